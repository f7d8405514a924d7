"""Token counts as rollups that signed deltas maintain.

A batch of events (insert, revise, delete) becomes signed rows: what a document
counted before with -1, what it counts now with +1. Their sums by source,
language, tokenizer and version add to the totals; the totals are the sums over
all committed batches and never need a recount.

A batch's tables are written to a folder of their own, which a numbered manifest
then names: creating that small file, which must not exist, is the commit.
Committing a batch id again changes nothing, a failed job leaves a folder that
nothing names, and of two writers that race for a number one starts over. After
COMPACT batches the state is written as one, so that a commit never reads more
than that many tables and one base.

Defined results: null and empty texts count 0 tokens and one document; null
sources and languages are groups of their own; of several events of a document
in a batch the one with the highest seq holds (ties: the larger operation name,
then larger values), so repeated rows count once; an event of a later batch
holds only if its seq is larger than the document's so far, deletes included, so
late and early arrivals give the same totals; deletes of unknown documents change
no total, but keep older events out; empty batches change nothing; rows without
an id are left out; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table_folder

COMPACT = 8
#: (name, version) -> token count of a text column that isn't null. All are built-in functions.
TOKENIZERS: dict[tuple[str, int], Callable[[Column], Column] | Vocabulary] = {
    ("words", 1): lambda t: F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
    ("bytes4", 1): lambda t: F.ceil(F.octet_length(t) / 4).cast("long"),
    ("chars", 1): lambda t: F.length(t).cast("long"),
}
GROUPS = ["source", "lang", "tokenizer", "version"]
_COUNTS = "array<struct<tokenizer string, version int, tokens long>>"
_STATE = f"doc_id long, seq long, alive boolean, source string, lang string, counts {_COUNTS}"
_ROLLUP = "source string, lang string, tokenizer string, version int, n_docs long, n_tokens long"


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer that a vocabulary file describes: kind is "word" (tokenizers, word ends, no white space) or "ranks" (byte pairs by tiktoken, with the pattern that splits a text)."""

    kind: str
    path: str
    pattern: str = ""

    def counter(self) -> Callable[[list[str]], list[int]]:
        """Token counts of texts; loaded once in a worker."""
        if self not in _loaded:
            _loaded[self] = self._load()
        return _loaded[self]

    def _load(self) -> Callable[[list[str]], list[int]]:
        if self.kind == "word":
            from .packing import tokenizer

            words = tokenizer(self.path)
            return lambda texts: [len(x) // words.dtype.itemsize - 1 for x in words.encode(texts)]
        import base64

        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        byte_pairs = tiktoken.Encoding("counts", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(byte_pairs.encode_ordinary(t)) for t in texts]


_loaded: dict[Vocabulary, Callable] = {}


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict | None = None, compact_after: int = COMPACT):
        self.spark, self.folder, self.tokenizers, self.compact_after = spark, folder.rstrip("/"), tokenizers or TOKENIZERS, compact_after

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifests(self) -> list[tuple[int, dict]]:
        """(number, manifest) of all commits in order; one that its writer didn't finish counts for nothing."""
        fs, path = self._path("commits")
        out = []
        for s in fs.listStatus(path) if fs.exists(path) else []:
            stream = fs.open(s.getPath())
            try:
                raw = bytes(stream.readAllBytes())
            finally:
                stream.close()
            try:
                out.append((int(s.getPath().getName()), json.loads(raw)))
            except ValueError:
                out.append((int(s.getPath().getName()), {}))
        return sorted(out, key=lambda x: x[0])

    def committed(self) -> list[str]:
        return sorted(m["batch"] for _, m in self._manifests() if m.get("batch") is not None)

    def _create(self, number: int, manifest: dict) -> bool:
        """Create the manifest of that number; False if there is one."""
        fs, path = self._path(f"commits/{number:08d}")
        if fs.exists(path):
            return False
        try:
            stream = fs.create(path, False)
        except Exception:
            if fs.exists(path):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        return True

    @staticmethod
    def _since_base(manifests: list[tuple[int, dict]]) -> list[dict]:
        """The last base and the batches after it."""
        valid = [m for _, m in manifests if m]
        start = max((i for i, m in enumerate(valid) if m["batch"] is None), default=0)
        return valid[start:]

    def _read(self, part: str, schema: str, manifests: list[tuple[int, dict]]) -> DataFrame:
        found = [f"{self.folder}/data/{m['data']}/{part}" for m in self._since_base(manifests)]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _current(self, manifests: list[tuple[int, dict]]) -> DataFrame:
        """The last state of each document ever seen."""
        last = self._read("state", _STATE, manifests).groupBy("doc_id").agg(F.max_by(F.struct("seq", "alive", "source", "lang", "counts"), "seq").alias("s"))
        return last.select("doc_id", "s.*")

    def documents(self) -> DataFrame:
        """What each current document counts, a row for each tokenizer."""
        rows = self._current(self._manifests()).where("alive")
        return rows.select("doc_id", "source", "lang", F.explode("counts").alias("c")).select("doc_id", "source", "lang", "c.tokenizer", "c.version", "c.tokens")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, version, n_docs, n_tokens) of the current documents."""
        return self._sums(self._read("rollup", _ROLLUP, self._manifests()))

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*GROUPS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")

    def _counted(self, events: DataFrame) -> DataFrame:
        """Events with counts in place of texts."""
        text = F.coalesce("text", F.lit(""))
        native = {k: c for k, c in self.tokenizers.items() if not isinstance(c, Vocabulary)}
        own = {k: c for k, c in self.tokenizers.items() if isinstance(c, Vocabulary)}
        fixed = [F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("string").alias("op"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")]
        rows = events.where("doc_id is not null").select(*fixed, *(c(text).alias(f"n{i}") for i, c in enumerate(native.values())), text.alias("text"))
        if own:
            kept = rows.columns[:-1]
            names = [*kept, *(f"v{i}" for i in range(len(own)))]

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                counters = [v.counter() for v in own.values()]
                for b in batches:
                    for at in range(0, b.num_rows, 1024):
                        c = b.slice(at, 1024)
                        texts = c.column(len(kept)).to_pylist()
                        yield pa.RecordBatch.from_arrays([*c.columns[:-1], *(pa.array(count(texts), pa.int64()) for count in counters)], names)

            rows = rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1]) + "".join(f", v{i} long" for i in range(len(own))))
        columns = {k: f"n{i}" for i, k in enumerate(native)} | {k: f"v{i}" for i, k in enumerate(own)}
        counts = F.array(*(F.struct(F.lit(n).alias("tokenizer"), F.lit(v).cast("int").alias("version"), F.col(columns[n, v]).cast("long").alias("tokens")) for n, v in self.tokenizers))
        return rows.select("doc_id", F.struct("seq", "op", "source", "lang", counts.alias("counts")).alias("e"))

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply (op, seq, doc_id, source, lang, text) rows; False if the batch was committed before."""
        while True:
            manifests = self._manifests()
            if any(m.get("batch") == batch for _, m in manifests):
                return False
            data = f"{uuid.uuid4().hex}"
            self._write(data, events, manifests)
            number = manifests[-1][0] + 1 if manifests else 0
            if self._create(number, {"batch": batch, "data": data}):
                break
            self._drop(data)  # another writer was first: what it changed counts
        if len(self._since_base([*manifests, (number, {"batch": batch, "data": data})])) > self.compact_after:
            self.compact()
        return True

    def _write(self, data: str, events: DataFrame, manifests: list[tuple[int, dict]]) -> None:
        at = f"{self.folder}/data/{data}"
        # counted before the shuffle, which then carries no texts
        last = self._counted(events).groupBy("doc_id").agg(F.max("e").alias("e"))
        new = last.select("doc_id", "e.seq", (F.col("e.op") != "delete").alias("alive"), "e.source", "e.lang", "e.counts")
        none = F.lit(None)
        if any(m for _, m in manifests):
            old = self._current(manifests).select("doc_id", F.col("seq").alias("old_seq"), F.struct("alive", "source", "lang", "counts").alias("old"))
            rows = new.join(old, "doc_id", "left").where("old_seq is null or seq > old_seq").drop("old_seq")
        else:
            rows = new.withColumn("old", none.cast(f"struct<alive boolean, source string, lang string, counts {_COUNTS}>"))
        rows.write.parquet(f"{at}/state")
        changes = self.spark.read.schema(f"{_STATE}, old struct<alive boolean, source string, lang string, counts {_COUNTS}>").parquet(f"{at}/state")
        plus = changes.where("alive").select("source", "lang", F.explode("counts").alias("c"), F.lit(1).alias("sign"))
        minus = changes.where("old.alive").select("old.source", "old.lang", F.explode("old.counts").alias("c"), F.lit(-1).alias("sign"))
        signed = plus.unionByName(minus).select("source", "lang", "c.tokenizer", "c.version", "c.tokens", "sign")
        signed.groupBy(*GROUPS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens")).write.parquet(f"{at}/rollup")

    def compact(self) -> bool:
        """Write the state and the totals as one base; False if another writer was first. Folders that no manifest since the base names may then be removed (vacuum)."""
        manifests, data = self._manifests(), uuid.uuid4().hex
        if not manifests:
            return False
        self._current(manifests).write.parquet(f"{self.folder}/data/{data}/state")
        self._sums(self._read("rollup", _ROLLUP, manifests)).write.parquet(f"{self.folder}/data/{data}/rollup")
        if self._create(manifests[-1][0] + 1, {"batch": None, "data": data}):
            return True
        self._drop(data)
        return False

    def vacuum(self) -> None:
        """Remove the tables that no reader needs any more; only while nobody writes."""
        fs, path = self._path("data")
        used = {m["data"] for m in self._since_base(self._manifests())}
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)

    def _drop(self, data: str) -> None:
        fs, path = self._path(f"data/{data}")
        fs.delete(path, True)


def temporary(spark: SparkSession, tokenizers: dict | None = None) -> Rollup:
    """A ledger in a new folder of the shared one."""
    return Rollup(spark, table_folder(spark, "rollup"), tokenizers)
