"""Mixture-controlled packing of token streams into fixed-length sequences.

Each source is a queue of documents. Deficit round-robin deals every window of
WINDOW_SEQUENCES sequences among the queues in the target proportions; the
fraction of a token that a queue is owed after a window is its deficit, carried
to the next window exactly (integers only). Documents are cut where a queue's
turn or a sequence ends, so only the last sequence is ever short.

A queue holds its documents in the input's order: by partition, then by row.
Positions follow from per-partition totals, so ids are never shuffled.

Defined results: null and empty texts are one end token; a null source is the
queue ""; repeated rows are packed as often as they occur; an empty table packs
nothing; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, checkpointed, kept

SEQUENCE = 2048
WINDOW_SEQUENCES = 16
END = 1
#: Word pieces that a worker keeps before they become the older generation.
CACHE = 400_000
#: ASCII marks that may be cut from the end of a piece; the apostrophe begins pieces of its own.
_MARKS = b'.,!?;:%$&*#|"()[]{}<>+=/@^~-_'
#: Rows of (partition, source) totals up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 100_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class WordTokenizer:
    """Ids of a tokenizer that drops white space and ignores ASCII case.

    Pieces between ASCII white space are looked up; of those that are new, the
    ASCII marks at the end are looked up apart, since the tokenizer never joins
    a letter and a mark. What is left is encoded in one call. Two generations of
    CACHE pieces each are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, new: list[bytes]) -> None:
        """Encode pieces that are not known yet."""
        for at in range(0, len(new), 4096):
            part = [p.decode("utf-8") for p in new[at : at + 4096]]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            start = np.cumsum([0, *(len(p) + 1 for p in part)])
            ids = np.array(e.ids, self.dtype)
            cut = np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), start)
            for k, piece in enumerate(new[at : at + 4096]):
                self.known[piece] = ids[cut[k] : cut[k + 1]].tobytes()

    def _learn(self, pieces: set[bytes]) -> None:
        """Make every one of the pieces known."""
        known, older = self.known, self.older
        parts: list[tuple[bytes, bytes, bytes]] = []
        new: dict[bytes, None] = {}
        for p in pieces:
            if p in older:
                known[p] = older[p]
                continue
            core = p.rstrip(_MARKS)
            last = core[-1:]
            if len(core) < len(p) and (b"a" <= last <= b"z" or last >= b"\x80" and core.decode("utf-8")[-1].lower()[-1].isalpha()):
                marks = p[len(core) :]
                parts.append((p, core, marks))
                for x in (core, marks):
                    if x not in known:
                        if x in older:
                            known[x] = older[x]
                        else:
                            new[x] = None
            else:
                new[p] = None
        self._encode([*new])
        for p, core, marks in parts:
            known[p] = known[core] + known[marks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids with the end token, as little-endian numbers."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        lower = [t.encode("utf-8", "replace").lower() if t else b"" for t in texts]
        whole = {i for i, t in enumerate(lower) if any(s in t for s in self.special)}  # strings of special tokens depend on case
        split = [[] if i in whole else t.split() for i, t in enumerate(lower)]
        self._learn(set().union(*split).difference(self.known))
        end, get = np.array([END], self.dtype).tobytes(), self.known.__getitem__
        out = [b"".join([*map(get, pieces), end]) for pieces in split]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.dtype).tobytes() + end
        return out


_loaded: dict[str, WordTokenizer] = kept.setdefault("tokenizer", {})


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, source, doc_id, local, n, ids): ids as little-endian numbers; local: ids of the queue before, in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokenizer")
        tok, before, part = tokenizer(path), {}, TaskContext.get().partitionId()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                ids = tok.encode(c.column(2).to_pylist())
                sources = c.column(1).to_pylist()
                n = [len(x) // tok.dtype.itemsize for x in ids]
                local = []
                for s, k in zip(sources, n, strict=True):
                    local.append(before.get(s, 0))
                    before[s] = local[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), c.column(1), c.column(0), pa.array(local, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["part", "source", "doc_id", "local", "n", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "part int, source string, doc_id long, local long, n long, ids binary")


@dataclass
class Phase:
    """Windows dealt by one set of weights: at is the first position, size the tokens, low and weight by source, base what a source gave before."""

    at: int
    size: int
    total: int
    low: dict[str, int]
    weight: dict[str, int]
    base: dict[str, int]


class Schedule:
    """Where the tokens of each queue go. Without a mixture the queues' own shares are the target; queues outside a mixture follow once it is spent."""

    def __init__(self, totals: dict[str, int], mixture: dict[str, float] | None = None, window: int = WINDOW_SEQUENCES * SEQUENCE):
        self.window, self.phases = window, []
        left = {s: n for s, n in sorted(totals.items()) if n}
        self.given = dict.fromkeys(left, 0)
        if mixture is None:
            self._phase(dict(left), sum(left.values()))
            left = {}
        target = {s: Fraction(p).limit_denominator(10**6) for s, p in (mixture or {}).items() if p > 0}
        while left:
            share = {s: target[s] for s in left if s in target} or {s: Fraction(n) for s, n in left.items()}
            unit = 1
            for f in share.values():
                unit = unit * f.denominator
            weight = {s: int(f * unit) for s, f in share.items()}
            whole = sum(weight.values())
            windows = min(left[s] * whole // (w * window) for s, w in weight.items())
            while windows and any(self._taken(windows * window, weight, s, whole) > left[s] for s in weight):
                windows -= 1
            if windows:
                took = {s: self._taken(windows * window, weight, s, whole) for s in weight}
                self._phase(weight, windows * window)
            else:  # some queue runs dry in this window: the others fill it
                took, room, open_ = {}, window, dict(weight)
                while open_ and room:
                    dry = [s for s in open_ if left[s] * sum(open_.values()) <= open_[s] * room]
                    if not dry:
                        took |= {s: self._taken(room, open_, s, sum(open_.values())) for s in open_}
                        break
                    for s in dry:
                        took[s] = min(left[s], room)
                        room -= took[s]
                        del open_[s]
                took = {s: n for s, n in sorted(took.items()) if n}
                self._phase(took, sum(took.values()))
            left = {s: n - took.get(s, 0) for s, n in left.items() if n > took.get(s, 0)}
        self.starts = {s: [p.base[s] if s in p.base else None for p in self.phases] for s in self.given}
        self.of = {s: [(p.base[s], p) for p in self.phases if s in p.weight] for s in self.given}

    @staticmethod
    def _taken(tokens: int, weight: dict[str, int], source: str, whole: int) -> int:
        low = 0
        for s, w in weight.items():
            if s == source:
                return tokens * (low + w) // whole - tokens * low // whole
            low += w
        return 0

    def _phase(self, weight: dict[str, int], size: int) -> None:
        low, run = {}, 0
        for s, w in weight.items():
            low[s], run = run, run + w
        at = self.phases[-1].at + self.phases[-1].size if self.phases else 0
        self.phases.append(Phase(at, size, run, low, weight, {s: self.given[s] for s in weight}))
        for s, w in weight.items():
            self.given[s] += size * (low[s] + w) // run - size * low[s] // run

    def places(self, source: str, first: int, n: int) -> Iterator[tuple[int, int]]:
        """(position, length) of the queue's tokens first .. first + n."""
        phases = self.of[source]
        at = bisect_right(phases, first, key=lambda x: x[0]) - 1
        while n > 0:
            base, p = phases[at]
            low, high = p.low[source], p.low[source] + p.weight[source]
            x = first - base
            k = max(0, x * p.total // (p.weight[source] * self.window) - 1)
            while True:
                a, b = min(k * self.window, p.size), min((k + 1) * self.window, p.size)
                la, lb = a * low // p.total, b * low // p.total
                begin, end = a * high // p.total - la, b * high // p.total - lb
                if x < end:
                    took = min(n, end - x)
                    yield p.at + a + (lb - la) + (x - begin), took
                    first, x, n = first + took, x + took, n - took
                    if not n:
                        return
                elif b == p.size:
                    break
                k += 1
            at += 1


def packed(
    docs: DataFrame, path: str, mixture: dict[str, float] | None = None, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per piece; sequences are gapless from position 0 and full but for the last."""
    rows = checkpointed(tokenized(docs, path, id_col, text_col, source_col))
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = checkpointed(sums.select("source", "part", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")))
    schedule = Schedule({r.source: r.n for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}, mixture, window_sequences * sequence)
    before = sums.select("source", "part", "before")
    placed = rows.join(F.broadcast(before) if before.count() <= BROADCAST_ROWS else before, ["source", "part"])
    dtype = tokenizer(path).dtype.str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = zlib.crc32
        for b in batches:
            out: list[tuple] = []
            for source, doc, first, n, ids in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                wide, at = np.frombuffer(ids, dtype).astype("<u4"), 0
                for position, length in schedule.places(source, first, n):
                    while length:
                        k = min(length, sequence - position % sequence)
                        out.append((doc, at, k, crc(wide[at : at + k]), n, position // sequence, position % sequence))
                        at, position, length = at + k, position + k, length - k
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 7)], _COLUMNS)

    return placed.select("source", "doc_id", (F.col("local") + F.col("before")).alias("first"), "n", "ids").mapInArrow(run, SCHEMA)
