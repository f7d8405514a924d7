"""Scans over DataFrames of (path, content): one pass in Arrow batches, no shuffle before caps."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ScanConfig
from ..rules.model import Ruleset
from .engine import Engine

_LONG = "line col end_line end_col col_utf16 end_col_utf16".split(), "start_offset end_offset secret_start_offset secret_end_offset".split()
FINDING = T.StructType(
    [
        T.StructField("file", T.StringType()),
        *(T.StructField(n, T.LongType()) for n in _LONG[0]),
        *(T.StructField(n, T.StringType()) for n in ("rule_id", "description", "matched")),
        T.StructField("entropy", T.DoubleType()),
        *(T.StructField(n, T.LongType()) for n in _LONG[1]),
        *(T.StructField(n, T.StringType()) for n in ("fingerprint", "commit")),
        T.StructField("context_lines", T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("content", T.StringType())]))),
    ]
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The key of keyed fingerprints is read from here on the driver, for each scan.
KEY_VARIABLE = "SIEVEGLASS_FINGERPRINT_KEY"


def fingerprint_key() -> bytes | None:
    return os.environ.get(KEY_VARIABLE, "").encode() or None


_engines: dict[str, Engine] = {}


def _engine(shared, name: str) -> Engine:
    """The worker's engine for a broadcast ruleset, by the scan's name."""
    if name not in _engines:
        _engines.clear()
        _engines[name] = Engine(*shared.value)
    return _engines[name]


def scan(docs: DataFrame, rules: Ruleset, config: ScanConfig, path_col: str = "path", content_col: str = "content", redacted: bool = False) -> DataFrame:
    """The input's columns with findings ARRAY, findings_truncated and, if asked for, redacted_content of the content's type.

    Null content has no findings and stays null; texts over max_file_size are
    neither scanned nor passed on: oversized is true and their redaction null.
    """
    content = docs.schema[content_col].dataType
    limit, names = config.max_file_size, docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("findings", T.ArrayType(FINDING)), T.StructField("findings_truncated", T.BooleanType()), T.StructField("oversized", T.BooleanType())])
    if redacted:
        schema = schema.add("redacted_content", content)
    shared, name = docs.sparkSession.sparkContext.broadcast((rules, config, fingerprint_key())), uuid.uuid4().hex
    at_path, at_content = names.index(path_col), names.index(content_col)
    text = isinstance(content, T.StringType)
    from pyspark.sql.pandas.types import to_arrow_type

    found_type = to_arrow_type(T.ArrayType(FINDING))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(shared, name)
        for b in batches:
            found, cut, over, clean = [], [], [], []
            for path, value in zip(b.column(at_path).to_pylist(), b.column(at_content).to_pylist(), strict=True):
                data = value.encode("utf-8", "replace") if text and value is not None else value
                large = data is not None and len(data) > limit
                if data is None or large:
                    rows, out, more = [], None, False
                elif redacted:
                    rows, out, more = engine.scan_and_redact(path or "", data)
                else:
                    rows, out = engine.scan(path or "", data), None
                    cap = config.max_findings_per_file
                    more = cap is not None and len(rows) > cap
                    rows = rows[:cap] if more else rows
                found.append(rows)
                cut.append(more)
                over.append(large)
                clean.append(out.decode("utf-8") if text and out is not None else out)
            columns = [*b.columns, pa.array(found, found_type), pa.array(cut, pa.bool_()), pa.array(over, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(clean, b.column(at_content).type)] if redacted else columns, schema.names)

    return docs.mapInArrow(run, schema)


def findings(scanned: DataFrame) -> DataFrame:
    """One row per finding; emit_ord is its place in the document's emission order."""
    return scanned.select(F.posexplode("findings").alias("emit_ord", "f")).select("f.*", "emit_ord")


def native_findings(docs: DataFrame, rule_id: str, pattern: str, least_entropy: float | None, keyword: str | None, namespace: str = "sieveglass", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Findings of one simple pattern, within the JVM: (file, rule_id, line, col, start_offset, end_offset, secret, entropy, fingerprint).

    The pattern must not match the empty string; the secret is the whole match.
    """
    from ..functions import columns as X
    from ..rules.dialect import to_java
    from ..rules.model import ascii_lower

    java, text = to_java(pattern), F.col(text_col)
    rows = docs.where(F.contains(F.translate(text, UPPER, UPPER.lower()), F.lit(ascii_lower(keyword)))) if keyword else docs
    rows = rows.where(text.rlike(java))
    hits = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    rows = rows.select(F.col(path_col).alias("file"), hits.alias("_hits"), F.split(text, java, -1).alias("_gaps"))
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def after(at: Column, piece: Column) -> Column:
        # bytes, line feeds and bytes since the last one, before and with the piece
        tail = F.when(F.contains(piece, F.lit("\n")), F.octet_length(F.substring_index(piece, "\n", -1))).otherwise(at["tail"] + F.octet_length(piece))
        return F.struct((at["bytes"] + F.octet_length(piece)).alias("bytes"), (at["lines"] + newlines(piece)).alias("lines"), tail.cast("long").alias("tail"))

    zero = F.lit(0).cast("long")
    pieces = F.transform("_hits", lambda h, i: F.struct(F.get("_gaps", i).alias("gap"), h.alias("hit")))
    starts = F.aggregate(pieces, F.array(F.struct(zero.alias("bytes"), zero.alias("lines"), zero.alias("tail"))), lambda done, p: F.concat(done, F.array(after(F.element_at(done, -1), F.concat(p["gap"], p["hit"])))))
    # the starts are computed once and bound; a row of the result carries its own finding only
    found = F.get(F.transform(F.array(starts), lambda known: F.transform("_hits", lambda h, i: F.struct(h.alias("secret"), after(F.get(known, i), F.get("_gaps", i)).alias("at")))), F.lit(0))
    rows = rows.select("file", F.explode(found).alias("_f")).select("file", F.col("_f.secret").alias("secret"), F.col("_f.at").alias("_at"))
    out = rows.select(
        "file", F.lit(rule_id).alias("rule_id"), (F.col("_at.lines") + 1).alias("line"), (F.col("_at.tail") + 1).alias("col"), F.col("_at.bytes").alias("start_offset"),
        (F.col("_at.bytes") + F.octet_length("secret")).alias("end_offset"), "secret", X.entropy(F.col("secret")).alias("entropy"), X.finding_fingerprint(F.lit(rule_id), F.col("file"), F.col("secret"), namespace).alias("fingerprint"),
    )
    return out if least_entropy is None else out.where((F.octet_length("secret") >= 8) & (F.col("entropy") >= least_entropy))
