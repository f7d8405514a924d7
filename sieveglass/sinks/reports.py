"""Reports: text, JSON, JSON lines, SARIF, baselines. Tables stay distributed; single documents are written by the driver, a batch of rows at a time."""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ScanError
from ..functions import columns as X
from ..operators.detect import FINDING
from ..operators.engine import MARKER
from ..operators.relations import sorted_findings

FIELDS = ["rule_id", "description", "file", "line", "col", "end_line", "end_col", "col_utf16", "end_col_utf16", "matched", "entropy", "start_offset", "end_offset", "secret_start_offset", "secret_end_offset", "fingerprint"]


def json_object(context: bool = False) -> Column:
    """One finding as JSON; commit and context only where there are any."""
    cols = [F.col(c) if c != "entropy" else F.col(c).cast("decimal(18,6)").alias(c) for c in FIELDS]
    cols.append(F.col("commit"))
    if context:
        cols.append(F.when(F.size("context_lines") > 0, F.col("context_lines")).alias("context"))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "true"})


def text_lines(context: bool = False) -> Column:
    """A finding as text of our own layout: place, rule, what is shown; then its description and lines around it."""
    place = F.format_string("%s:%d:%d", X.sanitize_display(F.col("file")), "line", "col")
    about = F.concat(F.col("rule_id"), F.when(F.col("description") != "", F.concat(F.lit(" ("), X.sanitize_display(F.col("description")), F.lit(")"))).otherwise(""))
    shown = F.format_string("entropy %.2f, shown as %s", "entropy", X.sanitize_display(F.col("matched")))
    rows = [F.concat_ws("  ", place, about, F.concat(F.lit("@"), F.substring("commit", 1, 12))), F.concat(F.lit("    "), shown)]
    if context:
        show = lambda x: F.format_string("    %s%6d  %s", F.when(x["line"] == F.col("line"), "*").otherwise(" "), x["line"], X.sanitize_display(x["content"]))
        rows.append(F.when(F.size("context_lines") > 0, F.array_join(F.transform("context_lines", show), "\n")))
    return F.array_join(F.array(*rows), "\n")


def write_table(findings: DataFrame, path: str, fmt: str = "jsonl", context: bool = False) -> None:
    """Distributed report: a folder of JSON lines or text."""
    findings.select((json_object(context) if fmt == "jsonl" else text_lines(context)).alias("value")).write.text(path)


def private_file(path: str):
    """A file only its owner may read; links and special files are refused."""
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_NOFOLLOW, 0o600)
    if not stat.S_ISREG(os.fstat(fd).st_mode):
        os.close(fd)
        raise ScanError(f"{path} is not a regular file")
    os.fchmod(fd, 0o600)
    os.ftruncate(fd, 0)
    return os.fdopen(fd, "w", encoding="utf-8")


def render(findings: DataFrame, fmt: str, context: bool = False, base: str = "", namespace: str = "sieveglass") -> Iterator[str]:
    """Parts of a report in final order."""
    rows = sorted_findings(findings)
    if fmt == "text":
        n = findings.count()
        yield f"{n} finding{'s' * (n != 1)}\n"
        for r in rows.select(text_lines(context).alias("v")).toLocalIterator():
            yield r.v + "\n"
    elif fmt in ("json", "jsonl"):
        first = True
        if fmt == "json":
            yield "["
        for r in rows.select(json_object(context).alias("v")).toLocalIterator():
            yield ("" if first else ",") + r.v if fmt == "json" else r.v + "\n"
            first = False
        if fmt == "json":
            yield "]\n"
    elif fmt == "sarif":
        yield from sarif(rows, base, namespace)
    else:
        raise ScanError(f"unknown format {fmt}")


def sarif(rows: DataFrame, base: str = "", namespace: str = "sieveglass") -> Iterator[str]:
    """SARIF 2.1.0; messages never hold a match."""
    uri = X.relativize(F.col("file"), base)
    shown = rows.select(
        "rule_id", "description", "entropy", "commit", uri.alias("uri"), X.sarif_region(*(F.col(c) for c in ("line", "end_line", "col", "end_col", "col_utf16", "end_col_utf16"))).alias("region"),
        X.sarif_fingerprint(F.col("fingerprint"), X.location_fingerprint(F.col("rule_id"), uri, F.col("start_offset"), F.col("end_offset"), namespace)).alias("fp"),
    )
    rules: dict[str, int] = {}
    about: list[dict] = []
    yield '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"automationDetails":{"id":' + json.dumps(f"{namespace}/scan") + '},"results":['
    first = True
    for r in shown.toLocalIterator():
        if r.rule_id not in rules:
            rules[r.rule_id] = len(rules)
            about.append({"id": r.rule_id, "name": r.rule_id, "shortDescription": {"text": r.description}})
        result = {
            "ruleId": r.rule_id, "ruleIndex": rules[r.rule_id], "level": "error", "message": {"text": f"Potential secret detected by rule {r.rule_id} (entropy {r.entropy:.2f})"},
            "partialFingerprints": {f"{namespace}/v2": r.fp}, "properties": {"commit": r.commit} if r.commit else {},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.uri, "uriBaseId": "SRCROOT"}, "region": r.region.asDict()}}],
        }
        yield ("" if first else ",") + json.dumps(result, ensure_ascii=False)
        first = False
    driver = {"name": namespace, "version": "0.1.0", "rules": about}
    yield '],"tool":{"driver":' + json.dumps(driver, ensure_ascii=False) + "}}]}\n"


def baseline_rows(findings: DataFrame) -> DataFrame:
    """What a baseline keeps: no context, no match."""
    return findings.withColumn("context_lines", F.array().cast(FINDING["context_lines"].dataType)).withColumn("matched", F.lit(MARKER))


def write_baseline(findings: DataFrame, path: str) -> None:
    with private_file(path) as f:
        f.write("[")
        for k, r in enumerate(sorted_findings(baseline_rows(findings)).select(F.to_json(F.struct(*FINDING.names)).alias("v")).toLocalIterator()):
            f.write(("," if k else "") + r.v)
        f.write("]\n")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a baseline file; missing locations are 0, unknown keys are ignored."""
    rows = spark.read.schema(FINDING).option("multiLine", True).option("mode", "FAILFAST").json(path)
    zero = [f.name for f in FINDING.fields if f.dataType.typeName() == "long"]
    return rows.fillna(0, zero).fillna("", ["fingerprint", "matched", "description"])
