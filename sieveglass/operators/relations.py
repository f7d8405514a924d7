"""Relational operators on findings: suppression, caps, order, spans, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ignore_rules(findings: DataFrame, ids: list[str]) -> DataFrame:
    return findings.where(~F.col("rule_id").isin(*ids)) if ids else findings


def suppress_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Drop what a baseline holds: by fingerprint, or by (file, line, rule_id) where a row has no usable one."""
    usable = F.coalesce(F.col("fingerprint").rlike("^(sha256|hmac-sha256):"), F.lit(False))
    by_print = baseline.where(usable).select("fingerprint").distinct()
    by_place = baseline.where(~usable).select("file", "line", "rule_id").distinct()
    return findings.join(by_print, "fingerprint", "left_anti").join(by_place, ["file", "line", "rule_id"], "left_anti").select(*findings.columns)


def cap_per_file(findings: DataFrame, n: int) -> DataFrame:
    """The first n findings of each file in emission order."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy("emit_ord"))
    return findings.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def path_order(path: Column) -> Column:
    """Sort key: component by component."""
    return F.split(path, "/")


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first n files in path order; a top-k, not a sort of all."""
    return files.orderBy(path_order(F.col("path"))).limit(n)


def cap_total(findings: DataFrame, n: int) -> DataFrame:
    """The first n findings by file order, then emission order."""
    return findings.orderBy(path_order(F.col("file")), "emit_ord").limit(n)


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "start_offset", "end_offset", "rule_id", F.asc_nulls_first("commit"), "line")


def dedup_history(findings: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The first arrival of each (commit, file, line, rule, fingerprint)."""
    keys = ["commit", "file", "line", "rule_id", "fingerprint"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(arrival))
    return findings.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Islands of overlapping or touching spans per key."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.where(F.col(start) < F.col(end)).withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def candidate_rules(docs: DataFrame, keyword_rules: DataFrame, text_col: str = "text") -> DataFrame:
    """(path, rule_id) of documents that hold one of a rule's keywords, ASCII case aside; keyword_rules: (keyword, rule_id), a ruleset's size. One automaton finds all keywords in one reading of a text."""
    from ..rules.model import ascii_lower

    index: dict[str, set[str]] = {}
    for r in keyword_rules.collect():
        index.setdefault(ascii_lower(r.keyword), set()).add(r.rule_id)
    always = sorted(index.pop("", ()))
    rows = docs.select(F.col("path").cast("string").alias("path"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, ids in index.items():
            automaton.add_word(k.encode().decode("latin-1"), tuple(sorted(ids)))  # bytes as characters
        if index:
            automaton.make_automaton()
        for b in batches:
            paths, found = [], []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                hit = {x for _, ids in automaton.iter(text.encode("utf-8", "replace").lower().decode("latin-1")) for x in ids} if index else set()
                hit.update(always)
                paths += [path] * len(hit)
                found += sorted(hit)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())], ["path", "rule_id"])

    return rows.mapInArrow(run, "path string, rule_id string")


def disposition(files: DataFrame, config, path_allowed: Column, content: str = "content") -> DataFrame:
    """What becomes of each file: empty, allowlisted, filtered, oversized, binary or scan."""
    from ..functions import columns as X

    c = F.col(content)
    binary = X.is_probably_binary(c)
    skip = F.lit(False) if config.binary == "scan" else binary if config.binary == "skip" else binary & ~X.is_source_like(F.col("path"))
    size = F.coalesce("length", F.octet_length(c)) if "length" in files.columns else F.octet_length(c)
    state = (
        F.when(~X.should_scan(F.col("path"), config.binary != "scan"), "filtered")
        .when(path_allowed, "allowlisted")
        .when(size > config.max_file_size, "oversized")
        .when(c.isNull(), "errored")
        .when(F.octet_length(c) == 0, "empty")
        .when(skip, "binary")
        .otherwise("scan")
    )
    return files.withColumn("disposition", state)


def scan_stats(dispositions: DataFrame, files_over_cap: int = 0, findings_truncated: bool = False, git_failed: bool = False, git_fallback: bool = False, history_timed_out: bool = False) -> DataFrame:
    """One row of counters and flags; rows that say findings_truncated of themselves set the flag too."""
    cut = F.coalesce(F.bool_or("findings_truncated"), F.lit(False)) if "findings_truncated" in dispositions.columns else F.lit(False)
    count = lambda *s: F.count_if(F.col("disposition").isin(*s))
    return dispositions.agg(
        count("scan", "empty").alias("files_scanned"), count("binary").alias("binary_skipped"), count("oversized").alias("oversized_skipped"), count("errored").alias("errored"), F.lit(files_over_cap).cast("long").alias("files_over_cap"),
        (cut | F.lit(findings_truncated)).alias("findings_truncated"), F.lit(git_failed).alias("git_failed"), F.lit(git_fallback).alias("git_fallback"), F.lit(history_timed_out).alias("history_timed_out"),
    )


def fold_stats(stats: DataFrame) -> DataFrame:
    """Statistics of several scans as one: counters add, flags or."""
    kinds = dict(stats.dtypes)
    return stats.agg(*((F.bool_or(c) if kinds[c] == "boolean" else F.sum(c)).alias(c) for c in stats.columns))


def coverage_reasons(stats: DataFrame) -> DataFrame:
    """Why coverage is incomplete, in a fixed order."""
    reason = lambda on, name: F.when(on, F.lit(name))
    rows = F.array_compact(
        F.array(
            reason(F.col("git_failed"), "GitFailed"), reason(F.col("history_timed_out"), "HistoryTimedOut"), reason(F.col("errored") > 0, "UnreadableFiles"),
            reason(F.col("binary_skipped") + F.col("oversized_skipped") > 0, "PolicySkipped"), reason(F.col("files_over_cap") > 0, "FileCapReached"),
        )
    )
    return stats.withColumn("reasons", rows)


def incomplete(stats: DataFrame) -> DataFrame:
    """The stricter API flags: incomplete (binary skips aside) and skipped_by_policy."""
    bad = (F.col("errored") > 0) | (F.col("oversized_skipped") > 0) | (F.col("files_over_cap") > 0) | F.col("history_timed_out") | F.col("git_failed") | F.col("git_fallback")
    return stats.withColumn("incomplete", bad).withColumn("skipped_by_policy", F.col("binary_skipped") + F.col("oversized_skipped"))


def rule_index(findings: DataFrame, order: str) -> DataFrame:
    """(rule_id, rule_index): rules by first appearance."""
    first = findings.groupBy("rule_id").agg(F.min(order).alias("_first"))
    return first.select("rule_id", (F.row_number().over(Window.orderBy("_first", "rule_id")) - 1).cast("long").alias("rule_index"))


def findings_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n_findings"), F.count_distinct("file").alias("n_files"))


def generic_parts(rules: DataFrame, least: int = 3) -> DataFrame:
    """(part): parts of rule ids that stand beside at least that many different first parts; they name a kind of secret, not whose it is."""
    from ..functions import columns as X

    ids = rules.select(X.id_parts(F.col("rule_id")).alias("p")).distinct().where(F.size("p") > 1)
    later = ids.select(F.element_at("p", 1).alias("first"), F.explode(F.slice("p", F.lit(2), F.size("p") - 1)).alias("part"))
    return later.groupBy("part").agg(F.count_distinct("first").alias("n")).where(F.col("n") >= least).select("part")


def vendor_clusters(rules: DataFrame, threshold: int = 2, least: int = 3) -> DataFrame:
    """Rules of one vendor from several sources: (stem, n_rules, n_sources). What is generic is learnt from the ids themselves, a ruleset's size."""
    from ..functions import columns as X

    generic = sorted(r.part for r in generic_parts(rules, least).collect())
    stem = rules.select(X.vendor_stem(F.col("rule_id"), generic).alias("stem"), "source").where("stem is not null")
    return stem.groupBy("stem").agg(F.count("*").alias("n_rules"), F.count_distinct("source").alias("n_sources")).where((F.col("n_rules") >= threshold) & (F.col("n_sources") >= 2))


def remap_lines(findings: DataFrame) -> DataFrame:
    """Lines of a history buffer to lines of the new file, through line_map ARRAY<BIGINT>; offsets stay the buffer's."""
    at = lambda c: F.coalesce(F.try_element_at("line_map", F.col(c).cast("int")), F.col(c))
    context = F.transform("context_lines", lambda x: F.struct(F.coalesce(F.try_element_at("line_map", x["line"].cast("int")), x["line"]).alias("line"), x["content"].alias("content")))
    return findings.withColumns({"line": at("line"), "end_line": at("end_line"), "context_lines": context}).drop("line_map")
