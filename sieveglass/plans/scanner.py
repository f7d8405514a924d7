"""The Scanner: rules and options applied to any DataFrame, folder or repository."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..errors import GitFailed, IncompleteCoverage, InputTooLarge, NotHardened
from ..functions import columns as X
from ..operators import detect
from ..operators import relations as R
from ..operators.engine import Engine
from ..rules import model
from ..rules.dialect import to_java
from ..sources import files, git, rulesets

DEFAULT_RULES = Path(__file__).resolve().parent.parent / "rules" / "default.toml"


@dataclass
class ScanReport:
    """Findings in final order and a row of statistics; release() gives up what is kept for both."""

    findings: DataFrame
    stats: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for d in self.held:
            d.unpersist()

    def exit_code(self, no_fail: bool = False, error_on_unreadable: bool = False, error_on_skipped: bool = False) -> int:
        """2 for incomplete coverage, then 1 for findings; rules that don't load are 3, before any scan."""
        s = self.stats.first()
        if s.git_failed or s.history_timed_out or error_on_unreadable and s.errored or error_on_skipped and s.binary_skipped + s.oversized_skipped:
            return 2
        return 0 if no_fail or self.findings.isEmpty() else 1

    def strict(self) -> ScanReport:
        """Raise unless everything was covered."""
        if R.incomplete(self.stats).first().incomplete:
            raise IncompleteCoverage("the scan is incomplete")
        return self


class Scanner:
    def __init__(self, rules: model.Ruleset, config: ScanConfig | None = None):
        self.rules, self.config = rules, config or ScanConfig()

    @classmethod
    def bundled(cls, config: ScanConfig | None = None) -> Scanner:
        return cls.from_file(str(DEFAULT_RULES), config)

    @classmethod
    def resolved(cls, config: ScanConfig | None = None) -> Scanner:
        """Rules that the environment names, else of the verified cache, else the bundled ones."""
        return cls(model.load(rulesets.resolve()), config)

    @classmethod
    def from_file(cls, path: str, config: ScanConfig | None = None, strict: bool = False) -> Scanner:
        return cls(model.load(Path(path).read_text("utf-8"), strict), config)

    @classmethod
    def from_toml(cls, toml: str, config: ScanConfig | None = None) -> Scanner:
        return cls(model.load(toml, True), config)

    def with_config(self, config: ScanConfig) -> Scanner:
        return Scanner(self.rules, config)

    # introspection

    def rules_df(self, spark: SparkSession) -> DataFrame:
        rows = [(r.id, r.description, r.regex, list(r.keywords), r.entropy, r.path, r.secret_group, i) for i, r in enumerate(self.rules.rules)]
        return spark.createDataFrame(rows, "rule_id string, description string, regex string, keywords array<string>, entropy double, path string, secret_group int, rule_ord int")

    def keyword_index_df(self, spark: SparkSession) -> DataFrame:
        ids = [r.id for r in self.rules.keyworded]
        return spark.createDataFrame([(k, ids[i]) for k, at in self.rules.keyword_index().items() for i in at], "keyword string, rule_id string")

    # DataFrames

    def scan(self, docs: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
        """Findings in emission order per document, capped per document."""
        return detect.findings(detect.scan(docs, self.rules, self.config, path_col, content_col))

    def scan_and_redact(self, docs: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
        """The rows with findings, redacted_content and findings_truncated; every finding is redacted, also those beyond the cap."""
        return detect.scan(docs, self.rules, self.config, path_col, content_col, redacted=True)

    def redact_untrusted(self, docs: DataFrame, content_col: str = "content") -> DataFrame:
        """For proxies: needs a hardened configuration; also valid on streams."""
        if not self.config.hardened:
            raise NotHardened("redacting untrusted text needs ScanConfig.proxy()")
        return self.scan_and_redact(docs.withColumn("path", F.lit("<proxy>")), "path", content_col)

    # one document, on the driver

    def scan_content(self, path: str, content: str) -> list[dict]:
        return self.scan_bytes(path, content.encode("utf-8"))

    def scan_bytes(self, path: str, content: bytes) -> list[dict]:
        return Engine(self.rules, self.config, detect.fingerprint_key()).scan_and_redact(path, content)[0]

    def redact_content(self, path: str, content: str) -> tuple[list[dict], str, bool]:
        found, out, cut = Engine(self.rules, self.config, detect.fingerprint_key()).scan_and_redact(path, content.encode("utf-8"))
        return found, out.decode("utf-8"), cut

    def scan_proxy(self, content: bytes) -> tuple[list[dict], bytes, bool]:
        if not self.config.hardened:
            raise NotHardened("scan_proxy needs ScanConfig.proxy()")
        if len(content) > self.config.max_file_size:
            raise InputTooLarge(f"{len(content)} bytes; the limit is {self.config.max_file_size}")
        return Engine(self.rules, self.config, detect.fingerprint_key()).scan_and_redact("<proxy>", content)

    # files and repositories

    def scan_files(self, rows: DataFrame, over_cap: int | None = None, errored: int = 0, oversized: int = 0, **flags) -> ScanReport:
        """Findings and statistics of (path, content BINARY) rows, or of rows with their length too.

        over_cap: files that a listing has left out already; errored, oversized:
        what it counted apart. A cap on findings ends the scan with the file, in
        path order, in which it is reached.
        """
        c, late = self.config, False
        engine_allow = F.lit(False)
        for a in self.rules.allowlists:
            if a.target_rules or not a.paths or a.all_of and (a.regexes or a.stopwords):
                continue
            for p in a.paths:
                engine_allow = engine_allow | F.col("path").rlike(to_java(p))
        if c.max_files is not None and over_cap is None:
            listed = rows.where(X.should_scan(F.col("path"), c.binary != "scan") & ~engine_allow)
            over_cap = max(0, listed.count() - c.max_files)
            rows = listed.join(R.first_files(listed.select("path"), c.max_files), "path", "left_semi")
        if c.max_findings == 0:
            late, rows = not rows.isEmpty(), rows.limit(0)
        state = R.disposition(rows, c, engine_allow)
        # one pass reads the contents; only what it found is kept for findings and statistics
        rows = state.withColumn("content", F.when(F.col("disposition") == "scan", F.col("content")))
        state = detect.scan(rows.select("path", "disposition", "content"), self.rules, c).select("path", "disposition", "findings", "findings_truncated").persist()
        held, found = [state], detect.findings(state)
        if c.max_findings:
            found = R.cap_total(found, c.max_findings).persist()
            held.append(found)
            if found.count() >= c.max_findings:
                last = found.select(F.max(F.struct(R.path_order(F.col("file")).alias("o"), F.col("file").alias("file"))).alias("m")).select("m.file").first().file
                whole = state.where(F.col("path") == last).agg(F.sum(F.size("findings")).alias("n")).first().n > found.where(F.col("file") == last).count()
                kept = R.path_order(F.col("path")) <= F.split(F.lit(last), "/")
                late = whole or not state.where(~kept & ~F.col("disposition").isin("filtered", "allowlisted")).isEmpty()
                state = state.where(kept)
        stats = R.scan_stats(state, over_cap or 0, late, **flags)
        if errored or oversized:
            stats = stats.withColumns({"errored": F.col("errored") + errored, "oversized_skipped": F.col("oversized_skipped") + oversized})
        return ScanReport(R.sorted_findings(found.drop("emit_ord")), stats, held)

    def _only_flags(self, spark: SparkSession, errored: int = 0, **flags) -> ScanReport:
        """The report of a scan that read nothing."""
        return ScanReport(spark.createDataFrame([], detect.FINDING), R.scan_stats(spark.createDataFrame([("errored",)] * errored, "disposition string"), **flags))

    def _listed(self, spark: SparkSession, rows: list[tuple[str, str, int | None]], sized: bool = True, **flags) -> ScanReport:
        """Scan local files (path shown, path, size): policy and caps apply to their names and sizes, then only what is left is read."""
        c, engine = self.config, Engine(self.rules, self.config)
        policy = [r for r in rows if r[2] is None or files.wanted(r[0], c.binary != "scan") and not engine.path_allowed(r[0])]
        errored = sum(n is None for _, _, n in policy)
        kept = [r for r in policy if r[2] is not None and not (sized and r[2] > c.max_file_size)]
        oversized, over = len(policy) - errored - len(kept), 0
        if c.max_files is not None:
            kept.sort(key=lambda r: r[0].split("/"))
            over, kept = max(0, len(kept) - c.max_files), kept[: c.max_files]
        return self.scan_files(files.read(spark, [(*r, True) for r in kept], c.max_file_size), over, errored, oversized, **flags)

    def scan_file(self, spark: SparkSession, path: str) -> ScanReport:
        """One named file: a link, a special file or one that the path policy leaves out counts as an error, not as clean."""
        c = self.config
        if c.git_mode in ("staged", "history"):
            return self._only_flags(spark, git_failed=True)
        if not files.regular(path) or not files.wanted(path, c.binary != "scan") or Engine(self.rules, c).path_allowed(path):
            return self._only_flags(spark, 1)
        at = os.path.abspath(path)
        return self._listed(spark, [(path, at, os.lstat(at).st_size)])

    def scan_path(self, spark: SparkSession, root: str) -> ScanReport:
        """A folder, a file or a repository; findings show paths as they are given, relative ones too."""
        c, flags = self.config, {}
        if not files.local(root):
            return self.scan_files(files.directory(spark, root, c.max_file_size))
        if not os.path.isdir(root):
            return self.scan_file(spark, root)
        top, shown = os.path.abspath(root), root.rstrip("/") or "/"
        place = lambda name: (f"{shown}/{name}", os.path.join(top, name))
        try:
            if c.git_mode == "history":
                return self.scan_history(spark, root)
            if c.git_mode == "staged":
                return self._staged(spark, shown, top)
            if c.git_mode:
                names = git.tracked(top) if c.git_mode == "tracked" else git.changed(top, c.base)
                names += git.untracked(top) if c.include_untracked else []
                found = [(*place(n), os.lstat(os.path.join(top, n)).st_size if files.regular(os.path.join(top, n)) else None) for n in dict.fromkeys(names)]
                # links and special files are left out; what git lists and isn't there counts as an error
                return self._listed(spark, [r for r in found if r[2] is not None or not os.path.lexists(r[1])], False)
        except GitFailed:
            if not c.fallback_walk or c.git_mode == "history":
                return self._only_flags(spark, git_failed=True)
            flags = {"git_fallback": True}
        return self._listed(spark, [(*place(n), size) for n, size in files.walk(top)], **flags)

    def _staged(self, spark: SparkSession, shown: str, top: str) -> ScanReport:
        c, engine = self.config, Engine(self.rules, self.config)
        names = [n for n in git.staged(top) if files.wanted(f"{shown}/{n}", c.binary != "scan") and not engine.path_allowed(f"{shown}/{n}")]
        names.sort(key=lambda n: n.split("/"))
        cut = len(names) if c.max_files is None else c.max_files
        rows = ((f"{shown}/{n}", size, None if data is None else bytearray(data)) for n, data, size in git.staged_blobs(top, c.max_file_size, names[:cut]))
        return self.scan_files(files.batched(spark, rows, files.FILE, 2), max(0, len(names) - cut))

    def scan_history(self, spark: SparkSession, root: str) -> ScanReport:
        """Added lines of the history, a file diff at a time; the caps count in the order in which git prints."""
        c, engine = self.config, Engine(self.rules, self.config)
        top, shown = os.path.abspath(root), root.rstrip("/") or "/"
        if c.max_findings == 0:
            git.probe(top, c)
            return self._only_flags(spark, findings_truncated=True)
        over, late = 0, False

        def rows() -> Iterator[tuple]:
            nonlocal over, late
            whole = 0
            for arrival, d in enumerate(git.history(top, c, lambda p: files.wanted(p, c.binary != "scan") and not engine.path_allowed(p))):
                if d is None:
                    late = True
                elif d.oversized:
                    yield d.commit, f"{shown}/{d.path}", None, [], True, arrival
                elif c.max_files is not None and whole >= c.max_files:
                    over += 1
                else:
                    whole += 1
                    yield d.commit, f"{shown}/{d.path}", d.content, d.lines, False, arrival

        read = files.batched(spark, rows(), git.HISTORY_SCHEMA, 2)
        state = R.disposition(read.withColumn("length", F.when(F.col("oversized"), c.max_file_size + 1).otherwise(F.octet_length("content"))), c, F.lit(False))
        ok = state.where("disposition = 'scan'").select("commit", "path", "content", "line_map", "arrival")
        scanned = detect.scan(ok, self.rules, c).drop("content").persist()
        found = scanned.select("arrival", "line_map", F.col("commit").alias("_commit"), F.posexplode("findings").alias("emit_ord", "f")).select("arrival", "line_map", "f.*", "emit_ord", "_commit")
        found = R.remap_lines(found.withColumn("commit", F.col("_commit")).drop("_commit"))
        cut, last = False, None
        if c.max_findings is not None:
            found = found.orderBy("arrival", "emit_ord").limit(c.max_findings).persist()
            if found.count() >= c.max_findings:  # a reached cap is always told, and ends the scan
                cut, last = True, found.agg(F.max("arrival").alias("m")).first().m
        stats = state if last is None else state.where(F.col("arrival") <= last)
        stats = stats.select("disposition", "arrival").join(scanned.select("arrival", "findings_truncated"), "arrival", "left")
        held = [scanned, found] if c.max_findings is not None else [scanned]
        found = R.dedup_history(found.withColumn("arrival", F.struct("arrival", "emit_ord"))).select(*detect.FINDING.names)
        return ScanReport(R.sorted_findings(found), R.scan_stats(stats, over, cut or late, history_timed_out=late), held)


def safe_findings(findings: DataFrame) -> DataFrame:
    """Without matches, context and fingerprints: for tools that must not see secrets."""
    return findings.drop("matched", "context_lines", "fingerprint")


def register_functions(spark: SparkSession, scanner: Scanner) -> None:
    """SQL functions: secret_entropy(s), secret_redact(s) and secret_fingerprint(rule, file, secret), built of SQL expressions; the table function scan_secrets(path, content)."""
    from pyspark.sql.functions import udtf

    pairs = "regexp_extract_all(hex(encode(s, 'UTF-8')), '(..)', 1)"
    share = "(size(filter(p, y -> y = x)) / size(p))"
    total = f"aggregate(array_distinct(p), 0D, (a, x) -> a - {share} * log2({share}))"
    size = lambda x: "unhex(concat(" + ", ".join(f"lpad(hex(shiftrightunsigned(cast(octet_length({x}) AS bigint), {8 * k}) & 255), 2, '0')" for k in range(8)) + "))"
    parts = [f"'{scanner.config.namespace}/finding/v2'", "rule", "file", "secret"]
    digest = "concat('sha256:', sha2(concat(" + ", ".join(f"{size(x)}, encode({x}, 'UTF-8')" for x in parts) + "), 256))"
    bodies = {
        "secret_entropy(s STRING) RETURNS DOUBLE": f"CASE WHEN s IS NULL THEN NULL WHEN s = '' THEN 0D ELSE transform(array({pairs}), p -> {total})[0] END",
        "secret_redact(s STRING) RETURNS STRING": "CASE WHEN length(s) <= 12 THEN repeat('*', length(s)) ELSE concat(left(s, 4), repeat('*', length(s) - 8), right(s, 4)) END",
        "secret_fingerprint(rule STRING, file STRING, secret STRING) RETURNS STRING": digest,
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    rules, config, key = scanner.rules, scanner.config, detect.fingerprint_key()

    @udtf(returnType="rule_id string, line bigint, col bigint, matched string, entropy double, fingerprint string")
    class ScanSecrets:
        def __init__(self):
            self.engine = Engine(rules, config, key)

        def eval(self, path: str, content: str):
            for f in self.engine.scan_and_redact(path or "", (content or "").encode())[0]:
                yield f["rule_id"], f["line"], f["col"], f["matched"], f["entropy"], f["fingerprint"]

    spark.udtf.register("scan_secrets", ScanSecrets)
