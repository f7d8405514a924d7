"""Command line: scan, validate-rules, merge-rules, list-rules, update-rules.

Exit codes of a scan: 3 rules that can't be loaded, 2 incomplete coverage (git
failed, time budget spent, or what the error-on flags ask for), 1 findings, 0
none. The first that holds counts.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from .config import ScanConfig
from .errors import ScanError
from .rules import merge, model


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sieveglass")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("paths", nargs="+")
    s.add_argument("--format", choices=["text", "json", "jsonl", "sarif"], default="text")
    s.add_argument("--rules")
    s.add_argument("--output")
    s.add_argument("--baseline")
    s.add_argument("--generate-baseline")
    s.add_argument("--ignore-rule", action="append", default=[])
    s.add_argument("--min-entropy", type=float)
    s.add_argument("--max-file-size", type=int, default=2 << 20)
    s.add_argument("--binary", choices=["auto", "skip", "scan"], default="auto")
    s.add_argument("--redaction", choices=["partial", "full"], default="partial")
    for flag in ("no-redact", "git-tracked", "changed-files", "git-staged", "git-history", "history-all", "include-untracked", "fallback-walk", "show-context", "no-fail", "error-on-unreadable", "error-on-skipped", "full-history", "no-allow-markers", "bundled-rules"):
        s.add_argument(f"--{flag}", action="store_true")
    s.add_argument("--log-opts", action="append", default=[], metavar="OPTION", help="option for git log, such as --since=...")
    s.add_argument("--base")
    s.add_argument("--history-timeout", type=float, default=0)
    for cap in ("max-files", "max-findings", "max-findings-per-file"):
        s.add_argument(f"--{cap}", type=positive)
    v = sub.add_parser("validate-rules")
    v.add_argument("files", nargs="+")
    m = sub.add_parser("merge-rules")
    m.add_argument("manifest")
    m.add_argument("--out", required=True)
    m.add_argument("--report")
    m.add_argument("--check", action="store_true")
    m.add_argument("--all", action="store_true", help="also sources that are not embedded")
    u = sub.add_parser("update-rules")
    u.add_argument("--source", required=True)
    only = u.add_mutually_exclusive_group()
    only.add_argument("--check", action="store_true")
    only.add_argument("--force", action="store_true")
    r = sub.add_parser("list-rules")
    r.add_argument("--rules")
    return p


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def validate(files: list[str]) -> int:
    """0 valid, 1 invalid, 2 unreadable; the worst holds."""
    worst = 0
    for f in files:
        try:
            problems = model.validate(model.parse(Path(f).read_text("utf-8")))
        except OSError as e:
            print(f"{f}: {e}", file=sys.stderr)
            worst = 2
            continue
        except ScanError as e:
            problems = [str(e)]
        for x in problems:
            print(f"{f}: {x}", file=sys.stderr)
        worst = max(worst, int(bool(problems)))
    return worst


def merge_rules(manifest: str, out: str, report: str | None, check: bool, everything: bool = True) -> int:
    root = Path(manifest).parent
    rows = merge.select(model.parse(Path(manifest).read_text("utf-8")), not everything)

    def text(file: str) -> str:  # beside the manifest, or else as it stands
        return (root / file if (root / file).exists() else Path(file)).read_text("utf-8")

    toml, found = merge.merge_checked([merge.Source(s["name"], s.get("priority", 0), model.parse(text(s["file"]))) for s in rows])
    if report:
        Path(report).write_text(found.to_json(), "utf-8")
    if check:
        return int(not Path(out).exists() or Path(out).read_text("utf-8") != toml)
    Path(out).write_text(toml, "utf-8")
    return 0


def scan(a: argparse.Namespace) -> int:
    from functools import reduce

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import relations as R
    from .plans.scanner import Scanner, ScanReport
    from .sinks import reports

    mode = "history" if a.git_history else "staged" if a.git_staged else "changed" if a.changed_files or a.base else "tracked" if a.git_tracked else None
    early = not (a.baseline or a.ignore_rule or a.generate_baseline)
    config = ScanConfig(
        a.min_entropy, a.max_file_size, not a.no_redact, a.redaction, mode, a.base, a.history_all, history_timeout=a.history_timeout, include_untracked=a.include_untracked, fallback_walk=a.fallback_walk, binary=a.binary, max_files=a.max_files,
        max_findings=a.max_findings if early else None, max_findings_per_file=a.max_findings_per_file, honor_allow_markers=not a.no_allow_markers,
        history_full=mode == "history" or a.full_history, history_options=tuple(a.log_opts),
    )
    try:
        scanner = Scanner.from_file(a.rules, config, strict=True) if a.rules else Scanner.bundled(config) if a.bundled_rules else Scanner.resolved(config)
    except (ScanError, OSError, UnicodeDecodeError) as e:
        print(json.dumps({"code": "INVALID_RULES", "error": str(e)}), file=sys.stderr)
        return 3
    spark = SparkSession.builder.appName("sieveglass").getOrCreate()
    done, left, cut = [], config.max_findings, False
    for p in a.paths:
        if left == 0 and done:  # the cap is spent: later paths are not scanned, and it is told
            cut = True
            break
        done.append(scanner.with_config(replace(config, max_findings=left)).scan_path(spark, p))
        if left:
            left = max(0, left - done[-1].findings.count())
    found = reduce(lambda x, y: x.unionByName(y), (d.findings for d in done))
    stats = R.fold_stats(reduce(lambda x, y: x.unionByName(y), (d.stats for d in done)))
    report = ScanReport(found, stats.withColumn("findings_truncated", F.col("findings_truncated") | F.lit(cut)))
    found = R.ignore_rules(found, a.ignore_rule)
    if a.generate_baseline:
        s = report.stats.first()
        if s.errored or s.history_timed_out or s.git_failed:
            return 2
        reports.write_baseline(found, a.generate_baseline)
        return 0
    if a.baseline:
        found = R.suppress_baseline(found, reports.read_baseline(spark, a.baseline))
    if a.max_findings and not early:
        found = R.sorted_findings(found).limit(a.max_findings)
    report.findings = found.persist()
    out = reports.private_file(a.output) if a.output else sys.stdout
    for part in reports.render(report.findings, a.format, a.show_context, a.paths[0]):
        out.write(part)
    if a.output:
        out.close()
    return report.exit_code(a.no_fail, a.error_on_unreadable, a.error_on_skipped)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "scan":
            return scan(a)
        if a.command == "validate-rules":
            return validate(a.files)
        if a.command == "merge-rules":
            return merge_rules(a.manifest, a.out, a.report, a.check, a.all)
        if a.command == "update-rules":
            from .sources import rulesets

            done = rulesets.update(a.source, check_only=a.check, force=a.force)
            print(done.value)
            return done.exit_code
        from .plans.scanner import DEFAULT_RULES

        for r in model.load(Path(a.rules or DEFAULT_RULES).read_text("utf-8"), False).rules:
            print(f"{r.id}\t{len(r.keywords)}\t{r.description}")
        return 0
    except (ScanError, OSError) as e:
        print(json.dumps({"code": getattr(e, "code", "IO_ERROR"), "error": str(e)}), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
