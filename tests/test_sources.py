import json
import os
import subprocess

import pytest

from sieveglass import cli
from sieveglass.config import ScanConfig
from sieveglass.errors import ConfigError
from sieveglass.operators import relations as R
from sieveglass.plans.scanner import Scanner, register_functions, safe_findings
from sieveglass.sinks import reports
from sieveglass.sources import files, git
from sieveglass.streaming.redact import finding_stream, redact_stream

TOML = "[[rules]]\nid='k'\ndescription='a key'\nregex='SECRET[0-9]{6}'\nkeywords=['secret']\n"


def sh(root, *args):
    subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_NAME": "n", "GIT_AUTHOR_EMAIL": "e", "GIT_COMMITTER_NAME": "n", "GIT_COMMITTER_EMAIL": "e"})


@pytest.fixture
def tree(tmp_path):
    files = {"a.txt": b"x\nSECRET123456\n", "b.png": b"SECRET123456", "node_modules/c.js": b"SECRET123456", "bin": b"\0SECRET123456", "d.json": b"\0SECRET123456", "empty": b"", "big.txt": b"SECRET123456" + b" " * 5000, "sub/e.py": b"SECRET999999 SECRET888888"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_directory_scan(spark, tree):
    s = Scanner.from_toml(TOML, ScanConfig(max_file_size=4000))
    rep = s.scan_path(spark, str(tree))
    got = [(r.file.removeprefix(str(tree) + "/"), r.line, r.matched) for r in rep.findings.collect()]
    assert got == [("a.txt", 2, "*" * 12), ("d.json", 1, "*" * 12), ("sub/e.py", 1, "*" * 12), ("sub/e.py", 1, "*" * 12)]
    st = rep.stats.first()
    assert (st.files_scanned, st.binary_skipped, st.oversized_skipped, st.errored) == (4, 1, 1, 0)
    assert rep.exit_code() == 1 and rep.exit_code(no_fail=True) == 0 and rep.exit_code(error_on_skipped=True) == 2
    assert R.coverage_reasons(rep.stats).first().reasons == ["PolicySkipped"]
    capped = s.with_config(ScanConfig(max_files=2, max_findings=1)).scan_path(spark, str(tree))
    assert capped.findings.count() == 1 and capped.stats.first().files_over_cap == 4 and capped.stats.first().findings_truncated


def test_reports(spark, tree, tmp_path):
    rep = Scanner.from_toml(TOML).scan_path(spark, str(tree))
    text = "".join(reports.render(rep.findings, "text", True))
    assert text.startswith("5 findings\n") and "a.txt:2:1  k (a key)" in text and "    *     2  [REDACTED_SECRET]" in text
    rows = json.loads("".join(reports.render(rep.findings, "json")))
    assert len(rows) == 5 and rows[0]["rule_id"] == "k" and "commit" not in rows[0] and "context" not in rows[0]
    assert [json.loads(x) for x in "".join(reports.render(rep.findings, "jsonl")).splitlines()] == rows
    sarif = json.loads("".join(reports.render(rep.findings, "sarif", base=str(tree))))["runs"][0]
    assert sarif["tool"]["driver"]["rules"] == [{"id": "k", "name": "k", "shortDescription": {"text": "a key"}}]
    assert sarif["results"][0]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a.txt", "uriBaseId": "SRCROOT"}, "region": {"startLine": 2, "startColumn": 1, "endLine": 2, "endColumn": 13}}
    assert "SECRET1" not in json.dumps(sarif)
    assert json.loads("".join(reports.render(rep.findings.limit(0), "json"))) == []
    at = tmp_path / "base.json"
    reports.write_baseline(rep.findings.where("line = 2"), str(at))
    assert at.stat().st_mode & 0o777 == 0o600
    base = reports.read_baseline(spark, str(at))
    assert R.suppress_baseline(rep.findings, base).count() == 4
    old = spark.createDataFrame([(f"{tree}/a.txt", 2, "k", "")], "file string, line long, rule_id string, fingerprint string")
    assert R.suppress_baseline(rep.findings, old).count() == 4
    os.symlink(at, tmp_path / "link")
    with pytest.raises(OSError):
        reports.private_file(str(tmp_path / "link"))
    assert not {"matched", "context_lines", "fingerprint"} & set(safe_findings(rep.findings).columns)


def test_git_modes(spark, tmp_path):
    root = tmp_path
    sh(root, "init", "-q", "-b", "main")
    (root / "a.txt").write_text("one\nSECRET111111\nthree\n")
    sh(root, "add", ".")
    sh(root, "commit", "-q", "-m", "first")
    (root / "a.txt").write_text("one\nthree\nfour\n++ SECRET222222\n")
    sh(root, "commit", "-q", "-am", "second")
    (root / "new.txt").write_text("SECRET333333")
    (root / "staged.txt").write_text("SECRET444444")
    sh(root, "add", "staged.txt")
    (root / "staged.txt").write_text("clean now")
    found = lambda **c: sorted((r.file.rsplit("/", 1)[1], r.line) for r in Scanner.from_toml(TOML, ScanConfig(**c)).scan_path(spark, str(root)).findings.collect())
    assert found(git_mode="tracked") == [("a.txt", 4)]
    assert found(git_mode="tracked", include_untracked=True) == [("a.txt", 4), ("new.txt", 1)]
    assert found(git_mode="staged") == [("staged.txt", 1)]
    assert found(git_mode="changed", base="HEAD~1") == [("a.txt", 4)]
    assert found(git_mode="history") == [("a.txt", 2), ("a.txt", 4)]
    rep = Scanner.from_toml(TOML, ScanConfig(git_mode="history")).scan_path(spark, str(root))
    assert all(len(r.commit) == 40 for r in rep.findings.collect()) and len({r.commit for r in rep.findings.collect()}) == 2
    with pytest.raises(git.GitFailed):
        git.changed(str(root), "--output=x")


def test_git_fails_closed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("SECRET123456")
    for mode in ("tracked", "history"):
        rep = Scanner.from_toml(TOML, ScanConfig(git_mode=mode)).scan_path(spark, str(tmp_path))
        assert rep.findings.count() == 0 and rep.stats.first().git_failed and rep.exit_code() == 2
    rep = Scanner.from_toml(TOML, ScanConfig(git_mode="tracked", fallback_walk=True)).scan_path(spark, str(tmp_path))
    assert rep.findings.count() == 1 and rep.stats.first().git_fallback


def test_file_diffs():
    sha, other = b"a" * 40, b"b" * 40
    lines = [
        sha, b"", b"diff --git a/x b/x", b"--- a/x", b"+++ b/x", b"@@ -0,0 +1,2 @@", b"+one", b"+++ b/not a header", b"@@ -9 +20 @@", b"-" + other, b"\\ No newline at end of file", b"+late", b"\\ No newline at end of file",
        b"diff --git a/y b/y", b"--- a/y", b"+++ /dev/null", b"@@ -1 +0,0 @@", b"-gone", b"diff --cc z", b"+++ b/z", b"@@@ -1 -1 +1 @@@", b"++no", b"+++ b/w", b"diff --git a/u b/u", b"+++ b/../u", b"@@ -0,0 +1 @@", b"+x",
        other, b"diff --git a/q b/q", b'+++ "b/t\\303\\251\\t.txt"', b"@@ -0,0 +3 @@", b"+diff --git a/p b/p", b"diff --git a/s b/s", b"+++ b/s s\t", b"@@ -0,0 +1,9 @@", b"+cut off",
    ]
    got = [(d.commit, d.path, bytes(d.content), d.lines) for d in git.file_diffs(iter(x + b"\n" for x in lines), 1000)]
    a, b = sha.decode(), other.decode()
    assert got == [(a, "x", b"one\n++ b/not a header\nlate\n", [1, 2, 20]), (b, "té\t.txt", b"diff --git a/p b/p\n", [3]), (b, "s s", b"cut off\n", [1])]
    assert [d.path for d in git.file_diffs(iter(lines), 1000, lambda p: p != "x")] == ["té\t.txt", "s s"]
    assert [(d.path, d.oversized) for d in git.file_diffs(iter(lines), 8)] == [("x", True), ("té\t.txt", True), ("s s", False)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a SECRET123456"), (2, "clean"), (3, None)], "id int, text string").write.parquet(str(src))
    stream = spark.readStream.schema("id int, text string").parquet(str(src))
    proxy = Scanner.from_toml(TOML, ScanConfig.proxy())
    for name, df in (("red", redact_stream(stream, proxy).select("id", "redacted_content")), ("found", finding_stream(stream, proxy, "text", "text").select("rule_id", "line"))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {r.id: r.redacted_content for r in spark.sql("select * from red").collect()} == {1: "a [REDACTED_SECRET]", 2: "clean", 3: None}
    assert [tuple(r) for r in spark.sql("select * from found").collect()] == [("k", 1)]


def test_sql_functions(spark):
    register_functions(spark, Scanner.from_toml(TOML))
    assert spark.sql("select secret_redact('short') r").first().r == "*****"
    assert [r.line for r in spark.sql("select * from scan_secrets('p', 'x\nSECRET123456')").collect()] == [2]


def test_partitions_do_not_matter(spark):
    rows = [(f"p{i}", "é SECRET%06d " % i * (i % 4)) for i in range(60)]
    s = Scanner.from_toml(TOML)
    df = spark.createDataFrame(rows, "path string, content string")
    one, many = (sorted(map(str, s.scan(df.repartition(n)).collect())) for n in (1, 7))
    assert one == many and len(one) == 90


def test_cli(spark, tree, capsys):
    rules = tree / "r.toml"
    rules.write_text(TOML)
    assert cli.main(["scan", str(tree / "sub"), "--rules", str(rules), "--format", "json"]) == 1
    assert len(json.loads(capsys.readouterr().out)) == 2
    assert cli.main(["scan", str(tree / "sub"), "--rules", str(rules), "--ignore-rule", "k", "--format", "json"]) == 0
    assert cli.main(["scan", str(tree / "sub"), "--rules", str(rules), "--generate-baseline", str(tree / "b.json")]) == 0
    assert cli.main(["scan", str(tree / "sub"), "--rules", str(rules), "--baseline", str(tree / "b.json")]) == 0
    bad = tree / "bad.toml"
    bad.write_text("[[rules]]\nid='a'\n")
    assert [cli.main(["validate-rules", str(x)]) for x in (rules, bad, tree / "none")] == [0, 1, 2]
    (tree / "m.toml").write_text("[[sources]]\nname='s'\nfile='r.toml'\npriority=1\nembed=true\n")
    assert cli.main(["merge-rules", str(tree / "m.toml"), "--out", str(tree / "o.toml"), "--check"]) == 1
    assert cli.main(["merge-rules", str(tree / "m.toml"), "--out", str(tree / "o.toml"), "--report", str(tree / "rep.json")]) == 0
    assert cli.main(["merge-rules", str(tree / "m.toml"), "--out", str(tree / "o.toml"), "--check"]) == 0
    assert cli.main(["list-rules", "--rules", str(tree / "o.toml")]) == 0


def test_links_and_special_files_are_not_read(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "secret.txt").write_text("SECRET123456")
    (tmp_path / "t" / "own.txt").write_text("SECRET222222")
    os.symlink(tmp_path / "secret.txt", tmp_path / "t" / "link.txt")
    os.symlink(tmp_path, tmp_path / "t" / "loop")
    os.mkfifo(tmp_path / "t" / "pipe")
    s = Scanner.from_toml(TOML)
    rep = s.scan_path(spark, str(tmp_path / "t"))
    assert [r.file for r in rep.findings.collect()] == [f"{tmp_path}/t/own.txt"]
    assert (rep.stats.first().files_scanned, rep.stats.first().errored) == (1, 0)
    assert s.scan_path(spark, str(tmp_path / "secret.txt")).findings.count() == 1
    for named in ("t/link.txt", "t/pipe", "none.txt"):
        rep = s.scan_path(spark, str(tmp_path / named))
        assert rep.findings.isEmpty() and rep.stats.first().errored == 1 and rep.exit_code(error_on_unreadable=True) == 2
    (tmp_path / "x.png").write_text("SECRET123456")
    assert s.scan_path(spark, str(tmp_path / "x.png")).stats.first().errored == 1
    assert s.with_config(ScanConfig(git_mode="history")).scan_path(spark, str(tmp_path / "secret.txt")).stats.first().git_failed


def test_unreadable_folders_count_as_errors(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "shut").mkdir()
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (_ for _ in ()).throw(PermissionError()) if str(p).endswith("shut") else scandir(p))
    st = Scanner.from_toml(TOML).scan_path(spark, str(tmp_path)).stats.first()
    assert (st.files_scanned, st.errored) == (1, 1)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo") / "r"
    root.mkdir()
    sh(root, "init", "-q", "-b", "main")
    (root / "a.py").write_text("SECRET111111\nSECRET222222\n")
    (root / "z.txt").write_text("clean\n")
    (root / "pic.png").write_text("SECRET333333\n")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "n.js").write_text("SECRET444444\n")
    (root / "raw.dat").write_bytes(b"\x01" * 8 + b"SECRET777777\n")
    sh(root, "add", ".")
    sh(root, "commit", "-q", "-m", "one")
    (root / "b.txt").write_text("SECRET555555\n")
    (root / "gone.txt").write_text("SECRET666666\n")
    sh(root, "add", ".")
    sh(root, "commit", "-q", "-m", "two")
    (root / "gone.txt").unlink()
    sh(root, "commit", "-q", "-am", "three")
    return root


def test_relative_roots(spark, repo, monkeypatch):
    monkeypatch.chdir(repo.parent)
    for mode in (None, "tracked", "changed", "staged", "history"):
        (repo / "b.txt").write_text("SECRET555555\nSECRET999999\n")
        sh(repo, "add", "b.txt")
        s = Scanner.from_toml(TOML, ScanConfig(git_mode=mode))
        got = [(r.file, r.line) for r in s.scan_path(spark, "r").findings.collect()]
        far = [(r.file, r.line) for r in s.scan_path(spark, str(repo)).findings.collect()]
        assert got and [(f"{repo.parent}/{f}", n) for f, n in got] == far, mode
        monkeypatch.chdir(repo)
        assert [(f, n) for f, n in got] == [("r/" + r.file.removeprefix("./"), r.line) for r in s.scan_path(spark, ".").findings.collect()], mode
        monkeypatch.chdir(repo.parent)
    assert cli.main(["scan", "r", "--git-tracked", "--format", "json"]) in (0, 1)


def test_history_caps_and_filters(spark, repo):
    def report(**c):
        rep = Scanner.from_toml(TOML, ScanConfig(git_mode="history", **c)).scan_path(spark, str(repo))
        return [(r.file.rsplit("/", 1)[1], r.line) for r in rep.findings.collect()], rep.stats.first()

    whole, st = report()
    assert whole == [("a.py", 1), ("a.py", 2), ("b.txt", 1), ("gone.txt", 1)]
    assert (st.files_scanned, st.binary_skipped, st.findings_truncated, st.files_over_cap) == (4, 1, False, 0)
    assert ("raw.dat", 1) in report(binary="scan")[0] and ("pic.png", 1) in report(binary="scan")[0]
    some, st = report(max_files=2)
    assert {f for f, _ in some} == {"b.txt", "gone.txt"} and st.files_over_cap == 3 and st.files_scanned == 2
    one, st = report(max_findings=1)
    assert len(one) == 1 and st.findings_truncated
    none, st = report(max_findings=0)
    assert not none and st.findings_truncated and st.files_scanned == 0
    _, st = report(max_findings_per_file=1)
    assert st.findings_truncated
    small, st = report(max_file_size=20)
    assert ("a.py", 1) not in small and st.oversized_skipped == 2
    assert report(history_options=("--max-count=1",))[0] == []
    bad = Scanner.from_toml(TOML, ScanConfig(git_mode="history", max_findings=0)).scan_path(spark, "/")
    assert bad.stats.first().git_failed
    with pytest.raises(ConfigError):
        ScanConfig(git_mode="history", history_options=("--output=x",))


def test_history_over_what_the_driver_holds(spark, repo, monkeypatch):
    monkeypatch.setattr(files, "HELD", 300)
    got = Scanner.from_toml(TOML, ScanConfig(git_mode="history")).scan_path(spark, str(repo))
    assert got.findings.count() == 4 and got.stats.first().files_scanned == 4
    (repo / "b.txt").write_text("SECRET555555\nSECRET999999\n")
    sh(repo, "add", "b.txt")
    staged = Scanner.from_toml(TOML, ScanConfig(git_mode="staged")).scan_path(spark, str(repo))
    assert staged.findings.count() == 2


def test_total_cap_ends_the_scan(spark, repo):
    def report(n):
        rep = Scanner.from_toml(TOML, ScanConfig(max_findings=n)).scan_path(spark, str(repo))
        st = rep.stats.first()
        rep.release()
        return rep.findings.count(), st.files_scanned, st.findings_truncated

    assert report(1) == (1, 1, True) and report(2) == (2, 1, True) and report(0) == (0, 0, True)
    (n, _, cut) = report(100)
    assert not cut and report(n)[0] == n and report(n)[2]  # clean files are left over


def test_per_file_cap_is_told(spark, repo):
    st = Scanner.from_toml(TOML, ScanConfig(max_findings_per_file=1)).scan_path(spark, str(repo)).stats.first()
    assert st.findings_truncated


def test_exit_codes_and_rule_sources(spark, repo, tmp_path, monkeypatch, capsys):
    bad, good = tmp_path / "bad.toml", tmp_path / "good.toml"
    bad.write_text("[[rules]]\nid='a'\nregex='('\n")
    good.write_text(TOML)
    assert cli.main(["scan", str(repo), "--rules", str(bad)]) == 3
    assert cli.main(["scan", str(repo), "--rules", str(tmp_path / "none")]) == 3
    assert cli.main(["scan", str(tmp_path), "--git-history", "--rules", str(good), "--no-fail"]) == 2
    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path / "data"))
    monkeypatch.chdir(tmp_path)
    assert cli.main(["update-rules", "--source", str(good), "--check"]) == 1
    assert cli.main(["update-rules", "--source", str(good)]) == 0
    assert cli.main(["update-rules", "--source", str(good), "--check"]) == 0
    capsys.readouterr()
    assert cli.main(["scan", str(repo / "a.py"), "--format", "json"]) == 1  # the cached rules
    assert [r["rule_id"] for r in json.loads(capsys.readouterr().out)] == ["k", "k"]
    monkeypatch.setenv("SIEVEGLASS_RULES", str(bad))
    assert cli.main(["scan", str(repo / "a.py")]) == 3
    monkeypatch.delenv("SIEVEGLASS_RULES")
    assert cli.main(["scan", str(repo), "--git-history", "--log-opts=--max-count=1", "--rules", str(good)]) == 0
    capsys.readouterr()
    assert cli.main(["scan", str(repo / "a.py"), str(repo / "b.txt"), "--rules", str(good), "--max-findings", "2", "--format", "json"]) == 1
    assert len(json.loads(capsys.readouterr().out)) == 2


def test_manifests(tmp_path):
    from sieveglass.errors import RulesetError
    from sieveglass.rules import merge

    rows = [{"name": "a", "priority": 1, "embed": True}, {"name": "b", "priority": 5}]
    for key in ("source", "sources"):
        assert [s["name"] for s in merge.select({key: rows})] == ["b", "a"]
        assert [s["name"] for s in merge.select({key: rows}, True)] == ["a"]
    with pytest.raises(RulesetError):
        merge.select({})


def test_generic_parts_of_ids(spark):
    rows = [(f"{v}-api-token", s) for v in ("acme", "bolt", "cone") for s in "ab"] + [("api-token", "a"), ("acme-secret", "b"), ("solo", "a")]
    got = {r.stem: (r.n_rules, r.n_sources) for r in R.vendor_clusters(spark.createDataFrame(rows, "rule_id string, source string")).collect()}
    assert got == {"acme": (3, 2), "bolt": (2, 2), "cone": (2, 2)}


def test_sql_fingerprint_and_entropy(spark):
    from sieveglass.operators.engine import entropy, finding_fingerprint

    register_functions(spark, Scanner.from_toml(TOML))
    r = spark.sql("select secret_fingerprint('r', 'f', 'sécret') a, secret_entropy('aabbé') b, secret_entropy('') c, secret_entropy(null) d, secret_redact(null) e").first()
    assert (r.a, r.c, r.d, r.e) == (finding_fingerprint("sieveglass", "r", "f", "sécret".encode()), 0.0, None, None)
    assert r.b == pytest.approx(entropy("aabbé".encode()))
