"""The registered queries of the engine, each with the DuckDB SQL it is checked against."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import columns as X
from ..operators import detect
from ..operators import relations as R
from ..rules import model
from .scanner import Scanner

NS = "sieveglass"
TOKEN = r'token = "[0-9a-f]{40}"'
EMAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+"
CARD = r"[0-9]{16}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
LICENSE = r"(?m)^[^\n]*[Ll]icen[sc]e[^\n]*"  # anchored: no second try within a line
PATTERNS = {"token": (TOKEN, "token"), "email": (EMAIL, "@"), "card": (CARD, None), "ipv4": (IPV4, "."), "license": (LICENSE, "licen")}

#: The engine's own small ruleset for the tables at hand; every pattern means the same in all three dialects.
RULES_TOML = f"""
[[allowlists]]
id = "tests"
targetRules = ["ipv4"]
regexes = ['''^127\\.''']

[[rules]]
id = "token"
description = "assigned token"
regex = '''token = "([0-9a-f]{{40}})"'''
secretGroup = 1
entropy = 3.0
keywords = ["token"]

[[rules]]
id = "email"
description = "e-mail address"
regex = '''{EMAIL}'''
keywords = ["@"]

[[rules]]
id = "card"
description = "card-like number"
regex = '''{CARD}'''
entropy = 2.0

[[rules]]
id = "ipv4"
description = "IPv4 address"
regex = '''{IPV4}'''
keywords = ["."]
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def path_col() -> Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(path_col().alias("path"), "text")


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FILE = "source || '/' || doc_id || '.txt'"


def sql_entropy(x: str) -> str:
    cs = f"string_split({x}, '')"
    share = f"(len(list_filter({cs}, lambda y: y = c)) / len({cs}))"
    return f"CASE WHEN {x} = '' THEN 0.0 ELSE list_sum(list_transform(list_distinct({cs}), lambda c: -{share} * log2({share}))) END"


def sql_digest(*parts: str) -> str:
    size = lambda p: f"unhex(printf('%02x', strlen({p}) % 256) || printf('%02x', strlen({p}) // 256 % 256) || printf('%02x', strlen({p}) // 65536 % 256) || printf('%02x', strlen({p}) // 16777216 % 256) || '00000000')"
    return "'sha256:' || sha256(" + " || ".join(f"{size(p)} || encode({p})" for p in parts) + ")"


def sql_hits(pattern: str, source: str = f"SELECT {FILE} AS file, text FROM documents") -> str:
    """CTEs up to u(file, i, secret, before)."""
    p = literal(pattern)
    return f"""WITH d AS ({source}), h AS (SELECT file, regexp_extract_all(text, {p}) AS hits, string_split_regex(text, {p}) AS gaps FROM d WHERE regexp_matches(text, {p})),
    e AS (SELECT file, hits, gaps, unnest(range(len(hits))) AS i FROM h),
    u AS (SELECT file, i, hits[i + 1] AS secret, array_to_string(list_transform(range(i), lambda k: gaps[k + 1] || hits[k + 1]), '') || gaps[i + 1] AS before FROM e)"""


LINE = "CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS BIGINT)"
COL = "CAST(strlen(string_split(before, chr(10))[-1]) + 1 AS BIGINT)"


def sql_findings(rule: str, pattern: str, least: float | None) -> str:
    where = f"WHERE strlen(secret) >= 8 AND {sql_entropy('secret')} >= {least}" if least else ""
    return f"""{sql_hits(pattern)} SELECT file, '{rule}' AS rule_id, {LINE} AS line, {COL} AS col, CAST(strlen(before) AS BIGINT) AS start_offset, CAST(strlen(before) + strlen(secret) AS BIGINT) AS end_offset,
    secret, round({sql_entropy('secret')}, 6) AS entropy, {sql_digest(f"'{NS}/finding/v2'", f"'{rule}'", "file", "secret")} AS fingerprint FROM u {where}"""


def _findings(rule: str, least: float | None = None):
    pattern, keyword = PATTERNS[rule]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return detect.native_findings(docs(spark, sf), rule, pattern, least, keyword, NS).withColumn("entropy", F.round("entropy", 6))

    run.__name__ = f"{rule}_findings"
    return query(sql_findings(rule, pattern, least))(run)


for _rule, _least in (("token", 3.0), ("email", None), ("card", 2.0), ("ipv4", None), ("license", None)):
    _findings(_rule, _least)


def flat(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    return QUERIES[f"{rule}_findings"](spark, sf)


@query(f"SELECT p_name, round({sql_entropy('p_name')}, 6) AS entropy FROM (SELECT DISTINCT p_name FROM part)")
def entropy_of_names(spark, sf):
    return table(spark, sf, "part").select("p_name").distinct().withColumn("entropy", F.round(X.entropy(F.col("p_name")), 6))


@query(f"SELECT rule_id, count(*) AS n_findings, count(DISTINCT file) AS n_files FROM (" + " UNION ALL ".join(f"SELECT * FROM ({sql_hits(PATTERNS[r][0])} SELECT file, '{r}' AS rule_id FROM u)" for r in ("email", "ipv4", "license")) + ") GROUP BY rule_id")
def findings_by_rule(spark, sf):
    parts = [flat(spark, sf, r) for r in ("email", "ipv4", "license")]
    return R.findings_by_rule(parts[0].unionByName(parts[1]).unionByName(parts[2]))


KEYWORDS = [("token", "token"), ("@", "email"), ("licen", "license"), ("license", "license"), ("the", "word"), ("token", "word")]


@query("SELECT DISTINCT " + FILE + " AS path, r.rule_id FROM documents, (VALUES " + ", ".join(f"('{k}', '{r}')" for k, r in KEYWORDS) + ") r(keyword, rule_id) WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), keyword)")
def keyword_candidates(spark, sf):
    return R.candidate_rules(docs(spark, sf), spark.createDataFrame(KEYWORDS, "keyword string, rule_id string"))


@query(f"{sql_hits(EMAIL)} SELECT file, secret, CASE WHEN length(secret) <= 12 THEN repeat('*', length(secret)) ELSE left(secret, 4) || repeat('*', length(secret) - 8) || right(secret, 4) END AS matched FROM u")
def redact_partial(spark, sf):
    return flat(spark, sf, "email").select("file", "secret", X.redact_partial(F.col("secret")).alias("matched"))


@query(f"{sql_hits(LICENSE)} SELECT file, CAST(i AS BIGINT) AS n, CASE WHEN strlen(secret) > 60 THEN '[MATCH OMITTED: ' || strlen(secret) || ' bytes]' ELSE '[REDACTED]' END AS matched FROM u".replace("CAST(i AS BIGINT) AS n, ", ""))
def redact_full(spark, sf):
    return flat(spark, sf, "license").select("file", X.matched(F.col("secret"), 60, "full").alias("matched"))


@query("SELECT " + FILE + " AS path, " + "regexp_replace(regexp_replace(text, '" + EMAIL + "', '[REDACTED_SECRET]', 'g'), '', '') AS redacted FROM documents WHERE regexp_matches(text, '" + EMAIL + "')")
def redacted_content(spark, sf):
    rows = docs(spark, sf).where(F.col("text").rlike(EMAIL))
    hits, gaps = F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)), F.split("text", EMAIL, -1)
    rows = rows.select("path", "text", hits.alias("h"), gaps.alias("g"))
    lengths = F.transform("h", lambda x, i: F.struct(F.length(F.get("g", i)).alias("gap"), F.length(x).alias("hit")))
    none = F.struct(F.array().cast("array<struct<a int, b int>>").alias("spans"), F.lit(0).alias("at"))

    def add(done: Column, x: Column) -> Column:
        a, b = done["at"] + x["gap"], done["at"] + x["gap"] + x["hit"]
        return F.struct(F.concat(done["spans"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("spans"), b.alias("at"))

    spans = F.aggregate(lengths, none, add, lambda done: done["spans"])
    return rows.select("path", X.redact_islands(F.col("text"), spans).alias("redacted"))


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s WHERE a < b),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b FROM g GROUP BY k, island""")
def merged_ranges(spark, sf):
    a = F.col("l_linenumber").cast("long") * 10
    spans = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), a.alias("a"), (a + F.col("l_quantity").cast("long")).alias("b"))
    return R.merge_spans(spans, ["k"], "a", "b")


@query(f"{sql_hits(EMAIL)}, t AS (SELECT DISTINCT file, {LINE} AS line FROM u), w AS (SELECT t.file, t.line, string_split(d.text, chr(10)) AS ls FROM t JOIN d USING (file)), n AS (SELECT file, line, ls, unnest(range(greatest(line - 2, 1), least(line + 2, len(ls)) + 1)) AS k FROM w) SELECT file, line, CAST(k AS BIGINT) AS ctx_line, regexp_replace(ls[k], '\\s+$', '') AS content FROM n")
def context_lines(spark, sf):
    t = flat(spark, sf, "email").select("file", "line").distinct()
    d = docs(spark, sf).withColumnRenamed("path", "file")
    return d.join(t, "file").select("file", "line", F.explode(X.context_lines(F.col("text"), F.col("line").cast("int"))).alias("c")).select("file", "line", F.col("c.line").alias("ctx_line"), F.col("c.content").alias("content"))


@query(f"{sql_hits(IPV4)} SELECT file, CAST(strlen(before) AS BIGINT) AS start_offset, {LINE} AS line, {COL} AS col FROM u")
def line_col(spark, sf):
    return flat(spark, sf, "ipv4").select("file", "start_offset", "line", "col")


@query("SELECT doc_id, CAST(length(string_split(text, chr(10))[-1]) + len(regexp_extract_all(string_split(text, chr(10))[-1], '[\\x{10000}-\\x{10FFFF}]')) + 1 AS BIGINT) AS col_utf16 FROM documents")
def utf16_col(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.utf16_column(F.col("text")).cast("long").alias("col_utf16"))


def scanned(spark: SparkSession, sf: str, toml: str, **options) -> DataFrame:
    """Findings of a ruleset over all documents, by the scanner."""
    config = ScanConfig(**({"redact": False, "max_file_size": 1 << 40, "capture_context": False} | options))
    return Scanner.from_toml(toml, config).scan(docs(spark, sf), "path", "text")


def rule(name: str, pattern: str, *more: str) -> str:
    return "\n".join(["[[rules]]", f"id = '{name}'", f"regex = '''{pattern}'''", *more, ""])


def allowing(*more: str) -> str:
    return "\n".join(["[[rules.allowlists]]", *more, ""])


@query(f"{sql_hits(IPV4)} SELECT file, secret FROM u WHERE NOT (regexp_matches(secret, '^1') OR contains(secret, '.2'))")
def allowlist_stopword(spark, sf):
    return scanned(spark, sf, rule("ipv4", IPV4) + allowing("regexes = ['^1']", "stopwords = ['.2']")).select("file", F.col("matched").alias("secret"))


@query(f"{sql_hits(IPV4)} SELECT file, secret FROM u WHERE NOT (regexp_matches(secret, '^1') AND regexp_matches(file, '^src1'))")
def allowlist_regex_and(spark, sf):
    return scanned(spark, sf, rule("ipv4", IPV4) + allowing("condition = 'AND'", "regexes = ['^1']", "paths = ['^src1']")).select("file", F.col("matched").alias("secret"))


@query(f"SELECT file, rule_id, secret FROM (SELECT * FROM ({sql_hits(IPV4)} SELECT file, 'ipv4' AS rule_id, secret FROM u) UNION ALL SELECT * FROM ({sql_hits(EMAIL)} SELECT file, 'email', secret FROM u)) WHERE NOT (rule_id = 'ipv4' AND regexp_matches(secret, '^1'))")
def allowlist_target_rules(spark, sf):
    toml = "[[allowlists]]\ntargetRules = ['ipv4']\nregexes = ['^1']\n" + rule("ipv4", IPV4) + rule("email", EMAIL)
    return scanned(spark, sf, toml).select("file", "rule_id", F.col("matched").alias("secret"))


@query(f"{sql_hits(EMAIL)}, w AS (SELECT u.file, {LINE} AS line, u.secret, d.text FROM u JOIN d USING (file)) SELECT file, line, secret FROM w WHERE NOT contains(lower(string_split(text, chr(10))[line]), 'and the')")
def allowlist_on_the_line(spark, sf):
    """Stopwords against the line, case aside."""
    return scanned(spark, sf, rule("email", EMAIL) + allowing("regexTarget = 'line'", "stopwords = ['AND the']")).select("file", "line", F.col("matched").alias("secret"))


@query(f"{sql_hits(EMAIL)}, w AS (SELECT u.file, {LINE} AS line, u.secret, d.text FROM u JOIN d USING (file)) SELECT file, line, secret FROM w WHERE NOT contains(string_split(text, chr(10))[line], 'the:allow')")
def inline_allow_marker(spark, sf):
    """The scanner's own marker, written into every second document in place of a frequent word."""
    marked = docs(spark, sf).withColumn("text", F.replace("text", F.lit("the "), F.lit("the:allow ")))
    found = Scanner.from_toml(rule("email", EMAIL), ScanConfig(redact=False, max_file_size=1 << 40, namespace="the", capture_context=False)).scan(marked, "path", "text")
    return found.select("file", "line", F.col("matched").alias("secret"))


ORACLES["inline_allow_marker"] = f"{sql_hits(EMAIL, f'SELECT {FILE} AS file, replace(text, {literal(chr(116) + "he ")}, {literal("the:allow ")}) AS text FROM documents')}, w AS (SELECT u.file, {LINE} AS line, u.secret, d.text FROM u JOIN d USING (file)) SELECT file, line, secret FROM w WHERE NOT contains(string_split(text, chr(10))[line], 'the:allow')"


@query(f"{sql_hits(EMAIL)} SELECT file, 'email' AS rule_id, secret AS matched FROM u WHERE NOT regexp_matches(file, '[37]\\.txt$') UNION ALL SELECT {FILE}, 'path', 'File path matches pattern: ' || {FILE} FROM documents WHERE NOT regexp_matches({FILE}, '[37]\\.txt$') AND regexp_matches({FILE}, '1\\.txt$')")
def path_allowlist(spark, sf):
    """A global allowlist of paths takes whole documents out, path rules too; one with targets doesn't."""
    toml = "[[allowlists]]\npaths = ['[37]\\.txt$']\n[[allowlists]]\ntargetRules = ['none']\npaths = ['1\\.txt$']\n" + rule("email", EMAIL) + "[[rules]]\nid = 'path'\npath = '''[13]\\.txt$'''\n"
    return scanned(spark, sf, toml).select("file", "rule_id", "matched")


@query(f"{sql_hits(EMAIL)} SELECT file, secret FROM u WHERE regexp_matches(file, '^src[12]/')")
def rule_path_filter(spark, sf):
    return scanned(spark, sf, rule("email", EMAIL, "path = '^src[12]/'", "keywords = ['@']")).select("file", F.col("matched").alias("secret"))


@query(f"""WITH o AS (SELECT {FILE} AS file, 'path' AS rule_id, 0 AS k, 0 AS i FROM documents WHERE regexp_matches({FILE}, '[135]\\.txt$')
UNION ALL SELECT * FROM ({sql_hits(IPV4)} SELECT file, 'ipv4', 1, i FROM u) UNION ALL SELECT * FROM ({sql_hits(EMAIL)} SELECT file, 'email', 2, i FROM u) UNION ALL SELECT * FROM ({sql_hits(CARD)} SELECT file, 'card', 3, i FROM u))
SELECT file, rule_id, CAST(row_number() OVER (PARTITION BY file ORDER BY k, i) - 1 AS INTEGER) AS emit_ord FROM o""")
def emission_order(spark, sf):
    """Path rules, then rules with keywords, then those without; within each by the ruleset and the place."""
    toml = rule("card", CARD) + rule("ipv4", IPV4, "keywords = ['.']") + "[[rules]]\nid = 'path'\npath = '''[135]\\.txt$'''\n" + rule("email", EMAIL, "keywords = ['@']")
    return scanned(spark, sf, toml).select("file", "rule_id", F.col("emit_ord").cast("int").alias("emit_ord"))


@query(f"SELECT {FILE} AS path, regexp_replace(text, '{EMAIL}', '[REDACTED_SECRET]', 'g') AS redacted, least(len(regexp_extract_all(text, '{EMAIL}')), 1)::INTEGER AS n, len(regexp_extract_all(text, '{EMAIL}')) > 1 AS findings_truncated FROM documents")
def uncapped_redaction(spark, sf):
    """The cap bounds the list; every finding is redacted."""
    out = Scanner.from_toml(rule("email", EMAIL), ScanConfig(max_file_size=1 << 40, max_findings_per_file=1)).scan_and_redact(docs(spark, sf), "path", "text")
    return out.select("path", F.col("redacted_content").alias("redacted"), F.size("findings").alias("n"), "findings_truncated")


@query(f"{sql_hits(EMAIL)}, t AS (SELECT DISTINCT u.file, {LINE} AS line, string_split(regexp_replace(text, '{EMAIL}', '[REDACTED_SECRET]', 'g'), chr(10)) AS ls FROM u JOIN d USING (file)), n AS (SELECT file, line, ls, unnest(range(greatest(line - 2, 1), least(line + 2, len(ls)) + 1)) AS k FROM t) SELECT file, line, k AS ctx_line, rtrim(ls[k], ' ' || chr(9) || chr(13)) AS content FROM n")
def redacted_context(spark, sf):
    """Lines around a finding show none of the document's secrets."""
    found = scanned(spark, sf, rule("email", EMAIL), capture_context=True).select("file", "line", F.explode("context_lines").alias("c")).distinct()
    return found.select("file", "line", F.col("c.line").alias("ctx_line"), F.col("c.content").alias("content"))


def sql_hmac(key: bytes, message: str) -> str:
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block).hex() for x in (0x36, 0x5C))
    return f"'hmac-sha256:' || sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


def sql_framed(*parts: str) -> str:
    return sql_digest(*parts).removeprefix("'sha256:' || sha256(").removesuffix(")")


@query(f"{sql_hits(EMAIL)} SELECT file, CAST(strlen(before) AS BIGINT) AS start_offset, {sql_hmac(b'a key of the tests', sql_framed(literal(NS + '/finding/v2'), literal('email'), 'file', 'secret'))} AS fingerprint FROM u")
def keyed_fingerprint(spark, sf):
    old = os.environ.get(detect.KEY_VARIABLE)
    os.environ[detect.KEY_VARIABLE] = "a key of the tests"  # read when the scan is made
    try:
        return scanned(spark, sf, rule("email", EMAIL)).select("file", "start_offset", "fingerprint")
    finally:
        if old is None:
            del os.environ[detect.KEY_VARIABLE]
        else:
            os.environ[detect.KEY_VARIABLE] = old


FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS HUGEINT)), lambda h, b: CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS HUGEINT) * 1099511628211 % 18446744073709551616, 14695981039346656037::HUGEINT)"


@query(f"SELECT p_partkey, lower(lpad(to_hex(CAST({FNV.format('p_name || chr(1) || p_brand')} AS UBIGINT)), 16, '0')) AS fnv FROM part")
def legacy_fingerprint(spark, sf):
    from ..operators.engine import fnv1a

    hashed = F.pandas_udf(lambda a, b: a.str.cat(b, "\x01").map(lambda x: fnv1a([x.encode()])), "string")
    return table(spark, sf, "part").select("p_partkey", hashed(F.col("p_name"), F.col("p_brand")).alias("fnv"))


@query(f"{sql_hits(CARD)} SELECT file, secret FROM u WHERE strlen(secret) >= 8 AND round({sql_entropy('secret')}, 9) >= greatest(2.0, 2.9)")
def entropy_floor(spark, sf):
    floor = max(2.0, 2.9)
    return flat(spark, sf, "card").where(F.round(X.entropy(F.col("secret")), 9) >= floor).select("file", "secret")


@query(f"{sql_hits(EMAIL)}, b AS (SELECT DISTINCT file FROM d WHERE file LIKE 'src1%') SELECT file, secret FROM u WHERE file NOT IN (SELECT file FROM b)")
def baseline_fingerprint_anti(spark, sf):
    f = flat(spark, sf, "email")
    return R.suppress_baseline(f, f.where(F.col("file").startswith("src1"))).select("file", "secret")


@query(f"{sql_hits(EMAIL)}, w AS (SELECT file, {LINE} AS line, secret FROM u) SELECT file, line, secret FROM w WHERE line > 1")
def baseline_legacy_anti(spark, sf):
    f = flat(spark, sf, "email")
    return R.suppress_baseline(f, f.where("line = 1").withColumn("fingerprint", F.lit(""))).select("file", "line", "secret")


@query(f"{sql_hits('the')}, r AS (SELECT file, i FROM u) SELECT file, CAST(i AS BIGINT) AS emit_ord FROM r WHERE i < 3")
def per_file_cap(spark, sf):
    rows = docs(spark, sf).select(F.col("path").alias("file"), F.posexplode(F.regexp_extract_all("text", F.lit("the"), F.lit(0))).alias("emit_ord", "secret"))
    return R.cap_per_file(rows, 3).select("file", F.col("emit_ord").cast("long").alias("emit_ord"))


@query(f"{sql_hits(EMAIL)} SELECT file, CAST(i AS BIGINT) AS emit_ord FROM u ORDER BY string_split(file, '/'), i LIMIT 7")
def total_cap(spark, sf):
    w = flat(spark, sf, "email")
    rank = F.row_number().over(R.Window.partitionBy("file").orderBy("start_offset")) - 1
    return R.cap_total(w.withColumn("emit_ord", rank.cast("long")), 7).select("file", "emit_ord")


@query(f"SELECT {FILE} AS path FROM documents ORDER BY string_split({FILE}, '/') LIMIT 25")
def max_files(spark, sf):
    return R.first_files(docs(spark, sf).select("path"), 25)


@query(f"{sql_hits(IPV4)} SELECT file, CAST(strlen(before) AS BIGINT) AS start_offset FROM u ORDER BY file, strlen(before)")
def final_sort(spark, sf):
    rows = flat(spark, sf, "ipv4").withColumn("commit", F.lit(None).cast("string"))
    return R.sorted_findings(rows).select("file", "start_offset")


@query("SELECT CAST(count(*) FILTER (strlen(text) <= 4000) AS BIGINT) AS files_scanned, CAST(0 AS BIGINT) AS binary_skipped, CAST(count(*) FILTER (strlen(text) > 4000) AS BIGINT) AS oversized_skipped, CAST(0 AS BIGINT) AS errored, CAST(0 AS BIGINT) AS files_over_cap, false AS findings_truncated, false AS git_failed, false AS git_fallback, false AS history_timed_out FROM documents")
def scan_stats(spark, sf):
    rows = docs(spark, sf).select("path", F.encode("text", "UTF-8").alias("content"))
    return R.scan_stats(R.disposition(rows, ScanConfig(max_file_size=4000), F.lit(False)))


PER_PART = "SELECT doc_id % 4 AS part, count(*) FILTER (strlen(text) > 12000 AND doc_id % 4 <> 3) AS oversized, count(*) FILTER (strlen(text) <= 12000 OR doc_id % 4 = 3) AS scanned FROM documents GROUP BY ALL"


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of four parts of the corpus: one hits a file cap, one a time budget, one has no limit of size."""
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("part"), path_col().alias("path"), F.encode("text", "UTF-8").alias("content"))
    out = None
    for part in range(4):
        state = R.disposition(rows.where(F.col("part") == part), ScanConfig(max_file_size=1 << 40 if part == 3 else 12000), F.lit(False))
        one = R.scan_stats(state, 2 * (part == 1), part == 2, history_timed_out=part == 2).withColumn("part", F.lit(part).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT part, list_filter([CASE WHEN part = 2 THEN 'HistoryTimedOut' END, CASE WHEN oversized > 0 THEN 'PolicySkipped' END, CASE WHEN part = 1 THEN 'FileCapReached' END], lambda x: x IS NOT NULL) AS reasons FROM ({PER_PART})")
def coverage_reasons(spark, sf):
    return R.coverage_reasons(_stats(spark, sf)).select("part", "reasons")


@query(f"SELECT CAST(sum(scanned) AS BIGINT) AS files_scanned, CAST(sum(oversized) AS BIGINT) AS oversized_skipped, CAST(sum(CASE WHEN part = 1 THEN 2 ELSE 0 END) AS BIGINT) AS files_over_cap, bool_or(part = 2) AS findings_truncated, bool_or(part = 2) AS history_timed_out, false AS git_failed FROM ({PER_PART})")
def folded_stats(spark, sf):
    return R.fold_stats(_stats(spark, sf).drop("part")).select("files_scanned", "oversized_skipped", "files_over_cap", "findings_truncated", "history_timed_out", "git_failed")


@query(f"SELECT part, oversized > 0 OR part IN (1, 2) AS incomplete, CAST(oversized AS BIGINT) AS skipped_by_policy FROM ({PER_PART})")
def incomplete_scans(spark, sf):
    return R.incomplete(_stats(spark, sf)).select("part", "incomplete", "skipped_by_policy")


ODD = "repeat(chr(1), CAST(doc_id % 60 AS INTEGER)) || left(text, 100)"
IS_BINARY = f"(strlen({ODD}) > 0 AND (doc_id % 60) * 100 // strlen({ODD}) > 30)"


def _odd(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that begin with up to 59 control characters; every fourth has the name of a source file."""
    text = F.concat(F.repeat(F.lit("\x01"), (F.col("doc_id") % 60).cast("int")), F.left("text", F.lit(100)))
    path = F.concat(path_col(), F.when(F.col("doc_id") % 4 == 0, ".json").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", path.alias("path"), F.encode(text, "UTF-8").alias("content"))


@query(f"SELECT doc_id, {IS_BINARY} AS is_binary FROM documents")
def binary_sniff(spark, sf):
    return _odd(spark, sf).select("doc_id", X.is_probably_binary(F.col("content")).alias("is_binary"))


@query(f"SELECT doc_id, CASE WHEN strlen({ODD}) = 0 THEN 'empty' WHEN doc_id % 4 <> 0 AND {IS_BINARY} THEN 'binary' ELSE 'scan' END AS auto, CASE WHEN strlen({ODD}) = 0 THEN 'empty' WHEN {IS_BINARY} THEN 'binary' ELSE 'scan' END AS skip, CASE WHEN strlen({ODD}) = 0 THEN 'empty' ELSE 'scan' END AS scan FROM documents")
def binary_policy(spark, sf):
    rows = _odd(spark, sf)
    for policy in ("auto", "skip", "scan"):
        rows = R.disposition(rows, ScanConfig(binary=policy), F.lit(False)).withColumnRenamed("disposition", policy)
    return rows.select("doc_id", "auto", "skip", "scan")


CUMULATED = "list_transform(range(61), lambda i: strlen(left(text, i)))"


@query(f"SELECT doc_id, left(text, len(list_filter({CUMULATED}, lambda c: c <= 7)) - 1) || '[REDACTED_SECRET]' || substr(text, len(list_filter({CUMULATED}, lambda c: c < 12)) + 1) AS redacted FROM documents WHERE strlen(text) >= 60")
def widened_spans(spark, sf):
    """A span of bytes 7 to 12 is widened to whole characters."""
    from ..operators.engine import redact_spans

    cut = F.pandas_udf(lambda t: t.map(lambda x: redact_spans(x.encode(), [(7, 12)]).decode()), "string")
    return table(spark, sf, "documents").where("octet_length(text) >= 60").select("doc_id", cut(F.col("text")).alias("redacted"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name || ' ' || upper(p_name) || ' ' || p_type, ' '), lambda x: lower(x)))), '|') AS keywords FROM part")
def keyword_set(spark, sf):
    words = F.split(F.concat_ws(" ", "p_name", F.upper("p_name"), "p_type"), " ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.keyword_set(words), "|").alias("keywords"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 THEN [10, 20, 35][l_linenumber] ELSE l_linenumber END::BIGINT AS line, CASE WHEN l_linenumber <= 2 THEN [10, 20, 35][l_linenumber + 1] ELSE l_linenumber + 1 END::BIGINT AS end_line, CASE WHEN l_linenumber <= 3 THEN [10, 20, 35][l_linenumber] ELSE l_linenumber END::BIGINT AS context FROM lineitem")
def remapped_lines(spark, sf):
    n = F.col("l_linenumber").cast("long")
    context = F.array(F.struct(n.alias("line"), F.lit("x").alias("content")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n.alias("line"), (n + 1).alias("end_line"), context.alias("context_lines"), F.array(*(F.lit(x).cast("long") for x in (10, 20, 35))).alias("line_map"))
    return R.remap_lines(rows).select("l_orderkey", "l_linenumber", "line", "end_line", F.col("context_lines")[0]["line"].alias("context"))


@query(f"{sql_hits(EMAIL)} SELECT file, CAST(strlen(before) AS BIGINT) AS start_offset FROM u WHERE NOT starts_with(file, 'src1') ORDER BY file, strlen(before) LIMIT 9")
def cap_after_suppression(spark, sf):
    """With a baseline the total cap applies to what it leaves, in final order."""
    found = scanned(spark, sf, rule("email", EMAIL))
    left = R.suppress_baseline(found, found.where(F.col("file").startswith("src1")))
    return R.sorted_findings(left).limit(9).select("file", "start_offset")


@query("SELECT url, NOT regexp_matches(lower(url), '\\.(png|jpg|jpeg|gif|ico|webp|bmp|tiff|woff|woff2|ttf|eot|otf|pdf|zip|tar|gz|bz2|xz|7z|zst|exe|dll|so|dylib|bin|o|a|pyc|pyo|class|jar|war|mp3|mp4|avi|mov|mkv|flv|sqlite|db)$') AND NOT regexp_matches(url, '(^|/)(node_modules|\\.git|target|dist|vendor|\\.cache|__pycache__|\\.venv|venv|\\.tox|build)/') AS scanned, regexp_matches(lower(url), '\\.(pem|key|json|yaml|yml|toml|properties)$|(^|/)(\\.env[^/]*|\\.npmrc|\\.pypirc|dockerfile(\\.[^/]*)?|makefile)$') AS source_like FROM pages")
def path_policy(spark, sf):
    return table(spark, sf, "pages").select("url", X.should_scan(F.col("url")).alias("scanned"), X.is_source_like(F.col("url")).alias("source_like"))


@query(f"SELECT {FILE} AS file, 'path-rule' AS rule_id, 'File path matches pattern: ' || {FILE} AS matched, {sql_digest(f"'{NS}/finding/v2'", "'path-rule'", FILE, FILE)} AS fingerprint FROM documents WHERE regexp_matches({FILE}, '7\\.txt$')")
def path_only_rule(spark, sf):
    scanner = Scanner.from_toml("[[rules]]\nid = 'path-rule'\npath = '''7\\.txt$'''\n")
    found = scanner.scan(docs(spark, sf), "path", "text")
    return found.select("file", "rule_id", "matched", "fingerprint")


@query(f"{sql_hits(TOKEN)} SELECT file, CAST(strlen(before) AS BIGINT) AS start_offset, CAST(strlen(before) + 9 AS BIGINT) AS secret_start_offset, CAST(strlen(before) + 49 AS BIGINT) AS secret_end_offset, {sql_digest(f"'{NS}/finding/v2'", "'token'", "file", "substr(secret, 10, 40)")} AS fingerprint FROM u WHERE {sql_entropy('substr(secret, 10, 40)')} >= 3.0")
def secret_group(spark, sf):
    found = Scanner(model.load(RULES_TOML)).scan(docs(spark, sf), "path", "text")
    return found.where("rule_id = 'token'").select("file", "start_offset", "secret_start_offset", "secret_end_offset", "fingerprint")


def _union_sql(select: str) -> str:
    parts = [("email", EMAIL, "true"), ("card", CARD, f"{sql_entropy('secret')} >= 2.0"), ("ipv4", IPV4, "NOT regexp_matches(secret, '^127\\.')")]
    return " UNION ALL ".join(f"SELECT * FROM ({sql_hits(p)} SELECT file, '{r}' AS rule_id, {select} FROM u WHERE {w})" for r, p, w in parts)


@query(_union_sql(f"{LINE} AS line, {COL} AS col, CAST(strlen(before) AS BIGINT) AS start_offset, CAST(strlen(before) + strlen(secret) AS BIGINT) AS end_offset, secret AS matched, round({sql_entropy('secret')}, 6) AS entropy"))
def full_scan(spark, sf):
    """The Arrow matcher with a ruleset, against plain SQL."""
    found = Scanner(model.load(RULES_TOML), ScanConfig(redact=False, max_file_size=1 << 40)).scan(docs(spark, sf), "path", "text")
    return found.where("rule_id != 'token'").select("file", "rule_id", "line", "col", "start_offset", "end_offset", "matched", F.round("entropy", 6).alias("entropy"))


def _spans_sql() -> str:
    """(file, a, b, i) in characters of all secrets of the oracle ruleset."""
    parts = [(TOKEN, 9, 1, f"{sql_entropy('substr(secret, 10, 40)')} >= 3.0"), (EMAIL, 0, 0, "true"), (CARD, 0, 0, f"{sql_entropy('secret')} >= 2.0"), (IPV4, 0, 0, "NOT regexp_matches(secret, '^127\\.')")]
    return " UNION ALL ".join(f"SELECT * FROM ({sql_hits(p)} SELECT file, length(before) + {x} AS a, length(before) + length(secret) - {y} AS b FROM u WHERE {w})" for p, x, y, w in parts)


@query(f"""WITH s AS ({_spans_sql()}), m AS (SELECT *, max(b) OVER (PARTITION BY file ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
n AS (SELECT file, min(a) AS a, max(b) AS b, count(*) AS k FROM g GROUP BY file, island), l AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY file ORDER BY a), 0) AS prior FROM n),
t AS (SELECT {FILE} AS path, text FROM documents),
r AS (SELECT path, string_agg(substr(text, prior + 1, a - prior) || '[REDACTED_SECRET]', '' ORDER BY a) || substr(any_value(text), max(b) + 1) AS redacted, sum(k) AS n FROM l JOIN t ON path = file GROUP BY path)
SELECT path, coalesce(redacted, text) AS redacted, CAST(coalesce(n, 0) AS INTEGER) AS n_findings, false AS findings_truncated FROM t LEFT JOIN r USING (path)""")
def redacted_documents(spark, sf):
    """Every whole document redacted with the oracle ruleset."""
    out = Scanner(model.load(RULES_TOML), ScanConfig(max_file_size=1 << 40)).scan_and_redact(docs(spark, sf), "path", "text")
    return out.select("path", F.col("redacted_content").alias("redacted"), F.size("findings").alias("n_findings"), "findings_truncated")


RULE_ROWS = [("a", "r1", "AKIA[0-9]"), ("a", "r2", r"\bAKIA[0-9]\b"), ("b", "r1", "x"), ("b", "r3", "(?i)akia[0-9]$"), ("b", "r4", "AKIA[0-9]"), ("b", "github-token", "ghp_"), ("a", "github-pat", "gho_")]
RULE_VALUES = "(VALUES " + ", ".join(f"({i}, '{s}', '{r}', '{p}')" for i, (s, r, p) in enumerate(RULE_ROWS)) + ") v(ord, source, rule_id, regex)"
SQL_NORM = r"lower(regexp_replace(regexp_replace(regexp_replace(regex, '\(\?[a-zA-Z]*(?:-[a-zA-Z]*)?\)', '', 'g'), '\\[bB]|[\^$]', '', 'g'), '\s', '', 'g'))"


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULE_ROWS)], "ord int, source string, rule_id string, regex string")


@query(f"SELECT rule_id, source FROM (SELECT *, row_number() OVER (PARTITION BY regex ORDER BY ord) AS m FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ord) AS n FROM {RULE_VALUES}) WHERE n = 1) WHERE m = 1")
def ruleset_merge_dedup(spark, sf):
    from ..rules import merge

    sources = [merge.Source(s, 10 if s == "b" else 20, {"rules": [{"id": r, "regex": p} for t, r, p in RULE_ROWS if t == s]}) for s in ("a", "b")]
    kept, report = merge.merge(sources)
    where = {(r, p): s for s, r, p in reversed(RULE_ROWS)}
    return spark.createDataFrame([(r["id"], where[r["id"], r["regex"]]) for r in kept["rules"]], "rule_id string, source string")


@query(f"SELECT rule_id, source, {SQL_NORM} AS norm, first_value(rule_id) OVER (PARTITION BY {SQL_NORM} ORDER BY ord) AS first_id FROM {RULE_VALUES}")
def normalized_near_dups(spark, sf):
    norm = X.normalize_pattern(F.col("regex"))
    return _rules(spark).withColumn("norm", norm).select("rule_id", "source", "norm", F.first("rule_id").over(R.Window.partitionBy("norm").orderBy("ord")).alias("first_id"))


STEMS = "SELECT r_name AS r, lower(replace(r_name, ' ', '')) AS v FROM region"


@query(f"""WITH v AS ({STEMS}), i AS (SELECT DISTINCT v || '-' || w AS id, s FROM v, (VALUES ('api-token', 'a'), ('api-token', 'b'), ('secret', 'b')) k(w, s) UNION ALL SELECT 'api-' || v, 'a' FROM v UNION ALL SELECT v || length(v), 'a' FROM v)
SELECT v AS stem, CAST(count(*) AS BIGINT) AS n_rules, CAST(count(DISTINCT s) AS BIGINT) AS n_sources FROM (SELECT v, s FROM v JOIN i ON id IN (v || '-api-token', v || '-secret', 'api-' || v)) GROUP BY v""")
def vendor_clusters(spark, sf):
    """Vendors are the regions; api, token and secret stand beside all of them, so they are nobody's name."""
    v = table(spark, sf, "region").select(F.lower(F.replace("r_name", F.lit(" "), F.lit(""))).alias("v"))
    kinds = spark.createDataFrame([("api-token", "a"), ("api-token", "b"), ("secret", "b")], "w string, source string")
    own = v.join(F.broadcast(kinds)).select(F.concat_ws("-", "v", "w").alias("rule_id"), "source")
    more = v.select(F.concat(F.lit("api-"), "v").alias("rule_id"), F.lit("a").alias("source")).unionByName(v.select(F.concat("v", F.length("v").cast("string")).alias("rule_id"), F.lit("a").alias("source")))
    return R.vendor_clusters(own.unionByName(more))


@query("SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type, lower(p_brand), p_size % 2, p_size % 3 = 0 ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def equivalent_rules(spark, sf):
    """Of rules with one pattern that detect the same only the first stays; 3 and 3.0 are different."""
    from ..rules import merge

    rows = table(spark, sf, "part").orderBy("p_partkey").collect()  # a ruleset is small
    rules = [{"id": str(r.p_partkey), "regex": r.p_type, "keywords": [r.p_brand, r.p_brand.upper()][:: 1 if r.p_partkey % 2 else -1], "secretGroup": r.p_size % 2, "entropy": 3 if r.p_size % 3 == 0 else 3.0} for r in rows]
    kept, _ = merge.merge([merge.Source("part", 1, {"rules": rules})])
    return spark.createDataFrame([(int(r["id"]),) for r in kept["rules"]], "p_partkey long")


def _nation_sources(spark: SparkSession, sf: str) -> list:
    """A source for each region, of its nations' allowlists; priorities are not in the regions' order."""
    from ..rules import merge

    lists: dict[int, list[dict]] = {}
    for n in table(spark, sf, "nation").orderBy("n_nationkey").collect():
        lists.setdefault(n.n_regionkey, []).append({"id": f"list{n.n_nationkey % 7}", "regexes": [n.n_name]})
    regions = table(spark, sf, "region").collect()
    return [merge.Source(r.r_name, r.r_regionkey * 3 % 5, {"title": r.r_name, f"only{r.r_regionkey}": r.r_regionkey, "allowlists": lists.get(r.r_regionkey, []), "rules": []}) for r in regions]


@query("SELECT 'title' AS key, arg_max(r_name, r_regionkey * 3 % 5) AS value FROM region UNION ALL SELECT 'only' || r_regionkey, CAST(r_regionkey AS VARCHAR) FROM region")
def merged_scalars(spark, sf):
    """Of each top-level key the value of the highest priority."""
    from ..rules import merge

    out, _ = merge.merge(_nation_sources(spark, sf))
    return spark.createDataFrame([(k, str(v)) for k, v in out.items() if k not in ("rules", "allowlists")], "key string, value string")


@query("""WITH l AS (SELECT 'list' || n_nationkey % 7 AS id, n_name, r_regionkey * 3 % 5 AS priority, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS place, id, pattern FROM (SELECT id, min((priority, n_nationkey)) AS first, arg_max(n_name, (priority, n_nationkey)) AS pattern FROM l GROUP BY id)""")
def merged_allowlists(spark, sf):
    """Allowlists by rising priority; one of the same id takes the place of the earlier one."""
    from ..rules import merge

    out, _ = merge.merge(_nation_sources(spark, sf))
    return spark.createDataFrame([(i, a["id"], a["regexes"][0]) for i, a in enumerate(out["allowlists"])], "place int, id string, pattern string")


@query("""SELECT o_custkey AS file, o_orderpriority AS rule_id, min(o_orderkey) AS arrival FROM orders GROUP BY ALL""")
def history_dedup(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("c").alias("commit"), F.col("o_custkey").alias("file"), F.lit(1).alias("line"), F.col("o_orderpriority").alias("rule_id"), F.lit("f").alias("fingerprint"), F.col("o_orderkey").alias("arrival"))
    return R.dedup_history(o).select("file", "rule_id", "arrival")


@query("SELECT rule_id, CAST(row_number() OVER (ORDER BY f, rule_id) - 1 AS BIGINT) AS rule_index FROM (SELECT event_type AS rule_id, min(event_id) AS f FROM events GROUP BY 1)")
def sarif_rule_index(spark, sf):
    return R.rule_index(table(spark, sf, "events").withColumnRenamed("event_type", "rule_id"), "event_id")


@query(f"SELECT {FILE} AS file, CASE WHEN starts_with({FILE}, 'src1/') THEN substr({FILE}, 6) ELSE {FILE} END AS uri FROM documents")
def relativize(spark, sf):
    return docs(spark, sf).select(F.col("path").alias("file"), X.relativize(F.col("path"), "./src1").alias("uri"))


@query(f"SELECT doc_id, {sql_digest(f"'{NS}/finding/v2'", "'rule'", FILE, "text")} AS finding, {sql_digest(f"'{NS}/location/v2'", "'rule'", FILE, "CAST(doc_id AS VARCHAR)", "CAST(n_chars AS VARCHAR)")} AS location FROM documents")
def fingerprint(spark, sf):
    rule, file = F.lit("rule"), path_col()
    return table(spark, sf, "documents").select("doc_id", X.finding_fingerprint(rule, file, F.col("text"), NS).alias("finding"), X.location_fingerprint(rule, file, F.col("doc_id"), F.col("n_chars"), NS).alias("location"))


@query("SELECT doc_id, replace(replace(text, chr(10), '\\x0a'), chr(9), '\\x09') AS shown FROM documents")
def sanitize_display(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sanitize_display(F.col("text")).alias("shown"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value ELSE event_id END AS start_col, CASE WHEN (CASE WHEN event_id % 4 = 0 THEN value ELSE event_id END) >= 5 THEN (CASE WHEN event_id % 4 = 0 THEN value ELSE event_id END) + 1 ELSE 5 END AS end_col FROM (SELECT event_id, CAST(event_id % 7 + 1 AS BIGINT) AS value FROM events)".replace("event_id END", "2 END"))
def sarif_region(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 7 + 1).alias("v"))
    one = F.lit(1).cast("long")
    r = X.sarif_region(one, one, F.col("v"), F.lit(5).cast("long"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(2).cast("long"), F.lit(0).cast("long"))
    return e.select("event_id", r["startColumn"].alias("start_col"), r["endColumn"].alias("end_col"))


@query(f"{sql_hits(EMAIL)} SELECT file, {LINE} AS line, 'email' AS rule_id, '[REDACTED_SECRET]' AS matched FROM u")
def baseline_rows(spark, sf):
    from ..sinks.reports import baseline_rows as rows

    found = Scanner(model.load(RULES_TOML), ScanConfig(max_file_size=1 << 40)).scan(docs(spark, sf), "path", "text").where("rule_id = 'email'")
    return rows(found).select("file", "line", "rule_id", "matched")


@query(f"SELECT doc_id, quality, n FROM (SELECT doc_id, count(*) AS n FROM ({sql_hits(IPV4, 'SELECT doc_id AS file, text FROM documents')} SELECT file AS doc_id FROM u) GROUP BY 1) JOIN labels USING (doc_id)")
def findings_with_labels(spark, sf):
    f = flat(spark, sf, "ipv4").select(F.regexp_extract("file", r"/(\d+)\.txt$", 1).cast("long").alias("doc_id"))
    return f.groupBy("doc_id").agg(F.count("*").alias("n")).join(table(spark, sf, "labels"), "doc_id").select("doc_id", "quality", "n")


@query(f"SELECT CAST(page_id AS BIGINT) AS page_id, CAST(len(regexp_extract_all(html, '{EMAIL}')) AS BIGINT) AS n FROM pages WHERE regexp_matches(html, '{EMAIL}')")
def page_findings(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "html", F.col("page_id").cast("string").alias("path"))
    out = detect.scan(p, model.load(rule("email", EMAIL)), ScanConfig(max_file_size=1 << 40, capture_context=False), "path", "html")
    return out.where(F.size("findings") > 0).select("page_id", F.size("findings").cast("long").alias("n"))


NAME = r"[A-Z][a-z]{3,}"


@query(f"SELECT conv_id, turn, regexp_replace(text, '{NAME}', '[REDACTED_SECRET]', 'g') AS redacted, CAST(least(len(regexp_extract_all(text, '{NAME}')), 1000) AS INTEGER) AS n FROM conversations")
def conversation_redaction(spark, sf):
    """Proxy redaction of chat turns: words that begin with a capital stand for secrets."""
    proxy = Scanner.from_toml(rule("name", NAME), ScanConfig.proxy(max_file_size=1 << 40))
    out = proxy.redact_untrusted(table(spark, sf, "conversations"), "text")
    return out.select("conv_id", "turn", F.col("redacted_content").alias("redacted"), F.size("findings").alias("n"))
