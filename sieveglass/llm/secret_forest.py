"""Secret scans: a random forest removes false positives from candidate findings.

Candidates are runs of 16 or more characters of secrets' alphabets, over whole
texts, and values of 4 (in quotes) or 6 characters and more that are assigned to
a name with a key word, whatever they are made of. Only plain words without a
known prefix, an assignment or a key word beside them are none. Each gets features of its length, character transitions, dictionary
coverage (stretches that are words of a tokenizer's vocabulary), path and
neighbouring words. The forest is trained on labelled findings: by default on
examples() - generated keys of known kinds in the places they occur, and
generated hashes, words, addresses, placeholders and numbers - or on any rows
of (candidate, before, after, path, label).

Defined results: null and empty texts have no candidates; equal candidates in
one text are separate findings by position, and may overlap where a value holds
a run (redaction joins them); repeated rows are scanned each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin

TREES, DEPTH, LEAF = 60, 12, 3
THRESHOLD = 0.5
MARKER = "[REDACTED_SECRET]"
CANDIDATE = re.compile(rb"[A-Za-z0-9_+/=.\-]{16,}")
#: Text kept at each side of a candidate.
AROUND = 48
#: Words that announce a secret, that announce something else, and of paths.
KEY_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "credential", "bearer", "access", "private")
OTHER_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "id", "version", "example", "sample", "dummy", "placeholder", "integrity", "revision", "build", "http", "https", "www")
PATH_WORDS = ("test", "example", "sample", "doc", "fixture", "mock", "lock", "vendor")
SECRET_PATHS = (".env", ".pem", ".key", "config", "secret", "credential", ".ini", ".yaml", ".yml", ".properties")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "glpat-", "npm_", "eyJ", "SG.")
#: An assignment, the name before it and the value after it, of which at most 1,024 bytes count.
ASSIGNED = re.compile(rb"[=:]>?[ \t]*")
VALUE = re.compile(rb"""(?:"([^"\r\n]{4,1024})"|'([^'\r\n]{4,1024})'|([^\s"'<>=:][^\s"'<>]{5,1023}))""")
KEY_NAME = re.compile(rb"(?:%s)[a-z0-9_\-]{0,24}[\"']?[ \t]*:?$" % "|".join(KEY_WORDS).encode())
_PREFIXES = tuple(p.encode() for p in PREFIXES)
FEATURES = (
    "length", "entropy", "classes", "transitions", "digit_share", "upper_share", "lower_share", "mark_share", "longest_run", "distinct", "hex", "base64", "digits_only", "coverage",
    "longest_word", "prefix", "repeats", "key_near", "key_first", "other_near", "assigned", "quoted", "path_test", "path_secret", "in_address", "vowels",
)
SCHEMA = "doc_id long, start long, end long, candidate_sha256 string, score double, secret boolean, features array<double>"


class Dictionary:
    """Lower-case words of at least four letters; greedy longest coverage."""

    def __init__(self, words: set[str]):
        self.words = frozenset(words)
        self.longest = min(16, max(map(len, words), default=0))

    @classmethod
    def of_tokenizer(cls, path: str) -> Dictionary:
        from tokenizers import Tokenizer

        return cls({w.removesuffix("</w>") for w in Tokenizer.from_file(path).get_vocab() if w.endswith("</w>") and len(w) >= 8 and w[:-4].isascii() and w[:-4].isalpha()})

    def cover(self, text: str) -> tuple[float, int]:
        """Share of the letters that words cover, and the longest word."""
        low, at, covered, longest = text.lower(), 0, 0, 0
        while at < len(low):
            for k in range(min(self.longest, len(low) - at), 3, -1):
                if low[at : at + k] in self.words:
                    covered, longest, at = covered + k, max(longest, k), at + k
                    break
            else:
                at += 1
        return covered / max(1, len(low)), longest


_dictionaries: dict[str, Dictionary] = {}


def dictionary(path: str) -> Dictionary:
    if path not in _dictionaries:
        _dictionaries[path] = Dictionary.of_tokenizer(path)
    return _dictionaries[path]


def features(candidate: str, before: str, after: str, path: str, words: Dictionary) -> list[float]:
    n = len(candidate)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in candidate]
    share = [kinds.count(k) / n for k in range(4)]
    run = best = 1
    for a, b in zip(kinds, kinds[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    counts = np.array([candidate.count(c) for c in set(candidate)]) / n
    cover, longest = words.cover(candidate)
    left = re.findall(r"[a-z0-9_]+", before.lower())[-4:]
    near = left + re.findall(r"[a-z0-9_]+", after.lower())[:2]
    tail = before.rstrip()[-24:]
    path = (path or "").lower()
    letters = [c for c in candidate.lower() if c.isalpha()]
    return [
        float(min(n, 200)), float(-(counts * np.log2(counts)).sum()), float(sum(s > 0 for s in share)), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), *share, best / n,
        len(set(candidate)) / min(n, 64), float(bool(re.fullmatch(r"[0-9a-fA-F]+", candidate))), float(bool(re.fullmatch(r"[A-Za-z0-9+/_\-]+={0,2}", candidate))), float(candidate.isdigit()), cover,
        float(longest), float(candidate.startswith(PREFIXES)), sum(a == b for a, b in zip(candidate, candidate[1:])) / max(1, n - 1), float(sum(any(k in w for k in KEY_WORDS) for w in near)),
        float(bool(left) and any(k in left[-1] for k in KEY_WORDS)), float(sum(w in OTHER_WORDS for w in near)), float(bool(re.search(r"[=:]\s*[\"']?$", tail))), float(before[-1:] in "\"'" and before != ""),
        float(any(w in path for w in PATH_WORDS)), float(any(w in path for w in SECRET_PATHS)), float(bool(re.search(r"(://|@|www\.)\S*$", before)) or "://" in candidate), sum(c in "aeiou" for c in letters) / max(1, len(letters)),
    ]


def _beside(before: bytes) -> bool:
    """Whether an assignment or a word with a key word ends the text before a candidate."""
    low = before.lower()
    last = re.findall(rb"[a-z0-9_]+", low)[-1:]
    return bool(re.search(rb"[=:]\s*[\"']?$", low)) or any(k.encode() in w for w in last for k in KEY_WORDS)


def _values(raw: bytes) -> Iterator[tuple[int, int]]:
    """Spans of the values assigned to a name with a key word."""
    for sign in ASSIGNED.finditer(raw):
        if KEY_NAME.search(raw[max(0, sign.start() - AROUND) : sign.start()].lower()) and (m := VALUE.match(raw, sign.end())):
            a, z = m.span(m.lastindex)
            yield a, a + len(m[3].rstrip(b",;)")) if m.lastindex == 3 else z


def candidates(text: str | None) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, candidate, before, after), positions in UTF-8 bytes, by start."""
    if not text:
        return
    raw = text.encode("utf-8", "replace")
    spans = {x for x in _values(raw) if x[1] - x[0] >= 4}
    for m in CANDIDATE.finditer(raw):
        word = m[0]
        start = m.start() + len(word) - len(word.lstrip(b".-=/"))
        word = word.strip(b".-=/") if not word.endswith(b"=") else word.lstrip(b".-=/")
        if len(word) < 16:
            continue
        plain = not re.search(rb"[0-9]", word) and (word.islower() or word.isupper() or word.istitle()) and b"_" not in word and len(word) < 32
        if not plain or word.startswith(_PREFIXES) or _beside(raw[max(0, start - AROUND) : start]):
            spans.add((start, start + len(word)))
    for start, end in sorted(spans):
        yield start, end, raw[start:end].decode("utf-8", "ignore"), raw[max(0, start - AROUND) : start].decode("utf-8", "ignore"), raw[end : end + AROUND].decode("utf-8", "ignore")


def examples(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings: (candidate, before, after, path, 1 for a secret)."""
    rng = random.Random(seed)
    pick = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ing", "tion", "ment", "eau", "sch", "keit", "dad", "mente"]
    word = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    prose = lambda: " ".join(word(rng.randint(1, 4)) for _ in range(6))
    names = ["token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "DB_PASSWORD", "apiKey", "private_key"]
    paths = ["src/app.py", "config/settings.yaml", ".env", "deploy/main.tf", "src1/42.txt", "src7/9001.txt", "notes.md", "lib/client.js"]
    calm = ["tests/fixtures/a.py", "docs/example.md", "package-lock.json", "vendor/x.go", "src3/17.txt", "src9/5.txt", "CHANGELOG.md", "src/app.py"]
    out = []
    for _ in range(n):
        kind = rng.randrange(9)
        value = [
            lambda: pick(hexes, rng.choice([32, 40, 40, 64])),
            lambda: pick(alnum, rng.randint(20, 48)),
            lambda: rng.choice(["AKIA", "ASIA"]) + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
            lambda: rng.choice(["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "npm_", "AIza"]) + pick(alnum, rng.randint(20, 40)),
            lambda: base64.b64encode(rng.randbytes(rng.randint(18, 48))).decode(),
            lambda: "eyJ" + pick(alnum, 30) + "." + pick(alnum, 60) + "." + pick(alnum + "-_", 43),
            lambda: pick(hexes.upper(), rng.choice([32, 40])),
            lambda: pick("abcdefghijklmnopqrstuvwxyz", rng.randint(16, 31)),
            lambda: pick(alnum + "!@#$%^&*", rng.randint(8, 20)),
        ][kind]()
        name = rng.choice(names)
        name = name.upper() if rng.random() < 0.2 else name
        quote = rng.choice(['"', '"', "'", ""])
        lead = rng.choice([prose() + " ", "", "export ", "  "])
        before = lead + name + rng.choice([" = ", "=", ": ", " := "]) + quote
        if kind in (2, 3, 5) and rng.random() < 0.3:
            before = prose() + " "
        out.append((value, before[-AROUND:], (quote + rng.choice([" ", "\n", ";", "!! "]) + rng.choice([prose(), prose(), word(1), ""]))[:AROUND], rng.choice(paths), 1))
    for _ in range(n):
        kind = rng.randrange(14)
        before, after = rng.choice([prose() + " ", prose() + " ", word(1) + " ", ""]), " " + rng.choice([prose(), prose(), word(1), ""])
        if kind == 0:
            value = word(rng.randint(6, 12))
        elif kind == 1:
            value, before = pick(hexes, rng.choice([32, 40, 64])), prose() + " " + rng.choice(["commit ", "sha256: ", "checksum ", "md5 = ", "revision: ", "build id "])
        elif kind == 2:
            value, before = rng.choice(["your_api_key_goes_here", "example_token_value_123", "xxxxxxxxxxxxxxxxxxxxxxxx", "00000000000000000000", "changeme_please_12345", "INSERT_TOKEN_HERE_0000", "placeholder-secret-value-1"]), prose() + " " + rng.choice(names) + " = " + rng.choice(['"', "'", ""])
        elif kind == 3:
            value = pick("0123456789", rng.choice([16, 16, 19, 20]))
        elif kind == 4:
            value = "-".join([pick(hexes, 8), pick(hexes, 4), pick(hexes, 4), pick(hexes, 4), pick(hexes, 12)])
        elif kind == 5:
            value, before = ".".join([word(2), word(3), "com"]) + "/" + word(2) + "/" + pick("0123456789", 4), prose() + " https://"
        elif kind == 6:
            value, before = word(2) + "." + word(3) + pick("0123456789", 2), prose() + " mail "
            after = "@" + word(2) + ".com " + prose()
        elif kind == 7:
            value = "_".join([word(2), word(2), word(3)]) + rng.choice(["", "_v2", "_2024"])
        elif kind == 8:
            value = "/".join([word(2), word(3), word(2) + ".py"])
        elif kind == 9:
            value = rng.choice(["-", "=", "_", "."]).join(word(1) for _ in range(9)) + pick("0123456789", 1)
        elif kind == 10:
            value, before = "sha512-" + base64.b64encode(rng.randbytes(48)).decode(), '"integrity": "'
        elif kind in (11, 12):
            quote = rng.choice(['"', "'", "", ""])
            value, before = rng.choice([word(rng.randint(2, 4)), word(rng.randint(3, 8)), word(2).capitalize(), word(2) + "." + word(2)]) if not quote else prose()[: rng.randint(8, 40)], rng.choice(["", prose() + " "]) + rng.choice(names) + rng.choice([": ", " = ", "="]) + quote
            after = quote + after
        else:
            value = "".join(word(2).capitalize() for _ in range(4)) + pick("0123456789", rng.randint(0, 2))
        out.append((value, before[-AROUND:], after[:AROUND], rng.choice(calm), 0))
    return out


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1: leaf), cut, left child (right: the next), share of label 1."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    left: list[np.ndarray]
    value: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, c, left, v in zip(self.feature, self.cut, self.left, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            rows = np.arange(len(x))
            for _ in range(DEPTH + 1):
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = left[at] + (x[rows, np.maximum(f[at], 0)] > c[at])
                at = np.where(inner, go, at)
            total += v[at]
        return total / max(1, len(self.feature))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 5) -> Forest:
    """Trees on bootstrap rows; each cut is the best by Gini over a random subset of features."""
    rng = np.random.default_rng(seed)
    forest, tries = Forest([], [], [], []), max(1, int(np.sqrt(x.shape[1])))
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        feature, cut, left, value, todo = [-1], [0.0], [0], [0.0], [(0, rows, 0)]
        while todo:
            node, own, depth = todo.pop()
            value[node] = float(y[own].mean())
            if depth == DEPTH or len(own) < 2 * LEAF or value[node] in (0.0, 1.0):
                continue
            best = (1e-12, -1, 0.0)
            whole = value[node] * (1 - value[node])
            for f in rng.choice(x.shape[1], tries, replace=False):
                order = np.argsort(x[own, f], kind="stable")
                v, t = x[own[order], f], np.cumsum(y[own[order]])
                k = np.flatnonzero(v[1:] > v[:-1])
                k = k[(k + 1 >= LEAF) & (len(own) - k - 1 >= LEAF)]
                if not len(k):
                    continue
                nl = k + 1.0
                pl, pr = t[k] / nl, (t[-1] - t[k]) / (len(own) - nl)
                gain = whole - (nl * pl * (1 - pl) + (len(own) - nl) * pr * (1 - pr)) / len(own)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (float(gain[j]), int(f), float((v[k[j]] + v[k[j] + 1]) / 2))
            if best[1] < 0:
                continue
            feature[node], cut[node], left[node] = best[1], best[2], len(feature)
            right = x[own, best[1]] > best[2]
            for part in (own[~right], own[right]):
                todo.append((len(feature), part, depth + 1))
                feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
        forest.feature.append(np.array(feature)), forest.cut.append(np.array(cut)), forest.left.append(np.array(left)), forest.value.append(np.array(value))
    return forest


def train(dictionary_path: str, rows: list[tuple[str, str, str, str, int]] | None = None) -> Forest:
    """A forest on labelled findings; examples() where none are given."""
    rows = examples() if rows is None else rows
    words = dictionary(dictionary_path)
    return fit(np.array([features(*r[:4], words) for r in rows]), np.array([r[4] for r in rows], np.float64))


def _scored(forest: Forest, words: Dictionary, texts: list, paths: list) -> list[tuple[int, tuple, float, list[float]]]:
    """(row, candidate, score, features) of all candidates of a batch."""
    found, x = [], []
    for i, (t, p) in enumerate(zip(texts, paths, strict=True)):
        for c in candidates(t):
            found.append((i, c))
            x.append(features(c[2], c[3], c[4], p, words))
    s = forest.score(np.array(x).reshape(-1, len(FEATURES)))
    return [(i, c, float(v), f) for (i, c), v, f in zip(found, s, x, strict=True)]


def _inputs(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))


def scan(docs: DataFrame, forest: Forest, dictionary_path: str, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate, with its score and whether it stays a finding; the candidate itself is only given as a digest."""
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(forest)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokenizer")
        words = dictionary(dictionary_path)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                ids = c.column(0).to_pylist()
                rows = [(ids[i], m[0], m[1], hashlib.sha256(m[2].encode()).hexdigest(), s, s >= THRESHOLD, f) for i, m, s, f in _scored(shared.value, words, c.column(1).to_pylist(), c.column(2).to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return _inputs(docs, id_col, text_col, path_col).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, forest: Forest, dictionary_path: str, text_col: str = "text", path: F.Column | None = None) -> DataFrame:
    """The same rows and columns; every finding in the text is replaced by MARKER."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    names = docs.columns
    at_text, schema = names.index(text_col), docs.schema
    rows = docs.withColumn("_path_of_row", F.lit("") if path is None else path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokenizer")
        words = dictionary(dictionary_path)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                texts = c.column(at_text).to_pylist()
                spans: dict[int, list[tuple[int, int]]] = {}
                for i, m, s, _ in _scored(shared.value, words, texts, c.column(c.num_columns - 1).to_pylist()):
                    if s >= THRESHOLD:
                        spans.setdefault(i, []).append(m[:2])
                for i, found in spans.items():
                    raw, end, out = texts[i].encode("utf-8", "replace"), 0, []
                    for a, z in found:
                        if a >= end:
                            out += [raw[end:a], MARKER.encode()]
                        end = max(end, z)
                    texts[i] = b"".join([*out, raw[end:]]).decode("utf-8")
                columns = [pa.array(texts, c.column(k).type) if k == at_text else c.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
