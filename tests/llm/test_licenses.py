import math
import random
from collections import Counter

import pytest

from sieveglass.llm import licenses as L


def brute(rows, threshold):
    """Best template of each file by plain loops."""
    vocabulary = {t for _, x in L.TEMPLATES for t in L.terms(x)}
    df = Counter(t for _, x, _ in rows for t in set(L.terms(x or "")) & vocabulary)
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in vocabulary}
    out = {}
    for i, text, path in rows:
        low = (text or "").lower()
        parts = low.split("\n") + [p for p in L.re.split(r"\n[ \t\r]*\n", low) if "\n" in p]
        if path and L.re.search(L.LICENSE_FILE, path.split("/")[-1]):
            parts.append(low)
        for p in parts:
            v = {t: n * idf.get(t, L.OTHER) for t, n in Counter(L.terms(p)).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for name, x in L.TEMPLATES:
                u = {t: n * idf[t] for t, n in Counter(L.terms(x)).items()}
                dot = sum(v.get(t, 0) * w for t, w in u.items())
                s = round(dot / norm / math.sqrt(sum(w * w for w in u.values())), 6) if norm else 0
                if s >= threshold:
                    out[i] = min(out.get(i, (0, "")), (-s, name))
    return {i: (n, -s) for i, (s, n) in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["the", "license", "of", "under", "word", "thing", "Version", "erion", "public", "software", "2.0"]
    out = []
    for i in range(120):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 15))) for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            t = rng.choice(L.TEMPLATES)[1].split()
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = "other"
            lines.insert(rng.randrange(len(lines) + 1), " ".join(t) + rng.choice([".", "", "!"]))
        out.append((i, "\n".join(lines), f"s/{i % 3}/{i}.txt"))
    mit = L.TEMPLATES[4][1].replace(", to any", ",\nto any")
    return out + [(900, None, "s/0/x"), (901, "", None), (902, mit, "s/1/LICENSE"), (903, L.TEMPLATES[0][1], "s/COPYING"), (904, "plain", "s/1/deep/er/a.txt"), (905, "plain", "s/2/b.txt"), (906, "plain", "t/c.txt"), (907, "plain\n" * 9000, "top.txt")]


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, path string, score int").repartition(3)
    got = {r.doc_id: r for r in L.scan(df).collect()}
    want = brute(rows, L.THRESHOLD)
    assert len(got) == len(rows) and len(want) > 20
    assert {i: r.license for i, r in got.items() if r.origin == "own"} == {i: n for i, (n, _) in want.items()}
    assert all(got[i].score == pytest.approx(s, abs=2e-6) for i, (_, s) in want.items())
    assert (got[904].license, got[904].origin) == ("MIT", "inherited")
    assert (got[905].license, got[905].origin) == ("Apache-2.0", "inherited")
    assert got[900].license == "Apache-2.0" and got[901].license is None and got[906].license is None and got[907].origin is None


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string, path string")).count() == 0


def test_known_notices(spark):
    rows = [(i, f"some text here\n{t}", f"a/{i}.txt") for i, (_, t) in enumerate(L.TEMPLATES)]
    got = {r.doc_id: r.license for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {i: n for i, (n, _) in enumerate(L.TEMPLATES)}
