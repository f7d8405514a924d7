import random

import numpy as np

from sieveglass.llm import decontamination as D


def brute(doc, item):
    best = 0
    h = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            s = D.MATCH if doc[j - 1] == item[i - 1] else D.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_is_the_best():
    rng = random.Random(1)
    for _ in range(200):
        a = np.array([rng.randrange(5) for _ in range(rng.randint(1, 30))])
        b = np.array([rng.randrange(5) for _ in range(rng.randint(1, 12))])
        score, same, i, j, x, y = D.align(a, b)
        assert score == brute(a.tolist(), b.tolist())
        assert same <= min(j - i, y - x)


def edited(rng, toks):
    out = []
    for t in toks:
        r = rng.random()
        if r < 0.12:
            out.append("other%d" % rng.randrange(99))
        elif r < 0.17:
            continue
        else:
            out.append(t)
        if rng.random() < 0.05:
            out.append("extra")
    return out


def test_planted_passages(spark):
    rng = random.Random(2)
    vocab = [f"v{int(rng.expovariate(0.004))}" for _ in range(4000)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(15, 60))]) for i in range(30)]
    rows, want = [], set()
    for d in range(120):
        toks = [rng.choice(vocab) for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            i, it = rng.choice(items)
            at = rng.randrange(len(toks) + 1)
            toks[at:at] = it if d % 2 else edited(rng, it)
            want.add((d, i))
        rows.append((d, " ".join(toks).upper() if d % 5 == 0 else ", ".join(toks), "clash"))
    rows += [(500, None, "x"), (501, "", "x"), (502, " ".join(items[0][1]) * 500, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(98, None), (99, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contamination(docs, bench).collect()}
    assert want <= set(got)
    assert {k for k in got if k[0] < 500} == want and (502, 0) in got
    assert not any(k[0] in (500, 501) for k in got)
    small = {(r.doc_id, r.item_id) for p in [D.contamination] for r in p(docs, bench).collect()}
    assert small == set(got)


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x a b c d e f y"), (2, "g h i j k l"), (2, "g h i j k l")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "item_id long, text string")
    one = sorted(D.contamination(docs, bench).collect())
    monkeypatch.setattr(D.blocks, "__defaults__", (6,))
    assert sorted(D.contamination(docs, bench).collect()) == one
    assert [(r.doc_id, r.item_id) for r in one] == [(1, 1), (2, 2), (2, 2)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).count() == 0


def test_short_and_long_items(spark):
    rng = random.Random(7)
    long = [f"w{rng.randrange(3000)}" for _ in range(5000)]
    bench = spark.createDataFrame([(1, "yes"), (2, "two words"), (3, " ".join(long)), (4, "")], "item_id long, text string")
    other = [f"o{rng.randrange(3000)}" for _ in range(400)]
    rows = [(1, "Yes."), (2, "yes it is so"), (3, "two, words!"), (4, "words two"), (5, " ".join(other[:90] + long[3100:3180] + other[90:])), (6, " ".join(other)), (7, " ".join(long)), (8, None), (9, " ".join(edited(rng, long[4900:])))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contamination(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 2), (5, 3), (7, 3), (9, 3)}
    r = got[5, 3]
    assert (r.start, r.end, r.item_start, r.item_end) == (90, 170, 3100, 3180)
    assert {r.doc_id for r in D.keep_clean(docs, bench).collect()} == {2, 4, 6, 8}


def test_whole_query_against_every_alignment(spark):
    """Without seeds: each document aligned with each item."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(150)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(12, 25))]) for i in range(8)]
    rows = []
    for d in range(40):
        toks = [rng.choice(vocab) for _ in range(rng.randint(20, 60))]
        if d % 2:
            at = rng.randrange(len(toks))
            toks[at:at] = edited(rng, rng.choice(items)[1])
        rows.append((d, " ".join(toks)))
    got = {(r.doc_id, r.item_id): r.score for r in D.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")).collect()}
    number = {w: k for k, w in enumerate({w for _, t in rows for w in t.split()} | {w for _, t in items for w in t})}
    want = {}
    for d, text in rows:
        for i, item in items:
            score = brute([number[w] for w in text.split()], [number[w] for w in item]) / (D.MATCH * min(len(item), D.PART))
            if score >= D.THRESHOLD:
                want[d, i] = score
    assert len(want) >= 15 and got == want
