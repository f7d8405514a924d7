import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveglass.llm import quality as Q
from sieveglass.llm.common import auc, crc_mod_py


def corpus(n=500):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        toks = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 90))]
        y = int(rng.random() < 0.7)
        if not y:
            kind = rng.randrange(3)
            toks = [t.upper() + "!!" for t in toks] if kind == 0 else [t for t in toks[:6] for _ in range(12)] if kind == 1 else [t + "%%%" for t in toks]
        rows.append((i, " ".join(toks), y))
    return rows


def test_held_out_documents(spark):
    rows = corpus() + [(900, None, None), (901, "", None), (902, "word " * 50000, None)]
    docs = spark.createDataFrame([(i, t, 3) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.judged(docs, labels).collect()}
    held = [(y, got[i].score, got[i].predicted) for i, _, y in rows if y is not None and got[i].held_out]
    assert {i for i, _, _ in rows if got[i].held_out} == {i for i, _, _ in rows if crc_mod_py(i, 4) == 2}
    y, s, p = map(np.array, zip(*held))
    assert auc(y, s) > 0.98 and (p == y).mean() > 0.93
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    flipped = labels.withColumn("quality", F.when(Q.crc_mod("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in Q.judged(docs, flipped).collect()}
    assert all(again[i] == pytest.approx(got[i].score) for i in got)


def test_interaction_is_learned():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    w = np.ones(len(y))
    alone, both = Q.fit(x[:3000], y[:3000], w[:3000], pairs=0), Q.fit(x[:3000], y[:3000], w[:3000], pairs=2)
    assert auc(y[3000:], alone.score(x[3000:])) < 0.65
    assert auc(y[3000:], both.score(x[3000:])) > 0.97
    assert (0, 1) in both.pairs


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(4)
    x = rng.random((500, 4))
    m = Q.fit(x, (x[:, 0] > 0.4).astype(float), np.ones(500), rounds=20)
    for row in x[:20]:
        total = m.intercept + sum(m.tables[f][int((m.edges[f] < row[f]).sum())] for f in range(4))
        total += sum(t[int((m.coarse[a] < row[a]).sum()), int((m.coarse[b] < row[b]).sum())] for (a, b), t in zip(m.pairs, m.pair_tables))
        assert m.raw(row[None])[0] == pytest.approx(total)


@pytest.mark.parametrize("labels", [[], [(2, 1)], [(2, 0), (5, 0)]])
def test_one_class_or_none(spark, labels):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    fitted = [y for i, y in labels if crc_mod_py(i, 4) != 2]
    got = Q.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {r.score for r in got} == {float(1 in fitted)}


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int")
    assert Q.judged(docs, labels).count() == 0 and Q.judged(docs, labels.limit(0)).count() == 0
