import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveglass.llm import toxicity as T
from sieveglass.llm.common import auc, crc_mod_py


def corpus(n=400):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    bad = ["vile", "rotten", "dreck"]
    rows = []
    for i in range(n):
        toks = [vocab[min(399, int(rng.expovariate(0.02)))] for _ in range(rng.randint(5, 120))]
        y = int(rng.random() < 0.25)
        if y:
            for _ in range(rng.randint(1, 3)):
                toks.insert(rng.randrange(len(toks)), rng.choice(bad))
        rows.append((i, " ".join(toks), y))
    return rows


def test_held_out_documents(spark):
    rows = corpus() + [(900, None, None), (901, "", None), (902, "!!!", None), (903, "vile " * 3000, None)]
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.judged(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [(y, got[i].score, got[i].predicted) for i, _, y in rows if y is not None and got[i].held_out]
    y, s, p = map(np.array, zip(*held))
    assert auc(y, s) > 0.97
    assert (p == y).mean() > 0.93
    assert p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.05
    assert got[900].score == got[901].score == got[902].score < 0.5
    assert got[903].score > 0.7
    flipped = labels.withColumn("toxic", F.when(T.crc_mod("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in T.judged(docs, flipped).collect()}
    assert all(again[i] == pytest.approx(got[i].score) for i in got)


def everything(m, vocabulary):
    """Each known word, and an unseen one for each group that may have some and for all others."""
    unseen = {T.group(w, k)[: k] + b"~" * (12 - k) for w in vocabulary for k in T.PREFIXES if not T.group(w, k).endswith(b"\0")}
    for w in unseen:
        assert w not in vocabulary
    return [*vocabulary, *unseen, b"?" * 20]


def test_probabilities_sum_to_one(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "beginning", "beginnings", "beginner", "begin", "strange", "stranger", "strangers", "strangely", "it", "italian", "italians", "vile", "vilest"]
    rows = [(i, " ".join(rng.choice(vocab[: 9 + 6 * (i % 2)]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    m = T.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"), F.lit(True))
    folds = {r.doc_id: r.f for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "pmod(xxhash64(doc_id, 'fold'), 4) AS f").collect()}
    known = {w for i, t in rows if folds[i] for w in T.tokens(t)}
    assert len(known) > 10
    ends = everything(m, known)
    assert len(ends) > len(known) + 3
    for before in [None, *known, b"never"]:
        texts = [[w] if before is None else [before, w] for w in ends]
        ll, *_ = m.likelihoods(texts)
        last = np.cumsum([len(t) for t in texts]) - 1
        assert np.exp(ll[:, last]).sum(axis=1) == pytest.approx([1, 1], abs=1e-9)


def test_model_survives_pickling(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(60)], "doc_id long, text string")
    m = T.train(docs, spark.createDataFrame([(i, y) for i, _, y in corpus(60)], "doc_id long, toxic int"), F.lit(True))
    again = pickle.loads(pickle.dumps(m))
    assert len(m.pairs) and (m.pairs == again.pairs).all() and (m.pair_n == again.pair_n).all()
    texts = [T.tokens(t) for _, t, _ in corpus(60)]
    assert (m.features(texts) == again.features(texts)).all()
    none = T.Model.empty(0.5)
    assert pickle.loads(pickle.dumps(none)).probability(np.zeros((2, 6))).tolist() == [0.5, 0.5]


def test_discounts():
    assert T.discounts(np.array([5, 0, 1, 1])).tolist() == [0, T.DISCOUNT, T.DISCOUNT, T.DISCOUNT]
    got = T.discounts(np.array([100, 40, 20, 12]))
    assert got[1:] == pytest.approx([1 - 2 * (5 / 9) * 0.4, 2 - 3 * (5 / 9) * 0.5, 3 - 4 * (5 / 9) * 0.6])


def test_operating_point():
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.2).astype(float)
    s = np.round(np.clip(0.2 + 0.3 * y + 0.2 * rng.standard_normal(400), 0, 1), 2)
    w = np.where(y == 1, 1.0, 3.0)
    cut = T.operating_point(s, y, w)
    best = max((s[y == 1] >= c).mean() + (s[y == 0] < c).mean() for c in np.unique(s) if (s[y == 0] < c).mean() >= T.SPECIFICITY)
    assert (s[y == 0] < cut).mean() >= T.SPECIFICITY
    assert (s[y == 1] >= cut).mean() + (s[y == 0] < cut).mean() == pytest.approx(best)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_one_class_or_none(spark, labels):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    got = T.judged(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    fitted = [y for i, y in labels if crc_mod_py(i, 3) != 1]
    assert {r.score for r in got} == {float(fitted == [1])}
    assert T.judged(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_most_telling_words_of_the_whole_text():
    names = T.hashes([b"a", b"b", b"c"])
    order = np.argsort(names)
    p = np.array([[0.1, 0.1, 0.1], [0.9, 0.6, 0.4]])
    none = np.zeros(0, np.uint64)
    m = T.Model(names[order], p[:, order], np.log(p[1] / p[0])[order], 0.0, np.zeros((2, 3)), np.ones((2, 3)), np.zeros((2, 4)), none, np.zeros((2, 0), np.uint16), (none, none), (np.zeros((2, 0)), np.zeros((2, 0)), np.full((2, 1), 0.1)), None, 0.0)
    got = m.features([[b"a"] * 500 + [b"b", b"c"], []])
    assert got[0, 4:] == pytest.approx([np.log(9), np.log(9 * 6 * 4)])
    assert not got[1].any()
