import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sieveglass.llm import maxent as M


def corpus(n=150):
    rng = random.Random(6)
    groups = [[f"g{g}w{i}" for i in range(60)] for g in range(4)]
    rows = []
    for i in range(n):
        g = groups[i % 4]
        rows.append((i, " ".join(g[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(1, 150)))))
    return rows


def test_base_is_exact_and_the_model_beats_it(spark):
    rows = corpus() + [(900, None), (901, ""), (902, "Unseen g0w1 G0W1 UNSEEN"), (902, "Unseen g0w1 G0W1 UNSEEN"), (903, "g1w1 " * 70000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(3)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    toks = {i: [*(t or "").encode().lower().split(), M.END] for i, t in rows}
    c = Counter()
    for i, t in rows:
        if i not in held:
            c.update(toks[i])
    n, v = sum(c.values()), len(c)
    want = {i: sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts) for i, ts in toks.items()}
    got = M.fit_and_score(df, M.crc_mod("doc_id", 10) != 0, head=40).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        assert r.train_tokens == n and r.n_tokens == len(toks[r.doc_id])
        assert r.n_known == sum(c[t] > 0 for t in toks[r.doc_id])
        assert r.base_score == pytest.approx(want[r.doc_id], rel=1e-9)
        assert r.score < 0
    some = [r for r in got if r.doc_id < 900]
    assert sum(r.score for r in some) > sum(r.base_score for r in some)
    rest = [r for r in some if r.doc_id in held]
    assert sum(r.score for r in rest) > sum(r.base_score for r in rest)


def test_classes_are_a_distribution(spark):
    texts = spark.createDataFrame(corpus(60), "doc_id long, text string")
    model, tail, _ = M.train(texts, head=30)
    assert tail.count() > 0
    padded = np.array([M.UNITS + M.SUFFIXES] * 3 + [5, 7, 9])
    feats = M.features(padded, np.array([3, 4, 5]))
    p = model.class_share(feats)
    assert np.allclose(np.exp(model.class_log(feats, np.array([1, 2, 3]))), p[[0, 1, 2], [1, 2, 3]], rtol=1e-4)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    total = model.vocab.tokens + M.ALPHA * (model.vocab.distinct + M.CLASSES)
    assert model.mass.sum() == pytest.approx(total)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = M.fit_and_score(df, M.F.lit(False)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert M.fit_and_score(df.limit(0), M.F.lit(True)).collect() == []


def tokens_of(rows):
    return sum(len((t or "").split()) + 1 for _, t in rows)


def test_every_update_sums_over_all_training_documents(spark, monkeypatch):
    seen = []

    def gather(units, model, expected, f=M._gather):
        got = f(units, model, expected)
        seen.append((expected, got.sum()))
        return got

    monkeypatch.setattr(M, "_gather", gather)
    rows = corpus(40)
    M.train(spark.createDataFrame(rows, "doc_id long, text string"), head=30)
    n = 4 * tokens_of(rows)
    assert [e for e, _ in seen] == [False] + [True] * M.STEPS
    assert [x for _, x in seen] == pytest.approx([n] * (1 + M.STEPS), rel=1e-3)


def test_classes_come_from_all_training_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "classes", lambda units, f=M.classes: seen.append(sum(len(p) for p in [np.frombuffer(r.units, np.uint16) for r in units.collect()])) or f(units))
    rows = [(i, "a b") for i in range(4300)]
    M.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), M.F.lit(True))
    assert seen == [4300 * (3 + 3)]


def test_neighbours_are_counted_exactly(spark):
    vocab = M.Vocabulary({w: i for i, w in enumerate([M.END, b"a", b"b"])}, np.array([9, 9, 9]), np.array([0, 1, 2, 0]), 27, 3)
    units = M.encoded(spark.createDataFrame([("a b a",), (None,)], "text string").repartition(1), vocab)
    got = Counter()
    for r in M.neighbours(M.training(units)).collect():
        got[divmod(r.cell, M.ANCHORS)] = r.n
    # a b a end: each token within two places; padding parts the texts, at the ends it is clipped
    assert got[1, 2] == got[2, 1] == 2 and got[1, 1] == 2 and got[1, 0] == 1 and got[2, 0] == 1 and got[0, 2] == 1


def test_held_out_texts_are_not_learnt_from(spark):
    vocab = M.Vocabulary({w: i for i, w in enumerate([M.END, b"a", b"b"])}, np.array([9, 9, 9]), np.array([0, 1, 2, 0]), 27, 3)
    rows = [(1, "a b", True), (2, "b b b b", False), (3, "a", True)]
    chunks = M.encoded(spark.createDataFrame(rows, "doc_id long, text string, learns boolean").repartition(1), vocab)
    learnt = [padded[place].tolist() for padded, place in M._arrays(M.training(chunks).toArrow().to_batches())]
    assert sorted(sum(learnt, [])) == [0, 0, 1, 1, 2]


def test_context_tells_words_of_a_class_apart(spark, monkeypatch):
    monkeypatch.setattr(M, "classes", lambda units: np.zeros(M.UNITS + M.SUFFIXES + 1, np.int64))
    rows = [(i, "red ball" if i % 2 else "blue kite") for i in range(60)]
    asked = {100: "red ball", 101: "red kite", 102: "blue kite", 103: "blue ball"}
    df = spark.createDataFrame(rows + [*asked.items()], "doc_id long, text string")
    got = {asked[r.doc_id]: r.score for r in M.fit_and_score(df, M.F.col("doc_id") < 100).collect() if r.doc_id in asked}
    assert got["red ball"] > got["red kite"] + 0.5 and got["blue kite"] > got["blue ball"] + 0.5


def test_units_of_a_class_are_a_distribution(spark):
    model, tail, _ = M.train(spark.createDataFrame(corpus(60), "doc_id long, text string"), head=30)
    assert np.abs(model.tree.weights).max() > 0.1
    for k in range(M.CLASSES):
        own = np.flatnonzero((model.klass[: len(model.tree.mass)] == k) & (model.tree.mass > 0))
        if len(own):
            padded = np.concatenate([np.r_[5, 7, 9, u] for u in own])  # the same context before each unit
            assert np.exp(model.tree.log(padded, np.arange(len(own)) * 4 + 3)).sum() == pytest.approx(1, abs=1e-3)
    # words and slots make up the units; without weights a unit's share is that of its mass
    words = model.vocab.tokens + M.ALPHA * (model.vocab.distinct + M.SUFFIXES)
    assert model.tree.mass.sum() == pytest.approx(words) and tail.count() > 0
    bare = M.tree(model.klass, model.tree.mass)
    own = np.flatnonzero((model.klass[: len(bare.mass)] == model.klass[0]) & (bare.mass > 0))
    share = bare.log(np.concatenate([np.r_[5, 7, 9, u] for u in own]), np.arange(len(own)) * 4 + 3)
    assert np.allclose(np.exp(share), bare.mass[own] / bare.mass[own].sum(), rtol=1e-3)


def test_decisions_are_counted_over_all_training_documents(spark):
    model, _, chunks = M.train(spark.createDataFrame(corpus(40), "doc_id long, text string").repartition(3), head=30)
    units = M.training(chunks)
    n = ones = 0
    for padded, place in M._arrays(units.toArrow().to_batches()):
        for u in padded[place]:
            side = model.tree.side[model.tree.at[u] : model.tree.at[u + 1]]
            n, ones = n + 4 * len(side), ones + 4 * int(side.sum())
    base, every, taken = M._gather_decisions(units, M.tree(model.klass, model.tree.mass), True)
    assert every.sum() == n and taken.sum() == ones
    assert base.sum() == pytest.approx(ones, rel=0.01)  # masses are counts and the smoothing


def test_observed_decisions_are_those_of_plain_counting(spark, monkeypatch):
    """Equal pairs of feature and unit are counted first, some tokens at a time; the weight rows are those that updates and scores use."""
    model, _, chunks = M.train(spark.createDataFrame(corpus(40), "doc_id long, text string").repartition(3), head=30)
    batches, bare = M.training(chunks).toArrow().to_batches(), M.tree(model.klass, model.tree.mass)
    want = np.zeros((3, M.NODE_ROWS))
    for padded, place in M._arrays(batches):
        for _, step, rows, z in bare.decisions(padded, place):
            for r in rows:
                for x, v in enumerate((1 / (1 + np.exp(-z)), 1.0, bare.side[step])):
                    np.add.at(want[x], r, v)
    assert np.allclose(M._gather_decisions(M.training(chunks), bare, True), want, rtol=1e-4)
    monkeypatch.setattr(M, "_COUNTED_AT_ONCE", 1000)
    pairs = [(u, h, c) for unit, hashes, n in M._pairs(iter(batches)) for u, h, c in zip(unit.tolist(), hashes.tolist(), n.tolist())]
    assert sum(c for *_, c in pairs) == 4 * tokens_of(corpus(40)) > len(pairs)


def test_a_context_has_the_weights_of_a_subtree_side_by_side():
    rng = np.random.default_rng(3)
    t = M.tree(rng.integers(0, M.CLASSES, M.UNITS + M.SUFFIXES + 1), rng.random(M.UNITS + M.SUFFIXES) * (rng.random(M.UNITS + M.SUFFIXES) < 0.1))
    n = np.diff(t.at)
    unit = int(n.argmax())
    row = t.row[t.at[unit] : t.at[unit + 1]][::-1]  # from the root
    assert n.max() > 6 and (row[:6].reshape(2, 3) >> M._LEVELS == row[[0, 3], None] >> M._LEVELS).all()
    assert len(set(row.tolist())) == len(row) and len(np.unique(row[:3] & 7)) == 3
    assert (np.diff(n[np.argsort(t.rank)]) <= 0).all()
    met = np.zeros(len(n) - 1, np.int64)
    for owner, step, _ in t.levels(np.arange(len(n) - 1), [np.zeros(len(n) - 1, np.int64)]):
        met[owner] += 1
        assert (t.at[owner] <= step).all() and (step < t.at[owner + 1]).all()
    assert (met == n[:-1]).all()


def test_rows_of_chunks_hold_their_rare_words(spark):
    """Passes over the training documents read a row a chunk, and none for each rare word."""
    vocab = M.Vocabulary({b"a": 0}, np.array([9]), np.array([0, 0]), 9, 1)
    chunks = M.encoded(spark.createDataFrame([("a x y x",), (None,), ("y a",)], "text string").repartition(1), vocab)
    assert chunks.count() == M.training(chunks).count() == 1
    (r,) = chunks.collect()
    found = sorted(zip(np.frombuffer(r.owner, np.int32).tolist(), bytes(r.word).split(b" "), np.frombuffer(r.tf, np.int32).tolist()))
    assert sum(n for *_, n in found) == 4 + 3 and len(found) == 6
    assert sorted(Counter(w for _, w, _ in found).items()) == [(M.END, 3), (b"x", 1), (b"y", 2)]


def test_paths_through_subtrees_are_their_decisions():
    rng = np.random.default_rng(4)
    t = M.tree(rng.integers(0, M.CLASSES, M.UNITS + M.SUFFIXES + 1), rng.random(M.UNITS + M.SUFFIXES) * (rng.random(M.UNITS + M.SUFFIXES) < 0.1))
    t.weights = rng.normal(size=M.NODE_ROWS).astype(np.float32)
    n = np.diff(t.at)
    padded = np.r_[5, 7, 9, np.flatnonzero(n), int(n.argmax())]
    place = np.arange(3, len(padded))
    want, met, odds = np.zeros(len(place)), np.zeros(len(place), int), np.zeros(len(place))
    for owner, step, _, z in t.decisions(padded, place):
        np.add.at(want, owner, -np.log(1 + np.exp(np.where(t.side[step], -z, z).astype(float))))
        np.add.at(odds, owner, z)
        np.add.at(met, owner, 1)
    assert np.allclose(t.log(padded, place), want, rtol=1e-5)
    assert set((n - 1) % M._LEVELS) > {0, 1}  # paths of every length
    for owner, step, _, z in t.paths(padded, place):
        have = t.path_odds[step] != M._NONE
        np.subtract.at(met, owner, have.sum(axis=1))
        np.subtract.at(odds, owner, np.where(have, z, 0).sum(axis=1))
    assert not met.any() and np.allclose(odds, 0, atol=1e-3)
    t.weights = np.zeros(M.NODE_ROWS, np.float32)  # what paths read follows the weights
    assert np.allclose([np.exp(t.log(np.r_[5, 7, 9, u], np.array([3])))[0] for u in padded[-1:]], np.prod([1 / (1 + np.exp(-o if s else o)) for o, s in zip(t.odds[t.at[padded[-1]] : t.at[padded[-1] + 1]], t.side[t.at[padded[-1]] : t.at[padded[-1] + 1]])]))


def test_sums_of_updates_are_those_of_plain_counting(spark, monkeypatch):
    """Numbers are added in single precision, two at once, and settled every so many tokens."""
    monkeypatch.setattr(M, "_SINGLE", 500)
    model, _, chunks = M.train(spark.createDataFrame(corpus(40), "doc_id long, text string").repartition(3), head=30)
    units = M.training(chunks)
    want, shares = np.zeros(M.NODE_ROWS), np.zeros((M.ROWS, M.CLASSES))
    for padded, place in M._arrays(units.toArrow().to_batches()):
        for _, _, rows, z in model.tree.decisions(padded, place):
            for r in rows:
                np.add.at(want, r, 1 / (1 + np.exp(-z.astype(float))))
        feats = M.features(padded, place)
        for f in feats:
            np.add.at(shares, f, model.class_share(feats))
    assert np.allclose(M._gather_decisions(units, model.tree, False)[0], want, rtol=1e-4, atol=1e-5)
    assert np.allclose(M._gather(units, model, True), shares, rtol=1e-4, atol=1e-5)


def test_one_addition_serves_two_classes(spark, monkeypatch):
    """The sums of an update take half as many additions as there are classes and features."""
    model, _, chunks = M.train(spark.createDataFrame(corpus(4), "doc_id long, text string").repartition(1), head=30)
    units, done = M.training(chunks), []
    batches = units.toArrow().to_batches()

    class Add:
        def __call__(self, *a, **k):
            return np.add(*a, **k)

        def at(self, to, rows, x):
            done.append(len(rows))
            np.add.at(to, rows, x)

    monkeypatch.setattr(type(units), "mapInArrow", lambda self, run, schema: list(run(iter(batches))))
    monkeypatch.setattr(M, "_add_up", lambda blocks, *a: np.zeros(M.ROWS * M.CLASSES))

    class Numpy:
        add = Add()

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(M, "np", Numpy())
    monkeypatch.setattr(M, "_blocks", lambda total: iter(()))
    M._gather(units, model, True)
    assert sum(done) == 4 * tokens_of(corpus(4)) * M.CLASSES // 2
