import random

import numpy as np
import pytest
import xxhash

from sieveglass.llm import simhash as S


def brute_fingerprint(text):
    toks = (text or "").encode().lower().split()
    if not toks:
        return 0
    shingles = [b" ".join(toks[i : i + 4]) for i in range(max(1, len(toks) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if j > i and bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


RINGS = [S.NARROW, S.WIDE]


@pytest.mark.parametrize("ring", RINGS)
def test_every_close_pair_shares_a_key_and_passes_the_chain_filter(ring):
    rng = random.Random(1)
    for _ in range(2000):
        x = np.array([sum(1 << b for b in rng.sample(range(64), rng.randint(0, ring.tau)))], np.uint64)
        assert ring.first[ring.agreeing(x)[0]] < len(ring.keys)
        assert ring.viable_chain(x)[0]


def plain_chain(ring, x):
    diff = [bin(x & int(m)).count("1") for m in ring.masks]
    return any(all(sum(diff[(s + i) % ring.segments] for i in range(n)) <= n * ring.tau // ring.segments for n in range(1, ring.chain + 1)) for s in range(ring.segments))


@pytest.mark.parametrize("ring", RINGS)
def test_the_chain_filter_prunes_before_the_hamming_check(ring):
    """Among pairs that share a key by chance most go, and some of those that stay fail the full check."""
    rng = random.Random(4)
    xor = []
    for _ in range(20000):
        key = rng.choice(ring.keys)
        x = rng.getrandbits(64)
        if rng.random() < 0.3:  # close ones too
            x &= rng.getrandbits(64) & rng.getrandbits(64)
        for s in key:
            x &= ~int(ring.masks[s])
        xor.append(x)
    got = ring.viable_chain(np.array(xor, np.uint64))
    assert got.tolist() == [plain_chain(ring, x) for x in xor]
    counts = np.zeros(3, np.int64)
    ring.near(np.array(xor, np.uint64), np.zeros(len(xor), np.uint64), counts)
    met, viable, linked = counts.tolist()
    assert met == len(xor) and linked < viable < 0.6 * met


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, "a b c d"), (5, " \t\n")]
    for i in range(6, 220):
        if i % 3 and len(rows) > 10:
            t = rows[rng.randrange(6, len(rows))][1].split()
            if i % 2:
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((i, " ".join(t)))
        else:
            rows.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randint(30, 200)))))
    rows.append((7, rows[7][1]))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    got = [(r.doc_id, r.fp, r.component_id) for r in S.near_duplicates(df).collect()]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    comp = brute_components(fps)
    want = [(i, int(np.uint64(fps[i]).view(np.int64)), comp[i]) for i, _ in rows]
    assert sorted(got) == sorted(want)
    assert len({c for _, _, c in got}) < len(rows) - 60


@pytest.mark.parametrize("most", [1 << 18, 30])
def test_overfull_keys_are_divided(spark, most):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {i: base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for i in range(400)}
    fps |= {1000 + i: rng.getrandbits(64) for i in range(50)}
    apart = [rng.getrandbits(37) << 27 | 0x2ABCDEF for _ in range(60)]  # one key, nothing near
    fps |= {2000 + i: f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for i, f in enumerate(apart * 3)}
    ring = S.Ring(7, 4, 4, small=6, run=9, most=most)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), 0) for f in set(fps.values())], "fp long, more long")
    assert len(list(S._met(df, ring))) >= 2
    got = {r.node: r.component for r in S.components(S.links(df, ring)).collect()}
    of = {i: int(np.uint64(f).view(np.int64)) for i, f in fps.items()}
    groups = {}
    for i, c in brute_components(fps).items():
        groups.setdefault(c, set()).add(got.get(of[i], of[i]))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


@pytest.mark.parametrize("ring", RINGS)
@pytest.mark.parametrize("most", [1 << 18, 100])
def test_a_task_links_a_group_by_a_forest(ring, most, monkeypatch):
    """Edges don't grow with the square of a group, nor by key."""
    monkeypatch.setattr(S, "_EDGES", most)
    rng = random.Random(5)
    groups = [[rng.getrandbits(64)] for _ in range(4)]
    for g, size in zip(groups, (2, 30, 60, 300)):
        g += [g[0] ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(size)]
    fps = sorted({f for g in groups for f in g})
    rows = S.pa.record_batch([S.pa.array(np.array(fps, np.uint64).view(np.int64)), S.pa.array(np.zeros(len(fps), np.int64))], ["fp", "more"])
    keyed = S.pa.Table.from_batches(S._keyed(ring)([rows])).sort_by("key").combine_chunks().to_batches()
    edges = [(a, b) for o in S._link(ring, True)(keyed) for a, b in zip(o["a"].to_pylist(), o["b"].to_pylist()) if b is not None]
    assert all(a > b for a, b in edges)
    if most > len(fps):
        assert len(edges) == len(fps) - len(groups)
    at = {int(np.uint64(f).view(np.int64)): i for i, f in enumerate(fps)}
    label = S._labels(len(fps), *(np.array([at[e[i]] for e in edges]) for i in (0, 1)))
    assert sorted(tuple(sorted({fps[i] for i in np.flatnonzero(label == x)})) for x in set(label)) == sorted(tuple(sorted(set(g))) for g in groups)


def test_counts_of_candidates(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for f in base for _ in range(6)}
    r = S.candidate_counts(spark.createDataFrame([(int(np.uint64(f).view(np.int64)), 0) for f in fps], "fp long, more long")).first()
    assert r.met > r.viable > r.linked > 0


def shingles(text, n=5):
    toks = text.lower().split()
    return {tuple(toks[i : i + n]) for i in range(max(1, len(toks) - n + 1))}


def test_keep_one_at_a_similarity(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    rows, copies = [], {}
    for i in range(120):
        toks = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        rows.append((i, " ".join(toks)))
        near = list(toks)
        for _ in range(rng.choice([1, 1, 2, 3, 8, 30])):
            near[rng.randrange(len(near))] = "other"
        copies[1000 + i] = i
        rows.append((1000 + i, " ".join(near)))
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    j = {c: len(shingles(text[c]) & shingles(text[i])) / len(shingles(text[c]) | shingles(text[i])) for c, i in copies.items()}
    assert set(range(120)) <= kept
    assert not [c for c in copies if j[c] < 0.6 and c not in kept]
    close = [c for c in copies if j[c] >= 0.9]
    assert len(close) > 20 and sum(c not in kept for c in close) > 0.8 * len(close)


def test_rows_of_one_id_count_apart(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(7, long), (7, "quite another text that has words of its own"), (8, long), (None, long), (None, "alone"), (9, long + " x"), (9, long + " x"), (2, "a b"), (2, "a b"), (2, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.text) for r in S.keep_one(df).collect()), key=str)
    assert got == sorted([rows[0], rows[1], (None, long), (None, "alone"), (2, "a b"), (2, None)], key=str)
    classes = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert classes.count((7, 7)) == 2 and classes.count((8, 7)) == 1 and classes.count((None, 7)) == 1 and classes.count((None, None)) == 1 and len(classes) == len(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    df = spark.createDataFrame([(5, "x")][:n], "doc_id long, text string")
    assert [r.component_id for r in S.near_duplicates(df).collect()] == [5][:n]


def test_chain_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(100, 112)] + [(7, 3)], "a long, b long")
    got = {r.node: r.component for r in S.components(edges).collect()}
    assert got == {**{i: 100 for i in range(101, 113)}, 7: 3}
