"""SimHash near-duplicate classes with pigeonring candidate filtering.

Fingerprints lie on a ring of segments. If two differ at tau bits or fewer,
some start on the ring has, for every length l, at most l*tau/segments
differing bits in its first l segments (the pigeonring principle). Each such
chain forces certain sets of segments to agree exactly; those sets are the
equi-join keys. Pairs that meet under a key must then show a viable chain of
ring.chain segments, shorter than the ring, and what is left is held against
the full Hamming distance (candidate_counts reports how many pairs each step
leaves).

near_duplicates links at TAU bits over SHINGLE words. keep_one, a pipeline
stage, takes five words and a similarity of 0.8: its fingerprints have 128
bits, of which the first 64 give the candidates (WIDE.tau bits or fewer) and
all are compared; WIDE_TAU differing bits are what a Jaccard similarity of 0.8
gives on average (bits differ with probability acos(2J / (1 + J)) / pi).

A key's fingerprints are linked in one task while that is cheap: neighbours in
a few sorted orders first, then all that this leaves apart against all. A key
for which that is too much is divided by further bits, in every way in which a
pair within tau bits agrees, so that no link is lost; under a key that leaves
LAST bits open there are 2 ** LAST fingerprints at most.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows without an id are classed too, but give their class no id (a class
without any has a null one), and keep_one leaves them as they are; repeated rows
and ids keep one output row each, of keep_one only one per class; rows that
share an id but not a class count apart; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, checkpointed, words

TAU = 4
SHINGLE = 4
SEED = 42
WIDE_SHINGLE = 5
WIDE_TAU = 20
#: Rows (of 16 bytes) of a list of rows to drop up to which it is broadcast; beyond, documents are shuffled to it.
LISTED = 1_000_000
#: Open bits of a key at which it is no longer divided.
LAST = 16
_SHINGLES_AT_ONCE = 1 << 16
#: Edges that a task of links holds before it makes a forest of them.
_EDGES = 1 << 18


def fingerprint(text: str | None, n: int = SHINGLE, wide: bool = False) -> tuple[int, int]:
    """Majority bits of the shingles' XXH64, and of 64 more hash bits if wide (else 0); 0 without words."""
    import xxhash

    tokens = words(text)
    if not tokens:
        return 0, 0
    h, size, seed = (xxhash.xxh3_128_digest, 128, 0) if wide else (xxhash.xxh64_intdigest, 64, SEED)
    flat = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = [0, *ends[:-n].tolist()] if len(tokens) > n else [0]
    stops = (ends[n - 1 :] - 1).tolist() if len(tokens) > n else [len(flat)]
    total = len(starts)
    ones = np.zeros(size, np.int64)
    for at in range(0, total, _SHINGLES_AT_ONCE):
        part = [h(flat[a:b], seed) for a, b in zip(starts[at : at + _SHINGLES_AT_ONCE], stops[at : at + _SHINGLES_AT_ONCE], strict=True)]
        raw = np.frombuffer(b"".join(part), np.uint8) if wide else np.array(part, "<u8").view(np.uint8)
        ones += np.unpackbits(raw.reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    got = np.packbits(ones * 2 > total, bitorder="little").view("<u8")
    return int(got[0]), int(got[1]) if wide else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, wide: bool = False) -> DataFrame:
    """(doc_id, text_hash, fp, more): the fingerprint as signed 64-bit numbers; more is 0 unless wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for b in batches:
            got = np.array([fingerprint(t.as_py(), n, wide) for t in b.column(2)], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(got[:, i]).view(np.int64)) for i in (0, 1))], ["doc_id", "text_hash", "fp", "more"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, more long")


@dataclass(frozen=True)
class Ring:
    """64 bits in segments; pairs differ at tau bits or fewer, and wide_tau or fewer of all bits.

    small: rows of a key up to which its pairs are compared together with those of other keys; run: a
    key with more comparisons left than its square is divided; most: rows of a key that a task holds at all.
    """

    segments: int
    tau: int
    chain: int
    wide_tau: int | None = None
    size: int = 3
    small: int = 64
    run: int = 2048
    most: int = 1 << 18

    @cached_property
    def budgets(self) -> list[int]:
        """Most differing bits that a chain's first 1, 2, ... segments may have."""
        return [length * self.tau // self.segments for length in range(1, self.segments + 1)]

    @cached_property
    def layout(self) -> list[tuple[int, int]]:
        """(lowest bit, width) of each segment."""
        cut = [64 * k // self.segments for k in range(self.segments + 1)]
        return [(a, b - a) for a, b in zip(cut, cut[1:])]

    @cached_property
    def masks(self) -> np.ndarray:
        return np.array([((1 << w) - 1) << a for a, w in self.layout], np.uint64)

    @cached_property
    def keys(self) -> list[tuple[int, ...]]:
        """Sets of `size` segments of which one agrees exactly in any viable chain."""
        sets = set()
        for length in range(1, self.segments + 1):
            viable = [
                d
                for k in range(length + 1)
                for d in combinations(range(length), k)
                if all(sum(x < n for x in d) <= self.budgets[n - 1] for n in range(1, length + 1))
            ]
            if all(length - len(d) >= self.size for d in viable):
                for d in viable:
                    agree = [x for x in range(length) if x not in d]
                    for start in range(self.segments):
                        sets.add(tuple(sorted((x + start) % self.segments for x in agree[: self.size])))
                return sorted(sets)
        raise ValueError("no chain forces that many segments to agree")

    @cached_property
    def first(self) -> np.ndarray:
        """For each set of agreeing segments, the first key that finds a pair; so a pair is linked once."""
        bits = [sum(1 << x for x in k) for k in self.keys]
        return np.array([next((i for i, k in enumerate(bits) if s & k == k), len(bits)) for s in range(1 << self.segments)], np.int64)

    def agreeing(self, xor: np.ndarray) -> np.ndarray:
        """Bits for the segments that agree."""
        out = np.zeros(xor.shape, np.int64)
        for k, m in enumerate(self.masks):
            out |= ((xor & m) == 0).astype(np.int64) << k
        return out

    def viable_chain(self, xor: np.ndarray) -> np.ndarray:
        """True where some start on the ring keeps every cumulative budget of its first `chain` segments."""
        flat = xor.reshape(-1)
        agree, found = self.agreeing(flat), np.zeros(flat.shape, bool)
        for start in range(self.segments):
            at = np.flatnonzero((agree >> start & 1 == 1) & ~found)  # the first budget is none
            total = np.zeros(len(at), np.uint8)
            for n in range(1, self.chain):
                total += np.bitwise_count(flat[at] & self.masks[(start + n) % self.segments])
                held = total <= self.budgets[n]
                at, total = at[held], total[held]
            found[at] = True
        return found.reshape(xor.shape)

    def near(self, xor: np.ndarray, more: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Where differences of both halves have a viable chain and then are few enough; counts: met, viable and linked pairs so far."""
        ok = self.viable_chain(xor)
        viable = xor[ok]
        n = np.bitwise_count(viable)
        close = n <= self.tau
        if self.wide_tau is not None:
            close &= n + np.bitwise_count(more[ok]) <= self.wide_tau
        if counts is not None:
            counts += [xor.size, len(viable), int(close.sum())]
        ok[ok] = close
        return ok

    def parts(self, used: int) -> list[int]:
        """The bits that are not in `used` in tau + 2 parts; two fingerprints within tau bits agree in two of them."""
        rest = [x for x in range(64) if not used >> x & 1]
        n = self.tau + 2
        return [sum(1 << x for x in rest[len(rest) * p // n : len(rest) * (p + 1) // n]) for p in range(n)]


NARROW = Ring(7, TAU, 4)
WIDE = Ring(11, 8, 7, WIDE_TAU)


def _node(fp: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One number for both halves: the first half itself where the second is 0."""
    return (fp ^ (more << np.uint64(29) | more >> np.uint64(35))).view(np.int64)


def _node_column() -> Column:
    """The same in SQL."""
    return F.col("fp").bitwiseXOR(F.shiftleft("more", 29).bitwiseOR(F.shiftrightunsigned("more", 35)))


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items reaches over the edges."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        for x in (u, v):
            np.minimum.at(label, label[x], low)
        label = label[label]
        if (label == before).all() and (label[u] == label[v]).all():
            break
    return label


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one that it reaches over the edges (a, b): fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _labels(len(nodes), at[: len(a)], at[len(a) :])
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _cluster(ring: Ring, f: np.ndarray, m: np.ndarray, counts: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Edges (indices) that connect what is near among the fingerprints of one key, and whether that is all."""
    n = len(f)
    us, vs = [], []
    for turn in (0, 21, 42):
        order = np.argsort(f << np.uint64(turn) | f >> np.uint64(64 - turn) if turn else f, kind="stable")
        for off in (1, 2, 3):
            i, j = order[:-off], order[off:]
            ok = ring.near(f[i] ^ f[j], m[i] ^ m[j], counts)
            us.append(i[ok])
            vs.append(j[ok])
    label = _labels(n, np.concatenate(us), np.concatenate(vs))
    apart = np.flatnonzero(label != np.arange(n))
    us, vs = [apart], [label[apart]]
    found, size = np.unique(label, return_counts=True)
    rest = np.flatnonzero(label != found[size.argmax()])
    if not last and len(rest) * n > ring.run**2:
        return us[0], vs[0], False
    step = max(1, (1 << 18) // n)
    for at in range(0, len(rest), step):
        own = rest[at : at + step]
        i, j = np.nonzero(ring.near(f[own][:, None] ^ f, m[own][:, None] ^ m, counts))
        pair = np.unique(own[i] * n + label[j])  # one edge to each group that it touches
        us.append(pair // n)
        vs.append(pair % n)
    return np.concatenate(us), np.concatenate(vs), True


def _runs(batches: Iterator[pa.RecordBatch], most: int, numbered: bool) -> Iterator[tuple]:
    """Whole runs of equal keys as (keys, fps, mores) arrays; one of over `most` rows that can be divided as (key, None, None)."""
    held: list[tuple[np.ndarray, ...]] = []
    count, over = 0, None
    for b in batches:
        k, f, m = (np.asarray(b.column(i)) for i in range(3))
        if over is not None:
            to = int(np.searchsorted(k, over, "right"))
            k, f, m = k[to:], f[to:], m[to:]
            if not len(k):
                continue
            over = None
        if held and k[0] == k[-1] == held[-1][0][0]:  # the run goes on
            held.append((k, f, m))
            count += len(k)
        else:
            if held:
                k, f, m = (np.concatenate([*(h[i] for h in held), x]) for i, x in enumerate((k, f, m)))
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1], "left"))
            if cut:
                yield k[:cut], f[:cut], m[:cut]
            held, count = [(k[cut:], f[cut:], m[cut:])], len(k) - cut
        if count > most and (numbered or not held[-1][0][0] & 1):
            over, held = int(k[-1]), []
            yield over, None, None
    if held:
        yield tuple(np.concatenate([h[i] for h in held]) for i in range(3))


def _link(ring: Ring, numbered: bool) -> Callable:
    """Edges (a, b) between nodes, (key, null) for a key that must be divided, and (null, null) with counts of pairs met, viable and linked; numbered: keys are the ring's own. The edges are a forest of what the task links, or of _EDGES at a time: not every pair of a group, under every key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        counts = np.zeros(3, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none, none, none], _LINKS_NAMES)

        for k, f, m in _runs(batches, ring.most, numbered):
            if f is None:
                yield out(np.array([k]), None)
                continue
            f, m = f.view(np.uint64), m.view(np.uint64)
            node = _node(f, m)
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[start, len(k)])
            small = size <= ring.small
            us, vs, full = [], [], []
            left = np.repeat(np.where(small, start + size, 0), size) - np.arange(len(k))  # rows to the end of a small run
            for off in range(1, int(size[small].max(initial=0))):
                i = np.flatnonzero(left > off)
                xor = f[i] ^ f[i + off]
                ok = ring.near(xor, m[i] ^ m[i + off], counts)
                if numbered:  # a pair is linked under its first key only
                    ok[ok] = ring.first[ring.agreeing(xor[ok])] == k[i[ok]] >> 48
                us.append(i[ok])
                vs.append(i[ok] + off)
            for at, n in zip(start[~small].tolist(), size[~small].tolist()):
                u, v, done = _cluster(ring, f[at : at + n], m[at : at + n], counts, not numbered and bool(k[at] & 1))
                us.append(u + at)
                vs.append(v + at)
                if not done:
                    full.append(int(k[at]))
            if full:
                yield out(np.array(full, np.int64), None)
            if us and sum(map(len, us)):
                held.append((node[np.concatenate(us)], node[np.concatenate(vs)]))
                if sum(len(a) for a, _ in held) > _EDGES:
                    held = [_forest(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > _EDGES // 2:
                        yield out(*held.pop())
        if held:
            a, b = _forest(*map(np.concatenate, zip(*held, strict=True)))
            if len(a):
                yield out(a, b)
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, *(pa.array([int(c)]) for c in counts)], _LINKS_NAMES)

    return run


_LINKS = "a long, b long, met long, viable long, linked long"
_LINKS_NAMES = [c.split()[0] for c in _LINKS.split(", ")]


def _keyed(ring: Ring) -> Callable:
    """(key, fp, more) of each (fp, more) row for each of the ring's keys: a key's number above bit 48, its segments below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = np.asarray(b.column(0)).view(np.uint64)
            parts = [((u & m) >> np.uint64(a)).astype(np.int64) for m, (a, _) in zip(ring.masks, ring.layout, strict=True)]
            for i, key in enumerate(ring.keys):
                col, shift = np.full(len(u), i << 48, np.int64), 0
                for s in key:
                    col |= parts[s] << shift
                    shift += ring.layout[s][1]
                yield pa.RecordBatch.from_arrays([pa.array(col), b.column(0), b.column(1)], ["key", "fp", "more"])

    return run


def _divided(ring: Ring, numbered: bool) -> Callable:
    """Each (fp, more, used) row of an overfull key under two of tau + 2 parts of the bits that the key leaves open; keys with few open bits left are odd. used: the bits of the key, or the number of one of the ring's own."""
    whole = np.array([int(ring.masks[list(key)].sum()) for key in ring.keys], np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, m, used = (np.asarray(b.column(i)) for i in range(3))
            used = whole[used] if numbered else used
            u = f.view(np.uint64)
            for mask in np.unique(used):
                at = np.flatnonzero(used == mask)
                held = int(mask) & (1 << 64) - 1
                for one, two in combinations(ring.parts(held), 2):
                    new = held | one | two
                    key = ((u[at] & np.uint64(new)) ^ np.uint64(new * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
                    key = (key ^ key >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
                    key = key & ~np.uint64(1) | np.uint64(64 - new.bit_count() <= LAST)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(f[at]), pa.array(m[at]), pa.array(np.full(len(at), np.uint64(new)).view(np.int64))], ["key", "fp", "more", "used"])

    return run


def _met(distinct: DataFrame, ring: Ring) -> Iterator[DataFrame]:
    """What tasks find under the ring's keys, and then under those that overfull ones are divided to."""
    keyed = distinct.select("fp", "more").mapInArrow(_keyed(ring), "key long, fp long, more long")
    numbered = True
    while True:
        rows = keyed.select("key", "fp", "more").repartition("key").sortWithinPartitions("key")
        found = checkpointed(rows.mapInArrow(_link(ring, numbered), _LINKS))
        yield found
        full = found.where("a is not null and b is null").select(F.col("a").alias("key")).distinct()
        if full.isEmpty():
            return
        used = F.shiftright("key", 48) if numbered else F.col("used")
        over = keyed.join(full, "key", "left_semi").select("fp", "more", used.alias("used"))
        keyed = checkpointed(over.mapInArrow(_divided(ring, numbered), "key long, fp long, more long, used long"))
        numbered = False


def links(distinct: DataFrame, ring: Ring = NARROW) -> DataFrame:
    """Edges (a, b), a > b, that connect (fp, more) rows that the ring calls near, by node(fp, more): at most one a node from each task (of _EDGES edges)."""
    found = list(_met(distinct, ring))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.where("b is not null").select("a", "b").distinct()


def candidate_counts(distinct: DataFrame, ring: Ring = NARROW) -> DataFrame:
    """(met, viable, linked): pairs compared, pairs that the chain filter leaves to the Hamming check, and pairs that pass it."""
    found = list(_met(distinct, ring))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "viable", "linked")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges reaches; large and small stars in turn."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    count = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).distinct()
        small = checkpointed(small)
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 30) - 1))), F.count_distinct("a")).first()
        if now == count or now[0] == now[2] and small.join(small.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges, count = small, now


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, ring: Ring) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp, more) of each row, and (fp, more, class) of each distinct fingerprint."""
    rows = checkpointed(fingerprints(docs, id_col, text_col, n, ring.wide_tau is not None))
    distinct = checkpointed(rows.select("fp", "more").distinct())
    found = components(links(distinct, ring))
    of = distinct.withColumn("node", _node_column()).join(found, "node", "left")
    return rows, of.select("fp", "more", F.coalesce("component", "node").alias("class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, ring: Ring = NARROW) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row; the component is its smallest reachable id."""
    rows, of = _classes(docs, id_col, text_col, n, ring)
    least = rows.groupBy("fp", "more").agg(F.min("doc_id").alias("least")).join(of, ["fp", "more"])
    low = least.groupBy("class").agg(F.min("least").alias("component_id"))
    return rows.join(least.select("fp", "more", "class").join(low, "class"), ["fp", "more"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WIDE_SHINGLE, ring: Ring = WIDE) -> DataFrame:
    """One row of each class, in the same columns: that with the smallest id, of several the one with the smallest hash of its text; rows without an id stay as they are."""
    rows, of = _classes(docs, id_col, text_col, n, ring)
    # rows of one text and one id are told apart by nothing: counted
    own = rows.where("doc_id is not null").groupBy("fp", "more", "doc_id", "text_hash").agg(F.count("*").alias("n")).join(of, ["fp", "more"])
    own = checkpointed(own.select("class", F.struct("doc_id", "text_hash").alias("row"), "n"))
    first = own.groupBy("class").agg(F.min("row").alias("first"))
    judged = own.join(first, "class").select("row.doc_id", "row.text_hash", "n", (F.col("row") == F.col("first")).alias("stays"))
    ids, text = F.col(id_col).cast("long"), F.xxhash64(text_col)

    def that(listed: DataFrame, how: str) -> DataFrame:
        listed = checkpointed(listed.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")))
        if listed.count() <= LISTED:
            listed = F.broadcast(listed)
        return docs.join(listed, (ids == F.col("_doc")) & (text == F.col("_hash")), how)

    kept = that(judged.where("not stays or n > 1"), "left_anti")
    repeated = judged.where("stays and n > 1")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(that(repeated, "left_semi").dropDuplicates([id_col, text_col]))
