"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(unit | class, context) * P(word | unit).
The first two factors are log-linear models of the same features: the last word,
the word before, the pair of both and the third word back (skips). For the first
each is hashed to one of ROWS weight rows of CLASSES columns. For the second the
units of a class are the leaves of a Huffman tree; each of its decisions is a
log-linear model of two outcomes, and each feature at each node is hashed to one
of NODE_ROWS weights (tabulated: a context's bits against a subtree's; its nodes' weights lie side by side). A frequent word is a unit of its own; the others share one
by their endings, of which the third factor is their share, from exact counts
over all training documents, with a slot for a word never seen. Classes group
words by their neighbours.

Training: one pass counts words; one more reads the texts for the last time and
writes all documents as arrays of units, with the words outside the head beside
them. The next ones read the units of the training documents. One gathers the words' neighbours, which group
them to classes; one gathers the observed feature counts, which give the first
weights in closed form; then each of STEPS updates sums the gradient of all training documents,
observed less expected counts. The observed ones stay the same, so they are
counted once. The decisions are trained alike. A task's sums are dense blocks of a fixed size, added up in a tree
of tasks; a task's rows are those of one partition of the input, or of four.

Memory: the HEAD most frequent words at most are broadcast; the counts of all
other words are joined by shuffle. Scoring reads the units in numpy batches.

Defined results: null and empty texts are one end token; repeated rows are
scored each; without training documents all words are unknown; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, words

END = b"\n"
HEAD = 1 << 18
UNITS = 1 << 15
SUFFIXES = 1 << 12
CLASSES = 32
ROWS = 1 << 15
STEPS = 2
RATE = 0.5
FIRST = 0.45
SMOOTH = 4.0
#: Largest weight: products of four factors then stay within single precision.
LARGEST = 18.0
ANCHORS = 128
ALPHA = 0.1
_FEATURES = 4
_AT_ONCE = 1 << 16
_FLUSH = 250_000
#: Numbers in a block of sums, and tasks whose blocks one task adds up.
_BLOCK, _FAN = 1 << 17, 16
#: Weights of the decisions within classes; a context's weights at _LEVELS levels of a subtree are neighbours in memory.
NODE_ROWS = 1 << 21
_LEVELS = 3
#: Places in a subtree that a path meets, for each of the four nodes it may reach on the third level (the last one is none of its). Half the contexts have them turned over, so that all places are about as full.
_PATHS = np.array([[0, 1, 3, 7], [0, 1, 4, 7], [0, 2, 5, 7], [0, 2, 6, 7]])
#: Log odds where a path has no decision: side 1 is never expected there, nor taken.
_NONE = -200.0
#: Tokens whose classes' shares are made at once, what they take stays in a core's cache; tokens whose decisions are.
_SHARES_AT_ONCE, _NODES_AT_ONCE = 1 << 11, 1 << 16
#: Tokens, about, whose sums are single precision before they are added to those in double.
_SINGLE = 1 << 18
#: Tokens of which equal pairs of feature and unit are counted first.
_COUNTED_AT_ONCE = 1 << 21


def unit_of(word: bytes, index: int) -> int:
    """Frequent words are units of their own; the others share a unit with those of the same ending."""
    return index if 0 <= index < UNITS else UNITS + (zlib.crc32(word[-3:]) & (SUFFIXES - 1))


@dataclass
class Vocabulary:
    number: dict[bytes, int]
    count: np.ndarray
    unit: np.ndarray
    tokens: int
    distinct: int

    def units(self, toks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index in the head or -1, unit) of each token."""
        at = np.fromiter(map(self.number.get, toks, [-1] * len(toks)), np.int64, len(toks))
        unit = self.unit[at]
        rest = np.flatnonzero(at < 0)
        crc = zlib.crc32
        unit[rest] = UNITS + (np.fromiter([crc(toks[i][-3:]) for i in rest.tolist()], np.int64, len(rest)) & (SUFFIXES - 1))
        return at, unit


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

    for b in batches:
        for t in b.column(0):
            seen.update(words(t.as_py()))
            seen[END] += 1
            if len(seen) > _FLUSH:
                yield out()
                seen.clear()
    if seen:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all words and the end token."""
    return texts.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The frequent words, at most `head`, and the counts of the others."""
    kinds = sorted(((r.c, r.n) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = (kinds[0][0] + 1 if kinds else 1), 0
    for c, n in kinds:
        if held + n > head:
            break
        least, held = c, held + n
    got = counts.where(F.col("c") >= least).toArrow()
    pairs = sorted(zip(got["word"].to_pylist(), got["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    number = {w: i for i, (w, _) in enumerate(pairs)}
    unit = np.array([unit_of(w, i) for i, (w, _) in enumerate(pairs)] + [0], np.int64)
    v = Vocabulary(number, np.array([c for _, c in pairs], np.int64), unit, sum(c * n for c, n in kinds), sum(n for _, n in kinds))
    return v, counts.where(F.col("c") < least)


#: Starts before each text in arrays of units.
_START = UNITS + SUFFIXES
#: A row is a chunk of whole texts: arrays of their units, lengths, ids, whether to learn from them, known tokens and log10 counts; words outside the head, parted by a space, with the text and how often.
_CHUNK = "key long, units binary, size binary, doc binary, named binary, learns binary, known binary, base binary, word binary, owner binary, tf binary"


def encoded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Rows of _CHUNK of (text) rows; also of their doc_id and of learns, where they have them. A text's key is its chunk's and its place in it."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)
    names = [c.split()[0] for c in _CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        log_count = np.r_[np.log10(v.count + ALPHA), 0.0]
        key = TaskContext.get().partitionId() << 40
        for b in batches:
            first, size, toks = 0, [], []
            for i, t in enumerate(b.column(0)):
                own = words(t.as_py())
                own.append(END)
                size.append(len(own))
                toks += own
                if len(toks) < _AT_ONCE and i < b.num_rows - 1:
                    continue
                at, unit = v.units(toks)
                n = np.array(size, np.int64)
                place = np.arange(len(toks)) + 3 * np.repeat(np.arange(1, len(n) + 1), n)
                padded = np.full(len(toks) + 3 * len(n), _START, np.uint16)
                padded[place] = unit
                start = np.r_[0, np.cumsum(n)[:-1]]
                ids, learns = (b.column(k).slice(first, len(n)) for k in (1, 2))
                parts = [padded, n.astype(np.int32), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), learns.to_numpy(zero_copy_only=False).astype(bool)]
                parts += [np.add.reduceat((at >= 0).astype(np.int32), start).astype(np.int32), np.add.reduceat(log_count[at], start)]
                rest = np.flatnonzero(at < 0)
                tf = Counter(zip((np.searchsorted(start, rest, "right") - 1).tolist(), map(toks.__getitem__, rest.tolist())))
                rare = [b" ".join([w for _, w in tf]), np.array([o for o, _ in tf], np.int32).tobytes(), np.array(list(tf.values()), np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array([x], pa.binary()) for x in [*(p.tobytes() for p in parts), *rare])], names)
                key += len(n)
                first, size, toks = i + 1, [], []

    have = rows.columns
    doc = F.col("doc_id").cast("long") if "doc_id" in have else F.lit(None).cast("long")
    learns = F.coalesce(F.col("learns"), F.lit(False)) if "learns" in have else F.lit(True)
    return checkpointed(rows.select("text", doc.alias("doc_id"), learns.alias("learns")).mapInArrow(run, _CHUNK))


def training(chunks: DataFrame) -> DataFrame:
    """(units, size, learns) of the chunks."""
    return chunks.select("units", "size", "learns")


def _places(padded: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the chosen texts' tokens, a long text's a part at a time."""
    place = np.flatnonzero(padded != _START)
    if not chosen.all():
        place = place[np.repeat(chosen, size)]
    for at in range(0, len(place), _AT_ONCE):
        yield place[at : at + _AT_ONCE]


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(units with starts, places of the tokens to learn from) of what training() gives."""
    for b in batches:
        for units, size, learns in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            padded = np.frombuffer(units, np.uint16).astype(np.int64)
            for place in _places(padded, np.frombuffer(size, np.int32), np.frombuffer(learns, bool)):
                yield padded, place


def _some(arrays: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The arrays in runs of about _SINGLE tokens; each is to be read before the next."""

    def run(at: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield at
        n = len(at[1])
        while n < _SINGLE and (more := next(arrays, None)):
            n += len(more[1])
            yield more

    while first := next(arrays, None):
        yield run(first)


def _fewer(rows: DataFrame, by: int) -> DataFrame:
    """Tasks of `by` partitions each, for sums of a fixed size that are cheap to gather; a task's share of the rows stays the same at any size."""
    return rows.coalesce(max(1, -(-rows.rdd.getNumPartitions() // by)))


def _values(padded: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The features of each token's context, as numbers."""
    one, two, three = padded[place - 1], padded[place - 2], padded[place - 3]
    return [one, two, one << 20 | two, three]


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    h = (x.astype(np.uint64) * np.uint64(4) + np.uint64(salt) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def _top(h: np.ndarray, rows: int) -> np.ndarray:
    """The highest bits of hashes, as many as number `rows`."""
    return (h >> np.uint64(64 - int(rows).bit_length() + 1)).astype(np.int64)


def features(padded: np.ndarray, place: np.ndarray, rows: int | None = None) -> list[np.ndarray]:
    """Weight rows of each token's context."""
    return [_top(_hashed(x, k), rows or ROWS) for k, x in enumerate(_values(padded, place))]


@dataclass
class Tree:
    """How the units of a class are told apart: unit u's decisions are node[at[u]:at[u + 1]], side 1 or 0 at each."""

    at: np.ndarray
    node: np.ndarray
    side: np.ndarray
    odds: np.ndarray  # of side 1 by mass, natural log, a decision each
    row: np.ndarray  # a decision's weight is in this row, with the bits of the context's hash turned over; of its place in the subtree all or none
    rank: np.ndarray  # units by falling number of decisions
    mass: np.ndarray  # counts of the unit's words and the smoothing
    weights: np.ndarray
    # unit u's paths through subtrees are path_at[u]:path_at[u + 1], up to _LEVELS decisions each
    path_at: np.ndarray
    path_row: np.ndarray  # eight to a subtree, four for either half of the contexts
    path_odds: np.ndarray  # by level
    path_sign: np.ndarray  # 1 for side 1, else -1

    def _walk(self, at: np.ndarray, row: np.ndarray, unit: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(numbers of units that have so many steps, their steps, rows by context) for each number; unit u's are at[u]:at[u + 1]."""
        for a in range(0, len(unit), _NODES_AT_ONCE):
            some = unit[a : a + _NODES_AT_ONCE]
            order = np.argsort(self.rank[some], kind="stable")  # longest first, equal ones side by side
            some = some[order]
            first, own = at[some], [c[a : a + _NODES_AT_ONCE][order] for c in contexts]
            have = len(some) - np.cumsum(np.bincount(at[some + 1] - first))
            for level, m in enumerate(have[:-1].tolist()):
                step = first[:m] + level
                bits = row[step]
                yield a + order[:m], step, [c[:m] ^ bits for c in own]

    def levels(self, unit: np.ndarray, contexts: list[np.ndarray], by_side: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(numbers of units that have so many decisions, their decisions, weight rows by context) of each level; by_side: rows of side 1 stand NODE_ROWS higher."""
        row = self.row | self.side * np.int64(NODE_ROWS) if by_side else self.row
        return self._walk(self.at, row, unit, [c >> _LEVELS << _LEVELS | (c & 1) * ((1 << _LEVELS) - 1) for c in contexts])

    def paths(self, padded: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(numbers of tokens in place, their paths, rows by feature, log odds of side 1 by level) of all paths through subtrees, some at a time: what decisions() gives a decision at a time."""
        quads = self._quads()
        for owner, step, rows in self._walk(self.path_at, self.path_row, padded[place], [c >> _LEVELS << _LEVELS | (c & 1) << 2 for c in features(padded, place, NODE_ROWS)]):
            z = np.take(self.path_odds, step, axis=0, mode="clip")
            for r in rows:
                z += np.take(quads, r, mode="clip").view(np.float32).reshape(-1, 4)
            yield owner, step, rows, z

    def _quads(self) -> np.ndarray:
        """The weights of each path in a subtree as one 16-byte number."""
        if getattr(self, "_held", (None,))[0] is not self.weights:
            self._held = self.weights, self.weights.reshape(-1, 1 << _LEVELS)[:, [_PATHS, 7 - _PATHS]].reshape(-1).view(np.complex128)
        return self._held[1]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_held"}

    def decisions(self, padded: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(numbers of tokens in place, their decisions, weight rows by feature, log odds of side 1) of all decisions, some at a time."""
        for owner, step, rows in self.levels(padded[place], features(padded, place, NODE_ROWS)):
            z = self.odds[step]
            for r in rows:
                z += np.take(self.weights, r, mode="clip")
            yield owner, step, rows, z

    def log(self, padded: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's unit, given its class and context."""
        out = np.zeros(len(place))
        for owner, step, _, z in self.paths(padded, place):
            z *= np.take(self.path_sign, step, axis=0, mode="clip")
            out[owner] += (np.minimum(z, 0) - np.log(1 + np.exp(-np.abs(z)))) @ np.ones(4, np.float32)
        return out


def tree(klass: np.ndarray, mass: np.ndarray) -> Tree:
    """Huffman trees of the units that have a mass, one for each class; no weights yet."""
    n, odds = len(mass), []
    up, side = np.full(2 * n, -1, np.int64), np.zeros(2 * n, bool)
    for k in range(CLASSES):
        own = np.flatnonzero((klass[:n] == k) & (mass > 0))
        heap = list(zip(mass[own].tolist(), own.tolist(), strict=True))
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            up[[left, right]], side[right] = n + len(odds), True
            heapq.heappush(heap, (a + b, n + len(odds)))
            odds.append(np.log(b / a))
    unit = at = np.arange(n)
    found = [(unit[:0], unit[:0], side[:0])]
    while len(at):
        unit, at = unit[up[at] >= 0], at[up[at] >= 0]
        found.append((unit, up[at] - n, side[at]))
        at = up[at]
    units, nodes, sides = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(units, kind="stable")
    start = np.r_[0, np.cumsum(np.bincount(units, minlength=n + 1))]
    # a decision is known by the top of its subtree of _LEVELS levels and its place there
    parent, depth = up[n : n + len(odds)] - n, np.zeros(len(odds), np.int64)
    top, place = np.arange(len(odds)), np.zeros(len(odds), np.int64)
    for x in reversed(range(len(odds))):  # parents come after their children
        if (y := parent[x]) >= 0:
            depth[x] = depth[y] + 1
            if depth[x] % _LEVELS:
                top[x], place[x] = top[y], 2 * place[y] + 1 + side[n + x]
    row = _top(_hashed(top, _FEATURES), NODE_ROWS >> _LEVELS) << _LEVELS | place
    nodes, rank = nodes[order], np.empty(n, np.uint16)
    rank[np.argsort(-np.diff(start)[:n], kind="stable")] = np.arange(n)
    odds, sides = np.array(odds, np.float32)[nodes], sides[order]
    # a unit's decisions come from below: a path's last one is its subtree's top
    at_place = place[nodes]
    last = at_place == 0
    path, level = np.cumsum(last) - last, np.searchsorted([1, 3], at_place, "right")
    path_odds, path_sign = np.full((int(last.sum()), 4), _NONE, np.float32), np.full((int(last.sum()), 4), -1, np.float32)
    path_odds[path, level], path_sign[path, level] = odds, np.where(sides, 1, -1)
    first = np.r_[True, last[:-1]][: len(last)]
    reached = np.array([0, 0, 2, 0, 1, 2, 3])[at_place[first]]
    return Tree(start, nodes.astype(np.int32), sides, odds, row[nodes], rank, mass, np.zeros(NODE_ROWS, np.float32), np.r_[0, np.cumsum(last)][start], row[nodes][first] >> _LEVELS << _LEVELS | reached, path_odds, path_sign)


@dataclass
class Model:
    vocab: Vocabulary
    klass: np.ndarray
    bias: np.ndarray
    mass: np.ndarray
    weights: np.ndarray
    tree: Tree | None = None

    def __post_init__(self):
        # e to the sum of four weights is a product of table entries
        self._factor, self._base = np.exp(self.weights), np.exp(self.bias)

    def _products(self, feats: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
        """The classes' shares before they are divided by their sum, some tokens at a time; the array is used again."""
        held, more = np.empty((2, min(len(feats[0]), _SHARES_AT_ONCE), CLASSES), np.float32)
        for a in range(0, len(feats[0]), _SHARES_AT_ONCE):
            part = slice(a, min(a + _SHARES_AT_ONCE, len(feats[0])))
            z = np.take(self._factor, feats[0][part], axis=0, out=held[: part.stop - a], mode="clip")
            for f in feats[1:]:
                z *= np.take(self._factor, f[part], axis=0, out=more[: len(z)], mode="clip")
            z *= self._base
            yield part, z

    def shares(self, feats: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
        """Probabilities of the classes, some tokens at a time; the array is used again."""
        for part, z in self._products(feats):
            z /= (z @ np.ones(CLASSES, np.float32))[:, None]
            yield part, z

    def class_share(self, feats: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the classes."""
        return np.concatenate([p.copy() for _, p in self.shares(feats)])

    def class_log(self, feats: list[np.ndarray], klass: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's class."""
        out = np.empty(len(klass), np.float32)
        for part, z in self._products(feats):
            out[part] = np.log(z[np.arange(len(z)), klass[part]]) - np.log(z @ np.ones(CLASSES, np.float32))
        return out


def _blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums in blocks, those that hold anything."""
    part = TaskContext.get().partitionId()
    for i, x in enumerate(total.astype(np.float32).reshape(-1, _BLOCK)):
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([i], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["part", "block", "data"])


_SUMS = "part long, block long, data binary"


def _add_up(blocks: DataFrame, tasks: int, size: int) -> np.ndarray:
    """Sum of the (part, block, data) arrays, by trees of _FAN."""

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in t["data"]], axis=0)
        return pa.table({"part": t["part"][:1], "block": t["block"][:1], "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    while tasks > 1:
        blocks = blocks.withColumn("part", F.floor(F.col("part") / _FAN).cast("long")).groupBy("part", "block").applyInArrow(add, _SUMS)
        tasks = -(-tasks // _FAN)
    out = np.zeros((size // _BLOCK, _BLOCK), np.float32)
    for r in blocks.select("block", "data").toArrow().to_pylist():
        out[r["block"]] += np.frombuffer(r["data"], np.float32)
    return out.reshape(-1)


def _gather(units: DataFrame, model: Model, expected: bool) -> np.ndarray:
    """Feature counts by class over all texts: what the model expects, or else the observed ones."""
    shared = units.sparkSession.sparkContext.broadcast((model.klass, model.bias, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        klass, bias, weights = shared.value
        m = Model(None, klass, bias, None, weights)
        if expected:
            # two classes are one complex number, so that one addition serves both
            total, sums, held = np.zeros((CLASSES // 2, ROWS, 2)), np.zeros((CLASSES // 2, ROWS), np.complex64), np.empty((CLASSES // 2, _AT_ONCE), np.complex64)
            for places in _some(_arrays(batches)):
                for padded, place in places:
                    feats = features(padded, place)
                    for part, p in m.shares(feats):
                        held[:, part] = p.view(np.complex64).T
                    for k in range(CLASSES // 2):
                        for f in feats:
                            np.add.at(sums[k], f, held[k, : len(f)])
                total += sums.view(np.float32).reshape(total.shape)
                sums[:] = 0
            total = total.transpose(0, 2, 1).reshape(CLASSES, ROWS)
        else:
            total = np.zeros((CLASSES, ROWS))
            for padded, place in _arrays(batches):
                own = m.klass[padded[place]] * ROWS
                for f in features(padded, place):
                    np.add.at(total.reshape(-1), own + f, 1.0)
        yield from _blocks(np.ascontiguousarray(total.T))

    rows = units if expected else _fewer(units, 4)
    return _add_up(rows.mapInArrow(run, _SUMS), rows.rdd.getNumPartitions(), ROWS * CLASSES).reshape(ROWS, CLASSES)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(unit, hash of a feature before it, how often) of the tokens to learn from, once for each different pair of some of them."""

    def counted(held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for salt, kind in enumerate((np.uint32, np.uint32, np.uint64, np.uint32)):
            key, n = np.unique(np.concatenate([x[salt].astype(kind) << kind(16) | x[-1].astype(kind) for x in held]), return_counts=True)
            for a in range(0, len(key), 8 * _AT_ONCE):
                some = key[a : a + 8 * _AT_ONCE].astype(np.int64)
                value = some >> 16
                yield some & 0xFFFF, _hashed((value >> 16) << 20 | value & 0xFFFF if salt == 2 else value, salt), n[a : a + 8 * _AT_ONCE].astype(np.float64)

    held, size = [], 0
    for padded, place in _arrays(batches):
        own = [padded[place - k].astype(np.uint16) for k in (1, 2, 3, 0)]
        held.append([own[0], own[1], own[0].astype(np.uint32) << np.uint32(16) | own[1], *own[2:]])
        size += len(place)
        if size >= _COUNTED_AT_ONCE:
            yield from counted(held)
            held, size = [], 0
    if held:
        yield from counted(held)


def _gather_decisions(units: DataFrame, tree: Tree, observed: bool) -> np.ndarray:
    """By weight, over the decisions of all texts: how often side 1 is expected; or else, of a tree without weights, that, how many there are and how often side 1 is taken."""
    shared = units.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        total = np.zeros((3 if observed else 1, NODE_ROWS))
        if observed:  # without weights a decision's odds are the same in all contexts
            # how often and what is expected are one complex number
            one, sums, since = (1 + 1j / (1 + np.exp(-t.odds))).astype(np.complex64), np.zeros((2, NODE_ROWS), np.complex64), 0

            def settle() -> None:
                for side, x in enumerate(sums):
                    np.add(total[0], x.imag, out=total[0])
                    np.add(total[1], x.real, out=total[1])
                    if side:
                        np.add(total[2], x.real, out=total[2])
                sums[:] = 0

            for unit, h, n in _pairs(batches):
                times = n.astype(np.float32)
                for owner, step, (r,) in t.levels(unit, [_top(h, NODE_ROWS)], True):
                    np.add.at(sums.reshape(-1), r, one[step] * times[owner])
                since += n.sum()
                if since >= _COUNTED_AT_ONCE:
                    settle()
                    since = 0
            settle()
        else:
            # the upper two levels of a path are one complex number
            upper, lowest = np.zeros(NODE_ROWS >> 1, np.complex64), np.zeros(NODE_ROWS, np.float32)
            own = total.reshape(-1, 1 << _LEVELS)
            with np.errstate(over="ignore"):  # where a path has no decision
                for places in _some(_arrays(batches)):
                    for padded, place in places:
                        for _, step, rows, z in t.paths(padded, place):
                            p = np.reciprocal(1 + np.exp(-z))
                            deep = np.flatnonzero(t.path_odds[step, 2] != _NONE)
                            third = p[deep, 2]
                            for r in rows:
                                np.add.at(upper, r >> 1, p.view(np.complex64)[:, 0])
                                np.add.at(lowest, r[deep], third)
                    for turned, to in enumerate((own, own[:, ::-1])):
                        by = upper.reshape(-1, 2, 2)[:, turned]
                        to[:, 0] += by.real.sum(axis=1)
                        to[:, 1:3] += by.imag
                        to[:, 3:7] += lowest.reshape(-1, 2, 4)[:, turned]
                    upper[:], lowest[:] = 0, 0
        yield from _blocks(total)

    rows = _fewer(units, 4)
    got = _add_up(rows.mapInArrow(run, _SUMS), rows.rdd.getNumPartitions(), (3 if observed else 1) * NODE_ROWS)
    shared.destroy()
    return got.reshape(-1, NODE_ROWS)


def _train_decisions(units: DataFrame, tree: Tree) -> None:
    """First weights in closed form, then STEPS updates, as for the classes."""
    base, n, ones = _gather_decisions(units, tree, True)
    q = (base + 0.5) / (n + 1)
    ratio = lambda o, e, s: np.log((o + s) / (e + s))
    weights = FIRST * (ratio(ones, base, SMOOTH * q) - ratio(n - ones, np.maximum(n - base, 0), SMOOTH * (1 - q)))
    for _ in range(STEPS):
        tree.weights = np.clip(weights, -LARGEST, LARGEST).astype(np.float32)
        expected = np.minimum(_gather_decisions(units, tree, False)[0], n)
        room = np.minimum(np.maximum(ones, expected), np.maximum(n - ones, n - expected))
        weights = tree.weights + RATE * (ones - expected - 0.05 * tree.weights) / (room + SMOOTH)
    tree.weights = np.clip(weights, -LARGEST, LARGEST).astype(np.float32)


def neighbours(units: DataFrame) -> DataFrame:
    """(cell, n): how often each unit stands within two places of each anchor; at most (UNITS + SUFFIXES) * ANCHORS cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((UNITS + SUFFIXES + 1) * ANCHORS, np.int64)
        for padded, place in _arrays(batches):
            own = padded[place] * ANCHORS
            for step in (1, 2, -1, -2):
                near = padded[np.clip(place - step, 0, len(padded) - 1)]
                ok = near < ANCHORS
                np.add.at(total, own[ok] + near[ok], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return _fewer(units, 4).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def classes(units: DataFrame, seed: int = 7) -> np.ndarray:
    """Class of each unit: k-means of the words' neighbours among the ANCHORS most frequent ones."""
    got = neighbours(units).select(F.col("cell").cast("int"), F.col("n").cast("float")).toArrow()
    x = np.zeros((UNITS + SUFFIXES + 1) * ANCHORS, np.float32)
    x[np.asarray(got["cell"])] = np.asarray(got["n"])
    x = x.reshape(-1, ANCHORS)
    size = x.sum(axis=1)
    mean = x.sum(axis=0) / max(float(size.sum()), 1.0)
    x = np.sqrt((x + 8 * mean) / (size + 8)[:, None])  # few neighbours: near the mean
    rng = np.random.default_rng(seed)
    heavy = np.argsort(-size, kind="stable")[:4096]
    centre = x[rng.choice(heavy, CLASSES, replace=False, p=(size[heavy] + 1) / (size[heavy] + 1).sum())]
    w = np.sqrt(size + 0.1)
    for _ in range(15):
        klass = (x @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
        for k in range(CLASSES):
            if (klass == k).any():
                centre[k] = np.average(x[klass == k], axis=0, weights=w[klass == k])
    return klass.astype(np.int64)


def train(texts: DataFrame, head: int = HEAD) -> tuple[Model, DataFrame, DataFrame]:
    """The model, (word, c) of the words outside its head, and what encoded() gives of all texts; texts: (text), with learns where not all are learnt from."""
    learnt = texts.where("learns") if "learns" in texts.columns else texts
    counts = checkpointed(word_counts(learnt.select("text")))
    vocab, tail = vocabulary(counts, head)
    chunks = encoded(texts, vocab)
    units = training(chunks)
    klass = classes(units)
    mass = np.bincount(klass[vocab.unit[:-1]], vocab.count + ALPHA, CLASSES) + ALPHA
    of_unit = np.bincount(vocab.unit[:-1], vocab.count + ALPHA, UNITS + SUFFIXES).astype(float)
    of_unit[UNITS:] += ALPHA  # a word never seen
    # the same ending as in unit_of
    ending = F.crc32(F.substring("word", -3, 3)).bitwiseAND(F.lit(SUFFIXES - 1))
    for r in tail.groupBy(ending.alias("s")).agg(F.sum(F.col("c") + ALPHA).alias("m")).collect():
        mass[klass[UNITS + r.s]] += r.m
        of_unit[UNITS + r.s] += r.m
    bias = np.log(mass / mass.sum()).astype(np.float32)
    weights = np.zeros((ROWS, CLASSES), np.float32)
    decisions = tree(klass, of_unit)
    if vocab.tokens:
        _train_decisions(units, decisions)
        observed = _gather(units, Model(vocab, klass, bias, mass, weights), False)
        share = np.exp(bias)
        weights = FIRST * np.log((observed + SMOOTH * share) / ((observed.sum(axis=1, keepdims=True) + SMOOTH) * share))
        for _ in range(STEPS):
            model = Model(vocab, klass, bias, mass, np.clip(weights, -LARGEST, LARGEST).astype(np.float32))
            expected = _gather(units, model, True)
            weights = model.weights + RATE * (observed - expected - 0.05 * model.weights) / (np.maximum(observed, expected) + SMOOTH)
    return Model(vocab, klass, bias, mass, np.clip(weights, -LARGEST, LARGEST).astype(np.float32), decisions), tail, chunks


_PART = "key long, doc_id long, n long, known long, s double, gain double"


def scores(chunks: DataFrame, model: Model, tail: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of encoded texts, one row each."""
    shared = chunks.sparkSession.sparkContext.broadcast((model.klass, model.bias, model.weights, model.tree))
    names = [c.split()[0] for c in _PART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        klass, bias, weights, tree = shared.value
        m = Model(None, klass, bias, None, weights)
        log_mass = np.log10(np.maximum(tree.mass, ALPHA))
        for b in batches:
            for key, units, *rest in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                padded = np.frombuffer(units, np.uint16).astype(np.int64)
                size, doc, named, known, base = (np.frombuffer(x, t) for x, t in zip(rest, (np.int32, np.int64, bool, np.int32, np.float64), strict=True))
                gain = []
                for place in _places(padded, size, np.ones(len(size), bool)):
                    own = padded[place]
                    gain.append((m.class_log(features(padded, place), klass[own]).astype(np.float64) + tree.log(padded, place)) / np.log(10) - log_mass[own])
                start = np.r_[0, np.cumsum(size)[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(len(size))), pa.array(doc, mask=~named), pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(np.add.reduceat(np.concatenate(gain), start))], names
                )

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, word, *rest in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                owner, tf = (np.frombuffer(x, np.int32).astype(np.int64) for x in rest)
                if len(tf):
                    yield pa.RecordBatch.from_arrays([pa.array(key + owner), pa.array(word.split(b" "), pa.binary()), pa.array(tf)], ["key", "word", "tf"])

    ours = checkpointed(chunks.select("key", "units", "size", "doc", "named", "known", "base").mapInArrow(run, _PART))
    rare = chunks.select("key", "word", "owner", "tf").mapInArrow(unknown, "key long, word binary, tf long").join(tail, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.select("key", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n"), F.when(c > 0, F.col("tf")).otherwise(0).alias("known"), (F.col("tf") * F.log10(c + F.lit(ALPHA))).alias("s"), F.lit(None).cast("double").alias("gain"))
    got = ours.unionByName(rare).groupBy("key").agg(*(f(x).alias(x) for f, x in ((F.max, "doc_id"), (F.max, "n"), (F.sum, "known"), (F.sum, "s"), (F.max, "gain"))))
    v = model.vocab
    whole = float(np.log10(v.tokens + ALPHA * (v.distinct + 1)))
    return got.select("doc_id", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("s") - F.col("n") * whole).alias("base_score"), (F.col("s") + F.col("gain")).alias("score"))


def fit_and_score(docs: DataFrame, train_where: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Learn from the rows of train_where and score all."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model, tail, chunks = train(rows.withColumn("learns", train_where), head)
    return scores(chunks, model, tail)


def judged(docs: DataFrame) -> DataFrame:
    """Scores with held_out: the rows that nothing is learned from."""
    return fit_and_score(docs, crc_mod("doc_id", 10) != 0).withColumn("held_out", crc_mod("doc_id", 10) == 0)
