"""Text quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted over one feature after the other, round after round;
as each tree reads one feature, a feature's trees add up to one lookup table
over its bins. Pairs of features with the most gain left then get tables of
their own, boosted the same way. A score is a sum of table entries, looked up
for whole batches, through a sigmoid.

The model is fitted on at most SAMPLE labelled documents of each class, those
with the lowest hash of their id; scoring reads every whole text.

Defined results: null and empty texts have all-zero features and a score;
repeated rows are scored each; without labels of both classes the score is the
share of label 1 (0 without labels); extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .linear import sigmoid

SAMPLE = 15_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE, RIDGE, LEAST = 0.12, 2.0, 8.0
THRESHOLD = 0.7
FEATURES = (
    "log_words", "word_length", "upper", "digits", "marks", "odd_marks", "pipes", "distinct", "repeats", "same_lines",
    "line_words", "top_word", "short_words", "ends", "marked_words", "entropy", "non_ascii", "title_words", "long_words", "pair_repeats",
)

_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_MARK = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])
_PLAIN = np.array([chr(i) in ".,'\"-;:?()" for i in range(256)])
_PUNCT = b".,!?;:%$&*#|\"'()[]{}<>+=/@^~-_"


def measure(text: str | None) -> list[float]:
    """The features of one whole text."""
    raw = text.encode("utf-8", "replace") if text else b""
    toks = raw.split()
    n = len(toks)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    size, letters = len(raw), max(1.0, count[_LETTER].sum())
    low = raw.lower().split()
    freq = Counter(low)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marked = sum(1 for t in toks if len(t) > 2 and t[-1] < 128 and t[-2] < 128 and not t[-1:].isalnum() and not t[-2:-1].isalnum())
    p = count[count > 0] / size
    return [
        float(np.log1p(n)),
        sum(map(len, toks)) / n,
        count[_UPPER].sum() / letters,
        count[_DIGIT].sum() / size,
        count[_MARK].sum() / size,
        count[_MARK & ~_PLAIN].sum() / size,
        count[124] / n,
        len(freq) / n,
        sum(a == b for a, b in zip(low, low[1:])) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        max(freq.values()) / n,
        sum(len(t) <= 3 for t in toks) / n,
        (count[46] + count[33] + count[63]) / n,
        marked / n,
        float(-(p * np.log2(p)).sum()),
        count[128:].sum() / size,
        sum(t[:1].isupper() for t in toks) / n,
        sum(len(t) > 20 for t in toks) / n,
        1 - len(set(zip(low, low[1:]))) / max(1, n - 1),
    ]


@dataclass
class Model:
    """Bin edges and tables of the features and of the pairs."""

    intercept: float
    edges: list[np.ndarray]
    tables: np.ndarray
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f])]
        low = {f: np.searchsorted(self.coarse[f], x[:, f]) for pair in self.pairs for f in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[low[a], low[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Steps of a tree with few leaves over the bins of one feature."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    for _ in range(leaves - 1):
        best = (1e-9, 0, 0)
        for i, (a, b) in enumerate(parts):
            k = np.arange(a + 1, b)
            if not len(k):
                continue
            lg, lh = cg[k] - cg[a], ch[k] - ch[a]
            rg, rh = cg[b] - cg[k], ch[b] - ch[k]
            gain = np.where((lh > LEAST / 4) & (rh > LEAST / 4), _gain(lg, lh) + _gain(rg, rh) - _gain(cg[b] - cg[a], ch[b] - ch[a]), 0)
            j = int(gain.argmax())
            best = max(best, (float(gain[j]), i, int(k[j])))
        if not best[2]:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = RATE * (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of both axes into four leaves, and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, found = 0.0, None
    whole = _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    quarters = []
    for c in (cg, ch):
        ll = c[i, j]
        quarters.append((ll, c[i, -1] - ll, c[-1, j] - ll, c[-1, -1] - c[i, -1] - c[-1, j] + ll))
    gain = sum(_gain(a, b) for a, b in zip(*quarters, strict=True)) - whole
    k = np.unravel_index(int(gain.argmax()), gain.shape)
    best, found = float(gain[k]), (int(i[k]), int(j[k]))
    out = np.zeros_like(g)
    for rows in (slice(0, found[0]), slice(found[0], None)):
        for cols in (slice(0, found[1]), slice(found[1], None)):
            out[rows, cols] = RATE * g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return out, best


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Model:
    n, d = x.shape
    cut = lambda f, k: np.unique(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1]))
    edges, coarse = [cut(f, BINS) for f in range(d)], [cut(f, PAIR_BINS) for f in range(d)]
    fine = [np.searchsorted(edges[f], x[:, f]) for f in range(d)]
    low = [np.searchsorted(coarse[f], x[:, f]) for f in range(d)]
    share = float((weight * y).sum() / weight.sum())
    intercept = float(np.log(share / (1 - share)))
    tables, at = np.zeros((d, BINS + 1)), np.full(n, intercept)
    for _ in range(rounds):
        for f in range(d):
            p = sigmoid(at)
            g = np.bincount(fine[f], weight * (y - p), BINS + 1)
            h = np.bincount(fine[f], weight * p * (1 - p), BINS + 1)
            step = _tree(g, h)
            tables[f] += step
            at += step[fine[f]]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell = sigmoid(at), low[a] * PAIR_BINS + low[b]
        return tuple(np.bincount(cell, weight * v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (y - p, p * (1 - p)))

    chosen = sorted(combinations(range(d), 2), key=lambda ab: -_pair_tree(*sums(*ab))[1])[:pairs]
    pair_tables = np.zeros((len(chosen), PAIR_BINS, PAIR_BINS))
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(chosen):
            step, _ = _pair_tree(*sums(a, b))
            pair_tables[k] += step
            at += step[low[a], low[b]]
    for k, (a, b) in enumerate(chosen):  # tables are centred, the intercept takes the rest
        mean = float(np.average(pair_tables[k][low[a], low[b]], weights=weight))
        pair_tables[k] -= mean
        intercept += mean
    return Model(intercept, edges, tables, coarse, chosen, pair_tables)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, fit_where: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | float:
    """A model, or the share of label 1 where only one class is labelled."""
    rows = labels.where(fit_where & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    n = {int(r.y): r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return float(1 in n)
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * sample rows
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id").select("text", "y").mapInArrow(_measured, "y double, x array<double>").toArrow()
    if not got.num_rows:
        return n[1] / (n[0] + n[1])
    x, y = np.array(got["x"].to_pylist()), np.asarray(got["y"])
    if len(set(y.tolist())) < 2:
        return n[1] / (n[0] + n[1])
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums should not depend on it
    x, y = x[order], y[order]
    weight = np.where(y == 1, n[1] / min(n[1], sample), n[0] / min(n[0], sample))
    return fit(x, y, weight / weight.mean())


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = np.array([measure(t.as_py()) for t in b.column(1)]).reshape(-1, len(FEATURES))
            s = np.full(len(x), m) if isinstance(m, float) else m.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with held_out and predicted; labels of held-out rows are never read."""
    model = train(docs, labels, crc_mod("doc_id", 4) != 2)
    return score(docs, model).withColumn("held_out", crc_mod("doc_id", 4) == 2).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
