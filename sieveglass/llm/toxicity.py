"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated model of word pairs, words and word prefixes;
what a class has not seen backs off to counts shared by both classes (numbers
of distinct left neighbours). Prefixes of 8 and 6 characters divide the words
into nested groups, a shorter word being a group of its own: a class's word
backs off to its group's share times the shared share of the word in the group.
Each group and the whole keep a slot for words never seen, so that the
probabilities after any word sum to one over the words and the slots.

A text is compared by its log-likelihoods under both classes, normalised by
length: over the whole text, over its worst window and over its most telling
words. A logistic link, fitted on documents that gave no counts, makes a
probability of these; its intercept is then moved so that THRESHOLD is the cut
that separates those documents best (see operating_point).

Counts are of documents, so that one repetitive text weighs once. The model is
fitted on at most SAMPLE labelled documents of each class, those with the
lowest hash of their id, and keeps every count of theirs: 10 or 12 bytes a distinct
word pair, 72 a distinct word, under 64-bit hashes. Scoring reads every whole
text, a bounded number of tokens of short texts or one text at a time.

Defined results: null and empty texts score as texts without evidence; repeated
rows are scored each; without labels of both classes the score is the share of
toxic labels (0 without labels); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, crc_mod, hashes
from .linear import logistic, sigmoid

SAMPLE = 10_000
PREFIXES = (8, 6)
#: Discount of every count where the counts of counts don't give one.
DISCOUNT = 0.75
WINDOW = 8
THRESHOLD = 0.7
#: Least share of ordinary documents that the cut must leave alone.
SPECIFICITY = 0.95
#: ASCII that separates words here: all but letters and digits.
_SPACES = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
_AT_ONCE = 1 << 17
_START = b""


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SPACES).split() if text else []


def group(word: bytes, k: int) -> bytes:
    """The word's group: its first k characters, or itself with an end mark if it isn't longer."""
    if len(word) > k and len(s := word.decode("utf-8")) > k:
        return s[:k].encode()
    return word + b"\0"


def group_keys(words: Iterator[bytes] | list[bytes], k: int) -> np.ndarray:
    """64-bit keys of the words' groups; odd ones are of cut words, which others may share."""
    found = [group(w, k) for w in words]
    cut = np.fromiter((not g.endswith(b"\0") for g in found), np.uint64, len(found))
    return hashes(found) & ~np.uint64(1) | cut


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left ^ left >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + right
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


_WORDS = "kind int, key long, a long, b long, t long, o long"
_PAIRS = "a long, b long, t long, o long"


def _batch(schema: str, columns: list[np.ndarray], y: int) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(n, y)), pa.array(np.full(n, 1 - y))], [c.split()[0] for c in schema.split(", ")])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each gram once a document: (0, word, its 8-group, its 6-group), (8, group, its 6-group), (6, group)."""
    begin()
    for b in batches:
        for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            own = list(dict.fromkeys(tokens(text.as_py())))
            if not own:
                continue
            eight, six = group_keys(own, PREFIXES[0]), group_keys(own, PREFIXES[1])
            of8, at8 = np.unique(eight, return_index=True)
            of6 = np.unique(six)
            none8, none6 = np.zeros(len(of8), np.uint64), np.zeros(len(of6), np.uint64)
            parts = [(0, hashes(own), eight, six), (PREFIXES[0], of8, six[at8], none8), (PREFIXES[1], of6, none6, none6)]
            kind = np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in parts])
            yield _batch(_WORDS, [kind, *(np.concatenate([x[i] for x in parts]).view(np.int64) for i in (1, 2, 3))], y)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right) keys of the word pairs, each once a document; the first word follows the start."""
    begin()
    for b in batches:
        for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            toks = tokens(text.as_py())
            if toks:
                number: dict[bytes, int] = {}
                own = np.fromiter((number.setdefault(w, len(number)) for w in toks), np.int64, len(toks))
                names = np.r_[hashes(number), hashes([_START])].view(np.int64)
                pair = np.unique(np.r_[len(number), own[:-1]] << 32 | own)
                yield _batch(_PAIRS, [names[pair >> 32], names[pair & 0xFFFFFFFF]], y)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Model:
    """Sorted 64-bit keys and, by class (rows: ordinary, toxic), what the models know of them."""

    words: np.ndarray  # keys of the words and of the start
    word_p: np.ndarray  # P(word)
    sure: np.ndarray  # cautious log ratio of the word's probabilities
    one: float  # share of one document among ordinary word counts
    total: np.ndarray  # tokens after the word
    held: np.ndarray  # what discounting leaves after the word
    by: np.ndarray  # discounts of the pairs
    pairs: np.ndarray
    pair_n: np.ndarray
    groups: tuple[np.ndarray, np.ndarray]  # keys of the 8- and 6-groups
    unseen: tuple[np.ndarray, np.ndarray, np.ndarray]  # P(unseen word) in a known 8-group, in a known 6-group, in none
    link: tuple | None
    share: float

    def __getstate__(self) -> dict:
        """The pairs as compressed steps, so that a broadcast takes about half."""
        steps = np.diff(self.pairs, prepend=np.uint64(0))
        planes = [zlib.compress((steps >> np.uint64(8 * k)).astype(np.uint8), 1) for k in range(8)]
        packed = planes, zlib.compress(np.ascontiguousarray(self.pair_n), 1), self.pair_n.dtype.str
        return {k: v for k, v in self.__dict__.items() if not k.startswith("pair")} | {"packed": packed}

    def __setstate__(self, state: dict) -> None:
        planes, counts, kind = state.pop("packed")
        self.__dict__.update(state)
        steps = np.uint64(0)
        for k, plane in enumerate(planes):
            steps = steps | np.frombuffer(zlib.decompress(plane), np.uint8).astype(np.uint64) << np.uint64(8 * k)
        self.pairs = np.cumsum(steps, dtype=np.uint64)
        self.pair_n = np.frombuffer(zlib.decompress(counts), kind).reshape(2, -1)

    @classmethod
    def empty(cls, share: float) -> Model:
        none, two = np.zeros(0, np.uint64), np.zeros((2, 0))
        return cls(none, two, np.zeros(0), 0.0, two, two, np.zeros((2, 4)), none, np.zeros((2, 0), np.uint16), (none, none), (two, two, np.full((2, 1), 0.5)), None, share)

    def unigrams(self, own: list[bytes], keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(word) by class of distinct words."""
        p = np.empty((2, len(own)))
        p[:, at >= 0] = self.word_p[:, at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        p[:, rest] = self.unseen[2]
        for k, table, q in reversed([*zip(PREFIXES, self.groups, self.unseen[:2], strict=True)]):
            if len(rest):
                up = _find(table, group_keys([own[i] for i in rest.tolist()], k))
                p[:, rest[up >= 0]] = q[:, up[up >= 0]]
        return p

    def likelihoods(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities by class (a column for each token of all texts), the tokens' numbers among the distinct words, and these words' cautious log ratios."""
        flat = [w for t in texts for w in t]
        own = list(dict.fromkeys(flat))
        number = {w: i for i, w in enumerate(own)}
        tok = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        keys = hashes(own)
        at = _find(self.words, keys)
        p = self.unigrams(own, keys, at)
        start = np.cumsum([0, *map(len, texts)])[:-1][[len(t) > 0 for t in texts]]
        left = np.r_[0, tok[:-1]] if len(tok) else tok
        left_at, left_key = at[left], keys[left]
        first = hashes([_START])
        left_at[start], left_key[start] = _find(self.words, first), first
        out = p[:, tok]
        known = np.flatnonzero(left_at >= 0)
        pair = _find(self.pairs, _pair_keys(left_key[known], keys[tok[known]]))
        n = np.where(pair >= 0, self.pair_n[:, pair], 0) if len(self.pairs) else np.zeros((2, len(known)))
        total = self.total[:, left_at[known]]
        seen = _less(n, self.by) / np.maximum(total, 1)
        out[:, known] = seen + self.held[:, left_at[known]] * out[:, known]
        sure = np.log(p[1]) - np.log(p[0] + self.one)
        sure[at >= 0] = self.sure[at[at >= 0]]
        return np.log(out), tok, sure

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        """A row for each text: mean log-likelihoods (toxic, ordinary); their difference overall, in the worst window, and of the most telling words."""
        out = np.zeros((len(texts), 6))
        ll, tok, sure = self.likelihoods(texts)
        base = np.log(self.unseen[2])
        ratio = ll[1] - ll[0] - float(base[1, 0] - base[0, 0])
        a = 0
        for row, t in zip(out, texts, strict=True):
            z = a + len(t)
            if t:
                r = ratio[a:z]
                run = np.r_[0.0, np.cumsum(r)]
                k = min(WINDOW, len(t))
                top = np.maximum(np.sort(sure[np.unique(tok[a:z])])[-3:], 0)
                row[:] = ll[1, a:z].mean(), ll[0, a:z].mean(), r.mean(), (run[k:] - run[:-k]).max() / WINDOW, top[-1], top.sum()
            a = z
        return out

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """Features of a column of texts, a bounded number of tokens or one text at a time."""
        out, held, n = [], [], 0
        for t in texts:
            held.append(tokens(t.as_py()))
            n += len(held[-1])
            if n >= _AT_ONCE:
                out.append(self.features(held))
                held, n = [], 0
        return np.concatenate([*out, self.features(held)])

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.link is None:
            return np.full(len(features), self.share)
        mean, scale, beta = self.link
        return sigmoid(np.c_[(features[:, 2:] - mean) / scale, np.ones(len(features))] @ beta)


def _arrays(t: pa.Table, *keys: str) -> list[np.ndarray]:
    """Key columns as uint64, sorted by the first, then the counts (rows: ordinary, toxic)."""
    columns = [np.asarray(t[k], np.int64).view(np.uint64) for k in keys]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns] + [np.stack([np.asarray(t["o"], np.float64), np.asarray(t["t"], np.float64)])[:, order]]


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more by the numbers n of grams counted 1, 2, 3 and 4 times (modified Kneser-Ney)."""
    if not n.all():
        return np.array([0.0, DISCOUNT, DISCOUNT, DISCOUNT])
    share = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * share * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.1), k - 0.05) for k, d in enumerate(found, 1))])


def _discounts(c: np.ndarray) -> np.ndarray:
    """Discounts by class (rows)."""
    return np.stack([discounts(np.bincount(np.minimum(row, 5).astype(np.int64), minlength=6)[1:5]) for row in c])


def _less(c: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Counts less their discounts."""
    return np.stack([row - d[np.minimum(row, 3).astype(np.int64)] for row, d in zip(c, by, strict=True)])


def _shares(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Discounted shares of the counts, and what discounting leaves for the next order."""
    total, kept = c.sum(axis=1, keepdims=True), _less(c, _discounts(c))
    return kept / total, 1 - kept.sum(axis=1, keepdims=True) / total


def _summed(texts: DataFrame, grams: Callable, schema: str) -> DataFrame:
    keys = [c.split()[0] for c in schema.split(", ")][:-2]
    return texts.mapInArrow(grams, schema).groupBy(*keys).agg(F.sum("t").cast("int").alias("t"), F.sum("o").cast("int").alias("o"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of pairs as bytes: lefts, rights, ordinary and toxic counts."""
    for b in batches:
        if b.num_rows:
            data = np.concatenate([np.asarray(b.column(i)).astype(np.int64) for i in (0, 1, 3, 2)])
            yield pa.RecordBatch.from_arrays([pa.array([data.tobytes()], pa.binary())], ["data"])


def _model(texts: DataFrame) -> Model | None:
    """All counts of (text, y) rows; the pairs come to the driver a partition at a time and stay there as 10 or 12 bytes each."""
    found = _summed(texts, _words, _WORDS).toArrow()
    words, eights, sixes = (found.filter(pc.equal(found["kind"], k)) for k in (0, *PREFIXES))
    key, eight, _, c = _arrays(words, "key", "a", "b")
    if not len(key) or not c.sum(axis=1).all():
        return None
    start = hashes([_START])
    names = np.concatenate([key, start])
    place = np.argsort(names, kind="stable")
    names = names[place]
    left_kinds, total, kinds = np.zeros(len(key)), np.zeros((2, len(names))), np.zeros((2, 4, len(names)), np.int32)
    found, counts = [np.zeros(0, np.uint64)], [np.zeros((2, 0), np.uint8)]
    for r in _summed(texts, _pairs, _PAIRS).mapInArrow(_packed, "data binary").toLocalIterator():
        lefts, rights, *n = np.frombuffer(r.data, np.int64).reshape(4, -1)
        lefts, rights = lefts.view(np.uint64), rights.view(np.uint64)
        at = _find(names, lefts)
        np.add.at(left_kinds, _find(key, rights), 1)
        for y in (0, 1):
            np.add.at(total[y], at, n[y])
            np.add.at(kinds[y], (np.minimum(n[y], 3), at), 1)
        found.append(_pair_keys(lefts, rights))
        counts.append(np.stack(n).astype(np.min_scalar_type(int(max(n[0].max(), n[1].max())))))
    pair, pair_n = np.concatenate(found), np.concatenate(counts, axis=1)
    del found, counts
    of8, up, c8 = _arrays(eights, "key", "a")
    of6, c6 = _arrays(sixes, "key")
    at8, up = _find(of8, eight), _find(of6, up)

    # shared shares: distinct left neighbours and half a one for every word; half a one for unseen words of each cut group, and for all others
    size8 = np.bincount(at8, left_kinds + 0.5, len(of8)) + 0.5 * (of8 & np.uint64(1))
    size6 = np.bincount(up, size8, len(of6)) + 0.5 * (of6 & np.uint64(1))
    whole = size6.sum() + 0.5
    (own0, rest0), (own8, rest8), (own6, rest6) = _shares(c), _shares(c8), _shares(c6)
    # a class's share of a group over the shared one, from the longest groups down
    of_six = own6 / (size6 / whole) + rest6
    of_eight = own8 / (size8 / whole) + rest8 * of_six[:, up]
    p = own0 + rest0 * (left_kinds + 0.5) / whole * of_eight[:, at8]
    slot = rest0 * 0.5 / whole

    # one standard error less of toxic counts (never below the back-off), one more of ordinary ones
    one = 1 / float(c[0].sum())
    less = p[1] - np.minimum(own0[1], np.sqrt(c[1]) / c[1].sum())
    sure = np.log(less) - np.log(p[0] + (1 + np.sqrt(c[0])) * one)

    p, sure = np.c_[p, slot * rest8 * rest6][:, place], np.r_[sure, 0.0][place]
    by = _discounts(pair_n)
    held = np.where(total > 0, (by[:, :, None] * kinds).sum(axis=1) / np.maximum(total, 1), 1.0)
    order = np.argsort(pair)
    pair, pair_n = pair[order], pair_n[:, order]
    return Model(names, p, sure, one, total, held, by, pair, pair_n, (of8, of6), (slot * of_eight, slot * rest8 * of_six, slot * rest8 * rest6), None, 0.0)


def operating_point(p: np.ndarray, y: np.ndarray, weight: np.ndarray, specificity: float = SPECIFICITY) -> float:
    """The cut of a score with the largest recall + specificity among those that leave the given share of label 0 alone; midway between the scores beside it."""
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    recall = np.cumsum(weight * y) / max((weight * y).sum(), 1e-12)
    wrong = np.cumsum(weight * (1 - y)) / max((weight * (1 - y)).sum(), 1e-12)
    last = np.flatnonzero(np.r_[p[1:] < p[:-1], True] & (1 - wrong >= specificity))
    if not len(last):
        return float(p[0])
    k = last[int(np.argmax(recall[last] - wrong[last]))]
    return float((p[k] + p[min(k + 1, len(p) - 1)]) / 2)


def _scorer(shared, cal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        model = shared.value
        for b in batches:
            f = model.of_texts(b.column(1))
            arrays = [b.column(0), *(pa.array(f[:, i]) for i in range(6))]
            names = ["doc_id", "ll_toxic", "ll_ordinary", "ratio", "worst", "top", "top3"]
            if cal:
                yield pa.RecordBatch.from_arrays([*arrays, b.column(2)], [*names, "y"])
            else:
                yield pa.RecordBatch.from_arrays([*arrays[:5], pa.array(model.probability(f))], [*names[:5], "score"])

    return run


def training_sample(labels: DataFrame, label_col: str, fit_where: Column, id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, y, fold) of at most `sample` rows of each class, and the rows of each class that one stands for."""
    rows = labels.where(fit_where & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("y"))
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    both = parts[0].unionByName(parts[1]).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)))
    return both, {y: k / min(k, sample) for y, k in n.items()}


def train(docs: DataFrame, labels: DataFrame, fit_where: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Three quarters of the sample give the counts, the rest the link."""
    rows, stands = training_sample(labels, label_col, fit_where, id_col, sample)
    n = sum(stands.values())
    spark = docs.sparkSession
    chosen = F.broadcast(rows)  # at most 2 * sample rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id").select("text", "y", "fold", "doc_id").persist()
    try:
        model = _model(texts.where("fold > 0").select("text", "y")) if n else None
        if model is None:
            share = float(stands.get(1, 0) > 0 and stands.get(0, 0) == 0)
            return Model.empty(share)
        schema = "doc_id long, ll_toxic double, ll_ordinary double, ratio double, worst double, top double, top3 double, y long"
        shared = spark.sparkContext.broadcast(model)
        got = texts.where("fold = 0").select("doc_id", "text", "y").mapInArrow(_scorer(shared, True), schema).toPandas()
        shared.destroy()  # every executor holds a copy on disk
    finally:
        texts.unpersist()
    y = got["y"].to_numpy()
    weight = np.where(y == 1, stands.get(1, 1.0), stands.get(0, 1.0))
    model.share = float((weight * y).sum() / max(weight.sum(), 1))
    if len(set(y.tolist())) == 2:
        x = got[["ll_toxic", "ll_ordinary", "ratio", "worst", "top", "top3"]].to_numpy()
        model.link = mean, scale, beta = logistic(x[:, 2:], y, weight)
        cut = min(max(operating_point(model.probability(x), y, weight), 1e-6), 1 - 1e-6)
        beta[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(cut / (1 - cut))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ll_toxic, ll_ordinary, ratio, worst, score): log-likelihoods per token, and the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, ll_toxic double, ll_ordinary double, ratio double, worst double, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scorer(shared, False), schema)


def judged(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """Scores with held_out and predicted; labels of held-out rows are never read."""
    model = train(docs if train_docs is None else train_docs, labels, crc_mod("doc_id", 3) != 1)
    return score(docs, model).withColumn("held_out", crc_mod("doc_id", 3) == 1).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, in the same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        m = shared.value
        for b in batches:
            yield b.filter(pa.array(m.probability(m.of_texts(b.column(at))) < threshold))

    return docs.mapInArrow(run, docs.schema)
