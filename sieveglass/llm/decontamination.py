"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A seed is an n-gram of a test item whose words make it rare: its expected number
of chance occurrences in a document, from word frequencies over the whole corpus,
is at most RARE. (The n-gram's own frequency would not do: a leaked passage that
is copied often is just what has to be found.) An item without rare seeds keeps
its FEWEST rarest. Every occurrence of a seed joins a passage to its item; the
item is then aligned with the text around the occurrences, so that changed,
dropped and added words cost a little and do not end the match.

The benchmark is handled in blocks of BLOCK_WORDS words at most; a block's words,
seeds and items are broadcast, one block at a time, and each block is one pass
over the corpus for word frequencies and one for matches.

A match needs half the score of a perfect one, or of a perfect run of PART words:
a leaked part of a long item is a leak. Items of over LONGEST words are aligned
in parts that overlap by half, so that an alignment's table stays small; the best
part counts. Items of fewer than N words, which any text may hold by chance,
match texts whose whole sequence of words they are.

Defined results: null and empty texts and items match nothing; repeated rows
match each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, checkpointed

N = 3
RARE = 1e-4
FEWEST = 5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score as a share of a perfect one (the item's, or a run of PART words).
THRESHOLD = 0.5
PART = 50
LONGEST = 1024
BLOCK_WORDS = 1_000_000
SCHEMA = "doc_id long, item_id long, score double, matched int, start int, end int, item_start int, item_end int"
_SPACES = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates."""
    return text.lower().encode("utf-8", "replace").translate(_SPACES).split() if text else []


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """Best local alignment: (score, matches, doc start, doc end, item start, item end), ends exclusive."""
    n, m = len(item), len(doc)
    h = np.zeros((n + 1, m + 1), np.int32)
    ramp = np.arange(m + 1, dtype=np.int32) * -GAP
    for i in range(1, n + 1):
        row = np.maximum(h[i - 1, :-1] + np.where(doc == item[i - 1], MATCH, MISMATCH), h[i - 1, 1:] + GAP)
        row = np.r_[0, np.maximum(row, 0)]
        h[i] = np.maximum.accumulate(row + ramp) - ramp  # gaps along the document
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, end, item_end, matches = int(h[i, j]), int(j), int(i), 0
    while h[i, j] > 0:
        same = i and j and doc[j - 1] == item[i - 1]
        if i and j and h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matches += bool(same)
            i, j = i - 1, j - 1
        elif i and h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matches, int(j), end, int(i), item_end


@dataclass
class Block:
    """Items of one block, long ones in parts: their words' numbers, and where each seed occurs."""

    numbers: dict[bytes, int]
    ids: list[int]
    shifts: list[int]
    items: list[np.ndarray]
    short: dict[tuple[bytes, ...], list[int]]
    seeds: np.ndarray
    first: np.ndarray
    places: np.ndarray


def _keys(words: np.ndarray, base: int) -> np.ndarray:
    """Keys of the n-grams; -1 where a word isn't the benchmark's."""
    if len(words) < N:
        return np.zeros(0, np.int64)
    key = np.zeros(len(words) - N + 1, np.int64)
    ok = np.ones(len(key), bool)
    for k in range(N):
        part = words[k : len(words) - N + 1 + k]
        key = key * base + part
        ok &= part >= 0
    return np.where(ok, key, -1)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with any words, a bounded number of words at a time; a larger item is a block of its own."""
    part, n = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        toks = tokens(r.t)
        if not toks:
            continue
        if part and n + len(toks) > size:
            yield part
            part, n = [], 0
        part.append((r.i, toks))
        n += len(toks)
    if part:
        yield part


def word_counts(docs: DataFrame, numbers: dict[bytes, int], text_col: str = "text") -> tuple[np.ndarray, int, int]:
    """Occurrences of each numbered word, all words, and documents, over the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        own = shared.value
        counts, words, rows = np.zeros(len(own) + 1, np.int64), 0, 0
        for b in batches:
            rows += b.num_rows
            for t in b.column(0):
                toks = tokens(t.as_py())
                words += len(toks)
                counts += np.bincount(np.fromiter(map(own.get, toks, [-1] * len(toks)), np.int64, len(toks)) + 1, minlength=len(counts))
        at = np.flatnonzero(counts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[counts[1:][at], words, rows])], ["word", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out, total = np.zeros(len(numbers), np.int64), {-1: 0, -2: 0}
    for w, n in zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True):
        if w < 0:
            total[w] = n
        else:
            out[w] = n
    return out, total[-1], total[-2]


def prepare(part: list[tuple[int, list[bytes]]], docs: DataFrame, text_col: str = "text") -> Block:
    """Choose each item's seeds by the corpus's word frequencies."""
    numbers: dict[bytes, int] = {}
    short: dict[tuple[bytes, ...], list[int]] = {}
    ids, shifts, items = [], [], []
    for i, toks in part:
        if len(toks) < N:
            short.setdefault(tuple(toks), []).append(i)
            continue
        whole = np.array([numbers.setdefault(w, len(numbers)) for w in toks], np.int64)
        for at in range(0, max(1, len(whole) - LONGEST // 2), LONGEST // 2):
            ids.append(i), shifts.append(at), items.append(whole[at : at + LONGEST])
    counts, words, rows = word_counts(docs, numbers, text_col)
    log_p = np.log((counts + 0.5) / (words + 1))
    length = np.log(max(words / max(rows, 1), 1))
    found: list[tuple[int, int, int]] = []
    for k, item in enumerate(items):
        expected = length + np.convolve(log_p[item], np.ones(N), "valid")
        rare = expected <= np.log(RARE)
        if rare.sum() < FEWEST:
            rare[np.argsort(expected, kind="stable")[:FEWEST]] = True
        key = _keys(item, len(numbers))
        found += [(int(key[p]), k, int(p)) for p in np.flatnonzero(rare)]
    found.sort()
    keys = np.array([f[0] for f in found], np.int64)
    seeds, first = np.unique(keys, return_index=True)
    return Block(numbers, ids, shifts, items, short, seeds, np.r_[first, len(keys)], np.array([f[1:] for f in found], np.int64).reshape(-1, 2))


def matches(toks: list[bytes], block: Block, threshold: float = THRESHOLD) -> list[tuple]:
    """(item, score, matched, start, end, item start, item end) of each passage that holds an item."""
    n = len(toks)
    if n < N:
        return [(i, 1.0, n, 0, n, 0, n) for i in block.short.get(tuple(toks), [])] if n else []
    if not len(block.seeds):
        return []
    words = np.fromiter(map(block.numbers.get, toks, [-1] * n), np.int64, n)
    key = _keys(words, len(block.numbers))
    at = np.flatnonzero(key >= 0)
    if not len(at):
        return []
    where = np.minimum(np.searchsorted(block.seeds, key[at]), len(block.seeds) - 1)
    hit = block.seeds[where] == key[at]
    spans: dict[int, list[tuple[int, int]]] = {}
    for pos, s in zip(at[hit].tolist(), where[hit].tolist(), strict=True):
        for item, place in block.places[block.first[s] : block.first[s + 1]].tolist():
            size = len(block.items[item])
            slack = 8 + size // 4
            spans.setdefault(item, []).append((max(0, pos - place - slack), min(n, pos - place + size + slack)))
    out: dict[int, tuple] = {}
    for item, found in spans.items():
        found.sort()
        merged = [list(found[0])]
        for a, b in found[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        target = block.items[item]
        least = threshold * MATCH * min(len(target), PART)
        best = None
        for a, b in merged:
            for start in range(a, b, 4096):  # long runs of seeds in overlapping parts, so that the table stays small
                stop = min(b, start + 4096 + 2 * len(target))
                score, same, i, j, x, y = align(words[start:stop], target)
                if score >= least and (best is None or score > best[0]):
                    best = (score, same, start + i, start + j, x, y)
                if stop == b:
                    break
        if best:
            score, same, i, j, x, y = best
            name, shift = block.ids[item], block.shifts[item]
            row = (name, score / (MATCH * min(len(target), PART)), same, i, j, x + shift, y + shift)
            if name not in out or row[1] > out[name][1]:
                out[name] = row
    return [*out.values()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that aligns: the best passage, in words, and its score."""
    spark = docs.sparkSession
    done, last = [spark.createDataFrame([], SCHEMA)], None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for part in blocks(benchmark, item_col, item_text):
        if last:  # one block in memory at a time
            done.append(checkpointed(last[0]))
            last[1].destroy()
        shared = spark.sparkContext.broadcast(prepare(part, rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            begin()
            block = shared.value
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            types = [pa.int64(), pa.int64(), pa.float64(), *[pa.int32()] * 5]
            for b in batches:
                rows = [(doc, *m) for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in matches(tokens(t.as_py()), block, threshold)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        last = rows.mapInArrow(run, SCHEMA), shared
    if last:
        done.append(last[0])
    return reduce(DataFrame.unionByName, done)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that hold no item, in the same columns."""
    spark, at, kept, shared = docs.sparkSession, docs.columns.index(text_col), docs, None
    for part in blocks(benchmark, item_col, item_text):
        if shared:  # one block in memory at a time
            kept = checkpointed(kept)
            shared.destroy()
        shared = spark.sparkContext.broadcast(prepare(part, docs, text_col))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            begin()
            block = shared.value
            for b in batches:
                yield b.filter(pa.array([not matches(tokens(t.as_py()), block, threshold) for t in b.column(at)], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
