import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sieveglass.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("mixture", [None, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0}])
def test_schedule_is_a_bijection_and_keeps_shares(mixture):
    totals = {"a": 5000, "b": 1234, "c": 777, "d": 1, "e": 0}
    s = P.Schedule(totals, mixture, 100)
    seen = {}
    for source, n in totals.items():
        at = 0
        while at < n:
            k = random.Random(at).randint(1, 60)
            for pos, length in s.places(source, at, min(k, n - at)):
                for x in range(pos, pos + length):
                    assert x not in seen
                    seen[x] = source
            at += k
    assert sorted(seen) == list(range(sum(totals.values())))
    if mixture and len(mixture) == 3:
        first = Counter(seen[x] for x in range(1000))
        assert first == {"a": 500, "b": 300, "c": 200}
    if mixture is None:
        for w in range(0, 7000, 100):
            assert abs(Counter(seen[x] for x in range(w, w + 100))["a"] - 5000 / 7012 * 100) < 2


def test_pieces_hold_the_documents(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    texts = [None, "", " ", "Hello,  WORLD!! it's 2024 <|endoftext|> x", "ÀÉ  İx ΣΣ \x1c y"] + [" ".join(rng.choice(["the", "lorem42", "Été", "a-b", "\n"]) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, offset int").repartition(3)
    got = P.packed(df, PATH, sequence=64, window_sequences=4).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _, _ in rows}
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(ids)
    for doc, p in pieces.items():
        at = 0
        for r in sorted(p, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for k, v in filled.items():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == 64 or k == max(filled)
    assert sorted(filled) == list(range(len(filled)))


def test_tokenizer_is_exact():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(PATH), P.WordTokenizer(PATH)
    rng = random.Random(9)
    marks = list("abcXYZ'.,!?-_\"<|> \n\t09") + ["é", "É", "ß", "ü.", "“", "—", "½", "²", "\u0301", "\u00a0", "中", "'s", "'re", "İ", "Σ", "<|endoftext|>", "\u2028"]
    for _ in range(300):
        texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(5)]
        got = [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)]
        assert got == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], "doc_id long, text string, source string"), PATH).collect() == []


def test_a_worker_keeps_no_word_pieces_for_other_operators():
    from sieveglass.llm import common, toxicity

    P.tokenizer(PATH).encode(["some words"])
    common.begin("tokenizer")
    assert common.kept["tokenizer"]  # packing's own tasks find it
    list(toxicity._words(iter(())))
    assert not common.kept["tokenizer"]
