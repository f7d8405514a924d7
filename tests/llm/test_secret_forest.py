import random

import numpy as np
import pytest

from sieveglass.llm import secret_forest as S
from sieveglass.llm.common import auc

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def forest():
    return S.train(PATH)


def test_held_out_findings(forest):
    rows = S.examples(400, seed=99)
    x = np.array([S.features(*r[:4], S.dictionary(PATH)) for r in rows])
    y = np.array([r[4] for r in rows])
    s = forest.score(x)
    assert auc(y, s) > 0.99 and ((s >= S.THRESHOLD) == y).mean() > 0.97


def test_scores_follow_the_trees(forest):
    rows = S.examples(20, seed=3)
    x = np.array([S.features(*r[:4], S.dictionary(PATH)) for r in rows])

    def walk(t, row):
        node = 0
        while forest.feature[t][node] >= 0:
            node = forest.left[t][node] + int(row[forest.feature[t][node]] > forest.cut[t][node])
        return forest.value[t][node]

    want = [np.mean([walk(t, r) for t in range(S.TREES)]) for r in x]
    assert np.allclose(forest.score(x), want)


def test_scan_and_redact(spark, forest):
    key = random.Random(1).randbytes(20).hex()
    rows = [
        (1, f'Ünthe of token = "{key}" thing.', "a/1.txt"),
        (2, "Plain thintion reing stthedwhtionble words onenthtionwhthing 4913615156729033 end.", "a/2.txt"),
        (3, None, "x"),
        (4, "", None),
        (5, f'TOKEN = "{key.upper()}"!! ' + "long text " * 20000 + f"secret: {key}", "b/.env"),
        (6, "commit " + key + " merged", "CHANGELOG.md"),
        (6, "commit " + key + " merged", "CHANGELOG.md"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = S.scan(df, forest, PATH, path_col="path").collect()
    kept = sorted((r.doc_id, r.start, r.end) for r in got if r.secret)
    at = rows[0][1].encode().index(key.encode())
    end = len(rows[4][1])
    assert kept == [(1, at, at + 40), (5, 9, 49), (5, end - 40, end)]
    assert {r.doc_id for r in got} >= {1, 2, 5, 6}
    out = {r.doc_id: r.text for r in S.redact(df, forest, PATH, path=df.path).collect()}
    assert out[1] == f'Ünthe of token = "{S.MARKER}" thing.' and out[3] is None and out[4] == "" and key not in out[5].lower()
    assert out[2] == rows[1][1]
    assert S.scan(df.limit(0), forest, PATH).count() == 0
    assert S.redact(df, forest, PATH).columns == df.columns


def test_no_filter_before_the_forest(spark, forest):
    rng = random.Random(4)
    aws = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16))
    low = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))
    rows = [(1, f"the {aws} here"), (2, f'secret = "{low}"'), (3, "password = h7!x@Q#9z\n"), (4, "url:a?db_password=Zk9$wq2!Lx,"), (5, "the key: something is plain thinghandtionreing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {(r.doc_id, r.start, r.end) for r in S.scan(df, forest, PATH).collect()}
    assert seen >= {(1, 4, 24), (2, 10, 34), (3, 11, 20), (4, 18, 28), (5, 9, 18)}
    out = {r.doc_id: r.text for r in S.redact(df, forest, PATH).collect()}
    assert out[1] == f"the {S.MARKER} here" and out[2] == f'secret = "{S.MARKER}"' and out[3] == f"password = {S.MARKER}\n"
    assert out[4] == f"url:a?db_password={S.MARKER}," and out[5] == rows[4][1]


def test_findings_labelled_by_hand():
    """None of them come from the generator that the forest learns from."""
    from labelled_findings import FINDINGS

    p = pytest.importorskip("public_tokenizers")
    path = p.path("word_bpe_49k.json")
    words, forest = S.dictionary(path), S.train(path)
    score = forest.score(np.array([S.features(*r[:4], words) for r in FINDINGS]))
    y = np.array([r[4] for r in FINDINGS])
    wrong = [(r[0], round(float(s), 2)) for r, s in zip(FINDINGS, score) if (s >= S.THRESHOLD) != r[4]]
    assert (score[y == 1] >= S.THRESHOLD).mean() >= 0.85, wrong
    assert (score[y == 0] < S.THRESHOLD).mean() >= 0.85, wrong


def test_trained_on_labelled_findings():
    """Labels of one's own decide: here dates in ISO form are what is looked for."""
    p = pytest.importorskip("public_tokenizers")
    path, words = p.path("word_bpe_49k.json"), S.dictionary(p.path("word_bpe_49k.json"))
    rows = [(f"20{i:02d}-0{i % 9 + 1}-1{i % 9}T0{i % 9}:00:00.000Z", "at ", "", "a.txt", 1) for i in range(60)] + [("plainword" + "abcdefgh"[i % 8] * (i % 20 + 8), "at ", "", "a.txt", 0) for i in range(60)]
    forest = S.train(path, rows)
    score = forest.score(np.array([S.features("2031-05-11T02:00:00.000Z", "at ", "", "a.txt", words), S.features("someotherplainwordhere", "at ", "", "a.txt", words)]))
    assert score[0] > 0.8 and score[1] < 0.2
