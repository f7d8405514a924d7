import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = [f"w{i}x" for i in range(900)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, text(rng.randint(20, 120))) for i in range(160)]
    labels = []
    for i in range(0, 160, 2):
        if i % 8 == 0:
            rows[i] = (i, rows[i][1] + " vile dreck rotten " + text(3))
        labels.append((i, 1, int(i % 8 == 0)))
    item = text(30)
    key = rng.randbytes(20).hex()
    rows += [(1000, rows[1][1]), (1001, rows[3][1] + " tail"), (1002, text(10) + " " + item + " " + text(9)), (1003, f'{text(8)} token = "{key}" {text(5)}'), (1004, None), (1005, ""), (1006, text(30) + " vile dreck rotten " + text(2))]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, dict(rows), key


def test_stages_take_effect(spark, folder):
    at, texts, key = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == COLUMNS
        docs = docs.checkpoint()
        got[name] = {r.doc_id: r for r in docs.collect()}
    tox = set(texts) - set(got["toxicity"])
    assert 1006 in tox and {i for i in tox if i < 1000} <= set(range(0, 160, 8)) and len(tox) > 15
    dup = set(got["toxicity"]) - set(got["simhash"])
    assert 1000 in dup and {1, 3} <= set(got["simhash"]) and dup <= {1000, 1001, 1005}
    assert set(got["simhash"]) - set(got["decontamination"]) == {1002}
    assert set(got["secrets"]) == set(got["decontamination"])
    assert key in texts[1003] and key not in got["secrets"][1003].text and got["secrets"][1003].n_chars == len(got["secrets"][1003].text)
    assert all(got["secrets"][i].text == texts[i] for i in got["secrets"] if i != 1003)


def test_run_packs_what_is_kept(spark, folder):
    at, texts, _ = folder
    got = corpus_pipeline.run(spark, at).collect()
    ids = {r.doc_id for r in got}
    assert 1000 not in ids and 1002 not in ids and {1, 3, 1003, 1004} <= ids
    for i in ids:
        own = [r for r in got if r.doc_id == i]
        assert sum(r.length for r in own) == own[0].doc_tokens


def test_nulls_ties_and_extra_columns(spark, folder):
    at, _, _ = folder
    rows = [(None, None, None, None, None, 1), (None, "some text", "en", None, 9, 1), (7, None, None, "s", 0, 1), (7, "again", "en", "s", 5, 1), (8, "again", None, None, None, 1), (9, "x " * 60000, "en", "s", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for n in (None, 0):
        left = docs if n is None else docs.limit(0)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, at)
            assert left.columns == docs.columns
            left = left.checkpoint()
        ids = sorted(str(r.doc_id) for r in left.collect())
        assert ids == ([] if n == 0 else ["7", "7", "9", "None", "None"])  # two texts of one id
        pieces = corpus_pipeline.STAGES[-1][1](spark, left, at).collect()
        assert {r.doc_id for r in pieces} == ({None, 7, 9} if n is None else set())
