import random

import pytest

from sieveglass.llm import rollups as R


def totals(ledger):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}


def events(spark, rows):
    return spark.createDataFrame(rows, "op string, seq int, doc_id long, source string, lang string, text string, tokens int")


def test_signed_batches(spark, tmp_path):
    ledger = R.Rollup(spark, str(tmp_path))
    assert ledger.totals().count() == 0
    one = events(spark, [("insert", 1, 1, "a", "en", "x y z", 0), ("insert", 1, 2, "a", "en", "", 0), ("insert", 1, 3, None, None, None, 0), ("insert", 1, 1, "a", "en", "x y z", 0), ("delete", 1, 99, "a", "en", None, 0), ("insert", 1, None, "a", "en", "q", 0)])
    assert ledger.commit("b1", one) and not ledger.commit("b1", one)
    assert totals(ledger)["a", "en", "words"] == (2, 3) and totals(ledger)[None, None, "chars"] == (1, 0)
    two = events(spark, [("revise", 2, 1, "b", "en", "one", 0), ("revise", 3, 1, "b", "en", "one two", 0), ("delete", 2, 2, "a", "en", None, 0), ("insert", 2, 4, "a", "en", "w" * 100000, 0)])
    assert ledger.commit("b2", two)
    assert not ledger.commit("b2", two) and not ledger.commit("b1", one)
    assert {k: v for k, v in totals(ledger).items() if k[2] == "words"} == {("a", "en", "words"): (1, 1), ("b", "en", "words"): (1, 2), (None, None, "words"): (1, 0)}
    assert totals(ledger)["a", "en", "bytes4"] == (1, 25000)
    assert ledger.commit("b3", two.limit(0))
    assert {r.doc_id for r in ledger.documents().collect()} == {1, 3, 4}


def test_unfinished_batch_is_redone(spark, tmp_path):
    ledger = R.Rollup(spark, str(tmp_path))
    (tmp_path / "data" / "unfinished" / "state").mkdir(parents=True)
    one = events(spark, [("insert", 1, 1, "a", "en", "x y", 0)])
    assert ledger.commit("b1", one)
    assert totals(ledger)["a", "en", "words"] == (1, 2)
    assert ledger.committed() == ["b1"]


def plain(batches, count):
    """Totals by replaying all events one after another."""
    state, seen = {}, set()
    for name, rows in batches:
        if name in seen:
            continue
        seen.add(name)
        last = {}
        for op, seq, i, source, lang, text, _ in rows:
            if i is not None and (i not in last or (seq, op) > last[i][:2]):
                last[i] = (seq, op, source, lang, text)
        for i, (seq, op, source, lang, text) in last.items():
            if i not in state or seq > state[i][0]:
                state[i] = (seq, op != "delete", source, lang, count(text or ""))
    out = {}
    for _, alive, source, lang, n in state.values():
        if alive:
            docs, tokens = out.get((source, lang), (0, 0))
            out[source, lang] = (docs + 1, tokens + n)
    return out


def test_late_and_early_events_with_compaction(spark, tmp_path):
    rng = random.Random(4)
    batches = []
    for k in range(12):
        seqs = rng.sample(range(1000), 25)
        batches.append((f"b{k}", [(rng.choice(["insert", "revise", "delete"]), q, rng.randrange(30), rng.choice("ab"), rng.choice(["en", None]), " ".join("w" * rng.randrange(6)), 0) for q in seqs]))
    ledger = R.Rollup(spark, str(tmp_path), {("words", 1): R.TOKENIZERS["words", 1]}, compact_after=5)
    for k, (name, rows) in enumerate(batches):
        assert ledger.commit(name, events(spark, rows))
        if k == 7:
            assert not ledger.commit("b3", events(spark, batches[3][1]))
            ledger.vacuum()
    want = plain(batches, lambda t: len(t.split()))
    assert {k[:2]: v for k, v in totals(ledger).items()} == want
    assert ledger.committed() == sorted(n for n, _ in batches)
    assert len(ledger._since_base(ledger._manifests())) <= 6
    again = {}
    for r in ledger.documents().collect():
        docs, n = again.get((r.source, r.lang), (0, 0))
        again[r.source, r.lang] = (docs + 1, n + r.tokens)
    assert again == want


def test_racing_writer_starts_over(spark, tmp_path, monkeypatch):
    ledger, other = (R.Rollup(spark, str(tmp_path), {("words", 1): R.TOKENIZERS["words", 1]}) for _ in range(2))
    write = R.Rollup._write

    def late(self, data, rows, manifests):
        write(self, data, rows, manifests)
        if self is ledger and not manifests:
            monkeypatch.setattr(R.Rollup, "_write", write)
            assert other.commit("first", events(spark, [("insert", 1, 1, "a", "en", "x y z", 0)]))

    monkeypatch.setattr(R.Rollup, "_write", late)
    assert ledger.commit("second", events(spark, [("revise", 2, 1, "a", "en", "x", 0)]))
    assert totals(ledger) == {("a", "en", "words"): (1, 1)}
    (tmp_path / "commits" / "00000002").write_text("")  # a writer that was lost
    assert ledger.commit("third", events(spark, [("delete", 3, 1, "a", "en", None, 0)])) and totals(ledger) == {}


def test_vocabularies(spark, tmp_path):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    p = pytest.importorskip("public_tokenizers")
    queries = pytest.importorskip("sieveglass.llm.queries")
    texts = [None, "", "Hello, world!  Café naïve\n\tüber 123 <|endoftext|>", "the " * 30000, "x" * 5000, "😀 emoji", "a|b|c"]
    rows = [("insert", 1, i, "s", "en", t, 0) for i, t in enumerate(texts)]
    ledger = R.Rollup(spark, str(tmp_path), queries.vocabularies())
    ledger.commit("b", events(spark, rows))
    words = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs = tiktoken.Encoding("t", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {(r.doc_id, r.tokenizer): r.tokens for r in ledger.documents().collect()}
    for i, t in enumerate(texts):
        assert got[i, "words"] == len((t or "").split())
        assert got[i, "word_bpe_49k"] == len(words.encode(t or "", add_special_tokens=False).ids)
        assert got[i, "byte_bpe_50k"] == len(pairs.encode_ordinary(t or ""))


def test_whole_query_against_plain_counts(spark, tmp_path):
    queries = pytest.importorskip("sieveglass.llm.queries")
    pytest.importorskip("public_tokenizers")
    rng = random.Random(6)
    docs = [(i, " | ".join(rng.choice(["red", "Green", "blau", "été"]) for _ in range(rng.randrange(9))) if i else None, rng.choice(["en", "de"]), rng.choice("st")) for i in range(60)]
    labels = [(i, rng.randrange(2), int(rng.random() < 0.3)) for i in range(0, 60, 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r.source, r.lang, r.tokenizer, r.version): (r.n_docs, r.n_tokens) for r in queries.op6_token_counts(spark, str(tmp_path)).collect()}
    counters = {("words", 1): lambda t: [len(x.split()) for x in t]} | {k: v.counter() for k, v in queries.vocabularies().items() if isinstance(v, R.Vocabulary)}
    want, of = {}, {i: (q, t) for i, q, t in labels}
    for i, text, lang, source in docs:
        quality, toxic = of.get(i, (1, 0))
        if toxic:
            continue
        text = (text or "").replace("|", " ") if quality == 0 else text or ""
        for (name, version), count in counters.items():
            n, k = want.get((source, lang, name, version), (0, 0))
            want[source, lang, name, version] = (n + 1, k + count([text])[0])
    assert got == want


def test_texts_that_no_label_changes_are_not_shuffled(spark, tmp_path):
    from sieveglass.llm import common

    queries = pytest.importorskip("sieveglass.llm.queries")
    ids = [*range(-1500, 1500), 1 << 62, None]
    docs = spark.createDataFrame([(i, "t", "en", "s") for i in ids], "doc_id long, text string, lang string, source string")
    some = spark.createDataFrame([(i,) for i in ids[::10] if i is not None], "doc_id long")
    left = [r.doc_id for r in common.maybe_in(docs, "doc_id", some).collect()]
    assert {r.doc_id for r in some.collect()} <= set(left) and len(left) == len(set(left)) < 0.25 * len(ids)
    assert common.maybe_in(docs, "doc_id", some.limit(0)).count() == 0
    few = spark.createDataFrame([(i,) for i in range(9)], "doc_id int")  # of another type
    assert set(range(9)) <= {r.doc_id for r in common.maybe_in(docs, "doc_id", few).collect()}
    docs.where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    some.selectExpr("doc_id", "0 as quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dict(queries._batches(spark, str(tmp_path)))["2"]
        assert plan.count() == some.count()
        tree = plan._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "bitmap_construct_agg" in tree
