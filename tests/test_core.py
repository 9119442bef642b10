"""Fixture tests: vocabulary, text contract, encoder, evaluation, positions, transforms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.functions import vectors as Vx
from lexaria.functions.ordering import with_global_index
from lexaria.operators import contexts as X
from lexaria.operators import encode as EN
from lexaria.operators import evaluate as EV
from lexaria.operators import linalg as LA
from lexaria.operators import pooling as PO
from lexaria.operators import positions as PS
from lexaria.operators import vocabulary as V
from lexaria.sources import corpus as C

W2V = [("hello", [1.0, 0.0, 0.0]), ("world", [0.0, 1.0, 0.0]), ("test", [0.0, 0.0, 1.0]),
       ("the", [0.5, 0.5, 0.0]), ("quick", [0.3, 0.3, 0.4])]


def w2v(spark):
    return spark.createDataFrame(W2V, "word string, vec array<double>")


def counts_df(spark, rows):
    # first occurrence in list order, like a Counter insertion order
    data = [(w, f, i) for i, (w, f) in enumerate(rows)]
    df = spark.createDataFrame(data, "word string, freq bigint, pos long")
    return df.select("word", "freq", F.col("pos").cast("decimal(38,0)").alias("first_key"))


def test_vocabulary_filter(spark):
    c = counts_df(spark, [("a", 100), ("ab", 50), ("abc", 25), ("abcd", 10), ("abcde", 5)])
    assert [r.word for r in V.filter_vocabulary(c, 1, 3).orderBy("word_idx").collect()] == ["abc", "abcd", "abcde"]
    assert [r.word for r in V.filter_vocabulary(c, 20, 1).orderBy("word_idx").collect()] == ["a", "ab", "abc"]
    assert V.filter_vocabulary(c, 1, 1, max_size=2).count() == 2


def test_vocabulary_index_ties_follow_first_occurrence(spark):
    c = counts_df(spark, [("hello", 100), ("world", 50), ("test", 50), ("zeta", 100)])
    v = V.filter_vocabulary(c, 1, 1).orderBy("word_idx").collect()
    assert [r.word for r in v] == ["hello", "zeta", "world", "test"]
    assert [r.word_idx for r in v] == [0, 1, 2, 3]


def test_valid_word(spark):
    df = spark.createDataFrame([(w,) for w in ["hello", "Hello123", "...", "123", "#hashtag", "http://url"]], "w string")
    got = {r.w: r.v for r in df.select("w", T.valid_word(F.col("w")).alias("v")).collect()}
    assert got == {"hello": True, "Hello123": True, "...": False, "123": False, "#hashtag": False,
                   "http://url": False}


def test_sentences_and_tokens(spark):
    docs = spark.createDataFrame([(1, "  Hello there, world!  How are you today?\n\nshort. Yes it is a longer one here.")],
                                 "doc_id long, text string")
    s = C.sentences(C.document_lines(docs)).orderBy("line_no", "sent_no").collect()
    assert [r.sentence for r in s] == ["Hello there, world!", "How are you today?", "Yes it is a longer one here."]
    toks = V.tokens(C.sentences(C.document_lines(docs))).where(F.col("sent_no") == 0).where(
        F.col("line_no") == 0).orderBy("tok_pos").collect()
    assert [t.word for t in toks] == ["hello", "there", "world"]
    t = spark.createDataFrame([("it's $5 a+b",)], "s string").select(T.word_tokens(F.col("s")).alias("t")).first().t
    assert t == ["it", "'", "s", "$", "5", "a", "+", "b"]


def test_line_count_counts_blank_lines(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n")], "doc_id long, text string")
    assert docs.select(F.size(T.split_lines(F.col("text")))).first()[0] == 4
    assert C.document_lines(docs).count() == 2


def test_context_index_first_n_and_lowercase(spark):
    docs = spark.createDataFrame([(1, "The cat sat down. The Cat ran away now. A cat cat cat here. The dog is here now.")],
                                 "doc_id long, text string")
    vocab = spark.createDataFrame([("cat", 1, 0), ("dog", 1, 1), ("bird", 1, 2)], "word string, freq long, word_idx long")
    ctx = X.build_contexts(C.sentences(C.document_lines(docs)), vocab, n_sentences=2, vocab_bound=10)
    rows = ctx.orderBy("word", "rn").collect()
    assert [(r.word, r.rn) for r in rows] == [("cat", 1), ("cat", 2), ("dog", 1)]
    assert rows[1].sentence == "the cat ran away now."
    stats = X.context_stats(vocab, ctx, 2).first()
    assert (stats.vocab_size, stats.words_with_sentences, stats.words_needing) == (3, 2, 2)
    assert stats.avg_sentences == pytest.approx(1.5)
    got = X.sentences_of(ctx, spark.createDataFrame([("bird",), ("cat",)], "word string"), 1).orderBy("word").collect()
    assert got[0].sentences == [] and len(got[1].sentences) == 1


def _space_tokens(c):
    return F.split(F.lower(c), " ")


def test_encoder(spark):
    texts = spark.createDataFrame([(0, "hello"), (1, "hello world"), (2, "hello xyz world"), (3, "xyz abc def")],
                                  "sent_id long, text string")
    enc = {r.sent_id: np.array(r.vec) for r in
           EN.encode(texts, w2v(spark), dim=3, tokenizer=_space_tokens).collect()}
    assert np.linalg.norm(enc[0]) == pytest.approx(1.0, abs=1e-6)
    assert np.linalg.norm(enc[1]) == pytest.approx(1.0, abs=1e-6)
    assert np.linalg.norm(enc[2]) > 0
    assert np.allclose(enc[3], 0)
    pairs = spark.createDataFrame([(0, "hello", "hello"), (1, "hello", "world")], "pair_id long, a string, b string")
    sims = {r.pair_id: r.sim for r in EN.pair_similarity(pairs, w2v(spark), dim=3, tokenizer=_space_tokens).collect()}
    assert sims[0] == pytest.approx(1.0, abs=1e-6) and sims[1] < 1


def test_encode_drop_empty_raises(spark):
    texts = spark.createDataFrame([(0, "xyz abc")], "sent_id long, text string")
    with pytest.raises(ValueError):
        EN.encode_nonempty(texts, w2v(spark), dim=3)


def test_word_similarity_coverage(spark):
    pairs = spark.createDataFrame([("d", 0, "hello", "world", 0.2), ("d", 1, "hello", "the", 0.8),
                                   ("d", 2, "world", "the", 0.7), ("d", 3, "test", "quick", 0.5)],
                                  "dataset string, pair_id long, a string, b string, gold double")
    r = EV.word_similarity(pairs, w2v(spark), dim=3).first()
    assert (r.n_pairs, r.n_found, r.coverage) == (4, 4, 1.0) and r.spearman > 0
    oov = spark.createDataFrame([("d", 0, "hello", "world", 0.5), ("d", 1, "hello", "xyzzy", 0.5)],
                                "dataset string, pair_id long, a string, b string, gold double")
    r = EV.word_similarity(oov, w2v(spark), dim=3).first()
    assert (r.n_found, r.coverage, r.spearman, r.pearson) == (1, 0.5, 0.0, 0.0)


def test_spearman_ties_and_constant(spark):
    x = [1.0, 2.0, 2.0, 3.0, 5.0, 5.0, 5.0]
    y = [2.0, 1.0, 4.0, 4.0, 6.0, 7.0, 7.0]
    df = spark.createDataFrame([("d", i, a, b) for i, (a, b) in enumerate(zip(x, y))],
                               "dataset string, pair_id long, pred double, gold double")
    r = EV.correlations(df, ["dataset"]).first()

    def avg_rank(v):
        v = np.asarray(v)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert r.spearman == pytest.approx(np.corrcoef(avg_rank(x), avg_rank(y))[0, 1], abs=1e-12)
    assert r.pearson == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)
    const = spark.createDataFrame([("d", i, 1.0, float(i)) for i in range(5)],
                                  "dataset string, pair_id long, pred double, gold double")
    assert EV.correlations(const, ["dataset"]).first().pearson is None


def test_synthetic_pairs(spark):
    assert EV.synthetic_word_pairs(spark).count() == 14
    assert EV.synthetic_sentence_pairs(spark).count() == 9


def test_positions(spark):
    rows = [([3, 4, 5, 6], [5], 0, 2), ([3, 4, 5, 6], [1], 0, None), ([3, 3, 4], [3], 0, 0), ([3, 3, 4], [3], 1, 1),
            ([3, 4], [3, 4, 5], 0, None), ([3, 4], [], 0, None)]
    df = spark.createDataFrame(rows, "t array<int>, w array<int>, s int, e int")
    got = df.select(PS.first_position(F.col("t"), F.col("w"), F.col("s")).alias("p"), "e").collect()
    assert [r.p for r in got] == [r.e for r in got]


@pytest.mark.parametrize("mode", [{}, {"subword_mode": True}, {"strict": True, "prompt": "query: find", "n_contexts": 2, "cap": "after"}])
def test_positions_cut_a_sentence_once(spark, mode):
    rows = [("hello", 1, "say hello, hello"), ("hello", 2, "nothing"), ("hello", 3, "hello"), ("say", 4, None), (None, 5, "say"), ("say", 6, "say")]
    out = PS.find_positions(spark.createDataFrame(rows, "word string, rn int, sentence string"), **mode)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(" + ("concat(query: find" if "prompt" in mode else "sentence#")) == 1
    got = {(r.word, r.rn): r.start for r in out.collect()}
    off = 5 if "prompt" in mode else 0
    found = {("say", 6): off} | ({} if "subword_mode" in mode else {("hello", 1): 1 + off, ("hello", 3): off})
    assert got == found


def test_contexts_are_cut_before_they_are_sorted(spark, monkeypatch):
    """First sentences of a word in corpus order, however small the chunks; rows may repeat, ids may be null."""
    sents = [(d, n, 0, f"common word{d or 0} common {'rare' if n == 3 else 'x'}") for d in (None, 5, 5, 2, 9) for n in range(4)]
    df = spark.createDataFrame([*sents, (1, 0, 0, None), (1, 1, 0, "..."), (1, 2, 0, "common " * 100)],
                               "doc_id long, line_no int, sent_no int, sentence string").repartition(3)
    vocab = spark.createDataFrame([("common",), ("rare",), ("word5",), ("none",)], "word string")
    want = {}
    for d, n, k, s in sorted(sents, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        for w in {"common", "rare", "word5"} & set(s.split()):
            want.setdefault(w, []).append((d, n, k, s))
    for size in (1, 7, 1 << 21):
        monkeypatch.setattr(X, "CHUNK_WORDS", size)
        ctx = X.build_contexts(df, vocab, 6)
        got = {}
        for r in sorted(ctx.collect(), key=lambda r: (r.word, r.rn)):
            got.setdefault(r.word, []).append((r.doc_id, r.line_no, r.sent_no, r.sentence))
            assert r.rn == len(got[r.word])
        assert got == {w: rows[:6] for w, rows in want.items()}
    # one row per word and sentence never reaches the JVM's sort
    plan = ctx._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode(" not in plan.lower()


def test_pieces_drop_lone_marker(spark):
    df = spark.createDataFrame([("hello",), ("3rd",)], "w string")
    got = {r.w: r.p for r in df.select("w", PS.word_pieces(F.col("w")).alias("p")).collect()}
    assert got == {"hello": ["▁hel", "lo"], "3rd": ["3rd"]}


def test_subword_lookup(spark):
    table = spark.createDataFrame([("hel", [1.0, 0.0]), ("hello", [0.0, 1.0]), ("wor", [0.5, 0.5])],
                                  "word string, vec array<double>")
    oov = spark.createDataFrame([("hellooo", ["▁hel", "lo", "oo"]), ("WORLD", ["▁WOR", "LD"]), ("x", ["▁x"]),
                                 ("zzzz", ["▁zzz", "z"])], "word string, pieces array<string>")
    got = {r.word: r.vec for r in EN.subword_lookup(oov, table).collect()}
    assert got == {"hellooo": [0.0, 1.0], "WORLD": [0.5, 0.5]}


def test_normalize_and_center(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "id int, vec array<double>")
    got = {r.id: r.v for r in df.select("id", Vx.l2_normalize("vec").alias("v")).collect()}
    assert np.allclose(got[0], [0.6, 0.8], atol=1e-7) and got[1] == [0.0, 0.0]
    m = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "id int, vec array<double>")
    centred, mean = PO.mean_center(m)
    assert np.allclose(mean, [3.0, 4.0])
    assert np.allclose(np.mean([r.vec for r in centred.collect()], axis=0), 0)


def test_pca_remove_and_reduce(spark):
    rng = np.random.default_rng(0)
    sents = spark.createDataFrame([(i, rng.normal(size=32).tolist()) for i in range(100)], "id int, vec array<double>")
    words = spark.createDataFrame([(i, rng.normal(size=32).tolist()) for i in range(50)], "id int, vec array<double>")
    fit = LA.fit_pca(sents, 3)
    assert fit.components.shape == (3, 32)
    assert np.allclose(fit.components @ fit.components.T, np.eye(3), atol=1e-8)
    out = np.array([r.vec for r in LA.remove_components(words, fit, 3).collect()])
    assert np.abs(out @ fit.components.T).max() < 1e-10
    red, _ = LA.reduce_dims(words, 8)
    assert len(red.first().vec) == 8


def test_all_but_the_top_lowers_dominant_variance(spark):
    rng = np.random.default_rng(1)
    direction = rng.normal(size=16)
    direction /= np.linalg.norm(direction)
    x = rng.normal(size=(100, 16)) * 0.1 + np.outer(rng.normal(size=100) * 5, direction)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    out = np.array([r.vec for r in LA.all_but_the_top(df, 1).orderBy("id").collect()])
    assert np.var(out @ direction) < np.var(x @ direction) * 0.01


def test_sif_weights(spark):
    emb = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(60)], "token int, vec array<double>")
    counts = spark.createDataFrame([(0, 10000), (1, 1), (2, 100), (999, 5)], "token int, n long")
    got = {r.token: r.vec[0] for r in LA.sif_weighting(emb, counts, 1e-3).collect()}
    assert got[0] < got[1] and got[50] == 1.0


def test_post_process_unit_norms(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=32).tolist()) for i in range(80)], "token int, vec array<double>")
    out = LA.post_process(df, None, pca_dims=8, remove_pc=True)
    norms = [np.linalg.norm(r.vec) for r in out.collect()]
    assert len(out.first().vec) == 8 and np.allclose(norms, 1.0, atol=1e-5)
    plain = LA.post_process(df, None, apply_pca=False, remove_pc=False).collect()
    assert np.allclose([np.linalg.norm(r.vec) for r in plain], 1.0, atol=1e-6)


def test_global_index_is_partition_independent(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    a = [r.idx for r in with_global_index(df.repartition(1), ["k"], "idx").orderBy("k").collect()]
    b = [r.idx for r in with_global_index(df.repartition(16), ["k"], "idx", num_partitions=7).orderBy("k").collect()]
    assert a == b == list(range(1000))


def test_pooling_variants(spark):
    ctx = spark.createDataFrame([("a", 0, [1.0, 0.0], 1.0), ("a", 1, [0.0, 1.0], 3.0), ("b", 0, [2.0, 2.0], 0.0)],
                                "word string, ctx int, vec array<double>, w double")
    mean = {r.word: r.vec for r in PO.mean_pooling(ctx).collect()}
    assert mean["a"] == [0.5, 0.5]
    wm = {r.word: r.vec for r in PO.weighted_mean_pooling(ctx, "w").collect()}
    assert np.allclose(wm["a"], [0.25, 0.75]) and wm["b"] is None
    vw = {r.word: r.vec for r in PO.variance_weighted_pooling(ctx).collect()}
    assert np.allclose(vw["a"], [0.5, 0.5]) and vw["b"] == [2.0, 2.0]


def test_two_level_mean_differs_from_flat(spark):
    st = spark.createDataFrame([("w", 0, 0, [1.0]), ("w", 0, 1, [1.0]), ("w", 0, 2, [1.0]), ("w", 1, 0, [0.0])],
                               "word string, ctx int, tok int, vec array<double>")
    r = PO.two_level_mean(st).first()
    assert r.vec == [0.5] and r.n_contexts == 2


def test_masked_mean_guard(spark):
    st = spark.createDataFrame([(0, 0, 1, [2.0]), (0, 1, 0, [9.0]), (1, 0, 0, [5.0])],
                               "sent int, tok int, mask int, vec array<double>")
    got = {r.sent: r.vec for r in PO.masked_mean(st).collect()}
    assert got == {0: [2.0], 1: [0.0]}


def test_vocabulary_and_contexts_are_partition_independent(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")

    def build(d):
        sents = C.sentences(C.document_lines(d))
        vocab = V.filter_vocabulary(V.word_counts(V.tokens(sents)), 10, 3, 200)
        ctx = X.build_contexts(sents, vocab, 5, vocab_bound=200)
        return ([(r.word, r.freq, r.word_idx) for r in vocab.orderBy("word_idx").collect()],
                sorted((r.word, r.rn, r.doc_id, r.line_no, r.sent_no) for r in ctx.collect()))

    one = build(docs.repartition(1))
    many = build(docs.repartition(13, "doc_id"))
    assert one == many and len(one[0]) == 200


def test_batch_similarities_are_pairs(spark):
    """D6 and D8 give every pair of a batch, as their queries name it; a null vector has no cosine."""
    from lexaria.operators import losses as L

    vec = {0: [3.0, 4.0], 1: [1.0, 0.0], 2: None, 3: [0.0, 2.0]}
    rows = [(b, i, v, v and v[::-1]) for b in (0, 1) for i, v in vec.items() if b == 0 or i < 2]
    b = spark.createDataFrame(rows, "batch_id long, i long, s array<double>, t array<double>")
    pairs = {(r.batch_id, r.i, r.j): r.s for r in L.in_batch_pairs(b, ["s", "t"]).collect()}
    assert set(pairs) == {(0, i, j) for i in vec for j in vec if i != j} | {(1, 0, 1), (1, 1, 0)}
    assert pairs[0, 0, 1] == pytest.approx(0.6) and pairs[0, 1, 3] == 0.0 and pairs[0, 2, 1] is None
    sims = {(r.batch_id, r.i, r.j): r.sim for r in L.bipartite_pairs(b, "s", "t").collect()}
    assert len(sims) == 20 and sims[0, 0, 0] == pytest.approx(0.96) and sims[0, 0, 1] == pytest.approx(0.8)


def test_batch_similarity_queries_keep_their_pairs():
    import __spark_entry__ as E

    sql = E.oracle_sql()
    assert "SELECT batch_id, i, j, round(student, 6)" in sql["d06_in_batch_similarity"]
    assert "SELECT batch_id, i, j, round(sim, 6)" in sql["d08_bipartite_similarity"]


def test_encode_resolves_a_word_once(spark, monkeypatch):
    """However many lots ask for a word, its vector is looked up once."""
    asked, resolve = [], EN.resolve
    monkeypatch.setattr(EN, "LOT_TOKENS", 4)
    monkeypatch.setattr(EN, "resolve", lambda a, *rest: (asked.append(a), resolve(a, *rest))[1])
    sents = spark.createDataFrame([(i, "hello World the zzz") for i in range(12)] + [(12, None), (13, "zzz")], "sent_id int, text string")
    out = EN.encode(sents, spark.createDataFrame(W2V, "word string, vec array<double>"), normalize=False).collect()
    words = [r.word for r in asked[0].select("word").collect()]
    assert sorted(words) == ["World", "hello", "the", "zzz"]
    assert sorted(r.sent_id for r in out) == list(range(14))
    for r in out:
        assert r.vec == pytest.approx([0.5, 0.5, 0.0] if r.sent_id < 12 else [0.0, 0.0, 0.0])


def test_encode_joins_without_broadcast(spark):
    """Vectors are not collected by the driver, however small their table is."""
    sents = spark.createDataFrame([(i, "hello World") for i in range(3)], "sent_id int, text string")
    plan = EN.encode(sents, spark.createDataFrame(W2V, "word string, vec array<double>"), dim=3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pair_similarity_multiplies_in_lots(spark, monkeypatch):
    """The sides of a pair meet in their lot, not by a shuffle of their vectors; repeated keys are one pair, null keys score 0."""
    w2v_table = spark.createDataFrame(W2V, "word string, vec array<double>")
    vec = {w: np.array(v) for w, v in W2V}
    rows = [(1, "the Quick", "the"), (2, "the", "zzz"), (3, None, "quick"), (4, "the", "zzz"), (4, None, "quick"),
            (5, "the", "quick"), (5, "the", "quick"), (None, "the", "the")]
    pairs = spark.createDataFrame(rows, "pair_id int, a string, b string")
    monkeypatch.setattr(EN, "encode", None)
    for tokens, out in ((1 << 20, 1 << 14), (2, 2)):
        monkeypatch.setattr(EN, "LOT_TOKENS", tokens)
        monkeypatch.setattr(EN, "OUT_SENTENCES", out)
        got = sorted(((r.pair_id or 0), r.sim) for r in EN.pair_similarity(pairs, w2v_table, dim=3, normalize=False).collect())
        cross = float(vec["the"] @ vec["quick"])
        both = float(((vec["the"] + vec["quick"]) / 2) @ vec["the"])
        want = [(0, 0.0), (1, both), (2, 0.0), (3, 0.0), (4, cross), (4, cross), (5, 0.0), (5, 0.0)]
        assert [k for k, _ in got] == [k for k, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])


def test_historical_transform_computes_sentences_once(spark):
    """Sentences that are fitted and projected come from one run of their plan."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rng = np.random.default_rng(8)
    sents = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 3)))], "id long, vec array<double>")
    sents = sents.mapInArrow(count, "id long, vec array<double>")
    assert LA.historical_transform(sents, sents, 0, 3).count() == 20 and seen.value == 20


def test_words_counted_where_sentences_lie(spark, monkeypatch):
    """the rows of ``word_counts(tokens(...))`` without a row per token, over pieces in any order."""
    rng = np.random.default_rng(1)
    words = ["The", "the", "ΑΣ", "ας", "naïve", "«", "“x”", "...", "a.b", "İ", "😀", "日本", ",", "word", "Word"]
    rows = [(int(d) if d < 9 else None, int(x), int(y), " ".join(rng.choice(words, int(n))))
            for d, x, y, n in zip(rng.integers(-2, 12, 300), rng.integers(0, 4, 300), rng.integers(0, 4, 300), rng.integers(0, 9, 300))]
    sents = spark.createDataFrame([*rows, *rows[:50], (1, 0, 0, "")], "doc_id long, line_no long, sent_no long, sentence string")
    want = sorted(V.word_counts(V.tokens(sents)).collect())
    for size, parts in ((1, 1), (1 << 23, 3)):
        monkeypatch.setattr(V, "COUNT_BYTES", size)
        got = V.sentence_word_counts(sents.repartition(parts))
        assert sorted(got.collect()) == want and "Generate" not in got._jdf.queryExecution().toString()
    assert V.sentence_word_counts(sents.where("false")).count() == 0
    with pytest.raises(Exception, match="10\\^6 lines"):
        V.sentence_word_counts(spark.createDataFrame([(1, 10**6, 0, "a")], sents.schema)).collect()
