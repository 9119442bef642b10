"""Structured Streaming operators: final state equals the batch result; the
cap holds across micro-batches."""

import uuid

from pyspark.sql import functions as F

from lexaria.operators import vocabulary as V
from lexaria.session import stage_path
from lexaria.sources import corpus as C
from lexaria.streaming import corpus as ST

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = ["The cat sat on the mat today. The dog ran off.", "A cat and a dog met here. The cat left soon.",
         "Dogs and cats are friends now.", "The cat came back again later."]


def _staged(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = stage_path(spark, f"test-stream-{uuid.uuid4().hex[:8]}")
    df.repartition(4, "doc_id").write.parquet(path)
    return df, ST.document_stream(spark, path, SCHEMA, 1)


def test_running_word_counts_equal_batch(spark):
    batch, stream = _staged(spark)
    out = stage_path(spark, f"wc-{uuid.uuid4().hex[:8]}")
    ST.latest_counts(ST.running_word_counts(stream), out, out + "-ckpt").awaitTermination()
    got = {r.word: r.freq for r in ST.read_latest(spark, out).collect()}
    want = {r.word: r.freq for r in V.word_counts(V.tokens(C.sentences(C.document_lines(batch)))).collect()}
    assert got == want and got["cat"] == 4


def test_capped_contexts_across_batches(spark):
    _, stream = _staged(spark)
    vocab = spark.createDataFrame([("cat",), ("dog",)], "word string")
    out = stage_path(spark, f"cc-{uuid.uuid4().hex[:8]}")
    ST.capped_contexts(stream, vocab, out, out + "-ckpt", n=2, vocab_bound=10).awaitTermination()
    counts = {r.word: r.n for r in ST.read_contexts(spark, out).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"cat": 2, "dog": 2}


def test_capped_contexts_state(spark):
    """Many triggers: a word keeps its first contexts by position of the earliest triggers; later ones add nothing."""
    path, out = (stage_path(spark, f"{k}-{uuid.uuid4().hex[:8]}") for k in ("test-state", "cs"))
    for day in range(5):  # one file per trigger, in order of arrival
        text = " ".join(f"The cat sees thing{i}." for i in range(3))
        rows = [(10 * day + i, text, "en", "s", len(text)) for i in (1, 0)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    vocab = spark.createDataFrame([("cat",), ("thing1",), ("never",)], "word string")
    stream = ST.document_stream(spark, path, SCHEMA, 1)
    ST.capped_contexts(stream, vocab, out, out + "-ckpt", n=8, vocab_bound=10).awaitTermination()
    got = {}
    for r in ST.read_contexts(spark, out).collect():
        got.setdefault(r.word, []).append((r.doc_id, r.sent_no))
    assert sorted(got["cat"]) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (10, 0), (10, 1)]
    assert len(got["thing1"]) == 8 and sorted(got["thing1"])[:3] == [(0, 1), (1, 1), (10, 1)] and "never" not in got
    # a restart of the same query with nothing new emits nothing
    ST.capped_contexts(stream, vocab, out, out + "-ckpt", n=8, vocab_bound=10).awaitTermination()
    assert ST.read_contexts(spark, out).count() == 16


def test_capped_contexts_state_is_held_by_group(spark):
    """The words of a group share a row of the state, so a trigger calls Python per group; the cap stays per word."""
    path, out = (stage_path(spark, f"{k}-{uuid.uuid4().hex[:8]}") for k in ("test-groups", "cg"))
    words = [f"word{i}" for i in range(200)]
    for day in range(2):
        text = " ".join(f"Here {w} comes again." for w in words for _ in range(2))
        spark.createDataFrame([(day, text, "en", "s", len(text))], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    vocab = spark.createDataFrame([(w,) for w in words], "word string")
    query = ST.capped_contexts(ST.document_stream(spark, path, SCHEMA, 1), vocab, out, out + "-ckpt", n=3, vocab_bound=200)
    query.awaitTermination()
    got = ST.read_contexts(spark, out).groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    per_day = sorted((r.doc_id, r.n) for r in got)
    assert len(got) == 400 and sorted({r.word for r in got}) == sorted(words) and {n for _, n in per_day} == {1, 2}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= -(-200 // ST.WORDS_A_GROUP)
