"""Derived relations over the test tables (the inputs every registered query reads).

- corpus lines / sentences / tokens from ``documents``
- vocabulary: all words that pass min_freq=10 and min_len=3
- word vectors: every vocabulary word gets the embedding ``vec_id = word_idx mod |embeddings|``
- sentence pairs: a user turn and the next turn of ``conversations``
- contexts: ``embeddings`` with ``label`` as the word and ``vec_id`` as the context
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.functions.vectors import as_double
from lexaria.operators import vocabulary as V
from lexaria.session import stage_path
from lexaria.sources import corpus as C

MIN_FREQ = 10
MIN_LEN = 3
N_CONTEXTS = 10


_STAGES: dict = {}
_RUN = uuid.uuid4().hex[:12]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return C.read_table(spark, sf, name)


def stage(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Materialise a bounded stage once (Parquet in the shared checkpoint
    folder) and read it back on later use; cuts the lineage too."""
    key = (sf, name)
    if key not in _STAGES:
        path = stage_path(spark, f"stage-{_RUN}-{name}-{hashlib.md5(sf.encode()).hexdigest()[:8]}")
        build().write.mode("overwrite").parquet(path)
        _STAGES[key] = path
    return spark.read.parquet(_STAGES[key])


def reset_stages() -> None:
    """Forget materialised stages and counts (the bench times every query from scratch)."""
    _STAGES.clear()
    _COUNTS.clear()


def lines(spark, sf) -> DataFrame:
    return C.document_lines(table(spark, sf, "documents").select("doc_id", "text"))


def sentences(spark, sf) -> DataFrame:
    return C.sentences(lines(spark, sf))


def tokens(spark, sf) -> DataFrame:
    return V.tokens(sentences(spark, sf))


def counts(spark, sf) -> DataFrame:
    return V.word_counts(tokens(spark, sf))


_COUNTS: dict = {}


def _once(key, make):
    if key not in _COUNTS:
        _COUNTS[key] = make()
    return _COUNTS[key]


def n_vectors(spark, sf) -> int:
    """|embeddings|; one scalar per table set (parquet footer metadata, no data scan)."""
    return _once((sf, "vectors"), lambda: table(spark, sf, "embeddings").count())


def n_words(spark, sf) -> int:
    """Measured size of the staged vocabulary: what decides whether its vectors may be broadcast."""
    return _once((sf, "words"), lambda: vocab(spark, sf).count())


def dim(spark, sf) -> int:
    """Dimension of the vectors, read from the table once."""
    return _once((sf, "dim"), lambda: table(spark, sf, "embeddings").select(F.size("embedding")).first()[0])


def vector_of(index, spark, sf, shift: int = 0):
    """The ``vec_id`` that stands for a word or document number."""
    return F.pmod(index + shift, F.lit(n_vectors(spark, sf)))


def turn_key(conv="conv_id", turn="turn"):
    """One key per (conversation, turn); the parts keep their full width."""
    return F.concat(F.lpad(F.col(conv).cast("string"), 19, "0"), F.lit("-"), F.lpad(F.col(turn).cast("string"), 19, "0"))


def vocab(spark, sf) -> DataFrame:
    return stage(spark, sf, "vocab",
                 lambda: V.filter_vocabulary(V.sentence_word_counts(sentences(spark, sf)), MIN_FREQ, MIN_LEN))


def embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", as_double("embedding").alias("vec"), "label"
    )


def word2vec(spark, sf) -> DataFrame:
    """``(word, vec array<double>)`` — a vector for every vocabulary word."""
    def build():
        v = vocab(spark, sf)
        e = embeddings(spark, sf)
        return v.join(e, vector_of(v.word_idx, spark, sf) == e.vec_id).select("word", "vec")

    return stage(spark, sf, "word2vec", build)


def conversation_pairs(spark, sf) -> DataFrame:
    """``(pair_id, a, b, gold)``: every user turn and the following turn."""
    c = table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("a"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return u.join(n, ["conv_id", "turn"]).select(
        turn_key().alias("pair_id"),
        "a",
        "b",
        T.hash_gold(F.col("conv_id"), F.col("turn")).alias("gold"),
    )


def word_pairs(spark, sf) -> DataFrame:
    """``(pair_id, a, b, gold)``: every vocabulary word with the next one.

    About a fifth of the partners (chosen by hash) get a suffix that makes them
    out of vocabulary, so coverage is below one.
    """
    v = vocab(spark, sf)
    a = v.select(F.col("word_idx").alias("pair_id"), F.col("word").alias("a"))
    b = v.select((F.col("word_idx") - 1).alias("pair_id"), F.col("word").alias("b"))
    oov = T.hash_gold(F.col("pair_id"), F.lit("oov")) < 0.2
    return a.join(b, "pair_id").select(
        "pair_id",
        "a",
        F.when(oov, F.concat(F.col("b"), F.lit("zzq"))).otherwise(F.col("b")).alias("b"),
        T.hash_gold(F.col("pair_id")).alias("gold"),
    )


def contexts(spark, sf) -> DataFrame:
    """``(word, ctx, vec)``: embeddings grouped by label (10 'words', many contexts)."""
    return embeddings(spark, sf).select(
        F.concat(F.lit("w"), F.col("label").cast("string")).alias("word"),
        F.col("vec_id").alias("ctx"),
        "vec",
    )
