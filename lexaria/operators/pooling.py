"""Grouped vector aggregates.

Group means use ``pyspark.ml.stat.Summarizer`` (a typed imperative aggregate
with a map-side partial buffer of ``d`` doubles), so a word holding a third of
all contexts is reduced inside every map task before the shuffle.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.functions import vectors as Vx
from lexaria.functions.joins import bounded_broadcast, vector_row_bytes


def group_mean(df: DataFrame, keys: list[str], vec: str = "vec", weight: str | None = None,
               out: str = "vec") -> DataFrame:
    """``Σ w x / Σ w`` per group (plain mean without ``weight``); null when ``Σ w = 0``."""
    if weight is None:
        agg = Summarizer.mean(array_to_vector(F.col(vec))).alias("_m")
        return df.groupBy(*keys).agg(agg).select(*keys, vector_to_array("_m").alias(out))
    w = F.col(weight).cast("double")
    scaled = array_to_vector(F.transform(F.col(vec), lambda x: x * w))
    g = df.groupBy(*keys).agg(Summarizer.sum(scaled).alias("_s"), F.sum(w).alias("_w"))
    return g.select(
        *keys, F.when(F.col("_w") != 0, Vx.scale(vector_to_array("_s"), F.lit(1.0) / F.col("_w"))).alias(out)
    )


def group_sum(df: DataFrame, keys: list[str], vec: str = "vec", weight: str | None = None,
              out: str = "vec") -> DataFrame:
    """``Σ w x`` per group (any sign of ``w``: vectors are scaled before the sum)."""
    v = F.col(vec) if weight is None else F.transform(F.col(vec), lambda x: x * F.col(weight).cast("double"))
    agg = Summarizer.sum(array_to_vector(v))
    return df.groupBy(*keys).agg(agg.alias("_s")).select(*keys, vector_to_array("_s").alias(out))


def mean_pooling(contexts: DataFrame, key: str = "word") -> DataFrame:
    """Mean of the context vectors of each word."""
    return group_mean(contexts, [key])


def weighted_mean_pooling(contexts: DataFrame, weight: str | None, key: str = "word") -> DataFrame:
    """Weights normalised to sum one; no weights -> E8; zero weight sum -> null."""
    if weight is None:
        return mean_pooling(contexts, key)
    return group_mean(contexts, [key], weight=weight)


def variance_weighted_pooling(contexts: DataFrame, key: str = "word",
                              key_bound: int | None = None) -> DataFrame:
    """Weight ``1/(||x - centroid|| + 1e-6)``; groups of one row keep the plain mean.

    The centroid table has one row per word: broadcast when its size is bounded,
    otherwise a shuffled join that AQE may still turn into a broadcast.
    """
    cent = contexts.groupBy(key).agg(
        Summarizer.mean(array_to_vector(F.col("vec"))).alias("_c"), F.count(F.lit(1)).alias("_n")
    ).select(key, vector_to_array("_c").alias("_c"), "_n")
    cent = bounded_broadcast(cent, key_bound, vector_row_bytes(1024))
    w = contexts.join(cent, key).withColumn(
        "_w",
        F.when(F.col("_n") <= 1, F.lit(1.0)).otherwise(1.0 / (Vx.norm(Vx.sub("vec", "_c")) + F.lit(1e-6))),
    )
    return group_mean(w, [key], weight="_w")


def two_level_mean(states: DataFrame) -> DataFrame:
    """Mean over token pieces per context, then mean over contexts, plus context count.

    Input ``(word, ctx, tok, vec)``; output ``(word, vec, n_contexts)``.
    """
    per_ctx = group_mean(states, ["word", "ctx"])
    per_word = group_mean(per_ctx, ["word"])
    n = per_ctx.groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("n_contexts"))
    return per_word.join(n, "word")


def masked_mean(states: DataFrame, key: str = "sent") -> DataFrame:
    """``Σ mask·x / max(Σ mask, 1e-9)`` per sentence (all-masked -> zero vector)."""
    s = group_sum(states, [key], weight="mask", out="_s")
    m = states.groupBy(key).agg(F.sum(F.col("mask").cast("double")).alias("_m"))
    return s.join(m, key).select(
        key, Vx.scale("_s", F.lit(1.0) / F.greatest(F.col("_m"), F.lit(1e-9))).alias("vec")
    )


def merge_word_vectors(*tables: DataFrame) -> DataFrame:
    """Union of the words; mean of the vectors that exist for each."""
    u = tables[0].select("word", "vec")
    for t in tables[1:]:
        u = u.unionByName(t.select("word", "vec"))
    return group_mean(u, ["word"])


def embedding_stats(word_vectors: DataFrame) -> DataFrame:
    """Vocabulary size, dimension, mean / population std / min / max of the norms."""
    n = word_vectors.select(F.size("vec").alias("d"), Vx.norm("vec").alias("nrm"))
    return n.agg(
        F.count(F.lit(1)).cast("bigint").alias("vocab_size"),
        F.max("d").cast("bigint").alias("dim"),
        F.avg("nrm").alias("norm_mean"),
        F.stddev_pop("nrm").alias("norm_std"),
        F.min("nrm").alias("norm_min"),
        F.max("nrm").alias("norm_max"),
    )


def mean_center(df: DataFrame, vec: str = "vec") -> tuple[DataFrame, list[float]]:
    """subtract the column mean; returns the centred table and the mean (d floats)."""
    mean = df.select(Summarizer.mean(array_to_vector(F.col(vec))).alias("m")).first()["m"]
    mean_list = [float(x) for x in mean.toArray()] if mean is not None else []
    mcol = F.array(*[F.lit(x) for x in mean_list])
    return df.withColumn(vec, Vx.sub(vec, mcol)), mean_list
