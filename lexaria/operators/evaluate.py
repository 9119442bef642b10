"""Similarity evaluation (E18-E22, D9) and benchmark relations.

Pairs are ``(dataset, pair_id, a, b, gold)``.  Correlations are one grouped
aggregate per dataset; Spearman ranks come from a distributed global index
(average rank for ties), never from an un-partitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaria.functions import vectors as Vx
from lexaria.functions.ordering import average_rank
from lexaria.operators import encode as EN

# ---------------------------------------------------------------------------
# The reference's inline synthetic benchmark pairs.
# ---------------------------------------------------------------------------
SYNTHETIC_WORD_PAIRS = [
    ("car", "automobile", 0.9),
    ("happy", "joyful", 0.9),
    ("big", "large", 0.85),
    ("fast", "quick", 0.85),
    ("smart", "intelligent", 0.9),
    ("car", "vehicle", 0.7),
    ("dog", "animal", 0.6),
    ("book", "read", 0.5),
    ("water", "drink", 0.5),
    ("car", "banana", 0.1),
    ("happy", "table", 0.05),
    ("dog", "computer", 0.1),
    ("book", "mountain", 0.1),
    ("water", "philosophy", 0.05),
]
SYNTHETIC_SENTENCE_PAIRS = [
    ("The cat sat on the mat.", "A cat was sitting on a mat.", 0.9),
    ("I love programming.", "I enjoy coding.", 0.85),
    ("The weather is nice today.", "It's a beautiful day.", 0.8),
    ("The dog is running.", "The cat is sleeping.", 0.3),
    ("I went to the store.", "She visited the market.", 0.5),
    ("He plays guitar.", "She sings songs.", 0.4),
    ("The sun is shining.", "Mathematics is difficult.", 0.1),
    ("I like pizza.", "The stock market crashed.", 0.05),
    ("Trees are green.", "Computers process data.", 0.1),
]


def pearson_expr(x: str, y: str):
    """Pearson r; null (not an error) when either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def with_average_ranks(df: DataFrame, group: list[str], x: str, y: str, key: str) -> DataFrame:
    """Average ranks (ties share the mean rank) of ``x`` and ``y`` inside ``group``."""
    rx = average_rank(df, x, group, [key], "_rx")
    return average_rank(rx, y, group, [key], "_ry")


def correlations(scored: DataFrame, group: list[str], pred: str = "pred", gold: str = "gold",
                 key: str = "pair_id") -> DataFrame:
    """E18 + E19 per group: ``(group..., n, spearman, pearson)``."""
    # every aggregate reads the checkpointed, ranked rows: the scored input is
    # computed once, not once per correlation
    ranked = with_average_ranks(scored, group, pred, gold, key)
    return ranked.groupBy(*group).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        pearson_expr(pred, gold).alias("pearson"),
        pearson_expr("_rx", "_ry").alias("spearman"),
    )


def _guard(df: DataFrame, n_col: str) -> DataFrame:
    """Fewer than two scored pairs -> both correlations 0.0."""
    small = F.coalesce(F.col(n_col), F.lit(0)) < 2
    return df.withColumn("spearman", F.when(small, F.lit(0.0)).otherwise(F.col("spearman"))).withColumn(
        "pearson", F.when(small, F.lit(0.0)).otherwise(F.col("pearson"))
    )


def word_similarity(pairs: DataFrame, word_vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Per dataset ``n_pairs, n_found, coverage, spearman, pearson``."""
    la = EN.lookup(pairs, word_vectors, "a").withColumnRenamed("vec", "va")
    lb = EN.lookup(la, word_vectors, "b").withColumnRenamed("vec", "vb")
    found = lb.where(F.col("va").isNotNull() & F.col("vb").isNotNull()).select(
        "dataset", "pair_id", "gold", Vx.cosine("va", "vb").alias("pred")
    )
    totals = pairs.groupBy("dataset").agg(F.count(F.lit(1)).cast("bigint").alias("n_pairs"))
    corr = correlations(found, ["dataset"])
    out = totals.join(corr, "dataset", "left").select(
        "dataset", "n_pairs",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_found"),
        (F.coalesce("n", F.lit(0)) / F.col("n_pairs")).alias("coverage"),
        "spearman", "pearson",
    )
    return _guard(out, "n_found")


def sts(pairs: DataFrame, word_vectors: DataFrame, dim: int | None = None,
        **kw) -> DataFrame:
    """Every pair is scored (all-OOV sides give 0 and still count)."""
    key = ["dataset", "pair_id"]
    sims = EN.pair_similarity(pairs.select(*key, "a", "b"), word_vectors, dim=dim, key=key, **kw)
    scored = pairs.select(*key, "gold").join(sims.withColumnRenamed("sim", "pred"), key)
    corr = correlations(scored, ["dataset"])
    out = corr.select("dataset", F.col("n").alias("n_pairs"), "spearman", "pearson")
    return _guard(out, "n_pairs")


def encoder_word_similarity(pairs: DataFrame, word_vectors: DataFrame, is_transformer: bool = False,
                            dim: int | None = None) -> DataFrame:
    """Words scored through the sentence encoder; static models skip OOV words.

    Output per dataset ``(spearman, coverage, n_found)``; fewer than 2 -> 0, 0, 0.
    """
    p = pairs
    if not is_transformer:
        la = EN.lookup(p, word_vectors, "a").withColumnRenamed("vec", "va")
        lb = EN.lookup(la, word_vectors, "b").withColumnRenamed("vec", "vb")
        p = lb.where(F.col("va").isNotNull() & F.col("vb").isNotNull()).drop("va", "vb")
    key = ["dataset", "pair_id"]
    sims = EN.pair_similarity(p.select(*key, "a", "b"), word_vectors, dim=dim, key=key)
    scored = p.select(*key, "gold").join(sims.withColumnRenamed("sim", "pred"), key)
    corr = correlations(scored, ["dataset"])
    totals = pairs.groupBy("dataset").agg(F.count(F.lit(1)).alias("_total"))
    out = totals.join(corr, "dataset", "left")
    small = F.coalesce(F.col("n"), F.lit(0)) < 2
    return out.select(
        "dataset",
        F.when(small, F.lit(0.0)).otherwise(F.col("spearman")).alias("spearman"),
        F.when(small, F.lit(0.0)).otherwise(F.col("n") / F.col("_total")).alias("coverage"),
        F.when(small, F.lit(0)).otherwise(F.col("n")).cast("bigint").alias("n_found"),
    )


def compare_models(ours: DataFrame, baseline: DataFrame, metric: str = "spearman") -> DataFrame:
    """Per dataset ours vs baseline and delta (missing side -> null), plus the mean row."""
    o = ours.select("dataset", F.col(metric).alias("ours"))
    b = baseline.select("dataset", F.col(metric).alias("baseline"))
    j = o.join(b, "dataset", "full_outer").select(
        "dataset", "ours", "baseline", (F.col("ours") - F.col("baseline")).alias("delta"),
        F.try_divide(F.col("ours"), F.col("baseline")).alias("retention"),
    )
    mean = j.agg(
        F.lit("MEAN").alias("dataset"), F.avg("ours").alias("ours"), F.avg("baseline").alias("baseline"),
        F.avg("delta").alias("delta"), F.lit(None).cast("double").alias("retention"),
    )
    return j.unionByName(mean)


# --------------------------------------------------------------------------- benchmark relations

def simlex_pairs(staged: DataFrame) -> DataFrame:
    """gold = score / 10."""
    return staged.select(F.lit("SimLex-999").alias("dataset"), "pair_id", F.col("word1").alias("a"),
                         F.col("word2").alias("b"), (F.col("score") / 10.0).alias("gold"))


def wordsim_pairs(staged: DataFrame) -> DataFrame:
    """Rows whose ``dataset`` contains 'wordsim' (case-insensitive)."""
    return staged.where(F.lower("dataset").contains("wordsim")).select(
        F.lit("WordSim-353").alias("dataset"), "pair_id", F.col("word1").alias("a"),
        F.col("word2").alias("b"), F.col("similarity").alias("gold"))


def sts_pairs(staged: DataFrame, split: str = "test", scale: float = 5.0) -> DataFrame:
    """Pairs of one split, gold = score / 5 (``scale=1`` keeps the raw score)."""
    return staged.where(F.col("split") == split).select(
        F.lit("STS-B").alias("dataset"), "pair_id", F.col("sentence1").alias("a"),
        F.col("sentence2").alias("b"), (F.col("score") / scale).alias("gold"))


def synthetic_word_pairs(spark: SparkSession) -> DataFrame:
    """The inline synthetic word pairs."""
    rows = [("synthetic", i, a, b, g) for i, (a, b, g) in enumerate(SYNTHETIC_WORD_PAIRS)]
    return spark.createDataFrame(rows, "dataset string, pair_id long, a string, b string, gold double")


def synthetic_sentence_pairs(spark: SparkSession) -> DataFrame:
    """The inline synthetic sentence pairs."""
    rows = [("synthetic", i, a, b, g) for i, (a, b, g) in enumerate(SYNTHETIC_SENTENCE_PAIRS)]
    return spark.createDataFrame(rows, "dataset string, pair_id long, a string, b string, gold double")


def benchmark_inventory(*tables: DataFrame) -> DataFrame:
    """Rows available per benchmark and a success flag (rows > 0)."""
    u = tables[0].select("dataset")
    for t in tables[1:]:
        u = u.unionByName(t.select("dataset"))
    return u.groupBy("dataset").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).withColumn(
        "ok", F.col("n_rows") > 0
    )
