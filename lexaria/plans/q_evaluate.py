"""Registered queries: evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.functions import vectors as Vx
from lexaria.operators import evaluate as EV
from lexaria.plans import fixtures as FX
from lexaria.plans.catalog import register
from lexaria.plans.oracle import add_cte, gold, with_ctes


def corr_sql(src: str, group: str, x: str, y: str) -> str:
    """Pearson and Spearman (average ranks) per group, as a DuckDB select."""
    return f"""
SELECT {group}, CAST(count(*) AS BIGINT) AS n,
       covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) AS pearson,
       covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS spearman
FROM (SELECT *,
        rank() OVER (PARTITION BY {group} ORDER BY {x}) + (count(*) OVER (PARTITION BY {group}, {x}) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY {group} ORDER BY {y}) + (count(*) OVER (PARTITION BY {group}, {y}) - 1) / 2.0 AS ry
      FROM {src})
GROUP BY {group}"""


def r(c: str) -> str:
    return f"round({c}, 6) + 0.0"


# ---- E18 / E19 on raw columns (with ties) --------------------------------------------------

add_cte("xy", ["emb"], """
SELECT 'w' || CAST(label AS VARCHAR) AS dataset, vec_id AS pair_id,
       round(vec[1], 2) AS pred, round(vec[2], 2) AS gold FROM emb""")


@register(
    "e19_spearman_pearson",
    with_ctes(["xy"], f"SELECT dataset, n, {r('pearson')} AS pearson, {r('spearman')} AS spearman FROM ("
                      + corr_sql("xy", "dataset", "pred", "gold") + ")"),
)
def e19_spearman_pearson(spark, sf):
    """E18 + E19 per label on rounded vector coordinates (many ties)."""
    e = FX.embeddings(spark, sf).select(
        F.concat(F.lit("w"), F.col("label").cast("string")).alias("dataset"),
        F.col("vec_id").alias("pair_id"),
        F.round(F.col("vec")[0], 2).alias("pred"),
        F.round(F.col("vec")[1], 2).alias("gold"),
    )
    c = EV.correlations(e, ["dataset"])
    return c.select("dataset", "n", Vx.round_col("pearson").alias("pearson"), Vx.round_col("spearman").alias("spearman"))


add_cte("xy_const", ["emb"], """
SELECT 'w' || CAST(label AS VARCHAR) AS dataset, vec_id AS pair_id, 1.0 AS pred, round(vec[2], 2) AS gold FROM emb""")


@register(
    "e18_pearson_constant",
    with_ctes(["xy_const"], f"SELECT dataset, n, {r('pearson')} AS pearson, {r('spearman')} AS spearman FROM ("
                            + corr_sql("xy_const", "dataset", "pred", "gold") + ")"),
)
def e18_pearson_constant(spark, sf):
    """E18 guard: a constant side gives null, not an error."""
    e = FX.embeddings(spark, sf).select(
        F.concat(F.lit("w"), F.col("label").cast("string")).alias("dataset"),
        F.col("vec_id").alias("pair_id"), F.lit(1.0).alias("pred"), F.round(F.col("vec")[1], 2).alias("gold"),
    )
    c = EV.correlations(e, ["dataset"])
    return c.select("dataset", "n", Vx.round_col("pearson").alias("pearson"), Vx.round_col("spearman").alias("spearman"))


# ---- E20 word similarity ---------------------------------------------------------------

add_cte("wp_ds", ["word_pairs"], f"""
SELECT CASE WHEN pair_id % 2 = 0 THEN 'set_a' ELSE 'set_b' END AS dataset, pair_id // 2 AS pair_id, a, b, gold FROM word_pairs""")


def _ds_pairs(spark, sf):
    # two datasets, each numbered from 0
    p = FX.word_pairs(spark, sf)
    return p.select(
        F.when(F.col("pair_id") % 2 == 0, "set_a").otherwise("set_b").alias("dataset"),
        F.floor(F.col("pair_id") / 2).cast("bigint").alias("pair_id"), "a", "b", "gold",
    )


add_cte("wsim_found", ["wp_ds", "word2vec"], """
SELECT p.dataset, p.pair_id, p.gold,
       list_reduce(list_transform(list_zip(x, y), lambda z: z[1] * z[2]), lambda a, b: a + b) AS pred
FROM (SELECT p.*, list_transform(coalesce(ea.vec, la.vec), lambda v: v / (nx + 1e-8)) AS x,
             list_transform(coalesce(eb.vec, lb.vec), lambda v: v / (ny + 1e-8)) AS y
      FROM (SELECT p.*, 0 AS _z FROM wp_ds p) p
      LEFT JOIN word2vec ea ON ea.word = p.a LEFT JOIN word2vec la ON la.word = lower(p.a)
      LEFT JOIN word2vec eb ON eb.word = p.b LEFT JOIN word2vec lb ON lb.word = lower(p.b)
      CROSS JOIN LATERAL (SELECT sqrt(list_reduce(list_transform(coalesce(ea.vec, la.vec), lambda v: v * v), lambda a, b: a + b)) AS nx,
                                 sqrt(list_reduce(list_transform(coalesce(eb.vec, lb.vec), lambda v: v * v), lambda a, b: a + b)) AS ny)
      WHERE coalesce(ea.vec, la.vec) IS NOT NULL AND coalesce(eb.vec, lb.vec) IS NOT NULL) p""")

WSIM_SQL = f"""
SELECT t.dataset, t.n_pairs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_found,
       {r('coalesce(c.n, 0) / t.n_pairs')} AS coverage,
       {r('CASE WHEN coalesce(c.n, 0) < 2 THEN 0.0 ELSE c.spearman END')} AS spearman,
       {r('CASE WHEN coalesce(c.n, 0) < 2 THEN 0.0 ELSE c.pearson END')} AS pearson
FROM (SELECT dataset, CAST(count(*) AS BIGINT) AS n_pairs FROM wp_ds GROUP BY dataset) t
LEFT JOIN ({corr_sql('wsim_found', 'dataset', 'pred', 'gold')}) c ON c.dataset = t.dataset"""


def _round_metrics(df, cols):
    return df.select(*[Vx.round_col(c).alias(c) if c in cols else c for c in df.columns])


@register("e20_word_similarity", with_ctes(["wp_ds", "wsim_found"], WSIM_SQL))
def e20_word_similarity(spark, sf):
    out = EV.word_similarity(_ds_pairs(spark, sf), FX.word2vec(spark, sf), dim=FX.dim(spark, sf))
    return _round_metrics(out, ["coverage", "spearman", "pearson"])


# ---- E22 STS ---------------------------------------------------------------------------

add_cte("sts_pairs", ["conv_pairs"], f"""
SELECT 'sts_a' AS dataset, pair_id, a, b, gold FROM conv_pairs
UNION ALL SELECT 'sts_b', pair_id, b, a, {gold('pair_id', "'ds'")} FROM conv_pairs""")
add_cte("sts_scored", ["sts_pairs", "enc_pairs"], """
SELECT p.dataset, p.pair_id, p.gold, coalesce(s.sim, 0.0) AS pred FROM sts_pairs p LEFT JOIN
  (SELECT a.pair_id, sum(a.value * b.value) AS sim FROM enc_pairs a JOIN enc_pairs b
     ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.dim = b.dim GROUP BY a.pair_id) s
  ON s.pair_id = p.pair_id""")

STS_SQL = f"""
SELECT dataset, n AS n_pairs, {r('CASE WHEN n < 2 THEN 0.0 ELSE spearman END')} AS spearman,
       {r('CASE WHEN n < 2 THEN 0.0 ELSE pearson END')} AS pearson
FROM ({corr_sql('sts_scored', 'dataset', 'pred', 'gold')})"""


def _sts_pairs(spark, sf):
    p = FX.conversation_pairs(spark, sf)
    # two datasets that share their pair ids
    return p.select(F.lit("sts_a").alias("dataset"), "pair_id", "a", "b", "gold").unionByName(p.select(
        F.lit("sts_b").alias("dataset"), "pair_id", F.col("b").alias("a"), F.col("a").alias("b"),
        T.hash_gold(F.col("pair_id"), F.lit("ds")).alias("gold")))


@register("e22_sts", with_ctes(["sts_scored"], STS_SQL))
def e22_sts(spark, sf):
    out = EV.sts(_sts_pairs(spark, sf), FX.word2vec(spark, sf), dim=FX.dim(spark, sf))
    return _round_metrics(out, ["spearman", "pearson"])


# ---- D9 comparison -----------------------------------------------------------------------

add_cte("wsim_base_found", ["wp_ds", "w2v_shift"], """
SELECT p.dataset, p.pair_id, p.gold,
       list_reduce(list_transform(list_zip(x, y), lambda z: z[1] * z[2]), lambda a, b: a + b) AS pred
FROM (SELECT p.*, list_transform(coalesce(ea.vec, la.vec), lambda v: v / (nx + 1e-8)) AS x,
             list_transform(coalesce(eb.vec, lb.vec), lambda v: v / (ny + 1e-8)) AS y
      FROM wp_ds p
      LEFT JOIN w2v_shift ea ON ea.word = p.a LEFT JOIN w2v_shift la ON la.word = lower(p.a)
      LEFT JOIN w2v_shift eb ON eb.word = p.b LEFT JOIN w2v_shift lb ON lb.word = lower(p.b)
      CROSS JOIN LATERAL (SELECT sqrt(list_reduce(list_transform(coalesce(ea.vec, la.vec), lambda v: v * v), lambda a, b: a + b)) AS nx,
                                 sqrt(list_reduce(list_transform(coalesce(eb.vec, lb.vec), lambda v: v * v), lambda a, b: a + b)) AS ny)
      WHERE coalesce(ea.vec, la.vec) IS NOT NULL AND coalesce(eb.vec, lb.vec) IS NOT NULL) p""")

D9_SQL = f"""
WITH_PLACEHOLDER
SELECT dataset, {r('ours')} AS ours, {r('baseline')} AS baseline, {r('delta')} AS delta, {r('retention')} AS retention FROM (
  SELECT coalesce(o.dataset, b.dataset) AS dataset, o.spearman AS ours, b.spearman AS baseline,
         o.spearman - b.spearman AS delta, o.spearman / nullif(b.spearman, 0) AS retention
  FROM ({corr_sql('wsim_found', 'dataset', 'pred', 'gold')}) o
  FULL OUTER JOIN ({corr_sql('wsim_base_found', 'dataset', 'pred', 'gold')}) b ON o.dataset = b.dataset
  UNION ALL
  SELECT 'MEAN', avg(o.spearman), avg(b.spearman), avg(o.spearman - b.spearman), NULL
  FROM ({corr_sql('wsim_found', 'dataset', 'pred', 'gold')}) o
  FULL OUTER JOIN ({corr_sql('wsim_base_found', 'dataset', 'pred', 'gold')}) b ON o.dataset = b.dataset)"""


def _d9_sql():
    body = D9_SQL.replace("WITH_PLACEHOLDER", "")
    return with_ctes(["wsim_found", "wsim_base_found"], body)


@register("d09_compare_models", _d9_sql())
def d09_compare_models(spark, sf):
    """Word-similarity Spearman of the vocabulary vectors vs a shifted baseline."""
    v = FX.vocab(spark, sf)
    e = FX.embeddings(spark, sf)
    base_vectors = v.join(e, e.vec_id == FX.vector_of(v.word_idx, spark, sf, 1)).select("word", "vec")
    pairs = _ds_pairs(spark, sf)
    ours = EV.word_similarity(pairs, FX.word2vec(spark, sf), dim=FX.dim(spark, sf))
    base = EV.word_similarity(pairs, base_vectors, dim=FX.dim(spark, sf))
    # the comparison reports the raw correlations (no <2 guard is involved at this size)
    out = EV.compare_models(ours, base)
    return _round_metrics(out, ["ours", "baseline", "delta", "retention"])


# ---- E21 encoder-based word evaluation --------------------------------------------------

E21_SQL = f"""
SELECT t.dataset,
       {r('CASE WHEN coalesce(c.n, 0) < 2 THEN 0.0 ELSE c.spearman END')} AS spearman,
       {r('CASE WHEN coalesce(c.n, 0) < 2 THEN 0.0 ELSE c.n / t.n_pairs END')} AS coverage,
       CAST(CASE WHEN coalesce(c.n, 0) < 2 THEN 0 ELSE c.n END AS BIGINT) AS n_found
FROM (SELECT dataset, count(*) AS n_pairs FROM wp_ds GROUP BY dataset) t
LEFT JOIN ({corr_sql('wsim_found', 'dataset', 'pred', 'gold')}) c ON c.dataset = t.dataset"""


@register("e21_encoder_word_similarity", with_ctes(["wp_ds", "wsim_found"], E21_SQL))
def e21_encoder_word_similarity(spark, sf):
    """Words encoded as one-word sentences; OOV pairs skipped (static model)."""
    out = EV.encoder_word_similarity(_ds_pairs(spark, sf), FX.word2vec(spark, sf),
                                     dim=FX.dim(spark, sf))
    return _round_metrics(out, ["spearman", "coverage"])


# ---- A11 / A12 / A13 / A17 staged benchmark relations -----------------------------------

add_cte("staged_words", ["wp_ds"], """
SELECT pair_id, a AS word1, b AS word2, round(gold * 10, 2) AS score,
       CASE WHEN dataset = 'set_a' THEN 'WordSim353-rel' ELSE 'simlex' END AS dataset, gold AS similarity
FROM wp_ds""")


def _staged_words(spark, sf):
    p = _ds_pairs(spark, sf)
    return p.select(
        "pair_id", F.col("a").alias("word1"), F.col("b").alias("word2"),
        F.round(F.col("gold") * 10, 2).alias("score"),
        F.when(F.col("dataset") == "set_a", "WordSim353-rel").otherwise("simlex").alias("dataset"),
        F.col("gold").alias("similarity"),
    )


@register("a11_simlex_pairs", with_ctes(["staged_words"], f"""
SELECT 'SimLex-999' AS dataset, pair_id, word1 AS a, word2 AS b, {r('score / 10.0')} AS gold FROM staged_words"""))
def a11_simlex_pairs(spark, sf):
    out = EV.simlex_pairs(_staged_words(spark, sf))
    return out.withColumn("gold", Vx.round_col("gold"))


@register("a12_wordsim_pairs", with_ctes(["staged_words"], f"""
SELECT 'WordSim-353' AS dataset, pair_id, word1 AS a, word2 AS b, {r('similarity')} AS gold
FROM staged_words WHERE contains(lower(dataset), 'wordsim')"""))
def a12_wordsim_pairs(spark, sf):
    out = EV.wordsim_pairs(_staged_words(spark, sf))
    return out.withColumn("gold", Vx.round_col("gold"))


add_cte("staged_sts", ["conv_pairs"], f"""
SELECT pair_id, a AS sentence1, b AS sentence2, round(gold * 5, 3) AS score,
       CASE WHEN {gold('pair_id', "'split'")} < 0.7 THEN 'train' ELSE 'test' END AS split FROM conv_pairs""")


@register("a13_sts_pairs", with_ctes(["staged_sts"], f"""
SELECT 'STS-B' AS dataset, pair_id, sentence1 AS a, sentence2 AS b, {r('score / 5.0')} AS gold
FROM staged_sts WHERE split = 'test'"""))
def a13_sts_pairs(spark, sf):
    p = FX.conversation_pairs(spark, sf)
    staged = p.select(
        "pair_id", F.col("a").alias("sentence1"), F.col("b").alias("sentence2"),
        F.round(F.col("gold") * 5, 3).alias("score"),
        F.when(T.hash_gold(F.col("pair_id"), F.lit("split")) < 0.7, "train").otherwise("test").alias("split"),
    )
    return EV.sts_pairs(staged, "test").withColumn("gold", Vx.round_col("gold"))


@register("a17_benchmark_inventory", with_ctes(["staged_words", "staged_sts"], """
SELECT dataset, CAST(count(*) AS BIGINT) AS n_rows, count(*) > 0 AS ok FROM (
  SELECT 'SimLex-999' AS dataset FROM staged_words
  UNION ALL SELECT 'WordSim-353' FROM staged_words WHERE contains(lower(dataset), 'wordsim')
  UNION ALL SELECT 'STS-B' FROM staged_sts WHERE split = 'test')
GROUP BY dataset"""))
def a17_benchmark_inventory(spark, sf):
    w = _staged_words(spark, sf)
    p = FX.conversation_pairs(spark, sf)
    staged = p.select(
        "pair_id", F.col("a").alias("sentence1"), F.col("b").alias("sentence2"),
        F.round(F.col("gold") * 5, 3).alias("score"),
        F.when(T.hash_gold(F.col("pair_id"), F.lit("split")) < 0.7, "train").otherwise("test").alias("split"),
    )
    return EV.benchmark_inventory(EV.simlex_pairs(w), EV.wordsim_pairs(w), EV.sts_pairs(staged, "test"))
