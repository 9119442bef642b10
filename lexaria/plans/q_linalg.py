"""Registered queries: linear algebra and post-processing.

PCA signs and eigen-solver details are not unique, so the PCA-based queries
return invariants (residual projections, preserved means, unit norms, zero
means) whose expected values the oracle states; SIF, covariance, clamps and
the linear projection are checked value by value.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from lexaria.functions import vectors as Vx
from lexaria.operators import encode as EN
from lexaria.operators import linalg as LA
from lexaria.plans import fixtures as FX
from lexaria.plans.catalog import register
from lexaria.functions.text import TOKEN_PATTERN
from lexaria.plans.oracle import P1_SQL, add_cte, with_ctes
from lexaria.plans.q_vectors import enc_sql, long_sql, spark_long


def _sent_vecs(spark, sf):
    """Sentence vectors for fitting: un-normalised mean encodings of all conversation turns."""
    t = FX.table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("sent_id"), "text")
    return EN.encode(t, FX.word2vec(spark, sf), key="sent_id", dim=FX.dim(spark, sf), normalize=False, on_empty="drop")


def _max_abs_projection(df, fit: LA.PcaFit, n: int, center: bool = False):
    comps = fit.components[:n]
    mean = fit.mean if center else np.zeros_like(fit.mean)
    comp_col = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in comps])
    mcol = F.array(*[F.lit(float(x)) for x in mean])
    centred = Vx.sub("vec", mcol)
    proj = F.transform(comp_col, lambda p: F.abs(Vx.dot(centred, p)))
    return F.array_max(proj)


@register("f03_covariance", with_ctes(["word2vec"], f"""
SELECT CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(covar_samp(a.value, b.value), 6) + 0.0 AS cov
FROM ({long_sql('word2vec', 'word')}) a JOIN ({long_sql('word2vec', 'word')}) b ON a.word = b.word
GROUP BY a.dim, b.dim"""))
def f03_covariance(spark, sf):
    """F3 input: the distributed sample covariance the PCA eigen-decomposes."""
    return LA.covariance(FX.word2vec(spark, sf)).withColumn("cov", Vx.round_col("cov"))


@register("f03_pca_components")
def f03_pca_components(spark, sf):
    """7 components of the sentence vectors: unit norm, ratios descending."""
    fit = LA.fit_pca(_sent_vecs(spark, sf), 7)
    rows = [(i, float(np.round(np.linalg.norm(c), 6)), float(r)) for i, (c, r) in
            enumerate(zip(fit.components, fit.ratios))]
    return spark.createDataFrame(rows, "pc int, norm double, ratio double")


@register("f03_pca_orthonormal", """
SELECT CAST(a.r AS INTEGER) AS i, CAST(b.r AS INTEGER) AS j, CASE WHEN a.r = b.r THEN 1.0 ELSE 0.0 END AS dot
FROM range(0, 7) a(r), range(0, 7) b(r)""")
def f03_pca_orthonormal(spark, sf):
    """the 7 components fitted on the sentence vectors are orthonormal (Gram matrix = I;
    sign-invariant, unlike the components themselves)."""
    fit = LA.fit_pca(_sent_vecs(spark, sf), 7)
    gram = fit.components @ fit.components.T  # 7 x 7
    rows = [(i, [float(np.round(x, 6)) + 0.0 for x in r]) for i, r in enumerate(gram)]
    g = spark.createDataFrame(rows, "i int, r array<double>")
    return g.select("i", F.posexplode("r").alias("j", "dot")).select("i", F.col("j").cast("int").alias("j"), "dot")


@register("f04_remove_components", with_ctes(["word2vec"], "SELECT word, 0.0 AS max_abs_proj FROM word2vec"))
def f04_remove_components(spark, sf):
    """after removing 7 sentence PCs, every word's projection on them is 0."""
    fit = LA.fit_pca(_sent_vecs(spark, sf), 7)
    out = LA.remove_components(FX.word2vec(spark, sf), fit, 7)
    return out.select("word", Vx.round_col(_max_abs_projection(out, fit, 7)).alias("max_abs_proj"))


@register("f05_all_but_the_top", with_ctes(["word2vec"], f"""
SELECT dim, round(avg(value), 6) + 0.0 AS mean FROM ({long_sql('word2vec', 'word')}) GROUP BY dim"""))
def f05_all_but_the_top(spark, sf):
    """centre, remove the top PC, add the mean back — the column means are preserved."""
    out = LA.all_but_the_top(FX.word2vec(spark, sf), 1)
    long = out.select(F.posexplode("vec").alias("dim", "value"))
    return long.groupBy("dim").agg(Vx.round_col(F.avg("value")).alias("mean")).select(
        F.col("dim").cast("bigint").alias("dim"), "mean")


@register("f05_residual", with_ctes(["word2vec"], "SELECT word, 0.0 AS max_abs_proj FROM word2vec"))
def f05_residual(spark, sf):
    """the centred output has no component along the removed direction."""
    w = FX.word2vec(spark, sf)
    fit = LA.fit_pca(w, 1)
    out = LA.all_but_the_top(w, 1)
    return out.select("word", Vx.round_col(_max_abs_projection(out, fit, 1, center=True)).alias("max_abs_proj"))


@register("f06_reduce_dims", "SELECT CAST(range AS BIGINT) AS dim, 0.0 AS mean FROM range(0, 16)")
def f06_reduce_dims(spark, sf):
    """centred projection to 16 dims — every output dimension has mean 0."""
    out, _ = LA.reduce_dims(FX.word2vec(spark, sf), 16)
    long = out.select(F.posexplode("vec").alias("dim", "value"))
    return long.groupBy("dim").agg(Vx.round_col(F.avg("value")).alias("mean")).select(
        F.col("dim").cast("bigint").alias("dim"), "mean")


SPECTRUM_SQL = """
SELECT round(sum(CASE WHEN i = j THEN c END), 6) + 0.0 AS trace, round(sum(c * c), 6) + 0.0 AS squares
FROM (SELECT a.dim AS i, b.dim AS j, covar_samp(a.value, b.value) AS c FROM ({long}) a JOIN ({long}) b USING ({key})
      GROUP BY a.dim, b.dim)"""


@register("f06_spectrum", with_ctes(["emb"], SPECTRUM_SQL.format(long=long_sql("emb", "vec_id"), key="vec_id")))
def f06_spectrum(spark, sf):
    """F6, sign-free: with all components kept, the variances of the reduced columns sum to the
    trace of the covariance, and their squares to its squared entries only if the columns are
    the principal axes."""
    out, _ = LA.reduce_dims(FX.embeddings(spark, sf).select("vec_id", "vec"), FX.dim(spark, sf))
    var = out.select(Summarizer.variance(array_to_vector("vec")).alias("v")).select(F.explode(vector_to_array("v")).alias("x"))
    return var.agg(Vx.round_col(F.sum("x")).alias("trace"), Vx.round_col(F.sum(F.col("x") * F.col("x"))).alias("squares"))


enc_sql("enc_fit", "turns", "conv_id, turn", "text", P1_SQL, normalize=False, on_empty="drop")


@register("f08_spectrum", with_ctes(["enc_fit"], SPECTRUM_SQL.format(long="SELECT * FROM enc_fit", key="conv_id, turn")))
def f08_spectrum(spark, sf):
    """F8, sign-free: the fitting sentences themselves, projected on all their components."""
    s = _sent_vecs(spark, sf)
    out = LA.historical_transform(s, s, 0, FX.dim(spark, sf))
    var = out.select(Summarizer.variance(array_to_vector("vec")).alias("v")).select(F.explode(vector_to_array("v")).alias("x"))
    return var.agg(Vx.round_col(F.sum("x")).alias("trace"), Vx.round_col(F.sum(F.col("x") * F.col("x"))).alias("squares"))


@register("f07_transform_embeddings", with_ctes(["word2vec"], "SELECT word, 16 AS dim, 1.0 AS norm FROM word2vec"))
def f07_transform_embeddings(spark, sf):
    """fit on sentences, remove 7 PCs from words, reduce to 16, L2 — unit 16-d vectors."""
    out = LA.transform_embeddings(FX.word2vec(spark, sf), _sent_vecs(spark, sf), 7, 16)
    return out.select("word", F.size("vec").alias("dim"), Vx.round_col(Vx.norm("vec")).alias("norm"))


@register("f08_historical_transform", with_ctes(["word2vec"], "SELECT word, 16 AS dim FROM word2vec"))
def f08_historical_transform(spark, sf):
    """F8: words projected on sentence components 7..22 (centred, not normalised)."""
    out = LA.historical_transform(FX.word2vec(spark, sf), _sent_vecs(spark, sf), 7, 16)
    return out.select("word", F.size("vec").alias("dim"))


@register("f10_variance_report")
def f10_variance_report(spark, sf):
    """cumulative explained variance at 1/3/all and the first i above 0.99."""
    fit = LA.fit_pca(FX.word2vec(spark, sf), 64)
    return LA.variance_report(fit, spark).withColumn("cum", Vx.round_col("cum"))


@register("f10_total_variance", with_ctes(["word2vec"], f"""
SELECT round(sum(v), 6) + 0.0 AS total_variance, 1.0 AS ratio_sum FROM (
  SELECT var_samp(value) AS v FROM ({long_sql('word2vec', 'word')}) GROUP BY dim)"""))
def f10_total_variance(spark, sf):
    """F10 invariant: a full PCA's explained-variance ratios sum to one, and the
    variance they divide is the trace of the covariance (sum of column variances)."""
    w = FX.word2vec(spark, sf)
    fit = LA.fit_pca(w, 64)
    var = w.select(Summarizer.variance(array_to_vector("vec")).alias("v")).first()["v"].toArray()
    return spark.createDataFrame([(float(np.round(var.sum(), 6)) + 0.0, float(np.round(fit.ratios.sum(), 6)) + 0.0)],
                                 "total_variance double, ratio_sum double")


# ---- SIF / post-processing ------------------------------------------------------------------

add_cte("sif_counts", ["vocab_all"], "SELECT word_idx AS token, freq AS n FROM vocab_all")
add_cte("sif", ["emb", "sif_counts"], """
SELECT token, list_transform(vec, lambda x: x * w) AS vec FROM (
  SELECT e.vec_id AS token, e.vec,
         CAST(CAST(coalesce(0.001 / (0.001 + c.n / t.total), 1.0) AS FLOAT) AS DOUBLE) AS w
  FROM emb e LEFT JOIN sif_counts c ON c.token = e.vec_id
  CROSS JOIN (SELECT CAST(sum(n) AS DOUBLE) AS total FROM sif_counts) t)""")


def _sif(spark, sf):
    counts = FX.counts(spark, sf)
    from lexaria.operators import vocabulary as V

    vocab_all = V.filter_vocabulary(counts, FX.MIN_FREQ, FX.MIN_LEN, None)
    c = vocab_all.select(F.col("word_idx").alias("token"), F.col("freq").alias("n"))
    e = FX.embeddings(spark, sf).select(F.col("vec_id").alias("token"), "vec")
    return e, c


@register("f11_sif_weighting", with_ctes(["sif"], f"""
SELECT token, dim, round(value, 6) + 0.0 AS value FROM ({long_sql('sif', 'token')})"""))
def f11_sif_weighting(spark, sf):
    """token ids = vocabulary index; counts beyond the table still enter the total."""
    e, c = _sif(spark, sf)
    return spark_long(LA.sif_weighting(e, c, 1e-3), ["token"])


@register("f12_post_process_sif_l2", with_ctes(["sif"], f"""
SELECT token, dim, round(value / (nrm + 1e-8), 6) + 0.0 AS value FROM
  (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY token)) AS nrm FROM ({long_sql('sif', 'token')}))"""))
def f12_post_process_sif_l2(spark, sf):
    """F12 with the PCA steps off: SIF then L2."""
    e, c = _sif(spark, sf)
    out = LA.post_process(e, c, apply_sif=True, apply_pca=False, remove_pc=False)
    return spark_long(out, ["token"])


@register("f12_post_process_full", with_ctes(["emb"], "SELECT vec_id AS token, 16 AS dim, 1.0 AS norm FROM emb"))
def f12_post_process_full(spark, sf):
    """F12 full chain: SIF -> PCA to 16 -> all-but-the-top -> L2 (unit 16-d rows)."""
    e, c = _sif(spark, sf)
    out = LA.post_process(e, c, pca_dims=16, remove_pc=True, n_pc_remove=1)
    # x / (|x| + 1e-8) leaves small rows a hair under 1: compare at 4 decimals
    return out.select("token", F.size("vec").alias("dim"), Vx.round_col(Vx.norm("vec"), 4).alias("norm"))


@register("f13_target_reduction", with_ctes(["emb"], "SELECT vec_id, 32 AS dim, 1.0 AS norm FROM emb"))
def f13_target_reduction(spark, sf):
    """PCA to min(32, n, d) then L2."""
    e = FX.embeddings(spark, sf).select("vec_id", "vec")
    out = LA.target_reduction(e, 32)
    return out.select("vec_id", F.size("vec").alias("dim"), Vx.round_col(Vx.norm("vec")).alias("norm"))


add_cte("enc_drop_plain", ["turns", "word2vec"], f"""
SELECT DISTINCT t.conv_id, t.turn FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS w FROM turns) t
JOIN word2vec e ON e.word = t.w OR e.word = lower(t.w)
WHERE t.w NOT IN ({P1_SQL})""")


@register("f14_dimension_clamps", with_ctes(["enc_drop_plain"], """
SELECT CAST(least(7, n // 2) AS BIGINT) AS n_remove, CAST(least(256, n - 1, 64 - least(7, n // 2)) AS BIGINT) AS output_dim
FROM (SELECT count(*) AS n FROM enc_drop_plain)"""))
def f14_dimension_clamps(spark, sf):
    """clamps from the number of fitting sentences and the raw dimension."""
    n = _sent_vecs(spark, sf).count()
    nr, out = LA.dimension_clamps(n, FX.dim(spark, sf), 7, 256)
    return spark.createDataFrame([(nr, out)], "n_remove bigint, output_dim bigint")


@register("f14_end_to_end_clamps", with_ctes(["enc_drop_plain", "vocab"], """
SELECT CAST(least(7, m // 2) AS BIGINT) AS n_remove, CAST(least(256, m - 1) AS BIGINT) AS output_dim
FROM (SELECT least((SELECT count(*) FROM vocab), (SELECT count(*) FROM enc_drop_plain),
                   (SELECT max(len(embedding)) FROM embeddings)) AS m)"""))
def f14_end_to_end_clamps(spark, sf):
    """clamps of the end-to-end run from words, sentences and raw dimension."""
    nr, out = LA.end_to_end_clamps(FX.n_words(spark, sf), _sent_vecs(spark, sf).count(), FX.dim(spark, sf))
    return spark.createDataFrame([(nr, out)], "n_remove bigint, output_dim bigint")


# ---- F15 student projection ----------------------------------------------------------------

add_cte("label_means", ["emb"], f"""
SELECT CAST(label AS BIGINT) AS r, dim, avg(value) AS w FROM ({long_sql('emb', 'label')}) GROUP BY label, dim""")


@register("f15_student_projection", with_ctes(["enc_sum", "turns", "label_means"], """
SELECT conv_id, turn, r AS dim, round(y / greatest(nrm, 1e-12), 6) + 0.0 AS value FROM (
  SELECT conv_id, turn, r, y, sqrt(sum(y * y) OVER (PARTITION BY conv_id, turn)) AS nrm FROM (
    SELECT m.conv_id, m.turn, l.r, sum(l.w * m.value) AS y
    FROM (SELECT s.conv_id, s.turn, s.dim, s.value / c.n AS value
          FROM enc_sum s JOIN (SELECT conv_id, turn, count(*) AS n FROM enc_sum_h GROUP BY conv_id, turn) c
          USING (conv_id, turn)) m
    JOIN label_means l ON l.dim = m.dim
    GROUP BY m.conv_id, m.turn, l.r)
  UNION ALL
  SELECT t.conv_id, t.turn, l.r, 0.0, 0.0 FROM turns t CROSS JOIN (SELECT DISTINCT r FROM label_means) l
  WHERE NOT EXISTS (SELECT 1 FROM enc_sum_h h WHERE h.conv_id = t.conv_id AND h.turn = t.turn))
"""))
def f15_student_projection(spark, sf):
    """mean of token vectors -> linear layer (rows = per-label mean vectors) -> L2 clamp."""
    e = FX.embeddings(spark, sf)
    means = e.groupBy("label").agg(Summarizer.mean(array_to_vector("vec")).alias("m")).orderBy(
        "label").collect()  # one row per label: a bounded parameter (labels x d)
    weight_rows = [list(r["m"].toArray()) for r in means]
    t = FX.table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("sent_id"), "text")
    enc = EN.encode(t, FX.word2vec(spark, sf), key="sent_id", dim=FX.dim(spark, sf), normalize=False)
    out = EN.project(enc, weight_rows).select(
        F.col("sent_id.conv_id").alias("conv_id"), F.col("sent_id.turn").alias("turn"), "vec")
    return spark_long(out, ["conv_id", "turn"])


@register("f16_vector_output", with_ctes(["vocab", "emb"], f"""
SELECT word_idx, word, dim, round(value, 6) + 0.0 AS value FROM
  ({long_sql('(SELECT v.word_idx, v.word, e.vec FROM vocab v JOIN emb e ON e.vec_id = v.word_idx % (SELECT count(*) FROM embeddings))', 'word_idx, word')})"""))
def f16_vector_output(spark, sf):
    """F16: the table's vectors aligned with the vocabulary index."""
    v = FX.vocab(spark, sf)
    e = FX.embeddings(spark, sf)
    j = v.join(e, FX.vector_of(v.word_idx, spark, sf) == e.vec_id).select("word_idx", "word", "vec")
    return spark_long(j, ["word_idx", "word"])


@register("b11_pca_parameters", """
SELECT CAST(r AS INTEGER) AS pc, CAST((SELECT max(len(embedding)) FROM embeddings) AS INTEGER) AS dim,
       true AS roundtrip_ok FROM range(-1, 7) t(r)""")
def b11_pca_parameters(spark, sf):
    """Persist the fitted PCA as a tiny Parquet table and read it back."""
    from lexaria.session import stage_path

    fit = LA.fit_pca(_sent_vecs(spark, sf), 7)
    path = stage_path(spark, "b11_pca_params")
    fit.to_frame(spark).write.mode("overwrite").parquet(path)
    back = LA.PcaFit.from_frame(spark.read.parquet(path))
    ok = bool(np.allclose(back.components, fit.components) and np.allclose(back.mean, fit.mean))
    return spark.read.parquet(path).select("pc", F.size("loading").alias("dim"), F.lit(ok).alias("roundtrip_ok"))
