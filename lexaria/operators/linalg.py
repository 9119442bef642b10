"""Principal components and post-processing.

Fitting is Spark ML ``PCA`` (a distributed covariance via tree aggregation;
only the d x d matrix and the k x d components reach the driver).  Applying
components is an Arrow-batched ``pandas_udf`` doing one NumPy matrix product
per batch — the k x d parameters travel with the task closure, the rows never
leave the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.functions import vectors as Vx


@dataclass
class PcaFit:
    """Fitted parameters: ``mean`` (d), ``components`` (k x d, rows), ``ratios`` (k)."""

    mean: np.ndarray
    components: np.ndarray
    ratios: np.ndarray

    def to_frame(self, spark) -> DataFrame:
        """The parameters as a tiny table ``(pc, loading, ratio)`` plus mean row pc=-1."""
        rows = [(-1, [float(x) for x in self.mean], None)]
        rows += [(i, [float(x) for x in c], float(r)) for i, (c, r) in enumerate(zip(self.components, self.ratios))]
        return spark.createDataFrame(rows, "pc int, loading array<double>, ratio double")

    @staticmethod
    def from_frame(df: DataFrame) -> "PcaFit":
        rows = sorted(df.collect(), key=lambda r: r["pc"])  # k+1 rows: bounded by the dimension
        mean = np.array(rows[0]["loading"])
        comps = np.array([r["loading"] for r in rows[1:]])
        ratios = np.array([r["ratio"] for r in rows[1:]])
        return PcaFit(mean, comps, ratios)


def _sign_fix(components: np.ndarray) -> np.ndarray:
    """Deterministic signs: each component's largest-magnitude loading is positive."""
    out = components.copy()
    for i in range(out.shape[0]):
        j = int(np.argmax(np.abs(out[i])))
        if out[i, j] < 0:
            out[i] = -out[i]
    return out


def fit_pca(df: DataFrame, k: int, vec: str = "vec") -> PcaFit:
    """PCA on the (centred) rows; components are covariance eigenvectors."""
    # the fit makes several passes (column statistics, Gramian, mean): keep the
    # input rows for its duration instead of recomputing the upstream plan
    v = df.select(array_to_vector(F.col(vec)).alias("_v")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
        comps = _sign_fix(np.asarray(model.pc.toArray()).T)  # k x d
        ratios = np.asarray(model.explainedVariance.toArray())
        mean_row = v.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"]
    finally:
        v.unpersist()
    return PcaFit(np.asarray(mean_row.toArray()), comps, ratios)


def covariance(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Sample covariance entries ``(i, j, cov)``: distributed Pearson matrix times the
    per-dimension standard deviations (only d x d numbers reach the driver)."""
    from pyspark.ml.stat import Correlation

    spark = df.sparkSession
    v = df.select(array_to_vector(F.col(vec)).alias("_v")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        corr = np.asarray(Correlation.corr(v, "_v").first()[0].toArray())
        var = np.asarray(v.select(Summarizer.variance(F.col("_v")).alias("s")).first()["s"].toArray())
    finally:
        v.unpersist()
    std = np.sqrt(var)
    cov = np.nan_to_num(corr) * np.outer(std, std)
    # d rows of d values (the matrix Spark ML already holds on the driver); the
    # long form is produced by Spark
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(cov)]
    mat = spark.createDataFrame(rows, "i int, r array<double>")
    return mat.select("i", F.posexplode("r").alias("j", "cov")).select("i", F.col("j").cast("int").alias("j"), "cov")


def _apply(df: DataFrame, vec: str, fn, out: str | None = None) -> DataFrame:
    """Row-wise NumPy matrix function over Arrow batches."""

    @F.pandas_udf("array<double>")
    def udf(s: pd.Series) -> pd.Series:
        if len(s) == 0:
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in s.values])
        y = fn(x)
        return pd.Series(list(y))

    return df.withColumn(out or vec, udf(F.col(vec)))


def remove_components(df: DataFrame, fit: PcaFit, n_remove: int | None = None, vec: str = "vec") -> DataFrame:
    """``v - Σ (v·p) p`` over the top ``n_remove`` components, sequentially, uncentred."""
    comps = fit.components[: (n_remove if n_remove is not None else fit.components.shape[0])]

    def fn(x):
        for p in comps:
            x = x - np.outer(x @ p, p)
        return x

    return _apply(df, vec, fn)


def project(df: DataFrame, fit: PcaFit, k: int | None = None, vec: str = "vec", center: bool = True,
            start: int = 0) -> DataFrame:
    """F6 transform: ``(v - mean) · C[start:start+k]ᵀ``."""
    comps = fit.components[start: start + (k if k is not None else fit.components.shape[0])]
    mean = fit.mean if center else np.zeros_like(fit.mean)
    return _apply(df, vec, lambda x: (x - mean) @ comps.T)


def reduce_dims(df: DataFrame, output_dim: int, vec: str = "vec") -> tuple[DataFrame, PcaFit]:
    """fit PCA on the table itself and project (centred)."""
    fit = fit_pca(df, output_dim, vec)
    return project(df, fit, output_dim, vec), fit


def all_but_the_top(df: DataFrame, n_components: int = 1, vec: str = "vec") -> DataFrame:
    """centre, fit on the centred table, remove, add the mean back."""
    fit = fit_pca(df, n_components, vec)
    mean, comps = fit.mean, fit.components

    def fn(x):
        c = x - mean
        for p in comps:
            c = c - np.outer(c @ p, p)
        return c + mean

    return _apply(df, vec, fn)


def transform_embeddings(words: DataFrame, sentences: DataFrame, n_remove: int = 7, output_dim: int = 256,
                         vec: str = "vec") -> DataFrame:
    """fit on sentences, remove from words, reduce fitted on words, L2 normalise."""
    sent_fit = fit_pca(sentences, n_remove, vec)
    removed = remove_components(words, sent_fit, n_remove, vec)
    reduced, _ = reduce_dims(removed, output_dim, vec)
    return reduced.withColumn(vec, Vx.l2_normalize(vec))


def historical_transform(words: DataFrame, sentences: DataFrame, d_remove: int, out_dim: int,
                         vec: str = "vec") -> DataFrame:
    """F8: full PCA on sentences, words become ``(W - mean) · C[d:d+e]ᵀ``; no normalisation.

    Sentences that are also the words are computed once, for the fit and the projection.
    """
    if words is sentences:
        words = sentences = sentences.checkpoint()
    fit = fit_pca(sentences, d_remove + out_dim, vec)
    return project(words, fit, out_dim, vec, center=True, start=d_remove)


def variance_report(fit: PcaFit, spark) -> DataFrame:
    """cumulative explained-variance ratios at 1/3/300/512/all and first i with cum > 0.99."""
    rows = [(i + 1, float(r)) for i, r in enumerate(fit.ratios)]
    df = spark.createDataFrame(rows, "i int, ratio double")
    from pyspark.sql import Window

    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # k rows (<= d)
    cum = df.withColumn("cum", F.sum("ratio").over(w))
    n = len(rows)
    marks = [m for m in (1, 3, 300, 512) if m <= n] + [n]
    report = cum.where(F.col("i").isin(marks)).select(F.col("i").alias("top"), "cum")
    first = cum.where(F.col("cum") > 0.99).agg(F.min("i").cast("double").alias("cum"))
    return report.unionByName(first.select(F.lit(-1).alias("top"), "cum"))


def sif_weighting(emb: DataFrame, counts: DataFrame, a: float = 1e-3, key: str = "token", vec: str = "vec") -> DataFrame:
    """``w = a / (a + n / total)`` (float32 weight), tokens without a count keep 1;
    counts of ids outside the table still count in ``total``."""
    total = counts.agg(F.sum("n")).first()[0] or 0  # one scalar
    c = counts.select(F.col(key).alias("_k"), (F.lit(a) / (F.lit(a) + F.col("n") / F.lit(float(total)))).alias("_w"))
    j = emb.join(c, emb[key] == c["_k"], "left")
    w = F.coalesce(F.col("_w"), F.lit(1.0)).cast("float").cast("double")
    return j.select(*[x for x in emb.columns if x != vec], Vx.scale(vec, w).alias(vec))


def post_process(emb: DataFrame, counts: DataFrame | None = None, apply_sif: bool = True, apply_pca: bool = True,
                 pca_dims: int | None = None, remove_pc: bool = True, n_pc_remove: int = 1,
                 sif_coefficient: float = 1e-3, key: str = "token", vec: str = "vec") -> DataFrame:
    """SIF (with counts) -> PCA (if pca_dims < d) -> all-but-the-top -> L2."""
    out = emb
    if apply_sif and counts is not None:
        out = sif_weighting(out, counts, sif_coefficient, key, vec)
    if apply_pca and pca_dims is not None:
        d = int(out.select(F.max(F.size(vec))).first()[0])
        if pca_dims < d:
            out, _ = reduce_dims(out, pca_dims, vec)
    if remove_pc:
        out = all_but_the_top(out, n_pc_remove, vec)
    return out.withColumn(vec, Vx.l2_normalize(vec))


def target_reduction(df: DataFrame, pca_dims: int, vec: str = "vec") -> DataFrame:
    """PCA to ``min(pca_dims, n, d)`` then L2 (clamped form)."""
    n = df.count()
    d = int(df.select(F.max(F.size(vec))).first()[0])
    k = min(pca_dims, n, d)
    red, _ = reduce_dims(df, k, vec)
    return red.withColumn(vec, Vx.l2_normalize_clamped(vec))


def dimension_clamps(n_sentences: int, raw_dim: int, n_remove: int = 7, output_dim: int = 256) -> tuple[int, int]:
    """``n_remove = min(7, n//2)``, ``out = min(256, n-1, raw - n_remove)``."""
    nr = min(n_remove, n_sentences // 2)
    out = min(output_dim, n_sentences - 1, raw_dim - nr)
    return nr, out


def end_to_end_clamps(n_words: int, n_sentences: int, raw_dim: int, n_remove: int = 7,
                      output_dim: int = 256) -> tuple[int, int]:
    """F14, end-to-end form: with ``m = min(n_words, n_sentences, raw_dim)``,
    ``n_remove = min(7, m // 2)`` and ``out = min(256, m - 1)``."""
    m = min(n_words, n_sentences, raw_dim)
    return min(n_remove, m // 2), min(output_dim, m - 1)
