"""Registered queries: losses.

Batches: the embeddings table hash-shuffled into batches of 32 (G10 contract);
student = first half of each vector, teacher = second half.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexaria.functions import vectors as Vx
from lexaria.operators import encode as EN
from lexaria.operators import losses as L
from lexaria.operators import sampling as S
from lexaria.plans import fixtures as FX
from lexaria.plans.catalog import register
from lexaria.plans.oracle import P1_SQL, add_cte, dot, norm, with_ctes
from lexaria.plans.q_vectors import enc_sql, long_sql

BS = 32
T = 0.05


def _batches(spark, sf):
    e = FX.embeddings(spark, sf).select(
        "vec_id", F.slice("vec", 1, 32).alias("student"), F.slice("vec", 33, 32).alias("teacher")
    )
    return S.epoch_batches(e, "vec_id", BS, 0, 42)


add_cte("batches", ["emb"], f"""
SELECT vec_id, CAST(idx // {BS} AS BIGINT) AS batch_id, CAST(idx % {BS} AS BIGINT) AS i,
       list_transform(s, lambda x: x / greatest({norm('s')}, 1e-12)) AS s,
       list_transform(t, lambda x: x / greatest({norm('t')}, 1e-12)) AS t
FROM (SELECT vec_id, vec[1:32] AS s, vec[33:64] AS t,
             row_number() OVER (ORDER BY md5(concat_ws('|', '42', '0', CAST(vec_id AS VARCHAR))), vec_id) - 1 AS idx
      FROM emb)""")

add_cte("d6", ["batches"], f"""
SELECT a.batch_id, a.i, b.i AS j, {dot('a.s', 'b.s')} AS student, {dot('a.t', 'b.t')} AS teacher
FROM batches a JOIN batches b ON a.batch_id = b.batch_id AND a.i <> b.i""")

add_cte("e23", ["d6"], f"""
SELECT batch_id, -sum(exp(lt - zt) * (ls - zs)) / sum(exp(lt - zt)) AS loss, CAST(count(DISTINCT i) AS BIGINT) AS n
FROM (SELECT *, ms + ln(sum(exp(ls - ms)) OVER w) AS zs, mt + ln(sum(exp(lt - mt)) OVER w) AS zt
      FROM (SELECT *, max(ls) OVER w AS ms, max(lt) OVER w AS mt
            FROM (SELECT batch_id, i, j, student / {T} AS ls, teacher / {T} AS lt FROM d6)
            WINDOW w AS (PARTITION BY batch_id, i))
      WINDOW w AS (PARTITION BY batch_id, i))
GROUP BY batch_id HAVING count(DISTINCT i) >= 2""")


@register("d06_in_batch_similarity", with_ctes(["d6"], """
SELECT batch_id, i, j, round(student, 6) + 0.0 AS student, round(teacher, 6) + 0.0 AS teacher FROM d6"""))
def d06_in_batch_similarity(spark, sf):
    """All pairs i != j inside each batch of 32 (block products)."""
    p = L.in_batch_pairs(_batches(spark, sf), ["student", "teacher"])
    return p.select("batch_id", "i", "j", Vx.round_col("student").alias("student"),
                    Vx.round_col("teacher").alias("teacher"))


@register("e23_distillation_loss", with_ctes(["e23"], "SELECT batch_id, round(loss, 6) + 0.0 AS loss, n FROM e23"))
def e23_distillation_loss(spark, sf):
    """Per-batch cross-entropy between teacher and student in-batch softmax (T=0.05)."""
    return L.distillation_loss(_batches(spark, sf), T).select("batch_id", Vx.round_col("loss").alias("loss"), "n")


@register("e26_epoch_loss", with_ctes(["e23"], """
SELECT round(sum(loss) / greatest(count(*), 1), 6) + 0.0 AS epoch_loss, round(sum(loss), 6) + 0.0 AS epoch_loss_sum
FROM e23"""))
def e26_epoch_loss(spark, sf):
    """Mean over batches (current) and sum over batches (historical)."""
    bl = L.distillation_loss(_batches(spark, sf), T)
    agg = bl.agg((F.sum("loss") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("m"), F.sum("loss").alias("s"))
    return agg.select(Vx.round_col("m").alias("epoch_loss"), Vx.round_col("s").alias("epoch_loss_sum"))


add_cte("d8", ["batches"], f"""
SELECT a.batch_id, a.i, b.i AS j, {dot('a.s', 'b.t')} AS sim FROM batches a JOIN batches b ON a.batch_id = b.batch_id""")


@register("d08_bipartite_similarity", with_ctes(["d8"], """
SELECT batch_id, i, j, round(sim, 6) + 0.0 AS sim FROM d8"""))
def d08_bipartite_similarity(spark, sf):
    """src_i . tgt_j for all i, j of each batch (diagonal kept; block products)."""
    s = L.bipartite_pairs(_batches(spark, sf), "student", "teacher")
    return s.select("batch_id", "i", "j", Vx.round_col("sim").alias("sim"))


@register("e24_contrastive_loss", with_ctes(["d8"], f"""
SELECT batch_id, round(-avg(CASE WHEN i = j THEN l - zr END) - avg(CASE WHEN i = j THEN l - zc END), 6) + 0.0 AS loss,
       CAST(count(*) FILTER (WHERE i = j) AS BIGINT) AS n
FROM (SELECT *, mr + ln(sum(exp(l - mr)) OVER (PARTITION BY batch_id, i)) AS zr,
                mc + ln(sum(exp(l - mc)) OVER (PARTITION BY batch_id, j)) AS zc
      FROM (SELECT *, max(l) OVER (PARTITION BY batch_id, i) AS mr, max(l) OVER (PARTITION BY batch_id, j) AS mc
            FROM (SELECT batch_id, i, j, sim / {T} AS l FROM d8)))
GROUP BY batch_id"""))
def e24_contrastive_loss(spark, sf):
    """Symmetric in-batch contrastive loss, gold = the diagonal."""
    return L.contrastive_loss(_batches(spark, sf), T, "student", "teacher").select("batch_id", Vx.round_col("loss").alias("loss"), "n")


# ---- E25 cosine regression ------------------------------------------------------------------

add_cte("docs_src", [], "SELECT doc_id, text FROM documents")
enc_sql("enc_docs", "docs_src", "doc_id", "text", P1_SQL)


@register("e25_cosine_regression", with_ctes(["enc_docs", "emb", "word2vec"], f"""
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(1 - c), 6) + 0.0 AS cos_loss,
       round(avg(1 - c) + 1e-5 * (SELECT avg(v * v) FROM (SELECT unnest(vec) AS v FROM word2vec)), 6) + 0.0 AS loss
FROM (SELECT o.doc_id,
             CASE WHEN sum(o.value * o.value) = 0 THEN 0.0
                  ELSE sum(o.value * t.value) / (sqrt(sum(o.value * o.value)) * sqrt(sum(t.value * t.value))) END AS c
      FROM enc_docs o JOIN ({long_sql('emb', 'vec_id')}) t ON t.vec_id = o.doc_id % (SELECT count(*) FROM embeddings) AND t.dim = o.dim
      GROUP BY o.doc_id)"""))
def e25_cosine_regression(spark, sf):
    """Documents encoded by the word vectors vs their teacher vector (vec_id = doc_id mod |embeddings|),
    plus the 1e-5 L2 term over the word-vector table."""
    docs = FX.table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    w2v = FX.word2vec(spark, sf)
    out = EN.encode(docs, w2v, key="text_id", dim=FX.dim(spark, sf))
    tgt = docs.select("text_id").join(
        FX.embeddings(spark, sf), FX.vector_of(F.col("text_id"), spark, sf) == F.col("vec_id")).select("text_id", "vec")
    res = L.cosine_regression_loss(out, tgt, w2v, "text_id")
    return res.select("n", Vx.round_col("cos_loss").alias("cos_loss"), Vx.round_col("loss").alias("loss"))
