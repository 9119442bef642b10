"""Registered queries: training re-aimed as synchronous large-batch jobs (K1-K7).

Sentences are the conversation turns; the teacher (J3, a precomputed vector
table) encodes them with a shifted word-vector assignment; the student starts
from the vocabulary's vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.functions import vectors as Vx
from lexaria.operators import encode as EN
from lexaria.operators import evaluate as EV
from lexaria.operators import sampling as S
from lexaria.plans import fixtures as FX
from lexaria.plans.catalog import register
from lexaria.plans.oracle import P1_SQL, TOK, add_cte, gold, with_ctes
from lexaria.plans.q_vectors import long_sql
from lexaria.session import stage_path
from lexaria.train import driver as D
from lexaria.train import model as M


def _sentences(spark, sf):
    c = FX.table(spark, sf, "conversations")
    return c.select(FX.turn_key().alias("sent_id"), "text")


def _shifted(spark, sf):
    v = FX.vocab(spark, sf)
    e = FX.embeddings(spark, sf)
    return v.join(e, e.vec_id == FX.vector_of(v.word_idx, spark, sf, 1)).select("word", "vec")


def _teacher(spark, sf):
    enc = EN.encode(_sentences(spark, sf), _shifted(spark, sf), key="sent_id", dim=FX.dim(spark, sf))
    return enc.select("sent_id", F.col("vec").alias("tvec"))


def _split(spark, sf):
    s = _sentences(spark, sf)
    val = T.hash_gold(F.col("sent_id"), F.lit("val")) < 0.2
    return s.where(~val), s.where(val)


@register("k01_init_params", with_ctes(["word2vec"], """
SELECT word, CAST(len(vec) AS BIGINT) AS dim, true AS zero_moments FROM word2vec"""))
def k01_init_params(spark, sf):
    """K1: parameter table from the vocabulary vectors, zero Adam moments."""
    p = M.init_params(FX.word2vec(spark, sf))
    zero = (F.aggregate("m", F.lit(0.0), lambda a, x: a + F.abs(x)) == 0) & (
        F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)) == 0)
    return p.select("word", F.size("vec").cast("bigint").alias("dim"), zero.alias("zero_moments"))


@register("k05_adam_step", with_ctes(["word2vec", "w2v_shift"], f"""
SELECT p.word, p.dim, round(p.value - 1e-4 * (0.1 * coalesce(g.value, 0) * sc.s / 0.1)
                          / (sqrt(0.001 * pow(coalesce(g.value, 0) * sc.s, 2) / 0.001) + 1e-8), 6) + 0.0 AS value
FROM ({long_sql('word2vec', 'word')}) p
LEFT JOIN ({long_sql('w2v_shift', 'word')}) g ON g.word = p.word AND g.dim = p.dim
CROSS JOIN (SELECT CASE WHEN sqrt(sum(value * value)) > 5.0 THEN 5.0 / (sqrt(sum(value * value)) + 1e-6) ELSE 1.0 END AS s
            FROM ({long_sql('w2v_shift', 'word')})) sc"""))
def k05_adam_step(spark, sf):
    """K5: global-norm clip at 5 then one Adam step (lr 1e-4) with a data-derived gradient table."""
    params = M.init_params(FX.word2vec(spark, sf))
    grad = _shifted(spark, sf).select("word", F.col("vec").alias("g"))
    new = M.adam_step(params, grad, 1, lr=1e-4, clip=5.0)
    return Vx.long_form(new.select("word", "vec"), ["word"], "vec")


def _sums_sql(name: str, src: str, text: str, vectors: str = "word2vec") -> None:
    """CTEs ``{name}_tf`` (batch_id, i, word, tf), ``{name}`` (long-form sums s per row and dim) and
    ``{name}_u`` (unit vectors as lists, with the length of the sum)."""
    add_cte(f"{name}_tf", [src, vectors], f"""
SELECT batch_id, i, coalesce(e.word, l.word) AS word, CAST(count(*) AS DOUBLE) AS tf
FROM (SELECT batch_id, i, unnest(regexp_extract_all({text}, '{TOK}')) AS w FROM {src}) t
LEFT JOIN {vectors} e ON e.word = t.w LEFT JOIN {vectors} l ON l.word = lower(t.w)
WHERE t.w NOT IN ({P1_SQL}) AND coalesce(e.word, l.word) IS NOT NULL GROUP BY ALL""")
    add_cte(name, [f"{name}_tf", vectors], f"""
SELECT t.batch_id, t.i, v.dim, sum(t.tf * v.value) AS s FROM {name}_tf t JOIN ({long_sql(vectors, 'word')}) v ON v.word = t.word
GROUP BY ALL""")
    add_cte(f"{name}_u", [name, src], f"""
SELECT r.batch_id, r.i, coalesce(len, 0.0) AS len, coalesce(u, list_transform(range(0, 64), lambda x: 0.0::DOUBLE)) AS u
FROM {src} r LEFT JOIN (
  SELECT batch_id, i, sqrt(sum(s * s)) AS len, list_transform(list(s ORDER BY dim), lambda x: x / greatest(sqrt(sum(s * s)), 1e-12)) AS u
  FROM {name} GROUP BY batch_id, i) x ON x.batch_id = r.batch_id AND x.i = r.i""")


def _word_gradient_sql(parts: list[tuple[str, str]], src: str) -> str:
    """Per-word gradient norms from (term frequencies, long-form row gradients ds)."""
    both = " UNION ALL ".join(f"SELECT t.word, d.dim, t.tf * d.ds AS g FROM {tf} t JOIN {d} d ON d.batch_id = t.batch_id AND d.i = t.i"
                              for tf, d in parts)
    return f"""
SELECT word, round(sqrt(sum(g * g)), 9) + 0.0 AS grad_norm
FROM (SELECT word, dim, sum(g) / (SELECT count(DISTINCT batch_id) FROM {src}) AS g FROM ({both}) GROUP BY word, dim) GROUP BY word"""


def _through_unit_sql(du: str, u: str) -> str:
    """Row gradients wrt raw vectors (long form) from those wrt unit vectors (batch_id, i, dim, d)."""
    return f"""
SELECT batch_id, i, dim, (d - u * sum(d * u) OVER (PARTITION BY batch_id, i)) / len AS ds
FROM (SELECT d.batch_id, d.i, d.dim, d.d, u.u[d.dim + 1] AS u, u.len FROM {du} d JOIN {u} u ON u.batch_id = d.batch_id AND u.i = d.i
      WHERE u.len > 0)"""


def _dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


add_cte("k02_rows", [], f"""
SELECT CAST(idx // 128 AS BIGINT) AS batch_id, CAST(idx % 128 AS BIGINT) AS i, sent_id, text
FROM (SELECT sent_id, text, row_number() OVER (ORDER BY md5(concat_ws('|', '42', '0', sent_id)), sent_id) - 1 AS idx
      FROM (SELECT lpad(CAST(conv_id AS VARCHAR), 19, '0') || '-' || lpad(CAST(turn AS VARCHAR), 19, '0') AS sent_id, text FROM conversations)
      WHERE NOT {gold("sent_id", "'val'")} < 0.2)""")
_sums_sql("k02_s", "k02_rows", "text")
_sums_sql("k02_t", "k02_rows", "text", "w2v_shift")
add_cte("k02_pairs", ["k02_s_u", "k02_t_u"], f"""
SELECT a.batch_id, a.i, b.i AS j, b.u AS uj, {_dot_sql('a.u', 'b.u')} / 0.05 AS ls, {_dot_sql('ta.u', 'tb.u')} / 0.05 AS lt
FROM k02_s_u a JOIN k02_s_u b ON b.batch_id = a.batch_id AND b.i <> a.i
JOIN k02_t_u ta ON ta.batch_id = a.batch_id AND ta.i = a.i JOIN k02_t_u tb ON tb.batch_id = b.batch_id AND tb.i = b.i""")
add_cte("k02_g", ["k02_pairs", "k02_rows"], """
SELECT p.batch_id, i, j, (exp(ls - zs) - exp(lt - zt)) / (n * 0.05) AS g
FROM (SELECT *, ms + ln(sum(exp(ls - ms)) OVER w) AS zs, mt + ln(sum(exp(lt - mt)) OVER w) AS zt
      FROM (SELECT *, max(ls) OVER w AS ms, max(lt) OVER w AS mt FROM k02_pairs WINDOW w AS (PARTITION BY batch_id, i))
      WINDOW w AS (PARTITION BY batch_id, i)) p
JOIN (SELECT batch_id, count(*) AS n FROM k02_rows GROUP BY batch_id) b ON b.batch_id = p.batch_id""")
add_cte("k02_du", ["k02_g", "k02_s_u"], """
SELECT batch_id, i, dim, sum(gs * v) AS d
FROM (SELECT x.batch_id, x.i, x.g + y.g AS gs, unnest(u.u) AS v, generate_subscripts(u.u, 1) - 1 AS dim
      FROM k02_g x JOIN k02_g y ON y.batch_id = x.batch_id AND y.i = x.j AND y.j = x.i
      JOIN k02_s_u u ON u.batch_id = x.batch_id AND u.i = x.j)
GROUP BY batch_id, i, dim""")
add_cte("k02_ds", ["k02_du", "k02_s_u"], _through_unit_sql("k02_du", "k02_s_u"))


@register("k02_distillation_gradient", with_ctes(["k02_s_tf", "k02_ds", "k02_rows"], _word_gradient_sql([("k02_s_tf", "k02_ds")], "k02_rows")))
def k02_distillation_gradient(spark, sf):
    """K2: one synchronous pass of the distillation gradient (batches of 128); per-word gradient norm."""
    train, _ = _split(spark, sf)
    # batch rows with their teacher vector
    b = S.epoch_batches(train, "sent_id", 128, 0, 42).join(_teacher(spark, sf), "sent_id")
    params = M.init_params(FX.word2vec(spark, sf))
    grad, losses = M.distillation_gradient(b.select("batch_id", "i", "text", "tvec"), params, temperature=0.05,
                                           bound=FX.n_words(spark, sf), dim=FX.dim(spark, sf))
    return grad.select("word", Vx.round_col(Vx.norm("g"), 9).alias("grad_norm"))


add_cte("k03_rows", ["conv_pairs"], """
SELECT CAST(idx // 32 AS BIGINT) AS batch_id, CAST(idx % 32 AS BIGINT) AS i, a, b
FROM (SELECT a, b, row_number() OVER (ORDER BY md5(concat_ws('|', '42', '0', pair_id)), pair_id) - 1 AS idx FROM conv_pairs)""")
_sums_sql("k03_a", "k03_rows", "a")
_sums_sql("k03_b", "k03_rows", "b")
add_cte("k03_g", ["k03_a_u", "k03_b_u"], f"""
SELECT batch_id, i, j, (exp(l - zr) + exp(l - zc) - CASE WHEN i = j THEN 2 ELSE 0 END) / (n * 0.05) AS g
FROM (SELECT *, mr + ln(sum(exp(l - mr)) OVER (PARTITION BY batch_id, i)) AS zr, mc + ln(sum(exp(l - mc)) OVER (PARTITION BY batch_id, j)) AS zc,
             count(*) OVER (PARTITION BY batch_id, i) AS n
      FROM (SELECT *, max(l) OVER (PARTITION BY batch_id, i) AS mr, max(l) OVER (PARTITION BY batch_id, j) AS mc
            FROM (SELECT a.batch_id, a.i, b.i AS j, {_dot_sql('a.u', 'b.u')} / 0.05 AS l
                  FROM k03_a_u a JOIN k03_b_u b ON b.batch_id = a.batch_id)))""")
for _side, _other, _own, _far in (("a", "b", "i", "j"), ("b", "a", "j", "i")):
    add_cte(f"k03_{_side}_du", ["k03_g", f"k03_{_other}_u"], f"""
SELECT batch_id, i, dim, sum(g * v) AS d
FROM (SELECT x.batch_id, x.{_own} AS i, x.g, unnest(u.u) AS v, generate_subscripts(u.u, 1) - 1 AS dim
      FROM k03_g x JOIN k03_{_other}_u u ON u.batch_id = x.batch_id AND u.i = x.{_far})
GROUP BY batch_id, i, dim""")
    add_cte(f"k03_{_side}_ds", [f"k03_{_side}_du", f"k03_{_side}_u"], _through_unit_sql(f"k03_{_side}_du", f"k03_{_side}_u"))


@register("k03_contrastive_gradient", with_ctes(["k03_a_tf", "k03_b_tf", "k03_a_ds", "k03_b_ds", "k03_rows"],
                                                _word_gradient_sql([("k03_a_tf", "k03_a_ds"), ("k03_b_tf", "k03_b_ds")], "k03_rows")))
def k03_contrastive_gradient(spark, sf):
    """K3: one pass of the contrastive gradient over aligned turn pairs (batches of 32)."""
    p = FX.conversation_pairs(spark, sf).select(F.col("pair_id").alias("sent_id"), F.col("a").alias("src"),
                                                 F.col("b").alias("tgt"))
    b = S.epoch_batches(p, "sent_id", 32, 0, 42)
    params = M.init_params(FX.word2vec(spark, sf))
    grad, _ = M.contrastive_gradient(b.select("batch_id", "i", "src", "tgt"), params, 0.05,
                                     bound=FX.n_words(spark, sf), dim=FX.dim(spark, sf))
    return grad.select("word", Vx.round_col(Vx.norm("g"), 9).alias("grad_norm"))


@register("k04_regression_gradient")
def k04_regression_gradient(spark, sf):
    """K4: cosine-regression gradient wrt token vectors and the projection (rows = label means)."""
    e = FX.embeddings(spark, sf)
    means = e.groupBy("label").agg(Summarizer.mean(array_to_vector("vec")).alias("m")).orderBy("label").collect()
    W = np.array([r["m"].toArray() for r in means])  # labels x d: a bounded parameter
    docs = FX.table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    # every document has a target
    texts = docs
    tv = docs.select("text_id").join(e, FX.vector_of(F.col("text_id"), spark, sf) == F.col("vec_id")).select(
        "text_id", F.slice("vec", 1, W.shape[0]).alias("tvec"))
    grad, dW, loss = M.regression_gradient(texts, M.init_params(FX.word2vec(spark, sf)), tv, W,
                                           bound=FX.n_words(spark, sf), dim=FX.dim(spark, sf))
    return grad.select("word", Vx.round_col(Vx.norm("g"), 9).alias("grad_norm"),
                       F.lit(float(np.linalg.norm(dW))).alias("proj_grad_norm"), F.lit(float(loss)).alias("loss"))


@register("k06_training_run")
def k06_training_run(spark, sf):
    """K6 + K7 + G13: two synchronous passes with validation loss, best table and a
    word-similarity evaluation every second pass."""
    train, val = _split(spark, sf)
    teacher = _teacher(spark, sf)
    params = M.init_params(FX.word2vec(spark, sf))
    from lexaria.plans.q_evaluate import _ds_pairs

    pairs = _ds_pairs(spark, sf)

    def evaluate(vectors):
        r = EV.word_similarity(pairs, vectors, dim=FX.dim(spark, sf))
        return r.agg(F.avg("spearman")).first()[0]

    cfg = D.TrainConfig(epochs=2, batch_size=128, learning_rate=1e-3, patience=5, eval_every=2)
    out = stage_path(spark, f"train-{abs(hash(sf))}-{np.random.default_rng().integers(1 << 30)}")
    res = D.train_distillation(spark, params, train, val, teacher, out, cfg, evaluate=evaluate,
                               bound=FX.n_words(spark, sf), dim=FX.dim(spark, sf))
    rows = [(h["epoch"], h["train_loss"], h["val_loss"], h["is_best"], h["metrics"]) for h in res.history]
    return spark.createDataFrame(rows, "epoch int, train_loss double, val_loss double, is_best boolean, "
                                       "spearman double")


HISTORY = "epoch int, train_loss double, val_loss double, is_best boolean, spearman double"


def _history(spark, result):
    rows = [(h["epoch"], h["train_loss"], h["val_loss"], h["is_best"], h["metrics"]) for h in result.history]
    return spark.createDataFrame(rows, HISTORY)


@register("k06_regression_run")
def k06_regression_run(spark, sf):
    """K6: two regression passes of two steps over all documents (AdamW, cosine decay, projection)."""
    e = FX.embeddings(spark, sf)
    means = e.groupBy("label").agg(Summarizer.mean(array_to_vector("vec")).alias("m")).orderBy("label").collect()
    w = np.array([r["m"].toArray() for r in means])
    docs = FX.table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    targets = docs.select("text_id").join(e, FX.vector_of(F.col("text_id"), spark, sf) == F.col("vec_id")).select(
        "text_id", F.slice("vec", 1, w.shape[0]).alias("tvec"))
    cfg = D.TrainConfig(epochs=2, steps_per_pass=2, learning_rate=1e-2)
    res, _ = D.train_regression(spark, M.init_params(FX.word2vec(spark, sf)), docs, targets, w,
                                stage_path(spark, f"train-reg-{np.random.default_rng().integers(1 << 40)}"), cfg,
                                bound=FX.n_words(spark, sf), dim=FX.dim(spark, sf))
    return _history(spark, res)


@register("k06_contrastive_run")
def k06_contrastive_run(spark, sf):
    """K6: two cross-lingual passes over the conversation pairs, the last tenth being validation."""
    pairs = FX.conversation_pairs(spark, sf).select("pair_id", F.col("a").alias("src"), F.col("b").alias("tgt"))
    cfg = D.TrainConfig(epochs=2, batch_size=64, learning_rate=1e-3)
    res = D.train_contrastive(spark, M.init_params(FX.word2vec(spark, sf)), pairs,
                              stage_path(spark, f"train-con-{np.random.default_rng().integers(1 << 40)}"), cfg,
                              n_val=max(2, pairs.count() // 10), bound=FX.n_words(spark, sf), dim=FX.dim(spark, sf))
    return _history(spark, res)
