"""Registered queries: vector core."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.functions import vectors as Vx
from lexaria.functions.joins import bounded_broadcast
from lexaria.operators import encode as EN
from lexaria.operators import pooling as PO
from lexaria.plans import fixtures as FX
from lexaria.plans.catalog import register
from lexaria.plans.oracle import P1_SQL, P2_SQL, add_cte, gold, with_ctes

TOK = T.TOKEN_PATTERN
DIM = 64  # dimension of the test vectors (read from data in the Spark queries)


def long_sql(src: str, keys: str, vec: str = "vec") -> str:
    """Long form of a vector column: ``keys, dim, value``."""
    return f"SELECT {keys}, CAST(generate_subscripts({vec}, 1) - 1 AS BIGINT) AS dim, unnest({vec}) AS value FROM {src}"


def mean_sql(src: str, keys: str, weight: str | None = None) -> str:
    """Group mean in long form (optionally weighted)."""
    if weight is None:
        return f"SELECT {keys}, dim, avg(value) AS value FROM ({long_sql(src, keys + ', 1.0 AS _w')}) GROUP BY {keys}, dim"
    return (f"SELECT {keys}, dim, sum(_w * value) / sum(_w) AS value FROM "
            f"({long_sql(src, keys + ', ' + weight + ' AS _w')}) GROUP BY {keys}, dim")


def normalized_sql(src: str, keys: str, eps: str = "1e-8") -> str:
    """F1 on a long-form relation."""
    return (f"SELECT s.*, s.value / (n.nrm + {eps}) AS nvalue FROM {src} s JOIN "
            f"(SELECT {keys}, sqrt(sum(value * value)) AS nrm FROM {src} GROUP BY {keys}) n USING ({keys})")


def out_long(src: str, keys: str, value: str = "value") -> str:
    return f"SELECT {keys}, dim, round({value}, 6) + 0.0 AS value FROM {src}"


def spark_long(df, keys):
    return Vx.long_form(df, keys, "vec")


# --------------------------------------------------------------------------- pooling

add_cte("ctx_mean", ["contexts"], mean_sql("contexts", "word"))


@register("e08_mean_pooling", with_ctes(["ctx_mean"], out_long("ctx_mean", "word")))
def e08_mean_pooling(spark, sf):
    return spark_long(PO.mean_pooling(FX.contexts(spark, sf)), ["word"])


@register(
    "f01_l2_normalize",
    with_ctes(["ctx_mean"], out_long(f"({normalized_sql('ctx_mean', 'word')})", "word", "nvalue")),
)
def f01_l2_normalize(spark, sf):
    """F1 on the (non unit) pooled vectors."""
    pooled = PO.mean_pooling(FX.contexts(spark, sf))
    return spark_long(pooled.select("word", Vx.l2_normalize("vec").alias("vec")), ["word"])


add_cte("ctx_w", ["contexts"], f"SELECT *, {gold('ctx')} AS w FROM contexts")


@register("e09_weighted_mean_pooling", with_ctes(["ctx_w"], out_long(f"({mean_sql('ctx_w', 'word', 'w')})", "word")))
def e09_weighted_mean_pooling(spark, sf):
    c = FX.contexts(spark, sf).withColumn("w", T.hash_gold(F.col("ctx")))
    return spark_long(PO.weighted_mean_pooling(c, "w"), ["word"])


add_cte("ctx_cent", ["contexts", "ctx_mean"], """
SELECT c.word, c.ctx, c.vec,
       CASE WHEN m.n <= 1 THEN 1.0 ELSE 1.0 / (sqrt(m.d2) + 1e-6) END AS w
FROM contexts c JOIN (
  SELECT x.word, x.ctx, sum((x.value - y.value) * (x.value - y.value)) AS d2, max(k.n) AS n
  FROM (SELECT word, ctx, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS dim, unnest(vec) AS value FROM contexts) x
  JOIN ctx_mean y ON x.word = y.word AND x.dim = y.dim
  JOIN (SELECT word, count(*) AS n FROM contexts GROUP BY word) k ON k.word = x.word
  GROUP BY x.word, x.ctx) m ON m.word = c.word AND m.ctx = c.ctx""")


@register(
    "e10_variance_weighted_pooling",
    with_ctes(["ctx_cent"], out_long(f"({mean_sql('ctx_cent', 'word', 'w')})", "word")),
)
def e10_variance_weighted_pooling(spark, sf):
    return spark_long(PO.variance_weighted_pooling(FX.contexts(spark, sf), key_bound=10_000), ["word"])


add_cte("states", ["emb"], """
SELECT 'w' || CAST(label AS VARCHAR) AS word, vec_id // 4 AS ctx, vec_id AS tok, vec FROM emb""")
add_cte("states_ctx", ["states"], mean_sql("states", "word, ctx"))


@register(
    "e11_two_level_mean",
    with_ctes(
        ["states_ctx"],
        """SELECT m.word, m.dim, round(m.value, 6) + 0.0 AS value, n.n_contexts FROM
           (SELECT word, dim, avg(value) AS value FROM states_ctx GROUP BY word, dim) m
           JOIN (SELECT word, CAST(count(DISTINCT ctx) AS BIGINT) AS n_contexts FROM states GROUP BY word) n
           ON m.word = n.word""",
    ),
)
def e11_two_level_mean(spark, sf):
    """Token pieces -> context mean -> word mean (never a flat mean)."""
    e = FX.embeddings(spark, sf)
    states = e.select(
        F.concat(F.lit("w"), F.col("label").cast("string")).alias("word"),
        F.floor(F.col("vec_id") / 4).cast("bigint").alias("ctx"),
        F.col("vec_id").alias("tok"),
        "vec",
    )
    out = PO.two_level_mean(states)
    return spark_long(out, ["word", "n_contexts"])


add_cte("masked", ["emb"], f"""
SELECT vec_id // 5 AS sent, vec_id AS tok,
       CASE WHEN {gold('vec_id', "'m'")} < 0.7 THEN 1 ELSE 0 END AS mask, vec FROM emb""")


@register(
    "e12_masked_mean",
    with_ctes(
        ["masked"],
        """SELECT l.sent, l.dim, round(l.s / greatest(m.m, 1e-9), 6) + 0.0 AS value FROM
           (SELECT sent, dim, sum(mask * value) AS s FROM
              (SELECT sent, mask, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS dim, unnest(vec) AS value FROM masked)
            GROUP BY sent, dim) l
           JOIN (SELECT sent, CAST(sum(mask) AS DOUBLE) AS m FROM masked GROUP BY sent) m ON l.sent = m.sent""",
    ),
)
def e12_masked_mean(spark, sf):
    e = FX.embeddings(spark, sf)
    states = e.select(
        F.floor(F.col("vec_id") / 5).cast("bigint").alias("sent"),
        F.col("vec_id").alias("tok"),
        F.when(T.hash_gold(F.col("vec_id"), F.lit("m")) < 0.7, 1).otherwise(0).alias("mask"),
        "vec",
    )
    return spark_long(PO.masked_mean(states), ["sent"])


add_cte("w2v_shift", ["vocab", "emb"], "SELECT v.word, e.vec FROM vocab v JOIN emb e ON e.vec_id = (v.word_idx + 1) % (SELECT count(*) FROM embeddings)")


@register(
    "e16_merge_word_vectors",
    with_ctes(
        ["word2vec", "w2v_shift"],
        out_long(f"({mean_sql('(SELECT * FROM word2vec UNION ALL SELECT * FROM w2v_shift)', 'word')})", "word"),
    ),
)
def e16_merge_word_vectors(spark, sf):
    """Merge the vocabulary's vectors with a shifted assignment (partial overlap)."""
    v = FX.vocab(spark, sf)
    e = FX.embeddings(spark, sf)
    shifted = v.join(e, e.vec_id == FX.vector_of(v.word_idx, spark, sf, 1)).select("word", "vec")
    return spark_long(PO.merge_word_vectors(FX.word2vec(spark, sf), shifted), ["word"])


@register(
    "e17_embedding_stats",
    with_ctes(
        ["word2vec"],
        f"""SELECT CAST(count(*) AS BIGINT) AS vocab_size, CAST(max(len(vec)) AS BIGINT) AS dim,
                   round(avg(n), 6) + 0.0 AS norm_mean, round(stddev_pop(n), 6) + 0.0 AS norm_std,
                   round(min(n), 6) + 0.0 AS norm_min, round(max(n), 6) + 0.0 AS norm_max
            FROM (SELECT vec, sqrt(list_reduce(list_transform(vec, lambda x: x * x), lambda a, b: a + b)) AS n FROM word2vec)""",
    ),
)
def e17_embedding_stats(spark, sf):
    s = PO.embedding_stats(FX.word2vec(spark, sf))
    return s.select("vocab_size", "dim", *[Vx.round_col(c).alias(c) for c in
                                           ["norm_mean", "norm_std", "norm_min", "norm_max"]])


add_cte("emb_mean", ["emb"], "SELECT dim, avg(value) AS value FROM (" + long_sql("emb", "vec_id") + ") GROUP BY dim")


@register(
    "f02_mean_center",
    with_ctes(
        ["emb", "emb_mean"],
        f"""SELECT l.vec_id, l.dim, round(l.value - m.value, 6) + 0.0 AS value
            FROM ({long_sql('emb', 'vec_id')}) l JOIN emb_mean m ON l.dim = m.dim""",
    ),
)
def f02_mean_center(spark, sf):
    centred, _ = PO.mean_center(FX.embeddings(spark, sf))
    return spark_long(centred, ["vec_id"])


# --------------------------------------------------------------------------- lookup / encoding

add_cte("lookup_q", ["word_pairs"], """
SELECT pair_id, 'plain' AS variant, b AS w FROM word_pairs
UNION ALL SELECT pair_id, 'capital' AS variant, CASE WHEN b >= 'a' AND b < '{' THEN upper(substr(b, 1, 1)) || substr(b, 2) ELSE b END AS w FROM word_pairs""")


@register(
    "d01_lookup",
    with_ctes(
        ["lookup_q", "word2vec"],
        """SELECT q.pair_id, q.variant, coalesce(e.vec, l.vec) IS NOT NULL AS found,
                  round(list_reduce(coalesce(e.vec, l.vec), lambda a, b: a + b), 6) + 0.0 AS vsum
           FROM lookup_q q LEFT JOIN word2vec e ON e.word = q.w LEFT JOIN word2vec l ON l.word = lower(q.w)""",
    ),
)
def d01_lookup(spark, sf):
    """Exact, else lowercase (the capitalised variant only hits through lowercase)."""
    p = FX.word_pairs(spark, sf)
    q = p.select("pair_id", F.lit("plain").alias("variant"), F.col("b").alias("w")).unionByName(
        p.select("pair_id", F.lit("capital").alias("variant"),
                 # engines differ on the capital of some letters, e.g. the German sharp s
                 F.when((F.col("b") >= "a") & (F.col("b") < "{"), F.concat(F.upper(F.substring("b", 1, 1)), F.expr("substring(b, 2)")))
                 .otherwise(F.col("b")).alias("w"))
    )
    out = EN.lookup(q, FX.word2vec(spark, sf), "w")
    return out.select(
        "pair_id", "variant", F.col("vec").isNotNull().alias("found"),
        Vx.round_col(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("vsum"),
    )


def enc_sql(name: str, src: str, keys: str, text: str, punct_sql: str, reduce: str = "mean",
            normalize: bool = True, on_empty: str = "zero") -> None:
    """Register CTEs ``{name}_t`` (tokens), ``{name}_h`` (hits), ``{name}`` (long-form vectors)."""
    add_cte(f"{name}_t", [src], f"""
SELECT {keys}, w FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '{TOK}')) AS w FROM {src})
WHERE w NOT IN ({punct_sql})""")
    add_cte(f"{name}_h", [f"{name}_t", "word2vec"], f"""
SELECT {', '.join('t.' + k.strip() for k in keys.split(','))}, coalesce(e.vec, l.vec) AS vec
FROM {name}_t t LEFT JOIN word2vec e ON e.word = t.w LEFT JOIN word2vec l ON l.word = lower(t.w)
WHERE coalesce(e.vec, l.vec) IS NOT NULL""")
    agg = "avg(value)" if reduce == "mean" else "sum(value)"
    base = f"SELECT {keys}, dim, {agg} AS value FROM ({long_sql(name + '_h', keys)}) GROUP BY {keys}, dim"
    if on_empty == "zero":
        kk = ", ".join("s." + k.strip() for k in keys.split(","))
        on = " AND ".join(f"a.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
        base = (f"SELECT {kk}, d.dim, coalesce(a.value, 0.0) AS value FROM {src} s "
                f"CROSS JOIN (SELECT CAST(range AS BIGINT) AS dim FROM range(0, {DIM})) d "
                f"LEFT JOIN ({base}) a ON {on} AND a.dim = d.dim")
    if normalize:
        add_cte(f"{name}_raw", [src, f"{name}_h"], base)
        base = (f"SELECT r.* EXCLUDE (value), r.value / (n.nrm + 1e-8) AS value FROM {name}_raw r JOIN "
                f"(SELECT {keys}, sqrt(sum(value * value)) AS nrm FROM {name}_raw GROUP BY {keys}) n USING ({keys})")
        add_cte(name, [f"{name}_raw"], base)
    else:
        add_cte(name, [src, f"{name}_h"], base)


add_cte("turns", [], "SELECT conv_id, turn, text FROM conversations")
enc_sql("enc_mean", "turns", "conv_id, turn", "text", P1_SQL)
enc_sql("enc_sum", "turns", "conv_id, turn", "text", P1_SQL, reduce="sum", normalize=False)
enc_sql("enc_drop", "turns", "conv_id, turn", "text", P2_SQL, on_empty="drop")


def _turns(spark, sf):
    return FX.table(spark, sf, "conversations").select(
        F.struct("conv_id", "turn").alias("sent_id"), "conv_id", "turn", "text"
    )


def _enc(spark, sf, **kw):
    out = EN.encode(_turns(spark, sf), FX.word2vec(spark, sf), key="sent_id", dim=FX.dim(spark, sf), **kw)
    out = out.select(F.col("sent_id.conv_id").alias("conv_id"), F.col("sent_id.turn").alias("turn"), "vec")
    return spark_long(out, ["conv_id", "turn"])


@register("e13_encode_mean", with_ctes(["enc_mean"], out_long("enc_mean", "conv_id, turn")))
def e13_encode_mean(spark, sf):
    """Mean of known word vectors, zero vector when none, L2-normalised."""
    return _enc(spark, sf)


@register("e14_encode_sum", with_ctes(["enc_sum"], out_long("enc_sum", "conv_id, turn")))
def e14_encode_sum(spark, sf):
    """Sum of known word vectors (training students), no normalisation."""
    return _enc(spark, sf, reduce="sum", normalize=False)


@register("e15_encode_drop_empty", with_ctes(["enc_drop"], out_long("enc_drop", "conv_id, turn")))
def e15_encode_drop_empty(spark, sf):
    """Sentences with no known word are dropped; P2 punctuation."""
    return _enc(spark, sf, on_empty="drop", punct="P2")


PAIRS_SIM = """
SELECT p.pair_id, round(coalesce(sum(a.value * b.value), 0.0), 6) + 0.0 AS sim
FROM conv_pairs p
JOIN enc_pairs a ON a.pair_id = p.pair_id AND a.side = 0
JOIN enc_pairs b ON b.pair_id = p.pair_id AND b.side = 1 AND b.dim = a.dim
GROUP BY p.pair_id"""

add_cte("pair_texts", ["conv_pairs"], "SELECT pair_id, 0 AS side, a AS text FROM conv_pairs UNION ALL "
                                      "SELECT pair_id, 1 AS side, b AS text FROM conv_pairs")
enc_sql("enc_pairs", "pair_texts", "pair_id, side", "text", P1_SQL)


@register("d10_pair_similarity", with_ctes(["conv_pairs", "enc_pairs"], PAIRS_SIM))
def d10_pair_similarity(spark, sf):
    """D10 (flagship): cosine of mean-pooled, normalised turn vectors for adjacent turns."""
    sims = EN.pair_similarity(FX.conversation_pairs(spark, sf), FX.word2vec(spark, sf), dim=FX.dim(spark, sf))
    return sims.select("pair_id", Vx.round_col("sim").alias("sim"))


@register(
    "f09_cosine",
    with_ctes(
        ["word_pairs", "word2vec"],
        """SELECT p.pair_id,
                  round(list_reduce(list_transform(list_zip(x.vec, y.vec), lambda z: z[1] * z[2]), lambda a, b: a + b)
                        / ((sqrt(list_reduce(list_transform(x.vec, lambda v: v * v), lambda a, b: a + b)) + 1e-8)
                           * (sqrt(list_reduce(list_transform(y.vec, lambda v: v * v), lambda a, b: a + b)) + 1e-8)), 6) + 0.0
                  AS cosine
           FROM word_pairs p JOIN word2vec x ON x.word = p.a JOIN word2vec y ON y.word = p.b""",
    ),
)
def f09_cosine(spark, sf):
    """cosine of the two words' vectors (pairs with both words present)."""
    p = FX.word_pairs(spark, sf)
    w = FX.word2vec(spark, sf)
    x = w.select(F.col("word").alias("a"), F.col("vec").alias("va"))
    y = w.select(F.col("word").alias("b"), F.col("vec").alias("vb"))
    bound = FX.n_words(spark, sf)
    j = p.join(bounded_broadcast(x, bound, 600), "a").join(bounded_broadcast(y, bound, 600), "b")
    return j.select("pair_id", Vx.round_col(Vx.cosine("va", "vb")).alias("cosine"))


# ---- E13 over the whole corpus ------------------------------------------------------------------

add_cte("sent_keys", ["sentences"], "SELECT doc_id, line_no, sent_no, sentence AS text FROM sentences")
enc_sql("enc_corpus", "sent_keys", "doc_id, line_no, sent_no", "text", P1_SQL)


@register("e13_encode_corpus", with_ctes(["enc_corpus"], """
SELECT doc_id, line_no, sent_no, round(sum(value), 6) + 0.0 AS vsum, round(sqrt(sum(value * value)), 6) + 0.0 AS norm
FROM enc_corpus GROUP BY doc_id, line_no, sent_no"""))
def e13_encode_corpus(spark, sf):
    """E13 on every sentence of the corpus (per-sentence vector sum and norm)."""
    s = FX.sentences(spark, sf).select("doc_id", "line_no", "sent_no", F.col("sentence").alias("text"))
    out = EN.encode(s, FX.word2vec(spark, sf), key=["doc_id", "line_no", "sent_no"], dim=FX.dim(spark, sf))
    return out.select(
        "doc_id", "line_no", "sent_no",
        Vx.round_col(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("vsum"),
        Vx.round_col(Vx.norm("vec")).alias("norm"))
