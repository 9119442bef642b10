"""Registered queries: pieces, positions, sub-word lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.functions import vectors as Vx
from lexaria.operators import encode as EN
from lexaria.operators import positions as PS
from lexaria.plans import fixtures as FX
from lexaria.plans.catalog import register
from lexaria.plans.oracle import add_cte, with_ctes
from lexaria.plans.q_text import contexts

TOK = T.TOKEN_PATTERN


def pieces_sql(w: str) -> str:
    chunks = f"regexp_extract_all({w}, '.{{1,3}}')"
    return (f"(CASE WHEN regexp_matches({w}, '^[0-9]') THEN list_concat(['▁'], {chunks}) "
            f"ELSE list_transform({chunks}, lambda p, i: CASE WHEN i = 1 THEN '▁' || p ELSE p END) END)")


def word_pieces_sql(w: str) -> str:
    p = pieces_sql(w)
    return f"(CASE WHEN len({p}) > 0 AND {p}[1] = '▁' THEN {p}[2:] ELSE {p} END)"


def sentence_pieces_sql(s: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({s}, '{TOK}'), lambda w: {pieces_sql('w')}))"


def first_pos_sql(t: str, w: str, start: str) -> str:
    return (f"(CASE WHEN len({w}) > 0 THEN list_filter(range({start}, len({t}) - len({w}) + 1), "
            f"lambda i: i >= {start} AND {t}[i + 1:i + len({w})] = {w})[1] END)")


add_cte("ctx_pieces", ["ctx"], f"""
SELECT word, rn, sentence, {sentence_pieces_sql('sentence')} AS t, {word_pieces_sql('word')} AS w FROM ctx""")


@register("c16_word_positions", with_ctes(["ctx_pieces"], f"""
SELECT word, rn, CAST(s AS BIGINT) AS start, CAST(len(w) AS BIGINT) AS n_pieces, CAST(s + len(w) - 1 AS BIGINT) AS last
FROM (SELECT *, {first_pos_sql('t', 'w', '0')} AS s FROM ctx_pieces WHERE len(t) <= 500) WHERE s IS NOT NULL"""))
def c16_word_positions(spark, sf):
    """C16 + C17: first piece-sequence match of the word in each of its contexts."""
    out = PS.find_positions(contexts(spark, sf), max_len=500)
    return out.select("word", "rn", F.col("start").cast("bigint").alias("start"),
                      F.col("n_pieces").cast("bigint").alias("n_pieces"),
                      F.element_at("pos", -1).cast("bigint").alias("last"))


PROMPT = "query: represent this sentence"
add_cte("ctx_prompt", ["ctx"], f"""
SELECT word, rn, {sentence_pieces_sql(f"'{PROMPT} ' || sentence")} AS t, {word_pieces_sql('word')} AS w,
       len({sentence_pieces_sql(f"'{PROMPT}'")}) AS off FROM ctx""")


@register("c09_prompted_positions", with_ctes(["ctx_prompt"], f"""
SELECT word, rn, CAST(s AS BIGINT) AS start, CAST(off AS BIGINT) AS offset
FROM (SELECT *, {first_pos_sql('t', 'w', 'off')} AS s FROM ctx_prompt WHERE len(t) < 500) WHERE s IS NOT NULL"""))
def c09_prompted_positions(spark, sf):
    """C9 + C17 (cap ``>= 500`` pieces): prompt-prefixed sentences, search from the prompt's end."""
    out = PS.find_positions(contexts(spark, sf), max_len=500, strict=True, prompt=PROMPT)
    off = F.size(PS.sentence_pieces(F.lit(PROMPT)))
    return out.select("word", "rn", F.col("start").cast("bigint").alias("start"), off.cast("bigint").alias("offset"))


@register("c17_cap_after_search", with_ctes(["ctx_prompt"], f"""
SELECT word, rn, CAST(s AS BIGINT) AS start FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY rn) AS nth FROM (
    SELECT *, {first_pos_sql('t', 'w', 'off')} AS s FROM ctx_prompt WHERE len(t) < 500) WHERE s IS NOT NULL)
WHERE nth <= 4"""))
def c17_cap_after_search(spark, sf):
    """C17: at most 4 contexts of a word, counted after the search."""
    out = PS.find_positions(contexts(spark, sf), max_len=500, strict=True, prompt=PROMPT, n_contexts=4, cap="after")
    return out.select("word", "rn", F.col("start").cast("bigint").alias("start"))


@register("c16_subword_positions", with_ctes(["ctx_pieces"], f"""
SELECT word, rn, CAST(s AS BIGINT) AS start FROM (
  SELECT *, (CASE WHEN len(w) > 0 THEN list_filter(range(0, len(t) - len(w) + 1),
               lambda i: trim(replace(replace(t[i + 1], '##', ''), '▁', '')) = word)[1] END) AS s
  FROM ctx_pieces WHERE len(t) <= 500) WHERE s IS NOT NULL"""))
def c16_subword_positions(spark, sf):
    """C16 sub-word mode: one stripped piece equal to the word (loop bound from the word's piece count)."""
    out = PS.find_positions(contexts(spark, sf), max_len=500, subword_mode=True)
    return out.select("word", "rn", F.col("start").cast("bigint").alias("start"))


@register("c13_word_pieces", with_ctes(["counts"], f"""
SELECT word, CAST(len({pieces_sql('word')}) AS BIGINT) AS n_raw, CAST(len({word_pieces_sql('word')}) AS BIGINT) AS n_pieces,
       array_to_string({word_pieces_sql('word')}, '|') AS pieces FROM counts"""))
def c13_word_pieces(spark, sf):
    """C13 (+J1 pieces): pieces of every counted word, a lone leading ``▁`` dropped."""
    c = FX.counts(spark, sf)
    raw = PS.chunk_pieces(F.col("word"))
    wp = PS.word_pieces(F.col("word"))
    return c.select("word", F.size(raw).cast("bigint").alias("n_raw"), F.size(wp).cast("bigint").alias("n_pieces"),
                    F.array_join(wp, "|").alias("pieces"))


@register("c12_strip_markers", with_ctes(["counts"], f"""
SELECT word, replace(replace(array_to_string({pieces_sql('word')}, '##'), '##', ''), '▁', '') AS rebuilt FROM counts"""))
def c12_strip_markers(spark, sf):
    """Pieces joined with ``##`` then both markers removed give the word back."""
    c = FX.counts(spark, sf)
    joined = F.array_join(PS.chunk_pieces(F.col("word")), "##")
    return c.select("word", T.strip_markers(joined).alias("rebuilt"))


add_cte("sent_lang", ["sentences"], "SELECT s.*, d.lang FROM sentences s JOIN documents d ON d.doc_id = s.doc_id")


@register("c14_language_tokens", with_ctes(["sent_lang"], f"""
SELECT doc_id, line_no, sent_no, CAST(len(CASE WHEN coalesce(lang, 'en') IN ('ja', 'zh')
         THEN list_filter(list_transform({sentence_pieces_sql('sentence')}, lambda p: replace(p, '▁', '')), lambda p: p <> '')
         ELSE regexp_extract_all(sentence, '{TOK}') END) AS BIGINT) AS n_tokens
FROM sent_lang"""))
def c14_language_tokens(spark, sf):
    """C14: language-routed tokenisation (ja/zh pieces, others words, unknown = en)."""
    d = FX.table(spark, sf, "documents").select("doc_id", "lang")
    s = FX.sentences(spark, sf).join(d, "doc_id")
    out = PS.language_tokens(s)
    return out.select("doc_id", "line_no", "sent_no", F.size("tokens").cast("bigint").alias("n_tokens"))


@register("c10_vocabulary_lowercase", with_ctes(["vocab", "ctx"], """
SELECT (SELECT bool_and(word = lower(word)) FROM vocab) AS all_lower,
       CAST(count(*) FILTER (WHERE sentence = lower(sentence)) AS BIGINT) AS n_lower_contexts FROM ctx"""))
def c10_vocabulary_lowercase(spark, sf):
    """Vocabulary-is-lowercase test; contexts are lowercased iff it holds."""
    low = PS.vocabulary_is_lowercase(FX.vocab(spark, sf))
    ctx = contexts(spark, sf)
    text = F.lower("sentence") if low else F.col("sentence")
    return ctx.select(text.alias("s")).agg(
        F.lit(low).alias("all_lower"),
        F.count_if(F.col("s") == F.lower("s")).cast("bigint").alias("n_lower_contexts"))


@register("c11_output_key", with_ctes(["word_pairs"], """
SELECT pair_id, replace(ltrim('  ' || a || ' ' || b), ' ', '▁') AS key FROM word_pairs"""))
def c11_output_key(spark, sf):
    """C11: multi-word output keys — leading spaces stripped, inner spaces become ``▁``."""
    p = FX.word_pairs(spark, sf)
    return p.select("pair_id", T.output_key(F.concat(F.lit("  "), "a", F.lit(" "), "b")).alias("key"))


# ---- D2 sub-word fallback ---------------------------------------------------------------------

add_cte("oov_words", ["word_pairs", "word2vec"], """
SELECT DISTINCT b AS word FROM word_pairs WHERE b NOT IN (SELECT word FROM word2vec)
  AND lower(b) NOT IN (SELECT word FROM word2vec)""")


@register("d02_subword_lookup", with_ctes(["oov_words", "word2vec"], f"""
SELECT word, CAST(max(plen) AS BIGINT) AS plen,
       round(list_reduce(arg_max(vec, plen), lambda a, b: a + b), 6) + 0.0 AS vsum FROM (
  SELECT o.word, o.plen, coalesce(e.vec, l.vec) AS vec FROM (
    SELECT word, plen, replace(replace(array_to_string(p[1:plen], ''), '##', ''), '▁', '') AS prefix FROM (
      SELECT word, p, unnest(range(1, len(p))) AS plen FROM (SELECT word, {pieces_sql('word')} AS p FROM oov_words)
      WHERE len(p) > 1)) o
  LEFT JOIN word2vec e ON e.word = o.prefix LEFT JOIN word2vec l ON l.word = lower(o.prefix))
WHERE vec IS NOT NULL GROUP BY word"""))
def d02_subword_lookup(spark, sf):
    """Longest proper piece-prefix of each OOV word that has a vector."""
    w2v = FX.word2vec(spark, sf)
    p = FX.word_pairs(spark, sf).select(F.col("b").alias("word")).distinct()
    from lexaria.operators.contexts import out_of_vocabulary

    oov = out_of_vocabulary(p, w2v, "word").select("word", PS.chunk_pieces(F.col("word")).alias("pieces"))
    hits = EN.subword_lookup(oov, w2v)
    plen = oov.select("word", F.explode(F.sequence(F.lit(1), F.size("pieces") - 1)).alias("plen"), "pieces")
    plen = plen.withColumn("prefix", T.strip_markers(F.array_join(F.slice("pieces", 1, F.col("plen")), "")))
    best = EN.lookup(plen, w2v, "prefix").where(
        F.col("vec").isNotNull()).groupBy("word").agg(F.max("plen").cast("bigint").alias("plen"))
    return hits.join(best, "word").select(
        "word", "plen", Vx.round_col(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("vsum"))


@register("e13_encode_subword")
def e13_encode_subword(spark, sf):
    """E13 + D2 + J1: conversation turns encoded with the sub-word fallback for OOV words."""
    t = FX.table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("sent_id"), "text")
    out = EN.encode(t, FX.word2vec(spark, sf), key="sent_id", dim=FX.dim(spark, sf), pieces=PS.chunk_pieces)
    out = out.select(F.col("sent_id.conv_id").alias("conv_id"), F.col("sent_id.turn").alias("turn"), "vec")
    return Vx.long_form(out, ["conv_id", "turn"], "vec")


# ---- E27 / E28 word senses --------------------------------------------------------------------

@register("e27_sense_invariants", with_ctes(["contexts"], """
SELECT word, CAST(greatest(1, least(3, count(*) // 5)) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n_contexts
FROM contexts GROUP BY word"""))
def e27_sense_invariants(spark, sf):
    """Per word the induced sense count k = max(1, min(3, n // 5)) and the contexts covered."""
    from lexaria.operators import senses as SN

    ctx = FX.contexts(spark, sf)
    labels = SN.sense_labels(ctx, 3, 5)
    return labels.groupBy("word").agg(
        (F.max("sense_id") + 1).cast("bigint").alias("k"), F.count(F.lit(1)).cast("bigint").alias("n_contexts"))


@register("e27_multi_sense")
def e27_multi_sense(spark, sf):
    """Centroid and size of every sense (k-means per word; labels are unique only up to permutation)."""
    from lexaria.operators import senses as SN

    out = SN.multi_sense(FX.contexts(spark, sf), 3, 5)
    return out.select("word", "sense_id", "n_ctx", Vx.round_col(Vx.norm("vec")).alias("centroid_norm"))


@register("e28_optimal_senses")
def e28_optimal_senses(spark, sf):
    """Best sense count by silhouette (k = 2..5, every cluster >= 5 contexts)."""
    from lexaria.operators import senses as SN

    out = SN.optimal_senses(FX.contexts(spark, sf), 5, 5)
    return out.select("word", "best_k", Vx.round_col("best_score").alias("best_score"))


# ---- oracle for E13 + D2 (sub-word fallback inside the encoder) -------------------------------

def _subword_encoder_sql() -> str:
    from lexaria.plans.oracle import CTES, P1_SQL
    from lexaria.plans.q_vectors import enc_sql, out_long

    enc_sql("enc_sub", "turns", "conv_id, turn", "text", P1_SQL)
    add_cte("enc_sub_direct", ["enc_sub_t", "word2vec"], """
SELECT t.conv_id, t.turn, t.w, coalesce(e.vec, l.vec) AS vec
FROM enc_sub_t t LEFT JOIN word2vec e ON e.word = t.w LEFT JOIN word2vec l ON l.word = lower(t.w)""")
    add_cte("enc_sub_fb", ["enc_sub_direct", "word2vec"], f"""
SELECT w, arg_max(vec, plen) AS vec FROM (
  SELECT o.w, o.plen, coalesce(e.vec, l.vec) AS vec FROM (
    SELECT w, plen, replace(replace(array_to_string(p[1:plen], ''), '##', ''), '▁', '') AS prefix FROM (
      SELECT w, p, unnest(range(1, len(p))) AS plen
      FROM (SELECT w, {pieces_sql('w')} AS p FROM (SELECT DISTINCT w FROM enc_sub_direct WHERE vec IS NULL))
      WHERE len(p) > 1)) o
  LEFT JOIN word2vec e ON e.word = o.prefix LEFT JOIN word2vec l ON l.word = lower(o.prefix))
WHERE vec IS NOT NULL GROUP BY w""")
    # the hits relation of the encoder: direct hits, else the sub-word fallback
    CTES["enc_sub_h"] = (["enc_sub_direct", "enc_sub_fb"], """
SELECT d.conv_id, d.turn, coalesce(d.vec, f.vec) AS vec
FROM enc_sub_direct d LEFT JOIN enc_sub_fb f ON f.w = d.w WHERE coalesce(d.vec, f.vec) IS NOT NULL""")
    return with_ctes(["enc_sub"], out_long("enc_sub", "conv_id, turn"))


from lexaria.plans.catalog import ORACLE  # noqa: E402

ORACLE["e13_encode_subword"] = _subword_encoder_sql()


# ---- E28 silhouette for given labels --------------------------------------------------------------

add_cte("ctx_lab", ["contexts"], "SELECT word, ctx, vec, CASE WHEN vec[1] > 0 THEN 1 ELSE 0 END AS lab FROM contexts")
add_cte("sil_pairs", ["ctx_lab"], """
SELECT a.word, a.ctx AS i, a.lab AS li, b.lab AS lj,
       avg(sqrt(list_reduce(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])),
                            lambda x, y: x + y))) AS md
FROM ctx_lab a JOIN ctx_lab b ON a.word = b.word AND a.ctx <> b.ctx
GROUP BY a.word, a.ctx, a.lab, b.lab""")


@register("e28_silhouette_given_labels", with_ctes(["ctx_lab", "sil_pairs"], """
SELECT w.word, round(CASE WHEN w.n_lab < 2 THEN -1.0 ELSE s.score END, 6) + 0.0 AS silhouette
FROM (SELECT word, count(DISTINCT lab) AS n_lab FROM ctx_lab GROUP BY word) w
LEFT JOIN (
  SELECT word, avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS score FROM (
    SELECT c.word, c.ctx,
           max(CASE WHEN p.lj = p.li THEN p.md END) AS a,
           min(CASE WHEN p.lj <> p.li THEN p.md END) AS b
    FROM ctx_lab c LEFT JOIN sil_pairs p ON p.word = c.word AND p.i = c.ctx
    GROUP BY c.word, c.ctx)
  GROUP BY word) s ON s.word = w.word"""))
def e28_silhouette_given_labels(spark, sf):
    """Silhouette (Euclidean) of each word's contexts under data-derived labels
    (sign of the first coordinate), the score the sense-count search maximises."""
    from lexaria.operators import senses as SN

    ctx = FX.contexts(spark, sf).withColumn("sense_id", F.when(F.col("vec")[0] > 0, 1).otherwise(0))
    out = SN.silhouette_scores(ctx)
    return out.select("word", Vx.round_col("silhouette").alias("silhouette"))


@register("e27_sense_mass", with_ctes(["contexts"], """
SELECT word, dim, round(sum(value), 6) + 0.0 AS value FROM (
  SELECT word, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS dim, unnest(vec) AS value FROM contexts)
GROUP BY word, dim"""))
def e27_sense_mass(spark, sf):
    """E27 invariant (label-permutation free): Σ_senses n_ctx · centroid equals the sum of the
    word's context vectors, so the senses partition the contexts and centroids are exact means."""
    from lexaria.operators import senses as SN
    from lexaria.operators.pooling import group_sum

    senses = SN.multi_sense(FX.contexts(spark, sf), 3, 5)
    mass = group_sum(senses, ["word"], vec="vec", weight="n_ctx")
    return Vx.long_form(mass, ["word"], "vec")
