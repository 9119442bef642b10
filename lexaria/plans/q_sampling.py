"""Registered queries: samplers, splits, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexaria.functions import vectors as Vx
from lexaria.operators import sampling as S
from lexaria.operators import vocabulary as V
from lexaria.plans import fixtures as FX
from lexaria.plans.catalog import register
from lexaria.plans.oracle import add_cte, with_ctes
from lexaria.plans.q_text import contexts
from lexaria.sources import corpus as C

SEED = 42


def h(*parts: str) -> str:
    """DuckDB twin of ``text.hash_key``."""
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


add_cte("per_word", ["ctx"], f"""
SELECT word, rn, doc_id, line_no, sent_no, sentence,
       count(*) OVER (PARTITION BY word) AS cnt,
       row_number() OVER (PARTITION BY word ORDER BY {h(SEED, 'word', 'rn')}) AS pick
FROM ctx""")

add_cte("g3_idx", ["per_word"], f"""
SELECT sentence, row_number() OVER (ORDER BY {h(SEED, 'sentence')}, sentence) - 1 AS idx
FROM (SELECT DISTINCT sentence FROM per_word WHERE cnt >= 3 AND pick <= 3)""")

add_cte("g3", ["g3_idx"], """
SELECT sentence, CASE WHEN idx < CAST(floor((SELECT count(*) FROM g3_idx) * 0.8) AS BIGINT) THEN 'train' ELSE 'val' END
       AS split, CAST(idx AS BIGINT) AS idx FROM g3_idx""")


@register("g03_training_split", with_ctes(["g3"], "SELECT sentence, split, idx FROM g3"))
def g03_training_split(spark, sf):
    """G3 + H2: 3 sentences per word, distinct, hash shuffle, 80/20 split."""
    return S.training_split(contexts(spark, sf), 3, 0.8, SEED)


@register("h05_split_overlap", with_ctes(["g3"], """
SELECT CAST(count(*) AS BIGINT) AS n_overlap FROM
 (SELECT sentence FROM g3 WHERE split = 'train' INTERSECT SELECT sentence FROM g3 WHERE split = 'val')"""))
def h05_split_overlap(spark, sf):
    """H5: the train/val overlap must be empty."""
    sp = S.training_split(contexts(spark, sf), 3, 0.8, SEED)
    ov = S.overlap(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val"))
    return ov.agg(F.count(F.lit(1)).cast("bigint").alias("n_overlap"))


@register("g04_historical_split", with_ctes(["per_word"], f"""
SELECT sentence, 'train' AS split FROM (SELECT DISTINCT sentence FROM per_word WHERE cnt >= 5 AND pick <= 2)
UNION ALL
SELECT sentence, 'dev' AS split FROM (
  SELECT sentence FROM (SELECT DISTINCT sentence FROM per_word WHERE cnt >= 5 AND pick = 3
                        EXCEPT SELECT sentence FROM per_word WHERE cnt >= 5 AND pick <= 2)
  ORDER BY {h(SEED, "'dev'", 'sentence')}, sentence LIMIT 10000)"""))
def g04_historical_split(spark, sf):
    """G4 + H3: 2 train / 1 dev per word with >= 5 sentences, dev minus train, <= 10,000 dev."""
    return S.historical_split(contexts(spark, sf), SEED, 10000)


add_cte("g5_words", ["ctx"], """
SELECT word, row_number() OVER (ORDER BY word) - 1 AS widx
FROM (SELECT word FROM ctx GROUP BY word HAVING count(*) >= 2)""")


@register("g05_contrastive_pairs", with_ctes(["g5_words", "ctx"], f"""
SELECT draw, word, max(CASE WHEN k = 1 THEN sentence END) AS s1, max(CASE WHEN k = 2 THEN sentence END) AS s2
FROM (SELECT d.draw, w.word, c.sentence,
             row_number() OVER (PARTITION BY d.draw ORDER BY {h(SEED, 'd.draw', 'c.rn')}, c.rn) AS k
      FROM (SELECT range AS draw,
                   CAST(('0x' || substr({h(SEED, 'range')}, 1, 15)) AS BIGINT) % (SELECT count(*) FROM g5_words) AS widx
            FROM range(0, 10000)) d
      JOIN g5_words w ON w.widx = d.widx
      JOIN ctx c ON c.word = w.word)
WHERE k <= 2 GROUP BY draw, word"""))
def g05_contrastive_pairs(spark, sf):
    """10,000 draws of (word, two different sentences of it)."""
    return S.contrastive_pairs(contexts(spark, sf), 10000, SEED)


@register("g06_one_per_word", with_ctes(["per_word"], """
SELECT word, sentence FROM (
  SELECT p.word, p.sentence, f.d, f.l, f.s FROM per_word p
  JOIN (SELECT word, min(doc_id) AS d, arg_min(line_no, (doc_id, line_no, sent_no)) AS l,
               arg_min(sent_no, (doc_id, line_no, sent_no)) AS s FROM ctx GROUP BY word) f ON f.word = p.word
  WHERE p.cnt >= 3 AND p.pick = 1
  ORDER BY f.d, f.l, f.s, p.word LIMIT 100000)"""))
def g06_one_per_word(spark, sf):
    """One hash-chosen sentence per word with >= 3, at most 100,000."""
    return S.one_per_word(contexts(spark, sf), 3, 100000, SEED)


def _ctx_lang(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", "lang")
    return contexts(spark, sf).join(d, "doc_id")


add_cte("ctx_lang", ["ctx"], "SELECT c.*, d.lang, count(*) OVER (PARTITION BY c.word) AS cnt "
                             "FROM ctx c JOIN documents d ON c.doc_id = d.doc_id")


@register("g07_language_sample", with_ctes(["ctx_lang"], f"""
SELECT word, sentence FROM (
  SELECT h.word, h.sentence, h.k, f.d, f.l, f.s FROM (
    SELECT word, sentence, row_number() OVER (PARTITION BY word ORDER BY {h(SEED, 'word', 'rn')}, rn) AS k
    FROM ctx_lang WHERE cnt >= 10 AND lang = 'en') h
  JOIN (SELECT word, min(doc_id) AS d, arg_min(line_no, (doc_id, line_no, sent_no)) AS l,
               arg_min(sent_no, (doc_id, line_no, sent_no)) AS s FROM ctx GROUP BY word) f ON f.word = h.word
  WHERE h.k <= 5 ORDER BY f.d, f.l, f.s, h.word, h.k LIMIT 100000)"""))
def g07_language_sample(spark, sf):
    """G7 + C15: up to 5 English sentences per word with >= 10, at most 100,000."""
    return S.language_sample(_ctx_lang(spark, sf), "en", 5, 10, 100000, SEED)


@register("g07_language_share", with_ctes(["ctx_lang"], """
SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT) AS n_target,
       round(count(*) FILTER (WHERE lang = 'en') / count(*), 6) + 0.0 AS share
FROM ctx_lang WHERE cnt >= 10"""))
def g07_language_share(spark, sf):
    out = S.language_share(_ctx_lang(spark, sf), "en", 10)
    return out.withColumn("share", Vx.round_col("share"))


@register("g08_shuffled_sample", with_ctes(["ctx"], f"""
SELECT word, rn, sentence FROM ctx ORDER BY {h(SEED, 'word', 'rn')}, word, rn LIMIT 10000"""))
def g08_shuffled_sample(spark, sf):
    """10,000 contexts in hash order (the PCA fit sample)."""
    return S.shuffled_sample(contexts(spark, sf), 10000, SEED)


@register("g09_head_contexts", with_ctes(["ctx", "vocab"], """
SELECT c.word, v.word_idx, c.rn, c.sentence FROM ctx c JOIN vocab v ON v.word = c.word
WHERE v.word_idx < 1000 AND c.rn <= 5 ORDER BY v.word_idx, c.rn LIMIT 5000"""))
def g09_head_contexts(spark, sf):
    """First 1000 words x first 5 contexts, first 5000 (the pipeline's PCA sample)."""
    return S.head_contexts(contexts(spark, sf), FX.vocab(spark, sf), 1000, 5, 5000)


add_cte("g10", ["sentences"], f"""
SELECT key, row_number() OVER (ORDER BY {h(SEED, 0, 'key')}, key) - 1 AS idx FROM
  (SELECT concat_ws('|', CAST(doc_id AS VARCHAR), CAST(line_no AS VARCHAR), CAST(sent_no AS VARCHAR)) AS key
   FROM sentences)""")


@register("g10_epoch_batches", with_ctes(["g10"], """
SELECT key, CAST(idx AS BIGINT) AS idx, CAST(idx // 128 AS BIGINT) AS batch_id, CAST(idx % 128 AS BIGINT) AS i
FROM g10
WHERE idx < (SELECT count(*) FROM g10) // 128 * 128 OR (SELECT count(*) FROM g10) % 128 >= 2"""))
def g10_epoch_batches(spark, sf):
    """Epoch-0 hash shuffle of all sentences into batches of 128 (tail kept if >= 2)."""
    s = FX.sentences(spark, sf).select(F.concat_ws("|", "doc_id", "line_no", "sent_no").alias("key"))
    return S.epoch_batches(s, "key", 128, 0, SEED).select("key", "idx", "batch_id", "i")


@register("g11_hold_out_last", with_ctes(["conv_pairs"], """
SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY pair_id) - 1 >= (SELECT count(*) FROM conv_pairs) - 50
                     THEN 'val' ELSE 'train' END AS split FROM conv_pairs"""))
def g11_hold_out_last(spark, sf):
    """The last 50 aligned pairs (by position) are held out."""
    return S.hold_out_last(FX.conversation_pairs(spark, sf), 50).select("pair_id", "split")


@register("g12_first_n", with_ctes(["sentences"], """
SELECT doc_id, line_no, sent_no, sentence FROM sentences ORDER BY doc_id, line_no, sent_no LIMIT 1000"""))
def g12_first_n(spark, sf):
    """Corpus cap (first 1000 sentences in corpus order)."""
    return S.first_n(FX.sentences(spark, sf), ["doc_id", "line_no", "sent_no"], 1000)


add_cte("loss_hist", ["emb"], """
SELECT CAST(label AS BIGINT) AS epoch, round(avg(vec[1]) + 1.0, 2) AS val_loss FROM emb GROUP BY label""")


@register("g13_early_stopping", with_ctes(["loss_hist"], """
WITH x AS (
  SELECT epoch, val_loss,
         (min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS best_before
  FROM loss_hist),
y AS (SELECT *, best_before IS NULL OR val_loss < best_before AS is_best FROM x),
z AS (SELECT *, epoch - max(CASE WHEN is_best THEN epoch END) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING)
              AS since_best FROM y),
s AS (SELECT *, min(CASE WHEN since_best >= 2 THEN epoch END) OVER () AS stop_epoch FROM z)
SELECT epoch, val_loss, is_best, CAST(since_best AS BIGINT) AS since_best,
       coalesce(epoch = stop_epoch, false) AS stop, stop_epoch IS NULL OR epoch <= stop_epoch AS ran FROM s""".replace(
    "WITH x AS", ", x AS")))
def g13_early_stopping(spark, sf):
    """G13 over a loss history derived per label (patience 2 so the stop is exercised)."""
    e = FX.embeddings(spark, sf)
    hist = e.groupBy("label").agg(F.round(F.avg(F.col("vec")[0]) + 1.0, 2).alias("val_loss")).select(
        F.col("label").cast("bigint").alias("epoch"), "val_loss"
    )
    return S.early_stopping(hist, 2)


# ---- H1 / H2 ----------------------------------------------------------------------------

def _lang_vocab_sql(lang: str) -> str:
    return f"""
SELECT word FROM (SELECT t.word, count(*) AS freq FROM tokens t JOIN documents d ON d.doc_id = t.doc_id
                  WHERE d.lang = '{lang}' GROUP BY t.word)
WHERE freq >= 10 AND length(word) >= 3 AND regexp_matches(word, '\\p{{L}}') AND NOT starts_with(word, '#')
  AND NOT starts_with(word, '@') AND NOT starts_with(word, 'http')"""


add_cte("vocab_en", ["tokens"], _lang_vocab_sql("en"))
add_cte("vocab_de", ["tokens"], _lang_vocab_sql("de"))


def _lang_vocab(spark, sf, lang):
    d = FX.table(spark, sf, "documents").where(F.col("lang") == lang).select("doc_id", "text")
    toks = V.tokens(C.sentences(C.document_lines(d)))
    return V.filter_vocabulary(V.word_counts(toks), FX.MIN_FREQ, FX.MIN_LEN, None)


@register("h01_vocabulary_union", with_ctes(["vocab_en", "vocab_de"],
                                            "SELECT word FROM vocab_en UNION SELECT word FROM vocab_de"))
def h01_vocabulary_union(spark, sf):
    """H1: distinct union of the English and German vocabularies."""
    return V.union_vocabularies(_lang_vocab(spark, sf, "en"), _lang_vocab(spark, sf, "de"))


@register("h02_distinct_sentences", with_ctes(["ctx"], "SELECT DISTINCT sentence FROM ctx"))
def h02_distinct_sentences(spark, sf):
    """H2: distinct context sentences."""
    return S.distinct_sentences(contexts(spark, sf).select("sentence"))
