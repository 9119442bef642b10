"""Registered queries: language detection (C15) and learned sentence boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexaria.functions import vectors as Vx
from lexaria.operators import language as LG
from lexaria.operators.batching import budget_batches
from lexaria.plans import fixtures as FX
from lexaria.plans.catalog import register
from lexaria.plans.oracle import TOK, WS, add_cte, gold, with_ctes

add_cte("lang_words", [], f"""
SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS word FROM documents) GROUP BY ALL""")
add_cte("lang_grams", ["lang_words"], """
SELECT word, substr(' ' || word || ' ', CAST(i AS INTEGER), 3) AS gram
FROM (SELECT word, unnest(range(1, greatest(length(word), 1) + 1)) AS i FROM (SELECT DISTINCT word FROM lang_words))""")
add_cte("lang_seen", ["lang_words", "lang_grams"], f"""
SELECT d.lang, g.gram, sum(w.n) AS c FROM lang_words w JOIN documents d ON d.doc_id = w.doc_id JOIN lang_grams g ON g.word = w.word
WHERE NOT {gold('w.doc_id', "'lang'")} < 0.2 GROUP BY ALL""")
add_cte("lang_model", ["lang_seen"], """
SELECT g.gram, t.lang, ln((coalesce(s.c, 0) + 0.5) / (t.total + 0.5 * (SELECT count(DISTINCT gram) FROM lang_seen))) AS logp
FROM (SELECT DISTINCT gram FROM lang_seen) g CROSS JOIN (SELECT lang, sum(c) AS total FROM lang_seen GROUP BY lang) t
LEFT JOIN lang_seen s ON s.gram = g.gram AND s.lang = t.lang""")


@register("c15_language_detection", with_ctes(["lang_words", "lang_grams", "lang_model"], f"""
SELECT x.doc_id, d.lang, {gold('x.doc_id', "'lang'")} < 0.2 AS held_out, arg_max(x.lang, x.s) AS predicted, round(max(x.s), 3) + 0.0 AS score
FROM (SELECT w.doc_id, m.lang, sum(w.n * m.s) AS s FROM lang_words w
      JOIN (SELECT g.word, m.lang, sum(m.logp) AS s FROM lang_grams g JOIN lang_model m ON m.gram = g.gram GROUP BY ALL) m ON m.word = w.word
      GROUP BY ALL) x JOIN documents d ON d.doc_id = x.doc_id GROUP BY x.doc_id, d.lang"""))
def c15_language_detection(spark, sf):
    """Character trigram log-likelihoods learned from four fifths of ``documents.lang``, scored on all documents."""
    docs = FX.table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = FX.T.hash_gold(F.col("doc_id"), F.lit("lang")) < 0.2
    texts = docs.select("doc_id", "text")
    model = LG.gram_model_of(LG.language_words(texts, docs.where(~held & F.col("lang").isNotNull()).select("doc_id", "lang")))
    got = LG.detect_texts(texts, model.checkpoint(eager=True)).join(docs.select("doc_id", "lang", held.alias("held_out")), "doc_id")
    return got.select("doc_id", "lang", "held_out", "predicted", Vx.round_col("score", 3).alias("score"))


add_cte("abbr", [], r"""
SELECT word, n, n_dot, ratio, ratio * exp(-length(word)) * pow(CAST(length(word) AS DOUBLE), -CAST(n - n_dot AS DOUBLE)) AS score
FROM (SELECT word, n, n_dot, -2 * ((n_dot * ln(p) + (n - n_dot) * ln(1 - p)) - (n_dot * ln(0.99::DOUBLE) + (n - n_dot) * ln(0.01::DOUBLE))) AS ratio
      FROM (SELECT word, n, n_dot, (sum(n_dot) OVER ()) / CAST(sum(n) OVER () AS DOUBLE) AS p
            FROM (SELECT lower(rtrim(t, '.')) AS word, count(*) AS n, CAST(sum(CASE WHEN t LIKE '%.' THEN 1 ELSE 0 END) AS BIGINT) AS n_dot
                  FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+\.?')) AS t FROM documents) GROUP BY 1)) WHERE n_dot > 0)""")


@register("c01_abbreviations", with_ctes(["abbr"], """
SELECT word, n, n_dot, round(ratio, 4) + 0.0 AS ratio, score >= 0.3 AS abbreviation FROM abbr"""))
def c01_abbreviations(spark, sf):
    """Likelihood ratio of every word type that its full stop belongs to it, over all documents."""
    got = LG.abbreviations(FX.table(spark, sf, "documents").select("text"))
    return got.select("word", "n", "n_dot", Vx.round_col("ratio", 4).alias("ratio"), "abbreviation")


@register("c01_learned_sentences", with_ctes(["lines", "abbr"], rf"""
SELECT doc_id, line_no, CAST(count(*) AS BIGINT) AS n_pieces,
       CAST(1 + sum(CASE WHEN k < last AND a.word IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_sentences
FROM (SELECT doc_id, line_no, k, last, lower(regexp_extract(piece, '(\p{{L}}+)\.$', 1)) AS w
      FROM (SELECT doc_id, line_no, generate_subscripts(ps, 1) AS k, len(ps) AS last, unnest(ps) AS piece
            FROM (SELECT doc_id, line_no, string_split(regexp_replace(line, '([.!?])[{WS}]+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM lines))) p
LEFT JOIN (SELECT word FROM abbr WHERE score >= 0.3) a ON a.word = p.w
GROUP BY doc_id, line_no"""))
def c01_learned_sentences(spark, sf):
    """Pieces of the regex splitter and sentences after joining at learned abbreviations, per line."""
    docs = FX.table(spark, sf, "documents").select("doc_id", "text")
    lines = FX.lines(spark, sf)
    got = LG.sentences_by_abbreviation(lines, LG.abbreviations(docs))
    pieces = lines.select("doc_id", "line_no", F.size(FX.T.split_sentences(F.col("line"))).cast("bigint").alias("n_pieces"))
    counts = got.groupBy("doc_id", "line_no").agg(F.count("*").alias("n_sentences"))
    return pieces.join(counts, ["doc_id", "line_no"]).select("doc_id", "line_no", "n_pieces", "n_sentences")


add_cte("budget_rows", [], f"""
SELECT doc_id, cost, row_number() OVER (ORDER BY cost DESC, doc_id) AS k
FROM (SELECT doc_id, CAST(2 * len(regexp_extract_all(text, '{TOK}')) AS BIGINT) AS cost FROM documents)""")


@register("g10_token_budget_batches", with_ctes(["budget_rows"], "").replace("WITH ", "WITH RECURSIVE ", 1) + """,
cut(k, doc_id, cost, held, batch_id) AS (
  SELECT k, doc_id, cost, cost, CAST(0 AS BIGINT) FROM budget_rows WHERE k = 1
  UNION ALL
  SELECT r.k, r.doc_id, r.cost, CASE WHEN c.held + r.cost > 16384 THEN r.cost ELSE c.held + r.cost END,
         c.batch_id + CASE WHEN c.held + r.cost > 16384 THEN 1 ELSE 0 END
  FROM cut c JOIN budget_rows r ON r.k = c.k + 1)
SELECT doc_id, cost, batch_id FROM cut""")
def g10_token_budget_batches(spark, sf):
    """Batches of documents by falling length, cut greedily at 32 x 512 estimated tokens (two a word)."""
    docs = FX.table(spark, sf, "documents").select("doc_id", (2 * F.size(FX.T.word_tokens(F.col("text")))).cast("bigint").alias("cost"))
    return budget_batches(docs, "cost", [F.col("cost").desc(), "doc_id"], 32 * 512)
