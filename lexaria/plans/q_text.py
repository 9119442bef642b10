"""Registered queries: text core."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.operators import contexts as X
from lexaria.operators import vocabulary as V
from lexaria.plans import fixtures as FX
from lexaria.plans.catalog import register
from lexaria.plans.oracle import P1_SQL, with_ctes
from lexaria.sources import corpus as C


@register("a01_corpus_lines", with_ctes(["lines"], "SELECT doc_id, line_no, line FROM lines"))
def a01_corpus_lines(spark, sf):
    return FX.lines(spark, sf)


@register("c02_sentences", with_ctes(["sentences"], "SELECT doc_id, line_no, sent_no, sentence FROM sentences"))
def c02_sentences(spark, sf):
    return FX.sentences(spark, sf)


@register("c04_tokens", with_ctes(["tokens"], "SELECT doc_id, line_no, sent_no, tok_pos, word FROM tokens"))
def c04_tokens(spark, sf):
    return FX.tokens(spark, sf)


@register(
    "e03_word_counts",
    with_ctes(
        ["counts"],
        """SELECT word, freq, first[1] AS first_doc, first[2] AS first_line, first[3] AS first_sent,
                  first[4] AS first_tok FROM counts""",
    ),
)
def e03_word_counts(spark, sf):
    c = FX.counts(spark, sf)
    return c.select(
        "word", "freq",
        F.col("first.doc_id").alias("first_doc"),
        F.col("first.line_no").alias("first_line"),
        F.col("first.sent_no").alias("first_sent"),
        F.col("first.tok_pos").alias("first_tok"),
    )


@register("c07_vocabulary", with_ctes(["vocab"], "SELECT word, freq, word_idx FROM vocab"))
def c07_vocabulary(spark, sf):
    """C7 + E4 + G2: filtered vocabulary capped at |embeddings|, 0-based index."""
    return FX.vocab(spark, sf)


@register(
    "c07_vocabulary_unlimited",
    with_ctes(["vocab_all"], "SELECT word, freq, word_idx FROM vocab_all"),
)
def c07_vocabulary_unlimited(spark, sf):
    """C7 with ``max_size=None``: every word passing the filters, ranked."""
    return V.filter_vocabulary(FX.counts(spark, sf), FX.MIN_FREQ, FX.MIN_LEN, None)


@register(
    "c06_valid_words",
    with_ctes(
        ["counts"],
        f"""SELECT word, (regexp_matches(word, '\\p{{L}}') AND word NOT IN ({P1_SQL})
                   AND NOT starts_with(word, '#') AND NOT starts_with(word, '@')
                   AND NOT starts_with(word, 'http')) AS valid
            FROM counts""",
    ),
)
def c06_valid_words(spark, sf):
    return FX.counts(spark, sf).select("word", T.valid_word(F.col("word")).alias("valid"))


@register(
    "c05_punct_filter",
    with_ctes(
        ["sentences"],
        f"""SELECT doc_id, line_no, sent_no, CAST(count(*) AS BIGINT) AS n_tokens,
                   CAST(count(*) FILTER (WHERE w NOT IN ({P1_SQL})) AS BIGINT) AS n_words
            FROM (SELECT doc_id, line_no, sent_no, unnest(regexp_extract_all(sentence, '{T.TOKEN_PATTERN}')) AS w
                  FROM sentences)
            GROUP BY doc_id, line_no, sent_no""",
    ),
)
def c05_punct_filter(spark, sf):
    """C4 without lowercasing + C5: tokens and non-punctuation tokens per sentence."""
    s = FX.sentences(spark, sf)
    toks = T.word_tokens(F.col("sentence"))
    return s.select(
        "doc_id", "line_no", "sent_no",
        F.size(toks).cast("bigint").alias("n_tokens"),
        F.size(T.drop_punct(toks)).cast("bigint").alias("n_words"),
    ).where(F.col("n_tokens") > 0)


@register(
    "e01_line_count",
    "SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines FROM documents",
)
def e01_line_count(spark, sf):
    """Physical lines including blank ones."""
    d = FX.table(spark, sf, "documents")
    return d.agg(F.sum(F.size(T.split_lines(F.col("text")))).cast("bigint").alias("n_lines"))


@register(
    "e02_size_profile",
    with_ctes(
        ["sentences"],
        """SELECT d.lang, CAST(count(*) AS BIGINT) AS n_docs,
                  CAST(coalesce(sum(s.n), 0) AS BIGINT) AS n_sentences,
                  CAST(sum(strlen(d.text)) AS BIGINT) AS n_bytes
           FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id) s
             ON d.doc_id = s.doc_id
           GROUP BY d.lang""",
    ),
)
def e02_size_profile(spark, sf):
    return C.size_profile(FX.table(spark, sf, "documents"))


@register("e02_language_profile", with_ctes(["sentences"], """
SELECT a.lang, p.n_docs, p.n_sentences, p.n_bytes, CASE WHEN p.lang IS NULL THEN 'unknown' ELSE 'known' END AS status
FROM (SELECT 'en' AS lang UNION ALL SELECT 'xyz') a LEFT JOIN (
  SELECT d.lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS n_sentences,
         CAST(sum(strlen(d.text)) AS BIGINT) AS n_bytes
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id) s ON d.doc_id = s.doc_id
  GROUP BY d.lang) p ON p.lang = a.lang"""))
def e02_language_profile(spark, sf):
    """A language that occurs, and one that does not."""
    d = FX.table(spark, sf, "documents")
    return C.language_profile(d, "en").unionByName(C.language_profile(d, "xyz"))


@register(
    "a02_monolingual_corpus",
    with_ctes(["sentences"], """SELECT s.doc_id, s.line_no, s.sent_no, s.sentence
        FROM sentences s JOIN documents d ON s.doc_id = d.doc_id WHERE d.lang = 'de'"""),
)
def a02_monolingual_corpus(spark, sf):
    """A2: all German sentences (the cap is exercised in the unit tests)."""
    return C.monolingual_corpus(FX.table(spark, sf, "documents"), "de")


CTX_SQL = """
SELECT word, CAST(rn AS BIGINT) AS rn, doc_id, line_no, sent_no, sentence FROM (
  SELECT word, doc_id, line_no, sent_no, sentence,
         row_number() OVER (PARTITION BY word ORDER BY doc_id, line_no, sent_no) AS rn
  FROM (SELECT DISTINCT doc_id, line_no, sent_no, lower(sentence) AS sentence, w AS word
        FROM (SELECT doc_id, line_no, sent_no, sentence,
                     unnest(regexp_extract_all(lower(sentence), '{tok}')) AS w
              FROM sentences WHERE length(sentence) <= 500))
  WHERE word IN (SELECT word FROM vocab) AND word NOT IN ({p1}))
WHERE rn <= {n}"""

from lexaria.plans.oracle import add_cte  # noqa: E402

add_cte("ctx", ["sentences", "vocab"], CTX_SQL.format(tok=T.TOKEN_PATTERN, p1=P1_SQL, n=FX.N_CONTEXTS))


def contexts(spark, sf):
    """The context index as a materialised stage (bounded by |vocab| x n)."""
    return FX.stage(spark, sf, "contexts", lambda: X.build_contexts(
        FX.sentences(spark, sf), FX.vocab(spark, sf), FX.N_CONTEXTS, vocab_bound=FX.n_words(spark, sf)))


@register("e05_context_index", with_ctes(["ctx"], "SELECT word, rn, doc_id, line_no, sent_no, sentence FROM ctx"))
def e05_context_index(spark, sf):
    """E5 + D4 + G1 + C8: first 10 contexts per vocabulary word, corpus order."""
    return contexts(spark, sf)


@register(
    "e06_context_stats",
    with_ctes(
        ["ctx", "vocab"],
        f"""SELECT CAST(count(*) AS BIGINT) AS vocab_size, CAST(count(n) AS BIGINT) AS words_with_sentences,
                   CAST(coalesce(sum(n), 0) AS DOUBLE) / greatest(count(n), 1) AS avg_sentences,
                   CAST(count(*) FILTER (WHERE coalesce(n, 0) < {FX.N_CONTEXTS}) AS BIGINT) AS words_needing
            FROM vocab v LEFT JOIN (SELECT word, count(*) AS n FROM ctx GROUP BY word) c ON v.word = c.word""",
    ),
)
def e06_context_stats(spark, sf):
    return X.context_stats(FX.vocab(spark, sf), contexts(spark, sf), FX.N_CONTEXTS)


@register(
    "d05_sentences_of",
    with_ctes(
        ["ctx", "word_pairs"],
        """SELECT q.b AS word, c.rn, c.sentence
           FROM (SELECT DISTINCT b FROM word_pairs) q LEFT JOIN (SELECT * FROM ctx WHERE rn <= 3) c ON c.word = q.b""",
    ),
)
def d05_sentences_of(spark, sf):
    """First 3 sentences of each requested word (missing word -> one empty row)."""
    words = FX.word_pairs(spark, sf).select(F.col("b").alias("word")).distinct()
    got = X.sentences_of(contexts(spark, sf), words, 3)
    return got.select("word", F.posexplode_outer("sentences").alias("rn", "sentence")).select(
        "word", (F.col("rn") + 1).cast("bigint").alias("rn"), "sentence")


@register(
    "d03_in_vocabulary",
    with_ctes(
        ["word_pairs", "word2vec"],
        """SELECT pair_id, b FROM word_pairs
           WHERE b IN (SELECT word FROM word2vec) OR lower(b) IN (SELECT word FROM word2vec)""",
    ),
)
def d03_in_vocabulary(spark, sf):
    return X.in_vocabulary(FX.word_pairs(spark, sf), FX.word2vec(spark, sf), "b").select("pair_id", "b")


@register(
    "d03_out_of_vocabulary",
    with_ctes(
        ["word_pairs", "word2vec"],
        """SELECT pair_id, b FROM word_pairs
           WHERE b NOT IN (SELECT word FROM word2vec) AND lower(b) NOT IN (SELECT word FROM word2vec)""",
    ),
)
def d03_out_of_vocabulary(spark, sf):
    return X.out_of_vocabulary(FX.word_pairs(spark, sf), FX.word2vec(spark, sf), "b").select("pair_id", "b")


@register(
    "d11_point_access",
    with_ctes(
        ["vocab"],
        """SELECT v.word_idx, v.word, n.size
           FROM vocab v, (SELECT CAST(count(*) AS BIGINT) AS size FROM vocab) n""",
    ),
)
def d11_point_access(spark, sf):
    """Index of every word and the word at that index again, with the vocabulary size."""
    v = FX.vocab(spark, sf)
    index = V.index_of(v, v.select("word"))
    return V.word_at(v, index.select("word_idx")).select("word_idx", "word", F.lit(FX.n_words(spark, sf)).cast("bigint").alias("size"))


@register(
    "h04_sentence_vocab_intersection",
    with_ctes(
        ["sentences", "vocab"],
        f"""SELECT doc_id, line_no, sent_no, CAST(count(DISTINCT w) AS BIGINT) AS n_vocab_words
            FROM (SELECT doc_id, line_no, sent_no, unnest(regexp_extract_all(lower(sentence), '{T.TOKEN_PATTERN}')) AS w
                  FROM sentences)
            WHERE w IN (SELECT word FROM vocab)
            GROUP BY doc_id, line_no, sent_no""",
    ),
)
def h04_sentence_vocab_intersection(spark, sf):
    """H4: words needed ∩ words in the sentence, counted per sentence."""
    sw = X.sentence_words(FX.sentences(spark, sf), True, None)
    v = FX.vocab(spark, sf).select("word")
    return sw.join(v, "word", "left_semi").groupBy("doc_id", "line_no", "sent_no").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_vocab_words")
    )
