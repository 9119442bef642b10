"""Registered queries: sources and sinks.

Sink queries write into the shared checkpoint folder and return what a reader
gets back, so the check covers the write and the read together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.functions import vectors as Vx
from lexaria.functions.joins import bounded_broadcast
from lexaria.operators import evaluate as EV
from lexaria.operators import vocabulary as V
from lexaria.plans import fixtures as FX
from lexaria.plans.catalog import register
from lexaria.plans.oracle import add_cte, strip, with_ctes
from lexaria.plans.q_text import contexts
from lexaria.plans.q_vectors import long_sql
from lexaria.session import stage_path
from lexaria.sinks import vectors as SK
from lexaria.sources import corpus as C
from lexaria.sources import vectors as SV


def _out(spark, name):
    return stage_path(spark, f"io-{name}-{uuid.uuid4().hex[:8]}")


def _long6(df, keys):
    return Vx.long_form(df, keys, "vec")


W2V_LONG = with_ctes(["word2vec"], f"SELECT word, dim, round(value, 6) + 0.0 AS value FROM ({long_sql('word2vec', 'word')})")
W2V_LONG_F32 = with_ctes(["word2vec"], f"""
SELECT word, dim, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) + 0.0 AS value FROM ({long_sql('word2vec', 'word')})""")


@register("a05_word2vec_text_read", W2V_LONG)
def a05_word2vec_text_read(spark, sf):
    """B1 write + A5 read: the %.6f text format round trip."""
    p = SK.write_word2vec_text(FX.word2vec(spark, sf), _out(spark, "w2v"))
    return _long6(SV.read_word2vec_text(spark, p), ["word"])


@register("b01_word2vec_text_header", with_ctes(["word2vec"], """
SELECT CAST(count(*) AS VARCHAR) || ' ' || CAST(max(len(vec)) AS VARCHAR) AS header FROM word2vec"""))
def b01_word2vec_text_header(spark, sf):
    """B1: the first line of the first part is ``"n d"``."""
    p = SK.write_word2vec_text(FX.word2vec(spark, sf), _out(spark, "w2vh"))
    first = spark.read.text(p + "/part-00000*").limit(1)
    return first.select(F.col("value").alias("header"))


@register("a07_glove_text_read", W2V_LONG)
def a07_glove_text_read(spark, sf):
    """B2 write + A7 read (no header)."""
    p = SK.write_glove_text(FX.word2vec(spark, sf), _out(spark, "glove"))
    return _long6(SV.read_glove_text(spark, p), ["word"])


@register("a06_lenient_read", W2V_LONG)
def a06_lenient_read(spark, sf):
    """The lenient reader skips the 2-field header line of a word2vec file."""
    p = SK.write_word2vec_text(FX.word2vec(spark, sf), _out(spark, "len"))
    return _long6(SV.read_lenient(spark, p), ["word"])


@register("b03_full_precision_write", W2V_LONG)
def b03_full_precision_write(spark, sf):
    """B3 write (full precision) + historical lenient read."""
    p = SK.write_full_precision(FX.word2vec(spark, sf), _out(spark, "full"))
    return _long6(SV.read_lenient(spark, p, historical=True), ["word"])


@register("a08_word2vec_binary_read", W2V_LONG_F32)
def a08_word2vec_binary_read(spark, sf):
    """B4 write (4 self-contained shards) + A8 read."""
    p = SK.write_word2vec_binary(FX.word2vec(spark, sf), _out(spark, "bin"), shards=4)
    return _long6(SV.read_word2vec_binary(spark, p), ["word"])


@register("b05_columnar_write", W2V_LONG_F32)
def b05_columnar_write(spark, sf):
    """Words + float32 vectors as Parquet, read back."""
    p = SK.write_columnar(FX.word2vec(spark, sf), _out(spark, "col"))
    return _long6(spark.read.parquet(p).select("word", F.col("vec").cast("array<double>").alias("vec")), ["word"])


@register("b06_export_all_formats", with_ctes(["word2vec"], """
SELECT f AS format, CAST((SELECT count(*) FROM word2vec) AS BIGINT) AS n_words
FROM (VALUES ('w2v_text'), ('w2v_binary'), ('glove_text'), ('columnar')) t(f)"""))
def b06_export_all_formats(spark, sf):
    """All four formats written; each read back with its reader."""
    w = FX.word2vec(spark, sf)
    paths = SK.export_embeddings(w, _out(spark, "export"), "vectors")
    readers = {
        "w2v_text": lambda p: SV.read_word2vec_text(spark, p),
        "w2v_binary": lambda p: SV.read_word2vec_binary(spark, p),
        "glove_text": lambda p: SV.read_glove_text(spark, p),
        "columnar": lambda p: spark.read.parquet(p),
    }
    counts = [(f, readers[f](p).count()) for f, p in paths.items()]  # four scalars
    return spark.createDataFrame(counts, "format string, n_words bigint")


@register("b07_sentence_corpus_write", with_ctes(["sentences"], "SELECT sentence FROM sentences"))
def b07_sentence_corpus_write(spark, sf):
    """One sentence per line, read back (multiset equal)."""
    p = SK.write_sentences(FX.sentences(spark, sf), _out(spark, "sents"))
    return spark.read.text(p).select(F.col("value").alias("sentence"))


add_cte("features", ["emb"], """
SELECT d.doc_id AS row_no, d.text, e.vec FROM documents d JOIN emb e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)""")


@register("a09_feature_batches", with_ctes(["features"], """
SELECT CAST(row_no // 100 AS BIGINT) AS batch_id, row_no, length(text) AS n_chars,
       round(list_reduce(list_transform(vec, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)), lambda a, b: a + b), 5) + 0.0 AS vsum
FROM features"""))
def a09_feature_batches(spark, sf):
    """B8 write (batch_id = row_no // 100) + A9 read: texts aligned with teacher vectors."""
    d = FX.table(spark, sf, "documents").select(F.col("doc_id").alias("row_no"), "text")
    e = FX.embeddings(spark, sf).select("vec_id", "vec")
    rows = d.join(e, FX.vector_of(F.col("row_no"), spark, sf) == F.col("vec_id")).drop("vec_id")
    p = SK.write_feature_batches(rows, _out(spark, "feat"), 100)
    back = SV.read_features(spark, p)
    return back.select(
        "batch_id", "row_no", F.length("text").cast("bigint").alias("n_chars"),
        Vx.round_col(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5).alias("vsum"),
    )


@register("a10_vocabulary_roundtrip", with_ctes(["vocab"], "SELECT word, freq, word_idx FROM vocab"))
def a10_vocabulary_roundtrip(spark, sf):
    """B9 save + A10 load with an explicit schema."""
    p = SK.write_table(FX.vocab(spark, sf), _out(spark, "vocab"))
    return SV.read_vocabulary(spark, p)


add_cte("found", ["ctx"], "SELECT word, CAST(count(*) AS BIGINT) AS n FROM ctx GROUP BY word HAVING count(*) >= 5")


@register("b10_extraction_sidecar", with_ctes(["vocab", "found"], """
SELECT v.word, coalesce(CAST(f.n AS VARCHAR), 'NOT_FOUND') AS n FROM vocab v LEFT JOIN found f ON f.word = v.word"""))
def b10_extraction_sidecar(spark, sf):
    """Vectors of words with >= 5 contexts + count sidecar (others NOT_FOUND)."""
    ctx = contexts(spark, sf)
    found = ctx.groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("n_contexts")).where(
        F.col("n_contexts") >= 5)
    res = found.join(FX.word2vec(spark, sf), "word")
    _, cp = SK.extraction_outputs(FX.vocab(spark, sf), res, _out(spark, "xv"), _out(spark, "xc"))
    back = spark.read.text(cp).select(F.split("value", " ").alias("p"))
    return back.select(F.col("p")[0].alias("word"), F.col("p")[1].alias("n"))


@register("d07_resume_remaining", with_ctes(["vocab", "found"], """
SELECT word FROM vocab WHERE word NOT IN
  (SELECT word FROM found WHERE word <> (SELECT max(word) FROM found))"""))
def d07_resume_remaining(spark, sf):
    """A16 + D7: a count file of finished words (sorted, last line may be partial) is
    read back without its last line; the vocabulary minus those words remains."""
    ctx = contexts(spark, sf)
    found = ctx.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 5)
    p = _out(spark, "counts")
    found.orderBy("word").select(F.concat_ws(" ", "word", F.col("n").cast("string")).alias("value")).write.text(p)
    done = SV.resume_words(SV.read_count_lines(spark, p))
    return FX.vocab(spark, sf).select("word").join(done, "word", "left_anti")


@register("b12_metrics_json", with_ctes(["wp_ds", "wsim_found"], """
SELECT dataset, n_pairs, n_found FROM (""" + """
SELECT t.dataset, t.n_pairs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_found
FROM (SELECT dataset, CAST(count(*) AS BIGINT) AS n_pairs FROM wp_ds GROUP BY dataset) t
LEFT JOIN (SELECT dataset, count(*) AS n FROM wsim_found GROUP BY dataset) c ON c.dataset = t.dataset)"""))
def b12_metrics_json(spark, sf):
    """Word-similarity results written as JSON and read back."""
    from lexaria.plans.q_evaluate import _ds_pairs

    res = EV.word_similarity(_ds_pairs(spark, sf), FX.word2vec(spark, sf), dim=FX.dim(spark, sf))
    p = SK.write_metrics_json(res, _out(spark, "metrics"))
    return spark.read.schema("dataset string, n_pairs bigint, n_found bigint").json(p)


@register("b13_stage_resume", with_ctes(["vocab"], """
SELECT 'first' AS run, CAST(count(*) AS BIGINT) AS n FROM vocab UNION ALL
SELECT 'second', CAST(count(*) AS BIGINT) FROM vocab"""))
def b13_stage_resume(spark, sf):
    """A finished stage is skipped and reloaded; the second run equals the first."""
    p = _out(spark, "stage")
    calls = []

    def build():
        calls.append(1)
        return FX.vocab(spark, sf)

    first = SK.run_stage(spark, p, build).count()
    second = SK.run_stage(spark, p, build).count()
    assert len(calls) == 1, "finished stage was rebuilt"
    return spark.createDataFrame([("first", first), ("second", second)], "run string, n bigint")


# ---- scans over the test tables ---------------------------------------------------------------

@register("a15_web_texts", f"""
SELECT page_id AS text_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS h
FROM (SELECT page_id, {strip('html')} AS t FROM pages) WHERE length(t) >= 20""")
def a15_web_texts(spark, sf):
    """Strip, keep whole texts of >= 20 characters."""
    p = FX.table(spark, sf, "pages")
    w = C.web_texts(p, text_col="html", key="page_id")
    return w.select("text_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("h"))


add_cte("translations", ["conv_pairs"], """
SELECT pair_id, map(['en', 'de'], [a, b]) AS translation FROM conv_pairs""")


@register("a03_parallel_pairs", with_ctes(["translations"], f"""
SELECT pair_id, src, tgt FROM (
  SELECT pair_id, {strip("translation['en']")} AS src, {strip("translation['de']")} AS tgt FROM translations)
WHERE src <> '' AND tgt <> ''"""))
def a03_parallel_pairs(spark, sf):
    """A3: two languages pulled from a map column; both sides must be non-empty."""
    p = FX.conversation_pairs(spark, sf)
    m = p.select("pair_id", F.create_map(F.lit("en"), "a", F.lit("de"), "b").alias("translation"))
    return C.parallel_pairs(m, "en", "de")


@register("a04_zip_aligned", with_ctes(["sentences"], """
SELECT CAST(row_number() OVER (ORDER BY doc_id, line_no, sent_no) - 1 AS BIGINT) AS pair_id, sentence AS src,
       md5(sentence) || '-' || CAST(doc_id AS VARCHAR) AS tgt FROM sentences"""))
def a04_zip_aligned(spark, sf):
    """A4: two line-aligned text files, each numbered from its own lines, zipped by line number."""
    s = FX.sentences(spark, sf).orderBy("doc_id", "line_no", "sent_no")
    left, right = _out(spark, "aligned-l"), _out(spark, "aligned-r")
    s.select(F.col("sentence").alias("value")).write.mode("overwrite").text(left)
    s.select(F.concat_ws("-", F.md5("sentence"), F.col("doc_id").cast("string")).alias("value")).write.mode("overwrite").text(right)
    return C.zip_aligned(C.indexed_text_lines(spark, left), C.indexed_text_lines(spark, right))


@register("e07_token_frequencies", with_ctes(["vocab"], f"""
SELECT v.word_idx AS token, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest(regexp_extract_all(lower(text), '{T.TOKEN_PATTERN}')) AS w FROM conversations) t
JOIN vocab v ON v.word = t.w GROUP BY v.word_idx"""))
def e07_token_frequencies(spark, sf):
    """Frequency of every token id (vocabulary index) over the conversation texts."""
    c = FX.table(spark, sf, "conversations").select(T.word_tokens(F.lower("text")).alias("toks"))
    v = FX.vocab(spark, sf).select("word", "word_idx")
    ids = c.select(F.explode("toks").alias("word")).join(bounded_broadcast(v, FX.n_words(spark, sf), 64),
                                                         "word").select(
        F.col("word_idx").alias("token"))
    return V.token_frequencies(ids.select(F.array("token").alias("tokens")))


@register("a01_text_file_lines", with_ctes(["sentences"], "SELECT sentence AS line FROM sentences"))
def a01_text_file_lines(spark, sf):
    """A1 on text files: the sentence corpus written as text (B7) and scanned back
    (strip, drop empty lines), in file order."""
    p = SK.write_sentences(FX.sentences(spark, sf), _out(spark, "corpus-txt"))
    return C.read_text_lines(spark, p).select("line")


@register("e01_text_file_line_count", with_ctes(["sentences"], """
SELECT CAST(count(*) AS BIGINT) AS n_lines FROM sentences"""))
def e01_text_file_line_count(spark, sf):
    """E1 on a text file: every physical line is counted."""
    p = SK.write_sentences(FX.sentences(spark, sf), _out(spark, "corpus-cnt"))
    return spark.createDataFrame([(C.count_lines(spark, p),)], "n_lines bigint")


@register("b07_pair_corpus_write", with_ctes(["conv_pairs"], "SELECT pair_id, a AS src, b AS tgt FROM conv_pairs"))
def b07_pair_corpus_write(spark, sf):
    """Aligned pairs written as one table (alignment cannot break) and read back."""
    p = FX.conversation_pairs(spark, sf).select("pair_id", F.col("a").alias("src"), F.col("b").alias("tgt"))
    return spark.read.parquet(SK.write_pairs(p, _out(spark, "pairs")))


@register("a10_context_index_roundtrip", with_ctes(["ctx"], """
SELECT word, rn, doc_id, line_no, sent_no, sentence FROM ctx"""))
def a10_context_index_roundtrip(spark, sf):
    """B9 save + A10 load of the word -> contexts index with an explicit schema."""
    p = SK.write_table(contexts(spark, sf), _out(spark, "ctx"))
    return SV.read_contexts(spark, p)
