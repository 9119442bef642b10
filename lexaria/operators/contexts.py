"""Word -> context-sentence index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.functions.joins import bounded_broadcast

POS = ["doc_id", "line_no", "sent_no"]
CHUNK_WORDS = 1 << 21
OUT_ROWS = 1 << 15


def distinct_words(sents: DataFrame, lowercase: bool, max_sentence_len: int | None, punct, tokenizer) -> DataFrame:
    """``(doc_id, line_no, sent_no, sentence, words)``: the distinct non-punctuation words (length gate first)."""
    tok = tokenizer or T.word_tokens
    s = sents
    if max_sentence_len is not None:
        s = s.where(F.length("sentence") <= max_sentence_len)
    text = F.lower("sentence") if lowercase else F.col("sentence")
    s = s.select(*POS, text.alias("sentence"))
    return s.select(*POS, "sentence", F.array_distinct(T.drop_punct(tok(F.col("sentence")), punct)).alias("words"))


def sentence_words(sents: DataFrame, lowercase: bool = True, max_sentence_len: int | None = 500,
                   punct="P1", tokenizer=None) -> DataFrame:
    """C8 + D4 input: ``(doc_id, line_no, sent_no, sentence, word)`` one row per
    *distinct* non-punctuation word of each sentence (length gate first)."""
    s = distinct_words(sents, lowercase, max_sentence_len, punct, tokenizer)
    return s.select(*POS, "sentence", F.explode("words").alias("word"))


def first_sentences(n: int, nulls: str = "at_start"):
    """``mapInArrow``: rows ``(word, POS, sentence)`` of the first ``n`` sentences (corpus order, ``nulls``
    first or last) of every word among about ``CHUNK_WORDS`` words read; what is held is one such chunk."""
    def first(held):
        t = pa.Table.from_batches(held).combine_chunks()
        rows = t.num_rows
        words = t.column("words").chunk(0).fill_null([])
        flat = words.flatten().dictionary_encode()
        order = pc.sort_indices(t.select(POS), sort_keys=[(c, "ascending") for c in POS], null_placement=nulls).to_numpy()
        rank = np.empty(rows, np.int64)
        rank[order] = np.arange(rows)
        at = flat.indices.to_numpy().astype(np.int64) * rows + np.repeat(rank, words.value_lengths().to_numpy())
        at.sort()
        word, sent = at // rows, order[at % rows]
        new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        nth = np.arange(len(word)) - np.repeat(new, np.diff(np.r_[new, len(word)]))
        word, sent = word[nth < n], sent[nth < n]
        for a in range(0, len(word), OUT_ROWS):
            taken = t.select([*POS, "sentence"]).take(pa.array(sent[a:a + OUT_ROWS])).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [flat.dictionary.take(pa.array(word[a:a + OUT_ROWS])), *[c.chunk(0) for c in taken.columns]], ["word", *POS, "sentence"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column("words").value_lengths().fill_null(0)))
            start = 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK_WORDS - size, side="right")))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - base)
                start = stop
                if size >= CHUNK_WORDS or start < batch.num_rows:
                    yield from first(held)
                    held, size = [], 0
        if held:
            yield from first(held)

    return run


def build_contexts(sents: DataFrame, vocab: DataFrame, n_sentences: int = 100,
                   lowercase: bool = True, max_sentence_len: int | None = 500,
                   vocab_bound: int | None = None, tokenizer=None) -> DataFrame:
    """E5: first ``n_sentences`` sentences (corpus order) per vocabulary word.

    Long form ``(word, rn, doc_id, line_no, sent_no, sentence)``; one entry per
    sentence even if the word repeats in it; the stored sentence is the
    lowercased one when ``lowercase``.  Tasks reduce their words to the first ``n`` sentences
    a chunk at a time before any sort or shuffle, so no row per token is sorted, and a
    Zipf-head word ships at most ``n`` rows per map task (WindowGroupLimit).
    """
    # vocabulary words are unique by construction: no distinct (and its shuffle) needed
    words = bounded_broadcast(vocab.select("word"), vocab_bound, 64)
    told = distinct_words(sents, lowercase, max_sentence_len, "P1", tokenizer)
    kind = ", ".join(f"{c} {told.schema[c].dataType.simpleString()}" for c in [*POS, "sentence"])
    hits = told.mapInArrow(first_sentences(n_sentences), f"word string, {kind}").join(words, "word", "left_semi")
    w = Window.partitionBy("word").orderBy(*POS)
    return (
        hits.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= n_sentences)
        .select("word", F.col("rn").cast("bigint").alias("rn"), *POS, "sentence")
    )


def nested_contexts(ctx: DataFrame) -> DataFrame:
    """Nested view ``(word, sentences array<string>)`` in rank order (bounded by n)."""
    return ctx.groupBy("word").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "sentence"))), lambda x: x["sentence"]).alias(
            "sentences"
        )
    )


def context_stats(vocab: DataFrame, ctx: DataFrame, n_sentences: int) -> DataFrame:
    """Vocab size, words with >=1 sentence, mean sentences per such word, words short of n."""
    per_word = ctx.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    j = vocab.select("word").join(per_word, "word", "left")
    return j.agg(
        F.count(F.lit(1)).cast("bigint").alias("vocab_size"),
        F.count("n").cast("bigint").alias("words_with_sentences"),
        (F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.count("n"), F.lit(1))).cast("double").alias(
            "avg_sentences"
        ),
        F.count_if(F.coalesce(F.col("n"), F.lit(0)) < n_sentences).cast("bigint").alias("words_needing"),
    )


def sentences_of(ctx: DataFrame, words: DataFrame, n: int | None = None) -> DataFrame:
    """First ``n`` sentences of each requested word; missing words get an empty list."""
    c = ctx if n is None else ctx.where(F.col("rn") <= n)
    nested = nested_contexts(c)
    return words.select("word").join(nested, "word", "left").select(
        "word", F.coalesce("sentences", F.array().cast("array<string>")).alias("sentences")
    )


def in_vocabulary(df: DataFrame, vec_table: DataFrame, word_col: str = "word") -> DataFrame:
    """D3: rows whose word (or its lowercase) is in the vector table (multiplicity kept)."""
    keys = vec_table.select("word").distinct()
    exact = keys.select(F.col("word").alias("_k1"), F.lit(True).alias("_h1"))
    lower = keys.select(F.col("word").alias("_k2"), F.lit(True).alias("_h2"))
    j = df.join(exact, F.col(word_col) == F.col("_k1"), "left").join(
        lower, F.lower(F.col(word_col)) == F.col("_k2"), "left"
    )
    return j.where(F.coalesce("_h1", F.lit(False)) | F.coalesce("_h2", F.lit(False))).drop(
        "_k1", "_h1", "_k2", "_h2"
    )


def out_of_vocabulary(df: DataFrame, vec_table: DataFrame, word_col: str = "word") -> DataFrame:
    """D3 complement: OOV rows (neither the word nor its lowercase is present)."""
    keys = vec_table.select(F.col("word").alias("_k"))
    return df.join(keys, F.col(word_col) == F.col("_k"), "left_anti").join(
        keys, F.lower(F.col(word_col)) == F.col("_k"), "left_anti"
    )

