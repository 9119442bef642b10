"""Structured Streaming re-aims of the stateful corpus consumers.

The reference reads lazily with an early stop; here the corpus arrives as
files.  State grows with the vocabulary, not with time, so no watermark is
needed (add one only when the caller supplies event time).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexaria.functions.joins import bounded_broadcast
from lexaria.operators import contexts as X
from lexaria.operators import vocabulary as V
from lexaria.sources import corpus as C


def document_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Arriving Parquet files of a documents-like table: a folder, or a glob of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_word_counts(docs: DataFrame) -> DataFrame:
    """C1-C5 then ``groupBy(word).count()`` (complete/update output modes)."""
    toks = V.tokens(C.sentences(C.document_lines(docs.select("doc_id", "text"))))
    return toks.groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("freq"))


def latest_counts(counts: DataFrame, out_path: str, checkpoint: str):
    """I1 sink: the complete result of every trigger, written by the executors to
    ``out_path/epoch=<n>``; a repeated trigger overwrites its own folder."""

    def write(batch_df: DataFrame, epoch_id: int):
        batch_df.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def read_latest(spark: SparkSession, out_path: str) -> DataFrame:
    """The result of the last trigger that ``latest_counts`` wrote."""
    df = spark.read.parquet(out_path)
    last = df.agg(F.max("epoch")).first()[0]  # one number
    return df.where(F.col("epoch") == last).drop("epoch")


CONTEXT_SCHEMA = "word string, doc_id bigint, line_no bigint, sent_no bigint, sentence string"


WORDS_A_GROUP = 64


def _cut(rows: pd.DataFrame, held: dict, n: int) -> pd.DataFrame:
    """The first rows by position of every word, as many as it has room for."""
    rows = rows.sort_values(X.POS, kind="stable")
    words = rows["word"]
    return rows[rows.groupby(words, sort=False).cumcount() < n - words.map(held).fillna(0)]


def capped_contexts(docs: DataFrame, vocab_words: DataFrame, out_path: str, checkpoint: str, n: int = 100,
                    max_sentence_len: int = 500, vocab_bound: int | None = None):
    """Append a context of a vocabulary word only while the word has fewer than ``n``.

    The state of a word is one number, the contexts emitted so far, in Spark's state store, so
    a trigger costs what arrives in it however much was emitted before.  Tasks reduce their words to
    the first ``n`` sentences before a row per word exists, and words are dealt by hash to groups
    of about ``WORDS_A_GROUP``, whose numbers are read and written together: a trigger calls Python once a
    group, not once a word.  Behind the shuffle a word keeps its first contexts by position up to
    its remaining room.  Repeated triggers are settled by Spark: the state has the version of the
    batch, the file sink drops known batches.
    """
    groups = max(1, -(-(vocab_bound or 1 << 18) // WORDS_A_GROUP))

    def fill(key, batches, state: GroupState):
        held = dict(zip(*state.get)) if state.exists else {}
        first, kept = None, 0
        for rows in batches:
            rows = rows[rows["word"].map(held).fillna(0) < n]
            first = rows if first is None else pd.concat([first, rows])
            if len(first) > 2 * kept + n * WORDS_A_GROUP:
                first = _cut(first, held, n)
                kept = len(first)
        if first is None or not len(first):
            return
        first = _cut(first, held, n)
        for word, more in first["word"].value_counts(sort=False).items():
            held[word] = held.get(word, 0) + int(more)
        state.update((list(held), list(held.values())))
        yield first[["word", *X.POS, "sentence"]]

    told = X.distinct_words(C.sentences(C.document_lines(docs.select("doc_id", "text"))), True, max_sentence_len, "P1", None)
    kind = ", ".join(f"{c} {told.schema[c].dataType.simpleString()}" for c in [*X.POS, "sentence"])
    hits = told.mapInArrow(X.first_sentences(n, "at_end"), f"word string, {kind}")
    hits = hits.join(bounded_broadcast(vocab_words.select("word"), vocab_bound, 64), "word", "left_semi")
    hits = hits.select("word", *(F.col(c).cast("bigint").alias(c) for c in X.POS), "sentence")
    hits = hits.withColumn("word_group", F.pmod(F.xxhash64("word"), F.lit(groups)))
    kept = hits.groupBy("word_group").applyInPandasWithState(
        fill, CONTEXT_SCHEMA, "words array<string>, held array<int>", "append", GroupStateTimeout.NoTimeout)
    return kept.writeStream.format("parquet").outputMode("append").option("path", out_path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_contexts(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.schema(CONTEXT_SCHEMA).parquet(out_path)


def encode_stream(texts: DataFrame, encode_batch: Callable[[DataFrame], DataFrame], out_path: str,
                  checkpoint: str):
    """Run the batch encoder on every micro-batch (``foreachBatch``) and write
    the vectors to ``out_path/epoch=<n>``, so a repeated trigger replaces its rows; the
    per-sentence aggregate stays inside one micro-batch, so no streaming state is needed."""

    def run(batch_df: DataFrame, epoch_id: int):
        encode_batch(batch_df).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")

    return texts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


__all__ = ["document_stream", "running_word_counts", "latest_counts", "read_latest", "capped_contexts", "read_contexts",
           "encode_stream"]
