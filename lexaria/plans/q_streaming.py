"""Registered queries: Structured Streaming.

The given tables are read as file streams where they lie, one file per micro-batch;
results go to files in the shared checkpoint folder and are read from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexaria.functions import vectors as Vx
from lexaria.functions.text import TOKEN_PATTERN
from lexaria.operators import encode as EN
from lexaria.plans import fixtures as FX
from lexaria.plans.catalog import register
from lexaria.plans.oracle import with_ctes
from lexaria.plans.q_vectors import out_long
from lexaria.session import stage_path
from lexaria.streaming import corpus as ST

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _places(spark, name):
    """A fresh output folder and checkpoint folder."""
    run = uuid.uuid4().hex[:8]
    return stage_path(spark, f"stream-{name}-{run}"), stage_path(spark, f"ckpt-{name}-{run}")


def _stream(spark, sf, name, schema):
    # a glob, so that a table may be one file or a folder of files
    return ST.document_stream(spark, f"{sf.rstrip('/')}/{name}.parquet*", schema, 1)


@register("i01_streaming_word_counts", with_ctes(["counts"], "SELECT word, freq FROM counts"))
def i01_streaming_word_counts(spark, sf):
    """Running word counts over arriving document files (complete mode, final state)."""
    out, ckpt = _places(spark, "i01")
    ST.latest_counts(ST.running_word_counts(_stream(spark, sf, "documents", DOC_SCHEMA)), out, ckpt).awaitTermination()
    return ST.read_latest(spark, out)


@register("i02_streaming_capped_contexts", with_ctes(["sentences", "vocab"], f"""
SELECT word, CAST(least(10, count(*)) AS BIGINT) AS n_contexts FROM (
  SELECT DISTINCT doc_id, line_no, sent_no, w AS word
  FROM (SELECT doc_id, line_no, sent_no, unnest(regexp_extract_all(lower(sentence), '{TOKEN_PATTERN}')) AS w
        FROM sentences WHERE length(sentence) <= 500)
  WHERE w IN (SELECT word FROM vocab))
GROUP BY word"""))
def i02_streaming_capped_contexts(spark, sf):
    """Keyed state caps each word at 10 emitted contexts across micro-batches."""
    out, ckpt = _places(spark, "i02")
    ST.capped_contexts(_stream(spark, sf, "documents", DOC_SCHEMA), FX.vocab(spark, sf), out, ckpt, FX.N_CONTEXTS,
                       vocab_bound=FX.n_words(spark, sf)).awaitTermination()
    return ST.read_contexts(spark, out).groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("n_contexts"))


@register("i03_streaming_encode", with_ctes(["enc_mean"], out_long("enc_mean", "conv_id, turn")))
def i03_streaming_encode(spark, sf):
    """Arriving conversation turns encoded per micro-batch (foreachBatch + batch E13)."""
    texts = _stream(spark, sf, "conversations", "conv_id bigint, turn bigint, role string, text string")
    w2v = FX.word2vec(spark, sf)

    def encode_batch(df):
        t = df.select(F.struct("conv_id", "turn").alias("sent_id"), "text")
        out = EN.encode(t, w2v, key="sent_id", dim=FX.dim(spark, sf))
        return out.select(F.col("sent_id.conv_id").alias("conv_id"), F.col("sent_id.turn").alias("turn"), "vec")

    out, ckpt = _places(spark, "i03")
    ST.encode_stream(texts, encode_batch, out, ckpt).awaitTermination()
    return Vx.long_form(spark.read.parquet(out).drop("epoch"), ["conv_id", "turn"], "vec")
