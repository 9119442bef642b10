"""Word-vector file scans.

Text formats are read with ``spark.read.text`` (splittable, one row per line)
and parsed with ``split`` + casts; the binary format is read as self-contained
shard files (``binaryFile``) decoded by ``mapInPandas`` — one record stream is
not splittable, a directory of shards is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a position key ``(file, block, mid)`` in file order."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
        F.col("value").alias("line"),
    )


def _parts(df: DataFrame, rstrip_only: bool = False) -> DataFrame:
    txt = F.regexp_replace("line", r"[ ]+$", "") if rstrip_only else F.regexp_replace(
        "line", r"^[\s]+|[\s]+$", "")
    return df.withColumn("parts", F.split(txt, " "))


def _keep_last(df: DataFrame) -> DataFrame:
    """Duplicate words: the last line wins (a dict insert in file order)."""
    return df.groupBy("word").agg(F.max_by("vec", F.struct("file", "block", "mid")).alias("vec"))


def read_word2vec_text(spark: SparkSession, path: str) -> DataFrame:
    """A5: mandatory ``"n d"`` header line, then ``word v1 .. vd``; float32 values.

    The header is the first line of the first file, whatever the dimension.  Lines of
    another length than ``d`` keep the values they have; nothing is dropped.
    """
    p = _parts(_lines(spark, path))
    first = p.orderBy("file", "block", "mid").limit(1).collect()  # one line
    if not first or len(first[0]["parts"]) != 2 or not all(x.isdigit() for x in first[0]["parts"]):
        raise ValueError(f"no word2vec header in {path}")
    h = first[0]
    header = (F.col("file") == h["file"]) & (F.col("block") == h["block"]) & (F.col("mid") == h["mid"])
    vecs = p.where(~header).select(
        "file", "block", "mid", F.col("parts")[0].alias("word"),
        F.slice("parts", 2, F.size("parts") - 1).cast("array<float>").cast("array<double>").alias("vec"),
    )
    return _keep_last(vecs)


def read_glove_text(spark: SparkSession, path: str) -> DataFrame:
    """Every line is ``word v1 .. vd`` (no header handling)."""
    p = _parts(_lines(spark, path))
    vecs = p.select("file", "block", "mid", F.col("parts")[0].alias("word"),
                    F.slice("parts", 2, F.size("parts") - 1).cast("array<float>").cast("array<double>").alias("vec"))
    return _keep_last(vecs)


def read_lenient(spark: SparkSession, path: str, historical: bool = False) -> DataFrame:
    """Any 2-field line is skipped (so 1-d vectors vanish); float64 values;
    ``ValueError`` when nothing is left.  ``historical=True``: right-strip spaces
    only, skip empty vectors and require equal dimensions."""
    p = _parts(_lines(spark, path), rstrip_only=historical)
    vecs = p.where(F.size("parts") != 2).select(
        "file", "block", "mid", F.col("parts")[0].alias("word"),
        F.slice("parts", 2, F.size("parts") - 1).cast("array<double>").alias("vec"),
    )
    if historical:
        vecs = vecs.where(F.size("vec") > 0)
    out = _keep_last(vecs)
    stats = out.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("lo"),
                    F.max(F.size("vec")).alias("hi")).first()
    if not stats["n"]:
        raise ValueError(f"No embeddings found in {path}")
    if historical and stats["lo"] != stats["hi"]:
        raise ValueError("vectors have different dimensions")
    return out


# --------------------------------------------------------------------------- binary shards

def _decode_shard(content: bytes) -> list[tuple[str, list[float]]]:
    nl = content.index(b"\n")
    n, d = (int(x) for x in content[:nl].split())
    pos, out = nl + 1, []
    for _ in range(n):
        sp = content.index(b" ", pos)
        word = content[pos:sp].decode("utf-8")
        start = sp + 1
        vec = np.frombuffer(content[start:start + 4 * d], dtype="<f4").astype(np.float64)
        out.append((word, vec.tolist()))
        pos = start + 4 * d + 1  # trailing newline
    return out


def read_word2vec_binary(spark: SparkSession, path: str) -> DataFrame:
    """A directory of self-contained binary shards (header, then per word
    ``word␠`` + d little-endian float32 + ``\\n``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "content")

    def decode(batches):
        for pdf in batches:
            words, vecs = [], []
            for content in pdf["content"]:
                for w, v in _decode_shard(bytes(content)):
                    words.append(w)
                    vecs.append(v)
            yield pd.DataFrame({"word": words, "vec": vecs})

    return files.mapInPandas(decode, "word string, vec array<double>")


def encode_shard(rows: list[tuple[str, list[float]]]) -> bytes:
    """One complete binary file for a shard (its own header)."""
    if not rows:
        return b""
    d = len(rows[0][1])
    buf = [f"{len(rows)} {d}\n".encode()]
    for w, v in rows:
        buf.append(w.encode("utf-8") + b" " + np.asarray(v, dtype="<f4").tobytes() + b"\n")
    return b"".join(buf)


# --------------------------------------------------------------------------- tables

VOCAB_SCHEMA = "word string, freq bigint, word_idx bigint"
CONTEXT_SCHEMA = "word string, rn bigint, doc_id bigint, line_no bigint, sent_no bigint, sentence string"
FEATURE_SCHEMA = "batch_id bigint, row_no bigint, text string, vec array<float>"


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A10: vocabulary table with an explicit schema."""
    return spark.read.schema(VOCAB_SCHEMA).parquet(path)


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """A10: context index table with an explicit schema."""
    return spark.read.schema(CONTEXT_SCHEMA).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature batches ``(batch_id, row_no, text, vec)``; files hold ranges in batch/row order."""
    return spark.read.schema(FEATURE_SCHEMA).parquet(path)


def read_count_lines(spark: SparkSession, path: str) -> DataFrame:
    """A16 input: a ``word count`` text file as ``(pos struct, word, n)``; two fields asserted."""
    p = _parts(_lines(spark, path))
    bad = p.where(F.size("parts") != 2).limit(1).count()
    if bad:
        raise ValueError("count lines must have two fields")
    return p.select(F.struct("file", "block", "mid").alias("pos"), F.col("parts")[0].alias("word"),
                    F.col("parts")[1].alias("n"))


def resume_words(counts_lines: DataFrame) -> DataFrame:
    """Words listed in the count file except its last line (it may be partial)."""
    last = counts_lines.agg(F.max("pos").alias("m")).first()["m"]  # one position
    if last is None:
        return counts_lines.select("word").limit(0)
    is_last = (F.col("pos.file") == last["file"]) & (F.col("pos.block") == last["block"]) & (
        F.col("pos.mid") == last["mid"])
    return counts_lines.where(~is_last).select("word")
