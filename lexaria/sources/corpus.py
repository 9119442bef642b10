"""Corpus scans.

A corpus is a DataFrame ``(doc_id bigint, line_no bigint, line string)``.
Position columns replace the reference's arrival order, so every downstream
"first n" is a deterministic, partition-independent ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.functions.ordering import with_global_index

# Language codes accepted by the monolingual ingestion.
KNOWN_LANGUAGES = ["en", "de", "zh", "ja"]


SCAN_PARTITIONS = "spark.lexaria.scan.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A scan with the splits of its files, dealt over ``SCAN_PARTITIONS`` partitions where the caller sets that.

    The setting is for tables of few row groups, whose scan would be the only task that reads text; it is
    unset by default, no code sets it by the size of the data, and no result depends on it.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def document_lines(docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """A1 on a documents table: every text line is a corpus line; strip, drop empty."""
    return (
        docs.select(F.col(key).alias("doc_id"), F.posexplode(T.split_lines(F.col(text_col))).alias("line_no", "raw"))
        .where(T.has_text(F.col("raw")))
        .select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), T.strip(F.col("raw")).alias("line"))
    )


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A1 on text files: ``(file, offset-ordered line id, line)``; strip, drop empty.

    The order key is (file path, split start, position inside the split), which
    is the file order without funnelling a file through one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
        F.col("value"),
    )
    return raw.select(
        "file", "block", "mid", T.strip(F.col("value")).alias("line")
    ).where(F.col("line") != "")


def indexed_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A4 input: ``(line_no, line)`` with the global 0-based number of every physical line.

    A split of a file is read in its order by one task, so the lines are stored where they are read and numbered
    by the counts of the splits before theirs; lines are not moved.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line")).checkpoint(eager=True)
    splits = raw.groupBy("file", "block").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("file", "block").collect()
    starts, run = [], 0  # one row per split of a file
    for r in splits:
        starts.append((r["file"], r["block"], run - r["first"]))
        run += r["n"]
    shift = spark.createDataFrame(starts, "file string, block bigint, shift bigint")
    return raw.join(F.broadcast(shift), ["file", "block"]).select((F.col("mid") + F.col("shift")).alias("line_no"), "line")


def count_lines(spark: SparkSession, path: str) -> int:
    """Every physical line, blank ones included."""
    return spark.read.text(path).count()


def sentences(lines: DataFrame) -> DataFrame:
    """C1 + C2: regex sentence split, strip, keep sentences longer than 10 characters."""
    # ``line`` is stripped, so the pieces are too (see ``text.split_sentences``)
    return (
        lines.select("doc_id", "line_no", F.posexplode(T.split_sentences(F.col("line"))).alias("sent_no", "sentence"))
        .where(F.length("sentence") > 10)
        .select("doc_id", "line_no", F.col("sent_no").cast("bigint").alias("sent_no"), "sentence")
    )


def monolingual_corpus(docs: DataFrame, language: str, max_sentences: int | None = None) -> DataFrame:
    """A2: sentences of one language, in corpus order, optionally capped.

    Documents whose text is empty are skipped; unknown languages are an error.
    """
    if language not in KNOWN_LANGUAGES and docs.where(F.col("lang") == language).limit(1).isEmpty():
        raise ValueError(f"Unsupported language: {language}")
    s = sentences(document_lines(docs.where((F.col("lang") == language) & (F.col("text") != ""))))
    return first_in_order(s, ["doc_id", "line_no", "sent_no"], max_sentences)


def first_in_order(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows of a total order; ``n`` may be far more than one task can sort."""
    if not n:
        return df
    return with_global_index(df, order, "_nth").where(F.col("_nth") < n).drop("_nth")


def parallel_pairs(src: DataFrame, l1: str, l2: str, max_pairs: int | None = None,
                   key: str = "pair_id", map_col: str = "translation") -> DataFrame:
    """A3: pull two languages from a map column; keep pairs where both are non-empty."""
    out = src.select(
        F.col(key).alias("pair_id"),
        T.strip(F.col(map_col)[l1]).alias("src"),
        T.strip(F.col(map_col)[l2]).alias("tgt"),
    ).where((F.col("src") != "") & (F.col("tgt") != ""))
    return first_in_order(out, ["pair_id"], max_pairs)


def zip_aligned(left: DataFrame, right: DataFrame, key: str = "line_no") -> DataFrame:
    """A4: two line-indexed relations zipped by index; unequal length is an error.

    The check is a full-outer join whose unmatched count must be zero.
    """
    l = left.select(F.col(key).alias("pair_id"), F.col("line").alias("src"))
    r = right.select(F.col(key).alias("pair_id"), F.col("line").alias("tgt"))
    joined = l.join(r, "pair_id", "full_outer")
    bad = joined.where(F.col("src").isNull() | F.col("tgt").isNull()).limit(1).count()
    if bad:
        raise ValueError("aligned inputs have different lengths")
    return joined


def web_texts(pages: DataFrame, text_col: str = "text", key: str = "page_id",
              min_len: int = 20, max_chars: int | None = None, max_texts: int | None = None) -> DataFrame:
    """Strip, drop texts shorter than ``min_len``; ``max_chars`` cuts texts only where it is given."""
    cut = F.col("t") if max_chars is None else F.substring("t", 1, max_chars)
    out = (
        pages.select(F.col(key).alias("text_id"), T.strip(F.col(text_col)).alias("t"))
        .where(F.length("t") >= min_len)
        .select("text_id", cut.alias("text"))
    )
    return first_in_order(out, ["text_id"], max_texts)


def size_profile(docs: DataFrame) -> DataFrame:
    """E2 re-aimed: real per-language profile (documents, sentences, bytes)."""
    per_doc = sentences(document_lines(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sent"))
    return (
        docs.join(per_doc, "doc_id", "left")
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("n_docs"),
            F.coalesce(F.sum("n_sent"), F.lit(0)).cast("bigint").alias("n_sentences"),
            F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes"),
        )
    )


def language_profile(docs: DataFrame, language: str) -> DataFrame:
    """E2 for one language: its profile row, or one row with status ``unknown``."""
    asked = docs.sparkSession.createDataFrame([(language,)], "lang string")
    found = asked.join(size_profile(docs.where(F.col("lang") == language)), "lang", "left")
    return found.withColumn("status", F.when(F.col("n_docs").isNull(), "unknown").otherwise("known"))
