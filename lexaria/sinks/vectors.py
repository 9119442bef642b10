"""Word-vector and table sinks.

Every sink writes a *directory* of part files from the executors (no
``coalesce(1)``, nothing through the driver).  Text formats go through
``write.text``; the header of the word2vec text format is a one-row relation
put before the vectors, so it lands at the start of the first part.  The
binary format is a Spark Python data source whose tasks write complete,
self-contained shards (own header) of at most ``SHARD_ROWS`` words, published by
the commit.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lexaria.sources.vectors import encode_shard

FORMATS = ("w2v_text", "w2v_binary", "glove_text", "columnar")


def _vec_text(vec: str = "vec", fmt: str = "%.6f"):
    return F.array_join(F.transform(F.col(vec), lambda x: F.format_string(fmt, x)), " ")


def _text_lines(df: DataFrame, body, header: DataFrame | None, order: str | None) -> DataFrame:
    """Header first, then the rows sorted by ``order``, or in their own order where it is None."""
    lines = (df.orderBy(order) if order else df).select(body.alias("value"))
    # a union keeps the order of its sides: the header is the first line of the first part file
    return lines if header is None else header.select("value").unionByName(lines)


def write_word2vec_text(df: DataFrame, path: str, order: str | None = None) -> str:
    """B1: header ``"n d"``, then ``word v1 .. vd`` with ``%.6f`` values, in the order of ``df``.

    ``order`` names a column to sort by (``word_idx`` for vocabulary order).
    """
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"))
    header = stats.select(F.concat_ws(" ", F.col("n").cast("string"), F.col("d").cast("string")).alias("value"))
    body = F.concat_ws(" ", F.col("word"), _vec_text())
    _text_lines(df, body, header, order).write.mode("overwrite").text(path)
    return path


def write_glove_text(df: DataFrame, path: str, order: str | None = None) -> str:
    """B2: ``word v1 .. vd`` with ``%.6f`` values, no header; order as in B1."""
    body = F.concat_ws(" ", F.col("word"), _vec_text())
    _text_lines(df, body, None, order).write.mode("overwrite").text(path)
    return path


def write_full_precision(df: DataFrame, path: str) -> str:
    """``word v1 .. vd`` with full-precision (shortest round-trip) values."""
    body = F.concat_ws(" ", F.col("word"), F.array_join(F.col("vec").cast("array<string>"), " "))
    df.select(body.alias("value")).write.mode("overwrite").text(path)
    return path


def write_columnar(df: DataFrame, path: str) -> str:
    """Words and vectors as a columnar (Parquet) table."""
    df.select("word", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)
    return path


# --------------------------------------------------------------------------- binary shards

SHARD_ROWS = 100_000


@dataclass
class _Shards(WriterCommitMessage):
    files: list[str]


class _ShardWriter(DataSourceWriter):
    """Tasks write into a folder of this write; only ``commit`` publishes, and only the files
    of the attempts that succeeded.  A failed write leaves the target as it was."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex[:12]

    def _folder(self, root: str) -> str:
        return f"{root.rstrip('/')}/_attempt-{self.run}"

    def write(self, iterator):
        from itertools import islice

        from pyspark import TaskContext

        task = TaskContext.get()
        filesystem, root = _filesystem(self.path)
        rows = ((r["word"], list(r["vec"])) for r in iterator)
        files: list[str] = []
        while part := list(islice(rows, SHARD_ROWS)):  # a shard's header needs its row count
            name = f"part-{self.run}-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files):04d}.bin"
            filesystem.create_dir(self._folder(root), recursive=True)
            with filesystem.open_output_stream(f"{self._folder(root)}/{name}") as f:
                f.write(encode_shard(part))
            files.append(name)
        return _Shards(files)

    def commit(self, messages):
        from pyarrow import fs as pafs

        filesystem, root = _filesystem(self.path)
        filesystem.create_dir(root, recursive=True)
        old = [f.path for f in filesystem.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".bin")]
        for name in [n for m in messages if m is not None for n in m.files]:
            filesystem.move(f"{self._folder(root)}/{name}", f"{root.rstrip('/')}/{name}")
        if self.overwrite:
            for f in old:
                filesystem.delete_file(f)
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs as pafs

        filesystem, root = _filesystem(self.path)
        if filesystem.get_file_info(self._folder(root)).type == pafs.FileType.Directory:
            filesystem.delete_dir(self._folder(root))


def _filesystem(path: str):
    """A pyarrow filesystem and path for a qualified path (with a scheme)."""
    from pyarrow import fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme Spark's readers would give it, so all tasks mean the same place."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


class Word2VecBinary(DataSource):
    """``df.write.format("w2vbin").mode("overwrite").save(path)``."""

    @classmethod
    def name(cls):
        return "w2vbin"

    def schema(self):
        return "word string, vec array<double>"

    def writer(self, schema, overwrite):
        return _ShardWriter(self.options["path"], overwrite)


def register_formats(spark: SparkSession) -> None:
    spark.dataSource.register(Word2VecBinary)


def write_word2vec_binary(df: DataFrame, path: str, shards: int | None = None) -> str:
    """A directory of complete binary files, one per shard (each with its header)."""
    register_formats(df.sparkSession)
    out = df.select("word", F.col("vec").cast("array<double>").alias("vec"))
    if shards:
        out = out.repartition(shards, "word")
    out.write.format("w2vbin").mode("overwrite").save(_qualified(df.sparkSession, path))
    return path


def export_embeddings(df: DataFrame, output_dir: str, name: str, formats=None) -> dict[str, str]:
    """Write the requested formats (default all four); returns format -> path."""
    formats = list(formats) if formats is not None else list(FORMATS)
    unknown = [f for f in formats if f not in FORMATS]
    if unknown:
        raise ValueError(f"Unknown format(s): {unknown}")
    base = output_dir.rstrip("/") + "/" + name
    out = {}
    writers = {
        "w2v_text": lambda p: write_word2vec_text(df, p),
        "w2v_binary": lambda p: write_word2vec_binary(df, p),
        "glove_text": lambda p: write_glove_text(df, p),
        "columnar": lambda p: write_columnar(df, p),
    }
    for f in formats:
        out[f] = writers[f](f"{base}.{f}")
    return out


# --------------------------------------------------------------------------- tables

def write_sentences(df: DataFrame, path: str, col: str = "sentence") -> str:
    """One sentence per line."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)
    return path


def write_pairs(df: DataFrame, path: str) -> str:
    """Aligned pairs stay in one table so alignment cannot break."""
    df.select("pair_id", "src", "tgt").write.mode("overwrite").parquet(path)
    return path


def write_feature_batches(df: DataFrame, path: str, save_every: int, batch_size: int = 1) -> str:
    """Rows in ``row_no`` order, flushed as soon as at least ``save_every`` rows are held.

    Rows arrive ``batch_size`` at a time, so a flush holds the first multiple of it that
    reaches ``save_every`` (both flush rules of the contract agree on that).  ``batch_id``
    is a column; rows are range-partitioned by it, so the number of files follows the data.
    """
    flush = -(-save_every // batch_size) * batch_size
    out = df.withColumn("batch_id", F.floor(F.col("row_no") / flush).cast("bigint"))
    out = out.select("batch_id", "row_no", "text", F.col("vec").cast("array<float>").alias("vec"))
    out.repartitionByRange("batch_id", "row_no").sortWithinPartitions("batch_id", "row_no").write.mode("overwrite").parquet(path)
    return path


def write_table(df: DataFrame, path: str) -> str:
    """Parquet table."""
    df.write.mode("overwrite").parquet(path)
    return path


def extraction_outputs(vocab: DataFrame, result: DataFrame, vec_path: str, count_path: str) -> tuple[str, str]:
    """Vectors of found words + a count sidecar where missing words read ``NOT_FOUND``."""
    write_word2vec_text(result.select("word", "vec"), vec_path)
    side = vocab.select("word").join(result.select("word", "n_contexts"), "word", "left").select(
        F.concat_ws(" ", "word", F.coalesce(F.col("n_contexts").cast("string"), F.lit("NOT_FOUND"))).alias("value"))
    side.write.mode("overwrite").text(count_path)
    return vec_path, count_path


def write_metrics_json(df: DataFrame, path: str) -> str:
    """Evaluation results as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def stage_done(spark: SparkSession, path: str) -> bool:
    """A stage is complete iff its ``_SUCCESS`` marker exists."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def run_stage(spark: SparkSession, path: str, build) -> DataFrame:
    """Skip a finished stage and reload it; otherwise build, write, reload."""
    if not stage_done(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
