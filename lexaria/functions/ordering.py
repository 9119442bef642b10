"""Distributed global ordering helpers.

A bare ``Window.orderBy`` (no partition) moves every row into one task.  For
corpus-sized inputs we instead range-partition on a *total* order key, number
rows inside each partition, and add per-partition offsets (one count per
partition reaches the driver, as with ``zipWithIndex``; the offsets travel as a
literal array indexed by partition id, so no join is needed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_global_index(
    df: DataFrame, order_cols: list, name: str = "idx", num_partitions: int | None = None
) -> DataFrame:
    """Add a 0-based ``bigint`` position in the total order ``order_cols``.

    ``order_cols`` must form a total order (add a unique tiebreaker), so the
    numbering is deterministic and survives task re-execution.
    """
    return indexed_with_count(df, order_cols, name, num_partitions)[0]


def indexed_with_count(
    df: DataFrame, order_cols: list, name: str = "idx", num_partitions: int | None = None
) -> tuple[DataFrame, int]:
    """``with_global_index`` that also returns the row count (known for free)."""
    out, run = _numbered(df, order_cols, name, num_partitions)
    return out.drop("_pid"), run


def _numbered(
    df: DataFrame, order_cols: list, name: str, num_partitions: int | None = None
) -> tuple[DataFrame, int]:
    """Rows with their position and the range partition ``_pid`` they lie in, and the row count."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    # Partition id and in-partition position are stored once (reliable
    # checkpoint in the shared checkpoint folder): later stages may coalesce
    # or re-split partitions, but they only read these columns.
    tagged = ranged.select(
        "*",
        F.spark_partition_id().cast("bigint").alias("_pid"),
        F.monotonically_increasing_id().alias("_mid"),
    ).withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), 33)).drop("_mid")
    tagged = tagged.checkpoint(eager=True)
    # one count per partition (bounded by the partition count, like zipWithIndex)
    sizes = {r["_pid"]: r["_n"] for r in tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect()}
    width = (max(sizes) + 1) if sizes else 1
    offsets, run = [], 0
    for p in range(width):
        offsets.append(run)
        run += sizes.get(p, 0)
    table = F.array(*[F.lit(o).cast("bigint") for o in offsets])
    out = tagged.withColumn(name, (F.element_at(table, (F.col("_pid") + 1).cast("int")) + F.col("_local"))
                            .cast("bigint")).drop("_local")
    return out, run


def average_rank(
    df: DataFrame, value: str, group: list[str], tiebreak: list[str], name: str
) -> DataFrame:
    """1-based rank of ``value`` inside ``group`` with ties given their average rank.

    A rank scan with carry: rows are numbered in the total order, each range partition is
    reduced to its tie blocks, blocks that cross partition borders are united, and every
    partition gets its blocks' ranks back.  The joins are keyed by the range partition, so a
    value or group that all rows share still spreads over as many tasks as it has partitions.
    """
    indexed, _ = _numbered(df, group + [value] + tiebreak, "_gi")
    parts = indexed.groupBy("_pid", *group, value).agg(F.min("_gi").alias("_lo"), F.max("_gi").alias("_hi"))
    blocks = parts.groupBy(*group, value).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    heads = parts.groupBy("_pid", *group).agg(F.min("_lo").alias("_g"))  # a group has a row per partition
    starts = heads.drop("_g").join(heads.groupBy(*group).agg(F.min("_g").alias("_g0")), group)
    ranks = parts.drop("_lo", "_hi").join(blocks, [*group, value]).join(starts, ["_pid", *group]).select(
        "_pid", *group, value, ((F.col("_lo") + F.col("_hi")) / 2.0 - F.col("_g0") + 1.0).alias(name)
    )
    return indexed.drop("_gi").join(ranks, ["_pid", *group, value]).drop("_pid")
