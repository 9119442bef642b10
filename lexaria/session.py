"""Spark session helpers.

The library never hard-codes a storage location: lineage is cut into the
shared folder the cluster names in ``spark.checkpoint.dir``.  Only when that
setting is absent *and* the master is local (tests, benches) a scratch folder
is created.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(
    master: str | None = None,
    app: str = "lexaria",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    if not spark.sparkContext.master.startswith("local"):
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import its functions by name.

    Not needed where the package is installed on every node, or in local mode.
    """
    import shutil
    from pathlib import Path

    here = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="lexaria-pkg-")) / "lexaria"
    archive = shutil.make_archive(str(base), "zip", root_dir=here.parent, base_dir=here.name)
    spark.sparkContext.addPyFile(archive)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only locally."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is unset; set it to a folder shared by all executors"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexaria-ckpt-"))
    return sc.getCheckpointDir()


def stage_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return checkpoint_dir(spark).rstrip("/") + "/" + name
