"""Session settings, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"
#: Shuffle files are removed at the end of the action that wrote them.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build(name: str = "quellwerk", master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A session with the settings the operators are written for."""
    return (
        SparkSession.builder.appName(name)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scalar(df: DataFrame):
    """The value of a one-row, one-column aggregate, so that no row has to be paired with it."""
    return df.first()[0]


def work_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; only a local session without one gets its own."""
    folder = spark.conf.get(CHECKPOINT, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} must name a folder all executors share")
        folder = os.path.join(tempfile.gettempdir(), "quellwerk-checkpoints")
    return folder.rstrip("/")


#: Folders this process has written to and not yet removed.
_written: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder."""
    _written.append(f"{work_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}")
    return _written[-1]


def clean(spark: SparkSession) -> None:
    """Remove what this process has written below the shared folder; for when no result is read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and read it again: cuts the lineage and survives lost executors.

    The shuffle files of the write go when it is over, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a materialised result that nothing reads any more."""
    spark = df.sparkSession
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for path in [w for w in _written if w.rsplit("/", 1)[-1] in names]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)
