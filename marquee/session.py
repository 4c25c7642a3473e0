"""Session defaults and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that a task sorts or groups, about.
TASK_ROWS = 1 << 20
#: Whether a query removes its shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marquee")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, n_rows: int | None, *keys: str) -> DataFrame:
    """``rows`` placed by ``keys`` over more tasks than usual, if there are more than ``TASK_ROWS`` for each; as they are where ``n_rows`` is not known.

    Joins and groups by the same keys then keep these tasks, whose memory doesn't grow with the table.
    """
    usual = shuffle_partitions(rows.sparkSession)
    if n_rows is None or n_rows <= usual * TASK_ROWS:
        return rows
    return rows.repartition(-(-n_rows // TASK_ROWS), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; one of our own only on a local master."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            configured = tempfile.mkdtemp(prefix="marquee-checkpoint-")
        sc.setCheckpointDir(configured)
        named = sc.getCheckpointDir()
    return named


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run here go once each has ended; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a result feeds several branches of a plan: the branches then read
    files that outlive any executor instead of recomputing the whole upstream. What was shuffled for it is removed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
