"""Staging of intermediate tables in the shared checkpoint folder.

A staged table cuts lineage, survives lost executors, can be pruned by column and carries real size
statistics, so the optimizer decides on broadcasts from facts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Whether the shuffle files of a query go when it ends; else they stay until the driver collects its garbage.
_FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_root(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; there is no other place for staged tables."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return root.rstrip("/")


def ensure_local_root(spark: SparkSession) -> None:
    """Give a one-machine session what it lacks: a checkpoint folder, and this package on its workers' path.

    Sessions on a cluster are left alone; there the package is installed or shipped with the job.
    """
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        return
    if not (spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sitemill-"))
    context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/sitemill/{label}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that end herein leave no shuffle files; their results must be written or on the driver."""
    before = spark.conf.get(_FREES_SHUFFLES, None)
    spark.conf.set(_FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREES_SHUFFLES) if before is None else spark.conf.set(_FREES_SHUFFLES, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet and go on from the written table."""
    spark = df.sparkSession
    target = new_path(spark, label)
    with freed(spark):
        df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def unstage(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more; those of other tables stay."""
    for df in tables:
        spark = df.sparkSession
        own = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            files = path.getFileSystem(spark._jsc.hadoopConfiguration())
            home = files.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(f"{staging_root(spark)}/sitemill"))
            if files.makeQualified(path).getParent().equals(home):
                files.delete(path, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition small rows that are costly to work on.

    The number of partitions is that of the session's shuffles and is kept: adaptive execution would
    merge partitions by their bytes, which say little about the work the rows bring.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
