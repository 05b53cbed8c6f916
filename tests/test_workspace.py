from pathlib import Path

from pyspark.sql import functions as F

from sitemill.workspace import freed, stage, unstage


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for x in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    counted = spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count()
    staged = stage(counted, "counted")
    assert _shuffle_files(spark) <= before
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, counted.collect()))


def test_the_setting_of_the_session_is_left_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with freed(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before


def test_only_staged_tables_are_deleted(spark, tmp_path):
    kept = str(tmp_path / "kept")
    spark.range(5).write.parquet(kept)
    one, other = stage(spark.range(3), "one"), stage(spark.range(4), "other")
    unstage(one, spark.read.parquet(kept), spark.range(2).toDF("id"))
    assert not any(Path(f.removeprefix("file:").replace("///", "/")).exists() for f in one.inputFiles())
    assert other.count() == 4 and spark.read.parquet(kept).count() == 5
