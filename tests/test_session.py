from pathlib import Path

from marquee.session import stage


def shuffle_files(spark):
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0]
    return {p.name for p in Path(str(folder)).rglob("shuffle_*.data")}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    rows = stage(spark.range(10_000).repartition(3, "id").selectExpr("id % 100 AS k").groupBy("k").count(), "counted")
    assert rows.count() == 100 and rows.groupBy().sum("count").first()[0] == 10_000
    left = shuffle_files(spark) - before
    # What count() and first() shuffle are single rows; the 10,000 keys are gone.
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0]
    assert sum(p.stat().st_size for p in Path(str(folder)).rglob("shuffle_*.data") if p.name in left) < 5_000
    assert spark.conf.get(key) == setting
