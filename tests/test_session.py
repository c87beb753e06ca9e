import os

from pyspark.sql import functions as F

from huemill.session import materialised, stored_alone


def test_stored_rows_take_little_room(spark):
    """A long text that many rows share, and rows of regular numbers, are stored in less than eight bytes a row; the schema stays."""
    df = spark.range(50_000).select("id", F.lit("円 " * 20).alias("text"), F.struct((F.col("id") % 7).alias("k")).alias("s"), F.array(F.col("id") % 3).alias("a"))
    out = materialised(df)
    size = sum(os.path.getsize(f.removeprefix("file:")) for f in (x.replace("file://", "") for x in out.inputFiles()))
    assert out.inputFiles() and size < 8 * 50_000
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in df.schema]
    assert sorted(out.collect()) == sorted(df.collect())


def test_many_stored_rows_are_not_broadcast(spark):
    """Rows that take few bytes as Parquet may take much of a driver's memory: they are joined by sorting, few rows as Spark likes."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    many, few = (materialised(spark.range(n).select(F.expr("id div 1000").alias("k"), F.lit(1).alias("v"))) for n in (200_000, 1_000))
    other = spark.range(10_000_000).select(F.col("id").alias("k"))
    for kept in (many, many.where("v = 1").select("k"), many.groupBy("k").agg(F.max("v"))):
        assert "BroadcastHashJoin" not in plan(other.join(kept, "k")) and "SortMergeJoin" in plan(other.join(kept, "k"))
    assert "BroadcastHashJoin" in plan(other.join(few, "k"))
    assert many.join(few, "k").count() == 200_000 // 200 * 1_000


def test_steps_are_removed_and_the_result_stays(spark):
    made = []

    def make():
        made.append(materialised(spark.range(1000).repartition(5, "id")))
        made.append(stored_alone(spark, lambda: materialised(made[0].where("id < 500")).where("id < 200")))
        return made[1].groupBy((F.col("id") % 10).alias("k")).count()

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    out = stored_alone(spark, make)
    here = lambda df: [f for f in df.inputFiles() if os.path.exists(f.removeprefix("file:").replace("//", "/"))]
    assert len(here(out)) == len(out.inputFiles()) > 0 and not here(made[0]) and not here(made[1])
    assert sorted(map(tuple, out.collect())) == [(k, 20) for k in range(10)]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
