"""Row numbers and prefix sums in two levels, against one window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyline.functions.order import prefixed


def test_numbers_and_sums_equal_one_window_with_a_hot_group_and_ties(spark):
    df = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 9 == 0, F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),  # the rest: null
        F.when(F.col("id") % 11 > 0, F.col("id") % 4).alias("v"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("m"),
    )
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    got = prefixed(df.repartition(6), order=order, within=["g"], number="n", sums={"before": "m"})
    w = Window.partitionBy("g").orderBy(*order)
    want = df.withColumn("n", F.row_number().over(w).cast("long")).withColumn("before", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_equal_rows_are_split_over_partitions_and_numbered_once(spark):
    df = spark.range(4000).select(F.lit(7).alias("v"))
    assert sorted(r["place"] for r in prefixed(df, order=["v"], number="place").collect()) == list(range(1, 4001))
    held = prefixed(df, order=["v"], number="place").select(F.spark_partition_id().alias("p"), "place")
    assert held.select("p").distinct().count() > 1
    assert prefixed(df.limit(0), order=["v"], number="v", sums={"s": "v"}).collect() == []
    assert prefixed(df, order=["v"], number="v").columns == ["v"]
