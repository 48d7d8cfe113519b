"""Decimals as the SQL twins make them."""

import random

import duckdb
from pyspark.sql import functions as F

from tallyline.functions import stats


def test_a_measure_is_cast_as_sql_casts_it(spark):
    """Among them means of eight prices, whose fifth place is a half."""
    rng = random.Random(5)
    values = [(rng.randrange(10**5, 4 * 10**8) / 100.0) / 8 * rng.choice((1, -1)) for _ in range(4000)] + [0.0, -0.0, 0.00005, 0.49999999999999994e-4, 4.5e11 + 0.25]
    want = dict(duckdb.execute("SELECT x, CAST(CAST(x AS DECIMAL(18,4)) AS VARCHAR) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall())
    df = spark.createDataFrame([(v,) for v in values], "x double")
    with stats.exact_sums(4):
        got = {r["x"]: r["d"] for r in df.select("x", stats.measure("x").cast("string").alias("d")).collect()}
        whole = spark.range(1).select(stats.measure(F.lit(3)).alias("i"), stats.measure(F.lit("2.5").cast("decimal(9,2)")).alias("d")).first()
    assert got == want and [str(whole["i"]), str(whole["d"])] == ["3.0000", "2.5000"]
