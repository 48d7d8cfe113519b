"""Ranks over whole tables or a few large groups, without one task for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import prefixed
from ..functions.shared import cut

#: Ranges of values that are ordered apart from each other.
RANGES = 128


def rank_min(df: DataFrame, *, value: str, within: list[str] | None = None, name: str = "rank", descending: bool = True) -> DataFrame:
    """Adds the rank by value, 1 for the best; ties share the smallest, nulls come last.

    The rows are dealt once, by range of values between quantiles, and a rank is the rank in the range and the rows of the
    better ranges. A quantile is a range of its own: a value that many rows share is one, and its rows, which all rank
    first in it, are spread. What is left of a range is about a RANGES-th of all rows. The input is written once, since it is read three times.
    """
    keys = within or []
    worth = F.coalesce(F.col(value).cast("double") * (-1 if descending else 1), F.lit(float("inf")))  # nulls behind all others
    rows = cut(df.withColumn("__v", worth))
    cuts = rows.agg(F.array_distinct(F.percentile_approx("__v", [k / RANGES for k in range(1, RANGES)], F.lit(10_000)))).first()[0] or []  # RANGES numbers at most
    edges = F.array(*map(F.lit, cuts)).cast("array<double>")
    placed = rows.withColumn("__range", 2 * F.size(F.filter(edges, lambda c: c < F.col("__v"))) + F.array_contains(edges, F.col("__v")).cast("int"))

    better = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    offsets = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(better), F.lit(0)).alias("__offset"))  # 2 x RANGES rows of a group
    spread = F.when(F.col("__range") % 2 == 1, F.spark_partition_id()).otherwise(0)
    local = placed.withColumn("__spread", spread).withColumn("__local", F.rank().over(Window.partitionBy(*keys, "__range", "__spread").orderBy("__v")))
    met = local.join(offsets, [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__range") == F.col("__r")])
    kept = [c for c in df.columns if c != name]
    return met.select(*kept, (F.col("__local") + F.col("__offset")).cast("int").alias(name))


def numbered(df: DataFrame, *, value: str, tie: list[str], within: list[str] | None = None, ascending: bool = True, name: str = "place") -> DataFrame:
    """Adds the position 1..n by value within each group, nulls last, ties by ``tie``: see ``functions.order.prefixed``."""
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    return prefixed(df, order=[order, *tie], within=within or [], number=name).withColumn(name, F.col(name).cast("int"))
