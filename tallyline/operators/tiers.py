"""Gap tiers without a fold over a segment.

A row opens a tier when its gap to the row before is large, which the two values tell alone, or when the tier is full. Large
gaps cut a segment into runs, each of which opens at least one tier. Rows from the LAST_TIER-th run on are therefore in the
last tier, and what comes before is told by the lengths of so many runs: they are folded, a few numbers for each segment, and
every row then finds its tier by its place in its run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import chunked, prefixed
from ..functions.shared import cut

# Fixed values: (previous value from, least gap, least share of it), highest first; sizes and the last tier.
GAP_RULES = [(200.0, 15.0, 0.07), (100.0, 12.0, 0.10), (50.0, 20.0, 0.18)]
GAP_ELSE = (30.0, 0.35)
SIZE_CAPS = (5, 8, 12)  # up to tier 5: 8 rows, then 12
LAST_TIER = 18


def _by_previous(previous: Column, k: int) -> Column:
    out = F.lit(GAP_ELSE[k])
    for start, *least in reversed(GAP_RULES):
        out = F.when(previous >= start, F.lit(least[k])).otherwise(out)
    return out


def _tier_at(first: Column, place: Column) -> Column:
    """The tier of a run's ``place``-th row (from 0), when the run's first row is in tier ``first``."""
    last_small, small, large = SIZE_CAPS
    in_small = F.greatest(last_small + 1 - first, F.lit(0)) * small
    later = F.greatest(first, F.lit(last_small + 1)) + F.floor((place - in_small) / large)
    return F.least(F.when(place < in_small, first + F.floor(place / small)).otherwise(later), F.lit(LAST_TIER)).cast("int")


def gap_tiers(df: DataFrame, *, segment: list[str], value: str, key: str, chunk: int | None = None) -> DataFrame:
    """segment..., key, value, tier. Values from high to low (ties by key); a row opens a tier if its gap to the row
    before, or the gap's share of that, reaches the rule for the row before, or the tier is full, up to LAST_TIER. Null values are left out.

    Rows are numbered by ranges; gaps and runs are told in chunks of a segment with the last row of the chunk before; so no
    task holds a segment and no array grows with one.
    """
    rows = prefixed(df.where(F.col(value).isNotNull()).select(*segment, key, F.col(value).cast("double").alias("__v")), within=segment, order=[F.col("__v").desc(), key], number="__n")
    of_chunk = Window.partitionBy(*segment, "__chunk").orderBy("__n")
    previous, v = F.col("__previous"), F.col("__v")
    share = F.when(previous > 0, (previous - v) / previous).otherwise(0.0)
    cuts = previous.isNull() | (previous - v >= _by_previous(previous, 0)) | (share >= _by_previous(previous, 1))
    told = chunked(rows, number="__n", halo=1, size=chunk).withColumn("__previous", F.lag("__v").over(of_chunk)).where("__own")
    told = cut(told.withColumn("__cuts", cuts.cast("int")).withColumn("__local", F.sum("__cuts").over(of_chunk)))

    names = [F.col(s).alias(f"__{s}") for s in segment]
    same = [F.col(s).eqNullSafe(F.col(f"__{s}")) for s in segment]
    earlier = Window.partitionBy(*segment).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = told.groupBy(*segment, "__chunk").agg(F.sum("__cuts").alias("__t"))
    offsets = totals.select(*names, F.col("__chunk").alias("__c"), F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__before"))  # a row for each chunk
    runs = told.join(offsets, [*same, F.col("__chunk") == F.col("__c")]).select(*segment, key, "__v", "__n", (F.col("__local") + F.col("__before")).alias("__run"))

    firsts = runs.where(F.col("__run") <= LAST_TIER).groupBy(*segment, "__run").agg(F.min("__n").alias("start"), F.count("*").alias("n"))
    ordered = firsts.groupBy(*segment).agg(F.array_sort(F.collect_list(F.struct(F.col("__run").alias("run"), "start", "n"))).alias("__runs"))  # LAST_TIER at most

    def step(a: Column, r: Column) -> Column:
        first = F.least(a["tier"] + 1, F.lit(LAST_TIER))
        return F.struct(_tier_at(first, r["n"] - 1).alias("tier"), F.array_append(a["out"], F.struct(r["start"].alias("start"), first.alias("first"))).alias("out"))

    none = F.struct(F.lit(0).alias("tier"), F.array().cast("array<struct<start:bigint,first:int>>").alias("out"))
    opened = ordered.select(*names, F.aggregate("__runs", none, step, lambda a: a["out"]).alias("__opened"))
    run = F.get("__opened", F.col("__run").cast("int") - 1)
    tier = F.when(F.col("__run") > LAST_TIER, LAST_TIER).otherwise(_tier_at(run["first"], F.col("__n") - run["start"]))
    return runs.join(opened, same).select(*segment, key, F.col("__v").alias(value), tier.alias("tier"))
