"""Row numbers and prefix sums over whole tables or a few large groups, in two levels.

Rows are dealt to partitions by range of (group, order), so that each holds about as many, whatever its groups and ties. A
partition is ordered by itself; its counts and sums, a row for each group in it, are added up over the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: monotonically_increasing_id() keeps the partition above so many bits, the row's number in it below.
_ROW_BITS = 33
#: Rows of a chunk of an ordered group.
CHUNK = 1 << 16


def _arranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` over partitions by range of ``keys``, with __place ascending in that order. Written, since ranges are sampled anew
    with every plan. Rows of equal keys are told apart by a number, so that they can be split as well."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = [*keys, F.col("__row")]
    ranged = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *every).sortWithinPartitions(*every)
    return cut(ranged.drop("__row").withColumn("__place", F.monotonically_increasing_id()))


def prefixed(df: DataFrame, *, order: Sequence[Column | str], within: Sequence[str] = (), number: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``number``, the row's number 1.. in the order of its group, and for each of ``sums`` (name: measure) the sum of the
    measure, null as 0, over the rows before it in its group. Null is a group of its own. Rows of equal order are numbered one
    after the other in no fixed order. Input columns may bear the names of new ones, which replace them; an empty table stays empty.

    The input is read twice, once to sample its ranges: ``cut`` it first where it is dear. Its rows are exchanged once, and
    once more where there are sums. Exchanged besides: a row for each partition and group in it.
    """
    sums = sums or {}
    groups = [F.col(g) for g in within]
    keys = [*(g.asc_nulls_first() for g in groups), *(F.col(o) if isinstance(o, str) else o for o in order)]
    measured = df.withColumns({f"__s{k}": F.coalesce(F.col(m), F.lit(0)) for k, m in enumerate(sums.values())}) if sums else df
    rows = _arranged(measured, keys).withColumn("__part", F.shiftright("__place", _ROW_BITS))

    totals = rows.groupBy(*within, "__part").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"), *[F.sum(f"__s{k}").alias(f"__t{k}") for k in range(len(sums))])
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    added = [F.coalesce(F.sum(f"__t{k}").over(earlier), F.lit(0)).alias(f"__b{k}") for k in range(len(sums))]
    shift = (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift")
    offsets = totals.select(*[g.alias(f"__g{k}") for k, g in enumerate(groups)], F.col("__part").alias("__p"), shift, *added)

    if sums:
        local = Window.partitionBy(*within, "__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({f"__l{k}": F.coalesce(F.sum(f"__s{k}").over(local), F.lit(0)) for k in range(len(sums))})
    met = rows.join(offsets, [F.col("__part") == F.col("__p"), *[g.eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(groups)]])
    new = {number: F.col("__place") + F.col("__shift")} if number else {}
    new |= {name: F.col(f"__l{k}") + F.col(f"__b{k}") for k, name in enumerate(sums)}
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[c.alias(name) for name, c in new.items()])


def chunked(numbered: DataFrame, *, number: str, halo: int, size: int | None = None) -> DataFrame:
    """Adds __chunk, in which windows over an ordered group run instead of over all of it, and __own: each row in its own chunk,
    and the last ``halo`` rows of a chunk again, not __own, in the next one, for windows that look back so far."""
    size = size or CHUNK
    at = F.col(number) - 1
    chunk = F.floor(at / size)
    chunks = F.when(at % size >= size - halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return numbered.select("*", F.explode(chunks).alias("__chunk")).withColumn("__own", F.col("__chunk") == chunk)
