"""Comparable seasons: pool, nearest neighbours with capped inverse-distance weights, blend with a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.stats import label, mean, rounded, std_pop
from .ranks import numbered


def comparable_pool(career: DataFrame, *, entity: str, season: str, segment: str, games: str, target: str, least_games: int = 8, first_from: int | None = None) -> DataFrame:
    """Seasons with enough games and a season after them, with that season's target as next_value. A first career year
    counts only where it is ``first_from`` or later (its start may lie before the data)."""
    w = Window.partitionBy(entity, segment).orderBy(season)
    pool = career.withColumn("next_value", F.when(F.lead(season).over(w) == F.col(season) + 1, F.lead(target).over(w)))
    pool = pool.where((F.col(games) >= least_games) & F.col("next_value").isNotNull())
    return pool if first_from is None else pool.where((F.col("career_year") > 1) | (F.col("first_season") >= first_from))


#: Cells of a segment's index for each square root of its rows.
CELLS = 4
#: Ranks of members whose distance to the pivot bounds the k-th distance of what is asked, besides the last one's.
RINGS = (1, 2, 4, 8, 16)
#: Bounds are compared with so much to spare, since distances are rounded.
_SPARE = 1e-9


def _distance(a: Column, b: Column, n: int) -> Column:
    """Euclidean distance of two arrays of ``n`` numbers, added up in their order."""
    squares = [(a[i] - b[i]) * (a[i] - b[i]) for i in range(n)]
    return F.sqrt(sum(squares[1:], squares[0]))


def _cells(pool: DataFrame, segment: list[str], width: int) -> DataFrame:
    """segment..., cell, pivot, inner, outer, rings, members: the pool's rows by the nearest of their segment's pivots, with the least
    and largest distance to it, and the distances that so many more of them keep. Pivots are rows that a hash of the key picks, CELLS x sqrt(rows) of a segment about, and the one
    with the smallest hash."""
    h = F.xxhash64("comp_entity", "comp_season")
    sizes = pool.groupBy(*segment).agg(F.count("*").alias("rows"))
    share = F.least(F.lit(1.0), CELLS / F.sqrt("rows"))
    picked = F.when(F.pmod(h, F.lit(1 << 30)) < share * (1 << 30), F.col("z"))
    pivots = pool.join(sizes, segment).groupBy(*segment).agg(F.array_distinct(F.concat(F.collect_list(picked), F.array(F.min_by("z", h)))).alias("pivots"))
    nearest = F.array_min(F.transform("pivots", lambda p, i: F.struct(_distance(p, F.col("z"), width).alias("r"), i.alias("cell"))))
    filed = pool.join(pivots, segment).withColumn("near", nearest).withColumn("pivot", F.get("pivots", F.col("near.cell")))
    members = F.collect_list(F.struct("comp_entity", "comp_season", "next_value", "z"))
    return filed.groupBy(*segment, F.col("near.cell").alias("cell")).agg(
        F.first("pivot").alias("pivot"), F.min("near.r").alias("inner"), F.max("near.r").alias("outer"), F.array_sort(F.collect_list("near.r")).alias("rs"), members.alias("members")
    ).withColumn("rings", _rings()).drop("rs")


def _rings() -> Column:
    """(r, n) of ``rs``, ascending distances: n more of them are within r."""
    ranks = F.array_sort(F.array_append(F.filter(F.array(*map(F.lit, RINGS)), lambda k: k < F.size("rs")), F.size("rs")))
    return F.transform(ranks, lambda k, i: F.struct(F.col("rs")[k - 1].alias("r"), (k - F.when(i > 0, F.get(ranks, i - 1)).otherwise(0)).alias("n")))


def nearest_rows(asked: DataFrame, pool: DataFrame, *, key: list[str], segment: list[str], k: int, width: int) -> DataFrame:
    """key..., near (the k nearest of ``pool`` as distance, comp_entity, comp_season, next_value, nearest first, ties by entity
    and season, never the asked row itself) and compared, how many rows of the pool were measured. ``asked``: entity and
    season first in ``key``, then the segment, and z (``width`` numbers); ``pool``: comp_entity, comp_season, segment, next_value, z.

    An exact join over a metric index. Of pool rows with equal z only the first k + 1 can be among the nearest, and only they
    are filed. A cell lies in the ring between ``inner`` and ``outer`` around its pivot. By the triangle inequality no member is
    nearer to an asked row at distance d from the pivot than max(d - outer, inner - d), and one at r from the pivot is no farther
    than d + r: the smallest such distance that k + 1 members keep bounds the k-th one, and cells beyond it are not visited. Each visited
    cell gives k rows at most, which are merged. A cell holds about a quarter of the root of its segment's rows; of cells, four times that root are weighed.
    """
    first = Window.partitionBy(*segment, "z").orderBy("comp_entity", "comp_season")
    filed = cut(pool.withColumn("__no", F.row_number().over(first)).where(F.col("__no") <= k + 1).drop("__no"))
    cells = cut(_cells(filed, segment, width))
    index = cells.groupBy(*segment).agg(F.collect_list(F.struct("cell", "pivot", "inner", "outer", "rings")).alias("cells"))

    d = lambda c: _distance(c["pivot"], F.col("z"), width)
    weighed = F.transform("cells", lambda c: F.struct(d(c).alias("d"), c["inner"].alias("inner"), c["outer"].alias("outer"), c["cell"].alias("cell"), c["rings"].alias("rings")))
    kept = F.array_sort(F.flatten(F.transform("weighed", lambda c: F.transform(c["rings"], lambda x: F.struct((c["d"] + x["r"]).alias("upper"), x["n"].alias("n"))))))
    start = F.struct(F.lit(0).alias("held"), F.lit(0.0).alias("bound"))
    bound = F.aggregate(kept, start, lambda a, x: F.when(a["held"] > k, a).otherwise(F.struct((a["held"] + x["n"]).alias("held"), x["upper"].alias("bound"))))["bound"]
    routed = asked.join(index, segment).withColumn("weighed", weighed).withColumn("bound", bound * (1 + _SPARE) + _SPARE)
    near = F.filter("weighed", lambda c: F.greatest(c["d"] - c["outer"], c["inner"] - c["d"]) <= F.col("bound"))
    visits = routed.select(*key, "z", F.explode(near["cell"]).alias("cell"))

    entity, season = key[:2]
    met = visits.join(cells.select(*segment, "cell", "members"), [*segment, "cell"])
    others = F.filter("members", lambda m: ~(m["comp_entity"].eqNullSafe(F.col(entity)) & m["comp_season"].eqNullSafe(F.col(season))))
    measured = F.transform(others, lambda m: F.struct(_distance(F.col("z"), m["z"], width).alias("distance"), m["comp_entity"].alias("comp_entity"), m["comp_season"].alias("comp_season"), m["next_value"].alias("next_value")))
    found = met.select(*key, F.slice(F.array_sort(measured), 1, k).alias("best"), F.size("members").alias("looked_at"))
    return found.groupBy(*key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("near"), F.sum("looked_at").alias("compared"))


def nearest_comparables(asked: DataFrame, pool: DataFrame, *, segment: list[str], entity: str, season: str, features: list[str], k: int = 8, least_pool: int = 4, cap: float = 0.40, digits: int | None = 1) -> DataFrame:
    """entity, season, segment..., comparable (weighted next_value of the k nearest), n_comps, names, compared.

    Distance: Euclidean over features (null as 0) z-scored by the pool's mean and population deviation (0 as 1). Weight
    1 / (d + 0.01), each cut to ``cap`` of the raw sum, then scaled once to sum 1. Ties by entity, season. Segments with
    fewer than ``least_pool`` rows give nothing; an asked row is not its own comparable. Names are told with the season after and
    its value. ``nearest_rows`` says how the nearest are found and what compared is.
    """
    filled = [F.coalesce(F.col(f), F.lit(0.0)).cast("double").alias(f) for f in features]
    seen = cut(pool.select(F.col(entity).alias("comp_entity"), F.col(season).alias("comp_season"), *segment, "next_value", *filled))
    stats = seen.groupBy(*segment).agg(F.count("*").alias("pool_size"), *[x for f in features for x in (mean(f).alias(f"{f}_mean"), std_pop(f).alias(f"{f}_std"))])
    stats = stats.where(F.col("pool_size") >= least_pool)

    def scored(df: DataFrame) -> DataFrame:
        unit = [(F.col(f) - F.col(f"{f}_mean")) / F.when(F.col(f"{f}_std") > 0, F.col(f"{f}_std")).otherwise(1.0) for f in features]
        return df.join(stats, segment).select(*[c for c in df.columns if c not in features], F.array(*unit).alias("z"))

    key = [entity, season, *segment]
    near = nearest_rows(scored(asked.select(*key, *filled)), scored(seen), key=key, segment=segment, k=k, width=len(features)).where(F.size("near") > 0)

    def fold(of) -> Column:
        return F.aggregate("near", F.lit(0.0), lambda a, t: a + of(t))

    raw = lambda t: 1 / (t["distance"] + 0.01)
    capped = lambda t: F.least(raw(t), cap * F.col("raw_sum"))
    name = lambda t: label("%s (%s): %sFP", t["comp_entity"].cast("string"), (t["comp_season"] + 1).cast("string"), F.round(t["next_value"], 0).cast("bigint").cast("string"))
    return near.withColumn("raw_sum", fold(raw)).select(
        *key,
        rounded(fold(lambda t: capped(t) * t["next_value"]) / fold(capped), digits).alias("comparable"),
        F.size("near").alias("n_comps"),
        F.array_join(F.transform("near", name), ", ").alias("names"),
        "compared",
    )


def blended(rows: DataFrame, *, model: str, comparable: str, career_year: str, weights: dict[int, float], digits: int | None = 1) -> DataFrame:
    """Adds blended: w x comparable + (1 - w) x model by career year; the model alone without a weight or comparable."""
    w = F.lit(None).cast("double")
    for year, weight in weights.items():
        w = F.when(F.col(career_year) == year, F.lit(float(weight))).otherwise(w)
    mix = w * F.col(comparable) + (1 - w) * F.col(model)
    return rows.withColumn("blended", rounded(F.coalesce(mix, F.col(model)), digits))


def final_ranks(rows: DataFrame, *, value: str, tie: list[str], segment: str) -> DataFrame:
    """Adds segment_place and overall_place, 1 for the highest value, nulls last."""
    within = numbered(rows, value=value, tie=tie, within=[segment], ascending=False, name="segment_place")
    return numbered(within, value=value, tie=tie, ascending=False, name="overall_place")
