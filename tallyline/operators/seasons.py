"""Season roll-ups, year-over-year pairs and trends of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import mean, rounded, safe_div, std_samp, total0


def season_rollup(facts: DataFrame, *, keys: list[str], measures: list[str], thresholds: dict[str, list[float]] | None = None, digits: int | None = 3) -> DataFrame:
    """One row per key: n, then sum (0 if none), mean, sample deviation, max and median of each measure, and for each
    threshold the count of rows at or above it and their share. Rows with a null key are dropped."""
    out = [F.count("*").alias("n")]
    for m in measures:
        out += [total0(m).alias(f"{m}_sum"), mean(m).alias(f"{m}_mean"), std_samp(m).alias(f"{m}_std"), F.max(m).alias(f"{m}_max"), F.round(F.median(m), 4).alias(f"{m}_median")]
        out += [F.count_if(F.col(m) >= t).alias(f"{m}_at_{t:g}") for t in (thresholds or {}).get(m, [])]
    rolled = facts.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(*out)
    for m, ts in (thresholds or {}).items():
        for t in ts:
            rolled = rolled.withColumn(f"{m}_rate_{t:g}", rounded(F.coalesce(safe_div(f"{m}_at_{t:g}", "n"), F.lit(0.0)), digits))
    return rolled


def derived_rates(rolled: DataFrame, *, rates: dict[str, tuple[str, str]], games: str, per_game: list[str] = ()) -> DataFrame:
    """Adds each rate (name: dividend, divisor) and <total>_per_game; null where the divisor is 0."""
    found = {name: safe_div(a, b) for name, (a, b) in rates.items()} | {f"{t}_per_game": safe_div(t, games) for t in per_game}
    return rolled.withColumns(found)


def primary_category(facts: DataFrame, *, keys: list[str], category: str) -> DataFrame:
    """The category with the most rows for each key; of equally frequent ones the first in order."""
    counted = facts.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count("*").alias("n_rows"))
    best = F.min_by(category, F.struct(-F.col("n_rows"), F.col(category)))
    return counted.groupBy(*keys).agg(best.alias(category), F.max("n_rows").alias("n_rows"))


def full_season(rolled: DataFrame, *, totals: list[str], games: str, season_games: int, digits: int | None = 1) -> DataFrame:
    """Adds <total>_full: the total carried on to a full season, total x season_games / max(games, 1)."""
    return rolled.withColumns({f"{t}_full": rounded(F.col(t) * float(season_games) / F.greatest(F.col(games), F.lit(1)), digits) for t in totals})


def career(rolled: DataFrame, *, entity: list[str], season: str, cumulative: bool = True) -> DataFrame:
    """Adds first_season, career_year (season - first + 1) and seasons_seen: up to the row's season, or of all time
    where not ``cumulative``. Expects a row per entity and season."""
    every = Window.partitionBy(*entity)
    so_far = every.orderBy(season).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(season).over(every)
    return rolled.withColumns({"first_season": first, "career_year": F.col(season) - first + 1, "seasons_seen": F.count("*").over(so_far if cumulative else every)})


def yoy_pairs(rolled: DataFrame, *, entity: list[str], season: str, games: str, target: str, least_games: int = 8, short_games: int = 14, season_games: int = 17, digits: int | None = 1) -> DataFrame:
    """Rows of season N with next_games, next_<target> and adjusted_target of season N+1. Both seasons need
    ``least_games``; a next season under ``short_games`` is carried on to a full one."""
    w = Window.partitionBy(*entity).orderBy(season)
    follows = F.lead(season).over(w) == F.col(season) + 1
    paired = rolled.withColumns({"next_games": F.when(follows, F.lead(games).over(w)), f"next_{target}": F.when(follows, F.lead(target).over(w))})
    paired = paired.where((F.col(games) >= least_games) & (F.col("next_games") >= least_games))
    carried = rounded(F.col(f"next_{target}") * float(season_games) / F.col("next_games"), digits)
    return paired.withColumn("adjusted_target", F.when(F.col("next_games") < short_games, carried).otherwise(F.col(f"next_{target}")))


def yoy_trend(rolled: DataFrame, *, entity: list[str], season: str, measures: list[str]) -> DataFrame:
    """Adds <m>_trend: the measure less that of the season before; 0 where there is none."""
    w = Window.partitionBy(*entity).orderBy(season)
    follows = F.lag(season).over(w) == F.col(season) - 1
    return rolled.withColumns({f"{m}_trend": F.coalesce(F.when(follows, F.col(m) - F.lag(m).over(w)), F.lit(0.0)) for m in measures})


def weighted_profile(rolled: DataFrame, *, keys: list[str], season: str, seasons: list[int], measures: list[str], games: str) -> DataFrame:
    """Games-weighted mean of each measure over the given seasons; null measures count as 0, games as 1 at least."""
    w = F.greatest(F.coalesce(F.col(games), F.lit(0)), F.lit(1))
    weighted = [safe_div(total0(F.coalesce(F.col(m), F.lit(0.0)) * w), F.sum(w)).alias(m) for m in measures]
    return rolled.where(F.col(season).isin(seasons)).groupBy(*keys).agg(*weighted)


def combine_shares(left: DataFrame, right: DataFrame, *, keys: list[str], left_measure: str, right_measure: str) -> DataFrame:
    """Left join with the right measure filled with 0, and share = left / (left + right + 1e-6)."""
    one = right.groupBy(*keys).agg(total0(right_measure).alias(right_measure))  # keys of the right side made unique
    joined = left.join(one, keys, "left").withColumn(right_measure, F.coalesce(right_measure, F.lit(0.0)))
    return joined.withColumn("share", F.col(left_measure) / (F.col(left_measure) + F.col(right_measure) + F.lit(1e-6)))


def continuity(facts: DataFrame, *, unit: str, season: str, holder: str, first: int, second: int) -> DataFrame:
    """(unit, before, after, same): whether the holder is the same in both seasons; an unknown one counts as changed."""
    sides = facts.groupBy(unit).agg(*[F.max(F.when(F.col(season) == s, F.col(holder))).alias(n) for n, s in (("before", first), ("after", second))])
    return sides.withColumn("same", F.coalesce(F.col("before") == F.col("after"), F.lit(False)).cast("int"))


def next_season_input(rolled: DataFrame, *, season: str, year: int, games: str, least_games: int = 6) -> DataFrame:
    """Rows of one season with enough games to be projected."""
    return rolled.where((F.col(season) == year) & (F.col(games) >= least_games))
