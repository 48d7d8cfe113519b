"""Profiles of opponents: selection, smoothing over two seasons, decayed means and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import decay_weight, mean, rounded, safe_div, total
from .ranks import numbered


def select_profile(facts: DataFrame, *, unit: str, season: str, seasons: list[int], measures: list[str]) -> DataFrame:
    return facts.where(F.col(season).isin(seasons)).select(unit, season, *measures)


def smoothed(facts: DataFrame, *, unit: str, season: str, new: int, measures: list[str], alpha: float = 0.6) -> DataFrame:
    """alpha x season ``new`` + (1 - alpha) x the season before; a unit with one of the two keeps that one. Presence is
    told by the whole row; where both rows are there, a null on either side gives null. Expects a row per unit and season."""
    present = " OR ".join(f"`{m}` IS NOT NULL" for m in measures)
    sides = [facts.where((F.col(season) == s) & F.expr(present)).select(F.col(unit), *[F.col(m).alias(f"{m}_{n}") for m in measures], F.lit(True).alias(f"has_{n}")) for n, s in (("new", new), ("old", new - 1))]
    both = sides[0].join(sides[1], unit, "full_outer")
    blend = [F.when(F.col("has_new") & F.col("has_old"), F.col(f"{m}_new") * alpha + F.col(f"{m}_old") * (1 - alpha)).when(F.col("has_new"), F.col(f"{m}_new")).otherwise(F.col(f"{m}_old")).alias(m) for m in measures]
    return both.select(unit, *blend)


def decayed_mean(facts: DataFrame, *, keys: list[str], season: str, measure: str, latest: int, decay: float, lookback: int, in_latest: bool = True) -> DataFrame:
    """Mean over the last ``lookback`` seasons, weight decay ** (latest - season), null values left out; only keys of the
    latest season where ``in_latest``. Expects a row per key and season, summed in order of season."""
    return _decayed(facts, decay_weight(F.lit(latest) - F.col(season), decay, lookback), keys=keys, season=season, measure=measure, latest=latest, in_latest=in_latest)


def decayed_by_rule(facts: DataFrame, *, keys: list[str], segment: str, season: str, measure: str, latest: int, rules: dict[str, tuple[float, int]], in_latest: bool = True) -> DataFrame:
    """``decayed_mean`` with a decay and lookback for each segment, in one pass; segments without a rule are left out."""
    offset = F.lit(latest) - F.col(season)
    w = F.coalesce(*[F.when(F.col(segment) == name, decay_weight(offset, decay, lookback)) for name, (decay, lookback) in rules.items()])
    return _decayed(facts, w, keys=[*keys, segment], season=season, measure=measure, latest=latest, in_latest=in_latest)


def _decayed(facts: DataFrame, w: Column, *, keys: list[str], season: str, measure: str, latest: int, in_latest: bool) -> DataFrame:
    used = facts.where(w.isNotNull() & F.col(measure).isNotNull())
    terms = F.array_sort(F.collect_list(F.struct(F.col(season).alias("season"), w.alias("w"), F.col(measure).cast("double").alias("v"))))

    def fold(of) -> F.Column:
        return F.aggregate("terms", F.lit(0.0), lambda a, t: a + of(t))

    folded = used.groupBy(*keys).agg(terms.alias("terms"), F.max(season).alias("last_season"))
    if in_latest:
        folded = folded.where(F.col("last_season") == latest)
    return folded.select(*keys, safe_div(fold(lambda t: t["w"] * t["v"]), fold(lambda t: t["w"])).alias("decayed"))


def segment_ranks(decayed: DataFrame, weekly: DataFrame, *, unit: str, segment: str, week: str, measure: str) -> DataFrame:
    """unit, segment, points, place (1: fewest points; ties by unit): decayed means of some segments (column decayed) and, of
    others, the mean over the weeks in which ``weekly`` has the unit."""
    weeks = weekly.groupBy(unit, segment, week).agg(total(measure).alias("points")).groupBy(unit, segment).agg(mean("points").alias("points"))
    return numbered(decayed.select(unit, segment, F.col("decayed").alias("points")).unionByName(weeks), value="points", tie=[unit], within=[segment])


def strength(decayed: DataFrame, *, within: list[str], value: str = "decayed", digits: int | None = 3) -> DataFrame:
    """Adds strength: value / mean of its group."""
    w = Window.partitionBy(*within)
    return decayed.withColumn("strength", rounded(safe_div(value, mean(value, w)), digits))
