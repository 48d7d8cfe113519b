"""Scheme and manual adjustments: rules as tables, combined by compounding, applied and ranked anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import measure, notes, rounded
from .matchup import ratio_multiplier
from .ranks import rank_min


def scheme_adjustments(entities: DataFrame, rules: DataFrame, profiles: DataFrame, *, measures: tuple[str, str]) -> DataFrame:
    """entity, segment, label, scheme: a rule's multiplier less 1, times the entity's weight.

    ``rules``: label, unit, from_profile, to_profile, translation, is_move, weights map<entity, weight>. ``profiles``:
    profile, segment and two measures (a rate and points). A move compares the other way round. An entity's weight is 1
    where the rule names none.
    """
    rate, points = measures
    side = {n: profiles.select(F.col("profile").alias(f"{n}_profile"), "segment", F.col(rate).alias(f"{n}_rate"), F.col(points).alias(f"{n}_points")) for n in ("from", "to")}
    hit = entities.join(rules, "unit").join(side["from"], ["from_profile", "segment"], "left").join(side["to"], ["to_profile", "segment"], "left")
    fro, to = [[F.when(F.col("is_move"), F.col(f"{b}_{m}")).otherwise(F.col(f"{a}_{m}")) for m in ("rate", "points")] for a, b in (("from", "to"), ("to", "from"))]
    multiplier = ratio_multiplier(to[0], fro[0], to[1], fro[1], translation=F.col("translation"))
    weight = F.coalesce(F.try_element_at("weights", F.col("entity").cast("string")), F.lit(1.0))
    return hit.select("entity", "segment", "label", ((multiplier - 1) * weight).alias("scheme"))


def combine_adjustments(schemes: DataFrame, manual: DataFrame, *, keys: list[str], digits: int | None = 4) -> DataFrame:
    """Sum of schemes s and manual m by key: total = (1 + s)(1 + m) - 1, and a note of what applied."""
    s = schemes.groupBy(*keys).agg(F.sum(measure("scheme", places=6)).cast("double").alias("scheme"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
    m = manual.groupBy(*keys).agg(F.max("pct").alias("manual"), F.max("reason").alias("reason"))
    both = s.join(m, keys, "full_outer").withColumns({"scheme": F.coalesce("scheme", F.lit(0.0)), "manual": F.coalesce("manual", F.lit(0.0))})
    said = F.when(F.col("reason").isNotNull(), F.concat(F.lit("Manual: "), F.col("reason")))
    return both.select(*keys, "scheme", "manual", rounded((1 + F.col("scheme")) * (1 + F.col("manual")) - 1, digits).alias("total"), notes(F.when(F.col("labels") != "", F.concat(F.lit("Scheme: "), F.col("labels"))), said).alias("note"))


def apply_adjustments(projections: DataFrame, adjustments: DataFrame, *, keys: list[str], value: str, segment: str, updates: DataFrame | None = None, digits: int | None = 1) -> DataFrame:
    """Adds adjusted (value x (1 + total)) and its ranks in the segment and overall (ties share the smallest); ``updates``
    (keys, new_unit) replaces the unit. Without an adjustment the value stays."""
    out = projections.join(adjustments.select(*keys, "total"), keys, "left").withColumn("adjusted", rounded(F.col(value) * (1 + F.coalesce("total", F.lit(0.0))), digits))
    if updates is not None:
        out = out.join(updates.select(*keys, "new_unit"), keys, "left").withColumn("unit", F.coalesce("new_unit", "unit")).drop("new_unit")
    return rank_min(rank_min(out, value="adjusted", within=[segment], name="segment_rank"), value="adjusted", name="overall_rank")


def resolve_segments(asked: DataFrame, history: DataFrame, *, entity: str, unit: str, segment: str, season: str, default: str = "WR") -> DataFrame:
    """``asked`` (entity, unit) with the segment in which the history (entity, unit, season, segment) last has the entity:
    at that unit, else at any unit, else ``default``. Of a season's several segments the first in order."""
    latest = F.min_by(segment, F.struct(-F.col(season), F.col(segment)))
    here = history.groupBy(entity, unit).agg(latest.alias("here"))
    anywhere = history.groupBy(entity).agg(latest.alias("anywhere"))
    return asked.join(here, [entity, unit], "left").join(anywhere, entity, "left").withColumn(segment, F.coalesce("here", "anywhere", F.lit(default))).drop("here", "anywhere")


def scheme_profiles(history: DataFrame, wanted: DataFrame, *, unit: str, segment: str, season: str, measures: list[str], games: str) -> DataFrame:
    """Games-weighted means of the measures for each of ``wanted`` (profile, unit, seasons array, segment): a rule's own list of
    seasons, met by an equi-join on unit, season and segment. Null measures count as 0, games as 1 at least."""
    years = wanted.select("profile", unit, segment, F.explode("seasons").alias(season)).distinct()
    w = F.greatest(F.coalesce(F.col(games), F.lit(0)), F.lit(1))
    means = [(F.sum(measure(F.coalesce(F.col(m), F.lit(0.0)) * w)).cast("double") / F.sum(w)).alias(m) for m in measures]
    return years.join(history, [unit, segment, season]).groupBy("profile", unit, segment).agg(*means)


def resolve_as_of(asked: DataFrame, history: DataFrame, *, entity: str, unit: str, segment: str, season: str, default: str = "WR") -> DataFrame:
    """``asked`` (entity, unit, as_of and further columns) with the segment in which the history (entity, unit, season, segment)
    last has the entity by season ``as_of``: at that unit, else at any unit, else ``default``. A null ``as_of`` asks for the latest of all."""
    past = history.select(F.col(entity).alias("__e"), F.col(unit).alias("__u"), F.col(season).alias("__s"), F.col(segment).alias("__g"))
    met = asked.join(past, (F.col(entity) == F.col("__e")) & (F.col("as_of").isNull() | (F.col("__s") <= F.col("as_of"))), "left")
    order = F.struct(~F.col("__u").eqNullSafe(F.col(unit)), -F.col("__s"), F.col("__g"))
    best = F.min_by("__g", F.when(F.col("__s").isNotNull(), order))
    return met.groupBy(*asked.columns).agg(F.coalesce(best, F.lit(default)).alias(segment))


def rule_adjustments(rules: DataFrame, weights: DataFrame, history: DataFrame, *, entity: str, unit: str, segment: str, season: str, measures: tuple[str, str], games: str, digits: int | None = 4) -> DataFrame:
    """label, entity, segment, unit, scheme: the whole way from rules to adjustments.

    ``rules``: label, from_unit, from_years, to_unit, prior_years (arrays of seasons), translation, is_move, as_of. ``weights``:
    label, entity, weight; those above 0 take part. ``history``: entity, unit, season, segment, two measures (a rate and points), games.
    An entity's segment is resolved as of the rule's season, at the unit it comes from where it moves itself, else at the unit
    that the coach comes to. Profiles of both units over their own lists of seasons are compared there: the new unit's over the old one's
    for a move, else the coach's origin over his destination. An unknown profile changes nothing.
    """
    rate, points = measures
    named = weights.where(F.col("weight") > 0).select("label", entity, "weight").join(rules, "label")
    asked = named.select("label", entity, "weight", "as_of", F.when(F.col("is_move"), F.col("from_unit")).otherwise(F.col("to_unit")).alias(unit))
    resolved = resolve_as_of(asked, history, entity=entity, unit=unit, segment=segment, season=season).select("label", entity, "weight", segment)
    both = resolved.select("label", segment).distinct().join(rules, "label")
    sides = F.inline(F.array(*[F.struct(F.concat(F.lit(f"{side}:"), "label").alias("profile"), F.col(u).alias(unit), F.col(years).alias("seasons")) for side, u, years in (("from", "from_unit", "from_years"), ("to", "to_unit", "prior_years"))]))
    found = scheme_profiles(history, both.select(segment, sides), unit=unit, segment=segment, season=season, measures=[rate, points], games=games)
    side = {n: found.where(F.col("profile").startswith(f"{n}:")).select(F.expr(f"substr(profile, {len(n) + 2})").alias("label"), segment, F.col(rate).alias(f"{n}_rate"), F.col(points).alias(f"{n}_points")) for n in ("from", "to")}
    met = resolved.join(rules, "label").join(side["from"], ["label", segment], "left").join(side["to"], ["label", segment], "left")
    over, under = [[F.when(F.col("is_move"), F.col(f"{a}_{m}")).otherwise(F.col(f"{b}_{m}")) for m in ("rate", "points")] for a, b in (("to", "from"), ("from", "to"))]
    multiplier = ratio_multiplier(over[0], under[0], over[1], under[1], translation=F.col("translation"))
    return met.select("label", entity, segment, F.col("to_unit").alias(unit), rounded((multiplier - 1) * F.col("weight"), digits).alias("scheme"))
