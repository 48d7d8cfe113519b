"""Optimal weekly lineups of rosters, marginal values of candidates, standings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.stats import measure, measure_type, rounded, std_pop, total

#: Starters by position, and the positions that may fill the one flexible place.
LINEUP = {"QB": 1, "RB": 2, "WR": 3, "TE": 1}
FLEX = ("RB", "WR", "TE")


def weekly_points(rosters: DataFrame, projections: DataFrame, *, roster: list[str], weeks: int) -> DataFrame:
    """roster..., entity, position, week, points for weeks 1..``weeks`` without bye weeks.

    ``projections``: entity, position, week, points, base, bye; the weekly value counts, else the base. Roster rows of
    unknown entities are left out; an entity held twice counts twice.
    """
    seats = rosters.withColumn("seat", F.row_number().over(Window.partitionBy(*roster, "entity").orderBy("entity")))
    known = projections.groupBy("entity").agg(F.min("position").alias("position"), F.max("base").alias("base"), F.max("bye").alias("bye"))
    every = seats.join(known, "entity").withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(weeks)))).where(F.coalesce(F.col("bye") != F.col("week"), F.lit(True)))
    values = projections.groupBy("entity", "week").agg(F.max("points").alias("points"))
    met = every.join(values, ["entity", "week"], "left")
    return met.select(*roster, "entity", "seat", "position", "week", F.coalesce("points", "base").alias("points"))


def _places(starters: dict[str, int], flex: tuple[str, ...]) -> dict[str, int]:
    """Starting places by position, 0 for those that can only fill the flexible one."""
    return starters | {p: 0 for p in flex if p not in starters}


def _sorted_points(positions: Iterable[str]) -> list[Column]:
    """of_<position>: the points of a group's entities there, high to low."""
    return [F.reverse(F.array_sort(F.collect_list(F.when(F.col("position") == p, measure("points"))))).alias(f"of_{p}") for p in positions]


def _sorted_weeks(points: DataFrame, *, roster: list[str], starters: dict[str, int], flex: tuple[str, ...]) -> DataFrame:
    """roster..., week, of_<position>: the points that can count in a week's score, a position's starters and the best after them, high
    to low. The others of a position are dropped before and after they are exchanged, so a group is as long as a lineup."""
    positions = _places(starters, flex)
    order = Window.partitionBy(*roster, "week", "position").orderBy(measure("points").desc_nulls_last())
    best = points.withColumn("__no", F.row_number().over(order)).where(F.col("__no") <= max(positions.values()) + 1)
    return best.groupBy(*roster, "week").agg(*_sorted_points(positions))


def lineup_weeks(points: DataFrame, *, roster: list[str], starters: dict[str, int] | None = None, flex: tuple[str, ...] = FLEX) -> DataFrame:
    """roster..., week, week_points: the best starters of each position and the best other for the flexible place."""
    starters = starters or LINEUP
    positions = _places(starters, flex)
    held = _sorted_weeks(points, roster=roster, starters=starters, flex=flex)
    return held.select(*roster, "week", _score({p: F.col(f"of_{p}") for p in positions}, starters, flex).alias("week_points"))


def lineup_scores(rosters: DataFrame, projections: DataFrame, *, roster: list[str], weeks: int = 14, starters: dict[str, int] | None = None, flex: tuple[str, ...] = FLEX, digits: int | None = 1) -> DataFrame:
    """roster..., score: the sum of all weeks; 0 for rosters without an active entity."""
    found = lineup_weeks(weekly_points(rosters, projections, roster=roster, weeks=weeks), roster=roster, starters=starters, flex=flex)
    sums = found.groupBy(*roster).agg(total("week_points").alias("score"))
    return rosters.select(*roster).distinct().join(sums, roster, "left").select(*roster, rounded(F.coalesce("score", F.lit(0.0)), digits).alias("score"))


def _score(by_position: dict[str, Column], starters: dict[str, int], flex: tuple[str, ...]) -> Column:
    """Score of a week from sorted arrays (high to low) of points by position."""
    zero, kind = F.lit(0).cast(measure_type()), measure_type(28)

    def added(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))

    out = F.lit(0).cast(kind)
    rest = []
    for position, n in _places(starters, flex).items():
        out = out + added(F.slice(by_position[position], 1, n))
        if position in flex:
            rest.append(F.coalesce(F.try_element_at(by_position[position], F.lit(n + 1)), zero))
    return (out + (F.greatest(*rest) if len(rest) > 1 else rest[0] if rest else zero)).cast("double")


def marginal_values(rosters: DataFrame, candidates: DataFrame, projections: DataFrame, *, roster: str, weeks: int = 14, starters: dict[str, int] | None = None, flex: tuple[str, ...] = FLEX, least_spread: float = 2.0, weak_weeks: int = 5, digits: int | None = 1) -> DataFrame:
    """roster, entity, gain, weak_gain: what each candidate adds to the roster's score, over all weeks and over its weak
    weeks; only gains above 0.

    ``candidates``: roster, entity (available to that roster). Weak weeks: of the weeks with points and without a
    rostered bye, the lowest ``weak_weeks`` (ties by week), if their deviation reaches ``least_spread``. A roster's week
    is one row of sorted arrays by position, each as long as can count with one more; a candidate is inserted into its array and the week
    scored again, so the roster's rows are never repeated for a candidate.
    """
    starters = starters or LINEUP
    mine = weekly_points(rosters, projections, roster=[roster], weeks=weeks)
    positions = _places(starters, flex)
    held = _sorted_weeks(mine, roster=[roster], starters=starters, flex=flex)
    every = rosters.select(roster).unionByName(candidates.select(roster)).distinct()  # also rosters without an entity yet
    frame = every.withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
    empty = F.array().cast(f"array<{measure_type()}>")
    base = frame.join(held, [roster, "week"], "left").select(roster, "week", *[F.coalesce(f"of_{p}", empty).alias(f"of_{p}") for p in positions])
    base = cut(base.withColumn("now", _score({p: F.col(f"of_{p}") for p in positions}, starters, flex)))  # read twice
    byes = rosters.join(projections.groupBy("entity").agg(F.max("bye").alias("week")), "entity").where("week IS NOT NULL").select(roster, F.col("week").cast("int").alias("week"), F.lit(True).alias("is_bye")).distinct()
    usable = base.select(roster, "week", "now").join(byes, [roster, "week"], "left").where("is_bye IS NULL AND now > 0")
    low = usable.withColumns({"spread": std_pop("now", Window.partitionBy(roster)), "place": F.row_number().over(Window.partitionBy(roster).orderBy("now", "week"))})
    weak = low.where((F.col("spread") >= least_spread) & (F.col("place") <= weak_weeks)).select(roster, "week", F.lit(1).alias("weak"))
    base = base.join(weak, [roster, "week"], "left")
    theirs = weekly_points(candidates, projections, roster=[roster], weeks=weeks).select(roster, "week", "entity", "position", measure("points").alias("points"))
    tried = theirs.join(base, [roster, "week"])
    with_it = {p: F.when(F.col("position") == p, F.reverse(F.array_sort(F.array_append(F.col(f"of_{p}"), F.col("points"))))).otherwise(F.col(f"of_{p}")) for p in positions}
    tried = tried.withColumn("then", _score(with_it, starters, flex))
    change = measure(F.col("then") - F.col("now"))
    weak_change = measure(F.round("then", 1) - F.round("now", 1))
    gains = tried.groupBy(roster, "entity").agg(F.sum(change).cast("double").alias("gain"), F.coalesce(F.sum(F.when(F.col("weak") == 1, weak_change)).cast("double"), F.lit(0.0)).alias("weak_gain"))
    return gains.withColumns({"gain": rounded(F.col("gain"), digits), "weak_gain": rounded(F.col("weak_gain"), digits)}).where("gain > 0")


def raw_value_rank(candidates: DataFrame, projections: DataFrame, *, weeks: int = 14, per_position: int = 2, top: int = 5) -> DataFrame:
    """Fallback: candidates by their own points over the weeks, at most ``per_position`` of a position, ``top`` in all."""
    sums = weekly_points(candidates, projections, roster=["roster"], weeks=weeks).groupBy("roster", "entity", "position").agg(total("points").alias("value"))
    capped = top_of_each(sums, within=["roster", "position"], value="value", tie="entity", n=per_position)
    return top_of_each(capped.drop("place"), within=["roster"], value="value", tie="entity", n=top)


def top_of_each(df: DataFrame, *, within: list[str], value: str, tie: str, n: int) -> DataFrame:
    """The n rows with the highest value in each group, with their place."""
    w = Window.partitionBy(*within).orderBy(F.col(value).desc_nulls_last(), tie)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def standings(scores: DataFrame, *, league: str, roster: str, score: str = "score") -> DataFrame:
    """Adds place, behind_best, over_mean and a grade by the place's share of the league: A to 20 %, B to 40 %, C to 60 %,
    D to 80 %, else F."""
    every = Window.partitionBy(league)
    place = F.row_number().over(every.orderBy(F.col(score).desc(), roster))
    n = F.count("*").over(every)
    out = scores.withColumns({"place": place, "n_rosters": n, "behind_best": F.max(score).over(every) - F.col(score), "over_mean": F.col(score) - total(score, every) / n})
    share = F.col("place") / F.col("n_rosters")
    return out.withColumn("grade", F.when(share <= 0.2, "A").when(share <= 0.4, "B").when(share <= 0.6, "C").when(share <= 0.8, "D").otherwise("F"))


def week_status(points: DataFrame, rosters: DataFrame, projections: DataFrame, *, roster: list[str], least_spread: float = 2.0, weak_weeks: int = 5, digits: int | None = 1) -> DataFrame:
    """roster..., week, week_points, status of lineup weeks: 'weak' (the lowest ``weak_weeks`` with points and without a
    rostered bye, if the deviation of such weeks reaches ``least_spread``), else 'bye' where a rostered entity has one."""
    byes = rosters.join(projections.groupBy("entity").agg(F.max("bye").alias("week")), "entity").where("week IS NOT NULL").select(*roster, F.col("week").cast("int").alias("week"), F.lit(True).alias("is_bye")).distinct()
    flagged = points.join(byes, [*roster, "week"], "left")
    usable = F.col("is_bye").isNull() & (F.col("week_points") > 0)
    every = Window.partitionBy(*roster)
    told = flagged.withColumns({"spread": std_pop(F.when(usable, F.col("week_points")), every), "place": F.row_number().over(every.orderBy(usable.desc(), "week_points", "week"))})
    weak = usable & (F.col("spread") >= least_spread) & (F.col("place") <= weak_weeks)
    return told.select(*roster, "week", rounded(F.col("week_points"), digits).alias("week_points"), F.when(weak, "weak").when(F.col("is_bye"), "bye").otherwise("").alias("status"))


def week_table(projection: DataFrame, *, weeks: list[int], key: list[str]) -> DataFrame:
    """One column for each week; a week without a value stays null (a bye)."""
    return projection.groupBy(*key).pivot("week", weeks).agg(F.max("points")).select(*key, *[F.col(str(w)).alias(f"w{w}") for w in weeks])
