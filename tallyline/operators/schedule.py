"""Schedules as edge lists: both directions, gaps, opponents' ranks, strength and complements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.stats import mean, rounded, safe_div
from .ranks import numbered


def both_directions(games: DataFrame, *, home: str, away: str, keep: list[str], swapped: dict[str, str] | None = None, drop_open: bool = False) -> DataFrame:
    """(unit, opponent, is_home, keep..., swapped...) with two rows per game, in one scan. ``swapped`` maps a column of the
    home side to that of the away side: each row carries the opponent's, under the home column's name."""
    swapped = swapped or {}

    def side(mine: str, other: str, is_home: int, others: list[str]) -> Column:
        return F.struct(F.col(mine).alias("unit"), F.col(other).alias("opponent"), F.lit(is_home).alias("is_home"), *[F.col(o).alias(f"opponent_{h}") for h, o in zip(swapped, others, strict=True)])

    sides = F.array(side(home, away, 1, list(swapped.values())), side(away, home, 0, list(swapped)))
    out = games.select(*keep, F.inline(sides))
    return out.where("unit IS NOT NULL AND opponent IS NOT NULL") if drop_open else out.where("unit IS NOT NULL")


def first_gap(facts: DataFrame, *, unit: str, week: str, last: int, first: int = 1) -> DataFrame:
    """(unit, gap): the first week of first..last without a row; null where there is none. A set of weeks per unit only."""
    weeks = F.array_except(F.sequence(F.lit(first), F.lit(last)), F.collect_set(F.col(week).cast("int")))
    return facts.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.array_min(weeks).alias("gap"))


def matchup_factor(schedule: DataFrame, allowed: DataFrame, *, segment: str, measure: str, last_week: int, week: str = "week") -> DataFrame:
    """(unit, segment, week, factor): what the opponent allows in the segment over the mean of all, 1.0 where unknown.
    ``allowed`` has opponent, segment and measure, a row per pair."""
    league = allowed.groupBy(segment).agg(mean(measure).alias("league"))
    segments = schedule.where(F.col(week) <= last_week).crossJoin(F.broadcast(league))  # one row for each of the few segments
    joined = segments.join(allowed.select("opponent", segment, F.col(measure).alias("allowed")), ["opponent", segment], "left")
    return joined.select("unit", segment, week, F.coalesce(safe_div("allowed", "league"), F.lit(1.0)).alias("factor"))


def rank_matrix(edges: DataFrame, ranks: DataFrame, *, segment: str) -> DataFrame:
    """unit, segment, week, opponent, opponent_rank: ``edges`` (unit, opponent, week) with what ``ranks`` (unit, segment, place)
    has of the opponent, for each of its segments; games against an opponent without a rank are left out."""
    theirs = ranks.select(F.col("unit").alias("opponent"), segment, F.col("place").alias("opponent_rank"))
    return edges.join(theirs, "opponent").select("unit", segment, "week", "opponent", "opponent_rank")


def schedule_view(entities: DataFrame, edges: DataFrame, ranks: DataFrame, *, segment: str, playoff: tuple[int, int]) -> DataFrame:
    """entity, week, opponent, opponent_points, opponent_rank, over_league, is_playoff: the games of an entity's unit with
    what the opponent allows in the entity's segment, its rank there and the difference to the league's mean; null where
    ``ranks`` (unit, segment, points, place) does not know the opponent."""
    league = ranks.groupBy(segment).agg(mean("points").alias("league"))
    theirs = ranks.join(F.broadcast(league), segment).select(  # a row for each of a few segments
        F.col("unit").alias("opponent"), segment, F.col("points").alias("opponent_points"), F.col("place").alias("opponent_rank"), (F.col("points") - F.col("league")).alias("over_league")
    )
    games = entities.join(edges.select("unit", "opponent", "week"), "unit").join(theirs, ["opponent", segment], "left")
    return games.select("entity", "week", "opponent", "opponent_points", "opponent_rank", "over_league", F.col("week").between(*playoff).alias("is_playoff"))


def strength_summary(ranked_schedule: DataFrame, *, unit: list[str], week: str, rank: str, playoff: tuple[int, int], easy: int, tough: int, digits: int | None = 1) -> DataFrame:
    """Mean opponent rank of the season and of the playoff weeks, and counts of easy (>=) and tough (<=) opponents."""
    late = F.when(F.col(week).between(*playoff), F.col(rank))
    return ranked_schedule.groupBy(*unit).agg(
        F.count(rank).alias("games"), rounded(mean(rank), digits).alias("season_mean"), rounded(mean(late), digits).alias("playoff_mean"),
        F.count_if(F.col(rank) >= easy).alias("easy_games"), F.count_if(F.col(rank) <= tough).alias("tough_games"),
    )


def grade_of(difference: Column, band: float) -> Column:
    """'easy' above the band, 'tough' below it, else 'average'."""
    return F.when(difference > band, "easy").when(difference < -band, "tough").otherwise("average")


#: Places of a week's list that the first round of ``complements`` takes; each further round goes GROWTH times as deep.
FIRST_PLACES = 64
GROWTH = 4


def complements(ranks: DataFrame, *, unit: str, week: str, rank: str, tough: int, easy: int, top: int, weight: int = 3) -> DataFrame:
    """For each unit the ``top`` others by mean rank in its tough weeks (rank <= tough) + weight x easy weeks there
    (rank >= easy), weeks without a row left out: unit, other, tough_weeks, mean_rank, easy_weeks, score, place, looked_at (how
    many others were scored for the unit). Expects one row of a unit and week at most; null ranks are left out.

    A threshold search over the weeks' lists, sorted from the highest rank down. A round reads the next places of the lists of
    a unit's tough weeks, by equality on week and place, and scores who stands there by all their weeks. Whoever was not met has at
    most the rank at which each list stands, so at most the largest of these + weight x those that are easy: where the
    ``top``-th score is above that, the unit is done. The others go on deeper, until the lists end.
    """
    rows = cut(ranks.where(F.col(rank).isNotNull()).select(F.col(unit).alias("other"), F.col(week).alias("week"), F.col(rank).alias("rank")))
    lists = cut(numbered(rows, value="rank", tie=["other"], within=["week"], ascending=False, name="at"))
    weeks_of = cut(rows.groupBy("other").agg(F.map_from_entries(F.collect_list(F.struct("week", "rank"))).alias("ranks")))  # a season's weeks
    kind = dict(rows.dtypes)["other"]
    none = F.array().cast(f"array<struct<low:double,other:{kind},tough_weeks:bigint,mean_rank:double,easy_weeks:bigint>>")
    hard = F.map_keys(F.map_filter("ranks", lambda w, r: r <= tough))
    pending = cut(weeks_of.select(F.col("other").alias("unit"), hard.alias("weeks"), none.alias("best"), F.lit(0).cast("bigint").alias("looked_at")).where("size(weeks) > 0"))

    done, depth, to = [], 0, FIRST_PLACES
    while True:
        places = F.explode(F.sequence(F.lit(depth + 1), F.lit(to)))
        asked = pending.select("unit", "weeks", F.explode("weeks").alias("week")).select("*", places.alias("at"))
        met = asked.join(lists.select("week", "at", "other"), ["week", "at"]).where("other != unit").groupBy("unit", "other").agg(F.first("weeks").alias("weeks"))
        there = F.filter(F.transform("weeks", lambda w: F.try_element_at("ranks", w)), lambda r: r.isNotNull())
        scored = met.join(weeks_of, "other").withColumn("there", there)
        counted = F.size("there").cast("bigint")
        average = F.aggregate("there", F.lit(0.0), lambda a, r: a + r) / counted
        scored = scored.select("unit", "other", counted.alias("tough_weeks"), average.alias("mean_rank"), F.size(F.filter("there", lambda r: r >= easy)).cast("bigint").alias("easy_weeks"))
        scored = scored.withColumn("low", -(F.col("mean_rank") + weight * F.col("easy_weeks")))
        first = scored.withColumn("no", F.row_number().over(Window.partitionBy("unit").orderBy("low", "other"))).withColumn("n", F.count("*").over(Window.partitionBy("unit")))
        first = first.where(F.col("no") <= top).groupBy("unit").agg(F.collect_list(F.struct("low", "other", "tough_weeks", "mean_rank", "easy_weeks")).alias("new"), F.first("n").alias("n"))
        stands = pending.select("unit", F.explode("weeks").alias("week")).join(lists.where(F.col("at") == to).select("week", "rank"), "week")
        bound = stands.groupBy("unit").agg((F.max("rank") + weight * F.count_if(F.col("rank") >= easy)).alias("bound"))
        best = F.slice(F.array_sort(F.array_distinct(F.concat("best", F.coalesce("new", none)))), 1, top)
        after = pending.join(first, "unit", "left").join(bound, "unit", "left").select("unit", "weeks", best.alias("best"), (F.col("looked_at") + F.coalesce("n", F.lit(0))).alias("looked_at"), "bound")
        after = cut(after.withColumn("ends", F.col("bound").isNull() | F.coalesce(-F.get("best", F.lit(top - 1))["low"] > F.col("bound"), F.lit(False))))
        done.append(after.where("ends").select("unit", "looked_at", "best"))
        pending = after.where("NOT ends").drop("bound", "ends")
        if pending.isEmpty():
            break
        depth, to = to, to * GROWTH
    found = reduce(DataFrame.unionByName, done).select("unit", "looked_at", F.posexplode("best").alias("no", "b"))
    return found.select("unit", "b.other", "b.tough_weeks", "b.mean_rank", "b.easy_weeks", (F.col("b.mean_rank") + weight * F.col("b.easy_weeks")).alias("score"), (F.col("no") + 1).alias("place"), "looked_at")


def week_bits(weeks: Column) -> Column:
    """Bitmap of weeks 0 to 62; others raise."""
    bit = F.when(weeks.between(0, 62), F.call_function("shiftleft", F.lit(1).cast("bigint"), weeks.cast("int"))).when(weeks.isNotNull(), F.raise_error(F.lit("weeks go from 0 to 62")).cast("bigint"))
    return F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint"))


def best_pairing(candidates: DataFrame, roster: DataFrame, ranks: DataFrame, *, unit: str, week: str, rank: str, tough: int, easy: int) -> DataFrame:
    """For each candidate of a roster the rostered unit whose tough weeks it covers best: easy weeks there, then more
    tough weeks, then roster order. ``candidates``: roster, candidate; ``roster``: roster, unit, seat. A week without a
    row of the candidate counts 0; units without tough weeks are left out. Weeks go from 0 to 62.

    A unit's tough weeks and a candidate's easy ones are bitmaps, a roster is one row of its units' bitmaps, and a candidate
    meets that row once; nothing is made for a pair of units or a week.
    """
    bits = cut(ranks.groupBy(F.col(unit).alias("u")).agg(week_bits(F.when(F.col(rank) <= tough, F.col(week))).alias("hard"), week_bits(F.when(F.col(rank) >= easy, F.col(week))).alias("soft")))
    held = roster.join(bits.where("hard != 0"), F.col("unit") == F.col("u")).groupBy("roster").agg(F.collect_list(F.struct("unit", "seat", "hard")).alias("units"))
    met = candidates.join(held, "roster").join(bits.select("u", "soft"), F.col("candidate") == F.col("u"), "left")
    soft = F.coalesce("soft", F.lit(0).cast("bigint"))
    weighed = F.transform("units", lambda x: F.struct((-F.bit_count(soft.bitwiseAND(x["hard"]))).alias("low"), (-F.bit_count(x["hard"])).alias("few"), x["seat"].alias("seat"), x["unit"].alias("unit")))
    best = met.select("roster", "candidate", F.array_min(weighed).alias("best"))
    return best.select("roster", "candidate", "best.unit", (-F.col("best.few")).cast("bigint").alias("tough_weeks"), (-F.col("best.low")).cast("bigint").alias("easy_weeks"))


def conflicts(schedule: DataFrame, mine: DataFrame, available: DataFrame, *, week: str, weeks: tuple[int, int]) -> DataFrame:
    """Available entities whose unit faces one of mine in the given weeks: entity, and the meetings as text."""
    games = schedule.where(F.col(week).between(*weeks)).join(mine.select(F.col("unit").alias("opponent")).distinct(), "opponent", "left_semi")
    met = available.join(games, "unit")
    text = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.col(week), F.col("opponent")))), lambda s: F.format_string("W%s vs %s", s[week].cast("string"), s["opponent"].cast("string"))), ", ")
    return met.groupBy("entity").agg(text.alias("meetings"))


def opponents_best(schedule: DataFrame, entities: DataFrame, *, entity: str, rank: str, week: str, weeks: tuple[int, int], top: int = 4) -> DataFrame:
    """unit, week, opponent, place, entity, rank: the ``top`` entities of each unit's opponents in the given weeks, by rank (nulls
    last), then entity; opponents without entities give nothing. ``entities``: entity, unit, rank. Spark keeps ``top`` of a unit
    in each task before it exchanges them, and the games meet them as one short array."""
    best = entities.withColumn("place", F.row_number().over(Window.partitionBy("unit").orderBy(F.col(rank).asc_nulls_last(), entity))).where(F.col("place") <= top)
    lists = best.groupBy(F.col("unit").alias("opponent")).agg(F.array_sort(F.collect_list(F.struct("place", entity, rank))).alias("best"))
    games = schedule.where(F.col(week).between(*weeks)).select("unit", "opponent", week).distinct()
    return games.join(lists, "opponent").select("unit", week, "opponent", F.inline("best"))
