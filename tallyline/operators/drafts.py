"""Many drafts at once: picks, winners, their aggregates, snake order, needs and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import prefixed
from ..functions.shared import cut
from ..functions.stats import mean, right_closed, rounded, safe_div
from .ranks import numbered


def snake(pick: Column, teams: int) -> dict[str, Column]:
    """Round, slot and the next pick of the same slot for a pick number, counted from 1."""
    round_no = F.floor((pick - 1) / teams).cast("int") + 1
    place = F.pmod(pick - 1, F.lit(teams)).cast("int") + 1
    slot = F.when(round_no % 2 == 1, place).otherwise(teams + 1 - place)
    following = round_no + 1
    return {"round": round_no, "slot": slot, "next_pick": (following - 1) * teams + F.when(following % 2 == 1, slot).otherwise(teams + 1 - slot)}


def fingerprints(picks: DataFrame, *, draft: str, members: list[str]) -> DataFrame:
    """draft, fingerprint: SHA-256 of the draft's set of picks, whatever their order."""
    one = F.concat_ws(":", *[F.col(m).cast("string") for m in members])
    return picks.groupBy(draft).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(one)), ","), 256).alias("fingerprint"))


def first_of_each_fingerprint(marks: DataFrame, *, draft: str) -> DataFrame:
    """Adds first_draft (the smallest with the same fingerprint) and copies; an aggregate, so no group meets in a task."""
    groups = marks.groupBy("fingerprint").agg(F.min(draft).alias("first_draft"), F.count("*").alias("copies"))
    return marks.join(groups, "fingerprint")


def unmatched(left: DataFrame, right: DataFrame, *, key: str) -> DataFrame:
    """Keys that only one of two exports has, and which."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))


def winners(picks: DataFrame, table: DataFrame, *, draft: str, roster: str, score: str) -> DataFrame:
    """Picks of each draft's best roster (highest score, then roster), with the score and the draft's roster count."""
    best = table.groupBy(draft).agg(F.min_by(F.struct(F.col(roster), F.col(score)), F.struct(-F.col(score), F.col(roster))).alias("best"), F.count("*").alias("n_rosters"))
    best = best.select(draft, F.col(f"best.{roster}").alias(roster), F.col(f"best.{score}").alias("winning_score"), "n_rosters")
    return picks.join(best, [draft, roster])


def draft_summaries(picks: DataFrame, table: DataFrame, *, draft: str, roster: str, score: str, mine: str, digits: int | None = 1) -> DataFrame:
    """draft, win_roster, win_score, my_rank (of the best roster for which ``mine`` is true, else null), n_rosters, n_picks (of the
    winner). Places by score, then roster; a draft's rosters are few."""
    places = F.row_number().over(Window.partitionBy(draft).orderBy(F.col(score).desc_nulls_last(), roster))
    won = F.col("place") == 1
    told = table.withColumn("place", places).groupBy(draft).agg(
        F.max(F.when(won, F.col(roster))).alias("win_roster"), rounded(F.max(F.when(won, F.col(score))), digits).alias("win_score"), F.min(F.when(F.col(mine), F.col("place"))).alias("my_rank"), F.count("*").alias("n_rosters")
    )
    held = picks.groupBy(draft, F.col(roster).alias("win_roster")).agg(F.count("*").alias("n_picks"))
    return told.join(held, [draft, "win_roster"], "left").withColumn("n_picks", F.coalesce("n_picks", F.lit(0)))


def top_entities(rows: DataFrame, *, entity: str, draft: str, labels: list[str], measures: list[str], top: int, order: str = "pick") -> DataFrame:
    """Entities by the number of drafts that hold them: first known labels by ``order``, mean measures; the ``top`` ones."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, draft))).alias(c) for c in labels]
    held = rows.where(F.col(entity).isNotNull())
    drafts = held.select(entity, draft).distinct().groupBy(entity).agg(F.count(draft).alias("drafts"))
    found = drafts.join(held.groupBy(entity).agg(*first, *[mean(m).alias(f"mean_{m}") for m in measures]), entity)
    return found.orderBy(F.col("drafts").desc(), entity).limit(top)


def pivot_counts(rows: DataFrame, *, by: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each value by row label, with their total; null labels are dropped."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).pivot(column, values).count().fillna(0, values)
    return counts.withColumn("total", sum((F.col(v) for v in values[1:]), F.col(values[0])))


def phase_average(rows: DataFrame, *, round_col: str, column: str, values: list[str], edges: list[float], labels: list[str], drafts: int | None = None, draft: str | None = None) -> DataFrame:
    """Picks of each value per draft by phase; phases without a pick are rows of 0."""
    spark = rows.sparkSession
    n = F.lit(drafts).alias("n_drafts") if drafts is not None else F.countDistinct(draft).alias("n_drafts")
    total = rows.agg(n) if drafts is None else spark.range(1).select(n)
    phases = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("phase"))
    counted = pivot_counts(rows.withColumn("phase", right_closed(round_col, edges, labels)), by="phase", column=column, values=values).drop("total")
    return phases.join(counted, "phase", "left").crossJoin(F.broadcast(total)).select("phase", *[safe_div(F.coalesce(v, F.lit(0)), "n_drafts").alias(v) for v in values])  # one row


def first_timing(rows: DataFrame, *, draft: str, round_col: str, column: str, value: str) -> DataFrame:
    """Drafts by the round in which the value was first taken."""
    firsts = rows.where(F.col(column) == value).groupBy(draft).agg(F.min(round_col).alias("first_round"))
    return firsts.groupBy("first_round").agg(F.count("*").alias("drafts"))


def stacks(rows: DataFrame, *, draft: str, unit: str, least: int = 2) -> DataFrame:
    """Units by the number of drafts that hold ``least`` or more of their members; null units are dropped."""
    held = rows.where(F.col(unit).isNotNull()).groupBy(draft, unit).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return held.groupBy(unit).agg(F.count("*").alias("drafts"), F.sum("n").alias("members"))


def value_by_round(rows: DataFrame, *, round_col: str, adp: str, pick: str) -> DataFrame:
    """Mean of market rank less pick by round (above 0: taken earlier than the market has it); null ranks are left out."""
    return rows.withColumn("adp_minus_pick", F.col(adp) - F.col(pick)).groupBy(round_col).agg(mean("adp_minus_pick").alias("adp_minus_pick"), F.count("adp_minus_pick").alias("n"))


def report(rows: DataFrame, *, draft: str, roster: str, round_col: str, column: str, value: str, gap: str) -> DataFrame:
    """One row of figures over all drafts: drafts, mean roster number, mean and commonest first round of the value (lowest
    on ties), share of positive gaps and mean gap."""
    firsts = rows.where(F.col(column) == value).groupBy(draft).agg(F.min(round_col).alias("first_round"))
    commonest = firsts.groupBy("first_round").agg(F.count("*").alias("n")).agg(F.min_by("first_round", F.struct(-F.col("n"), F.col("first_round"))).alias("commonest_first_round"))
    means = firsts.agg(mean("first_round").alias("mean_first_round"))
    figures = rows.agg(
        F.countDistinct(draft).alias("drafts"), mean(roster).alias("mean_roster"), safe_div(F.count_if(F.col(gap) > 0), F.count(gap)).alias("positive_share"), mean(gap).alias("mean_gap"),
    )
    return figures.crossJoin(means).crossJoin(commonest)  # one row each


def slot_distribution(rosters: DataFrame, *, draft: str, slot: str) -> DataFrame:
    """Winning slots by count; a draft counts once for a slot."""
    return rosters.select(draft, slot).distinct().groupBy(slot).agg(F.count("*").alias("drafts"))


def early_mix(rows: DataFrame, *, round_col: str, column: str, rounds: int = 2) -> DataFrame:
    """Picks of each value in each of the first rounds."""
    return rows.where(F.col(round_col) <= rounds).groupBy(round_col, column).agg(F.count("*").alias("picks"))


def composition(rows: DataFrame, *, draft: str, column: str, digits: int | None = 1) -> DataFrame:
    """Picks of each value per draft."""
    n = rows.select(draft).distinct().agg(F.count("*").alias("n_drafts"))  # one row
    return rows.groupBy(column).agg(F.count("*").alias("picks")).crossJoin(F.broadcast(n)).select(column, rounded(safe_div("picks", "n_drafts"), digits).alias("per_draft"))


#: Blocks of entities that a pool is made by, and parts of the drafts that meet a block apart from each other.
BLOCKS = 64
PARTS = 4


def available(ranked: DataFrame, picks: DataFrame, *, draft: str, entity: str) -> DataFrame:
    """Ranked entities that a draft has not taken, for each draft.

    The result is a product less a few of its rows, so it is streamed: entities lie in BLOCKS by hash, a draft is a row for each
    block with what it has taken of it, and the join of both gives the pool's rows, which are not exchanged, sorted or kept. What is
    exchanged, once, grows with the picks, BLOCKS rows of a draft and PARTS copies of the entities.
    """
    kind = dict(ranked.dtypes)[entity]

    def block(e: Column) -> Column:
        return F.pmod(F.xxhash64(e.cast(kind)), F.lit(BLOCKS)).cast("int")

    key = (F.col("__block") * PARTS + F.pmod(F.xxhash64(draft), F.lit(PARTS)).cast("int")).alias("__key")
    frame = picks.select(draft).distinct().select(draft, F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("__block"), F.lit(None).cast(kind).alias("__e"))
    took = picks.where(F.col(draft).isNotNull() & F.col(entity).isNotNull()).select(draft, block(F.col(entity)).alias("__block"), F.col(entity).cast(kind).alias("__e"))
    parts = int(picks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A draft has one row for a key, and what is dealt by key is met by key: the picks are exchanged once. Sorted, a task's rows are
    # made before their product is; without, the product took about twice the time.
    asked = frame.unionByName(took).select(draft, key, "__e").repartition(parts, "__key").groupBy("__key", draft).agg(F.collect_set("__e").alias("__taken")).sortWithinPartitions("__key")
    filed = ranked.withColumn("__key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: block(F.col(entity)) * PARTS + k)))
    met = asked.join(filed.hint("shuffle_hash"), "__key").where(~F.coalesce(F.array_contains("__taken", F.col(entity)), F.lit(False)))
    return met.select(draft, *ranked.columns)


def near_picks(picks: DataFrame, ranked: DataFrame, *, pick: str, market: str, before: int, after: int, top: int | None = None, tie: str = "entity") -> DataFrame:
    """Entities whose market rank is within [pick - before, pick + after].

    With ``top`` the first so many of them, by rank: the ranked entities are one sorted list, a band is a stretch of its places,
    and only the first places of it are looked up, once for all rows of one pick number. Picks that are equal in every column share their
    places, an entity taking one for each. Without ``top`` an equi-join on blocks of ranks as wide as the band, so a pick meets its own two
    or three blocks only.
    """
    if top is not None:
        listed = ranked.where(F.col(market).isNotNull()).withColumn("__all", F.lit(0))
        places = cut(numbered(listed, value=market, tie=[tie], name="__at"))
        numbers = picks.select(F.lit(0).alias("__all"), F.col(pick).alias("__pick")).where("__pick IS NOT NULL").distinct()
        bounds = _list_bounds(places, numbers, within="__all", pick="__pick", market=market, before=before, after=after)
        stretch = F.sequence(F.col("lo") + 1, F.least("hi", F.col("lo") + top))
        first = bounds.where("hi > lo").select("__pick", F.posexplode(stretch).alias("__no", "__at")).join(places.drop("__all"), "__at").drop("__at")
        asked = picks.groupBy(*picks.columns).agg(F.count("*").cast("int").alias("__same"))
        met = asked.join(first, F.col(pick) == F.col("__pick")).where(F.col("__no") * F.col("__same") < top)
        place = F.explode(F.sequence(F.col("__no") * F.col("__same") + 1, F.least(F.lit(top), (F.col("__no") + 1) * F.col("__same")))).alias("place")
        return met.select(*picks.columns, *ranked.columns, place)
    width = before + after + 1
    spans = picks.withColumn("block", F.explode(F.sequence(F.floor((F.col(pick) - before) / width), F.floor((F.col(pick) + after) / width))))
    blocks = ranked.withColumn("block", F.floor(F.col(market) / width))
    return spans.join(blocks, "block").where(F.col(market).between(F.col(pick) - before, F.col(pick) + after)).drop("block")


def needs(rosters: DataFrame, targets: DataFrame, *, roster: str, position: str) -> DataFrame:
    """roster, position, have, need: target less held; every target position of every roster."""
    have = rosters.groupBy(roster, position).agg(F.count("*").alias("have"))
    every = rosters.select(roster).distinct().crossJoin(F.broadcast(targets))  # one row for each of the few positions
    return every.join(have, [roster, position], "left").select(roster, position, F.coalesce("have", F.lit(0)).alias("have"), (F.col("target") - F.coalesce("have", F.lit(0))).alias("need"))


def _places(ranked: DataFrame, *, within: str, market: str, entity: str) -> DataFrame:
    """within, entity, market, at: the sorted rank list of each group, written, since it is read several times."""
    return cut(numbered(ranked.select(within, entity, market), value=market, tie=[entity], within=[within], name="at"))


def _taken(picks: DataFrame, places: DataFrame, *, roster: str, within: str, entity: str) -> DataFrame:
    """roster, within, taken: the places of each list that a roster has taken."""
    return picks.select(roster, entity).distinct().join(places, entity).groupBy(roster, within).agg(F.collect_list("at").alias("taken"))


def _free(first: Column, last: Column, n: Column | None = None) -> Column:
    """The places from ``first`` to ``last`` that are not in the column taken, the first ``n`` of them."""
    taken = F.coalesce("taken", F.array().cast("array<int>"))
    if n is None:
        return F.array_except(F.sequence(first, last), taken)
    far = F.least(last, first + n + F.size(taken) - 1)  # so many places hold n free ones
    return F.when(first <= far, F.slice(F.array_except(F.sequence(first, far), taken), 1, n)).otherwise(F.array().cast("array<int>"))


def _list_bounds(places: DataFrame, asked: DataFrame, *, within: str, pick: str, market: str, before: int, after: int) -> DataFrame:
    """within, pick, lo, hi: how many places of a list are below pick - before, and up to pick + after, counted in one order
    of the list's ranks and the bands' ends."""
    v = F.col(pick).cast("double")
    ends = F.inline(F.array(F.struct((v - before).alias("v"), F.lit(0).alias("kind"), F.lit(0).alias("n")), F.struct((v + after).alias("v"), F.lit(2).alias("kind"), F.lit(0).alias("n"))))
    points = asked.select(within, pick).distinct().select(within, pick, ends)
    listed = places.where(F.col(market).isNotNull()).select(within, F.lit(None).cast(dict(asked.dtypes)[pick]).alias(pick), F.col(market).cast("double").alias("v"), F.lit(1).alias("kind"), F.lit(1).alias("n"))
    counted = prefixed(points.unionByName(listed), within=[within], order=["v", "kind"], sums={"below": "n"}).where("kind != 1")
    lo, hi = (F.max(F.when(F.col("kind") == k, F.col("below"))).cast("int") for k in (0, 2))
    return counted.groupBy(within, pick).agg(lo.alias("lo"), hi.alias("hi"))


def need_candidates(needed: DataFrame, ranked: DataFrame, picks: DataFrame, *, roster: str, position: str, pick: str, market: str, entity: str, before: int = 5, after: int = 18, top: int = 3) -> DataFrame:
    """roster, position, entity, is_near, place: for each position that a roster still needs (need > 0) the ``top`` entities of
    ``ranked`` that the roster's ``picks`` leave and whose market rank is near its pick, by rank; where none is near, the best of the position.

    A position is one sorted list. A roster's picks are places taken of it, the band around a pick is a stretch of places, and
    the first free ones of the stretch are told by number: no row is made for an entity that is not returned.
    """
    places = _places(ranked, within=position, market=market, entity=entity)
    wanted = needed.where("need > 0").select(roster, position, pick)
    bounds = _list_bounds(places, wanted, within=position, pick=pick, market=market, before=before, after=after)
    sizes = places.groupBy(position).agg(F.count("*").cast("int").alias("n"))
    taken = _taken(picks, places, roster=roster, within=position, entity=entity)
    met = wanted.join(bounds, [position, pick]).join(sizes, position).join(taken, [roster, position], "left")
    near, best = _free(F.col("lo") + 1, F.col("hi"), F.lit(top)), _free(F.lit(1), F.col("n"), F.lit(top))
    chosen = met.withColumn("near", near).withColumn("is_near", F.size("near") > 0).withColumn("best", F.when(F.col("is_near"), F.col("near")).otherwise(best))
    found = chosen.select(roster, position, "is_near", F.posexplode("best").alias("no", "at")).join(places.select(position, "at", entity), [position, "at"])
    return found.select(roster, position, entity, "is_near", (F.col("no") + 1).alias("place"))


#: Least places of a block of the sorted list of entities; longer lists have BLOCKS blocks of more places.
STRETCH = 1 << 14


def stack_targets(rosters: DataFrame, ranked: DataFrame, *, roster: str, entity: str, unit: str, pick: str, market: str, band: int = 20) -> DataFrame:
    """roster, entity, unit, market, at_pick, mates, is_near, place: the entities of the units that a roster holds, less those
    that it has, near its last pick of the unit first.

    The result is about a product, so its rows are streamed as those of ``available``: neither exchanged nor sorted. All entities are
    one list sorted by market and entity, in blocks of STRETCH places, BLOCKS at most; a roster meets a block with its units and what it has taken of it. A first
    pass counts a roster's near, other and unknown rows of each block; prefix sums of these counts are where a (roster, kind, block) starts
    in the roster's order. In the second pass such stretches lie sorted in the partitions, so a row's number in its partition tells
    its place. What is kept and exchanged is a row for each roster and block, and PARTS copies of the entities.
    """
    parts = int(rosters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = ranked.select(entity, unit, market).where(F.col(unit).isNotNull())
    listed = cut(prefixed(known, order=[F.col(market).asc_nulls_first(), entity], number="__g"))
    ids = cut(numbered(listed.select(unit).distinct(), value=unit, tie=[], name="__uid"))  # a row for each of the units
    block = F.floor((F.col("__g") - 1) / max(STRETCH, -(-listed.count() // BLOCKS))).cast("int")

    held = rosters.groupBy(roster, unit).agg(F.max(pick).alias("at_pick"), F.count("*").cast("int").alias("mates")).join(ids, unit)
    by_unit = held.groupBy(roster).agg(F.map_from_entries(F.collect_list(F.struct("__uid", F.struct("at_pick", "mates")))).alias("__held"))
    ends = listed.agg(F.max(block).alias("__last")).crossJoin(ids.agg(F.max("__uid").alias("__units")))  # one row
    every = by_unit.crossJoin(F.broadcast(ends)).withColumn("__of", F.transform(F.sequence(F.lit(1), F.col("__units")), lambda u: F.col("__held")[u]))
    every = cut(every.select(roster, F.col("__of.at_pick").alias("__at"), F.col("__of.mates").alias("__mates"), "__last").where("__last IS NOT NULL"))

    none = F.lit(None).cast("bigint").alias("__g")
    frame = every.select(roster, F.explode(F.sequence(F.lit(0), F.col("__last"))).alias("__block"), none)
    took = rosters.select(roster, entity).where(F.col(roster).isNotNull()).distinct().join(listed.select(entity, "__g"), entity).select(roster, block.alias("__block"), F.col("__g").cast("bigint").alias("__g"))
    taken = frame.unionByName(took).repartition(roster, "__block").groupBy(roster, "__block").agg(F.collect_set("__g").alias("__taken"))
    same = F.col(roster).eqNullSafe(F.col("__r"))
    asked = taken.join(every.withColumnRenamed(roster, "__r").drop("__last"), same).drop("__r")
    asked = cut(asked.withColumn("__key", F.col("__block") * PARTS + F.pmod(F.xxhash64(roster), F.lit(PARTS)).cast("int")))

    copies = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: block * PARTS + k)).alias("__key")
    rows = F.struct(F.col("__g").cast("bigint").alias("__g"), "__uid", F.col(entity).alias("__e"), F.col(unit).alias("__u"), F.col(market).alias("__m"))
    filed = cut(listed.join(ids, unit).select(rows.alias("__row"), copies).groupBy("__key").agg(F.array_sort(F.collect_list("__row")).alias("__rows")))

    def streamed(df: DataFrame, *kept: str) -> DataFrame:
        """The free rows of blocks in the order of ``df``."""
        flat = df.join(filed.hint("shuffle_hash"), "__key").select(roster, *kept, "__at", "__mates", "__taken", F.inline("__rows"))
        at, mates = F.get("__at", F.col("__uid") - 1), F.get("__mates", F.col("__uid") - 1)
        free = flat.withColumns({"at_pick": at, "mates": mates}).where(F.col("mates").isNotNull() & ~F.array_contains("__taken", F.col("__g")))
        return free.withColumn("is_near", F.abs(F.col("__m") - F.col("at_pick")) <= band)

    kind = F.when(F.col("is_near"), 0).when(~F.col("is_near"), 1).otherwise(2)
    counts = streamed(asked.repartition(parts, "__key"), "__key", "__block").groupBy(roster, "__key", "__block").agg(*[F.count_if(kind == k).alias(f"n{k}") for k in range(3)])
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("__kind"), F.col(f"n{k}").alias("__n")) for k in range(3)]))
    # the partition that repartition(parts, "__key") deals a key to
    stretches = cut(counts.select(F.col(roster).alias("__r"), F.col("__key").alias("__k"), "__block", each).where("__n > 0").withColumn("__part", F.pmod(F.hash("__k"), F.lit(parts))))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = before(Window.partitionBy("__r").orderBy("__kind", "__block")) - before(Window.partitionBy("__part").orderBy("__k", "__r", "__kind"))
    met = asked.join(stretches.select("__r", "__k", "__kind", shift.alias("__shift")), same & (F.col("__key") == F.col("__k"))).drop("__r", "__k", "__block")
    dealt = cut(met.repartition(parts, "__key").sortWithinPartitions("__key", roster, "__kind"))
    # Dealt again by the same key, each partition is one written partition in its order, and of a fixed number: none is merged or split
    out = streamed(dealt.repartition(parts, "__key"), "__kind", "__shift").where(kind == F.col("__kind"))
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.select(roster, F.col("__e").alias(entity), F.col("__u").alias(unit), F.col("__m").alias(market), "at_pick", F.col("mates").cast("bigint").alias("mates"), "is_near", (number + F.col("__shift")).cast("int").alias("place"))


def fallen(pool: DataFrame, *, pick: str, market: str) -> DataFrame:
    """Adds fell: how far a pick is past the market rank; null where it is not."""
    return pool.withColumn("fell", F.when(F.col(pick) > F.col(market), F.col(pick) - F.col(market)))


def scarcity(ranked: DataFrame, picks: DataFrame, *, draft: str, entity: str, position: str, market: str, first: int, second: int) -> DataFrame:
    """Entities left by draft and position, in all and within the first and second market ranks: the totals of a position
    less what the draft has taken of it, so the pools themselves are never made. Positions with none left are left out."""

    def counts() -> list[Column]:
        return [F.count("*").alias("all"), F.count_if(F.col(market) <= first).alias("first"), F.count_if(F.col(market) <= second).alias("second")]

    taken = picks.select(draft, entity).distinct().join(ranked, entity).groupBy(draft, position).agg(*[c.alias(n) for c, n in zip(counts(), ("t_all", "t_first", "t_second"), strict=True)])
    every = picks.select(draft).distinct().crossJoin(F.broadcast(ranked.groupBy(position).agg(*counts())))  # a row for each of a few positions
    left = every.join(taken, [draft, position], "left").select(draft, position, *[(F.col(n) - F.coalesce(f"t_{n}", F.lit(0))).alias(out) for n, out in (("all", "left_over"), ("first", "left_first"), ("second", "left_second"))])
    return left.where("left_over > 0")


def bye_clusters(rosters: DataFrame, *, roster: str, bye: str, entity: str) -> DataFrame:
    """Entities of a roster by bye week, with a severity from three and from two."""
    by = rosters.where(F.col(bye).isNotNull()).groupBy(roster, bye).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(entity).cast("string"))), ", ").alias("names"))
    return by.withColumn("severity", F.when(F.col("n") >= 3, "high").when(F.col("n") >= 2, "medium").otherwise("low"))


def first_source(sources: list[DataFrame], *, key: str) -> DataFrame:
    """Union of lists by column names; of a key that several have, the row of the first list."""
    out = None
    for k, df in enumerate(sources):
        one = df.withColumn("source_no", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.withColumn("keep", F.row_number().over(Window.partitionBy(key).orderBy("source_no"))).where("keep = 1").drop("keep")


def export(picks: DataFrame, projections: DataFrame, market: DataFrame, totals: DataFrame, *, draft: str, roster: str, entity: str) -> DataFrame:
    """The draft table: each pick with its projection, market rank and the roster's total."""

    def one(df: DataFrame) -> DataFrame:
        """A row for each entity, the smallest of several."""
        rest = [c for c in df.columns if c != entity]
        return df.groupBy(entity).agg(F.min(F.struct(*rest)).alias("__row")).select(entity, "__row.*")

    return picks.join(one(projections), entity, "left").join(one(market), entity, "left").join(totals, [draft, roster], "left")


def board_picks(boards: DataFrame, *, id_col: str, text_col: str, divider: str = "User Avatar", ending: str = "icon") -> DataFrame:
    """id, section, pick, name from pasted boards: sections between divider lines, in them a number line before a line
    that ends in ``ending``. A bulk job over any number of texts."""
    sections = boards.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), divider)).alias("section", "part"))
    lines = rf"(?m)^\s*(\d+)\s*\n\s*(.*?)\s*{ending}\s*$"
    found = sections.select(id_col, "section", F.explode(F.arrays_zip(F.regexp_extract_all("part", F.lit(lines), F.lit(1)).alias("pick"), F.regexp_extract_all("part", F.lit(lines), F.lit(2)).alias("name"))).alias("row"))
    return found.select(id_col, "section", F.col("row.pick").cast("int").alias("pick"), F.col("row.name").alias("name"))
