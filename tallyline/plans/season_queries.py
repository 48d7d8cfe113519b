"""Queries over seasons: roll-ups, pairs, profiles, comparables, tiers, adjustments, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import mean, safe_div, title_case, total
from ..operators import adjust, compare, comps, lineup, matchup, profiles, ranks, schedule, seasons, signals, tiers
from .base import EVENTS, ORDERS, ROLLED, events, orders, query, s_mean, s_round, s_spread, s_total, table

KEYS = ["entity", "season"]


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasons.season_rollup(orders(spark, sf_dir), keys=KEYS, measures=["value"])


@query(f"""WITH {ROLLED.replace("max(value) AS value_max", '''max(value) AS value_max, round(median(value), 4) AS value_median,
    count(*) FILTER (value >= 100000) AS value_at_100000, count(*) FILTER (value >= 250000) AS value_at_250000''')}
    SELECT *, {s_round("value_at_100000 / CAST(n AS DOUBLE)", 3)} AS value_rate_100000, {s_round("value_at_250000 / CAST(n AS DOUBLE)", 3)} AS value_rate_250000 FROM r""")
def season_rollup(spark, sf_dir):
    return seasons.season_rollup(orders(spark, sf_dir), keys=KEYS, measures=["value"], thresholds={"value": [100000, 250000]})


@query(f"""WITH {ORDERS}, c AS (SELECT entity, season, segment, count(*) AS n_rows FROM o GROUP BY ALL)
    SELECT entity, season, segment, n_rows FROM c QUALIFY row_number() OVER (PARTITION BY entity, season ORDER BY n_rows DESC, segment) = 1""")
def primary_category(spark, sf_dir):
    return seasons.primary_category(orders(spark, sf_dir), keys=KEYS, category="segment")


@query(f"WITH {ROLLED} SELECT entity, season, n, value_sum, {s_round('value_sum * 17.0 / greatest(n, 1)', 1)} AS value_sum_full FROM r")
def full_season_norm(spark, sf_dir):
    full = seasons.full_season(rolled(spark, sf_dir), totals=["value_sum"], games="n", season_games=17)
    return full.select(*KEYS, "n", "value_sum", "value_sum_full")


@query(f"""WITH {ROLLED} SELECT entity, season, min(season) OVER w AS first_season, season - min(season) OVER w + 1 AS career_year,
    count(*) OVER (PARTITION BY entity ORDER BY season) AS seasons_seen FROM r WINDOW w AS (PARTITION BY entity)""")
def career_year(spark, sf_dir):
    return seasons.career(rolled(spark, sf_dir).select(*KEYS), entity=["entity"], season="season")


@query(f"""WITH {ROLLED} SELECT a.entity, a.season, a.n, a.value_sum, b.n AS next_games, b.value_sum AS next_value_sum,
    CASE WHEN b.n < 4 THEN {s_round("b.value_sum * 6.0 / b.n", 1)} ELSE b.value_sum END AS adjusted_target
    FROM r a JOIN r b ON a.entity = b.entity AND b.season = a.season + 1 WHERE a.n >= 2 AND b.n >= 2""")
def yoy_pairs(spark, sf_dir):
    base = rolled(spark, sf_dir).select(*KEYS, "n", "value_sum")
    return seasons.yoy_pairs(base, entity=["entity"], season="season", games="n", target="value_sum", least_games=2, short_games=4, season_games=6)


@query(f"""WITH {ROLLED} SELECT a.entity, a.season, a.value_mean, coalesce(a.value_mean - b.value_mean, 0) AS value_mean_trend
    FROM r a LEFT JOIN r b ON a.entity = b.entity AND b.season = a.season - 1""")
def yoy_trend(spark, sf_dir):
    return seasons.yoy_trend(rolled(spark, sf_dir).select(*KEYS, "value_mean"), entity=["entity"], season="season", measures=["value_mean"])


@query(f"""WITH {ROLLED}, p AS (SELECT entity, season, segment FROM (SELECT entity, season, segment, count(*) AS k FROM o GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY entity, season ORDER BY k DESC, segment) = 1),
    f AS (SELECT r.entity, r.season, p.segment, r.n, r.value_sum * 17.0 / greatest(r.n, 1) AS value_full,
        coalesce(r.value_mean - b.value_mean, 0) AS value_mean_trend
        FROM r JOIN p USING (entity, season) LEFT JOIN r b ON b.entity = r.entity AND b.season = r.season - 1)
    SELECT *, row_number() OVER (PARTITION BY segment ORDER BY value_full DESC, entity) AS place FROM f WHERE season = 2000
    QUALIFY row_number() OVER (PARTITION BY segment ORDER BY value_full DESC, entity) <= 25""")
def flagship(spark, sf_dir):
    """Roll-up, primary segment, full-season value, trend, then the best 25 of each segment in one season."""
    base = seasons.full_season(rolled(spark, sf_dir), totals=["value_sum"], games="n", season_games=17, digits=None).withColumnRenamed("value_sum_full", "value_full")
    trend = seasons.yoy_trend(base, entity=["entity"], season="season", measures=["value_mean"])
    segment = seasons.primary_category(orders(spark, sf_dir), keys=KEYS, category="segment").drop("n_rows")
    rows = trend.join(segment, KEYS).where("season = 2000").select(*KEYS, "segment", "n", "value_full", "value_mean_trend")
    return lineup.top_of_each(rows, within=["segment"], value="value_full", tie="entity", n=25)


NATION_SEASON = f"""{ORDERS}, ns AS (SELECT c_nationkey AS nation, season, count(*) AS n, {s_mean("value")} AS value_mean
    FROM o JOIN customer ON c_custkey = entity GROUP BY ALL)"""


def nation_season(spark, sf_dir, *extra):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("nation"))
    return orders(spark, sf_dir).join(customers, "entity").groupBy("nation", "season", *extra).agg(F.count("*").alias("n"), mean("value").alias("value_mean"))


def _seasons(lookback: int) -> str:
    return ", ".join(f"max(CASE WHEN season = {y} THEN value_mean END) AS v{y}" for y in range(2001 - lookback + 1, 2002))


def _mean_of_seasons(decay: float, lookback: int) -> str:
    """SQL of a decayed mean with the terms added in order of season."""
    w = {y: repr(float(decay ** (2001 - y))) for y in range(2001 - lookback + 1, 2002)}
    top = " + ".join(["CAST(0 AS DOUBLE)", *[f"coalesce(CAST({w[y]} AS DOUBLE) * v{y}, 0)" for y in w]])
    low = " + ".join(["CAST(0 AS DOUBLE)", *[f"CASE WHEN v{y} IS NULL THEN 0 ELSE CAST({w[y]} AS DOUBLE) END" for y in w]])
    return f"({top}) / ({low})"


def _decayed(decay: float, lookback: int) -> str:
    return f"d AS (SELECT nation, {_mean_of_seasons(decay, lookback)} AS decayed FROM (SELECT nation, {_seasons(lookback)} FROM ns GROUP BY nation) WHERE v2001 IS NOT NULL)"


@query(f"WITH {NATION_SEASON}, {_decayed(0.6, 4)} SELECT nation, decayed, row_number() OVER (ORDER BY decayed, nation) AS place FROM d")
def decayed_mean_rank(spark, sf_dir):
    decayed = profiles.decayed_mean(nation_season(spark, sf_dir), keys=["nation"], season="season", measure="value_mean", latest=2001, decay=0.6, lookback=4)
    return ranks.numbered(decayed, value="decayed", tie=["nation"])  # a row for each nation


@query(f"""WITH {NATION_SEASON}, {_decayed(0.9, 3)}, g AS (SELECT d.*, n_regionkey AS region FROM d JOIN nation ON n_nationkey = nation)
    SELECT nation, region, decayed, {s_round("decayed / " + s_mean("decayed", "OVER (PARTITION BY region)"), 3)} AS strength FROM g""")
def offence_strength(spark, sf_dir):
    decayed = profiles.decayed_mean(nation_season(spark, sf_dir), keys=["nation"], season="season", measure="value_mean", latest=2001, decay=0.9, lookback=3)
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return profiles.strength(decayed.join(regions, "nation"), within=["region"]).select("nation", "region", "decayed", "strength")


@query(f"""WITH {ROLLED}, a AS (SELECT entity, value_mean, value_std FROM r WHERE season = 2001), b AS (SELECT entity, value_mean, value_std FROM r WHERE season = 2000)
    SELECT coalesce(a.entity, b.entity) AS entity,
        CASE WHEN a.entity IS NOT NULL AND b.entity IS NOT NULL THEN a.value_mean * 0.6 + b.value_mean * 0.4 WHEN a.entity IS NOT NULL THEN a.value_mean ELSE b.value_mean END AS value_mean,
        CASE WHEN a.entity IS NOT NULL AND b.entity IS NOT NULL THEN a.value_std * 0.6 + b.value_std * 0.4 WHEN a.entity IS NOT NULL THEN a.value_std ELSE b.value_std END AS value_std
    FROM a FULL JOIN b ON a.entity = b.entity""")
def smoothed_profile(spark, sf_dir):
    return profiles.smoothed(rolled(spark, sf_dir), unit="entity", season="season", new=2001, measures=["value_mean", "value_std"], alpha=0.6)


@query(f"""WITH {ROLLED} SELECT entity, season, n, value_mean FROM r WHERE season IN (1999, 2000)""")
def profile_select(spark, sf_dir):
    return profiles.select_profile(rolled(spark, sf_dir), unit="entity", season="season", seasons=[1999, 2000], measures=["n", "value_mean"])


@query(f"""WITH {ORDERS} SELECT entity AS unit, max(CASE WHEN season = 1999 THEN segment END) AS before, max(CASE WHEN season = 2000 THEN segment END) AS after,
    CAST(coalesce(max(CASE WHEN season = 1999 THEN segment END) = max(CASE WHEN season = 2000 THEN segment END), false) AS INTEGER) AS same FROM o GROUP BY entity""")
def continuity_flag(spark, sf_dir):
    facts = orders(spark, sf_dir).withColumnRenamed("entity", "unit")
    return seasons.continuity(facts, unit="unit", season="season", holder="segment", first=1999, second=2000)


@query(f"""WITH {ORDERS}, ns AS (SELECT c_nationkey AS nation, season, segment, count(*) AS n, {s_mean("value")} AS value_mean FROM o JOIN customer ON c_custkey = entity GROUP BY ALL)
    SELECT nation, segment, {s_total("value_mean * n")} / sum(n) AS value_mean FROM ns WHERE season IN (1998, 1999, 2000) GROUP BY ALL""")
def weighted_profile(spark, sf_dir):
    return seasons.weighted_profile(nation_season(spark, sf_dir, "segment"), keys=["nation", "segment"], season="season", seasons=[1998, 1999, 2000], measures=["value_mean"], games="n")


@query(f"""WITH {ORDERS}, left_side AS (SELECT id AS k, value FROM o), right_side AS (SELECT l_orderkey AS k, {s_total("l_extendedprice")} AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT k, value, coalesce(returned, 0) AS returned, value / (value + coalesce(returned, 0) + 1e-6) AS share FROM left_side LEFT JOIN right_side USING (k)""")
def share(spark, sf_dir):
    left = orders(spark, sf_dir).select(F.col("id").alias("k"), "value")
    right = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("returned"))
    return seasons.combine_shares(left, right, keys=["k"], left_measure="value", right_measure="returned")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, coalesce(o_orderstatus, '?') AS status, CAST(coalesce(o_totalprice, 0) AS DOUBLE) AS order_value
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey * 2""")
def enrich_left(spark, sf_dir):
    """Lines with the order of twice their number, which half of them have not."""
    twice = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("twice"), "o_orderstatus", "o_totalprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").join(twice, F.col("l_orderkey") * 2 == F.col("twice"), "left")
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", F.coalesce("o_orderstatus", F.lit("?")).alias("status"), F.coalesce("o_totalprice", F.lit(0.0)).alias("order_value"))


@query(f"""WITH {ROLLED}, c AS (SELECT *, season - min(season) OVER (PARTITION BY entity) + 1 AS career_year FROM r)
    SELECT entity, season, n, career_year FROM c WHERE season = 2000 AND n >= 3""")
def next_season_input(spark, sf_dir):
    rows = seasons.career(rolled(spark, sf_dir).select(*KEYS, "n"), entity=["entity"], season="season")
    return seasons.next_season_input(rows, season="season", year=2000, games="n", least_games=3).select(*KEYS, "n", "career_year")


def _career(spark, sf_dir):
    return seasons.career(rolled(spark, sf_dir), entity=["entity"], season="season")


COMPS = f"""{ROLLED}, c AS (SELECT *, season - min(season) OVER (PARTITION BY entity) + 1 AS career_year, min(season) OVER (PARTITION BY entity) AS first_season FROM r),
    pool AS (SELECT p.entity, p.season, p.career_year, q.value_sum AS next_value, CAST(p.n AS DOUBLE) AS f1, p.value_mean AS f2 FROM c p JOIN c q ON q.entity = p.entity AND q.season = p.season + 1
        WHERE p.n >= 4 AND (p.career_year > 1 OR p.first_season >= 1996)),
    stats AS (SELECT career_year, count(*) AS m, {s_mean("f1")} AS m1, {s_spread("f1", less=0)} AS d1, {s_mean("f2")} AS m2, {s_spread("f2", less=0)} AS d2 FROM pool GROUP BY career_year HAVING count(*) >= 4),
    z AS (SELECT entity, season, career_year, next_value, (f1 - m1) / CASE WHEN d1 > 0 THEN d1 ELSE 1 END AS z1, (f2 - m2) / CASE WHEN d2 > 0 THEN d2 ELSE 1 END AS z2 FROM pool JOIN stats USING (career_year)),
    asked AS (SELECT entity, season, career_year, (n - m1) / CASE WHEN d1 > 0 THEN d1 ELSE 1 END AS z1, (value_mean - m2) / CASE WHEN d2 > 0 THEN d2 ELSE 1 END AS z2
        FROM c JOIN stats USING (career_year) WHERE season = 2001 AND n >= 2),
    pairs AS (SELECT a.entity, a.season, a.career_year, z.entity AS ce, z.season AS cs, z.next_value, sqrt((a.z1 - z.z1) * (a.z1 - z.z1) + (a.z2 - z.z2) * (a.z2 - z.z2)) AS d
        FROM asked a JOIN z USING (career_year) WHERE a.entity <> z.entity OR a.season <> z.season),
    near AS (SELECT *, row_number() OVER (PARTITION BY entity, season, career_year ORDER BY d, ce, cs) AS k FROM pairs QUALIFY k <= 8),
    raw AS (SELECT entity, season, career_year, list(1 / (d + 0.01) ORDER BY k) AS ws, list(next_value ORDER BY k) AS vs, string_agg(ce || ' (' || (cs + 1) || '): ' || CAST({s_round('next_value', 0)} AS BIGINT) || 'FP', ', ' ORDER BY k) AS names FROM near GROUP BY ALL),
    tot AS (SELECT *, list_reduce(list_prepend(0.0, ws), lambda a, b: a + b) AS total FROM raw),
    cap AS (SELECT *, list_transform(ws, lambda w: least(w, CAST(0.4 AS DOUBLE) * total)) AS cw FROM tot)"""


@query(f"""WITH {COMPS} SELECT entity, season, career_year,
    {s_round("list_reduce(list_prepend(0.0, list_transform(range(1, len(cw) + 1), lambda i: cw[i] * vs[i])), lambda a, b: a + b) / list_reduce(list_prepend(0.0, cw), lambda a, b: a + b)", 1)} AS comparable,
    CAST(len(cw) AS INTEGER) AS n_comps, names FROM cap""")
def comps_knn(spark, sf_dir):
    rows = _career(spark, sf_dir).select(*KEYS, "n", "value_mean", "value_sum", "career_year", "first_season")
    pool = comps.comparable_pool(rows.withColumn("segment", F.lit(1)), entity="entity", season="season", segment="segment", games="n", target="value_sum", least_games=4, first_from=1996)
    asked = rows.where("season = 2001 AND n >= 2")
    return comps.nearest_comparables(asked, pool, segment=["career_year"], entity="entity", season="season", features=["n", "value_mean"]).drop("compared")


@query(f"""WITH {ROLLED}, c AS (SELECT entity, season, value_sum, value_max, season - min(season) OVER (PARTITION BY entity) + 1 AS career_year FROM r)
    SELECT entity, season, career_year, value_sum, value_max,
        CASE career_year WHEN 1 THEN 0.6 * value_max + (1 - CAST(0.6 AS DOUBLE)) * value_sum WHEN 2 THEN 0.35 * value_max + (1 - CAST(0.35 AS DOUBLE)) * value_sum ELSE value_sum END AS blended FROM c""")
def blend(spark, sf_dir):
    rows = _career(spark, sf_dir).select(*KEYS, "career_year", "value_sum", "value_max")
    return comps.blended(rows, model="value_sum", comparable="value_max", career_year="career_year", weights={1: 0.60, 2: 0.35}, digits=None)


PARTS = "p AS (SELECT p_brand AS segment, p_partkey AS id, p_size * 7.0 + p_retailprice / 100 AS value FROM part)"


@query("""WITH RECURSIVE p AS (SELECT p_brand AS segment, p_partkey AS id, CAST(p_size * 7 AS DOUBLE) + p_retailprice / 100 AS value FROM part),
    q AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY value DESC, id) AS k FROM p),
    t AS (SELECT segment, id, value, k, 1 AS tier, 1 AS size FROM q WHERE k = 1
        UNION ALL
        SELECT segment, id, value, k, CASE WHEN breaks THEN tier + 1 ELSE tier END, CASE WHEN breaks THEN 1 ELSE size + 1 END
        FROM (SELECT q.segment, q.id, q.value, q.k, t.tier, t.size,
            t.tier < 18 AND (t.value - q.value >= CASE WHEN t.value >= 200 THEN 15 WHEN t.value >= 100 THEN 12 WHEN t.value >= 50 THEN 20 ELSE 30 END
                OR CASE WHEN t.value > 0 THEN (t.value - q.value) / t.value ELSE 0 END >= CASE WHEN t.value >= 200 THEN CAST(0.07 AS DOUBLE) WHEN t.value >= 100 THEN CAST(0.10 AS DOUBLE) WHEN t.value >= 50 THEN CAST(0.18 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END
                OR t.size >= CASE WHEN t.tier <= 5 THEN 8 ELSE 12 END) AS breaks
            FROM t JOIN q ON q.segment = t.segment AND q.k = t.k + 1))
    SELECT segment, id, value, tier FROM t""")
def gap_tiers(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("segment"), F.col("p_partkey").alias("id"), ((F.col("p_size") * 7).cast("double") + F.col("p_retailprice") / 100).alias("value"))
    return tiers.gap_tiers(parts, segment=["segment"], value="value", key="id")


@query("""SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 2""")
def fits_capped_top(spark, sf_dir):
    return lineup.top_of_each(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), within=["p_brand"], value="p_retailprice", tie="p_partkey", n=2)


@query(f"""WITH {ORDERS}, z AS (SELECT c_custkey AS entity, c_mktsegment AS segment, c_acctbal AS balance, coalesce(t.total, 0) AS total FROM customer LEFT JOIN (SELECT entity, {s_total("value")} AS total FROM o GROUP BY 1) t ON t.entity = c_custkey),
    s AS (SELECT segment, {s_mean("balance")} AS bm, {s_spread("balance")} AS bs, {s_mean("total")} AS tm, {s_spread("total")} AS ts FROM z GROUP BY segment),
    y AS (SELECT entity, segment, (balance - bm) / CASE WHEN bs > 0 THEN bs ELSE 1 END AS balance_z, (total - tm) / CASE WHEN ts > 0 THEN ts ELSE 1 END AS total_z FROM z JOIN s USING (segment))
    SELECT *, least(greatest(1 + CAST(0.04 AS DOUBLE) * ((CAST(0 AS DOUBLE) + balance_z * CAST(0.25 AS DOUBLE)) + total_z * CAST(0.75 AS DOUBLE)), CAST(0.9 AS DOUBLE)), CAST(1.1 AS DOUBLE)) AS signal FROM y""")
def zscore_signal(spark, sf_dir):
    spent = orders(spark, sf_dir).groupBy("entity").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    rows = customers.join(spent, "entity", "left").fillna(0.0, ["total"])
    scored = signals.zscores(rows, within=["segment"], measures=["balance", "total"])
    return signals.composite_signal(scored, weights={"balance": 0.25, "total": 0.75}).select("entity", "segment", "balance_z", "total_z", "signal")


MATCH_ENTITY = {"overall": "overall", "man": "man", "zone": "zone", "high1": "high1", "high2": "high2"}
MATCH_OPPONENT = {"man": "o_man", "zone": "o_zone", "high1": "o_high1", "high2": "o_high2", "man_fpdb": "o_man_fpdb", "zone_fpdb": "o_zone_fpdb"}
MATCH_PARTS = """pe AS (SELECT p_partkey AS entity, p_partkey % 25 AS unit, p_retailprice AS total, (p_partkey % 7) / 2.0::DOUBLE AS overall, (p_partkey % 5) / 2.0::DOUBLE AS man,
        (p_partkey % 3) / 2.0::DOUBLE AS zone, (p_partkey % 4) / 2.0::DOUBLE AS high1, (p_size % 6) / 2.0::DOUBLE AS high2 FROM part),
    po AS (SELECT s_suppkey AS opponent, CAST(20 + s_suppkey % 30 AS DOUBLE) AS o_man, CAST(80 - s_suppkey % 30 AS DOUBLE) AS o_zone, CAST(s_suppkey % 60 AS DOUBLE) AS o_high1,
        CAST(s_suppkey % 40 AS DOUBLE) AS o_high2, s_acctbal / 10000 AS o_man_fpdb, s_acctbal / 20000 AS o_zone_fpdb FROM supplier)"""
MATCH_SQL = """ma AS (SELECT *, o_man / 100.0::DOUBLE AS sm, o_zone / 100.0::DOUBLE AS sz, o_high1 / 100.0::DOUBLE AS s1, o_high2 / 100.0::DOUBLE AS s2 FROM {rows}),
    mb AS (SELECT *, man * sm + high1 * s1 * sz + high2 * s2 * sz AS mix FROM ma),
    mc AS (SELECT *, CASE WHEN mix = 0 AND (man > 0 OR zone > 0) THEN man * sm + zone * sz ELSE mix END AS expected FROM mb),
    md AS (SELECT *, CASE WHEN overall > 0 THEN expected / overall - 1 ELSE 0 END AS advantage FROM mc)"""


def _match_sides(spark, sf_dir):
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    half = lambda x: x / F.lit(2.0)
    k, size, s = F.col("p_partkey"), F.col("p_size"), F.col("s_suppkey")
    entities = part.select(k.alias("entity"), (k % 25).alias("unit"), F.col("p_retailprice").alias("total"), half(k % 7).alias("overall"), half(k % 5).alias("man"), half(k % 3).alias("zone"), half(k % 4).alias("high1"), half(size % 6).alias("high2"))
    opponents = supplier.select(
        s.alias("opponent"), (20 + s % 30).cast("double").alias("o_man"), (80 - s % 30).cast("double").alias("o_zone"), (s % 60).cast("double").alias("o_high1"), (s % 40).cast("double").alias("o_high2"),
        (F.col("s_acctbal") / 10000).alias("o_man_fpdb"), (F.col("s_acctbal") / 20000).alias("o_zone_fpdb"),
    )
    return entities, opponents


@query(f"""WITH {MATCH_PARTS}, {MATCH_SQL.format(rows="pe, po")} SELECT entity, opponent, expected, advantage, man - overall AS man_adv, zone - overall AS zone_adv, sm * 100 AS man_pct, sz * 100 AS zone_pct, sm * o_man_fpdb + sz * o_zone_fpdb AS opponent_fpdb FROM md""")
def matchup_cross(spark, sf_dir):
    entities, opponents = _match_sides(spark, sf_dir)
    return matchup.matchup_table(entities, opponents, entity=MATCH_ENTITY, opponent=MATCH_OPPONENT, digits=None).select("entity", "opponent", "expected", "advantage", "man_adv", "zone_adv", "man_pct", "zone_pct", "opponent_fpdb")


@query(f"""WITH {MATCH_PARTS}, sched AS (SELECT n_nationkey AS unit, CAST(w AS INTEGER) AS week, (n_nationkey * 3 + w * 7) % 110 AS opponent FROM nation, range(1, 18) t(w)),
    j AS (SELECT pe.*, week, opponent, coalesce(o_man, 0) AS o_man, coalesce(o_zone, 0) AS o_zone, coalesce(o_high1, 0) AS o_high1, coalesce(o_high2, 0) AS o_high2 FROM pe JOIN sched USING (unit) LEFT JOIN po USING (opponent)),
    {MATCH_SQL.format(rows="j")} SELECT entity, week, opponent, advantage, total / 17.0 * (1 + advantage) AS week_value FROM md""")
def weekly_matchup_projection(spark, sf_dir):
    entities, opponents = _match_sides(spark, sf_dir)
    n, w = F.col("n_nationkey"), F.col("week")
    weeks = table(spark, sf_dir, "nation").select(n.cast("bigint").alias("unit"), F.explode(F.sequence(F.lit(1), F.lit(17))).alias("week"), n)
    schedule = weeks.select("unit", "week", ((n * 3 + w * 7) % 110).cast("bigint").alias("opponent"))
    out = matchup.weekly_matchups(entities, schedule, opponents, entity=MATCH_ENTITY, opponent=MATCH_OPPONENT, value="total", digits=None)
    return out.select("entity", "week", "opponent", "advantage", "week_value")


SCHEME = f"""{ORDERS}, np AS (SELECT c_nationkey AS profile, segment, {s_mean("value")} AS rate, {s_total("value")} / count(DISTINCT entity) AS points FROM o JOIN customer ON c_custkey = entity GROUP BY ALL),
    ru AS (SELECT n_nationkey AS unit, 'rule ' || n_nationkey AS label, n_nationkey AS from_profile, (n_nationkey + 7) % 25 AS to_profile, CAST(0.5 AS DOUBLE) AS translation, n_nationkey % 4 = 0 AS is_move FROM nation),
    en AS (SELECT c_custkey AS entity, c_nationkey AS unit, p.segment FROM customer JOIN (SELECT entity, max(segment) AS segment FROM o GROUP BY 1) p ON p.entity = c_custkey),
    sc AS (SELECT en.entity, en.segment, ru.label, ru.is_move, ru.translation, f.rate AS fr, f.points AS fp, t.rate AS tr, t.points AS tp FROM en JOIN ru USING (unit)
        LEFT JOIN np f ON f.profile = from_profile AND f.segment = en.segment LEFT JOIN np t ON t.profile = to_profile AND t.segment = en.segment),
    sm AS (SELECT entity, segment, label, coalesce(1 + least(greatest((CASE WHEN is_move THEN CAST(0.7 AS DOUBLE) * (fr / tr) + CAST(0.3 AS DOUBLE) * (fp / tp) ELSE CAST(0.7 AS DOUBLE) * (tr / fr) + CAST(0.3 AS DOUBLE) * (tp / fp) END - 1) * translation, CAST(-0.4 AS DOUBLE)), CAST(0.4 AS DOUBLE)), 1) - 1 AS scheme FROM sc)"""


def _schemes(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("unit"))
    facts = orders(spark, sf_dir)
    by_nation = facts.join(customers, "entity").groupBy(F.col("unit").alias("profile"), "segment")
    points = safe_div(F.sum(F.col("value").cast("decimal(18,4)")), F.countDistinct("entity"))
    found = by_nation.agg(mean("value").alias("rate"), points.alias("points"))
    n = F.col("n_nationkey")
    rules = table(spark, sf_dir, "nation").select(
        n.alias("unit"), F.concat(F.lit("rule "), n.cast("string")).alias("label"), n.alias("from_profile"), ((n + 7) % 25).alias("to_profile"), F.lit(0.5).alias("translation"), (n % 4 == 0).alias("is_move"), F.create_map().cast("map<string,double>").alias("weights")
    )
    entities = customers.join(facts.groupBy("entity").agg(F.max("segment").alias("segment")), "entity")
    return adjust.scheme_adjustments(entities, rules, found, measures=("rate", "points"))


@query(f"WITH {SCHEME} SELECT entity, segment, label, scheme FROM sm")
def scheme_ratio(spark, sf_dir):
    return _schemes(spark, sf_dir)


@query(f"""WITH {SCHEME}, s AS (SELECT entity, segment, CAST(sum(CAST(scheme AS DECIMAL(18,6))) AS DOUBLE) AS scheme, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels FROM sm GROUP BY ALL),
    m AS (SELECT c_custkey AS entity, p.segment, c_acctbal / 100000 AS pct, 'balance' AS reason FROM customer JOIN (SELECT entity, max(segment) AS segment FROM o GROUP BY 1) p ON p.entity = c_custkey)
    SELECT s.entity, s.segment, scheme, coalesce(pct, 0) AS manual, {s_round("(1 + scheme) * (1 + coalesce(pct, 0)) - 1", 4)} AS total,
        'Scheme: ' || labels || CASE WHEN reason IS NOT NULL THEN ' | Manual: ' || reason ELSE '' END AS note FROM s LEFT JOIN m ON m.entity = s.entity AND m.segment = s.segment""")
def adjust_compound(spark, sf_dir):
    schemes = _schemes(spark, sf_dir)
    balances = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") / 100000).alias("pct"), F.lit("balance").alias("reason"))
    manual = balances.join(orders(spark, sf_dir).groupBy("entity").agg(F.max("segment").alias("segment")), "entity")
    return adjust.combine_adjustments(schemes, manual, keys=["entity", "segment"])


@query(f"""WITH {ROLLED}, v AS (SELECT entity, season, max(segment) AS segment, {s_total("value")} AS value FROM o GROUP BY entity, season),
    a AS (SELECT c_custkey AS entity, c_acctbal / 100000 AS total FROM customer),
    w AS (SELECT v.entity, season, segment, v.value, {s_round("value * (1 + coalesce(total, 0))", 1)} AS adjusted, CASE WHEN v.entity % 11 = 0 THEN 'moved' ELSE 'unit ' || v.entity % 25 END AS unit FROM v LEFT JOIN a USING (entity))
    SELECT *, CAST(rank() OVER (PARTITION BY segment ORDER BY adjusted DESC) AS INTEGER) AS segment_rank, CAST(rank() OVER (ORDER BY adjusted DESC) AS INTEGER) AS overall_rank FROM w""")
def adjust_apply(spark, sf_dir):
    """Every season of every customer."""
    rows = orders(spark, sf_dir).groupBy("entity", "season").agg(F.max("segment").alias("segment"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))
    adjustments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") / 100000).alias("total"))
    rows = rows.withColumn("unit", F.concat(F.lit("unit "), (F.col("entity") % 25).cast("string")))
    updates = table(spark, sf_dir, "customer").where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("entity"), F.lit("moved").alias("new_unit"))
    return adjust.apply_adjustments(rows, adjustments, keys=["entity"], value="value", segment="segment", updates=updates).drop("total")


COMPARE = f"""{ORDERS}, a AS (SELECT lower(trim(c_name)) AS name_key, c_mktsegment AS segment, max(c_acctbal) AS v FROM customer GROUP BY ALL),
    b AS (SELECT lower(trim(c_name)) AS name_key, c_mktsegment AS segment, max(t) AS v FROM customer JOIN (SELECT entity, {s_total("value")} AS t FROM o GROUP BY 1) ON entity = c_custkey GROUP BY ALL),
    ra AS (SELECT *, CAST(rank() OVER (PARTITION BY segment ORDER BY v DESC) AS INTEGER) AS k FROM a), rb AS (SELECT *, CAST(rank() OVER (PARTITION BY segment ORDER BY v DESC) AS INTEGER) AS k FROM b),
    cmp AS (SELECT coalesce(ra.name_key, rb.name_key) AS name_key, coalesce(ra.segment, rb.segment) AS segment, ra.k AS our_rank, rb.k AS their_rank, rb.k - ra.k AS rank_diff,
        CASE WHEN rb.k IS NULL THEN 'only_ours' WHEN ra.k IS NULL THEN 'only_theirs' WHEN rb.k - ra.k >= 8 THEN 'higher' WHEN rb.k - ra.k <= -8 THEN 'lower' ELSE 'agree' END AS verdict
        FROM ra FULL JOIN rb ON ra.name_key = rb.name_key AND ra.segment = rb.segment)"""


def _compared(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("value"))
    spent = orders(spark, sf_dir).groupBy("entity").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))
    theirs = customers.drop("value").join(spent, "entity")
    return compare.compare_ranks(customers, theirs, name="name", segment="segment", value="value")


@query(f"WITH {COMPARE} SELECT name_key, segment, our_rank, their_rank, rank_diff, verdict FROM cmp")
def rank_compare(spark, sf_dir):
    return _compared(spark, sf_dir).select("name_key", "segment", "our_rank", "their_rank", "rank_diff", "verdict")


@query(f"""WITH {COMPARE} SELECT segment, count(*) FILTER (verdict = 'agree') AS agree, count(*) FILTER (verdict = 'higher') AS higher, count(*) FILTER (verdict = 'lower') AS lower,
    count(*) FILTER (verdict = 'only_ours') AS only_ours, count(*) FILTER (verdict = 'only_theirs') AS only_theirs FROM cmp GROUP BY segment""")
def verdict_counts(spark, sf_dir):
    return compare.verdict_counts(_compared(spark, sf_dir), segment="segment")


@query("""WITH RECURSIVE known AS (SELECT DISTINCT p_name AS name FROM part),
    raw AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' Jr.' WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
        WHEN 3 THEN 'the boss' WHEN 4 THEN 'zzz nobody' WHEN 5 THEN split_part(p_name, ' ', 1) || ' II ' || split_part(p_name, ' ', 2) WHEN 6 THEN 'Round Robin' ELSE split_part(p_name, ' ', 2) END AS raw_name FROM part),
    al(a, c) AS (VALUES ('the boss', 'the chief'), ('the chief', 'old red'), ('old red', 'red widget'), ('round robin', 'robin round'), ('robin round', 'round robin')),
    ch(a, c, n) AS (SELECT a, c, 1 FROM al UNION ALL SELECT ch.a, al.c, n + 1 FROM ch JOIN al ON al.a = ch.c WHERE n < 6), en AS (SELECT a, c FROM ch WHERE c NOT IN (SELECT a FROM al)),
    k AS (SELECT *, lower(trim(raw_name)) AS rk FROM raw), a AS (SELECT k.*, coalesce(en.c, rk) AS asked, en.c IS NOT NULL AS aliased FROM k LEFT JOIN en ON en.a = rk),
    s AS (SELECT *, array_to_string(list_filter(string_split(asked, ' '), lambda w: rtrim(w, '.') NOT IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v')), ' ') AS short FROM a),
    e AS (SELECT s.*, x.name AS exact, y.name AS by_suffix FROM s LEFT JOIN known x ON lower(x.name) = asked LEFT JOIN known y ON lower(y.name) = short),
    w AS (SELECT e.id, count(*) AS hits, min(n.name) AS by_words FROM e JOIN known n ON list_bool_and(list_transform(list_filter(string_split(short, ' '), lambda t: length(t) > 1), lambda t: contains(lower(n.name), t)))
        WHERE exact IS NULL AND by_suffix IS NULL GROUP BY e.id)
    SELECT e.id, raw_name, coalesce(exact, by_suffix, CASE WHEN hits = 1 THEN by_words END, raw_name) AS resolved,
        CASE WHEN exact IS NOT NULL AND aliased THEN 'alias' WHEN exact IS NOT NULL THEN 'exact' WHEN by_suffix IS NOT NULL THEN 'suffix' WHEN hits = 1 THEN 'words' ELSE 'none' END AS stage FROM e LEFT JOIN w USING (id)""")
def name_resolve(spark, sf_dir):
    """Raw names of eight kinds: among them an alias of three steps, two that lead to each other, and a suffix in the middle."""
    part = table(spark, sf_dir, "part")
    k, name = F.col("p_partkey") % 8, F.col("p_name")
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    asked = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(name, F.lit(" Jr."))).when(k == 2, F.concat(second, F.lit(" "), first)).when(k == 3, "the boss").when(k == 4, "zzz nobody")
    asked = asked.when(k == 5, F.concat(first, F.lit(" II "), second)).when(k == 6, "Round Robin").otherwise(second)
    raw = part.select(F.col("p_partkey").alias("id"), asked.alias("raw_name"))
    pairs = [("The Boss", "the chief"), ("the chief", "Old Red"), ("old red", "red widget"), ("round robin", "robin round"), ("robin round", "round robin")]
    aliases = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(c).alias("canonical")) for a, c in pairs])))
    return compare.resolve_names(raw, part.select("p_name").distinct(), aliases, name="raw_name", known_name="p_name")


@query(f"WITH {COMPARE} SELECT name_key, segment, our_rank, their_rank FROM cmp WHERE their_rank <= 24 AND (our_rank IS NULL OR our_rank > 24)")
def missed_top(spark, sf_dir):
    return compare.missed_top(_compared(spark, sf_dir)).select("name_key", "segment", "our_rank", "their_rank")


@query(f"""WITH {COMPARE} SELECT name_key, segment, our_rank, their_rank, CAST(row_number() OVER (PARTITION BY segment ORDER BY our_rank, name_key) AS INTEGER) AS place FROM cmp WHERE our_rank IS NOT NULL AND their_rank IS NOT NULL QUALIFY place <= 12""")
def agreement_top(spark, sf_dir):
    return compare.agreement(_compared(spark, sf_dir), segment="segment").select("name_key", "segment", "our_rank", "their_rank", "place")


@query(f"""SELECT l_suppkey AS draft, l_returnflag AS flag, count(*) AS n, {s_total("l_quantity")} AS quantity_sum, {s_total("l_extendedprice")} AS price_sum,
    {s_total("l_extendedprice")} / nullif({s_total("l_quantity")}, 0) AS price_per_piece, {s_total("l_quantity")} / count(*) AS quantity_sum_per_game FROM lineitem GROUP BY ALL""")
def derived_rates(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("draft"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    rolled = seasons.season_rollup(facts, keys=["draft", "flag"], measures=["quantity", "price"])
    out = seasons.derived_rates(rolled, rates={"price_per_piece": ("price_sum", "quantity_sum")}, games="n", per_game=["quantity_sum"])
    return out.select("draft", "flag", "n", "quantity_sum", "price_sum", "price_per_piece", "quantity_sum_per_game")


@query("""SELECT c_custkey AS id, list_aggregate(list_transform(string_split(lower(trim(regexp_replace(replace(replace(c_name, '#', ' '), '0', 'ab '), '\\s+', ' ', 'g'))), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS name FROM customer""")
def title_case_names(spark, sf_dir):
    name = F.replace(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit("0"), F.lit("ab "))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), title_case(name).alias("name"))


@query(f"""WITH {ROLLED}, c AS (SELECT entity, season, value_sum, value_max, season - min(season) OVER (PARTITION BY entity) + 1 AS career_year FROM r),
    p AS (SELECT entity, season, segment FROM (SELECT entity, season, segment, count(*) AS k FROM o GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity, season ORDER BY k DESC, segment) = 1),
    b AS (SELECT entity, segment, career_year, {s_round("CASE career_year WHEN 1 THEN 0.6 * value_max + (1 - CAST(0.6 AS DOUBLE)) * value_sum WHEN 2 THEN 0.35 * value_max + (1 - CAST(0.35 AS DOUBLE)) * value_sum ELSE value_sum END", 1)} AS blended FROM c JOIN p USING (entity, season) WHERE season = 2001)
    SELECT *, CAST(row_number() OVER (PARTITION BY segment ORDER BY blended DESC NULLS LAST, entity) AS INTEGER) AS segment_place, CAST(row_number() OVER (ORDER BY blended DESC NULLS LAST, entity) AS INTEGER) AS overall_place FROM b""")
def blend_ranks(spark, sf_dir):
    segment = seasons.primary_category(orders(spark, sf_dir), keys=KEYS, category="segment").drop("n_rows")
    rows = _career(spark, sf_dir).join(segment, KEYS).where("season = 2001").select("entity", "segment", "career_year", "value_sum", "value_max")
    mixed = comps.blended(rows, model="value_sum", comparable="value_max", career_year="career_year", weights={1: 0.60, 2: 0.35})
    return comps.final_ranks(mixed.select("entity", "segment", "career_year", "blended"), value="blended", tie=["entity"], segment="segment")


@query(f"""WITH {MATCH_PARTS}, sched AS (SELECT n_nationkey AS unit, CAST(w AS INTEGER) AS week, (n_nationkey * 3 + w * 7) % 110 AS opponent FROM nation, range(1, 18) t(w)),
    j AS (SELECT pe.*, week, opponent, coalesce(o_man, 0) AS o_man, coalesce(o_zone, 0) AS o_zone, coalesce(o_high1, 0) AS o_high1, coalesce(o_high2, 0) AS o_high2 FROM pe JOIN sched USING (unit) LEFT JOIN po USING (opponent)),
    {MATCH_SQL.format(rows="j")} SELECT entity, week, opponent, advantage FROM md WHERE advantage >= 0.15 ORDER BY advantage DESC, entity, week, opponent LIMIT 10""")
def best_matchups(spark, sf_dir):
    """A top-k report: the ten best weeks from a threshold on."""
    return weekly_matchup_projection(spark, sf_dir).where("advantage >= 0.15").orderBy(F.col("advantage").desc(), "entity", "week", "opponent").limit(10).select("entity", "week", "opponent", "advantage")


# Decay and seasons looked back to, by segment.
RULES = {"1-URGENT": (1.00, 1), "2-HIGH": (1.00, 4), "3-MEDIUM": (0.90, 3), "5-LOW": (0.60, 4)}
RANKS = f"""{ORDERS}, {EVENTS}, ns AS (SELECT c_nationkey AS unit, season, segment, {s_mean("value")} AS value_mean FROM o JOIN customer ON c_custkey = entity GROUP BY ALL),
    dw AS (SELECT unit, segment, {_seasons(4)} FROM ns GROUP BY ALL),
    dc AS (SELECT unit, segment, CASE segment {" ".join(f"WHEN '{s}' THEN {_mean_of_seasons(*r)}" for s, r in RULES.items())} END AS points FROM dw WHERE v2001 IS NOT NULL AND segment IN ({", ".join(f"'{s}'" for s in RULES)})),
    tg AS (SELECT entity % 25 AS unit, 'slot' AS segment, week, points FROM e WHERE points >= 10 UNION ALL SELECT entity % 25, 'wide', week, points FROM e WHERE points <= 10),
    wk AS (SELECT unit, segment, week, {s_total("points")} AS points FROM tg GROUP BY ALL),
    dr AS (SELECT *, CAST(row_number() OVER (PARTITION BY segment ORDER BY points, unit) AS INTEGER) AS place FROM (SELECT * FROM dc UNION ALL SELECT unit, segment, {s_mean("points")} FROM wk GROUP BY ALL)),
    g AS (SELECT n.n_nationkey AS home, (n.n_nationkey + w) % 25 AS away, CAST(w AS INTEGER) AS week FROM nation n, range(1, 18) t(w)),
    ed AS (SELECT home AS unit, away AS opponent, week FROM g UNION ALL SELECT away, home, week FROM g),
    mx AS (SELECT ed.unit, segment, week, opponent, place AS opponent_rank FROM ed JOIN dr ON dr.unit = opponent)"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as units: four segments from the seasons of their customers' orders, two from the weeks of events."""
    decayed = profiles.decayed_by_rule(nation_season(spark, sf_dir, "segment"), keys=["nation"], segment="segment", season="season", measure="value_mean", latest=2001, rules=RULES).withColumnRenamed("nation", "unit")
    tagged = events(spark, sf_dir).select((F.col("entity") % 25).alias("unit"), "week", "points", F.explode(F.array_compact(F.array(F.when(F.col("points") >= 10, "slot"), F.when(F.col("points") <= 10, "wide")))).alias("segment"))
    return profiles.segment_ranks(decayed, tagged, unit="unit", segment="segment", week="week", measure="points")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, w = F.col("n_nationkey"), F.col("week")
    games = table(spark, sf_dir, "nation").withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(17)))).select(n.cast("bigint").alias("home"), ((n + w) % 25).cast("bigint").alias("away"), "week")
    return schedule.both_directions(games, home="home", away="away", keep=["week"])


@query(f"WITH {RANKS} SELECT unit, segment, points, place FROM dr")
def segment_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query(f"WITH {RANKS} SELECT unit, segment, points FROM dc")
def decayed_by_rule(spark, sf_dir):
    return _ranks(spark, sf_dir).where(F.col("segment").isin(list(RULES))).select("unit", "segment", "points")


@query(f"WITH {RANKS} SELECT unit, segment, week, opponent, opponent_rank FROM mx")
def rank_matrix(spark, sf_dir):
    return schedule.rank_matrix(_edges(spark, sf_dir), _ranks(spark, sf_dir), segment="segment")


@query(f"""WITH {RANKS} SELECT unit, segment, count(opponent_rank) AS games, {s_round(s_mean("opponent_rank"), 1)} AS season_mean, {s_round(s_mean("CASE WHEN week BETWEEN 14 AND 17 THEN opponent_rank END"), 1)} AS playoff_mean,
    count(*) FILTER (opponent_rank >= 23) AS easy_games, count(*) FILTER (opponent_rank <= 10) AS tough_games FROM mx GROUP BY ALL""")
def unit_strength(spark, sf_dir):
    ranked = schedule.rank_matrix(_edges(spark, sf_dir), _ranks(spark, sf_dir), segment="segment")
    return schedule.strength_summary(ranked, unit=["unit", "segment"], week="week", rank="opponent_rank", playoff=(14, 17), easy=23, tough=10)


SEGMENT_OF = "CASE s_suppkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN 'slot' WHEN 3 THEN 'wide' ELSE 'none' END"


@query(f"""WITH {RANKS}, lg AS (SELECT segment, {s_mean("points")} AS league FROM dr GROUP BY segment), en AS (SELECT s_suppkey AS entity, s_nationkey AS unit, {SEGMENT_OF} AS segment FROM supplier)
    SELECT entity, week, opponent, points AS opponent_points, place AS opponent_rank, points - league AS over_league, week BETWEEN 14 AND 17 AS is_playoff
    FROM en JOIN ed USING (unit) LEFT JOIN (SELECT dr.unit AS u, dr.segment AS s, points, place, league FROM dr JOIN lg USING (segment)) ON u = opponent AND s = en.segment""")
def schedule_view(spark, sf_dir):
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").cast("bigint").alias("unit"), F.expr(SEGMENT_OF).alias("segment"))
    return schedule.schedule_view(entities, _edges(spark, sf_dir), _ranks(spark, sf_dir), segment="segment", playoff=(14, 17))


@query(f"""WITH {ORDERS}, h AS (SELECT entity, season, min(segment) AS segment, c_nationkey AS unit FROM o JOIN customer ON c_custkey = entity GROUP BY ALL),
    a AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE (c_nationkey + 1) % 25 END AS unit FROM customer),
    x AS (SELECT entity, unit, segment FROM h QUALIFY row_number() OVER (PARTITION BY entity, unit ORDER BY season DESC, segment) = 1), y AS (SELECT entity, segment FROM h QUALIFY row_number() OVER (PARTITION BY entity ORDER BY season DESC, segment) = 1)
    SELECT a.entity, a.unit, coalesce(x.segment, y.segment, 'WR') AS segment FROM a LEFT JOIN x ON x.entity = a.entity AND x.unit = a.unit LEFT JOIN y ON y.entity = a.entity""")
def resolve_segments(spark, sf_dir):
    """Half of the customers are asked for at another unit, some have no order at all."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("bigint").alias("unit"))
    history = orders(spark, sf_dir).groupBy("entity", "season").agg(F.min("segment").alias("segment")).join(customers, "entity")
    asked = customers.select("entity", F.when(F.col("entity") % 2 == 0, F.col("unit")).otherwise((F.col("unit") + 1) % 25).alias("unit"))
    return adjust.resolve_segments(asked, history, entity="entity", unit="unit", segment="segment", season="season")


@query(f"""WITH {ORDERS}, ns AS (SELECT c_nationkey AS unit, season, segment, count(*) AS n, {s_mean("value")} AS value_mean FROM o JOIN customer ON c_custkey = entity GROUP BY ALL),
    w AS (SELECT n_nationkey AS unit, CASE WHEN n_nationkey % 2 = 0 THEN 2000 ELSE 1999 END AS y FROM nation)
    SELECT 'rule ' || unit AS profile, unit, segment, {s_total("value_mean * n")} / sum(n) AS value_mean FROM ns JOIN w USING (unit) WHERE season IN (y, y - 1) GROUP BY ALL""")
def scheme_profiles(spark, sf_dir):
    """Rules with seasons of their own."""
    history = nation_season(spark, sf_dir, "segment").withColumnRenamed("nation", "unit")
    n = F.col("n_nationkey")
    year = F.when(n % 2 == 0, 2000).otherwise(1999)
    segments = orders(spark, sf_dir).select("segment").distinct()
    wanted = table(spark, sf_dir, "nation").crossJoin(F.broadcast(segments)).select(F.concat(F.lit("rule "), n.cast("string")).alias("profile"), n.alias("unit"), "segment", F.array(year, year - 1).alias("seasons"))  # a few segments
    return adjust.scheme_profiles(history, wanted, unit="unit", segment="segment", season="season", measures=["value_mean"], games="n")


@query(f"""WITH {ORDERS}, h AS (SELECT entity, c_nationkey AS unit, season, min(segment) AS segment, count(*) AS n, {s_mean("value")} AS rate, {s_total("value")} AS points FROM o JOIN customer ON c_custkey = entity GROUP BY ALL),
    ru AS (SELECT 'rule ' || n_nationkey AS label, n_nationkey AS fu, (n_nationkey + 7) % 25 AS tu, [1999, 2000 - n_nationkey % 2] AS fy, [2000, 2001] AS py, n_nationkey % 4 = 0 AS mv, 1996 + n_nationkey % 5 AS as_of FROM nation),
    wt AS (SELECT 'rule ' || c_custkey * 3 % 25 AS label, c_custkey AS entity, (c_custkey % 5) / 4.0::DOUBLE AS weight FROM customer),
    rs AS (SELECT wt.label, wt.entity, weight, fu, tu, fy, py, mv, coalesce(h.segment, 'WR') AS segment FROM wt JOIN ru USING (label) LEFT JOIN h ON h.entity = wt.entity AND h.season <= as_of WHERE weight > 0
        QUALIFY row_number() OVER (PARTITION BY wt.label, wt.entity ORDER BY coalesce(h.unit <> CASE WHEN mv THEN fu ELSE tu END, true), h.season DESC NULLS LAST, h.segment) = 1),
    pf AS (SELECT label, segment, {s_total("rate * n")} / sum(n) AS r, {s_total("points * n")} / sum(n) AS p FROM ru JOIN h ON h.unit = fu AND list_contains(fy, h.season) GROUP BY ALL),
    pt AS (SELECT label, segment, {s_total("rate * n")} / sum(n) AS r, {s_total("points * n")} / sum(n) AS p FROM ru JOIN h ON h.unit = tu AND list_contains(py, h.season) GROUP BY ALL),
    mx AS (SELECT label, entity, segment, tu, weight, CASE WHEN mv THEN CAST(0.7 AS DOUBLE) * (pt.r / pf.r) + CAST(0.3 AS DOUBLE) * (pt.p / pf.p) ELSE CAST(0.7 AS DOUBLE) * (pf.r / pt.r) + CAST(0.3 AS DOUBLE) * (pf.p / pt.p) END AS ratio
        FROM rs LEFT JOIN pf USING (label, segment) LEFT JOIN pt USING (label, segment))
    SELECT label, entity, segment, tu AS unit, {s_round("CASE WHEN ratio IS NULL THEN 0 ELSE (1 + least(greatest((ratio - 1) * CAST(0.5 AS DOUBLE), CAST(-0.4 AS DOUBLE)), CAST(0.4 AS DOUBLE)) - 1) * weight END", 4)} AS scheme FROM mx""")
def rule_adjustments(spark, sf_dir):
    """Rules of nations with lists of seasons and weights of their own, each as of its season."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("unit"))
    facts = orders(spark, sf_dir).join(customers, "entity").groupBy("entity", "unit", "season")
    history = facts.agg(F.min("segment").alias("segment"), F.count("*").alias("n"), mean("value").alias("rate"), total("value").alias("points"))
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    name = lambda x: F.concat(F.lit("rule "), x.cast("string"))
    rules = table(spark, sf_dir, "nation").select(
        name(n).alias("label"), n.alias("from_unit"), ((n + 7) % 25).alias("to_unit"), F.array(F.lit(1999), (2000 - n % 2).cast("int")).alias("from_years"), F.array(F.lit(2000), F.lit(2001)).alias("prior_years"),
        F.lit(0.5).alias("translation"), (n % 4 == 0).alias("is_move"), (1996 + n % 5).cast("int").alias("as_of"),
    )
    weights = table(spark, sf_dir, "customer").select(name(k * 3 % 25).alias("label"), k.alias("entity"), (k % 5 / F.lit(4.0)).alias("weight"))
    return adjust.rule_adjustments(rules, weights, history, entity="entity", unit="unit", segment="segment", season="season", measures=("rate", "points"), games="n")
