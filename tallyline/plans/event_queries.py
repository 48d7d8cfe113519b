"""Queries over events and schedules: lagged features, booms, matchups, lineups, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import mean, std_samp, total
from ..operators import features, lineup, matchup, ranks, schedule, signals
from .base import EVENTS, events, query, s_mean, s_round, s_spread, s_total, table

NEAR = "OVER (PARTITION BY entity, position ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
PAST = "OVER (PARTITION BY entity, position ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
THRESHOLDS = {"click": 20.0, "view": 12.5, "purchase": 40.0}


def _lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.lagged(events(spark, sf_dir), keys=["entity", "position"], order=["ts", "event_id"], measures=["points"])


@query(f"WITH {EVENTS} SELECT event_id, {s_mean('points', NEAR)} AS points_roll, {s_spread('points', NEAR)} AS points_roll_std FROM e")
def lagged_roll3(spark, sf_dir):
    return _lagged(spark, sf_dir).select("event_id", "points_roll", "points_roll_std")


@query(f"WITH {EVENTS} SELECT event_id, {s_mean('points', PAST)} AS points_past, {s_spread('points', PAST)} AS points_past_std FROM e")
def lagged_expanding(spark, sf_dir):
    return _lagged(spark, sf_dir).select("event_id", "points_past", "points_past_std")


@query(f"""WITH {EVENTS} SELECT event_id, {s_mean('points', NEAR.replace("entity, ", ""))} AS points_roll, {s_spread('points', NEAR.replace("entity, ", ""))} AS points_roll_std,
    {s_mean('points', PAST.replace("entity, ", ""))} AS points_past, {s_spread('points', PAST.replace("entity, ", ""))} AS points_past_std FROM e""")
def lagged_by_type(spark, sf_dir):
    """Over the few event types, each of which has a large share of all rows."""
    out = features.lagged_of_large_keys(events(spark, sf_dir), keys=["position"], order=["ts", "event_id"], measures=["points"])
    return out.select("event_id", "points_roll", "points_roll_std", "points_past", "points_past_std")


BOOM = f"""{EVENTS}, b AS (SELECT *, CASE WHEN points >= CASE position WHEN 'click' THEN 20 WHEN 'view' THEN 12.5 WHEN 'purchase' THEN 40 END THEN 1 ELSE 0 END AS boom,
    least(points / 100, 1.0) AS prob FROM e WHERE week > 1)"""


@query(f"""WITH {BOOM} SELECT entity, position, count(*) AS weeks, coalesce({s_total("prob")}, 0) AS expected_booms, count(*) FILTER (prob >= CAST(0.35 AS DOUBLE)) AS predicted_booms,
    CAST(sum(boom) AS BIGINT) AS actual_booms, {s_mean("points")} AS mean_points, max(points) AS best_points FROM b GROUP BY ALL""")
def boom_label_summary(spark, sf_dir):
    rows = features.labelled(events(spark, sf_dir), segment="position", measure="points", thresholds=THRESHOLDS, week="week")
    rows = rows.withColumn("prob", F.least(F.col("points") / 100, F.lit(1.0)))
    return features.boom_summary(rows, keys=["entity", "position"], probability="prob", actual="boom", points="points")


@query(f"""WITH {EVENTS} SELECT entity, position, count(*) AS n, {s_round("count(*) FILTER (points >= CASE position WHEN 'click' THEN 20 WHEN 'view' THEN 12.5 ELSE 40 END) * 100 / CAST(count(*) AS DOUBLE)", 1)} AS boom_rate
    FROM e WHERE position IN ('click', 'view', 'purchase') GROUP BY ALL""")
def boom_rate(spark, sf_dir):
    return features.boom_rate(events(spark, sf_dir), keys=["entity", "position"], segment="position", measure="points", thresholds=THRESHOLDS)


@query(f"""WITH {EVENTS}, v AS (SELECT entity, position, {s_mean("points")} AS mean_points, {s_spread("points")} AS std_points, count(points) AS n FROM e GROUP BY ALL HAVING count(points) >= 6)
    SELECT *, CASE WHEN mean_points > 1 THEN std_points / mean_points END AS cv FROM v""")
def consistency_cv(spark, sf_dir):
    return features.consistency(events(spark, sf_dir), keys=["entity", "position"], measure="points", least=6)


WEEKLY = f"{EVENTS}, w AS (SELECT entity, week, position, {s_total('points')} AS points FROM e GROUP BY ALL)"


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("entity", "week", "position").agg(total("points").alias("points"))


@query(f"""WITH {EVENTS}, t AS (SELECT entity, week, position AS segment, points FROM e UNION ALL SELECT entity, week, 'high', points FROM e WHERE points >= 10
        UNION ALL SELECT entity, week, 'low', points FROM e WHERE points <= 10)
    SELECT entity, week, segment, {s_total("points")} AS points_sum, count(*) AS n FROM t GROUP BY ALL""")
def slot_share_buckets(spark, sf_dir):
    facts = events(spark, sf_dir).withColumnRenamed("position", "segment")
    tags = {"high": F.col("points") >= 10, "low": F.col("points") <= 10}  # both ends hold 10
    return signals.tagged_sums(facts, keys=["entity", "week"], segment="segment", tags=tags, measure="points")


@query(f"""WITH {WEEKLY}, g AS (SELECT week, position, {s_mean("points")} AS league_mean FROM w GROUP BY ALL)
    SELECT entity, week, position, points, league_mean, points - league_mean AS over_league,
        CASE WHEN points - league_mean > league_mean * CAST(0.15 AS DOUBLE) THEN 'easy' WHEN points - league_mean < -(league_mean * CAST(0.15 AS DOUBLE)) THEN 'tough' ELSE 'average' END AS grade FROM w JOIN g USING (week, position)""")
def over_league(spark, sf_dir):
    out = signals.over_league(weekly(spark, sf_dir), unit="entity", segment="position", week="week", measure="points")
    return out.withColumn("grade", schedule.grade_of(F.col("over_league"), F.col("league_mean") * 0.15))


@query(f"""WITH {WEEKLY}, m AS (SELECT entity, position, count(*) AS n, CAST(sum(week) AS DOUBLE) AS sx, {s_total("points")} AS sy, CAST(sum(week * week) AS DOUBLE) AS sxx,
        CAST(sum(CAST(week AS DECIMAL(18,4)) * CAST(CAST(points AS DECIMAL(18,4)) AS DECIMAL(19,4))) AS DOUBLE) AS sxy FROM w GROUP BY ALL),
    f AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM m WHERE n >= 4 AND n * sxx - sx * sx > 0)
    SELECT entity, position, n, slope, (sy - slope * sx) / n AS intercept FROM f""")
def trend_line(spark, sf_dir):
    return signals.trend_line(weekly(spark, sf_dir), keys=["entity", "position"], x="week", y="points")


@query("""WITH g AS (SELECT n.n_nationkey AS home, (n.n_nationkey + w) % 25 AS away, CAST(w AS INTEGER) AS week, n.n_regionkey AS home_coach, (n.n_regionkey + w) % 5 AS away_coach FROM nation n, range(1, 18) t(w))
    SELECT home AS unit, away AS opponent, 1 AS is_home, week, away_coach AS opponent_home_coach FROM g UNION ALL SELECT away, home, 0, week, home_coach FROM g""")
def edge_expand(spark, sf_dir):
    return schedule.both_directions(_games(spark, sf_dir), home="home", away="away", keep=["week"], swapped={"home_coach": "away_coach"})


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, w = F.col("n_nationkey"), F.col("n_regionkey"), F.col("week")
    weeks = table(spark, sf_dir, "nation").withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(17))))
    return weeks.select(n.cast("bigint").alias("home"), ((n + w) % 25).cast("bigint").alias("away"), "week", r.cast("bigint").alias("home_coach"), ((r + w) % 5).cast("bigint").alias("away_coach"))


@query("""SELECT l_suppkey AS unit, l_partkey AS opponent, 1 AS is_home, l_linenumber AS week FROM lineitem UNION ALL SELECT l_partkey, l_suppkey, 0, l_linenumber FROM lineitem""")
def edge_expand_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_linenumber").alias("week"))
    return schedule.both_directions(rows, home="l_suppkey", away="l_partkey", keep=["week"])


@query(f"""WITH {EVENTS}, u AS (SELECT DISTINCT entity FROM e), d AS (SELECT DISTINCT entity, week FROM e)
    SELECT u.entity, CAST(min(CASE WHEN d.week IS NULL THEN g END) AS INTEGER) AS gap FROM u CROSS JOIN range(1, 31) t(g) LEFT JOIN d ON d.entity = u.entity AND d.week = g GROUP BY u.entity""")
def gap_weeks(spark, sf_dir):
    return schedule.first_gap(events(spark, sf_dir), unit="entity", week="week", last=30)


DAILY = f"""{EVENTS}, dw AS (SELECT entity, week, {s_total("points")} AS points FROM e GROUP BY ALL),
    k AS (SELECT entity, week, CAST(row_number() OVER (PARTITION BY week ORDER BY points, entity) AS INTEGER) AS rank FROM dw)"""


def _daily_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = events(spark, sf_dir).groupBy("entity", "week").agg(total("points").alias("points"))
    return ranks.numbered(daily, value="points", tie=["entity"], within=["week"], name="rank").select("entity", "week", "rank")


@query(f"""WITH {DAILY} SELECT entity, count(rank) AS games, {s_mean("rank")} AS season_mean, {s_mean("CASE WHEN week BETWEEN 14 AND 17 THEN rank END")} AS playoff_mean,
    count(*) FILTER (rank >= 23) AS easy_games, count(*) FILTER (rank <= 10) AS tough_games FROM k GROUP BY entity""")
def schedule_strength(spark, sf_dir):
    return schedule.strength_summary(_daily_ranks(spark, sf_dir), unit=["entity"], week="week", rank="rank", playoff=(14, 17), easy=23, tough=10, digits=None)


@query(f"""WITH {DAILY}, p AS (SELECT a.entity AS unit, b.entity AS other, count(*) AS tough_weeks, {s_mean("b.rank")} AS mean_rank, count(*) FILTER (b.rank >= 21) AS easy_weeks
        FROM k a JOIN k b ON a.week = b.week AND a.entity <> b.entity WHERE a.rank <= 13 GROUP BY ALL)
    SELECT *, mean_rank + 3 * easy_weeks AS score, CAST(row_number() OVER (PARTITION BY unit ORDER BY mean_rank + 3 * easy_weeks DESC, other) AS INTEGER) AS place FROM p QUALIFY place <= 5""")
def complement_single(spark, sf_dir):
    return schedule.complements(_daily_ranks(spark, sf_dir), unit="entity", week="week", rank="rank", tough=13, easy=21, top=5).drop("looked_at")


@query(f"""WITH {DAILY}, ro AS (SELECT DISTINCT entity % 10 AS roster, entity AS unit, entity // 10 AS seat FROM e WHERE entity % 3 = 0), ca AS (SELECT DISTINCT r.roster, e.entity AS candidate FROM e, (SELECT DISTINCT roster FROM ro) r WHERE e.entity % 3 > 0),
    m AS (SELECT ca.roster, ca.candidate, ro.unit, ro.seat, count(*) AS tough_weeks, count(*) FILTER (c.rank >= 21) AS easy_weeks
        FROM ca JOIN ro USING (roster) JOIN k a ON a.entity = ro.unit AND a.rank <= 13 LEFT JOIN k c ON c.entity = ca.candidate AND c.week = a.week GROUP BY ALL)
    SELECT roster, candidate, unit, tough_weeks, easy_weeks FROM m QUALIFY row_number() OVER (PARTITION BY roster, candidate ORDER BY easy_weeks DESC, tough_weeks DESC, seat) = 1""")
def complement_best(spark, sf_dir):
    users = events(spark, sf_dir).select("entity").distinct()
    roster = users.where("entity % 3 = 0").select((F.col("entity") % 10).alias("roster"), F.col("entity").alias("unit"), F.expr("entity div 10").alias("seat"))
    candidates = roster.select("roster").distinct().crossJoin(users.where("entity % 3 > 0").select(F.col("entity").alias("candidate")))
    return schedule.best_pairing(candidates, roster, _daily_ranks(spark, sf_dir), unit="entity", week="week", rank="rank", tough=13, easy=21)


@query(f"""WITH {DAILY}, s AS (SELECT entity AS unit, (entity * 7 + week * 3) % 150 AS opponent, week FROM (SELECT DISTINCT entity, week FROM e)),
    c AS (SELECT a.unit AS entity, a.week, a.opponent FROM s a WHERE a.week BETWEEN 15 AND 17 AND a.opponent % 5 = 0)
    SELECT entity, string_agg('W' || week || ' vs ' || opponent, ', ' ORDER BY week, opponent) AS meetings FROM c WHERE entity % 5 <> 0 GROUP BY entity""")
def playoff_conflicts(spark, sf_dir):
    days = events(spark, sf_dir).select("entity", "week").distinct()
    games = days.select(F.col("entity").alias("unit"), ((F.col("entity") * 7 + F.col("week") * 3) % 150).alias("opponent"), "week")
    users = events(spark, sf_dir).select("entity").distinct()
    every = games.select(F.col("opponent").alias("unit")).unionByName(users.select(F.col("entity").alias("unit"))).distinct()
    return schedule.conflicts(games, every.where("unit % 5 = 0"), users.where("entity % 5 != 0").select("entity", F.col("entity").alias("unit")), week="week", weeks=(15, 17))


@query(f"""WITH {EVENTS}, g AS (SELECT DISTINCT entity AS unit, (entity * 7 + week * 3) % 150 AS opponent, week FROM e WHERE week BETWEEN 15 AND 17),
    r AS (SELECT c_custkey AS entity, c_custkey % 150 AS unit, CASE WHEN c_custkey % 9 > 0 THEN CAST(c_custkey * 7 % 1000 AS INTEGER) END AS rank FROM customer),
    b AS (SELECT *, CAST(row_number() OVER (PARTITION BY unit ORDER BY rank NULLS LAST, entity) AS INTEGER) AS place FROM r QUALIFY place <= 4)
    SELECT g.unit, week, opponent, place, b.entity, rank FROM g JOIN b ON b.unit = g.opponent""")
def playoff_opponents(spark, sf_dir):
    """The four best of each opponent in weeks 15 to 17."""
    e, k = events(spark, sf_dir), F.col("c_custkey")
    games = e.select(F.col("entity").alias("unit"), ((F.col("entity") * 7 + F.col("week") * 3) % 150).alias("opponent"), "week")
    ranked = table(spark, sf_dir, "customer").select(k.alias("entity"), (k % 150).alias("unit"), F.when(k % 9 > 0, (k * 7 % 1000).cast("int")).alias("rank"))
    return schedule.opponents_best(games, ranked, entity="entity", rank="rank", week="week", weeks=(15, 17))


FACTORS = f"""{EVENTS}, al AS (SELECT entity AS opponent, position AS segment, {s_total("points")} AS points FROM e GROUP BY ALL), lg AS (SELECT segment, {s_mean("points")} AS league FROM al GROUP BY segment),
    sc AS (SELECT DISTINCT entity AS unit, (entity * 7 + week * 3) % 160 AS opponent, week FROM e WHERE week <= 17),
    fa AS (SELECT unit, lg.segment, week, coalesce(points / nullif(league, 0), 1) AS factor FROM sc CROSS JOIN lg LEFT JOIN al ON al.opponent = sc.opponent AND al.segment = lg.segment)"""


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    allowed = e.groupBy(F.col("entity").alias("opponent"), F.col("position").alias("segment")).agg(total("points").alias("points"))
    games = e.select(F.col("entity").alias("unit"), ((F.col("entity") * 7 + F.col("week") * 3) % 160).alias("opponent"), "week").distinct()
    return schedule.matchup_factor(games, allowed, segment="segment", measure="points", last_week=17)


@query(f"WITH {FACTORS} SELECT unit, segment, week, factor FROM fa")
def matchup_factor(spark, sf_dir):
    return _factors(spark, sf_dir)


PPW = f"""{FACTORS}, en AS (SELECT entity, entity % 200 AS unit, position AS segment, {s_total("points")} AS total, {s_mean("points")} / 10 AS off, 1 + count(*) / CAST(100 AS DOUBLE) AS sig FROM e GROUP BY ALL),
    li AS (SELECT *, total / CAST(17 AS DOUBLE) AS base, (1 + CAST(0.3 AS DOUBLE) * (off - 1)) * least(greatest(sig, CAST(0.9 AS DOUBLE)), CAST(1.1 AS DOUBLE)) AS lift FROM en),
    ppw AS (SELECT entity, li.segment, fa.week, base * factor * lift AS points FROM li JOIN fa USING (unit, segment)
        UNION ALL SELECT entity, segment, CAST(g AS INTEGER), base * lift FROM li CROSS JOIN range(1, 18) t(g) WHERE (unit, segment) NOT IN (SELECT unit, segment FROM fa))"""


def _ppw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("entity", F.col("position").alias("segment")).agg(
        total("points").alias("total"), (mean("points") / 10).alias("off"), (1 + F.count("*") / F.lit(100.0)).alias("sig")
    )
    rows = rows.withColumn("unit", F.col("entity") % 200)
    return matchup.weekly_projection(rows, _factors(spark, sf_dir), total="total", segment="segment", offence="off", signal="sig", digits=None)


@query(f"WITH {PPW} SELECT entity, segment, week, points FROM ppw")
def weekly_ppw(spark, sf_dir):
    return _ppw(spark, sf_dir).select("entity", "segment", "week", "points")


@query(f"WITH {PPW} SELECT entity, segment, " + ", ".join(f"max(CASE WHEN week = {w} THEN points END) AS w{w}" for w in range(1, 18)) + " FROM ppw GROUP BY ALL")
def weekly_pivot(spark, sf_dir):
    return lineup.week_table(_ppw(spark, sf_dir), weeks=list(range(1, 18)), key=["entity", "segment"])


# Rosters over events: a user's five types are five entities of a roster with positions QB, RB, WR, TE; a user belongs to one of ten rosters.
STARTERS = {"QB": 1, "RB": 2, "WR": 3, "TE": 1}
POSITION = "CASE position WHEN 'view' THEN 'WR' WHEN 'click' THEN 'RB' WHEN 'error' THEN 'QB' WHEN 'signup' THEN 'TE' ELSE 'WR' END"
ROSTER = f"""{EVENTS}, pj AS (SELECT entity || position AS entity, {POSITION} AS position, week, {s_total("points")} AS points FROM e WHERE week <= 14 GROUP BY ALL),
    kn AS (SELECT entity || position AS entity, min({POSITION}) AS position, CAST(round({s_total("points")} / 30, 2) AS DOUBLE) AS base, CAST(min(entity) % 16 AS INTEGER) AS bye, min(e.entity) AS usr FROM e GROUP BY 1),
    wp AS (SELECT usr % 10 AS roster, usr, kn.entity, kn.position, CAST(g AS INTEGER) AS week, coalesce(pj.points, base) AS points FROM kn CROSS JOIN range(1, 15) t(g)
        LEFT JOIN pj ON pj.entity = kn.entity AND pj.week = g WHERE bye <> g),
    pl AS (SELECT *, row_number() OVER (PARTITION BY roster, week, position ORDER BY points DESC, entity) AS place FROM wp WHERE usr % 3 > 0),
    st AS (SELECT *, place <= CASE position WHEN 'QB' THEN 1 WHEN 'RB' THEN 2 WHEN 'WR' THEN 3 ELSE 1 END AS starts FROM pl),
    lw AS (SELECT roster, week, CAST(coalesce(sum(CAST(points AS DECIMAL(18,4))) FILTER (starts), 0) + coalesce(max(CAST(points AS DECIMAL(18,4))) FILTER (NOT starts AND position <> 'QB'), 0) AS DOUBLE) AS week_points FROM st GROUP BY ALL),
    sc AS (SELECT roster, CAST(sum(CAST(week_points AS DECIMAL(18,4))) AS DOUBLE) AS score FROM lw GROUP BY roster)"""


def _rosters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projections, rostered entities and free ones."""
    e = events(spark, sf_dir)
    name = F.concat(F.col("entity").cast("string"), F.col("position"))
    position = F.expr(POSITION)
    base = F.round(total("points") / 30, 2)
    known = e.groupBy(name.alias("name"), position.alias("place")).agg(base.alias("base"), (F.min("entity") % 16).cast("int").alias("bye"), F.min("entity").alias("usr"))
    values = e.where("week <= 14").groupBy(name.alias("name"), "week").agg(total("points").alias("points"))
    projections = known.join(values, "name", "left").select(F.col("name").alias("entity"), F.col("place").alias("position"), "week", "points", "base", "bye")
    seats = known.select((F.col("usr") % 10).alias("roster"), F.col("name").alias("entity"), "usr")
    return projections, seats.where("usr % 3 > 0").drop("usr"), seats.where("usr % 3 = 0").drop("usr")


@query(f"WITH {ROSTER} SELECT roster, week, week_points FROM lw")
def lineup_weeks(spark, sf_dir):
    projections, rosters, _ = _rosters(spark, sf_dir)
    return lineup.lineup_weeks(lineup.weekly_points(rosters, projections, roster=["roster"], weeks=14), roster=["roster"])


@query(f"WITH {ROSTER} SELECT roster, {s_round('score', 1)} AS score FROM sc")
def lineup_score(spark, sf_dir):
    projections, rosters, _ = _rosters(spark, sf_dir)
    return lineup.lineup_scores(rosters, projections, roster=["roster"])


@query(f"""WITH {ROSTER}, fr AS (SELECT DISTINCT roster, bye AS week FROM kn JOIN (SELECT DISTINCT entity, roster FROM wp WHERE usr % 3 > 0) USING (entity)),
    fl AS (SELECT lw.roster, lw.week, week_points, fr.week IS NOT NULL AS is_bye, fr.week IS NULL AND week_points > 0 AS usable FROM lw LEFT JOIN fr ON fr.roster = lw.roster AND fr.week = lw.week),
    tl AS (SELECT *, row_number() OVER (PARTITION BY roster ORDER BY usable DESC, week_points, week) AS place, {s_spread("CASE WHEN usable THEN week_points END", "OVER (PARTITION BY roster)", less=0)} AS spread FROM fl)
    SELECT roster, week, {s_round("week_points", 1)} AS week_points, CASE WHEN usable AND spread >= 2 AND place <= 5 THEN 'weak' WHEN is_bye THEN 'bye' ELSE '' END AS status FROM tl""")
def week_status(spark, sf_dir):
    projections, rosters, _ = _rosters(spark, sf_dir)
    weeks = lineup.lineup_weeks(lineup.weekly_points(rosters, projections, roster=["roster"], weeks=14), roster=["roster"])
    return lineup.week_status(weeks, rosters, projections, roster=["roster"])


@query(f"""WITH {ROSTER}, c AS (SELECT DISTINCT roster AS cr, entity AS ce FROM wp WHERE usr % 3 = 0),
    tw AS (SELECT c.cr, c.ce, x.position, x.week, x.points, x.entity FROM c JOIN wp x ON x.roster = c.cr AND (x.usr % 3 > 0 OR x.entity = c.ce)),
    tp AS (SELECT *, row_number() OVER (PARTITION BY cr, ce, week, position ORDER BY points DESC, entity) AS place FROM tw),
    ts AS (SELECT *, place <= CASE position WHEN 'QB' THEN 1 WHEN 'RB' THEN 2 WHEN 'WR' THEN 3 ELSE 1 END AS starts FROM tp),
    tl AS (SELECT cr, ce, week, CAST(coalesce(sum(CAST(points AS DECIMAL(18,4))) FILTER (starts), 0) + coalesce(max(CAST(points AS DECIMAL(18,4))) FILTER (NOT starts AND position <> 'QB'), 0) AS DOUBLE) AS wps FROM ts GROUP BY ALL),
    fr AS (SELECT DISTINCT roster, bye AS week FROM kn JOIN (SELECT DISTINCT entity, roster FROM wp WHERE usr % 3 > 0) USING (entity)),
    us AS (SELECT lw.roster, lw.week, week_points, row_number() OVER (PARTITION BY lw.roster ORDER BY week_points, lw.week) AS place, {s_spread("week_points", "OVER (PARTITION BY lw.roster)", less=0)} AS spread
        FROM lw LEFT JOIN fr ON fr.roster = lw.roster AND fr.week = lw.week WHERE fr.week IS NULL AND week_points > 0),
    g AS (SELECT cr AS roster, ce AS entity, CAST(sum(CAST(wps AS DECIMAL(18,4)) - CAST(coalesce(lw.week_points, 0) AS DECIMAL(18,4))) AS DOUBLE) AS gain,
        coalesce(CAST(sum(CAST({s_round("wps", 1)} AS DECIMAL(18,4)) - CAST({s_round("lw.week_points", 1)} AS DECIMAL(18,4))) FILTER (us.spread >= 2 AND us.place <= 5) AS DOUBLE), 0) AS weak_gain
        FROM tl LEFT JOIN lw ON lw.roster = cr AND lw.week = tl.week LEFT JOIN us ON us.roster = cr AND us.week = tl.week GROUP BY ALL)
    SELECT roster, entity, gain, weak_gain FROM g WHERE gain > 0""")
def marginal_value(spark, sf_dir):
    projections, rosters, free = _rosters(spark, sf_dir)
    return lineup.marginal_values(rosters, free, projections, roster="roster", digits=None).select("roster", "entity", "gain", "weak_gain")


@query(f"""WITH {ROSTER}, x AS (SELECT roster, entity, position, CAST(sum(CAST(points AS DECIMAL(18,4))) AS DOUBLE) AS value FROM wp WHERE usr % 3 = 0 GROUP BY ALL),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY roster, position ORDER BY value DESC, entity) <= 2)
    SELECT *, CAST(row_number() OVER (PARTITION BY roster ORDER BY value DESC, entity) AS INTEGER) AS place FROM y QUALIFY place <= 5""")
def raw_value_rank(spark, sf_dir):
    projections, _, free = _rosters(spark, sf_dir)
    return lineup.raw_value_rank(free, projections)


@query(f"""WITH {ROSTER}, y AS (SELECT roster % 2 AS league, roster, score FROM sc),
    z AS (SELECT *, CAST(row_number() OVER (PARTITION BY league ORDER BY score DESC, roster) AS INTEGER) AS place, count(*) OVER (PARTITION BY league) AS n_rosters, max(score) OVER (PARTITION BY league) - score AS behind_best,
        score - {s_total("score", "OVER (PARTITION BY league)")} / count(*) OVER (PARTITION BY league) AS over_mean FROM y)
    SELECT *, CASE WHEN place / n_rosters <= CAST(0.2 AS DOUBLE) THEN 'A' WHEN place / n_rosters <= CAST(0.4 AS DOUBLE) THEN 'B' WHEN place / n_rosters <= CAST(0.6 AS DOUBLE) THEN 'C' WHEN place / n_rosters <= CAST(0.8 AS DOUBLE) THEN 'D' ELSE 'F' END AS grade FROM z""")
def standings_grade(spark, sf_dir):
    projections, rosters, _ = _rosters(spark, sf_dir)
    scores = lineup.lineup_scores(rosters, projections, roster=["roster"], digits=None)
    return lineup.standings(scores.withColumn("league", F.col("roster") % 2), league="league", roster="roster")


OUTLOOK = f"""{EVENTS}, br AS (SELECT entity, position, count(*) FILTER (points >= CASE position WHEN 'click' THEN 20 WHEN 'view' THEN 12.5 ELSE 40 END) / CAST(count(*) AS DOUBLE) AS rate
        FROM e WHERE position IN ('click', 'view', 'purchase') GROUP BY ALL),
    mu AS (SELECT DISTINCT entity, position, week, (week - 15) / CAST(10 AS DOUBLE) AS advantage FROM e)"""


@query(f"""WITH {OUTLOOK} SELECT mu.entity, mu.position, mu.week, rate, CASE WHEN rate IS NOT NULL THEN least(greatest(rate * (1 + advantage), 0.0), CAST(0.95 AS DOUBLE)) END AS outlook FROM mu LEFT JOIN br USING (entity, position)""")
def boom_outlook(spark, sf_dir):
    e = events(spark, sf_dir)
    counted = F.expr("count_if(points >= threshold) / cast(count(*) as double)").alias("rate")
    prior = e.withColumn("threshold", features.threshold_of("position", THRESHOLDS)).where("threshold IS NOT NULL").groupBy("entity", "position").agg(counted)
    matchups = e.select("entity", "position", "week").distinct().withColumn("advantage", (F.col("week") - 15) / F.lit(10.0))
    return features.boom_outlook(prior, matchups, on=["entity", "position"], rate="rate", advantage="advantage").select("entity", "position", "week", "rate", "outlook")


@query(f"""WITH {EVENTS}, t AS (SELECT entity, position, {s_total("points")} AS season_total FROM e GROUP BY ALL), g AS (SELECT position, {s_mean("season_total")} AS league_mean FROM t GROUP BY position)
    SELECT entity, position, season_total, league_mean, season_total - league_mean AS difference,
        CASE WHEN season_total - league_mean > league_mean * CAST(0.1 AS DOUBLE) THEN 'easy' WHEN season_total - league_mean < -(league_mean * CAST(0.1 AS DOUBLE)) THEN 'tough' ELSE 'average' END AS grade FROM t JOIN g USING (position)""")
def season_totals(spark, sf_dir):
    totals = events(spark, sf_dir).groupBy("entity", "position").agg(total("points").alias("season_total"))
    league = totals.groupBy("position").agg(mean("season_total").alias("league_mean"))
    out = totals.join(league, "position").withColumn("difference", F.col("season_total") - F.col("league_mean"))
    return out.withColumn("grade", schedule.grade_of(F.col("difference"), F.col("league_mean") * 0.1))


@query(f"""WITH {EVENTS}, a AS (SELECT entity FROM e WHERE position = 'purchase' GROUP BY entity HAVING max(points) >= 40), b AS (SELECT entity FROM e WHERE position = 'signup' GROUP BY entity HAVING max(points) >= 40)
    SELECT entity, 'both' AS side FROM a INTERSECT SELECT entity, 'both' FROM b UNION ALL SELECT entity, 'first' FROM a WHERE entity NOT IN (SELECT entity FROM b)""")
def set_operations(spark, sf_dir):
    """Users whose best purchase, or best signup, reaches 40."""
    best = events(spark, sf_dir).groupBy("entity", "position").agg(F.max("points").alias("best")).where("best >= 40")
    a, b = (best.where(F.col("position") == p).select("entity") for p in ("purchase", "signup"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.join(b, "entity", "left_anti").withColumn("side", F.lit("first")))


@query(f"""WITH {WEEKLY} SELECT entity, week, position, points FROM w ORDER BY points DESC, entity, week, position LIMIT 40""")
def top_n_global(spark, sf_dir):
    """A top-k report: the forty best weeks."""
    return weekly(spark, sf_dir).select("entity", "week", "position", "points").orderBy(F.col("points").desc(), "entity", "week", "position").limit(40)


@query(f"""WITH {EVENTS}, v AS (SELECT entity, {s_mean("points")} AS mean_points, {s_spread("points")} AS std_points, count(points) AS n,
        CASE WHEN count(week) >= 4 THEN {s_round(s_spread("week"), 1)} END AS share_std FROM e WHERE points IS NOT NULL GROUP BY ALL HAVING count(points) >= 4)
    SELECT *, {s_round("CASE WHEN mean_points > 1 THEN std_points / mean_points END", 2)} AS cv FROM v""")
def consistency_share(spark, sf_dir):
    """The day of the month stands for the share whose steadiness is measured."""
    return features.consistency(events(spark, sf_dir), keys=["entity"], measure="points", share="week", digits=(2, 1))


@query(f"""WITH {EVENTS}, a AS (SELECT entity, {s_mean("points")} / 50 AS signal FROM e WHERE position = 'click' GROUP BY entity), b AS (SELECT entity, {s_mean("points")} / 40 AS signal FROM e WHERE position = 'view' GROUP BY entity)
    SELECT coalesce(b.entity, a.entity) AS entity, coalesce(b.signal, a.signal) AS signal FROM a FULL JOIN b ON a.entity = b.entity""")
def later_signal(spark, sf_dir):
    e = events(spark, sf_dir)
    parts = [e.where(c).groupBy("entity").agg((mean("points") / d).alias("signal")) for c, d in (("position = 'click'", 50), ("position = 'view'", 40))]
    return signals.later_wins(parts, key=["entity"])


LOGS = "g AS (SELECT event_id, user_id AS entity, event_type AS position, ts, ln(1 + value) AS x FROM events)"


@query(f"""WITH {LOGS} SELECT entity, position, count(*) AS n, round(sum(x), 6) AS x_sum, round(avg(x), 8) AS x_mean, round(stddev_samp(x), 8) AS x_std FROM g GROUP BY ALL""", places=None)
def rollup_of_logs(spark, sf_dir):
    """Sums, means and deviations in double precision, of a measure of no known scale."""
    rows = events(spark, sf_dir).withColumn("x", F.log(1 + F.col("points")))
    found = rows.groupBy("entity", "position").agg(F.count("*").alias("n"), total("x").alias("x_sum"), mean("x").alias("x_mean"), std_samp("x").alias("x_std"))
    return found.select("entity", "position", "n", F.round("x_sum", 6).alias("x_sum"), F.round("x_mean", 8).alias("x_mean"), F.round("x_std", 8).alias("x_std"))


@query(f"""WITH {LOGS} SELECT event_id, round(avg(x) {NEAR}, 8) AS x_roll, round(stddev_samp(x) {NEAR}, 6) AS x_roll_std, round(avg(x) {PAST}, 8) AS x_past FROM g""", places=None)
def lagged_logs(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("x", F.log(1 + F.col("points")))
    out = features.lagged(rows, keys=["entity", "position"], order=["ts", "event_id"], measures=["x"])
    return out.select("event_id", F.round("x_roll", 8).alias("x_roll"), F.round("x_roll_std", 6).alias("x_roll_std"), F.round("x_past", 8).alias("x_past"))


@query(f"""WITH {EVENTS}, g AS (SELECT entity, week, sum(ln(1 + points)) AS y FROM e GROUP BY ALL), f AS (SELECT entity, count(*) AS n, regr_slope(y, week) AS slope, regr_intercept(y, week) AS intercept FROM g GROUP BY entity HAVING count(*) >= 4 AND var_pop(week) > 0)
    SELECT entity, n, round(slope, 7) AS slope, round(intercept, 6) AS intercept FROM f""", places=None)
def trend_of_logs(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("entity", "week").agg(total(F.log(1 + F.col("points"))).alias("y"))
    return signals.trend_line(rows, keys=["entity"], x="week", y="y").select("entity", "n", F.round("slope", 7).alias("slope"), F.round("intercept", 6).alias("intercept"))
