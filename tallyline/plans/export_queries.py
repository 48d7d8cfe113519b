"""Queries over files: the given tables written as exports, with the traps of such files, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import scratch_folder
from ..sources import exports
from .base import query, table


def put(df: DataFrame, header: list[str], folder: str, *, group: list[str] | None = None) -> str:
    """Writes ``df`` as CSV files, each with a group row, where one is given, and the header, whose names may repeat."""
    head = [",".join(row) for row in ([group] if group else []) + [header]]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of the row within its file
    lines = df.select(F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns])).alias("line"), place.alias("place"))
    lines.select(F.explode(F.when(F.col("place") == 0, F.array(*map(F.lit, head), F.col("line"))).otherwise(F.array("line"))).alias("value")).write.text(folder)
    return folder


def text(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(prefix), x.cast("string"))


@query("SELECT 'C' || o_custkey AS name, CAST(month(o_orderdate) AS DOUBLE) AS week, o_totalprice AS fp, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def export_years(spark, sf_dir):
    """Yearly files; the years without one are skipped."""
    rows = table(spark, sf_dir, "orders").select(text("C", F.col("o_custkey")).alias("Name"), F.month("o_orderdate").alias("WEEK"), F.col("o_totalprice").alias("FP"), F.year("o_orderdate").alias("y"))
    place = scratch_folder(spark, "years")
    rows.write.partitionBy("y").option("header", True).csv(place)
    return exports.read_years(spark, {y: f"{place}/y={y}" for y in range(1990, 2006)})


POSITIONS = "CASE event_type WHEN 'click' THEN 'RB' WHEN 'signup' THEN 'TE' WHEN 'error' THEN 'QB' ELSE 'WR' END"
FACTS = f"""f AS (SELECT 'U' || user_id AS name, {POSITIONS} AS pos, CAST(nullif(day(ts), 28) AS DOUBLE) AS week, CASE WHEN user_id % 9 > 0 THEN 'T' || user_id % 25 END AS opponent,
    value AS fp, CAST(user_id % 100 AS DOUBLE) AS slot_rte_pct, CAST(100 - user_id % 100 AS DOUBLE) AS wide_rte_pct FROM events)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of the month stands for rows without a week."""
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        text("U", u).alias("name"), F.expr(POSITIONS).alias("pos"), F.nullif(F.dayofmonth("ts"), F.lit(28)).alias("week"), F.when(u % 9 > 0, text("T", u % 25)).alias("opponent"),
        F.col("value").alias("fp"), (u % 100).alias("slot"), (100 - u % 100).alias("wide"),
    )


@query(f"WITH {FACTS} SELECT name, pos, week, fp FROM f WHERE week IS NOT NULL")
def export_positions(spark, sf_dir):
    """Three files that hold more positions than theirs, each position taken of one of them."""
    rows, place = _facts(spark, sf_dir).select("name", "pos", "week", "fp"), scratch_folder(spark, "positions")
    held = {"rushing": ["RB", "QB"], "receiving": ["WR", "TE", "RB"], "passing": ["QB", "WR", "RB", "TE"]}
    read = []
    for kind, positions in held.items():
        path = put(rows.where(F.col("pos").isin(positions)), ["Name", "POS", "WEEK", "FP"], f"{place}/{kind}", group=["Player", "", "Game", ""])
        read.append(exports.read_export(spark, path))
    return exports.all_positions(*read)


@query(f"WITH {FACTS} SELECT name, pos, week, opponent, fp, slot_rte_pct, wide_rte_pct FROM f WHERE week IS NOT NULL AND opponent IS NOT NULL AND fp IS NOT NULL")
def export_opponents(spark, sf_dir):
    path = put(_facts(spark, sf_dir), ["Name", "POS", "WEEK", "Opponent", "FP", "SLOT RTE %", "WIDE RTE %"], scratch_folder(spark, "opponents"), group=["Player", "", "", "", "", "Routes", ""])
    return exports.weekly_opponents(exports.read_export(spark, path))


SPLIT_COLUMNS = [f"{m}_{s}" for s in exports.SPLITS for m in ("rte", "tprr", "yprr", "fp_per_rr")]


@query(f"""WITH t(team, shift) AS (VALUES ('A', 0), ('B', 5)), r AS (SELECT 'S' || s_suppkey AS name, team, 'WR' AS pos, {", ".join(f"CAST((s_suppkey * {k + 1} + shift) % 97 AS DOUBLE) AS {c}" for k, c in enumerate(SPLIT_COLUMNS))} FROM supplier, t)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY name, pos ORDER BY rte_overall DESC, team DESC) = 1""")
def export_splits(spark, sf_dir):
    """Four measures under five times the same names, and two rows of each player."""
    teams = F.explode(F.array(F.struct(F.lit("A").alias("team"), F.lit(0).alias("shift")), F.struct(F.lit("B").alias("team"), F.lit(5).alias("shift")))).alias("t")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", teams)
    values = [((F.col("s_suppkey") * (k + 1) + F.col("t.shift")) % 97).alias(c) for k, c in enumerate(SPLIT_COLUMNS)]
    rows = rows.select(text("S", F.col("s_suppkey")).alias("name"), F.col("t.team").alias("team"), F.lit("WR").alias("pos"), *values)
    path = put(rows, ["Name", "Team", "POS", *["RTE", "TPRR", "YPRR", "FP/RR"] * 5], scratch_folder(spark, "splits"), group=["Player", "", "", *["x"] * 20])
    return exports.coverage_splits(spark, path)


@query("SELECT CAST(p_partkey AS DOUBLE) AS rank, 'P' || p_partkey AS name, p_brand AS pos, p_retailprice AS sep, CAST(p_size AS DOUBLE) AS sep_1 FROM part")
def export_separation(spark, sf_dir):
    """Several files, each with its own header rows, and a name that comes twice."""
    rows = table(spark, sf_dir, "part").select("p_partkey", text("P", F.col("p_partkey")).alias("name"), "p_brand", "p_retailprice", "p_size").repartition(5, "p_partkey")
    return exports.read_export(spark, put(rows, ["Rank", "Name", "POS", "SEP", "SEP"], scratch_folder(spark, "separation"), group=["", "Player", "", "Man", "Zone"]))


TEAMS = "tm AS (SELECT 'N' || n_nationkey AS abbrev, n_name AS full_name, n_nationkey FROM nation)"
TEAM_NAME = "CASE s_suppkey % 4 WHEN 0 THEN full_name WHEN 1 THEN 'Old ' || full_name WHEN 2 THEN abbrev ELSE 'Unknown ' || s_suppkey END"
TEAM_CODE = "CASE WHEN s_suppkey % 4 < 3 THEN abbrev ELSE 'Unknown ' || s_suppkey END"


def _teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(text("N", F.col("n_nationkey")).alias("abbrev"), F.col("n_name").alias("full_name"), F.array(F.concat(F.lit("Old "), "n_name")).alias("alias"), "n_nationkey")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a team's name, old name, code, or an unknown name."""
    rows = table(spark, sf_dir, "supplier").join(_teams(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.withColumn("team_name", F.expr(TEAM_NAME))


@query(f"""WITH {TEAMS} SELECT CAST(s_suppkey AS DOUBLE) AS rank, {TEAM_NAME} AS name, {TEAM_CODE} AS team, CAST(s_suppkey % 60 AS DOUBLE) AS man_pct, s_acctbal AS fp_per_db_man, s_acctbal + 1 AS fp_per_db_zone, s_acctbal + 2 AS fp_per_db_high1
    FROM supplier JOIN tm ON n_nationkey = s_nationkey""")
def export_matrix(spark, sf_dir):
    b = F.col("s_acctbal")
    rows = _named(spark, sf_dir).select("s_suppkey", "team_name", (F.col("s_suppkey") % 60).alias("m"), b.alias("a"), F.lit(40).alias("z"), (b + 1).alias("b"), F.lit(30).alias("h"), (b + 2).alias("c"), F.lit(20).alias("g"), (b + 3).alias("d"))
    path = put(rows, ["Rank", "Name", "MAN %", "FP/DB", "ZONE %", "FP/DB", "1-HI %", "FP/DB", "2-HI %", "FP/DB"], scratch_folder(spark, "matrix"), group=["Team", "", *["Coverage", ""] * 4])
    return exports.coverage_matrix(spark, path, _teams(spark, sf_dir)).select("rank", "name", "team", "man_pct", "fp_per_db_man", "fp_per_db_zone", "fp_per_db_high1")


@query(f"""WITH {TEAMS} SELECT CAST(2020 + s_suppkey % 6 AS INTEGER) AS season, {TEAM_NAME} AS team, {TEAM_CODE} AS team_code, s_name AS offensive_coordinator, 'new, since ' || s_suppkey AS notes FROM supplier JOIN tm ON n_nationkey = s_nationkey""")
def export_coordinators(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = _named(spark, sf_dir).select((2020 + k % 6).alias("season"), "team_name", F.lit("x").alias("c"), F.lit("y").alias("d"), "s_name", F.lit(None).cast("string").alias("p"), F.lit("z").alias("dc"), text("new, since ", k).alias("notes"))
    path = put(rows, ["season", "team", "conference", "division", "offensive_coordinator", "oc_play_caller", "defensive_coordinator", "notes"], scratch_folder(spark, "coordinators"))
    return exports.coordinators(spark, path, _teams(spark, sf_dir)).select("season", "team", "team_code", "offensive_coordinator", "notes")


@query("""SELECT CAST(month(o_orderdate) AS INTEGER) AS week, 'N' || h.n_nationkey AS home, 'N' || a.n_nationkey AS away, h.n_name || ' dc' AS home_dc, CASE WHEN o_orderkey % 2 = 0 THEN a.n_name || ' dc' END AS away_dc
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation h ON h.n_nationkey = c_nationkey JOIN nation a ON a.n_nationkey = (c_nationkey + o_orderkey % 24 + 1) % 25""")
def export_schedule(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    home, away = (nation.select(F.col("n_nationkey").alias(f"{s}_key"), F.col("n_name").alias(f"{s}_team")) for s in ("home", "away"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(home, F.col("c_nationkey") == F.col("home_key")).join(away, (F.col("c_nationkey") + F.col("o_orderkey") % 24 + 1) % 25 == F.col("away_key"))
    rows = rows.select(F.month("o_orderdate").alias("week"), "home_team", "away_team", F.concat("home_team", F.lit(" dc")).alias("home_dc"), F.when(F.col("o_orderkey") % 2 == 0, F.concat("away_team", F.lit(" dc"))).alias("away_dc"))
    return exports.schedule(spark, put(rows, ["week", "home_team", "away_team", "home_dc", "away_dc"], scratch_folder(spark, "schedule")), _teams(spark, sf_dir))


PROJECTIONS = """SELECT 'P' || p_partkey AS name, p_brand AS position, 'N' || p_partkey % 25 AS team, CAST(CASE WHEN p_size % 5 > 0 THEN p_size END AS INTEGER) AS bye, p_retailprice AS points,
    CAST(greatest(p_size % 18, 1) AS DOUBLE) AS games, p_retailprice / 16 AS per_game FROM part"""


def _projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    rows = table(spark, sf_dir, "part").select(text("P", k).alias("name"), "p_brand", text("N", k % 25).alias("team"), F.when(size % 5 > 0, size).alias("bye"), F.lit(1).alias("pos"), price.alias("points"), F.nullif(size % 18, F.lit(0)).alias("gp"), (price / 16).alias("per_game"))
    path = put(rows, ["NAME", "Position", "Team", "BYE", "POS", "FPTS", "GP", "FPTS/G"], scratch_folder(spark, "projections"), group=["Player", *[""] * 7])
    return exports.season_projections(spark, path)


@query(PROJECTIONS)
def export_projections(spark, sf_dir):
    """A file with two columns of one name, one of them told apart by its case."""
    return _projections(spark, sf_dir)


@query(PROJECTIONS)
def projections_read_back(spark, sf_dir):
    """The projections written by the sink, as CSV and by position, and read back."""
    place = scratch_folder(spark, "own")
    exports.write_table(_projections(spark, sf_dir), place, kind="csv", partition_by=["position"])
    return exports.read_projections(spark, place, "name string, team string, bye int, points double, games double, per_game double, position string")


@query("SELECT 'P' || p_partkey AS name, 'RB' || p_size AS position, CAST(p_size AS INTEGER) AS positional_rank, CAST(p_partkey AS DOUBLE) AS market, p_retailprice AS adp FROM part")
def export_rankings(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(text("P", k).alias("name"), k.alias("id"), F.lit("RB").alias("pos"), F.lit("KC").alias("team"), "p_retailprice", k.alias("overall"), text("RB", F.col("p_size")).alias("position"))
    path = put(rows, ["NAME", "ID", "POS", "Team", "ADP", "OVERALL", "POSITION"], scratch_folder(spark, "rankings"))
    return exports.market_rankings(spark, path).select("name", "position", "positional_rank", "market", "adp")


SEGMENTS = ["QB", "RB", "TE", "WR", "WR_Slot", "WR_Wide"]


@query(f"""WITH s(segment, k) AS (VALUES {", ".join(f"('{s}', {k})" for k, s in enumerate(SEGMENTS))}) SELECT 'S' || s_suppkey AS name, segment, CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) END AS g, s_acctbal * (k + 1) AS fp FROM supplier, s""")
def export_allowed(spark, sf_dir):
    """Six files of two layouts, the segment told by the file."""
    place, paths = scratch_folder(spark, "allowed"), {}
    for k, segment in enumerate(SEGMENTS):
        more = [F.lit(k).alias("g")] if k % 2 == 0 else []
        rows = table(spark, sf_dir, "supplier").select("s_suppkey", text("S", F.col("s_suppkey")).alias("name"), *more, (F.col("s_acctbal") * (k + 1)).alias("fp"))
        paths[segment] = put(rows, ["Rank", "Name", *(["G"] if more else []), "FP"], f"{place}/{segment}")
    return exports.points_allowed(spark, paths).select("name", "segment", "g", "fp")


@query("""SELECT CAST(o_orderkey % 3 AS INTEGER) AS lobby, 'picks' AS side, 'C' || o_custkey AS name, o_totalprice AS value FROM orders WHERE o_orderkey % 3 < 2
    UNION ALL SELECT CAST(s_suppkey % 2 AS INTEGER), 'standings', 'S' || s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 2, 'only picks', NULL, NULL UNION ALL SELECT 7, 'only standings', NULL, NULL""")
def export_pairs(spark, sf_dir):
    """Drafts 0 and 1 have both files, 2 and 7 one of them."""
    place = scratch_folder(spark, "pairs")
    number = lambda n: f" ({n})" if n else ""
    picks, teams = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    for n in range(3):
        rows = picks.where(F.col("o_orderkey") % 3 == n).select(F.lit(1).alias("p"), text("C", F.col("o_custkey")).alias("c"), "o_totalprice")
        put(rows, ["Pick", "Player", "ADP"], f"{place}/draft_analysis{number(n)}.csv")
    for n in (0, 1, 7):
        rows = teams.where(F.col("s_suppkey") % 2 == n % 2).select(F.lit(1).alias("r"), text("S", F.col("s_suppkey")).alias("t"), "s_acctbal")
        put(rows, ["Rank", "My Team", "Proj Pts"], f"{place}/league_standings{number(n)}.csv")
    a, b, alone = exports.draft_exports(spark, f"{place}/draft_analysis*.csv", f"{place}/league_standings*.csv")
    out = a.select("lobby", F.lit("picks").alias("side"), F.col("player").alias("name"), F.col("adp").alias("value"))
    out = out.unionByName(b.select("lobby", F.lit("standings").alias("side"), F.col("my_team").alias("name"), F.col("proj_pts").alias("value")))
    return out.unionByName(alone.select("lobby", text("only ", F.col("only_in")).alias("side")), allowMissingColumns=True)


@query("SELECT 'P' || p_partkey AS name, p_brand AS pos, CASE WHEN p_size % 4 = 0 THEN 15.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS g, p_retailprice AS fpts FROM part")
def export_outside(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", text("P", F.col("p_partkey")).alias("name"), F.lit("KC").alias("t"), "p_brand", F.when(size % 4 > 0, size).alias("g"), "p_retailprice")
    return exports.outside_ranking(spark, put(rows, ["RK", "Name", "Team", "POS", "G", "FPTS"], scratch_folder(spark, "outside"))).select("name", "pos", "g", "fpts")


@query("""SELECT 'brands' AS name, p_brand AS label, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'sizes', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size UNION ALL SELECT 'parts', 'P' || p_partkey, CAST(p_size AS BIGINT) FROM part""")
def sinks_read_back(spark, sf_dir):
    """Several tables in one folder, and one with columns that need not be there, in order."""
    part, place = table(spark, sf_dir, "part"), scratch_folder(spark, "sinks")
    tables = {"brands": part.groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n")), "sizes": part.groupBy(F.col("p_size").cast("string").alias("label")).agg(F.count("*").alias("n"))}
    exports.write_tables(tables, place)
    one = part.select(text("P", F.col("p_partkey")).alias("label"), F.col("p_size").cast("bigint").alias("n"), "p_brand")
    exports.write_table(one, f"{place}/parts", kind="csv", columns=["label", "absent", "n"], order=["n", "label"])
    out = spark.read.option("header", True).schema("label string, n bigint").csv(f"{place}/parts").withColumn("name", F.lit("parts"))
    for name in tables:
        out = out.unionByName(spark.read.parquet(f"{place}/{name}").withColumn("name", F.lit(name)))
    return out.select("name", "label", "n")
