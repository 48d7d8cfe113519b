"""CSV exports with one or two header rows, read as text by position and cast with try_cast; and the sinks.

The header row is looked up once per file layout (the first lines of one file reach the driver); the rows are read by
Spark without a header, so repeated column names and group rows do no harm.
"""

from __future__ import annotations

import csv
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import existing, number

HEAD_LINES = 4


def snake(name: str) -> str:
    """'FP/G' -> 'fp_per_g', 'TGT %' -> 'tgt_pct'."""
    words = name.strip().lower().replace("%", " pct ").replace("/", " per ").replace("#", " no ")
    return re.sub(r"[^a-z0-9]+", "_", words).strip("_") or "column"


def unique_names(header: list[str]) -> list[str]:
    """Snake-case names; the second and later ones of a name get _1, _2, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in map(snake, header):
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(name if k == 0 else f"{name}_{k}")
    return out


def _head(spark: SparkSession, path: str, key: str) -> tuple[list[list[str]], list[str]]:
    """Rows up to the header (its last), which is the first row with ``key`` among its cells."""
    lines = [r[0].lstrip("﻿") for r in spark.read.text(path).limit(HEAD_LINES).collect()]
    rows = list(csv.reader(lines))
    for k, row in enumerate(rows):
        if key in (c.strip() for c in row):
            return rows[: k + 1], row
    raise ValueError(f"no header with {key!r} in the first {HEAD_LINES} lines of {path}")


def read_export(spark: SparkSession, path: str, *, key: str = "Name", names: list[str] | None = None, text: list[str] | None = None, file_name: bool = False) -> DataFrame:
    """A file, or files of one layout: snake-case columns by position (``names`` overrides them), numbers by try_cast
    except in ``text`` columns, which are trimmed. Group rows, header rows (repeated ones too) and rows without a key are
    dropped. With ``file_name``, a column of that name holds the file's path."""
    head, header = _head(spark, path, key)
    columns = names or unique_names(header)
    key_column = columns[[c.strip() for c in header].index(key)]
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path, header=False, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if file_name:
        raw = raw.select(*columns, F.col("_metadata.file_path").alias("file_name"))
    rows = raw.where(F.col(key_column).isNotNull() & (F.trim(key_column) != "") & (F.trim(key_column) != key))
    for row in head[:-1]:  # group rows
        same = [F.coalesce(F.ltrim(F.col(c), F.lit("﻿")), F.lit("")) == v.strip() for c, v in zip(columns, row, strict=False)]
        condition = same[0]
        for x in same[1:]:
            condition = condition & x
        rows = rows.where(~condition)
    words = set(text if text is not None else ["name", "team", "pos", "position", "opponent", "location", "team_name", "season_name"]) | {key_column}
    return rows.select(*[F.trim(c).alias(c) if c in words else number(c).alias(c) for c in columns], *(["file_name"] if file_name else []))


def read_years(spark: SparkSession, paths: dict[int, str], *, key: str = "Name", text: list[str] | None = None) -> DataFrame | None:
    """Yearly files with an added year, united by name (absent columns null); years without a file are skipped, and None
    comes back where no year has one."""
    out = None
    for year, path in sorted(paths.items()):
        try:
            one = read_export(spark, path, key=key, text=text).withColumn("year", F.lit(year))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def weekly_facts(facts: DataFrame, *, positions: list[str] | None = None, required: tuple[str, ...] = ("name", "week")) -> DataFrame:
    """Weekly rows with all required columns, of the given positions: receiving, rushing, passing and later exports."""
    for c in required:
        facts = facts.where(F.col(c).isNotNull())
    return facts if positions is None else facts.where(F.col("pos").isin(positions))


def weekly_opponents(facts: DataFrame) -> DataFrame:
    """Weekly rows that have a week, points and an opponent."""
    return weekly_facts(facts, required=("week", "fp", "opponent"))


def all_positions(rushing: DataFrame | None, receiving: DataFrame | None, passing: DataFrame | None) -> DataFrame:
    """Weekly history of all positions without double counting: RB of rushing, WR and TE of receiving, QB of passing;
    a missing source is left out."""
    out = None
    for df, positions in ((rushing, ["RB"]), (receiving, ["WR", "TE"]), (passing, ["QB"])):
        if df is not None:
            part = weekly_facts(df, positions=positions)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source of weekly facts")
    return out


SPLITS = ("overall", "man", "zone", "high1", "high2")


def coverage_splits(spark: SparkSession, path: str, *, measures: tuple[str, ...] = ("rte", "tprr", "yprr", "fp_per_rr"), lead: tuple[str, ...] = ("name", "team", "pos")) -> DataFrame:
    """Player splits: the measures come five times under one name and are told apart by position only. Repeated
    (name, pos) are cut to the row with the most routes overall."""
    names = [*lead, *(f"{m}_{s}" for s in SPLITS for m in measures)]
    rows = read_export(spark, path, names=names, text=list(lead))
    best = F.max_by(F.struct(*names), F.struct(F.coalesce(f"{measures[0]}_overall", F.lit(-1.0)), F.col("team")))
    return rows.groupBy("name", "pos").agg(best.alias("r")).select("r.*")


def coverage_matrix(spark: SparkSession, path: str, teams: DataFrame) -> DataFrame:
    """Defensive coverage of teams: the four columns of one name become fp_per_db_man, _zone, _high1, _high2, and the
    team's code is added."""
    rows = read_export(spark, path, text=["name", "location", "team_name"])
    renames = dict(zip(["fp_per_db", "fp_per_db_1", "fp_per_db_2", "fp_per_db_3"], ["fp_per_db_man", "fp_per_db_zone", "fp_per_db_high1", "fp_per_db_high2"], strict=True))
    return with_team_code(rows.withColumnsRenamed({k: v for k, v in renames.items() if k in rows.columns}), teams, name="name")


def with_team_code(df: DataFrame, teams: DataFrame, *, name: str, code: str = "team", pass_through: bool = True) -> DataFrame:
    """Adds the code of a team's name or alias (teams: abbrev, full_name, alias array); an unknown name stays itself or,
    without ``pass_through``, becomes null."""
    keys = teams.select("abbrev", F.explode(F.array_distinct(F.concat(F.array("full_name", "abbrev"), F.coalesce("alias", F.array().cast("array<string>"))))).alias("known"))
    one = keys.groupBy("known").agg(F.min("abbrev").alias("abbrev"))
    joined = df.join(one, F.trim(F.col(name)) == F.col("known"), "left").drop("known")
    return joined.withColumn(code, F.coalesce("abbrev", F.col(name)) if pass_through else F.col("abbrev")).drop("abbrev")


def coordinators(spark: SparkSession, path: str, teams: DataFrame) -> DataFrame:
    text = ["season", "team", "conference", "division", "offensive_coordinator", "oc_play_caller", "defensive_coordinator", "notes"]
    rows = read_export(spark, path, key="team", text=text)
    return with_team_code(rows.withColumn("season", number("season", "int")), teams, name="team", code="team_code")


def schedule(spark: SparkSession, path: str, teams: DataFrame) -> DataFrame:
    """week, home, away (codes), and the coordinators of both sides."""
    rows = read_export(spark, path, key="week", text=["week", "home_team", "away_team", "home_dc", "away_dc"]).withColumn("week", number("week", "int"))
    rows = with_team_code(with_team_code(rows, teams, name="home_team", code="home"), teams, name="away_team", code="away")
    return rows.select("week", "home", "away", *existing(rows, ["home_dc", "away_dc"]))


def season_projections(spark: SparkSession, path: str) -> DataFrame:
    """name, position, team, bye, points, games (1 at least), per_game; the rank column that is also called POS is left out."""
    rows = read_export(spark, path, key="NAME", text=["name", "position", "team"])
    games = F.greatest(F.coalesce(F.col("gp"), F.lit(1.0)), F.lit(1.0))
    return rows.select("name", "position", "team", F.col("bye").cast("int").alias("bye"), F.col("fpts").alias("points"), games.alias("games"), F.col("fpts_per_g").alias("per_game"))


def market_rankings(spark: SparkSession, path: str) -> DataFrame:
    """Rankings with positional_rank taken from texts as RB12."""
    rows = read_export(spark, path, key="NAME", text=["name", "id", "pos", "team", "position"])
    rank = F.col("overall") if "overall" in rows.columns else F.col("adp")
    return rows.withColumns({"positional_rank": number(F.regexp_extract("position", r"(\d+)$", 1), "int"), "market": rank})


def points_allowed(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Points allowed by segment: one table with the segment as a column."""
    out = None
    for segment, path in sorted(paths.items()):
        one = read_export(spark, path, text=["name", "location", "team_name", "pos"]).withColumn("segment", F.lit(segment))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def outside_ranking(spark: SparkSession, path: str, *, default_games: float = 15.0) -> DataFrame:
    rows = read_export(spark, path, text=["name", "team", "pos"])
    return rows.withColumn("g", F.coalesce("g", F.lit(default_games)))


def draft_exports(spark: SparkSession, picks: str, standings: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Picks and standings of all drafts with their number as lobby ('(n)' of the file name, else 0), those of matched
    pairs only, and the unmatched numbers."""
    lobby = F.coalesce(number(F.regexp_extract("file_name", r"(?:\(|%28)(\d+)(?:\)|%29)[^/]*(?:/part-[^/]*)?$", 1), "int"), F.lit(0)).alias("lobby")
    sides = []
    for path, key, text in ((picks, "Player", ["player", "pos", "nfl_team", "my_pick"]), (standings, "Rank", ["my_team"])):
        df = read_export(spark, path, key=key, text=text, file_name=True)
        if key == "Rank":
            df = df.withColumn("rank", number("rank"))
        sides.append(df.select(lobby, *[c for c in df.columns if c != "file_name"]))
    a, b = (s.select("lobby").distinct() for s in sides)
    alone = a.join(b, "lobby", "left_anti").withColumn("only_in", F.lit("picks")).unionByName(b.join(a, "lobby", "left_anti").withColumn("only_in", F.lit("standings")))
    both = a.join(b, "lobby", "left_semi")
    return sides[0].join(both, "lobby", "left_semi"), sides[1].join(both, "lobby", "left_semi"), alone


def read_projections(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that ``write_table`` wrote as CSV with a header, partition columns included."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, *, kind: str = "parquet", partition_by: list[str] | None = None, columns: list[str] | None = None, order: list | None = None) -> None:
    """A sink: the named columns that exist, sorted within files where an order is given, as parquet or csv."""
    out = df.select(*existing(df, columns)) if columns else df
    if order:
        out = out.orderBy(*order)
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


def write_tables(tables: dict[str, DataFrame], folder: str, *, kind: str = "parquet") -> None:
    """One folder for each table."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", kind=kind)
