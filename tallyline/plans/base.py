"""Registry of the queries, the relations they start from, and helpers for their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import exact_sums

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, places: int | None = 4):
    """Registers a query under its function's name, with its SQL twin where SQL can say it. The given tables' measures have
    four decimal places at most, so sums are exact at that scale; with ``places`` None they are in double precision."""

    def register(f):
        @functools.wraps(f)
        def built(spark: SparkSession, sf_dir: str) -> DataFrame:
            with exact_sums(places):
                return f(spark, sf_dir)

        QUERIES[f.__name__] = built
        if sql:
            SQL[f.__name__] = sql
        return built

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity = customer, season = year, segment = priority, value = price."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("segment"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity = user, week = day of the month, position = event type, points = value."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("week"), F.col("event_type").alias("position"), F.col("value").alias("points"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft = supplier's lines: round = line number, pick by order and line, entity = part."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("draft"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pick"), F.col("l_linenumber").alias("round"), F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("orderkey"), (F.col("l_orderkey") % 12 + 1).cast("int").alias("roster")
    )


# The same relations in SQL, as the heads of WITH clauses.
ORDERS = """o AS (SELECT o_orderkey AS id, o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority AS segment,
    o_orderstatus AS status, o_totalprice AS value FROM orders)"""
EVENTS = "e AS (SELECT event_id, ts, user_id AS entity, CAST(day(ts) AS INTEGER) AS week, event_type AS position, value AS points FROM events)"
LINES = """l AS (SELECT l_suppkey AS draft, l_orderkey * 8 + l_linenumber AS pick, l_linenumber AS round, l_partkey AS entity, l_returnflag AS flag,
    l_quantity AS quantity, l_extendedprice AS price, l_orderkey AS orderkey, CAST(l_orderkey % 12 + 1 AS INTEGER) AS roster FROM lineitem)"""


def s_total(x: str, over: str = "") -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) {over} AS DOUBLE)"


def s_mean(x: str, over: str = "") -> str:
    return f"({s_total(x, over)} / nullif(CAST(count({x}) {over} AS DOUBLE), 0))"


def s_round(x: str, digits: int) -> str:
    """Half away from zero, of the shortest decimal form of a number."""
    return f"CAST(round(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,17)), {digits}) AS DOUBLE)"


def s_spread(x: str, over: str = "", less: int = 1) -> str:
    n, s = f"count({x}) {over}", s_total(x, over)
    q = f"CAST(sum(CAST(CAST({x} AS DECIMAL(18,4)) AS DECIMAL(19,4)) * CAST(CAST({x} AS DECIMAL(18,4)) AS DECIMAL(19,4))) {over} AS DOUBLE)"
    return f"CASE WHEN {n} > {less} THEN sqrt(greatest({q} - {s} * {s} / {n}, 0.0) / ({n} - {less})) END"


#: Roll-up of orders by entity and season, as season_rollup gives it.
ROLLED = f"""{ORDERS}, r AS (SELECT entity, season, count(*) AS n, {s_total("value")} AS value_sum, {s_mean("value")} AS value_mean,
    {s_spread("value")} AS value_std, max(value) AS value_max FROM o GROUP BY entity, season)"""
