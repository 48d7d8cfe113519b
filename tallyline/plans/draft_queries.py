"""Queries over drafts: lines of orders as picks, suppliers as drafts; snake order, bands, boards, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import total
from ..operators import drafts, ranks
from .base import EVENTS, LINES, events, lines, query, s_mean, s_round, s_total, table

FLAGS = ["A", "N", "R"]


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ranked entities: market rank = size x 40 + key modulo 40, position = last digit of the brand."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("entity"), (F.col("p_size") * 40 + k % 40).cast("int").alias("market"), F.col("p_type").alias("position"), F.col("p_brand").alias("unit"), F.col("p_retailprice").alias("value"))


MARKET = "mk AS (SELECT p_partkey AS entity, CAST(p_size * 40 + p_partkey % 40 AS INTEGER) AS market, p_type AS position, p_brand AS unit, p_retailprice AS value FROM part)"


@query("""SELECT o_orderkey, CAST((o_orderkey // 12) + 1 AS INTEGER) AS round, CAST(CASE WHEN (o_orderkey // 12) % 2 = 0 THEN o_orderkey % 12 + 1 ELSE 12 - o_orderkey % 12 END AS INTEGER) AS slot,
    CAST(((o_orderkey // 12) + 1) * 12 + CASE WHEN (o_orderkey // 12) % 2 = 0 THEN 12 - o_orderkey % 12 ELSE 12 - o_orderkey % 12 END AS INTEGER) AS next_pick FROM orders""")
def snake_slot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    made = drafts.snake(F.col("o_orderkey") + 1, 12)
    return rows.select("o_orderkey", made["round"].cast("int").alias("round"), made["slot"].cast("int").alias("slot"), made["next_pick"].cast("int").alias("next_pick"))


@query(f"""WITH {MARKET}, pk AS (SELECT s_suppkey AS draft, CAST(s_suppkey * 17 % 2000 + 1 AS INTEGER) AS pick FROM supplier)
    SELECT draft, pick, entity, market, CAST(row_number() OVER (PARTITION BY draft, pick ORDER BY market, entity) AS INTEGER) AS place FROM pk JOIN mk ON market BETWEEN pick - 5 AND pick + 18 QUALIFY place <= 6""")
def near_pick_band(spark, sf_dir):
    s = F.col("s_suppkey")
    picks = table(spark, sf_dir, "supplier").select(s.alias("draft"), (s * 17 % 2000 + 1).cast("int").alias("pick"))
    return drafts.near_picks(picks, market(spark, sf_dir).select("entity", "market"), pick="pick", market="market", before=5, after=18, top=6)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their market rank."""
    return lines(spark, sf_dir).join(market(spark, sf_dir).select("entity", "market", "position", "unit"), "entity")


FLAGGED = f"{LINES}, {MARKET}, f AS (SELECT l.*, market, position, unit FROM l JOIN mk USING (entity))"


@query(f"""WITH {FLAGGED}, g AS (SELECT entity, count(DISTINCT draft) AS drafts, {s_mean("round")} AS mean_round, {s_mean("market")} AS mean_market, min(position) AS position, min(unit) AS unit FROM f GROUP BY entity)
    SELECT * FROM g ORDER BY drafts DESC, entity LIMIT 30""")
def top_players(spark, sf_dir):
    return drafts.top_entities(flagged(spark, sf_dir), entity="entity", draft="draft", labels=["position", "unit"], measures=["round", "market"], top=30)


@query(f"""WITH {LINES} SELECT round, count(*) FILTER (flag = 'A') AS A, count(*) FILTER (flag = 'N') AS N, count(*) FILTER (flag = 'R') AS R, count(*) FILTER (flag IN ('A', 'N', 'R')) AS total FROM l GROUP BY round""")
def round_pivot(spark, sf_dir):
    return drafts.pivot_counts(lines(spark, sf_dir), by="round", column="flag", values=FLAGS)


@query(f"""WITH {LINES}, p AS (SELECT 'early' AS phase, 0 AS a, 2 AS b UNION ALL SELECT 'middle', 2, 5 UNION ALL SELECT 'late', 5, 20 UNION ALL SELECT 'last', 20, 30)
    SELECT phase, count(*) FILTER (flag = 'A') / CAST((SELECT count(DISTINCT draft) FROM l) AS DOUBLE) AS A, count(*) FILTER (flag = 'N') / CAST((SELECT count(DISTINCT draft) FROM l) AS DOUBLE) AS N,
        count(*) FILTER (flag = 'R') / CAST((SELECT count(DISTINCT draft) FROM l) AS DOUBLE) AS R FROM p LEFT JOIN l ON round > a AND round <= b GROUP BY phase""")
def phase_avg(spark, sf_dir):
    return drafts.phase_average(lines(spark, sf_dir), round_col="round", column="flag", values=FLAGS, edges=[0, 2, 5, 20, 30], labels=["early", "middle", "late", "last"], draft="draft")


@query("""SELECT first_round, count(*) AS drafts FROM (SELECT l_orderkey, min(l_linenumber) AS first_round FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) GROUP BY 1""")
def first_timing(spark, sf_dir):
    return drafts.first_timing(lines(spark, sf_dir), draft="orderkey", round_col="round", column="flag", value="R")


@query(f"""WITH {FLAGGED}, h AS (SELECT draft, unit, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 25) SELECT unit, count(*) AS drafts, CAST(sum(n) AS BIGINT) AS members FROM h GROUP BY unit""")
def stacks(spark, sf_dir):
    return drafts.stacks(flagged(spark, sf_dir), draft="draft", unit="unit", least=25)


@query(f"""WITH {FLAGGED} SELECT round, {s_mean("market - round * 150")} AS adp_minus_pick, count(*) AS n FROM f GROUP BY round""")
def value_by_round(spark, sf_dir):
    rows = flagged(spark, sf_dir).withColumn("at", F.col("round") * 150)
    return drafts.value_by_round(rows, round_col="round", adp="market", pick="at")


@query(f"""WITH {FLAGGED}, b AS (SELECT draft, min(round) AS first_round FROM f WHERE flag = 'R' GROUP BY draft)
    SELECT count(DISTINCT draft) AS drafts, {s_mean("roster")} AS mean_roster, count(*) FILTER (market - round * 150 > 0) / CAST(count(*) AS DOUBLE) AS positive_share, {s_mean("market - round * 150")} AS mean_gap,
        (SELECT {s_mean("first_round")} FROM b) AS mean_first_round, (SELECT first_round FROM b GROUP BY 1 ORDER BY count(*) DESC, first_round LIMIT 1) AS commonest_first_round FROM f""")
def report_scalars(spark, sf_dir):
    rows = flagged(spark, sf_dir).withColumn("gap", F.col("market") - F.col("round") * 150)
    return drafts.report(rows, draft="draft", roster="roster", round_col="round", column="flag", value="R", gap="gap")


@query(f"""WITH {EVENTS}, m AS (SELECT entity AS draft, sha256(string_agg(DISTINCT position || ':' || week, ',' ORDER BY position || ':' || week)) AS fingerprint FROM e GROUP BY entity)
    SELECT draft, fingerprint, min(draft) OVER w AS first_draft, count(*) OVER w AS copies FROM m WINDOW w AS (PARTITION BY fingerprint)""")
def fingerprint_dedupe(spark, sf_dir):
    picks = events(spark, sf_dir).withColumnRenamed("entity", "draft")
    return drafts.first_of_each_fingerprint(drafts.fingerprints(picks, draft="draft", members=["position", "week"]), draft="draft")


@query(f"""WITH {LINES}, t AS (SELECT draft, roster, {s_total("price")} AS score FROM l GROUP BY ALL),
    b AS (SELECT draft, roster, score AS winning_score, count(*) OVER (PARTITION BY draft) AS n_rosters FROM t QUALIFY row_number() OVER (PARTITION BY draft ORDER BY score DESC, roster) = 1)
    SELECT draft, roster, pick, entity, winning_score, n_rosters FROM l JOIN b USING (draft, roster)""")
def winner_rosters(spark, sf_dir):
    picks = lines(spark, sf_dir)
    scores = picks.groupBy("draft", "roster").agg(total("price").alias("score"))
    return drafts.winners(picks.select("draft", "roster", "pick", "entity"), scores, draft="draft", roster="roster", score="score")


@query(f"""WITH {LINES}, t AS (SELECT draft, roster, {s_total("price")} AS score FROM l GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY draft ORDER BY score DESC, roster) AS INTEGER) AS place FROM t)
    SELECT draft, max(CASE WHEN place = 1 THEN roster END) AS win_roster, {s_round("max(CASE WHEN place = 1 THEN score END)", 1)} AS win_score, min(CASE WHEN roster = draft % 15 THEN place END) AS my_rank, count(*) AS n_rosters,
        (SELECT count(*) FROM l JOIN k w USING (draft, roster) WHERE w.draft = k.draft AND w.place = 1) AS n_picks FROM k GROUP BY draft""")
def draft_summaries(spark, sf_dir):
    """My roster is the one numbered draft modulo 15, which some drafts have not."""
    picks = lines(spark, sf_dir)
    scores = picks.groupBy("draft", "roster").agg(total("price").alias("score")).withColumn("mine", F.col("roster") == F.col("draft") % 15)
    return drafts.draft_summaries(picks, scores, draft="draft", roster="roster", score="score", mine="mine")


@query(f"""WITH {LINES}, a AS (SELECT DISTINCT orderkey FROM l WHERE flag = 'A'), b AS (SELECT DISTINCT orderkey FROM l WHERE flag = 'R')
    SELECT orderkey, 'left' AS only_in FROM a WHERE orderkey NOT IN (SELECT orderkey FROM b) UNION ALL SELECT orderkey, 'right' FROM b WHERE orderkey NOT IN (SELECT orderkey FROM a)""")
def unmatched_exports(spark, sf_dir):
    picks = lines(spark, sf_dir)
    return drafts.unmatched(picks.where("flag = 'A'"), picks.where("flag = 'R'"), key="orderkey")


@query(f"""WITH {LINES}, {MARKET}, d AS (SELECT DISTINCT draft FROM l) SELECT draft, entity, market, position, unit FROM d CROSS JOIN mk WHERE (draft, entity) NOT IN (SELECT draft, entity FROM l)""")
def available_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select("draft", "entity", "market", "position", "unit")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts x parts less the picks: the result by definition."""
    return drafts.available(market(spark, sf_dir), lines(spark, sf_dir), draft="draft", entity="entity")


POOL = f"{LINES}, {MARKET}, d AS (SELECT DISTINCT draft FROM l), po AS (SELECT draft, mk.* FROM d CROSS JOIN mk WHERE (draft, entity) NOT IN (SELECT draft, entity FROM l))"


@query(f"""WITH {POOL} SELECT draft, position, count(*) AS left_over, count(*) FILTER (market <= 500) AS left_first, count(*) FILTER (market <= 1000) AS left_second FROM po GROUP BY ALL""")
def scarcity(spark, sf_dir):
    return drafts.scarcity(market(spark, sf_dir), lines(spark, sf_dir), draft="draft", entity="entity", position="position", market="market", first=500, second=1000)


@query(f"""WITH {POOL} SELECT draft, entity, CASE WHEN 700 > market THEN 700 - market END AS fell FROM po""")
def fallen(spark, sf_dir):
    return drafts.fallen(_pool(spark, sf_dir).withColumn("pick", F.lit(700)), pick="pick", market="market").select("draft", "entity", "fell")


@query(f"""WITH {FLAGGED}, t AS (SELECT DISTINCT p_type AS position, CAST(20 AS INTEGER) AS target FROM part), r AS (SELECT DISTINCT draft FROM f)
    SELECT r.draft, t.position, coalesce(h.have, 0) AS have, target - coalesce(h.have, 0) AS need FROM r CROSS JOIN t LEFT JOIN (SELECT draft, position, count(*) AS have FROM f GROUP BY ALL) h ON h.draft = r.draft AND h.position = t.position""")
def position_needs(spark, sf_dir):
    targets = table(spark, sf_dir, "part").select(F.col("p_type").alias("position")).distinct().withColumn("target", F.lit(20))
    return drafts.needs(flagged(spark, sf_dir), targets, roster="draft", position="position")


@query(f"""WITH {POOL}, h AS (SELECT draft, unit, CAST(max(round) * 150 AS INTEGER) AS at_pick, count(*) AS mates FROM l JOIN mk USING (entity) GROUP BY ALL)
    SELECT draft, entity, unit, mates, abs(market - at_pick) <= 20 AS is_near, CAST(row_number() OVER (PARTITION BY draft ORDER BY abs(market - at_pick) <= 20 DESC, market, entity) AS INTEGER) AS place FROM po JOIN h USING (draft, unit)""")
def stack_targets(spark, sf_dir):
    held = flagged(spark, sf_dir).withColumn("pick", F.col("round") * 150)
    out = drafts.stack_targets(held, market(spark, sf_dir), roster="draft", entity="entity", unit="unit", pick="pick", market="market")
    return out.select("draft", "entity", "unit", "mates", "is_near", "place")


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS draft, l_linenumber AS bye, l_partkey AS entity FROM lineitem)
    SELECT draft, bye, count(*) AS n, string_agg(CAST(entity AS VARCHAR), ', ' ORDER BY CAST(entity AS VARCHAR)) AS names, CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS severity FROM r GROUP BY ALL""")
def bye_clusters(spark, sf_dir):
    rows = lines(spark, sf_dir).select("draft", F.col("round").alias("bye"), "entity").distinct()
    return drafts.bye_clusters(rows, roster="draft", bye="bye", entity="entity")


@query("""WITH u AS (SELECT s_suppkey AS k, s_name AS name, 0 AS source_no FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer)
    SELECT k, name, source_no FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY source_no) = 1""")
def first_source_union(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return drafts.first_source([suppliers, customers], key="k").select("k", "name", "source_no")


@query(f"""WITH {LINES}, {MARKET}, t AS (SELECT draft, roster, {s_total("price")} AS roster_total FROM l GROUP BY ALL)
    SELECT draft, roster, pick, entity, value, market, roster_total FROM l LEFT JOIN mk USING (entity) LEFT JOIN t USING (draft, roster)""")
def export_table(spark, sf_dir):
    picks, ranks = lines(spark, sf_dir), market(spark, sf_dir)
    totals = picks.groupBy("draft", "roster").agg(total("price").alias("roster_total"))
    out = drafts.export(picks.select("draft", "roster", "pick", "entity"), ranks.select("entity", "value"), ranks.select("entity", "market"), totals, draft="draft", roster="roster", entity="entity")
    return out.select("draft", "roster", "pick", "entity", "value", "market", "roster_total")


@query(r"""WITH li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS section FROM documents),
    se AS (SELECT doc_id, section, unnest(string_split(line, '. ')) AS name, generate_subscripts(string_split(line, '. '), 1) AS pick FROM li)
    SELECT doc_id, CAST(section AS INTEGER) AS section, CAST(pick AS INTEGER) AS pick, trim(name) AS name FROM se WHERE regexp_matches(name, '^[A-Za-z ]+$')""")
def board_parse(spark, sf_dir):
    """Boards made of the documents: a line of a text is a section, and each of its sentences a pick."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    picks = lambda line: F.array_join(F.transform(F.split(line, r"\. "), lambda s, k: F.concat((k + 1).cast("string"), F.lit("\n"), s, F.lit(" icon"))), "\n")
    boards = docs.select("doc_id", F.array_join(F.transform("lines", lambda line: F.concat(F.lit("User Avatar\n"), picks(line))), "\n").alias("board"))
    parsed = drafts.board_picks(boards, id_col="doc_id", text_col="board")
    return parsed.where(F.col("name").rlike("^[A-Za-z ]+$"))


@query(f"""WITH {MARKET} SELECT mk.entity, p_name AS name, market, position, CAST(row_number() OVER (ORDER BY market NULLS LAST, mk.entity) AS INTEGER) AS place FROM mk JOIN part ON p_partkey = mk.entity WHERE lower(p_name) LIKE '%red%' AND position IN ('SMALL', 'ECONOMY')""")
def player_search(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"))
    found = market(spark, sf_dir).join(names, "entity").where(F.col("name").ilike("%red%") & F.col("position").isin("SMALL", "ECONOMY"))
    return ranks.numbered(found.select("entity", "name", "market", "position"), value="market", tie=["entity"])


@query(f"""WITH {FLAGGED} SELECT draft, position, unit, count(*) AS held, count(DISTINCT entity) AS entities, CAST(min(market) AS INTEGER) AS best_market, 'no ' || min(market) || ' in round ' || min(round) AS label FROM f GROUP BY ALL""")
def roster_positions(spark, sf_dir):
    label = F.format_string("no %s in round %s", F.min("market").cast("string"), F.min("round").cast("string"))
    return flagged(spark, sf_dir).groupBy("draft", "position", "unit").agg(F.count("*").alias("held"), F.countDistinct("entity").alias("entities"), F.min("market").alias("best_market"), label.alias("label"))


@query(f"""WITH {LINES}, {MARKET}, w AS (SELECT DISTINCT draft, roster FROM (SELECT draft, roster, {s_total("price")} AS score FROM l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY draft ORDER BY score DESC, roster) = 1)
    SELECT roster, count(*) AS drafts FROM w GROUP BY roster""")
def slot_distribution(spark, sf_dir):
    picks = lines(spark, sf_dir)
    scores = picks.groupBy("draft", "roster").agg(total("price").alias("score"))
    return drafts.slot_distribution(drafts.winners(picks.select("draft", "roster"), scores, draft="draft", roster="roster", score="score"), draft="draft", slot="roster")


@query(f"WITH {FLAGGED} SELECT round, position, count(*) AS picks FROM f WHERE round <= 2 GROUP BY ALL")
def early_mix(spark, sf_dir):
    return drafts.early_mix(flagged(spark, sf_dir), round_col="round", column="position")


@query(f"WITH {FLAGGED} SELECT position, {s_round('count(*) / CAST((SELECT count(DISTINCT draft) FROM f) AS DOUBLE)', 1)} AS per_draft FROM f GROUP BY position")
def roster_composition(spark, sf_dir):
    return drafts.composition(flagged(spark, sf_dir), draft="draft", column="position")


@query(f"""WITH {POOL}, t AS (SELECT DISTINCT position FROM mk), h AS (SELECT draft, position, count(*) AS have FROM l JOIN mk USING (entity) GROUP BY ALL),
    n AS (SELECT d.draft, t.position, d.draft * 37 % 3000 + 1 AS pick FROM d CROSS JOIN t LEFT JOIN h ON h.draft = d.draft AND h.position = t.position WHERE 110 - coalesce(have, 0) > 0),
    c AS (SELECT n.draft, n.position, entity, market, market BETWEEN pick - 5 AND pick + 18 AS is_near FROM n JOIN po ON po.draft = n.draft AND po.position = n.position),
    k AS (SELECT *, max(is_near) OVER (PARTITION BY draft, position) AS any_near FROM c)
    SELECT draft, position, entity, is_near, CAST(row_number() OVER (PARTITION BY draft, position ORDER BY market, entity) AS INTEGER) AS place FROM k WHERE is_near OR NOT any_near QUALIFY place <= 3""")
def need_candidates(spark, sf_dir):
    targets = table(spark, sf_dir, "part").select(F.col("p_type").alias("position")).distinct().withColumn("target", F.lit(110))
    needed = drafts.needs(flagged(spark, sf_dir), targets, roster="draft", position="position").withColumn("pick", F.col("draft") * 37 % 3000 + 1)
    return drafts.need_candidates(needed, market(spark, sf_dir), lines(spark, sf_dir), roster="draft", position="position", pick="pick", market="market", entity="entity")
