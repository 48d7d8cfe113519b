"""Pools, bands and products of drafts: the same rows as plain versions, without the rows in between."""

from pyspark.sql import functions as F

from tallyline.operators import drafts, lineup, matchup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pool_of(spark):
    ranked = [(f"e{k:03d}", k % 50 if k % 11 else None) for k in range(200)] + [(None, 7), ("e001", 99)]
    picks = [(r, f"e{(r * 37 + k * 5) % 220:03d}") for r in range(9) for k in range(40 - r)] + [(3, "e001"), (3, None), (None, "e002"), (4, "e010"), (4, "e010")]
    lists, taken = spark.createDataFrame(ranked, "entity string, market int"), spark.createDataFrame(picks, "draft int, entity string")
    return lists, taken, [(d, e, m) for d in {p[0] for p in picks} for e, m in ranked if d is None or e is None or (d, e) not in picks]


def key(row):
    return tuple((v is None, v or 0 if not isinstance(v, str) else v) for v in row)


def test_available_pool_streams_its_rows(spark):
    lists, taken, want = pool_of(spark)
    got = drafts.available(lists, taken, draft="draft", entity="entity")
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    text = plan(got)
    assert "Cartesian" not in text and "NestedLoop" not in text and "LeftAnti" not in text  # no product that is exchanged again


def test_a_pool_exchanges_its_picks_once(spark):
    lists, taken, _ = pool_of(spark)
    text = plan(drafts.available(lists, taken, draft="draft", entity="entity"))
    by = [line.split("Exchange hashpartitioning(")[1].split("#")[0] for line in text.split("\n") if "Exchange hashpartitioning(" in line]
    assert sorted(by) == ["__key", "__key", "draft"]  # the picks, the entities, and the drafts' names


def test_fallen_streams_the_pool(spark):
    lists, taken, want = pool_of(spark)
    got = drafts.fallen(drafts.available(lists, taken, draft="draft", entity="entity").withColumn("pick", F.lit(30)), pick="pick", market="market")
    told = [(*w, 30 - w[2] if w[2] is not None and w[2] < 30 else None) for w in want]
    assert sorted((tuple(r) for r in got.select("draft", "entity", "market", "fell").collect()), key=key) == sorted(told, key=key)
    assert "Exchange" not in plan(got).split("ShuffledHashJoin")[0] and "ShuffledHashJoin" in plan(got)


def test_near_picks_look_up_the_first_of_a_band(spark):
    ranked = [(f"e{k:03d}", (k * 13) % 40 if k % 7 else None) for k in range(160)]
    picks = [(d, (d * 11) % 60) for d in range(25)] + [(3, 33), (3, 33), (99, None), (100, 500), (101, -30)]
    lists, asked = spark.createDataFrame(ranked, "entity string, market int"), spark.createDataFrame(picks, "draft int, pick int")
    got = drafts.near_picks(asked, lists, pick="pick", market="market", before=3, after=4, top=6)
    want = []
    for d, p in sorted({x for x in picks if x[1] is not None}):
        band = sorted((m, e) for e, m in ranked if m is not None and p - 3 <= m <= p + 4)
        want += [(d, p, e, m, k) for k, (m, e) in enumerate([x for x in band for _ in range(picks.count((d, p)))][:6], 1)]
    assert got.columns == ["draft", "pick", "entity", "market", "place"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "block#" not in plan(got)  # no row for every entity of a band


def test_lineup_weeks_hold_what_can_count_only(spark):
    points = spark.range(5000).select((F.col("id") % 2).alias("roster"), F.col("id").alias("entity"), F.lit(1).alias("week"), F.element_at(F.array(*map(F.lit, ("QB", "RB", "WR", "TE"))), (F.col("id") % 4 + 1).cast("int")).alias("position"), ((F.col("id") * 7919) % 5003).cast("double").alias("points"))
    held = lineup._sorted_weeks(points, roster=["roster"], starters=lineup.LINEUP, flex=lineup.FLEX)
    assert all(len(r[f"of_{p}"]) <= 4 for r in held.collect() for p in lineup.LINEUP)
    want = {}
    for r in points.collect():
        want.setdefault(r["roster"], {}).setdefault(r["position"], []).append(r["points"])
    for r in lineup.lineup_weeks(points, roster=["roster"]).collect():
        best = {p: sorted(v, reverse=True) for p, v in want[r["roster"]].items()}
        rest = max(best[p][n] for p, n in lineup.LINEUP.items() if p in best and p in lineup.FLEX)
        assert r["week_points"] == sum(sum(v[: lineup.LINEUP[p]]) for p, v in best.items()) + rest


def test_a_matchup_of_one_file_is_dealt_to_all_tasks(spark):
    names = ["overall", "man", "zone", "high1", "high2"]
    entities = spark.range(20, numPartitions=1).select(F.col("id").alias("entity"), *[F.lit(k + 0.5).alias(n) for k, n in enumerate(names)])
    sides = ["man", "zone", "high1", "high2", "man_fpdb", "zone_fpdb"]
    opponents = spark.range(3, numPartitions=1).select(F.col("id").alias("opponent"), *[F.lit(10.0 + k).alias(f"o_{n}") for k, n in enumerate(sides)])
    out = matchup.matchup_table(entities, opponents, entity={n: n for n in names}, opponent={n: f"o_{n}" for n in sides})
    assert out.rdd.getNumPartitions() == 4 and out.select("entity", "opponent").distinct().count() == 60


def test_stack_targets_neither_sort_nor_exchange_their_rows(spark, monkeypatch):
    monkeypatch.setattr(drafts, "STRETCH", 16)
    ranked = [(f"e{k:03d}", f"u{k % 7}" if k % 13 else None, (k * 17) % 60 if k % 10 else None) for k in range(150)]
    held = [(r, f"e{(r * 31 + k * 3) % 150:03d}", r + 5 * k) for r in range(8) for k in range(12)]
    lists = spark.createDataFrame(ranked, "entity string, unit string, market int")
    rosters = spark.createDataFrame(held, "roster int, entity string, pick int").join(lists, "entity")
    got = drafts.stack_targets(rosters, lists, roster="roster", entity="entity", unit="unit", pick="pick", market="market", band=6)
    want, units = [], {e: u for e, u, _ in ranked}
    for r in range(8):
        mine = [(units[e], p, e) for q, e, p in held if q == r and units[e]]
        last = {u: max(p for v, p, _ in mine if v == u) for u, _, _ in mine}
        pool = [(None if m is None else abs(m - last[u]) <= 6, m, e, u) for e, u, m in ranked if u in last and e not in {e for _, _, e in mine}]
        pool.sort(key=lambda x: ({True: 0, False: 1, None: 2}[x[0]], x[1] or 0, x[2]))
        want += [(r, e, u, near, k) for k, (near, _, e, u) in enumerate(pool, 1)]
    assert sorted(tuple(x) for x in got.select("roster", "entity", "unit", "is_near", "place").collect()) == sorted(want)
    assert "Window" not in plan(got) and "SortMergeJoin" not in plan(got)


def test_stack_targets_rows_of_a_roster_are_bounded(spark, monkeypatch):
    """A longer list has longer blocks, so that what is written and exchanged is BLOCKS rows of a roster, however many entities there are."""
    monkeypatch.setattr(drafts, "STRETCH", 4)
    monkeypatch.setattr(drafts, "BLOCKS", 8)
    seen, cut = [], drafts.cut
    monkeypatch.setattr(drafts, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    lists = spark.range(600).selectExpr("id AS entity", "CAST(id % 5 AS STRING) AS unit", "CAST(id % 90 AS INT) AS market")
    rosters = spark.range(40).selectExpr("id % 4 AS roster", "id * 7 AS entity", "CAST(id AS INT) AS pick").join(lists, "entity")
    got = drafts.stack_targets(rosters, lists, roster="roster", entity="entity", unit="unit", pick="pick", market="market")
    asked = next(df for df in seen if {"__taken", "__key"} <= set(df.columns))
    assert asked.count() == 4 * 8
    want = 4 * 600 - 40 - sum(1 for r in range(4) for u in "01234" for _ in range(120) if not any(k % 4 == r and str(k * 7 % 5) == u for k in range(40)))
    assert got.count() == want and dict(got.dtypes)["mates"] == "bigint"
    assert [sorted(x["place"] for x in got.where(f"roster = {r}").collect()) for r in range(4)] == [list(range(1, got.where(f"roster = {r}").count() + 1)) for r in range(4)]
