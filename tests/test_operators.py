"""Operators on tiny hand-computed frames: nulls, ties, empty inputs, properties."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyline.functions import stats
from tallyline.operators import adjust, compare, comps, drafts, features, lineup, matchup, metrics, profiles, ranks, schedule, seasons, signals, tiers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_scalars(spark):
    df = spark.createDataFrame([(5.0, " A.J.  Smith Jr.", "7"), (20.0, "Bo III", "x"), (None, None, None), (0.0, "c", "")], "v double, n string, t string")
    out = df.select(
        stats.right_closed("v", [0, 5, 20], ["a", "b"]).alias("b"), stats.name_key("n").alias("k"), stats.number("t", "int").alias("i"), stats.clip("v", 1, 10).alias("c"), stats.safe_div(F.lit(1), "v").alias("d"), stats.label("#%s", "t").alias("l"), stats.notes("t", "n").alias("s")
    )
    got = [tuple(r) for r in out.collect()]
    assert got[0][:5] == ("a", "aj smith", 7, 5.0, 0.2) and got[1][:5] == ("b", "bo", None, 10.0, 0.05)
    assert got[2][:5] == (None, None, None, None, None) and got[3][0] is None and got[3][3:5] == (1.0, None)
    assert got[0][5] == "#7" and got[2][6] == ""


def test_rollup_nulls_and_thresholds(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 1, None), ("a", 1, 20.0), ("b", 1, None), (None, 1, 5.0)], "e string, s int, v double")
    got = rows(seasons.season_rollup(df, keys=["e", "s"], measures=["v"], thresholds={"v": [15]}), "e")
    assert got[0] == ("a", 1, 3, 30.0, 15.0, pytest.approx(math.sqrt(50)), 20.0, 15.0, 1, 0.333)
    assert got[1] == ("b", 1, 1, 0.0, None, None, None, None, 0, 0.0) and len(got) == 2


def test_category_ties_career_pairs_and_trend(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None)], "e string, c string")
    assert rows(seasons.primary_category(df, keys=["e"], category="c"), "e") == [("a", "x", 1)]
    base = spark.createDataFrame([("a", 2020, 10, 100.0), ("a", 2021, 8, 80.0), ("a", 2023, 17, 60.0), ("b", 2020, 10, 5.0)], "e string, s int, g int, v double")
    career = rows(seasons.career(base, entity=["e"], season="s").select("e", "s", "career_year", "seasons_seen"), "e", "s")
    assert career == [("a", 2020, 1, 1), ("a", 2021, 2, 2), ("a", 2023, 4, 3), ("b", 2020, 1, 1)]
    pairs = rows(seasons.yoy_pairs(base, entity=["e"], season="s", games="g", target="v"), "s")
    assert pairs == [("a", 2020, 10, 100.0, 8, 80.0, 170.0)]  # 80 x 17 / 8
    trend = rows(seasons.yoy_trend(base, entity=["e"], season="s", measures=["v"]).select("s", "v_trend").where("e = 'a'"), "s")
    assert trend == [(2020, 0.0), (2021, -20.0), (2023, 0.0)]


def test_lagged_never_sees_the_row_itself(spark):
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([10, 20, 60, 0, 1000])], "e string, w int, v double")
    got = rows(features.lagged(df, keys=["e"], order=["w"], measures=["v"]).select("w", "v_roll", "v_past", "v_roll_std"), "w")
    assert got[0] == (0, None, None, None) and got[1] == (1, 10.0, 10.0, None)
    assert got[4][1] == pytest.approx(80 / 3) and got[4][2] == 22.5


def test_continuity_unknown_counts_as_changed(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("c", 1, None), ("c", 2, None)], "u string, s int, h string")
    assert [(r[0], r[3]) for r in rows(seasons.continuity(df, unit="u", season="s", holder="h", first=1, second=2), "u")] == [("a", 1), ("b", 0), ("c", 0)]


def test_profiles(spark):
    df = spark.createDataFrame([("a", 2024, 10.0, 1.0), ("a", 2025, 20.0, None), ("b", 2024, 7.0, 3.0), ("c", 2025, None, None), ("c", 2024, 4.0, 4.0)], "u string, s int, x double, y double")
    got = rows(profiles.smoothed(df, unit="u", season="s", new=2025, measures=["x", "y"]), "u")
    assert got == [("a", 16.0, None), ("b", 7.0, 3.0), ("c", 4.0, 4.0)]
    dec = rows(profiles.decayed_mean(df, keys=["u"], season="s", measure="x", latest=2025, decay=0.5, lookback=2), "u")
    assert dec == [("a", pytest.approx((20 + 0.5 * 10) / 1.5))]
    assert [r[0] for r in rows(profiles.decayed_mean(df, keys=["u"], season="s", measure="x", latest=2025, decay=0.5, lookback=2, in_latest=False), "u")] == ["a", "b", "c"]
    placed = ranks.numbered(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("d", 0.5)], "u string, v double"), value="v", tie=["u"])
    assert rows(placed.select("u", "place"), "place") == [("d", 1), ("a", 2), ("b", 3), ("c", 4)]


def test_schedule(spark):
    games = spark.createDataFrame([("a", "b", 1, "x", "y"), ("a", None, 2, "x", None)], "h string, w string, week int, hc string, ac string")
    both = rows(schedule.both_directions(games, home="h", away="w", keep=["week"], swapped={"hc": "ac"}), "week", "unit")
    assert both == [(1, "a", "b", 1, "y"), (1, "b", "a", 0, "x"), (2, "a", None, 1, None)]
    assert schedule.both_directions(games, home="h", away="w", keep=["week"], drop_open=True).count() == 2
    weeks = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 2), ("b", 3), (None, 1)], "u string, w int")
    assert rows(schedule.first_gap(weeks, unit="u", week="w", last=3), "u") == [("a", 2), ("b", None)]
    ranks = spark.createDataFrame([("a", 1, 5), ("a", 2, 10), ("b", 1, 25), ("c", 1, 22), ("c", 2, 30)], "u string, w int, r int")
    got = rows(schedule.complements(ranks, unit="u", week="w", rank="r", tough=13, easy=21, top=1).where("unit = 'a'"), "place")
    assert got == [("a", "c", 2, 26.0, 2, 32.0, 1, 2)]
    roster = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "roster string, unit string, seat int")
    cand = spark.createDataFrame([("r", "c"), ("r", "z")], "roster string, candidate string")
    best = rows(schedule.best_pairing(cand, roster, ranks, unit="u", week="w", rank="r", tough=13, easy=21), "candidate")
    assert best == [("r", "c", "a", 2, 2), ("r", "z", "a", 2, 0)]


def test_matchup_unknown_opponent_and_fallback_mix(spark):
    ents = spark.createDataFrame([("e", "u", 170.0, 2.0, 3.0, 1.0, 2.0, 2.0), ("n", "u", 170.0, None, None, None, None, None), ("f", "u", 170.0, 2.0, 3.0, 1.0, 0.0, 0.0)], "entity string, unit string, total double, overall double, man double, zone double, high1 double, high2 double")
    sched = spark.createDataFrame([("u", "x", 1), ("u", "q", 2)], "unit string, opponent string, week int")
    prof = spark.createDataFrame([("x", 40.0, 60.0, 50.0, 50.0, 0.5, 0.4)], "opponent string, o_man double, o_zone double, o_high1 double, o_high2 double, o_man_fpdb double, o_zone_fpdb double")
    names = {k: k for k in ("overall", "man", "zone", "high1", "high2")}
    opp = {"man": "o_man", "zone": "o_zone", "high1": "o_high1", "high2": "o_high2", "man_fpdb": "o_man_fpdb", "zone_fpdb": "o_zone_fpdb"}
    got = {(r["entity"], r["week"]): r for r in matchup.weekly_matchups(ents, sched, prof, entity=names, opponent=opp, value="total").collect()}
    assert got["e", 1]["advantage"] == pytest.approx((3 * 0.4 + 2 * 0.5 * 0.6 * 2) / 2 - 1) and got["e", 2]["week_value"] == 0.0 and got["n", 1]["week_value"] == 10.0
    neutral = matchup.weekly_matchups(ents, sched, prof, entity=names, opponent=opp, value="total", unknown="neutral")
    assert {r["week_value"] for r in neutral.where("week = 2").collect()} == {10.0}
    table = matchup.matchup_table(ents.where("entity = 'f'"), prof.withColumn("o_man", F.lit(0.0)), entity=names, opponent=opp)
    assert table.first()["expected"] == 0.6  # nothing of man, so zone alone


def test_ratio_and_adjustments(spark):
    df = spark.createDataFrame([(2.0, 1.0, 2.0, 1.0), (1.1, 1.0, 1.0, 1.0), (1.0, 0.0, 1.0, 1.0)], "rt double, rf double, pt double, pf double")
    got = [r[0] for r in df.select(matchup.ratio_multiplier(F.col("rt"), F.col("rf"), F.col("pt"), F.col("pf"), translation=F.lit(0.5))).collect()]
    assert got == [1.4, pytest.approx(1.035), 1.0]
    schemes = spark.createDataFrame([("a", "WR", "s1", 0.1), ("a", "WR", "s2", 0.1), ("b", "RB", "s1", 0.2)], "entity string, segment string, label string, scheme double")
    manual = spark.createDataFrame([("a", "WR", -0.5, None), ("c", "TE", 0.1, "why")], "entity string, segment string, pct double, reason string")
    both = rows(adjust.combine_adjustments(schemes, manual, keys=["entity", "segment"]), "entity")
    assert both == [("a", "WR", 0.2, -0.5, -0.4, "Scheme: s1, s2"), ("b", "RB", 0.2, 0.0, 0.2, "Scheme: s1"), ("c", "TE", 0.0, 0.1, 0.1, "Manual: why")]
    proj = spark.createDataFrame([("a", "WR", 100.0, "X"), ("d", "WR", 60.0, "Y"), ("e", "WR", 60.0, "Y")], "entity string, segment string, v double, unit string")
    upd = spark.createDataFrame([("d", "WR", "Z")], "entity string, segment string, new_unit string")
    out = adjust.apply_adjustments(proj, spark.createDataFrame(both, "entity string, segment string, s double, m double, total double, note string"), keys=["entity", "segment"], value="v", segment="segment", updates=upd)
    assert rows(out.select("entity", "adjusted", "segment_rank", "unit"), "entity") == [("a", 60.0, 1, "X"), ("d", 60.0, 1, "Z"), ("e", 60.0, 1, "Y")]


def test_scheme_weights_and_moves(spark):
    entities = spark.createDataFrame([("a", "u", "WR"), ("b", "u", "WR")], "entity string, unit string, segment string")
    prof = spark.createDataFrame([("p", "WR", 1.0, 10.0), ("q", "WR", 1.1, 11.0)], "profile string, segment string, rate double, points double")
    for move, want in ((False, 0.1), (True, 1 / 1.1 - 1)):
        rules = spark.createDataFrame([("r", "u", "p", "q", 1.0, move, {"a": 0.5})], "label string, unit string, from_profile string, to_profile string, translation double, is_move boolean, weights map<string,double>")
        got = {r["entity"]: r["scheme"] for r in adjust.scheme_adjustments(entities, rules, prof, measures=("rate", "points")).collect()}
        assert got == {"a": pytest.approx(want / 2), "b": pytest.approx(want)}


def plain_tiers(values):
    out, tier, size, prev = [], 1, 0, None
    for v in values:
        if prev is not None:
            rule = next((g for g in [(200, 15, 0.07), (100, 12, 0.10), (50, 20, 0.18)] if prev >= g[0]), (0, 30, 0.35))
            gap = prev - v
            if (gap >= rule[1] or (gap / prev if prev > 0 else 0) >= rule[2] or size >= (8 if tier <= 5 else 12)) and tier < 18:
                tier, size = tier + 1, 0
        size += 1
        prev = v
        out.append(tier)
    return out


def test_tiers_against_a_plain_fold(spark):
    values = sorted([300, 290, 280, 250, 249, 248, 247, 246, 245, 244, 243, 242, 120, 119, 60, 59, 30, 29, 5, 1, 0, -3] + [k / 7 for k in range(200)], reverse=True)
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(values)] + [("s", 999, None), ("t", 1, 1.0)], "g string, k int, v double")
    got = rows(tiers.gap_tiers(df, segment=["g"], value="v", key="k").where("g = 's'"), "k")
    assert [r[3] for r in got] == plain_tiers(values) and max(r[3] for r in got) <= 18


def test_tiers_in_chunks_with_null_segments_and_many_runs(spark):
    rng = random.Random(8)
    sets = {None: [rng.choice([5, 5, 40, 400, 0]) * rng.random() for _ in range(500)], "long": [100.0] * 150 + [99.0] * 90, "steps": [2000 - 40.0 * k for k in range(60)], "small": [7.0], "neg": [-1.0, -50.0, -51.0]}
    data = [(g, k, v) for g, values in sets.items() for k, v in enumerate(sorted(values, reverse=True))]
    df = spark.createDataFrame(data, "g string, k int, v double").repartition(5)
    for chunk in (7, 64, None):
        got = {(r["g"], r["k"]): r["tier"] for r in tiers.gap_tiers(df, segment=["g"], value="v", key="k", chunk=chunk).collect()}
        assert got == {(g, k): t for g, values in sets.items() for k, t in enumerate(plain_tiers(sorted(values, reverse=True)))}
    assert tiers.gap_tiers(df.limit(0), segment=["g"], value="v", key="k").collect() == []


def test_tiers_of_a_million_rows_in_one_segment(spark):
    df = spark.range(1_000_000).select(F.lit("s").alias("g"), F.col("id").alias("k"), (F.col("id") * 1e-4).alias("v"))
    began = time.perf_counter()
    counts = {r["tier"]: r["n"] for r in tiers.gap_tiers(df, segment=["g"], value="v", key="k").groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert counts == {**{t: 8 for t in range(1, 6)}, **{t: 12 for t in range(6, 18)}, 18: 1_000_000 - 5 * 8 - 12 * 12}
    assert time.perf_counter() - began < 60


def test_final_ranks_and_curves_without_a_window_over_a_group(spark):
    df = spark.createDataFrame([(f"e{k}", "ab"[k % 2], None if k == 5 else float(k // 3)) for k in range(20)], "e string, g string, v double")
    got = {r["e"]: (r["segment_place"], r["overall_place"]) for r in comps.final_ranks(df, value="v", tie=["e"], segment="g").collect()}
    order = sorted(range(20), key=lambda k: (k == 5, -(k // 3), f"e{k}"))
    assert got == {f"e{k}": ([j for j in order if j % 2 == k % 2].index(k) + 1, order.index(k) + 1) for k in range(20)}
    rng = random.Random(2)
    rows_ = [(g, rng.randrange(2), round(rng.random(), 2)) for g in "xxxxy" for _ in range(200)] + [("z", 1, 0.5), ("z", None, 0.5), ("z", 0, None)]
    scored = spark.createDataFrame(rows_, "g string, y int, s double")
    auc = {r["g"]: r["auc"] for r in metrics.roc_auc(scored, label="y", score="s", within=["g"]).collect()}
    ap = {r["g"]: r["average_precision"] for r in metrics.average_precision(scored, label="y", score="s", within=["g"]).collect()}
    for g in "xy":
        pos, neg = ([s for h, y, s in rows_ if h == g and y == k] for k in (1, 0))
        assert auc[g] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
        assert ap[g] == pytest.approx(sum(pos.count(t) / len(pos) * sum(p >= t for p in pos) / sum(x >= t for x in pos + neg) for t in set(pos)))
    assert auc["z"] is None and ap["z"] == 1.0


def test_complements_equal_all_pairs_and_stop_early(spark, monkeypatch):
    monkeypatch.setattr(schedule, "FIRST_PLACES", 8)
    rng = random.Random(6)
    at = {(u, w): rng.randrange(1, 33) for u in range(600) for w in range(1, 9) if rng.random() < 0.8}
    df = spark.createDataFrame([(u, w, r) for (u, w), r in at.items()] + [(1000, 1, None)], "u int, w int, r int")
    got = {}
    looked = {}
    for r in schedule.complements(df, unit="u", week="w", rank="r", tough=13, easy=21, top=3).collect():
        got.setdefault(r["unit"], []).append((r["place"], r["other"], r["tough_weeks"], round(r["mean_rank"], 9), r["easy_weeks"]))
        looked[r["unit"]] = r["looked_at"]
    for u in range(600):
        weeks = [w for w in range(1, 9) if at.get((u, w), 99) <= 13]
        scores = []
        for o in range(600):
            there = [at[o, w] for w in weeks if (o, w) in at]
            if o != u and there:
                scores.append((-(sum(there) / len(there) + 3 * sum(r >= 21 for r in there)), o, len(there), round(sum(there) / len(there), 9), sum(r >= 21 for r in there)))
        assert sorted(got.get(u, [])) == [(k, *x[1:]) for k, x in enumerate(sorted(scores)[:3], 1)]
    assert sum(looked.values()) < 0.8 * 600 * 600
    assert schedule.complements(df.limit(0), unit="u", week="w", rank="r", tough=13, easy=21, top=3).collect() == []


def test_nearest_rows_are_those_of_all_pairs_and_few_are_measured(spark):
    rng = random.Random(4)
    pool = [(f"e{k:04d}", 2000 + k % 3, "hot" if k % 5 else f"s{k % 20}", float(k), [round(rng.gauss(0, 1), 1), rng.gauss(0, 1)] if k % 3 else [0.0, 0.0]) for k in range(4000)]
    asked = [(e, s, g, z) for e, s, g, _, z in pool[1::41]] + [("new", 2009, "hot", [9.0, -9.0]), ("none", 2009, "absent", [0.0, 0.0])]
    df = spark.createDataFrame(pool, "comp_entity string, comp_season int, g string, next_value double, z array<double>")
    got = comps.nearest_rows(spark.createDataFrame(asked, "e string, s int, g string, z array<double>"), df, key=["e", "s", "g"], segment=["g"], k=8, width=2).collect()
    by = {(r["e"], r["s"], r["g"]): r for r in got}
    of = {}
    for row in pool:
        of.setdefault(row[2], []).append(row)
    assert len(by) == len(asked) - 1
    for e, s, g, z in asked[:-1]:
        near = sorted((math.sqrt((z[0] - q[0]) ** 2 + (z[1] - q[1]) ** 2), ce, cs, v) for ce, cs, _, v, q in of[g] if (ce, cs) != (e, s))[:8]
        assert [tuple(x)[1:] for x in by[e, s, g]["near"]] == [x[1:] for x in near]
        assert [x["distance"] for x in by[e, s, g]["near"]] == pytest.approx([x[0] for x in near])
    assert sum(r["compared"] for r in got) < 0.1 * sum(len(of[g]) for _, _, g, _ in asked[:-1])


def test_comparables_weights(spark):
    pool = spark.createDataFrame([(f"p{k}", 2020, 1, float(k), 10.0 * k) for k in range(6)], "e string, s int, seg int, f double, next_value double")
    asked = spark.createDataFrame([("q", 2024, 1, 2.0), ("z", 2024, 9, 2.0)], "e string, s int, seg int, f double")
    got = rows(comps.nearest_comparables(asked, pool, segment=["seg"], entity="e", season="s", features=["f"], k=3, digits=None), "e")
    std = math.sqrt(sum((k - 2.5) ** 2 for k in range(6)) / 6)
    raw = [1 / 0.01, 1 / (1 / std + 0.01), 1 / (1 / std + 0.01)]
    cut = [min(w, 0.4 * sum(raw)) for w in raw]
    assert len(got) == 1 and got[0][3] == pytest.approx(sum(w * v for w, v in zip(cut, [20, 10, 30], strict=True)) / sum(cut)) and got[0][5] == "p2 (2021): 20FP, p1 (2021): 10FP, p3 (2021): 30FP"
    blend = comps.blended(spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, None), (3, 10.0, 20.0)], "y int, m double, c double"), model="m", comparable="c", career_year="y", weights={1: 0.6, 2: 0.35})
    assert [r[3] for r in rows(blend, "y")] == [16.0, 10.0, 10.0]


def test_compare_and_names(spark):
    ours = spark.createDataFrame([("A.J. Fox Jr", "WR", 10.0), ("Bo", "WR", 5.0), ("Cy", "WR", 5.0)], "name string, seg string, v double")
    theirs = spark.createDataFrame([("aj fox", "WR", 1.0), ("Dee", "WR", 9.0)], "name string, seg string, v double")
    got = {r["name_key"]: (r["our_rank"], r["their_rank"], r["verdict"]) for r in compare.compare_ranks(ours, theirs, name="name", segment="seg", value="v", band=1).collect()}
    assert got == {"aj fox": (1, 2, "higher"), "bo": (2, None, "only_ours"), "cy": (2, None, "only_ours"), "dee": (None, 1, "only_theirs")}
    known = spark.createDataFrame([("Marvin Harrison Jr.",), ("Mike Evans",), ("Mike Williams",), ("Bo Nix",)], "n string")
    raw = spark.createDataFrame([("mike EVANS",), ("The Man",), ("Bo Nix II",), ("harrison marvin",), ("mike",), ("nobody",), (None,), ("",)], "raw string")
    alias = spark.createDataFrame([("the man", "Mike Williams")], "alias string, canonical string")
    got = {r["raw"]: (r["resolved"], r["stage"]) for r in compare.resolve_names(raw, known, alias, name="raw", known_name="n").collect()}
    assert got == {"mike EVANS": ("Mike Evans", "exact"), "The Man": ("Mike Williams", "alias"), "Bo Nix II": ("Bo Nix", "suffix"), "harrison marvin": ("Marvin Harrison Jr.", "words"), "mike": ("mike", "none"), "nobody": ("nobody", "none"), None: (None, "none"), "": ("", "none")}


PROJ = [(e, p, w, pts, base, bye) for e, p, base, bye in [("q1", "QB", 20.0, 1), ("r1", "RB", 10.0, None), ("r2", "RB", 8.0, 2), ("r3", "RB", 7.0, None), ("w1", "WR", 9.0, None), ("w2", "WR", 6.0, None), ("w3", "WR", 5.0, 3), ("w4", "WR", 4.0, None), ("t1", "TE", 3.0, None), ("t2", "TE", 2.5, None)] for w, pts in [(1, base + 1), (2, None)]]


def brute_week(names, week, dim):
    pts = {}
    for n in names:
        pos, base, bye, vals = dim[n]
        if bye != week:
            pts.setdefault(pos, []).append(vals.get(week) if vals.get(week) is not None else base)
    best = 0.0
    s = {p: sorted(v, reverse=True) for p, v in pts.items()}
    for flex in ("RB", "WR", "TE", None):
        total = sum(sum(s.get(p, [])[: n + (p == flex)]) for p, n in lineup.LINEUP.items())
        best = max(best, total)
    return best


def test_lineups_and_marginals_against_brute_force(spark):
    proj = spark.createDataFrame(PROJ, "entity string, position string, week int, points double, base double, bye int")
    dim = {}
    for e, p, w, pts, base, bye in PROJ:
        dim.setdefault(e, (p, base, bye, {}))[3][w] = pts
    names = sorted(dim)
    held = {f"s{k}": [n for n, b in zip(names, bits, strict=True) if b] for k, bits in enumerate(itertools.islice(itertools.product([0, 1], repeat=len(names)), 1, 1024, 41))}
    rosters = spark.createDataFrame([(r, n) for r, ns in held.items() for n in [*ns, "unknown"]] + [("none", "unknown"), ("twice", "r1"), ("twice", "r1")], "roster string, entity string")
    held |= {"none": [], "twice": ["r1", "r1"]}
    want = {r: sum(brute_week(ns, w, dim) for w in range(1, 15)) for r, ns in held.items()}
    got = {r["roster"]: r["score"] for r in lineup.lineup_scores(rosters, proj, roster=["roster"], digits=None).collect()}
    assert got == {r: pytest.approx(v) for r, v in want.items()}
    cand = spark.createDataFrame([(r, n) for r, ns in held.items() for n in names if n not in ns], "roster string, entity string")
    gains = {(r["roster"], r["entity"]): r["gain"] for r in lineup.marginal_values(rosters, cand, proj, roster="roster", digits=None).collect()}
    for r, ns in held.items():
        for n in names:
            if n not in ns:
                gain = sum(brute_week([*ns, n], w, dim) for w in range(1, 15)) - want[r]
                assert gain >= -1e-9 and gains.get((r, n), 0.0) == pytest.approx(gain, abs=1e-6)


def test_standings_grades(spark):
    df = spark.createDataFrame([("l", k, float(10 - k)) for k in range(5)] + [("m", 1, 1.0)], "league string, roster int, score double")
    assert [r["grade"] for r in lineup.standings(df, league="league", roster="roster").where("league = 'l'").orderBy("place").collect()] == list("ABCDF")


def test_drafts(spark):
    picks = spark.range(1, 37)
    got = picks.select("id", *[c.alias(n) for n, c in drafts.snake(F.col("id"), 12).items()]).collect()
    slots = {r["id"]: r["slot"] for r in got}
    assert [slots[k] for k in (1, 12, 13, 24, 25)] == [1, 12, 12, 1, 1] and all(r["next_pick"] > 36 or slots[r["next_pick"]] == r["slot"] for r in got)
    rowset = [(1, 1, "a"), (1, 2, "b"), (2, 2, "b"), (2, 1, "a"), (3, 1, "b")]
    marks = drafts.fingerprints(spark.createDataFrame(rowset, "d int, pick int, e string"), draft="d", members=["pick", "e"])
    assert rows(drafts.first_of_each_fingerprint(marks, draft="d").select("d", "first_draft", "copies"), "d") == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
    pool = spark.createDataFrame([("x", 3), ("y", 30), ("z", 11), ("n", None)], "entity string, market int")
    near = drafts.near_picks(spark.createDataFrame([(1, 10)], "d int, pick int"), pool, pick="pick", market="market", before=7, after=2)
    assert sorted(r["entity"] for r in near.collect()) == ["x", "z"]
    boards = spark.createDataFrame([(1, "User Avatar\n12\nBo Nix icon\n3\nAnn Lee icon\nUser Avatar\n\n7\nCy icon"), (2, ""), (3, None)], "id int, t string")
    assert rows(drafts.board_picks(boards, id_col="id", text_col="t"), "section", "pick") == [(1, 1, 3, "Ann Lee"), (1, 1, 12, "Bo Nix"), (1, 2, 7, "Cy")]
    phase = drafts.phase_average(spark.createDataFrame([(1, 1, "A"), (1, 6, "B"), (2, 99, "A")], "d int, r int, p string"), round_col="r", column="p", values=["A", "B"], edges=[0, 5, 10, 20], labels=["a", "b", "c"], draft="d")
    assert rows(phase, "phase") == [("a", 0.5, 0.0), ("b", 0.0, 0.5), ("c", 0.0, 0.0)]


def test_signals_and_trend(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 1.0)], "g string, v double")
    got = sorted((str(r["g"]), r["v_z"]) for r in signals.zscores(df, within=["g"], measures=["v"]).collect())
    assert got == [("None", 0.0), ("a", pytest.approx(-1 / math.sqrt(2))), ("a", pytest.approx(1 / math.sqrt(2))), ("b", 0.0)]
    line = spark.createDataFrame([("a", float(x), 2.0 * x + 1) for x in range(4)] + [("b", 1.0, 1.0)] * 4 + [("c", 1.0, None)], "k string, x double, y double")
    assert rows(signals.trend_line(line, keys=["k"], x="x", y="y"), "k") == [("a", 4, 2.0, 1.0)]
    tags = signals.tagged_sums(spark.createDataFrame([("u", "WR", 50.0, 1.0)], "u string, p string, s double, v double"), keys=["u"], segment="p", tags={"slot": F.col("s") >= 50, "wide": F.col("s") <= 50}, measure="v")
    assert sorted(r["p"] for r in tags.collect()) == ["WR", "slot", "wide"]
    out = signals.later_wins([spark.createDataFrame([("a", 1.0)], "k string, signal double"), spark.createDataFrame([("a", 2.0)], "k string, signal double")], key=["k"])
    assert rows(out, "k") == [("a", 2.0)]


def test_metrics_by_definition(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.4), (0, 0.5), (1, 0.1), (0, 0.05), (None, 0.3)]
    df = spark.createDataFrame(data, "y int, s double")
    pos, neg = [s for y, s in data if y == 1], [s for y, s in data if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df, label="y", score="s").first()["auc"] == pytest.approx(want)
    ap = seen = tp = 0
    for s in sorted({s for y, s in data if y is not None}, reverse=True):
        k = sum(1 for y, x in data if y == 1 and x == s)
        tp, seen = tp + k, seen + sum(1 for y, x in data if y is not None and x == s)
        ap += k / len(pos) * tp / seen
    assert metrics.average_precision(df, label="y", score="s").first()["average_precision"] == pytest.approx(ap)
    r = metrics.mae_r2(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0)], "a double, p double"), actual="a", predicted="p").first()
    assert (r["n"], r["mae"], r["r2"]) == (2, 0.5, 0.5)
    assert metrics.roc_auc(df.where("y = 1"), label="y", score="s").first()["auc"] is None


def test_plans_use_no_python_and_no_stray_product(spark):
    from tallyline.plans import QUERIES

    for name in ("season_rollup", "comps_knn", "lineup_score", "name_resolve", "near_pick_band", "schedule_strength"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct")), name


def test_rank_min_against_plain_ranks(spark):
    rng = random.Random(5)
    data = [(k, rng.choice("xyz"), rng.choice([None, 1.0, 2.0, 2.5]) if k % 3 else rng.uniform(-5, 5)) for k in range(700)] + [(999, None, 3.0), (1000, "n", None)]
    df = spark.createDataFrame(data, "k int, g string, v double")
    for within in ([], ["g"]):
        got = {r["k"]: r["rank"] for r in ranks.rank_min(df, value="v", within=within).collect()}
        for k, g, v in data:
            peers = [b for _, a, b in data if (not within or a == g) and b is not None]
            assert got[k] == 1 + sum(b > v for b in peers) if v is not None else got[k] == 1 + len(peers)
    assert ranks.rank_min(df.limit(0), value="v").count() == 0


def test_sums_without_a_scale_keep_small_large_and_undefined_values(spark):
    df = spark.createDataFrame([("s", 0.00004), ("s", 0.00002), ("l", 1e15), ("l", 3e15), ("n", float("nan"))], "g string, v double")
    got = {r["g"]: r for r in df.groupBy("g").agg(stats.mean("v").alias("m"), stats.std_samp("v").alias("s"), stats.total("v").alias("t")).collect()}
    assert got["s"]["m"] == pytest.approx(0.00003) and got["s"]["s"] == pytest.approx(0.00002 / math.sqrt(2))
    assert got["l"]["t"] == 4e15 and math.isnan(got["n"]["m"])
    with stats.exact_sums(2):
        assert df.where("g = 's'").agg(stats.total("v")).first()[0] == 0.0
    assert not stats.sums_are_exact()


def test_need_candidates_fall_back_to_the_best(spark):
    needed = spark.createDataFrame([("r", "QB", 1, 10), ("r", "RB", 0, 10), ("r", "TE", 2, 10)], "roster string, position string, need int, pick int")
    ranked = spark.createDataFrame([("QB", "a", 200), ("QB", "b", 3), ("TE", "c", 12), ("TE", "d", 1), ("RB", "e", 10), ("QB", "f", 2), ("QB", "g", None)], "position string, entity string, market int")
    picks = spark.createDataFrame([("r", "f"), ("r", "unknown"), ("s", "b")], "roster string, entity string")
    got = rows(drafts.need_candidates(needed, ranked, picks, roster="roster", position="position", pick="pick", market="market", entity="entity"), "position", "place")
    assert got == [("r", "QB", "b", False, 1), ("r", "QB", "a", False, 2), ("r", "QB", "g", False, 3), ("r", "TE", "c", True, 1)]


def test_candidates_and_stacks_equal_the_pool_searched_whole(spark):
    rng = random.Random(9)
    ranked = [(f"e{k:03d}", f"p{k % 4}", f"u{k % 7}", rng.choice([None, *range(1, 90)] if k % 9 == 0 else range(1, 90))) for k in range(300)]
    picks = sorted({(r, f"e{rng.randrange(300):03d}") for r in range(12) for _ in range(60)})
    needed = [(r, f"p{p}", rng.choice([0, 1, 2]), rng.choice([1, 20, 45, 400, -50])) for r in range(12) for p in range(4)]
    lists = spark.createDataFrame(ranked, "entity string, position string, unit string, market int")
    taken = spark.createDataFrame(picks, "roster int, entity string")
    got = rows(drafts.need_candidates(spark.createDataFrame(needed, "roster int, position string, need int, pick int"), lists, taken, roster="roster", position="position", pick="pick", market="market", entity="entity", before=3, after=4), "roster", "position", "place")
    want = []
    for r, p, need, pick in sorted(needed):
        pool = sorted(((m is None, m or 0, e) for e, q, _, m in ranked if q == p and (r, e) not in picks))
        near = [x for x in pool if not x[0] and pick - 3 <= x[1] <= pick + 4]
        want += [(r, p, e, bool(near), k) for k, (_, _, e) in enumerate((near or pool)[:3], 1) if need > 0]
    assert got == want and len({w[3] for w in want}) == 2
    held = taken.join(lists, "entity").withColumn("pick", F.length("entity") * 10 + F.col("roster"))
    got = {(r["roster"], r["entity"]): (r["unit"], r["mates"], r["place"]) for r in drafts.stack_targets(held, lists, roster="roster", entity="entity", unit="unit", pick="pick", market="market").collect()}
    info = {e: (u, m) for e, _, u, m in ranked}
    for r in range(12):
        units = [info[e][0] for s, e in picks if s == r]
        free = [e for e, (u, _) in info.items() if u in units and (r, e) not in picks]
        assert {e for s, e in got if s == r} == set(free)
        assert all(got[r, e][:2] == (info[e][0], units.count(info[e][0])) for e in free)
        assert sorted(got[r, e][2] for e in free) == list(range(1, len(free) + 1))


def test_marginal_value_of_weak_weeks(spark):
    projections = spark.createDataFrame([(e, p, w, float(v), 0.0, None) for e, p, vs in (("q", "QB", [10, 20, 30]), ("c", "RB", [9, 1, 0])) for w, v in enumerate(vs, 1)], "entity string, position string, week int, points double, base double, bye int")
    rosters = spark.createDataFrame([("r", "q")], "roster string, entity string")
    free = spark.createDataFrame([("r", "c")], "roster string, entity string")
    got = rows(lineup.marginal_values(rosters, free, projections, roster="roster", weeks=3, weak_weeks=1), "entity")
    assert [(r[1], r[2], r[3]) for r in got] == [("c", 10.0, 9.0)]


def test_alias_chains_cycles_and_suffixes_anywhere(spark):
    aliases = spark.createDataFrame([("A", "b"), ("b", "C "), ("c", "anna lee"), ("x", "y"), ("y", "x"), ("into", "x"), ("self", "self"), ("", "q")], "alias string, canonical string")
    ends = {r["raw_key"]: r["alias_key"] for r in compare.alias_ends(aliases).collect()}
    assert ends == {"a": "anna lee", "b": "anna lee", "c": "anna lee"}
    known = spark.createDataFrame([("Anna Lee",), ("Bo Ray Cox",), ("Bo Ray Fox",), ("Al Vu",)], "n string")
    raw = spark.createDataFrame([(k, n) for k, n in enumerate(["a", "X", "anna Jr. lee", "bo cox", "ray", "Al V. Vu", "lee", "al", "zz", "", None, "  ANNA   lee III"])], "id int, raw string")
    got = {r["id"]: (r["resolved"], r["stage"]) for r in compare.resolve_names(raw, known, aliases, name="raw", known_name="n").collect()}
    assert got[0] == ("Anna Lee", "alias") and got[1] == ("X", "none") and got[2] == ("Anna Lee", "suffix") and got[11] == ("Anna Lee", "suffix")
    assert got[3] == ("Bo Ray Cox", "words") and got[4] == ("ray", "none") and got[5] == ("Al Vu", "suffix") and got[6] == ("Anna Lee", "words") and got[7] == ("Al Vu", "words")
    assert got[8] == ("zz", "none") and got[9] == ("", "none") and got[10] == (None, "none")


def test_draft_summaries_and_opponents_best(spark):
    table = spark.createDataFrame([("d", 1, 10.0, False), ("d", 2, 12.04, False), ("d", 3, 11.0, True), ("e", 1, 1.0, False)], "draft string, slot int, score double, mine boolean")
    picks = spark.createDataFrame([("d", 2), ("d", 2), ("d", 1)], "draft string, slot int")
    assert rows(drafts.draft_summaries(picks, table, draft="draft", roster="slot", score="score", mine="mine"), "draft") == [("d", 2, 12.0, 2, 3, 2), ("e", 1, 1.0, None, 1, 0)]
    games = spark.createDataFrame([("u", "v", 15), ("u", "w", 16), ("u", "v", 18), ("u", "none", 17)], "unit string, opponent string, week int")
    ents = spark.createDataFrame([("a", "v", 3), ("b", "v", None), ("c", "v", 1), ("d", "w", 5)], "entity string, unit string, rank int")
    got = rows(schedule.opponents_best(games, ents, entity="entity", rank="rank", week="week", weeks=(15, 17), top=2), "week", "place")
    assert got == [("u", 15, "v", 1, "c", 1), ("u", 15, "v", 2, "a", 3), ("u", 16, "w", 1, "d", 5)]


def test_rules_resolve_as_of_their_season(spark):
    history = spark.createDataFrame(
        [("p", "new", 2018, "TE", 1.0, 10.0, 4), ("p", "new", 2020, "RB", 2.0, 20.0, 4), ("p", "old", 2021, "WR", 3.0, 30.0, 4), ("q", "old", 2020, "RB", 4.0, 40.0, 4), ("r", "new", 2023, "WR", 1.0, 1.0, 1)],
        "e string, u string, s int, g string, rate double, points double, n int",
    )
    asked = spark.createDataFrame([("p", "new", 2022), ("p", "new", 2019), ("p", "old", 2020), ("p", "new", None), ("z", "new", 2022)], "e string, u string, as_of int")
    got = {(r["e"], r["u"], r["as_of"]): r["g"] for r in adjust.resolve_as_of(asked, history, entity="e", unit="u", segment="g", season="s").collect()}
    assert got == {("p", "new", 2022): "RB", ("p", "new", 2019): "TE", ("p", "old", 2020): "RB", ("p", "new", None): "RB", ("z", "new", 2022): "WR"}
    rules = spark.createDataFrame([("c", "old", [2020], "new", [2020], 0.5, False, 2021), ("m", "old", [2020], "new", [2020], 0.5, True, 2020)], "label string, from_unit string, from_years array<int>, to_unit string, prior_years array<int>, translation double, is_move boolean, as_of int")
    weights = spark.createDataFrame([("c", "p", 0.5), ("m", "q", 1.0), ("c", "z", 1.0), ("c", "q", 0.0)], "label string, e string, weight double")
    out = rows(adjust.rule_adjustments(rules, weights, history, entity="e", unit="u", segment="g", season="s", measures=("rate", "points"), games="n"), "label", "e")
    assert out == [("c", "p", "RB", "new", 0.2), ("c", "z", "WR", "new", 0.0), ("m", "q", "RB", "new", -0.25)]


def test_lagged_of_large_keys_equals_the_windows(spark):
    rng = random.Random(7)
    data = [(None if k % 50 == 0 else "hot" if k % 10 else f"g{k % 3}", k, None if rng.random() < 0.1 else round(rng.uniform(-5, 400), 2)) for k in range(3000)]
    df = spark.createDataFrame(data, "e string, w int, v double").repartition(5)
    for places in (2, None):
        with stats.exact_sums(places):
            want = {r["w"]: r for r in features.lagged(df, keys=["e"], order=["w"], measures=["v"]).collect()}
            got = features.lagged_of_large_keys(df, keys=["e"], order=["w"], measures=["v"], chunk=64)
            assert got.columns == [*df.columns, "v_roll", "v_roll_std", "v_past", "v_past_std"]
            for r in got.collect():
                for c in ("v_roll", "v_roll_std", "v_past", "v_past_std"):
                    assert (r[c] is None) == (want[r["w"]][c] is None) and (r[c] is None or r[c] == pytest.approx(want[r["w"]][c], rel=1e-9, abs=1e-9)), (r, c)
    assert features.lagged_of_large_keys(df.limit(0), keys=["e"], order=["w"], measures=["v"]).collect() == []
