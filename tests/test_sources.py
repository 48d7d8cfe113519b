import pytest

from tallyline.sources import exports


@pytest.fixture
def teams(spark):
    return spark.createDataFrame([("WAS", "Washington Commanders", ["Washington Football Team"]), ("KC", "Kansas City Chiefs", None)], "abbrev string, full_name string, alias array<string>")


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_two_header_rows_repeated_names_and_bad_numbers(spark, tmp_path):
    path = put(tmp_path / "a.csv", '﻿Details,,,Pass,,Rush\nRank,Name,POS,YDS,TD,YDS\n1, Ann ,RB,"1,000",2,x\nRank,Name,POS,YDS,TD,YDS\n2,Bo,WR,30.5,,7\n3,,WR,1,1,1\n')
    rows = [tuple(r) for r in exports.read_export(spark, path).orderBy("rank").collect()]
    assert rows == [(1.0, "Ann", "RB", None, 2.0, None), (2.0, "Bo", "WR", 30.5, None, 7.0)]
    assert exports.read_export(spark, path).columns == ["rank", "name", "pos", "yds", "td", "yds_1"]


def test_years_of_two_layouts_with_a_missing_one(spark, tmp_path):
    a = put(tmp_path / "2021.csv", "Name,WEEK,YDS\nAnn,1,10\nAnn,,11\n")
    b = put(tmp_path / "2022.csv", "g,,,\nName,WEEK,YDS,TD\nBo,2,5,1\n")
    df = exports.read_years(spark, {2021: a, 2022: b, 2023: str(tmp_path / "none.csv")})
    assert sorted(map(tuple, df.select("name", "year", "td").collect()), key=str) == [("Ann", 2021, None), ("Ann", 2021, None), ("Bo", 2022, 1.0)]
    assert exports.weekly_facts(df).count() == 2
    assert exports.read_years(spark, {2020: str(tmp_path / "none.csv")}) is None


def test_all_positions_do_not_double_count(spark):
    rush = spark.createDataFrame([("A", "RB", 1, 5.0), ("Q", "QB", 1, 3.0)], "name string, pos string, week int, fp double")
    rec = spark.createDataFrame([("A", "RB", 1, 5.0), ("W", "WR", 1, 4.0), ("T", "TE", None, 1.0)], "name string, pos string, week int, fp double")
    assert sorted(r["name"] for r in exports.all_positions(rush, rec, None).collect()) == ["A", "W"]


def test_splits_matrix_and_codes(spark, tmp_path, teams):
    head = "Player,,," + ",".join(["x"] * 20)
    path = put(tmp_path / "s.csv", head + "\nName,Team,POS" + ",RTE,TPRR,YPRR,FP/RR" * 5 + "\nAnn,KC,WR," + ",".join(map(str, range(20))) + "\nAnn,WAS,WR," + ",".join(map(str, range(1, 21))) + "\n")
    row = exports.coverage_splits(spark, path).first()
    assert (row["team"], row["rte_overall"], row["yprr_man"], row["fp_per_rr_high2"]) == ("WAS", 1.0, 7.0, 20.0)
    path = put(tmp_path / "m.csv", "a,,,,,,,,\nRank,Name,MAN %,FP/DB,ZONE %,FP/DB,1-HI,FP/DB,2-HI,FP/DB\n1,Washington Football Team,30,0.4,65,0.5,50,0.6,40,0.7\n2,Elsewhere,,,,,,,,\n")
    rows = {r["team"]: r for r in exports.coverage_matrix(spark, path, teams).collect()}
    assert (rows["WAS"]["fp_per_db_man"], rows["WAS"]["fp_per_db_high2"], rows["WAS"]["man_pct"]) == (0.4, 0.7, 30.0) and "Elsewhere" in rows
    df = spark.createDataFrame([("Elsewhere",), ("Kansas City Chiefs",)], "t string")
    assert sorted(str(r["team"]) for r in exports.with_team_code(df, teams, name="t", pass_through=False).collect()) == ["KC", "None"]


def test_schedule_coordinators_projections_rankings(spark, tmp_path, teams):
    path = put(tmp_path / "c.csv", 'week,home_team,away_team,home_dc,away_dc\n1,Kansas City Chiefs,Washington Commanders,Dan,\n2,,KC,a,b\n')
    rows = exports.schedule(spark, path, teams).orderBy("week").collect()
    assert tuple(rows[0]) == (1, "KC", "WAS", "Dan", None) and rows[1]["home"] is None and rows[1]["away"] == "KC"
    path = put(tmp_path / "o.csv", 'season,team,conference,division,offensive_coordinator,oc_play_caller,defensive_coordinator,notes\n2025,Kansas City Chiefs,AFC,West,,HC,"Spags, S","a, b"\n')
    row = exports.coordinators(spark, path, teams).first()
    assert (row["season"], row["team_code"], row["offensive_coordinator"], row["notes"]) == (2025, "KC", None, "a, b")
    path = put(tmp_path / "p.csv", "g,,,,,,,\nNAME,Position,Team,BYE,POS,FPTS,GP,FPTS/G\nAnn,RB,KC,7,1,170,0,10\nBo,WR,KC,,2,x,17,9\n")
    assert sorted(map(tuple, exports.season_projections(spark, path).collect())) == [("Ann", "RB", "KC", 7, 170.0, 1.0, 10.0), ("Bo", "WR", "KC", None, None, 17.0, 9.0)]
    path = put(tmp_path / "r.csv", "NAME,ID,POS,Team,ADP,OVERALL,POSITION\nAnn,7,RB,KC,1.5,2,RB12\n")
    row = exports.market_rankings(spark, path).first()
    assert (row["positional_rank"], row["market"]) == (12, 2.0)
    path = put(tmp_path / "e.csv", "RK,Name,Team,POS,G,FPTS,FPTS/G\n1,Ann,KC,RB,,100,6\n")
    assert exports.outside_ranking(spark, path).first()["g"] == 15.0
    allowed = exports.points_allowed(spark, {"RB": put(tmp_path / "q.csv", "Rank,Name,FP\n1,KC,20\n"), "WR": put(tmp_path / "w.csv", "Rank,Name,G,FP\n1,KC,17,30\n")})
    assert sorted((r["segment"], r["fp"]) for r in allowed.collect()) == [("RB", 20.0), ("WR", 30.0)]


def test_draft_exports_are_paired_by_number(spark, tmp_path):
    for n, name in ((1, "draft_analysis (1).csv"), (0, "draft_analysis.csv"), (3, "draft_analysis (3).csv")):
        put(tmp_path / name, f"Pick,Round,Slot,My Pick,Player,POS,NFL Team,ADP\n1,1,1,True,P{n},RB,,\n")
    for name in ("league_standings (1).csv", "league_standings.csv", "league_standings (9).csv"):
        put(tmp_path / name, "Rank,Slot,Picks,Proj Pts\n1,1,18,1500.5\n")
    picks, standings, alone = exports.draft_exports(spark, str(tmp_path / "draft_analysis*.csv"), str(tmp_path / "league_standings*.csv"))
    assert sorted((r["lobby"], r["player"]) for r in picks.collect()) == [(0, "P0"), (1, "P1")]
    assert sorted((r["lobby"], r["proj_pts"]) for r in standings.collect()) == [(0, 1500.5), (1, 1500.5)]
    assert sorted(map(tuple, alone.collect())) == [(3, "picks"), (9, "standings")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "a", 1), (1, "b", 2)], "k int, s string, d int")
    exports.write_table(df, str(tmp_path / "t"), columns=["s", "k", "absent"], order=["k"])
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).orderBy("k").collect()] == [("b", 1), ("a", 2)]
    exports.write_table(df, str(tmp_path / "c"), kind="csv", partition_by=["d"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    exports.write_tables({"x": df}, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all/x")).count() == 2
