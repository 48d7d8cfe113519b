import hashlib
import time

import duckdb
import pytest

from tallyline.llm.exact_dedup import drop_exact_copies, exact_groups
from tallyline.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from tallyline.llm.url_filter import filter_urls

ROWS = [(5, "a b", "x"), (2, "ab ", "x"), (3, "a\tb ", "y"), (4, None, "x"), (9, "", "x"), (7, "alone", "x"), (7, "alone", "x"), (None, "AB", "x"), (None, "A B", "x"), (8, "z" * 100 + "1", "x"), (6, "z" * 100 + "2", "x"), (1, "\xa0", "x"), (5, " other", None)]
SCHEMA = "doc_id bigint, text string, full_hash string"


def test_groups_by_the_plain_rule(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for hash_all in (False, True):
        got = exact_groups(docs, hash_all=hash_all).collect()
        assert len(got) == len(ROWS)
        norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups = {}
        for i, t, _ in ROWS:
            groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0))
        want = sorted((-1 if i is None else i, str(None if min(groups[norm(t)])[1] else min(groups[norm(t)])[2]), len(groups[norm(t)])) for i, t, _ in ROWS)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], str(r["keep_id"]), r["group_size"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)
        if hash_all:
            assert {r["full_hash"] for r in got} == {hashlib.sha256(k.encode()).hexdigest() for k in groups}
    assert exact_groups(docs.limit(0)).count() == 0


def test_drop_keeps_one_of_each(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect() if r["text"]) == sorted(
        [("3", "a\tb "), ("7", "alone"), ("None", "A B"), ("8", "z" * 100 + "1"), ("6", "z" * 100 + "2"), ("1", "\xa0"), ("5", " other")]
    )
    assert kept.where("text IS NULL OR text = ''").count() == 1
    assert drop_exact_copies(docs.limit(0)).count() == 0


def test_drop_with_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, 1, "h") for r in ROWS], SCHEMA.replace("full_hash", "told_id") + ", __hash int, hash string").repartition(2)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == drop_exact_copies(docs.select("doc_id", "text")).count()
    assert {r["hash"] for r in kept.collect()} == {"h"} and {r["__hash"] for r in kept.collect()} == {1}


def test_url_rules(spark):
    urls = {
        "http://example.com/en/x": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://www.EXAMPLE.com/en/?q=://a": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "x://a.b.www.example.com/en": ("a.b.www.example.com", "/en", "com/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://a.net/fr/#top": ("a.net", "/fr/", "net/fr/", "block"),
        "http://net/es/a/b/c": ("net", "/es/a/b/c", "net/es/", "block"),
        "http://a.net?x": ("a.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"),
        "http:///en/": ("", "/en/", None, "allow"),
        None: ("", "", None, "allow"),
        "http://a..net./es/": ("a..net.", "/es/", None, "allow"),
    }
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, "http://a.com/", "h"), (1, "http://b.net/es/", "h")], "page_id bigint, url string, host string")
    got = filter_urls(pages, rules).collect()
    assert len(got) == len(urls) + 2
    by = {r["page_id"]: tuple(r)[1:] for r in got if r["host"] != "b.net"}
    for k, u in enumerate(urls):
        assert by[k] == urls[u], u
    assert by[None][2:] == ("com/", "allow")
    assert {r["verdict"] for r in filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert filter_urls(pages.limit(0), rules).count() == 0


def test_rules_that_end_inside_a_path_part_and_ties(spark):
    rules = spark.createDataFrame([("a.com", "/en", "block"), ("a.com", "/e", "allow"), ("b.com", "/x", "allow"), ("b.com", "/x", "block"), ("c.com", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/english"), (2, "http://a.com/ex"), (3, "http://b.com/xyz"), (4, "http://q.c.com")], "page_id bigint, url string")
    assert sorted((r["page_id"], r["verdict"]) for r in filter_urls(pages, rules).collect()) == [(1, "block"), (2, "allow"), (3, "block"), (4, "block")]


def test_hosts_of_many_labels_and_long_paths(spark):
    began = time.time()
    urls = ["http://" + "a." * 100_000 + "net/es/" + "x/" * 100_000, "http://" + "." * 100_000, "http://" + "net." * 50_000 + "example.com/en/"]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules).collect()}
    assert got == {0: ("net/es/", "block"), 1: (None, "allow"), 2: ("example.com/en/", "block")} and time.time() - began < 30


@pytest.mark.parametrize("name", ["op5_url_filter", "op6_exact_dedup"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, "/root/testdata/sf0.001").select(columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
