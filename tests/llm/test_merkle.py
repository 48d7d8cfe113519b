"""The manifest against a plain tree of lists, and its query against its SQL."""

import hashlib
import random
import zlib

import duckdb

from tallyline.llm.merkle import merkle_manifest, tamper_report
from tallyline.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, path string, hash int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def record(row, low=False):
    i, text, lang, source, n = row[:5]
    if low and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        first = at // 8 * 8
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 8])
        at //= 8


def plain_report(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, record(r), r))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    top, out = levels_of([trees[g][-1][0] for g in langs]), []
    for k, g in enumerate(langs):
        for at, (_, _, leaf, row) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            path = [*siblings(trees[g], at), *siblings(top, k)]
            node = record(row, True) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 else leaf
            for left, right in path:
                node = digest(left + node + right)
            out.append((row[0], leaf, trees[g][-1][0], top[-1][0], digest("".join(x + y for x, y in path)), node, node == top[-1][0]))
    return out


def test_equals_the_plain_tree_with_nulls_repeats_and_groups_of_all_sizes(spark):
    rng = random.Random(5)
    langs = [None, *["en"] * 9, "de", "de", "é", "\U0001f600", *[f"x{k}" for k in range(9)]]  # one over a block, one over a run, some of a few rows
    rows = [(None if rng.random() < 0.01 else rng.randrange(10**6), rng.choice([None, "", "Abc", "low", "ÄÖ X", "Q" * 5000]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 5]), "p", 1) for _ in range(1300)]
    rows += [(9, "X", "en", "s", 1, "p", 1)] * 20 + [(5, "alone", "zz", None, None, None, None)]
    got = tamper_report(merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), rehearse=True))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_report(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert 0 < sum(not w[-1] for w in want) < len(want)


def test_empty_single_and_eight(spark):
    docs = spark.createDataFrame([(k, f"T{k}", "en", "s", 2, "p", 0) for k in range(9)], SCHEMA)
    assert merkle_manifest(docs.limit(0)).collect() == []
    for n in (1, 8, 9):
        rows = [tuple(r) for r in docs.where(f"doc_id < {n}").collect()]
        got = tamper_report(merkle_manifest(docs.where(f"doc_id < {n}"), rehearse=True))
        assert sorted(map(tuple, got.collect())) == sorted(plain_report(rows))
    alone = merkle_manifest(docs.where("doc_id = 4")).collect()[0]
    assert alone["leaf"] == alone["subroot"] == alone["root"] and alone["path"] == [] and "altered" not in alone.asDict()


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(ORACLE_SQL["op11_merkle_manifest"])
    names = [d[0] for d in want.description]
    got = QUERIES["op11_merkle_manifest"](spark, "/root/testdata/sf0.001").select(names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
