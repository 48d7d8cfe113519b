"""The mined rows against every pair scored in Python's integers, and the query against its SQL."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyline.llm import hard_negatives
from tallyline.llm.hard_negatives import Shard, mine_hard_negatives
from tallyline.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int, row int, score string"


def first(rows, k):
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]


def plain(rows):
    held = lambda x: min(max(math.floor(256 * x) if math.isfinite(256 * x) else (1 << 80) * (1 if x > 0 else -1), -(1 << 63)), (1 << 63) - 1)
    good = [(i, label, [held(x) for x in v]) for i, v, label, *_ in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    long = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for at, (i, label, v) in enumerate(good):
        if i is None or i % 10:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, own) for k, (j, own, w) in enumerate(good) if k != at]
        for p, pid, _ in first([s for s in scored if s[2] == label], 5):
            fits = [s for s in scored if s[2] != label and 80 * long(p) <= 100 * s[0] <= 100 * long(p)]
            out += [(i, pid, rank, nid, long(p), long(n)) for rank, (n, nid, _) in enumerate(first(fits, 5), 1)]
    return out


def made(seed, n, wide=6, scale=1.0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = [rng.choice([0.0, 0.0, rng.gauss(0, 1), round(rng.gauss(0, 1))]) * scale for _ in range(wide)]
        rows.append((k, v, 1 if rng.random() < 0.4 else rng.randrange(6), 1, "x"))
    return rows


def test_equals_every_pair_with_ties_copies_and_odd_vectors(spark, monkeypatch):
    rows = made(1, 300)
    rows += [(k, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25], k % 3, 1, "x") for k in range(300, 380)]  # many equal scores
    rows += [(400, [0.0] * 6, 1, 1, "x"), (410, [1.0, 2.0], 1, 1, "x"), (411, [], 2, 1, "x"), (420, [-1.0] * 6, 3, 1, "x"), (430, [1.0] * 6, 99, 1, "x")]
    rows += [(440, None, 1, 1, "x"), (450, [1.0] * 6, None, 1, "x"), (460, [float("nan")] * 6, 1, 1, "x"), (470, [None, 1.0], 1, 1, "x"), (480, [float("inf")], 1, 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = sorted(plain(rows))
    for shard, block in ((8192, 4096), (64, 7)):
        monkeypatch.setattr(hard_negatives, "SHARD", shard)
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        assert sorted(map(tuple, mine_hard_negatives(docs, F.col("vec_id") % 10 == 0).collect())) == want
    assert len({r[0] for r in want}) > 20


def test_large_numbers_null_ids_and_empty_tables(spark):
    rows = made(2, 60, scale=1e9) + [(70, [1e300] * 6, 1, 1, "x"), (71, [1e300] * 6, 2, 1, "x"), (None, [3e9] * 6, 2, 1, "x"), (None, [3e9] * 6, 2, 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, mine_hard_negatives(docs, F.col("vec_id") % 10 == 0).collect()), key=key) == sorted(plain(rows), key=key)
    assert mine_hard_negatives(docs.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert mine_hard_negatives(docs, F.lit(False)).collect() == []
    twice = spark.createDataFrame([*rows[:20], rows[0]], SCHEMA)
    assert mine_hard_negatives(twice, F.col("vec_id") == 0).count() == 2 * len([r for r in plain([*rows[:20], rows[0]]) if r[0] == 0]) / 2


def test_search_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-20, 20, (4000, 4))
    vectors[:10] = 200
    shard = Shard(vectors, np.arange(4000), pa.array(range(4000), pa.int64()), 200)
    met = []
    kth = shard._kth
    shard._kth = lambda seen, *a: met.append(len(seen)) or kth(seen, *a)
    best = shard.search(np.array([200, 200, 200, 200]), np.ones(4000, dtype=bool), [(None, None)], 5)
    assert [j for _, j in best[0]] == [0, 1, 2, 3, 4] and met[-1] < 100


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.execute(ORACLE_SQL["op12_hard_negatives"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.001").select(names).collect())) == sorted(want.fetchall())
