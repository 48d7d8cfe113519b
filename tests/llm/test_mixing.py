"""The mix against targets and streams in plain lists, its schedule part by part, and its query against its SQL."""

import hashlib
import random
import re
from fractions import Fraction

import duckdb
import pytest

from tallyline.llm.mixing import mix_sources, mixed_texts, word_count
from tallyline.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id bigint, text string, source string, place int, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Exact, from {source: size}; null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, target = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in free}
        target |= {s: Fraction(2 * sizes[s]) for s in over}
        left, free = left - sum(2 * sizes[s] for s in over), free - over
    return target


def plain_taken(rows):
    sizes, docs = {}, []
    for i, text, source, *_ in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        docs.append((i, source, n))
    targets, out = plain_targets(sizes), []
    for s in sizes:
        quota, at = int(targets[s]), 0
        for i, _, n in sorted((d for d in docs if d[1] == s), key=lambda d: (hashlib.md5(f"0:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] or 0, d[2])):
            passes, rest = divmod(quota, sizes[s]) if sizes[s] else (0, 0)
            out.append((i, n, sizes[s], passes * n + max(0, min(n, rest - at))))
            at += n
    return out, targets


def made(seed, n):
    rng = random.Random(seed)
    sources = ["hot"] * 9 + ["b", "B", "é", "\U0001f600", None, "", "tiny", "none"]
    text = lambda s: None if rng.random() < 0.03 else " \t" if s == "none" else "\n".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 3, 40, 400]) if s != "tiny" else 1)) + rng.choice(["", " ", "\xa0"])
    rows = []
    for k in range(n):
        s = rng.choice(sources)
        rows.append((None if rng.random() < 0.02 else k, text(s), s, 1, "x"))
    return rows + [(7, "same text here", "hot", 1, "x")] * (n // 3)


def test_taken_words_and_schedule(spark):
    rows = made(3, 600)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    mix = mix_sources(docs, block_words=64)
    want, targets = plain_taken(rows)
    got = mix.documents.collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r["target"] == pytest.approx(float(targets[r["source"]])) and r["taken"] <= 2 * r["size"]
    slots = mix.schedule.collect()
    by_slot, seen = {}, {}
    for r in slots:
        by_slot.setdefault(r["slot"], set()).add((r["source"], r["pass"], r["block"]))
        seen[r["slot"]] = seen.get(r["slot"], 0) + r["n_words"]
    assert all(len(x) == 1 for x in by_slot.values()) and max(seen.values()) <= 64
    # Any stretch of slots holds the sources about as their targets say.
    words = sum(seen.values())
    for s in ("hot", "B", None):
        taken = at = 0
        for slot in sorted(seen)[: len(seen) * 3 // 4]:
            taken, at = taken + seen[slot] * (next(iter(by_slot[slot]))[0] == s), at + seen[slot]
            assert abs(taken - at * float(targets[s]) / words) < 5 * 64
    again = mix_sources(docs.repartition(3), block_words=64).documents
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_texts_of_the_schedule_are_the_documents_words(spark):
    rows = [(k, " ".join(f"{k}_{j}" for j in range(k % 50)), f"s{k % 4}", 1, "x") for k in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    parts = mixed_texts(docs, mix_sources(docs, block_words=16).schedule).collect()
    held = {}
    for r in sorted(parts, key=lambda r: r["slot"]):
        words = r["words"].split(" ")
        assert len(words) == r["n_words"]
        held.setdefault((r["pass"], r["doc_id"]), []).extend(words)
    for k in range(120):  # of the first pass whole, but where a source's target is smaller than its size
        if len(held.get((0, k), [])) == k % 50:
            assert sorted(held.get((0, k), [])) == sorted(f"{k}_{j}" for j in range(k % 50))
    assert sum(len(v) for v in held.values()) == sum(r["n_words"] for r in parts)


def test_words_and_empty_tables(spark):
    texts = ["", "a", " a\tb\x0bc ", "\xa0", " x y", "a" * 100000 + " b", "\r\n", "\x1c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count(df["t"])).collect()] == [len(WORD.findall(t)) for t in texts]
    none = mix_sources(spark.createDataFrame([], SCHEMA))
    assert none.documents.collect() == [] and none.schedule.collect() == []
    empty = mix_sources(spark.createDataFrame([(1, None, None, 1, "x"), (1, " ", "a", 1, "x")], SCHEMA)).documents.collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def test_query_equals_its_sql_and_runs_no_python(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(ORACLE_SQL["op13_source_mix"])
    names = [d[0] for d in want.description]
    got = QUERIES["op13_source_mix"](spark, "/root/testdata/sf0.001").select(names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
