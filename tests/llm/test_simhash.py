import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from tallyline.llm import simhash
from tallyline.llm.components import connected_components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, links):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    for bits in itertools.combinations(range(64), 3):
        differing = sum(1 << b for b in bits)
        assert any(not m & differing for m in masks)
    kept = masks[4]
    free = [b for b in range(64) if not kept >> b & 1]
    for bits in itertools.combinations(free, 3):
        assert any(not m & sum(1 << b for b in bits) and m & kept == kept for m in simhash.covering_masks(kept))


def test_last_level_leaves_few_bits_free():
    least = min(m.bit_count() for a in simhash.covering_masks() for b in simhash.covering_masks(a) for m in simhash.covering_masks(b))
    assert 2 ** (64 - least) <= simhash.BUCKET


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b", "A b C", "a b c d a b c d", "é\xa0x y z w v", "w " * 70000 + "x"])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == plain_fingerprint(text)


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)  # so that large buckets are refined
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **_: docs)
    rng = random.Random(1)
    fps = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.append(x)
    fps += [0, 0, fps[3], 1 << 63, 7]
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    docs = spark.createDataFrame(pd.DataFrame({"doc": np.arange(len(fps)), "fp": signed}), "doc bigint, fp bigint")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    want = roots(fps, [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert [got[i]["component_id"] for i in range(len(fps))] == want
    assert [got[i]["fingerprint"] for i in range(len(fps))] == [f"{x:016x}" for x in fps]


def test_whole_operator_with_nulls_copies_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "the quick brown fox jumps", "z"), (3, "the quick brown fox jumps", "z"), (4, "The  QUICK brown\nfox jumps", None), (None, "lonely words here", "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] or -1 for r in simhash.keep_one_of_each(docs).collect()) == [-1, 1, 3, 3]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50)) and got[201] == 200 and len(got) == 93
