import numpy as np
import pandas as pd
import pytest

from tallyline.llm import embedding_dedup as ed


def brute(ids, vectors, least=0.95):
    good = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links, root = {i: 0 for i in range(len(ids))}, list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.float64(np.float32(vectors[i])), np.float64(np.float32(vectors[j]))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    root[max(x, y, key=lambda k: ids[k])] = min(x, y, key=lambda k: ids[k])
    return {ids[i]: (links[i], ids[find(i)]) for i in range(len(ids))}


@pytest.mark.parametrize("members", [2048, 7])
def test_against_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(ed, "MEMBERS", members)
    monkeypatch.setattr(ed, "VISITORS", 5 * members)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    near = base[rng.integers(0, 20, 150)] + rng.normal(size=(150, 16)) * 0.12
    vectors = [*base.tolist(), *near.tolist(), *[base[0].tolist()] * 5, [1e30] * 16, [2e30] * 16, [1e-30] * 16]
    ids = list(range(1000, 1000 + len(vectors)))[::-1]
    want = brute(ids, vectors)
    got = {r["vec_id"]: r for r in ed.embedding_links(spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id bigint, embedding array<float>")).collect()}
    asked, met = sum(n for n, _ in want.values()), sum(r["n_links"] for r in got.values())
    assert met <= asked and met >= 0.97 * asked
    assert all(got[i]["n_links"] <= want[i][0] and got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)
    assert np.mean([got[i]["component_id"] == want[i][1] for i in ids]) >= 0.97


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, size int")
    got = sorted((tuple(r) for r in ed.embedding_links(df).collect()), key=lambda r: r[0] or 0)
    assert got == [(None, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *[(i, 0, i, True) for i in range(3, 10)]]
    assert ed.embedding_links(df.limit(0)).count() == 0


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(1)
    index = ed.MultiIndex(8, rng.normal(size=(9, 4)), rng.normal(size=(9, 4)))
    unit = index.unit(rng.normal(size=(30, 8)).tolist())
    one, two = index.distances(unit)
    sums = (one[:, :, None] + two[:, None, :]).reshape(30, -1)
    assert (index.visits(unit, 13) == np.argsort(sums, axis=1, kind="stable")[:, :13]).all()
    assert (index.visits(unit, 13)[:, 0] == index.own_cells(unit)).all()


@pytest.mark.parametrize("pairs", [0, 40])
def test_rare_pairs_are_met_though_few_queries_have_one(spark, pairs):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aim = rng.normal(size=(pairs, 32))
    aim -= (aim * base[:pairs]).sum(axis=1, keepdims=True) * base[:pairs]
    near = 0.952 * base[:pairs] + np.sqrt(1 - 0.952**2) * aim / np.linalg.norm(aim, axis=1, keepdims=True)
    vectors = np.concatenate([base, near])
    rows = [(i, 1, v) for i, v in enumerate(vectors.tolist())]
    classes = spark.createDataFrame(rows, "cid bigint, size bigint, vector array<float>").cache()
    index, sample = ed._fit(classes, len(rows), 32)
    count = ed._measured_visits(classes, index, sample, 0.95)
    unit = index.unit(base.tolist())
    aim = rng.normal(size=unit.shape)
    aim -= (aim * unit).sum(axis=1, keepdims=True) * unit
    partner = 0.95 * unit + np.sqrt(1 - 0.95**2) * aim / np.linalg.norm(aim, axis=1, keepdims=True)
    assert (index.visits(unit, count) == index.own_cells(partner)[:, None]).any(axis=1).mean() >= 0.95


def test_double_vectors_are_compared_as_they_are(spark):
    # The cosine is over the threshold in double precision only by less than single precision can tell.
    a, least = np.array([1.0, 0.0]), 0.95
    over, under = ([c, np.sqrt(1 - c * c)] for c in (least + 1e-12, least - 1e-12))
    for other, links in ((over, 1), (under, 0)):
        df = spark.createDataFrame([(1, a.tolist()), (2, [float(x) for x in other])], "vec_id bigint, embedding array<double>")
        assert [r["n_links"] for r in ed.embedding_links(df).collect()] == [links, links]


@pytest.mark.parametrize("group", [0, 1000])
def test_recall_of_planted_pairs_among_many_vectors(spark, group):
    """Also beside one large group of near copies, whose many links say nothing of rarer and farther ones."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(50_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)

    def at(cosine, of):
        aim = rng.normal(size=of.shape)
        aim -= (aim * of).sum(axis=1, keepdims=True) * of
        return cosine * of + np.sqrt(1 - cosine**2) * aim / np.linalg.norm(aim, axis=1, keepdims=True)

    vectors = np.concatenate([base, at(0.955, base[:200]), at(0.995, np.repeat(base[-1:], group, axis=0))]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(vectors)), "embedding": vectors.tolist()}), "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r["component_id"] for r in ed.embedding_links(df).where("vec_id >= 50000").collect()}
    assert sum(got[50_000 + i] == i for i in range(200)) >= 190
    assert all(got[50_200 + i] == 49_999 for i in range(group))
