"""Embedding near-dedup over an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a product grid of cells; every vector is filed in its cell.
A vector visits the cells nearest to it in multi-sequence order (by the sum of its distances to the two codewords); how
many is measured, and the largest of these answers decides: TARGET_RECALL of the true links of vectors that are compared with
all, as many as LEAST_LINKS links take; the same within each band of cosines that has BAND_LINKS of them, so that a large group
of near copies doesn't speak for the others; and PLANTED_RECALL of pairs planted at the least cosine. The vectors measured are not
among those that the codebooks are fitted on. Visits are then verified in double precision. The codebooks are fitted on a bounded
sample; all vectors are filed and all vectors visit.

Equal vectors are one class from the start. Cells with many members, or many visitors, are dealt out in blocks of
bounded size. Pairs are never emitted: a block gives the links it found by vector, summed, and the edges of a spanning
forest. A pair that meets twice (each visits the other's cell) is counted once for each side.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, hash_sample, kind_of, shuffle_partitions
from .components import connected_components

LEAST_COSINE = 0.95
#: Classes that the codebooks are fitted on, for each codeword and at least, and the numbers they may hold together.
SAMPLE_OF_CODEWORD = 16
SAMPLE = 8192
SAMPLE_NUMBERS = 1 << 23
#: Classes of the sample whose links are found by brute force at first, to measure how many cells to visit; more of them
#: until so many links are found.
QUERIES = 192
LEAST_LINKS = 1000
TARGET_RECALL = 0.999
#: Cosines that part the links into bands, and the links from which a band is held to the recall by itself.
BANDS = (0.96, 0.97, 0.98, 0.99)
BAND_LINKS = 100
#: Vectors kept from the fit, a quarter of the sample at most, each given a partner as far as links can be, and the share of these
#: pairs to be met from either side.
PLANTED = 1024
PLANTED_RECALL = 0.98
#: Cells visited at least.
LEAST_VISITS = 4
#: Codewords of a half, at most: the grid grows with the classes up to its square.
CODEWORDS = 4096
#: Cells of a grid whose sizes are broadcast; those of a larger one are joined as Catalyst finds best.
BROADCAST_CELLS = 1 << 18
#: Members and visitors of a cell that one block compares.
MEMBERS = 2048
VISITORS = 16384
_SEED = 20
_LOG = logging.getLogger(__name__)


@dataclass
class MultiIndex:
    """Codebooks of the two halves (k x half dimension) of vectors padded to ``width``; of bounded size."""

    width: int
    first: np.ndarray
    second: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def unit(self, vectors) -> np.ndarray:
        """Unit vectors in double precision, shorter ones padded with zeros."""
        out = np.zeros((len(vectors), self.width))
        if len(vectors) and all(len(v) == self.width for v in vectors):
            out[:] = np.stack(vectors)
        else:
            for row, v in zip(out, vectors, strict=True):
                row[: len(v)] = v
        out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)  # no overflow in the squares
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return tuple(((b * b).sum(axis=1)[None, :] - 2 * a @ b.T) for a, b in ((unit[:, :half], self.first), (unit[:, half:], self.second)))

    def own_cells(self, unit: np.ndarray) -> np.ndarray:
        one, two = self.distances(unit)
        return one.argmin(axis=1) * len(self.second) + two.argmin(axis=1)

    def visits(self, unit: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` first cells in multi-sequence order, nearest first. The t-th cell pairs the i-th and j-th
        nearest codewords with i * j <= t, so only such pairs are looked at."""
        one, two = self.distances(unit)
        near = [np.argsort(d, axis=1, kind="stable") for d in (one, two)]
        pairs = np.array([(i, j) for i in range(min(count, len(self.first))) for j in range(min(count // (i + 1), len(self.second)))])
        a, b = near[0][:, pairs[:, 0]], near[1][:, pairs[:, 1]]
        sums = np.take_along_axis(one, a, axis=1) + np.take_along_axis(two, b, axis=1)
        order = np.argsort(sums, axis=1, kind="stable")[:, :count]
        return np.take_along_axis(a * len(self.second) + b, order, axis=1)


def _codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by Lloyd's rounds from k distinct points of the sample."""
    rng = np.random.default_rng(_SEED)
    centres = points[rng.choice(len(points), size=k, replace=False)].copy()
    for _ in range(rounds):
        nearest = ((centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)
        sums, sizes = np.zeros_like(centres), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, points)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def linkable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _fit(classes: DataFrame, total: int, width: int) -> tuple[MultiIndex, pd.DataFrame]:
    wanted = min(CODEWORDS, 1 << max(3, round(math.log2(math.sqrt(total) / 4))))
    sample = hash_sample(classes.select("cid", "size", "vector"), "cid", total, max(1, min(max(SAMPLE, SAMPLE_OF_CODEWORD * wanted), SAMPLE_NUMBERS // width))).toPandas()
    half = (width + 1) // 2
    index = MultiIndex(width, np.zeros((1, half)), np.zeros((1, width - half)))
    unit = index.unit(sample["vector"].iloc[_measured(sample) :].tolist())
    k = max(1, min(wanted, len(unit)))
    return MultiIndex(width, _codebook(unit[:, :half], k), _codebook(unit[:, half:], k)), sample


def _measured(sample: pd.DataFrame) -> int:
    """How many vectors at the head of the sample are kept from the fit."""
    return min(PLANTED, len(sample) // 4)


def _before(index: MultiIndex, one: np.ndarray, two: np.ndarray, cell: int) -> int:
    """Cells that a vector at distances ``one`` and ``two`` to the codewords visits before ``cell``."""
    a, b = divmod(int(cell), len(index.second))
    return int((one[:, None] + two[None, :] < one[a] + two[b]).sum())


def _link_ranks(classes: DataFrame, index: MultiIndex, asked: pd.DataFrame, least: float) -> list[tuple[int, int, int]]:
    """(band, cells before the link's, links) of the true links of ``asked``, found by brute force over all classes."""
    queries, ids = index.unit(asked["vector"].tolist()), asked["cid"].to_numpy()
    one, two = index.distances(queries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.iloc[k : k + 512]
                unit = index.unit(part["vector"].tolist())
                cosines = queries @ unit.T
                q, v = np.nonzero((cosines >= least) & (ids[:, None] != part["cid"].to_numpy()[None, :]))
                met, links = np.unique(np.stack([q, index.own_cells(unit)[v], np.searchsorted(BANDS, cosines[q, v], side="right")], axis=1), axis=0, return_counts=True)
                before = [_before(index, one[i], two[i], cell) for i, cell, _ in met]
                yield pd.DataFrame({"band": met[:, 2], "before": np.array(before, dtype=np.int64), "links": links.astype(np.int64)})

    # A row for each band and rank at most: no more than the grid has cells, five times.
    found = classes.select("cid", "vector").mapInPandas(run, "band long, before long, links long")
    return [tuple(r) for r in found.groupBy("band", "before").agg(F.sum("links")).collect()]


def _planted_ranks(index: MultiIndex, fresh: pd.DataFrame, least: float) -> list[tuple[int, int]]:
    """(cells before the partner's, 1) of partners at a cosine of just ``least``, the farthest that link, made for vectors that the
    codebooks have not seen: by turns in a random direction and towards another of them. A pair is met from either side."""
    rng = np.random.default_rng(_SEED)
    unit = index.unit(fresh["vector"].tolist())
    aim = rng.normal(size=unit.shape)
    aim[::2] = unit[rng.permutation(len(unit))][::2]
    aim -= (aim * unit).sum(axis=1, keepdims=True) * unit
    norm = np.linalg.norm(aim, axis=1, keepdims=True)
    partner = least * unit + math.sqrt(1 - least * least) * aim / np.maximum(norm, 1e-300)
    ranks = []
    for a, b in ((unit, partner), (partner, unit)):
        one, two = index.distances(a)
        ranks.append([_before(index, one[i], two[i], cell) for i, cell in enumerate(index.own_cells(b))])
    return [(min(pair), 1) for i, pair in enumerate(zip(*ranks, strict=True)) if norm[i] > 1e-9]


def _visits_for(ranks: list[tuple[int, int]], recall: float) -> int:
    """Cells to visit so that ``recall`` of the links in ``ranks`` are met; 1 where there are none."""
    total, seen = sum(n for _, n in ranks), 0
    for before, n in sorted(ranks):
        seen += n
        if seen >= recall * total:
            return before + 1
    return 1


def _measured_visits(classes: DataFrame, index: MultiIndex, sample: pd.DataFrame, least: float) -> int:
    """Cells to visit, as the head of this module says. Queries are added until they hold LEAST_LINKS links or the sample ends."""
    ranks, start, stop = [], 0, QUERIES
    while start < len(sample) and sum(n for *_, n in ranks) < LEAST_LINKS:
        ranks += _link_ranks(classes, index, sample.iloc[start:stop], least)
        start, stop = stop, 4 * stop
    bands = {band: [r[1:] for r in ranks if r[0] == band] for band in range(len(BANDS) + 1)}
    large = [r for r in bands.values() if sum(n for _, n in r) >= BAND_LINKS]
    planted = _planted_ranks(index, sample.iloc[: max(_measured(sample), min(len(sample), QUERIES))], least)
    count = max(min(LEAST_VISITS, index.cells), _visits_for([r[1:] for r in ranks], TARGET_RECALL), _visits_for(planted, PLANTED_RECALL), *[_visits_for(r, TARGET_RECALL) for r in large])

    def told(r: list[tuple[int, int]]) -> str:
        return f"{sum(n for before, n in r if before < count)} of {sum(n for _, n in r)}"

    edges = (least, *BANDS)
    _LOG.info("%d of %d cells are visited; links met of %d queries: %s; planted: %s", count, index.cells, min(start, len(sample)), ", ".join(f"{told(r)} from {edges[band]:g}" for band, r in bands.items()), told(planted))
    return count


def _compare(block: pd.DataFrame, visitors: pd.DataFrame, index: MultiIndex, least: float) -> Iterator[tuple]:
    """(a, b, links): links found for a (b null), or an edge of the forest (links null)."""
    members = index.unit(block["vector"].tolist())
    ids, sizes, size_of = block["cid"].to_numpy(), block["size"].to_numpy(), block["vector"].map(len).to_numpy()
    visits = np.stack(block["visits"].tolist())
    label, found = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
    for k in range(0, len(visitors), 1024):
        part = visitors.iloc[k : k + 1024]
        other, other_sizes, home = part["cid"].to_numpy(), part["size"].to_numpy(), part["home"].to_numpy()
        near = index.unit(part["vector"].tolist()) @ members.T >= least
        near &= (other[:, None] != ids[None, :]) & (part["vector"].map(len).to_numpy()[:, None] == size_of[None, :])
        links = near @ sizes
        for i in np.flatnonzero(links):
            hits = np.flatnonzero(near[i])
            yield int(other[i]), None, int(links[i])
            unmet = hits[~(visits[hits] == home[i]).any(axis=1)]  # these don't visit the visitor's cell themselves
            found[unmet] += other_sizes[i]
            roots = np.unique(label[hits])
            for r in roots[1:]:
                yield int(ids[roots[0]]), int(ids[r]), None
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
            yield int(other[i]), int(ids[roots[0]]), None
    yield from ((int(ids[i]), None, int(found[i])) for i in np.flatnonzero(found))


def _blocks(batches: Iterator[pd.DataFrame], index: MultiIndex, least: float) -> Iterator[pd.DataFrame]:
    """Reads the rows of blocks, sorted, members before visitors; holds the members of one block at a time."""
    at, members = None, []
    for batch in batches:
        keys = batch["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        out: list[tuple] = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            rows = batch.iloc[i:j]
            if keys[i] != at:
                at, members = keys[i], []
            visiting = rows["home"].notna().to_numpy()
            if not visiting.all():
                members.append(rows[~visiting])
            if visiting.any() and members:
                members = [pd.concat(members)] if len(members) > 1 else members
                out += _compare(members[0], rows[visiting], index, least)
        # As objects first: numbers next to a null would become floats.
        yield pd.DataFrame(out, columns=["a", "b", "links"], dtype=object).astype({"a": "Int64", "b": "Int64", "links": "Int64"})


def linked_classes(classes: DataFrame, *, least: float = LEAST_COSINE) -> DataFrame:
    """(a, b, links) over ``classes`` (cid, size, vector): summed links of a where b is null, else edges of a forest."""
    total, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not total:
        return classes.sparkSession.createDataFrame([], "a bigint, b bigint, links bigint")
    index, sample = _fit(classes, total, width)
    count = _measured_visits(classes, index, sample, least)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.iloc[k : k + 1024].copy()
                visits = index.visits(index.unit(part["vector"].tolist()), count)
                part["cell"], part["visits"] = visits[:, 0], list(visits)
                yield part

    filed = cut_lineage(classes.mapInPandas(file, f"cid bigint, size bigint, vector {kind_of(classes, 'vector')}, cell bigint, visits array<bigint>"))
    visits = filed.select("cid", "size", "vector", F.col("cell").alias("home"), F.explode("visits").alias("cell"))
    # A row for each cell of the grid at most.
    members = filed.groupBy("cell").agg(F.count("*").alias("members"))
    visitors = visits.groupBy("cell").agg(F.count("*").alias("visitors"))
    cells = members.join(visitors, "cell").select("cell", F.ceil(F.col("members") / MEMBERS).cast("int").alias("rows"), F.ceil(F.col("visitors") / VISITORS).cast("int").alias("columns"))
    cells = F.broadcast(cells) if index.cells <= BROADCAST_CELLS else cells
    spread = F.xxhash64("cid", F.lit(_SEED))
    block = F.xxhash64("cell", "row", "column").alias("block")
    filed_rows = filed.join(cells, "cell").select(
        "cid", "size", "vector", "visits", F.lit(None).cast("bigint").alias("home"), "cell", F.pmod(spread, F.col("rows")).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column")
    )
    visit_rows = visits.join(cells, "cell").select(
        "cid", "size", "vector", F.lit(None).cast("array<bigint>").alias("visits"), "home", "cell", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(spread, F.col("columns")).cast("int").alias("column")
    )
    dealt = filed_rows.unionByName(visit_rows).select("cid", "size", "vector", "visits", "home", block)
    parts = shuffle_partitions(classes.sparkSession)
    return dealt.repartition(parts, "block").sortWithinPartitions("block", F.col("home").isNotNull()).mapInPandas(lambda batches: _blocks(batches, index, least), "a bigint, b bigint, links bigint")


def embedding_links(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    n_links counts the other rows whose vector has a cosine of ``least`` or more with the row's, component_id is the
    smallest id reachable by links, kept says that this is the row's own. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing; vectors of different lengths don't link. A null id links with
    nothing: n_links 0, component_id null, kept true. A row repeated with its id counts as another row, and both are
    kept or dropped together. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    # Single precision stays as it is, everything else is compared as it comes in double precision.
    vector = F.col(vector_col) if kind_of(vectors, vector_col) == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec"), vector.alias("vector"), (linkable(vector) & F.col(id_col).isNotNull()).alias("linkable"))
    keyed = rows.select("vec", F.when(F.col("linkable"), F.xxhash64("vector")).alias("k1"), F.when(F.col("linkable"), F.xxhash64(F.lit(_SEED), F.col("vector"))).alias("k2"), F.when(F.col("linkable"), F.col("vector")).alias("vector"))
    classes = cut_lineage(keyed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec").cast("bigint").alias("cid"), F.count("*").alias("size"), F.any_value("vector").alias("vector")))
    found = cut_lineage(linked_classes(classes.select("cid", "size", "vector"), least=least))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    components = connected_components(found.where("b IS NOT NULL")).select(F.col("node").alias("cid"), "component")
    known = (
        classes.join(links, "cid", "left")
        .join(components, "cid", "left")
        .select(F.xxhash64("k1", "k2").alias("class_key"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    )
    # The extra key makes this exchange both sides, so that a vector with very many copies can be split.
    joined = keyed.drop("vector").withColumn("row_key", F.xxhash64("k1", "k2")).join(known, (F.col("row_key") == F.col("class_key")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.coalesce("component_id", F.col("vec").cast("bigint"))
    return joined.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec") == component, F.lit(True)).alias("kept"))
