"""Hard-negative mining by the threshold algorithm over shards.

Candidates are dealt into shards of bounded size, anchors into blocks. A task holds one shard beside one block: for each
dimension the shard's rows sorted by their integer component. An anchor walks each list from the end that its own component's
sign favours, fetches the whole vectors of rows it has not met, and scores them. What it has not met can't score more than the
threshold, the inner product of the anchor with the components it stands at. It stops once the threshold is strictly below
the k-th score of each of its windows, or below a window that has fewer. The shards' first k rows are then merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_partitions

#: Candidates of a shard and anchors of a block, at most about; a smaller table has a shard for each partition of a shuffle,
#: of LEAST rows.
SHARD = 8192
BLOCK = 4096
LEAST = 256
#: Rows of each list that the first step takes; each further step takes as many as all before it.
STEP = 16
#: Pools up to which their sizes are broadcast; more are joined.
FEW_POOLS = 10_000
#: Inner products of doubles are exact below this.
_EXACT = 1 << 53
_FOUND = "anchor bigint, win int, row bigint, id bigint, score bigint"
_FOUND_ARROW = pa.schema([("anchor", pa.int64()), ("win", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of ``width`` integers; shorter ones end in zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max(max((n for n in c.combine_chunks().value_lengths().to_pylist()), default=0) for c in columns)


def _largest(vectors: np.ndarray) -> int:
    return max(abs(int(vectors.min(initial=0))), abs(int(vectors.max(initial=0))))


class Shard:
    """Candidates with their sorted lists, in doubles where inner products with anchors of components up to ``largest`` are exact
    in them, else in Python's integers."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, ids: pa.Array, largest: int) -> None:
        self.kind = np.float64 if _largest(vectors) * max(1, largest) * max(1, vectors.shape[1]) < _EXACT else object
        by_dimension = np.ascontiguousarray(vectors.T)
        self.lists = np.argsort(by_dimension, axis=1, kind="stable")
        self.sorted = np.take_along_axis(by_dimension, self.lists, axis=1).astype(self.kind)
        self.vectors, self.rows = vectors.astype(self.kind), rows
        self.no_id, self.ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int | None, int | None]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high), both included, None: open: the first k allowed rows by score, then id (null last), then
        row, as (score, place in the shard)."""
        n, a = len(self.rows), anchor.astype(self.kind)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        scores, met = np.zeros(n, dtype=self.kind), np.zeros(n, dtype=bool)
        kth: list = [low for low, _ in windows]
        depth = 0
        while depth < n:
            to = min(n, max(STEP, 2 * depth)) if len(up) + len(down) else n
            fresh = np.zeros(n, dtype=bool)
            fresh[self.lists[up, n - to : n - depth]] = True
            fresh[self.lists[down, depth:to]] = True
            if to == n:
                fresh[:] = True
            fresh &= ~met
            scores[fresh] = self.vectors[fresh] @ a
            met |= fresh
            threshold = a[up] @ self.sorted[up, n - to] + a[down] @ self.sorted[down, to - 1]
            seen = scores[met & allowed]
            kth = [self._kth(seen, low, high, k) for low, high in windows]
            if all(x is not None and threshold < x for x in kth):
                break
            depth = to
        usable = np.flatnonzero(met & allowed)
        return [self._first(scores, usable, x, high, k) for (_, high), x in zip(windows, kth, strict=True)]

    @staticmethod
    def _within(scores: np.ndarray, low: int | None, high: int | None) -> np.ndarray:
        held = np.ones(len(scores), dtype=bool)
        for x, compare in ((low, np.greater_equal), (high, np.less_equal)):
            if x is not None:
                held &= compare(scores, x).astype(bool)
        return held

    def _kth(self, seen: np.ndarray, low: int | None, high: int | None, k: int):
        """The k-th score in the window; with fewer rows, the window's low end."""
        inside = seen[self._within(seen, low, high)]
        if len(inside) < k:
            return low
        return np.partition(inside, len(inside) - k)[-k] if self.kind is np.float64 else sorted(inside)[-k]

    def _first(self, scores: np.ndarray, usable: np.ndarray, low, high: int | None, k: int) -> list[tuple[int, int]]:
        at = usable[self._within(scores[usable], low, high)]
        if self.kind is np.float64:
            order = at[np.lexsort((self.rows[at], self.ids[at], self.no_id[at], -scores[at]))]
        else:
            order = sorted(at, key=lambda j: (-scores[j], self.no_id[j], self.ids[j], self.rows[j]))
        return [(int(scores[j]), int(j)) for j in order[:k]]


def _found(anchors: pa.Table, candidates: pa.Table, *, k: int, same_label: bool, percent: int) -> pa.Table:
    """The first k rows of one shard for each window of one block's anchors."""
    if not anchors.num_rows or not candidates.num_rows:
        return _FOUND_ARROW.empty_table()
    width = _width(anchors["a_vec"], candidates["vec"])
    asked, labels = _matrix(anchors["a_vec"], width), candidates["label"].to_numpy()
    shard = Shard(_matrix(candidates["vec"], width), candidates["row"].to_numpy(), candidates["id"].combine_chunks(), _largest(asked))
    out: list[tuple] = []
    for vector, anchor, label, wins in zip(asked, anchors["a_row"].to_pylist(), anchors["a_label"].to_pylist(), anchors["a_wins"].to_pylist(), strict=True):
        if same_label:
            windows, allowed = {0: (None, None)}, (labels == label) & (shard.rows != anchor)
        else:
            lows = [-(-percent * p // 100) for p in wins]
            windows, allowed = {w: (low, p) for w, (low, p) in enumerate(zip(lows, wins, strict=True)) if low <= p}, labels != label
        if windows and allowed.any():
            for w, best in zip(windows, shard.search(vector, allowed, list(windows.values()), k), strict=True):
                out += [(anchor, w, int(shard.rows[j]), None if shard.no_id[j] else int(shard.ids[j]), min(max(score, -(1 << 63)), (1 << 63) - 1)) for score, j in best]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW) if out else _FOUND_ARROW.empty_table()


def _first_of_each(found: DataFrame, k: int) -> DataFrame:
    """The shards' rows merged: the first k of each anchor and window, numbered from 1. Spark takes k a partition before it exchanges them."""
    w = Window.partitionBy("anchor", "win").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(anchors: DataFrame, candidates: DataFrame, *, k: int, same_label: bool, percent: int = 0) -> DataFrame:
    """(anchor, win, row, id, score, rank) of ``anchors`` (row, label, vec, wins) against all ``candidates`` (row, id, label, vec),
    of the same label alone or of all others. Rows are dealt by shard and block of their pool, which is a label or all."""
    spark = candidates.sparkSession
    least = shuffle_partitions(spark)
    pool = F.col("label") if same_label else F.lit(0)
    anchors, candidates = anchors.withColumn("pool", pool), candidates.withColumn("pool", pool)
    held = candidates.groupBy("pool").agg(F.count("*").alias("held"))
    asking = anchors.groupBy(F.col("pool").alias("p")).agg(F.count("*").alias("asking"))
    shards = F.greatest(F.ceil(F.col("held") / SHARD), F.least(F.lit(least), F.ceil(F.col("held") / LEAST)))
    pools = cut_lineage(held.join(asking, F.col("pool") == F.col("p")).select("p", shards.alias("shards"), F.ceil(F.col("asking") / BLOCK).alias("blocks")))
    few = pools.count() <= FEW_POOLS

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(pools) if few else pools, F.col("pool") == F.col("p"))

    def of(count: str) -> Column:
        return F.pmod(F.xxhash64("row"), F.col(count))

    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    # Names of their own, since both sides come from one table.
    left = dealt(anchors).select("pool", every("shards").alias("shard"), of("blocks").alias("block"), *[F.col(c).alias(f"a_{c}") for c in ("row", "label", "vec", "wins")])
    right = dealt(candidates).select("pool", of("shards").alias("shard"), every("blocks").alias("block"), "row", "id", "label", "vec")
    key = ["pool", "shard", "block"]
    run = lambda a, c: _found(a, c, k=k, same_label=same_label, percent=percent)
    return _first_of_each(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, _FOUND), k)


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of components floor(scale x x); higher ones come first, ties by smaller id (null last), then in no
    fixed order. The rows for which ``anchor`` is true are the queries, held against all rows, in blocks. Their positives are
    the first ``positives`` other rows of their label; for each of them come the first ``negatives`` rows of another label
    with percent x positive_score <= 100 x score <= 100 x positive_score.

    Rows with a null label, a null vector, or a null or non-finite component take no part; null ids do, but as no anchors where
    ``anchor`` asks for the id. Components missing at the end of shorter vectors count as 0; scaled components and scores beyond a
    long saturate, and sums are exact at any size. Repeated rows are rows of their own, repeated anchors give repeated results. Other columns
    are ignored, whatever their names. An empty table, or one without anchors, gives an empty result.

    Exact: a shard is left only when no row that was not met could enter. Each candidate is exchanged once for every BLOCK anchors of its
    pool and each anchor once for every SHARD candidates; a task holds one of each, however large a label is.
    """
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), scaled.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    rows = cut_lineage(rows)
    asking = rows.where("asks").select("row", "id", "label", "vec", F.array().cast("array<bigint>").alias("wins"))
    near = cut_lineage(_search(asking.drop("id"), rows.drop("asks"), k=positives, same_label=True))

    met = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("positives"))
    asking = cut_lineage(asking.drop("wins").join(met, F.col("row") == F.col("anchor")))
    windows = F.transform("positives", lambda p: p["positive_score"])
    mined = _search(asking.select("row", "label", "vec", windows.alias("wins")), rows.drop("asks"), k=negatives, same_label=False, percent=percent)
    named = mined.select(F.col("anchor").alias("a"), "win", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    positive = F.element_at("positives", F.col("win") + 1)
    out = named.join(asking, F.col("a") == F.col("row"))
    return out.select(F.col("id").alias("anchor_id"), positive["positive_id"].alias("positive_id"), "rank", "negative_id", positive["positive_score"].alias("positive_score"), "negative_score")
