"""SimHash near-dedup on sets of five-word shingles, links confirmed by the exact similarity of the sets.

Texts whose sets of ``WORDS``-word shingles have a Jaccard similarity of LEAST or more link. Candidates share a key:

- the covering tables of ``simhash``: a SimHash fingerprint of the set under each of the 15 masks, so that every pair
  within RADIUS bits is a candidate;
- BANDS keys of ROWS minima of the same shingle hashes each. They are needed because fingerprints can't carry this
  threshold: at a similarity of 0.8 they differ in 10 of 64 bits on average and in up to 17 of them, and masks that
  cover 17 bits would be 2^18 tables. A pair at 0.8 shares no band with a probability of (1 - 0.8^5)^20 = 0.0004.

Every candidate is confirmed on the whole sets.

Equal sets are one class from the start. Small buckets give all their pairs, at most SMALL - 1 for a member. Members of
larger ones are compared with one pivot first, which settles groups of near copies; only buckets whose members are then
in several components are compared in full, in blocks, pairs within a component left out. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, bound_batches, carried, cut_lineage, filter_bits, filter_blocks, slot, text_of, with_mark, without
from .components import connected_components
from .simhash import covering_masks

WORDS = 5
LEAST = 0.8
BANDS = 20
ROWS = 5
#: Members of a bucket whose pairs are all emitted; members of a block that one task compares with another's.
SMALL = 32
BLOCK = 1024
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_MASKS = np.array(covering_masks(), dtype=np.uint64)
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def shingles(data: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's shingles; fewer words than ``size`` are one shingle."""
    words = data.translate(_LOWER).split()  # bytes.split() cuts at [\x20\x09-\x0D]+
    if not words:
        return np.array([], dtype=np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[i:j]) for i, j in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64))


def fingerprint_of(found: np.ndarray) -> np.uint64:
    """SimHash of a set of 64-bit hashes: a bit is 1 if set in over half of them."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(found), 1 << 15):
        counts += np.unpackbits(found[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)[0]


def keys_of(found: np.ndarray) -> np.ndarray:
    """The keys that a set of shingle hashes is filed under, of its masked fingerprint and its bands, as signed integers;
    none for an empty set."""
    if not len(found):
        return np.array([], dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), 2048):
        least = np.minimum(least, (found[None, k : k + 2048] * _FACTORS[:, None] + _TERMS[:, None]).min(axis=1))
    rows = [*least.reshape(BANDS, ROWS), *(fingerprint_of(found) & _MASKS)]
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], dtype=np.uint64).view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.encode(text_of(text_col), "UTF-8").alias("data"))


def _key(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes())], dtype=np.uint64).view(np.int64)[0])


def _sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc, key, n, buckets) per row: key names the set, n is its size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(_key(s), len(s), keys_of(s)) for s in (shingles(bytes(x), size) for x in batch["data"])]
            yield pd.DataFrame({"doc": batch["doc"], "key": [x[0] for x in out], "n": [x[1] for x in out], "buckets": [x[2] for x in out]})

    rows = _rows(docs, id_col, text_col).select(carried("doc").alias("doc"), "data")
    return rows.mapInPandas(run, "doc string, key bigint, n bigint, buckets array<bigint>").withColumn("doc", F.col("doc").cast("bigint"))


def _sets(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(key, shingles) of the classes that have a row among the ids in ``asked`` (column doc), others now and then."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [shingles(bytes(x), size) for x in batch["data"]]
            yield pd.DataFrame({"key": [_key(s) for s in out], "shingles": [s.view(np.int64) for s in out]})

    rows, bits = _rows(docs, id_col, text_col), filter_bits(asked.count())
    if bits is not None:
        mark = slot("doc", bits=bits)
        rows = with_mark(rows.withColumn("slot", mark), filter_blocks(asked.select(mark.alias("slot"))), "may_be").where("may_be")
    return rows.select("data").mapInPandas(run, "key bigint, shingles array<bigint>").groupBy("key").agg(F.any_value("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = sets.select(F.xxhash64("key").alias("k1"), F.col("shingles").alias("s1"))
    two = sets.select(F.xxhash64("key").alias("k2"), F.col("shingles").alias("s2"))
    met = pairs.withColumn("h1", F.xxhash64("a")).join(one, F.col("h1") == F.col("k1")).withColumn("h2", F.xxhash64("b")).join(two, F.col("h2") == F.col("k2"))
    both = F.size(F.array_intersect("s1", "s2"))
    return met.where(both / (F.size("s1") + F.size("s2") - both) >= least).select("a", "b")


def _cross_links(keys: list[int], labels: list[int], sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Edges that join the members of different labels that are similar enough."""
    label, sizes = np.unique(labels, return_inverse=True)[1], np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    largest = np.bincount(label).argmax()
    marks = np.zeros(flat.max() + 1, dtype=bool)
    for i in np.flatnonzero(label != largest):
        own = flat[starts[i] : starts[i] + sizes[i]]
        marks[own] = True
        both = np.add.reduceat(marks[flat], starts, dtype=np.int64)
        marks[own] = False
        hits = np.flatnonzero((both / (sizes + sizes[i] - both) >= least) & (label != label[i]))
        for other in np.unique(label[hits], return_index=True)[1]:
            yield keys[i], keys[hits[other]]


def _full_edges(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges between the components (column label) that meet in a bucket, every pair of its blocks compared."""
    counts = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count_distinct("label").alias("labels")).where("labels > 1")
    met = members.join(counts.select(F.xxhash64("bucket").alias("c"), "blocks"), F.xxhash64("bucket") == F.col("c")).withColumn("own", F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int"))
    dealt = met.select("bucket", "key", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "key", "label")
    filled = dealt.withColumn("h", F.xxhash64("key")).join(sets.select(F.xxhash64("key").alias("s"), "shingles"), F.col("h") == F.col("s"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("key")
        found = list(_cross_links(part["key"].tolist(), part["label"].tolist(), [np.asarray(s) for s in part["shingles"]], least))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return filled.select("block", "key", "label", "shingles").groupBy("block").applyInPandas(run, "a bigint, b bigint")


def similar_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: id, component_id (smallest id reachable by links).

    Null and empty texts are one class, linked with nothing else. Null ids stay null; a component whose ids are all null
    has a null component_id. Repeated rows keep a row each; other columns are ignored; an empty table gives an empty
    result.
    """
    bound_batches(docs)
    sketches = cut_lineage(_sketches(docs, id_col, text_col, words))
    classes = sketches.groupBy("key").agg(F.min("doc").alias("first_doc"), F.any_value("n").alias("n"), F.any_value("buckets").alias("buckets"))
    filed = classes.select("key", "n", F.explode("buckets").alias("bucket"))
    sizes = filed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select(F.xxhash64("bucket").alias("size_key"), "members")
    shared = cut_lineage(filed.withColumn("bucket_key", F.xxhash64("bucket")).join(sizes, F.col("bucket_key") == F.col("size_key")).select("bucket", "key", "n", "members"))

    one, small = F.struct("key", "n"), shared.where(F.col("members") <= SMALL)
    groups = small.groupBy("bucket").agg(F.collect_list(one).alias("all")).select("all", F.posexplode("all").alias("at", "x"))
    pairs = groups.select("x", F.explode(F.slice("all", F.col("at") + 2, F.size("all") - F.col("at") - 1)).alias("y"))
    large = shared.where(F.col("members") > SMALL)
    pivots = large.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("key", "bucket").alias("place"), "key", "n")).alias("first")).select(F.xxhash64("bucket").alias("pivot_key"), F.struct("first.key", "first.n").alias("x"))
    stars = large.withColumn("bucket_key", F.xxhash64("bucket")).join(pivots, F.col("bucket_key") == F.col("pivot_key")).select("x", F.struct("key", "n").alias("y"))
    close = F.least("x.n", "y.n") / F.greatest("x.n", "y.n") >= least  # no other sizes can be similar enough
    asked = pairs.unionByName(stars).where(close).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).where("a < b").distinct()

    wanted = shared.select(F.xxhash64("key").alias("w")).distinct()
    ids = cut_lineage(sketches.select("doc", F.xxhash64("key").alias("h")).join(wanted, F.col("h") == F.col("w"), "left_semi").select("doc"))
    sets = cut_lineage(_sets(docs, ids, id_col, text_col, words))
    edges = cut_lineage(_confirmed(asked, sets, least))
    found = connected_components(edges)
    if not large.isEmpty():
        labelled = large.withColumn("h", F.xxhash64("key")).join(found.select(F.xxhash64("node").alias("f"), "component"), F.col("h") == F.col("f"), "left")
        found = connected_components(edges.unionByName(_full_edges(labelled.select("bucket", "key", F.coalesce("component", "key").alias("label")), sets, least)))

    labels = found.select(F.xxhash64("node").alias("f"), "component")
    rooted = cut_lineage(classes.withColumn("h", F.xxhash64("key")).join(labels, F.col("h") == F.col("f"), "left").select("key", "first_doc", F.coalesce("component", "key").alias("root")))
    roots = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")).select(F.xxhash64("root").alias("root_key"), "component_id")
    by_class = rooted.withColumn("class_root", F.xxhash64("root")).join(roots, F.col("class_root") == F.col("root_key")).select(F.xxhash64("key").alias("class_key"), "component_id")
    return sketches.withColumn("doc_key", F.xxhash64("key")).join(by_class, F.col("doc_key") == F.col("class_key")).select(F.col("doc").alias(id_col), "component_id")


def keep_one_of_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, all columns.

    Rows with a null id are kept; rows repeated with their id are kept or dropped together; null and empty texts are one
    class; an empty table gives an empty result; columns may have any names.
    """
    found = similar_texts(docs, id_col=id_col, text_col=text_col)
    return without(docs, found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("dropped_id")).distinct(), id_col)
