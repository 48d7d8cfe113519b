"""SimHash near-dedup by covering locality-sensitive hashing.

For radius 3, every fingerprint bit i is given one of the 15 non-zero vectors m(i) of GF(2)^4, and every non-zero
vector v gives a mask that keeps the bits with <m(i), v> = 1. The vectors of three differing bits span at most three
dimensions, so some v is orthogonal to all of them, its mask keeps none of them, and the pair collides in that table:
no pair within the radius can be missed. A bucket with too many fingerprints is not capped but refined: the same
construction is applied to the bits its mask left free, which keeps the guarantee. Three levels leave at most seven
bits free, so no bucket of the last level can hold more than 128 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, bound_batches, carried, cut_lineage, text_of, without
from .components import connected_components

RADIUS = 3
BITS = 64
SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints in a bucket that one task compares with each other; larger buckets are refined. At least 128.
BUCKET = 256
LEVELS = 3
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_ALL = (1 << BITS) - 1
_BLOCK = 1 << 15  # shingles whose bits are unpacked at once


def fingerprint(data: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed integer."""
    words = data.translate(_LOWER).split()  # bytes.split() cuts at [\x20\x09-\x0D]+
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        cuts = zip((ends - sizes)[: 1 - SHINGLE_WORDS].tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], SEED) for i, j in cuts]
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), _BLOCK):
        counts += np.unpackbits(h[k : k + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp) per row of ``docs``; a null text counts as empty (fingerprint zero)."""
    bound_batches(docs)
    rows = docs.select(carried(id_col).alias("doc"), F.encode(text_of(text_col), "UTF-8").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc"], "fp": np.array([fingerprint(bytes(x)) for x in batch["data"]], dtype=np.int64)})

    return rows.mapInPandas(run, "doc string, fp bigint").select(F.col("doc").cast("bigint").alias("doc"), "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(kept: int = 0) -> list[int]:
    """Masks (unsigned) that keep the bits of ``kept`` and cover the others: 2^(RADIUS+1) - 1 of them."""
    top = 1 << (RADIUS + 1)
    free = [i for i in range(BITS) if not kept >> i & 1]
    vector = {bit: 1 + k % (top - 1) for k, bit in enumerate(free)}
    return [kept | sum(1 << bit for bit, m in vector.items() if (m & v).bit_count() % 2) for v in range(1, top)]


def _mask_table(spark: SparkSession, level: int) -> DataFrame:
    """(path, next_path, mask) of a level: 15^level rows, whatever the input."""
    found = [(0, 0)]
    for _ in range(level - 1):
        found = [(path * 16 + k + 1, mask) for path, kept in found for k, mask in enumerate(covering_masks(kept))]
    rows = [(path, path * 16 + k + 1, _signed(mask)) for path, kept in found for k, mask in enumerate(covering_masks(kept))]
    return spark.createDataFrame(rows, "path bigint, next_path bigint, mask bigint")


def _forest(fps: list[int]) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among a bucket's fingerprints (signed)."""
    if len(fps) == 2:
        if ((fps[0] ^ fps[1]) & _ALL).bit_count() <= RADIUS:
            yield fps[0], fps[1]
        return
    left, queue = np.array(fps, dtype=np.int64), []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count((left ^ at).view(np.uint64)) <= RADIUS
        found, left = left[near], left[~near]
        yield from ((int(at), int(x)) for x in found)
        queue.extend(found)


def _bucket_edges(buckets: DataFrame) -> DataFrame:
    """Edges within each bucket; ``fps`` holds BUCKET fingerprints at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edges = [edge for fps in batch["fps"] for edge in _forest(fps.tolist())]
            yield pd.DataFrame(np.array(edges, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])

    return buckets.mapInPandas(run, "a bigint, b bigint")


def linking_edges(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of ``fps`` (column fp) that connect all pairs within the radius."""
    spark = fps.sparkSession
    rows = fps.select("fp").distinct().withColumn("path", F.lit(0).cast("bigint"))
    edges = None
    for level in range(1, LEVELS + 1):
        keyed = rows.join(F.broadcast(_mask_table(spark, level)), "path").select("fp", "next_path", F.xxhash64("next_path", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
        sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("bucket").alias("size_key"), "n")
        # Joined on a hash of the bucket, so that both sides are exchanged and a large bucket can be split.
        shared = cut_lineage(keyed.withColumn("bucket_key", F.xxhash64("bucket")).join(sizes, F.col("bucket_key") == F.col("size_key")).select("fp", "next_path", "bucket", "n"))
        found = _bucket_edges(shared.where(F.col("n") <= BUCKET).groupBy("bucket").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps"))
        edges = found if edges is None else edges.unionByName(found)
        large = shared.where(F.col("n") > BUCKET)
        if level == LEVELS or large.isEmpty():
            break
        rows = large.select("fp", F.col("next_path").alias("path"))
    return edges


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Fingerprints link at RADIUS or fewer differing bits; equal ones (copies, and all empty texts, at zero) are one class
    from the start, so groups of copies cost nothing more. Null texts count as empty. Repeated rows keep a row each.
    Null ids stay null; a component whose ids are all null has a null component_id. Other columns are ignored, whatever
    their names. An empty table gives an empty result. Texts are read whole, in blocks of bounded memory beyond the
    text itself.
    """
    fps = cut_lineage(fingerprints(docs, id_col=id_col, text_col=text_col))
    classes = fps.groupBy("fp").agg(F.min("doc").alias("first_doc"))
    labels = connected_components(linking_edges(fps)).withColumnRenamed("node", "fp")
    rooted = cut_lineage(classes.join(labels, "fp", "left").select("fp", "first_doc", F.coalesce("component", "fp").alias("root")))
    roots = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")).select(F.xxhash64("root").alias("root_key"), "component_id")
    by_class = rooted.withColumn("class_root", F.xxhash64("root")).join(roots, F.col("class_root") == F.col("root_key")).select(F.xxhash64("fp").alias("class_key"), "component_id")
    joined = fps.withColumn("doc_key", F.xxhash64("fp")).join(by_class, F.col("doc_key") == F.col("class_key"))
    return joined.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, all columns. Rows with a null id are kept."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    dropped = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("dropped_id")).distinct()
    return without(docs, dropped, id_col)
