"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of the surviving groups only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut_lineage, filter_bits, filter_blocks, slot, text_of, with_mark, without

#: Characters of the normalised text that the prefix hash covers.
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), ASCII_SPACE, text)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    return (
        text.withColumn("norm", normalised(F.col("text")))
        .select("doc", F.length("text").cast("long").alias("n_chars"), "norm", F.length("norm").alias("norm_len"))
        .withColumn("prefix_hash", F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)))
    )


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, full_hash, n_chars.

    Texts are equal when identical without white space; null counts as empty (and equals other empty texts). Of equal
    texts the row with the most code points stays, then the smallest id (null last), then the first row read: of
    repeated rows with one id exactly one is kept.

    Rounds: the first scan counts rows by normalised length, split by the hash of the first PREFIX_CHARS characters
    (both keys are cheap, so one pass serves both); the bits of keys that occur twice go into a filter, as large as their
    count asks; where that would pass its bound, all rows go on. The second scan takes the full SHA-256 only of rows whose bit is set (of all rows with ``hash_all``). A false bit
    costs a hash, never a wrong group. Texts never enter a shuffle; only ids, lengths and hashes do. The hashed rows
    are checkpointed, since they are read twice and carry row numbers.
    ``full_hash`` is null for rows that no earlier round let through, which are alone in their group.
    Other columns of the input are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = _scan(docs, id_col, text_col)
    survivors = cut_lineage(rows.groupBy("norm_len", "prefix_hash").agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1").select("norm_len", "prefix_hash"))
    bits = filter_bits(survivors.count())
    if bits is None:
        scanned = rows.withColumn("survives", F.lit(True))
    else:
        key = slot("norm_len", "prefix_hash", bits=bits)
        scanned = with_mark(rows.withColumn("slot", key), filter_blocks(survivors.select(key.alias("slot"))), "survives")
    digest = F.sha2("norm", 256)
    hashed = cut_lineage(
        scanned.select(
            "doc",
            "n_chars",
            "survives",
            (digest if hash_all else F.when(F.col("survives"), digest)).alias("full_hash"),
            F.monotonically_increasing_id().alias("row_no"),
        )
    )

    best = F.struct((-F.col("n_chars")).alias("fewest"), F.col("doc").isNull().alias("no_doc"), "doc", "row_no")
    groups = (
        hashed.where("survives")
        .groupBy("full_hash")
        .agg(F.count("*").alias("size"), F.min(best).alias("first"))
        .where("size > 1")
        .select(F.xxhash64("full_hash").alias("group_key"), F.col("full_hash").alias("group_hash"), "size", F.col("first.doc").alias("first_doc"), F.col("first.row_no").alias("first_row"))
    )
    # The extra key makes this exchange both sides, so that a group with a large share of the rows can be split.
    joined = hashed.withColumn("row_key", F.xxhash64("full_hash")).join(groups, (F.col("row_key") == F.col("group_key")) & (F.col("full_hash") == F.col("group_hash")), "left")
    alone = F.col("size").isNull()
    return joined.select(
        F.col("doc").alias(id_col),
        F.when(alone, F.col("doc")).otherwise(F.col("first_doc")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_no") == F.col("first_row"))).alias("kept"),
        "full_hash",
        "n_chars",
    )


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each group of equal texts; see ``exact_groups``. Only the
    groups that survive length and prefix hash are hashed in full.

    Rows of ids that only go are left out by a filter and an anti join on the id alone. An id of which one row goes and
    another stays (rows repeated with their id, or ids that are not unique) is settled by the text's hash apart from the
    others; where there is none, that part is not run.
    """
    groups = exact_groups(docs, id_col=id_col, text_col=text_col)
    told = cut_lineage(groups.where("group_size > 1").select(F.col(id_col).alias("told_id"), F.col("full_hash").alias("told_hash"), "kept"))
    gone = told.where("NOT kept").select("told_id").distinct()
    mixed = cut_lineage(groups.where("kept").select(F.col(id_col).alias("told_id")).join(gone.withColumnRenamed("told_id", "gone_id"), F.col("told_id").eqNullSafe(F.col("gone_id")), "left_semi").distinct())
    if mixed.isEmpty():
        return without(docs, gone, id_col)
    once = without(docs, gone, id_col)
    groups = exact_groups(docs, id_col=id_col, text_col=text_col, hash_all=True)
    keep = groups.where("kept").select(F.col(id_col).alias("told_id"), F.col("full_hash").alias("told_hash")).distinct()
    inner = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # no clash with our own names
    own_id, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    hashed = inner.withColumn("hash", F.sha2(normalised(text_of(text)), 256)).join(mixed, F.col(own_id).eqNullSafe(F.col("told_id")), "left_semi")
    settled = hashed.join(keep, F.col(own_id).eqNullSafe(F.col("told_id")) & (F.col("hash") == F.col("told_hash")), "left_semi")
    return once.unionByName(settled.dropDuplicates([own_id, "hash"]).drop("hash").toDF(*docs.columns))
