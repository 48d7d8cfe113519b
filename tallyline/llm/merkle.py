"""Merkle manifest of a dataset: a tree of digests for each group of rows, a tree over the groups' roots, proofs by row.

A level of the tree is kept as text: each aligned block of 8^3 nodes holds its level as one string of hex digests of fixed
width. Parents are the hashes of fixed-width substrings of 8 digests, siblings are the substrings that flank a node's own, and
the blocks' top digests are the nodes of the next round, until a group has one node. Strings are kept as binary, where a
substring takes time by its own length and not by its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import prefixed
from .common import ascii_lower, cut_lineage

#: Children of a node.
FAN = 8
#: Levels that a block folds; it holds FAN ** BLOCK_LEVELS nodes at most.
BLOCK_LEVELS = 3
_BLOCK = FAN**BLOCK_LEVELS
_DIGEST = 64  # characters of a SHA-256 digest in hex
_RUN = FAN * _DIGEST
#: Tampering is rehearsed on the rows whose CRC-32 of the id this divides.
TAMPER_MOD = 3


def record_digest(values: list[Column]) -> Column:
    """SHA-256 of the values one after the other: "-" for a null, else the count of UTF-8 bytes, a colon, the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _parents(level: Column) -> Column:
    """The level above: the digests of each FAN digests of ``level``, the last of what is left."""
    runs = F.ceil(F.octet_length(level) / _RUN)
    digests = F.transform(F.sequence(F.lit(0), (runs - 1).cast("int")), lambda k: F.sha2(F.substring(level, k * _RUN + 1, F.lit(_RUN)), 256))
    return F.array_join(digests, "").cast("binary")


def _flanks(level: Column, node: Column) -> Column:
    """What stands before and behind ``node`` in its run of the level."""
    first = node - node % FAN
    left = F.substring(level, first * _DIGEST + 1, (node - first) * _DIGEST)
    right = F.substring(level, (node + 1) * _DIGEST + 1, (first + FAN - 1 - node) * _DIGEST)  # ends where the level does
    return F.struct(left.alias("left"), right.alias("right"))


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes: the powers of FAN below n."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(21)]), lambda p: p < n))


def _blocks(nodes: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """(grp, block, n, height, nodes, level0.., top) from (grp, pos, hash, row), and n, which ``sizes`` gives where it isn't there."""
    held = F.array_sort(F.collect_list(F.struct("pos", "hash", "row"))).alias("nodes")
    n = [] if sizes is not None else [F.first("n").alias("n")]
    blocks = nodes.groupBy("grp", (F.col("pos") / _BLOCK).cast("long").alias("block")).agg(held, *n)
    if sizes is not None:
        blocks = blocks.join(sizes.select(F.col("grp").alias("g"), "n"), F.col("grp").eqNullSafe(F.col("g"))).drop("g")
    levels = blocks.withColumn("height", F.least(_height(F.col("n")), F.lit(BLOCK_LEVELS)))
    levels = levels.withColumn("level0", F.array_join(F.transform("nodes", lambda x: x["hash"]), "").cast("binary"))
    for k in range(BLOCK_LEVELS):
        levels = levels.withColumn(f"level{k + 1}", F.when(F.col("height") > k, _parents(F.col(f"level{k}"))))
    top = F.coalesce(*[F.col(f"level{k}") for k in range(BLOCK_LEVELS, -1, -1)])
    return cut_lineage(levels.withColumn("top", top.cast("string")))


def _rounds(nodes: DataFrame, sizes: DataFrame) -> list[DataFrame]:
    """The blocks of each round; those of the last are their groups' roots. ``sizes``: (grp, n)."""
    most = sizes.agg(F.max("n")).first()[0] or 1
    rounds = [_blocks(nodes, sizes)]
    while most > _BLOCK:
        most = -(-most // _BLOCK)
        above = rounds[-1].select("grp", F.col("block").alias("pos"), F.col("top").alias("hash"), F.lit(None).cast("int").alias("row"), F.ceil(F.col("n") / _BLOCK).alias("n"))
        rounds.append(_blocks(above, None))
    return rounds


def _descend(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(row, hash, path, and the columns of ``roots``) of the first round's nodes: path has the siblings level by level up to
    the root. ``roots``: grp, path above the group's root and further columns."""
    carried = [c for c in roots.columns if c not in ("grp", "path")]
    above = roots.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        upper = above.select(F.col("grp").alias("g"), F.col("pos").alias("p"), F.col("path").alias("upper"), *carried)
        met = blocks.join(upper, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("p")))
        nodes = met.select("grp", "block", "height", "upper", *carried, *[f"level{k}" for k in range(BLOCK_LEVELS)], F.posexplode("nodes").alias("at", "node"))
        own = F.slice(F.array(*[_flanks(F.col(f"level{k}"), F.floor(F.col("at") / FAN**k).cast("int")) for k in range(BLOCK_LEVELS)]), F.lit(1), F.col("height"))
        above = nodes.select("grp", (F.col("block") * _BLOCK + F.col("at")).alias("pos"), "node.row", "node.hash", F.concat(own, "upper").alias("path"), *carried)
    return above.select("row", "hash", "path", *carried)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, from left to right."""
    return F.sha2(F.aggregate(path, F.lit("").cast("binary"), lambda a, x: F.concat(a, x["left"], x["right"])), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of ``path``."""
    return F.aggregate(path, leaf.cast("binary"), lambda a, x: F.sha2(F.concat(x["left"], a, x["right"]), 256).cast("binary")).cast("string")


def merkle_manifest(rows: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", rehearse: bool = False) -> DataFrame:
    """One row per row of ``rows``: id, leaf, subroot, root and path, an array of (left, right) siblings from the leaf's level
    up to the root; with ``rehearse`` also altered, the leaf after tampering with the text (its A-Z lower-cased) of the rows
    whose id's CRC-32 is divisible by TAMPER_MOD, null for the others and for null ids.

    Leaves ascend by id in their group, null first, equal ids by leaf; while there are several, each FAN in turn become the
    digest of their digests, the last run with fewer, even one. The groups' roots, by group in the order of UTF-8 bytes, null
    first, are joined to the root in the same way. A group of one row has its leaf as its root. Null and empty texts differ ("-" and "0:").
    Repeated rows are leaves of their own. Other columns are ignored, whatever their names. An empty table gives an empty result.

    Texts are read once and never exchanged; numbers and digests are exchanged twice, a group of any share of the rows
    by ranges and by blocks of 512. What is written: the leaves, their order, the blocks of each round.
    """
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    altered = record_digest([ascii_lower(F.col(c).cast("string")) if c == text_col else F.col(c) for c in columns])
    told = F.when(crc % TAMPER_MOD == 0, altered) if rehearse else F.lit(None).cast("string")
    leaves = cut_lineage(rows.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), record_digest([F.col(c) for c in columns]).alias("hash"), told.alias("altered")))
    sizes = cut_lineage(leaves.groupBy("grp").agg(F.count("*").alias("n")))

    placed = prefixed(leaves, order=[F.col("id").asc_nulls_first(), F.col("hash")], within=["grp"], number="number")
    rounds = _rounds(placed.select("grp", (F.col("number") - 1).alias("pos"), "hash", F.struct("id", "altered").alias("row")), sizes)
    subroots = rounds[-1].select("grp", F.col("top").alias("hash"))
    ordered = prefixed(subroots, order=[F.col("grp").asc_nulls_first()], number="number").select(F.lit(0).alias("grp"), (F.col("number") - 1).alias("pos"), "hash", F.struct(F.col("grp").alias("member")).alias("row"))
    forest = _rounds(ordered, sizes.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(0).alias("grp"), "n"))

    no_path = F.array().cast("array<struct<left:binary,right:binary>>")
    members = _descend(forest, forest[-1].select("grp", no_path.alias("path"), F.col("top").alias("root")))
    found = _descend(rounds, members.select(F.col("row.member").alias("grp"), "path", F.col("hash").alias("subroot"), "root"))
    return found.select(F.col("row.id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "path", *([F.col("row.altered").alias("altered")] if rehearse else []))


def tamper_report(manifest: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root (of the altered leaf, else the original one, with the original siblings)
    and verified, for the result of ``merkle_manifest(rehearse=True)``."""
    root = folded(F.coalesce("altered", "leaf"), F.col("path"))
    out = manifest.select(F.col(id_col), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
