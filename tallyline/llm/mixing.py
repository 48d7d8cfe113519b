"""Mixing sources to target weights by a low-discrepancy schedule of blocks. DataFrame functions only.

A source's documents are shuffled by a hash of their ids and laid end to end; the stream is cut into blocks of equal words.
The mix is a row of slots. Slot n gets the point n x golden ratio mod 1, which falls into the interval of one source among the
cumulative targets, so that every stretch of slots holds each source about as its target says. The r-th slot of a source takes
its r-th block, from the first one again when all are through; its last slot is cut where the target is reached. The few
slots that the points leave a source short of follow at the end, a source after the other in turn.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import prefixed
from .common import ASCII_SPACE, cut_lineage, text_of

#: Words of a block.
BLOCK_WORDS = 1024
#: Points are n x GOLDEN mod POINTS: all of them once in POINTS slots. GOLDEN is the odd number next to POINTS x 0.618...
POINTS = 1 << 31
GOLDEN = 1327217885
#: Sources up to which their figures are broadcast; more are joined.
FEW_SOURCES = 10_000


class Mix(NamedTuple):
    #: A row for each document: id, source, size, source_size, target, taken.
    documents: DataFrame
    #: A row for each part of a document in a slot: slot, source, pass, block, id, first_word (from 0), n_words.
    schedule: DataFrame


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text: each one and the space before it become a letter."""
    letters = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "w")
    return F.length(F.rtrim(letters, F.lit(ASCII_SPACE))).cast("long")


def _level(sources: DataFrame, total: float) -> float | None:
    """What a weight of 1 gets of ``total`` when no source gets more than its cap: each turn fixes those above it at their
    caps and shares the rest. Only sums come to the driver. None: all are at their caps."""
    level, fixed = None, -1
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("cap")
        got = sources.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if got[2] == fixed or not got[1]:
            return level if got[1] else None
        level, fixed = (total - got[0]) / got[1], got[2]


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most_passes: int = 2) -> DataFrame:
    """source, source_size, place, target, quota (its whole words), begins (the quotas of earlier sources) from (source, size).

    Sources by code point, null last, get ``weights`` in turn. They share ``share`` x all sizes by weight; a target stops at
    ``most_passes`` x its source's size, and what is over goes to the others by weight, until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = prefixed(sources, order=[F.col("source").asc_nulls_last()], number="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = cut_lineage(placed.withColumns({"weight": weight, "cap": F.col("source_size") * most_passes}))
    level = _level(placed, share * (placed.agg(F.sum("source_size")).first()[0] or 0))
    target = F.col("cap").cast("double") if level is None else F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    aimed = placed.withColumn("target", target).withColumn("quota", F.floor("target"))
    return cut_lineage(prefixed(aimed, order=["place"], sums={"begins": "quota"}).select("source", "source_size", "place", "target", "quota", "begins"))


def _slots(sources: DataFrame, block_words: int) -> DataFrame:
    """(slot, source, pass, block, n_words): the schedule before its blocks are looked up."""
    n_sources, words = sources.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    n_slots = -(-words // block_words)
    # Intervals are met by cells, of which there are more than sources: as many pairs as slots, and a quarter more at most.
    width = max(1, -(-words // max(64, 4 * n_sources)))
    blocks = F.ceil(F.col("source_size") / block_words)
    passes = F.floor(F.col("quota") / F.col("source_size"))
    needed = passes * blocks + F.ceil((F.col("quota") - passes * F.col("source_size")) / block_words)
    drawn_from = sources.where("quota > 0").withColumns({"blocks": blocks, "needed": needed})
    cells = drawn_from.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begins") / width), F.floor((F.col("begins") + F.col("quota") - 1) / width))))

    point = (F.col("slot") % POINTS * GOLDEN) % POINTS
    points = sources.sparkSession.range(n_slots).select(F.col("id").alias("slot")).withColumn("at", F.floor(point / POINTS * words))
    met = points.withColumn("slot_cell", F.floor(F.col("at") / width)).join(cells, (F.col("slot_cell") == F.col("cell")) & (F.col("at") >= F.col("begins")) & (F.col("at") < F.col("begins") + F.col("quota")))
    drawn = prefixed(cut_lineage(met.select("slot", "place")), order=["slot"], within=["place"], number="rank").select("slot", "place", (F.col("rank") - 1).alias("rank"))
    drawn = cut_lineage(drawn)

    had = drawn.groupBy(F.col("place").alias("p")).agg(F.count("*").alias("had"))
    short = drawn_from.join(had, F.col("place") == F.col("p"), "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < needed")
    closing = short.select("place", "had", F.explode(F.sequence(F.col("had"), F.col("needed") - 1)).alias("rank"))
    closing = closing.select((n_slots + (F.col("rank") - F.col("had")) * n_sources + F.col("place") - 1).alias("slot"), "place", "rank")

    told = drawn_from.withColumnRenamed("place", "p")
    ranked = drawn.unionByName(closing).join(F.broadcast(told) if n_sources <= FEW_SOURCES else told, F.col("place") == F.col("p")).where("rank < needed")
    ranked = ranked.withColumns({"pass": F.floor(F.col("rank") / F.col("blocks")), "block": F.col("rank") % F.col("blocks")})
    begins = F.col("block") * block_words
    held = F.least(F.lit(block_words), F.col("source_size") - begins, F.col("quota") - F.col("pass") * F.col("source_size") - begins)
    return ranked.select("slot", "place", "pass", "block", held.alias("n_words"))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most_passes: int = 2, block_words: int = BLOCK_WORDS, seed: int = 0
) -> Mix:
    """The mix of all ``docs``; see ``Mix``, ``source_targets`` and the head of this module.

    A source's taken words are its target's whole words. No document is taken more often than ``most_passes`` times whole,
    since targets stop there and a stream is gone through evenly. Reruns agree: the shuffle goes by the id's hash, then
    id and size; rows equal in these are alike in all that is returned. Null texts and texts of white space have size 0 and
    are never taken; null is a source; null ids stay. Documents of any length are cut into as many parts as they meet blocks.
    Other columns are ignored, whatever their names. An empty table gives empty results.

    Texts are read once, for their sizes; what is exchanged are ids and numbers: by range of (source, hash), so that a source
    of any share of the rows is spread evenly, and by block, which holds ``block_words`` documents at most.
    """
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size"), F.monotonically_increasing_id().alias("row"))
    sizes = cut_lineage(sizes)
    sources = source_targets(sizes, weights=weights, share=share, most_passes=most_passes)
    few = sources.count() <= FEW_SOURCES
    known = sources.select(F.col("source").alias("s"), "place", "source_size", "target", F.xxhash64("source").alias("source_key"))
    # The hash beside the source makes this exchange both sides where there are many, so that a hot one can be split.
    told = sizes.withColumn("key", F.xxhash64("source")).join(F.broadcast(known) if few else known, (F.col("key") == F.col("source_key")) & F.col("source").eqNullSafe(F.col("s")))
    told = told.select("id", "source", "size", "row", "place", "source_size", "target", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("shuffled"))
    told = cut_lineage(told)

    streams = prefixed(told.where("size > 0"), order=["shuffled", "id", "size"], within=["place"], sums={"start": "size"})
    ends = F.col("start") + F.col("size")
    parts = streams.select("id", "source", "row", "place", "start", ends.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((ends - 1) / block_words))).alias("block"))
    slots = _slots(sources, block_words).select("slot", F.col("place").alias("p"), "pass", F.col("block").alias("b"), "n_words")
    met = parts.join(slots, (F.col("place") == F.col("p")) & (F.col("block") == F.col("b")))
    begins = F.greatest(F.col("start"), F.col("block") * block_words)
    held = F.least(F.col("end"), F.col("block") * block_words + F.col("n_words")) - begins
    schedule = met.select("slot", "source", "pass", "block", "id", "row", (begins - F.col("start")).alias("first_word"), held.alias("n_words")).where("n_words > 0")

    taken = schedule.groupBy(F.col("row").alias("r")).agg(F.sum("n_words").alias("taken"))
    documents = told.join(taken, F.col("row") == F.col("r"), "left")
    documents = documents.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return Mix(documents, schedule.select("slot", F.col("source").alias(source_col), "pass", "block", F.col("id").alias(id_col), "first_word", "n_words"))


def mixed_texts(docs: DataFrame, schedule: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The schedule's rows with their words, joined by one space, in place of first_word. Expects unique ids."""
    words = F.filter(F.split(text_of(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    texts = docs.select(F.col(id_col).alias("__id"), words.alias("__words"))
    cut = F.array_join(F.slice("__words", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    return schedule.join(texts, F.col(id_col) == F.col("__id")).withColumn("words", cut).drop("__id", "__words", "first_word")
