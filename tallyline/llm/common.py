"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that the contracts name, [\x20\x09-\x0D].
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, UPPER.lower())


def carried(column: str) -> Column:
    """An id on its way through pandas: as text, since a batch with a null would turn large integers into floats."""
    return F.col(column).cast("string")


def kind_of(df: DataFrame, column: str) -> str:
    return df.select(column).schema[0].dataType.simpleString()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none: a temporary folder in
    local mode, which is one machine, and one beside the warehouse's tables on a cluster."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
        named = tempfile.mkdtemp(prefix="tallyline-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/tallyline-shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


#: Rows of an Arrow batch on its way to Python: texts of kilobytes make megabytes of it.
BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(df: DataFrame) -> None:
    """Has the session cut Arrow batches at BATCH_ROWS rows, unless it asks for fewer already. Spark's default of 10,000
    holds tens of megabytes of texts in the JVM and again in each Python worker; results don't depend on it."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCHES)) <= BATCH_ROWS:
        conf.set(_BATCHES, str(BATCH_ROWS))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, key: str, total: int, most: int) -> DataFrame:
    """``most`` rows at most, those with the smallest hash of ``key``. First a share by hash that holds about so many:
    else every task would hand that many rows to the last one."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    share = min(1.0, (1.2 * most + 20) / max(1, total))
    return df.where(place < int(share * (1 << 30))).orderBy(place, key).limit(most)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches whose ``column`` (binary or text) holds ``most`` bytes at most, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


#: Bits of a filter for each of its keys, and of a whole filter: 32 MiB at most. More keys than fill it are met by joins.
BITS_OF_KEY = 16
MOST_BITS = 1 << 28


def filter_bits(keys: int) -> int | None:
    """Bits of a filter of so many keys, a power of two; None where a filter of the largest size would tell too little."""
    return None if keys * 4 > MOST_BITS else min(MOST_BITS, 1 << max(16, (BITS_OF_KEY * keys - 1).bit_length()))


def slot(*columns: str | Column, bits: int) -> Column:
    """The bit of a key in a filter."""
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def filter_blocks(slots: DataFrame) -> DataFrame:
    """(block, bits): the filter of the keys in ``slots`` (column slot), in blocks of 4 KiB."""
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def with_mark(df: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """Adds whether the bit of the row's ``slot`` is set: certain where it is not, to be confirmed where it is."""
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(bitmap_bit_position(slot) div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    mark = F.coalesce(F.getbit(byte, (F.bitmap_bit_position("slot") % 8).cast("int")) == 1, F.lit(False))
    return df.withColumn("block", F.bitmap_bucket_number("slot")).join(F.broadcast(blocks), "block", "left").withColumn(name, mark).drop("block", "bits")


def without(df: DataFrame, dropped: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` is not in ``dropped`` (one column of the same type, distinct); nulls compare equal.

    A filter, as large as the count of the dropped keys asks and bounded by MOST_BITS, tells at the scan which rows may be
    in it; only those, with their texts, are shuffled to the anti join. The others are never moved. Beyond the bound the
    anti join takes all rows.
    """
    value = F.col(dropped.columns[0])
    gone = cut_lineage(dropped.select(value.alias("__gone")))
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])  # no clash with our own names
    key = f"c{df.columns.index(column)}"
    bits = filter_bits(gone.count())
    if bits is None:
        return inner.join(gone, F.col(key).eqNullSafe(F.col("__gone")), "left_anti").toDF(*df.columns)
    blocks = filter_blocks(gone.select(slot("__gone", bits=bits).alias("slot")))
    marked = with_mark(inner.withColumn("slot", slot(key, bits=bits)), blocks, "may_go")
    stays = marked.where("NOT may_go").select(inner.columns)
    asked = marked.where("may_go").select(inner.columns)
    return stays.unionByName(asked.join(gone, F.col(key).eqNullSafe(F.col("__gone")), "left_anti")).toDF(*df.columns)
