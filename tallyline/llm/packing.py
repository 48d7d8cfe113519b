"""Packing by concatenate and cut: two-pass prefix sums over partition totals, then fixed windows.

Pass one tokenises each partition once and writes (partition, tokens before in the partition, ids) to a table in the
shared folder. A window over the totals by partition, a row each, gives the global offsets. Pass two reads the
table, adds the offset and cuts: the pieces of a document are its parts in consecutive windows, so every sequence but
the last is full. No document, id or piece is ever shuffled.

Both passes go over Arrow batches in slices of HELD_BYTES, so that a task holds Python objects of one slice at a time.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bound_batches, kind_of, shared_dir, slices, text_of

#: Bytes of chunks and ids that one Python worker remembers; the memory is emptied beyond it, results don't depend on it.
REMEMBERED_BYTES = 96 << 20
#: Bytes of an entry besides its chunk and ids: two object headers and a place in the table.
ENTRY_BYTES = 2 * 33 + 100
#: Chunks longer than this are not remembered.
LONG_CHUNK = 1 << 10
#: Texts that a task turns into ids and hands on together, in bytes; one text at least.
HELD_BYTES = 2 << 20
#: A mark after an ASCII letter or digit is a pre-token of its own: its ids follow those of the rest of the chunk.
ENDS = (b",", b".")
#: Lower-case words that are one pre-token and in normal form already.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The letter that byte-level tokenizers write for each byte: itself where it shows, else from U+0100 on.
BYTE_LETTERS = {b: chr(b) for b in _SEEN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SEEN)}


def numbers(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkIds(dict):
    """uint32 ids (bytes) by white-space-free chunk (UTF-8). The tokenizer drops white space and never merges across it,
    and its added tokens hold none, so the ids of a text are those of its chunks, one after the other."""

    def __init__(self, path: str):
        super().__init__()
        self.held = 0
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Checked for the two ways of cutting: at white space, and before a closing mark.
        probe = "\x0b One\t two\r\n\x0cthree "
        if self.tokenizer.encode(probe, add_special_tokens=False).ids != [i for w in probe.split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids]:
            raise ValueError("this tokenizer keeps white space: texts can't be cut into chunks")
        for word in ("one", "über", "garçonnière", "straße"):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            if np.frombuffer(self._word(word.encode()), dtype="<u4").tolist() != ids:
                raise ValueError("this tokenizer changes plain words")
            for mark in ENDS:
                if self.tokenizer.encode(word + mark.decode(), add_special_tokens=False).ids != ids + self.tokenizer.encode(mark.decode(), add_special_tokens=False).ids:
                    raise ValueError("this tokenizer joins words and marks: chunks can't be cut before a mark")

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts, each as little-endian unsigned 32-bit numbers."""
        # Lower case in front folds more chunks together; not where an added token may stand, which has a case.
        return [b"".join(map(self.__getitem__, (t if b"<|" in t else t.lower()).split())) for t in texts]

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk[-1:] in ENDS and chunk[-2:-1].isalnum():
            ids = self[chunk[:-1]] + self[chunk[-1:]]
        elif LETTERS.fullmatch(word := chunk.decode()):
            ids = self._word(chunk)
        else:
            ids = numbers(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(chunk) > LONG_CHUNK:
            return ids
        if self.held > REMEMBERED_BYTES:
            self.clear()
            self.held = 0
        self.held += len(chunk) + len(ids) + ENTRY_BYTES
        self[chunk] = ids
        return ids

    def _word(self, chunk: bytes) -> bytes:
        """Ids of a word of LETTERS by the tokenizer's model alone: normalising and cutting would leave it as it is."""
        return numbers([t.id for t in self.tokenizer.model.tokenize(chunk.decode("latin-1").translate(BYTE_LETTERS))])


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def _tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc"), F.encode(text_of(text_col), "UTF-8").alias("data"))
    end = numbers([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, before = chunk_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "data", HELD_BYTES):
            ids = [x + end for x in known.ids_of(batch.column("data").to_pylist())]
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ends = before + np.cumsum(sizes)
            before = int(ends[-1])
            columns = [batch.column("doc"), pa.array(ends - sizes), pa.array(sizes), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), part, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "before", "n", "ids", "part"])

    return rows.mapInArrow(run, f"doc {kind_of(docs, id_col)}, before bigint, n bigint, ids binary, part int")


def pack(docs: DataFrame, *, tokenizer_path: str, end_id: int, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the tokenizer's ids without added special tokens, then ``end_id``; null texts count as empty and give
    the end id alone. Documents follow one another in the order of the input's partitions and are cut every ``length``
    ids; all sequences are full but the last. Null ids and repeated rows are packed like others; other columns are
    ignored, whatever their names; an empty table gives an empty result. A very long text is held by one task, as its
    ids, but by no other.
    """
    bound_batches(docs)
    spark = docs.sparkSession
    place = f"{shared_dir(spark)}/tokenised-{uuid.uuid4().hex}"
    # Row groups of bounded size: a reader holds one at a time.
    tokenised = _tokenised(docs, tokenizer_path, end_id, id_col, text_col)
    tokenised.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(place)
    table = spark.read.schema(tokenised.schema).parquet(place)

    # A row for each partition of the input, with documents or not: broadcast, and summed by one task.
    totals = table.groupBy(F.col("part").alias("base_part")).agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("base_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("base_part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))

    placed = table.join(F.broadcast(offsets), F.col("part") == F.col("base_part")).select("doc", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", HELD_BYTES):
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            pieces = (at + n - 1) // length - at // length + 1  # a document has its end id at least
            row = np.repeat(np.arange(len(n)), pieces)
            window = at[row] // length + np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
            begin = np.maximum(at[row], window * length)
            size = np.minimum(at[row] + n[row], (window + 1) * length) - begin
            start, ids = begin - at[row], batch.column("ids")
            views = [memoryview(ids[k].as_buffer()) for k in range(len(n))]
            crc = [zlib.crc32(views[r][4 * a : 4 * b]) for r, a, b in zip(row.tolist(), start.tolist(), (start + size).tolist(), strict=True)]
            columns = [batch.column("doc").take(pa.array(row)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(window), pa.array(begin - window * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = kind_of(docs, id_col)
    return placed.mapInArrow(run, f"doc {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("doc", id_col)
