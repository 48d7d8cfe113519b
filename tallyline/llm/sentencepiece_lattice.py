"""SentencePiece encoding and decoding as a relational lattice.

Encoding: texts are cut wherever two neighbouring characters stand together in no piece, since no merge and no edge can
cross such a place. The distinct parts of the corpus are exploded into substrings of the lengths that pieces with the same
head have, equi-joined to the piece table, and the edges that match are grouped by part: a lattice. A fold with Spark's
higher-order aggregate then reads the pieces off it. There are two folds over the same lattice: Viterbi (the path with the
highest sum of scores) for unigram tables, and for BPE tables, where the best path is not what the model means, the merge
fold, which takes the best edge over two adjacent symbols until there is none. Where the model allows it (``Vocabulary.ordered``),
one pass over the edges in the order of their scores does the same.

Texts meet the cuts of their parts in blocks of BLOCK_BYTES. A block's distinct parts are numbered in their order and exchanged
once, by part; the places (block, number) of a part go with it through the lattice, and what comes back to a block, compressed
and grouped with it, is a number and a cut. The block finds its parts again and needs neither their text nor ids. Tokens are never rows
of a shuffle. Within a block, chunks, parts and symbols are slices of one buffer of text, told apart by Arrow's dictionaries, and ids
are gathered by their codes; no Python object is made for a word.

Decoding: the ids are replaced by the bytes of the piece table, whose size is that of a vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, kind_of, slices, text_of

SPACE = "▁"
#: Parts up to so many characters are folded in Spark: their cuts are the bits of one number. Longer stretches in which every
#: two neighbours stand together in some piece are encoded by the library, which is the exact way for the rest.
FOLDED_CHARS = 60
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are taken into a block together, and what an empty text counts besides.
SLICE_BYTES = 1 << 20
ROW_BYTES = 64
#: Characters of a substring's head, by which the lengths to be exploded are known.
HEAD = 3
#: Bits of a start and of a stop in a merge's number; both are FOLDED_CHARS at most.
PLACE_BITS = 6


def piece_table(spark: SparkSession, model_path: str) -> DataFrame:
    """(id, piece, score, hex, is_byte) of a model file: as many rows as its vocabulary has, so of bounded size."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    rows = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            rows.append((i, piece, None, piece[3:5], True))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            if "\n" in piece or SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece crosses pre-tokens: this model can't be cut into them")
            rows.append((i, piece, float(model.get_score(i)), piece.encode().hex(), False))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece", "score", "hex", "is_byte"]), "id int, piece string, score double, hex string, is_byte boolean")


def _strings(ends: np.ndarray, data: np.ndarray) -> pa.StringArray:
    """The stretches of UTF-8 ``data`` between neighbouring ``ends``."""
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _bytes(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, data): what ``_strings`` takes."""
    _, ends, data = strings.buffers()
    if not len(strings) or data is None:
        return np.zeros(len(strings) + 1, np.int32), np.zeros(0, np.uint8)
    ends = np.frombuffer(ends, np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return ends - ends[0], np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]


def _chars(data: np.ndarray) -> np.ndarray:
    """The byte at which each character of ``data`` starts, and the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends): the stretches of ``flat`` that the codes name, one after the other."""
    n = sizes[codes]
    ends = np.append(0, np.cumsum(n, dtype=np.int64))
    return flat[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])], ends


class Vocabulary:
    """The piece table as tasks use it: ids of pieces and bytes, bytes of ids, and the pairs of neighbours within pieces.

    ``ranks`` are the places of the scores, the highest first. ``ordered``: words whose edges all rank below it are read by one
    pass over their edges, best first. That equals taking the best edge again and again if no edge comes to join two symbols
    after its turn. An edge whose ends are still cuts at its turn has between them what its piece alone has at that turn; if the
    pass makes the piece alone one symbol, there are two symbols then, so the edge is taken at its turn or, an end being lost, never.
    This holds for every edge of such a word: ``ordered`` is the least rank of a piece that the pass does not make one symbol,
    or of one that shares its score with another.
    """

    def __init__(self, pieces: DataFrame):
        rows = pieces.collect()
        plain = [r for r in rows if not r["is_byte"]]
        self.pieces = pa.array([r["piece"] for r in plain], pa.string())
        self.ids = np.array([r["id"] for r in plain], np.int32)
        self.byte_ids = np.full(256, -1, np.int32)
        for r in rows:
            if r["is_byte"]:
                self.byte_ids[int(r["hex"], 16)] = r["id"]
        self.hexes = {r["id"]: bytes.fromhex(r["hex"]) for r in rows}
        self.pairs = pa.array(sorted({ord(x) << 21 | ord(y) for r in plain for x, y in zip(r["piece"], r["piece"][1:], strict=False)}), pa.int64())
        place = {score: n for n, score in enumerate(sorted({r["score"] for r in plain}, reverse=True))}
        self.ranks = {r["piece"]: place[r["score"]] for r in plain}

    def ordered(self) -> int:
        """See above."""
        met: set[int] = set()
        least = len(self.ranks)
        for piece, rank in self.ranks.items():
            if rank in met or len(piece) > 1 and not self._is_one(piece):
                least = min(least, rank)
            met.add(rank)
        return least

    def _is_one(self, piece: str) -> bool:
        """Whether one pass over the edges of a piece makes it one symbol."""
        n = len(piece)
        spans = [(i, j) for i in range(n) for j in range(i + 2, n + 1)]
        edges = sorted((self.ranks[piece[i:j]], i, j) for i, j in spans if piece[i:j] in self.ranks)
        cuts = set(range(n + 1))
        for _, i, j in edges:
            inner = cuts.intersection(range(i + 1, j))
            if i in cuts and j in cuts and len(inner) == 1:
                cuts -= inner
        return len(cuts) == 2

    def parts_of(self, chunks: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """(parts, ends): the chunks, cut between neighbours that no piece holds, and each chunk's places among the parts."""
        ends, data = _bytes(chunks)
        first = _chars(data)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        begin = np.searchsorted(first, ends)
        cut = np.ones(len(first), bool)
        pairs = points[:-1].astype(np.int64)
        pairs <<= 21
        pairs |= points[1:]
        cut[1:-1] = ~pc.is_in(pa.array(pairs), value_set=self.pairs).to_numpy(zero_copy_only=False)
        cut[begin] = True
        at = np.flatnonzero(cut)
        return _strings(first[at], data), np.searchsorted(at, begin)

    def parts(self, chunk: str) -> list[str]:
        return self.parts_of(pa.array([chunk], pa.string()))[0].to_pylist()

    def ids_of(self, symbols: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): those of its UTF-8 bytes for a symbol without a piece."""
        at = pc.index_in(symbols, value_set=self.pieces)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        ends, data = _bytes(symbols)
        sizes = np.where(known, 1, np.diff(ends))
        to = np.append(0, np.cumsum(sizes, dtype=np.int64))
        ids = np.empty(to[-1], np.int32)
        ids[to[:-1][known]] = self.ids[at.drop_null().to_numpy()]
        ids[np.repeat(~known, sizes)] = self.byte_ids[data[np.repeat(~known, np.diff(ends))]]
        if (ids < 0).any():
            raise ValueError("the piece table has neither a piece nor bytes for a character")
        return ids, to


def chunks_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(chunks, ends): runs of spaces with the word after them, and line feeds, and each text's places among the chunks. Marks
    count as spaces; a text that is not empty gets a space in front."""
    spaced = pc.replace_substring(texts, SPACE, " ")
    ends, data = _bytes(pc.if_else(pc.equal(spaced, ""), "", pc.binary_join_element_wise("", spaced, " ")))
    line, space = data == 10, data == 32
    start = line.copy()
    start[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    start[ends[:-1][ends[:-1] < ends[1:]]] = True
    at = np.append(np.flatnonzero(start), len(data))
    return _strings(at, data), np.searchsorted(at, ends)


def _marked(chunks: pa.StringArray) -> pa.StringArray:
    return pc.replace_substring(chunks, " ", SPACE)


def chunks(text: str) -> list[str]:
    """The chunks of one text, with marks."""
    return _marked(chunks_of(pa.array([text], pa.string()))[0]).to_pylist()


def lattice(words: DataFrame, pieces: DataFrame, *, value: str = "score", shortest: int = 1) -> DataFrame:
    """(word, at, edge struct<start, stop, ``value``>): the edges over ``shortest`` characters or more (2 at most) of distinct ``words``
    (word, at), and for each word a row of its own that has ``at`` and no edge: start -1, the empty head and piece."""
    table = pieces.where("NOT is_byte").where(F.length("piece") >= shortest)
    heads = table.groupBy(F.substring("piece", 1, HEAD).alias("head")).agg(F.collect_set(F.length("piece")).alias("sizes"))
    own = pieces.sparkSession.range(1)
    heads = heads.unionByName(own.select(F.lit("").alias("head"), F.array(F.lit(0)).alias("sizes")))
    scores = table.select("piece", value).unionByName(own.select(F.lit("").alias("piece"), F.lit(None).cast(dict(pieces.dtypes)[value]).alias(value)))
    starts = words.select("word", "at", F.explode(F.sequence(F.lit(-1), F.length("word") - shortest)).alias("start"))
    starts = starts.select("word", "start", F.when(F.col("start") < 0, F.col("at")).alias("at"))
    within = F.filter(F.array(*[F.lit(n) for n in range(shortest, HEAD + 1)]), lambda n: F.col("start") + n <= F.length("word"))
    begun = starts.select("word", "at", "start", F.explode(F.when(F.col("start") < 0, F.array(F.lit(0))).otherwise(within)).alias("n"))
    begun = begun.select("word", "at", "start", F.expr("substring(word, start + 1, n)").alias("head"))
    # Both tables are no larger than the vocabulary.
    spans = begun.join(F.broadcast(heads), "head").select("word", "at", "start", F.explode("sizes").alias("size")).where(F.col("start") + F.col("size") <= F.length("word"))
    met = spans.select("word", "at", "start", "size", F.expr("substring(word, start + 1, size)").alias("piece")).join(F.broadcast(scores), "piece")
    edge = F.when(F.col("start") >= 0, F.struct("start", (F.col("start") + F.col("size")).alias("stop"), value))
    return met.select("word", "at", edge.alias("edge"))


def merge_of(edge: Column) -> Column:
    """An edge as the merge folds take it: a bigint of rank, start and stop, so that the best, and of equals the leftmost, is the least."""
    high = F.call_function("shiftleft", edge["rank"].cast("bigint"), F.lit(2 * PLACE_BITS))
    return high + F.call_function("shiftleft", edge["start"], F.lit(PLACE_BITS)) + edge["stop"]


def _bits(merge: Column) -> tuple[Column, Column]:
    """A merge as bits of a word's places: ``ends`` (start and stop) and ``inner`` (the places between)."""
    low = merge.cast("int")
    start = F.call_function("shiftright", low, F.lit(PLACE_BITS)).bitwiseAND((1 << PLACE_BITS) - 1)
    one, two = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
    stop = F.call_function("shiftleft", one, low.bitwiseAND((1 << PLACE_BITS) - 1))
    return F.call_function("shiftleft", one, start) + stop, stop - F.call_function("shiftleft", two, start)


def merge_fold(n: Column, merges: Column) -> Column:
    """bigint: the cuts of the BPE segmentation, as bits. Every step merges the two adjacent symbols whose joint edge has the
    highest score, the leftmost of equals. The cuts are the bits of a number: an edge joins two symbols if its ends are
    cuts and one cut lies between. ``merges`` are sorted."""
    every = F.call_function("shiftleft", F.lit(2).cast("bigint"), n) - 1
    spans = F.transform(merges, lambda m: F.struct(*[c.alias(x) for c, x in zip(_bits(m), ("ends", "inner"), strict=True)]))

    def step(cuts: Column, _: Column) -> Column:
        best = F.get(F.filter(spans, lambda e: (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1)), F.lit(0))
        return F.coalesce(cuts.bitwiseAND(F.bitwise_not(best["inner"])), cuts)

    return F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), every, step)


def merge_pass(n: Column, merges: Column) -> Column:
    """What ``merge_fold`` gives, for words whose edges rank below ``Vocabulary.ordered``: each merge has one turn."""
    every = F.call_function("shiftleft", F.lit(2).cast("bigint"), n) - 1

    def step(cuts: Column, merge: Column) -> Column:
        ends, inner = _bits(merge)
        joins = (cuts.bitwiseAND(ends) == ends) & (F.bit_count(cuts.bitwiseAND(inner)) == 1)
        return F.when(joins, cuts.bitwiseAND(F.bitwise_not(inner))).otherwise(cuts)

    return F.aggregate(merges, every, step)


def viterbi_fold(n: Column, edges: Column, *, unknown: float = -1e6) -> Column:
    """array<int>: the cuts of the path with the highest sum of scores, a character without a piece costing ``unknown``;
    of equal paths the one whose last piece starts first. The state holds the best score and start of every end."""
    start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(-1)).alias("back"))

    def step(s: Column, i: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda e: e["stop"] == i), lambda e: F.struct((F.get(s["best"], e["start"]) + e["score"]).alias("score"), (-e["start"]).alias("low")))
        plain = F.array(F.struct((F.get(s["best"], i - 1) + F.lit(unknown)).alias("score"), (1 - i).alias("low")))
        best = F.array_max(F.concat(ways, plain))
        return F.struct(F.array_append(s["best"], best["score"]).alias("best"), F.array_append(s["back"], -best["low"]).alias("back"))

    back = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["back"])
    walk = F.aggregate(
        F.sequence(F.lit(1), n), F.struct(F.array(n).alias("cuts"), back.alias("back")),
        lambda s, _: F.when(F.get(s["cuts"], F.lit(0)) == 0, s).otherwise(F.struct(F.array_prepend(s["cuts"], F.get(s["back"], F.get(s["cuts"], F.lit(0)))).alias("cuts"), s["back"].alias("back"))),
        lambda s: s["cuts"],
    )
    return walk


def segmented(words: DataFrame, pieces: DataFrame, *, fold: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(at, cuts) of distinct ``words`` (word, at), none longer than FOLDED_CHARS where ``fold`` is 'merge': bits of a
    bigint there, else an array<int>. Where ``words`` are partitioned by word, nothing is exchanged."""
    at = F.first("at", ignorenulls=True).alias("at")
    if fold != "merge":
        net = lattice(words, pieces).groupBy("word").agg(F.collect_list("edge").alias("edges"), at)
        return net.select("at", viterbi_fold(F.length("word"), F.col("edges")).alias("cuts"))
    vocabulary = vocabulary or Vocabulary(pieces)
    ranked = pd.DataFrame({"piece": list(vocabulary.ranks), "rank": list(vocabulary.ranks.values())})
    table = pieces.sparkSession.createDataFrame(ranked, "piece string, rank int").withColumn("is_byte", F.lit(False))
    edges = lattice(words, table, value="rank", shortest=2).withColumn("merge", merge_of(F.col("edge")))
    net = edges.groupBy("word").agg(F.sort_array(F.collect_list("merge")).alias("merges"), at)
    n, merges = F.length("word"), F.col("merges")
    in_order = F.coalesce(F.get(merges, F.size(merges) - 1) < vocabulary.ordered() << 2 * PLACE_BITS, F.lit(True))
    return net.select("at", F.when(in_order, merge_pass(n, merges)).otherwise(merge_fold(n, merges)).alias("cuts"))


def symbols_of(words: pa.StringArray, cuts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """(symbols, ends): the words, cut at the places that ``segmented`` gives, and each word's places among the symbols."""
    ends, data = _bytes(words)
    first = _chars(data)
    begin = np.searchsorted(first, ends)
    if pa.types.is_integer(cuts.type):
        bits = np.unpackbits(cuts.cast(pa.int64()).to_numpy().astype("<i8").view(np.uint8), bitorder="little")
        found = np.flatnonzero(bits)
        counts, places = np.bincount(found >> 6, minlength=len(cuts)), found & 63
    else:
        counts, places = pc.list_value_length(cuts).to_numpy(), cuts.flatten().to_numpy()
    last = np.cumsum(counts)
    if len(counts) != len(words) or (counts < 2).any() or places[last - counts].any() or (places[last - 1] != np.diff(begin)).any():
        raise ValueError("the texts have changed between two readings")
    starts = np.delete(np.repeat(begin[:-1], counts) + places, last - 1)
    return _strings(first[np.append(starts, len(first) - 1)], data), np.append(0, np.cumsum(counts - 1))


def _symbols(word: str, cuts: int | list[int]) -> list[str]:
    """The symbols of one word."""
    return symbols_of(pa.array([word], pa.string()), pa.array([cuts], pa.list_(pa.int32()) if isinstance(cuts, list) else pa.int64()))[0].to_pylist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows): the same each time a partition is read."""
    base, held = TaskContext.get().partitionId() << 32, 0
    for batch in slices(batches, "text", SLICE_BYTES):
        yield base + held // BLOCK_BYTES, batch
        held += batch.column("text").nbytes + ROW_BYTES * len(batch)


def encode(docs: DataFrame, pieces: DataFrame, *, fold: str = "merge", model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids array<int>.

    Null and empty texts have no ids. Texts are encoded whole, without begin or end. Null ids and repeated rows each
    keep their row; other columns are ignored, whatever their names; an empty table gives an empty result. ``docs`` is
    read twice and must come in the same partitions and order both times, as tables in files do; a block whose parts are
    not as many or as long as in the first reading raises. Blocks are dealt by number, so no text, word or source can make one
    large; a frequent part is a row for each block, and has as many places. ``model_path`` is needed for BPE parts over FOLDED_CHARS.
    """
    bound_batches(docs)
    vocabulary = Vocabulary(pieces)
    rows = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))

    longest = FOLDED_CHARS if fold == "merge" else None

    def parted(found: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """(parts, ends, folded): the parts of distinct chunks, each chunk's places among them, and the codes of the distinct parts
        that are folded, in the order of their numbers."""
        parts, ends = vocabulary.parts_of(_marked(found))
        coded = parts.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        if longest is not None:
            order = order[pc.utf8_length(coded.dictionary).to_numpy()[order] <= longest]
        return coded, ends, order

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(block: int, seen: list[pa.StringArray]) -> pa.RecordBatch:
            coded, _, folded = parted(pa.chunked_array(seen, pa.string()).unique())
            words = coded.dictionary.take(pa.array(folded))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(np.arange(len(words), dtype=np.int32)), words], names=["block", "no", "word"])

        at, seen = None, []
        for block, batch in _blocks(batches):
            if block != at and seen:
                yield found(at, seen)
                seen = []
            at = block
            seen.append(chunks_of(batch.column("text"))[0].unique())
        if seen:
            yield found(at, seen)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as writer:
                for batch in held:
                    writer.write_batch(batch)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])

        at, held = None, []
        for block, batch in _blocks(batches):
            if block != at and held:
                yield put(at, held)
                held = []
            at = block
            held.append(batch)
        if held:
            yield put(at, held)

    def by_library() -> Callable[[str], list[int]]:
        """The exact way for a part that is not folded."""
        held: list = []

        def ids(word: str) -> list[int]:
            if not held:
                model = sentencepiece.SentencePieceProcessor(model_file=model_path)
                held.extend([model, len(model.encode("\n"))])  # the mark in front and the line feed
            model, first = held
            # A part that starts with a mark gets it from the library; others follow a line feed.
            return model.encode(word[1:].replace(SPACE, " ")) if word[0] == SPACE else model.encode("\n" + word)[first:]

        return ids

    def encoded(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, split = [], []
        for batch in (batch for x in left.column("texts").to_pylist() for batch in pa.ipc.open_stream(x)):
            docs.append(batch.column("doc"))
            split.append(chunks_of(batch.column("text")))
        met = pa.chunked_array([c for c, _ in split], pa.string()).combine_chunks().dictionary_encode()
        codes = np.split(met.indices.to_numpy(), np.cumsum([len(c) for c, _ in split])[:-1])
        coded, chunk_ends, folded = parted(met.dictionary)
        ends = [e for _, e in split]
        del met, split, batch
        words = coded.dictionary.take(pa.array(folded))
        cuts = right.column("cuts").take(pa.array(np.argsort(right.column("no").to_numpy()))).combine_chunks()
        symbols, word_ends = symbols_of(words, cuts)
        ids, symbol_ends = vocabulary.ids_of(symbols)
        # The ids of each distinct part, then of each distinct chunk, as stretches of one array.
        starts, sizes = np.zeros(len(coded.dictionary), np.int64), np.zeros(len(coded.dictionary), np.int64)
        of_words = symbol_ends[word_ends]
        starts[folded], sizes[folded] = of_words[:-1], np.diff(of_words)
        rest = np.setdiff1d(np.arange(len(coded.dictionary)), folded)
        if len(rest):
            other = by_library()
            more = [np.array(other(w), np.int32) for w in coded.dictionary.take(pa.array(rest)).to_pylist()]
            sizes[rest] = [len(x) for x in more]
            starts[rest] = len(ids) + np.cumsum(sizes[rest]) - sizes[rest]
            ids = np.concatenate([ids, *more])
        ids, part_ends = _gathered(ids, starts, sizes, coded.indices.to_numpy())
        of_chunks = part_ends[chunk_ends]
        del words, cuts, symbols, coded
        out = []
        for doc, text_ends, code in zip(docs, ends, codes, strict=True):
            values, to = _gathered(ids, of_chunks[:-1], np.diff(of_chunks), code)
            lists = pa.ListArray.from_arrays(pa.array(to[text_ends].astype(np.int32)), pa.array(values))
            out.append(pa.RecordBatch.from_arrays([doc, lists], names=["doc", "ids"]))
        return pa.Table.from_batches(out)

    # Exchanged by part first: a part has few places, so counting them before would sort for nothing.
    met = rows.mapInArrow(parts, "block bigint, no int, word string").repartition("word")
    words = met.groupBy("word").agg(F.collect_list(F.struct("block", "no")).alias("at"))
    known = segmented(words, pieces, fold=fold, vocabulary=vocabulary)
    dictionaries = known.select(F.explode("at").alias("at"), "cuts").select("at.block", "at.no", "cuts")
    blocks = rows.mapInArrow(packed, "block bigint, texts binary")
    made = blocks.groupBy("block").cogroup(dictionaries.groupBy("block")).applyInArrow(encoded, f"doc {kind_of(docs, id_col)}, ids array<int>")
    return made.withColumnRenamed("doc", id_col)


def decode(encoded: DataFrame, pieces: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: id, text. Ids become the bytes of their pieces; unknown ids and control ids give
    nothing, null ids arrays an empty text, broken byte sequences U+FFFD."""
    known = Vocabulary(pieces).hexes
    size = max(known, default=-1) + 1
    table = pa.array([known.get(i, b"") for i in range(size + 1)], pa.large_binary())  # the last one for all other ids

    def texts(ids: pa.ListArray) -> list[str]:
        flat = ids.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        pieces_of = table.take(pa.array(np.where((flat >= 0) & (flat < size), flat, size)))
        _, starts, data = pieces_of.buffers()
        rows_at = np.cumsum([0, *pc.list_value_length(ids).fill_null(0).to_pylist()])
        cuts = np.frombuffer(starts, dtype=np.int64)[rows_at].tolist() if len(flat) else [0] * len(rows_at)
        view = memoryview(data) if len(flat) and data else memoryview(b"")
        return [str(view[i:j], "utf-8", "replace").replace(SPACE, " ").removeprefix(" ") for i, j in zip(cuts, cuts[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 100):
                part = batch.slice(k, 100)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(texts(part.column("ids")), pa.string())], names=["doc", "text"])

    rows = encoded.select(F.col(id_col).alias("doc"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc {kind_of(encoded, id_col)}, text string").withColumnRenamed("doc", id_col)
