import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyline.llm import packing, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TOKENIZER = Tokenizer.from_file(WORDS)

texts = st.lists(st.sampled_from(["a", " ", "  ", "\n", "▁", "the", "é", "½", "\t", "\0", "<s>", "<|endoftext|>", "<|ENDOFTEXT|>", "K", "İ", "\x1c", "\xa0", "'S", "漢", "ç", "über", "É", "thing,", "x.", ",.", "é."])).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts | st.text(max_size=30))
def test_counts_are_the_librarys(text):
    assert token_counts.counts_of([text], MODEL) == [len(LIBRARY.encode(text))]


@settings(max_examples=400, deadline=None)
@given(texts | st.text(max_size=30))
def test_ids_are_the_librarys(text):
    got = packing.chunk_ids(WORDS).ids_of([text.encode()])[0]
    assert np.frombuffer(got, dtype="<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_memory_bound_changes_no_result(monkeypatch):
    rows = [f"w{i} and v{i}x\ny{i}" for i in range(60)]
    monkeypatch.setattr(token_counts, "REMEMBERED_BYTES", 1500)
    monkeypatch.setattr(token_counts, "LONG_KEY", 4)
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 1500)
    assert token_counts.counts_of(rows, MODEL) == [len(x) for x in LIBRARY.encode(rows)]
    known = packing.ChunkIds(WORDS)
    assert [np.frombuffer(known.ids_of([r.encode()])[0], dtype="<u4").tolist() for r in rows] == [e.ids for e in TOKENIZER.encode_batch(rows, add_special_tokens=False)]


def test_token_counts_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "a b", 7), (3, "é " * 6000, 8), (3, "é " * 6000, 8)], "doc_id bigint, text string, n_tokens int")
    got = token_counts.token_counts(docs, model_path=MODEL, limit=4096)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = [tuple(r) for r in got.collect()]
    long = len(LIBRARY.encode("é " * 6000))
    assert sorted(rows, key=str) == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, False), (3, 18000, long, True), (3, 18000, long, True)], key=str)
    assert token_counts.token_counts(docs.limit(0), model_path=MODEL, limit=1).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_packing_round_trip(spark, parts):
    data = [(1, None), (2, ""), (3, "one two three " * 40), (None, "x"), (4, "Ünï <|endoftext|> z"), (3, "one two three " * 40)]
    docs = spark.createDataFrame([(*r, "clash") for r in data], "doc_id bigint, text string, start string").repartition(parts)
    pieces = [r.asDict() for r in packing.pack(docs, tokenizer_path=WORDS, end_id=2, length=16).collect()]
    want = {d: TOKENIZER.encode(t or "", add_special_tokens=False).ids + [2] for d, t in data}
    spots = sorted((p["sequence_id"] * 16 + p["offset"], p["length"]) for p in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:], strict=False)) and spots[0][0] == 0
    assert sum(n for _, n in spots) == sum(len(want[d]) for d, _ in data)
    for p in pieces:
        ids = want[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["offset"] + p["length"] <= 16
        assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes())
    assert sum(p["length"] for p in pieces if p["doc_id"] == 3) == 2 * len(want[3])
    assert packing.pack(docs.limit(0), tokenizer_path=WORDS, end_id=2, length=16).count() == 0
