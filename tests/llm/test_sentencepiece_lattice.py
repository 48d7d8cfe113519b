import random
import re

import public_tokenizers
import pyarrow as pa
import sentencepiece

from tallyline.llm import sentencepiece_lattice as lat

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_are_the_librarys_and_decode_back(spark, monkeypatch):
    rng = random.Random(4)
    bits = ["the ", "in", "er", "  ", "\n", "é", "漢", "½", "ation", "a", "\t", "un", "believ", "able", "!", "1984", "▁", "\0", "x" * 60, "ing" * 30]
    texts = [None, "", " ", "\n", "a", "Hello world, unbelievable!", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(250))]
    rows = [(k, t, "c") for k, t in enumerate(texts)] + [(None, "twice", "c"), (None, "twice", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    pieces = lat.piece_table(spark, MODEL)
    encoded = lat.encode(docs, pieces, model_path=MODEL)
    got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    want = {k: LIBRARY.encode((t or "").replace("▁", " ")) for k, t, _ in rows}
    assert got == want and encoded.count() == len(rows)
    back = {r["doc_id"]: r["text"] for r in lat.decode(encoded, pieces).collect()}
    assert back == {k: (t or "").replace("▁", " ") for k, t, _ in rows}
    assert lat.encode(docs.limit(0), pieces, model_path=MODEL).count() == 0


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lat, "BLOCK_BYTES", 40)
    monkeypatch.setattr(lat, "SLICE_BYTES", 30)
    monkeypatch.setattr(lat, "FOLDED_CHARS", 5)
    texts = [f"words of text {k}  and mor\u00e9,\nlines" * (k % 3) for k in range(40)] + ["internationalisation" * 30, " x", "  x ", "a ", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).cache()
    got = {r["doc_id"]: list(r["ids"]) for r in lat.encode(docs, lat.piece_table(spark, MODEL), model_path=MODEL).collect()}
    assert got == {k: LIBRARY.encode(t) for k, t in enumerate(texts)}


def test_parts_are_cut_where_no_piece_goes(spark):
    vocabulary = lat.Vocabulary(lat.piece_table(spark, MODEL))
    assert "".join(vocabulary.parts("\u2581x9,abc\u6f22z")) == "\u2581x9,abc\u6f22z" and "9" in vocabulary.parts("\u2581x9,abc")
    assert lat.chunks("") == [] and lat.chunks("a  b\nc d") == ["\u2581a", "\u2581\u2581b", "\n", "c", "\u2581d"]


def test_viterbi_is_the_best_path(spark):
    rng = random.Random(2)
    table = {p: -rng.random() * 5 for p in ["▁", "a", "b", "ab", "ba", "aab", "▁a", "bab", "▁ab", "abab"]}
    ids = {p: 256 + k for k, p in enumerate(table)}
    pieces = spark.createDataFrame([(i, f"<0x{i:02X}>", None, f"{i:02x}", True) for i in range(256)] + [(ids[p], p, s, p.encode().hex(), False) for p, s in table.items()], "id int, piece string, score double, hex string, is_byte boolean")
    texts = ["".join(rng.choice("ab b") for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["aéb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def best(word):
        top = [(0.0, [])]
        for j in range(1, len(word) + 1):
            ways = [(top[i][0] + table[word[i:j]], [*top[i][1], ids[word[i:j]]]) for i in range(j) if word[i:j] in table]
            ways.append((top[j - 1][0] - 1e6, [*top[j - 1][1], *word[j - 1].encode()]))
            top.append(max(ways, key=lambda w: w[0]))
        return top[-1]

    got = {r["doc_id"]: list(r["ids"]) for r in lat.encode(docs, pieces, fold="viterbi").collect()}
    for k, t in enumerate(texts):
        marked = "▁" + t.replace(" ", "▁")
        want = best(marked)[1]
        assert sum(table.get(p, -1e6) for i in got[k] for p, j in ids.items() if i == j) == sum(table.get(p, -1e6) for i in want for p, j in ids.items() if i == j), t
        assert len(got[k]) > 0
    assert {r["doc_id"]: r["text"] for r in lat.decode(lat.encode(docs, pieces, fold="viterbi"), pieces).collect()} == dict(enumerate(texts))


def test_decode_of_unknown_and_null_ids(spark):
    pieces = lat.piece_table(spark, MODEL)
    hello = LIBRARY.encode("hello \u6f22")
    rows = [(1, hello), (2, None), (3, []), (4, [-1, 2**31 - 1, 1, 2]), (5, [None, *hello, None]), (None, hello), (7, hello[:-1])]
    got = {r["doc_id"]: r["text"] for r in lat.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), pieces).collect()}
    broken = b"".join(lat.Vocabulary(pieces).hexes[i] for i in hello[:-1]).decode("utf-8", "replace").replace(lat.SPACE, " ").removeprefix(" ")
    assert got == {1: "hello \u6f22", 2: "", 3: "", 4: "", 5: "hello \u6f22", None: "hello \u6f22", 7: broken}
    assert lat.decode(spark.createDataFrame([(1, [4])], "doc_id bigint, ids array<int>"), pieces.limit(0)).collect()[0]["text"] == ""


def test_parts_are_exchanged_once_and_joined_to_nothing_large(spark):
    docs = spark.createDataFrame([(k, f"words of text {k}") for k in range(9)], "doc_id bigint, text string")
    text = lat.encode(docs, lat.piece_table(spark, MODEL), model_path=MODEL)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(word") == 1 and "SortMergeJoin" not in text and "ShuffledHashJoin" not in text


def test_a_changed_text_raises():
    assert lat._symbols("abcd", 0b10101) == ["ab", "cd"] and lat._symbols("abcd", [0, 1, 4]) == ["a", "bcd"]
    for word, cuts in (("abc", 0b10101), ("abcd", 0b101), ("a", 0)):
        try:
            lat._symbols(word, cuts)
        except ValueError:
            continue
        raise AssertionError(word)


def test_one_pass_where_it_is_proved_and_the_merge_fold_elsewhere(spark):
    rng = random.Random(8)
    vocabulary = lat.Vocabulary(lat.piece_table(spark, MODEL))
    assert len(vocabulary.ranks) > vocabulary.ordered() > 0.99 * len(vocabulary.ranks)
    # "bcd" comes to join two symbols only after its turn, "aa" and "dd" have one score.
    table = {p: -float(k) for k, p in enumerate(["a", "b", "c", "d", "\u2581", "ab", "bcd", "cd", "aa", "da"])} | {"dd": -8.0}
    rows = [(i, f"<0x{i:02X}>", None, f"{i:02x}", True) for i in range(256)] + [(256 + k, p, s, p.encode().hex(), False) for k, (p, s) in enumerate(table.items())]
    pieces = spark.createDataFrame(rows, "id int, piece string, score double, hex string, is_byte boolean")
    own = lat.Vocabulary(pieces)
    assert own.ordered() == own.ranks["bcd"] == 6
    texts = ["bcd", "abcd", "ab", *("".join(rng.choice("abcd e") for _ in range(rng.randint(1, 20))) for _ in range(80))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def merged(text):
        at = list("\u2581" + text.replace(" ", "\u2581"))
        while ways := [(-table[x + y], i) for i, (x, y) in enumerate(zip(at, at[1:], strict=False)) if x + y in table]:
            i = min(ways)[1]
            at[i : i + 2] = [at[i] + at[i + 1]]
        return at

    names = {r[0]: r[1] for r in rows}
    got = {r["doc_id"]: [names[i] for i in r["ids"]] for r in lat.encode(docs, pieces).collect()}
    assert got == {k: ["<0x65>" if s == "e" else s for s in merged(t)] for k, t in enumerate(texts)}


def test_chunks_of_many_texts_are_those_of_each():
    rng = random.Random(3)
    texts = ["", "", " ", "a ", "", "\n", "b\n", " \u00e9", *("".join(rng.choice(["a", " ", "  ", "\n", "\u6f22", "\u2581"]) for _ in range(rng.randint(0, 9))) for _ in range(300)), ""]

    def plain(text):
        marked = text.replace("\u2581", " ")
        return re.findall("\n| +[^ \n]*|[^ \n]+", " " + marked) if marked else []

    for some in (texts, texts[:2], [], [""]):
        found, ends = lat.chunks_of(pa.array(some, pa.string()))
        assert [found[i:j].to_pylist() for i, j in zip(ends, ends[1:], strict=False)] == [plain(t) for t in some]
