"""Every stage on its own input, against a plain version, and the columns in between."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallyline.llm import secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        place = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(place)
        result = spark.read.parquet(place)
        out.append((docs, result))
        docs = result
    return out


def test_columns_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "packing"] and corpus_pipeline.ORACLE_SQL is None


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_all_but_the_last_return_documents(stages):
    columns = stages[0][0].columns
    assert all(result.columns == columns for _, result in stages[:-1])


def test_toxicity(spark, stages):
    docs, result = map(by_id, stages[0])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(docs) - set(result)
    assert all(docs[i] == result[i] for i in result)
    assert sum(labels.get(i) == 0 for i in gone) <= 2 and sum(labels.get(i) == 1 for i in result) <= 5


def test_exact_dedup(stages):
    docs, result = map(by_id, stages[1])
    groups = {}
    for i, r in docs.items():
        groups.setdefault("".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(r["text"] or ""), i))
    assert set(result) == {min(g)[1] for g in groups.values()} and all(docs[i] == result[i] for i in result)


def test_near_dedup(stages):
    docs, result = map(by_id, stages[2])
    ids = sorted(docs)
    sets = []
    for i in ids:
        words = "".join(c.lower() if c.isascii() else c for c in docs[i]["text"] or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in enumerate(sets):
        for j, two in enumerate(sets[:i]):
            if len(one & two) >= 0.8 * len(one | two):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(result) == {ids[find(i)] for i in range(len(ids))} and all(docs[i] == result[i] for i in result)


def test_secret_scan(stages):
    docs, result = map(by_id, stages[3])
    assert set(docs) == set(result)
    for i, r in docs.items():
        data = (r["text"] or "").encode()
        if secrets.byte_spans(data):
            assert secrets.byte_spans(result[i]["text"].encode()) == [] and result[i]["n_chars"] == len(result[i]["text"])
        else:
            assert result[i] == r


def test_packing(stages):
    docs, pieces = by_id(stages[4][0]), stages[4][1].collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2] for i, r in docs.items()}
    spots = sorted((p["sequence_id"] * 4096 + p["offset"], p["length"]) for p in pieces)
    assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:], strict=False))
    met = {}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["doc_tokens"] == len(ids[p["doc_id"]]) and len(part) == p["length"] and p["offset"] + p["length"] <= 4096
        assert p["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        met[p["doc_id"]] = met.get(p["doc_id"], 0) + p["length"]
    assert met == {i: len(x) for i, x in ids.items()}


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() == 0
