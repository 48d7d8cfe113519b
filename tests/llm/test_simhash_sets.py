import random

import pytest

import corpus_pipeline
from tallyline.llm import simhash_sets

WORDS = [f"w{k}" for k in range(5000)]


def corpus():
    """Texts with copies changed in a few words, a group larger than a small bucket, and texts half shared."""
    rng, texts = random.Random(4), []
    for _ in range(12):
        base = rng.choices(WORDS, k=200)
        for changed in (0, 1, 2, 3, 4, 6):
            words = list(base)
            for i in rng.sample(range(200), changed):
                words[i] = rng.choice(WORDS)
            texts.append(" ".join(words))
    hot = rng.choices(WORDS, k=150)
    for k in range(60):
        texts.append(" ".join([*hot[: 150 - k % 40], *rng.choices(WORDS, k=k % 40)]))
    rng.shuffle(texts)
    return [*texts, "", None, "one two", "One  two", "three"]


def brute(texts):
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8 if a | b else True:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("small", "block"), [(32, 1024), (3, 5)])
def test_components_against_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(simhash_sets, "SMALL", small)
    monkeypatch.setattr(simhash_sets, "BLOCK", block)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_sets.similar_texts(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_stage_drops_near_copies_that_the_fingerprints_miss(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(texts))) and kept.columns == docs.columns


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (9, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] or -1 for r in simhash_sets.keep_one_of_similar(docs).collect()) == [-1, -1, 3, 3, 9]
    assert simhash_sets.keep_one_of_similar(docs.limit(0)).count() == 0


def test_pairs_within_the_radius_share_a_masked_key():
    rng = random.Random(3)
    for _ in range(30):
        words = rng.choices(WORDS, k=400)
        near = list(words)
        near[rng.randrange(400)] = "changed"
        a, b = (simhash_sets.shingles(" ".join(w).encode()) for w in (words, near))
        prints = [simhash_sets.fingerprint_of(x) for x in (a, b)]
        if (int(prints[0]) ^ int(prints[1])).bit_count() <= 3:
            assert set(simhash_sets.keys_of(a)[simhash_sets.BANDS :].tolist()) & set(simhash_sets.keys_of(b)[simhash_sets.BANDS :].tolist())
