"""Ids beyond 2^53 keep their value next to a null id, in every operator that goes through pandas."""

import public_tokenizers
import pytest

from tallyline.llm import embedding_dedup, packing, secrets, simhash, token_counts, toxicity

BIG = 2**62 + 1


@pytest.mark.parametrize(
    "operator",
    [
        simhash.near_duplicates,
        secrets.scan_secrets,
        lambda d: token_counts.token_counts(d, model_path=public_tokenizers.path("piece_bpe_32k.model"), limit=9),
        lambda d: packing.pack(d, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=64),
        lambda d: toxicity.score_toxicity(d, toxicity.ToxicityModel(toxicity.np.zeros(0, dtype=int), toxicity.np.zeros(0), 0.0)),
    ],
)
def test_ids_survive(spark, operator):
    docs = spark.createDataFrame([(BIG, "one text"), (None, "another text")], "doc_id bigint, text string").coalesce(1)
    out = operator(docs)
    assert out.schema["doc_id"].dataType.simpleString() == "bigint" and {r["doc_id"] for r in out.collect()} == {BIG, None}


def test_large_vector_ids(spark):
    rows = [(BIG + k, [1.0, 0.001 * k]) for k in range(3)] + [(5, [0.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert got == {BIG: (2, BIG), BIG + 1: (2, BIG), BIG + 2: (2, BIG), 5: (0, 5)}
