import hashlib
import zlib

import public_tokenizers
import sentencepiece

from tallyline.llm.queries import op8_sentencepiece


def test_query_decodes_what_it_encodes(spark, tmp_path):
    texts = ["Hello, world", None, "", "two  spaces\nand \u00e9\u4e16 lines", "x" * 60]
    rows = [*enumerate(texts), (0, "another text"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def want(i, text):
        ids = model.encode(text or "")
        return str(i), len(ids), zlib.crc32(",".join(map(str, ids)).encode()), hashlib.sha256(model.decode(ids).encode()).hexdigest()

    got = [(str(r["doc_id"]), r["n_pieces"], r["ids_crc32"], r["decoded_sha256"]) for r in op8_sentencepiece(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want(i, t) for i, t in rows)
