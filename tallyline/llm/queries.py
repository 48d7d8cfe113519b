"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .embedding_dedup import embedding_links
from .exact_dedup import exact_groups
from .hard_negatives import mine_hard_negatives
from .html_extract import extract_text, fit_extractor
from .merkle import merkle_manifest, tamper_report
from .mixing import mix_sources
from .oracle import hard_negatives_sql, merkle_sql, mix_sql
from .packing import pack
from .secrets import scan_secrets
from .simhash import near_duplicates
from .token_counts import token_counts
from .sentencepiece_lattice import decode, encode, piece_table
from .toxicity import fit_toxicity, held_out, score_toxicity
from .url_filter import filter_urls

# The rules of the URL contract (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit_extractor(pages))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict")) for host, path, verdict in URL_RULES]
    return filter_urls(table(spark, sf_dir, "pages"), spark.range(1).select(F.inline(F.array(*rules))))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"), hash_all=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), model_path=public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as decimal text, comma-joined), decoded_sha256 (of the text the ids give).
    The model is a BPE model, so the lattice is read by the merge fold."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = piece_table(spark, model)
    encoded = encode(table(spark, sf_dir, "documents"), pieces, model_path=model)
    # The id column carries the figures of the row, so that rows with a null or repeated id keep their own.
    figures = F.struct("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", ",")).alias("ids_crc32"))
    decoded = decode(encoded.select(figures.alias("row"), "ids"), pieces, id_col="row")
    return decoded.select("row.doc_id", "row.n_pieces", "row.ids_crc32", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_report(merkle_manifest(table(spark, sf_dir, "documents"), rehearse=True))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_secret_scan": op9_secret_scan,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_mix": op13_source_mix,
}

_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NORM = "coalesce(text, '')"
for _c in (32, 9, 10, 11, 12, 13):
    _NORM = f"replace({_NORM}, chr({_c}), '')"

ORACLE_SQL = {
    "op5_url_filter": rf"""
        WITH rules(rh, rp, rv) AS (VALUES {_RULE_VALUES}),
        urls AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages),
        fits AS (
            SELECT page_id, rh || rp AS rule, rv,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS k
            FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.rv, 'allow') AS verdict
        FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id AND f.k = 1""",
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_NORM}) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op11_merkle_manifest": merkle_sql(),
    "op12_hard_negatives": hard_negatives_sql(),
    "op13_source_mix": mix_sql(),
}
