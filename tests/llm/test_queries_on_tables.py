"""Registered queries without an SQL twin, over the smallest given tables, against plain versions."""

import hashlib
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from tallyline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def given(table, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{table}.parquet'").fetchall()


def smallest_reachable(nodes, links):
    found = {n: n for n in nodes}

    def top(n):
        while found[n] != n:
            n = found[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        found[b] = a
    return {n: top(n) for n in nodes}


class Article(HTMLParser):
    """What stands within <article>, without scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.quiet, self.parts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.quiet += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.quiet -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside > 0 and not self.quiet:
            self.parts.append(data)


def test_op1_gives_the_articles(spark):
    got = {r["page_id"]: r for r in QUERIES["op1_html_extract"](spark, SF).collect()}
    pages = given("pages", "page_id, url, html")
    assert len(got) == len(pages)
    right = 0
    for i, url, html in pages:
        parser = Article()
        parser.feed(html or "")
        right += "".join(got[i]["text"].split()) == "".join("".join(parser.parts).split())
        assert got[i]["url"] == url and got[i]["n_chars"] == len(got[i]["text"]) and not re.search(r"\s\s|^\s|\s$", got[i]["text"])
    assert right >= 0.9 * len(pages)  # of this smallest table the heading is lost on a few pages, where the text repeats it


def test_op3_links_every_pair_within_the_radius(spark):
    plain = {}
    for i, text in given("documents", "doc_id, text"):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        plain[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    links = [(a, b) for a in plain for b in plain if a < b and (plain[a] ^ plain[b]).bit_count() <= 3]
    component = smallest_reachable(plain, links)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, SF).collect()}
    assert got == {(i, f"{fp:016x}", component[i]) for i, fp in plain.items()}


def test_op4_meets_the_links(spark):
    rows = given("embeddings", "vec_id, embedding")
    ids, unit = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in QUERIES["op4_embedding_dedup"](spark, SF).collect()}
    assert len(got) == len(ids)
    want = dict(zip(ids, near.sum(axis=1).tolist(), strict=True))
    assert all(got[i]["n_links"] <= want[i] for i in ids) and sum(r["n_links"] for r in got.values()) >= 0.9 * sum(want.values())
    component = smallest_reachable(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert sum(got[i]["component_id"] == component[i] for i in ids) >= 0.98 * len(ids)


def test_op7_counts_are_the_librarys(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = set()
    for i, text in given("documents", "doc_id, text"):
        n = len(library.encode(text or ""))
        want.add((i, len((text or "").encode()), n, n > 4096))
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op7_token_counts"](spark, SF).collect()} == want


def test_op9_base_spans_are_those_of_a_plain_search(spark):
    kinds = {
        "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    want = set()
    for i, text in given("documents", "doc_id, text"):
        spans = [(m.start(), at, kind, m.end()) for at, (kind, (pattern, keep)) in enumerate(kinds.items()) for m in re.finditer(pattern, text or "") if keep(m)]
        told = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        want.add((i, *[sum(s[2] == kind for s in spans) for kind in kinds], hashlib.sha256(told.encode()).hexdigest()))
    got = QUERIES["op9_secret_scan"](spark, SF).collect()
    assert {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got} == want and len(got) == len(want)


def test_op10_pieces_hold_every_id_once_in_sequences_without_gaps(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = [r.asDict() for r in QUERIES["op10_packing"](spark, SF).collect()]
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, text in given("documents", "doc_id, text"):
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces.pop(i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    totals = []
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        totals.append(at)
    assert max(totals) <= 4096 and sum(t == 4096 for t in totals) >= len(totals) - 1
