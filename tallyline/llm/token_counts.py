"""Token counts of a SentencePiece BPE model by the whole-token shortcut.

Proved once per model (``prove``): which vocabulary strings, standing alone as a pre-token, encode to exactly one token.
A pre-token that is one of these counts 1 without any merging; only the rest are merged, by the library, once per
distinct string. Cutting the text into pre-tokens changes no merge, because (also proved) no piece holds a space after
another character, and none holds a line feed: merges stay inside the pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, carried, kind_of, text_of

SPACE = "▁"
#: Bytes of merged pre-tokens that one Python worker remembers; the memory is emptied beyond it, results don't depend on it.
REMEMBERED_BYTES = 128 << 20
#: Bytes of an entry besides its text: an object header and a place in the table.
ENTRY_BYTES = 49 + 100
#: Pre-tokens longer than this are not remembered from one call to the next.
LONG_KEY = 1 << 10
#: Characters of text that are cut into pre-tokens together; one text at least.
TOGETHER = 1 << 20


class PreTokenCosts(dict):
    """Tokens by pre-token key: the pre-token without its first space mark; line feed + word where none precedes it."""

    def __init__(self, path: str):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.single = self.prove()
        self.fresh()

    def prove(self) -> set[str]:
        pieces = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        if any("\n" in p or SPACE in p.lstrip(SPACE) for _, p in pieces):
            raise ValueError("a piece crosses pre-tokens: this model needs another way of counting")
        if self.model.encode("a") and not self.model.id_to_piece(self.model.encode("a")[0]).startswith(SPACE):
            raise ValueError("the model puts no space before a text")
        if len(self.model.encode("a  a")) == len(self.model.encode("a a")) or self.model.encode("½") == self.model.encode("1/2"):
            raise ValueError("the model changes texts before it cuts them")
        words = [(i, p[1:]) for i, p in pieces if p.startswith(SPACE) and len(p) > 1 and p[1] != SPACE]
        return {word for (i, word), ids in zip(words, self.model.encode([w for _, w in words], num_threads=1), strict=True) if ids == [i]}

    def fresh(self) -> None:
        self.clear()
        self.held = 0
        self.update(dict.fromkeys(self.single, 1))
        self[""] = len(self.model.encode("\n")) - 1  # a space mark alone: the text is the mark and the line feed

    def learn(self, keys: set[str]) -> None:
        """Afterwards all of ``keys`` are known."""
        new = list(keys.difference(self))
        self.held += sum(map(len, new)) + ENTRY_BYTES * len(new)
        if self.held > REMEMBERED_BYTES:
            self.fresh()
            new = list(keys.difference(self))
            self.held = sum(map(len, new)) + ENTRY_BYTES * len(new)
        for key, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            self[key] = len(ids) - (2 if key[0] == "\n" else 0)  # without the marks put in front

    def forget_long(self, keys: set[str]) -> None:
        for key in keys:
            if len(key) > LONG_KEY and key in self:
                del self[key]
                self.held -= len(key) + ENTRY_BYTES


def pre_tokens(text: str) -> list[str]:
    """Keys of the pre-tokens of a text; one line feed token goes between lines besides."""
    keys: list[str] = []
    for n, line in enumerate(text.replace(SPACE, " ").split("\n")):
        words = line.split(" ")
        if n:
            words[0] = "\n" + words[0]
        if "" in words:  # runs of spaces: they belong to the word after them
            joined, spaces = [], 0
            for k, word in enumerate(words):
                if word == "" and k + 1 < len(words):
                    spaces += 1
                else:
                    joined.append(" " * spaces + word)
                    spaces = 0
            words = joined
        keys += words
    return keys


@lru_cache(maxsize=2)
def costs(path: str) -> PreTokenCosts:
    return PreTokenCosts(path)


def counts_of(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the library counts them without added tokens."""
    known, out, at = costs(path), [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size < TOGETHER or to == at):
            size += len(texts[to])
            to += 1
        keys = [pre_tokens(text) if text else [] for text in texts[at:to]]
        distinct = set(chain.from_iterable(keys))
        known.learn(distinct)
        out += [sum(map(known.__getitem__, ks)) + text.count("\n") for ks, text in zip(keys, texts[at:to], strict=True)]
        known.forget_long(distinct)
        at = to
    return out


def token_counts(docs: DataFrame, *, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: 0 bytes, 0 tokens. Texts are counted whole. Null ids and repeated rows each keep their
    row; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    bound_batches(docs)
    rows = docs.select(carried(id_col).alias("doc"), F.octet_length(text_of(text_col)).cast("bigint").alias("n_bytes"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["n_tokens"] = np.array(counts_of(batch.pop("text").tolist(), model_path), dtype=np.int64)
            yield batch

    counted = rows.mapInPandas(run, "doc string, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("doc").cast(kind_of(docs, id_col)).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
