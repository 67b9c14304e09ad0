"""Token counts by a two-tier lookup on the map side.

A text is the same sum however it is cut into pre-tokens, so a count needs only the token
length of each pre-token. The first tier is a compact table of frequent pre-tokens, made on the
driver from a bounded sample and broadcast; the second is a cache in each Python worker that
the tokenizer itself fills. Pre-tokens are never shuffled and the result does not depend on
what the tables hold.
"""

from __future__ import annotations

import json
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import ship, slices, text_views

#: Rows that the table of frequent pre-tokens is made from, and its entries, at most.
SAMPLE_ROWS = 512
FREQUENT = 40_000
#: Pre-tokens that a worker's cache holds, at most; beyond it a miss is encoded and forgotten.
CACHED = 300_000

#: Fixed value: the pre-token pattern that byte-level BPE vocabularies are defined with.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Lengths(dict):
    """Token length by pre-token; a miss is encoded and kept while there is room."""

    def __init__(self, path: str, known: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(known)
        self._encode = Tokenizer.from_file(path).encode
        self.room = CACHED

    def __missing__(self, piece: str) -> int:
        n = len(self._encode(piece, add_special_tokens=False).ids)
        if self.room > 0 and len(piece) < 200:
            self.room -= 1
            self[piece] = n
        return n


_workers: dict[str, tuple[Lengths, object, object]] = {}


def _counter(path: str, known: dict[str, int]) -> tuple[Lengths, object, object]:
    """The worker's cache for this tokenizer, with its pre-token and special-token patterns."""
    if path not in _workers:
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only byte-level BPE files are counted by pre-token, without normalizer or prefix space, and with added tokens that match anywhere as they are")
        special = [t["content"] for t in spec.get("added_tokens", [])]
        cut = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        _workers[path] = Lengths(path, known), regex.compile(BYTE_LEVEL), cut
    return _workers[path]


def count_tokens(text: str, lengths: Lengths, pieces: object, special: object) -> int:
    """Tokens of one whole text; each special string in it is one token, as the library has it."""
    if special is None or not special.search(text):
        return sum(map(lengths.__getitem__, pieces.findall(text)))
    total, at = 0, 0
    for m in special.finditer(text):
        total += 1 + sum(map(lengths.__getitem__, pieces.findall(text[at : m.start()])))
        at = m.end()
    return total + sum(map(lengths.__getitem__, pieces.findall(text[at:])))


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens of SAMPLE_ROWS shorter rows: a warm start, bounded by FREQUENT."""
    counts: Counter[str] = Counter()
    pieces = regex.compile(BYTE_LEVEL)
    for row in docs.select(F.col(text_col).alias("t")).where(F.length("t") <= 20_000).limit(SAMPLE_ROWS).collect():
        counts.update(pieces.findall(row["t"]))
    lengths = Lengths(path, {})
    return {p: lengths[p] for p, n in counts.most_common(FREQUENT) if len(p) < 200}


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``path`` is a tokenizer file that every worker can open. Texts are counted whole, without
    begin, end or added special tokens, truncation or padding. Cases: a null text counts as an
    empty one (0 bytes, 0 tokens); ids may be null or repeat; an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(pickle.dumps(frequent_lengths(docs, path, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, pieces, special = _counter(path, {} if path in _workers else pickle.loads(table.value))
        for batch in slices(batches, 500):
            sizes, tokens = [], []
            for view in text_views(batch, "text"):
                sizes.append(len(view))
                tokens.append(count_tokens(str(view, "utf-8"), lengths, pieces, special))
            n = np.array(tokens, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
