"""Benchmark passages in documents: CGK embedding, bit-sampling search, exact edit verification.

Benchmark items and item-sized windows of documents are strings of words. A window can be within
the edit bound of an item only if it holds enough words of the benchmark's vocabulary and enough of its
word pairs (an edit breaks two at most), which running sums decide for every window. What remains is embedded by CGK walks: a walk reads the
word under it, writes it out, and moves on by a random bit of that word and step, so that a few
edits become a few differing places of the output. Every other walk begins at the end of the string, so
that edits which gather on one side leave walks whole. Hash tables over sampled places of the
walks find item candidates; their number follows from the target recall, measured for each length when the
index is built, on items edited evenly, at the head, in the middle and at the tail. A length that MOST_TABLES
don't bring to the recall is searched without tables: every window with enough known words is verified. Items
so short that no edit is allowed are found by a hash of all their words. Candidates are verified by exact
edit distance on words.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import gathered, ship, text_views
from .words import char_offset, number, plain_words, word_spans

#: Places sampled for a table, tables taken from a walk, and tables of a length at most.
PLACES = 3
PER_WALK = 2
MOST_TABLES = 96
#: Steps of a walk that places are taken from, as a multiple of the window.
REACH = 0.9
#: Items of a length that the recall is measured on, at most, and edited copies of each kind.
TRIED, COPIES = 60, 2
#: Bytes of item texts that one pass over the documents broadcasts, at most.
ITEM_BYTES = 16_000_000


class Index:
    """Walks, tables and items of one broadcast block of the benchmark."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float, recall: float, least_words: int, seed: int = 29):
        self.edits = edits
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            words = plain_words(text)
            if len(words) >= least_words:
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int32)))
        self.longest = max((len(w) for _, w in self.items), default=0)
        rng = np.random.default_rng(seed)
        walks = -(-MOST_TABLES // PER_WALK)
        self.mixers = rng.integers(0, 2**63, (walks, 2 * self.longest + 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = rng.random((walks, PER_WALK, PLACES))
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for i, (_, w) in enumerate(self.items):
            self.by_length[len(w)].append(i)
        #: Word pairs of the items in a table of hashed pairs: a bit for each length of items (modulo 64) that have the pair.
        self.pairs = np.zeros(1 << max(16, (64 * sum(len(w) for _, w in self.items)).bit_length()), dtype=np.uint64)
        for _, w in self.items:
            np.bitwise_or.at(self.pairs, self._pair(w), np.uint64(1) << np.uint64(len(w) % 64))
        #: Tables of each length; 0 where windows are verified without tables.
        self.tables = {length: self._enough(length, recall, rng) for length in self.by_length}
        self.keys: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for length, members in self.by_length.items():
            joined = np.concatenate([self.items[i][1] for i in members])
            starts = np.arange(len(members)) * length
            for walk, table, key in self.hashed(joined, starts, length):
                order = np.argsort(key, kind="stable")
                self.keys[length, walk, table] = key[order], np.array(members)[order]

    def _pair(self, ids: np.ndarray) -> np.ndarray:
        """Places of neighbouring words in the table of pairs."""
        x = ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids[1:].astype(np.uint64)
        return (x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - len(self.pairs).bit_length())).astype(np.int64)

    def allowed(self, length: int) -> int:
        return int(self.edits * length + 1e-9)

    def _edited(self, words: np.ndarray, kind: int, rng: np.random.Generator) -> list[int]:
        """The item with the full number of edits: anywhere, in its first or middle or last two fifths."""
        v, n = list(words), len(words)
        low, high = ((0.0, 1.0), (0.0, 0.4), (0.3, 0.7), (0.6, 1.0))[kind]
        for _ in range(self.allowed(n)):
            at, how = min(len(v) - 1, int((low + (high - low) * rng.random()) * len(v))), rng.integers(3)
            new = int(rng.integers(len(self.vocabulary))) + 1
            v[at : at + (how != 1)] = [new] if how < 2 else []
            if not v:
                v = [new]
        return (v + [0] * n)[:n]

    def _enough(self, length: int, recall: float, rng: np.random.Generator) -> int:
        """Tables that find items with the full number of edits at the rate ``recall``, whatever the kind of edits, by trial; 0 if none do."""
        if not self.allowed(length):
            return 1
        tried = [self.items[i][1] for i in rng.permutation(self.by_length[length])[:TRIED]]
        copies = -(-TRIED * COPIES // len(tried))
        pairs = [(w, self._edited(w, kind, rng), kind) for w in tried for kind in range(4) for _ in range(copies)]
        joined = np.array([x for w, v, _ in pairs for x in (*w, *v)], dtype=np.int32)
        starts, kinds = np.arange(2 * len(pairs)) * length, np.array([k for *_, k in pairs])
        found = np.zeros(len(pairs), dtype=bool)
        for n, (_, _, key) in enumerate(self.hashed(joined, starts, length, MOST_TABLES), 1):
            found |= key[::2] == key[1::2]
            if min(found[kinds == k].mean() for k in range(4)) >= recall:
                return n
        return 0

    def hashed(self, ids: np.ndarray, starts: np.ndarray, length: int, tables: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(walk, table, keys) of the windows ids[start : start + length]."""
        tables = self.tables[length] if tables is None else tables
        if not self.allowed(length):
            key = np.zeros(len(starts), dtype=np.uint64)
            for t in range(length):
                key = (key ^ ids[starts + t].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            yield 0, 0, key
            return
        steps = max(PLACES, int(REACH * length))
        for walk in range(-(-tables // PER_WALK)):
            chosen = (self.places[walk] * steps).astype(int)
            wanted = set(chosen.ravel().tolist())
            first, way = (starts, 1) if walk % 2 == 0 else (starts + length - 1, -1)
            at, seen = np.zeros(len(starts), dtype=np.int64), {}
            for t in range(max(wanted) + 1):
                word = ids[first + way * np.minimum(at, length - 1)]
                if t in wanted:
                    seen[t] = np.where(at < length, word, -1)
                at += ((word.astype(np.uint64) + np.uint64(1)) * self.mixers[walk, t] >> np.uint64(63)).astype(np.int64)
            for table in range(min(PER_WALK, tables - walk * PER_WALK)):
                key = np.zeros(len(starts), dtype=np.uint64)
                for t in sorted(chosen[table].tolist()):
                    key = (key ^ seen[t].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield walk, table, key

    def candidates(self, ids: np.ndarray) -> dict[int, set[int]]:
        """Window starts by item. ``ids`` may hold several documents with gaps of zeros between them."""
        found: dict[int, set[int]] = defaultdict(set)
        known = np.concatenate([[0], np.cumsum(ids > 0, dtype=np.int32)])
        lengths = np.where((ids[:-1] > 0) & (ids[1:] > 0), self.pairs[self._pair(ids)], np.uint64(0)) if len(ids) else np.empty(0, dtype=np.uint64)
        met = np.concatenate([[0], np.cumsum(lengths != 0, dtype=np.int32)])
        lengths = lengths[lengths != 0]
        for length in self.by_length:
            if len(ids) < length:
                continue
            most = self.allowed(length)
            enough = known[length:] - known[:-length] >= length - most
            enough &= met[length - 1 :] - met[: len(met) - length + 1] >= length - 1 - 2 * most
            starts = np.flatnonzero(enough)
            # The same for the pairs of items of this length alone, over the places that have any.
            own = np.concatenate([[0], np.cumsum(lengths >> np.uint64(length % 64) & np.uint64(1), dtype=np.int32)])
            starts = starts[own[met[starts + length - 1]] - own[met[starts]] >= length - 1 - 2 * most]
            if not self.tables[length]:
                for item in self.by_length[length]:
                    found[item].update(starts.tolist())
                continue
            for at in range(0, len(starts), 200_000):
                part = starts[at : at + 200_000]
                for walk, table, key in self.hashed(ids, part, length):
                    keys, members = self.keys[length, walk, table]
                    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    for k in np.flatnonzero(high > low).tolist():
                        for item in members[low[k] : high[k]].tolist():
                            found[item].add(int(part[k]))
        return found


def edit_match(pattern: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of ``pattern`` in ``text`` within ``most`` edits; the first of the best.

    The dynamic programme runs bit-parallel, a column of it in two integers.
    """
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


def matches(index: Index, docs: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, edits, first word, end word): the best verified place of each stretch of a document where windows of an item lie."""
    gap = np.zeros(index.allowed(index.longest) + 1, dtype=np.int32)
    numbered = [number(plain_words(d), index.vocabulary) for d in docs]
    begins, parts, at = [], [], 0
    for ids in numbered:
        begins.append(at)
        parts += [ids, gap]
        at += len(ids) + len(gap)
    ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
    begins_at = np.array(begins, dtype=np.int64)
    for item, starts in index.candidates(ids).items():
        words = index.items[item][1]
        length, slack = len(words), index.allowed(len(words))
        regions: dict[int, list[list[int]]] = defaultdict(list)
        for s in sorted(starts):
            doc = int(np.searchsorted(begins_at, s, "right")) - 1
            a, b = max(0, s - begins[doc] - slack), min(len(numbered[doc]), s - begins[doc] + length + slack)
            if regions[doc] and a <= regions[doc][-1][1]:
                regions[doc][-1][1] = max(b, regions[doc][-1][1])
            else:
                regions[doc].append([a, b])
        pattern = words.tolist()
        for doc, spans in regions.items():
            for a, b in spans:
                text = numbered[doc][a:b].tolist()
                if hit := edit_match(pattern, text, slack):
                    # The start: the same search backwards from the end.
                    back = edit_match(pattern[::-1], text[: hit[1]][::-1][: length + slack], hit[0])
                    yield doc, item, hit[0], max(0, a + hit[1] - (back[1] if back else length)), a + hit[1]


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, recall: float = 0.95, least_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, item_words, start, end): the places of each item in each document.

    Of places that overlap or touch the best is given. A place counts where word edits (insert, delete, replace) do not exceed ``edits`` times the
    item's words; start and end are code points of the whole text, end exclusive. Case and ASCII
    punctuation do not count. Items come in blocks of ITEM_BYTES; each block is one pass over
    the documents, so that what is broadcast stays bounded. Cases: items or texts that are null
    or empty match nothing, nor do items shorter than ``least_words``, which say too little (items of fewer
    than five words allow no edit); a script without spaces has one word between two breaks; repeated documents and items
    match each for itself; null ids are kept; empty tables give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = [rows.mapInArrow(_search(index), "doc_id long, item_id long, edits int, item_words int, start long, end long") for index in _indexes(docs, benchmark, edits, recall, least_words)]
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, recall: float = 0.95, least_words: int = 3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they were, without a shuffle. Cases as for ``contaminated``."""
    for index in _indexes(docs, benchmark, edits, recall, least_words):
        docs = docs.mapInArrow(_drop(index, text_col), docs.schema)
    return docs


def _indexes(docs: DataFrame, benchmark: DataFrame, edits: float, recall: float, least_words: int) -> list:
    """Broadcast indexes over blocks of ITEM_BYTES of the benchmark, one at least."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.encode("text", "UTF-8").alias("t")).where("t is not null and length(t) > 0")
    passes = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // ITEM_BYTES))
    out = []
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == k) if passes > 1 else items
        loaded = sorted(((r["item_id"], bytes(r["t"])) for r in block.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        out.append(spark.sparkContext.broadcast(pickle.dumps(Index(loaded, edits, recall, least_words))))
    return out


def _drop(index, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = pickle.loads(index.value)
        for batch in gathered(batches, 5000, 16 << 20):
            keep = np.ones(batch.num_rows, dtype=bool)
            if known.items:
                keep[[m[0] for m in matches(known, [bytes(v) for v in text_views(batch, text_col)])]] = False
            yield batch.filter(pa.array(keep))

    return run


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = pickle.loads(index.value)
        for batch in gathered(batches, 5000, 16 << 20) if known.items else ():
            texts = [bytes(v) for v in text_views(batch, "text")]
            ids, out = batch.column(0).to_pylist(), []
            for doc, item, edits, a, b in matches(known, texts):
                first, end = word_spans(texts[doc])
                out.append((ids[doc], known.items[item][0], edits, len(known.items[item][1]), char_offset(texts[doc], first[a]), char_offset(texts[doc], end[b - 1])))
            if out:
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "edits", "item_words", "start", "end"])

    return run
