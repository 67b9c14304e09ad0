"""Near-duplicate passages by compact windows.

For a hash function over the five-word shingles of a text, every subsequence of at least ``least``
words has a min-hash, and all subsequences whose minimum sits at the same place ``c`` form one
compact window (l, c, r): they start in l..c and end in c..r. The windows are the nodes of the
Cartesian tree over the hashes that span enough shingles, about 2n/least of them for n shingles.
Windows of all documents meet by min-hash; an interval join over the hash functions keeps the places
of two documents where enough functions agree on a common diagonal, and these are verified on the
words of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import gathered, ship, slices, stash, suspects, text_views, wide
from .words import PLAIN, char_offset, edges, word_spans

WORDS = 5
#: Hash functions, and how many must agree on a place.
HASHES = 4
AGREE = 2
#: Bytes of text whose windows are made at a time, and of text whose words are hashed at a time, about; places with known powers.
CHUNK = 1 << 20
HASHED = 1 << 16
BLOCK = 1 << 20
#: Windows of other surroundings under a key that a window is compared with by signature, and how many of all it is tied to.
VARIANTS = 24
TIED = 2
#: One document in so many is looked at for keys that very many share. A key is hot from this share of the
#: scouted documents on, and from this many; its windows are dealt by what is around them.
SCOUT = 64
HOT_SHARE = 0.002
HOT_LEAST = 24
#: Windows of one hot key and surroundings that one task takes, about; more are dealt by document too.
HOT_ROWS = 100_000
#: Rows of a hot key that a task compares with all earlier ones, about; pairs that are compared at a time.
COMPARED = 8192
PAIRS = 1 << 15
#: Keys of fewer rows are compared together; rows of a large key that are judged at a time.
SMALL = 32
STEP = 16
#: Shingles by which the diagonal of two passages may shift at an edit.
DRIFT = 8
#: Shingles of texts that a worker keeps while it verifies, about.
CACHED_SHINGLES = 3_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base & ((1 << 64) - 1), dtype=np.uint64)], dtype=np.uint64)


_ODD = 0x9FB21C651E98DF25
_BACK = pow(_ODD, -1, 1 << 64)
_POWERS = _powers(_ODD, BLOCK), _powers(_BACK, BLOCK)


def _hash_block(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of plain bytes, and where the words begin: differences of one running sum."""
    x = np.frombuffer(part, dtype=np.uint8)
    start, end = edges(x)
    up, back = _POWERS if len(x) <= BLOCK else (_powers(_ODD, len(x)), _powers(_BACK, len(x)))
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * up[: len(x)], out=sums[1:], dtype=np.uint64)
    h = (sums[end] - sums[start]) * back[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h * _GOLD, start


def word_hashes(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of plain bytes, by blocks that end between words."""
    found, at = [], 0
    while at < len(plain):
        end = len(plain)
        if end - at > HASHED:
            end = plain.rfind(b" ", at, at + HASHED)
            end = plain.find(b" ", at + HASHED) if end <= at else end
            end = len(plain) if end < 0 else end
        h, start = _hash_block(plain[at:end])
        found.append((h, start + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))


def shingles(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each run of WORDS words."""
    return _rolled(word_hashes(b" ".join(words))[0])


def _rolled(w: np.ndarray) -> np.ndarray:
    n = max(0, len(w) - WORDS + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        h ^= w[k : k + n]
        h *= _GOLD
        h ^= h >> np.uint64(32)
    return h


def hashed(h: np.ndarray, function: int) -> np.ndarray:
    g = (h ^ np.uint64(0xD1B54A32D192ED03 * (function + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    g ^= g >> np.uint64(33)
    return g * np.uint64(0xC4CEB9FE1A85EC53)


def _least_of_runs(g: np.ndarray, span: int, gaps: np.ndarray | None) -> tuple[np.ndarray, np.uint64]:
    """The least hash of each run of ``span`` with its place in the low bits, and the mask of these bits."""
    n = len(g)
    bits = max(24, n.bit_length())
    place = np.uint64((1 << bits) - 1)
    marked = (g & ~place) | np.uint64(1 << bits)
    if gaps is not None:
        marked[gaps] = 0  # less than any hash, so that windows end at it
    marked |= np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = marked
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - span + 1], ahead[span - 1 : n]), place


def _smaller_before(value: np.ndarray) -> np.ndarray:
    """The nearest earlier place of a smaller value, -1 where there is none; values differ.

    What lies between a place and the one it points to is larger, so a place whose target is larger takes over
    the target's own; this doubles the steps, and few places need many.
    """
    v = np.concatenate((np.zeros(1, dtype=value.dtype), value))
    to = np.arange(-1, len(value))
    to[0] = 0
    more = np.flatnonzero(v[to] > v)
    while len(more):
        to[more] = to[to[more]]
        more = more[v[to[more]] > v[more]]
    return to[1:] - 1


def compact_windows(g: np.ndarray, span: int, gaps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), ends included, of the compact windows of ``span`` hashes or more; ties count leftmost as least.

    ``gaps`` marks places between texts, which no window holds. A hash spans enough just if it is
    the least of some run of ``span``, which block-wise running minima give for all runs at once; the
    tree over these alone has the ends, since the next smaller hash on either side of a node always
    spans more than the node itself.
    """
    n = len(g)
    if n < span:
        return (np.empty(0, dtype=np.int64),) * 3
    least, place = _least_of_runs(g, span, gaps)
    centre = least[np.flatnonzero(np.r_[True, least[1:] != least[:-1]])]
    at = (centre & place).astype(np.int64)
    before, after = _smaller_before(centre), len(at) - 1 - _smaller_before(centre[::-1])[::-1]
    edged = np.r_[at, n, -1]  # what follows the last and, by -1, what precedes the first
    left, right = edged[before] + 1, edged[after] - 1
    if gaps is not None:
        own = ~gaps[at]
        left, at, right = left[own], at[own], right[own]
        edge = np.r_[-1, np.flatnonzero(gaps), n]
        left, right = np.maximum(left, edge[np.searchsorted(edge, at) - 1] + 1), np.minimum(right, edge[np.searchsorted(edge, at)] - 1)
    return left, at, right


def _laid(sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of joined texts, which of them reach into the next text, the text of each, and where texts start."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = _rolled(words)
    gaps = np.zeros(len(h), dtype=bool)
    for k in range(1, WORDS):
        over = ends - k
        gaps[over[(over >= starts) & (over < len(h))]] = True
    return h, gaps, np.repeat(np.arange(len(sizes)), sizes)[: len(h)], starts


def _chunked(made, span: int):
    """Ids, numbers of words and word hashes of texts of ``least`` words or more, about CHUNK bytes at a time, as arguments of ``made``."""

    def whole(ids: list[int], texts: list[bytes]) -> pa.RecordBatch | None:
        words, first = word_hashes(b" ".join(texts))
        edge = np.cumsum([0] + [len(t) + 1 for t in texts])
        sizes = np.diff(np.searchsorted(first, edge))
        keep = sizes >= span + WORDS - 1
        return made(np.array(ids, dtype=np.int64)[keep], sizes[keep], words[np.repeat(keep, sizes)]) if keep.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in slices(batches, 1000):
            for doc, view in zip(batch.column(0).to_pylist(), text_views(batch, "text")):
                ids.append(doc)
                texts.append(bytes(view).translate(PLAIN))
                size += len(view)
                if size >= CHUNK:
                    if (out := whole(ids, texts)) is not None:
                        yield out
                    ids, texts, size = [], [], 0
        if ids and (out := whole(ids, texts)) is not None:
            yield out

    return run


class _Runs:
    """Hashes of all runs of ``span`` shingles, equal just for equal runs, in time that grows with the text alone."""

    def __init__(self, h: np.ndarray, span: int):
        self.span = span
        up, self.shift = _POWERS if len(h) <= BLOCK else (_powers(_ODD, len(h)), _powers(_BACK, len(h)))
        self.sums = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)], dtype=np.uint64)]

    def at(self, at: np.ndarray) -> np.ndarray:
        return self.between(at, at + self.span)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from a to b, end exclusive."""
        return (self.sums[b] - self.sums[a]) * self.shift[a]


def _periodic(h: np.ndarray, g: np.ndarray, left: np.ndarray, at: np.ndarray, right: np.ndarray, span: int, runs: _Runs | None = None) -> np.ndarray:
    """Which windows hold only runs of ``span`` that the window of the equal least hash before them holds too, one period earlier."""
    out = np.zeros(len(at), dtype=bool)
    i = np.flatnonzero((left > 0) & (g[left - 1] == g[at])) if len(at) else np.empty(0, dtype=np.int64)
    if len(i):
        runs = runs or _Runs(h, span)
        period = at[i] - left[i] + 1
        a, b = np.maximum(left[i], at[i] - span + 1), np.minimum(right[i], at[i] + span - 1) + 1
        ok = a >= period
        out[i[ok]] = runs.between(a[ok], b[ok]) == runs.between((a - period)[ok], (b - period)[ok])
    return out


class Hot:
    """Keys that very many documents share, and how many tasks take each of their surroundings that is common too."""

    def __init__(self, keys: np.ndarray, pairs: np.ndarray, tasks: np.ndarray, rows: np.ndarray):
        self.keys, self.pairs, self.tasks, self.rows = keys, pairs, tasks, rows

    def parts(self, key: np.ndarray) -> np.ndarray:
        """How many tasks compare the rows of a key: one for COMPARED of them."""
        out = np.ones(len(key), dtype=np.int64)
        if len(self.keys):
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hot = self.keys[slot] == key
            out[hot] = -(-self.rows[slot[hot]] // COMPARED)
        return out

    @staticmethod
    def pair(key: np.ndarray, near: np.ndarray) -> np.ndarray:
        x = (key.view(np.uint64) ^ (near.astype(np.uint64) << np.uint64(40))) * _GOLD
        return (x ^ x >> np.uint64(32)).view(np.int64)

    def salt(self, key: np.ndarray, near: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), dtype=np.int64)
        if len(self.keys):
            hot = np.isin(key, self.keys)
            out[hot] = 1 + near[hot]
            if len(self.pairs):
                pair = self.pair(key, near)
                slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                more = hot & (self.pairs[slot] == pair)
                spread = (doc[more].astype(np.uint64) * _GOLD >> np.uint64(33)).astype(np.int64) % self.tasks[slot[more]]
                out[more] += 65_536 * (1 + spread)
        return out


_NONE = Hot(*(np.empty(0, dtype=np.int64) for _ in range(4)))
_WINDOW = "key long, salt long, near int, sig long, doc long, f tinyint, l int, c int, r int"


def _octets(h: np.ndarray) -> np.ndarray:
    """For each place eight bits: one each of the shingles from there on; 40 places of zeros on either side."""
    bit = np.zeros(len(h) + 88, dtype=np.uint64)
    bit[40 : 40 + len(h)] = (h >> np.uint64(17)) & np.uint64(1)
    out = bit[:-8].copy()
    for k in range(1, 8):
        out |= bit[k : len(bit) - 8 + k] << np.uint64(k)
    return out


def _signatures(octets: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each place: one for each of the shingles from 32 before it on, 0 outside of the text."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(0, 64, 8):
        out |= octets[at + (40 - 32 + k)] << np.uint64(k)
    low, high = np.clip(begin - at + 32, 0, 63).astype(np.uint64), np.clip(at + 32 - end, 0, 63).astype(np.uint64)
    return out >> low << low << high >> high


def _windows(docs: DataFrame, span: int, hot: Hot = _NONE) -> DataFrame:
    """key, salt, near, sig, doc, f and the window, for each window.

    ``sig`` is a signature of the shingles around the place of the hash, one bit a place: two
    windows differ in about half as many bits as they have different shingles at the same distance from
    their common hash. ``near`` is a min-hash of the surroundings under a function of its own:
    surroundings of similarity s have the same at a rate of s. Keys that aren't hot have salt 0.
    """

    def made(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        h, gaps, owner, starts = _laid(sizes, words)
        last = starts + sizes - (WORDS - 1)  # the end of each text's shingles
        around, place = _least_of_runs(hashed(h, HASHES + 1), span, gaps) if len(h) >= span else (np.empty(0, dtype=np.uint64), np.uint64(0))
        around &= ~place
        octets, runs = _octets(h), _Runs(h, span)
        parts: list[list[np.ndarray]] = [[] for _ in range(9)]
        for f in range(HASHES):
            g = hashed(h, f)
            left, at, right = compact_windows(g, span, gaps)
            own = ~_periodic(h, g, left, at, right, span, runs)
            left, at, right = left[own], at[own], right[own]
            who = owner[at]
            first = np.clip(at - span // 2, starts[who], last[who] - span)
            key, doc, near = g[at].view(np.int64), ids[who], (around[first] * _GOLD >> np.uint64(48)).astype(np.int32)
            sig = _signatures(octets, at, starts[who], last[who]).view(np.int64)
            for part, x in zip(parts, (key, hot.salt(key, near, doc), near, sig, doc, np.full(len(at), f, dtype=np.int8), *((x - starts[who]).astype(np.int32) for x in (left, at, right)))):
                part.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=["key", "salt", "near", "sig", "doc", "f", "l", "c", "r"])

    return docs.mapInArrow(_chunked(made, span), _WINDOW)


def _hot_keys(docs: DataFrame, span: int) -> Hot:
    """Keys that a share of the documents has, from one in SCOUT of them.

    Their number is bounded by the windows of a mean document over HOT_SHARE, whatever the corpus.
    """
    scouted = docs.where(F.pmod(F.xxhash64("doc", F.lit(31)), F.lit(SCOUT)) == 0)
    least = max(HOT_LEAST, int(HOT_SHARE * scouted.count()))
    seen, _ = stash(_windows(scouted, span).groupBy("key", "near").agg(F.count("*").alias("n")), "passage-scouts")
    rows = seen.join(F.broadcast(seen.groupBy("key").agg(F.sum("n").alias("all")).where(f"all >= {least}").select("key")), "key").where(f"n * {SCOUT} > {HOT_ROWS}").collect()
    found = sorted((r["key"], r["all"]) for r in seen.groupBy("key").agg(F.sum("n").alias("all")).where(f"all >= {least}").collect())
    keys, sizes = np.array([k for k, _ in found], dtype=np.int64), np.array([SCOUT * n for _, n in found], dtype=np.int64)
    if not rows:
        return Hot(keys, *(np.empty(0, dtype=np.int64) for _ in range(2)), sizes)
    pairs = Hot.pair(np.array([r["key"] for r in rows], dtype=np.int64), np.array([r["near"] for r in rows]))
    order = np.argsort(pairs)
    return Hot(keys, pairs[order], np.array([-(-r["n"] * SCOUT // HOT_ROWS) for r in rows], dtype=np.int64)[order], sizes)


_TIE = "key long, salt long, near int, sig long, doc long, to long, f tinyint, l int, c int, r int, tl int, tc int, tr int"
_BESIDE = ("near", "sig", "doc", "f", "l", "c", "r")


def _meeting(hot: np.ndarray, span: int):
    """For rows sorted by key, salt, surroundings and document: pairs of an earlier and a later document under a key and salt.

    Each row is compared by signature with the first row, with the first of the same surroundings, with the one before and with
    the first rows of VARIANTS other surroundings; of the pairs in which its document is the later one, the TIED most alike stay.
    One pass that holds VARIANTS + 3 rows. The first rows of hot keys come out too, without a partner, so that
    those of different salts can meet. Keys under which some earlier row was not tied come out with a
    null document (crowded keys). Ties whose windows share less than ``span`` shingles are left out.
    """
    return lambda batches: _meet(gathered(batches, 12_000), hot, span)


def _meet(batches: Iterator[pa.RecordBatch], hot: np.ndarray, span: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _TIE.split(", ")]
    kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), *[pa.int32()] * 6)))
    held: dict[str, np.ndarray] | None = None  # rows of the last group that later ones may tie to
    seen = 0  # rows of that group

    def out(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(columns["key"])
        return pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[k]) if k in columns else pa.nulls(n, kinds[k]) for k in names], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: batch.column(i).to_numpy() for i, c in enumerate(batch.schema.names)}
        old = len(held["key"]) if held else 0
        rows = {c: np.concatenate([held[c], new[c]]) if held else new[c] for c in new}
        group = np.r_[True, (rows["key"][1:] != rows["key"][:-1]) | (rows["salt"][1:] != rows["salt"][:-1])]
        if len(hot) and (lead := group & (np.arange(len(group)) >= old) & np.isin(rows["key"], hot)).any():
            yield out({c: rows[c][lead] for c in ("key", "salt", *_BESIDE)})
        # Rows that are alone under their key have no partner; the last one may get some in the next batch.
        some = ~(group & np.r_[group[1:], False])
        if old and group[old]:
            some[:old] = False
        rows, group, old = {c: x[some] for c, x in rows.items()}, group[some], int(some[:old].sum())
        n = len(group)
        index = np.arange(n)
        head = group | np.r_[True, (rows["near"][1:] != rows["near"][:-1]) | (rows["sig"][1:] != rows["sig"][:-1])]
        first = np.maximum.accumulate(np.where(group, index, 0))
        own = np.maximum.accumulate(np.where(head, index, 0))
        heads = np.flatnonzero(head)
        nth = np.cumsum(head) - 1
        partners = [np.where(index > first, first, -1), np.where(index > own, own, -1), np.where(index > first, index - 1, -1)]
        for k in range(1, VARIANTS + 1):
            head_k = heads[np.maximum(nth - k, 0)]
            if not (some := (nth >= k) & (head_k >= first)).any():
                break
            partners.append(np.where(some, head_k, -1))
        before, after = rows["c"] - rows["l"], rows["r"] - rows["c"]
        # Each pair ties its later document to its earlier one; of a later row's pairs the most alike stay.
        mine = np.tile(index[old:], len(partners))
        other = np.concatenate([p[old:] for p in partners])
        ok = other >= 0
        ok[ok] = rows["doc"][other[ok]] != rows["doc"][mine[ok]]
        mine, other = mine[ok], other[ok]
        late = rows["doc"][mine] > rows["doc"][other]
        mine, other = np.where(late, mine, other), np.where(late, other, mine)
        both = np.minimum(before[mine], before[other]) + np.minimum(after[mine], after[other]) + 1
        ok = both >= span
        mine, other = mine[ok], other[ok]
        sig = rows["sig"].view(np.uint64)
        packed = np.unique(mine << 40 | np.bitwise_count(sig[mine] ^ sig[other]).astype(np.int64) << 32 | other)
        mine, other = packed >> 40, packed & ((1 << 32) - 1)
        first_of = np.maximum.accumulate(np.where(np.r_[True, np.diff(mine) != 0], np.arange(len(mine)), 0)) if len(mine) else mine
        best = np.arange(len(mine)) - first_of < TIED
        x, y = mine[best], other[best]
        if len(x):
            yield out({"key": rows["key"][x], "doc": rows["doc"][x], "to": rows["doc"][y], **{c: rows[c][x] for c in ("f", "l", "c", "r")}, "tl": rows["l"][y], "tc": rows["c"][y], "tr": rows["r"][y]})
        # The row that follows TIED + 1 has one that it isn't tied to; so have rows after two of one document.
        order = index - first
        if old and not group[old]:
            order = order + np.where(first == 0, seen - old, 0)
        crowd = (order > TIED) | ~group & (np.r_[-1, rows["doc"][:-1]] == rows["doc"])
        crowd &= index >= old
        if crowd.any():
            yield out({"key": np.unique(rows["key"][crowd])})
        # What the next batch may tie to: the first row, the last heads, the head and the row before.
        s = int(first[-1])
        keep = np.unique(np.r_[s, heads[heads >= s][-VARIANTS:], own[-1], n - 1])
        seen = int(order[-1]) + 1
        held = {c: x[keep] for c, x in rows.items()}


def _bitmap(keys: DataFrame, least_bits: int = 20, most_bits: int = 30) -> np.ndarray:
    """A bitmap of the low bits of keys, 16 bits a key within the bounds; ``_in_bitmap`` reads it."""
    n = keys.count()
    bits = min(most_bits, max(least_bits, (16 * n).bit_length()))
    place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))  # least hashes are low ones, so their high bits tell little
    rows = keys.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toLocalIterator()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


def _in_bitmap(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _exact_runs(docs: DataFrame, crowded: DataFrame, span: int) -> DataFrame:
    """(doc, to, a, b, d): repeats, word for word, of runs of ``span`` shingles whose minima lie under crowded keys.

    Under a key that is not crowded all rows are tied to each other. So a run is left to the ties
    if AGREE functions or more have such a key for its minimum, else it is tied here to the first
    document that holds the same run.
    """
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(crowded))

    def made(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        h, gaps, owner, starts = _laid(sizes, words)
        n = max(0, len(h) - span + 1)
        full = np.zeros(n, dtype=np.int8)
        if n:
            for f in range(HASHES):
                g = hashed(h, f)
                least, place = _least_of_runs(g, span, gaps)
                turn = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
                full += np.repeat(_in_bitmap(g[(least[turn] & place).astype(np.int64)], bitmap.value), np.diff(np.r_[turn, n]))
            over = np.r_[0, np.cumsum(gaps)]
            at = np.flatnonzero((full > HASHES - AGREE) & (over[span:] == over[:-span]))
            run = _Runs(h, span).at(at)
            # A run that overlaps an equal one belongs to words of one period; the first stands for these.
            order = np.lexsort((at, run))
            same = (run[order][1:] == run[order][:-1]) & (np.diff(at[order]) < span)
            at = np.delete(at, order[1:][same])
            run = np.delete(run, order[1:][same])
        else:
            at, run = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        who = owner[at]
        return pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), pa.array(ids[who]), pa.array((at - starts[who]).astype(np.int32))], names=["run", "doc", "at"])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in gathered(batches, 12_000):
            if not batch.num_rows:
                continue
            run, doc, at = (c.to_numpy() for c in batch.columns)
            head = np.r_[first is None or first[0] != run[0], run[1:] != run[:-1]]
            start = np.maximum.accumulate(np.where(head, np.arange(len(run)), -1))
            to, where = (np.where(start >= 0, x[start], first[i] if first else 0) for i, x in ((1, doc), (2, at)))
            tied = to != doc
            yield pa.RecordBatch.from_arrays([pa.array(doc[tied], pa.int64()), pa.array(to[tied], pa.int64()), pa.array(at[tied], pa.int32()), pa.array((at - where)[tied], pa.int32())], names=["doc", "to", "at", "d"])
            s = int(start[-1])
            first = (run[s], doc[s], at[s]) if s >= 0 else first

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            out = []
            for doc, to, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                at, d = (x.to_numpy().astype(np.int64) for x in rows.values.flatten())
                order = np.lexsort((at, d))
                at, d = at[order], d[order]
                turn = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (at[1:] != at[:-1] + 1)])
                out += [(doc, to, a, b + span - 1, k) for a, b, k in zip(at[turn].tolist(), at[np.r_[turn[1:], len(at)] - 1].tolist(), d[turn].tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "to", "a", "b", "d"])

    runs = docs.mapInArrow(_chunked(made, span), "run long, doc long, at int").repartition(wide(spark), "run").sortWithinPartitions("run", "doc", "at")
    ties = runs.mapInArrow(tie, "doc long, to long, at int, d int")
    return ties.groupBy("doc", "to").agg(F.collect_list(F.struct("at", "d")).alias("ties")).mapInArrow(joined, "doc long, to long, a long, b long, d long")


def _joined(lab: np.ndarray, row: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Labels of rows after those with a mark in common have been joined, each the least of its component."""
    while True:
        least = np.full(int(mark.max()) + 1 if len(mark) else 0, len(lab), dtype=lab.dtype)
        np.minimum.at(least, mark, lab[row])
        new = lab.copy()
        np.minimum.at(new, row, least[mark])
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


class _Group:
    """Rows of one key by document, and the shingles around their places as bytes, 0 outside of the text.

    With ``tag`` the rows of several keys, sorted by it, which are judged together and meet their own only.
    """

    def __init__(self, doc: np.ndarray, content: np.ndarray, span: int, similar: float, tag: np.ndarray | None = None):
        self.doc, self.span, self.width = doc, span, content.shape[1]
        self.tag = np.zeros(len(doc), dtype=np.int64) if tag is None else tag
        self.need = int(np.ceil(2 * similar / (1 + similar) * span - 1e-9))
        # Rows lie one after another with DRIFT zeros or more between them, so that a shift of all is one of each.
        self.content = np.zeros((len(doc), -(-(self.width + DRIFT) // 8) * 8), dtype=np.uint8)
        self.content[:, : self.width] = content
        self.query = np.where(self.content == 0, np.uint8(255), self.content)
        self.lab = self._equal()

    def _equal(self) -> np.ndarray:
        """Rows of one document are one, and so are those with a run of ``span`` shingles in common, which other ways tie."""
        x, n = self.content[:, : self.width], len(self.doc)
        sums = np.zeros((n, self.width + 1), dtype=np.uint64)
        np.cumsum(x * _POWERS[0][: self.width], axis=1, out=sums[:, 1:])
        k = np.arange(self.width - self.span + 1)
        run = (sums[:, self.span :] - sums[:, : len(k)]) * _POWERS[1][k]
        run ^= self.tag.astype(np.uint64)[:, None] * _GOLD
        row, at = np.nonzero((x[:, : len(k)] > 0) & (x[:, self.span - 1 :] > 0))
        _, mark, count = np.unique(run[row, at], return_inverse=True, return_counts=True)
        some = count[mark] > 1
        order = np.lexsort((self.doc, self.tag))
        docs = np.empty(n, dtype=np.int64)
        docs[order] = np.cumsum(np.r_[0, (np.diff(self.tag[order]) != 0) | (np.diff(self.doc[order]) != 0)])
        return _joined(np.arange(n), np.r_[np.arange(n), row[some]], np.r_[docs, mark[some] + n])

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a stretch of ``span`` shingles around the place of i is similar to what j has around its own, up to DRIFT off."""
        out = np.zeros(len(i), dtype=bool)
        starts, stride = self.width - self.span + 1, self.content.shape[1]
        for at in range(0, len(i), 1024):
            mine = self.query[i[at : at + 1024]].ravel()
            n = len(mine)
            padded = np.zeros(n + 2 * DRIFT, dtype=np.uint8)
            padded[DRIFT : DRIFT + n] = self.content[j[at : at + 1024]].ravel()
            hit = mine == padded[DRIFT : DRIFT + n]
            same, pair, pairs = np.empty(n, dtype=bool), np.empty(n - 1, dtype=bool), np.zeros(n - 1, dtype=bool)
            for shift in (*range(DRIFT), *range(DRIFT + 1, 2 * DRIFT + 1)):
                np.equal(mine, padded[shift : shift + n], out=same)
                pairs |= np.logical_and(same[1:], same[:-1], out=pair)  # one byte alone may be equal by chance
            hit[1:] |= pairs
            hit[:-1] |= pairs
            # Hits of all stretches of ``span``: stretches of 1, 2, 4 and so on, put together.
            kind = np.uint16 if self.span > 255 else np.uint8
            held, length, done, hits = hit.astype(kind), 1, 0, np.zeros(n - self.span + 1, dtype=kind)
            while length <= self.span:
                if self.span & length:
                    hits += held[done : done + len(hits)]
                    done += length
                held = held[:-length] + held[length:]
                length *= 2
            good = np.zeros(n, dtype=bool)
            good[: len(hits)] = (hits >= self.need) & hit[: len(hits)] & hit[self.span - 1 :]
            out[at : at + 1024] = good.reshape(-1, stride)[:, :starts].any(axis=1)
        return out

    def _hits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many places of each i are equal to those of each j: pair by pair for a few, else place by place over all pairs."""
        if len(i) * len(j) < 4096:
            return np.bitwise_count((self.query[i][:, None, :] == self.content[j][None, :, :]).view(np.uint64)).sum(axis=2, dtype=np.int16)
        if len(i) > len(j):
            return self._hits(j, i).T  # 0 and 255 outside of the texts never meet, whichever side asks
        mine, theirs = np.ascontiguousarray(self.query[i, : self.width].T), np.ascontiguousarray(self.content[j, : self.width].T)
        hits = np.zeros((len(i), len(j)), dtype=np.uint8 if self.width < 256 else np.uint16)
        same = np.empty(hits.shape, dtype=bool)
        for x, y in zip(mine, theirs):
            hits += np.equal(x[:, None], y[None, :], out=same).view(np.uint8)
        return hits

    def links(self, part: int, parts: int) -> list[tuple[int, int]]:
        """(row, earlier row): for each row of the part one link to each component of earlier rows that it joins."""
        n, found = len(self.doc), []
        if not self.lab.any():
            return found
        step = max(STEP, PAIRS // n)
        rows = np.arange(part, n, parts)
        block = max(1, BLOCK // n // step) * step
        floor = self.need // 2  # one edit leaves a half that is not shifted; the place lies in it for some function
        for at in range(0, len(rows), block):
            i = rows[at : at + block]
            end = int(i[-1])
            # Pairs of one component need no look: rows of the largest meet only those of others.
            large = np.bincount(self.lab[:end]).argmax() if end else 0
            inner, others = self.lab[i] == large, np.flatnonzero(self.lab[:end] != large)
            found_i, found_j, found_hits = [], [], []
            for some, cols in ((i[inner], others), (i[~inner], np.arange(end))):
                wide_ = max(1, 8 * PAIRS // max(1, len(cols)))
                for k in range(0, len(some) if len(cols) else 0, wide_):
                    who = some[k : k + wide_]
                    hits = self._hits(who, cols)
                    x, y = np.nonzero(hits >= floor)
                    own = (self.lab[cols[y]] != self.lab[who[x]]) & (cols[y] < who[x])
                    x, y = x[own], y[own]
                    found_i.append(who[x])
                    found_j.append(cols[y])
                    found_hits.append(hits[x, y])
            a, j, hits = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (found_i, found_j, found_hits))
            # What rows join is known to those of later steps.
            turn = np.searchsorted(i, a) // step
            order = np.argsort(turn, kind="stable")
            a, j, hits, turn = a[order], j[order], hits[order], turn[order]
            edge = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1], True]) if len(a) else []
            for x, y in zip(edge[:-1], edge[1:]):
                found += self._tied(a[x:y], j[x:y], hits[x:y], PAIRS // n < STEP)
        return found

    def links_of_tags(self) -> list[tuple[int, int]]:
        """``links`` of small keys, all at once."""
        n = len(self.doc)
        first = np.maximum.accumulate(np.where(np.r_[True, np.diff(self.tag) != 0], np.arange(n), 0))
        earlier = np.arange(n) - first
        a = np.repeat(np.arange(n), earlier)
        j = np.arange(len(a)) - np.repeat(np.cumsum(earlier) - earlier, earlier) + first[a]
        own = self.lab[a] != self.lab[j]
        a, j = a[own], j[own]
        hits = np.zeros(len(a), dtype=np.int16)
        for at in range(0, len(a), PAIRS):
            same = self.query[a[at : at + PAIRS]] == self.content[j[at : at + PAIRS]]
            hits[at : at + PAIRS] = np.bitwise_count(same.view(np.uint64)).sum(axis=1, dtype=np.int16)
        own = hits >= self.need // 2
        return self._tied(a[own], j[own], hits[own])

    def _tied(self, a: np.ndarray, j: np.ndarray, hits: np.ndarray, in_turn: bool = False) -> list[tuple[int, int]]:
        """For each row one link to each component that it joins of the rows that it is to be held against.

        With ``in_turn`` a row knows what the rows before it have joined.
        """
        found = []
        own = self.lab[j] != self.lab[a]
        a, j, hits = a[own], j[own], hits[own].astype(np.int64)
        order = np.lexsort((j, -hits, self.lab[j], a))
        a, j = a[order], j[order]
        for rest in (False, True):  # the most alike of each component first, all others where these do not do
            if not len(a):
                break
            lead = np.r_[True, (a[1:] != a[:-1]) | (self.lab[j[1:]] != self.lab[j[:-1]])]
            group = np.cumsum(lead) - 1
            tried = np.arange(len(a)) if rest else np.flatnonzero(lead)
            good = tried[self.similar(a[tried], j[tried])]
            if not len(good):
                a, j = a[~lead], j[~lead]
                continue
            good = good[np.r_[True, np.diff(group[good]) != 0]]
            done = np.zeros(group[-1] + 1, dtype=bool)
            done[group[good]] = True
            if in_turn:
                good = good[self._new(a[good], j[good])]
            found += zip(a[good].tolist(), j[good].tolist())
            self._join(a[good], j[good])
            left = ~done[group] & ~lead
            a, j = a[left], j[left]
            stay = self.lab[j] != self.lab[a]
            a, j = a[stay], j[stay]
            order = np.lexsort((self.lab[j], a))
            a, j = a[order], j[order]
        return found

    def _new(self, a: np.ndarray, j: np.ndarray) -> list[int]:
        """Which pairs join two components that those before them have not."""
        home: dict[int, int] = {}
        out = []
        for k, (x, y) in enumerate(zip(self.lab[a].tolist(), self.lab[j].tolist())):
            while x in home:
                x = home[x]
            while y in home:
                y = home[y]
            if x != y:
                home[max(x, y)] = min(x, y)
                out.append(k)
        return out

    def _join(self, a: np.ndarray, j: np.ndarray) -> None:
        """Make one component of those of each pair."""
        names, at = np.unique(np.r_[self.lab[a], self.lab[j]], return_inverse=True)
        new = np.arange(len(self.lab))
        new[names] = names[_joined(np.arange(len(names)), at, np.tile(np.arange(len(a)), 2))]
        self.lab = new[self.lab]


def _distinct(content: np.ndarray, tag: np.ndarray | None) -> np.ndarray:
    """The first of equal rows of each tag, in order."""
    mark = (content * _POWERS[0][: content.shape[1]]).sum(axis=1, dtype=np.uint64)
    tag = np.zeros(len(mark), dtype=np.int64) if tag is None else tag
    order = np.lexsort((mark, tag))
    same = (np.diff(tag[order]) == 0) & (mark[order][1:] == mark[order][:-1])
    same[same] = (content[order[1:][same]] == content[order[:-1][same]]).all(axis=1)
    return np.sort(order[np.r_[True, ~same]])


def _around(docs: DataFrame, bitmap, hot: Hot, span: int) -> DataFrame:
    """key, part, parts, doc, c, content: the shingles around each place of a crowded key, a byte each; rows of hot keys once for each part."""
    half = span - 1

    def made(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        h, gaps, owner, starts = _laid(sizes, words)
        last = starts + sizes - (WORDS - 1)
        code = np.zeros(len(h) + 2 * half, dtype=np.uint8)
        code[half : half + len(h)] = (h >> np.uint64(23)) % np.uint64(254) + np.uint64(1)
        around = np.lib.stride_tricks.sliding_window_view(code, 2 * half + 1)
        places, keys = [], []
        for f in range(HASHES if len(h) >= span else 0):
            g = hashed(h, f)
            least, place = _least_of_runs(g, span, gaps)
            at = (least[np.flatnonzero(np.r_[True, least[1:] != least[:-1]])] & place).astype(np.int64)
            at = at[~gaps[at] & _in_bitmap(g[at], bitmap.value)]
            places.append(at)
            keys.append(g[at].view(np.int64))
        at, key = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (places, keys))
        who = owner[at]
        content, col = around[at], np.arange(2 * half + 1)
        low, high = half + starts[who] - at, half + last[who] - at
        over = np.flatnonzero((low > 0) | (high <= 2 * half))  # only these reach into a text beside theirs
        content[over] = np.where((col >= low[over][:, None]) & (col < high[over][:, None]), content[over], np.uint8(0))
        # Of equal surroundings in one document one row stays.
        mark = np.zeros(len(at), dtype=np.uint64)
        order = np.lexsort((key, who))
        same = (np.diff(who[order]) == 0) & (np.diff(key[order]) == 0)
        some = order[np.r_[same, False] | np.r_[False, same]] if len(at) else order
        mark[some] = (content[some] * _POWERS[0][: 2 * half + 1]).sum(axis=1, dtype=np.uint64)
        order = np.lexsort((at, mark, key, who))
        new = np.r_[True, (np.diff(who[order]) != 0) | (np.diff(key[order]) != 0) | (mark[order][1:] != mark[order][:-1])] if len(at) else np.empty(0, dtype=bool)
        kept = order[new]
        parts = hot.parts(key[kept])
        kept, parts, part = np.repeat(kept, parts), np.repeat(parts, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        columns = (key[kept], part, parts, ids[who[kept]], at[kept] - starts[who[kept]])
        return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))), pa.array([x.tobytes() for x in content[kept]], pa.binary())], names=["key", "part", "parts", "doc", "c", "content"])

    return docs.mapInArrow(_chunked(made, span), "key long, part int, parts int, doc long, c int, content binary")


def _edited(docs: DataFrame, crowded: DataFrame, hot: Hot, span: int, similar: float) -> DataFrame:
    """(doc, to, a, b, d): the exact way for rows of crowded keys, which signatures tie to a few others only.

    All pairs of different surroundings under a key are compared but those already in one component; a
    document is tied to each component of earlier ones that it is similar to, so no link between
    components is lost and ties do not grow with the pairs.
    """
    spark, half = docs.sparkSession, span - 1
    bitmap = spark.sparkContext.broadcast(_bitmap(crowded))

    names = ["doc", "to", "a", "b", "d"]

    def linked(rows: pa.RecordBatch | pa.Table, tag: np.ndarray | None = None) -> pa.RecordBatch | None:
        """The links among rows of one key and part, or of several small keys, told apart by ``tag``."""
        doc, c = (rows.column(n).to_numpy() for n in ("doc", "c"))
        content = np.frombuffer(b"".join(rows.column("content").to_pylist()), dtype=np.uint8).reshape(len(doc), 2 * half + 1)
        first = _distinct(content, tag)
        doc, c, content, tag = doc[first], c[first], content[first], tag if tag is None else tag[first]
        if (doc == doc[0]).all():
            return None
        group = _Group(doc, content, span, similar, tag)
        links = group.links(rows.column("part")[0].as_py(), rows.column("parts")[0].as_py()) if tag is None else group.links_of_tags()
        if not links:
            return None
        i, j = np.array(links, dtype=np.int64).T
        low, high = np.argmax(content[i] > 0, axis=1), 2 * half - np.argmax(content[i][:, ::-1] > 0, axis=1)
        c = c.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[i], doc[j], c[i] - half + low, c[i] - half + high, c[i] - c[j])], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key and part so far

        def whole() -> pa.RecordBatch | None:
            return linked(pa.Table.from_batches(held).combine_chunks()) if sum(x.num_rows for x in held) > TIED else None

        for batch in gathered(batches, 12_000):
            if not batch.num_rows:
                continue
            key, part, parts = (batch.column(k).to_numpy() for k in range(3))
            turn = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            size = np.diff(np.r_[turn, len(key)])
            out = []
            if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (key[0], part[0]):
                out.append(whole())
                held = []
            # What goes on from the batch before, or may go on in the next, waits for its end.
            ends = np.ones(len(turn), dtype=bool)
            ends[-1] = False
            if held:
                held.append(batch.slice(0, size[0]))
                if len(turn) == 1:
                    continue
                out.append(whole())
                held = []
                ends[0] = False
            held = [batch.slice(turn[-1])]
            ends &= size > TIED
            small = ends & (size < SMALL) & (parts[turn] == 1)
            if small.any():
                tag = np.repeat(np.where(small, np.arange(len(turn)), -1), size)
                out.append(linked(batch.filter(pa.array(tag >= 0)), tag[tag >= 0]))
            out += [linked(batch.slice(turn[k], size[k])) for k in np.flatnonzero(ends & ~small)]
            yield from (x for x in out if x is not None)
        if held and (out_ := whole()) is not None:
            yield out_

    rows = _around(docs, bitmap, hot, span).repartition(wide(spark), "key", "part").sortWithinPartitions("key", "part", "doc", "c")
    return rows.mapInArrow(compare, "doc long, to long, a long, b long, d long")


def _tuples(lists: pa.ListArray) -> Iterator[list[tuple[int, ...]]]:
    """Each list of structs as a list of tuples."""
    ends = lists.offsets.to_numpy()
    values = lists.values.slice(ends[0], ends[-1] - ends[0])
    rows = list(zip(*(x.to_numpy().tolist() for x in values.flatten())))
    ends = (ends - ends[0]).tolist()
    return (rows[a:b] for a, b in zip(ends[:-1], ends[1:]))


def regions(ties: list[tuple[int, int, int, int, int, int, int]], span: int) -> list[tuple[int, int, int]]:
    """(start, end, diagonal) in shingles where AGREE hash functions or more cover a place.

    ``ties``: (f, l, c, r, tl, tc, tr). On its diagonal a tie covers the overlap of one window with the
    other, shifted; diagonals within 8 of each other are one.
    """
    covers: dict[int, list[tuple[int, int, int]]] = {}
    home = None
    for d, f, a, b in sorted((c - tc, f, max(left, tl + c - tc), min(r, tr + c - tc)) for f, left, c, r, tl, tc, tr in ties):
        if b - a + 1 >= span:
            home = d if home is None or d - home > 8 else home
            covers.setdefault(home, []).append((f, a, b))
    out = []
    for d, items in covers.items():
        events = sorted([(a, 0, f) for f, a, b in items] + [(b + 1, 1, f) for f, a, b in items])
        held, depth, start = [0] * HASHES, 0, None
        for at, closes, f in events:
            held[f] += -1 if closes else 1
            depth += (held[f] == 1 and not closes) - (held[f] == 0)
            if depth >= AGREE and start is None:
                start = at
            elif depth < AGREE and start is not None:
                if at - start >= span:
                    out.append((start, at - 1, d))
                start = None
    return out


def longest_run(hit: np.ndarray, share: float) -> tuple[int, int] | None:
    """The longest stretch that starts and ends on a hit and has at least ``share`` of hits."""
    at = hit.nonzero()[0]
    if not len(at):
        return None
    if len(at) == at[-1] - at[0] + 1:
        return int(at[0]), int(at[-1])
    # For hits i <= j: (j - i + 1) >= share * (at[j] - at[i] + 1), that is rise[j] + 1 - share >= rise[i].
    nth = np.arange(len(at))
    rise = nth - share * at
    low = np.minimum.accumulate(rise)  # the first i with rise[i] <= x is the first with low[i] <= x
    i = (-low).searchsorted(-(rise + 1 - share + 1e-9))
    i = np.minimum(i, nth)
    best = int((at - at[i]).argmax())
    return int(at[i[best]]), int(at[best])


def extended(a: np.ndarray, b: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The regions, each side as far as both texts stay equal on the diagonal beyond it."""
    out = set()
    for start, end, d in found:
        low, high = max(0, d), min(len(a), len(b) + d)
        start, end = max(start, low), min(end, high - 1)
        if end < start:
            continue
        if a[start] == b[start - d]:
            before = np.flatnonzero(a[low:start] != b[low - d : start - d])
            start = low + int(before[-1]) + 1 if len(before) else low
        if a[end] == b[end - d]:
            after = np.flatnonzero(a[end + 1 : high] != b[end + 1 - d : high - d])
            end = end + int(after[0]) if len(after) else high - 1
        out.add((start, end, d))
    return sorted(out)


def verify(a: np.ndarray, b: np.ndarray, found: list[tuple[int, int, int]], span: int, similar: float) -> list[tuple[int, int, int, int, float]]:
    """(start, end, other start, other end, similarity) in shingles of passages that really agree."""
    out: list[tuple[int, int, int, int, float]] = []
    todo = [(max(0, start), min(len(a) - 1, end), d) for start, end, d in sorted(found, reverse=True)]
    shared: _Shared | None = None
    while todo:
        start, end, d = todo.pop()
        if end - start + 1 < span:
            continue
        if start >= d and end - d < len(b) and np.array_equal(a[start : end + 1], b[start - d : end - d + 1]):
            out.append((start, end, start - d, end - d, 1.0))
            continue
        # The diagonal may drift by the edits inside the passage; look as far around as these allow.
        drift = 8 + int((end - start + 1) * (1 - similar))
        low, high = max(0, start - d - drift), min(len(b), end - d + drift + 1)
        shared = shared or _Shared(a, b, [(start, end, d), *todo], similar)
        hit = shared.within(start, end + 1, low, high)
        # Two passages of similarity s share 2s / (1 + s) of their shingles; else an unbroken run may still do.
        for share in (2 * similar / (1 + similar), 0.95, 1.0):
            run = longest_run(hit, share) if _enough(hit, share, span) else None
            if run is None or run[1] - run[0] + 1 < span:
                run = None
                break
            x, y = start + run[0], start + run[1]
            if place := _counterpart(shared, x, y + 1, low, high, share, span, similar):
                out.append((x, y, *place))
                break
        else:
            run = None
        if run:  # what lies on either side may hold passages of its own
            todo += [(y + 1, end, d), (start, x - 1, d)]
    taken: list[tuple[int, int, int, int, float]] = []
    for m in sorted(out, key=lambda m: (m[0] - m[1], m[0])):
        if all(m[1] < o[0] or o[1] < m[0] for o in taken):
            taken.append(m)
    return sorted(taken)


class _Shared:
    """The shingles of two texts as small numbers, of the stretches alone that ``found`` can lead to."""

    def __init__(self, a: np.ndarray, b: np.ndarray, found: list[tuple[int, int, int]], similar: float):
        drift = [8 + int((end - start + 1) * (1 - similar)) for start, end, _ in found]
        self.from_a, to_a = min(x[0] for x in found), max(x[1] for x in found) + 1
        self.from_b = max(0, min(start - d - far for (start, _, d), far in zip(found, drift)))
        to_b = max(0, max(end - d + far + 1 for (_, end, d), far in zip(found, drift)))
        a, b = a[self.from_a : to_a], b[self.from_b : to_b]
        kinds, ids = np.unique(np.concatenate((a, b)), return_inverse=True)
        self.a, self.b = ids[: len(a)], ids[len(a) :]
        self.marks = np.zeros((2, len(kinds)), dtype=bool)

    def mine(self, start: int, end: int) -> np.ndarray:
        return self.a[start - self.from_a : end - self.from_a]

    def theirs(self, low: int, high: int) -> np.ndarray:
        return self.b[max(0, low - self.from_b) : max(0, high - self.from_b)]

    def _in(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        mark = self.marks[0]
        mark[y] = True
        out = mark[x]
        mark[y] = False
        return out

    def within(self, start: int, end: int, low: int, high: int) -> np.ndarray:
        """Which shingles of the first text's stretch the second's has."""
        return self._in(self.mine(start, end), self.theirs(low, high))

    def back(self, start: int, end: int, low: int, high: int) -> np.ndarray:
        """Which shingles of the second text's stretch the first's has."""
        return self._in(self.theirs(low, high), self.mine(start, end))

    def alike(self, start: int, end: int, low: int, high: int) -> float:
        """Similarity of the stretches' sets of shingles."""
        self.marks[:] = False
        self.marks[0, self.mine(start, end)] = True
        self.marks[1, self.theirs(low, high)] = True
        both, all_ = int(np.count_nonzero(self.marks[0] & self.marks[1])), int(np.count_nonzero(self.marks))
        self.marks[:] = False
        return both / (all_ - both)


def _enough(hit: np.ndarray, share: float, span: int) -> bool:
    """Whether the hits are enough for a stretch of ``span``."""
    return np.count_nonzero(hit) >= share * span - 1e-6


def _counterpart(shared: _Shared, start: int, end: int, low: int, high: int, share: float, span: int, similar: float) -> tuple[int, int, float] | None:
    """(start, end, similarity) of what the passage from start to end repeats between low and high of the other text."""
    hit = shared.back(start, end, low, high)
    back = longest_run(hit, share) if _enough(hit, share, span) else None
    if back is None or back[1] - back[0] + 1 < span:
        return None
    u, v = low + back[0], low + back[1]
    alike = shared.alike(start, end, u, v + 1)
    return (u, v, alike) if alike >= similar else None


def repeated_passages(docs: DataFrame, least: int = 50, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage: doc_id, start, end, of_doc_id, of_start, of_end, words, similarity.

    A passage has at least ``least`` words and five-word shingles that agree with those of a
    passage of an earlier document (smaller doc_id) to ``similar``; start and end are code points of
    the whole text, end exclusive. Case and ASCII punctuation do not count. Equal texts are
    compared once: each copy reports the whole text against the first. Documents that share a
    min-hash are compared by signatures of what is around it, each with the first of them and with up to
    VARIANTS different ones, and tied to the TIED most alike: a passage found in many documents gives a few
    rows for each, never all pairs; exact repeats of ``least`` words are tied to the first that has
    them in any case. Cases: null texts and texts under ``least`` words have no passages; rows with a null
    id are left out; of repeated ids with different texts the first by text is compared; repeats
    within one document are not reported; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    span = max(2, least - WORDS + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    mark = F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(5), F.reverse("text")).alias("h2")
    marks, _ = stash(rows.select("doc", *mark), "passage-texts")
    lead = marks.groupBy("h1", "h2").agg(F.min("doc").alias("lead"), F.count("*").alias("n"))
    copies, _ = stash(marks.join(lead.where("n > 1"), ["h1", "h2"]).where("doc <> lead").select("doc", "lead").distinct(), "passage-copies")
    # Copies of a text are few of all rows: only those that a bitmap of ids suspects are moved to be told apart.
    suspected = suspects(rows, ["doc"], copies.select("doc"))
    alone = suspected.where("not _suspect").select("doc", "text").unionByName(suspected.where("_suspect").select("doc", "text").join(copies.select("doc").hint("merge"), "doc", "left_anti"))
    hot = _hot_keys(alone, span)
    order = ["key", "salt", "near", "sig", "doc", "c"]
    found = _windows(alone, span, hot).repartition(wide(spark), "key", "salt").sortWithinPartitions(*order)
    ties, _ = stash(found.mapInArrow(_meeting(hot.keys, span), _TIE), "passage-ties")
    crowded = ties.where("doc is null").select("key").unionByName(spark.createDataFrame([(k,) for k in hot.keys.tolist()], "key long")).distinct()
    ties = ties.where("doc is not null")
    if len(hot.keys):
        heads = ties.where("to is null").select("key", F.lit(0).cast("long").alias("salt"), *_BESIDE)
        met_again = heads.repartition(wide(spark), "key").sortWithinPartitions(*order).mapInArrow(_meeting(hot.keys[:0], span), _TIE)
        ties = ties.where("to is not null").unionByName(met_again.where("doc is not null"))
    # A pair's ties are bounded by the windows of one document.
    met = ties.groupBy("doc", "to").agg(F.collect_set("f").alias("fs"), F.collect_list(F.struct("f", "l", "c", "r", "tl", "tc", "tr")).alias("ties"))
    pairs = met.where(F.size("fs") >= AGREE)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            out = []
            for doc, to, rows_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _tuples(batch.column(2))):
                for a, b, d in regions(rows_, span):
                    out.append((doc, to, a, b, d))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "to", "a", "b", "d"])

    placed = pairs.select("doc", "to", "ties").mapInArrow(place, "doc long, to long, a long, b long, d long").unionByName(_exact_runs(alone, crowded, span)).unionByName(_edited(alone, crowded, hot, span, similar))
    candidates, _ = stash(placed.groupBy("doc", "to").agg(F.collect_list(F.struct("a", "b", "d")).alias("at")), "passage-candidates")
    # Suspects are enough: the joins below leave out the few that a bitmap wrongly lets through.
    ids = candidates.select("doc").unionByName(candidates.select(F.col("to").alias("doc")))
    sides = suspects(rows, ["doc"], ids.distinct()).where("_suspect").select("doc", "text")
    if marks.groupBy("doc").count().where("count > 1").limit(1).count():
        sides = sides.groupBy("doc").agg(F.min("text").alias("text"))
    texts, _ = stash(sides, "passage-sides")
    # Merge joins at every size: a small table of pairs must not decide whether texts move.
    joined = candidates.join(texts.select(F.col("doc").alias("to"), F.col("text").alias("other")).hint("merge"), "to").join(texts.hint("merge"), "doc")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}  # shingles of a text; words' first and end bytes once a passage is found
        size = 0

        def of(doc: int, text: memoryview) -> np.ndarray:
            nonlocal size
            if doc not in kept:
                if size > CACHED_SHINGLES:
                    kept.clear()
                    size = 0
                kept[doc] = [_rolled(word_hashes(bytes(text).translate(PLAIN))[0]), None]
                size += len(kept[doc][0])
            return kept[doc][0]

        def spans(doc: int, text: memoryview, passages: list[tuple[int, int]]) -> list[tuple[int, int]]:
            """Code points of the passages, which are given in shingles."""
            nonlocal size
            text = bytes(text)
            held = kept.get(doc, [None, None])
            if held[1] is None:
                held[1] = [x.astype(np.int32 if len(text) < 1 << 31 else np.int64) for x in word_spans(text)]
                size += len(held[1][0]) if doc in kept else 0
            s, e = held[1]
            at = [(int(s[x]), int(e[y + WORDS - 1])) for x, y in passages]
            return at if text.isascii() else [(char_offset(text, a), char_offset(text, b)) for a, b in at]

        for batch in slices(batches, 100):
            out = []
            for doc, to, at, text, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _tuples(batch.column(2)), text_views(batch, "text"), text_views(batch, "other")):
                mine, theirs = of(doc, text), of(to, other)
                hits = verify(mine, theirs, extended(mine, theirs, at), span, similar)
                if hits:
                    for (x, y, _, _, share), here, there in zip(hits, spans(doc, text, [h[:2] for h in hits]), spans(to, other, [h[2:4] for h in hits])):
                        out.append((doc, *here, to, *there, y - x + WORDS, share))
            if out:
                kinds = (*[pa.int64()] * 7, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    names = ["doc_id", "start", "end", "of_doc_id", "of_start", "of_end", "words", "similarity"]
    kinds = "doc_id long, start long, end long, of_doc_id long, of_start long, of_end long, words long, similarity double"
    near = joined.select("doc", "to", "at", "text", "other").mapInArrow(check, kinds)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            out = []
            for doc, lead_, view in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_views(batch, "text")):
                s, s_end = word_spans(bytes(view))
                if len(s) >= least:
                    a, b = char_offset(bytes(view), s[0]), char_offset(bytes(view), s_end[-1])
                    out.append((doc, a, b, lead_, a, b, len(s), 1.0))
            if out:
                kinds_ = (*[pa.int64()] * 7, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds_)], names=names)

    equal = suspected.where("_suspect").join(copies.hint("merge"), "doc").select("doc", "lead", "text").mapInArrow(whole, kinds)
    return near.unionByName(equal)

