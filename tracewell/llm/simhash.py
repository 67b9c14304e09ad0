"""Near-duplicate documents by SimHash fingerprints joined through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vptree
from ._work import gathered, ship, slices, stash, suspects, text_views, wide
from .components import components, of_component

#: Fingerprints that the top trees are fitted on, at least.
SAMPLE = 4096
#: Fingerprints that a shard aims at, and of a block where no split helps.
SHARD = 65_536
#: Bins of the one-permutation sketch that estimates shingle similarity.
BINS = 256
#: Fingerprints of shingle samples by which near copies meet, and shingles of a sample.
SAMPLES = 10
DRAWN = 4
_DRAWN_BINS = np.arange(SAMPLES * DRAWN) * (BINS // (SAMPLES * DRAWN))

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_LANES = np.arange(8, dtype=np.uint16) * 256


def shingle_hashes(text: bytes | memoryview, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42), big-endian bytes in rows of 8, of each shingle of the A-Z-lowered text.

    Words are runs of bytes other than space and \\x09-\\x0D; repeats stay; fewer words than a
    shingle takes make one shingle of all, no words none.
    """
    found = bytes(text).lower().split()
    if not found:
        return np.empty((0, 8), dtype=np.uint8)
    line = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    hashes = [digest(line[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :])] or [digest(line, 42)]
    return np.frombuffer(b"".join(hashes), dtype=np.uint8).reshape(-1, 8)


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64 bits; a bit is set where more than half of the hashes set it."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes)).tobytes(), "big")


def sketch(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """A one-permutation sketch: 16 bits of the least hash in each of BINS bins (0 marks an empty bin), and SAMPLES fingerprints.

    Fingerprint ``i`` is the SimHash of the hashes in DRAWN bins of its own; an empty bin takes the next
    one's. Two texts have the same hash in a bin at the rate of their shingle similarity ``s``, so a
    fingerprint is the same at a rate of s^DRAWN or more, and one of them at 1 - (1 - s^DRAWN)^SAMPLES:
    0.995 for 0.8.
    """
    out = np.zeros(BINS, dtype=np.uint16)
    if not len(hashes):
        return out.tobytes(), bytes(8 * SAMPLES)
    h = np.unique(hashes.view(">u8").ravel().astype(np.uint64))
    bins = (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = 1 + ((h[first] >> np.uint64(20)) % np.uint64(65_535)).astype(np.uint16)
    drawn = h[first[np.searchsorted(bins[first], _DRAWN_BINS) % len(first)]] * np.uint64(0xFF51AFD7ED558CCD)
    drawn ^= drawn >> np.uint64(32)  # least hashes of a bin begin alike
    drawn *= np.uint64(0x9E3779B97F4A7C15)
    ones = np.unpackbits(drawn.astype(">u8").view(np.uint8)).reshape(SAMPLES, DRAWN, 64).sum(1)
    return out.tobytes(), np.packbits(ones * 2 > DRAWN).tobytes()


def fingerprints(docs: DataFrame, words: int = 3, sketched: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long); if asked for, also ``mark`` (a hash of the text), ``size`` (shingles), ``sketch`` and ``samples``.

    One row per row: a null text counts as an empty one, whose fingerprint is zero; ids may be null or
    repeat; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            fps, sizes, sketches, samples = [], [], [], []
            for text in text_views(batch, "text"):
                h = shingle_hashes(text, words)
                fps.append(fingerprint(h))
                if sketched:
                    sizes.append(len(h))
                    marks, drawn = sketch(h)
                    sketches.append(marks)
                    samples.append(drawn)
            columns = [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column(1), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(samples, pa.binary())] if sketched else []), names=names)

    names = ["doc_id", "fp"] + (["mark", "size", "sketch", "samples"] if sketched else [])
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *([F.xxhash64(text).alias("mark")] if sketched else []), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long" + (", mark long, size long, sketch binary, samples binary" if sketched else ""))


def _trees(items: DataFrame, total: int, shard: int, rule: vptree.Rule, sized: bool) -> vptree.Tree:
    """Top trees from a sample by hash of PER_SHARD fingerprints for each shard, SAMPLE at least: 8 bytes each, 40 MB for 10^10 items."""
    share = min(1.0, max(SAMPLE, vptree.PER_SHARD * total / shard) / max(1, total))
    picked = items.select("fp", *(["size"] if sized else [])).where(F.pmod(F.xxhash64("fp", F.lit(71)), F.lit(1 << 40)) < int(share * (1 << 40))).toPandas()
    picked = picked.sort_values(list(picked.columns))
    return vptree.fit(picked["fp"].to_numpy(np.int64).view(np.uint64), picked["size"].to_numpy(np.int64) if sized else None, total, shard, rule)


def fingerprint_links(items: DataFrame, rule: vptree.Rule, shard: int = SHARD) -> DataFrame:
    """(u, v) links that connect just the ``key``s whose fingerprints the rule connects.

    ``items``: key long (distinct), fp long, size long and sketch binary where the rule needs them,
    and optionally ``part`` int: only items of one part are compared. The sample of the top
    trees grows with the number of shards; every item is indexed. A shard that no split could make
    small is compared in pairs of blocks of ``shard`` items, so no task holds more than two blocks.
    Cases: no items give no links; equal fingerprints under different keys are linked.
    """
    extra = rule.ratio is not None or rule.similar is not None
    columns = ["key", "fp"] + (["size", "sketch"] if extra else [])
    parted = "part" in items.columns
    items = items.select(*columns, F.col("part").cast("long") if parted else F.lit(0).cast("long").alias("part"))
    sizes = items.groupBy("part").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    spark, total = items.sparkSession, sizes["most"] or 0
    sample = items.where(F.col("part") == items.select(F.min("part")).first()[0]) if parted and total else items
    shared = spark.sparkContext.broadcast(_trees(sample, total, shard, rule, extra))
    tall = 1 << 18  # blocks of a shard, at most

    def dealt(blocks: dict[int, int]):
        cut_leaves = np.array(sorted(blocks), dtype=np.int64)
        cuts = np.array([blocks[k] for k in sorted(blocks)], dtype=np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            for batch in gathered(batches, 20_000):
                fp, part = batch.column(1).to_numpy().view(np.uint64), batch.column(len(columns)).to_numpy()
                row, leaf = tree.place(fp, batch.column(2).to_numpy() if extra else None)
                shard_no = part[row] * tree.leaves + leaf
                cut = np.ones(len(row), dtype=np.int64)
                if len(cut_leaves):
                    slot = np.minimum(np.searchsorted(cut_leaves, shard_no), len(cut_leaves) - 1)
                    cut = np.where(cut_leaves[slot] == shard_no, cuts[slot], 1)
                own = (fp[row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cut
                # Block pairs: each item goes to the pair of its block with every other.
                other = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
                row, shard_no, own = (np.repeat(x, cut) for x in (row, shard_no, own))
                pair = np.minimum(own, other) * tall + np.maximum(own, other)
                taken = batch.select(list(range(len(columns)))).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(shard_no), pa.array(pair), *taken.columns], names=["shard", "pair", *columns])

        return run

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        tree = shared.value
        key, fp = part["key"].to_numpy(np.int64), part["fp"].to_numpy(np.int64).view(np.uint64)
        size = part["size"].to_numpy(np.int64) if extra else None
        marks = np.frombuffer(b"".join(part["sketch"]), dtype=np.uint16).reshape(len(part), -1) if extra else None
        pairs = vptree.links(fp, size, marks, rule, mask=tree.leaf_mask[int(part["shard"].iat[0]) % tree.leaves])
        return pd.DataFrame({"u": key[pairs[:, 0]], "v": key[pairs[:, 1]]})

    kinds = "shard long, pair long, key long, fp long" + (", size long, sketch binary" if extra else "")
    counts = items.mapInArrow(dealt({}), kinds).groupBy("shard").count().where(f"count > {2 * shard}").collect()  # shards that no split makes small
    blocks = {r["shard"]: -(-r["count"] // shard) for r in counts}
    return items.mapInArrow(dealt(blocks), kinds).groupBy("shard", "pair").applyInPandas(joined, "u long, v long").distinct()


def simhash_components(docs: DataFrame, words: int = 3, reach: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, kept.

    Documents hang together where a chain of fingerprints, each at most ``reach`` bits from the
    next, leads from one to the other; ``component_id`` is the smallest doc_id that is reached.
    Cases: a null or empty text has fingerprint zero and links like any other; equal fingerprints
    are joined once, whatever their number; a null id takes part in linking, gets its component's
    smallest id, and that is null if no member has one; repeated rows stay; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    marked, _ = stash(fingerprints(docs, words), "simhash")
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = fingerprint_links(groups.select(F.col("fp").alias("key"), "fp"), vptree.Rule(reach))
    roots, path = components(edges)
    class_of = groups.join(roots, groups.fp == roots.vertex, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = of_component(class_of, "fp", F.min("least"), "component_id").select("fp", "component_id")
    result = marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return result


def near_duplicates(docs: DataFrame, words: int = 5, reach: int = 20, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, mark, first) of near copies: five-word shingles, similarity at least ``similar``.

    Texts of similarity 0.8 differ in some ten bits of their SimHash, which no tree can prune. So each
    text has SAMPLES more fingerprints, SimHashes of small min-wise samples of its shingles, of which
    near copies share some to 3 bits at most; the trees join these. Texts that meet
    link where their whole fingerprints differ in ``reach`` bits at most, their lengths allow the
    similarity and their sketches show it (standard error 0.025). ``mark`` is a hash of the text,
    ``component_id`` the smallest doc_id of the group (null if none has one), ``first`` whether the row
    has that id and, of different texts under it, the one with the least mark. Cases: texts that are
    equal or have the same shingles are joined once, texts without words are one group; an
    empty table gives no rows; other columns are ignored; null and repeated ids as they come.
    """
    spark = docs.sparkSession
    marked, _ = stash(fingerprints(docs, words, True, id_col, text_col).withColumn("key", F.xxhash64("fp", "size", "sketch")), "nearcopies")
    groups, _ = stash(marked.groupBy("key").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("samples").alias("samples")), "nearcopy-groups")
    sample = F.conv(F.hex(F.expr("substring(samples, part * 8 + 1, 8)")), 16, -10).cast("long")
    prints = groups.select("key", "samples", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))).alias("part")).select("key", "part", sample.alias("fp"))
    prints = prints.withColumn("node", F.xxhash64("part", "fp"))
    nodes, _ = stash(prints.groupBy("node").agg(F.first("part").alias("part"), F.first("fp").alias("fp"), F.count("*").alias("n")), "nearcopy-prints")
    links, _ = stash(fingerprint_links(nodes.select(F.col("node").alias("key"), "part", "fp"), vptree.Rule(3)), "nearcopy-links")
    balls, _ = components(links)
    # Only fingerprints that several texts have, or that lie near another, make texts meet.
    shared = nodes.where("n > 1").select(F.col("node").alias("vertex"), F.col("node").alias("root")).join(balls.select("vertex"), "vertex", "left_anti").unionByName(balls).unionByName(balls.select(F.col("root").alias("vertex"), "root").distinct()).distinct()
    met, _ = stash(prints.join(shared, F.col("node") == F.col("vertex")).select("key", F.col("root").alias("ball")).distinct(), "nearcopy-met")
    edges = _verified(groups.drop("samples"), met, vptree.Rule(reach, ratio=similar, similar=similar))
    roots, _ = components(edges)
    class_of = groups.select("key").join(roots, F.col("key") == F.col("vertex"), "left").select("key", F.coalesce("root", "key").alias("root"))
    named = marked.groupBy("key").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("least")).join(class_of, "key")
    named = of_component(named.select("key", "root", "least"), "key", F.min("least"), "winner").select("key", "winner")
    first = F.struct("doc_id", "mark").eqNullSafe(F.col("winner"))
    return marked.select("key", "doc_id", "mark").join(named, "key").select("doc_id", F.col("winner.doc_id").alias("component_id"), "mark", first.alias("first"))


def _verified(groups: DataFrame, met: DataFrame, rule: vptree.Rule, block: int = 16_384) -> DataFrame:
    """(u, v) that connect the keys of a ball that the rule links; a ball of more than two blocks is compared in pairs of blocks."""
    large = met.groupBy("ball").count().where(f"count > {2 * block}").select("ball", F.ceil(F.col("count") / block).cast("int").alias("cut"))
    cut = F.coalesce("cut", F.lit(1))
    dealt = met.join(F.broadcast(large), "ball", "left").withColumn("own", F.pmod(F.xxhash64("key", F.lit(5)), cut).cast("int"))  # a ball in that table has tens of thousands of rows
    dealt = dealt.select("key", "ball", "own", F.explode(F.sequence(F.lit(0), cut - 1)).alias("other")).select("key", "ball", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def linked(table: pa.Table) -> pa.RecordBatch:
        ball, key, fp, size = (table.column(c).to_numpy() for c in ("ball", "key", "fp", "size"))
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint16).reshape(len(key), -1)
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        start, out = np.flatnonzero(np.r_[True, (np.diff(ball) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)]), []
        vptree.within_cells(np.arange(len(key)), start, fp.view(np.uint64), size, marks, rule, np.random.default_rng(1), out)
        pairs = np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)
        pairs = vptree._forest(pairs[:, 0], pairs[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(key[pairs[:, 0]]), pa.array(key[pairs[:, 1]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            turn = np.flatnonzero(np.diff(batch.column(0).to_numpy()) != 0) + 1
            if rows + batch.num_rows > block and (len(turn) or held and held[-1].column(0)[-1] != batch.column(0)[0]):
                # Whole balls go; the last one may go on in the next batch.
                cut = int(turn[-1]) if len(turn) else 0
                yield linked(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield linked(pa.Table.from_batches(held))

    placed = dealt.join(groups, "key").select("ball", "a", "b", "key", "fp", "size", "sketch")
    return placed.repartition(wide(groups.sparkSession), "ball", "a", "b").sortWithinPartitions("ball", "a", "b").mapInArrow(run, "u long, v long").distinct()


def one_of_each(docs: DataFrame, words: int = 5, reach: int = 20, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of ``near_duplicates`` the smallest doc_id stays.

    Rows are judged by id and text: where an id repeats with another text, that text is judged for
    itself. Cases: of rows that repeat an id and its text one stays; rows without an id cannot be
    named and stay; an empty table gives no rows; all columns stay as they were.
    """
    classes, _ = stash(near_duplicates(docs, words, reach, similar, id_col, text_col), "classes")
    named = classes.where("doc_id is not null").groupBy("doc_id", "mark").agg(F.first("first").alias("first"), F.count("*").alias("n"))
    # Rows to move: those that go, and those that repeat. A bitmap keeps most others where they are.
    touched, _ = stash(named.where("not first or n > 1").select("doc_id", "mark", "first"), "losers")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    marked = suspects(rows, ["doc_id", "mark"], touched.select("doc_id", "mark"))
    some = marked.where("_suspect").join(touched, ["doc_id", "mark"], "left")
    once = some.where("first").dropDuplicates(["doc_id", "mark"])
    return marked.where("not _suspect").select("row.*").unionByName(some.where("first is null").select("row.*")).unionByName(once.select("row.*"))
