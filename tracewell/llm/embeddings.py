"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors (pivots) come from a sample; their number grows with the square root of the table.
A vector is described by its nearest pivots in order, as many as let pairs at the threshold share two
of them at the rate RECALL, which is measured on the sample when the index is made. Inverted lists
are kept under each pair of pivots, so two vectors meet exactly if they share two pivots or more.
The lists under one smaller pivot lie together in a block, so a vector moves once a block, not
once a list. First it moves as a code of a byte a dimension with the length of its rounding error,
which bounds every cosine from above; only vectors that such a bound may link move whole, and their
cosines are taken in double precision. A pair that shares several pivots counts in the list
of its two smallest only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import gathered, ship, slices, stash, suspects, wide
from .components import components, of_component
from .vptree import _forest

#: Bytes of pivots (single precision) of one length of vectors, at most; the sample takes four times as much.
PIVOT_BYTES = 24 << 20
#: Distinct vectors of one length up to which one list holds them all.
FEW = 1024
#: Pivots that describe a vector, at least and at most, and the share of pairs at the threshold that must share two.
PREFIX, MOST_PREFIX, RECALL = 5, 12, 0.97
#: Sampled vectors that the share is measured on.
TRIALS = 1500
#: Bytes of a block of lists, and rows of one block of a long list: a task multiplies two of these.
BLOCK_BYTES = 48 << 20
BLOCK = 16_384
#: One vector in so many is looked at for the lengths of lists.
SCOUT = 16
#: Rows of a list that are multiplied with all of it at a time.
STRIP = 512


def wanted_pivots(total: int, dim: int) -> int:
    """As many as keep lists at some tens of rows, within PIVOT_BYTES."""
    return int(min(PIVOT_BYTES // (4 * dim), max(64, math.isqrt(total // 3 + 1))))


def choose_pivots(vectors: np.ndarray, want: int, least: float) -> np.ndarray:
    """Unit vectors, so far apart that a dense group gives one pivot at most.

    The distance follows the sample: half way from its median cosine, which is high where vectors lie in a
    cone, to the threshold.
    """
    if len(vectors) < 2:
        return vectors
    some = vectors[:400]
    apart = (float(np.median((some @ some.T)[np.triu_indices(len(some), 1)])) + least) / 2
    chosen = np.empty((0, vectors.shape[1]))
    for at in range(0, len(vectors), 1024):
        part = vectors[at : at + 1024]
        part = part[(part @ chosen.T).max(1) < apart] if len(chosen) else part
        cos, kept = part @ part.T, []
        for i in range(len(part)):
            if not kept or cos[i, kept].max() < apart:
                kept.append(i)
        chosen = np.vstack([chosen, part[kept]])
        if len(chosen) >= want:
            break
    return chosen[:want]


def nearest(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector by cosine, nearest first."""
    out = np.empty((len(x), prefix), dtype=np.int32)
    step = max(16, (8 << 20) // max(1, len(pivots)))
    ref = pivots.T.astype(np.float32)
    for at in range(0, len(x), step):
        s = x[at : at + step].astype(np.float32) @ ref
        top = np.argpartition(-s, prefix - 1, axis=1)[:, :prefix] if prefix < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
        out[at : at + step] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def fitted(vectors: np.ndarray, total: int, least: float, seed: int = 5) -> tuple[np.ndarray, int, np.ndarray]:
    """Pivots, how many of them describe a vector, by trial on partners at the cosine ``least``, and the centre.

    Vectors are described by their directions from the centre of the sample: where all lie in a cone, the
    pivots nearest to its axis would be near to everything else.

    Half of the partners lie in any direction, half in that of another sampled vector. Where MOST_PREFIX
    pivots don't reach RECALL for both halves, fewer pivots are taken.
    """
    rng, dim = np.random.default_rng(seed), vectors.shape[1]
    centre = vectors.mean(0) if len(vectors) else np.zeros(dim)
    moved = vectors - centre
    size = np.linalg.norm(moved, axis=1, keepdims=True)
    pivots = choose_pivots((moved / np.maximum(size, 1e-12))[size[:, 0] > 1e-6], wanted_pivots(total, dim), least)
    x = vectors[rng.permutation(len(vectors))[:TRIALS]]
    away = np.where((np.arange(len(x)) % 2 == 0)[:, None], rng.normal(size=x.shape), vectors[rng.integers(0, len(vectors), len(x))])
    away -= (away * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    y = least * x + math.sqrt(1 - least * least) * away / np.maximum(size, 1e-12)
    told = size[:, 0] > 1e-9
    while len(pivots) > PREFIX:
        most = min(MOST_PREFIX, len(pivots) - 1)
        a, b = nearest(x - centre, pivots, most), nearest(y - centre, pivots, most)
        for prefix in range(min(PREFIX, most), most + 1):
            both = (a[:, :prefix, None] == b[:, None, :prefix]).sum((1, 2)) >= 2
            if all(both[k::2][told[k::2]].mean() >= RECALL for k in (0, 1) if told[k::2].any()):
                return pivots, prefix, centre
        pivots = pivots[: len(pivots) // 2]
    return pivots[:0], 2, centre


def _unit(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return _scaled(batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = x.astype(np.float64)
    # Scaled by the largest part first, so that no square overflows or vanishes.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte a dimension, and for each unit vector the distance to what its code stands for, rounded up."""
    code = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
    back = code / np.linalg.norm(code.astype(np.float64), axis=1, keepdims=True)
    return code, (np.linalg.norm(back - x, axis=1) + 1e-5).astype(np.float32)


def _vector(vectors: DataFrame, column: str) -> Column:
    """The vectors in their own precision, float or double; a float moves in half the bytes and is the same number."""
    kind = vectors.schema[column].dataType.simpleString()
    return F.col(column) if kind == "array<float>" else F.col(column).cast("array<double>")


def _pairs(x: np.ndarray, floor: Callable, own: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (a, b), a < b, whose product is ``floor(a rows, all)`` or more; of different blocks if ``own`` tells them."""
    for at in range(0, len(x), STRIP):
        hit = x[at : at + STRIP] @ x.T >= floor(slice(at, at + STRIP))
        a, b = np.nonzero(hit)
        a += at
        ok = a < b if own is None else (a < b) & (own[a] != own[b])
        yield a[ok], b[ok]


def suspected(code: np.ndarray, err: np.ndarray, own: np.ndarray | None, least: float) -> np.ndarray:
    """Which vectors of a list may be linked with another of it, by their codes."""
    x = code.astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = np.zeros(len(x), dtype=bool)
    for a, b in _pairs(x, lambda s: (least - 1e-5 - err[s])[:, None] - err[None, :], own):
        out[a] = True
        out[b] = True
    return out


def counted(x: np.ndarray, weight: np.ndarray, near: np.ndarray, p: int, q: int, own: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of the list (p, q), by number of equal vectors, and a spanning forest of them."""
    links, trees = np.zeros(len(x), dtype=np.int64), []
    for a, b in _pairs(x, lambda s: least, own):
        for k in range(0, len(a), 200_000):
            i, j = a[k : k + 200_000], b[k : k + 200_000]
            shared = (near[i][:, :, None] == near[j][:, None, :]).any(2) & (near[i] >= 0)
            # ``near`` is sorted: the first two shared ones are the smallest.
            smallest = np.where(shared, near[i], np.iinfo(np.int32).max)
            smallest = np.partition(smallest, 1, axis=1)[:, :2]
            mine = (smallest[:, 0] == p) & (smallest[:, 1] == q)
            i, j = i[mine], j[mine]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            trees.append(_forest(i, j))
    pairs = np.concatenate(trees) if trees else np.empty((0, 2), dtype=np.int64)
    return links, _forest(pairs[:, 0], pairs[:, 1])


def embedding_links(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows link where their labels are equal and not null and the cosine is at least ``least``.
    Equal vectors of a label are joined once and weighted by their number. Cases: vectors that
    are null, empty, zero or hold null or non-finite parts, or whose label is null, have no
    links and are components of their own, as are vectors of different lengths to each other;
    a null id gets a null component unless linked; repeated ids count as vectors of their own;
    an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("e")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), _vector(vectors, vector_col).alias("e"), F.col(label_col).cast("string").alias("label"))
    good = F.col("label").isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False)) & F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False))
    # Equal vectors share a node; nodes of one label and length are a part.
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("dim", F.size(e)).withColumn("node", F.when(F.col("good"), F.xxhash64("label", "e"))).withColumn("part", F.xxhash64("label", "dim"))
    usable = rows.where("good")
    # Lengths of vectors are few; those of FEW rows or fewer need no pivots.
    dims = {r["dim"]: r["count"] for r in usable.groupBy("dim").count().where(f"count > {FEW}").collect()}
    models: dict[int, tuple[np.ndarray, int, np.ndarray]] = {}
    if dims:
        wants = {d: min(n, max(2 * TRIALS, 4 * wanted_pivots(n, d))) for d, n in dims.items()}
        shares = spark.createDataFrame([(d, int((1 << 40) * wants[d] / n)) for d, n in dims.items()], "dim int, below long")
        picked = usable.join(F.broadcast(shares), "dim").where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 40)) < F.col("below")).select("dim", "node", "e").dropDuplicates(["node"]).toArrow().sort_by("node")
        for d in dims:
            part = picked.filter(pa.compute.equal(picked["dim"], d)).combine_chunks()
            if part.num_rows:
                models[d] = fitted(_unit(part.to_batches()[0], 2), dims[d], least)
    shared = spark.sparkContext.broadcast({d: m for d, m in models.items() if len(m[0])})
    most = max([m[1] for m in models.values()], default=2)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            dims_ = batch.column(3).to_numpy()
            near, codes, errs = np.full((len(dims_), most), -1, dtype=np.int32), [b""] * len(dims_), np.zeros(len(dims_), dtype=np.float32)
            for d in np.unique(dims_):
                at = np.flatnonzero(dims_ == d)
                x = _unit(batch.take(pa.array(at)), 2)
                code, errs[at] = coded(x)
                for i, c in zip(at.tolist(), code):
                    codes[i] = c.tobytes()
                if int(d) in shared.value:
                    ref, prefix, centre = shared.value[int(d)]
                    near[at, :prefix] = np.sort(nearest(x - centre, ref, prefix), axis=1)
                else:
                    near[at, :2] = 0, 1  # one list holds all
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(list(near), pa.list_(pa.int32())), pa.array(codes, pa.binary()), pa.array(errs)], names=["vec_id", "node", "dim", "part", "near", "code", "err"])

    described = usable.select("vec_id", "node", "e", "dim", "part").mapInArrow(describe, "vec_id long, node long, dim int, part long, near array<int>, code binary, err float")
    firsts = [F.first(c).alias(c) for c in ("dim", "part", "near", "code", "err")]
    groups, _ = stash(described.groupBy("node").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), *firsts), "vector-groups")

    def rough(col: Callable, near: np.ndarray) -> Callable:
        code, err = np.frombuffer(b"".join(col("code").to_pylist()), dtype=np.int8).reshape(len(near), -1), col("err").to_numpy()
        return lambda at, p, q, own: (np.flatnonzero(suspected(code[at], err[at], own, least)),)

    may = _met(groups, ["code", "err"], rough, 1)
    linked, _ = stash(may.select("node").distinct(), "vector-suspects")
    kept = suspects(usable.select("node", "e"), ["node"], linked).where("_suspect").join(linked, "node", "left_semi").groupBy("node").agg(F.first("e").alias("e"))
    whole, _ = stash(kept.join(groups.select("node", "w", "dim", "part", "near"), "node"), "vector-whole")

    def exact(col: Callable, near: np.ndarray) -> Callable:
        raw, weight = col("e").flatten().to_numpy(zero_copy_only=False).reshape(len(near), -1), col("w").to_numpy()

        def work(at: np.ndarray, p: int, q: int, own: np.ndarray | None) -> tuple[np.ndarray, ...]:
            links, tree = counted(_scaled(raw[at]), weight[at], near[at], p, q, own, least)
            root = np.arange(len(at))
            root[tree[:, 0]] = tree[:, 1]
            some = np.flatnonzero(links)
            return some, links[some], root[some]

        return work

    found, _ = stash(_met(whole, ["e", "w"], exact, 8 if "double" in str(whole.schema["e"].dataType).lower() else 4), "vector-links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots, _ = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    members = groups.select("node", "w", "least").join(degree, "node", "left").join(roots, F.col("node") == F.col("vertex"), "left")
    members = members.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = of_component(members, "node", F.min("least"), "component_id").select("node", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = usable.select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _met(groups: DataFrame, payload: list[str], prepare: Callable, bytes_a_part: int) -> DataFrame:
    """(node, links, root) of what ``prepare``'s function makes of each inverted list (p, q): row numbers, and two values for each where it gives them.

    Lists of one smaller pivot lie in a block, cut by the larger pivot where it would exceed BLOCK_BYTES. A list of more
    than two BLOCKs of rows goes alone, in pairs of blocks.
    """
    later = F.expr("filter(near, q -> q > p)")
    own_lists = groups.select("part", "dim", "node", "near", F.explode(F.expr("filter(near, p -> p >= 0)")).alias("p")).select("part", "dim", "node", "p", later.alias("qs")).where("size(qs) > 0")
    # Lengths are told from one vector in SCOUT: how lists are cut bounds memory and changes no result.
    own_lists = own_lists.where(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(SCOUT)) == 0)
    long = own_lists.select("part", "p", F.explode("qs").alias("q")).groupBy("part", "p", "q").count().where(f"count * {SCOUT} > {2 * BLOCK}").select("part", "p", "q", F.ceil(F.col("count") * SCOUT / BLOCK).cast("int").alias("cut"))
    large = own_lists.groupBy("part", "p").agg((F.count("*") * SCOUT * (F.first("dim") * bytes_a_part + 48)).alias("size")).where(f"size > {BLOCK_BYTES}").select("part", "p", F.ceil(F.col("size") / BLOCK_BYTES).cast("int").alias("parts"))
    long, _ = stash(long, "long-lists")
    keep = ["part", "p", "node", "near", *payload]
    by_pivot = groups.select("part", "node", "near", *payload, F.explode(F.expr("filter(near, p -> p >= 0)")).alias("p")).withColumn("qs", later).where("size(qs) > 0")
    by_pivot = by_pivot.join(F.broadcast(large), ["part", "p"], "left").withColumn("piece", F.explode(F.expr("array_distinct(transform(qs, q -> if(parts is null, 0, q % parts)))")))
    dealt = by_pivot.select(*keep, F.lit(-1).alias("q"), F.lit(0).cast("long").alias("pair"), F.lit(0).alias("own"), "piece", F.coalesce("parts", F.lit(1)).alias("parts"))
    skip = [tuple(r) for r in long.select("part", "p", "q").collect()]  # at most one list for each 2 * BLOCK list entries
    if skip:
        cut = groups.select("part", "node", "near", *payload, F.explode(F.expr("filter(near, p -> p >= 0)")).alias("p")).withColumn("q", F.explode(later)).join(F.broadcast(long), ["part", "p", "q"])
        cut = cut.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("cut")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, cut - 1)")))
        pair = F.least("own", "other").cast("long") * 1_000_000 + F.greatest("own", "other")
        dealt = dealt.unionByName(cut.select(*keep, "q", pair.alias("pair"), "own", F.lit(0).alias("piece"), F.lit(1).alias("parts")))
    skipped = groups.sparkSession.sparkContext.broadcast(frozenset(skip))
    order = ["part", "p", "q", "pair", "piece"]

    def lists(table: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = table.combine_chunks().to_batches()[0]
        col = lambda n: batch.column(batch.schema.get_field_index(n))
        head = {c: col(c)[0].as_py() for c in order}
        node, near = col("node").to_numpy(), col("near").flatten().to_numpy().reshape(batch.num_rows, -1)
        parts, p = col("parts")[0].as_py(), head["p"]
        if head["q"] >= 0:
            a, b = divmod(head["pair"], 1_000_000)
            todo = [(head["q"], np.arange(len(node)), None if a == b else col("own").to_numpy())]
        else:
            row, at = np.nonzero(near > p)
            q = near[row, at]
            turn = np.argsort(q, kind="stable")
            row, q = row[turn], q[turn]
            edges = np.flatnonzero(np.r_[True, np.diff(q) != 0, True]) if len(q) else np.zeros(1, dtype=np.int64)
            todo = [(int(q[x]), row[x:y], None) for x, y in zip(edges, edges[1:]) if y - x > 1 and (head["part"], p, int(q[x])) not in skipped.value]
            if parts > 1:
                todo = [t for t in todo if t[0] % parts == head["piece"]]
        work = prepare(col, near)
        for q, at, own in todo:
            if len(at) < 2:
                continue
            some, *values = work(at, p, q, own)
            if len(some):
                links, root = values if values else (np.zeros(len(some), dtype=np.int64), some)
                yield pa.RecordBatch.from_arrays([pa.array(node[at][some]), pa.array(links), pa.array(node[at][root])], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in gathered(batches, 20_000):
            if not batch.num_rows:
                continue
            codes = [np.asarray(batch.column(batch.schema.get_field_index(c)).dictionary_encode().indices) for c in order]
            change = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                piece = batch.slice(a, b - a)
                if held and any(held[0].column(held[0].schema.get_field_index(c))[0] != piece.column(piece.schema.get_field_index(c))[0] for c in order):
                    yield from lists(pa.Table.from_batches(held))
                    held = []
                held.append(piece)
        if held:
            yield from lists(pa.Table.from_batches(held))

    return dealt.repartition(wide(groups.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, "node long, links long, root long")

