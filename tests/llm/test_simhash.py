import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import simhash, vptree
from tracewell.llm.components import components
from tracewell.llm.queries import op2_simhash


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_query_against_brute_force(spark, small):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    prints = [plain_fingerprint(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = {(d, f"{p:016x}", docs[c][0]) for (d, _), p, c in zip(docs, prints, classes(len(docs), pairs))}
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in op2_simhash(spark, small).collect()} == want


def cloud(rng, n):
    base = rng.integers(0, 2**64, n, dtype=np.uint64)

    def flip(x, k):
        for b in rng.choice(64, k, replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        return x

    near = [flip(base[rng.integers(max(1, n // 4))], rng.integers(1, 6)) for _ in range(n)]
    tight = [flip(base[0], rng.integers(1, 6)) for _ in range(n)]
    return np.unique(np.concatenate([base, np.array(near + tight, dtype=np.uint64)]))


@pytest.mark.parametrize("n", [3, 60, 900])
def test_trees_find_all_links(n):
    fp = cloud(np.random.default_rng(n), n)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    got = vptree.links(fp, None, None, vptree.Rule(3))
    assert classes(len(fp), got.tolist()) == classes(len(fp), zip(i.tolist(), j.tolist()))
    tree = vptree.fit(fp[: len(fp) // 2], None, len(fp), 100, vptree.Rule(3))
    row, leaf = tree.place(fp, None)
    at = [set(leaf[row == k].tolist()) for k in range(len(fp))]
    assert all(at) and all(at[a] & at[b] for a, b in zip(i.tolist(), j.tolist()))


def test_length_vantage_keeps_near_pairs():
    rng = np.random.default_rng(4)
    fp, size = rng.integers(0, 2**64, 4000, dtype=np.uint64), np.exp(rng.normal(5, 1, 4000)).astype(np.int64)
    tree = vptree.fit(fp, size, 4000, 300, vptree.Rule(16, ratio=0.8))
    row, leaf = tree.place(fp, size)
    at = [set() for _ in fp]
    for r, x in zip(row.tolist(), leaf.tolist()):
        at[r].add(x)
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 16) & (np.minimum(size[:, None], size[None, :]) >= 0.8 * np.maximum(size[:, None], size[None, :]))
    assert tree.leaves > 1 and all(at[a] & at[b] for a, b in zip(*np.nonzero(near)))


def test_shards_without_a_split_are_compared_in_blocks(spark):
    fp = cloud(np.random.default_rng(9), 200)
    items = spark.createDataFrame([(int(k), int(k)) for k in fp.view(np.int64)], "key long, fp long")
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    want = classes(len(fp), zip(i.tolist(), j.tolist()))
    place = {int(k): n for n, k in enumerate(fp.view(np.int64))}
    got = [(place[r["u"]], place[r["v"]]) for r in simhash.fingerprint_links(items, vptree.Rule(3), shard=20).collect()]
    assert classes(len(fp), got) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(5, 5), (100, 101), (101, 100), (None, 3)], "u long, v long")
    roots, _ = components(edges)
    got = {r["vertex"]: r["root"] for r in roots.collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components(edges.limit(0))[0].count() == 0


def test_near_copies(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(3000)]
    base = rng.choice(words, 300).tolist()
    edited = base[:100] + ["zzz"] + base[101:]
    other = base[:150] + rng.choice(words, 150).tolist()
    rows = [(4, " ".join(base)), (9, " ".join(edited)), (2, " ".join(other)), (7, " ".join(base)), (7, " ".join(base)), (None, "alone"), (11, ""), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r[0], r[1]) for r in simhash.near_duplicates(docs).collect() if r[0] not in (None, 11, 12)} == {(4, 4), (9, 4), (7, 4), (2, 2)}
    assert sorted((r[0] or -1) for r in simhash.one_of_each(docs).collect()) == [-1, 2, 4, 11]


def test_rows_are_judged_by_id_and_text(spark):
    rows = [(3, "a b c d e f g h"), (7, "a b c d e f g h"), (7, "one two three four five six"), (7, "one two three four five six"), (9, "one two three four five six"), (None, "a b c d e f g h"), (4, None), (4, "of its own, this one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_suspect", F.lit(1)).withColumn("mark", F.lit("x"))
    got = sorted(((r["doc_id"] or -1, r["text"] or "") for r in simhash.one_of_each(docs).collect()))
    assert got == [(-1, rows[0][1]), (3, rows[0][1]), (4, ""), (4, rows[7][1]), (7, rows[2][1])]


def planted(rng, count, size):
    """Texts and copies of them in which runs of words were replaced, with the similarity of their five-word shingles."""
    words, out = [f"w{k}" for k in range(20_000)], []
    for _ in range(count):
        base = rng.choice(words, size).tolist()
        copy = base[:]
        for _ in range(rng.integers(1, max(2, size // 40))):
            copy[rng.integers(size)] = "edit%d" % rng.integers(10**6)
        a, b = (set(zip(*(x[k:] for k in range(5)))) for x in (base, copy))
        out.append((" ".join(base), " ".join(copy), len(a & b) / len(a | b)))
    return out


def test_recall_of_near_copies(spark):
    rng = np.random.default_rng(12)
    pairs = [p for size in (60, 150, 600) for p in planted(rng, 400, size)]
    rows = [(2 * k + j, p[j]) for k, p in enumerate(pairs) for j in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = lambda low, high: np.mean([got[2 * k + 1] == 2 * k for k, p in enumerate(pairs) if low <= p[2] < high])
    assert found(0.85, 1.1) >= 0.97 and found(0.8, 1.1) >= 0.93, (found(0.8, 0.85), found(0.85, 1.1))
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(len(pairs)))
    assert found(0.0, 0.7) == 0 or not any(p[2] < 0.7 for p in pairs)


def test_placements_do_not_grow_with_the_table():
    rng = np.random.default_rng(3)
    for total, most in ((10**6, 4.1), (10**8, 4.1), (10**9, 4.4)):
        tree = vptree.fit(rng.integers(0, 2**64, max(4096, vptree.PER_SHARD * total // 65_536), dtype=np.uint64), None, total, 65_536, vptree.Rule(3))
        row, leaf = tree.place(rng.integers(0, 2**64, 5000, dtype=np.uint64), None)
        assert len(row) <= most * 5000 and tree.leaves >= 4 * total // 65_536


def test_large_components_are_dealt_to_several_tasks(spark, monkeypatch):
    from tracewell.llm import components as module

    members = spark.createDataFrame([(k, 0 if k < 90 else k, 1000 - k) for k in range(100)], "key long, root long, least long")
    want = sorted((k, 911 if k < 90 else 1000 - k) for k in range(100))
    for hot in (10_000, 7):
        monkeypatch.setattr(module, "HOT", hot)
        assert sorted((r["key"], r["x"]) for r in module.of_component(members, "key", F.min("least"), "x").collect()) == want
