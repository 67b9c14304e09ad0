import math

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import embeddings
from tracewell.llm.queries import op5_embeddings


def brute(rows):
    """vec_id -> (links, component) from all pairs."""
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, link = len(rows), {i: set() for i in range(len(rows))}
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if usable(a, la) and usable(b, lb) and la == lb and len(a) == len(b):
                x, y = np.array(a, dtype=float), np.array(b, dtype=float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    link[i].add(j)
                    link[j].add(i)
    out, seen = {}, {}
    for i in range(n):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for k in link[todo.pop()] - group:
                    group.add(k)
                    todo.append(k)
            least = min(rows[k][0] for k in group)
            seen |= {k: least for k in group}
        out[rows[i][0]] = (len(link[i]), seen[i])
    return out


def check(got, rows):
    want = brute(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_query_against_brute_force(spark, small):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check(op5_embeddings(spark, small).collect(), rows)


def made(rng, count):
    base = rng.normal(size=(count, 32))
    near = base[rng.integers(count // 8, size=2 * count)] + rng.normal(size=(2 * count, 32)) * 0.12
    x = np.vstack([base, near, base[:5], base[:5] * 3])
    label = np.r_[rng.integers(3, size=count), rng.integers(3, size=2 * count), [0] * 10]
    return [(i, [float(v) for v in x[i]], int(label[i])) for i in range(len(x))]


@pytest.mark.parametrize("block", [1024, 24])
def test_dense_groups_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = made(np.random.default_rng(3), 80)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = {k: v[0] for k, v in brute(rows).items()}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())  # the index's recall


def test_odd_vectors(spark):
    a, b = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    rows = [(1, a, 1), (2, a, 1), (3, [2.0] + [0.0] * 7, 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0] * 8, 1), (8, [float("nan")] + [0.0] * 7, 1), (9, [None] + [1.0] * 7, 1), (10, [1.0], 1), (11, b, 1), (12, [float("inf")] * 8, 1), (13, [1e200] + [0.0] * 7, 1), (14, [], 1), (15, [1e-200] + [0.0] * 7, 1)]
    got = embeddings.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert by == {1: (4, 1), 2: (4, 1), 3: (4, 1), 13: (4, 1), 15: (4, 1)} | {k: (0, k) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12, 14)}


def partners(rng, count, dim, lift, low=0.93, high=0.97):
    """Unit vectors, in a cone if ``lift`` is set, and for each a partner at a cosine from ``low`` to ``high``."""
    x = rng.normal(size=(count, dim)) + lift
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(low, high, (count, 1))
    return x, cos * x + np.sqrt(1 - cos**2) * away


@pytest.mark.parametrize("lift", [0.0, 1.5])
def test_recall_of_planted_pairs(spark, lift):
    x, y = partners(np.random.default_rng(7), 12_000, 48, lift)
    if lift:
        assert np.median(x[:300] @ x[300:600].T) > 0.6
    both = np.concatenate([x, y])
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(both)), "embedding": pa.array(list(both)), "label": np.zeros(len(both), dtype=np.int32)}))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_links(frame).select("vec_id", "n_links", "component_id").collect()}
    # Recall against brute force over all pairs, and no link below the threshold.
    want = np.zeros(len(both), dtype=int)
    for at in range(0, len(both), 500):
        want[at : at + 500] = (both[at : at + 500] @ both.T >= 0.93).sum(1) - 1
    found = np.array([got[k][0] for k in range(len(both))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum() and want.sum() >= 20_000
    assert np.mean([got[k][1] == got[k + len(x)][1] for k in range(len(x))]) >= 0.95


def test_pivots_grow_and_adapt():
    for lift in (0.0, 1.5):
        x, _ = partners(np.random.default_rng(1), 8000, 32, lift)
        few, many = (embeddings.fitted(x, total, 0.93) for total in (50_000, 10**7))
        # In a cone a pair at the threshold is far apart against all others: fewer pivots, or more of them for a vector.
        assert len(few[0]) >= 64 and len(many[0]) > (4 if not lift else 1) * len(few[0]) and few[1] <= many[1] <= embeddings.MOST_PREFIX
    assert embeddings.wanted_pivots(10**9, 64) > 18_000


def test_long_lists_and_large_blocks_change_nothing(spark, monkeypatch):
    x, y = partners(np.random.default_rng(2), 1500, 16, 0.8)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y, y[:50], x[:1] + 0.01 * np.random.default_rng(3).normal(size=(300, 16))]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    run = lambda: sorted(map(tuple, embeddings.embedding_links(frame).collect()))
    plain = run()
    monkeypatch.setattr(embeddings, "SCOUT", 1)
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    assert run() == plain
    monkeypatch.setattr(embeddings, "BLOCK", 16_384)
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 4000)
    assert run() == plain


def test_many_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(100 * d + k, rng.normal(size=d).tolist() if k else [1.0] * d, 0) for d in range(1, 90) for k in range(3)]
    rows += [(20_000 + d, [2.0] * d, 0) for d in range(1, 90)]
    got = embeddings.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    check(got, [(i, [float(np.float32(v)) for v in e], l) for i, e, l in rows])
