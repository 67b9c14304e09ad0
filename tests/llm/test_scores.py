"""Token counts, quality and mixing."""

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import mixing, quality, token_counts
from tracewell.llm.queries import op3_mixing, op6_token_counts, op9_quality, tokenizer_path

MEDIUM = "/root/testdata/sf0.01"


def test_token_counts_against_the_library(spark, small):
    library = Tokenizer.from_file(tokenizer_path())
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op6_token_counts(spark, small).collect():
        n = len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 512)


ODD = ["", " ", "\n\n  x", "a<|endoftext|>b  c", "<|endoftext|><|endoftext|> y", "don't I'LL we've", "　  z", "\U0001f600\U0001f600 é é", "0123456789 " * 40, "a" * 5000, "\x00\x01\x85 \r\n\t", "ＡＢＣ ½ ²", "ß́́"]


def test_token_counts_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 2)
    monkeypatch.setattr(token_counts, "_workers", {})
    library = Tokenizer.from_file(tokenizer_path())
    lengths, pieces, special = token_counts._counter(tokenizer_path(), {})
    for text in ODD:
        assert token_counts.count_tokens(text, lengths, pieces, special) == len(library.encode(text, add_special_tokens=False).ids), text
    docs = spark.createDataFrame(list(enumerate([*ODD, None])), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, tokenizer_path()).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate([*ODD, None])}


def test_quality_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in op9_quality(spark, MEDIUM).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i in labels if rows[i]["held_out"]]
    good, bad = [rows[i]["predicted"] for i in held if labels[i]], [rows[i]["predicted"] for i in held if not labels[i]]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_scores_depend_on_text_alone(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    twin = docs.unionByName(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("source", F.lit("x")))
    rows = {r["doc_id"]: r["score"] for r in quality.quality_scores(twin, labels).collect()}
    assert all(rows[i] == pytest.approx(rows[i + 100_000]) for i in [r[0] for r in docs.limit(5).select("doc_id").collect()])


def test_vote_against_brute_force():
    rng = np.random.default_rng(1)
    space = quality.fit([bytes(rng.integers(32, 120, 300, dtype=np.uint8)) for _ in range(60)], rng.integers(0, 2, 60).tolist())
    z = space.vectors[:7]
    for v, s in zip(z, space.score(z)):
        near = sorted(((float(v @ u), y) for u, y in zip(space.vectors, space.labels)), reverse=True)[: quality.NEIGHBOURS]
        w = [np.exp(quality.SHARP * (c - 1)) for c, _ in near]
        assert s == pytest.approx(sum(a * y for a, (_, y) in zip(w, near)) / sum(w), abs=1e-4)


def test_mixing_meets_the_targets(spark, small):
    rows = op3_mixing(spark, small).collect()
    names = sorted(mixing.TARGETS)
    tokens = np.array([r["tokens"] for r in rows], dtype=float)
    have = np.array([r["posterior"] for r in rows]).T @ (tokens * np.array([r["rate"] for r in rows]))
    assert np.allclose(have / tokens.sum(), [mixing.TARGETS[n] for n in names], atol=1e-5)
    assert all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    hits = [names[int(np.argmax(r["posterior"]))] == langs[r["doc_id"]] for r in rows if r["tokens"] > 5]
    assert np.mean(hits) > 0.95


def test_rates_clip_at_zero_and_still_meet_targets(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    targets = {"en": 1.0, "de": 0.0, "fr": 1e-9, "es": 1e-9}
    rows = mixing.mixing_rates(docs, labels, targets).collect()
    tokens = np.array([r["tokens"] for r in rows], dtype=float)
    have = np.array([r["posterior"] for r in rows]).T @ (tokens * np.array([r["rate"] for r in rows]))
    assert have[sorted(targets).index("en")] / tokens.sum() == pytest.approx(1, abs=1e-2)
    assert min(r["rate"] for r in rows) == 0.0


def test_mixed_rows_follow_their_copies(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    want = {r["doc_id"]: r["copies"] for r in mixing.mixing_rates(docs, labels, mixing.TARGETS, "cover").collect()}
    out = mixing.mixed(docs, labels, mixing.TARGETS, "cover")
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert sum(abs(got.get(i, 0) - n) for i, n in want.items()) <= 1  # rounding of one and the same rate
    assert sum(got.values()) > len(want)


def test_quality_query_against_brute_force(spark, small):
    """Every score again: labelled rows chosen, counted, weighted and voted on in plain Python, with the axes given."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    known = sorted(i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 4 != 2)
    space = quality.fit([docs[i] for i in known], [labels[i] for i in known])

    def vector(text):
        pairs = np.zeros(quality.BINS)
        for a, b in zip(text, text[1:]):
            pairs[((a << 8 | b) * 0x9E3779B1 >> 12) % quality.BINS] += 1
        tf = np.log1p(pairs) * space.idf
        tf /= max(float(np.sqrt((tf**2).sum())), 1e-9)
        z = np.r_[tf @ space.axes, (quality.shape(memoryview(text)) - space.centre) * space.scale]
        return z / max(float(np.sqrt((z**2).sum())), 1e-9)

    known_vectors = [(vector(docs[i]), labels[i]) for i in known]
    for r in op9_quality(spark, small).collect():
        z = vector(docs[r["doc_id"]])
        near = sorted(((float(z @ v), y) for v, y in known_vectors), reverse=True)
        near = [n for n in near if n[0] >= near[quality.NEIGHBOURS - 1][0] - 1e-6]
        weight = [np.exp(quality.SHARP * (c - 1)) for c, _ in near]
        assert r["score"] == pytest.approx(sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight), abs=2e-3)


def test_ties_vote_together():
    space = quality.fit([b"good text of words"] * 40 + [b"0123 4567"] * 40, [1] * 30 + [0] * 10 + [0] * 40)
    first = space.score(space.project(np.stack([quality.counts(memoryview(b"good text of words"))]), np.stack([quality.shape(memoryview(b"good text of words"))])))
    assert first[0] == pytest.approx(0.75, abs=1e-3)


def test_labelled_texts_are_whole_and_one_for_an_id(spark):
    long = "word " * 30_000
    docs = spark.createDataFrame([(1, long), (2, "b"), (2, "a"), (2, "a"), (3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    c, s, y = quality.labelled(docs, labels, "true")
    assert y == [1, 0] and c[0].sum() == len(long) - 1 and len(s) == 2
    langs = docs.withColumn("lang", F.lit("en"))
    assert mixing.fit_classifier(langs, labels, ["de", "en"]).weights.any()


def brute_rates(tokens, posterior, goal):
    """Nonnegative least squares by accelerated projected gradients in plain numpy, to convergence."""
    a = (posterior * tokens[:, None]).T
    r = np.ones(len(tokens))
    step, y, t = 1 / np.linalg.norm(a @ a.T, 2), r.copy(), 1.0
    for _ in range(20_000):
        new = np.maximum(0.0, y - step * (a.T @ (a @ y - goal)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, r, t = new + (t - 1) / t2 * (new - r), new, t2
    return r


@pytest.mark.parametrize("targets", [mixing.TARGETS, {"en": 0.97, "de": 0.01, "fr": 0.01, "es": 0.01}, {"en": 0.1, "de": 0.1, "fr": 0.1, "es": 0.7}])
def test_rates_against_brute_force(spark, small, targets):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = mixing.mixing_rates(docs, labels, targets).collect()
    tokens, posterior, rate = (np.array([r[c] for r in rows], dtype=float) for c in ("tokens", "posterior", "rate"))
    goal = np.array([targets[n] for n in sorted(targets)]) * tokens.sum()
    miss = lambda r: np.linalg.norm((posterior * tokens[:, None]).T @ r - goal) / tokens.sum()
    assert miss(rate) <= miss(brute_rates(tokens, posterior, goal)) + 1e-3 and rate.min() >= 0


def test_special_strings_of_any_form(tmp_path):
    import json

    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    spec["added_tokens"] = [*spec.get("added_tokens", []), {"id": 90_000, "content": "[END]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]
    path = str(tmp_path / "own.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    library = Tokenizer.from_file(path)
    counter = token_counts._counter(path, {})
    for text in ("a [END] b", "[END][END]", "x [end]"):
        assert token_counts.count_tokens(text, *counter) == len(library.encode(text, add_special_tokens=False).ids)
    spec["added_tokens"][-1]["lstrip"] = True
    json.dump(spec, open(str(tmp_path / "odd.json"), "w", encoding="utf-8"))
    with pytest.raises(ValueError):
        token_counts._counter(str(tmp_path / "odd.json"), {})


def test_fitting_holds_the_counts_once():
    c = np.random.default_rng(3).poisson(0.1, (2048, quality.BINS)).astype(np.float32)
    tracemalloc.start()
    quality.fit_counts(c, np.zeros((len(c), 10), np.float32), [0, 1] * (len(c) // 2))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < c.nbytes // 2
