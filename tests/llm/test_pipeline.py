import zlib
from collections import Counter

import corpus_pipeline
from tracewell.llm import decontamination, mixing, quality
from tracewell.llm.words import plain_words


def shingled(text):
    words = text.encode().lower().split()
    return set(zip(*(words[k:] for k in range(5)))) or {tuple(words)}


def test_run_against_brute_force(spark, small):
    """Each decision made again in plain Python, with the fitted classifiers given."""
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    label_table, bench = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/benchmark.parquet").collect()
    labels = {r["doc_id"]: r["quality"] for r in label_table.collect()}
    known = sorted((r["doc_id"], r["text"]) for r in docs if r["doc_id"] in labels and not quality.held_out(r["doc_id"]))
    space = quality.fit([t.encode() for _, t in known], [labels[i] for i, _ in known])
    views = [memoryview(r["text"].encode()) for r in docs]
    score = space.score(space.project(quality.np.stack([quality.counts(v) for v in views]), quality.np.stack([quality.shape(v) for v in views])))
    left = [r for r, s in zip(docs, score) if s >= 0.7]

    sets = {r["doc_id"]: shingled(r["text"]) for r in left}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = [r for r in left if find(r["doc_id"]) == r["doc_id"]]

    items = [plain_words(r["text"].encode()) for r in bench]

    def dirty(text):
        words = plain_words(text.encode())
        return any(decontamination.edit_match(list(w), words, int(0.2 * len(w) + 1e-9)) for w in items)

    left = [r for r in left if not dirty(r["text"])]
    ids = {r["doc_id"] for r in left}
    frame = spark.read.parquet(f"{small}/documents.parquet").where(f"doc_id in ({','.join(map(str, ids))})")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixing_rates(frame, label_table, mixing.TARGETS, "cover").collect()}

    rows = corpus_pipeline.run(spark, small).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({i: n for i, n in copies.items() if n})
    text = {r["doc_id"]: r["text"].encode() for r in docs}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 8, zlib.crc32(text[r["doc_id"]])) for r in rows)
    places = sorted((r["shard"], r["slot"]) for r in rows)
    assert places == sorted((p % 24, p // 24) for p in range(len(rows)))


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
