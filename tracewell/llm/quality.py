"""Document quality by nearest-neighbour voting in a latent-semantic space.

Texts become sublinear, idf-weighted counts of hashed byte pairs and of a few word shapes; a truncated
singular value decomposition of a bounded sample of labelled rows gives the latent axes. The
labelled latent vectors, bounded too, are broadcast; each document takes exact cosines to all of
them in blocks, and its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import ship, slices, text_views

#: Labelled rows that the space and the votes are made from, at most (taken by hash of doc_id).
LABELLED = 4096
AXES = 48
NEIGHBOURS = 25
BINS = 4096
#: Rows of counts that are weighted at a time when the space is fitted.
BLOCK = 256
#: Votes weigh exp(SHARP * (cosine - 1)).
SHARP = 12.0

_ASCII = np.arange(256, dtype=np.int64)
_MIX = ((np.arange(65_536, dtype=np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(12)).astype(np.int64) % BINS
#: Byte classes: space, letter, digit, capital, other.
_KIND = np.select([np.isin(_ASCII, [9, 10, 11, 12, 13, 32]), (_ASCII >= 97) & (_ASCII <= 122) | (_ASCII >= 128), (_ASCII >= 48) & (_ASCII <= 57), (_ASCII >= 65) & (_ASCII <= 90)], [0, 1, 2, 3], 4).astype(np.uint8)


def counts(text: memoryview) -> np.ndarray:
    """Counts of hashed byte pairs over the whole text (BINS of them)."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) < 2:
        return np.zeros(BINS, dtype=np.float32)
    pairs = (data[:-1].astype(np.uint16) << 8) | data[1:]
    if len(pairs) < 16_000:
        return np.bincount(_MIX[pairs], minlength=BINS).astype(np.float32)
    return np.bincount(_MIX, weights=np.bincount(pairs, minlength=65_536), minlength=BINS).astype(np.float32)


def shape(text: memoryview) -> np.ndarray:
    """Shares that say how a text is made up: byte classes, distinct words and lines, lengths."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data)
    if not n:
        return np.zeros(10, dtype=np.float32)
    kinds = np.bincount(_KIND[data], minlength=5) / n
    raw = bytes(text)
    words, lines = raw.split(), raw.split(b"\n")
    k = max(1, len(words))
    return np.array([*kinds, len(set(words)) / k, len(set(lines)) / len(lines), np.log1p(k) / 10, n / k / 20, len(lines) / k], dtype=np.float32)


def _weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear, idf-weighted counts of unit length."""
    tf = np.log1p(c) * idf
    tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-9)
    return tf


class Space:
    """Latent axes, labelled vectors and the vote."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, centre: np.ndarray, scale: np.ndarray):
        self.idf, self.axes, self.centre, self.scale = idf, axes, centre, scale
        self.vectors = np.empty((0, 0), dtype=np.float32)
        self.labels = np.empty(0, dtype=np.float32)
        self.prior = 0.5

    def project(self, c: np.ndarray, s: np.ndarray) -> np.ndarray:
        return self.placed(_weighted(c, self.idf), s)

    def placed(self, tf: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Latent vectors from weighted counts and shapes."""
        z = np.hstack([tf @ self.axes, (s - self.centre) * self.scale]).astype(np.float32)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, z: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors; those as near as the last one vote too."""
        if not len(self.labels):
            return np.full(len(z), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        out = np.empty(len(z))
        for at in range(0, len(z), 256):
            near = z[at : at + 256] @ self.vectors.T
            last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            row, who = np.nonzero(near >= last[:, None])
            weight = np.exp(SHARP * (near[row, who].astype(np.float64) - 1))
            out[at : at + 256] = np.bincount(row, weight * self.labels[who], len(near)) / np.bincount(row, weight, len(near))
        return np.clip(out, 0.0, 1.0)


def fit(texts: list[bytes], labels: list[int]) -> Space:
    """The space from labelled texts; none give a space that scores everything one half."""
    views = [memoryview(t) for t in texts]
    return fit_counts(np.stack([counts(t) for t in views]) if views else np.empty((0, BINS), np.float32), np.stack([shape(t) for t in views]) if views else np.empty((0, 10), np.float32), labels)


def fit_counts(c: np.ndarray, s: np.ndarray, labels: list[int]) -> Space:
    """The space from the counts and shapes of labelled texts. The counts are overwritten: the driver's memory has room for them once."""
    if not len(c):
        return Space(np.ones(BINS, np.float32), np.zeros((BINS, 1), np.float32), np.zeros(10, np.float32), np.ones(10, np.float32))
    blocks = [slice(at, at + BLOCK) for at in range(0, len(c), BLOCK)]
    idf = np.log((1 + len(c)) / (1 + sum((c[b] > 0).sum(0) for b in blocks))).astype(np.float32) + 0.1
    for b in blocks:
        c[b] = _weighted(c[b], idf)
    # Leading right singular vectors by subspace iteration from a fixed start.
    axes = np.random.default_rng(5).standard_normal((BINS, AXES + 8)).astype(np.float32)
    for _ in range(6):
        axes = np.linalg.qr(c.T @ (c @ axes))[0]
    turn = np.linalg.svd(c @ axes, full_matrices=False)[2]
    axes = (axes @ turn.T)[:, :AXES].astype(np.float32)
    spread = s.std(0)
    space = Space(idf, axes, s.mean(0), np.where(spread > 1e-6, 0.35 / np.maximum(spread, 1e-6) / np.sqrt(10), 0).astype(np.float32))
    space.vectors, space.labels = space.placed(c, s), np.array(labels, dtype=np.float32)
    space.prior = float(space.labels.mean())
    return space


def labelled(docs: DataFrame, labels: DataFrame, where: str, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Counts, shapes and labels of at most LABELLED labelled texts that meet ``where``, chosen by hash of the id, ties by id.

    Whole texts are counted on the workers, so that a text's length bounds nothing here: a row of
    the result has BINS numbers, sent as those that are not zero. Of several texts under an id the
    least counts, of several labels the greatest.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label")).where(where)
    chosen = known.groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # LABELLED rows at most
    one = rows.where("text is not null").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            views = list(text_views(batch, "text"))
            full = [counts(t) for t in views]
            at = [np.flatnonzero(c) for c in full]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([c[a].tobytes() for c, a in zip(full, at)], pa.binary()), pa.array([shape(t).tobytes() for t in views], pa.binary())], names=["doc_id", "_label", "bins", "counts", "shape"])

    found = sorted(one.select("doc_id", "_label", "text").mapInArrow(run, "doc_id long, _label int, bins binary, counts binary, shape binary").collect(), key=lambda r: r["doc_id"])
    c = np.zeros((len(found), BINS), dtype=np.float32)
    for i, r in enumerate(found):
        c[i, np.frombuffer(r["bins"], dtype=np.uint16)] = np.frombuffer(r["counts"], dtype=np.float32)
    s = np.array([np.frombuffer(r["shape"], dtype=np.float32) for r in found], dtype=np.float32).reshape(-1, 10)
    return c, s, [r["_label"] for r in found]


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text leaves 2 on division by 4."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 4 == 2


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= ``cut``).

    Only the text is an input of a score; labels are learnt from rows that are not held out.
    Cases: null and empty texts are scored like any other (all-zero counts); a null id counts as
    empty text for ``held_out``; repeated rows stay and score alike; labelled vectors as near as the last of
    the NEIGHBOURS vote as well; without labels every score is 0.5; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    space = spark.sparkContext.broadcast(pickle.dumps(fit_counts(*labelled(docs, labels, "crc32(cast(doc_id as string)) % 4 <> 2", id_col, text_col))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Space = pickle.loads(space.value)
        for batch in slices(batches, 512):
            views = list(text_views(batch, "text"))
            z = model.project(np.stack([counts(t) for t in views]), np.stack([shape(t) for t in views]))
            score = model.score(z)
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``cut`` or more, all columns as they were, without a shuffle.

    Cases as for ``quality_scores``: every row, with or without an id, is judged by its text alone.
    """
    spark = docs.sparkSession
    ship(spark)
    space = spark.sparkContext.broadcast(pickle.dumps(fit_counts(*labelled(docs, labels, "crc32(cast(doc_id as string)) % 4 <> 2", id_col, text_col))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Space = pickle.loads(space.value)
        for batch in slices(batches, 512):
            views = list(text_views(batch, text_col))
            score = model.score(model.project(np.stack([counts(t) for t in views]), np.stack([shape(t) for t in views])))
            yield batch.filter(pa.array(score >= cut))

    return docs.mapInArrow(run, docs.schema)
