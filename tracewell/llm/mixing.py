"""Mixing to target weights with soft domain membership.

A softmax classifier, fitted on a bounded sample of the labelled rows, gives each document
posteriors over the domains. Nonnegative rates per document are then fitted so that the
expected tokens of each domain, the sum over documents of rate x tokens x posterior, match the
targets: projected-gradient least squares whose only shared state is one vector with an
entry per domain. A step aggregates the domain totals in parallel, turns their error into a
direction by the inverse of the domains' own Gram matrix (so an unclipped step lands on the
targets) and every document clips its own rate at zero.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import ship, slices, stash, text_views
from .quality import counts

#: Labelled rows that the classifier is fitted on, at most (taken by hash of doc_id).
LABELLED = 2048
STEPS = 40
TOLERANCE = 1e-7
FOLD = 1024

#: Shares of tokens by domain that the registered query and the pipeline aim at.
TARGETS = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}


def folded(text: memoryview) -> np.ndarray:
    """Counts of hashed byte pairs in FOLD bins."""
    return counts(text).reshape(-1, FOLD).sum(0)


class Classifier:
    """Softmax regression on hashed byte pairs."""

    def __init__(self, texts: list[bytes], domains: list[str], names: list[str]):
        self._fit(np.stack([folded(memoryview(t)) for t in texts]) if texts else np.empty((0, FOLD)), domains, names)

    @classmethod
    def of_counts(cls, c: np.ndarray, domains: list[str], names: list[str]) -> Classifier:
        """From folded counts of texts."""
        made = cls.__new__(cls)
        made._fit(c, domains, names)
        return made

    def _fit(self, c: np.ndarray, domains: list[str], names: list[str]) -> None:
        self.names = names
        self.weights = np.zeros((FOLD + 1, len(names)))
        if not len(c):
            return
        x = self._inputs(c)
        y = np.eye(len(names))[[names.index(d) for d in domains]]
        speed = np.zeros_like(self.weights)
        rate = 8.0
        for _ in range(150):
            p = self._softmax(x @ self.weights)
            speed = 0.9 * speed - rate * (x.T @ (p - y) / len(x) + 1e-5 * self.weights)
            self.weights += speed

    @staticmethod
    def _inputs(c: np.ndarray) -> np.ndarray:
        c = np.log1p(c.astype(np.float64))
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        return np.hstack([c, np.ones((len(c), 1))])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def posteriors(self, texts: list[memoryview]) -> np.ndarray:
        return self._softmax(self._inputs(np.stack([folded(t) for t in texts])) @ self.weights)


def fit_classifier(docs: DataFrame, labels: DataFrame, names: list[str], domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """The classifier from LABELLED labelled rows at most, ties by id; whole texts are counted on the workers, of several under an id the least."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(domain_col).cast("string").alias("domain"))
    known = known.join(F.broadcast(ids), "doc_id").where(F.col("domain").isin(names) & F.col("text").isNotNull())
    one = known.groupBy("doc_id").agg(F.min(F.struct("text", "domain")).alias("r")).select("doc_id", "r.domain", "r.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([folded(t).astype(np.float32).tobytes() for t in text_views(batch, "text")], pa.binary())], names=["doc_id", "domain", "counts"])

    sample = sorted(one.mapInArrow(run, "doc_id long, domain string, counts binary").collect(), key=lambda r: r["doc_id"])
    return Classifier.of_counts(np.array([np.frombuffer(r["counts"], dtype=np.float32) for r in sample]).reshape(-1, FOLD), [r["domain"] for r in sample], names)


def domain_posteriors(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens (words) and posterior (one share per name) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier: Classifier = pickle.loads(model.value)
        for batch in slices(batches, 512):
            views = list(text_views(batch, "text"))
            p = classifier.posteriors(views)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(bytes(v).split()) for v in views], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "tokens", "posterior"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tokens long, posterior array<double>")


def _rate(directions: list[np.ndarray]) -> Column:
    """The rate of a document after the given steps: from 1, a clipped step for each."""
    if not directions:
        return F.lit(1.0)
    steps = F.array(*(F.array(*(F.lit(float(v)) for v in d)) for d in directions))
    move = lambda d: sum((F.col("posterior")[k] * d[k] for k in range(len(directions[0]))), F.lit(0.0))
    return F.aggregate(steps, F.lit(1.0), lambda r, d: F.greatest(F.lit(0.0), r - move(d)))


def _draw(seed: int, id_col: str = "doc_id") -> Column:
    """A share of one by hash of the id; one half without an id."""
    return F.coalesce(F.when(F.col(id_col).isNotNull(), F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)), 11) / F.lit(float(1 << 53))), F.lit(0.5))


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: str | float, domain_col: str, id_col: str, text_col: str):
    """The broadcast classifier, the table of posteriors and the steps that lead to the rates."""
    spark = docs.sparkSession
    ship(spark)
    names = sorted(targets)
    size = len(names)
    model = spark.sparkContext.broadcast(pickle.dumps(fit_classifier(docs, labels, names, domain_col, id_col, text_col)))
    rows, _ = stash(domain_posteriors(docs, model, id_col, text_col), "posteriors")
    weight = [F.coalesce(F.sum(F.col("tokens") * F.col("posterior")[i]), F.lit(0.0)) for i in range(size)]
    gram = [F.coalesce(F.sum(F.col("tokens") * F.col("posterior")[i] * F.col("posterior")[j]), F.lit(0.0)) for i in range(size) for j in range(size)]
    first = rows.agg(*(c.alias(f"c{i}") for i, c in enumerate(weight + gram))).first()
    have = np.array(first[:size])
    inverse = np.linalg.pinv(np.array(first[size:]).reshape(size, size), rcond=1e-9, hermitian=True)
    share = np.array([targets[n] for n in names]) / sum(targets.values())
    total = float(budget) if not isinstance(budget, str) else float(have.sum()) if budget == "keep" else float(np.max(have / np.maximum(share, 1e-12)))
    goal, steps = share * total, []
    for _ in range(STEPS):
        error = have - goal
        if not total or np.abs(error).sum() <= TOLERANCE * total:
            break
        steps.append(inverse @ error)
        rate = _rate(steps)
        have = np.array(rows.agg(*(F.coalesce(F.sum(rate * F.col("tokens") * F.col("posterior")[i]), F.lit(0.0)).alias(f"c{i}") for i in range(size))).first())
    else:
        left = float(np.abs(have - goal).sum() / total) if total else 0.0
        if left > 1e-3:  # a target out of reach: the rates are the closest that the steps came to
            warnings.warn(f"domain totals miss the targets by {left:.2%} of the tokens after {STEPS} steps", stacklevel=3)
    return model, rows, steps


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: str | float = "keep", domain_col: str = "lang", seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens, posterior, rate, copies.

    ``targets`` are shares of tokens by domain. ``budget``: ``keep`` holds the token total, ``cover``
    takes the least total that cuts no domain below what there is, a number is a total. ``copies``
    rounds the rate by a hash of doc_id, so that the expected copies are the rate. Cases: null and
    empty texts have no tokens and rate by the classifier's intercepts; rows whose domain is
    null or not a target are only not learnt from; without labels all posteriors are equal;
    domains that no document belongs to are matched as closely as least squares can, with a warning where
    STEPS steps leave a thousandth of the tokens off the targets; repeated rows
    rate alike; an empty table gives no rows; other columns are ignored.
    """
    _, rows, steps = _fitted(docs, labels, targets, budget, domain_col, id_col, text_col)
    return rows.withColumn("rate", _rate(steps)).withColumn("copies", F.floor(F.col("rate") + _draw(seed)).cast("long"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: str | float = "cover", domain_col: str = "lang", seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its rounded rate says, all columns as they were, without a shuffle.

    Cases as for ``mixing_rates``.
    """
    model, _, steps = _fitted(docs, labels, targets, budget, domain_col, id_col, text_col)
    mark = "_tracewell_draw"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier: Classifier = pickle.loads(model.value)
        for batch in slices(batches, 512):
            p = classifier.posteriors(list(text_views(batch, text_col)))
            rate = np.ones(len(p))
            for step in steps:
                rate = np.maximum(0.0, rate - p @ step)
            copies = np.floor(rate + batch.column(batch.schema.get_field_index(mark)).to_numpy()).astype(np.int64)
            yield batch.drop_columns([mark]).take(pa.array(np.repeat(np.arange(len(p)), copies)))

    return docs.withColumn(mark, _draw(seed, id_col)).mapInArrow(run, docs.schema)
