"""From raw documents to shards of training data: five stages, each one operator over all that is left.

Each stage reads what the one before it wrote and its decision takes effect: rows go, repeat or are
placed. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontamination, mixing, quality, sharding, simhash
from tracewell.llm._work import ship, stash, stashes, sweep, table


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of ``cut`` or more).

    Cases: every row is judged by its whole text alone; a null or empty text is scored like any other;
    rows with equal texts go or stay together, with null or repeated ids too; without labels every score
    is 0.5 and no row stays; an empty table stays empty; all columns stay as they were.
    """
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), cut=0.7)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Cases: the smallest id of a group stays, of equal ids with different texts each is judged for itself;
    of rows equal in id and text one stays; rows without an id stay; null texts, empty ones and those
    without words are one group; an empty table stays empty; all columns stay as they were.
    """
    ship(spark)
    return simhash.one_of_each(docs, words=5, similar=0.8)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, up to a fifth of an item's words edited.

    Cases: null and empty texts hold no item and stay; null, empty and one- or two-word items match
    nothing; repeated rows go or stay together, with null or repeated ids too; an empty benchmark drops
    nothing; an empty table stays empty; all columns stay as they were.
    """
    ship(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), edits=0.2, recall=0.95)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that expected domain tokens meet the targets and no domain is cut.

    Cases: null and empty texts have no tokens and are rated by the classifier alone; rows of equal id
    and text are repeated alike, a fraction of a copy falls by hash of the id (one half without one); rows
    whose domain is null or no target are rated too; without labels all domains are alike; an empty
    table stays empty; all columns stay as they were.
    """
    ship(spark)
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), mixing.TARGETS, budget="cover")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row that is left: doc_id, size, text_crc32, law, shard, slot.

    Cases: a null text has size 8 and checksum 0, as an empty one; null ids are one id of their own;
    repeated rows get places of their own; an empty table gives no rows; other columns are ignored.
    """
    plan = sharding.shard_plan(docs, shards=24)
    return plan.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot")


STAGES = [
    ("quality", good_text),
    ("near_dedup", one_of_each),
    ("decontaminate", clean_of_benchmark),
    ("mix", mixed),
    ("shard", sharded),
]

#: Classifiers, fingerprints and walks are out of reach of SQL; a test holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is written before the next reads it.

    Tables that a stage made on its way go once its result is written, and that with the next stage's.
    """
    docs, since = table(spark, sf_dir, "documents"), stashes()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = stash(docs, f"pipeline-{name}")
            sweep(spark, keep=path, since=since)
    return docs
