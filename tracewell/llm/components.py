"""Connected components of a distributed graph by alternating star contractions.

Each round hangs every vertex on the smallest vertex it knows (large star, then small star);
the number of rounds grows with the logarithm of the longest path. Edges stay in DataFrames and
each round is written to the shared folder, so lost executors cost a re-read and the driver
only sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import discard, stash

#: Members of a component that one task takes, about, when each is to learn something of the whole.
HOT = 10_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # After a large star every edge already points from the larger vertex to the smaller.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, left: str = "u", right: str = "v") -> tuple[DataFrame, str]:
    """(vertex, root) for each vertex of ``edges`` but the roots themselves, and the folder it is kept in.

    ``root`` is the smallest vertex that can be reached. Loops, repeated and reversed edges are
    allowed; edges with a null end are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    start = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(f"{left} is not null and {right} is not null").where("u <> v").distinct()
    now, path = stash(start, "edges")
    while not _is_star(now):
        old = path
        now, path = stash(_small_star(_large_star(now)), "edges")
        discard(spark, old)
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")), path


def _is_star(edges: DataFrame) -> bool:
    """Whether each vertex has one parent at most and no parent has one itself."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    odd = roles.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or child = 1 and parent = 1")
    return odd.limit(1).count() == 0


def of_component(members: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """``members`` (with ``root``) and ``out``: an aggregate over all members of the same root.

    Values are aggregated before the shuffle; a component of more than HOT members is dealt to several
    tasks by hash of ``key``. The table of such components, which is broadcast, has a row for HOT members at least.
    """
    totals = members.groupBy("root").agg(value.alias(out), F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / HOT).cast("int")
    large = totals.where(f"_n > {HOT}").select("root", parts.alias("_parts"))
    spread = totals.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")
    dealt = members.join(F.broadcast(large), "root", "left").withColumn("_part", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return dealt.join(spread, ["root", "_part"]).drop("_part")
