"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelcorr.llm.common import written

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``links (a, b)``: the smallest id reachable.

    Alternates the large-star and small-star steps: every id links its larger
    neighbours to its smallest one, then its smaller neighbours. Each step is an
    aggregate and a join on the id, folded before the shuffle, so an id with many
    links is never gathered. Ends when a round leaves the links as they were, seen
    by their number and the sum of their hashes as they are written; that takes a
    number of rounds logarithmic in the ids. Self links are one-id components,
    nulls are no links.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL")
    found, before = _apart(links), None
    for _ in range(MAX_ROUNDS):
        seen = Observation()
        after = _small_star(_large_star(found))
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        found = written(after.observe(seen, F.count("*").alias("n"), mark.alias("mark")), "links")
        now = seen.get["n"], seen.get["mark"]
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = found.select(F.col("a").alias("id"), F.col("b").alias("component"))
    selves = links.select(F.explode(F.array("a", "b")).alias("id")).withColumn(
        "component", F.col("id")
    )
    return stars.unionByName(selves).groupBy("id").agg(F.min("component").alias("component"))


def _apart(df: DataFrame) -> DataFrame:
    """Links of different ids as (larger, smaller); some may stand there twice."""
    return df.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(
        F.col("a").alias("_a"), F.least("a", "_m").alias("_m")
    )
    larger = both.filter(F.col("b") > F.col("a"))
    stars = larger.join(least, F.col("a") == F.col("_a")).select(
        F.col("b").alias("a"), F.col("_m").alias("b")
    )
    return _apart(stars)


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_a")
    ends = F.array(
        F.struct("a", F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b"))
    )
    stars = links.join(least, F.col("a") == F.col("_a")).select(F.explode(ends).alias("l"))
    return _apart(stars.select("l.a", "l.b")).distinct()
