"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a group-wise minimum (combined before the shuffle) joined back to the links, so no
vertex's neighbours are ever gathered: a hub is only a skewed join key, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: each vertex hands the least vertex it sees to its larger (or its smaller) neighbours."""
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    seen = both.join(least, "a")
    if large:
        out = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a long, b long) -> (node long, component long): component is the least id reachable.

    Self links, repeated links and links with a null end are ignored; an empty table gives no rows.
    Vertices without a link have no row.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "links")
    print_of = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    before = print_of(now)
    for _ in range(max_rounds):
        if not before["n"]:
            break
        now = written(_star(_star(now, True), False), "links")
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
