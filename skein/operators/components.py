"""Connected components of an edge table, by alternating large and small stars.

Every round is one grouped minimum and one join; each is written to the shared folder, so no
lineage grows and nothing comes to the driver but a count. The rounds grow with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import discard, materialize


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the least node seen: the larger ones, or the smaller and the node."""
    both = pairs.select("u", "v")
    if large:
        both = both.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        made = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return made.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` of every node of ``edges(x, y)``; the label is the least node."""
    pairs = materialize(edges.select(F.col("x").alias("u"), F.col("y").alias("v")).filter("u <> v").distinct(), "edges")
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(pairs)
    while True:
        last, pairs = pairs, materialize(_star(_star(pairs, True), False), "stars")
        discard(last)
        after = digest(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
