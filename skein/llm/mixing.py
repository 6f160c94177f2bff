"""Mixing sources to target weights by systematic sampling.

Sources in code-point order, null last, weigh 5, 2, 1, repeating. Together they share
``BUDGET`` times all words; a target stops at ``MOST`` times its source's words and the excess
is shared again by weight, which is water filling: target = min(cap, level * weight).

Every document of a source is expected target / size copies. Documents of a source are put in a
fixed order, their expected copies are prefix-summed, one random offset per source is added, and
a document is emitted once per integer that its stretch of the sum crosses. Ordering by size
class first makes each class sampled evenly, so the words taken come near the target.

A hot source is never gathered: its order is cut into cells of (size class, hash bucket), the
cells are counted and prefix-summed (``CLASSES`` x ``BUCKETS`` rows per source at most), and only
the documents of one cell are ranked together.

Defined cases: a null text has size 0; a null source is a source of its own, the last; rows that
repeat, also with the same doc_id, are documents of their own; a source of no words has target 0
and no copies; an empty table gives an empty result; other columns pass through ``expand``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import quality
from skein.session import materialize

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
BUCKETS = 64
SEED = "mix-1"
_CELL = ["_source", "_none", "_class", "_bucket"]


def _portion(value: Column, digits: int) -> Column:
    """The first hex digits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` with ``_size`` in words, and the cell of each document.

    The class is the size's power of two and its next three bits.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.select(*keep, F.col("doc_id").alias("_id"), F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), F.size(quality.words(text)).cast("long").alias("_size"))
    power = F.length(F.bin(F.col("_size") + 1))
    part = F.floor((F.col("_size") + 1) * 8 / F.pow(F.lit(2.0), power - 1)).cast("int") - 8
    return df.withColumn("_class", power * 8 + part).withColumn("_bucket", (_portion(F.coalesce(F.col("_id").cast("string"), F.lit("")), 4) % BUCKETS).cast("int"))


def cells(df: DataFrame) -> DataFrame:
    """Per cell: ``_n`` documents and ``_words``; the hot keys are combined before the shuffle."""
    return df.groupBy(*_CELL).agg(F.count("*").alias("_n"), F.sum("_size").alias("_words"))


def targets(counted: DataFrame, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """Per source: ``_words``, ``_target`` and the sampling ``_offset``; one row per source."""
    sources = counted.groupBy("_source", "_none").agg(F.sum("_words").alias("_words"))
    ordered = W.orderBy("_none", "_source")
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    df = sources.withColumn("_weight", F.get(weights, ((F.row_number().over(ordered) - 1) % len(WEIGHTS)).cast("int")))
    df = df.withColumn("_ratio", F.col("_words") * most / F.col("_weight"))
    filled = W.orderBy("_ratio", "_none", "_source")
    whole = W.partitionBy()
    df = df.select(
        "*",
        (budget * F.sum("_words").over(whole)).alias("_all"),
        (F.sum(F.col("_words") * most).over(filled.rowsBetween(W.unboundedPreceding, -1))).alias("_capped"),
        F.sum("_weight").over(filled.rowsBetween(0, W.unboundedFollowing)).alias("_open"),
    )
    # the first source, by ratio, that the level of the open ones doesn't fill sets the level
    left = F.col("_all") - F.coalesce("_capped", F.lit(0))
    df = df.withColumn("_level", F.when(left / F.col("_open") <= F.col("_ratio"), F.struct(left.alias("left"), F.col("_open").alias("open"))))
    df = df.withColumn("_level", F.first("_level", ignorenulls=True).over(filled.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    share = F.col("_weight") * F.col("_level.left") / F.col("_level.open")
    cap = (F.col("_words") * most).cast("double")
    offset = _portion(F.concat_ws("|", F.lit(SEED), F.col("_source"), F.col("_none").cast("string")), 8) / F.lit(float(16**8))
    return df.select("_source", "_none", F.col("_words").alias("_total"), F.when(F.col("_level").isNull() | (share >= cap), cap).otherwise(share).alias("_target"), offset.alias("_offset"))


def _copies(df: DataFrame, counted: DataFrame) -> DataFrame:
    """Add ``_total``, ``_target`` and ``_copies`` to sized documents."""
    run = W.partitionBy("_source", "_none").orderBy("_class", "_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counted.select(*_CELL, F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    placed = before.join(targets(counted), ["_source", "_none"])
    rank = F.row_number().over(W.partitionBy(*_CELL).orderBy("_size", "_id"))
    df = df.join(placed, _CELL).withColumn("_rank", F.col("_before") + rank)
    each = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(F.lit(0.0))
    upto = lambda r: F.floor(r * each + F.col("_offset"))
    return df.withColumn("_copies", (upto(F.col("_rank")) - upto(F.col("_rank") - 1)).cast("long"))


def report(docs: DataFrame) -> DataFrame:
    """Sizes, targets and the words taken of each document."""
    df = materialize(sized(docs, ["doc_id"]), "mix")
    return _copies(df, cells(df)).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def expand(docs: DataFrame) -> DataFrame:
    """The mix: each row of ``docs`` as often as it is emitted."""
    counted = materialize(cells(sized(docs, [])), "mix-cells")
    named = docs.select("doc_id", "text", "source", F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    df = _copies(sized(named, ["_row"]), counted).filter(F.col("_copies") > 0)
    return df.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_i")).select("_row.*")
