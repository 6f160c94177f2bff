"""Range, interval and nearest-time joins, thinning and sampling of ordered rows.

Range joins become equi joins: time is cut into slots as wide as the reach, rows of one side are
spread to the slots they can meet, and the exact predicate follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.arrays import scan

#: Slots of neighbouring levels differ by this factor.
GROWTH = 16


def band_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, reach: float) -> DataFrame:
    """Pairs of equal keys with right time in [left time - reach, left time + reach); times in seconds.

    Columns of ``right`` other than the keys get the suffix ``_2``.
    """
    slot = lambda t: F.floor(t / reach)
    a = left.withColumn("_slot", F.explode(F.array(*(slot(F.col(time)) + i for i in (-1, 0, 1)))))
    b = right.select(*keys, *(F.col(c).alias(f"{c}_2") for c in right.columns if c not in keys))
    b = b.withColumn("_slot", slot(F.col(f"{time}_2")))
    near = (F.col(f"{time}_2") >= F.col(time) - reach) & (F.col(f"{time}_2") < F.col(time) + reach)
    return a.join(b, [*keys, "_slot"]).filter(near).drop("_slot")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, slack: float, width: float) -> DataFrame:
    """Pairs whose closed intervals, widened by ``slack`` in all, meet; each pair once.

    Slots of ``width`` grow by ``GROWTH`` per level. An interval belongs to the level whose slots are
    as long as itself, so it spans two of them; pairs meet in the slots of the higher level, in
    that of the later start. So an interval makes two rows a level, however long it is.
    """
    right = right.select(*keys, *(F.col(c).alias(f"{c}_2") for c in right.columns if c not in keys))
    own = lambda s, e: F.greatest(F.lit(0), F.ceil(F.log((F.col(e) + slack - F.col(s)) / width) / math.log(GROWTH))).cast("int")
    a, b = left.withColumn("_own", own(start, end)), right.withColumn("_own", own(f"{start}_2", f"{end}_2"))
    levels = sorted({r["_own"] for side in (a, b) for r in side.select("_own").distinct().collect() if r["_own"] is not None})
    wide = lambda level: F.lit(width) * F.pow(F.lit(float(GROWTH)), level)
    slot = lambda t: F.floor(t / wide(F.col("_level")))

    def spread(df: DataFrame, s: str, e: str) -> DataFrame:
        df = df.withColumn("_level", F.explode(F.filter(F.array(*(F.lit(x) for x in levels or [0])), lambda x: x >= F.col("_own"))))
        return df.withColumn("_slot", F.explode(F.sequence(slot(F.col(s)), slot(F.col(e) + slack))))

    met = spread(a, start, end).join(spread(b, f"{start}_2", f"{end}_2").withColumnRenamed("_own", "_other"), [*keys, "_level", "_slot"])
    meet = F.greatest(start, f"{start}_2") <= F.least(end, f"{end}_2") + slack
    once = (F.col("_slot") == slot(F.greatest(F.col(start), F.col(f"{start}_2")))) & (F.col("_level") == F.greatest("_own", "_other"))
    return met.filter(meet & once).drop("_slot", "_level", "_own", "_other")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, payload: list[str]) -> DataFrame:
    """For each left row the right row of equal keys nearest in time; the earlier wins ties.

    Both sides are merged and swept once in each direction, so no pairs are made. ``payload``
    columns of the match are returned as a struct ``match``, which is null without one.
    """
    own = F.struct(F.col(time).alias("t"), *(F.col(c).alias(c) for c in payload))
    rows = F.struct(*(F.col(c) for c in left.columns))
    a = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), rows.alias("_row"))
    b = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), own.alias("_m"))
    both = a.unionByName(b, allowMissingColumns=True)
    # both sweeps look back, the second from the end: Spark computes a frame that ends with its partition anew for each row
    order = ("_t", "_side", "_m")
    swept = lambda *by: F.last("_m", ignorenulls=True).over(W.partitionBy(*keys).orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    back, ahead = swept(*order), swept(*map(F.desc, order))
    both = both.withColumn("_b", back).withColumn("_a", ahead).filter("_side = 1")
    take_back = F.col("_a").isNull() | (F.col("_t") - F.col("_b.t") <= F.col("_a.t") - F.col("_t"))
    return both.withColumn("match", F.when(F.col("_b").isNotNull() & take_back, F.col("_b")).otherwise(F.col("_a"))).select("_row.*", "match")


def thinned(times: Column, gap: float) -> Column:
    """Of ascending times the first, and then each at least ``gap`` after the last kept."""

    def step(last: Column, t: Column) -> tuple[Column, Column]:
        far = last.isNull() | (t - last >= gap - 1e-6)
        return F.when(far, t).otherwise(last), F.when(far, t)

    kept = scan(times, F.lit(None).cast("double"), step, "double")
    return F.filter(kept, lambda t: t.isNotNull())


def every_kth(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Rows 1, 1 + k, 1 + 2k ... of each key."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("frame", n).filter(F.pmod(F.col("frame") - 1, F.lit(k)) == 0)
