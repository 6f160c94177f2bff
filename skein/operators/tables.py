"""Building the tables of videos, tracks and embeddings; upserts, fallbacks and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import naming
from skein.operators.ranking import numbered

CLIP_SECONDS = 120.0


def upsert(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_n", newest).filter("_n = 1").drop("_n")


def catalogue(names: list[DataFrame]) -> DataFrame:
    """Distinct names of several one-column sources, in order, with offsets of 120 s each."""
    every = names[0]
    for more in names[1:]:
        every = every.unionByName(more)
    df = numbered(every.distinct(), [F.col("video_name")], "_n").withColumn("video_index", F.col("_n") - 1)
    start = F.col("video_index") * CLIP_SECONDS
    return df.select("video_name", naming.camera_id(F.col("video_name")).alias("camera_id"), "video_index", start.alias("start_timestamp_sec"), naming.iso_time(start).alias("start_timestamp_iso"))


def with_offsets(rows: DataFrame, videos: DataFrame, seconds: str) -> DataFrame:
    """Add ``camera_timestamp_sec``: seconds plus the video's start, 0 for unknown videos."""
    known = videos.select("video_name", "start_timestamp_sec")
    df = rows.join(known, "video_name", "left")
    return df.withColumn("camera_timestamp_sec", F.col(seconds) + F.coalesce("start_timestamp_sec", F.lit(0.0))).drop("start_timestamp_sec")


def with_fallback(first: DataFrame, second: DataFrame, where: Column, order: list[str], limit: int) -> DataFrame:
    """The first table's matching rows; the second's where the first has none."""
    a = first.filter(where)
    none = a.agg(F.count("*").alias("_n")).filter("_n = 0").select(F.lit(1).alias("_x"))
    b = second.filter(where).crossJoin(F.broadcast(none)).drop("_x")
    return a.unionByName(b).orderBy(*order).limit(limit)


def parsed_json(text: Column) -> Column:
    """JSON as a variant; text that isn't JSON as {"raw": text}."""
    raw = F.to_json(F.struct(text.alias("raw")))
    return F.coalesce(F.try_parse_json(text), F.parse_json(raw))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the least of equals."""
    by = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return by.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("_m")).select(*keys, f"_m.{value}", "_m.n")


def merged_history(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, the secondary's where both have one."""
    both = primary.withColumn("_p", F.lit(0)).unionByName(secondary.withColumn("_p", F.lit(1)))
    return upsert(both, keys, ["_p"]).drop("_p")


def missing(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has gone."""
    return previous.join(current.select(*keys).distinct(), keys, "left_anti")


def unique_names(paths: DataFrame) -> DataFrame:
    """Feed names of paths: the file, with its folder where files repeat, numbered where both do."""
    df = paths.withColumn("_base", F.substring_index("path", "/", -1)).withColumn("_folder", F.substring_index(F.substring_index("path", "/", -2), "/", 1))
    repeats = F.count("*").over(W.partitionBy("_base")) > 1
    df = df.withColumn("_name", F.when(repeats, F.concat_ws("_", "_folder", "_base")).otherwise(F.col("_base")))
    n = F.row_number().over(W.partitionBy("_name").orderBy("path"))
    return df.withColumn("_n", n).select("path", F.when(F.col("_n") > 1, F.concat_ws("_", "_name", F.col("_n") - 1)).otherwise(F.col("_name")).alias("feed"))
