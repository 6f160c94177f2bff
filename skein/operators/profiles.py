"""Identities as profiles: their views, mean vectors and summaries; attributes compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import vectors
from skein.operators import fusion


def built(crops: DataFrame, class_label: str = "vehicle") -> DataFrame:
    """``global_id, profile, embedding, views`` per identity.

    ``crops``: global_id, path, track_id, camera_id, frame, ts, quality, embedding, rank (from 1,
    the order of the views). The mean vector has unit length where it isn't zero.
    """
    doc = F.concat(F.col("global_id"), F.lit("_v"), F.col("rank") - 1)
    view = F.struct(F.col("rank").alias("_rank"), doc.alias("doc_id"), (F.col("rank") - 1).alias("view_idx"), "embedding", "quality", "camera_id", "track_id", "frame", "ts", "path")
    by = crops.groupBy("global_id").agg(
        F.sort_array(F.collect_set("camera_id")).alias("camera_ids"), F.sort_array(F.collect_set("track_id")).alias("track_ids"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count("*").alias("num_representative_views"), F.round(F.avg("quality"), 4).alias("avg_quality_score"), F.sort_array(F.collect_list(view)).alias("views"),
    )
    span = F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))
    profile = F.struct("global_id", "camera_ids", "track_ids", "start_time", "end_time", span.alias("duration_sec"), "num_representative_views", F.lit(class_label).alias("class_label"), "avg_quality_score")
    mean = fusion.averaged(crops.filter(F.size("embedding") > 0), "global_id")
    n = vectors.norm(F.col("embedding"))
    unit = F.when(n > 0, F.transform("embedding", lambda x: x / n)).otherwise(F.col("embedding"))
    return by.select("global_id", profile.alias("profile"), "views").join(mean.select("global_id", unit.alias("embedding")), "global_id", "left")


def attribute_similarity(a: Column, b: Column) -> Column:
    """The share of equal ones among colour and type where both maps have them; 0.5 where neither."""
    both = [(F.element_at(a, k), F.element_at(b, k)) for k in ("color", "type")]
    known = [x.isNotNull() & y.isNotNull() for x, y in both]
    equal = reduce(lambda s, t: s + t, [F.when(k, (F.lower(x) == F.lower(y)).cast("double")).otherwise(0.0) for k, (x, y) in zip(known, both, strict=True)])
    n = reduce(lambda s, t: s + t, [k.cast("int") for k in known])
    return F.when(n > 0, equal / n).otherwise(F.lit(0.5))


def gallery_matches(queries: DataFrame, buffered: DataFrame, least: float = 0.8) -> DataFrame:
    """``query_id, track_id, similarity, rank``: buffered tracks of the query's class, alike enough, best first.

    ``queries(query_id, class_label, embedding)``; ``buffered(track_id, class_label, fused, vectors)``:
    the fused vector counts, else the mean of the others.
    """
    mean = buffered.filter(F.col("fused").isNull() & (F.size("vectors") > 0)).select("track_id", F.explode("vectors").alias("embedding"))
    made = fusion.averaged(mean, "track_id").withColumnRenamed("embedding", "_mean")
    known = buffered.join(made, "track_id", "left").select("track_id", "class_label", F.coalesce(F.col("fused").cast("array<double>"), F.col("_mean")).alias("_v"))
    met = queries.join(known.filter("_v is not null"), "class_label").withColumn("similarity", vectors.cosine(F.col("embedding"), F.col("_v")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "track_id"))
    return met.filter(F.col("similarity") >= least).select("query_id", "track_id", "similarity", rank.alias("rank"))


def registered(observations: DataFrame, merged: DataFrame | None = None, size: int = 2048) -> DataFrame:
    """``feed, track_id, class_label, n, vectors``: what a registry holds after all observations.

    ``observations(feed, track_id, frame, class_label, embedding)``; a missing vector is ``size`` zeros,
    the last class counts, and with ``merged(track_id, master)`` members add to their master.
    """
    df = observations
    if merged is not None:
        df = df.join(merged.select("track_id", "master"), "track_id", "left").withColumn("track_id", F.coalesce("master", "track_id"))
    vector = F.coalesce(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), size))
    held = F.sort_array(F.collect_list(F.struct("frame", vector.alias("v"))))
    return df.groupBy("feed", "track_id").agg(F.max_by("class_label", "frame").alias("class_label"), F.count("*").alias("n"), F.transform(held, lambda x: x.v).alias("vectors"))
