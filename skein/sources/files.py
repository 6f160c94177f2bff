"""Readers and writers of registries, match files, annotation tables and array archives."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "feed string, kind string, track_id string, ordinal int, embedding array<float>"
MATCHES = "array<struct<feed_a:string,track_a:long,class_a:string,feed_b:string,track_b:long,class_b:string,similarity:double>>"
IDENTITIES = f"global_id string, class_label string, tracks array<string>, camera_ids array<string>, num_tracks int, matches {MATCHES}"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """``feed, track_id, model`` of {feed: [{track_id, compressed_track}]}; the model stays JSON."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,array<struct<track_id:long,compressed_track:string>>>")
    feeds = text.select(F.explode(parsed).alias("feed", "tracks"))
    return feeds.select("feed", F.explode("tracks").alias("t")).select("feed", "t.track_id", F.col("t.compressed_track").alias("model"))


def identities(spark: SparkSession, path: str) -> DataFrame:
    """Clusters of matched tracks, one per element of the file's array."""
    return spark.read.schema(IDENTITIES).option("multiLine", True).json(path)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of {uuid: {frames, boxes}}; entries of unequal lengths are left out."""
    parsed = F.from_json("value", "map<string,struct<frames:array<string>,boxes:array<array<double>>,nl:array<string>>>")
    every = spark.read.text(path, wholetext=True).select(F.explode(parsed).alias("uuid", "t"))
    fine = every.filter((F.size("t.frames") > 0) & (F.size("t.frames") == F.size("t.boxes")))
    rows = fine.select("uuid", F.posexplode(F.arrays_zip("t.frames", "t.boxes")).alias("ordinal", "r"))
    box = [F.col("r.boxes")[i] for i in range(4)]
    frame = F.regexp_extract("r.frames", r"(\d+)\.(?:jpg|png|jpeg)$", 1).try_cast("long")
    return rows.select(
        "uuid", "ordinal", frame.alias("frame"), F.regexp_extract("r.frames", r"/(S\d+)/", 1).alias("sequence"), F.regexp_extract("r.frames", r"/(c\d+)/", 1).alias("camera"),
        *(c.alias(n) for c, n in zip((box[0], box[1], box[0] + box[2], box[1] + box[3]), ("x1", "y1", "x2", "y2"), strict=True)),
    )


def ground_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """``frame, id, x1..y2`` of headerless frame, id, x, y, w, h; shorter rows are left out."""
    raw = spark.read.schema("frame long, id long, x double, y double, w double, h double").csv(path)
    return raw.filter(F.col("h").isNotNull()).select("frame", "id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                for key in archive.files:
                    feed, _, track = key.rpartition("_")
                    kind = "app" if feed.endswith("_app") else "other"
                    m = np.atleast_2d(archive[key]).astype(np.float32)
                    yield pd.DataFrame({"feed": feed.removesuffix("_app"), "kind": kind, "track_id": track, "ordinal": range(len(m)), "embedding": list(m)})


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """``VECTORS`` of .npz archives with keys feed_app_track; archives are read apart, whole."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_arrays, VECTORS)


def write_identities(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
