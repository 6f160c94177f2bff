"""Retrieval over tables of tracks and embeddings: named tools, and vectors attached to tracks.

A tool takes arguments and gives a table; errors are a table too, so a caller always gets rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import vectors
from skein.operators import predicates, tables
from skein.operators.temporal import nearest

#: Seconds that a vector may lie outside its track, and by which two may miss.
REACH = 15.0
#: Fields of a result that are kept, and characters of each.
KEPT, LONGEST = ("id", "camera_id", "camera_timestamp", "track_id", "class_label"), 3000


def of_kind(kind: str, dimension: int, model: str | None = None) -> Column:
    """Embeddings of a type and dimension, and of a model if one is named."""
    fine = (F.col("embedding_type") == kind) & (F.col("vector_dim") == dimension)
    return fine if model is None else fine & (F.col("model_name") == model)


def search(embeddings: DataFrame, vector: list[float], k: int = 20, where: Column | None = None, kind: str = "retrieval", model: str | None = None) -> DataFrame:
    """The k nearest embeddings of a type and the query's dimension, with ``distance``."""
    df = embeddings.filter(of_kind(kind, len(vector), model))
    df = df if where is None else df.filter(where)
    q = F.array(*(F.lit(float(x)) for x in vector))
    return df.withColumn("distance", vectors.cosine_distance(F.col("embedding"), q)).orderBy("distance", "id").limit(k)


def projected(hits: DataFrame) -> DataFrame:
    """Search results as candidates."""
    return hits.select(
        "id", "camera_id", F.col("camera_timestamp_sec").alias("camera_timestamp"), "camera_timestamp_iso", "track_id", "video_pos_ms", "bbox", F.col("distance").alias("retrieval_distance"),
        F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("similarity"),
    )


def truncated(df: DataFrame, most: int = LONGEST) -> DataFrame:
    """The fields that are kept, texts cut."""
    return df.select(*(F.substring(c, 1, most).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c) for c in KEPT if c in df.columns))


def cameras_meet(a: Column, b: Column) -> Column:
    """Whether one camera's name is part of the other's; none meets the empty name."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def attached(scored: DataFrame, tracks: DataFrame, k: int, boost: Column | None = None, base: float = 0.1) -> DataFrame:
    """``id, score, rank``: the k best tracks for a question whose ``scored`` vectors are given.

    ``scored(track_key, camera_id, ts, similarity)``, ``tracks(id, track_id, camera_id, start_time,
    end_time, class_label)``. A vector belongs to the tracks of its key, and to those of its camera
    (or part of its name; cam_1 stands for any) that run within ``REACH`` of its time; a track's
    score is its best vector's, ``base`` without one, plus the boost. Cameras are few, so their
    names meet first, and vectors meet tracks by pairs of cameras and slots of time.
    """
    sides = [scored.select("track_key", "similarity", F.col("track_key").alias("key"))]
    keys = tracks.select(F.col("id").alias("track"), F.explode(F.array_distinct(F.array("id", F.col("track_id").cast("string")))).alias("key"))
    by_key = sides[0].join(keys, "key").select("track", "similarity")
    cameras = scored.filter("ts is not null and camera_id <> ''").select(F.col("camera_id").alias("a")).distinct()
    own = tracks.select(F.coalesce("camera_id", F.lit("")).alias("b")).distinct()
    meet = (F.col("a") == "cam_1") | F.contains(F.col("b"), F.col("a")) | F.contains(F.col("a"), F.col("b"))
    pairs = cameras.join(own, meet)
    slot = lambda t: F.floor(t / (4 * REACH))
    timed = scored.filter("ts is not null").select(F.col("camera_id").alias("a"), "ts", "similarity").join(pairs, "a").withColumn("slot", slot(F.col("ts")))
    end = F.coalesce("end_time", "start_time", F.lit(0.0))
    spans = tracks.select(F.col("id").alias("track"), F.coalesce("camera_id", F.lit("")).alias("b"), F.coalesce("start_time", F.lit(0.0)).alias("s"), end.alias("e"))
    spans = spans.withColumn("slot", F.explode(F.sequence(slot(F.col("s") - REACH), slot(F.col("e") + REACH))))
    near = timed.join(spans, ["b", "slot"]).filter(F.col("ts").between(F.col("s") - REACH, F.col("e") + REACH)).select("track", "similarity")
    best = by_key.union(near).groupBy("track").agg(F.max("similarity").alias("best"))
    score = F.coalesce("best", F.lit(base)) + (F.lit(0.0) if boost is None else boost)
    every = tracks.join(best, F.col("id") == F.col("track"), "left").withColumn("score", F.round(score, 6))
    top = every.orderBy(F.desc("score"), "id").limit(k)
    return top.select("id", "score", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"))


def same_occurrence(a: str, b: str) -> Column:
    """Whether the tracks of two struct columns are one: by id, or by camera and time within ``REACH``."""
    of = lambda side, c: F.col(f"{side}.{c}")
    start = F.greatest(of(a, "start_time"), of(b, "start_time"))
    end = F.least(F.coalesce(of(a, "end_time"), of(a, "start_time")), F.coalesce(of(b, "end_time"), of(b, "start_time")))
    return (of(a, "id") == of(b, "id")) | (cameras_meet(of(a, "camera_id"), of(b, "camera_id")) & (start <= end + REACH))


def video_position(rows: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Add ``pos_ms`` to ``rows(camera_id, timestamp)``, a text or number: epoch seconds, seconds or milliseconds.

    Over 100 000 it is an epoch, placed by the camera's embedding nearest in time (as it is where
    there is none); up to 3600 it is seconds; between, milliseconds. ISO 8601 times are epochs; what
    is no time is 0.
    """
    text = F.trim(F.col("timestamp").cast("string"))
    iso = F.unix_micros(F.try_to_timestamp(text)) / 1e6
    df = rows.withColumn("_t", F.coalesce(text.try_cast("double"), iso, F.lit(0.0)))
    known = embeddings.filter(F.col("camera_timestamp_sec").isNotNull()).select("camera_id", F.col("camera_timestamp_sec").alias("_at"), F.coalesce("video_pos_ms", F.lit(0.0)).alias("_pos"))
    late = df.filter(F.col("_t") > 100_000).withColumn("_at", F.col("_t"))
    met = nearest(late.select("camera_id", "timestamp", "_t", "_at", *(c for c in rows.columns if c not in ("camera_id", "timestamp"))), known, ["camera_id"], "_at", ["_pos"])
    placed = F.when(F.col("match").isNotNull(), F.col("match._pos") + (F.col("_t") - F.col("match.t")) * 1000).otherwise(F.col("_t"))
    met = met.withColumn("pos_ms", F.greatest(F.lit(0.0), placed)).select(*rows.columns, "pos_ms")
    early = df.filter(F.col("_t") <= 100_000).withColumn("pos_ms", F.when(F.col("_t") <= 3600, F.col("_t") * 1000).otherwise(F.col("_t")))
    return met.unionByName(early.select(*rows.columns, "pos_ms"))


def frame_references(asked: DataFrame, frames: DataFrame) -> DataFrame:
    """The stored frame ``path`` of each ``asked(camera_id, pos_ms)``, by whole milliseconds; null where there is none."""
    known = frames.select("camera_id", F.round("pos_ms").cast("long").alias("_ms"), "path")
    return asked.withColumn("_ms", F.round("pos_ms").cast("long")).join(known, ["camera_id", "_ms"], "left").drop("_ms")


@dataclass(frozen=True)
class Result:
    """What a tool gives: rows, or a message."""

    name: str
    rows: DataFrame | None = None
    error: str | None = None


Encoder = Callable[[str], list[float]]


class Tools:
    """The tools over one store; ``encode`` makes vectors of texts."""

    def __init__(self, tracks: DataFrame, embeddings: DataFrame, encode: Encoder | None = None, frames: DataFrame | None = None) -> None:
        self.tracks, self.embeddings, self.encode, self.frames = tracks, embeddings, encode, frames
        self._handlers: dict[str, Callable[..., DataFrame]] = {
            "encode_and_search_vector_store": self.search,
            "query_metadata": self.metadata,
            "get_temporal_context": self.context,
            "inspect_visual_candidate": self.frame,
            "get_entire_frame": self.frame,
        }

    def execute(self, name: str, arguments: dict) -> Result:
        handler = self._handlers.get(name)
        if handler is None:
            return Result(name, error=f"unknown tool '{name}'")
        try:
            return Result(name, handler(**arguments))
        except Exception as wrong:  # a caller gets the message instead
            return Result(name, error=f"tool failed: {wrong}")

    def search(self, query_text: str = "", top_k: int = 10, camera_id: str | None = None, **_: object) -> DataFrame:
        asked = predicates.parse_question(query_text)
        if self.encode is None:
            raise ValueError("no encoder")
        return projected(search(self.embeddings, self.encode(asked.text), top_k, predicates.question_filter(asked, camera_id)))

    def metadata(self, camera_id: str | None = None, start_timestamp: float | None = None, end_timestamp: float | None = None, class_label: str | None = None, top_k: int = 20, **_: object) -> DataFrame:
        terms: list[dict] = [{k: v} for k, v in (("camera_id", camera_id), ("class_label", class_label)) if v]
        terms += [{"camera_timestamp": {op: float(v)}} for op, v in (("$gte", start_timestamp), ("$lt", end_timestamp)) if v is not None]
        both = [c for c in self.tracks.columns if c in self.embeddings.columns]
        return tables.with_fallback(self.tracks.select(both), self.embeddings.select(both), predicates.compile_where({"$and": terms}), ["id"], top_k)

    def context(self, camera_id: str = "", reference_time_ms: float = 0.0, time_window_ms: float = 5000.0, class_label: str | None = None, **_: object) -> DataFrame:
        at, reach = reference_time_ms / 1000, time_window_ms / 1000
        return self.metadata(camera_id, at - reach, at + reach, class_label, 50)

    def frame(self, camera_id: str = "", video_pos_ms: float | None = None, timestamp: object = None, **_: object) -> DataFrame:
        if self.frames is None:
            raise ValueError("no frames are stored")
        spark = self.frames.sparkSession
        if video_pos_ms is None:
            asked = video_position(spark.createDataFrame([(camera_id, None if timestamp is None else str(timestamp))], "camera_id string, timestamp string"), self.embeddings)
        else:
            asked = spark.createDataFrame([(camera_id, float(video_pos_ms))], "camera_id string, pos_ms double")
        return frame_references(asked, self.frames)
