"""Plug-in points: stages of tables in and out, cost terms, encoders, and the chain after a track ends."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from skein.functions import vectors
from skein.operators import fusion, predicates, tracks


class Stage(Protocol):
    """A table in, a table out; stages keep no state of their own."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def chained(df: DataFrame, stages: Iterable[Stage]) -> DataFrame:
    """The stages one after another."""
    return reduce(lambda made, stage: made.transform(stage), stages, df)


class Cost(Protocol):
    """What it costs to match two rows, as an expression over their columns; in [0, 1]."""

    def __call__(self) -> Column: ...


def overlap_cost(iou: str = "iou") -> Cost:
    return lambda: 1 - F.col(iou)


def appearance_cost(a: str = "vector_a", b: str = "vector_b") -> Cost:
    return lambda: 1 - F.greatest(F.lit(0.0), vectors.cosine(F.col(a), F.col(b)))


def fused_cost(iou: str = "iou", score: str = "score", a: str = "vector_a", b: str = "vector_b", weight: float = 0.7, high: float = 0.25) -> Cost:
    """Overlap weighted by score and appearance; without vectors by the score alone where it is high."""

    def cost() -> Column:
        both = F.coalesce((F.size(a) > 0) & (F.size(a) == F.size(b)), F.lit(False))
        like = F.greatest(F.lit(0.0), vectors.cosine(F.col(a), F.col(b)))
        alone = F.when(F.col(score) > high, F.col(score)).otherwise(F.lit(1.0))
        return 1 - F.col(iou) * F.when(both, weight * F.col(score) + (1 - weight) * like).otherwise(alone)

    return cost


#: Name parts of encoders and the kinds they stand for; others are the last kind.
ENCODERS = (("eva", "eva_clip"), ("siglip", "siglip2"), ("clip", "clip"), ("vit-", "clip"))


def encoder_kind(model: str) -> str:
    name = model.lower()
    return next((kind for part, kind in ENCODERS if part in name), "siglip2")


class Encoders:
    """Encoders by kind, each a function from texts to vectors, given by who has the models."""

    def __init__(self) -> None:
        self._made: dict[str, Callable[[str], list[float]]] = {}

    def add(self, kind: str, encode: Callable[[str], list[float]]) -> None:
        self._made[kind] = encode

    def encoder(self, model: str) -> Callable[[str], list[float]]:
        kind = encoder_kind(model)
        if kind not in self._made:
            raise ValueError(f"no encoder of kind {kind}")
        return self._made[kind]

    def column(self, model: str, text: Column) -> Column:
        """Vectors of a column of texts, in Arrow batches."""
        encode = self.encoder(model)

        @F.pandas_udf(ArrayType(FloatType()))
        def encoded(texts):
            return texts.map(lambda t: None if t is None else [float(x) for x in encode(t)])

        return encoded(text)


#: Trackers by the name that a configuration gives.
TRACKERS = {"bytetrack": False, "enhanced_bytetrack": True, "bytetrackx": True}


def uses_appearance(tracker: str) -> bool:
    """Whether the tracker of this name weighs appearance; unknown names are an error."""
    if tracker not in TRACKERS:
        raise ValueError(f"no tracker is called {tracker}")
    return TRACKERS[tracker]


def finished(histories: DataFrame, mode: str = "attention", fold: dict | None = None) -> DataFrame:
    """What becomes of tracks that ended: ``feed, track_id, class_label, master_track_id, n, embedding, segments`` ...

    ``histories``: feed, track_id, class_label, is_activated, frame, ts, x, y, w, h, embedding (null
    where there is none), a row per observation; track_id is unique. Tracks that were never
    activated go; the others' vectors are pooled, their paths compressed, and broken tracks of a
    feed and class get the master that they continue.
    """
    rows = histories.filter(predicates.confirmed())
    seen = rows.withColumn("vec_id", F.col("frame"))
    pooled = fusion.pooled(seen, mode).select("track_id", "embedding", F.col("n").alias("n_vectors"))
    models = tracks.compressed(rows)
    ends = rows.groupBy("feed", "track_id").agg(
        F.max_by("class_label", "frame").alias("class_label"), F.min_by(F.struct("ts", "frame", "x", "y"), F.struct("frame", "ts")).alias("a"), F.max_by(F.struct("ts", "frame", "x", "y"), F.struct("frame", "ts")).alias("b"),
    )
    side = lambda s, p: [F.col(f"{s}.ts").alias(p), F.col(f"{s}.frame").alias(f"{p}_frame"), F.col(f"{s}.x").alias(f"{p}_x"), F.col(f"{s}.y").alias(f"{p}_y")]
    spans = ends.select("feed", "track_id", "class_label", *side("a", "start"), *side("b", "end"))
    fused = fusion.fuse_within_feed(spans.join(pooled.select("track_id", "embedding"), "track_id", "left"), mode=mode, **(fold or {}))
    own = spans.select("feed", "track_id", "class_label").join(fused.select("track_id", "master_track_id"), "track_id")
    return own.join(pooled, "track_id", "left").join(models.drop("n"), "track_id", "left")
