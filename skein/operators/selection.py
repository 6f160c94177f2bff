"""Quality gates and scores of crops and tracks, and diverse representatives."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gates:
    """Limits and weights of the crop gates and of the score."""

    area: float = 1600
    width: float = 30
    height: float = 30
    aspect: tuple[float, float] = (0.25, 4.0)
    intensity: tuple[float, float] = (12.0, 248.0)
    sharpness: float = 35.0
    weights: tuple[float, float, float, float, float] = (0.35, 0.25, 0.15, 0.15, 0.10)


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def gated(df: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Add ``prune_reason``, of the first failing gate, and ``quality``, 0 where pruned.

    Needs ``width, height, mean, contrast, sharpness, confidence, x1, y1``.
    """
    area, aspect = F.col("width") * F.col("height"), F.col("width") / F.greatest("height", F.lit(1))
    reason = (
        F.when((area < gates.area) | (F.col("width") < gates.width) | (F.col("height") < gates.height), "size")
        .when(~aspect.between(*gates.aspect), "aspect")
        .when(~F.col("mean").between(*gates.intensity), "exposure")
        .when(F.col("sharpness") < gates.sharpness, "blur")
    )
    border = F.when((F.col("x1") <= 2) | (F.col("y1") <= 2), 0.5).otherwise(1.0)
    parts = (_unit((F.col("sharpness") - gates.sharpness) / 400), _unit(area / 50176), _unit(F.col("contrast") / 70), _unit(F.col("confidence")), border)
    score = sum((w * p for w, p in zip(gates.weights, parts, strict=True)), F.lit(0.0))
    return df.withColumn("prune_reason", reason).withColumn("quality", F.when(F.col("prune_reason").isNull(), F.round(score, 4)).otherwise(0.0))


def best_per(df: DataFrame, keys: list[str], n: int, by: str, tie: str) -> DataFrame:
    """The n best rows of each key."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(by), tie))).filter(F.col("rank") <= n)


def track_quality(df: DataFrame) -> DataFrame:
    """Add ``quality`` in [0, 1] from a track's counters; needs those of ``TRACK_COUNTERS``."""
    n = F.greatest("num_detections", F.lit(1))
    duration = _unit(F.greatest(F.lit(1), F.col("frame_id") - F.col("start_frame") + 1) / 100)
    stable = _unit(F.col("stability_sum") / n)
    consistent = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("max_consecutive") / 50) - 0.02 * F.col("recall_count"))
    score = 0.3 * F.col("total_conf") / n + 0.2 * duration + 0.3 * stable + 0.2 * consistent
    return df.withColumn("quality", F.round(_unit(score), 6))


TRACK_COUNTERS = ("num_detections", "total_conf", "start_frame", "frame_id", "stability_sum", "max_consecutive", "recall_count")


def spaced(times: np.ndarray, gap: float) -> np.ndarray:
    """Of ascending times the places of the first and of each ``gap`` or more after the last kept."""
    kept, last = [], -np.inf
    for i, t in enumerate(times):
        if t - last >= gap:
            kept.append(i)
            last = t
    return np.array(kept, dtype=int)


def farthest(vectors: np.ndarray, k: int) -> list[int]:
    """k rows by farthest-point sampling on cosine distance from row 0; no row twice."""
    if len(vectors) <= k:
        return list(range(len(vectors)))
    picked, away = [0], 1 - vectors @ vectors[0]
    away[0] = -np.inf
    while len(picked) < k:
        i = int(away.argmax())
        picked.append(i)
        away = np.minimum(away, 1 - vectors @ vectors[i])
        away[i] = -np.inf
    return picked


VIEWS = "identity long, vec_id long, rank int"


def representatives(df: DataFrame, k: int = 3, gap: float = 1.5) -> DataFrame:
    """``VIEWS``: at most k diverse rows per identity.

    Identities of over k rows are thinned in time per camera, then sampled by farthest points
    from the best. Needs ``identity, vec_id, camera, ts, quality, embedding``.
    """

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["quality", "vec_id"], ascending=[False, True])
        if len(rows) > k:
            kept = [g.iloc[spaced(g["ts"].to_numpy(float), gap)] for _, g in rows.sort_values(["ts", "vec_id"]).groupby("camera")]
            rows = pd.concat(kept).sort_values(["quality", "vec_id"], ascending=[False, True])
            e = np.stack(rows["embedding"].to_numpy()).astype(float)
            n = np.linalg.norm(e, axis=1, keepdims=True)
            rows = rows.iloc[farthest(np.divide(e, n, out=np.zeros_like(e), where=n > 0), k)]
        return pd.DataFrame({"identity": key[0], "vec_id": rows["vec_id"], "rank": np.arange(1, len(rows) + 1)})

    return df.select("identity", "vec_id", "camera", "ts", "quality", "embedding").groupBy("identity").applyInPandas(one, VIEWS)
