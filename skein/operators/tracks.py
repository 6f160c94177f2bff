"""Trajectories: kinematics by windows, compression to piecewise models, reconstruction.

Kinematics, statistics and scores are window expressions per track. Segmentation restarts at each
cut, so it is a sequential function of one track, applied per track in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from skein.functions import geometry, vectors
from skein.session import spread

KEY = ["track_id"]


def _run(key: list[str]) -> W:
    return W.partitionBy(*key).orderBy("ts", "frame")


def velocities(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Forward differences ``vx, vy`` of x and y and ``heading``; the last row repeats the one before."""
    w = _run(key)
    dt = F.greatest(F.lead("ts").over(w) - F.col("ts"), F.lit(1e-6))
    df = df.withColumn("_vx", (F.lead("x").over(w) - F.col("x")) / dt).withColumn("_vy", (F.lead("y").over(w) - F.col("y")) / dt)
    fill = lambda c: F.coalesce(F.col(c), F.lag(c).over(w), F.lit(0.0))
    df = df.withColumn("vx", fill("_vx")).withColumn("vy", fill("_vy")).drop("_vx", "_vy")
    return df.withColumn("heading", F.atan2("vy", "vx"))


def central(df: DataFrame, column: str, key: list[str] = KEY) -> Column:
    """Central difference by time; forward at the first row, backward at the last."""
    w = _run(key)
    ahead, back = F.coalesce(F.lead(column).over(w), F.col(column)), F.coalesce(F.lag(column).over(w), F.col(column))
    t1, t0 = F.coalesce(F.lead("ts").over(w), F.col("ts")), F.coalesce(F.lag("ts").over(w), F.col("ts"))
    return F.when(t1 > t0, (ahead - back) / (t1 - t0)).otherwise(F.lit(0.0))


def arc_length(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The path length ``arc`` up to each row."""
    w = _run(key)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("arc", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def longest_run(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Per key the longest run of consecutive frames."""
    w = W.partitionBy(*key).orderBy("frame")
    isle = df.select(*key, "frame").distinct().withColumn("_isle", F.col("frame") - F.row_number().over(w))
    return isle.groupBy(*key, "_isle").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("max_consecutive"))


def lifecycle(df: DataFrame, gap: float, key: list[str] = KEY) -> DataFrame:
    """Events of each track's rows: created, updated, lost after a gap of time, recovered."""
    w = _run(key)
    before, after = F.col("ts") - F.lag("ts").over(w), F.lead("ts").over(w) - F.col("ts")
    kind = F.when(before.isNull(), "created").when(before > gap, "recovered").otherwise("updated")
    lost = F.when(after.isNull() | (after > gap), F.array(kind, F.lit("lost"))).otherwise(F.array(kind))
    return df.withColumn("_events", lost).select(*key, "frame", "ts", F.explode("_events").alias("event_type"))


def linear_fit(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Slopes and intercepts of x and y over time; constant where time doesn't vary."""
    return df.groupBy(*key).agg(*(e for c in ("x", "y") for e in (
        F.coalesce(F.regr_slope(F.col(c), F.col("ts")), F.lit(0.0)).alias(f"{c}_slope"),
        F.coalesce(F.regr_intercept(F.col(c), F.col("ts")), F.avg(c)).alias(f"{c}_intercept"),
    )))


def cleared_frame(df: DataFrame, lam: float = 1.0, mu: float = 0.5, weight: float = 1.0, key: list[str] = KEY) -> DataFrame:
    """The row of each track with the largest, steadiest and surest box; the first wins ties.

    Needs ``w, h, conf``; the score is area * conf^weight over changes of size and of aspect.
    """
    df = df.withColumn("_dw", F.abs(central(df, "w", key))).withColumn("_dh", F.abs(central(df, "h", key))).withColumn("_a", F.col("w") / F.greatest("h", F.lit(1e-6)))
    df = df.withColumn("_median", F.expr("percentile(_a, 0.5)").over(W.partitionBy(*key)))
    steady = 1 + lam * (F.col("_dw") / F.greatest("w", F.lit(1e-6)) + F.col("_dh") / F.greatest("h", F.lit(1e-6)))
    aspect = 1 + mu * F.abs(F.col("_a") - F.col("_median")) / F.greatest("_median", F.lit(1e-6))
    df = df.withColumn("score", F.round(F.col("w") * F.col("h") * F.pow("conf", F.lit(weight)) / (steady * aspect), 6))
    best = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "ts", "frame"))
    return df.withColumn("_n", best).filter("_n = 1").drop("_n", "_dw", "_dh", "_a", "_median")


def smoothed(values: Column, alpha: float = 0.9) -> Column:
    """Exponential moving average of an ordered array."""
    step = lambda a, x: F.when(a.isNull(), x).otherwise(alpha * a + (1 - alpha) * x)
    return F.aggregate(values, F.lit(None).cast("double"), step)


# Piecewise models, as plain dictionaries of SEGMENT's fields.
SEGMENT = "struct<type:string,t0:double,t1:double,x:array<double>,y:array<double>,knots:array<double>,mx:array<double>,my:array<double>,max_error:double>"
COMPRESSED = f"track_id long, start_time double, end_time double, n long, segments array<{SEGMENT}>, size_type string, w array<double>, h array<double>, size_knots array<double>, total_distance double, avg_speed double, max_speed double, avg_acceleration double, mean_error double, max_error double"


def spline(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the not-a-knot cubic through (t, v), of one or more columns.

    Two points give a line, three the parabola through them. The end conditions give the outer two
    in terms of their neighbours, so the others solve a tridiagonal system, in linear time.
    """
    n = len(t)
    m = np.zeros(v.shape)
    if n < 3:
        return m
    d = np.diff(t)
    slope = np.diff(v, axis=0) / (d if v.ndim == 1 else d[:, None])
    if n == 3:
        return m + 2 * (slope[1] - slope[0]) / (t[2] - t[0])
    low, mid, high = d[:-1].copy(), 2 * (d[:-1] + d[1:]), d[1:].copy()
    right = 6 * np.diff(slope, axis=0)
    # m[0] = m[1] + (m[1] - m[2]) * d[0] / d[1], and alike at the end
    mid[0] += d[0] * (1 + d[0] / d[1])
    high[0] -= d[0] * d[0] / d[1]
    mid[-1] += d[-1] * (1 + d[-1] / d[-2])
    low[-1] -= d[-1] * d[-1] / d[-2]
    for i in range(1, n - 2):
        f = low[i] / mid[i - 1]
        mid[i] -= f * high[i - 1]
        right[i] -= f * right[i - 1]
    m[n - 2] = right[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (right[i] - high[i] * m[i + 2]) / mid[i]
    m[0] = m[1] + (m[1] - m[2]) * d[0] / d[1]
    m[-1] = m[-2] + (m[-2] - m[-3]) * d[-1] / d[-2]
    return m


def spline_at(t: np.ndarray, v: np.ndarray, at: np.ndarray, m: np.ndarray | None = None, slope: bool = False) -> np.ndarray:
    """Values, or slopes, of the cubic; times outside the knots are moved to the ends."""
    at = np.clip(at, t[0], t[-1])
    if len(t) == 1:
        return np.full(len(at), 0.0 if slope else v[0])
    m = spline(t, v) if m is None or not len(m) else m
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    d, left, right = t[i + 1] - t[i], t[i + 1] - at, at - t[i]
    if slope:
        return (m[i + 1] * right**2 - m[i] * left**2) / (2 * d) + (v[i + 1] - v[i]) / d - (m[i + 1] - m[i]) * d / 6
    return (m[i] * left**3 + m[i + 1] * right**3) / (6 * d) + (v[i] / d - m[i] * d / 6) * left + (v[i + 1] / d - m[i + 1] * d / 6) * right


def line(t: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of least squares; the mean where time doesn't vary."""
    spread = ((t - t.mean()) ** 2).sum()
    slope = float(((t - t.mean()) * (v - v.mean())).sum() / spread) if spread > 0 else 0.0
    return slope, float(v.mean() - slope * t.mean())


def _wrapped(a: float) -> float:
    return abs((a + math.pi) % (2 * math.pi) - math.pi)


#: Rows that are looked at one by one.
SHORT = 24


def segments(t: np.ndarray, xy: np.ndarray, turn: float = 0.5, speed_change: float = 0.4, error: float = 8.0, least: int = 3) -> list[tuple[int, int]]:
    """First and last row of each stretch of steady heading, speed and straightness.

    A stretch ends one row before the row that breaks it and the next begins there, so neighbours
    share a row. Stretches under ``least`` rows join the one before.
    """
    n = len(t)
    if n < least:
        return [(0, n - 1)] if n else []
    v = np.diff(xy, axis=0) / np.maximum(np.diff(t), 1e-6)[:, None]
    v = np.vstack([v, v[-1]])
    heading, speed = np.arctan2(v[:, 1], v[:, 0]).tolist(), np.hypot(v[:, 0], v[:, 1]).tolist()

    # sums over the rows before each, by which a stretch's line needs no pass over it
    shifted = t - t[0]
    centred = xy - xy.mean(axis=0)
    sums = np.vstack([np.zeros(6), np.cumsum(np.column_stack([shifted, shifted**2, centred, shifted[:, None] * centred]), axis=0)]).tolist()
    ts, xs, ys = shifted.tolist(), centred[:, 0].tolist(), centred[:, 1].tolist()

    def breaks(first: int, row: int) -> bool:
        if _wrapped(heading[row] - heading[first]) > turn or abs(speed[row] - speed[first]) / max(1.0, speed[first]) > speed_change:
            return True
        k = row + 1 - first
        st, stt, sx, sy, stx, sty = ((b - a) / k for a, b in zip(sums[first], sums[row + 1], strict=True))
        spread = stt - st * st
        flat = spread <= 1e-12 * max(1.0, stt)
        ux, uy = (0.0, 0.0) if flat else ((stx - st * sx) / spread, (sty - st * sy) / spread)
        if k <= SHORT:  # a few rows are quicker without arrays
            return any(
                (xs[i] - sx - ux * (ts[i] - st)) ** 2 + (ys[i] - sy - uy * (ts[i] - st)) ** 2 > error * error for i in range(first, row + 1)
            )
        part = shifted[first : row + 1] - st
        off_x, off_y = centred[first : row + 1, 0] - sx - ux * part, centred[first : row + 1, 1] - sy - uy * part
        return bool((off_x * off_x + off_y * off_y).max() > error * error)

    cuts, row = [0], 1
    while row < n:
        if row - cuts[-1] + 1 > least and breaks(cuts[-1], row):
            cuts.append(row - 1)
            row = cuts[-1] + 1
        else:
            row += 1
    made: list[tuple[int, int]] = []
    for a, b in zip(cuts, [*cuts[1:], n - 1], strict=True):
        if made and b - a + 1 < least:
            made[-1] = (made[-1][0], b)
        elif a < b or not made:
            made.append((a, b))
    return made


def fit(t: np.ndarray, xy: np.ndarray) -> dict:
    """The model of one stretch: constant where it stands still, a line for few rows, else a cubic."""
    base = {"t0": float(t[0]), "t1": float(t[-1]), "knots": [], "mx": [], "my": []}
    if xy.var(axis=0).sum() < 1.0:
        middle = xy.mean(axis=0)
        model = base | {"type": "constant", "x": [float(middle[0])], "y": [float(middle[1])]}
        off = xy - middle
    elif len(t) <= 3 or len(np.unique(t)) < len(t):
        a, b = line(t, xy[:, 0]), line(t, xy[:, 1])
        model = base | {"type": "linear", "x": list(a), "y": list(b)}
        off = xy - np.column_stack([a[0] * t + a[1], b[0] * t + b[1]])
    else:
        bend = spline(t, xy)
        model = base | {"type": "spline", "x": xy[:, 0].tolist(), "y": xy[:, 1].tolist(), "knots": t.tolist(), "mx": bend[:, 0].tolist(), "my": bend[:, 1].tolist()}
        off = np.zeros((1, 2))  # it goes through its knots
    model["max_error"] = float(np.hypot(off[:, 0], off[:, 1]).max())
    return model


def _line_of(model: dict) -> tuple[float, float, float, float]:
    """Slope and value at time 0 of x, then of y; zeros for a cubic."""
    if model["type"] == "constant":
        return 0.0, model["x"][0], 0.0, model["y"][0]
    return (*model["x"], *model["y"]) if model["type"] == "linear" else (0.0, 0.0, 0.0, 0.0)


def positions(models: list[dict], at: np.ndarray, slope: bool = False) -> np.ndarray:
    """Places, or velocities, at some times: in the first stretch that holds a time, else in the nearest."""
    starts, ends = np.array([m["t0"] for m in models]), np.array([m["t1"] for m in models])
    # stretches follow one another: the last that begins at or before a time, or the one before that ends there
    own = np.clip(np.searchsorted(starts, at, side="right") - 1, 0, len(models) - 1)
    before, after = np.maximum(own - 1, 0), np.minimum(own + 1, len(models) - 1)
    own = np.where((at <= ends[before]) & (at >= starts[before]), before, own)
    gap = at > ends[own]
    own = np.where(gap & (starts[after] - at < at - ends[own]) & (starts[after] > at), after, own)
    # constants and lines all at once, cubics one by one
    plain = np.array([_line_of(m) for m in models])
    rate, base = plain[:, 0::2][own], plain[:, 1::2][own]
    out = rate if slope else rate * at[:, None] + base
    cubic = np.array([m["type"] == "spline" for m in models])
    for k in np.unique(own[cubic[own]]):
        m, rows = models[k], own == k
        knots = np.asarray(m["knots"], dtype=float)
        for axis, (c, bend) in enumerate((("x", "mx"), ("y", "my"))):
            known = m.get(bend)
            out[rows, axis] = spline_at(knots, np.asarray(m[c], dtype=float), at[rows], None if known is None else np.asarray(known, dtype=float), slope)
    return out


def velocity_at(models: list[dict], at: np.ndarray) -> np.ndarray:
    return positions(models, at, slope=True)


def acceleration_at(models: list[dict], at: np.ndarray, step: float = 1e-3) -> np.ndarray:
    """Central differences of the velocity."""
    return (velocity_at(models, at + step) - velocity_at(models, at - step)) / (2 * step)


def curvature_at(models: list[dict], at: np.ndarray) -> np.ndarray:
    """How sharply the path bends; 0 where it hardly moves."""
    v, a = velocity_at(models, at), acceleration_at(models, at)
    speed = np.hypot(*v.T)
    turn = np.abs(v[:, 0] * a[:, 1] - v[:, 1] * a[:, 0])
    return np.divide(turn, speed**3, out=np.zeros(len(at)), where=speed >= 1e-6)


def frame_at(frames: np.ndarray, times: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The frame, halves to even, that plays at some times; times outside are moved to the ends."""
    return np.round(np.interp(at, times, frames)).astype(np.int64)


def time_at(frames: np.ndarray, times: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.interp(at, frames, times)


def confidence_at(times: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The detector's confidence between observations, in [0, 1]."""
    return np.clip(np.interp(at, times, values), 0.0, 1.0)


def sizes(t: np.ndarray, wh: np.ndarray, turning: bool) -> dict:
    """The model of widths and heights: cubic where the track turns or a line is far off."""
    if len(t) == 1:
        return {"size_type": "constant", "w": [float(wh[0, 0])], "h": [float(wh[0, 1])], "size_knots": []}
    lines = [line(t, wh[:, k]) for k in (0, 1)]
    if len(t) >= 4:
        off = [float(np.abs(wh[:, k] - np.maximum(1.0, np.polyval(lines[k], t))).mean()) for k in (0, 1)]
        poor = any(o > 5 or o / max(1.0, wh[:, k].mean()) > 0.1 for k, o in enumerate(off))
        if turning or poor:
            step = max(1, min(5, len(t) // 5))
            picked = sorted({*range(0, len(t), step), len(t) - 1})
            _, first = np.unique(t[picked], return_index=True)
            rows = np.array(picked)[first]
            if len(rows) >= 2:
                return {"size_type": "spline", "w": wh[rows, 0].tolist(), "h": wh[rows, 1].tolist(), "size_knots": t[rows].tolist()}
    return {"size_type": "linear", "w": list(lines[0]), "h": list(lines[1]), "size_knots": []}


def size_at(model: dict, at: np.ndarray) -> np.ndarray:
    """Widths and heights at some times, 1 at least but for constants."""
    out = []
    for values in (model["w"], model["h"]):
        values = np.asarray(values, dtype=float)
        if model["size_type"] == "constant":
            out.append(np.full(len(at), values[0]))
        elif model["size_type"] == "linear":
            out.append(np.maximum(1.0, np.polyval(values, at)))
        else:
            out.append(np.maximum(1.0, spline_at(np.asarray(model["size_knots"], dtype=float), values, at)))
    return np.stack(out, axis=1)


def statistics(models: list[dict], samples: int = 100) -> dict:
    """Distance, speeds and mean acceleration of the path, sampled evenly in time."""
    t0, t1 = models[0]["t0"], models[-1]["t1"]
    if t1 <= t0:
        return {"total_distance": 0.0, "avg_speed": 0.0, "max_speed": 0.0, "avg_acceleration": 0.0}
    at = np.linspace(t0, t1, samples)
    v = velocity_at(models, at)
    steps, speed = np.hypot(*np.diff(positions(models, at), axis=0).T), np.hypot(*v.T)
    change = np.hypot(*(np.diff(v, axis=0) / np.diff(at)[:, None]).T)
    return {"total_distance": float(steps.sum()), "avg_speed": float(speed.mean()), "max_speed": float(speed.max()), "avg_acceleration": float(change.mean())}


def _turning(xy: np.ndarray, t: np.ndarray) -> bool:
    """Whether two headings differ by over 45 degrees: the largest gap on the circle tells."""
    v = np.diff(xy, axis=0)
    h = np.sort(np.arctan2(v[:, 1], v[:, 0]))
    if len(h) < 2:
        return False
    far = np.searchsorted(h, h + math.pi / 4, side="right")
    back = np.searchsorted(h, h + 2 * math.pi - math.pi / 4, side="left")
    return bool((far < back).any() and any(_wrapped(a - h[k]) > math.pi / 4 for a, k in zip(h, np.minimum(far, len(h) - 1), strict=True)))


def compress(track: pd.DataFrame) -> dict:
    """The models of one track's rows ``ts, x, y, w, h``."""
    track = track.sort_values(["ts", "frame"])
    t, xy, wh = track["ts"].to_numpy(float), track[["x", "y"]].to_numpy(float), track[["w", "h"]].to_numpy(float)
    models = [fit(t[a : b + 1], xy[a : b + 1]) for a, b in segments(t, xy)]
    off = np.hypot(*(positions(models, t) - xy).T)
    return {"start_time": t[0], "end_time": t[-1], "n": len(t), "segments": models, "mean_error": float(off.mean()), "max_error": float(off.max())} | sizes(t, wh, _turning(xy, t)) | statistics(models)


def compressed(df: DataFrame) -> DataFrame:
    """One row of ``COMPRESSED`` per track; a track is one group, rows without time or place don't count."""

    def one(track: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"track_id": track["track_id"].iloc[0]} | compress(track)])[[c.split()[0] for c in COMPRESSED.replace(f"array<{SEGMENT}>", "x").split(", ")]]

    fine = df.filter(F.col("ts").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = spread(fine.select("track_id", "frame", "ts", "x", "y", "w", "h"), "track_id")
    return rows.groupBy("track_id").applyInPandas(one, COMPRESSED)


def reconstruct(models: DataFrame, times: DataFrame) -> DataFrame:
    """Boxes at the rows of ``times(track_id, ts)``."""
    schema = "track_id long, ts double, x1 double, y1 double, x2 double, y2 double"
    asked = times.groupBy("track_id").agg(F.sort_array(F.collect_list("ts")).alias("at"))

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                at = np.asarray(r["at"], dtype=float)
                c, wh = positions(list(r["segments"]), at), size_at(r, at)
                low, high = c - wh / 2, c + wh / 2
                yield pd.DataFrame({"track_id": r["track_id"], "ts": at, "x1": low[:, 0], "y1": low[:, 1], "x2": high[:, 0], "y2": high[:, 1]})

    return models.join(asked, "track_id").select("track_id", "segments", "size_type", "w", "h", "size_knots", "at").mapInPandas(boxes, schema)


#: Points of a path that are compared, and the distance of one sigma.
PATH_POINTS, PATH_SIGMA = 20, 150.0
#: Weights of trajectory, size, embedding, space and time.
PARTS = (0.35, 0.20, 0.30, 0.15)


def along(x: np.ndarray, y: np.ndarray, n: int = PATH_POINTS) -> np.ndarray:
    """``n`` points at equal arc lengths of a path, x before y; steps in single precision."""
    path = np.column_stack([x, y]).astype(np.float32)
    far = np.insert(np.cumsum(np.linalg.norm(np.diff(path, axis=0), axis=1)), 0, 0.0)
    if far[-1] <= 1e-6:
        return np.repeat(path[0].astype(float), n)
    at = np.linspace(0, far[-1], n)
    return np.concatenate([np.interp(at, far, path[:, 0]), np.interp(at, far, path[:, 1])])


@F.pandas_udf(ArrayType(DoubleType()))
def _along(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([along(x, y) if x is not None and len(x) else None for x, y in zip(xs, ys, strict=True)], dtype=object)


def similarity(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The four parts and the weighted ``overall`` of each of ``pairs(a, b)``.

    ``tracks``: track_id, path (array of x, y in order), w, h, embedding, start, end, camera. Where
    a path or vector is missing its part is 0.5 (``distance`` 999); sizes are 50 then, times 0.
    """
    df = tracks.select(
        "track_id", _along(F.transform("path", lambda p: p.x.cast("double")), F.transform("path", lambda p: p.y.cast("double"))).alias("points"),
        *(F.when(F.col("w").isNull() | F.col("h").isNull(), F.lit(50.0)).otherwise(F.col(c).cast("double")).alias(c) for c in ("w", "h")),
        "embedding", F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", "start", F.lit(0.0)).alias("end"), F.col("camera").cast("string").alias("camera"),
    )
    side = lambda e: df.select(F.col("track_id").alias(e), F.struct(*df.columns[1:]).alias(f"_{e}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    of = lambda c: (F.col(f"_a.{c}"), F.col(f"_b.{c}"))
    p, q = of("points")
    steps = F.transform(F.sequence(F.lit(1), F.lit(PATH_POINTS)), lambda i: F.hypot(F.element_at(p, i) - F.element_at(q, i), F.element_at(p, i + PATH_POINTS) - F.element_at(q, i + PATH_POINTS)))
    distance = F.when(p.isNotNull() & q.isNotNull(), F.aggregate(steps, F.lit(0.0), lambda s, d: s + d) / PATH_POINTS)
    apart = lambda c: F.abs(of(c)[0] - of(c)[1]) / (of(c)[0] + of(c)[1])
    fine = (of("w")[0] > 0) & (of("w")[1] > 0) & (of("h")[0] > 0) & (of("h")[1] > 0)
    (s1, s2), (e1, e2), (c1, c2) = of("start"), of("end"), of("camera")
    same = F.when((c1 == c2) & (c1 != ""), F.lit(1.0)).otherwise(F.lit(0.5))
    parts = {
        "trajectory": F.coalesce(F.exp(-0.5 * F.pow(distance / PATH_SIGMA, F.lit(2.0))), F.lit(0.5)),
        "size": F.when(fine, F.greatest(F.lit(0.0), 1 - (apart("w") + apart("h")) / 2)).otherwise(F.lit(0.5)),
        "embedding": vectors.similarity_score(*of("embedding")),
        "spatiotemporal": 0.7 * geometry.temporal_iou(s1, e1, s2, e2) + 0.3 * same,
    }
    both = both.select("a", "b", *(v.alias(k) for k, v in parts.items()), F.coalesce(distance, F.lit(999.0)).alias("distance"))
    overall = sum((w * F.col(k) for w, k in zip(PARTS, parts, strict=True)), F.lit(0.0)) / sum(PARTS)
    return both.withColumn("overall", F.least(F.lit(1.0), F.greatest(F.lit(0.0), overall)))


# Two tracks over the time they share


def intersection(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float] | None:
    """The closed time that two tracks share; one instant counts."""
    start, end = max(a[0], b[0]), min(a[1], b[1])
    return (start, end) if start <= end else None


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of 2-D vectors by row; 0 where one hardly moves."""
    sizes = np.hypot(*a.T), np.hypot(*b.T)
    fine = (sizes[0] >= 1e-6) & (sizes[1] >= 1e-6)
    return np.divide((a * b).sum(axis=1), sizes[0] * sizes[1], out=np.zeros(len(a)), where=fine)


def alongside(models: DataFrame, pairs: DataFrame, samples: int = PATH_POINTS) -> DataFrame:
    """``a, b, start, end, distance, alignment`` of pairs of ``COMPRESSED`` tracks.

    Mean distance and mean cosine of the velocities over the time both share, evenly sampled; all
    null where they share none.
    """
    side = lambda e: models.select(F.col("track_id").alias(e), F.struct("segments", "start_time", "end_time").alias(f"_{e}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, ma, mb in zip(*(batch[c].tolist() for c in ("a", "b", "_a", "_b")), strict=True):
                shared = intersection((ma["start_time"], ma["end_time"]), (mb["start_time"], mb["end_time"]))
                if shared is None:
                    rows.append((a, b, None, None, None, None))
                    continue
                at = np.linspace(*shared, samples if shared[0] < shared[1] else 1)
                pa, pb = positions(list(ma["segments"]), at), positions(list(mb["segments"]), at)
                like = _alike(velocity_at(list(ma["segments"]), at), velocity_at(list(mb["segments"]), at))
                rows.append((a, b, *shared, float(np.hypot(*(pa - pb).T).mean()), float(like.mean())))
            yield pd.DataFrame(rows, columns=["a", "b", "start", "end", "distance", "alignment"])

    return both.select("a", "b", "_a", "_b").mapInPandas(compared, "a long, b long, start double, end double, distance double, alignment double")


# Measures, samples and documents of compressed tracks


def fidelity(seen: DataFrame, models: DataFrame) -> DataFrame:
    """Per track how far the boxes rebuilt from its models are from those ``seen``, and how much smaller they are.

    ``seen``: track_id, ts, x, y, w, h. Six numbers per observation stand against the numbers of the models.
    """
    rebuilt = reconstruct(models, seen.select("track_id", "ts").distinct())
    box = geometry.from_center(*(F.col(c) for c in ("x", "y", "w", "h")))
    both = seen.join(rebuilt, ["track_id", "ts"]).withColumn("_iou", geometry.iou(box, [F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    cx, cy = geometry.centre([F.col(c) for c in ("x1", "y1", "x2", "y2")])
    off = F.hypot(cx - F.col("x"), cy - F.col("y"))
    by = both.groupBy("track_id").agg(
        F.avg(off).alias("mean_error"), F.max(off).alias("max_error"), F.avg(F.abs(F.col("x2") - F.col("x1") - F.col("w"))).alias("mean_width_error"),
        F.avg(F.abs(F.col("y2") - F.col("y1") - F.col("h"))).alias("mean_height_error"), F.avg("_iou").alias("mean_iou"), F.min("_iou").alias("min_iou"), F.count("*").alias("n"),
    )
    of = lambda s: F.when(s.type == "constant", 4).when(s.type == "linear", 6).otherwise(2 + 3 * F.size(s.knots))
    size = F.when(F.col("size_type") == "constant", 2).when(F.col("size_type") == "linear", 4).otherwise(3 * F.size("size_knots"))
    numbers = F.aggregate(F.transform("segments", of), F.lit(0), lambda a, n: a + n) + size
    sizes_ = models.select("track_id", numbers.alias("_numbers"))
    return by.join(sizes_, "track_id").withColumn("compression_ratio", 6 * F.col("n") / F.greatest(F.lit(1), "_numbers")).drop("n", "_numbers")


def _sampled_times(frames: np.ndarray, times: np.ndarray, gap: float) -> list[tuple[int, float]]:
    """(frame, time) every ``gap`` seconds, moved to the nearest frame, no frame twice; all for no gap."""
    if gap <= 0:
        return list(zip(frames.tolist(), times.tolist(), strict=True))
    found: list[tuple[int, float]] = []
    t, last = float(times[0]), None
    while t <= times[-1] + 1e-9:
        frame = int(frame_at(frames, times, np.array([t]))[0])
        if frame == last:
            t += max(gap, 0.1)
            continue
        at = float(time_at(frames, times, np.array([frame]))[0])
        found.append((frame, at))
        t, last = max(at + gap, t + 1e-9), frame
    return found


def sampled(models: DataFrame, observed: DataFrame, gap: float) -> DataFrame:
    """``track_id, frame, ts, x1 .. y2``: boxes of compressed tracks every ``gap`` seconds, at whole frames.

    ``observed(track_id, frame, ts)`` tells when which frame played.
    """
    schema = "track_id long, frame long, ts double, x1 double, y1 double, x2 double, y2 double"
    played = observed.groupBy("track_id").agg(F.sort_array(F.collect_set(F.struct("frame", "ts"))).alias("played"))

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                frames, times = np.array([p["frame"] for p in r["played"]]), np.array([p["ts"] for p in r["played"]], dtype=float)
                taken = _sampled_times(frames, times, gap)
                at = np.array([t for _, t in taken])
                c, wh = positions(list(r["segments"]), at), size_at(r, at)
                low, high = c - wh / 2, c + wh / 2
                yield pd.DataFrame({"track_id": r["track_id"], "frame": [f for f, _ in taken], "ts": at, "x1": low[:, 0], "y1": low[:, 1], "x2": high[:, 0], "y2": high[:, 1]})

    return models.join(played, "track_id").select("track_id", "segments", "size_type", "w", "h", "size_knots", "played").mapInPandas(boxes, schema)


def active(tracks: DataFrame, at: Column) -> DataFrame:
    """Tracks that run at a time: started, and not yet ended."""
    return tracks.filter((F.col("start_time") <= at) & (at < F.col("end_time")))


def trail_times(now: Column, start: Column, end: Column, length: float = 3.0, per_second: int = 40) -> Column:
    """Times of the last ``length`` seconds of a track up to ``now``, evenly apart; none before it starts."""
    a, b = F.greatest(start, now - length), F.least(now, end)
    n = F.greatest(F.lit(2), F.ceil((b - a) * per_second).cast("int"))
    return F.when(b > a, F.transform(F.sequence(F.lit(0), n - 1), lambda i: a + (b - a) * i / (n - 1)))


def document() -> Column:
    """A row of ``COMPRESSED`` (with ``class_label``, ``camera``, ``frames``, ``times``, ``confidences``) as JSON.

    Fields that a kind of model doesn't have are left out. Fixed values: the names of the fields.
    """
    first = lambda v, i=0: F.get(v, F.lit(i))

    def segment(s: Column) -> Column:
        still, line = s.type == "constant", s.type == "linear"
        numbers = F.struct(
            F.when(still, first(s.x)).alias("cx"), F.when(still, first(s.y)).alias("cy"), F.when(line, first(s.x)).alias("a"), F.when(line, first(s.x, 1)).alias("b"),
            F.when(line, first(s.y)).alias("c"), F.when(line, first(s.y, 1)).alias("d"),
        )
        points = F.transform(F.arrays_zip(s.knots.alias("t"), s.x.alias("x"), s.y.alias("y")), lambda p: F.array(p.t, p.x, p.y))
        return F.struct(s.type.alias("type"), s.t0.alias("t0"), s.t1.alias("t1"), F.when(still | line, numbers).alias("parameters"), F.when(~(still | line), points).alias("control_points"), s.max_error.alias("max_error"))

    def size(v: str) -> Column:
        still, line = F.col("size_type") == "constant", F.col("size_type") == "linear"
        numbers = F.struct(F.when(still, first(F.col(v))).alias("val"), F.when(line, first(F.col(v))).alias("a"), F.when(line, first(F.col(v), 1)).alias("b"))
        points = F.zip_with("size_knots", v, lambda t, x: F.array(t, x))
        return F.struct(F.col("size_type").alias("type"), F.when(still | line, numbers).alias("parameters"), F.when(~(still | line), points).alias("control_points"))

    played = F.col("times").alias("timestamps")
    return F.to_json(F.struct(
        "track_id", F.col("class_label").alias("class"), "camera", "start_time", "end_time", F.struct(F.transform("segments", segment).alias("segments")).alias("trajectory"),
        size("w").alias("width_model"), size("h").alias("height_model"), F.struct("frames", played).alias("time_model"), F.struct(played, "confidences", "frames").alias("confidence_model"),
        F.struct("avg_speed", "max_speed", "total_distance", "avg_acceleration").alias("statistics"),
    ))


_PART = "struct<type:string,t0:double,t1:double,max_error:double,parameters:map<string,double>,control_points:array<array<double>>>"
_SIZE = "struct<type:string,parameters:map<string,double>,control_points:array<array<double>>>"
#: The form of a track's document.
DOCUMENT = (
    f"track_id long, class string, camera string, start_time double, end_time double, trajectory struct<segments:array<{_PART}>>, width_model {_SIZE}, height_model {_SIZE}, "
    "time_model struct<frames:array<long>,timestamps:array<double>>, confidence_model struct<timestamps:array<double>,confidences:array<double>,frames:array<long>>, "
    "statistics struct<avg_speed:double,max_speed:double,total_distance:double,avg_acceleration:double>"
)


def parsed(documents: DataFrame, text: str = "model") -> DataFrame:
    """Compressed tracks of JSON documents, with ``class_label``, ``camera``, ``frames``, ``times``, ``confidences``.

    Times of width and height points are joined, 1 where one is missing; unlike size models are
    constants of 1; without confidences all are 1.
    """
    d = documents.select(F.from_json(text, DOCUMENT).alias("d")).filter(F.col("d.track_id").isNotNull()).select("d.*")
    of = lambda s, *names: F.array(*(F.element_at(s.parameters, n) for n in names))
    column = lambda s, i: F.transform(s.control_points, lambda p: F.get(p, F.lit(i)))
    none = F.array().cast("array<double>")

    def segment(s: Column) -> Column:
        pick = lambda c, line, k: F.when(s.type == "constant", of(s, c)).when(s.type == "linear", of(s, *line)).otherwise(column(s, k))
        knots = F.when(s.type == "spline", column(s, 0)).otherwise(none)
        return F.struct(s.type.alias("type"), s.t0.alias("t0"), s.t1.alias("t1"), pick("cx", "ab", 1).alias("x"), pick("cy", "cd", 2).alias("y"), knots.alias("knots"), none.alias("mx"), none.alias("my"), F.coalesce(s.max_error, F.lit(0.0)).alias("max_error"))

    w, h = F.col("width_model"), F.col("height_model")
    times = F.array_sort(F.array_union(column(w, 0), column(h, 0)))
    at = lambda s: F.map_from_entries(F.transform(s.control_points, lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    kind = F.when((w.type == h.type) & w.type.isin("constant", "linear", "spline"), w.type).otherwise(F.lit("constant"))
    same = w.type == h.type

    def values(s: Column) -> Column:
        constant = F.when(same & (s.type == "constant"), of(s, "val")).otherwise(F.array(F.lit(1.0)))
        spline_ = F.transform(times, lambda t: F.coalesce(F.try_element_at(at(s), t), F.lit(1.0)))
        return F.when(kind == "linear", of(s, "a", "b")).when(kind == "spline", spline_).otherwise(constant)

    sure, played = F.col("confidence_model"), F.col("time_model.timestamps")
    ones = F.transform(played, lambda t: F.lit(1.0))
    return d.select(
        "track_id", F.col("class").alias("class_label"), "camera", "start_time", "end_time", F.size(played).cast("long").alias("n"), F.transform("trajectory.segments", segment).alias("segments"),
        kind.alias("size_type"), values(w).alias("w"), values(h).alias("h"), F.when(kind == "spline", times).otherwise(none).alias("size_knots"),
        *(F.coalesce(F.col(f"statistics.{c}"), F.lit(0.0)).alias(c) for c in ("total_distance", "avg_speed", "max_speed", "avg_acceleration")),
        F.col("time_model.frames").alias("frames"), played.alias("times"), F.coalesce(sure.confidences, ones).alias("confidences"),
    )
