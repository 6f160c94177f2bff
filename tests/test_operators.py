import math
import tracemalloc
from datetime import datetime, timezone
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.functions import geometry, naming
from skein.operators import clustering, fusion, metrics, predicates, search, selection, tables, temporal, tracks


def test_spline_reproduces_cubics():
    t = np.array([0.0, 1, 2.5, 3, 5, 7])
    f = lambda x: 2 * x**3 - x**2 + 3
    at = np.linspace(0, 7, 50)
    assert np.allclose(tracks.spline_at(t, f(t), at), f(at))
    assert np.allclose(tracks.spline_at(t[:3], t[:3] ** 2, at[:10]), np.clip(at[:10], 0, 2.5) ** 2)
    assert np.allclose(tracks.spline_at(t[:2], t[:2], np.array([0.5])), 0.5)


def test_segments_and_models():
    t = np.arange(20.0)
    straight = np.stack([t * 5, t * 0], axis=1)
    assert tracks.segments(t, straight) == [(0, 19)]
    corner = np.vstack([straight[:10], [[45, 5 * k] for k in range(1, 11)]])
    cut = tracks.segments(t, corner)
    assert len(cut) > 1 and cut[0][0] == 0 and cut[-1][1] == 19 and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
    still = tracks.fit(t, np.zeros((20, 2)))
    assert still["type"] == "constant" and tracks.statistics([still])["total_distance"] == 0
    track = pd.DataFrame({"ts": t, "frame": range(20), "x": corner[:, 0], "y": corner[:, 1], "w": 20.0, "h": 10.0 + t})
    made = tracks.compress(track)
    assert made["max_error"] < 8 and made["size_type"] == "spline"
    assert tracks.compress(track[:1])["size_type"] == "constant" and tracks.compress(track[:3])["size_type"] == "linear"


def test_compress_and_reconstruct(spark):
    rows = [(1, i, float(i), 5.0 * i, 2.0 * i, 20.0, 10.0) for i in range(12)] + [(2, 0, 0.0, 1.0, 1.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "track_id long, frame long, ts double, x double, y double, w double, h double")
    boxes = tracks.reconstruct(tracks.compressed(df), df.select("track_id", "ts")).collect()
    by = {(r.track_id, r.ts): r for r in boxes}
    for track, _, ts, x, y, w, h in rows:
        r = by[track, ts]
        assert np.allclose([r.x1, r.y1, r.x2, r.y2], [x - w / 2, y - h / 2, x + w / 2, y + h / 2], atol=1e-6)


def test_pooling():
    e = np.eye(3)
    assert np.allclose(fusion.attention_pool(e[:1]), e[0])
    assert np.allclose(fusion.attention_pool(np.array([e[0]] * 4)), e[0])
    a = np.random.default_rng(0).normal(size=(50, 8))
    w = np.exp(a @ a.T / math.sqrt(8))
    want = (w / w.sum(1, keepdims=True) @ a).mean(0)
    assert np.allclose(fusion.attention_pool(a, block=7), want / (np.linalg.norm(want) + 1e-8))


def test_fuse_within_feed(spark):
    cols = "feed string, class_label string, track_id long, start double, end double, start_frame long, end_frame long, start_x double, start_y double, end_x double, end_y double, embedding array<double>"
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("f", "car", 1, 0.0, 5.0, 0, 50, 0.0, 0.0, 10.0, 0.0, a), ("f", "car", 2, 6.0, 9.0, 60, 90, 12.0, 0.0, 30.0, 0.0, a), ("f", "car", 3, 9.5, 12.0, 95, 120, 31.0, 0.0, 40.0, 0.0, a), ("f", "car", 4, 6.0, 9.0, 60, 90, 12.0, 0.0, 30.0, 0.0, b), ("f", "bus", 5, 6.0, 9.0, 60, 90, 12.0, 0.0, 30.0, 0.0, a), ("f", "car", 6, 13.0, 14.0, 130, 140, 999.0, 0.0, 999.0, 0.0, a)]
    got = {r.track_id: r.master_track_id for r in fusion.fuse_within_feed(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_questions():
    now = datetime(2026, 8, 3, 15, 30, tzinfo=timezone.utc)
    ask = lambda q: predicates.parse_question(q, now)
    assert ask("the camera is red").filters == {} and ask("a camel ride").filters == {}
    assert ask("red truck on camera 3").filters == {"camera_id": "cam_3"} and ask("red truck on camera 3").text == "red truck"
    assert ask("car at gate 3").filters["camera_id"] == "gate3"
    day = now.replace(hour=0, minute=0).timestamp()
    assert ask("bus between 9am and 5pm").filters["camera_timestamp"] == {"$gte": day + 9 * 3600, "$lt": day + 17 * 3600}
    assert ask("between 22 and 24").filters["camera_timestamp"]["$lt"] == day + 86400
    assert ask("yesterday morning").filters["camera_timestamp"] == {"$gte": day - 86400 + 6 * 3600, "$lt": day - 86400 + 12 * 3600}
    assert ask("van in the night").filters == {"time_of_day": "night"}
    assert ask("last 5 minutes").filters["camera_timestamp"] == {"$gte": now.timestamp() - 300, "$lt": now.timestamp()}
    assert ask("").text == ""


def test_question_filter(spark):
    q = predicates.parse_question("car on camera 2 today", datetime(2026, 8, 2, 5, tzinfo=timezone.utc))
    rows = spark.createDataFrame([("cam_2", 10.0), ("cam_2", 90000.0), ("cam_1", 10.0)], "camera_id string, camera_timestamp_sec double")
    assert rows.filter(predicates.question_filter(q, base_epoch=naming.BASE_EPOCH)).count() == 1
    assert rows.filter(predicates.question_filter(q, "cam_1", naming.BASE_EPOCH)).count() == 1


def test_names(spark):
    rows = spark.createDataFrame([("clip7.mp4",), ("S01_c012.avi",), ("door.mp4",)], "n string")
    assert [r[0] for r in rows.select(naming.camera_id(F.col("n"))).collect()] == ["c007", "c012", "door"]
    one = spark.range(1).select(naming.iso_time(F.lit(0.0)), naming.iso_time(F.lit(61.5))).first()
    assert tuple(one) == ("2026-08-02T00:00:00+00:00", "2026-08-02T00:01:01.500000+00:00")


def test_boxes(spark):
    at = lambda *v: [F.lit(float(x)) for x in v]
    r = spark.range(1).select(geometry.iou(at(0, 0, 10, 10), at(5, 0, 15, 10)), geometry.iou(at(0, 0, 0, 0), at(0, 0, 0, 0)), geometry.angle_between(F.lit(3.0), F.lit(-3.0)), *geometry.clamped(at(-3, 2.5, 999, 3.5), 100, 50)).first()
    assert r[0] == pytest.approx(1 / 3) and r[1] == 0 and r[2] == pytest.approx(2 * math.pi - 6) and tuple(r[3:]) == (0, 2, 100, 4)


def test_sampling(spark):
    assert selection.spaced(np.array([0, 1.0, 1.5, 2.9, 3.0]), 1.5).tolist() == [0, 2, 4]
    same = np.ones((5, 2)) / math.sqrt(2)
    assert selection.farthest(same, 3) == [0, 1, 2]
    v = np.array([[1, 0], [0.99, 0.1], [0, 1.0], [-1, 0]])
    assert selection.farthest(v, 2) == [0, 3]
    df = spark.createDataFrame([(0.0,), (1.0,), (1.4,), (2.9,), (3.0,)], "t double").agg(F.sort_array(F.collect_list("t")).alias("t"))
    assert df.select(temporal.thinned(F.col("t"), 1.5)).first()[0] == [0.0, 2.9]


def test_nearest_takes_the_earlier(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 0.0), (2, 5.0), (1, 99.0)], "k int, t double")
    right = spark.createDataFrame([(1, 8.0, "a"), (1, 12.0, "b"), (1, 100.0, "c")], "k int, t double, v string")
    got = {(r.k, r.t): r.match and r.match.v for r in temporal.nearest(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {(1, 10.0): "a", (1, 0.0): "a", (2, 5.0): None, (1, 99.0): "c"}


def test_nearest_sweeps_a_long_key_once(spark):
    rng = np.random.default_rng(3)
    asked, known = rng.integers(0, 500, 300) / 4, np.sort(rng.integers(0, 500, 200) / 4)
    left = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(asked)] + [(1, -1, None)], "k int, i int, t double")
    right = spark.createDataFrame([(1, float(t), f"{t}") for t in known], "k int, t double, v string")
    met = temporal.nearest(left, right, ["k"], "t", ["v"])
    assert "unboundedfollowing" not in met._jdf.queryExecution().toString().lower()  # its cost is quadratic in the rows of a key
    got = {r.i: r.match.v for r in met.collect() if r.i >= 0}
    assert got == {i: f"{min(known, key=lambda x: (abs(x - t), x))}" for i, t in enumerate(asked)}


def test_tracking_scores(spark):
    box = lambda f, i, x: ("f", f, i, x, 0.0, x + 10, 10.0)
    schema = "feed string, frame long, id long, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([box(f, i, 100.0 * i) for f in range(4) for i in (1, 2)], schema)
    assert {k: round(v) for k, v in metrics.tracking(truth, truth).first().asDict().items()} == {"IDF1": 100, "IDP": 100, "IDR": 100, "HOTA": 100, "DetA": 100, "AssA": 100, "MOTA": 100, "IDTP": 8, "IDFP": 0, "IDFN": 0}
    swapped = spark.createDataFrame([box(f, i if f < 3 else 3 - i, 100.0 * i) for f in range(4) for i in (1, 2)], schema)
    r = metrics.tracking(truth, swapped).first()
    assert (r.IDTP, r.IDFP, r.MOTA) == (6, 2, 100)
    none = metrics.tracking(truth, truth.limit(0)).first()
    assert (none.IDTP, none.IDFN, none.MOTA) == (0, 8, 0)


def test_reid_scores(spark):
    ranked = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 2, 0), (3, 1, 0)], "query_id int, rank int, hit int")
    r = metrics.reid(ranked).first()
    assert (r.rank1, r.rank5, r.n_queries) == (50, 100, 2) and r.map == pytest.approx(100 * ((1 / 2 + 2 / 3) / 2 + 1) / 2, abs=1e-5)
    assert metrics.reid(ranked.limit(0)).first().map == 0


def test_chunks_give_the_exact_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(search, "CHUNK", 4 * 6 * 8)
    hits = search.knn_sets(df.filter("vec_id < 9"), df.repartition(5), 5).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(9):
        best = hits[hits.query_id == i].sort_values("rank").item_id.tolist()
        assert best == np.argsort(1 - u @ u[i], kind="stable")[:5].tolist()


def test_pair_sums_hold_one_tile(monkeypatch):
    rng = np.random.default_rng(2)
    n, tile = 3000, 1 << 20
    v, labels = rng.normal(size=(n, 4)), rng.integers(0, 3, n)
    monkeypatch.setattr(search, "TILE", tile, raising=False)
    shared = SimpleNamespace(value=search.Queries(np.arange(n), v, labels))
    batch = pd.DataFrame({"id": np.arange(n), "v": list(v), "label": labels})
    tracemalloc.start()
    sums = pd.concat(search._PairSums(shared)(iter([batch[:1], batch[1:]])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * tile < 8 * n * n  # all pairs at once would be 72 MB
    sums = sums.groupby(["query_label", "item_label"]).agg({"n": "sum", "s1": "sum", "s2": "sum", "least": "min", "most": "max"})
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s, other = u @ u.T, ~np.eye(n, dtype=bool)
    for (a, b), r in sums.iterrows():
        part = s[(labels[:, None] == a) & (labels == b) & other]
        assert r.n == len(part) and (r.least, r.most) == pytest.approx((part.min(), part.max()))
        assert (r.s1, r.s2) == pytest.approx((part.sum(), (part * part).sum()))
    assert len(sums) == 9


def test_pair_sums_are_dealt_out(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 2, [1.0, float(i)]) for i in range(400)], "vec_id long, label int, embedding array<double>").coalesce(1)
    kept, write = {}, search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    assert {(r.label_a, r.label_b): r.n for r in search.pair_stats(df).collect()} == {(a, b): 200 * (200 - (a == b)) for a in (0, 1) for b in (0, 1)}
    sizes = [r["count"] for r in kept["vectors"].groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200


def test_clusters(spark):
    df = spark.createDataFrame([(i, [1.0, 0.01 * i] if i < 10 else [0.01 * i, 5.0]) for i in range(20)], "vec_id long, embedding array<double>")
    c = clustering.kmeans(df, 2)
    assert clustering.silhouette(c) > 0.9 and clustering.plane(df).count() == 20


def test_tables(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, tables.merged_history(a, b, ["k"]).collect())) == [(1, "y"), (2, "z")]
    got = tables.with_fallback(a, b, F.col("k") == 2, ["k"], 5)
    assert [tuple(r) for r in got.collect()] == [(2, "z")]
    paths = spark.createDataFrame([("/a/v.mp4",), ("/b/v.mp4",), ("/x/b/v.mp4",), ("/b/w.mp4",)], "path string")
    assert {r.path: r.feed for r in tables.unique_names(paths).collect()} == {"/a/v.mp4": "a_v.mp4", "/b/v.mp4": "b_v.mp4", "/x/b/v.mp4": "b_v.mp4_1", "/b/w.mp4": "w.mp4"}


def test_track_similarity_has_four_parts(spark):
    schema = "track_id long, path array<struct<x: double, y: double>>, w double, h double, embedding array<float>, start double, end double, camera string"
    rows = [
        (1, [(0.0, 0.0), (100.0, 0.0)], 10.0, 20.0, [1.0, 0.0], 0.0, 10.0, "c1"),
        (2, [(0.0, 60.0), (10.0, 60.0), (100.0, 60.0)], 30.0, 20.0, [0.0, 2.0], 5.0, 15.0, "c1"),
        (3, None, None, None, None, None, None, None),
        (4, [(7.0, 7.0), (7.0, 7.0)], -1.0, 5.0, [0.0, 0.0], 10.0, 10.0, ""),
        (5, [(0.0, 0.0), (0.0, 50.0), (50.0, 50.0)], 10.0, 20.0, [-1.0, 0.0], 0.0, 10.0, "c2"),
    ]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 4), (1, 5), (1, 1)], "a long, b long")
    got = {(r.a, r.b): r for r in tracks.similarity(spark.createDataFrame(rows, schema), pairs).collect()}
    s = [100 * k / 19 for k in range(20)]
    corner = sum(math.hypot(x - max(0.0, x - 50), min(x, 50.0)) for x in s) / 20
    want = {
        (1, 2): (60.0, math.exp(-0.5 * 0.16), 0.75, 0.5, 0.7 / 3 + 0.3),
        (1, 3): (999.0, 0.5, 1 - (40 / 60 + 30 / 70) / 2, 0.5, 0.15),
        (4, 4): (0.0, 1.0, 0.5, 0.5, 0.15),
        (1, 5): (corner, math.exp(-0.5 * (corner / 150) ** 2), 1.0, 0.0, 0.7 + 0.15),
        (1, 1): (0.0, 1.0, 1.0, 1.0, 1.0),
    }
    assert set(got) == set(want)
    for k, (distance, *parts) in want.items():
        r = got[k]
        assert (r.distance, r.trajectory, r.size, r.embedding, r.spatiotemporal) == pytest.approx((distance, *parts), abs=1e-5)
        assert r.overall == pytest.approx(0.35 * parts[0] + 0.2 * parts[1] + 0.3 * parts[2] + 0.15 * parts[3], abs=1e-5)
