import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.__main__ import main as command
from skein.functions import naming
from skein.operators import fusion, identity, metrics, profiles, ranking, retrieval, search, temporal, tracks
from skein.operators.components import components
from skein.plans import reports, stages
from skein.sources import files, ingest, schemas
from skein.streaming import lifecycle


def test_best_pairs_match_dense_assignment():
    for seed in range(300):
        r = random.Random(seed)
        n, m = r.randrange(1, 6), r.randrange(1, 6)
        gains = {(i, j): r.choice([r.random(), r.random() - 0.5, 1, 2]) for i in range(n) for j in range(m) if r.random() < 0.6}
        dense = np.zeros((n, m))
        for (i, j), g in gains.items():
            dense[i, j] = max(0, g)
        got = identity.best_pairs(gains)
        assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
        assert sum(gains[p] for p in got) == pytest.approx(sum(dense[p] for p in identity.assign(-dense)))


def test_matches_have_the_largest_overlap_beyond_the_limit(spark):
    """One pair of 0.9 beats two of 0.55, and a pair at the limit is none."""
    rows = [("f", 1, 1, 1, 0.9), ("f", 1, 1, 2, 0.55), ("f", 1, 2, 1, 0.55), ("f", 2, 1, 1, 0.5), ("f", 3, 1, 1, 0.6), ("f", 3, 2, 2, 0.7)]
    pairs = spark.createDataFrame(rows, metrics.PAIRED)
    got = sorted((r.frame, r.truth_id, r.found_id) for r in metrics.matched(pairs).collect())
    assert got == [(1, 1, 1), (3, 1, 1), (3, 2, 2)]


def test_identities_by_component(spark, monkeypatch):
    r = random.Random(3)
    rows = [("f", a, b, r.randrange(1, 9)) for a in range(30) for b in {r.randrange(30) for _ in range(2)}]
    shared = spark.createDataFrame(rows, "feed string, truth_id long, found_id long, n long")
    dense = np.zeros((30, 30))
    for _, a, b, n in rows:
        dense[a, b] = n
    want = sum(dense[p] for p in identity.assign(-dense))
    assert metrics._shared_frames(shared).first().IDTP == want
    monkeypatch.setattr(metrics, "TOGETHER", 0)
    assert metrics._shared_frames(shared).first().IDTP == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_masters_of_broken_tracks(spark):
    cols = "feed string, class_label string, track_id long, start double, end double, start_frame long, end_frame long, start_x double, start_y double, end_x double, end_y double, embedding array<double>"
    at = lambda i, s, e, v: ("f", "car", i, s, e, int(s * 10), int(e * 10), 0.0, 0.0, 0.0, 0.0, v)
    rows = [at(1, 0.0, 5.0, [1.0, 0.0]), at(2, 20.0, 25.0, [1.0, 0.5]), at(3, 40.0, 45.0, [1.0, 0.9]), at(4, 50.0, 60.0, None), at(5, 90.0, 99.0, [1.0, 0.0])]
    got = {r.track_id: (r.master_track_id, r.fused_with) for r in fusion.fuse_within_feed(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: (1, None), 2: (1, 1), 3: (1, 1), 4: (4, None), 5: (5, None)}
    assert {r.track_id for r in fusion.masters_only(fusion.fuse_within_feed(spark.createDataFrame(rows, cols))).collect()} == {1, 4, 5}


def test_long_intervals_join_once(spark):
    r = random.Random(5)
    rows = [(r.randrange(2), i, s, s + r.choice([0.0, 3.0, 40.0, 5000.0, 1e7])) for i, s in enumerate(r.uniform(0, 1e5) for _ in range(120))]
    df = spark.createDataFrame(rows, "k int, id int, s double, e double")
    got = sorted((x.id, x.id_2) for x in temporal.overlap_join(df, df, ["k"], "s", "e", 15.0, 10.0).collect())
    assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and max(a[2], b[2]) <= min(a[3], b[3]) + 15)


def test_numbering(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    got = ranking.numbered(df, [F.desc("v")], "n").collect()
    assert [r.v for r in sorted(got, key=lambda r: r.n)] == sorted((i * 7919 % 5003 for i in range(5000)), reverse=True)
    assert {r.n for r in got} == set(range(1, 5001))


def test_ranks_of_positives(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 5)).round(1)
    df = spark.createDataFrame([(i, x.tolist(), int(i % 4)) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in range(0, 120, 20):
        s = np.round(u @ u[q], 6)
        order = sorted(range(120), key=lambda i: (-s[i], i))
        want |= {(q, i, order.index(i) + 1) for i in range(120) if i % 4 == q % 4}
    for most in (search.POSITIVES, 10):
        monkeypatch.setattr(search, "POSITIVES", most)
        assert {(r.query_id, r.item_id, r.rank) for r in search.positive_ranks(df.filter("vec_id % 20 = 0"), df).collect()} == want


def test_tables_of_archives(spark, tmp_path):
    registry = {"f_1.mp4": [{"track_id": 7, "compressed_track": {"class": "car", "time_model": {"frames": [1, 2, 5]}}}, {"track_id": 8, "compressed_track": None}, {"track_id": 9, "compressed_track": {"class": "bus", "time_model": {"frames": [1]}}}]}
    (tmp_path / "r.json").write_text(json.dumps(registry))
    np.savez(tmp_path / "v.npz", **{"f_1.mp4_occ_7": np.array([[1, 0], [0, 1]], np.float32), "app_7": np.ones((1, 2), np.float32), "9": np.array([3, 4], np.float32), "empty": np.empty((0, 2), np.float32)})
    known, archive = files.registry(spark, str(tmp_path / "r.json")), ingest.arrays(spark, str(tmp_path / "v.npz"))
    got = {r.track_id: (r.class_label, r.n_frames, [round(x, 4) for x in r.embedding]) for r in ingest.load_tracks(known, archive).collect()}
    assert got == {7: ("car", 3, [0.7071, 0.7071]), 9: ("bus", 1, [0.6, 0.8])}
    assert [r.track_id for r in ingest.load_tracks(known, archive, "last", classes=["bus"]).collect()] == [9]
    ingest.export_registry(known, str(tmp_path / "out"))
    assert {r.feed: len(r.tracks) for r in spark.read.json(str(tmp_path / "out")).collect()} == {"f_1.mp4": 3}
    assert [r.key for r in ingest.keyed_tracks(known).orderBy("track_id").collect()] == ["f_1.mp4:7", "f_1.mp4:8", "f_1.mp4:9"]
    np.savez(tmp_path / "ret.npz", embeddings=np.array([[3, 4], [0, 0]], np.float32), ids=np.array(["a", "b"], object), metadata=np.array([json.dumps({"track_id": "clip3_12", "start_time": 2}), "not json"], object))
    videos = spark.createDataFrame([("clip3", 100.0)], "video_name string, start_timestamp_sec double")
    rows = {r.id: r for r in ingest.retrieval_rows(ingest.retrieval_archive(spark, str(tmp_path / "ret.npz")), videos).collect()}
    assert (rows["a"].track_id, rows["a"].camera_id, rows["a"].camera_timestamp_sec, rows["a"].video_pos_ms) == (12, "c003", 102.0, 2000.0) and rows["a"].embedding == pytest.approx([0.6, 0.8])
    assert (rows["b"].track_id, rows["b"].video_name, json.loads(rows["b"].metadata)) == (1, "clip1.mp4", {"raw": "not json"})
    assert rows["b"].schema if hasattr(rows["b"], "schema") else True
    (r,) = [r for r in ingest.reid_rows(archive, videos, "m").collect() if r.id == "reid_f_1.mp4_occ_7"]
    assert (r.video_name, r.track_id, r.vector_dim) == ("f", 7, 2)


def test_identity_profiles_of_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"g1": {"track_ids": ["c006_vdo.avi_12", "5"], "start_time": 1.5}, "bad": [1]}))
    videos = spark.createDataFrame([("c006_vdo.avi", 120.0)], "video_name string, start_timestamp_sec double")
    rows = {r.id: r for r in ingest.identity_tracks(ingest.profiles(spark, str(tmp_path / "p.json")), videos).collect()}
    assert set(rows) == {"c006_vdo.avi_12", "5"}
    r = rows["c006_vdo.avi_12"]
    assert (r.track_id, r.camera_id, r.camera_timestamp_sec, r.end_time, r.class_label) == (12, "c006", 121.5, 1.5, "vehicle")
    assert (rows["5"].track_id, rows["5"].video_name) == (5, "c001.mp4")


@pytest.mark.parametrize(
    ("data", "want"),
    [
        ([{"feed_a": "x", "track_a": 1, "feed_b": "y", "track_b": 2}, {"feed_a": "y", "track_a": 2, "feed_b": "z", "track_b": 3}], {"x_1": "x_1", "y_2": "x_1", "z_3": "x_1"}),
        ([["a_1", "b_2"], ["c_3"]], {"a_1": "global_veh_1", "b_2": "global_veh_1", "c_3": "global_veh_2"}),
        ([{"global_id": "g", "tracks": ["a_1"]}, {"tracks": ["b_2"]}], {"a_1": "g", "b_2": "global_veh_2"}),
        ({"global_matches": {"a_1": "g1"}}, {"a_1": "g1"}),
        ({"g1": ["a_1", "b_2"], "c_3": "g2"}, {"a_1": "g1", "b_2": "g1", "c_3": "g2"}),
    ],
)
def test_mapping_layouts(spark, tmp_path, data, want):
    (tmp_path / "m.json").write_text(json.dumps(data))
    assert {r.track_key: r.global_id for r in ingest.mapping(spark, str(tmp_path / "m.json")).collect()} == want


def test_crop_files(spark, tmp_path):
    for name in ("t_1/frame_000012_t3.50.jpg", "t_1/notes.txt", "clip4.mp4_2/frame_000030.png"):
        (tmp_path / "crops" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "crops" / name).write_bytes(b"x")
    listing = ingest.crop_files(spark, str(tmp_path / "crops"))
    mapping = spark.createDataFrame([("t_1", "g9")], ingest.MAPPING)
    got = {r.track_id: (r.global_id, r.camera_id, r.frame, r.ts) for r in ingest.crops(listing, str(tmp_path / "crops"), mapping).collect()}
    assert got == {"t_1": ("g9", "c001", 12, 3.5), "clip4.mp4_2": ("clip4.mp4_2", "c004", 30, 1.0)}
    flat = spark.createDataFrame([("/d/c006_vdo.avi_12_frame_001.jpg",), ("/d/odd_frame_7.jpg",)], "path string")
    assert [r.track_id for r in ingest.crops(flat, "/d").orderBy("path").collect()] == ["c006_vdo.avi_12", "odd"]
    names = spark.createDataFrame([("ab",), ("abc",), ("zz",)], "name string")
    pick = lambda *asked: sorted(r.name for r in ingest.selected(names, list(asked)).collect())
    assert pick("ALL") == ["ab", "abc", "zz"] and pick("ab") == ["ab"] and pick("b", "zz") == ["ab", "abc", "zz"]
    (tmp_path / "g.csv").write_text("1,2,3,4,5,6\n9,2,3,4,5,6\n")
    assert [(r.feed, r.frame) for r in ingest.truth(spark, {"f": str(tmp_path / "g.csv")}, 5).collect()] == [("f", 1)]


def test_table_folders(spark, tmp_path):
    here = str(tmp_path / "db")
    assert schemas.opened(spark, [None, here], "tracks").count() == 0
    schemas.create(spark, here)
    rows = spark.createDataFrame([("a", "retrieval", [3.0, 4.0]), ("b", "reid", [1.0, 0.0]), ("c", "retrieval", [0.0, 0.0])], "id string, embedding_type string, embedding array<float>")
    schemas.refresh(rows, f"{here}/embeddings.parquet")
    got = {r.id: r.embedding for r in schemas.prepared(schemas.opened(spark, [None, here], "embeddings")).collect()}
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["c"] == [0.0, 0.0] and set(got) == {"a", "c"}


def test_exported_views(spark):
    crops = spark.createDataFrame([("g", "p1", "t1", "c1", 5, 1.0, 0.5, [3.0, 4.0], 1), ("g", "p2", "t2", "c1", 9, 4.0, 0.8, [3.0, 4.0], 2)], "global_id string, path string, track_id string, camera_id string, frame long, ts double, quality double, embedding array<double>, rank int")
    built = profiles.built(crops)
    (r,) = built.collect()
    assert r.profile.asDict() | {"camera_ids": 0, "track_ids": 0} == {"global_id": "g", "camera_ids": 0, "track_ids": 0, "start_time": 1.0, "end_time": 4.0, "duration_sec": 3.0, "num_representative_views": 2, "class_label": "vehicle", "avg_quality_score": 0.65}
    assert r.embedding == pytest.approx([0.6, 0.8])
    every = {x.doc_id: json.loads(x.metadata) for x in ingest.views(built).collect()}
    assert set(every) == {"g_v0", "g_v1"} and every["g_v1"]["frame_idx"] == 9 and every["g_v1"]["start_time"] == 4.0
    (one,) = ingest.views(built, "mean").collect()
    assert one.doc_id == "g" and json.loads(one.metadata)["vector_type"] == "mean_aggregated"


def test_attributes(spark):
    rows = [({"color": "Red", "type": "suv"}, {"color": "red", "type": "van"}), ({"color": "red"}, {"type": "van"}), ({"type": "bus"}, {"type": "bus"})]
    df = spark.createDataFrame(rows, "a map<string,string>, b map<string,string>")
    assert [r[0] for r in df.select(profiles.attribute_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.5, 1.0]


def test_tools(spark):
    rows = spark.createDataFrame([("1", "cam_1", 5.0, "car", 5, "x" * 4000), ("2", "cam_1", 50.0, "bus", 6, "y")], "id string, camera_id string, camera_timestamp_sec double, class_label string, track_id long, note string")
    frames = spark.createDataFrame([("cam_1", 4000.0, "/f/4.jpg")], "camera_id string, pos_ms double, path string")
    tools = retrieval.Tools(rows, rows.withColumn("video_pos_ms", F.lit(0.0)), frames=frames)
    assert tools.execute("nothing", {}).error and tools.execute("encode_and_search_vector_store", {"query_text": "x"}).error
    assert [r.id for r in tools.execute("get_temporal_context", {"camera_id": "cam_1", "reference_time_ms": 8000}).rows.collect()] == ["1"]
    assert [r.id for r in tools.execute("query_metadata", {"class_label": "bus"}).rows.collect()] == ["2"]
    assert tools.execute("get_entire_frame", {"camera_id": "cam_1", "timestamp": "4"}).rows.first().path == "/f/4.jpg"
    assert tools.execute("inspect_visual_candidate", {"camera_id": "cam_1", "video_pos_ms": 9}).rows.first().path is None
    assert retrieval.truncated(rows.withColumn("class_label", F.col("note"))).agg(F.max(F.length("class_label"))).first()[0] == retrieval.LONGEST
    pair = spark.createDataFrame([(("a", "c1", 0.0, 5.0), ("b", "c12", 19.0, None)), (("a", "c1", 0.0, 5.0), ("b", "c12", 21.0, None)), (("a", "", 0.0, 5.0), ("b", "c1", 0.0, 5.0))], "x struct<id:string,camera_id:string,start_time:double,end_time:double>, y struct<id:string,camera_id:string,start_time:double,end_time:double>")
    assert [r[0] for r in pair.select(retrieval.same_occurrence("x", "y")).collect()] == [True, False, False]


def test_paths_side_by_side(spark):
    line = lambda i, y, t0: [(i, k, t0 + k, 5.0 * k, y, 10.0, 10.0) for k in range(12)]
    df = spark.createDataFrame(line(1, 0.0, 0.0) + line(2, 30.0, 0.0) + line(3, 0.0, 100.0), "track_id long, frame long, ts double, x double, y double, w double, h double")
    models = tracks.compressed(df)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    got = {r.b: r for r in tracks.alongside(models, pairs).collect()}
    assert got[2].distance == pytest.approx(30) and got[2].alignment == pytest.approx(1) and got[3].distance is None
    boxes = tracks.sampled(models, df.select("track_id", "frame", "ts"), 2.5).filter("track_id = 1").orderBy("ts").collect()
    assert [r.frame for r in boxes] == [0, 2, 4, 6, 8, 10] and boxes[1].x1 == pytest.approx(5.0)
    assert tracks.sampled(models, df.select("track_id", "frame", "ts"), 0.0).filter("track_id = 1").count() == 12
    f = {r.track_id: r for r in tracks.fidelity(df, models).collect()}[1]
    assert f.mean_error == pytest.approx(0, abs=1e-6) and f.mean_iou == pytest.approx(1, abs=1e-6) and f.mean_width_error == pytest.approx(0, abs=1e-6) and f.compression_ratio > 1


def test_derivatives_of_a_circle():
    t = np.linspace(0, 2, 60)
    model = [tracks.fit(t, np.stack([100 * np.cos(t), 100 * np.sin(t)], axis=1))]
    at = np.linspace(0.3, 1.7, 9)
    assert np.allclose(np.hypot(*tracks.velocity_at(model, at).T), 100, rtol=1e-3)
    assert np.allclose(np.hypot(*tracks.acceleration_at(model, at).T), 100, rtol=2e-2)
    assert np.allclose(tracks.curvature_at(model, at), 0.01, rtol=2e-2)
    s = tracks.statistics(model)
    assert s["avg_speed"] == pytest.approx(100, rel=1e-3) and s["avg_acceleration"] == pytest.approx(100, rel=2e-2)
    assert tracks.frame_at(np.array([0, 10]), np.array([0.0, 1.0]), np.array([0.25, 5.0])).tolist() == [2, 10]
    assert tracks.confidence_at(np.array([0.0, 1.0]), np.array([0.5, 1.5]), np.array([0.5, 1.0])).tolist() == [1.0, 1.0]


def test_documents_read_back(spark):
    rng = np.random.default_rng(3)
    rows = [(i, k, float(k), 20.0 * k * (i > 1), float(rng.normal()) * 30 * (i > 2), 20.0 + k, 10.0 + (k % 5) * 8 * (i > 2)) for i in (1, 2, 3) for k in range(30)]
    df = spark.createDataFrame(rows, "track_id long, frame long, ts double, x double, y double, w double, h double")
    extra = [F.lit("car").alias("class_label"), F.lit("c").alias("camera"), F.sequence(F.lit(0), F.lit(29)).cast("array<long>").alias("frames"), F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: k.cast("double")).alias("times"), F.array_repeat(F.lit(0.5), 30).alias("confidences")]
    models = tracks.compressed(df).select("*", *extra)
    again = tracks.parsed(models.select(tracks.document().alias("model")))
    asked = df.select("track_id", (F.col("ts") + 0.25).alias("ts"))
    box = lambda m: {(r.track_id, r.ts): tuple(r)[2:] for r in tracks.reconstruct(m, asked).collect()}
    a, b = box(models), box(again)
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)
    assert {r.size_type for r in again.collect()} >= {"linear", "spline"}


def test_stages(spark):
    df = stages.chained(spark.range(10), [lambda d: d.filter("id > 3"), lambda d: d.withColumn("x", F.col("id") * 2)])
    assert df.agg(F.sum("x")).first()[0] == 2 * sum(range(4, 10))
    encoders = stages.Encoders()
    encoders.add("clip", lambda t: [float(len(t)), 1.0])
    assert stages.encoder_kind("EVA02-CLIP") == "eva_clip" and stages.encoder_kind("other") == "siglip2"
    assert spark.range(1).select(encoders.column("vit-b", F.lit("abc"))).first()[0] == [3.0, 1.0]
    with pytest.raises(ValueError):
        encoders.encoder("siglip")
    assert stages.uses_appearance("bytetrackx") and not stages.uses_appearance("bytetrack")
    with pytest.raises(ValueError):
        stages.uses_appearance("botsort")


def test_small_names(spark):
    one = spark.range(1).select(naming.asked_camera(F.lit("clip3.mp4")), naming.asked_camera(F.lit("door.mp4")), naming.clock(F.lit(3725.9)), naming.normal_camera(F.lit(" 4 ")), naming.normal_camera(F.lit("North Gate"))).first()
    assert tuple(one) == ("cam_3", "door", "01:02:05", "cam_4", "north_gate")


def test_greedy_matches(spark):
    r = random.Random(6)
    rows = [(f"a{i}", f"b{j}", round(r.random(), 1)) for i in range(12) for j in range(12) if r.random() < 0.4]
    pairs = spark.createDataFrame(rows, "a string, b string, similarity double")
    assert sorted(map(tuple, identity.greedy_matches(pairs).collect())) == sorted(identity.greedy(rows))
    assert identity.greedy_matches(pairs.limit(0)).count() == 0
    m = spark.createDataFrame([("f", "g", "c", 1, 2, 0.5), ("f", "g", "c", 3, 4, 0.9)], identity.MATCHED)
    assert [x.track_a for x in identity.best_first(m, 1).collect()] == [3] and identity.best_first(m).count() == 2


def test_ensemble_of_models(spark):
    df = spark.createDataFrame([(1, [2.0, 0.0]), (1, [0.0, 5.0]), (2, [3.0, 4.0])], "k int, embedding array<double>")
    got = {r.k: r.embedding for r in fusion.ensemble(df, "k").collect()}
    assert got[1] == pytest.approx([math.sqrt(0.5)] * 2) and got[2] == pytest.approx([0.6, 0.8])


def test_histories_of_events(spark):
    rows = [("f", k, 1, i, float(i), 0.0, 0.0, 1.0, 1.0, 0.9, 0.5) for i, k in enumerate(("created", "updated", "lost", "recovered", "terminated"))]
    (r,) = lifecycle.histories(spark.createDataFrame(rows, lifecycle.EVENTS)).collect()
    assert [h.frame for h in r.history] == [0, 1, 3] and r.ended == 4.0
    tracker = lifecycle.Tracker()
    tracker.step(1, 1.0, [{"box": [0, 0, 9, 9], "score": 0.9, "vector": []}])
    tracker.reset()
    assert tracker.tracks == [] and tracker.next_id == 1


def test_reports_and_feeds(spark, tmp_path, capsys):
    one = spark.createDataFrame([(1.5, 3)], "a double, n int")
    reports.write(str(tmp_path / "r"), "Scores", {"base": one, "fused": one.select("a")})
    assert json.loads((tmp_path / "r" / "report.json").read_text())["base"] == {"a": 1.5, "n": 3}
    assert "| n | 3 |  |" in (tmp_path / "r" / "report.md").read_text() and "a" in (tmp_path / "r" / "report.txt").read_text()
    with pytest.raises(ValueError):
        reports.measures(one.union(one))
    listing = spark.createDataFrame([("/d/S06/c041/vdo.avi",), ("/d/S05/c010/vdo.avi",), ("/d/S06/c041/note.txt",)], "path string")
    assert [r.camera for r in ingest.feeds(listing, "S06").collect()] == ["c041"]
    command([])
    assert "knn_topk" in capsys.readouterr().out
