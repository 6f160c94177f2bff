"""Registered queries of the engine's own operators and their SQL counterparts.

The tables stand in for tracks as follows: ``embeddings`` is the gallery (label = identity,
vec_id modulo 4 = camera), ``events`` are observations (user = track, value = x, props.k = y),
``lineitem`` rows are boxes, ``customer`` ids form a merge forest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import geometry, naming, vectors
from skein.operators import clustering, fusion, identity, metrics, predicates, profiles, retrieval, search, selection, tables, temporal, tracks
from skein.operators.components import components
from skein.plans import stages
from skein.plans.sql import SQL
from skein.sources import ingest
from skein.sources.tables import table
from skein.streaming import lifecycle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _gallery(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _query_set(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return _gallery(spark, d).filter("vec_id % 20 = 0")


def _one(spark: SparkSession, d: str) -> DataFrame:
    return _gallery(spark, d).orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def _observations(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events")
    y = F.get_json_object("props", "$.k").cast("double")
    return df.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("frame"), seconds(F.col("ts")).alias("ts"), F.col("value").alias("x"), F.coalesce(y, F.lit(0.0)).alias("y"), "event_type")


def _boxes(spark: SparkSession, d: str, shift: float) -> DataFrame:
    """A box per order line: its order is the frame, its part the identity."""
    line = table(spark, d, "lineitem")
    x, y = F.col("l_linenumber") * 10 + shift, F.col("l_linenumber") * 5 + shift * 2
    return line.select(F.lit("f").alias("feed"), F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("id"), x.alias("x1"), y.alias("y1"), (x + 10 + F.col("l_quantity")).alias("x2"), (y + 20 + F.col("l_quantity") / 2).alias("y2"))


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    g = _gallery(spark, d)
    return g.select(F.concat(F.lit("clip"), F.col("vec_id") % 4).alias("feed"), F.col("vec_id").alias("track_id"), F.col("label").cast("string").alias("class_label"), "embedding")


def _forest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    parent = F.when(F.col("c_custkey") % 5 != 0, F.floor(F.col("c_custkey") / 2))
    return c.select(F.col("c_custkey").alias("node"), F.when(parent > 0, parent).alias("parent"))


# Search


@query
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(_gallery(spark, d), _one(spark, d), 10)


@query
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(_gallery(spark, d), _one(spark, d), 10, predicates.compile_where({"label": 3}))


@query
def knn_multi_query(spark: SparkSession, d: str) -> DataFrame:
    return search.knn_sets(_query_set(spark, d), _gallery(spark, d), 10).withColumnRenamed("score", "distance")


@query
def euclidean_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = search.knn_sets(_query_set(spark, d), _gallery(spark, d), 5, "euclidean")
    return hits.select("query_id", "item_id", F.round("score", 4).alias("distance"), "rank")


@query
def cosine_distance_edge(spark: SparkSession, d: str) -> DataFrame:
    rows = [(0, None, [1.0]), (1, [], []), (2, [1.0], [1.0, 2.0]), (3, [0.0, 0.0], [1.0, 2.0]), (4, [1.0, 2.0], [1.0, 2.0]), (5, [1.0, 0.0], [-1.0, 0.0]), (6, [1.0, 0.0], [0.0, 3.0])]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    vectors.register(spark)
    a, b = F.col("a"), F.col("b")
    return df.select(
        "id", F.round(vectors.cosine_distance(a, b), 6).alias("distance"), F.round(vectors.cosine(a, b), 6).alias("similarity"),
        F.round(vectors.similarity_score(a, b), 6).alias("score"), F.round(F.expr("cosine_distance(a, b)"), 6).alias("by_sql"),
    )


@query
def all_pairs_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.pair_stats(_gallery(spark, d))


@query
def hybrid_keyword_score(spark: SparkSession, d: str) -> DataFrame:
    """Segments as classes, asked for in words; the best customers first."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("class_label"), (F.col("c_acctbal") / 9999).alias("_s"))
    scored = search.hybrid(c, "a red truck near the building", F.when(F.col("_s") > 0, F.col("_s")))
    return scored.select("c_custkey", "score")


# Vectors by group


def _element_wise(spark: SparkSession, d: str, how: str) -> DataFrame:
    return fusion.element_wise(_gallery(spark, d), "label", how).select("label", "pos", F.round("value", 6).alias("value"))


@query
def vec_mean_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _element_wise(spark, d, "mean")


@query
def vec_max_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _element_wise(spark, d, "max")


@query
def vec_last_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _element_wise(spark, d, "last")


@query
def attention_pool(spark: SparkSession, d: str) -> DataFrame:
    g = _gallery(spark, d).withColumn("track_id", F.col("label").cast("long"))
    p = fusion.pooled(g, "attention")
    return p.select("track_id", "n", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query
def assignment_match(spark: SparkSession, d: str) -> DataFrame:
    return identity.match_feeds(_tracks(spark, d), 0.3)


@query
def global_identities(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d)
    return identity.identities(t, identity.match_feeds(t, 0.3))


@query
def fps_diversity(spark: SparkSession, d: str) -> DataFrame:
    g = _gallery(spark, d).select(F.col("label").cast("long").alias("identity"), "vec_id", (F.col("vec_id") % 4).alias("camera"), F.col("vec_id").cast("double").alias("ts"), F.lit(1.0).alias("quality"), "embedding")
    return selection.representatives(g)


@query
def kmeans_summary(spark: SparkSession, d: str) -> DataFrame:
    return clustering.summary(clustering.kmeans(_gallery(spark, d), 10), "label")


@query
def plane_projection(spark: SparkSession, d: str) -> DataFrame:
    return clustering.plane(_gallery(spark, d)).select("vec_id", "px", "py")


# Evaluation


@query
def reid_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The query set against all vectors, its own included, as the harness does."""
    ranked = search.positive_ranks(_query_set(spark, d), _gallery(spark, d))
    return metrics.reid(ranked.select("query_id", "rank", F.lit(1).alias("hit")))


@query
def nl_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A user's events by value are a ranked answer; purchases are right; users of a residue are a group."""
    e = table(spark, d, "events")
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    df = e.select((F.col("user_id") % 7).alias("target"), F.col("user_id").alias("query_id"), rank.alias("rank"), (F.col("event_type") == "purchase").cast("int").alias("hit"))
    return metrics.retrieval(df, "target")


@query
def frame_match_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = metrics.frame_pairs(_boxes(spark, d, 0.0), _boxes(spark, d, 2.0), 0.3)
    return pairs.groupBy("frame").agg(F.count("*").alias("n_pairs"), F.round(F.max("iou"), 6).alias("best"))


@query
def mot_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tracking(_boxes(spark, d, 0.0), _boxes(spark, d, 2.0))


# Filters and joins


@query
def where_compiler(spark: SparkSession, d: str) -> DataFrame:
    where = {"$and": [{"event_type": "click"}, {"value": {"$gte": 10, "<": 60.5}}], "user_id": {"$gt": 3, "$unknown": 1}}
    return table(spark, d, "events").filter(predicates.compile_where(where)).select("event_id", "user_id", "value")


@query
def metadata_fallback(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    first = e.filter(F.col("event_type") == "view")
    return tables.with_fallback(first, e, predicates.compile_where({"event_type": "error"}), ["event_id"], 20)


@query
def temporal_context(spark: SparkSession, d: str) -> DataFrame:
    """Per error the events of its user within an hour before or after."""
    e = table(spark, d, "events").select("user_id", "event_id", seconds(F.col("ts")).alias("ts"), "event_type")
    near = temporal.band_join(e.filter("event_type = 'error'"), e, ["user_id"], "ts", 3600.0)
    return near.groupBy("event_id").agg(F.count("*").alias("n"), F.min("event_id_2").alias("first_id"), F.max("event_id_2").alias("last_id"))


@query
def overlap_join_15s(spark: SparkSession, d: str) -> DataFrame:
    """Events as intervals of ``value`` minutes; overlapping ones of a user, 15 s apart at most."""
    e = table(spark, d, "events").select("user_id", "event_id", seconds(F.col("ts")).alias("start"))
    v = table(spark, d, "events").select("event_id", "value")
    e = e.join(v, "event_id").withColumn("end", F.col("start") + F.abs("value") * 60).drop("value")
    met = temporal.overlap_join(e, e, ["user_id"], "start", "end", 15.0, 7200.0).filter("event_id < event_id_2")
    return met.groupBy("user_id").agg(F.count("*").alias("n_pairs"))


@query
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", seconds(F.col("ts")).alias("ts"), "event_type")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    found = temporal.nearest(e.filter("event_type = 'purchase'"), views, ["user_id"], "ts", ["event_id"])
    return found.select("event_id", F.col("match.event_id").alias("view_id"))


@query
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = metrics.frame_pairs(_boxes(spark, d, 0.0), _boxes(spark, d, 2.0), 0.5)
    return pairs.select("frame", "truth_id", "found_id", F.round("iou", 6).alias("iou"))


@query
def track_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders, compared with those of the customer before: time and size.

    ``overall`` is of these two parts only, as its SQL; ``track_similarity`` has all four.
    """
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("a")).agg(
        F.min(seconds(F.col("o_orderdate"))).alias("s"), F.max(seconds(F.col("o_orderdate"))).alias("e"), F.avg("o_totalprice").alias("w"), F.count("*").cast("double").alias("h"),
    )
    b = o.select((F.col("a") + 1).alias("a"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("w").alias("w2"), F.col("h").alias("h2"))
    time = geometry.temporal_iou(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))
    size = geometry.size_similarity(F.col("w"), F.col("h"), F.col("w2"), F.col("h2"))
    return o.join(b, "a").select(F.col("a").alias("track"), F.round(time, 6).alias("time"), F.round(size, 6).alias("size"), F.round((0.2 * size + 0.15 * (0.7 * time + 0.15)) / 0.35, 6).alias("overall"))


@query
def track_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Users as tracks, compared with the next one and the next of the same camera, by all four parts."""
    path = F.sort_array(F.collect_list(F.struct("ts", "frame", "x", "y")))
    by = _observations(spark, d).groupBy("track_id").agg(path.alias("path"), F.avg(F.col("x") / 10 + 20).alias("w"), F.avg(F.col("y") / 10 + 20).alias("h"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    seen = by.join(_gallery(spark, d).select(F.col("vec_id").alias("track_id"), "embedding"), "track_id", "left").withColumn("camera", (F.col("track_id") % 4).cast("string"))
    pairs = by.select(F.col("track_id").alias("a"), F.explode(F.array(F.col("track_id") + 1, F.col("track_id") + 4)).alias("b"))
    found = tracks.similarity(seen, pairs)
    return found.select("a", "b", *(F.round(c, 6).alias(c) for c in found.columns[2:]))


# Tables, names, graphs


@query
def video_catalog(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.select(F.concat(F.lit("clip"), F.col("user_id"), F.lit(".mp4")).alias("video_name"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("S01_c"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), F.lit(".avi")).alias("video_name"))
    return tables.catalogue([a, b])


@query
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return tables.upsert(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query
def class_sets(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    a, b = (line.filter(F.col("l_returnflag") == f).select("l_partkey").distinct() for f in ("A", "R"))
    tagged = [(a.intersect(b), "both"), (a.subtract(b), "only_a"), (a.union(b).distinct(), "any"), (tables.missing(b, a, ["l_partkey"]), "gone")]
    return tagged[0][0].withColumn("kind", F.lit("both")).unionByName(tagged[1][0].withColumn("kind", F.lit("only_a"))).unionByName(tagged[2][0].withColumn("kind", F.lit("any"))).unionByName(tagged[3][0].withColumn("kind", F.lit("gone"))).groupBy("kind").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("total"))


@query
def master_resolution(spark: SparkSession, d: str) -> DataFrame:
    return identity.masters(_forest(spark, d)).withColumn("master", F.col("master").cast("long"))


@query
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return components(_forest(spark, d).filter("parent is not null").select(F.col("node").alias("x"), F.col("parent").alias("y")))


@query
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0)


@query
def mode_with_tie(spark: SparkSession, d: str) -> DataFrame:
    return tables.mode(table(spark, d, "events"), ["user_id"], "event_type")


@query
def top3_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return selection.best_per(by, ["l_returnflag"], 3, "n", "l_suppkey")


@query
def variant_meta(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.lit("bad:"), F.col("event_type"))).alias("p"))
    v = e.withColumn("v", tables.parsed_json(F.col("p")))
    return v.select("event_id", F.coalesce(F.try_variant_get("v", "$.k", "long"), F.lit(-1)).alias("k"), F.try_variant_get("v", "$.raw", "string").alias("raw"))


@query
def names_and_keys(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", "p_size", F.concat(F.lit("c006_vdo.avi_"), F.col("p_partkey")).alias("key"))
    feed, track = naming.track_key_parts(F.col("key"))
    crop = F.concat(F.format_string("frame_%06d", "p_partkey"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_t"), F.col("p_size"), F.lit(".50"))).otherwise(F.lit("")), F.lit(".jpg"))
    frame, time = naming.crop_fields(crop)
    return s.select("p_partkey", feed.alias("feed"), track.alias("track"), frame.alias("frame"), F.round(time, 6).alias("time"), naming.class_name(F.col("p_size") % 9).alias("class_label"), naming.iso_time(F.col("p_size") * 0.25).alias("iso"))


# Tracks


@query
def velocity_heading(spark: SparkSession, d: str) -> DataFrame:
    df = tracks.velocities(_observations(spark, d))
    return df.select("track_id", "frame", F.round("vx", 4).alias("vx"), F.round("vy", 4).alias("vy"), F.round("heading", 4).alias("heading"))


@query
def central_diff(spark: SparkSession, d: str) -> DataFrame:
    df = _observations(spark, d)
    return df.select("track_id", "frame", F.round(tracks.central(df, "x"), 6).alias("dx"), F.round(tracks.central(df, "y"), 6).alias("dy"))


@query
def arc_length(spark: SparkSession, d: str) -> DataFrame:
    return tracks.arc_length(_observations(spark, d)).select("track_id", "frame", F.round("arc", 4).alias("arc"))


@query
def run_length(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select(F.col("user_id").alias("track_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("frame"))
    return tracks.longest_run(days)


@query
def lifecycle_events(spark: SparkSession, d: str) -> DataFrame:
    df = tracks.lifecycle(_observations(spark, d), 86400.0)
    return df.groupBy("track_id", "event_type").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"))


@query
def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    df = _observations(spark, d).withColumn("ts", (F.col("ts") - 1704067200) / 86400)
    fit = tracks.linear_fit(df)
    return fit.select("track_id", *(F.round(c, 4).alias(c) for c in fit.columns[1:]))


@query
def cleared_frame(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    df = line.select(F.col("l_partkey").alias("track_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("double").alias("ts"), (F.col("l_quantity") + 10).alias("w"), (F.col("l_linenumber") * 5 + 10.0).alias("h"), (1 - F.col("l_discount")).alias("conf"))
    return tracks.cleared_frame(df).select("track_id", "frame", F.round("score", 4).alias("score"))


@query
def min_gap_thinning(spark: SparkSession, d: str) -> DataFrame:
    by = _observations(spark, d).groupBy("track_id").agg(F.sort_array(F.collect_list("ts")).alias("at"))
    return by.select("track_id", F.explode(temporal.thinned(F.col("at"), 86400.0)).alias("ts"))


@query
def downsample_count(spark: SparkSession, d: str) -> DataFrame:
    return temporal.every_kth(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "frame")


@query
def ema_smoothing(spark: SparkSession, d: str) -> DataFrame:
    by = _observations(spark, d).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("ts", "frame", "x"))).alias("r"))
    return by.select("track_id", F.round(tracks.smoothed(F.transform("r", lambda r: r.x)), 6).alias("smoothed"))


@query
def compressed_tracks(spark: SparkSession, d: str) -> DataFrame:
    df = _observations(spark, d).withColumn("ts", (F.col("ts") - 1704067200) / 3600).withColumn("w", F.col("x") / 10 + 20).withColumn("h", F.col("y") / 10 + 20)
    return tracks.compressed(df).select("track_id", "n", F.size("segments").alias("n_segments"), "size_type", "total_distance", "avg_speed", "mean_error", "max_error")


@query
def intra_fusion(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d)
    at = (F.col("track_id") / 4).cast("double")
    place = F.col("track_id") % 50
    df = t.select("*", at.alias("start"), (at + 1).alias("end"), (at * 10).cast("long").alias("start_frame"), (at * 10 + 10).cast("long").alias("end_frame"), *(place.cast("double").alias(c) for c in ("start_x", "start_y", "end_x", "end_y")))
    return fusion.fuse_within_feed(df, max_gap=60.0, least_similarity=0.3)


@query
def quality_gate_and_score(spark: SparkSession, d: str) -> DataFrame:
    return _crops(spark, d).select("crop_id", "prune_reason", "quality")


def _crops(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    df = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("crop_id"), F.col("l_suppkey").alias("identity"), (F.col("l_quantity") * 5).alias("width"), (F.col("l_linenumber") * 30.0).alias("height"),
        (F.col("l_tax") * 3000 + 5).alias("mean"), (F.col("l_discount") * 1000).alias("contrast"), (F.col("l_extendedprice") / 100).alias("sharpness"), (1 - F.col("l_discount")).alias("confidence"),
        (F.col("l_linenumber") - 1.0).alias("x1"), F.lit(10.0).alias("y1"),
    )
    return selection.gated(df)


@query
def top_per_identity(spark: SparkSession, d: str) -> DataFrame:
    return selection.best_per(_crops(spark, d).filter("prune_reason is null"), ["identity"], 5, "quality", "crop_id").select("identity", "crop_id", "quality", "rank")


@query
def track_quality(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d)
    by = o.groupBy("track_id").agg(F.count("*").alias("num_detections"), F.sum(F.col("y") / 100).alias("total_conf"), F.min("frame").alias("start_frame"), F.max("frame").alias("frame_id"), (F.count("*") * 0.9).alias("stability_sum"), F.sum((F.col("event_type") == "error").cast("int")).alias("recall_count"))
    runs = run_length(spark, d)
    return selection.track_quality(by.join(runs, "track_id")).select("track_id", F.round("quality", 6).alias("quality"))


def _moving(spark: SparkSession, d: str) -> DataFrame:
    df = _observations(spark, d).withColumn("ts", (F.col("ts") - 1704067200) / 3600)
    return df.select("track_id", "frame", "ts", "x", "y", (F.col("x") / 10 + 20).alias("w"), (F.col("y") / 10 + 20).alias("h"))


@query
def compression_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per track how far the boxes rebuilt from its models are from those observed, and their size."""
    seen = _moving(spark, d)
    return tracks.fidelity(seen, tracks.compressed(seen))


@query
def tracker_events(spark: SparkSession, d: str) -> DataFrame:
    """The tracker over each kind of event as a feed, one box per event."""
    o = _observations(spark, d)
    frame = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "frame")).cast("long")
    box = geometry.from_xywh(F.floor("x").cast("double"), F.floor("y").cast("double"), F.lit(60.0), F.lit(60.0))
    df = o.select(F.col("event_type").alias("feed"), frame.alias("frame"), "ts", F.lit(0).alias("det_idx"), *(c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)), F.lit(0.9).alias("score"), F.lit(2).alias("class_id"), F.lit(None).cast("array<double>").alias("embedding"))
    return lifecycle.track_batch(df).groupBy("feed", "event_type").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("n_tracks"))


@query
def mean_pool_prototypes(spark: SparkSession, d: str) -> DataFrame:
    """Per label and camera one unit prototype."""
    g = _gallery(spark, d).withColumn("track_id", F.col("label") * 4 + F.col("vec_id") % 4)
    p = fusion.pooled(g.withColumn("track_id", F.col("track_id").cast("long")), "mean")
    return p.select("track_id", "n", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query
def crop_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which crops to cut at each time: tracks sampled a day apart, gathered by whole hour."""
    by = _observations(spark, d).groupBy("track_id").agg(F.sort_array(F.collect_list("ts")).alias("at"))
    picked = by.select("track_id", F.explode(temporal.thinned(F.col("at"), 86400.0)).alias("ts"))
    plan = picked.groupBy(F.floor(F.col("ts") / 3600).alias("hour")).agg(F.count("*").alias("n_crops"), F.sort_array(F.collect_list("track_id")).alias("track_ids"))
    return plan.select("hour", "n_crops", F.array_join("track_ids", ",").alias("track_ids"))


@query
def merged_histories(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and views of each user by day, views over clicks."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "value", "event_type")
    last = lambda kind: tables.upsert(e.filter(F.col("event_type") == kind), ["user_id", "day"], ["event_id"])
    return tables.merged_history(last("click"), last("view"), ["user_id", "day"]).select("user_id", F.col("day").cast("string").alias("day"), "event_id", "event_type")


def _single_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line per order and number."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return line.agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_quantity", "l_discount", "l_tax")))


@query
def mot_spaced(spark: SparkSession, d: str) -> DataFrame:
    """Boxes too far apart to compete; each identity is found under two ids, so the better one counts."""
    line = _single_lines(spark, d)
    x = F.col("l_linenumber") * 1000.0
    frame = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame")
    box = lambda shift: [(x + shift).alias("x1"), F.lit(0.0).alias("y1"), (x + shift + 40).alias("x2"), F.lit(20.0).alias("y2")]
    truth = line.select(F.lit("f").alias("feed"), frame, F.col("l_partkey").alias("id"), *box(F.lit(0.0)))
    twice = (F.col("l_partkey") * 2 + (F.col("l_quantity") > 20).cast("int")).alias("id")
    found = line.filter("l_tax > 0.01").select(F.lit("f").alias("feed"), frame, twice, *box(F.col("l_discount") * 400))
    return metrics.tracking(truth, found)


@query
def assignment_is_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Of the optimal matches no track of a feed pair and class comes twice, and none is under the threshold."""
    m = identity.match_feeds(_tracks(spark, d), 0.3)
    return m.agg(
        (F.countDistinct("feed_b", "track_a") == F.count("*")).alias("one_a"), (F.countDistinct("feed_a", "track_b") == F.count("*")).alias("one_b"), (F.min("similarity") >= 0.3).alias("fine"),
    )


@query
def identities_are_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every track is in one identity, identities are numbered without gaps, and larger ones come first."""
    i = global_identities(spark, d).withColumn("number", F.substring_index("global_id", "_", -1).cast("long"))
    members = i.select(F.explode("tracks").alias("key"))
    ordered = i.select("num_tracks", F.lead("num_tracks").over(W.orderBy("number")).alias("next"))
    counts = i.agg(F.sum("num_tracks").alias("n_tracks"), (F.max("number") == F.count("*")).alias("gapless"))
    once = members.agg(F.countDistinct("key").alias("n_keys"))
    falling = ordered.agg(F.coalesce(F.max(F.col("next") > F.col("num_tracks")), F.lit(False)).alias("rises"))
    return counts.crossJoin(F.broadcast(once)).crossJoin(F.broadcast(falling))


@query
def clusters_are_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every vector is in one cluster and shares add up."""
    c = kmeans_summary(spark, d)
    return c.agg(F.sum("n").alias("n"), F.round(F.sum("share"), 1).alias("share"), (F.max(F.size("top")) <= 3).alias("short"))


@query
def plane_energy(spark: SparkSession, d: str) -> DataFrame:
    """The projection's axes hold the two largest variances, so their sum bounds that of any two columns."""
    p = clustering.plane(_gallery(spark, d)).agg((F.var_pop("px") + F.var_pop("py")).alias("s"))
    own = _gallery(spark, d).select(F.posexplode("embedding").alias("pos", "v")).groupBy("pos").agg(F.var_pop("v").alias("v"))
    best = own.orderBy(F.desc("v")).limit(2).agg(F.sum("v").alias("two"))
    return p.crossJoin(F.broadcast(best)).select((F.col("s") >= F.col("two") - 1e-9).alias("holds"))


# Ingest, profiles and retrieval


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return tables.catalogue([table(spark, d, "supplier").select(F.concat(F.lit("S01_c"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), F.lit(".avi")).alias("video_name"))])


@query
def identity_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation as an identity's tracks; times come from the profile, shifted by the video."""
    s = table(spark, d, "supplier")
    key = F.concat(F.lit("S01_c"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), F.lit(".avi_"), F.col("s_suppkey"))
    by = s.groupBy(F.concat(F.lit("g"), "s_nationkey").alias("global_id")).agg(F.sort_array(F.collect_list(key)).alias("track_ids"), F.min("s_suppkey").cast("double").alias("start_time"), (F.max("s_suppkey") + 1).cast("double").alias("end_time"))
    profile = F.to_json(F.struct("track_ids", "start_time", "end_time"))
    rows = ingest.identity_tracks(by.select("global_id", profile.alias("profile")), _videos(spark, d))
    return rows.select("id", "global_id", "track_id", "camera_id", "video_name", "camera_timestamp_sec", "end_time", "class_label", "start_time_iso")


@query
def reid_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a label as an archive's entry: the unit mean, summed for comparison."""
    g = _gallery(spark, d).select(F.concat(F.lit("clip"), F.col("label") % 4, F.lit("_app_"), F.col("label")).alias("key"), F.col("vec_id").alias("ordinal"), "embedding")
    rows = ingest.reid_rows(g, _videos(spark, d), "osnet")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("id", "track_id", "camera_id", "video_name", "vector_dim", F.round(total, 4).alias("total"), "model_name")


@query
def retrieval_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with metadata: names, cameras, times and the model by the dimension."""
    meta = F.to_json(F.struct(F.concat(F.lit("clip"), F.col("label"), F.lit("_"), F.col("vec_id")).alias("track_id"), (F.col("vec_id") * 0.5).alias("start_time"), F.concat(F.lit("g"), F.col("label")).alias("global_id")))
    a = _gallery(spark, d).select(F.col("vec_id").alias("position"), F.concat(F.lit("v"), "vec_id").alias("doc_id"), meta.alias("meta"), "embedding")
    rows = ingest.retrieval_rows(a, _videos(spark, d))
    return rows.select("id", "global_id", "track_id", "camera_id", "video_name", "model_name", "vector_dim", "video_pos_ms", "class_label")


@query
def loaded_tracks(spark: SparkSession, d: str) -> DataFrame:
    """A registry of labels joined with an archive by the names a track's vectors may have."""
    g = _gallery(spark, d)
    model = F.to_json(F.struct(F.when(F.col("label") % 2 == 0, "car").otherwise("bus").alias("class"), F.struct(F.sequence(F.lit(1), F.col("label") + 1).alias("frames")).alias("time_model")))
    registry = g.select(F.lit("f_1").alias("feed"), F.col("label").cast("long").alias("track_id"), model.alias("model")).distinct()
    key = F.when(F.col("label") % 3 == 0, F.concat(F.lit("f_1_occ_"), "label")).when(F.col("label") % 3 == 1, F.concat(F.lit("app_"), "label")).otherwise(F.col("label").cast("string"))
    rows = ingest.load_tracks(registry, g.select(key.alias("key"), F.col("vec_id").alias("ordinal"), "embedding"), "max", classes=["car"])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("feed", "track_id", "class_label", "n_frames", F.round(total, 4).alias("total"))


@query
def pair_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Identities of a merge forest given as pairs of keys."""
    f = _forest(spark, d).filter("parent is not null")
    key = lambda c: F.concat(F.lit("k_"), F.lpad(F.col(c).cast("string"), 9, "0"))
    return ingest.paired(f.select(key("node").alias("a"), key("parent").alias("b")))


@query
def identity_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Labels as identities with their vectors as views."""
    g = _gallery(spark, d)
    rank = F.row_number().over(W.partitionBy("label").orderBy("vec_id"))
    crops = g.select(
        F.concat(F.lit("g"), "label").alias("global_id"), F.lit("p").alias("path"), (F.col("vec_id") % 7).cast("string").alias("track_id"), F.concat(F.lit("c"), F.col("vec_id") % 3).alias("camera_id"),
        F.col("vec_id").alias("frame"), (F.col("vec_id") / 4).alias("ts"), (F.col("vec_id") % 10 / 10).alias("quality"), "embedding", rank.alias("rank"),
    )
    p = profiles.built(crops)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return p.select("global_id", F.array_join("profile.camera_ids", ",").alias("cameras"), F.array_join("profile.track_ids", ",").alias("tracks"), "profile.start_time", "profile.duration_sec", "profile.num_representative_views", "profile.avg_quality_score", F.round(total, 4).alias("total"))


@query
def gallery_matches(spark: SparkSession, d: str) -> DataFrame:
    """The query set against buffered prototypes of its class: a fused vector, or the mean of two."""
    g = _gallery(spark, d)
    queries = _query_set(spark, d).select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("class_label"), "embedding")
    pairs = g.filter("vec_id % 10 < 2").groupBy(F.floor(F.col("vec_id") / 10).alias("track_id"), F.col("label").cast("string").alias("class_label")).agg(F.collect_list("embedding").alias("vectors"), F.max_by("embedding", "vec_id").alias("last"))
    buffered = pairs.select((F.col("track_id") * 100 + F.col("class_label").cast("int")).alias("track_id"), "class_label", F.when(F.col("track_id") % 2 == 0, F.col("last")).alias("fused"), "vectors")
    m = profiles.gallery_matches(queries, buffered, 0.1)
    return m.select("query_id", "track_id", F.round("similarity", 5).alias("similarity"))


@query
def attached_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Events as scored vectors, customers as tracks: by key, or by camera and time; the 50 best."""
    e = table(spark, d, "events")
    scored = e.select((F.col("event_id") * 3).cast("string").alias("track_key"), F.concat(F.lit("c"), F.col("user_id") % 20).alias("camera_id"), F.col("event_id").cast("double").alias("ts"), (F.col("value") / 1000).alias("similarity"))
    c = table(spark, d, "customer")
    start = F.col("c_custkey") * 7.0
    tracks_ = c.select(F.concat(F.lit("t"), "c_custkey").alias("id"), F.col("c_custkey").alias("track_id"), F.concat(F.lit("c"), F.col("c_nationkey")).alias("camera_id"), start.alias("start_time"), (start + 5).alias("end_time"), F.col("c_mktsegment").alias("class_label"))
    return retrieval.attached(scored, tracks_, 50, search.keyword_boost(F.lit("a van by the machinery"), F.col("class_label")))


@query
def vector_tool(spark: SparkSession, d: str) -> DataFrame:
    """Search by a tool whose encoder is given: candidates of one camera."""
    g = _gallery(spark, d)
    rows = g.select(
        F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("cam_"), F.col("vec_id") % 4).alias("camera_id"), F.col("vec_id").alias("track_id"), F.lit("retrieval").alias("embedding_type"), F.lit("m").alias("model_name"),
        F.size("embedding").alias("vector_dim"), "embedding", F.col("vec_id").cast("double").alias("camera_timestamp_sec"), F.lit("").alias("camera_timestamp_iso"), F.lit(0.0).alias("video_pos_ms"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("car").alias("class_label"),
    )
    n = len(g.first()["embedding"])
    tools = retrieval.Tools(rows, rows, lambda text: [1.0] + [0.0] * (n - 1))
    found = tools.execute("encode_and_search_vector_store", {"query_text": "cars on camera 2", "top_k": 15}).rows
    return found.select("id", "camera_id", F.round("retrieval_distance", 5).alias("distance"))


@query
def metadata_tool(spark: SparkSession, d: str) -> DataFrame:
    """Events of a camera in a time window by the metadata tool."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("cam_"), F.col("user_id") % 5).alias("camera_id"), F.col("value").alias("camera_timestamp_sec"), F.col("event_type").alias("class_label"))
    tools = retrieval.Tools(e, e)
    return tools.execute("query_metadata", {"camera_id": "cam_3", "start_timestamp": 10, "end_timestamp": 60, "class_label": "view", "top_k": 30}).rows


@query
def video_positions(spark: SparkSession, d: str) -> DataFrame:
    """Times in any form as video positions: epochs by the nearest known frame of the camera."""
    e = table(spark, d, "events")
    camera = F.concat(F.lit("cam_"), F.col("user_id") % 5)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    known = e.filter("event_type = 'view'").select(camera.alias("camera_id"), at.alias("camera_timestamp_sec"), F.col("event_id").cast("double").alias("video_pos_ms"))
    known = known.groupBy("camera_id", "camera_timestamp_sec").agg(F.min("video_pos_ms").alias("video_pos_ms"))
    text = F.when(F.col("event_id") % 3 == 0, at.cast("decimal(20,3)").cast("string")).when(F.col("event_id") % 3 == 1, (F.col("event_id") % 3000).cast("string")).otherwise((F.col("event_id") % 3000 + 3601).cast("string"))
    asked = e.filter("event_type = 'error'").select("event_id", camera.alias("camera_id"), text.alias("timestamp"))
    return retrieval.video_position(asked, known).select("event_id", F.round("pos_ms", 1).alias("pos_ms"))


@query
def registry_state(spark: SparkSession, d: str) -> DataFrame:
    """Users of a residue merged into one; events without a value's vector count as zeros."""
    e = table(spark, d, "events")
    v = F.when(F.col("event_id") % 4 != 0, F.array(F.col("value"), F.lit(1.0)))
    rows = e.select(F.lit("f").alias("feed"), F.col("user_id").alias("track_id"), F.col("event_id").alias("frame"), F.col("event_type").alias("class_label"), v.alias("embedding"))
    merged = e.select(F.col("user_id").alias("track_id"), (F.col("user_id") % 10).alias("master")).distinct()
    r = profiles.registered(rows, merged, 2)
    total = F.aggregate("vectors", F.lit(0.0), lambda a, x: a + F.get(x, F.lit(0)))
    return r.select("track_id", "class_label", "n", F.round(total, 3).alias("total"))


@query
def fused_costs(spark: SparkSession, d: str) -> DataFrame:
    """Costs of matching overlapping boxes: with a score and vectors, or without."""
    pairs = metrics.frame_pairs(_boxes(spark, d, 0.0), _boxes(spark, d, 2.0), 0.5)
    score = (F.col("truth_id") % 10 / 10).alias("score")
    v = lambda c: F.when(F.col(c) % 3 > 0, F.array(F.lit(1.0), (F.col(c) % 7).cast("double")))
    costs = pairs.select("*", score, v("truth_id").alias("vector_a"), v("found_id").alias("vector_b")).withColumn("cost", stages.fused_cost()())
    return costs.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.min("cost"), 6).alias("least"), F.round(F.max("cost"), 6).alias("most"))


@query
def active_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose orders began before, and ended after, the middle of the range; their trail's first time."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("track_id")).agg(F.min(seconds(F.col("o_orderdate"))).alias("start_time"), F.max(seconds(F.col("o_orderdate"))).alias("end_time"))
    now = F.lit(1_000_000_000.0)
    trail = tracks.trail_times(now, F.col("start_time"), F.col("end_time"))
    return tracks.active(o, now).select("track_id", F.size(trail).alias("points"), F.round(F.get(trail, F.lit(0)), 3).alias("first"))


@query
def asked_filters(spark: SparkSession, d: str) -> DataFrame:
    """Small filters of rows: classes and scores, area, frames, confirmation, subsets."""
    line = table(spark, d, "lineitem")
    df = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("frame"), (F.col("l_suppkey") % 9).cast("int").alias("class_id"), (1 - F.col("l_discount") * 9).alias("score"),
        F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), F.col("l_quantity").alias("y2"), (F.col("l_linenumber") > 1).alias("is_activated"),
    )
    keep = predicates.detected([2, 3, 5, 7]) & predicates.large_enough(100, 100, 0.02) & predicates.up_to_frame(5000) & predicates.confirmed() & predicates.among("class_id", [2, 7])
    return df.filter(keep).select("id", "class_id", predicates.among("class_id", []).alias("every"))


@query
def finished_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Users as tracks that ended: confirmed ones pooled, compressed and joined to masters."""
    o = _moving(spark, d)
    more = o.select("*", F.concat(F.lit("f"), F.col("track_id") % 3).alias("feed"), F.lit("car").alias("class_label"), (F.col("track_id") % 5 > 0).alias("is_activated"), F.array(F.lit(1.0), (F.col("track_id") % 2).cast("double")).alias("embedding"))
    return stages.finished(more).select("feed", "track_id", "n_vectors", F.round(F.get("embedding", F.lit(0)), 5).alias("first"))


@query
def alongside_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Users and the next: the time both were seen, how far apart and how alike in direction."""
    models = tracks.compressed(_moving(spark, d))
    pairs = models.select(F.col("track_id").alias("a"), (F.col("track_id") + 1).alias("b"))
    return tracks.alongside(models, pairs).select("a", "b", F.round("start", 6).alias("shared_from"), F.round("end", 6).alias("shared_to"))


@query
def track_documents(spark: SparkSession, d: str) -> DataFrame:
    """Compressed tracks written as documents and read again: what they were."""
    seen = _moving(spark, d)
    played = seen.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("frame", "ts"))).alias("p"))
    models = tracks.compressed(seen).join(played, "track_id").select("*", F.lit("car").alias("class_label"), F.lit("c1").alias("camera"), F.col("p.frame").alias("frames"), F.col("p.ts").alias("times"), F.transform("p", lambda p: F.lit(0.5)).alias("confidences"))
    again = tracks.parsed(models.select(tracks.document().alias("model")))
    return again.select("track_id", "class_label", "camera", "n", F.size("frames").alias("n_frames"), F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"), F.round(F.aggregate("confidences", F.lit(0.0), lambda a, x: a + x), 3).alias("confidence"))


@query
def whole_system(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval and tracking scores of one system, and what merged ids gain."""
    g = _gallery(spark, d)
    seen = g.select(F.col("label").cast("long").alias("track_id"), "embedding", F.col("vec_id").alias("ordinal"))
    line = _single_lines(spark, d).filter("l_linenumber = 1")
    box = [F.lit(v).alias(n) for v, n in zip((0.0, 0.0, 10.0, 10.0), ("x1", "y1", "x2", "y2"), strict=True)]
    truth = line.select(F.lit("f").alias("feed"), F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("id"), *box)
    broken = (F.col("l_partkey") * 2 + (F.col("l_quantity") > 20).cast("int")).alias("id")
    found = line.select(F.lit("f").alias("feed"), F.col("l_orderkey").alias("frame"), broken, *box)
    merged = found.select(F.col("id").alias("track_id"), F.floor(F.col("id") / 2).alias("master")).distinct()
    base, fused = metrics.system(seen, truth, found), metrics.system(seen, truth, found, merged)
    return metrics.gains(base.select("rank1", "IDF1", "DetA", "MOTA"), fused.select("rank1", "IDF1", "DetA", "MOTA"))
