"""Building tables from registries, identity maps, array archives and crop folders, and writing them back.

JSON files are read whole, by Spark, and exploded; archives are read by ``binaryFile`` in tasks of
their own. Rows of tables are ``skein.sources.schemas``.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import naming, vectors
from skein.operators import fusion, tables
from skein.operators.components import components
from skein.sources import files

ARCHIVED = "position long, doc_id string, meta string, embedding array<float>"
#: Which names a track's vectors may have in an archive, the first that is there wins.
KEYS = ("{feed}_{kind}_{track}", "{feed}_app_{track}", "{feed}_occ_{track}", "{feed}_smooth_{track}", "{feed}_{track}", "app_{track}", "{track}")
IMAGES = r"(?i)\.(jpg|jpeg|png|webp)$"


def class_filter(column: Column, classes: list[str]) -> Column:
    """Whether a class is among ``classes``; every one is, of none."""
    return column.isin(classes) if classes else F.lit(True)


def _keyed(archive: DataFrame) -> DataFrame:
    """Vectors of an archive by the name they have in it."""
    return archive.select("key", "ordinal", "embedding").filter(F.size("embedding") > 0)


def _named_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                for key in archive.files:
                    m = np.atleast_2d(archive[key]).astype(np.float32)
                    if m.size:
                        yield pd.DataFrame({"key": key, "ordinal": range(len(m)), "embedding": list(m)})


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """``key, ordinal, embedding`` of .npz archives: one row per vector; empty arrays give none."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_named_arrays, "key string, ordinal int, embedding array<float>")


def load_tracks(registry: DataFrame, archive: DataFrame, how: str = "mean", kind: str = "app", classes: list[str] | None = None) -> DataFrame:
    """``feed, track_id, class_label, n_frames, embedding`` of tracks that have a model and vectors.

    ``registry`` is that of ``files.registry``; ``how`` is mean (to unit length), max or last.
    """
    model = F.parse_json("model")
    of = lambda path, to: F.try_variant_get(model, path, to)
    known = registry.filter(F.col("model").isNotNull()).select("feed", "track_id", of("$.class", "string").alias("class_label"), F.size(of("$.time_model.frames", "array<long>")).alias("n_frames"))
    known = known.filter(class_filter(F.col("class_label"), classes or []))
    names = []
    for place, form in enumerate(KEYS):
        text = [x for part in form.replace("{kind}", kind).split("{") for x in part.split("}")]
        columns = [F.col({"feed": "feed", "track": "track_id"}[x]).cast("string") if x in ("feed", "track") else F.lit(x) for x in text]
        names.append(F.struct(F.lit(place).alias("place"), F.concat(*columns).alias("key")))
    asked = known.withColumn("k", F.explode(F.array(*names))).select("feed", "track_id", "class_label", "n_frames", "k.*")
    rows = _keyed(archive)
    present = asked.join(rows.select("key").distinct(), "key")
    chosen = present.groupBy("feed", "track_id", "class_label", "n_frames").agg(F.min_by("key", "place").alias("key"))
    return chosen.join(prototypes(rows, how), "key").select("feed", "track_id", "class_label", "n_frames", "embedding")


def prototypes(rows: DataFrame, how: str = "mean") -> DataFrame:
    """One vector per ``key``: the unit mean, the element-wise maximum, or the last."""
    if how == "mean":
        return fusion.averaged(rows, "key").withColumn("embedding", vectors.normalized(F.col("embedding")))
    long = fusion.element_wise(rows, "key", {"max_pooling": "max"}.get(how, how), "ordinal")
    return long.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x.value).alias("embedding"))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """``global_id`` and ``profile``, JSON, of {global id: profile}; what isn't an object is left out."""
    every = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("global_id", "profile"))
    return every.filter(F.schema_of_variant(F.try_parse_json("profile")).startswith("OBJECT"))


def identity_tracks(profiles_: DataFrame, videos: DataFrame) -> DataFrame:
    """A row of TRACKS per track of each profile; times are those of the profile, shifted by its video."""
    of = lambda path, to: F.try_variant_get(F.parse_json("profile"), path, to)
    start = F.coalesce(of("$.start_time", "double"), F.lit(0.0))
    df = profiles_.select(
        "global_id", "profile", start.alias("start_time"), F.coalesce(of("$.end_time", "double"), start).alias("end_time"),
        F.coalesce(of("$.class_label", "string"), F.lit("vehicle")).alias("class_label"), F.explode(of("$.track_ids", "array<string>")).alias("id"),
    )
    feed, track = naming.track_key_parts(F.col("id"))
    joined = F.contains(F.col("id"), F.lit("_"))
    number = F.when(track.rlike(r"^\d+$"), track.try_cast("long"))
    df = df.withColumn("video_name", F.when(joined, feed).otherwise(F.lit("c001.mp4"))).withColumn("track_id", F.coalesce(F.when(joined, number).otherwise(F.col("id").try_cast("long")), F.lit(0)))
    df = tables.with_offsets(df, videos, "start_time")
    end = F.col("camera_timestamp_sec") - F.col("start_time") + F.col("end_time")
    iso = naming.iso_time(F.col("camera_timestamp_sec"))
    rows = df.select(
        "id", "global_id", "track_id", naming.camera_id(F.col("video_name")).alias("camera_id"), "video_name", iso.alias("start_time_iso"), naming.iso_time(end).alias("end_time_iso"),
        iso.alias("camera_timestamp_iso"), "camera_timestamp_sec", "start_time", "end_time", "class_label", F.col("profile").alias("metadata"),
    )
    return tables.upsert(rows, ["id"], ["global_id"])


def _archived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            with np.load(io.BytesIO(content), allow_pickle=True) as archive:
                first = lambda *names: next((archive[n] for n in names if n in archive.files), None)  # noqa: B023, E731
                vectors_ = first("retrieval_embeddings", "embeddings")
                if vectors_ is None or not len(vectors_):
                    continue
                ids, metas = first("ids"), first("metadatas", "metadata")
                text = lambda m: m if isinstance(m, str) else json.dumps(m) if isinstance(m, dict) else "{}"
                n = len(vectors_)
                yield pd.DataFrame({
                    "position": range(n), "doc_id": [str(ids[i]) if ids is not None and i < len(ids) else f"retrieval_{i}" for i in range(n)],
                    "meta": [text(metas[i]) if metas is not None and i < len(metas) else "{}" for i in range(n)], "embedding": [np.asarray(v, dtype=np.float32) for v in vectors_],
                })


def retrieval_archive(spark: SparkSession, path: str) -> DataFrame:
    """``ARCHIVED``: vectors, ids and metadata of archives, joined by position.

    Archives hold Python objects, so only trusted ones may be read.
    """
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_archived, ARCHIVED)


def _unit(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(vectors.norm(v) > 0, x / vectors.norm(v)).otherwise(x).cast("float"))


def retrieval_rows(archive: DataFrame, videos: DataFrame, model: str | None = None) -> DataFrame:
    """Rows of EMBEDDINGS from ``ARCHIVED``; without ``model`` it is named by the vector's dimension."""
    meta = tables.parsed_json(F.col("meta"))
    df = archive.withColumn("m", meta)
    of = lambda name, to: F.try_variant_get("m", f"$.{name}", to)
    raw = of("track_id", "string")
    joined = F.contains(raw, F.lit("_"))
    df = df.withColumn("video_name", F.when(joined, F.substring_index(raw, "_", 1)).otherwise(F.coalesce(of("video_name", "string"), F.lit("clip1.mp4"))))
    number = F.when(joined, F.regexp_extract(raw, r"(\d+)$", 1).try_cast("long")).otherwise(raw.try_cast("long"))
    start = F.coalesce(of("start_time", "double"), of("camera_timestamp", "double"), F.lit(0.0))
    df = df.withColumn("track_id", F.coalesce(number, F.col("position"))).withColumn("start", start).withColumn("end", F.coalesce(of("end_time", "double"), start))
    df = tables.with_offsets(df, videos, "start")
    iso, dim = naming.iso_time(F.col("camera_timestamp_sec")), F.size("embedding")
    rows = df.select(
        F.col("doc_id").alias("id"), of("global_id", "string").alias("global_id"), "track_id", F.coalesce(of("camera_id", "string"), naming.camera_id(F.col("video_name"))).alias("camera_id"), "video_name",
        F.lit("retrieval").alias("embedding_type"), (F.lit(model) if model else naming.model_by_dimension(dim)).alias("model_name"), dim.alias("vector_dim"), _unit(F.col("embedding")).alias("embedding"),
        iso.alias("camera_timestamp_iso"), "camera_timestamp_sec", F.coalesce(of("video_pos_ms", "double"), F.col("start") * 1000).alias("video_pos_ms"), iso.alias("start_time_iso"),
        naming.iso_time(F.col("camera_timestamp_sec") - F.col("start") + F.col("end")).alias("end_time_iso"), F.coalesce(of("class_label", "string"), F.lit("vehicle")).alias("class_label"),
        of("bbox", "array<double>").alias("bbox"), F.coalesce(of("crop_path", "string"), F.lit("")).alias("crop_path"), F.to_json("m").alias("metadata"), "position",
    )
    return tables.upsert(rows, ["id"], ["position"]).drop("position")


def reid_rows(archive: DataFrame, videos: DataFrame, model: str) -> DataFrame:
    """Rows of EMBEDDINGS from ``arrays``: per key the unit mean; the track is the first number after a ``_``."""
    df = fusion.averaged(archive, "key")
    n = vectors.norm(F.col("embedding"))
    df = df.withColumn("embedding", F.when(n > 0, F.transform("embedding", lambda x: x / n)).otherwise(F.col("embedding")).cast("array<float>"))
    joined = F.contains(F.col("key"), F.lit("_"))
    parts = F.filter(F.slice(F.split("key", "_"), 2, 1_000_000), lambda p: p.rlike(r"^\d+$"))
    df = df.withColumn("video_name", F.when(joined, F.substring_index("key", "_", 1)).otherwise(F.lit("clip1.mp4"))).withColumn("zero", F.lit(0.0))
    df = tables.with_offsets(df, videos, "zero").withColumn("track_id", F.coalesce(F.when(joined, F.get(parts, F.lit(0)).try_cast("long")), F.lit(0)))
    iso, camera, kind = naming.iso_time(F.col("camera_timestamp_sec")), naming.camera_id(F.col("video_name")), F.lit("reid")
    meta = F.to_json(F.struct("key", "video_name", camera.alias("camera_id"), "track_id", kind.alias("embedding_type"), F.lit(model).alias("model_name")))
    none = F.lit(None)
    return df.select(
        F.concat(F.lit("reid_"), "key").alias("id"), none.cast("string").alias("global_id"), "track_id", camera.alias("camera_id"), "video_name", kind.alias("embedding_type"), F.lit(model).alias("model_name"),
        F.size("embedding").alias("vector_dim"), "embedding", iso.alias("camera_timestamp_iso"), "camera_timestamp_sec", F.lit(0.0).alias("video_pos_ms"), iso.alias("start_time_iso"), iso.alias("end_time_iso"),
        F.lit("vehicle").alias("class_label"), none.cast("array<double>").alias("bbox"), none.cast("string").alias("crop_path"), meta.alias("metadata"),
    )


MAPPING = "track_key string, global_id string"


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """``MAPPING`` of any of five layouts: matched pairs, lists of tracks, identities, a map under
    ``global_matches``, or a map from identity to its tracks (or from track to identity).

    Groups of pairs are components of all pairs, named by their least key.
    """
    text = spark.read.text(path, wholetext=True).withColumn("v", F.try_parse_json("value")).filter(F.col("v").isNotNull())
    listed = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "item")).withColumn("v", F.try_parse_json("item"))
    name = F.concat(F.lit("global_veh_"), F.col("place") + 1)
    of = lambda path_, to: F.try_variant_get("v", path_, to)
    plain = listed.select(F.explode(of("$", "array<string>")).alias("track_key"), name.alias("global_id"))
    named = listed.select(F.explode(of("$.tracks", "array<string>")).alias("track_key"), F.coalesce(of("$.global_id", "string"), name).alias("global_id"))
    key = lambda side: F.concat(of(f"$.feed_{side}", "string"), F.lit("_"), of(f"$.track_{side}", "string"))
    pairs = listed.select(key("a").alias("a"), key("b").alias("b")).filter("a is not null and b is not null")
    inner = F.try_variant_get("v", "$.global_matches", "map<string,string>")
    direct = text.select(F.explode(inner).alias("track_key", "global_id"))
    others = text.filter(inner.isNull()).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "item")).withColumn("v", F.try_parse_json("item"))
    members = of("$", "array<string>")
    grouped = others.filter(members.isNotNull()).select(F.explode(members).alias("track_key"), F.col("k").alias("global_id"))
    single = others.filter(members.isNull()).select(F.col("k").alias("track_key"), F.col("item").alias("global_id"))
    made = plain.unionByName(named).unionByName(direct).unionByName(grouped).unionByName(single)
    return made.unionByName(paired(pairs))


def paired(pairs: DataFrame) -> DataFrame:
    """``MAPPING`` of ``pairs(a, b)`` of track keys, a group per component."""
    keys = pairs.select(F.col("a").alias("track_key")).union(pairs.select("b")).distinct()
    labels = components(pairs.select(F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y")))
    df = keys.withColumn("node", F.xxhash64("track_key")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = df.groupBy("label").agg(F.min("track_key").alias("global_id"))
    return df.join(least, "label").select("track_key", "global_id")


def crops(listing: DataFrame, folder: str, mapping_: DataFrame | None = None) -> DataFrame:
    """``path, track_id, global_id, camera_id, frame, ts`` of the image files of a listing of paths.

    In folders of tracks the folder is the track; of flat files the name tells it. Tracks without
    a mapping are identities of their own.
    """
    below = F.substring(F.col("path"), F.instr("path", F.lit(folder)) + F.lit(len(folder.rstrip("/")) + 1), F.length("path"))
    df = listing.filter(F.col("path").rlike(IMAGES)).withColumn("_rest", F.ltrim(below, F.lit("/"))).withColumn("name", F.substring_index("_rest", "/", -1))
    inside = F.contains(F.col("_rest"), F.lit("/"))
    df = df.withColumn("track_id", F.when(inside, F.substring_index("_rest", "/", 1)).otherwise(naming.track_of_file(F.col("name"))))
    frame, ts = naming.crop_fields(F.col("name"))
    whole = F.concat_ws("_", "track_id", "name")
    camera = F.regexp_extract(whole, r"(c\d{3}|c\d+)", 1)
    clip = F.regexp_extract(whole, r"clip(\d+)", 1)
    camera = F.when(camera != "", camera).when(clip != "", F.concat(F.lit("c"), F.lpad(clip, F.greatest(F.lit(3), F.length(clip)), F.lit("0")))).otherwise(F.lit("c001"))
    df = df.select("path", "track_id", camera.alias("camera_id"), F.greatest(frame, F.lit(0)).alias("frame"), ts.alias("ts"))
    if mapping_ is None:
        return df.withColumn("global_id", F.col("track_id"))
    known = mapping_.select(F.col("track_key").alias("track_id"), "global_id")
    return df.join(known, "track_id", "left").withColumn("global_id", F.coalesce("global_id", "track_id"))


def crop_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")


def selected(names: DataFrame, requested: list[str]) -> DataFrame:
    """The rows of ``names(name)`` asked for: all for "all"; equal ones, or where there are none those that contain a request."""
    if "all" in (r.lower() for r in requested):
        return names
    asked = names.sparkSession.createDataFrame([(r,) for r in requested], "request string")
    exact = names.join(F.broadcast(asked), F.col("name") == F.col("request"), "left_semi")
    unmet = F.broadcast(asked.join(names, F.col("name") == F.col("request"), "left_anti"))
    part = names.join(unmet, F.contains(F.col("name"), F.col("request")), "left_semi")
    return exact.union(part).distinct()


def views(profiles_: DataFrame, mode: str = "multi_view") -> DataFrame:
    """``doc_id, embedding, metadata``: each view of ``profiles.built``, or one mean per identity."""
    if mode == "mean":
        meta = F.to_json(F.struct("profile.*", F.lit("mean_aggregated").alias("vector_type")))
        return profiles_.filter(F.col("embedding").isNotNull()).select(F.col("global_id").alias("doc_id"), "embedding", meta.alias("metadata"))
    one = profiles_.select("profile", F.explode("views").alias("v"))
    at = F.col("v.ts")
    meta = F.to_json(F.struct(
        *(F.col(f"profile.{c}") for c in ("global_id", "camera_ids", "track_ids", "duration_sec", "num_representative_views", "class_label", "avg_quality_score")),
        F.col("v.view_idx"), F.col("v.camera_id"), F.col("v.track_id"), F.col("v.frame").alias("frame_idx"), at.alias("camera_timestamp"), at.alias("start_time"), at.alias("end_time"),
        F.col("v.quality").alias("quality_score"), F.col("v.path").alias("crop_path"), F.lit("representative_view").alias("vector_type"),
    ))
    return one.select(F.col("v.doc_id"), F.col("v.embedding"), meta.alias("metadata"))


def export_registry(tracks: DataFrame, path: str) -> None:
    """One JSON line per feed: ``feed`` and its ``tracks`` with their models."""
    one = F.struct("track_id", F.col("model").alias("compressed_track"))
    tracks.groupBy("feed").agg(F.sort_array(F.collect_list(one)).alias("tracks")).write.mode("overwrite").json(path)


def keyed_tracks(registry: DataFrame) -> DataFrame:
    """The registry by ``feed:track`` keys."""
    return registry.withColumn("key", F.concat_ws(":", "feed", "track_id"))


def feeds(listing: DataFrame, scene: str) -> DataFrame:
    """``camera, path`` of the videos of a scene, from a listing of scene/camera/name paths."""
    path = F.col("path")
    inside = path.rlike(rf"(?i)/{scene}/c\d+/[^/]+\.(avi|mp4|mkv|mov)$")
    return listing.filter(inside).select(F.regexp_extract(path, rf"/{scene}/(c\d+)/", 1).alias("camera"), "path")


def truth(spark: SparkSession, feeds: dict[str, str], max_frames: int | None = None) -> DataFrame:
    """Ground truth of several feeds, each a headerless CSV file, up to a frame."""
    made = None
    for feed, path in feeds.items():
        df = files.ground_truth_csv(spark, path).withColumn("feed", F.lit(feed))
        made = df if made is None else made.unionByName(df)
    return made if max_frames is None else made.filter(F.col("frame") <= max_frames)
