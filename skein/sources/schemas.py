"""Schemas of the tables of videos, tracks and embeddings, and empty tables of them.

Where an index would serve lookups, tables are partitioned by ``embedding_type`` and
``model_name`` and sorted by camera and time within files, so scans prune by statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import vectors

VIDEOS = "video_name string, camera_id string, video_index int, start_timestamp_sec double, start_timestamp_iso string, duration_sec double, metadata string"
TRACKS = (
    "id string, global_id string, track_id long, camera_id string, video_name string, start_time_iso string, end_time_iso string, "
    "camera_timestamp_iso string, camera_timestamp_sec double, start_time double, end_time double, class_label string, metadata string"
)
EMBEDDINGS = (
    "id string, global_id string, track_id long, camera_id string, video_name string, embedding_type string, model_name string, "
    "vector_dim int, embedding array<float>, camera_timestamp_iso string, camera_timestamp_sec double, video_pos_ms double, "
    "start_time_iso string, end_time_iso string, class_label string, bbox array<double>, crop_path string, metadata string"
)
EVERY = {"videos": VIDEOS, "tracks": TRACKS, "embeddings": EMBEDDINGS}


def create(spark: SparkSession, folder: str) -> None:
    """The three tables, empty, as Parquet; what was there is replaced."""
    for name, schema in EVERY.items():
        refresh(spark.createDataFrame([], schema), f"{folder}/{name}.parquet")


def refresh(df: DataFrame, path: str) -> None:
    """Replace a whole table."""
    df.write.mode("overwrite").parquet(path)


def opened(spark: SparkSession, folders: list[str | None], name: str) -> DataFrame:
    """A table of the first folder that has it; an empty one of its schema where none does."""
    hadoop = spark._jsc.hadoopConfiguration()
    for folder in folders:
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
            if path.getFileSystem(hadoop).exists(path):
                return spark.read.parquet(f"{folder}/{name}.parquet")
    return spark.createDataFrame([], EVERY[name])


def prepared(embeddings: DataFrame, kind: str = "retrieval") -> DataFrame:
    """The embeddings of a kind, of unit length where they aren't zero."""
    n = vectors.norm(F.col("embedding"))
    unit = F.when(n > 0, F.transform("embedding", lambda x: (x / n).cast("float"))).otherwise(F.col("embedding"))
    return embeddings.filter(F.col("embedding_type") == kind).withColumn("embedding", unit)
