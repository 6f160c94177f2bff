"""K-means with its silhouette, and projection to the plane, by MLlib."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


def kmeans(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Add ``cluster``; at most one cluster per row."""
    rows = _features(df)
    model = KMeans(k=max(2, min(k, df.count())), seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows)


def silhouette(clustered: DataFrame) -> float:
    """Cosine silhouette; -1 for one cluster."""
    if clustered.select("cluster").distinct().limit(2).count() < 2:
        return -1.0
    return ClusteringEvaluator(distanceMeasure="cosine", predictionCol="cluster", featuresCol="features").evaluate(clustered)


def summary(clustered: DataFrame, member: str, top: int = 3) -> DataFrame:
    """Rows, share and the ``top`` most frequent members of each cluster."""
    by = clustered.groupBy("cluster", member).agg(F.count("*").alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("c"), F.col(member).alias("m")))), 1, top)
    grouped = by.groupBy("cluster").agg(F.sum("n").alias("n"), F.transform(best, lambda x: x.m).alias("top"))
    total = clustered.agg(F.count("*").alias("_all"))
    return grouped.crossJoin(F.broadcast(total)).select("cluster", "n", F.round(100 * F.col("n") / F.col("_all"), 4).alias("share"), "top")


def plane(df: DataFrame) -> DataFrame:
    """Add ``px, py``: the first two principal components."""
    rows = _features(df)
    out = PCA(k=2, inputCol="features", outputCol="_p").fit(rows).transform(rows).withColumn("_p", vector_to_array("_p"))
    return out.withColumn("px", F.col("_p")[0]).withColumn("py", F.col("_p")[1]).drop("_p", "features")
