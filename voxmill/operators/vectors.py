"""Distances to centroids and outliers by quantile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import squared_distance
from ..storage import fixed
from .aggregates import gather_vector, mean_vector, sorted_percentiles
from .joins import pending


def centroid_distances(df: DataFrame, key: str, vector: str, cluster: str | None = None) -> DataFrame:
    """(key, cluster, distance) to the mean of the row's cluster, or of all rows."""
    rows = df.select(key, (F.col(cluster) if cluster else F.lit(0)).alias("cluster"), F.transform(vector, lambda x: x.cast("double")).alias("__v"))
    centers = gather_vector(mean_vector(rows, "cluster", "__v"), "cluster", "__c")
    return rows.join(centers, "cluster").select(key, "cluster", F.sqrt(squared_distance("__v", "__c")).alias("distance"))


def flag_outliers(df: DataFrame, distance: str, fraction: float) -> DataFrame:
    """``outlier``: distance at or over the (1 - fraction) quantile of all rows.

    The distances are stored, since the quantile and the flags both read them.
    """
    df = fixed(df)
    cut = sorted_percentiles(df, distance, (1.0 - fraction,)).select(F.col("value").alias("__q"))
    return df.crossJoin(cut).withColumn("outlier", F.col(distance) >= F.col("__q")).drop("__q")


def cluster_distances(df: DataFrame, key: str, vector: str, k: int, components: int, seed: int = 42) -> DataFrame:
    """Scale, reduce, cluster: (key, cluster, distance) in the reduced space.

    The scaler divides by the population deviation, as the sample one times sqrt(n / (n - 1)).
    Rows with a null vector have no cluster and are left out; no row, no cluster.
    """
    known = df.filter(F.col(vector).isNotNull())
    size, width = known.agg(F.count("*"), F.max(F.size(vector))).first()
    if not size:
        return df.select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")).limit(0)
    rows = known.select(key, array_to_vector(vector).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(rows).transform(rows)
    most = max(1, min(components, size - 1, width))
    reduced = PCA(k=most, inputCol="scaled", outputCol="reduced").fit(scaled).transform(scaled)
    grow = float((size / (size - 1)) ** 0.5) if size > 1 else 1.0
    reduced = reduced.select(key, array_to_vector(F.transform(vector_to_array("reduced"), lambda x: x * grow)).alias("features"))
    model = KMeans(k=max(1, min(k, size)), seed=seed, featuresCol="features", predictionCol="cluster").fit(reduced)
    points = model.transform(reduced).select(key, "cluster", vector_to_array("features").alias("__v"))
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    return points.select(key, "cluster", F.sqrt(squared_distance("__v", F.get(centers, F.col("cluster")))).alias("distance"))


def cached_embeddings(df: DataFrame, key: str, cache: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Embeddings of all keys of ``df`` from the table ``cache``; those it lacks are computed and added to it.

    ``compute`` takes the rows without an embedding and returns (key, embedding). Work that was
    done before is read, never done again.
    """
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    missing = pending(df, spark.read.parquet(cache), key) if there else df
    compute(missing).write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(df.select(key).distinct(), key, "left_semi")
