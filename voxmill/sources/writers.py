"""Writers. Spark's commit protocol takes the place of locks and renames."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import one_line
from ..operators.projections import fixed_point


def write_json(df: DataFrame, path: str, *order: Column, mode: str = "error") -> None:
    """JSON lines in a global order; non-ASCII text stays as it is."""
    (df.orderBy(*order) if order else df).write.mode(mode).json(path)


def write_tsv(df: DataFrame, path: str, *order: Column, places: int = 6, mode: str = "error") -> None:
    """TSV with header; doubles with fixed places, breaks and tabs in text as blanks."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        columns.append((fixed_point(c, places) if kind in ("double", "float") else one_line(c) if kind == "string" else c).alias(name))
    (df.orderBy(*order) if order else df).select(*columns).write.mode(mode).csv(path, sep="\t", header=True, emptyValue="", quote="")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_summary(counters: DataFrame, path: str, mode: str = "error") -> None:
    """A one-row frame of counters as one JSON document."""
    counters.coalesce(1).write.mode(mode).json(path)


def write_shards(df: DataFrame, path: str, rows: int, key: str, speaker: str, mode: str = "error") -> tuple[DataFrame, DataFrame]:
    """Parquet files of at most ``rows`` rows; returns (key -> file) and (speaker -> files)."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)
    written = df.sparkSession.read.parquet(path).select(key, speaker, F.col("_metadata.file_path").alias("file"))
    return written.select(key, "file"), written.select(speaker, "file").distinct()


def write_by(df: DataFrame, path: str, *columns: str, mode: str = "error") -> None:
    """One folder for each value of the columns."""
    df.write.mode(mode).partitionBy(*columns).parquet(path)


def write_splits(df: DataFrame, path: str, split: str, names: Sequence[str], mode: str = "error") -> None:
    """One table for each split from one pass, as folders of a partitioned table."""
    df.filter(F.col(split).isin(*names)).write.mode(mode).partitionBy(split).json(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows; concurrent writers do not see each other's unfinished files."""
    df.write.mode("append").parquet(path)


def rewrite(df: DataFrame, path: str, keep_backup: bool = True) -> None:
    """Replaces the table at ``path`` by rows that may come from it: written aside, then swapped."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    new, old, older = f"{path}.new-{mark}", f"{path}.bak", f"{path}.bak-{mark}"
    df.write.parquet(new)
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def move(a: str, b: str) -> bool:
        a, b = jvm.org.apache.hadoop.fs.Path(a), jvm.org.apache.hadoop.fs.Path(b)
        return not fs.exists(a) or fs.rename(a, b)

    # an older backup goes last, when the new table is in its place
    if not move(old, older):
        raise OSError(f"cannot move {old} aside")
    if not move(path, old):
        move(older, old)
        raise OSError(f"cannot move {path} aside")
    if not move(new, path):
        move(old, path)
        move(older, old)
        raise OSError(f"cannot move the new table to {path}")
    for gone in (older,) if keep_backup else (older, old):
        fs.delete(jvm.org.apache.hadoop.fs.Path(gone), True)


def write_judged(judged: DataFrame, root: str, batch: int, reason: str = "reason") -> None:
    """One batch of judged pairs: ``pairs`` (JSON lines), ``discarded`` with reasons, ``manifest`` (TSV).

    Each batch has its own folder, which is written anew where the batch is run again.
    """
    judged = judged.persist()
    good = F.col(reason).isNull()
    folder = lambda name: f"{root}/{name}/batch={batch}"
    judged.filter(good).drop(reason).write.mode("overwrite").json(folder("pairs"))
    judged.filter(~good).write.mode("overwrite").json(folder("discarded"))
    write_tsv(judged.filter(good).drop(reason), folder("manifest"), mode="overwrite")
    judged.unpersist()


def write_counted(df: DataFrame, path: str, progress: str, shard: int) -> None:
    """Writes a shard's rows and adds (shard, done) to the progress table; the count comes from the same pass."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("done")).write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    append(spark.createDataFrame([(shard, seen.get["done"])], "shard int, done long"), progress)


def total_progress(spark: SparkSession, progress: str) -> DataFrame:
    """(shards, done) over all shards, the largest count of each."""
    return spark.read.parquet(progress).groupBy("shard").agg(F.max("done").alias("d")).agg(F.count("*").alias("shards"), F.coalesce(F.sum("d"), F.lit(0)).alias("done"))
