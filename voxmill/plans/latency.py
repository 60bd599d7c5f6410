"""Latency reports of one run, of two runs side by side, and of streamed requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import real_time_factor, unpivot, with_percentiles


def summary(df: DataFrame, by: Sequence[str], status: str, metrics: Sequence[str], done: str, duration: str) -> DataFrame:
    """Row, ok and fail counts; mean, p50, p95 of each metric over ok rows; mean duration; real-time factor."""
    ok = F.col(status) == "ok"
    columns: list[Column] = [F.count("*").alias("rows"), F.count_if(ok).alias("ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("fail")]
    for m in metrics:
        columns.append(F.avg(F.when(ok, F.col(m))).alias(f"{m}_mean"))
    columns += [F.avg(F.when(ok, F.col(duration))).alias("duration_mean"), real_time_factor(F.when(ok, F.col(done)), F.when(ok, F.col(duration))).alias("rtf")]
    stats = df.groupBy(*by).agg(*columns)
    out = with_percentiles(stats, df, {m: F.when(ok, F.col(m)) for m in metrics}, (0.5, 0.95), by)
    return out.select(*by, "rows", "ok", "fail", *[f"{m}_{n}" for m in metrics for n in ("mean", "p50", "p95")], "duration_mean", "rtf")


def paired_summary(left: DataFrame, right: DataFrame, key: str, status: str, metrics: Sequence[str]) -> DataFrame:
    """Long format: one counts row and one row a metric, means over pairs with both sides ok.

    Values are rounded to six places before they are averaged, as the files between the
    two steps hold them.
    """
    a = left.select(F.col(key), F.col(status).alias("ls"), *[F.round(m, 6).alias(f"l_{m}") for m in metrics])
    b = right.select(F.col(key), F.col(status).alias("rs"), *[F.round(m, 6).alias(f"r_{m}") for m in metrics])
    both = a.join(b, key, "full_outer")
    ok = F.coalesce((F.col("ls") == "ok") & (F.col("rs") == "ok"), F.lit(False))
    one = both.agg(
        F.count("ls").alias("cl"),
        F.count("rs").alias("cr"),
        *[x for m in metrics for x in (F.avg(F.when(ok, F.col(f"l_{m}"))).alias(f"al_{m}"), F.avg(F.when(ok, F.col(f"r_{m}"))).alias(f"ar_{m}"))],
    )
    rows = [("rows", (F.col("cl").cast("double"), F.col("cr").cast("double")))] + [(m, (F.col(f"al_{m}"), F.col(f"ar_{m}"))) for m in metrics]
    return unpivot(one, "metric", rows, ("left_value", "right_value"))


def request_report(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row a metric: mean, population variance (in squared units), p50, p90, p95, p99."""
    names = ("mean", "variance", "p50", "p90", "p95", "p99")
    stats = df.agg(*[c.alias(f"{m}_{n}") for m in metrics for n, c in (("mean", F.avg(m)), ("variance", F.var_pop(m)))])
    one = with_percentiles(stats, df, {m: F.col(m) for m in metrics}, (0.5, 0.9, 0.95, 0.99))
    return unpivot(one, "metric", [(m, [F.col(f"{m}_{n}") for n in names]) for m in metrics], names)


def chunk_latencies(chunks: DataFrame, request: str, time: str) -> DataFrame:
    """First and second chunk of each request; the second is null where there is one only."""
    two = F.slice(F.array_sort(F.collect_list(time)), 1, 2)
    return chunks.groupBy(request).agg(two.alias("__t")).select(request, F.get("__t", F.lit(0)).alias("first_chunk"), F.get("__t", F.lit(1)).alias("second_chunk"))


def series_summary(df: DataFrame, by: Sequence[str], step: str, value: str) -> DataFrame:
    """Count, first and last step and value, least, largest, mean, change and slope of a scalar series."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min(step).alias("first_step"),
        F.max(step).alias("last_step"),
        F.min_by(value, step).alias("first_value"),
        F.max_by(value, step).alias("last_value"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
    )
    delta = F.col("last_value") - F.col("first_value")
    return out.withColumn("delta", delta).withColumn("slope", delta / F.greatest(F.col("last_step") - F.col("first_step"), F.lit(1)))
