"""Samples, orders, pages and sets, all reproducible from keys instead of a generator's state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import hash_order


def sample_rows(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """n rows of least keyed hash; a bounded sort, no shuffle of the table."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def sample_per_label(df: DataFrame, label: str, key: Column, k: int, seed: int) -> DataFrame:
    w = Window.partitionBy(label).orderBy(hash_order(key, seed), key)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def sample_two_levels(df: DataFrame, group: str, key: Column, groups: int, k: int, seed: int) -> DataFrame:
    """k rows of each of ``groups`` groups that have as many."""
    large = df.groupBy(group).agg(F.count("*").alias("__n")).filter(F.col("__n") >= k)
    chosen = large.orderBy(hash_order(F.col(group), seed), group).limit(groups).select(group)
    return sample_per_label(df.join(chosen, group, "left_semi"), group, key, k, seed)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def lookup(df: DataFrame, column: str, value, *order: Column) -> DataFrame:
    return df.filter(F.col(column) == value).orderBy(*order).limit(1)


def natural_label(label: Column) -> list[Column]:
    """Sort keys: baseline first, then by the first number in the label, then by name."""
    return [F.when(label == "baseline", 0).otherwise(1), F.coalesce(F.regexp_extract(label, r"(\d+)", 1).try_cast("int"), F.lit(2**31 - 1)), label]


def latest_checkpoint(df: DataFrame, path: str) -> DataFrame:
    """The path of highest epoch, then highest step, read from its name."""
    number = lambda name: F.coalesce(F.regexp_extract(path, rf"{name}_(\d+)", 1).try_cast("int"), F.lit(-1))
    return df.agg(F.max_by(path, F.struct(number("epoch"), number("step"), F.col(path))).alias("latest"))


def suffix_id(key: Column, seed: int, length: int = 8) -> Column:
    """A short code from a keyed hash; collisions show in ``repeated_codes``."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, length)


def repeated_codes(df: DataFrame, code: str) -> DataFrame:
    return df.groupBy(code).agg(F.count("*").alias("n")).filter("n > 1")


def union_keys(key: str, *sides: DataFrame) -> DataFrame:
    out = sides[0].select(key)
    for side in sides[1:]:
        out = out.unionByName(side.select(key))
    return out.distinct()


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def mix(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Bag union in which each part occurs as often as its weight says."""
    out = None
    for df, times in parts:
        for copy in range(times):
            part = df.withColumn("copy", F.lit(copy))
            out = part if out is None else out.unionByName(part)
    return out


def distinct_in_order(df: DataFrame, value: str, order: Column) -> DataFrame:
    """Distinct values with the least order key of each."""
    return df.groupBy(value).agg(F.min(order).alias("first_at"))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): ``missing`` on the right, ``unexpected`` on the right."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    gone = a.join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    return gone.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))
