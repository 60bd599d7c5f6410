"""Joins and lookups. Catalyst and AQE choose the strategy; nothing is broadcast by hint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import latest, numbered


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """A lookup side with one row a key: the last in order."""
    return latest(df, keys, order)


def star(base: DataFrame, *sides: tuple[DataFrame, Sequence[str] | Column, str]) -> DataFrame:
    """``base`` joined to each side in turn."""
    for side, on, how in sides:
        base = base.join(side, on if isinstance(on, Column) else list(on), how)
    return base


def compare_full(left: DataFrame, right: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Full outer comparison: presence flags, both values and right minus left of each metric."""
    a = left.select(F.col(key).alias("__a"), *[F.col(m).alias(f"{m}_left") for m in metrics])
    b = right.select(F.col(key).alias("__b"), *[F.col(m).alias(f"{m}_right") for m in metrics])
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    columns = [F.coalesce("__a", "__b").alias(key), F.col("__a").isNotNull().alias("in_left"), F.col("__b").isNotNull().alias("in_right")]
    for m in metrics:
        columns += [F.col(f"{m}_left"), F.col(f"{m}_right"), (F.col(f"{m}_right") - F.col(f"{m}_left")).alias(f"{m}_diff")]
    return both.select(*columns)


def cross_in_group(df: DataFrame, group: Sequence[str], role: str, base: str, candidate: str, metrics: Sequence[str], name: str) -> DataFrame:
    """Every base row with every candidate row of its group; groups without either give none."""
    a = df.filter(F.col(role) == base).select(*group, F.col(name).alias(f"base_{name}"), *[F.col(m).alias(f"base_{m}") for m in metrics])
    b = df.filter(F.col(role) == candidate).select(*group, F.col(name).alias(f"cand_{name}"), *[F.col(m).alias(f"cand_{m}") for m in metrics])
    return a.join(b, list(group))


def improvement(base: Column, candidate: Column) -> Column:
    """Relative improvement in percent, null where the base is 0."""
    return F.try_divide((base - candidate) * 100.0, base)


def fallback(df: DataFrame, lookups: Sequence[tuple[DataFrame, str, str]], value: str, *inline: Column) -> DataFrame:
    """``value`` from the first lookup (frame, key of df, key of frame) that has it, else from ``inline``."""
    found = []
    for i, (side, own, other) in enumerate(lookups):
        named = side.select(F.col(other).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        df = df.join(named, df[own] == named[f"__k{i}"], "left").drop(f"__k{i}")
        found.append(F.col(f"__v{i}"))
    return df.withColumn(value, F.coalesce(*found, *inline)).drop(*[f"__v{i}" for i in range(len(lookups))])


def common_keys(key: str, *sides: DataFrame) -> DataFrame:
    out = sides[0].select(key)
    for side in sides[1:]:
        out = out.intersect(side.select(key))
    return out


def zip_rows(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """Rows paired by position as far as the shorter side goes, with column ``rn``."""
    return numbered(left, left_order, "rn").join(numbered(right, right_order, "rn"), "rn")


def pending(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not done yet."""
    return all_rows.join(done.select(key).distinct(), key, "left_anti")


def unmatched_count(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti").agg(F.count("*").alias("unmatched"))


def round_robin(df: DataFrame, others: DataFrame, order: Sequence[Column], other_order: Sequence[Column], n: int) -> DataFrame:
    """Row i of ``df`` with row i mod n of the n ``others``."""
    a = numbered(df, order, "__i").withColumn("__slot", F.pmod(F.col("__i") - 1, F.lit(n))).drop("__i")
    b = numbered(others, other_order, "__j").withColumn("__slot", F.col("__j") - 1).drop("__j")
    return a.join(b, "__slot").drop("__slot")


def counter_difference(before: DataFrame, after: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """After minus before; rows that were not there before keep their value."""
    old = before.select(*keys, *[F.col(c).alias(f"__{c}") for c in counters])
    joined = after.join(old, list(keys), "left")
    return joined.select(*keys, *[(F.col(c) - F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) for c in counters])


def complete_groups(df: DataFrame, group: str, condition: Column) -> DataFrame:
    """Groups all of whose rows meet the condition (null counts as not met)."""
    return df.groupBy(group).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("__all")).filter("__all").select(group)


def rows_of(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    return df.join(groups, key, "left_semi")


def explode_lookup(df: DataFrame, lists: DataFrame, key: str, values: str) -> DataFrame:
    """Each row with each of its key's listed values: columns ``tts_index`` and ``tts_text``."""
    return df.join(lists.select(key, F.posexplode(values).alias("tts_index", "tts_text")), key)
