"""Predicates and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_fields import all_failures, first_failure


def frames(tokens: Column, duration: Column | None = None) -> Column:
    """Frames of a sample: four a token, else a hundred a second, else null."""
    by_time = F.lit(None).cast("double") if duration is None else duration * 100
    return F.when(tokens.isNotNull(), tokens.cast("double") / 25 * 100).otherwise(by_time)


def length_ok(
    frame_count: Column,
    token_count: Column,
    max_length: int = 10240,
    min_length: int = 10,
    token_max: int = 200,
    token_min: int = 1,
    min_ratio: float = 0.0005,
    max_ratio: float = 1.0,
) -> Column:
    """FLT-01: bounds are inclusive, the ratio counts only where there are frames, null frames fail."""
    ratio = token_count / frame_count
    good = frame_count.between(min_length, max_length) & token_count.between(token_min, token_max) & ((frame_count == 0) | ratio.between(min_ratio, max_ratio))
    return F.coalesce(good, F.lit(False))


def both_filled(chosen: Column, rejected: Column, online: bool = False) -> Column:
    return F.lit(True) if online else (F.coalesce(F.size(chosen), F.lit(0)) > 0) & (F.coalesce(F.size(rejected), F.lit(0)) > 0)


def not_prefixed(c: Column, prefix: str) -> Column:
    """False for values that begin with the literal; null counts as empty."""
    return ~F.startswith(F.coalesce(c, F.lit("")), F.lit(prefix))


def sized_groups(df: DataFrame, group: str, least: int, most: int = 0) -> DataFrame:
    """Rows of groups of least..most rows (0: no upper bound)."""
    n = F.count("*").over(Window.partitionBy(group))
    out = df.withColumn("__n", n).filter(F.col("__n") >= least)
    return (out.filter(F.col("__n") <= most) if most else out).drop("__n")


def unique_token_group(items: Column, token: str, size: int) -> Column:
    """The first reason why a group is no set of ``size`` distinct token lists, null if it is one."""
    prints = F.transform(items, lambda x: F.md5(F.to_json(x[token])))
    return first_failure(
        (F.size(items) == size, "wrong_size"),
        (~F.exists(items, lambda x: x[token].isNull()), "missing_token"),
        (F.size(F.array_distinct(prints)) == size, "repeated_token"),
    )


def strict_quality(mos: Column, snr: Column, similarity: Column, score: Column) -> Column:
    return (mos >= 3.6) & (snr >= 30) & (similarity >= 0.85) & (score >= 0.82)


def record_errors(text: Column, tokens: Column, vocabulary: int = 6561) -> Column:
    """FLT-07: all hard errors of a record as an array."""
    return all_failures(
        (F.trim(F.coalesce(text, F.lit(""))) != "", "empty_text"),
        (tokens.isNotNull(), "no_tokens"),
        (F.coalesce(F.size(tokens), F.lit(0)) > 0, "empty_tokens"),
        (F.coalesce(F.forall(tokens, lambda x: x.isNotNull() & (x >= 0) & (x < vocabulary)), F.lit(True)), "token_out_of_range"),
    )


def record_warnings(tokens: Column, short: int = 25, long: int = 1500) -> Column:
    n = F.size(tokens)
    return all_failures((n >= short, "short_tokens"), (n <= long, "long_tokens"))


def tag_selected(tag: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Contains one of ``include`` (all if there is none) and none of ``exclude``."""

    def any_of(parts: Sequence[str]) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | tag.contains(p)
        return out

    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def missing_patterns(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Patterns that no row contains; a caller that requires them fails on any row."""
    one = df.agg(*[F.coalesce(F.bool_or(F.col(column).contains(p)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(patterns)])
    rows = F.array(*[F.when(~F.col(f"p{i}"), F.lit(p)) for i, p in enumerate(patterns)])
    return one.select(F.explode(F.array_compact(rows)).alias("missing"))


def short_rows(df: DataFrame, column: str, most: int, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows whose text has at most ``most`` characters."""
    return df.filter(F.length(column) <= most).orderBy(*order).limit(k)


def all_values_have(m: Column, key: str) -> Column:
    """Every struct of a map has the field set."""
    return F.forall(F.map_values(m), lambda v: v[key].isNotNull())


def search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Case-sensitive substring search over several columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).contains(needle), F.lit(False))
    return df.filter(found)


def within_duration(duration: Column, most: float = 30.0, policy: str = "skip") -> Column:
    """FLT-14 as a predicate (``skip``), or a check that raises (``fail``)."""
    good = duration <= most
    return F.when(F.assert_true(good, F.lit("audio is too long")).isNull(), True) if policy == "fail" else good


def paired_ok(left_status: Column, right_status: Column, ok: str = "ok") -> Column:
    return F.coalesce((left_status == ok) & (right_status == ok), F.lit(False))
