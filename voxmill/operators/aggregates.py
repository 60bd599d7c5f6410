"""Aggregations. Every one that depends on order takes it explicitly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import numbered

LAST = 10**9


def suffix_order(suffix: Column | str, missing_first: bool = False) -> Column:
    """Sort key of a numeric suffix; -1 means none and goes last, or first on request."""
    c = F.col(suffix) if isinstance(suffix, str) else suffix
    missing = c.isNull() | (c < 0)
    return F.when(missing, F.lit(-1 if missing_first else LAST)).otherwise(c)


def group_items(df: DataFrame, group: str, order: Sequence[Column], items: Sequence[str], least: int = 1, most: int = 0, name: str = "items") -> DataFrame:
    """One row a group with its rows as an ordered array of structs and their number.

    Sizes outside least..most (0: no upper bound) go before the rows are gathered, so
    an unwanted giant group is never collected.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    sized = df.select(group, *items, *[c.alias(k) for c, k in zip(order, keys)])
    if least > 1 or most:
        w = Window.partitionBy(group)
        sized = sized.withColumn("__n", F.count("*").over(w)).filter((F.col("__n") >= least) & (F.lit(not most) | (F.col("__n") <= most)))
    gathered = sized.groupBy(group).agg(F.count("*").alias("group_size"), F.array_sort(F.collect_list(F.struct(*keys, *items))).alias("__all"))
    return gathered.select(group, "group_size", F.transform("__all", lambda x: F.struct(*[x[i].alias(i) for i in items])).alias(name))


def majority(df: DataFrame, group: str, value: str, order: Sequence[Column]) -> DataFrame:
    """The most frequent value of each group, ties to the one seen first; nulls do not vote.

    Columns: group, unique_count, majority, majority_count, majority_ratio (of all rows). A group
    of nulls has the majority '' with 0 votes.
    """
    # both steps combine before the shuffle, so no group's rows are sorted or meet in one task
    votes = df.groupBy(group, F.col(value).alias("__v")).agg(F.count("*").alias("__c"), F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).alias("__f"))
    voting = F.col("__v").isNotNull()
    best = F.min(F.when(voting, F.struct((-F.col("__c")).alias("c"), F.col("__f").alias("f"), F.col("__v").alias("v"))))
    found = votes.groupBy(group).agg(F.count(F.when(voting, 1)).alias("unique_count"), best.alias("__b"), F.sum("__c").alias("__n"))
    return found.select(
        group,
        "unique_count",
        F.coalesce(F.col("__b.v"), F.lit("")).alias("majority"),
        F.coalesce(-F.col("__b.c"), F.lit(0)).alias("majority_count"),
        (F.coalesce(-F.col("__b.c"), F.lit(0)) / F.col("__n")).alias("majority_ratio"),
    )


def size_distribution(df: DataFrame, *group: str) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("groups"))


def dedup_statistics(df: DataFrame, group: str, kept: Column) -> DataFrame:
    """One row: rows in, out and removed, groups, groups reduced, most removed from one."""
    per = df.groupBy(group).agg(F.count("*").alias("i"), F.count_if(kept).alias("o"))
    return per.agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("total_in"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("total_out"),
        F.coalesce(F.sum(F.col("i") - F.col("o")), F.lit(0)).alias("removed"),
        F.coalesce(F.try_divide(F.sum(F.col("i") - F.col("o")), F.sum("i")), F.lit(0.0)).alias("removed_ratio"),
        F.count("*").alias("groups"),
        F.count_if(F.col("i") > F.col("o")).alias("groups_reduced"),
        F.coalesce(F.max(F.col("i") - F.col("o")), F.lit(0)).alias("max_removed"),
    )


PERCENTS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def _at_ranks(df: DataFrame, value: str, by: Sequence[str], ranks: Column) -> DataFrame:
    """(by..., r, value) at the zero-based ranks that ``ranks`` gives for a group's size ``__n``.

    ``ranks`` is an array of structs with a field ``rank``. The values are sorted once by range
    over the whole table and numbered; a group's ranks are counted from its least number, so
    neither a large group nor the table or the groups as a whole are ever in one task.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    sorted_rows = numbered(rows, [*(F.col(c) for c in by), F.col("__v")], "__rn")
    sizes = sorted_rows.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__rn").alias("__s"))
    wanted = sizes.select("__s", F.explode(ranks).alias("r")).filter(F.col("r.rank").isNotNull() & F.col("__s").isNotNull())
    return sorted_rows.join(wanted, F.col("__rn") == F.col("__s") + F.col("r.rank")).select(*by, "r", F.col("__v").alias("value"))


def floor_percentiles(df: DataFrame, value: str, percents: Sequence[float] = PERCENTS, by: Sequence[str] = ()) -> DataFrame:
    """Percentile ``sorted[floor((n - 1) * p)]`` as rows (by..., p, value)."""
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.floor((F.col("__n") - 1) * F.lit(float(p))).alias("rank")) for p in percents])
    return _at_ranks(df, value, by, ranks).select(*by, F.col("r.p").alias("p"), "value")


def sorted_percentiles(df: DataFrame, value: str, percents: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated percentiles as rows (by..., p, value), for groups of any size.

    ``linear_percentiles`` is the aggregate for groups whose distinct values fit one task.
    """
    pairs = []
    for p in percents:
        at = (F.col("__n") - 1) * F.lit(float(p))
        low = F.floor(at)
        pairs += [
            F.struct(F.lit(float(p)).alias("p"), low.alias("rank"), (1.0 - (at - low)).alias("w")),
            F.struct(F.lit(float(p)).alias("p"), F.when(at > low, low + 1).alias("rank"), (at - low).cast("double").alias("w")),
        ]
    hits = _at_ranks(df, value, by, F.array(*pairs))
    return hits.groupBy(*by, F.col("r.p").alias("p")).agg(F.sum(F.col("value") * F.col("r.w")).alias("value"))


def percentile_columns(df: DataFrame, metrics: Mapping[str, Column], percents: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row a group with a column ``<metric>_p<percent>`` for each metric and percent (0.5 is p50); one sort for all.

    Groups of which no metric has a value are missing.
    """
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("__m"), c.cast("double").alias("__x")) for m, c in metrics.items()])))
    found = sorted_percentiles(long, "__x", percents, [*by, "__m"])
    # p comes from the same literals, so it is compared exactly
    return found.groupBy(*by).agg(*[F.max(F.when((F.col("__m") == m) & (F.col("p") == float(p)), F.col("value"))).alias(f"{m}_p{round(p * 100)}") for m in metrics for p in percents])


def with_percentiles(stats: DataFrame, df: DataFrame, metrics: Mapping[str, Column], percents: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``stats``, a row a group, with the columns of percentile_columns; null where a group has no value."""
    more = percentile_columns(df, metrics, percents, by)
    if not by:
        return stats.crossJoin(more)
    keys = [f"__k{i}" for i in range(len(by))]
    more = more.withColumnsRenamed(dict(zip(by, keys)))
    same = [stats[a].eqNullSafe(more[k]) for a, k in zip(by, keys)]
    return stats.join(more, same, "left").drop(*keys)


def histogram_percentiles(df: DataFrame, bin_column: str, low: float, high: float, bins: int, percents: Sequence[float]) -> DataFrame:
    """Midpoint of the first bin whose running count reaches p * n."""
    width = (high - low) / bins
    counts = df.filter(F.col(bin_column).isNotNull()).groupBy(bin_column).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(F.lit(0))  # at most ``bins`` rows
    upto = counts.withColumn("__u", F.sum("__c").over(w.orderBy(bin_column))).withColumn("__n", F.sum("__c").over(w))
    targets = F.explode(F.array(*[F.lit(float(p)) for p in percents]))
    reached = upto.select("*", targets.alias("p")).filter(F.col("__u") >= F.col("p") * F.col("__n"))
    return reached.groupBy("p").agg(F.min(bin_column).alias("bin")).select("p", "bin", (F.lit(low) + (F.col("bin") - 0.5) * F.lit(width)).alias("value"))


def moments(value: str) -> list[Column]:
    """count, mean, population standard deviation, least and largest."""
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]


def sum_square_moments(value: str) -> list[Column]:
    """Mean and population standard deviation from sum and sum of squares, the variance kept at 0 or more."""
    n, s, q = F.count(value), F.sum(value), F.sum(F.col(value) * F.col(value))
    return [n.alias("n"), (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("std")]


def linear_percentiles(value: str | Column, percents: Sequence[float], names: Sequence[str]) -> list[Column]:
    return [F.percentile(value, F.lit(float(p))).alias(n) for p, n in zip(percents, names)]


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (a, b, corr) for every pair of columns, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])))


def mean_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean in doubles as rows (key, pos, value), in one pass over the vectors; null ones don't count."""
    rows = df.filter(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("__v"))
    means = rows.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias("__m"))
    return means.select(key, F.posexplode("__m").alias("pos", "value"))


def gather_vector(df: DataFrame, key: str, name: str = "centroid") -> DataFrame:
    """(key, pos, value) rows back to one ordered array a key."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return df.groupBy(key).agg(F.transform(pairs, lambda p: p["value"]).alias(name))


def cluster_statistics(df: DataFrame, cluster: str, distance: str, outlier: str) -> DataFrame:
    total = df.agg(F.count("*").alias("__all"))
    per = df.groupBy(cluster).agg(
        F.count("*").alias("size"), F.avg(distance).alias("mean_dist"), F.max(distance).alias("max_dist"), F.count_if(outlier).alias("outlier_count")
    )
    per = with_percentiles(per, df, {"d": F.col(distance)}, (0.5, 0.95), [cluster]).withColumnsRenamed({"d_p50": "median_dist", "d_p95": "p95_dist"})
    shares = per.crossJoin(total).withColumn("frac", F.col("size") / F.col("__all")).withColumn("outlier_frac", F.col("outlier_count") / F.col("size"))
    return shares.select(cluster, "size", "mean_dist", "median_dist", "p95_dist", "max_dist", "outlier_count", "frac", "outlier_frac")


def box_statistics(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Data of a box plot a group: quartiles, whiskers within 1.5 times their distance, and how many values lie beyond."""
    box = percentile_columns(df, {"q": F.col(value)}, (0.25, 0.5, 0.75), by)
    reach = F.lit(1.5) * (F.col("q_p75") - F.col("q_p25"))
    box = box.withColumns({"__lo": F.col("q_p25") - reach, "__hi": F.col("q_p75") + reach})
    keys = [f"__k{i}" for i in range(len(by))]
    box = box.withColumnsRenamed(dict(zip(by, keys)))
    rows = df.select(*by, F.col(value).cast("double").alias("__x")).filter("__x is not null")
    rows = rows.join(box, [rows[a].eqNullSafe(box[k]) for a, k in zip(by, keys)]) if by else rows.crossJoin(box)
    inside = F.col("__x").between(F.col("__lo"), F.col("__hi"))
    return rows.groupBy(*by, "q_p25", "q_p50", "q_p75").agg(
        F.min(F.when(inside, F.col("__x"))).alias("low"), F.max(F.when(inside, F.col("__x"))).alias("high"), F.count_if(~inside).alias("beyond")
    )


def heatmap_counts(df: DataFrame, x: Column, y: Column, width: float, height: float) -> DataFrame:
    """Data of a heat map: (x_bin, y_bin, n) of the cells that have a row; rows without a number in both are left out."""
    cells = df.select(F.floor(x / width).alias("x_bin"), F.floor(y / height).alias("y_bin"))
    return cells.filter("x_bin is not null and y_bin is not null").groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))


def unpivot(df: DataFrame, label: str, metrics: Sequence[tuple[str, Sequence[Column]]], names: Sequence[str]) -> DataFrame:
    """A one-row frame of aggregates as one row a metric."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(m).alias(label), *[c.alias(n) for c, n in zip(cols, names)]) for m, cols in metrics])))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def masked_mean(value: Column, mask: Column, clamp: bool = True) -> Column:
    """Mean under a mask; the clamped kind divides by 1 at least, the other gives null."""
    n = F.count_if(mask)
    return F.sum(F.when(mask, value).otherwise(0.0)) / F.greatest(n, F.lit(1)) if clamp else F.try_divide(F.sum(F.when(mask, value)), n)


def real_time_factor(elapsed: Column, duration: Column) -> Column:
    """Sum of elapsed over sum of duration, null unless both are positive."""
    e, d = F.sum(elapsed), F.sum(duration)
    return F.when((e > 0) & (d > 0), e / d)


def examples(value: Column, order: Column, when: Column, k: int) -> Column:
    """The first k values, in order, of rows that meet a condition."""
    pairs = F.array_sort(F.collect_list(F.when(when, F.struct(order.alias("o"), value.alias("v")))))
    return F.transform(F.slice(pairs, 1, k), lambda p: p["v"])
