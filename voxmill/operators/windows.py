"""Order-dependent operators on window functions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import fixed


def rank_in_group(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Zero-based ``group_rank`` and ``group_size`` on every row."""
    w = Window.partitionBy(group)
    return df.withColumn("group_rank", F.row_number().over(w.orderBy(*order)) - 1).withColumn("group_size", F.count("*").over(w))


def first_occurrence(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], keep_null: Column | None = None) -> DataFrame:
    """The first row of each key; rows where ``keep_null`` is null all stay."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    marked = df.withColumn("__first", first if keep_null is None else first | keep_null.isNull())
    return marked.filter("__first").drop("__first")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in this order (upsert, last-writer-wins)."""
    return first_occurrence(df, keys, [c.desc() for c in order])


def running_share(df: DataFrame, by: Sequence[str], p: str, order: Sequence[Column], top_p: float, top_k: int) -> DataFrame:
    """Nucleus cut: rows by falling p while the share before them is under top_p, at most top_k."""
    w = Window.partitionBy(*by).orderBy(F.desc(p), *order)
    before = F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(p)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("before", before).filter((F.col("before") < top_p) & (F.col("rank") <= top_k))


def trim_runs(df: DataFrame, by: Sequence[str], order: Sequence[Column], flag: Column, most: int) -> DataFrame:
    """Keeps at most ``most`` rows of each run of flagged rows, and all others."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__f", flag).withColumn("__p", F.row_number().over(w))
    own = Window.partitionBy(*by, "__f").orderBy("__p")
    runs = marked.withColumn("__run", F.col("__p") - F.row_number().over(own))
    place = F.row_number().over(Window.partitionBy(*by, "__f", "__run").orderBy("__p"))
    return runs.withColumn("__i", place).filter(~F.col("__f") | (F.col("__i") <= most)).drop("__f", "__p", "__run", "__i")


def recent_repeats(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, span: int) -> DataFrame:
    """``repeats``: how often the row's value occurs among the ``span`` rows before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-span, -1)
    return df.withColumn("repeats", F.size(F.filter(F.collect_list(value).over(w), lambda x: x == F.col(value))))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """Row numbers from 1 over the whole table without one global window.

    Rows are sorted by range into partitions and stored with their place in them, so that
    a lost task cannot cut them otherwise; the sizes of the partitions before give each its
    offset. The sizes are one small row a partition, the rows are shuffled once.
    """
    place = F.monotonically_increasing_id()  # the partition, and 33 bits for the place in it
    ordered = fixed(df.orderBy(*order).withColumn("__vm_id", place))
    part = F.shiftright("__vm_id", 33)
    sizes = ordered.groupBy(part.alias("__vm_part")).agg(F.count("*").alias("__vm_n"))
    before = F.coalesce(F.sum("__vm_n").over(Window.partitionBy(F.lit(0)).orderBy("__vm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__vm_part", before.alias("__vm_o"))
    here = F.col("__vm_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("__vm_part", part).join(offsets, "__vm_part").withColumn(name, (here + F.col("__vm_o") + 1).cast("long")).drop("__vm_part", "__vm_id", "__vm_o")


def split_ends(df: DataFrame, order: Sequence[Column], cv: int, from_tail: bool = True) -> DataFrame:
    """``split``: cv for ``cv`` rows at an end (at most n - 1), train for the rest."""
    rows = numbered(df, order, "__rn").crossJoin(df.agg(F.count("*").alias("__n")))
    held = F.least(F.lit(cv), F.col("__n") - 1)
    test = F.col("__rn") > F.col("__n") - held if from_tail else F.col("__rn") <= held
    return rows.withColumn("split", F.when(test, "cv").otherwise("train")).drop("__rn", "__n")


def hash_split(key: Column, seed: str, ratio: float) -> Column:
    """``cv`` where md5(seed::key), read as a fraction of its first 32 bits, is under the ratio."""
    head = F.conv(F.substring(F.md5(F.concat_ws("::", F.lit(seed), key)), 1, 8), 16, 10).cast("double")
    return F.when(head / F.lit(4294967295.0) < ratio, "cv").otherwise("train")


def circular_window(rn: Column, n: Column, start: int, k: int) -> Column:
    """True for the k rows from the 1-based ``start`` on, going round."""
    first = F.greatest(F.lit(1), F.least(F.lit(start), n))
    return (n <= k) | (F.pmod(rn - first, n) < k)


def even_parts(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``part``: contiguous parts 1..k, the first ones larger by the remainder."""
    rows = numbered(df, order, "__rn").crossJoin(df.agg(F.count("*").alias("__n")))
    small, extra = F.floor(F.col("__n") / k), F.col("__n") % k
    cut = extra * (small + 1)
    i = F.col("__rn") - 1
    part = F.when(i < cut, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - cut) / F.greatest(small, F.lit(1)))) + 1
    return rows.withColumn("part", part.cast("long")).drop("__rn", "__n")


def length_buckets(df: DataFrame, order: Sequence[Column], length: str, size: int) -> DataFrame:
    """``bucket`` of ``size`` consecutive rows, ``place`` by rising length in it."""
    rows = numbered(df, order, "__rn").withColumn("bucket", F.floor((F.col("__rn") - 1) / size))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(length, "__rn"))).drop("__rn")


def static_batches(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    return numbered(df, order, "__rn").withColumn("batch", F.floor((F.col("__rn") - 1) / size)).drop("__rn")


def padded_batches(df: DataFrame, bucket: str, order: Sequence[str], length: str, budget: int, frames_per_token: int = 4) -> DataFrame:
    """Greedy batches within each bucket by padded size, with column ``batch``.

    A row closes the batch where the longest times the rows would pass the budget. The
    fold is sequential only inside a bucket, which is a reader's stream or a run of rows of like
    length; buckets run in parallel and the result does not depend on partitions. Rows come
    sorted and in batches, so a bucket of any size is folded in little memory. A row that
    passes the budget alone is a batch of one; no batch is empty.
    """
    schema = T.StructType([*(f for f in df.schema if f.name != "batch"), T.StructField("batch", T.LongType())])
    plain = df.drop("batch")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = object()
        batch = longest = held = 0
        for pdf in batches:
            out = []
            for name, n in zip(pdf[bucket], pdf[length]):
                if name != now and not (pd.isna(name) and now is None):
                    now, batch, longest, held = None if pd.isna(name) else name, 0, 0, 0
                frames = 0 if pd.isna(n) else int(n) * frames_per_token
                if held and max(longest, frames) * (held + 1) > budget:
                    batch, longest, held = batch + 1, 0, 0
                longest, held = max(longest, frames), held + 1
                out.append(batch)
            yield pdf.assign(batch=out)

    return plain.repartition(bucket).sortWithinPartitions(bucket, *order).mapInPandas(run, schema)


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle key that every engine with md5 can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def buffered_shuffle(batches: Iterator[pd.DataFrame], size: int, seed: int) -> Iterator[pd.DataFrame]:
    """For mapInPandas: fills a buffer of ``size`` rows, shuffles, emits half, keeps half."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        while len(held) >= size:
            mixed = held.iloc[:size].sample(frac=1.0, random_state=seed)
            yield mixed.iloc[: size // 2]
            held = pd.concat([mixed.iloc[size // 2 :], held.iloc[size:]], ignore_index=True)
    if held is not None and len(held):
        yield held.sample(frac=1.0, random_state=seed)
