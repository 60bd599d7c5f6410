"""The summary of a sweep: what each experiment and epoch gave on each test set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(meta: DataFrame, outputs: DataFrame, key: str, reference: str, hypothesis: str, runs: Sequence[str], test_set: str) -> DataFrame:
    """OPS-02: a row for each run and test set: utterances, how many have an output, error rate in percent, status.

    ``meta`` has (test_set, key, reference), ``outputs`` (runs..., test_set, key, hypothesis). The rate is edits by
    characters over the reference's; it is NA where nothing is paired, whose status is ``missing``. A run that lacks
    some utterances is ``partial``.
    """
    totals = meta.groupBy(test_set).agg(F.count("*").alias("meta_total"))
    every = outputs.select(*runs).distinct().crossJoin(totals)
    pairs = outputs.join(meta, [test_set, key])
    errors = pairs.groupBy(*runs, test_set).agg(
        F.count("*").alias("paired"), F.sum(F.levenshtein(reference, hypothesis)).alias("__e"), F.sum(F.length(reference)).alias("__n")
    )
    out = every.join(errors, [*runs, test_set], "left")
    rate = F.format_string("%.2f", 100 * F.try_divide(F.col("__e"), F.col("__n")))
    paired = F.coalesce("paired", F.lit(0))
    status = F.when(paired == 0, "missing").when(paired < F.col("meta_total"), "partial").otherwise("ok")
    return out.select(*runs, test_set, "meta_total", paired.alias("paired"), F.when(F.col("__n") > 0, rate).otherwise("NA").alias("cer_pct"), status.alias("status"))
