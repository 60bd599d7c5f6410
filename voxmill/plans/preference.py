"""Choosing preference pairs with a pluggable judge.

A judge is a function from a pandas frame of candidates (one slice of one group) to the
positions of its best and worst row. The default judges by a score column; nothing
here calls out to a service.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Judge = Callable[[pd.DataFrame], tuple[int, int]]


def score_judge(score: str, key: str) -> Judge:
    """Highest numeric score is best, lowest is worst; ties by least key on either end."""

    def judge(pdf: pd.DataFrame) -> tuple[int, int]:
        by_score, by_key = pdf[score].to_numpy(), pdf[key].to_numpy()
        return int(np.lexsort((by_key, -by_score))[0]), int(np.lexsort((by_key, by_score))[0])

    return judge


def retrying(judge: Judge, tries: int = 3, transient: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)) -> Judge:
    """A judge called again after transient errors; the last error is raised."""

    def run(pdf: pd.DataFrame) -> tuple[int, int]:
        for left in range(tries - 1, -1, -1):
            try:
                return judge(pdf)
            except transient:
                if not left:
                    raise
        raise AssertionError

    return run


def tournament(pdf: pd.DataFrame, judge: Judge, size: int) -> tuple[int, int, int]:
    """(best, worst, calls): rounds over slices of ``size``, winners and losers apart.

    The first round finds both ends of every slice; later rounds halve each side, so it
    ends for every size from 2 on.
    """
    if size < 2:
        raise ValueError("a slice has two candidates at least")
    calls = 0

    def slices(rows: list[int]) -> list[list[int]]:
        return [rows[i : i + size] for i in range(0, len(rows), size)]

    def ends(rows: list[int]) -> tuple[int, int]:
        nonlocal calls
        if len(rows) == 1:
            return rows[0], rows[0]
        calls += 1
        best, worst = judge(pdf.iloc[rows])
        return rows[best], rows[worst]

    pairs = [ends(s) for s in slices(list(range(len(pdf))))]
    high, low = [b for b, _ in pairs], [w for _, w in pairs]
    while len(high) > 1:
        high = [ends(s)[0] for s in slices(high)]
    while len(low) > 1:
        low = [ends(s)[1] for s in slices(low)]
    return high[0], low[0], calls


def champion_challenger(pdf: pd.DataFrame, judge: Judge) -> tuple[int, int]:
    """Sequential duels: the best so far against the next, likewise the worst."""
    best = worst = 0
    for i in range(1, len(pdf)):
        best = [best, i][judge(pdf.iloc[[best, i]])[0]]
        worst = [worst, i][judge(pdf.iloc[[worst, i]])[1]]
    return best, worst


def select_pairs(df: DataFrame, group: str, key: str, order: Sequence[str], judge: Judge, size: int = 6, sequential: bool = False) -> DataFrame:
    """(group, best, worst, candidates) by the judge for each group of two or more.

    A judge error leaves the group out with the reason in ``error``.
    """
    kind = df.schema[key].dataType
    schema = T.StructType().add(group, df.schema[group].dataType).add("best", kind).add("worst", kind).add("candidates", T.LongType()).add("error", T.StringType())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable", ignore_index=True)
        name = pdf[group].iloc[0]
        if len(pdf) < 2:
            return pd.DataFrame({group: [name], "best": [None], "worst": [None], "candidates": [len(pdf)], "error": ["too_few_candidates"]})
        try:
            best, worst = champion_challenger(pdf, judge) if sequential else tournament(pdf, judge, size)[:2]
        except Exception as e:  # noqa: BLE001 - any judge failure is data here
            return pd.DataFrame({group: [name], "best": [None], "worst": [None], "candidates": [len(pdf)], "error": [f"{type(e).__name__}: {e}"]})
        return pd.DataFrame({group: [name], "best": [pdf[key].iloc[best]], "worst": [pdf[key].iloc[worst]], "candidates": [len(pdf)], "error": [None]})

    return df.groupBy(group).applyInPandas(run, schema)


def best_and_worst(df: DataFrame, group: str, key: str, score: str) -> DataFrame:
    """What select_pairs gives for a score judge, without leaving the JVM."""
    high, low = F.struct(F.col(score), -F.col(key)), F.struct(F.col(score), F.col(key))
    return df.groupBy(group).agg(F.max_by(key, high).alias("best"), F.min_by(key, low).alias("worst"), F.count("*").alias("candidates")).filter("candidates > 1")


def accept_pairs(votes: DataFrame, group: str, best_won: Column, keep: Column, margin: Column, confidence: Column, fatal: Column, wins: int = 2, keeps: int = 2, least_margin: float = 1.0, least_confidence: float = 3.0) -> DataFrame:
    """Verification votes by group: counts, signed margin (negative where the loser won), reasons joined by ;."""
    signed = F.when(best_won, margin).otherwise(-margin)
    out = votes.groupBy(group).agg(
        F.count("*").alias("rounds"), F.count_if(best_won).alias("wins"), F.count_if(keep).alias("keeps"), F.bround(F.avg(signed), 4).alias("margin"), F.bround(F.avg(confidence), 4).alias("confidence"), F.count_if(fatal).alias("fatal")
    )
    checks = (
        (F.col("rounds") > 0, "no_votes"),
        (F.col("wins") >= wins, "too_few_wins"),
        (F.col("keeps") >= keeps, "too_few_keeps"),
        (F.col("margin") >= least_margin, "small_margin"),
        (F.col("confidence") >= least_confidence, "low_confidence"),
        (F.col("fatal") == 0, "fatal_errors"),
    )
    reasons = F.concat_ws(";", F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(r)) for good, r in checks])))
    return out.withColumn("reasons", reasons).withColumn("accepted", reasons == "")


def classify_errors(message: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first substring that occurs; else the text behind the first colon."""
    behind = F.trim(F.regexp_extract(message, r"^[^:]*:(.*)$", 1))
    out = F.when(message.isNull(), "unknown")
    for part, label in rules:
        out = out.when(message.contains(part), label)
    return out.otherwise(F.when(behind != "", behind).otherwise(message))


def unique_versions(df: DataFrame, group: str, base: Column, rank: Column, order: Sequence[Column]) -> DataFrame:
    """``version``: the base label, for repeats _rNNN by rank, and _uNNN where that is taken too."""
    first = F.row_number().over(Window.partitionBy(group, "__b").orderBy(*order)) == 1
    named = df.withColumn("__b", base)
    named = named.withColumn("__c", F.when(first, F.col("__b")).otherwise(F.concat(F.col("__b"), F.format_string("_r%03d", rank))))
    again = F.row_number().over(Window.partitionBy(group, "__c").orderBy(*order))
    return named.withColumn("version", F.when(again == 1, F.col("__c")).otherwise(F.concat(F.col("__b"), F.format_string("_u%03d", again)))).drop("__b", "__c")
