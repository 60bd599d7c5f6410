"""Preference-data preparation: group, drop repeats, regroup, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import group_items, suffix_order
from ..operators.filters import sized_groups
from ..operators.projections import group_of, suffix_of
from ..operators.windows import first_occurrence, rank_in_group


def grouped_rows(rows: DataFrame, utt: str, line: str, least: int = 2, most: int = 0) -> DataFrame:
    """Rows with group_id, suffix_idx, group_rank and group_size; groups outside least..most go."""
    named = rows.withColumn("group_id", group_of(F.col(utt))).withColumn("suffix_idx", suffix_of(F.col(utt))).filter(F.coalesce(F.col(utt), F.lit("")) != "")
    order = [suffix_order("suffix_idx"), F.col(utt), F.col(line)]
    return rank_in_group(sized_groups(named, "group_id", least, most), "group_id", order)


def drop_repeats(rows: DataFrame, fingerprint: Column, line: str) -> DataFrame:
    """The first row of each fingerprint in a group; rows without one stay."""
    return first_occurrence(rows.withColumn("__fp", fingerprint), ["group_id", "__fp"], [F.col(line)], keep_null=F.col("__fp")).drop("__fp")


def regrouped(rows: DataFrame, utt: str, line: str, items: list[str]) -> DataFrame:
    """One row a group with its items in order; a missing suffix comes first here."""
    known = rows.withColumn("group_id", F.coalesce("group_id", F.lit("__NO_GROUP__")))
    order = [suffix_order("suffix_idx", missing_first=True), F.col("group_rank"), F.col(utt), F.col(line)]
    return group_items(known, "group_id", order, items)


def prepare(rows: DataFrame, utt: str, line: str, fingerprint: Column, items: list[str], least: int = 2, most: int = 0) -> DataFrame:
    """All three stages. Window and regrouping share the partitioning by group_id."""
    return regrouped(drop_repeats(grouped_rows(rows, utt, line, least, most), fingerprint, line), utt, line, items)
