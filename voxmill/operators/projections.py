"""Row-shaping: ids, roles, nested records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.json_fields import first_failure, first_filled

_UTT = r"^(.*)_([0-9]{3})$"


def group_of(utt: Column) -> Column:
    """The part of an utterance id before its three-digit suffix; the whole id without one."""
    return F.when(utt.rlike(_UTT), F.regexp_extract(utt, _UTT, 1)).otherwise(utt)


def suffix_of(utt: Column) -> Column:
    """The three-digit suffix as a number, -1 without one."""
    return F.when(utt.rlike(_UTT), F.regexp_extract(utt, _UTT, 2).cast("int")).when(utt.isNotNull(), F.lit(-1))


def version_id(suffix: Column, utt: Column) -> Column:
    return F.when(suffix.isNotNull(), F.format_string("v%03d", suffix)).otherwise(F.concat(F.lit("v_"), F.coalesce(utt, F.lit(""))))


def role_of(name: Column, baseline: str, candidate: str) -> Column:
    """baseline where the name begins so, else candidate, else other."""
    return F.when(F.startswith(name, F.lit(baseline)), "baseline").when(F.startswith(name, F.lit(candidate)), "candidate").otherwise("other")


def chat_record(index: Column, prompt: Column, answer: Column, source: str) -> Column:
    return F.struct(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content"))).alias("prompt"),
        F.struct(index.alias("index")).alias("extra"),
    )


def pair_record_reason(chosen: Column, rejected: Column, utt: Column, text: Column, least: int = 2) -> Column:
    """Why a preference pair makes no training record, null where it does."""
    return first_failure(
        (chosen.isNotNull() & rejected.isNotNull(), "bad_token_type"),
        ((F.size(chosen) >= least) & (F.size(rejected) >= least), "token_too_short"),
        (F.coalesce(utt, F.lit("")) != "", "missing_utt"),
        (F.coalesce(text, F.lit("")) != "", "missing_text"),
    )


def pair_text(chosen_text: Column, prompt: Column) -> Column:
    return first_filled(chosen_text, prompt)


def fixed_point(c: Column, places: int = 6) -> Column:
    """Text with a fixed number of places; null is blank."""
    return F.when(c.isNull(), "").otherwise(F.format_string(f"%.{places}f", c))
