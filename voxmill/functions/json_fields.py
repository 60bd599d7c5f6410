"""Tolerant JSON: objects in noisy text, casts that do not raise, checks with a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def embedded_object(c: Column | str) -> Column:
    """The text from the first brace to the last, null where that is no JSON object."""
    found = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def field(c: Column | str, name: str) -> Column:
    return F.get_json_object(col(c), f"$.{name}")


def whole(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), c.try_cast("double").try_cast("int"))


def truth(c: Column) -> Column:
    """true, yes, 1 and 是 are true, everything else false, null null."""
    return F.when(c.isNull(), None).otherwise(F.lower(F.trim(c)).isin("true", "yes", "1", "是"))


def int_list(c: Column | str) -> Column:
    """``[1, 2]`` in text as an array; null where it is none or an item is no integer."""
    ok = col(c).rlike(r"^\s*\[\s*(-?\d+\s*(,\s*-?\d+\s*)*)?\]\s*$")
    return F.when(ok, F.from_json(col(c), "array<int>"))


def has_key(c: Column | str, name: str) -> Column:
    """Presence of a key, also where its value is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(col(c)), name), F.lit(False))


def first_present(c: Column | str, *names: str) -> Column:
    """The value of the first key that is there, null values included."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(has_key(c, name), field(c, name)).otherwise(out)
    return out


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.when(c == "", None).otherwise(c) for c in columns], F.lit(""))


def first_failure(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that fails (false or null), null where all hold."""
    out = None
    for good, reason in checks:
        bad = ~F.coalesce(good, F.lit(False))
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out


def all_failures(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(reason)) for good, reason in checks]))


def pair_result_reason(winner: Column, loser: Column, margin: Column, confidence: Column) -> Column:
    """Why a judge's pair result cannot be used, null where it can."""
    return first_failure(
        (winner.isin("A", "B"), "bad_winner"),
        (loser.isin("A", "B"), "bad_loser"),
        (winner != loser, "same_winner_and_loser"),
        (margin.between(0, 5), "bad_margin"),
        (confidence.between(1, 5), "bad_confidence"),
    )
