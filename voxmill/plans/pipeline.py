"""Declarative pipelines: a list of named, configured transforms over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

_registry: dict[str, Callable[..., DataFrame]] = {}


def transform(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers ``f(df, **options)`` under a name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _registry:
            raise ValueError(f"transform {name} is there already")
        _registry[name] = f
        return f

    return add


def build(spec: Sequence[str | Mapping[str, Any]], overrides: Mapping[str, Mapping[str, Any]] | None = None) -> Callable[[DataFrame], DataFrame]:
    """One function from a spec such as ``["dedup", {"filter": {"condition": "n > 1"}}]``.

    ``overrides`` changes options of stages by name.
    """
    stages: list[tuple[str, dict[str, Any]]] = []
    for item in spec:
        name, options = (item, {}) if isinstance(item, str) else next(iter(item.items()))
        if name not in _registry:
            raise KeyError(f"no transform {name}; there are {sorted(_registry)}")
        stages.append((name, dict(options or {}) | dict((overrides or {}).get(name, {}))))

    def run(df: DataFrame) -> DataFrame:
        for name, options in stages:
            df = df.transform(_registry[name], **options)
        return df

    return run


@transform("filter")
def _filter(df: DataFrame, condition: str) -> DataFrame:
    return df.filter(condition)


@transform("select")
def _select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.selectExpr(*columns)


@transform("with_columns")
def _with_columns(df: DataFrame, **columns: str) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumns({name: F.expr(e) for name, e in columns.items()})


@transform("first_occurrence")
def _first_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    from pyspark.sql import functions as F

    from ..operators.windows import first_occurrence

    return first_occurrence(df, list(keys), [F.col(c) for c in order])
