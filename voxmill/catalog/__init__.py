"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from . import aggregation, evaluation, files, preparation, relational, texts  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
