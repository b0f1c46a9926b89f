"""Canonical column names of the mapped comments table, and small schema guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import PlenumError

COMMENT, PERIOD, RESPONDENT, POSITION = "comment_text", "date_or_hearing", "respondent_id", "row_position"
SUBGROUP_PREFIX = "subgroup__"
#: Columns that can't be chosen as subgroups.
RESERVED = frozenset({COMMENT, PERIOD, RESPONDENT, "source_row"})
MISSING_PERIOD, SINGLE_PERIOD = "Missing period", "All comments"
SENTIMENTS = ("negative", "neutral", "positive")
EMOTIONS = ("anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise")


def unique_columns(df: DataFrame, error: type[PlenumError]) -> None:
    if len(set(df.columns)) != len(df.columns):
        raise error("Provide a table with unique column names.")


def scalar_columns(df: DataFrame, columns: Iterable[str], error: type[PlenumError]) -> None:
    """Raises unless every column exists and holds single values, not arrays, maps or structs."""
    for name in columns:
        if name not in df.columns:
            raise error("Select columns that the table has.")
        if isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise error("Cells must hold single values.")


def subgroup_columns(df: DataFrame, columns: list[str] | None, error: type[PlenumError]) -> list[str]:
    """The chosen subgroup columns, or every column with the subgroup prefix."""
    if isinstance(columns, str):
        raise error("Select subgroup columns as a list.")
    chosen = list(columns) if columns is not None else [c for c in df.columns if c.startswith(SUBGROUP_PREFIX)]
    if len(set(chosen)) != len(chosen) or any(c not in df.columns or c in RESERVED for c in chosen):
        raise error("Select distinct subgroup columns, separate from text and identifiers.")
    scalar_columns(df, chosen, error)
    return chosen


def whole_number(value: object, least: int, error: type[PlenumError], what: str) -> int:
    if type(value) is not int or value < least:
        raise error(f"{what} must be a whole number of at least {least}.")
    return value
