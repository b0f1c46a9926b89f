"""The table of other wordings that problem 2 reads: field_name, canonical_value, wording.

What people call a role or a housing tenure in seven languages is knowledge that neither the reference list nor its few
aliases hold, so it is an input of its own, like the list.  `wordings.tsv` beside this file, written for this project,
is the default; any table with the three columns can stand in its place, or none.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULT = Path(__file__).with_name("wordings.tsv")
SCHEMA = "field_name string, canonical_value string, wording string"


def read_wordings(spark: SparkSession, path: str | Path = DEFAULT) -> DataFrame:
    """The wordings of a tab-separated file with a header; blank lines are left out."""
    lines = Path(path).read_text(encoding="utf-8").splitlines()[1:]
    rows = [tuple(line.split("\t")) for line in lines if line.strip()]
    return spark.createDataFrame(rows, SCHEMA)
