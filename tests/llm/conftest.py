import datetime

import pytest


@pytest.fixture(scope="session")
def clashing(spark):
    """Adds columns whose names clash with those that operators use inside, and one of an odd type."""

    def add(df):
        for name in ("id", "words", "bucket", "kind", "a", "b", "label", "value", "start_pos", "rank"):
            if name not in df.columns:
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit(datetime.date(2026, 1, 1)))
        return df

    return add
