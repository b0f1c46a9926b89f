"""Helpers shared by the corpus operators: schema guards, column picking and shared-folder checkpoints."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CorpusError(ValueError):
    """A corpus operator was called with a table or option that it can't use; never quotes cell values."""


def require(df: DataFrame, *names: str) -> None:
    """Raises CorpusError unless every name is exactly one column of df (extra columns are fine)."""
    have = [f.name for f in df.schema.fields]
    for name in names:
        if have.count(name) != 1:
            raise CorpusError(f"expected exactly one column {name!r}")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Selects new=old pairs only, so clashing or extra columns of the caller never reach the operator."""
    require(df, *columns.values())
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def by_batch(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]]) -> DataFrame:
    """mapInArrow with a per-task state: make() runs once in each task and returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if not batch.num_rows:
                continue
            step = step or make()
            out = step(batch)
            if out is None:
                continue
            if isinstance(out, pa.Table):
                yield from out.combine_chunks().to_batches()
            else:
                yield out

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> list[Row]:
    """At most `rows` rows, picked by a hash of the keys and in its order; all rows if there are no more.

    The rows are counted first and those below a share of the hash range are sent, so that the driver gets about as many
    as it keeps, however many tasks there are.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    # Three standard deviations more than are wanted, so that hardly ever fewer come.
    share = min(1.0, (rows + 3.0 * rows**0.5 + 3.0) / max(1, total))
    picked = df.withColumn("__place", place).where(F.col("__place") < int(share * (1 << 40)) + 1) if share < 1 else df.withColumn("__place", place)
    return sorted(picked.collect(), key=lambda r: (r["__place"], repr(tuple(r))))[:rows]


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master a temporary one set here."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise CorpusError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"plenum-{spark.sparkContext.applicationId}")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder, so that a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
