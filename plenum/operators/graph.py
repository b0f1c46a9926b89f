"""Connected components by joins, and the shared folder that iterations write to."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Computes df once into the folder of spark.checkpoint.dir; a local session without one gets a temporary folder.

    Files in a shared folder outlive a lost executor, and the lineage of an iteration stays short.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + os.path.join(tempfile.gettempdir(), f"plenum-{context.applicationId}")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Edges whose parts one task finds at most; more are joined in rounds.
LOCAL_EDGES = 2_000_000


def spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of a graph beside the smallest node of its connected part, roots left out."""
    if not len(left):
        return left, right
    names, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        # The label of the label, until labels are roots.
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        # A root that lost its place takes its whole part along.
        np.minimum.at(new, label, new)
        label = new[new]
    rest = np.flatnonzero(label != np.arange(len(names)))
    return names[label[rest]], names[rest]


def _local_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label) of all nodes of the edges (a, b) in one task."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return
    table = pa.Table.from_batches(kept)
    coded = pa.concat_arrays([c for name in ("a", "b") for c in table[name].chunks]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    # Numbers in the order of the keys.
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    flat = rank[coded.indices.to_numpy()]
    label = np.arange(len(order))
    root, node = spanning(flat[: table.num_rows], flat[table.num_rows :])
    label[node] = root
    names = coded.dictionary.take(pa.array(order))
    for i in range(0, len(label), 50_000):
        yield pa.RecordBatch.from_arrays([names[i : i + 50_000], names.take(pa.array(label[i : i + 50_000]))], names=["key", "label"])


def components(nodes: DataFrame, edges: DataFrame, *, node: str = "key") -> DataFrame:
    """(key, component) of an undirected graph given as nodes and edges (a, b); component is the smallest key.

    Every round each node takes the smallest label around it and then the label of that label, so chains close in
    about the logarithm of their length; it goes on until no label moves.  Up to LOCAL_EDGES edges one task does it.  Nodes without an edge never enter the iteration.
    """
    edges = checkpointed(edges.select("a", "b").where(F.col("a") != F.col("b")))
    kind = edges.schema["a"].dataType.simpleString()
    if edges.count() <= LOCAL_EDGES and kind == edges.schema["b"].dataType.simpleString():
        labels = checkpointed(edges.coalesce(1).mapInArrow(_local_components, f"key {kind}, label {kind}"))
        return _with_components(nodes, labels, node)
    both = checkpointed(edges.union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "key"))
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        step = labels.join(near, "key").select("key", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = step.join(labels.select(F.col("key").alias("new"), F.col("label").alias("further")), "new", "left")
        moved = checkpointed(jump.select("key", F.least("new", F.coalesce("further", "new")).alias("label"), "old"))
        changed = moved.where(F.col("label") < F.col("old")).limit(1).count()
        labels = moved.select("key", "label")
        if not changed:
            break
    return _with_components(nodes, labels, node)


def _with_components(nodes: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    return nodes.select(F.col(node).alias("key")).distinct().join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("component"))
