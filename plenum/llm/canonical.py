"""Problem 2: map freely typed values to the closest entry of a reference list.

The reference entries, their aliases and the wordings of a further input table stand in
BK-trees under the unrestricted Damerau-Levenshtein distance, a true metric, so the triangle
inequality lets a search skip subtrees and still return every entry within the threshold.
Every value goes through the trees; each is walked once for a whole batch of values: a node
compares its entry with all values still alive.  A tree holds one shard of the entries, and
the winners of the shards merge.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_batch, narrow
from .wordings import read_wordings

#: Entries of one tree, and entries (some tens of megabytes) that are sent to the executors at once; a larger list takes several passes over the distinct values.
SHARD_ENTRIES, BLOCK_ENTRIES = 50_000, 1_000_000
#: Distinct values of one task.
TASK_VALUES = 1_000

# What people add around the value itself.
_BEFORE = re.compile(r"^(?:i am an?|i m an?|i am|i m|an?|the|currently|soy|sou|jestem|我是)\s+(?=\S)|^我是")
_AFTER = re.compile(r"\s*(?:\([^()]*\)|@.*|/.*|,.*|\s[-–]\s.*)$")


def _key(text: str) -> str:
    """Case, width, punctuation and spacing removed; letters, marks and digits stay."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join("".join(c if c.isalnum() or unicodedata.category(c)[0] == "M" else " " for c in folded).split())


def variants(text: str) -> list[str]:
    """The keys under which a typed value is looked up: as a whole, and without what was added before or after it."""
    folded = unicodedata.normalize("NFKC", text).casefold().strip()
    bare = _AFTER.sub("", folded)
    keys = [_key(folded), _key(bare)]
    keys += [_BEFORE.sub("", k) for k in keys]
    return [k for k in dict.fromkeys(keys) if k]


def threshold(length: int) -> int:
    """Edits allowed for a key of this length: short words must be exact, as another word is always near."""
    return 0 if length <= 3 else 1 if length == 4 else 2 if length < 16 else 3


#: Cells of the distance tables that are filled at a time.
CELLS = 8_000_000


def pair_distances(left: np.ndarray, left_length: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of each row of `left` to the same row of `right` (code points, padded).

    All pairs go through the table together; pairs of like length are taken at a time.
    """
    out = np.zeros(len(left), np.int64)
    order = np.lexsort((right_length, left_length))
    begin = 0
    while begin < len(order):
        size = max(1, CELLS // ((int(left_length[order[begin]]) + 3) * (int(right_length.max()) + 2)))
        part = order[begin : begin + size]
        begin += len(part)
        la, lb = left_length[part], right_length[part]
        out[part] = _tables(np.ascontiguousarray(left[part, : int(la.max(initial=0))].T), la, np.ascontiguousarray(right[part, : int(lb.max(initial=0))].T), lb)
    return out


def _tables(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    height, n = a.shape
    width = len(b)
    top = height + width
    # table[i][j] is d(i-1, j-1) of the textbook recurrence, with a border of large values.
    table = np.full((height + 2, width + 2, n), top, np.int16)
    table[1, 1:] = np.arange(width + 1, dtype=np.int16)[:, None]
    table[1:, 1] = np.arange(height + 1, dtype=np.int16)[:, None]
    last_row = np.zeros((width, n), np.int16)  # last i with a[i] equal to the right character at j
    rows = np.arange(n)
    for i in range(1, height + 1):
        last_column = np.zeros(n, np.int16)
        same_row = b == a[i - 1]
        for j in range(1, width + 1):
            same = same_row[j - 1]
            best = table[i, j] + ~same
            np.minimum(best, table[i + 1, j] + 1, out=best)
            np.minimum(best, table[i, j + 1] + 1, out=best)
            if i > 1 and j > 1:
                i1 = last_row[j - 1]
                swap = np.flatnonzero(i1.astype(bool) & last_column.astype(bool))
                if len(swap):
                    i0, j0 = i1[swap], last_column[swap]
                    moved = table[i0, j0, rows[swap]] + (i - i0 - 1) + 1 + (j - j0 - 1)
                    best[swap] = np.minimum(best[swap], moved)
            table[i + 1, j + 1] = best
            last_column[same] = j
        last_row[same_row] = i
    return table[la + 1, lb + 1, rows].astype(np.int64)


def edit_distances(entry: str, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The distance of one entry to each value."""
    one, size = _rows([entry])
    return pair_distances(np.repeat(one, len(values), axis=0), np.repeat(size, len(values)), values, lengths)


def _rows(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(k) for k in keys], np.int64)
    out = np.zeros((len(keys), int(lengths.max(initial=0))), np.int32)
    for i, k in enumerate(keys):
        out[i, : len(k)] = np.frombuffer(k.encode("utf-32-le"), np.int32)
    return out, lengths


class Tree:
    """A BK-tree over distinct keys."""

    def __init__(self, keys: Iterable[str]) -> None:
        self.keys = sorted(set(keys))
        self.children: list[dict[int, int]] = [{} for _ in self.keys]
        if not self.keys:
            return
        # All keys go down together: those that reach a node at the same distance share a child.
        values, lengths = self.codes, self.lengths = _rows(self.keys)
        work = [(0, np.arange(1, len(self.keys)))]
        while work:
            node, below = work.pop()
            if not len(below):
                continue
            far = edit_distances(self.keys[node], values[below], lengths[below])
            for d in np.unique(far):
                group = below[far == d]
                self.children[node][int(d)] = int(group[0])
                work.append((int(group[0]), group[1:]))

    def search(self, keys: list[str], radius: np.ndarray) -> list[list[tuple[int, str]]]:
        """For each key all entries within its radius, as (distance, entry)."""
        out: list[list[tuple[int, str]]] = [[] for _ in keys]
        if not self.keys or not keys:
            return out
        longest = max(map(len, self.keys))
        fit = np.array([i for i, k in enumerate(keys) if len(k) <= longest + radius[i]], np.int64)
        if not len(fit):
            return out
        values, lengths = _rows([keys[i] for i in fit])
        radius = radius[fit]
        # Level by level: all values that are alive at any node of a level are compared in one go.
        node, alive = np.zeros(len(fit), np.int64), np.arange(len(fit))
        while len(node):
            far = pair_distances(self.codes[node], self.lengths[node], values[alive], lengths[alive])
            for k in np.flatnonzero(far <= radius[alive]):
                out[fit[alive[k]]].append((int(far[k]), self.keys[node[k]]))
            order = np.argsort(node, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(node[order]) != 0, True])
            next_node, next_alive = [], []
            for x, y in zip(edge, edge[1:], strict=False):
                here = order[x:y]
                children = self.children[int(node[here[0]])]
                if not children:
                    continue
                at, child = np.array(list(children)), np.array(list(children.values()))
                i, j = np.nonzero(np.abs(far[here][:, None] - at) <= radius[alive[here]][:, None])
                next_node.append(child[j]), next_alive.append(alive[here[i]])
            node, alive = (np.concatenate(parts) if parts else np.zeros(0, np.int64) for parts in (next_node, next_alive))
        return out


class Matcher:
    """Winners of one shard of the reference list for one field."""

    def __init__(self, entries: list[tuple[int, str]]) -> None:
        self.owners: dict[str, int] = {}
        for canonical_id, name in sorted(entries):
            self.owners.setdefault(_key(name), canonical_id)
        self.owners.pop("", None)
        self.tree = Tree(self.owners)

    def best(self, values: list[str]) -> list[tuple[int, int, int] | None]:
        """(distance, length not matched, canonical id) of each value's winner: the nearest entry, then the longest key, then the smallest id."""
        tried = [variants(v) for v in values]
        out: list[tuple[int, int, int] | None] = [None] * len(values)
        open_ = [i for i, keys in enumerate(tried) if keys]
        # Radius by radius: who has an entry at this distance needs no wider search, which prunes much less.
        radius = 0
        while open_:
            asked = sorted({k for i in open_ for k in tried[i] if threshold(len(k)) >= radius})
            if not asked:
                break
            near = dict(zip(asked, self.tree.search(asked, np.full(len(asked), radius, np.int64)), strict=True))
            for i in open_:
                hits = [(d, -len(k), self.owners[name]) for k in tried[i] for d, name in near.get(k, ()) if d <= threshold(len(name))]
                out[i] = min(hits, default=None)
            open_ = [i for i in open_ if out[i] is None]
            radius += 1
        return out


def reference_entries(canonical: DataFrame, wordings: DataFrame | None) -> DataFrame:
    """(field_name, canonical_id, name) of every entry, alias and wording; wordings name their entry by its value, in any case."""
    listed = narrow(canonical, field_name="field_name", canonical_id="canonical_id", canonical_value="canonical_value", aliases="aliases").where(F.col("field_name").isNotNull() & F.col("canonical_id").isNotNull())
    listed = listed.withColumn("canonical_id", F.col("canonical_id").cast("long"))
    names = listed.select("field_name", "canonical_id", F.explode(F.concat(F.array("canonical_value"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    if wordings is not None:
        more = narrow(wordings, field_name="field_name", value="canonical_value", name="wording").withColumn("value", F.lower(F.trim("value")))
        owners = listed.select("field_name", "canonical_id", F.lower(F.trim("canonical_value")).alias("value"))
        names = names.unionByName(more.join(owners, ["field_name", "value"]).select("field_name", "canonical_id", "name"))
    return names.where(F.col("name").isNotNull()).distinct()


def match_values(values: DataFrame, canonical: DataFrame, *, wordings: DataFrame | None = None, shard_entries: int = SHARD_ENTRIES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """values(field_name, value) -> (field_name, value, canonical_id, distance), one row for each distinct pair.

    canonical_id 0 and a null distance report a value that matches nothing.  Values are compared once each,
    however often they occur.  Each shard of the reference list returns its winner; the nearest one wins,
    ties going to the longer key and then to the smaller id.  The list is counted before any of it is sent; one of
    more than block_entries entries is searched in blocks.
    """
    spark = values.sparkSession
    entries = reference_entries(canonical, wordings)
    blocks = max(1, -(-entries.count() // block_entries))
    distinct = narrow(values, field_name="field_name", value="value").where(F.col("value").isNotNull()).distinct()
    # The search costs much more than its bytes show, so tasks are dealt out by the number of values, and by field: a
    # walk through a tree costs nearly the same for a few values as for some thousands.
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), distinct.count() // TASK_VALUES + 1)
    distinct = distinct.repartitionByRange(tasks, "field_name", F.xxhash64("value"))
    winners = None
    for block in range(blocks):
        part = entries if blocks == 1 else entries.where(F.pmod(F.xxhash64("field_name", "canonical_id", "name"), F.lit(blocks)) == block)
        rows = sorted((r["field_name"], r["canonical_id"], r["name"]) for r in part.collect())
        found_ = _match_block(distinct, rows, shard_entries)
        winners = found_ if winners is None else winners.unionByName(found_)
    if blocks > 1:
        order = F.struct(F.col("canonical_id") == 0, "distance", "unmatched", "canonical_id")
        winners = winners.groupBy("field_name", "value").agg(F.min_by(F.struct("canonical_id", "distance"), order).alias("w")).select("field_name", "value", "w.canonical_id", "w.distance")
    return winners.select("field_name", "value", "canonical_id", "distance")


def _match_block(distinct: DataFrame, entries: list[tuple[str, int, str]], shard_entries: int) -> DataFrame:
    shared = distinct.sparkSession.sparkContext.broadcast(entries)

    def make():
        fields: dict[str, list[Matcher]] = {}

        def shards(field: str) -> list[Matcher]:
            if field not in fields:
                own = [(i, n) for f, i, n in shared.value if f == field]
                fields[field] = [Matcher(own[k : k + shard_entries]) for k in range(0, len(own), shard_entries)]
            return fields[field]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, far, rest = [0] * len(values), [None] * len(values), [0] * len(values)
            for field in {f for f in names if f is not None}:
                at = [i for i, f in enumerate(names) if f == field]
                won = [shard.best([values[i] for i in at]) for shard in shards(field)]
                for i, *tries in zip(at, *won, strict=True):
                    best = min((t for t in tries if t), default=None)
                    if best:
                        far[i], rest[i], ids[i] = best
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(far, pa.int32()), pa.array(rest, pa.int32())], names=["field_name", "value", "canonical_id", "distance", "unmatched"])

        return step

    return by_batch(distinct, "field_name string, value string, canonical_id long, distance int, unmatched int", make)


def map_columns(table: DataFrame, canonical: DataFrame, *, id_column: str, fields: list[str], wordings: DataFrame | None = None, shard_entries: int = SHARD_ENTRIES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(row_id, field_name, canonical_id) of each value that is neither null nor blank nor exactly a canonical value.

    Repeated rows each give their row; a null id stays null; an empty reference list reports every value as 0.
    The values join back on (field, value): a value that a third of all rows share is one key there, so the
    matched side is broadcast when Spark finds it small and AQE splits the key otherwise.
    """
    picked = narrow(table, row_id=id_column, **{f: f for f in fields})
    long = picked.select("row_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("v")).select(F.col("row_id").cast("long").alias("row_id"), "v.field_name", "v.value")
    exact = canonical.select("field_name", F.col("canonical_value").alias("value")).distinct()
    typed = long.where(F.col("value").rlike(r"(?U)[^\s\x1c-\x1f]")).join(F.broadcast(exact) if _small(exact) else exact, ["field_name", "value"], "left_anti")
    matched = match_values(typed, canonical, wordings=wordings, shard_entries=shard_entries, block_entries=block_entries)
    return typed.join(matched, ["field_name", "value"]).select("row_id", "field_name", "canonical_id")


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def found(benchmark: DataFrame, canonical: DataFrame, *, shard_entries: int = SHARD_ENTRIES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(row_id, field_name, canonical_id) for role and housing_tenure, with the default wordings."""
    return map_columns(benchmark, canonical, id_column="row_id", fields=["role", "housing_tenure"], wordings=read_wordings(benchmark.sparkSession), shard_entries=shard_entries, block_entries=block_entries)
