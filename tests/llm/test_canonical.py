import random

import numpy as np
import pytest

from plenum.llm import canonical as ca

CANON = [("role", 1, "Parent", ["mother"]), ("role", 2, "Teacher", ["educator"]), ("role", 3, "Bus driver", []), ("tenure", 1, "Renter", ["tenant"]), ("tenure", 2, "Owner", None)]
SCHEMA = "field_name string, canonical_id long, canonical_value string, aliases array<string>"


def distance(a, b):
    seen, far = {}, len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            i1, j1, cost = seen.get(b[j - 1], 0), last, 1
            if a[i - 1] == b[j - 1]:
                cost, last = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        seen[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


def test_tree_equals_brute_force():
    rng = random.Random(1)
    entries = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(120)})
    asked = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    tree = ca.Tree(entries)
    for k, hits in zip(asked, tree.search(asked, np.full(len(asked), 2)), strict=True):
        assert sorted(hits) == sorted((distance(k, e), e) for e in entries if distance(k, e) <= 2)


def mapped(spark, rows, clashing=lambda d: d, canon=CANON, **options):
    df = clashing(spark.createDataFrame(rows, "row_id long, role string, tenure string"))
    out = ca.map_columns(df, spark.createDataFrame(canon, SCHEMA), id_column="row_id", fields=["role", "tenure"], **options)
    return sorted(((r["row_id"], r["field_name"], r["canonical_id"]) for r in out.collect()), key=str)


def test_values(spark, clashing):
    rows = [(1, "Parent", "renter (2 yrs)"), (2, "PARENT", None), (3, "mohter @ Hill", "  "), (4, "techer", "blue"), (5, "zzz", "Owner"), (5, "zzz", "Owner"), (None, "bus-driver", ""), (6, "x" * 100_000, "tenat")]
    assert mapped(spark, rows, clashing) == sorted([(1, "tenure", 1), (2, "role", 1), (3, "role", 1), (4, "role", 2), (4, "tenure", 0), (5, "role", 0), (5, "role", 0), (None, "role", 3), (6, "role", 0), (6, "tenure", 1)], key=str)


def test_ties_go_to_the_smaller_id(spark):
    canon = [("role", 2, "abcdx", []), ("role", 1, "abcdy", [])]
    assert mapped(spark, [(1, "abcdz", None)], canon=canon) == [(1, "role", 1)]


def test_shards_merge_to_the_same_winners(spark):
    rows = [(1, "mohter", "tenent"), (2, "edcuator", "onwer"), (3, "nothing like it", "rent")]
    assert mapped(spark, rows) == mapped(spark, rows, shard_entries=2) == mapped(spark, rows, shard_entries=2, block_entries=3)


def test_wordings_are_an_input(spark):
    rows = [(1, "mum", "lives in a flat"), (2, "mama", None)]
    table = spark.createDataFrame([("role", "PARENT", "mum"), ("role", "nobody", "mama"), ("role", None, "x"), (None, "parent", "y")], "field_name string, canonical_value string, wording string")
    assert mapped(spark, rows) == [(1, "role", 0), (1, "tenure", 0), (2, "role", 0)]
    assert mapped(spark, rows, wordings=table) == [(1, "role", 1), (1, "tenure", 0), (2, "role", 0)]


def test_default_wordings(spark):
    from plenum.llm.wordings import read_wordings

    table = read_wordings(spark)
    assert table.where("field_name is null or canonical_value is null or wording is null").count() == 0 and table.count() > 100


def test_empty_tables(spark):
    assert mapped(spark, []) == []
    assert mapped(spark, [(1, "Parent", None)], canon=[]) == [(1, "role", 0)]
