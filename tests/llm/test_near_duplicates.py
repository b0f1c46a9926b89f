import random

import numpy as np
import pytest

from plenum.llm import near_duplicates as nd
from plenum.llm.batches import CorpusError

SCHEMA = "row_id long, comment_text string"


def brute(rows, similarity=0.8):
    sets = {i: nd.word_set(t) for i, t in rows if i is not None and t is not None}
    sets = {i: s for i, s in sets.items() if s}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity - 1e-12}


def pairs(df):
    return {(r["row_id_a"], r["row_id_b"]) for r in df.collect()}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(120)] + ["the", "of", "and"]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.55:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, max(2, len(words) // 8))):
                at = rng.randrange(len(words))
                words[at] = rng.choice(vocabulary) if rng.random() < 0.6 else words[at] + " " + rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(words)
            rows.append((k, " ".join(words)))
        else:
            rows.append((k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 90)))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, clashing):
    rows = corpus(seed)
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    assert pairs(nd.near_duplicates(df)) == brute(rows)


@pytest.mark.parametrize("frequent,deletion", [(2, 0), (2, 200), (10_000, 33)])
def test_every_allocation_is_exact(spark, monkeypatch, frequent, deletion):
    monkeypatch.setattr(nd, "FREQUENT", frequent)
    monkeypatch.setattr(nd, "DELETION_SIZE", deletion)
    rows = corpus(7, 200)
    plan, keys = nd.statistics(nd._texts(spark.createDataFrame(rows, SCHEMA), "row_id", "comment_text"), 0.8, 8)
    if frequent == 2:
        assert len(keys)
    assert pairs(nd.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_deletion_neighbourhoods_alone(spark):
    plan = nd.Plan(0.8)
    plan.deletion = frozenset(range(40))
    rows = corpus(11, 150)
    texts = nd._texts(spark.createDataFrame(rows, SCHEMA), "row_id", "comment_text")
    found = nd.candidates_and_members(texts, plan, np.zeros(0, np.uint64), 8, 150)
    members = {r["a"]: r["b"] for r in found.where("kind = 1").collect()}
    candidates = {tuple(sorted((r["a"], r["b"]))) for r in found.where("kind = 0").collect()}
    wanted = {(members[a], members[b]) for a, b in brute(rows) if members[a] != members[b]}
    assert {tuple(sorted((x % 2**64, y % 2**64))) for x, y in wanted} <= {tuple(sorted((x % 2**64, y % 2**64))) for x, y in candidates}


def test_nulls_repeats_short_and_chinese(spark):
    long_text = "one two three four five six seven eight nine ten"
    chinese = "我不明白为什么竹塘东剩下元我们耽误了上班桂圃后已经有条投诉"
    rows = [(1, long_text), (2, long_text), (2, long_text), (3, "TEN nine, eight seven six five four three two one!"), (4, None), (5, ""), (6, "too short to count here"), (None, long_text), (7, chinese), (8, chinese + "吗")]
    got = pairs(nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert got == {(1, 2), (1, 3), (2, 3), (7, 8)}


def test_empty_table_and_options(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nd.near_duplicates(empty).count() == 0 and nd.duplicate_groups(empty).count() == 0
    with pytest.raises(CorpusError):
        nd.near_duplicates(empty, similarity=0.3)
    with pytest.raises(CorpusError):
        nd.near_duplicates(empty, text_column="nope")


def test_groups_have_one_row_a_document(spark):
    rows = corpus(5, 150)
    got = {r["row_id"]: (r["group_id"], r["n_links"]) for r in nd.duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    parent = {i: i for i in got}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {i: g for i, (g, _) in got.items()} == {i: find(i) for i in got}


def test_hot_group_of_copies(spark):
    text = "the same words over and over in a third of all rows here"
    rows = [(k, text) for k in range(300)] + [(1000 + k, f"{k} " + " ".join(f"u{k}x{j}" for j in range(12))) for k in range(600)]
    got = nd.duplicate_groups(spark.createDataFrame(rows, SCHEMA))
    assert got.where("group_id = 0").count() == 300 and got.where("row_id >= 1000 AND group_id = row_id").count() == 600


def test_very_long_text(spark):
    text = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, text), (2, text + " more"), (3, "a b c d e f g h i j")]
    assert pairs(nd.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == {(1, 2)}


def test_groups_go_on_until_nothing_moves(spark, monkeypatch):
    """With a limit on the rounds, here 64 made 1, the chain of versions came out in pieces."""
    import builtins

    monkeypatch.setattr(nd, "range", lambda *a: builtins.range(1) if a == (64,) else builtins.range(*a), raising=False)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    ids = [7, 3, 9, 1, 8, 2, 6, 4, 5, 0]
    rows = [(k, " ".join(words[i : i + 40])) for i, k in enumerate(ids)]
    got = nd.duplicate_groups(spark.createDataFrame(rows, "row_id long, comment_text string")).collect()
    assert len(got) == 10 and {r["group_id"] for r in got} == {0}


def with_common_part(seed, n=240):
    """A third of the rows share two thirds of their words, without being similar; some are edited copies of others."""
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(36)]
    rows = corpus(seed, n - n // 3)
    for k in range(len(rows), n):
        if k % 4 == 0 and k > len(rows) + 4:
            words = rows[-2][1].split()
            words[rng.randrange(len(words))] = f"x{k}"
        else:
            words = common + [f"u{rng.randrange(10_000)}" for _ in range(18)]
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("hot", [3, 12])
def test_hot_keys_go_on_to_further_rounds(spark, hot):
    rows = with_common_part(21)
    df = spark.createDataFrame(rows, SCHEMA)
    texts = nd._texts(df, "row_id", "comment_text")
    plan, frequent = nd.statistics(texts, 0.8, 8)
    assert nd.candidates_and_members(texts, plan, frequent, 8, len(rows), hot).where("kind = 2").count() > hot
    assert pairs(nd.near_duplicates(df, hot=hot)) == brute(rows)


def test_no_key_is_compared_beyond_the_bound():
    """A bucket hands on every set of a larger key, in pieces too, and compares the rest."""
    plan = nd.Plan(0.8)
    sets = nd.Sets([f"a b c d e f g h i w{k}" for k in range(50)], nd.Hasher(), 8)
    key, entries = nd.extended_entries(sets, np.zeros(50, np.uint64), plan, 1)
    entries = entries[(key % np.uint64(1)) == 0]
    bucket = nd.Bucket(0, plan, 10)
    bucket.HELD = 40
    handed = []
    for k in range(0, len(entries), 7):
        out = bucket.add(entries[k : k + 7])
        handed += [] if out is None else list(zip(*(x.tolist() for x in out), strict=True))
    left, out = bucket.close()
    handed += [] if out is None else list(zip(*(x.tolist() for x in out), strict=True))
    counts = {}
    for k, s in zip(entries["key"].tolist(), entries["set"].tolist(), strict=True):
        counts.setdefault(k, set()).add(s)
    assert len(set(handed)) == sum(len(v) for v in counts.values() if len(v) > 10)
    assert len(left) <= sum(len(v) * (len(v) - 1) // 2 for v in counts.values() if len(v) <= 10)


def test_pairs_of_blocks_cover_all_pairs(monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    plan = nd.Plan(0.8)
    sets = nd.Sets([f"a b c d e f g h i j k l w{k}" for k in range(30)], nd.Hasher(), 8)
    _, entries = nd.block_entries(sets, np.full(30, 5, np.uint64), np.full(30, 30))
    bucket = nd.Bucket(0, plan, 1 << 62)
    bucket.add(entries)
    found, out = bucket.close()
    assert out is None and len(found) == 30 * 29 // 2


def test_pairs_of_large_keys(monkeypatch):
    """The runs in which the pairs of one key are made give each pair once."""
    monkeypatch.setattr(nd, "PAIR_CHUNK", 100)
    plan = nd.Plan(0.8)
    sets = nd.Sets([f"a b c d e f g h i j k l w{k}" for k in range(70)], nd.Hasher(), 8)
    entries = np.zeros(70, nd.ENTRY)
    entries["set"] = np.sort(sets.identity)
    entries["meta"], entries["more"] = nd.signature(sets)
    assert len(nd.join_entries(entries, plan)) == 70 * 69 // 2
