import random

import numpy as np

from plenum.llm import leakage as le

ITEM = "Count how often the moderator says Oskby before 6:05 p.m. on Oct. 1, then name the phrase that shows it best."
CHINESE = "评测片段银冈北的居民列出个问题，时间是七点四十五。判断竹庄西得到的答复有没有说明侧门关不上"


def found(spark, documents, items=((1, ITEM), (2, CHINESE)), add=lambda d: d):
    d = add(spark.createDataFrame(documents, "doc_id long, text string"))
    i = add(spark.createDataFrame(list(items), "item_id long, item_text string"))
    return sorted((r["doc_id"], r["item_id"]) for r in le.found(d, i).collect())


def test_whole_part_and_disguise(spark, clashing):
    part = " ".join(ITEM.split()[3:16])
    short = " ".join(ITEM.split()[3:14])
    documents = [(1, f"before {ITEM} after"), (2, f"x {part} y"), (3, f"x {short} y"), (4, part.upper().replace(" ", "\n> ").replace(".", "")), (5, f"<p>{part.replace(' ', '  ')}</p>"), (6, "x " + CHINESE[3:30] + " y"), (7, "x " + CHINESE[3:20]), (8, None), (9, "")]
    assert found(spark, documents, add=clashing) == [(1, 1), (2, 1), (4, 1), (5, 1), (6, 2)]


def test_matches_are_longest_and_placed(spark):
    documents = spark.createDataFrame([(1, f"one two {ITEM} three")], "doc_id long, text string")
    r = le.leaks(documents, spark.createDataFrame([(1, ITEM)], "item_id long, item_text string")).first()
    assert (r["n_units"], r["doc_unit"], r["item_unit"]) == (len(le.words(ITEM)), 2, 0)


def test_equal_items_repeats_and_empty_tables(spark):
    assert found(spark, [(1, ITEM), (1, ITEM)], [(1, ITEM), (2, ITEM), (3, None), (4, "")]) == [(1, 1), (1, 2)]
    assert found(spark, []) == [] and found(spark, [(1, ITEM)], []) == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(k, f"{ITEM} number {k} of many") for k in range(12)]
    documents = [(k, f"text {ITEM} number {k} of many") for k in range(12)]
    whole = found(spark, documents, items)
    monkeypatch.setattr(le, "BLOCK_CHARACTERS", 300)
    assert found(spark, documents, items) == whole and len(whole) == 144


def test_without_leaks(spark):
    documents = spark.createDataFrame([(1, ITEM), (2, "fine"), (None, "fine")], "doc_id long, text string")
    matches = le.leaks(documents, spark.createDataFrame([(1, ITEM)], "item_id long, item_text string"))
    assert sorted(str(r["doc_id"]) for r in le.without_leaks(documents, matches).collect()) == ["2", "None"]


def test_suffix_array_is_sorted():
    x = np.array([random.Random(3).randrange(3) for _ in range(200)])
    order = le.suffix_array(x, 12)
    keys = [tuple(x[i : i + 12]) for i in order]
    assert keys == sorted(keys)


def test_search_equals_brute_force():
    rng = random.Random(5)
    items = [(k, [rng.choice("abc") for _ in range(14)]) for k in range(6)]
    documents = [[rng.choice("abc") for _ in range(60)] for _ in range(30)]
    index = le.Index.build(items, 5)
    d, i, n, _, _ = index.search(documents)
    got = dict(zip(zip(d.tolist(), i.tolist(), strict=True), n.tolist(), strict=True))
    want = {}
    for a, text in enumerate(documents):
        for k, item in items:
            best = 0
            for s in range(len(text)):
                for t in range(len(item)):
                    m = 0
                    while s + m < len(text) and t + m < len(item) and text[s + m] == item[t + m]:
                        m += 1
                    best = max(best, m)
            if best >= 5:
                want[a, k] = best
    assert got == want


def test_very_long_text(spark):
    assert found(spark, [(1, "word " * 300_000 + ITEM)]) == [(1, 1)]


def test_matches_are_measured_to_their_end(spark):
    """Neither a long match nor a long tag inside it is cut."""
    units = [f"word{k}" for k in range(1500)]
    item = " ".join(units)
    tag = '<a href="' + "x" * 900 + '">'
    document = "before it " + " ".join(units[:700]) + tag + " " + " ".join(units[700:]) + " after it"
    docs = spark.createDataFrame([(1, document), (2, " ".join(units[100:1340]))], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, item_text string")
    got = {r["doc_id"]: r["n_units"] for r in le.leaks(docs, items).collect()}
    assert got == {1: 1500, 2: 1240}
