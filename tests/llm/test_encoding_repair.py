import hashlib

import numpy as np
import pytest

from plenum.llm import encoding_repair as er

CLEAN = [
    "Señora Zúñiga’s façade photo shows a gap — the café by the church cost £3. Él dijo que no había más niños aquí.",
    "No entiendo por qué los niños llegan tarde después de la votación, según conté. ¿Cuándo van a reparar la reunión?",
    "Dziękuję, że sąsiedzi chcą naprawić wejście, choć minęło dużo czasu. Żadne z dzieci się nie spóźniło.",
    "我不明白为什么学校的门还没有修好，孩子们每天都在外面等。记录第四号提到锦坪里，却没有解释。",
    "NÃO É SÓ O ÔNIBUS! ÂNGULO, MAÇÃ",
    "Ελληνικά και кириллица, 14 °C until 8:45",
]


def wrong(text, right, codec):
    chars = er._table(codec)[0]
    return "".join(chars[b] for b in text.encode(right))


@pytest.fixture(scope="module")
def repaired(spark):
    rows = [(k, t) for k, t in enumerate(CLEAN * 30)]
    bad = {
        1000: (wrong(CLEAN[0], "utf-8", "cp1252"), CLEAN[0]),
        1001: (wrong(wrong(CLEAN[1], "utf-8", "latin-1"), "utf-8", "cp1252"), CLEAN[1]),
        1002: (wrong(CLEAN[2], "iso8859-2", "latin-1"), CLEAN[2]),
        1003: (wrong(CLEAN[3], "gb18030", "cp1252"), CLEAN[3]),
        1004: (wrong(CLEAN[1], "utf-8", "mac_roman"), CLEAN[1]),
        1005: ("Fine text first. " + wrong(CLEAN[0], "utf-8", "cp1252") + "\n" + CLEAN[1], "Fine text first. " + CLEAN[0] + "\n" + CLEAN[1]),
        1006: (CLEAN[1].replace("ñ", "�"), None),
    }
    rows += [(k, b) for k, (b, _) in bad.items()] + [(1000, bad[1000][0]), (None, bad[1000][0]), (2000, None), (2001, ""), (2002, "plain ascii")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, bad, er.repair_encoding(df).collect()


def test_garbled_texts_are_restored_and_clean_ones_left(repaired):
    _, bad, rows = repaired
    got = {r["doc_id"]: r["restored"] for r in rows}
    assert set(got) == {*bad, None}
    assert all(got[k] == original for k, (_, original) in bad.items())


def test_repeats_and_layers(repaired):
    _, _, rows = repaired
    assert sum(r["doc_id"] == 1000 for r in rows) == 2
    assert {r["doc_id"]: r["layers"] for r in rows}[1001] >= 1


def test_found_digests(repaired, clashing):
    df, bad, _ = repaired
    got = {r["doc_id"]: r["restored_sha256"] for r in er.found(clashing(df)).collect()}
    assert got[1006] == "" and got[1000] == hashlib.sha256(CLEAN[0].encode()).hexdigest()


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert er.found(empty).count() == 0
    long_text = (CLEAN[1] + "\n") * 3000
    df = spark.createDataFrame([(1, long_text), (2, wrong(long_text, "utf-8", "cp1252"))], "doc_id long, text string")
    got = {r["doc_id"]: r["restored"] for r in er.repair_encoding(df).collect()}
    assert got == {2: long_text}


def test_layers_are_undone_to_the_last():
    text, wrong = "señor, ¿qué pasó en la reunión de mañana?", 9
    counts = np.bincount(er._pairs((text + "\n") * 50), minlength=er.BUCKETS)
    garbled = text
    for _ in range(wrong):
        garbled = garbled.encode("utf-8").decode("latin-1")
    fixed, n = er.Repairer(counts).repair(garbled)
    assert fixed == text and n >= 5


def test_batch_equals_one_by_one():
    rng = np.random.default_rng(2)
    words = "niño café résumé señal über straße plain words 12° “quoted” naïve".split()
    texts = []
    for _ in range(60):
        text = " ".join(rng.choice(words, 8))
        texts.append(text.encode("utf-8").decode("cp1252", "replace") if rng.random() < 0.5 else text)
    texts = [t for t in texts if er.LOST not in t] + ["", "ascii only", "é"]
    counts = np.bincount(er._pairs("\n".join([" ".join(words)] * 40)), minlength=er.BUCKETS)
    assert er.Repairer(counts).repair_all(texts) == [er.Repairer(counts).repair(t) for t in texts]
