import pytest

from plenum.llm import language as la

SCHEMA = "row_id long, comment_text string, language string"
EN = "Please fix the gate before the winter because children wait outside in the cold every morning."
ES = "No entiendo por qué los niños llegan tarde a la escuela mientras todos preguntan lo mismo."
PL = "Prosimy naprawić wejście do szkoły, ponieważ dzieci czekają na zewnątrz każdego ranka."
PT = "Não entendo por que as crianças chegam tarde na escola enquanto ninguém confia no plano."
ZH = "我不明白为什么学校的门还没有修好，孩子们每天都在外面等。"
HI = "मुझे समझ नहीं आता कि स्कूल का फाटक अब तक ठीक क्यों नहीं हुआ।"
AR = "لا أفهم لماذا يصل الأطفال متأخرين إلى المدرسة في كل صباح ماطر."


def found(spark, rows, clashing=lambda d: d):
    return sorted((r["row_id"], r["seg_no"], r["lang_code"]) for r in la.found(clashing(spark.createDataFrame(rows, SCHEMA))).collect())


def test_single_languages(spark, clashing):
    rows = [(k, t, None) for k, t in enumerate((EN, ES, PL, PT, ZH, HI, AR))]
    assert found(spark, rows, clashing) == [(k, 0, c) for k, c in enumerate(("en", "es", "pl", "pt", "zh", "hi", "ar"))]


def test_right_labels_in_any_spelling_give_no_row(spark):
    rows = [(k, t, label) for k, (t, label) in enumerate([(EN, "Inglés"), (EN, " en-US "), (ES, "CASTELLANO"), (ZH, "普通话"), (HI, "हिन्दी"), (AR, "العربية"), (PL, "polski")])]
    assert found(spark, rows) == []
    assert found(spark, [(1, EN, "Spanish"), (2, ES, "unknown"), (3, PL, " ")]) == [(1, 0, "en"), (2, 0, "es"), (3, 0, "pl")]


def test_mixed_comments_have_their_stretches(spark):
    rows = [(1, f"{EN} {ES} {EN}", "English"), (2, f"{ZH} {EN}", None), (3, f"{EN.rstrip('.')}, {HI}", "English")]
    assert found(spark, rows) == [(1, 1, "en"), (1, 2, "es"), (1, 3, "en"), (2, 1, "zh"), (2, 2, "en"), (3, 1, "en"), (3, 2, "hi")]


def test_edges(spark):
    rows = [(1, None, None), (2, "", None), (3, "  \n", None), (4, "Fix this now", None), (5, "12345 67 890 @@ ??", None), (None, EN, None), (6, (EN + " ") * 2000, None), (6, (EN + " ") * 2000, None)]
    got = la.found(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["row_id"]), r["lang_code"]) for r in got) == [("6", "en"), ("6", "en"), ("None", "en")]
    assert found(spark, []) == []


def test_spans_lie_in_the_text(spark):
    text = f"  {EN} {ES}"
    rows = la.identify(spark.createDataFrame([(1, text, None)], SCHEMA)).orderBy("seg_no").collect()
    assert [text[r["start_pos"] : r["end_pos"]][:6] for r in rows] == [EN[:6], ES[:6]]
    assert all(0 <= r["confidence"] <= 1 for r in rows)


def test_held_out_accuracy(spark, folder):
    """The default model against script and frequent words of rows whose label it never saw."""
    model = la.Model.fit([])
    for text, code in ((EN, "en"), (ES, "es"), (PL, "pl"), (PT, "pt")):
        assert la.LANGUAGES[la.analyse([text], model)[0][1][0][2]] == code


@pytest.mark.parametrize("label,code", [("English", "en"), ("zh-CN", "zh"), ("pt-BR", "pt"), ("Eng.", "en"), ("klingon", None), (None, None), ("", None)])
def test_labels(spark, label, code):
    df = spark.createDataFrame([(label,)], "c string")
    assert df.select(la.code_of(df["c"]).alias("o")).first()["o"] == code


def test_stretches_of_small_share_and_of_many_languages(spark):
    rows = [(1, f"{EN} " * 40 + f"{ES} " + f"{EN} " * 40, None), (2, f"{EN} {ES} {PL} {ZH} {AR}", None)]
    assert found(spark, rows) == [(1, 1, "en"), (1, 2, "es"), (1, 3, "en"), *((2, k, c) for k, c in enumerate(("en", "es", "pl", "zh", "ar"), 1))]


def test_choose_is_the_best_of_all_sets():
    from itertools import combinations

    import numpy as np

    rng = np.random.default_rng(1)
    for k in range(40):
        own = np.repeat(rng.integers(0, 7, 5), rng.integers(3, 12))[:40]
        scores = -rng.random((len(own), 7)).astype(np.float32) * (2, 5)[k % 2]
        scores[np.arange(len(own)), own] *= 0.2
        scores -= scores.max(axis=1, keepdims=True)
        path = la.choose(scores, np.full(7, 1 / 7), scores.sum(axis=0))
        value = scores[np.arange(len(own)), path].sum() - la.SWITCH_COST * sum(a != b for a, b in zip(path, path[1:], strict=False)) - la.LANGUAGE_COST * (len(set(path)) - 1)
        wanted = max(la._stretches(scores, c)[0] - la.LANGUAGE_COST * (size - 1) for size in range(1, 8) for c in combinations(range(7), size))
        assert abs(value - wanted) < 1e-3


def test_text_in_none_of_the_languages(folder):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{folder.replace('sf0.001', 'sf0.01')}/synthetic_theme_benchmark.parquet", columns=["comment_text"]).column(0).to_pylist()
    rows = [t for t in rows if t and len(t) > 40]
    model = la.Model.fit([(t, "en") for t in rows])
    foreign = ["Дети каждое утро ждут автобус, и никто не объясняет нам, почему он снова опаздывает.", "Lapset odottavat bussia joka aamu eikä kukaan selitä meille miksi se on taas myöhässä."]
    assert [spans[0][2] for _, spans in la.analyse(foreign, model)] == [la.CODES.index(la.UNKNOWN)] * 2
    known = [spans for _, spans in la.analyse(rows, model) if spans]
    assert sum(s[2] == la.CODES.index(la.UNKNOWN) for spans in known for s in spans) <= 0.001 * len(known)


def test_confidence_is_the_share_of_the_expectation_step():
    model = la.Model.fit([])
    (_, one), (_, two) = la.analyse([EN, f"{EN} {ES}"], model)
    assert len(one) == 1 and one[0][3] > 0.8
    assert [la.CODES[s[2]] for s in two] == ["en", "es"] and all(0.6 < s[3] <= 1 for s in two)
