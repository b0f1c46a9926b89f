import pytest

from plenum.llm import sentences as se

CASES = [
    ("Dr. Green spoke at 3.5 hours. Can we join? Why now?", ["Dr. Green spoke at 3.5 hours.", "Can we join?", "Why now?"]),
    ("I support the plan... and still we wait. The St. Mary stop is closed.", ["I support the plan... and still we wait.", "The St. Mary stop is closed."]),
    ("A sign reads \"Is anybody listening!\" and it stayed up.Please look.", ["A sign reads \"Is anybody listening!\" and it stayed up.", "Please look."]),
    ("She said, “We hear you. Come back later,” and left at 9:10 a.m. The door was shut.", ["She said, “We hear you. Come back later,” and left at 9:10 a.m.", "The door was shut."]),
    ("the 7:15 a.m. van was late. ward clerks logged it, e.g. about the bus.", ["the 7:15 a.m. van was late.", "ward clerks logged it, e.g. about the bus."]),
    ("1. First thing\n2. Second thing\n- third", ["1. First thing", "2. Second thing", "- third"]),
    ("“操场一片漆黑！”桂圃东的租户在18:40喊道。记录第4号。为什么？好", ["“操场一片漆黑！”桂圃东的租户在18:40喊道。", "记录第4号。", "为什么？", "好"]),
    ("我不明白为什么 请在第3天之前公布", ["我不明白为什么", "请在第3天之前公布"]),
    ("¿Cuándo van? La Sra. directora dijo p. ej. que no. ¡Basta!", ["¿Cuándo van?", "La Sra. directora dijo p. ej. que no.", "¡Basta!"]),
    ("Mieszkam przy ul. Długiej 5. Dyr. szkoły wie o tym.", ["Mieszkam przy ul. Długiej 5.", "Dyr. szkoły wie o tym."]),
    ("डॉ. साहब ने कहा। फिर गए।", ["डॉ. साहब ने कहा।", "फिर गए।"]),
    ("قال د. المدير إن الكلفة 4.8 مليون. متى سيتم ذلك؟ لا أفهم.", ["قال د. المدير إن الكلفة 4.8 مليون.", "متى سيتم ذلك؟", "لا أفهم."]),
    ("Text Theo on 555-0192 after 8:55 a.m. please.", ["Text Theo on 555-0192 after 8:55 a.m. please."]),
    ("THE CLERK ANSWERED 'NO. NOT NOW.' AND LEFT. WE WAITED!", ["THE CLERK ANSWERED 'NO. NOT NOW.' AND LEFT.", "WE WAITED!"]),
    ("No.", ["No."]),
    ("ok", ["ok"]),
]


@pytest.mark.parametrize("text,wanted", CASES)
def test_cases(text, wanted):
    assert [text[a:b] for a, b in se.sentences(text)] == wanted


def test_cover_all_but_white_space(spark, folder):
    rows = spark.read.parquet(f"{folder}/synthetic_theme_benchmark.parquet").select("comment_text").collect()
    for (text,) in rows:
        last = 0
        rest = ""
        for a, b in se.sentences(text or ""):
            assert last <= a < b
            rest += text[last:a]
            last = b
        assert not (rest + (text or "")[last:]).strip()


def test_tables(spark, clashing):
    rows = [(1, "One. Two."), (2, None), (3, ""), (4, " \n "), (1, "One. Two."), (None, "Three.")]
    df = clashing(spark.createDataFrame(rows, "row_id long, comment_text string"))
    got = sorted((str(r["row_id"]), r["start_pos"], r["end_pos"]) for r in se.found(df).collect())
    assert got == [("1", 0, 4), ("1", 0, 4), ("1", 5, 9), ("1", 5, 9), ("None", 0, 6)]
    assert se.found(df.limit(0)).count() == 0


def test_very_long_line():
    text = "We wait for the bus. " * 20_000
    assert len(se.sentences(text)) == 20_000


def all_segmentations(line, words_of):
    """The score of each segmentation of a line, one for every subset of its candidates."""
    import itertools

    stop = len(line)
    cuts = []
    for found in se._CANDIDATE.finditer(line, 0, stop):
        score = se._boundary(line, found)
        if score is None or found.end() >= stop:
            continue
        after, before = se._WORD.search(line, found.end()), se._LAST.search(line, 0, found.start())
        score += words_of.opening.get(after[0].lower(), 0.0) if after else 0.0
        score += words_of.closing.get(before[1].lower(), 0.0)
        cuts.append((found.end() - len(found[3]), found.end(), score))
    values = {}
    for k in range(len(cuts) + 1):
        for chosen in itertools.combinations(cuts, k):
            edges = [0, *(x for c in chosen for x in c[:2]), stop]
            spans = list(zip(edges[::2], edges[1::2], strict=True))
            value = sum(c[2] for c in chosen)
            for a, b in spans:
                piece = line[a:b]
                # Words are counted between candidates, as the model does.
                inner = [a, *(x for c in cuts if a <= c[0] < b and c not in chosen for x in c[:2]), b]
                value += se._length_score(sum(se._count_words(line[x:y]) for x, y in zip(inner[::2], inner[1::2], strict=True)))
                value += se.UNBALANCED * ((piece.count("“") != piece.count("”")) + piece.count('"') % 2)
            values[tuple(spans)] = value
    return values


def test_dynamic_programme_equals_trying_all(monkeypatch):
    import random

    monkeypatch.setattr(se, "LONG_WORDS", 9)
    rng = random.Random(4)
    words = "We wait for the bus. every day! Why? then Mr. Lee came. “No. not now.” he said. The \"late. bus\" left at 5 p.m. Again so it goes. St. Mary etc. and then".split(" ")
    odds = se.Words({"every": 1.2, "then": -1.5, "again": 0.7, "the": 1.0}, {"lee": -0.6, "bus": 0.9, "etc": -1.0})
    for _ in range(120):
        line = " ".join(rng.choice(words) for _ in range(rng.randrange(6, 34)))
        if len(se._CANDIDATE.findall(line)) > 11:
            continue
        for words_of in (se.NO_WORDS, odds):
            values = all_segmentations(line, words_of)
            assert values[tuple(se.line_spans(line, words_of))] >= max(values.values()) - 1e-6, line


def test_words_are_fitted():
    fitted = se.Words.fit(["The bus is late again today.\nThe bell rings at noon today."] * 10)
    assert fitted.opening["the"] > 0 > fitted.opening["is"] and fitted.closing["today"] > 0
    assert se.Words.fit([]) == se.NO_WORDS


def test_long_line_takes_all_candidates():
    line = "We wait e.g. here and there " * 3000 + "and it ends. Then another one begins here."
    assert [line[a:b] for a, b in se.line_spans(line)][-1] == "Then another one begins here."


def test_words_are_fitted_on_all_texts(spark):
    texts = [f"The bus {i % 7} is late again today." for i in range(21_000)] + ["Zebras cross the road at noon."] * 5 + [None]
    table = spark.createDataFrame([(t,) for t in texts], "comment_text string").repartition(3)
    found = se.fit_words(table, text_column="comment_text")
    assert found == se.Words.fit(t for t in texts if t) and found.opening["zebras"] > 0
