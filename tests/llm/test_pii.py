import pytest

from plenum.llm import pii


@pytest.fixture(scope="module")
def decoder():
    return pii.Decoder(pii.fit([]))


def items(decoder, text):
    return [(text[a:b], k) for a, b, k in pii.find_items([text], decoder)[0]]


CASES = [
    ("My name is Harriet Quinimer and I speak for 59 households in Tamselholm.", [("Harriet Quinimer", "PERSON")]),
    ("Write to nik.havescu (at) families (dot) invalid before Jan. 18.", [("nik.havescu (at) families (dot) invalid", "EMAIL_ADDRESS")]),
    ("Call (312) 555-0125 ext. 44 and ask for Maribel Havsen, Pinderthorpe office hours only.", [("(312) 555-0125 ext. 44", "PHONE_NUMBER"), ("Maribel Havsen", "PERSON")]),
    ("They asked for my Social Security number 981-47-5917 at the Sallowley desk.", [("981-47-5917", "ID_NUMBER")]),
    ("I live at 2014 W Nettleworth Ave., Apt 27A, Lomermoor 00506 near Ivorthorpe Elementary.", [("2014 W Nettleworth Ave., Apt 27A, Lomermoor 00506", "STREET_ADDRESS")]),
    ("Case no. 2026-0012 covers room 351-B at Ulvermere Academy.", []),
    ("The Jordan Hall volunteers met at the corner of Wickholm Street.", []),
    ("Bus 446 and bus 17 left Hollinford at 8:15 p.m., 5.7 miles away.", []),
    ("Mieszkam przy ul. Klonowa-Jawowola 10/4, szkoła Topowany jest 30 minut stąd.", [("ul. Klonowa-Jawowola 10/4", "STREET_ADDRESS")]),
    ("我叫祝景澄，代表霞杨西的250户家庭。", [("祝景澄", "PERSON")]),
]


@pytest.mark.parametrize("text,wanted", CASES)
def test_cases(decoder, text, wanted):
    assert items(decoder, text) == wanted


def test_period_of_an_address(decoder):
    assert items(decoder, "The puddle outside 2835 Ivorbank Ave. never drains.") == [("2835 Ivorbank Ave.", "STREET_ADDRESS")]
    assert items(decoder, "Send the reply to 2835 Ivorbank Ave.") == [("2835 Ivorbank Ave", "STREET_ADDRESS")]


def test_tables(spark, decoder, clashing):
    field = decoder.field
    rows = [(1, "My name is Omar Velwright and I speak for us."), (2, None), (3, ""), (4, "  "), (1, "My name is Omar Velwright and I speak for us."), (None, "You can reach me at a.b@example.org before May 3.")]
    df = clashing(spark.createDataFrame(rows, "case_id long, text string"))
    got = sorted((str(r["row_key"]), r["pii_type"]) for r in pii.tag(df, field, id_column="case_id", text_column="text").collect())
    assert got == [("1", "PERSON"), ("1", "PERSON"), ("None", "EMAIL_ADDRESS")]
    redacted = {r["case_id"]: r["redacted_text"] for r in pii.redact(df, field, text_column="text").collect()}
    assert redacted[1] == "My name is [PERSON] and I speak for us." and redacted[2] is None and redacted[3] == ""
    assert pii.tag(df.limit(0), field, id_column="case_id", text_column="text").count() == 0


def test_very_long_text(decoder):
    text = "We wait for the bus every day. " * 2000 + "My name is Omar Velwright and I speak for us."
    assert items(decoder, text) == [("Omar Velwright", "PERSON")]


GIVEN = "Ngozi Takashi Bronwyn Siobhan Xiomara Anthony Dmitri Kwame Aoife Thandiwe Rajesh Elizabeth Jean Mohammed Linh Svetlana Hiro Chukwuemeka Ana Bob".split()
FAMILY = "Okonjo Nakamura Llewellyn Featherstonehaugh Nguyen Petrov Mensah Kowalczyk Smith Garcia O'Brien Abdullah Srinivasan Johansson Washington Xu Li Fitzgerald-Kane".split()


def test_names_never_seen(folder):
    """Names whose parts are in no training row, put where the hand-labelled names stand: nine of ten are found, and nine of ten found are names."""
    import random

    import pyarrow.parquet as pq

    large = folder.replace("sf0.001", "sf0.1").replace("sf0.01/", "sf0.1/")
    rows = [r for r in pq.read_table(f"{large}/person_redaction_cases.parquet").to_pylist() if r["names"] is not None and r["text"]]
    rng = random.Random(3)
    rng.shuffle(rows)
    half = len(rows) // 2
    trained = pii.Decoder(pii.fit([(r["text"], r["names"]) for r in rows[:half]]))
    texts, wanted = [], []
    for r in rows[half:]:
        text, at, names = "", 0, []
        for name in r["names"]:
            place = r["text"].find(name, at)
            parts = [p if len(p) == 2 and p[1] == "." else rng.choice(GIVEN) for p in name.split(" ")[:-1]]
            new = " ".join([*parts, rng.choice(FAMILY)])
            new = new.lower() if name.islower() else new.upper() if name.isupper() else new
            text += r["text"][at:place] + new
            at = place + len(name)
            names.append(new)
        texts.append(text + r["text"][at:]), wanted.append(names)
    hit = found = total = 0
    for text, names, items_ in zip(texts, wanted, pii.find_items(texts, trained), strict=True):
        got = [text[a:b] for a, b, kind in items_ if kind == "PERSON"]
        total, found = total + len(names), found + len(got)
        hit += sum(min(names.count(n), got.count(n)) for n in set(names))
    assert total >= 50 and hit >= 0.9 * total and hit >= 0.9 * found


def test_seed_holds_no_name_twice():
    """Names, places and streets are invented anew for each row: hardly a word of them comes in two rows, and none is known."""
    from collections import Counter

    from plenum.llm import pii_seed

    seen = Counter(w.lower() for text, spans in pii_seed.labelled_table(1500) for w in {w for a, b, kind in spans if kind == "PERSON" for w in text[a:b].split() if len(w) > 4})
    known = {w.lower() for w in pii_seed.AMBIGUOUS}
    often = [w for w, n in seen.items() if n > 2 and w not in known]
    assert len(often) <= 0.01 * len(seen)


def test_ordinary_words(spark):
    df = spark.createDataFrame([("the gate and The Gate of Omar",)] * 3 + [("the gate is open",)] * 3 + [("OPEN THE GATE",), (None,), ("",)], "text string")
    assert pii.ordinary_words(df) == {"the", "gate"}
    assert pii.ordinary_words(df.limit(0)) == frozenset()


def test_bounded_sample(spark):
    from plenum.llm.batches import bounded_sample

    df = spark.range(5000)
    picked = [r["id"] for r in bounded_sample(df, 100, "id")]
    assert len(picked) == 100 == len(set(picked)) and picked == [r["id"] for r in bounded_sample(df.repartition(3), 100, "id")]
    assert len(bounded_sample(df.limit(30), 100, "id")) == 30 and bounded_sample(df.limit(0), 100, "id") == []


def test_field_is_kept(tmp_path):
    field = pii.Field.empty()
    field.step[1, 2] = 0.5
    back = pii.Field.from_bytes(field.to_bytes())
    assert back.known == field.known and (back.step == field.step).all() and back.word.shape == field.word.shape


def test_decoding_is_the_best_path(decoder):
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(5):
        emissions = rng.normal(size=(4, pii.N)).astype(np.float32) * 3
        best = max(itertools.product(range(pii.N), repeat=4), key=lambda p: decoder.start[p[0]] + sum(emissions[t, p[t]] for t in range(4)) + sum(decoder.step[p[t], p[t + 1]] for t in range(3)))
        assert tuple(decoder.decode([emissions])[0]) == best


def test_fit_reads_labelled_rows(spark):
    cases = spark.createDataFrame([(1, "Contact Omar Velwright about it.", ["Omar Velwright"]), (2, "Keep the annex open.", []), (3, "x", None), (4, None, ["a"])], "case_id long, text string, names array<string>")
    assert sorted(pii.labelled_rows(cases)) == [("Contact Omar Velwright about it.", ["Omar Velwright"]), ("Keep the annex open.", [])]


def test_redacted_query_covers_both_tables(spark, folder):
    from plenum.llm import queries

    got = queries.queries()["p4_redacted"](spark, folder)
    assert got.columns == ["src_name", "row_key", "redacted_text"]
    sizes = {r["src_name"]: r["count"] for r in got.groupBy("src_name").count().collect()}
    tables = {"comment": "synthetic_theme_benchmark", "case": "person_redaction_cases"}
    assert sizes == {name: spark.read.parquet(f"{folder}/{table}.parquet").count() for name, table in tables.items()}
    marked = got.where("redacted_text rlike '\\\\[(PERSON|EMAIL_ADDRESS|PHONE_NUMBER|ID_NUMBER|STREET_ADDRESS)\\\\]'")
    assert {r["src_name"] for r in marked.select("src_name").distinct().collect()} == {"comment", "case"}


@pytest.mark.parametrize("text,wanted", [c for c in CASES[:5] if c[1]])
def test_items_of_long_texts_at_any_place(decoder, text, wanted):
    """Every token of each kind of item once stands where pieces of 400 tokens would be cut."""
    length = len(pii.tokens(text))
    texts = ["the bus is late " * 94 + "so " * k + "today; " + text for k in range(max(0, 24 - length), 24)]
    for long, found in zip(texts, pii.find_items(texts, decoder), strict=True):
        assert len(pii.tokens(long)) > pii.LONGEST
        assert [(long[a:b], k) for a, b, k in found] == wanted
