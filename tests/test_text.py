from pyspark.sql import functions as F

from plenum.functions import dates, redaction, text
from plenum.sources.tables import html_to_text


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("o")).first()["o"]


def test_strip_knows_unicode_space(spark):
    assert one(spark, " \x1c　 a b \t ", text.strip) == "a b"
    assert one(spark, None, text.strip) == ""


def test_question_reasons(spark):
    asked = ["Please explain?", "“This costs how much?”", "(Why now?)", "WHY now", "  2. Can we attend"]
    plain = ["", "?!", "We wonder why it closed.", "Whatever works.", "See https://example.org/?q=1 first."]
    assert all(one(spark, a, text.question_reasons) for a in asked)
    assert not any(one(spark, p, text.question_reasons) for p in plain)
    assert one(spark, "When will it open?", text.question_reasons) == ["question_mark", "wh_word"]
    assert one(spark, "Can we attend", text.question_reasons) == ["auxiliary"]
    assert one(spark, None, text.question_reasons) == []


def test_boilerplate(spark):
    given = "Add buses. Contact [PERSON] at [EMAIL_ADDRESS]. Call [PHONE_NUMBER] about the late bus."
    assert one(spark, given, text.without_boilerplate) == "Add buses. Call about the late bus."
    assert one(spark, None, text.without_boilerplate) == ""


def test_spreadsheet_guard(spark):
    for risky in ("=1+1", "\t@SUM(1)", " +1", "-command", "@formula"):
        assert one(spark, risky, text.spreadsheet_safe) == "'" + risky
    assert one(spark, "a-b", text.spreadsheet_safe) == "a-b"
    assert one(spark, None, text.spreadsheet_safe) is None


def test_days(spark):
    assert one(spark, "2026-09-12T18:00:00Z", dates.day_of) == "2026-09-12"
    assert one(spark, "09/12/2026", dates.day_of) == "2026-09-12"
    assert one(spark, "Sept hearing", dates.day_of) is None
    assert one(spark, None, dates.day_of) is None


def test_redaction_cases():
    r = redaction.redact_text
    assert r("Email resident@example.org, call (312) 555-0199, or visit https://example.org/form.")[0] == "Email [EMAIL_ADDRESS], call [PHONE_NUMBER], or visit [URL]."
    masked = r("I live at 1234 W Main Street, Apt 4B near the school.")[0]
    assert "[STREET_ADDRESS]" in masked and "[UNIT_NUMBER]" in masked and "1234" not in masked
    assert r("Contact Taylor Parker at resident@example.org or (312) 555-0199.")[0] == "Contact [PERSON] at [EMAIL_ADDRESS] or [PHONE_NUMBER]."
    assert r("Contact Customer Services at the main office.")[0] == "Contact Customer Services at the main office."
    assert r("Meet at 123 John Smith Road, please.", [(12, 22)])[0] == "Meet at [STREET_ADDRESS] please."
    assert r("123 Main Street Jones spoke.", [(4, 21)])[0] == "[PERSON] spoke."
    assert r(None) == ("", {}) and r("") == ("", {})
    assert r("They should not steal money near the steps.")[0] == "They should not steal money near the steps."


def test_touching_spans_stay_apart():
    assert redaction.merge([(0, 3, "A"), (3, 6, "B")]) == [(0, 3, "A"), (3, 6, "B")]
    assert redaction.merge([(0, 4, "A"), (3, 9, "B")]) == [(0, 9, "B")]


def test_redact_column_counts(spark):
    df = spark.createDataFrame([("a@b.org and c@d.org",), (None,), ("",)], "comment_text string")
    out = redaction.redact_column(df)
    assert sorted(r["redacted_comment_text"] for r in out.collect()) == ["", "", "[EMAIL_ADDRESS] and [EMAIL_ADDRESS]"]
    assert [tuple(r) for r in redaction.redaction_counts(out).collect()] == [("EMAIL_ADDRESS", 2)]
    assert redaction.safe_display(df).columns == ["comment_text"]


def test_html():
    assert html_to_text("<p>First &amp; second</p><p>Third</p>") == "First & second Third"
    assert html_to_text(None) == ""


def test_union_of_spans_equals_brute_force():
    import random

    rng = random.Random(9)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9), rng.choice("ABC")) for a in (rng.randrange(30) for _ in range(rng.randrange(9)))]
        covered = {k for a, b, _ in spans for k in range(a, b)}
        joined = {k for a, b, _ in spans for k in range(a + 1, b)}
        got = redaction.merge(spans)
        assert {k for a, b, _ in got for k in range(a, b)} == covered
        # Two neighbours are in one union only if a span goes across.
        assert {k for a, b, _ in got for k in range(a + 1, b)} == joined
        for a, b, kind in got:
            inside = [s for s in spans if a <= s[0] and s[1] <= b]
            assert kind == min(inside, key=lambda s: (s[0] - s[1], s[0]))[2] or max(y - x for x, y, _ in inside) == max(y - x for x, y, t in inside if t == kind)


def test_question_openings(spark):
    assert one(spark, "3) “Where is it", text.question_reasons) == ["wh_word"]
    assert one(spark, "- ('Does it run", text.question_reasons) == ["auxiliary"]
    assert one(spark, "Is it?\"') ]", text.question_reasons) == ["question_mark", "auxiliary"]
