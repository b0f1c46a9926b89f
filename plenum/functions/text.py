"""Text scalars as column expressions; they stay inside code generation unless they say otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_SPACE = r"(?U)[\s\x1c-\x1f]+"
MARKERS = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "STREET_ADDRESS", "UNIT_NUMBER", "URL")
_MARKER = r"\[(?:" + "|".join(MARKERS) + r")\]"

# Words that make up contact boilerplate, and the words that open questions.
CONTACT_WORDS = "contact at or i live email me us call on my address is".split()
WH_WORDS = "who whom whose what which when where why how".split()
AUXILIARIES = "am is are was were do does did have has had can could shall should will would may might must".split()


# What may stand behind a question mark and before the first word, and how a list item begins.
_CLOSING, _OPENING = "\"'”’)]} ", " \t\n\r\x0b\x0c\"'“‘(["
LIST_ITEM = r"^(?:\d+[.)]|[-*•])\s+"


def strip(c: Column) -> Column:
    """Trims all Unicode white space and the separators 0x1c to 0x1f; null becomes the empty string."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), _EDGE, "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), _SPACE), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def has_letter(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"\p{L}")


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}]", ""))


def fingerprint(c: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)


def normalised(c: Column) -> Column:
    """Lower case and single blanks, the key under which wordings are the same."""
    return squeeze(F.lower(c))


def sentence_split(c: Column) -> Column:
    """Parts after ., ! or ? and white space; the simple split that weighting and boilerplate use."""
    return F.split(c, r"(?<=[.!?])\s+")


def without_boilerplate(c: Column) -> Column:
    """Redacted text for analysis: markers blanked, and sentences dropped that hold a marker and otherwise only contact words."""
    contact = F.array(*[F.lit(w) for w in CONTACT_WORDS])

    def clean(s: Column) -> Column:
        return F.regexp_replace(s, _MARKER, " ")

    def boilerplate(s: Column) -> Column:
        left = F.regexp_extract_all(F.lower(clean(s)), F.lit(r"(\p{L}+)"), F.lit(1))
        return s.rlike(_MARKER) & (F.size(F.array_except(left, contact)) == 0)

    return squeeze(F.array_join(F.transform(F.filter(sentence_split(F.coalesce(c, F.lit(""))), lambda s: ~boilerplate(s)), clean), " "))


def for_scoring(c: Column) -> Column:
    """Text as affect models expect it: mentions as @user, links as http."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)(?<!\w)@\w+", "@user"), r"https?://\S+", "http")


def spreadsheet_safe(c: Column) -> Column:
    """Strings that a spreadsheet would take for a formula get a leading apostrophe."""
    return F.when(c.rlike(r"(?U)^\s*[=+\-@]") | c.rlike(r"^[\t\r\n]"), F.concat(F.lit("'"), c)).otherwise(c)


def heading(c: Column, limit: int = 76) -> Column:
    """One line of at most `limit` characters with the marks of Markdown escaped."""
    line = squeeze(F.coalesce(c, F.lit("")))
    cut = F.when(F.length(line) > limit, F.concat(F.rtrim(F.substring(line, 1, limit - 3)), F.lit("..."))).otherwise(line)
    return F.regexp_replace(cut, r"([\\`*_{}\[\]()#+\-.!|<>~$])", r"\\$1")


def question_reasons(c: Column) -> Column:
    """Why a sentence is a question candidate: a question mark before closing marks, else an opening wh-word or auxiliary."""
    text = strip(c)
    mark = F.rtrim(text, F.lit(_CLOSING)).endswith("?")
    # The first word: behind the number or dot of a list item and whatever opens a quotation.
    item = F.regexp_extract(text, LIST_ITEM, 0)
    first = F.lower(F.regexp_extract(F.ltrim(F.substr(text, F.length(item) + 1), F.lit(_OPENING)), "^[A-Za-z]*", 0))
    found = F.array(F.when(mark, F.lit("question_mark")), F.when(first.isin(*WH_WORDS), F.lit("wh_word")).when(first.isin(*AUXILIARIES), F.lit("auxiliary")))
    return F.when(has_letter(text), F.array_compact(found)).otherwise(F.array().cast("array<string>"))


def lexicon_hits(tokens: Column, lexicon: Sequence[str]) -> Column:
    """How many different words of a list occur among the tokens."""
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in lexicon])))


def letter_tokens(c: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))
