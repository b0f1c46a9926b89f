"""Typed redaction by patterns, with overlapping spans merged before anything is replaced."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RedactionError

#: A detector of persons: texts -> for each the spans (start, end).
PersonDetector = Callable[[list[str]], list[list[tuple[int, int]]]]

# The five patterns, the form of a named contact, and the wordings around two words that only look like names.
EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
URL = r"\b(?:https?://|www\.)[^\s<>()]+"
PHONE = r"(?<!\w)(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]\d{3}[\s.-]\d{4}(?!\w)"
STREET = r"\b\d{1,6}\s+(?:[A-Z0-9.'-]+\s+){0,5}(?:STREET|ST|AVENUE|AVE|ROAD|RD|BOULEVARD|BLVD|DRIVE|DR|LANE|LN|COURT|CT|PLACE|PL|PARKWAY|PKWY|WAY)\b\.?,?"
UNIT = r"\b(?:APT|APARTMENT|UNIT|SUITE|STE)(?:\.\s*#?\s*|\s+#?\s*|#\s*|(?=\d))(?:(?=[A-Z0-9-]*\d)[A-Z0-9]+(?:-[A-Z0-9]+)*|[A-Z])(?![\w-])"
CONTACT_NAME = r"\bContact\s+([A-Z][a-z]*(?:[-'][A-Z]?[a-z]+)?(?:\s+[A-Z][a-z]*(?:[-'][A-Z]?[a-z]+)?){1,3})\s+at\s+"
LIGHTING = r"\s+exterior\s+lighting\b"
MAIL_WORDS = ("me at", "us at")


@dataclass(frozen=True)
class Rule:
    """One row of the rule table: what a pattern finds, which part of it counts, and what must begin where the match ends."""

    kind: str
    pattern: re.Pattern
    group: int = 0
    shed: str = ""  # marks that don't belong to the end of a span
    before: tuple[str, ...] = ()  # kinds of which a span must follow at once


RULES = (
    Rule("EMAIL_ADDRESS", re.compile(EMAIL, re.I)),
    Rule("URL", re.compile(URL, re.I), shed=".,;:!?"),
    Rule("PHONE_NUMBER", re.compile(PHONE)),
    Rule("STREET_ADDRESS", re.compile(STREET, re.I)),
    Rule("UNIT_NUMBER", re.compile(UNIT, re.I)),
    Rule("PERSON", re.compile(CONTACT_NAME), group=1, before=("EMAIL_ADDRESS", "PHONE_NUMBER")),
)
#: A detected "person" is none if it is this word between such a beginning and such a continuation of the text.
NO_PERSON = {
    "broken": (re.compile(r"\s*\Z"), re.compile(LIGHTING, re.I)),
    "email": (re.compile(r".*\Z", re.S), re.compile(rf"\s*(?:(?:{'|'.join(MAIL_WORDS)})\s*)?(?={EMAIL})", re.I)),
}


def _is_person(text: str, a: int, b: int) -> bool:
    around = NO_PERSON.get(text[a:b].casefold())
    return around is None or not (around[0].match(text[:a]) and around[1].match(text, b))


def detect(text: str, persons: Iterable[tuple[int, int]] = ()) -> list[tuple[int, int, str]]:
    """All spans of a text, before merging: one pass of the rule table, then the detected persons that the exceptions leave."""
    places: dict[str, list[tuple[int, int]]] = {}
    spans: list[tuple[int, int, str]] = []
    for rule in RULES:
        follows = {a for kind in rule.before for a, _ in places.get(kind, ())}
        hits = [(m.start(rule.group), m.start(rule.group) + len(m[rule.group].rstrip(rule.shed) if rule.shed else m[rule.group])) for m in rule.pattern.finditer(text) if not rule.before or m.end() in follows]
        places.setdefault(rule.kind, []).extend(hits)
        spans += [(a, b, rule.kind) for a, b in hits]
    return spans + [(a, b, "PERSON") for a, b in persons if _is_person(text, a, b)]


def merge(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping spans become their union, named after the longest of them; spans that only touch stay apart.

    A sweep over all limits in order: a union lasts as long as any span is open, and ends close before others open.
    """
    if not spans:
        return []
    limits = sorted([(a, 1) for a, _, _ in spans] + [(b, 0) for _, b, _ in spans])
    depth = list(accumulate(1 if opens else -1 for _, opens in limits))
    starts = [at for (at, opens), d in zip(limits, depth, strict=True) if opens and d == 1]
    stops = [at for (at, opens), d in zip(limits, depth, strict=True) if not opens and d == 0]
    names: list[tuple[int, int, str]] = [(0, 0, "")] * len(starts)
    for a, b, kind in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        k = bisect_right(starts, a) - 1
        if not names[k][2]:  # the longest comes first, of equal ones the first in the text
            names[k] = (a, b, kind)
    return [(a, b, name[2]) for a, b, name in zip(starts, stops, names, strict=True)]


def redact_text(text: str | None, persons: Iterable[tuple[int, int]] = ()) -> tuple[str, dict[str, int]]:
    """The text with a marker for each merged span, and how many of each type; null gives the empty text."""
    unions = merge(detect(text, persons)) if text else []
    edges = [0, *chain.from_iterable((a, b) for a, b, _ in unions), len(text or "")]
    kept = [(text or "")[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    markers = [f"[{kind}]" for _, _, kind in unions]
    return "".join(chain.from_iterable(zip_longest(kept, markers, fillvalue=""))), dict(sorted(Counter(kind for _, _, kind in unions).items()))


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType()))])


def redacted(c: Column, detector: PersonDetector | None = None) -> Column:
    """Struct (text, counts) of a text column, in Arrow batches.  The detector, if any, is loaded once a batch iterator."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            plain = ["" if t is None else t for t in texts]
            if detector is None:
                found = [()] * len(plain)
            else:
                found = detector(plain)
                if len(found) != len(plain):
                    raise RedactionError("Name detection could not finish.")
            done = [redact_text(t, p) for t, p in zip(plain, found, strict=True)]
            yield pd.DataFrame({"text": [t for t, _ in done], "counts": [n for _, n in done]})

    return run(c.cast("string"))


def redact_column(df: DataFrame, source: str = "comment_text", output: str = "redacted_comment_text", *, detector: PersonDetector | None = None, require_person_model: bool = False) -> DataFrame:
    """The table with the redacted text and a map of counts; values that were found are never kept."""
    if source not in df.columns:
        raise RedactionError("The source column is missing.")
    if output in df.columns and output != source:
        raise RedactionError("The output column exists already.")
    if require_person_model and detector is None:
        raise RedactionError("Name detection is unavailable.")
    both = df.withColumn("__redacted", redacted(F.col(f"`{source}`"), detector))
    return both.withColumn(output, F.col("__redacted.text")).withColumn("redaction_counts", F.col("__redacted.counts")).drop("__redacted")


def redaction_counts(df: DataFrame) -> DataFrame:
    """(entity_type, n) over all rows; the maps are added up before the shuffle."""
    return df.select(F.explode("redaction_counts").alias("entity_type", "k")).groupBy("entity_type").agg(F.sum("k").cast("long").alias("n"))


def safe_display(df: DataFrame, source: str = "comment_text", *, detector: PersonDetector | None = None) -> DataFrame:
    """Only the redacted comments, under the name of the source; identifiers and mapped fields are left behind."""
    return df.select(redacted(F.col(f"`{source}`"), detector)["text"].alias(source))


def mail_and_links(c: Column) -> Column:
    """E-mail addresses and links masked by column expressions alone, for where no Python may run."""
    masked = F.regexp_replace(F.coalesce(c, F.lit("")), r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL_ADDRESS]")
    return F.regexp_replace(masked, r"(?:https?://|www\.)[^\s<>()]*[^\s<>().,;:!?]", "[URL]")
