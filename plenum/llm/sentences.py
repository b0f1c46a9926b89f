"""Problem 5: sentence boundaries in many languages and scripts.

A semi-Markov model: each line of a text is cut into spans at candidate boundaries, and
dynamic programming picks the spans whose scores add up highest.  A span is scored as a
whole: its length in words, the words that open and close it, the marks at its end, and
whether its quotation marks balance.  Line breaks always end a sentence, so every line is
solved for itself.

How well a word opens or closes a sentence is fitted on all texts: words
at the ends of lines, which are ends of sentences in any case, against words inside.  What
the marks say is scored by rules for the scripts, with fixed scores; no rule takes a
candidate out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import by_batch, cut, narrow

SPANS = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])

# Abbreviations that stand before something: a name, a number or the next word.
_BEFORE = frozenset(
    "mr mrs ms dr st rev hon prof gov sen rep supt sgt lt capt no nos vs e.g i.e eg ie approx ca cf fig art sec ext tel cel vol pp dept est nr núm num nº n.º p.ej ej sr sra srta sres dra dña d exmo exma ing lic arq prof.a profa av avda apdo col c apto ap bl r al ul pl os m lok np godz ok dyr inż mgr hab ks św tzn tzw wg sz jw jr tj min tys mln str pok woj red mieszk p пр ul डॉ डा श्री प्रो रु सं د أ ص ب م ش ت".split()
)
# Abbreviations that may as well end a sentence: times, months, parts of addresses, endings of lists.
_EITHER = frozenset("a.m p.m am pm jan feb mar apr jun jul aug sep sept oct nov dec ave rd ct blvd ln ter terr pkwy sq hwy cir apt ste fl bldg rm inc ltd co corp etc usa u.s u.s.a d.c ph.d b.a m.a itd itp dr st".split())
_PLACE = frozenset("st ave rd ct blvd ln dr ter terr pkwy sq hwy cir apt ste fl bldg".split())
_MONTH = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec".split())

# Words that open sentences much more often than they follow an abbreviation.
_OPENERS = frozenset(
    """a about after all also an and another any are as ask at because before between both but by call can come contact could could did do does each email even every families follow for from given good grandparents half have he hello her here his how however i i'm i've if in instead is it it's its just keep kindly last least less let look make many mark may maybe more most mr mrs ms my neighbors new no nobody none not now of older on once one only or our out over parents people perhaps please pupils put retired rev roughly score send several she should since so some somebody someone still strongly students substitute suppose text thank thanks that the their then there these they this those though to too under unless until up version visitors ward we well what when where which while who whose why will with without working would write yes yet you your younger unit bus case budget invoice caregivers new foster dr prof
    al algunos ante antes aunque basta así cada como con cuando cuándo cuánto dale de del desde después dónde el ella ellas ellos en entonces es esa ese eso esta este esto falta gracias hay hoy la las le les llamen llame llámenme lo los los más me mi mis mientras muchas muchos muy nadie necesitamos ni no nos nosotros nuestra nuestro nuestros para pedimos pero por porque pueden que qué queremos quien quién se señor señora si sin sobre soy su sus también tengo todas todos tras un una unas unos usted van vivo y ya yo
    a ao aos até agora aqui as às basta cada com como da das de depois desde dia do dos e ela ele eles em embora enquanto então essa esse esta este eu falta há hoje isso já linha mais mas meu meus minha minhas moro muitas muitos na não nas nem ninguém no nos nós nossa nosso o obrigada obrigado onde os ou para pedimos pois por porque quando quanto que quem quero queremos se sem seu sou sua também temos tenho todas todos um uma várias vários você
    a aby albo ale bardzo bez bo być chcemy co czemu czy dlaczego dlatego do dyrektor dziadkowie dziękuję dziękujemy dzisiaj dziś gdy gdzie i ich im ja jak jaki jako jestem jeszcze jeśli jeżeli już każdy kiedy kierowcy kto linia ma mam mamy mieszkam moja mój może można my na nasz nasza nasze nazywam nie nigdy nikt nowi o od oni opiekunowie ostatnio pan pani po pod podczas ponieważ potem proszę prosimy przed przez przy punkt rano rodzice sąsiedzi są tam tej ten to trzeba tu w wczoraj wciąż we wiele wieczorem wszyscy wtedy z za zawsze ze zebranie zgadzam że""".split()
)

_OPEN, _CLOSE = "“«„「『（([{", "”»」』）)]}"
_PAIRS = {"”": "“", "»": "«", "」": "「", "』": "『", "）": "（", ")": "(", "]": "[", "}": "{"}
_HAN = "㐀-鿿豈-﫿"

# A candidate: closing marks with the quotes that follow them, or a blank between Chinese characters.
_CANDIDATE = re.compile(rf"([.!?…。！？｡؟।॥]+)([\"'”’»」』）)\]]*)(\s*)|(?<=[{_HAN}])[ \t　]+(?=[“「『{_HAN}0-9])")
_WORD = re.compile(r"[^\W_]+(?:['’.][^\W_]+)*")
_LAST = re.compile(r"([^\s!?…。！？“”\"«»「」()（）\[\],;:，；：、]*)$")
_MARKER = re.compile(r"[ \t]*(?:[-–—*•·]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])[ \t]+")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
_ADDRESS = re.compile(r"(?:^|[\s,#])[0-9]{1,5}[A-Za-z]?\s+(?:(?:[NSEWnsew]\.|[^\s,.!?:;]+)\s+){1,3}$")
_DOMAIN = re.compile(r"(?:com|org|net|edu|gov|info|test|example|invalid|localhost|io|us|mx|pl|br|cn|in|co|uk)\b", re.I)

_CAPITAL = re.compile(r"[A-Z][a-z]")
_CODED = re.compile(r"[A-Za-z]{0,4}-?[0-9]")
_UNIT = re.compile(r"(?:apt|apartment|unit|suite|ste|flat|no|p\.?\s?o)\b\.?\s?#?[0-9]", re.I)
_TITLED = re.compile(r"\b(?!The\b)[A-Z][\w'’-]+\s+$")
_POLISH = re.compile("[ąćęłńśźż]", re.I)

# Scores, in the units of a log-likelihood ratio.
HARD, LIKELY, UNLIKELY, NEVER = 6.0, 3.0, -3.0, -12.0
#: How often a word must occur; what its log-odds weigh, and count for at most.
LEAST_SEEN, WORD_WEIGHT, WORD_LIMIT = 5, 1.0, 1.5
#: A span of n words costs LENGTH[n] (short ones) or grows slowly beyond LONG_WORDS.
SHORT = (-6.0, -1.2, -0.4, 0.0)
LONG_WORDS, LONG_COST = 60, 0.05
UNBALANCED = -5.0


def _length_score(words: int) -> float:
    if words < len(SHORT):
        return SHORT[words]
    return 0.0 if words <= LONG_WORDS else -LONG_COST * (words - LONG_WORDS)


def _joins(word: str, line: str) -> bool:
    # "i" is Polish "and" only where the line is Polish.
    return word in _JOINING and (word != "i" or _POLISH.search(line) is not None)


def _boundary(line: str, at: re.Match) -> float | None:
    """How well a sentence ends at this candidate, by what closes it and what opens after it; None: no boundary."""
    marks = at[1]
    end = at.end()
    if marks is None:  # a blank between Chinese characters
        return LIKELY
    after = line[end : end + 1]
    if not after:
        return HARD
    closing, gap = at[2], at[3]
    start = at.start()
    before = line[start - 1 : start]
    opener = _WORD.match(line, end)
    if opener is None and after in "“\"'‘’¿¡«「『(（*-–—_#":
        opener = _WORD.match(line, end + 1)
    word = opener[0] if opener else ""
    low = word.lower()
    if marks[0] in "。！？｡":
        if closing:
            return UNLIKELY if after not in "“「『" and not gap else LIKELY
        return HARD
    if marks[0] in "।॥":
        return HARD if not closing or gap else UNLIKELY
    capital = word[:1].isupper() or bool(word) and word[0].isalpha() and word[0] == word[0].swapcase() and not word[0].isascii()
    shouted = len(word) > 1 and word.isupper() and word.isascii()
    opens = low in _OPENERS
    fresh = after in "¿¡“«「"
    if "!" in marks or "?" in marks or "؟" in marks:
        if closing and closing.strip(")]）"):
            # A quoted question goes on when a lower-case or shouted non-opener follows.
            if not gap:
                return NEVER if after.isalnum() and not capital else UNLIKELY
            if (capital and not shouted) or fresh:
                return LIKELY
            return LIKELY if shouted and opens and not _joins(low, line) else UNLIKELY
        if not gap:
            if after.isalnum() or fresh or after in "\"'":
                return LIKELY if before.isalpha() or before.isdigit() or before in ".)”\"" else UNLIKELY
            return None if after in ",;:.-–—/&=#%" else UNLIKELY
        return HARD
    if "…" in marks or len(marks) > 1 and set(marks) == {"."}:
        if closing and not gap:
            return UNLIKELY
        if fresh:
            return LIKELY
        if _joins(low, line) or not word and after.islower():
            return UNLIKELY
        if capital and not shouted:
            return LIKELY if gap or len(marks) > 2 else UNLIKELY
        if shouted or word[:1].islower():
            return LIKELY if opens else UNLIKELY
        return LIKELY if gap else UNLIKELY
    # A single full stop.
    last = _LAST.search(line, max(0, start - 40), start)[1].lower()
    head, dot, tail = last.rpartition(".")
    if dot and (len(head.rpartition(".")[2]) > 2 or len(head) == 2 and tail in _BEFORE) and "@" not in head and not head.startswith(("http", "www")):
        last = tail  # the full stop before had no space after it
    if not gap and not closing:
        if not word or after.isdigit() or "@" in last or last.startswith(("http", "www")):
            return None
        if len(last) == 1 and last.isalpha() or last in _BEFORE or "." in last:
            return None
        if word[0].isupper() and not (shouted and line[start - 1].isupper() and not opens):
            tail = line[end : end + 30]
            return None if _DOMAIN.match(word) and "@" in line[max(0, start - 60) : start].rpartition(" ")[2] or "@" in tail.split(" ")[0] else LIKELY
        if not word[0].isascii() and word[0] == word[0].swapcase():
            return LIKELY if len(last) > 1 else None
        if opens and len(last) >= 3 and not _DOMAIN.match(word) and "@" not in line[end : end + 40].split(" ")[0]:
            return LIKELY if not _joins(low, line) else None
        return None
    if closing and closing.strip(")]）"):
        if not gap:
            return UNLIKELY if not capital else 0.5
        if capital and not shouted or fresh:
            return LIKELY
        return LIKELY if shouted and opens and not _joins(low, line) else UNLIKELY
    if line[:start].strip().isdigit() or _MARKER.fullmatch(line[: start + 1] + " "):
        return NEVER  # the number of a list item
    if last.isdigit() or not last:
        return HARD if last else LIKELY
    bare = last.rstrip(".")
    if len(bare) == 1 and bare.isalpha():
        if bare.isascii() and line[max(0, start - 4) : start - 1].rstrip().endswith(("º", "ª", ".o")):
            return LIKELY if capital or fresh else UNLIKELY
        return NEVER if not fresh else LIKELY
    if bare in _EITHER:
        if fresh:
            return LIKELY
        if bare in _MONTH:
            return NEVER if after.isdigit() else LIKELY if opens and capital else UNLIKELY
        if bare in _PLACE:
            if after.isdigit() or after in "#,;":
                return NEVER
            # "12 Oak St. We" ends, "St. Mary" and "Dr. Lee" don't, nor does "Oak St. near the hall" or "Ave. Apt. 4".
            if not _ADDRESS.search(line, max(0, start - 60), start - len(bare)) or _UNIT.match(line, end):
                return NEVER
            if capital and not shouted:
                return LIKELY if line[: start - len(bare)].rstrip()[-1:].islower() and _TITLED.search(line, max(0, start - 40), start - len(bare)) else NEVER
            return LIKELY if opens and low not in _INSIDE and low not in ("mr", "mrs", "ms", "dr") and (shouted or not _CAPITAL.search(line, max(0, start - 60), start)) else NEVER
        if after.isdigit():
            return UNLIKELY
        if low == "please" and line[opener.end() : opener.end() + 1] in ("", ".", "!", "?", "…"):
            return UNLIKELY
        if word[:1].islower() and _CAPITAL.search(line, max(0, start - 60), start):
            return UNLIKELY
        if shouted or word[:1].islower():
            return LIKELY if opens and low not in _INSIDE else UNLIKELY
        return LIKELY if capital else UNLIKELY
    if bare in ("no", "nos") and not after.isdigit() and after != "#":  # a number would follow the abbreviation
        if _CODED.match(line, end):
            return NEVER
        return LIKELY if capital or fresh else UNLIKELY
    if bare in _BEFORE:
        return NEVER
    if "." in bare and len(bare) <= 6 and all(len(p) <= 2 for p in bare.split(".")):
        return LIKELY if opens and capital else UNLIKELY
    if after in ",;:":
        return NEVER
    return HARD


# Words that join a clause to what came before, in place of opening a sentence.
_JOINING = frozenset("and but or yet so still then y e pero o u pero mas ou i ale oraz albo czyli asked said shouted replied wrote told".split())
# Words that often follow a time or an address inside a sentence.
_INSIDE = frozenset("and on at in or to from after before over since with for by of until as when while every once near during last most y e en a de del por para no na em às ao do da i o w z na do po od and the late van".split()) - {"the"}


@dataclass(frozen=True)
class Words:
    """What a word adds to the score of a span that it opens or closes; words that are not listed add nothing."""

    opening: dict[str, float]
    closing: dict[str, float]

    @classmethod
    def fit(cls, texts: Iterable[str]) -> Words:
        """Log-odds of the first and the last word of a line against words between blanks and other words."""
        return cls.from_counts(_counted(texts))

    @classmethod
    def from_counts(cls, counts: dict[str, tuple[int, int, int]], totals: tuple[int, int, int] | None = None) -> Words:
        """The same from how often each word is first, last and inside; rare words may be left out if the totals are given."""
        firsts, lasts, insides = totals or tuple(sum(n[k] for n in counts.values()) for k in range(3))

        def odds(k: int, edges: int) -> dict[str, float]:
            n, m = edges + 1.0, insides + 1.0
            raw = {w: math.log((c[k] + 0.5) / n) - math.log((c[2] + 0.5) / m) for w, c in counts.items() if c[k] + c[2] >= LEAST_SEEN}
            return {w: WORD_WEIGHT * max(-WORD_LIMIT, min(WORD_LIMIT, x)) for w, x in raw.items()}

        return cls(odds(0, firsts), odds(1, lasts))


def _counted(texts: Iterable[str]) -> dict[str, tuple[int, int, int]]:
    """How often each word is the first and the last of a line, and how often it stands inside one."""
    first, last, inside = Counter(), Counter(), Counter()
    for text in texts:
        for line in _LINE.findall(text):
            found = _WORD.findall(_MARKER.sub("", line, count=1))
            if len(found) < 4:
                continue
            first[found[0]] += 1
            last[found[-1]] += 1
            inside.update(_INNER.findall(line))
    out: dict[str, list[int]] = {}
    for k, counter in enumerate((first, last, inside)):
        # Each different word is put into small letters once.
        for word, n in counter.items():
            out.setdefault(word.lower(), [0, 0, 0])[k] += n
    return {w: tuple(n) for w, n in out.items()}


#: Words between words: white space and a letter, digit or comma stand on either side.
_INNER = re.compile(r"(?<=[\w,] )[^\W_]+(?= [^\W_])")
NO_WORDS = Words({}, {})


def line_spans(line: str, words_of: Words = NO_WORDS) -> list[tuple[int, int]]:
    """Sentences of one line as offsets; the best segmentation by dynamic programming.

    Every pair of candidates is a possible span.  Spans of up to LONG_WORDS words are looked at one by one; of the
    longer ones, whose score falls evenly with their length, the best start is kept for each state of the quotation
    marks, so that long lines take no longer for each candidate, and nothing is left out.
    """
    lead = len(line) - len(line.lstrip())
    stop = len(line.rstrip())
    if lead >= stop:
        return []
    cuts, scores, begins = [lead], [0.0], [lead]
    for found in _CANDIDATE.finditer(line, lead, stop):
        score = _boundary(line[:stop], found)
        if score is None:
            continue
        gap_at = found.end() - len(found[3]) if found[1] is not None else found.start()
        if found.end() >= stop:
            break
        if words_of.opening:
            after = _WORD.search(line, found.end(), min(stop, found.end() + 60))
            before = _LAST.search(line, max(lead, found.start() - 40), found.start())
            score += words_of.opening.get(after[0].lower(), 0.0) if after else 0.0
            score += words_of.closing.get(before[1].lower(), 0.0) if before else 0.0
        cuts.append(gap_at), scores.append(score), begins.append(found.end())
    if len(cuts) == 1:
        return [(lead, stop)]
    cuts.append(stop), scores.append(HARD), begins.append(stop)
    n = len(cuts)
    words = [0] * n
    depth = [0] * n
    straight = [0] * n
    for k in range(1, n):
        piece = line[begins[k - 1] : cuts[k]]
        words[k] = words[k - 1] + _count_words(piece)
        d = s = 0
        if not piece.isalnum():
            for c in piece:
                if c in "“«「『":
                    d += 1
                elif c in "”»」』":
                    d -= 1
                elif c == '"':
                    s += 1
            s += _single_quotes(piece)
        depth[k], straight[k] = depth[k - 1] + d, straight[k - 1] + s & 1
    best, back = [0.0] + [-1e9] * (n - 1), [0] * n
    near = 0  # starts from here on are at most LONG_WORDS before
    far: dict[tuple[int | None, int | None], tuple[float, int]] = {}
    for j in range(1, n):
        while words[j] - words[near] > LONG_WORDS:
            value = (best[near] + LONG_COST * words[near], -near)
            for state in ((depth[near], straight[near]), (depth[near], None), (None, straight[near]), (None, None)):
                far[state] = max(far.get(state, value), value)
            near += 1
        top, at = -1e18, 0
        for i in range(j - 1, near - 1, -1):
            value = best[i] + _length_score(words[j] - words[i])
            if depth[j] != depth[i]:
                value += UNBALANCED
            if straight[j] != straight[i]:
                value += UNBALANCED
            if value > top:
                top, at = value, i
        if far:
            for state, price in (((depth[j], straight[j]), 0.0), ((depth[j], None), UNBALANCED), ((None, straight[j]), UNBALANCED), ((None, None), 2 * UNBALANCED)):
                if state in far:
                    value = far[state][0] + price - LONG_COST * (words[j] - LONG_WORDS)
                    if value > top:
                        top, at = value, -far[state][1]
        best[j], back[j] = top + scores[j], at
    out, j = [], n - 1
    while j:
        i = back[j]
        out.append((begins[i], cuts[j]))
        j = i
    return out[::-1]


_SINGLE = re.compile(r"(?:(?<=\s)|^)['’‘](?=\w)|(?<=[\w.!?,])['’](?=\s|$|[,.;:!?])")


def _single_quotes(piece: str) -> int:
    if "'" not in piece and "’" not in piece:
        return 0
    return len(_SINGLE.findall(piece))


def _count_words(piece: str) -> int:
    if piece.isascii():
        return piece.count(" ") + 1
    han = sum("㐀" <= c <= "鿿" for c in piece)
    return piece.count(" ") + 1 + han // 2


def sentences(text: str, words_of: Words = NO_WORDS) -> list[tuple[int, int]]:
    """All sentences of a text as half-open code-point offsets, in order; they cover all but white space."""
    out: list[tuple[int, int]] = []
    for line in _LINE.finditer(text):
        base = line.start()
        out += [(base + a, base + b) for a, b in line_spans(line[0], words_of)]
    return out


COUNTS = T.StructType([T.StructField("word", T.StringType())] + [T.StructField(k, T.LongType()) for k in ("first", "last", "inside")])


def fit_words(table: DataFrame, *, text_column: str) -> Words:
    """Words.fit on all texts: each task counts its own, and the driver gets one row for each word that is seen often enough."""
    texts = narrow(table, text=text_column).select(F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _counted(batch.column(0).to_pylist())
            columns = [list(found), *([n[k] for n in found.values()] for k in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=COUNTS.fieldNames())

    sums = [F.sum(k).alias(k) for k in ("first", "last", "inside")]
    counts = cut(texts.mapInArrow(run, COUNTS).groupBy("word").agg(*sums))
    totals = counts.agg(*sums).first()
    often = counts.where((F.col("first") + F.col("inside") >= LEAST_SEEN) | (F.col("last") + F.col("inside") >= LEAST_SEEN)).collect()
    return Words.from_counts({r["word"]: tuple(r)[1:] for r in often}, tuple(n or 0 for n in totals))


def split_sentences(table: DataFrame, *, id_column: str = "row_id", text_column: str = "comment_text") -> DataFrame:
    """(row_id, start_pos, end_pos) of every sentence of every row whose text is not null or blank.

    Repeated rows each give their rows; a null id stays null; extra columns are ignored; an empty table gives an
    empty table.  The words are fitted on all texts in a pass of their own; then one narrow pass: whole texts, no shuffle.
    """
    source = narrow(table, row_id=id_column, text=text_column).select(F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    shared = table.sparkSession.sparkContext.broadcast(fit_words(table, text_column=text_column))

    def make():
        words_of = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0)
            counts, starts, ends = [], [], []
            for text in batch.column(1).to_pylist():
                spans = sentences(text, words_of)
                counts.append(len(spans))
                for a, b in spans:
                    starts.append(a), ends.append(b)
            row = np.repeat(np.arange(len(counts)), counts)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=SPANS.fieldNames())

        return step

    return by_batch(source, SPANS, make)


def found(benchmark: DataFrame) -> DataFrame:
    """The sentences of every benchmark comment."""
    return split_sentences(benchmark)
