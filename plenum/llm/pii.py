"""Problem 4: personal information inside free text.

A linear-chain conditional random field tags each token as outside, or as the beginning or the
inside of one of five kinds of items.  Its features are the words of a fixed vocabulary with their
affixes, letter shapes, the words around and the forms that a stretch of tokens may have (e-mail,
telephone, code, address).  A word outside the vocabulary, as nearly every name is, counts by its
shape and its place only, so a name needs no likeness to those of the training rows.  The field is
trained on the driver from a small labelled table and the hand-labelled rows, kept in the shared
folder, and decoded by Viterbi for a whole batch of texts in numpy.  It decides every span; what
follows only takes punctuation and titles off the ends.
"""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded_sample, by_batch, narrow, shared_folder
from .pii_seed import labelled_table, vocabulary

KINDS = ("EMAIL_ADDRESS", "PHONE_NUMBER", "ID_NUMBER", "STREET_ADDRESS", "PERSON")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N = len(LABELS)
#: Rows of the seed table, and hand-labelled rows that are used at most.
SEED_ROWS, FIT_ROWS = 4500, 1500
#: Hashed features; training rounds; step.
BUCKETS, EPOCHS, RATE, DECAY = 1 << 16, 7, 0.25, 1e-6
#: Part of the known words that a training row hides, so that the field learns to do without any of them.
HIDDEN = 0.15
#: A word is ordinary if the texts have it in small letters this often and more often than capitalised; so many, the most frequent, are kept.
LEAST_SEEN, MOST_ORDINARY = 5, 200_000
#: Longest text that training takes, in tokens; decoding takes whole texts of any length, this many tokens of 1,024 texts at once.
LONGEST = 400

SPANS = T.StructType([T.StructField("row_key", T.LongType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType()), T.StructField("pii_type", T.StringType())])


# Forms that a stretch may have.  They only propose: the model decides from the words around.
_DOT = r"(?:\.|\s?[\[(]\s?(?:dot|punto|ponto)\s?[\])]\s?)"
EMAIL = re.compile(rf"[a-z0-9][a-z0-9._%+-]*(?:\s?(?:@|[\[(]\s?(?:at|arroba)\s?[\])])\s?[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+|\s(?:at|arroba)\s[a-z0-9-]+(?:\s(?:dot|punto|ponto)\s[a-z0-9-]+)+)", re.I)
PHONE = re.compile(r"(?<![A-Za-z0-9_.,$/-])(?:\+\d{1,3}[ .-]?|1[ .-])?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-]?)?\d{3,4}[ .-]?\d{3,4}(?:,?\s?(?:ext|x)\.?\s?\d{1,5})?(?![A-Za-z0-9_/-]|[.,]\d)", re.I)
CODE = re.compile(r"(?<![A-Za-z0-9_.,$@/-])(?:[a-z]{1,3}-?)?\d{3,}(?:[- ]\d{2,})*(?:-[a-z])?(?![A-Za-z0-9_@/-]|[.,:]\d)", re.I)
_NAME = r"[^\W\d_][\w'’-]*"
_WAY = r"(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|place|terrace|crescent|close|boulevard|blvd|parkway|pkwy|way|square|circle|cir|trail|highway|hwy)"
_STOP = r"(?:and|or|but|near|to|in|on|at|for|from|missed|never|every|last|since|after|before|during|once|over|shortly|because|is|was|we|i|the|a|my|please|office|evenings|where|which|who|so|then)\b"
_TOWN = rf"(?:,\s(?!{_STOP})[^\W\d_]+(?:\s\d{{5}}(?!\d))?)?"
_UNIT = r"(?:,?\s(?:#\s?\d+[a-z]?|(?:apt|apartment|unit|suite|ste|flat|room)\b\.?\s?#?\d+[a-z]?))?"
# An English address is looked for at each number, the others where their own words occur.
_FLAT = re.compile(r"\b(?:flat|apt|apartment|unit|suite)\b\.?\s\d+[a-z]?,\s$", re.I)
_ENGLISH = re.compile(rf"\d{{1,5}}[a-z]?\s(?:(?:[nsew]\b\.?|north|south|east|west)\s)?(?:{_NAME}\s){{1,2}}?{_WAY}\b\.?{_UNIT}{_TOWN}", re.I)
_NUMBER = re.compile(r"\d+(?=[A-Za-z]?\s)")
_NOT_BEFORE = re.compile(r"[\w.,$/:-]")
_BOX = re.compile(rf"\bp\.?\s?o\.?\sbox\s\d+{_TOWN}", re.I)
_ROMANCE = re.compile(r"\b(?:calle|av\.|avda\.|avenida|paseo|plaza|camino|rua|travessa|alameda)\s[^\W\d_]+(?:\s(?:de|del|da|do|dos|la|las|los)\s[^\W\d_]+)*(?:,?\s(?:núm\.|n\.º|no?\.)?\s?\d+[a-z]?)(?:,\s(?:piso\s\d+|apto\.?\s\d+|\d+\.[ºª]\s[a-z]\b))*", re.I)
_POLISH = re.compile(r"\b(?:ul|os|al|pl)\.\s[^\W\d_]+(?:-[^\W\d_]+)?(?:\s[^\W\d_]+)?\s\d+[a-z]?(?:/\d+|\sm\.\s\d+)?(?:,\s\d{2}-\d{3}\s[^\W\d_]+(?:-[^\W\d_]+)?)?", re.I)
_CHINESE = re.compile(r"(?:(?![在到往至于住址是寄])[㐀-鿿]){2,6}?(?:路|街|巷|道)\d+(?:弄\d+)?号(?:\d+栋)?(?:\d+单元)?(?:\d+室)?")
_HINDI = re.compile(r"मकान नंबर \d+,(?: [^\s,]+){1,3} (?:मार्ग|रोड|सड़क|गली)|\d+/\d+(?: [^\s,]+){1,3} (?:मार्ग|रोड|सड़क|गली)")
_ARABIC = re.compile(r"(?:\d+\s)?شارع \S+(?: \S+){0,3}?(?: \d+)?(?: رقم \d+|،\s?شقة \d+)")
# Every telephone number and identity number has five digits nearly together.
_FIVE = re.compile(r"\d{3}\)?[ .-]?\d{2}")


def addresses(text: str) -> list[tuple[int, int]]:
    """Stretches that look like a street address or a post box."""
    out = []
    for number in _NUMBER.finditer(text):
        a = number.start()
        if number.end() - a > 5 or out and a < out[-1][1] or a and _NOT_BEFORE.match(text, a - 1):
            continue
        m = _ENGLISH.match(text, a)
        if m:
            before = _FLAT.search(text, max(0, a - 24), a) if text[a - 2 : a] == ", " else None
            out.append((before.start() if before else a, m.end()))
    low, others = text.lower(), []
    if "box " in low:
        others.append(_BOX)
    if "alle " in low or "av. " in low or "rua " in low or "travessa " in low or "avenida " in low or "avda. " in low or "plaza " in low or "paseo " in low or "camino " in low or "alameda " in low:
        others.append(_ROMANCE)
    if "ul. " in low or "os. " in low or "al. " in low or "pl. " in low:
        others.append(_POLISH)
    if not text.isascii():
        if "号" in text:
            others.append(_CHINESE)
        if "मार्ग" in text or "रोड" in text or "सड़क" in text or "गली" in text:
            others.append(_HINDI)
        if "شارع" in text:
            others.append(_ARABIC)
    for form in others:
        out += [m.span() for m in form.finditer(text)]
    return sorted(out) if others else out


_AT = ("@", "(at", "( at", "[at", "[ at", "arroba", " dot ", " punto ", " ponto ")
_NOT_DIGIT = re.compile(r"\D+")
_DIGITS = re.compile(r"\d")


def tokens(text: str) -> list[tuple[int, int]]:
    """Offsets of words, numbers, single Chinese characters, marks and line breaks."""
    return [m.span() for m in _tokens_of(text).finditer(text)]


_MARKS = "\u0300-\u036f\u064b-\u0652\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963"
_TOKEN_ASCII = re.compile(r"[A-Za-z]+|[0-9]+|[^\w\s]|_|\n")
_TOKEN_ANY = re.compile(rf"[^\W\d_㐀-鿿]+(?:[{_MARKS}]+[^\W\d_㐀-鿿]*)*|[㐀-鿿]|\d+|[{_MARKS}]+|[^\w\s]|_|\n")


def _tokens_of(text: str) -> re.Pattern:
    return _TOKEN_ASCII if text.isascii() else _TOKEN_ANY


# Where the way of writing may change: after closing marks and line breaks.
_SEGMENT = re.compile(r"[^.!?\n]*(?:[.!?\n]+\s*|$)")
_SHORT = re.compile(r"(?:^|[\s(.'\"“‘])(?:[a-z]|st|dr|mrs?|ms|rev|ave?|rd|ct|ln|blvd|apt|ste|ext|vs|no|nos|approx|eg|ie|jan|feb|mar|apr|aug|sept?|oct|nov|dec|sra?|dra|núm|ej|ul|os|al|np|nr|ok|godz|dyr)\.\s*$", re.I)
_DOTS = re.compile(r"(?:\.\.|…)\s*$")
#: Marks of a word in a stretch without capitals, and in one of capitals only.
LOWER, UPPER = "\x01", "\x02"


# A stretch in small letters begins with one; one of capitals has many together.
_MAYBE_LOWER = re.compile(r"(?:^|[.!?\n])[^\w.!?\n]*[^\WA-Z0-9]")
_MAYBE_UPPER = re.compile(r"[A-Z]{3}[^a-z]{3}")


def word_strings(text: str) -> list[str]:
    """The tokens of a text, with a mark on those of stretches that are written in small letters or in capitals only."""
    pattern = _tokens_of(text)
    if not _MAYBE_LOWER.search(text) and not _MAYBE_UPPER.search(text):
        return pattern.findall(text)
    edges, kinds, at = [0], [], 0
    for piece in _SEGMENT.findall(text):
        kind = LOWER if piece.islower() else UPPER if len(piece) > 9 and piece.isupper() else ""
        if kind and kinds and not kinds[-1]:
            # What follows an abbreviation goes on as before, and so does a thought in small letters after dots.
            if _SHORT.search(text, max(0, at - 12), at) or kind == LOWER and _DOTS.search(text, max(0, at - 8), at):
                kind = ""
        at += len(piece)
        if kinds and kinds[-1] == kind:
            edges[-1] = at
        else:
            kinds.append(kind), edges.append(at)
    if not any(kinds):
        return pattern.findall(text)
    # No token goes across an edge: closing marks, line breaks and blanks are tokens or none by themselves.
    out: list[str] = []
    for a, b, kind in zip(edges, edges[1:], kinds, strict=False):
        part = pattern.findall(text, a, b)
        out += [w + kind if w[0].isalpha() else w for w in part] if kind else part
    return out


def forms(text: str) -> list[list[tuple[int, int]]]:
    """For each form (e-mail, telephone, code, address) the stretches of the text that have it."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    low = text.lower()
    if any(sign in low for sign in _AT):
        out[0] = [m.span() for m in EMAIL.finditer(text)]
    if _FIVE.search(text):
        for k, form in ((1, PHONE), (2, CODE)):
            for m in form.finditer(text):
                if 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 19:
                    out[k].append(m.span())
    if _DIGITS.search(text):
        out[3] = addresses(text)
    return out


def _crc(kind: str, value: str) -> int:
    return zlib.crc32((kind + value).encode("utf-8", "surrogatepass"))


def _shape(word: str) -> str:
    if word.isdigit():
        return f"d{min(len(word), 12)}"
    if word.isupper():
        return "X" if len(word) == 1 else "XX"
    if word[0].isupper():
        return "Xx"
    if word.islower():
        return "x" if len(word) > 1 else "x1"
    c = ord(word[0])
    return "han" if 0x3400 <= c <= 0x9FFF else "deva" if 0x900 <= c <= 0x97F else "arab" if 0x600 <= c <= 0x6FF else word[0] if not word[0].isalnum() else "Xy"


OFFSETS = (-4, -3, -2, -1, 0, 1, 2)


# What a word says: each slot pairs an offset (which neighbour it speaks to) with one of the word's own traits.
_TRAITS = ("word", "shape", "end3", "start3", "start4", "end4", "end2", "both", "length")
_SLOTS = [(o, 0) for o in OFFSETS] + [(o, t) for o in (-1, 0, 1) for t in (1, 2)] + [(0, t) for t in (3, 4, 5, 6, 7, 8)] + [(-1, 3)]
_SLOTS.sort(key=lambda s: OFFSETS.index(s[0]))
_TRAIT_OF = np.array([t for _, t in _SLOTS])
_SALT = np.array([(OFFSETS.index(o) * 16 + t + 1) * 0x9E3779B1 for o, t in _SLOTS], np.uint64)
_OFFSET_OF = np.array([o for o, _ in _SLOTS])
_FIRST = np.array([min(i for i, s in enumerate(_SLOTS) if s[0] == o) for o in OFFSETS])


def word_features(words: list[str], known: frozenset[int], ordinary: frozenset[str] | set[str] = frozenset(), hidden: bool = False) -> np.ndarray:
    """Hashed features of each word (words x slots); slots are ordered by the offset that they speak to.

    A word that isn't known (see Field.known), or that is hidden, has a shape, a length, two last letters and whether
    it is ordinary (see ordinary_words).
    """
    traits = np.empty((len(words), len(_TRAITS)), np.uint64)
    for i, word in enumerate(words):
        mode = word[-1] if word[-1] in (LOWER, UPPER) else ""
        if mode:
            word = word[:-1]
        low, shape = word.lower(), _shape(word) + mode
        if word.isdigit():
            low = shape
        elif _letter(word[0]) and (hidden or _crc("w", low) not in known):
            rare = _ORDINARY if low in ordinary else _RARE
            traits[i] = (rare, _crc("s", shape), rare, rare, rare, rare, _crc("g", low[-2:]), _crc(shape, str(rare)), min(len(low), 12))
            continue
        traits[i] = (_crc("w", low), _crc("s", shape), _crc("e", low[-3:]), _crc("p", low[:3]), _crc("q", low[:4]), _crc("f", low[-4:]), _crc("g", low[-2:]), _crc(shape, low), min(len(low), 12))
    with np.errstate(over="ignore"):
        mixed = (traits[:, _TRAIT_OF] + _SALT) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int32)


_RARE, _ORDINARY = _crc("w", "\0"), _crc("w", "\1")


def form_codes(spans: list[tuple[int, int]], found: list[list[tuple[int, int]]]) -> np.ndarray:
    """For each token the state (0 outside, 1 first, 2 inside) in each form, as one number below 81."""
    codes = np.zeros(len(spans), np.int64)
    if not any(found):
        return codes
    starts = np.array([a for a, _ in spans])
    for k, stretches in enumerate(found):
        place = 3**k
        for a, b in stretches:
            i = int(np.searchsorted(starts, a))
            first = True
            while i < len(spans) and spans[i][0] < b:
                if codes[i] // place % 3 == 0:
                    codes[i] += place * (1 if first else 2)
                first = False
                i += 1
    return codes


@dataclass
class Field:
    """Weights of the field: hashed word features, form states at three offsets, and steps between labels; and the known words."""

    word: np.ndarray  # BUCKETS x N
    form: np.ndarray  # 3 x 81 x N
    step: np.ndarray  # N x N
    start: np.ndarray  # N
    known: frozenset[int]  # hashes

    @classmethod
    def empty(cls) -> Field:
        known = frozenset(_crc("w", w) for w in vocabulary())
        return cls(np.zeros((BUCKETS, N), np.float32), np.zeros((3, 81, N), np.float32), np.zeros((N, N), np.float32), np.zeros(N, np.float32), known)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, word=self.word, form=self.form, step=self.step, start=self.start, known=np.array(sorted(self.known), np.int64))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Field:
        with np.load(io.BytesIO(data), allow_pickle=False) as kept:
            return cls(kept["word"], kept["form"], kept["step"], kept["start"], frozenset(kept["known"].tolist()))


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    step, start = np.zeros((N, N), np.float32), np.zeros(N, np.float32)
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            start[j] = -1e4
            for i, before in enumerate(LABELS):
                if before[2:] != label[2:]:
                    step[i, j] = -1e4
    return step, start


STEP_MASK, START_MASK = _allowed()


class Decoder:
    """Scores and decodes texts; remembers what each word adds to itself and its neighbours."""

    MEMORY = 150_000

    def __init__(self, field: Field, ordinary: frozenset[str] = frozenset()) -> None:
        self.field, self.ordinary = field, ordinary
        self.step, self.start = field.step + STEP_MASK, field.start + START_MASK
        # What a labelled stretch can win by its steps at most: on the way in and out, and for each token inside.
        begins, insides, plain = np.arange(1, N, 2), np.arange(2, N, 2), field.step[0, 0]
        out = max(0.0, float((field.step[1:, 0] - plain).max()))
        self.enter = (np.maximum(self.step[:, begins].max(axis=0) - plain, field.start[begins] - field.start[0]) + out)[:, None]
        self.stay = (np.maximum(self.step[begins, insides], self.step[insides, insides]) - plain)[:, None]
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = 1
        self.table = np.zeros((len(OFFSETS), 4096, N), np.float32)  # row 0 is the gap between texts

    def learn(self, words: set[str]) -> None:
        """Works out what new words add to themselves and their neighbours."""
        known = self.known
        numbers = {w for w in words if w.isdigit() and w.isascii()}
        fresh = [w for w in {*(words - numbers), *("0" * min(len(w), 12) for w in numbers)} if w not in known]
        for begin in range(0, len(fresh), 4096):
            part = fresh[begin : begin + 4096]
            while self.rows + len(part) > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            values = np.add.reduceat(self.field.word[word_features(part, self.field.known, self.ordinary)], _FIRST, axis=1)
            self.table[:, self.rows : self.rows + len(part)] = values.transpose(1, 0, 2)
            known.update(zip(part, range(self.rows, self.rows + len(part)), strict=True))
            self.rows += len(part)
        for w in numbers:
            known[w] = known["0" * min(len(w), 12)]

    def scores(self, texts: list[tuple[str, list[str], list[list[tuple[int, int]]]]], spans: dict[int, list[tuple[int, int]]]) -> list[np.ndarray]:
        """Emission scores (tokens x labels) of each text, given with the strings of its tokens and its forms.

        Offsets of tokens that had to be found are left in `spans`.
        """
        if len(self.known) > self.MEMORY:
            self._reset()
        gap = max(-min(OFFSETS), max(OFFSETS))
        ids, codes, sizes = [], [], []
        known = self.known
        none = np.zeros(gap, np.int64)
        pad = [0] * gap
        new = {w for _, strings, _ in texts for w in strings if w not in known}
        if new:
            self.learn(new)
        for text, strings, found in texts:
            ids += [known[w] for w in strings]
            ids += pad
            if any(found):
                spans[len(sizes)] = tokens(text)
                codes += [form_codes(spans[len(sizes)], found), none]
            else:
                codes += [np.zeros(len(strings), np.int64), none]
            sizes.append(len(strings))
        flat = np.array([0] * gap + ids, np.int64)
        code = np.concatenate([np.zeros(gap, np.int64), *codes]) if codes else np.zeros(gap, np.int64)
        total = np.zeros((len(flat), N), np.float32)
        n = len(flat)
        for i, offset in enumerate(OFFSETS):
            part = self.table[i].take(flat, axis=0)
            # The word at t + offset speaks about the token at t.
            if offset < 0:
                total[-offset:] += part[: n + offset]
            elif offset > 0:
                total[: n - offset] += part[offset:]
            else:
                total += part
        # Most tokens are in no form: they share one constant, the others get the difference.
        form = self.field.form
        total += form[:, 0].sum(axis=0)
        some = np.flatnonzero(code)
        for i, offset in enumerate((-1, 0, 1)):
            at = some - offset
            fit = (at >= 0) & (at < n)
            total[at[fit]] += form[i][code[some[fit]]] - form[i][0]
        out, at = [], gap
        for size in sizes:
            out.append(total[at : at + size])
            at += size + gap
        return out

    def may_hold(self, emissions: list[np.ndarray]) -> np.ndarray:
        """Which texts could have a labelled stretch in their best path: one whose first token and best continuation pay, with the steps at their best."""
        sizes = np.array([len(e) for e in emissions])
        full = np.flatnonzero(sizes)
        out = np.zeros(len(emissions), bool)
        if not len(full):
            return out
        flat = np.concatenate([emissions[i] for i in full]).T
        gain = flat[1:] - flat[0]
        text = np.repeat(np.arange(len(full)), sizes[full])
        # The best continuation is the highest sum that follows in the text; texts lie on steps too high to look across.
        total = np.cumsum(gain[1::2] + self.stay, axis=1, dtype=np.float64) - text * 1e6
        after = np.maximum.accumulate(total[:, ::-1], axis=1)[:, ::-1] - total
        pays = (gain[::2] + self.enter + after > 0).any(axis=0)
        out[full] = np.logical_or.reduceat(pays, np.cumsum(sizes[full]) - sizes[full])
        return out

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each text by Viterbi; texts of like length step together."""
        out: list[np.ndarray] = [np.zeros(len(e), np.int64) for e in emissions]
        live = np.flatnonzero(self.may_hold(emissions)).tolist()
        order = sorted(live, key=lambda i: len(emissions[i]))
        opens = np.r_[0, 1:N:2]  # outside and the beginnings may follow any label
        begins, insides = np.arange(1, N, 2), np.arange(2, N, 2)  # an inside label follows the two of its kind
        to_open = np.ascontiguousarray(self.step[:, opens])[:, :, None]
        from_begin, from_inside = self.step[begins, insides][:, None], self.step[insides, insides][:, None]
        groups: list[list[int]] = []
        for i in order:
            if not groups or len(groups[-1]) == 1024 or (len(groups[-1]) + 1) * len(emissions[i]) > 1024 * LONGEST:
                groups.append([])
            groups[-1].append(i)
        for group in groups:
            width, n = len(emissions[group[-1]]), len(group)
            lengths = np.array([len(emissions[i]) for i in group])
            rows = np.zeros((n, width, N), np.float32)
            for k, i in enumerate(group):
                rows[k, : lengths[k]] = emissions[i]
            padded = np.ascontiguousarray(rows.transpose(1, 2, 0))  # labels by texts, so that every step works on long rows
            values = np.empty((width, N, n), np.float32)
            values[0] = padded[0] + self.start[:, None]
            shortest = int(lengths[0])
            best, other = np.empty((len(opens), n), np.float32), np.empty((len(opens), n), np.float32)
            for t in range(1, width):
                value, new = values[t - 1], values[t]
                np.add(value[0], to_open[0], out=best)
                for i in range(1, N):
                    np.add(value[i], to_open[i], out=other)
                    np.maximum(best, other, out=best)
                new[opens] = best
                new[insides] = np.maximum(value[begins] + from_begin, value[insides] + from_inside)
                new += padded[t]
                if t >= shortest:
                    ended = t >= lengths
                    new[:, ended] = value[:, ended]
            # The label before is looked up only along the best path.
            state = values[-1].argmax(axis=0)
            paths = np.zeros((width, n), np.int64)
            for t in range(width - 1, -1, -1):
                paths[t] = state
                if t:
                    state = np.where(t < lengths, (values[t - 1] + self.step[:, state]).argmax(axis=0), state)
            for k, i in enumerate(group):
                out[i] = paths[: lengths[k], k]
        return out


def label_ids(spans: list[tuple[int, int]], items: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(spans), np.int64)
    for a, b, kind in items:
        first = True
        for i, (s, e) in enumerate(spans):
            if s >= a and e <= b:
                out[i] = LABELS.index(("B-" if first else "I-") + kind)
                first = False
    return out


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, seed: int = 5, field: Field | None = None) -> Field:
    """Maximum likelihood by AdaGrad on minibatches; the expectations come from forward-backward over a padded batch."""
    field = field or Field.empty()
    prepared, cache, hidden = [], {}, {}
    draw = np.random.default_rng(seed + 1)
    for text, items in rows:
        spans = tokens(text)
        if not spans or len(spans) > LONGEST:
            continue
        strings = word_strings(text)
        strings = ["0" * min(len(w), 12) if w.isdigit() and w.isascii() else w for w in strings]
        fresh = [w for w in dict.fromkeys(strings) if w not in cache]
        if fresh:
            everything = {w.rstrip(LOWER + UPPER).lower() for w in fresh}
            cache.update(zip(fresh, word_features(fresh, field.known), strict=True))
            hidden.update(zip(fresh, word_features(fresh, field.known, everything, hidden=True), strict=True))
        # A hidden word is an ordinary one, most of the time; an unknown one hardly ever is.
        chance = draw.random(len(strings))
        known = [_crc("w", w.rstrip(LOWER + UPPER).lower()) in field.known for w in strings]
        rows_of = np.stack([hidden[w] if c < (HIDDEN if k else 0.03) else cache[w] for w, k, c in zip(strings, known, chance, strict=True)])
        # Word u speaks with its slots of offset o about token u - o.
        about = np.arange(len(spans))[:, None] - _OFFSET_OF
        inside = (about >= 0) & (about < len(spans))
        ids, at = rows_of[inside], about[inside]
        prepared.append((ids.astype(np.int64), at, form_codes(spans, forms(text)), label_ids(spans, items)))
    rng = np.random.default_rng(seed)
    g_word, g_form, g_step, g_start = (np.full_like(x, 1e-2) for x in (field.word, field.form, field.step, field.start))
    prepared.sort(key=lambda p: len(p[3]))
    batches = [prepared[i : i + 64] for i in range(0, len(prepared), 64)]
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            batch = batches[k]
            width, size = max(len(p[3]) for p in batch), len(batch)
            row_of = np.concatenate([p[1] + width * i for i, p in enumerate(batch)])
            ids = np.concatenate([p[0] for p in batch])
            lengths = np.array([len(p[3]) for p in batch])
            code = np.zeros((size, width), np.int64)
            gold = np.zeros((size, width), np.int64)
            for i, p in enumerate(batch):
                code[i, : len(p[3])], gold[i, : len(p[3])] = p[2], p[3]
            mask = np.arange(width) < lengths[:, None]
            unique, inverse = np.unique(ids, return_inverse=True)
            weights = field.word[unique]
            order = np.argsort(row_of, kind="stable")
            sums = np.zeros((size * width, N), np.float32)
            present, first = np.unique(row_of[order], return_index=True)
            sums[present] = np.add.reduceat(weights[inverse[order]], first, axis=0)
            emit = sums.reshape(size, width, N)
            emit = emit + field.form[1][code]
            emit[:, 1:] += field.form[0][code[:, :-1]]
            emit[:, :-1] += field.form[2][code[:, 1:]]
            step, start = field.step + STEP_MASK, field.start + START_MASK
            alpha, beta = np.zeros((width, size, N)), np.zeros((width, size, N))
            alpha[0] = emit[:, 0] + start
            for t in range(1, width):
                new = _lse(alpha[t - 1][:, :, None] + step, 1) + emit[:, t]
                alpha[t] = np.where(mask[:, t, None], new, alpha[t - 1])
            for t in range(width - 2, -1, -1):
                new = _lse(step[None] + (emit[:, t + 1] + beta[t + 1])[:, None, :], 2)
                beta[t] = np.where(mask[:, t + 1, None], new, beta[t + 1])
            z = _lse(alpha[-1], 1)
            node = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2) * mask[:, :, None]
            grad = node
            rows_, cols_ = np.nonzero(mask)
            grad[rows_, cols_, gold[rows_, cols_]] -= 1.0
            grad = grad.astype(np.float32)
            d_step = np.zeros((N, N))
            for t in range(1, width):
                live = mask[:, t]
                if not live.any():
                    break
                pair = alpha[t - 1][live][:, :, None] + step + (emit[live, t] + beta[t][live])[:, None, :] - z[live][:, None, None]
                d_step += np.exp(pair).sum(axis=0)
                np.add.at(d_step, (gold[live, t - 1], gold[live, t]), -1.0)
            d_start = node[:, 0].sum(axis=0)
            flat = grad.reshape(-1, N)
            by_id = np.argsort(inverse, kind="stable")
            begins = np.r_[0, np.flatnonzero(np.diff(inverse[by_id])) + 1]
            d_word = np.add.reduceat(flat[row_of[by_id]], begins, axis=0) + DECAY * weights * len(ids)
            d_form = np.zeros_like(field.form)
            np.add.at(d_form[1], code[mask], grad[mask])
            np.add.at(d_form[0], code[:, :-1][mask[:, 1:]], grad[:, 1:][mask[:, 1:]])
            both = mask[:, :-1] & mask[:, 1:]
            np.add.at(d_form[2], code[:, 1:][both], grad[:, :-1][both])
            for value, total, d in ((field.form, g_form, d_form), (field.step, g_step, d_step), (field.start, g_start, d_start)):
                total += d * d
                value -= RATE * d / np.sqrt(total)
            g_word[unique] += d_word * d_word
            field.word[unique] -= RATE * d_word / np.sqrt(g_word[unique])
    return field


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


_TITLE = re.compile(r"^(?:mrs?|ms|miss|dr|rev|prof|sra?|srta|dra|dona|doña|don|pani|pan|hon)\b\.?\s+", re.I)


_WAY_END = re.compile(r"\b(?:st|ave?|rd|ln|dr|ct|blvd|pkwy|hwy|cir|sq|ter|apt|ste)$", re.I)
_END_IN_ADDRESS = re.compile(r"\n|\.(?=\s+[A-Z])")
_END_IN_NAME = re.compile(r"(?<=[^\W\d_]{3})[.!?]+\s+")


def _split(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A name ends with its sentence: what follows is a name of its own if it has two words."""
    cuts = [m.span() for m in _END_IN_NAME.finditer(text, a, b)]
    if not cuts:
        return [(a, b)]
    edges = [a, *(x for cut in cuts for x in cut), b]
    parts = list(zip(edges[::2], edges[1::2], strict=True))
    return [parts[0], *(p for p in parts[1:] if len(text[p[0] : p[1]].split()) > 1)]


def _trim(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span without punctuation, blanks and titles at its ends; None if nothing is left that could be an item."""
    if kind == "STREET_ADDRESS":
        for m in _END_IN_ADDRESS.finditer(text, a, b):
            if m[0][0] == "\n" or _ends_sentence(text, m.start() + 1):
                b = m.start() + 1
                break
    if kind != "PERSON":
        while a < b and text[a] in " ,;:.-":
            a += 1
        while b > a and (text[b - 1] in " ,;:-" or text[b - 1] == "." and (kind != "STREET_ADDRESS" or _ends_sentence(text, b))):
            b -= 1
        if kind == "STREET_ADDRESS" and text[b : b + 1] == "." and _WAY_END.search(text, max(0, b - 8), b) and not _ends_sentence(text, b + 1):
            b += 1
        return (a, b) if any((c.isalpha() if kind == "STREET_ADDRESS" else c.isalnum()) for c in text[a:b]) else None
    while a < b and not _letter(text[a]):
        a += 1
    m = _TITLE.match(text, a, b)
    if m and m.end() < b:
        a = m.end()
    while b > a and not _letter(text[b - 1]) and not (text[b - 1] == "." and b - a >= 2 and _letter(text[b - 2]) and (b - a == 2 or not _letter(text[b - 3]))):
        b -= 1
    if text[a:b].endswith(("'s", "’s", "'S")):
        b -= 2
    letters = sum(c.isalpha() for c in text[a:b])
    return (a, b) if letters >= 2 else None


def _letter(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "M"


def _ends_sentence(text: str, end: int) -> bool:
    """Whether the period before `end` closes its sentence: nothing follows on the line, or a new sentence opens."""
    rest = text[end : end + 60]
    line = rest.partition("\n")[0].strip()
    if not line:
        return True
    begin = text.rfind("\n", 0, end) + 1
    stop = text.find("\n", end)
    return end - begin in _ends(text[begin : stop if stop >= 0 else len(text)])


@lru_cache(maxsize=8)
def _ends(line: str) -> frozenset[int]:
    """Where the sentences of a line end; a long line with many addresses asks again and again."""
    from .sentences import sentences

    return frozenset(e for _, e in sentences(line))


def find_items(texts: list[str], decoder: Decoder) -> list[list[tuple[int, int, str]]]:
    """Items (start, end, type) of each text, in order and without overlaps."""
    whole, owner = [], []
    for k, text in enumerate(texts):
        strings = word_strings(text)
        if strings:
            whole.append((text, strings, forms(text))), owner.append(k)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    offsets: dict[int, list[tuple[int, int]]] = {}
    paths = decoder.decode(decoder.scores(whole, offsets))
    for number, (k, (text, _, _), path) in enumerate(zip(owner, whole, paths, strict=True)):
        hit = np.flatnonzero(path)
        if not len(hit):
            continue
        spans = offsets.get(number) or tokens(text)
        i, n = int(hit[0]), len(path)
        while i < n:
            label = int(path[i])
            if not label:
                i += 1
                continue
            kind = LABELS[label][2:]
            j = i + 1
            while j < n and LABELS[path[j]] == "I-" + kind:
                j += 1
            for a, b in _split(text, spans[i][0], spans[j - 1][1]) if kind == "PERSON" else ((spans[i][0], spans[j - 1][1]),):
                span = _trim(text, a, b, kind)
                if span and not (out[k] and out[k][-1][1] > span[0]):
                    out[k].append((*span, kind))
            i = j
    return out


def fit(labelled: list[tuple[str, list[str]]], seed_rows: int = SEED_ROWS) -> Field:
    """The field trained on the seed table and on hand-labelled rows, of which only the names of persons are known.

    The other items of those rows are filled in by a field trained on the seed table alone.
    """
    rows = labelled_table(seed_rows)
    field = train(rows)
    if not labelled:
        return field
    decoder = Decoder(field)
    extra = []
    for (text, names), items in zip(labelled, find_items([t for t, _ in labelled], decoder), strict=True):
        spans, at = [], 0
        for name in names:
            a = text.find(name, at)
            if a >= 0:
                spans.append((a, a + len(name), "PERSON"))
                at = a + len(name)
        spans += [i for i in items if i[2] != "PERSON" and not any(i[0] < b and i[1] > a for a, b, _ in spans)]
        extra.append((text, sorted(spans)))
    return train(rows[: seed_rows // 3] + extra * (1 if len(extra) > 600 else 2), epochs=3, field=field)


def labelled_rows(cases: DataFrame, *, text_column: str = "text", names_column: str = "names", id_column: str = "case_id", rows: int = FIT_ROWS) -> list[tuple[str, list[str]]]:
    """At most `rows` hand-labelled rows, picked by a hash of the id."""
    picked = narrow(cases, k=id_column, text=text_column, names=names_column).where(F.col("names").isNotNull() & F.col("text").isNotNull())
    return [(r["text"], [n for n in r["names"] if n]) for r in bounded_sample(picked, rows, "k")]


_decoders: dict[str, Decoder] = {}


def _decoder(token: str, shared: object) -> Decoder:
    """The decoder of a broadcast field; a worker that runs several tasks keeps what it has worked out about words."""
    if token not in _decoders:
        _decoders.clear()
        _decoders[token] = Decoder(*shared.value)
    return _decoders[token]


def ordinary_words(*texts: DataFrame) -> frozenset[str]:
    """Words that the texts (one column each) write in small letters at least LEAST_SEEN times and more often than capitalised.

    Counted over all texts with partial sums; MOST_ORDINARY bounds what reaches the driver and the tasks.  The field
    sees of these words only that they are in use: a name hardly ever is.
    """
    both = None
    for part in texts:
        one = part.select(F.explode(F.regexp_extract_all(part[0].cast("string"), F.lit(r"\p{L}[\p{L}\p{M}]+"), F.lit(0))).alias("w"))
        both = one if both is None else both.unionByName(one)
    both = both.groupBy("w").agg(F.count(F.lit(1)).alias("n"))  # small letters and capitals are told apart once for each word
    low = F.lower("w")
    # In a script without capitals every word would seem ordinary: only words that could be capitalised count.
    small, capital = ((F.col("w") == low) & (F.col("w") != F.upper("w"))).cast("long") * F.col("n"), ((F.substring("w", 1, 1) != F.substring(low, 1, 1)) & (F.col("w") != F.upper("w"))).cast("long") * F.col("n")
    counted = both.groupBy(low.alias("word")).agg(F.sum(small).alias("small"), F.sum(capital).alias("capital"))
    kept = counted.where((F.col("small") >= LEAST_SEEN) & (F.col("small") > F.col("capital"))).orderBy(F.desc("small"), "word").limit(MOST_ORDINARY)
    return frozenset(kept.select("word").toPandas()["word"])


def tag(table: DataFrame, field: Field, *, id_column: str, text_column: str, ordinary: frozenset[str] = frozenset()) -> DataFrame:
    """(row_key, start_pos, end_pos, pii_type) of every item of every text; null, empty and blank texts have none.

    Repeated rows each give their rows; null ids stay null; extra columns are ignored; an empty table gives an
    empty table.  One narrow pass over whole texts, without a shuffle.
    """
    source = narrow(table, row_key=id_column, text=text_column).select(F.col("row_key").cast("long").alias("row_key"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    # A model is a few megabytes: a broadcast variable sends it once to each executor.
    shared, token = table.sparkSession.sparkContext.broadcast((field, ordinary)), uuid.uuid4().hex

    def make():
        decoder = _decoder(token, shared)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, starts, ends, kinds = [], [], [], []
            texts = batch.column(1).to_pylist()
            for begin in range(0, len(texts), 1024):
                for k, items in enumerate(find_items(texts[begin : begin + 1024], decoder), begin):
                    for a, b, kind in items:
                        row.append(k), starts.append(a), ends.append(b), kinds.append(kind)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string())], names=SPANS.fieldNames())

        return step

    return by_batch(source, SPANS, make)


def redact(table: DataFrame, field: Field, *, text_column: str, output_column: str = "redacted_text", ordinary: frozenset[str] = frozenset()) -> DataFrame:
    """The table with one more column: the text with each item replaced by its type in brackets, all else unchanged; null stays null."""
    shared, token = table.sparkSession.sparkContext.broadcast((field, ordinary)), uuid.uuid4().hex

    @F.pandas_udf(T.StringType())
    def run(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        decoder = _decoder(token, shared)
        known = [t for t in texts if t is not None]
        parts = (known[begin : begin + 1024] for begin in range(0, len(known), 1024))
        done = iter([_replace(t, i) for part in parts for t, i in zip(part, find_items(part, decoder), strict=True)])
        return pd.Series([None if t is None else next(done) for t in texts], dtype=object)

    return table.withColumn(output_column, run(F.col(f"`{text_column}`").cast("string")))


def _replace(text: str, items: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, kind in items:
        out += [text[last:a], f"[{kind}]"]
        last = b
    return "".join(out) + text[last:]


_fields: dict[str, Field] = {}


def fitted(cases: DataFrame, **options: object) -> Field:
    """fit() on the table's labelled rows.

    The field lies in the shared folder under a digest of the rows and of the seed table: the same rows give the same
    field without another training, in this process or in another.
    """
    rows = labelled_rows(cases, **options)
    digest = hashlib.sha256(repr((rows, SEED_ROWS, EPOCHS, HIDDEN, BUCKETS, labelled_table(200), sorted(vocabulary()))).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    if digest in _fields:
        return _fields[digest]
    spark = cases.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/pii-field-{digest}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        field = Field.from_bytes(bytes(spark.read.parquet(path).first()["field"]))
    else:
        field = fit(rows)
        spark.createDataFrame([(bytearray(field.to_bytes()),)], "field binary").coalesce(1).write.mode("overwrite").parquet(path)
    _fields.clear()
    _fields[digest] = field
    return field


def _ordinary(benchmark: DataFrame, cases: DataFrame) -> frozenset[str]:
    return ordinary_words(narrow(benchmark, text="comment_text"), narrow(cases, text="text"))


def found(benchmark: DataFrame, cases: DataFrame) -> DataFrame:
    """(src_name, row_key, start_pos, end_pos, pii_type) over both tables; labelled cases are left out."""
    field, ordinary = fitted(cases), _ordinary(benchmark, cases)
    comments = tag(benchmark, field, id_column="row_id", text_column="comment_text", ordinary=ordinary).select(F.lit("comment").alias("src_name"), "row_key", "start_pos", "end_pos", "pii_type")
    texts = tag(cases.where(F.col("names").isNull()), field, id_column="case_id", text_column="text", ordinary=ordinary).select(F.lit("case").alias("src_name"), "row_key", "start_pos", "end_pos", "pii_type")
    return comments.unionByName(texts)


def redacted(benchmark: DataFrame, cases: DataFrame) -> DataFrame:
    """(src_name, row_key, redacted_text) of every row of both tables, labelled cases included; null texts stay null."""
    field, ordinary = fitted(cases), _ordinary(benchmark, cases)

    def of(table: DataFrame, name: str, id_column: str, text_column: str) -> DataFrame:
        source = narrow(table, row_key=id_column, text=text_column).select(F.lit(name).alias("src_name"), F.col("row_key").cast("long").alias("row_key"), "text")
        return redact(source, field, text_column="text", ordinary=ordinary).select("src_name", "row_key", "redacted_text")

    return of(benchmark, "comment", "row_id", "comment_text").unionByName(of(cases, "case", "case_id", "text"))
