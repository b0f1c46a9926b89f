"""Problem 3: the language of each document and of each single-language stretch of a mixed one.

Every word gets a likelihood under each language from a character n-gram model.  For each
document, expectation-maximisation estimates the proportions of the languages; the set of
languages is the one whose penalised likelihood is highest; with that set fixed, the best
sequence of stretches follows from dynamic programming over the words.  The confidence of a
stretch is the share that the expectation step gives its language over its words, and text
that is unlikely under every language is reported as in none of them.

All steps work on the code points of a whole Arrow batch at once.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import by_batch, narrow

LANGUAGES = ("en", "es", "pl", "pt", "zh", "hi", "ar")
#: Labelled rows of each language that the model is fitted on at most.  Up to 1000 Spark limits the ranks before the shuffle.
FIT_ROWS = 1000
#: Hashed character trigrams and bigrams.
TRIGRAMS, BIGRAMS = 1 << 17, 1 << 14
#: One word can speak for or against a language by this many nats at most: a name or a slip must not decide.
WORD_LIMIT = 4.0
#: Weight of words that look like names (capitalised inside a text that has lower-case words).
NAME_WEIGHT = 0.35
#: Nats that a further language of a document costs, and each change of language.
LANGUAGE_COST, SWITCH_COST = 9.0, 4.0
EM_ROUNDS = 8
#: Code of text in none of the languages, and the mean log-likelihood of a character below which text of so many characters is that.
UNKNOWN, LEAST_LIKELY, LEAST_CHARACTERS = "und", -4.7, 20
#: Characters that a language must have been fitted on before text can be too unlikely for it.  Chinese is told by its script alone.
LEAST_FITTED = 20_000
CODES = (*LANGUAGES, UNKNOWN)
#: Documents with fewer words (characters of Chinese) get no language from `found`.
LEAST_WORDS = 8

SPANS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("n_languages", T.IntegerType()),
        T.StructField("seg_no", T.LongType()),
        T.StructField("start_pos", T.LongType()),
        T.StructField("end_pos", T.LongType()),
        T.StructField("lang_code", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# Names of the languages, lower-cased, as people write them in forms.
NAMES = {
    "en": "en eng english inglés ingles inglês angielski 英语 英文 अंग्रेज़ी अंग्रेजी الإنجليزية إنجليزي anglais",
    "es": "es esp spa spanish español espanol castellano espanhol hiszpański 西班牙语 西班牙文 स्पेनिश الإسبانية إسباني",
    "pl": "pl pol polish polski polaco polonês 波兰语 波兰文 पोलिश البولندية بولندي",
    "pt": "pt por portuguese português portugues portugués portugalski 葡萄牙语 葡萄牙文 पुर्तगाली البرتغالية برتغالي",
    "zh": "zh chi zho cmn chinese mandarin 中文 汉语 漢語 普通话 普通話 国语 國語 chino mandarín mandarin chinese chinês mandarim chiński चीनी الصينية صيني",
    "hi": "hi hin hindi हिन्दी हिंदी 印地语 印地文 hindi الهندية هندي",
    "ar": "ar ara arabic العربية عربي عربى árabe arabe arabski 阿拉伯语 阿拉伯文 अरबी",
}

# Frequent words that start the model off where labels are few or wrong.
SEEDS = {
    "en": "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know please thank you because our should school bus students",
    "es": "el la de que y en un una los las del al se por con no para es su lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus gracias escuela niños aunque según después",
    "pl": "i w nie na się z do że to jest o jak za po co ale od już czy tak tylko dla jego przez jej ma być ich może który było tego są aby był ze mnie kiedy gdy bardzo dlatego ponieważ przed przy nas wam nam tym temu tej te ten która które czemu żeby choć zanim nikt wszyscy szkole szkoła dzieci rodzice proszę prosimy dziękuję mam mój moja nasz wciąż oraz albo jeszcze gdzie kto tam teraz lub pod nad bez",
    "pt": "o a de que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja qual será nós tenho lhe deles essas esses pelas este fosse dele obrigado escola crianças porque embora enquanto ninguém perdemos",
    "zh": "的 一 是 不 了 在 人 有 我 他 这 个 们 中 来 上 大 为 和 国 地 到 以 说 时 要 就 出 会 可 也 你 对 生 能 而 子 那 得 于 着 下 自 之 年 过 学校 孩子 老师 我们 没有 所以 因为 请 谢谢",
    "hi": "के का की है में से और को पर यह हैं नहीं ने एक भी कि हो था वह इस कर लिए तो ही या थे जो अब मैं हम कृपया बच्चे स्कूल धन्यवाद",
    "ar": "في من على أن إلى التي عن ما هذا مع كان قد لا بعد كل هذه الذي ذلك لم بين هو هي أو حتى قبل عند غير ثم نحن المدرسة الأطفال شكرا أرجو نرجو",
}


def code_of(label: Column) -> Column:
    """Language code that a label names (code, name in some language, any case); null if it names none."""
    plain = F.lower(F.trim(F.regexp_replace(label.cast("string"), r"[._,;:!?()\[\]\"']", " ")))
    names = {n: c for c, listed in NAMES.items() for n in listed.split()} | {"mandarin chinese": "zh", "chinese mandarin": "zh"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[plain], table[F.regexp_extract(plain, r"^([^\W\d]{2,3})[-_ ][a-z0-9]{2,8}$", 1)])


def _char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point below 65536: kind (0 other, 1 letter or mark, 2 Chinese, 3 digit), lower case, whether upper case."""
    kind, lower, upper = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        ch = chr(c)
        category = unicodedata.category(ch)
        if category[0] in "LM":
            kind[c] = 2 if 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF else 1
        elif category == "Nd":
            kind[c] = 3
        if category == "Lu":
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
            upper[c] = True
    kind[ord("@")] = kind[ord("_")] = 3  # what holds them is no word of a language
    return kind, lower, upper


_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


@dataclass
class Words:
    """The words of a batch of texts: code points, and for each word its place, its text and whether it counts."""

    codes: np.ndarray  # lower-cased code points of all texts
    start: np.ndarray  # of each word
    end: np.ndarray
    text: np.ndarray  # index of the text
    base: np.ndarray  # start of each text
    weight: np.ndarray  # 0 for numbers and codes, less than 1 for likely names
    chinese: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        global _tables
        if _tables is None:
            _tables = _char_tables()
        kind_of, lower_of, upper_of = _tables
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.minimum(raw, 0xFFFF).astype(np.int64)
        kind = kind_of[small]
        kind[raw > 0xFFFF] = 2 * ((raw[raw > 0xFFFF] >= 0x20000) & (raw[raw > 0xFFFF] < 0x40000))
        codes = np.where(raw <= 0xFFFF, lower_of[small], raw)
        inside = kind > 0
        change = (kind == 2) | np.r_[True, (inside[1:] != inside[:-1]) | (kind[:-1] == 2)]
        start = np.flatnonzero(change & inside)
        if len(start):
            stop = np.r_[np.flatnonzero(change & (np.arange(len(kind)) > 0)), len(kind)]
            end = stop[np.searchsorted(stop, start, side="right")]
        else:
            end = start
        base = np.r_[0, np.cumsum(lengths)[:-1]]
        text = np.searchsorted(base, start, side="right") - 1
        digits = np.r_[0, np.cumsum(kind == 3)]
        no_word = digits[end] > digits[start]
        up = upper_of[small] & (raw <= 0xFFFF)
        ups = np.r_[0, np.cumsum(up)]
        shouted = (ups[end] - ups[start]) == (end - start)
        # A capitalised word counts less unless it opens its text or follows a full stop.
        previous = np.zeros(len(start), bool)
        if len(start):
            gap_from = np.r_[0, end[:-1]]
            stops = np.r_[0, np.cumsum(np.isin(raw, np.array([ord(c) for c in ".!?…\n¿¡"], np.uint32)))]
            previous = stops[start] > stops[gap_from]
            previous |= np.r_[True, text[1:] != text[:-1]]
        name = up[start] & ~previous & ~(shouted & ((end - start) > 1)) if len(start) else previous
        weight = np.where(no_word, 0.0, np.where(name, NAME_WEIGHT, 1.0)).astype(np.float32)
        return cls(codes, start, end, text, base, weight, kind[start] == 2)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed trigram and bigram of every character of every counting word, with the word it belongs to; words are framed by blanks."""
        n = (self.end - self.start) + 1
        word = np.repeat(np.arange(len(n)), n)
        at = np.repeat(self.start - (np.cumsum(n) - n), n) + np.arange(len(word))
        last = at == self.end[word]
        c = np.where(last, 32, self.codes[np.minimum(at, len(self.codes) - 1)]).astype(np.uint64)
        b = np.where(at - 1 < self.start[word], 32, self.codes[np.maximum(at - 1, 0)]).astype(np.uint64)
        a = np.where(at - 2 < self.start[word], 32, self.codes[np.maximum(at - 2, 0)]).astype(np.uint64)
        two = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two + c * np.uint64(0x165667B19E3779F9)
        mix = lambda x, size: ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(24)) % np.uint64(size)
        return mix(three, TRIGRAMS).astype(np.int32), mix(two, BIGRAMS).astype(np.int32), word


class Model:
    """Character trigram likelihoods of each language, smoothed towards an even guess."""

    def __init__(self, tri: np.ndarray, bi: np.ndarray) -> None:
        self.judges = np.zeros(len(LANGUAGES), bool)
        self.tri, self.bi = np.log(tri + 0.02).astype(np.float32), np.log(bi + 0.02 * 60).astype(np.float32)

    def words(self, words: Words) -> np.ndarray:
        """Log-likelihood of each word under each language, relative to the best one, limited and weighted."""
        return self.likelihoods(words)[0]

    def likelihoods(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words(), the log-likelihoods as they are, and the number of characters of each word (blank included)."""
        if not len(words.start):
            none = np.zeros((0, len(LANGUAGES)), np.float32)
            return none, none, np.zeros(0)
        three, two, word = words.grams()
        each = self.tri[three] - self.bi[two]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        total = np.add.reduceat(each, first, axis=0)
        relative = total - total.max(axis=1, keepdims=True)
        return np.maximum(relative, -WORD_LIMIT) * words.weight[:, None], total, np.diff(np.r_[first, len(word)])

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]], rounds: int = 3) -> Model:
        """Starts from the frequent words, then takes in the texts: each counts for the language the model gives its words, if that is clear.

        The labels only break ties of the first round, so wrong ones do no harm.
        """
        seeds = [(" ".join([SEEDS[c]] * 3), i) for i, c in enumerate(LANGUAGES)]
        texts = [t for t, _ in labelled]
        given = np.array([LANGUAGES.index(c) for _, c in labelled], np.int64) if labelled else np.zeros(0, np.int64)
        seed_words = Words.of([t for t, _ in seeds])
        counts = cls._count(seed_words, np.array([k for _, k in seeds])[seed_words.text])
        model, all_words = cls(*counts), Words.of(texts) if texts else None
        for k in range(rounds if texts else 0):
            scores = model.words(all_words)
            document = np.zeros((len(texts), len(LANGUAGES)))
            np.add.at(document, all_words.text, scores)
            if k == 0:
                document[np.arange(len(texts)), given] += 4.0
            best = document.argmax(axis=1)
            size = np.maximum(1.0, np.bincount(all_words.text, all_words.weight, len(texts)))
            # A text in one language fits it in nearly every word.
            clear = document[np.arange(len(texts)), best] / size > (-1.6 if k == 0 else -0.45)
            chosen = clear[all_words.text] & (all_words.weight > 0)
            picked = Words(all_words.codes, all_words.start[chosen], all_words.end[chosen], all_words.text[chosen], all_words.base, all_words.weight[chosen], all_words.chinese[chosen])
            tri, bi = cls._count(picked, best[picked.text])
            model = cls(tri + counts[0], bi + counts[1])
            fitted = np.bincount(best[picked.text], picked.end - picked.start + 1, len(LANGUAGES))
            model.judges = (fitted >= LEAST_FITTED) & (np.array(LANGUAGES) != "zh")
        return model

    @staticmethod
    def _count(words: Words, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(LANGUAGES)
        three, two, word = words.grams()
        tri = np.bincount(three.astype(np.int64) * k + language[word], minlength=TRIGRAMS * k).reshape(-1, k)
        bi = np.bincount(two.astype(np.int64) * k + language[word], minlength=BIGRAMS * k).reshape(-1, k)
        # Languages with more text must not seem likelier: bring all to the same size.
        scale = tri.sum(axis=0) / max(1, tri.sum(axis=0).max()) if tri.sum() else np.ones(k)
        scale = np.maximum(scale, 1e-3)
        return tri / scale, bi / scale


def proportions(scores: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of each document's language proportions, all documents of a batch at once; and of each word the posterior at the end."""
    k = scores.shape[1]
    like = np.exp(scores)
    share = np.full((len(first), k), 1.0 / k, np.float32)
    text = np.repeat(np.arange(len(first)), sizes)
    for _ in range(EM_ROUNDS):
        post = like * share[text]
        post /= post.sum(axis=1, keepdims=True)
        share = np.add.reduceat(post, first, axis=0) / sizes[:, None]
        share = np.maximum(share, 1e-4)
    return share, post


def _stretches(scores: np.ndarray, languages: tuple[int, ...]) -> tuple[float, list[int]]:
    """Best sequence of the given languages over the words, each change at SWITCH_COST; its score and the language of each word."""
    s = scores[:, languages]
    n, k = s.shape
    best = s[0].copy()
    back = np.zeros((n, k), np.int8)
    for i in range(1, n):
        top = int(best.argmax())
        change = best[top] - SWITCH_COST
        back[i] = np.where(best >= change, np.arange(k), top)
        best = np.maximum(best, change) + s[i]
    state = int(best.argmax())
    total, path = float(best[state]), [0] * n
    for i in range(n - 1, -1, -1):
        path[i] = languages[state]
        state = int(back[i][state])
    return total, path


#: Of every set of languages, as bits: its members and their number.
_HAS = (np.arange(1 << len(LANGUAGES))[:, None] >> np.arange(len(LANGUAGES)) & 1).astype(bool)
_SIZE = _HAS.sum(axis=1)


def _bounds(scores: np.ndarray) -> np.ndarray:
    """What each set of languages can reach at most: every word in its best language of the set, each further language entered once."""
    k = scores.shape[1]
    total = np.zeros(1 << k)
    for begin in range(0, len(scores), 4096):
        part = scores[begin : begin + 4096].T.astype(np.float64)
        best = np.full((1 << k, part.shape[1]), -np.inf)
        for i in range(k):
            best[1 << i : 2 << i] = np.maximum(best[: 1 << i], part[i])
        total += best.sum(axis=1)
    return total - (LANGUAGE_COST + SWITCH_COST) * np.maximum(_SIZE - 1, 0)


def _best_set(scores: np.ndarray, languages: list[int]) -> tuple[int, ...]:
    """The set of all sets of these languages whose best sequence has the highest penalised likelihood: one pass over (set, language) states."""
    k = len(languages)
    has = _HAS[: 1 << k, :k]
    without = np.arange(1 << k)[:, None] & ~(1 << np.arange(k))
    closed = np.where(has, 0.0, -np.inf)
    s = scores[:, languages].astype(np.float64)
    value = np.full((1 << k, k), -np.inf)
    value[1 << np.arange(k), np.arange(k)] = s[0]
    for row in s[1:]:
        top = value.max(axis=1)
        value = np.maximum(np.maximum(value, top[:, None] - SWITCH_COST), top[without] - (SWITCH_COST + LANGUAGE_COST))
        value += closed
        value += row
    final = value.max(axis=1)
    # Of equal sets the smallest wins.
    chosen = min(np.flatnonzero(final >= final.max() - 1e-6), key=lambda m: (_SIZE[m], -final[m]))
    return tuple(languages[i] for i in range(k) if chosen >> i & 1)


def choose(scores: np.ndarray, share: np.ndarray, single: np.ndarray) -> list[int]:
    """Language of each word of one document: the penalised likelihood picks one language or any set of them.

    Sets are tried from the highest bound on; if the bounds leave more than a few, one pass over all that are left decides.
    """
    first = int(single.argmax())
    best, path = float(single[first]), [first] * len(scores)
    bound = _bounds(scores)
    bound[_SIZE < 2] = -np.inf
    rank = np.argsort(-share)

    def attempt(languages: tuple[int, ...]) -> None:
        nonlocal best, path
        total, found = _stretches(scores, tuple(int(i) for i in rank if i in languages))
        value = total - LANGUAGE_COST * (len(set(found)) - 1)
        if value > best + 1e-6:
            best, path = value, found

    order = np.argsort(-bound, kind="stable")
    for mask in order[:3]:
        if bound[mask] <= best + 1e-6:
            return path
        attempt(tuple(np.flatnonzero(_HAS[mask])))
    left = order[3:][bound[order[3:]] > best + 1e-6]
    if len(left) > 3:
        attempt(_best_set(scores, [int(i) for i in np.flatnonzero(_HAS[left].any(axis=0))]))
    else:
        for mask in left:
            attempt(tuple(np.flatnonzero(_HAS[mask])))
    return path


_ADDRESS = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*\s?(?:@|[\[(]\s?at\s?[\])])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z0-9-]+)+|(?:https?://|www\.)\S+", re.I)


def without_addresses(text: str) -> str:
    """E-mail addresses, also written out, and links become digits of the same length: they are in no language."""
    if "@" in text or "(" in text or "[" in text or "://" in text or "www." in text:
        return _ADDRESS.sub(lambda m: "0" * len(m[0]), text)
    return text


def analyse(texts: list[str], model: Model) -> list[tuple[int, list[tuple[int, int, int, float]]]]:
    """For each text the number of words and its stretches (start, end, language index, confidence)."""
    words = Words.of([without_addresses(t) for t in texts])
    out: list[tuple[int, list[tuple[int, int, int, float]]]] = [(0, [])] * len(texts)
    if not len(words.start):
        return out
    scores, likelihood, characters = model.likelihoods(words)
    live = np.unique(words.text)
    first = np.searchsorted(words.text, live)
    sizes = np.diff(np.r_[first, len(words.text)])
    single = np.add.reduceat(scores, first, axis=0)
    weight = np.add.reduceat(words.weight, first)
    share, post = proportions(scores, first, sizes)
    top = share.argmax(axis=1)
    gap = single.max(axis=1)
    counts = (words.weight > 0.5)[:, None]
    plain, length = likelihood * counts, characters * counts[:, 0]
    whole, whole_length = np.add.reduceat(plain, first, axis=0), np.add.reduceat(length, first)

    def code(language: int, total: float, n: float) -> int:
        unlikely = n >= LEAST_CHARACTERS and total < LEAST_LIKELY * n
        return len(LANGUAGES) if unlikely and model.judges[language] else language

    for d, text in enumerate(live):
        a, b = first[d], first[d] + sizes[d]
        base = words.base[text]
        n = int(sizes[d])
        if not weight[d]:
            out[text] = (n, [])
            continue
        # The best language misses nothing worth a second one: no other set can win.
        path = None
        if gap[d] <= -(LANGUAGE_COST + SWITCH_COST):
            path = choose(scores[a:b], share[d], single[d])
        if path is None or len(set(path)) == 1:
            language = int(top[d]) if path is None else path[0]
            out[text] = (n, [(int(words.start[a] - base), int(words.end[b - 1] - base), code(language, float(whole[d, language]), float(whole_length[d])), float(share[d, language]))])
            continue
        cuts = [0, *[i for i in range(1, n) if path[i] != path[i - 1]], n]
        spans = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            part, language = slice(a + i, a + j), path[i]
            # Numbers and codes say nothing; a stretch without words of full weight has the share of its document.
            sure = float(np.average(post[part, language], weights=words.weight[part])) if words.weight[part].any() else float(share[d, language])
            spans.append((int(words.start[a + i] - base), int(words.end[a + j - 1] - base), code(language, float(plain[part, language].sum()), float(length[part].sum())), sure))
        out[text] = (n, spans)
    return out


def fit_sample(table: DataFrame, *, id_column: str, text_column: str, label_column: str, rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """At most `rows` labelled texts of each language, picked by a hash of the id; a partial limit runs before the shuffle."""
    picked = narrow(table, row_id=id_column, text=text_column, label=label_column).where(F.length("text") >= 40).withColumn("code", code_of(F.col("label"))).where(F.col("code").isNotNull())
    order = Window.partitionBy("code").orderBy(F.xxhash64("row_id"), "row_id")
    return [(r["text"], r["code"]) for r in picked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).select("text", "code").collect()]


def identify(table: DataFrame, *, id_column: str = "row_id", text_column: str = "comment_text", label_column: str = "language", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each stretch: (row_id, label, n_words, n_languages, seg_no, start_pos, end_pos, lang_code, confidence).

    `label` is the code that the given label names, null if none.  lang_code is `und` for text in none of the languages.  A document in one language has one row with
    seg_no 0; a mixed one has seg_no 1, 2, ... in text order.  Null, blank and wordless texts give no row; repeated
    rows each give their rows; null ids stay null; extra columns are ignored; an empty table gives an empty table.
    The model is fitted on a bounded labelled sample (fit_rows a language); every document is then identified
    whole in one pass without a shuffle.
    """
    model = Model.fit(fit_sample(table, id_column=id_column, text_column=text_column, label_column=label_column, rows=fit_rows))
    source = narrow(table, row_id=id_column, text=text_column, label=label_column).where(F.col("text").isNotNull())
    source = source.select(F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"), code_of(F.col("label")).alias("label"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(8)]
            texts = batch.column(1).to_pylist()
            row = []
            for start in range(0, len(texts), 2000):
                for k, (n, spans) in enumerate(analyse(texts[start : start + 2000], model), start):
                    used = len({s[2] for s in spans})
                    for no, (a, b, language, sure) in enumerate(spans, 1):
                        row.append(k)
                        for column, value in zip(columns, (n, used, no if len(spans) > 1 else 0, a, b, CODES[language], float(sure)), strict=False):
                            column.append(value)
            at = pa.array(row, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], names=SPANS.fieldNames())

        return step

    return by_batch(source, SPANS, make)


def found(benchmark: DataFrame) -> DataFrame:
    """(row_id, seg_no, lang_code): comments in one language whose label is absent or wrong, and the stretches of mixed ones."""
    spans = identify(benchmark).where(F.col("n_words") >= LEAST_WORDS)
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang_code"))
    return spans.where((F.col("seg_no") > 0) | wrong).select("row_id", "seg_no", "lang_code")
