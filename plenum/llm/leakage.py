"""Problem 7: passages of held-out evaluation items inside a training corpus.

Every batch of documents is a shard.  Its words (or characters, for Chinese) become
integers by the items' own vocabulary, a suffix array is built over the stretches that the
vocabulary covers, and every suffix of every item is looked up in it by binary search.
The matches carry their longest verbatim length and their locations.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import by_batch, narrow

#: Running words (characters of Chinese) that make a leak.
WORDS, CHARACTERS = 12, 20
#: Items are sent to the executors in blocks of at most this many characters; a larger table takes several passes.
BLOCK_CHARACTERS = 4_000_000
#: Units by which all open matches are measured at a time.
STRIDE = 32

MATCHES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_units", T.IntegerType()), T.StructField("doc_unit", T.LongType()), T.StructField("item_unit", T.IntegerType())])

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_WRAP = re.compile(r"(?<=\w)[-­‐][ \t]*\r?\n[ \t>]*(?=\w)")
_DROP = re.compile(r"[^\w\s]|_")
_HAN = re.compile(r"[㐀-鿿豈-﫿\U00020000-\U0003ffff]")


def plain(text: str) -> str:
    """The text without case, markup, punctuation and hyphenated line breaks; white space still separates words."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text).replace("\\n", " ").replace("\\t", " ")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\n" in text:
        text = _WRAP.sub("", text)
    return _DROP.sub("", text).casefold()


def words(text: str) -> list[str]:
    return plain(text).split()


def characters(text: str) -> list[str]:
    return list("".join(plain(text).split()))


def is_chinese(text: str) -> bool:
    """Whether Chinese characters prevail among the letters and digits."""
    units = plain(text).replace(" ", "")
    return bool(units) and len(_HAN.findall(units)) * 2 > len(units)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of tokens sorted by the `depth` tokens that follow, by prefix doubling; past the end counts as smallest."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    order, step = np.argsort(rank, kind="stable"), 1
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[True, key[order][1:] != key[order][:-1]])
        rank = new
        if rank.max() == n:
            break
        step *= 2
    return order


def _bounds(tokens: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query (a row of tokens) the range of the suffix array whose suffixes begin with it, by binary search of all at once."""
    width, out = queries.shape[1], []
    padded = np.r_[tokens, np.zeros(width, tokens.dtype)]
    for upper in (False, True):
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            seen = padded[order[mid][:, None] + np.arange(width)]
            wanted = queries[open_]
            differ = seen != wanted
            first = differ.argmax(axis=1)
            at = np.arange(len(open_))
            less = seen[at, first] < wanted[at, first]
            equal = ~differ[at, first]
            right = less | equal if upper else less
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        out.append(lo)
    return out[0], out[1]


@dataclass
class Index:
    """The items of one kind (words or characters): their vocabulary and all their suffixes."""

    least: int
    vocabulary: dict[str, int]
    stream: np.ndarray  # tokens of all items, 0 between them
    starts: np.ndarray  # of the suffixes that hold `least` tokens at least
    owner: np.ndarray  # item of each suffix
    unit: np.ndarray  # place of each suffix in its item

    @classmethod
    def build(cls, items: list[tuple[int, list[str]]], least: int) -> Index | None:
        vocabulary: dict[str, int] = {}
        stream, starts, owner, unit = [0], [], [], []
        for key, units in items:
            for k in range(len(units) - least + 1):
                starts.append(len(stream) + k), owner.append(key), unit.append(k)
            stream += [vocabulary.setdefault(u, len(vocabulary) + 1) for u in units] + [0]
        if not starts:
            return None
        return cls(least, vocabulary, np.array(stream, np.int32), np.array(starts), np.array(owner, np.int64), np.array(unit, np.int32))

    def search(self, documents: list[list[str]]) -> list[np.ndarray]:
        """Columns document, item, units, document unit, item unit: the longest match of each document and item."""
        look = self.vocabulary.get
        lengths = np.array([len(d) + 1 for d in documents], np.int64)
        tokens = np.fromiter((t for d in documents for t in (*(look(u, 0) for u in d), 0)), np.int32, int(lengths.sum()))
        # A match lies inside a stretch of known units; shorter stretches than a leak can't hold one.
        edge = np.flatnonzero(np.r_[True, tokens == 0, True])
        long = np.flatnonzero(np.diff(edge) > self.least)
        none = [np.zeros(0, np.int64)] * 5
        if not len(long):
            return none
        size = edge[long + 1] - edge[long]
        origin = np.repeat(edge[long] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        kept = tokens[np.minimum(origin, len(tokens) - 1)]
        order = suffix_array(kept, self.least)
        queries = self.stream[self.starts[:, None] + np.arange(self.least)]
        low, high = _bounds(kept, order, queries)
        n = high - low
        query = np.repeat(np.arange(len(n)), n)
        if not len(query):
            return none
        place = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(query))]
        document = np.searchsorted(np.cumsum(lengths), origin[place], side="right")
        # The same document and item match at every suffix of the passage: measure only where no earlier unit matches too.
        begin = self.starts[query]
        first = (place == 0) | (kept[place - 1] == 0) | (kept[place - 1] != self.stream[begin - 1])
        query, place, document, begin = query[first], place[first], document[first], begin[first]
        length = np.full(len(query), self.least, np.int64)
        live = np.arange(len(query))
        ahead = np.arange(STRIDE)
        while len(live):
            a, b = (place[live] + length[live])[:, None] + ahead, (begin[live] + length[live])[:, None] + ahead
            b = np.minimum(b, len(self.stream) - 1)  # the stream ends with 0, which matches nothing
            same = (a < len(kept)) & (kept[np.minimum(a, len(kept) - 1)] == self.stream[b]) & (self.stream[b] != 0)
            run = np.where(same.all(axis=1), STRIDE, same.argmin(axis=1))
            length[live] += run
            live = live[run == STRIDE]
        best = np.lexsort((place, -length, self.owner[query], document))
        one = best[np.r_[True, (np.diff(document[best]) != 0) | (np.diff(self.owner[query][best]) != 0)]]
        base = np.cumsum(lengths) - lengths
        return [document[one], self.owner[query][one], length[one], (origin[place] - base[document])[one], self.unit[query][one]]


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", least_words: int = WORDS, least_characters: int = CHARACTERS) -> DataFrame:
    """(doc_id, item_id, n_units, doc_unit, item_unit): the longest verbatim match of each document and item that is long enough.

    Units are words, or characters for items in Chinese.  Null, empty and too short texts and items match nothing;
    equal items each get their rows; a document id that occurs on several rows gives rows for each of them; extra
    columns are ignored; empty tables give an empty result.  The documents are read once for each block of items and
    never shuffled; only the items, in blocks of a bounded size, are sent to the executors.
    """
    source = narrow(documents, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") >= min(2 * least_words - 1, least_characters))
    wanted = narrow(items, item_id=item_id, item_text=item_text).where(F.col("item_text").isNotNull())
    total = wanted.agg(F.sum(F.length("item_text").cast("long")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // BLOCK_CHARACTERS))
    out = None
    for block in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == block)
        rows = [(int(r["item_id"]), r["item_text"]) for r in part.select(F.col("item_id").cast("long").alias("item_id"), "item_text").where(F.col("item_id").isNotNull()).collect()]
        found = _leaks_of_block(source, rows, least_words, least_characters)
        out = found if out is None else out.unionByName(found)
    return out


def _leaks_of_block(source: DataFrame, rows: list[tuple[int, str]], least_words: int, least_characters: int) -> DataFrame:
    chinese = {key: is_chinese(t) for key, t in rows}
    by_words = [(k, words(t)) for k, t in rows if not chinese[k]]
    by_characters = [(k, characters(t)) for k, t in rows if chinese[k]]

    # Built once and broadcast; its size is bounded by that of the block.
    shared = source.sparkSession.sparkContext.broadcast((Index.build(by_words, least_words), Index.build(by_characters, least_characters)))

    def make():
        kinds = list(zip(shared.value, (words, characters), (None, _HAN), strict=True))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = []
            for index, split, needs in kinds:
                if index is None:
                    continue
                chosen = [i for i, t in enumerate(texts) if needs is None or needs.search(t)]
                found = index.search([split(texts[i]) for i in chosen])
                if len(found[0]):
                    parts.append([np.array(chosen)[found[0]], *found[1:]])
            if not parts:
                return None
            rows_, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
            kinds_ = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows_], pa.int64()), *(pa.array(c.tolist(), k) for c, k in zip(rest, kinds_, strict=True))], schema=None, names=MATCHES.fieldNames())

        return step

    return by_batch(source, MATCHES, make)


def without_leaks(documents: DataFrame, matches: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """The documents, all columns, that no match names; rows with a null id stay, as nothing names them."""
    return documents.join(matches.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document and every item that it leaks."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()
