"""Problem 1: records that share at least a given part of their words, by a universe-partition pigeonhole.

Two sets with Jaccard similarity J or more differ in at most H = (|r|+|s|)(1-J)/(1+J) words.  Sets are handled in
size bands; for a band, words are hashed into m segments.  With m = H + 1 + SPARE, SPARE + 1 segments of a similar
pair agree exactly, so it is found under one segment that is not frequent, or else under a pair of frequent ones
(segment subsets).  In bands of small sets a cost estimate may choose fewer, wider segments instead: with
2m > H, one segment of a similar pair differs in at most one word, and it is found under the segment or one of its
one-deletion neighbours.  Which segments are frequent and which allocation is cheaper is counted over all documents.

No key is ever compared beyond HOT sets: whoever joins the entries of a key sees its true count, and the sets of a
larger one go on to a further round.  There the same key is extended by each of H + 1 segments of another, independent
partition, of which a similar pair still shares one.  What is still larger after ROUNDS such extensions is split into
blocks, and the pairs of blocks are spread over the tasks.  So each index entry costs at most HOT comparisons however
large the collection is, but for sets that agree nearly everywhere, whose pairs are the result itself.

Candidates are pruned by a bit signature (which never drops a similar pair) and verified on the word sets.  Words are
64-bit hashes there, and rows with equal sets of them count as copies; two different words of a collection of a billion
distinct ones share a hash with probability 3 in 100.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import CorpusError, cut, narrow

SIMILARITY, LEAST_WORDS = 0.8, 8
#: Further segments that must agree beyond one; and how often a segment occurs before it is only used in pairs.
SPARE, FREQUENT = 1, 128
#: Sets that are compared under one key at most; how often a larger key is extended before it is split into blocks; sets in a block.
HOT, ROUNDS, BLOCK = 2048, 3, 1024
#: A key must occur this often in one batch to be counted; keys called frequent at most.  Both steer cost, not results: HOT holds for the others.
LOCAL_COUNT, MAX_FREQUENT = 3, 500_000
#: Bands up to this size may use one-deletion neighbourhoods.
DELETION_SIZE = 33
#: Index entries that one task joins at a time, about; pairs that are compared at once.
BUCKET_ENTRIES, PAIR_CHUNK = 1_000_000, 2_000_000
#: Bits of the filter that keeps word sets without a candidate from being shuffled.
FILTER_BITS = 1 << 25

_HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_MARKS = "̀-ًͯ-ْٰऀ-ःऺ-ॏ॑-ॗॢॣ"
_ASCII = re.compile(r"[a-z0-9]+")
_WORD = re.compile(rf"[{_HAN}]+|[^\W_{_HAN}]+(?:[{_MARKS}]+[^\W_{_HAN}]*)*|[{_MARKS}]+(?:[^\W_{_HAN}]+[{_MARKS}]*)*")
_IS_HAN = re.compile(f"[{_HAN}]")


def word_set(text: str, least: int = LEAST_WORDS) -> set[str] | None:
    """The distinct words of a text, runs of Chinese as neighbouring pairs; None if it has fewer than `least` words (characters)."""
    low = text.lower()
    if low.isascii():
        words = _ASCII.findall(low)
        return set(words) if len(words) >= least else None
    out: set[str] = set()
    n = 0
    for word in _WORD.findall(low):
        if _IS_HAN.match(word):
            n += len(word)
            out.update((word[k : k + 2] for k in range(len(word) - 1)) if len(word) > 1 else (word,))
        else:
            n += 1
            out.add(word)
    return out if n >= least else None


class Hasher:
    """64-bit hashes of words, remembered."""

    MEMORY = 500_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _new(self, word: str) -> int:
        if len(self.known) > self.MEMORY:
            self.known.clear()
        value = self.known[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value

    def of(self, words: set[str]) -> list[int]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            return [known[w] if w in known else self._new(w) for w in words]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Sets:
    """The distinct word sets of some texts: flat hashes, sizes, and for each its own 64-bit identity."""

    def __init__(self, texts: list[str], hasher: Hasher, least: int) -> None:
        flat: list[int] = []
        sizes, rows = [], []
        for k, text in enumerate(texts):
            words = word_set(text, least)
            if words:
                flat += hasher.of(words)
                sizes.append(len(words)), rows.append(k)
        self.rows = np.array(rows, np.int64)
        self.size = np.array(sizes, np.int64)
        self.flat = np.array(flat, np.uint64)
        self.first = np.cumsum(self.size) - self.size
        with np.errstate(over="ignore"):
            self.identity = _mix(np.add.reduceat(_mix(self.flat), self.first) + self.size.astype(np.uint64)) if len(rows) else np.zeros(0, np.uint64)

    @classmethod
    def of_words(cls, identity: np.ndarray, flat: np.ndarray, size: np.ndarray) -> Sets:
        """Sets whose words are known as hashes."""
        out = object.__new__(cls)
        out.rows, out.identity, out.flat, out.size = np.arange(len(size)), identity, flat, size
        out.first = np.cumsum(size) - size
        return out

    def distinct(self) -> Sets:
        """One of each identity."""
        _, keep = np.unique(self.identity, return_index=True)
        keep.sort()
        out = object.__new__(Sets)
        out.rows, out.size, out.identity = self.rows[keep], self.size[keep], self.identity[keep]
        at = np.repeat(self.first[keep] - (np.cumsum(out.size) - out.size), out.size) + np.arange(out.size.sum())
        out.flat = self.flat[at]
        out.first = np.cumsum(out.size) - out.size
        return out


class Plan:
    """Size bands and, for each, the allocation: segments that must agree, or one-deletion neighbourhoods."""

    def __init__(self, similarity: float, largest: int = 1 << 40) -> None:
        self.similarity = similarity
        self.rate = (1 - similarity) / (1 + similarity)
        tops = [1]
        while tops[-1] < largest and len(tops) < 400:
            tops.append(max(tops[-1] + 1, int(tops[-1] / similarity + 1e-9)))
        self.top = np.array(tops, np.int64)
        self.deletion: frozenset[int] = frozenset()

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.top, size)

    def errors(self, band: int) -> int:
        """Most words in which a pair can differ whose smaller set lies in the band."""
        top = float(self.top[band])
        return int((top + top / self.similarity) * self.rate + 1e-9)

    def segments(self, band: int, deletion: bool) -> int:
        h = self.errors(band)
        return h // 2 + 1 if deletion else h + 1 + SPARE


def segment_keys(sets: Sets, chosen: np.ndarray, band: int, m: int, deletion: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the segments of the chosen sets (chosen x m), and for deletion also the keys without each one word, with their sets."""
    size = sets.size[chosen]
    at = np.repeat(sets.first[chosen] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    words = _mix(sets.flat[at])
    owner = np.repeat(np.arange(len(chosen)), size)
    with np.errstate(over="ignore"):
        salt = _mix(np.array([band * 2 + deletion + 17], np.uint64))[0]
        segment = (_mix(words + salt) % np.uint64(m)).astype(np.int64)
        cell = owner * m + segment
        total = np.zeros(len(chosen) * m, np.uint64)
        np.add.at(total, cell, words)
        place = _mix(np.arange(m, dtype=np.uint64) + salt)
        full = _mix(total + np.tile(place, len(chosen)))
        if not deletion:
            return full.reshape(-1, m), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        less = _mix(total[cell] - words + place[segment])
    return full.reshape(-1, m), less, owner


def signature(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """The parity of the words in 55 and in 16 further cells; the first number also has the size up to 255 and a free bit for the kind of an entry.

    Each word in which two sets differ changes one parity, so the parities never differ in more places than the sets.
    """
    cell = _mix(sets.flat + np.uint64(99)) % np.uint64(71)
    main = np.where(cell < 55, np.uint64(1) << (np.minimum(cell, np.uint64(54)) + np.uint64(9)), np.uint64(0))
    rest = np.where(cell >= 55, np.uint64(1) << (np.maximum(cell, np.uint64(55)) - np.uint64(55)), np.uint64(0))
    if not len(sets.size):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    bits = np.bitwise_xor.reduceat(main, sets.first)
    return bits | np.minimum(sets.size, 255).astype(np.uint64), np.bitwise_xor.reduceat(rest, sets.first).astype(np.uint16)


ENTRY = np.dtype([("key", "<u4"), ("set", "<u8"), ("meta", "<u8"), ("more", "<u2")])


def index_entries(sets: Sets, plan: Plan, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full 64-bit keys and the entries of all index entries of the sets."""
    keys, owners, kinds = [], [], []
    own = plan.band(sets.size)
    for band in np.unique(np.r_[own, own - 1]) if len(own) else ():
        # A set meets its partners in the band of the smaller of the two: its own or the one below.
        if band < 0:
            continue
        chosen = np.flatnonzero((own == band) | (own == band + 1))
        deletion = int(band) in plan.deletion
        m = plan.segments(int(band), deletion)
        full, less, of = segment_keys(sets, chosen, int(band), m, deletion)
        if deletion:
            keys += [full.ravel(), less]
            owners += [np.repeat(chosen, m), chosen[of]]
            kinds += [np.zeros(full.size, np.uint64), np.ones(len(less), np.uint64)]
            continue
        many = _member(full.ravel(), frequent).reshape(full.shape)
        row, column = np.nonzero(~many)
        keys.append(full[row, column]), owners.append(chosen[row]), kinds.append(np.zeros(len(row), np.uint64))
        count = many.sum(axis=1)
        for q in np.unique(count[count >= 2]):
            some = np.flatnonzero(count == q)
            columns = np.nonzero(many[some])[1].reshape(len(some), q)
            picked = np.take_along_axis(full[some], columns, 1)
            a, b = np.triu_indices(int(q), 1)
            with np.errstate(over="ignore"):
                both = _mix(picked[:, a] * np.uint64(3) + picked[:, b])
            keys.append(both.ravel()), owners.append(np.repeat(chosen[some], len(a))), kinds.append(np.zeros(both.size, np.uint64))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, ENTRY)
    owner, key = np.concatenate(owners), np.concatenate(keys)
    main, rest = signature(sets)
    out = np.empty(len(key), ENTRY)
    out["key"], out["set"], out["more"] = (key >> np.uint64(32)).astype(np.uint32), sets.identity[owner], rest[owner]
    out["meta"] = main[owner] | (np.concatenate(kinds) << np.uint64(8))
    return key, out


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def extended_entries(sets: Sets, keys: np.ndarray, plan: Plan, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of sets that share a key with too many others (one key for each set): the key with each segment of the partition of this round.

    The partition has one segment more than a similar pair differs in, so the pair shares one of the extended keys.
    """
    own = plan.band(sets.size)
    found_keys, owners = [], []
    for band in np.unique(np.r_[own, own - 1]) if len(own) else ():
        if band < 0:
            continue
        chosen = np.flatnonzero((own == band) | (own == band + 1))
        m = plan.errors(int(band)) + 1
        size = sets.size[chosen]
        at = np.repeat(sets.first[chosen] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        words = _mix(sets.flat[at])
        owner = np.repeat(np.arange(len(chosen)), size)
        with np.errstate(over="ignore"):
            salt = _mix(np.array([int(band) * 64 + number + 1_000_003], np.uint64))[0]
            total = np.zeros(len(chosen) * m, np.uint64)
            np.add.at(total, owner * m + (_mix(words ^ salt) % np.uint64(m)).astype(np.int64), words)
            full = _mix(total + np.tile(_mix(np.arange(m, dtype=np.uint64) + salt), len(chosen)))
            found_keys.append(_mix(full * np.uint64(5) + np.repeat(keys[chosen], m)))
        owners.append(np.repeat(chosen, m))
    return _entries(sets, found_keys, owners)


def block_entries(sets: Sets, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of sets that share a key with too many others: one for each pair of blocks that the set's own block is in."""
    blocks = (counts + BLOCK - 1) // BLOCK
    owner = np.repeat(np.arange(len(keys)), blocks)
    other = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = (_mix(sets.identity + np.uint64(7)) % blocks.astype(np.uint64)).astype(np.int64)[owner]
    pair = np.minimum(own, other).astype(np.uint64) << np.uint64(32) | np.maximum(own, other).astype(np.uint64)
    with np.errstate(over="ignore"):
        return _entries(sets, [_mix(_mix(pair) + keys[owner])], [owner])


def _entries(sets: Sets, keys: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, ENTRY)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    main, rest = signature(sets)
    out = np.empty(len(key), ENTRY)
    out["key"], out["set"], out["more"] = (key >> np.uint64(32)).astype(np.uint32), sets.identity[owner], rest[owner]
    out["meta"] = main[owner]
    return key, out


class Bucket:
    """Collects the entries of one bucket; sets under a key of more than `hot` sets are handed on and not kept."""

    #: Entries that are held before keys that are hot already are let go.
    HELD = 4_000_000

    def __init__(self, number: int, plan: Plan, hot: int) -> None:
        self.number, self.plan, self.hot = number, plan, hot
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.hot_keys = np.zeros(0, np.uint32)

    def add(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.parts.append(entries)
        self.size += len(entries)
        if self.size < self.HELD:
            return None
        kept, out = self._settle()
        # If little could be let go, wait for as much again.
        self.parts, self.size = [kept], 0 if len(kept) < self.HELD // 2 else -len(kept)
        return out

    def _settle(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
        """Entries sorted by key without copies, and (sets, keys) of the hot ones, which are left out."""
        entries = np.concatenate(self.parts) if len(self.parts) > 1 else self.parts[0]
        # Sorted by key and part of the identity in one number; then copies of a set are one entry.
        order = np.argsort(entries["key"].astype(np.uint64) << np.uint64(32) | (entries["set"] & np.uint64(0xFFFFFFFF)))
        entries = entries[order]
        key, own, meta = entries["key"], entries["set"], entries["meta"]
        new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (meta[1:] != meta[:-1])]
        entries = entries[new]
        key = entries["key"]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[start, len(key)])
        hot = (count > self.hot) | _member(key[start], self.hot_keys)
        if not hot.any():
            return entries, None
        self.hot_keys = np.union1d(self.hot_keys, key[start][hot])
        gone = np.repeat(hot, count)
        out = entries[gone]
        # The whole key: that of the bucket and the part kept in the entry.
        whole = _mix(out["key"].astype(np.uint64) << np.uint64(32) | np.uint64(self.number))
        return entries[~gone], (out["set"], whole)

    def close(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
        """Candidate pairs of what is left, and the last hot sets."""
        entries, out = self._settle()
        return join_entries(entries, self.plan), out


def join_entries(entries: np.ndarray, plan: Plan) -> np.ndarray:
    """Candidate pairs (two columns of identities, the smaller first) among entries of equal key, sorted by key."""
    key = entries["key"]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(key)])
    out = []
    for c in np.unique(count[count > 1]):
        begins = start[count == c]
        # All pairs of c places, a run of first places at a time.
        rows = max(1, PAIR_CHUNK // int(c))
        for low in range(0, int(c) - 1, rows):
            first = np.arange(low, min(low + rows, int(c) - 1))
            a = np.repeat(first, c - 1 - first)
            b = np.arange(len(a)) - np.repeat(np.cumsum(c - 1 - first) - (c - 1 - first), c - 1 - first) + a + 1
            step = max(1, PAIR_CHUNK // len(a))
            for k in range(0, len(begins), step):
                some = begins[k : k + step, None]
                out += _prune(entries, (some + a).ravel(), (some + b).ravel(), plan)
    if not out:
        return np.zeros((0, 2), np.uint64)
    pairs = np.concatenate(out)
    return np.unique(pairs, axis=0) if len(pairs) < 200_000 else _unique_pairs(pairs)


def _unique_pairs(pairs: np.ndarray) -> np.ndarray:
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    return pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]]


def _prune(entries: np.ndarray, i: np.ndarray, j: np.ndarray, plan: Plan) -> list[np.ndarray]:
    # Cheap first: at least as many words differ as parities do.
    sizes = (entries["meta"] & np.uint64(255)).astype(np.int16)
    meta, more = entries["meta"], entries["more"]
    differ = _popcount((meta[i] ^ meta[j]) >> np.uint64(9)) + _popcount(more[i] ^ more[j])
    near = np.flatnonzero((differ <= (sizes[i] + sizes[j]) * np.float32(plan.rate) + 1e-3) | (sizes[i] == 255) | (sizes[j] == 255))
    i, j, differ = i[near], j[near], differ[near]
    a, b = meta[i], meta[j]
    na, nb = sizes[i].astype(np.int32), sizes[j].astype(np.int32)
    whole = (na == 255) | (nb == 255)  # a size this large isn't known here
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    keep = whole | ((differ <= ((na + nb) * plan.rate + 1e-6)) & (small >= plan.similarity * large - 1e-6))
    keep &= ~((a & b) >> np.uint64(8) & np.uint64(1)).astype(bool)  # two deletions prove nothing
    x, y = entries["set"][i[keep]], entries["set"][j[keep]]
    other = x != y
    x, y = x[other], y[other]
    return [np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)] if len(x) else []


def _texts(table: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return narrow(table, row_id=id_column, text=text_column).select(F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def statistics(texts: DataFrame, similarity: float, least: int) -> tuple[Plan, np.ndarray]:
    """The plan and the frequent segment keys, counted over all texts.

    Each batch adds up its own keys and sends only those it has several times, with the costs of both allocations
    for small bands; what reaches the driver is bounded by MAX_FREQUENT.
    """
    plan = Plan(similarity)
    few = int(np.searchsorted(plan.top, DELETION_SIZE, side="right"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            sets = Sets(batch.column(0).to_pylist(), hasher, least).distinct()
            if not len(sets.size):
                continue
            own = plan.band(sets.size)
            keys, counts, costs = [], [], {}
            for band in np.unique(np.r_[own, own - 1]):
                if band < 0:
                    continue
                chosen = np.flatnonzero((own == band) | (own == band + 1))
                full, _, _ = segment_keys(sets, chosen, int(band), plan.segments(int(band), False), False)
                k, n = np.unique(full, return_counts=True)
                kept = n >= LOCAL_COUNT
                keys.append(k[kept]), counts.append(n[kept])
                if band < few:
                    wide, less, _ = segment_keys(sets, chosen, int(band), plan.segments(int(band), True), True)
                    _, o = np.unique(np.r_[wide.ravel(), less], return_counts=True)
                    n, o = n.astype(np.int64), o.astype(np.int64)
                    costs[int(band)] = (int(20 * full.size + (n * (n - 1)).sum()), int(20 * (wide.size + len(less)) + (o * (o - 1)).sum()))
            k, n = np.concatenate(keys), np.concatenate(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.zeros(len(k), np.int32), np.repeat(np.array(list(costs), np.int32) + 1, 2) if costs else np.zeros(0, np.int32)], pa.int32()), pa.array(np.r_[k.view(np.int64), np.tile(np.arange(2), len(costs))], pa.int64()), pa.array(np.r_[n.astype(np.int64), np.array([c for pair in costs.values() for c in pair], np.int64)], pa.int64())],
                names=["kind", "key", "n"],
            )

    total = texts.select("text").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    rows = total.where((F.col("kind") > 0) | (F.col("n") > FREQUENT)).orderBy(F.col("kind") == 0, F.desc("n"), "key").limit(MAX_FREQUENT).toPandas()
    cost = {(int(b) - 1, int(k)): int(n) for b, k, n in rows[rows["kind"] > 0].itertuples(index=False)}
    plan.deletion = frozenset(b for b, _ in cost if cost.get((b, 1), math.inf) < cost.get((b, 0), 0))
    frequent = np.sort(rows[rows["kind"] == 0]["key"].to_numpy(np.int64).view(np.uint64))
    return plan, frequent


def candidates_and_members(texts: DataFrame, plan: Plan, frequent: np.ndarray, least: int, rows: int, hot: int = HOT) -> DataFrame:
    """(kind, a, b) from one pass over the texts: kind 0 are pairs of identities that share a key and may be similar
    (a pair can come from several keys), kind 1 are row ids with the identity of their word set, kind 2 are identities
    with a key that too many sets share.

    Entries travel packed, by bucket of their key; a task joins one bucket at a time.
    """
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, rows * 40 // BUCKET_ENTRIES + 1)
    shared = spark.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            sets = Sets(batch.column(1).to_pylist(), hasher, least)
            if not len(sets.size):
                continue
            ids = np.asarray(batch.column(0).take(pa.array(sets.rows, pa.int64())).to_numpy())
            member = np.stack([ids, sets.identity.view(np.int64)], axis=1)
            # Members ride along under a negative bucket.
            yield _packed(*index_entries(sets.distinct(), plan, shared.value), buckets, [-1 - int(member[0, 1] % partitions)], [member.tobytes()])

    return _joined(texts.mapInArrow(emit, "bucket int, entries binary"), plan, buckets, partitions, hot)


def _packed(keys: np.ndarray, entries: np.ndarray, buckets: int, numbers: list[int], packed: list[bytes]) -> pa.RecordBatch:
    """Entries by bucket, one row each, behind the rows given."""
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, entries = bucket[order], entries[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True]) if len(bucket) else np.zeros(1, np.int64)
    numbers = [*numbers, *bucket[cuts[:-1]].tolist()]
    packed = [*packed, *(entries[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False))]
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "entries"])


def _joined(packed: DataFrame, plan: Plan, buckets: int, partitions: int, hot: int) -> DataFrame:
    """(kind, a, b) of packed entries: see candidates_and_members."""

    def rows_of(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), _signed(np.ascontiguousarray(a)), _signed(np.ascontiguousarray(b))], names=["kind", "a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Bucket | None = None

        def closed() -> Iterator[pa.RecordBatch]:
            if now is not None:
                pairs, out = now.close()
                if out is not None:
                    yield rows_of(2, *out)
                if len(pairs):
                    yield rows_of(0, pairs[:, 0], pairs[:, 1])

        for batch in batches:
            for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket < 0:
                    member = np.frombuffer(entries, np.int64).reshape(-1, 2)
                    yield rows_of(1, member[:, 0], member[:, 1])
                    continue
                if now is None or bucket != now.number:
                    yield from closed()
                    now = Bucket(bucket, plan, hot)
                out = now.add(np.frombuffer(entries, ENTRY))
                if out is not None:
                    yield rows_of(2, *out)
        yield from closed()

    # Bucket b goes to partition b modulo their number, so that no task gets several while another has none.
    tasks = min(buckets, 4 * partitions)
    spread = packed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
    return spread.mapInArrow(join, "kind int, a long, b long")


def further_candidates(shared: DataFrame, words: DataFrame, plan: Plan, number: int, hot: int, *, blocks: bool) -> DataFrame:
    """(kind, a, b) as in candidates_and_members, of sets under keys that too many share (id, key), with words(id, words)."""
    partitions = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = shared.count() * (HOT // BLOCK * 8 if blocks else 24)
    buckets = max(partitions, entries // BUCKET_ENTRIES + 1)
    rows = shared.join(words, "id")
    rows = rows.join(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").select("id", "key", "words", "n") if blocks else rows.select("id", "key", "words", F.lit(0).cast("long").alias("n"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            identity, key = (np.asarray(batch.column(k).to_numpy()).view(np.uint64) for k in (0, 1))
            lists = batch.column(2)
            sets = Sets.of_words(identity, np.asarray(lists.flatten().to_numpy()).view(np.uint64), np.diff(np.asarray(lists.offsets)).astype(np.int64))
            entries = block_entries(sets, key, np.asarray(batch.column(3).to_numpy())) if blocks else extended_entries(sets, key, plan, number)
            yield _packed(*entries, buckets, [], [])

    return _joined(rows.mapInArrow(emit, "bucket int, entries binary"), plan, buckets, partitions, (1 << 62) if blocks else hot)


def _own_hash(x: np.ndarray) -> np.ndarray:
    return (_mix(x) % np.uint64(FILTER_BITS)).astype(np.int64)


def word_sets(texts: DataFrame, least: int, wanted: DataFrame) -> DataFrame:
    """(id, words) of the rows that `wanted` (one column, row ids) names, one row for each id.

    A bit table of a fixed size, or-ed in the shuffle, tells the tasks which rows are worth splitting into words.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_own_hash(np.asarray(batch.column(0).to_numpy()).view(np.uint64)))
            word, bit = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int32), pa.int32()), _signed(np.bitwise_or.reduceat(bit, first)) if len(first) else pa.array([], pa.int64())], names=["w", "bit"])

    rows = wanted.mapInArrow(mark, "w int, bit long").groupBy("w").agg(F.bit_or("bit").alias("bit")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["w"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), shared.value.view(np.uint64)
        for batch in batches:
            at = _own_hash(np.asarray(batch.column(0).to_numpy()).view(np.uint64))
            marked = np.flatnonzero(table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            if not len(marked):
                continue
            sets = Sets(batch.column(1).take(pa.array(marked)).to_pylist(), hasher, least).distinct()
            offsets = np.r_[0, np.cumsum(sets.size)].astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(np.ascontiguousarray(sets.flat)))
            yield pa.RecordBatch.from_arrays([_signed(np.ascontiguousarray(sets.identity)), words], names=["id", "words"])

    return texts.mapInArrow(sets_of, "id long, words array<long>").dropDuplicates(["id"])


def similar_sets(texts: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): verified pairs (a, b, similarity) of different word sets, and (row_id, id) of every row that counts."""
    if not 0.5 <= similarity < 1:
        raise CorpusError("similarity must be at least 0.5 and less than 1")
    rows = texts.count()
    plan, frequent = statistics(texts, similarity, least)
    found_ = cut(candidates_and_members(texts, plan, frequent, least, rows, hot))
    candidates = found_.where("kind = 0").select("a", "b")
    members = found_.where("kind = 1").select(F.col("a").alias("row_id"), F.col("b").alias("id"))

    def words_of(ids: DataFrame) -> DataFrame:
        # One row for each identity brings its words.
        return word_sets(texts, least, members.join(ids, "id", "left_semi").groupBy("id").agg(F.min("row_id").alias("row_id")).select("row_id"))

    for number in range(1, ROUNDS + 2):
        left = found_.where("kind = 2")
        if left.isEmpty():
            break
        shared = cut(left.select(F.col("a").alias("id"), F.col("b").alias("key")).distinct())
        found_ = cut(further_candidates(shared, words_of(shared.select("id").distinct()), plan, number, hot, blocks=number > ROUNDS))
        candidates = candidates.unionByName(found_.where("kind = 0").select("a", "b"))
    candidates = candidates.distinct()
    sets = words_of(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    first = candidates.join(sets.withColumnsRenamed({"id": "a", "words": "x"}), "a")
    both = first.join(sets.withColumnsRenamed({"id": "b", "words": "y"}), "b")
    shared_words = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared_words
    pairs = both.select("a", "b", (shared_words / union).alias("similarity")).where(F.col("similarity") >= similarity - 1e-12)
    return pairs, members


def near_duplicates(table: DataFrame, *, id_column: str = "row_id", text_column: str = "comment_text", similarity: float = SIMILARITY, least: int = LEAST_WORDS, hot: int = HOT) -> DataFrame:
    """(row_id_a, row_id_b): every pair of rows whose word sets have the similarity, row_id_a < row_id_b.

    Identical texts and reorderings are pairs too.  Null, empty and short texts are in no pair; a row that occurs
    several times gives its pairs once; null ids are left out; extra columns are ignored; an empty table gives none.
    """
    texts = _texts(table, id_column, text_column).where(F.col("row_id").isNotNull())
    pairs, members = similar_sets(texts, similarity, least, hot)
    other = members.select(F.col("row_id").alias("other"), "id")
    same = members.join(other, "id").where(F.col("row_id") < F.col("other")).select(F.col("row_id").alias("row_id_a"), F.col("other").alias("row_id_b"))
    left = pairs.select("a", "b").join(members.withColumnRenamed("id", "a"), "a")
    across = left.join(other.withColumnRenamed("id", "b"), "b").select(F.least("row_id", "other").alias("row_id_a"), F.greatest("row_id", "other").alias("row_id_b"))
    return same.unionByName(across).where(F.col("row_id_a") < F.col("row_id_b")).distinct()


def duplicate_groups(table: DataFrame, *, id_column: str = "row_id", text_column: str = "comment_text", similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """(row_id, group_id, n_links): the connected group of every row that counts and its links to different word sets.

    group_id is the smallest row_id of the group; a row without a similar one is its own group.  Copies of a word
    set count as one node, so a group of copies is never expanded into pairs.  Labels spread by joins until none
    moves; each round is written to the shared folder.
    """
    texts = _texts(table, id_column, text_column).where(F.col("row_id").isNotNull())
    pairs, members = similar_sets(texts, similarity, least)
    members = members.distinct()
    edges = cut(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct())
    labels = members.groupBy("id").agg(F.min("row_id").alias("label"))
    nodes = edges.select(F.col("a").alias("id")).distinct()
    linked = cut(labels.join(nodes, "id", "left_semi"))
    while True:
        near = edges.join(linked.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = linked.join(near, "id").select("id", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        # Follow the label of the label's own set, so that long chains close in few rounds.
        jump = step.join(members.join(step.select("id", F.col("label").alias("further")), "id").select(F.col("row_id").alias("label"), "further").distinct(), "label", "left")
        linked = cut(jump.select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "moved"))
        if not linked.where("moved").limit(1).count():
            break
        linked = linked.drop("moved")
    final = labels.join(linked.select("id", F.col("label").alias("group_id")), "id", "left").select("id", F.coalesce("group_id", "label").alias("group_id"))
    degree = edges.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(final, "id").join(degree, "id", "left").select("row_id", "group_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def found(benchmark: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b) of the benchmark's near-duplicate comments."""
    return near_duplicates(benchmark)
