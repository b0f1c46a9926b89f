"""Problem 8: find and repair text that was decoded with the wrong character encoding.

A layer (wrong, right) undoes one mistake: the characters are encoded again by the wrong
codec and strictly decoded by the right one.  Layers are tried on the parts of a text that
hold characters beyond ASCII, the one whose garbling cost drops most is applied, and the
result is tried again for nested mistakes.

The garbling cost is the negative log-likelihood of neighbouring characters, counted over
all documents of the table (a fixed number of hashed counters, so its size doesn't grow).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_batch, narrow

#: Hashed counters of character pairs; the model is one float for each.
BUCKETS = 1 << 18
#: The cost (in nats) must drop by this much: for UTF-8, whose form is evidence in itself, and for other encodings.
UTF8_GAIN, TABLE_GAIN = 3.0, 7.5
#: Count that stands for a pair that no document has: it costs far more than a pair seen once.
UNSEEN = 1e-6
LOST = "�"

_UTF8 = "utf-8"
#: Codecs that text is wrongly decoded by, and legacy codecs that it was really in.
WRONG_FOR_UTF8 = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "cp1256", "koi8-r", "cp866", "cp1253", "cp1254", "iso8859-15", "gb18030")
WRONG_FOR_TABLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2")
RIGHT_TABLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "cp1256", "koi8-r")
RIGHT_MULTI = ("gb18030", "big5", "shift_jis", "euc_kr")

_UNIT = re.compile(r"[^ \t\n\r\x0b\x0c]*[^\x00-\x7f][^ \t\n\r\x0b\x0c]*")
_VALID = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")


def _table(codec: str) -> tuple[str, dict[str, int]]:
    """The 256 characters of a single-byte codec and their inverse; a byte without a character stands for its own code point."""
    chars = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


class Layer:
    """Undoes one decoding mistake on one unit of text."""

    def __init__(self, wrong: str, right: str) -> None:
        self.wrong, self.right = wrong, right
        self.wide = wrong == "gb18030"
        if not self.wide:
            chars, self.code = _table(wrong)
            high = "".join(re.escape(c) for c in chars[128:])
            self.run = re.compile(f"[{high}]+")
            self.piece = re.compile(f"[{high}\x00-\x7f]*[{high}][{high}\x00-\x7f]*")
            if right in RIGHT_TABLE:
                self.swap = str.maketrans({c: _table(right)[0][b] for b, c in enumerate(chars) if b >= 128})

    def _bytes(self, text: str) -> bytes:
        return bytes([self.code[c] for c in text])

    def utf8(self, unit: str) -> str | None:
        """Repairs every valid UTF-8 sequence of the unit and leaves the rest; None if there is none."""
        if self.wide:
            try:
                fixed = unit.encode("gb18030").decode("utf-8")
            except UnicodeError:
                return None
            return fixed if fixed != unit else None
        changed = False

        def part(found: re.Match) -> str:
            nonlocal changed
            raw, out, last = self._bytes(found[0]), [], 0
            for good in _VALID.finditer(raw):
                out += [found[0][last : good.start()], good[0].decode("utf-8")]
                last = good.end()
                changed = True
            return "".join(out) + found[0][last:]

        fixed = self.run.sub(part, unit)
        return fixed if changed else None

    def table(self, unit: str) -> str | None:
        """The unit with each wrong character replaced; None if a character is not of the wrong codec."""
        if any(c > "\x7f" and c not in self.code for c in unit):
            return None
        return unit.translate(self.swap)

    def multi(self, unit: str) -> str | None:
        """The unit with each run that the wrong codec can hold strictly decoded by a multi-byte codec; None if no run can be."""
        changed = False

        def part(found: re.Match) -> str:
            nonlocal changed
            try:
                fixed = self._bytes(found[0]).decode(self.right)
            except UnicodeError:
                return found[0]
            changed = True
            return fixed

        fixed = self.piece.sub(part, unit)
        return fixed if changed else None

    def repair(self, unit: str) -> str | None:
        if self.right == _UTF8:
            return self.utf8(unit)
        return self.table(unit) if self.right in RIGHT_TABLE else self.multi(unit)


def layers() -> list[Layer]:
    """All layers that are tried, each pair of different codecs once."""
    out = [Layer(w, _UTF8) for w in WRONG_FOR_UTF8]
    out += [Layer(w, r) for w in WRONG_FOR_TABLE for r in RIGHT_TABLE if w != r and {w, r} != {"cp1252", "latin-1"}]
    out += [Layer(w, r) for w in ("cp1252", "latin-1") for r in RIGHT_MULTI]
    return out


def _pairs_at(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and buckets of the neighbouring characters of which one at least is beyond ASCII."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    high = x > 127
    at = np.flatnonzero(high[:-1] | high[1:])
    a, b = x[at].astype(np.uint64), x[at + 1].astype(np.uint64)
    space = np.uint64(32)
    a, b = (np.where((y >= 9) & (y <= 13), space, y) for y in (a, b))
    # White space behind a digit is a character of its own: a degree sign follows it, an opening mark does not.
    before = x[np.maximum(at - 1, 0)]
    a = np.where((a == space) & (at > 0) & (before >= 48) & (before <= 57), np.uint64(1), a)
    b = np.where((b == space) & (a >= 48) & (a <= 57), np.uint64(1), b)
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    return at, (mixed % np.uint64(BUCKETS)).astype(np.int64)


def _pairs(text: str) -> np.ndarray:
    return _pairs_at(text)[1]


def pair_counts(documents: DataFrame, text_column: str = "text") -> np.ndarray:
    """Counts of character pairs over all texts: each task adds up its own counters, the shuffle adds those of all tasks.

    At most BUCKETS rows reach the driver, whatever the size of the table.
    """
    texts = narrow(documents, text=text_column).where(F.col("text").rlike("[^\\x00-\\x7F]"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                joined = "\n".join(batch.column(0).slice(start, 512).to_pylist())
                total += np.bincount(_pairs(joined), minlength=BUCKETS)
        kept = np.flatnonzero(total)
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(total[kept], pa.int64())], names=["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, np.int64)
    total[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return total


class Unit:
    """What each layer makes of one unit of text, and by how much the cost drops."""

    __slots__ = ("fixed", "gain")

    def __init__(self) -> None:
        self.fixed: dict[int, str] = {}
        self.gain: dict[int, float] = {}


class Repairer:
    """Repairs texts by a cost table; keeps what it found for each unit, as words repeat.

    The units of a batch of texts are worked out together: a layer is only tried on a unit whose characters its wrong
    codec has, and all that the layers make of all units is scored at once.
    """

    #: Units remembered in one worker.
    MEMORY = 200_000

    def __init__(self, counts: np.ndarray) -> None:
        total = max(1.0, float(counts.sum()))
        self.cost_of = (-np.log((counts + UNSEEN) / (total + 1.0))).astype(np.float32)
        self.layers = layers()
        self.nested = [layer for layer in self.layers if layer.right == _UTF8 and layer.wrong in ("cp1252", "latin-1")]
        self.least = [UTF8_GAIN if layer.right == _UTF8 else TABLE_GAIN for layer in self.layers]
        # By wrong codec: bit w of `has[c]` says that codec w has character c.
        codecs = sorted({layer.wrong for layer in self.layers if not layer.wide})
        self.has: dict[str, int] = {}
        for k, codec in enumerate(codecs):
            for c in _table(codec)[1]:
                if c > "\x7f":
                    self.has[c] = self.has.get(c, 0) | 1 << k
        bit = {codec: 1 << k for k, codec in enumerate(codecs)}
        self.by_utf8 = [(k, layer, bit.get(layer.wrong, 0)) for k, layer in enumerate(self.layers) if layer.right == _UTF8]
        self.by_table = [(k, layer, bit[layer.wrong]) for k, layer in enumerate(self.layers) if layer.right in RIGHT_TABLE]
        self.by_multi = [(k, layer, bit[layer.wrong]) for k, layer in enumerate(self.layers) if layer.right in RIGHT_MULTI]
        self.known: dict[tuple[str, bool], Unit] = {}

    def costs(self, units: list[tuple[str, bool]]) -> np.ndarray:
        """The cost of each unit between blanks, or behind a number and a blank."""
        texts = [f"0 {unit} " if numbered else f" {unit} " for unit, numbered in units]
        # Each text begins and ends with ASCII, so no pair lies between two.
        at, bucket = _pairs_at("".join(texts))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        return np.bincount(np.searchsorted(ends, at, side="right"), self.cost_of[bucket], len(texts))

    def _fixes(self, unit: str) -> dict[int, list[str]]:
        """For each layer that changes something the results to choose from."""
        out: dict[int, list[str]] = {}
        every, some, high = -1, 0, 0
        for c in unit:
            if c > "\x7f":
                mask = self.has.get(c, 0)
                every &= mask
                some |= mask
                high += 1
        if high > 1:  # a character of UTF-8 beyond ASCII has two bytes at least
            for k, layer, bit in self.by_utf8:
                fixed = layer.utf8(unit) if layer.wide or some & bit else None
                if fixed is not None:
                    # What lies between two layers may look worse than either end: look one further.
                    again = self.nested if layer.wrong in ("cp1252", "latin-1") else [layer]
                    out[k] = [fixed, *(d for d in (inner.utf8(fixed) for inner in again) if d is not None)]
        else:
            for k, layer, _ in self.by_utf8:
                fixed = layer.utf8(unit) if layer.wide else None
                if fixed is not None:
                    out[k] = [fixed, *(d for d in (layer.utf8(fixed),) if d is not None)]
        if every:
            for k, layer, bit in self.by_table:
                if every & bit:
                    out[k] = [unit.translate(layer.swap)]
        if some:
            for k, layer, bit in self.by_multi:
                fixed = layer.multi(unit) if some & bit else None
                if fixed is not None:
                    out[k] = [fixed]
        return out

    def learn(self, units: set[tuple[str, bool]]) -> None:
        """Works out what the layers make of new units."""
        fresh = [u for u in units if u not in self.known]
        for begin in range(0, len(fresh), 4096):
            part = fresh[begin : begin + 4096]
            fixes = [self._fixes(unit) for unit, _ in part]
            asked = [dict.fromkeys([unit, *(f for listed in found.values() for f in listed)]) for (unit, _), found in zip(part, fixes, strict=True)]
            cost = self.costs([(text, numbered) for (_, numbered), texts in zip(part, asked, strict=True) for text in texts]).tolist()
            at = 0
            for key, found, texts in zip(part, fixes, asked, strict=True):
                of = dict(zip(texts, cost[at : at + len(texts)], strict=True))
                at += len(texts)
                made = self.known[key] = Unit()
                before = of[key[0]]
                for k, listed in found.items():
                    best = min(listed, key=of.__getitem__)
                    made.fixed[k], made.gain[k] = best, before - of[best]

    def once(self, text: str, found: list[re.Match], keys: list[tuple[str, bool]]) -> str | None:
        """The text with the best layer undone where it helps; None if no layer lowers the cost enough."""
        units = [self.known[k] for k in keys]
        # No layer can gain more than its units do together.
        most: dict[int, float] = {}
        for unit in units:
            for k, gain in unit.gain.items():
                if gain > 0:
                    most[k] = most.get(k, 0.0) + gain
        best, at = 0.0, None
        for k in sorted(most):
            if most[k] < self.least[k] or most[k] <= best:
                continue
            if self.layers[k].right == _UTF8:
                gain, chosen = most[k], [i for i, u in enumerate(units) if u.gain.get(k, 0.0) > 0]
            else:
                # The run of units that gains most as a whole: inside a garbled place every unit is repaired.
                gain, first, chosen, run = 0.0, 0, [], 0.0
                for i, u in enumerate(units):
                    if k not in u.gain:
                        run, first = 0.0, i + 1
                        continue
                    if run <= 0:
                        run, first = 0.0, i
                    run += u.gain[k]
                    if run > gain:
                        gain, chosen = run, list(range(first, i + 1))
            if gain >= self.least[k] and gain > best:
                best, at = gain, (k, chosen)
        if at is None:
            return None
        out, last = [], 0
        for i in at[1]:
            out += [text[last : found[i].start()], units[i].fixed[at[0]]]
            last = found[i].end()
        return "".join(out) + text[last:]

    def repair_all(self, texts: list[str]) -> list[tuple[str, int]]:
        """Each text restored, and how many layers were undone.

        Every layer lowers the cost of its text, so this ends; there is no other limit to the layers.
        """
        out = [(text, 0) for text in texts]
        live = list(range(len(texts)))
        while live:
            found = [list(_UNIT.finditer(out[i][0])) for i in live]
            keys = [[(m[0], m.start() > 1 and "0" <= out[i][0][m.start() - 2] <= "9") for m in listed] for i, listed in zip(live, found, strict=True)]
            if len(self.known) >= self.MEMORY:
                self.known.clear()
            self.learn({k for listed in keys for k in listed})
            again = []
            for i, listed, of in zip(live, found, keys, strict=True):
                text, n = out[i]
                fixed = self.once(text, listed, of) if listed else None
                if fixed is not None and fixed != text:
                    out[i] = (fixed, n + 1)
                    again.append(i)
            live = again
        return out

    def repair(self, text: str) -> tuple[str, int]:
        return self.repair_all([text])[0]


def repair_encoding(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, restored, layers) of each row some part of which was decoded with the wrong encoding.

    `restored` is the whole original text, or null where characters were lost (U+FFFD).  Null, empty and
    pure ASCII texts are never garbled and give no row; repeated rows each give their row; a null id stays
    null; extra columns are ignored; an empty table gives an empty table.  Two passes without a shuffle of
    texts: one counts character pairs over all documents, one repairs.
    """
    source = narrow(documents, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = pair_counts(source, "text")
    packed = counts.astype(np.int64)

    def make():
        repairer = Repairer(packed)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, restored, undone = [], [], []
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin in range(0, len(texts), 512):
                part = texts[begin : begin + 512]
                done = iter(repairer.repair_all([t for t in part if LOST not in t]))
                for key, text in zip(keys[begin : begin + 512], part, strict=True):
                    if LOST in text:
                        ids.append(key), restored.append(None), undone.append(0)
                        continue
                    fixed, n = next(done)
                    if n and fixed != text:
                        ids.append(key), restored.append(fixed), undone.append(n)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(restored, pa.string()), pa.array(undone, pa.int32())], names=["doc_id", "restored", "layers"])

        return step

    return by_batch(source.where(F.col("text").rlike("[^\\x00-\\x7F]")), "doc_id long, restored string, layers int", make)


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, restored_sha256): the digest of the restored text, empty where it can't be restored."""
    repaired = repair_encoding(documents)
    return repaired.select("doc_id", F.coalesce(F.sha2(F.col("restored").cast("binary"), 256), F.lit("")).alias("restored_sha256"))
