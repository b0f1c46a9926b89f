"""Problem 6: token ids of every document by a public byte-level BPE vocabulary.

The ranks come from a local file (its path is a parameter).  Long texts are cut
only where the splitting pattern must end a piece whatever follows, so cutting
never changes the ids; each distinct piece run is then encoded by tiktoken.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import CorpusError, by_batch, narrow

#: Texts longer than this many characters are cut at safe boundaries before encoding.
LONG_TEXT = 20_000

IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

# Fixed value: the pre-tokenisation pattern published with the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# A piece never holds white space after another character, a letter followed by anything but a letter,
# or a digit followed by anything but a digit.  (A mark may run on into letters only after an apostrophe.)
_SAFE = r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[^\p{White_Space}\p{L}])|(?<=\p{N})(?=[^\p{White_Space}\p{N}])"

#: White-space runs from this length on are pieces of their own: the pattern's look-ahead would exhaust its stack on them.
LONG_SPACE = 500

_encoders: dict[str, object] = {}


def default_rank_file(name: str = "byte_bpe_50k") -> str:
    """Path of a rank file: $PLENUM_TOKENIZERS if set, else the installed public_tokenizers package, else /opt/tokenizers."""
    folder = os.environ.get("PLENUM_TOKENIZERS")
    if folder:
        return os.path.join(folder, f"{name}.tiktoken")
    try:
        import public_tokenizers

        return str(public_tokenizers.path(f"{name}.tiktoken"))
    except ImportError:
        return f"/opt/tokenizers/{name}.tiktoken"


def load_encoder(rank_file: str):
    """A tiktoken encoder without special tokens, kept once in each Python worker."""
    if rank_file not in _encoders:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[rank_file] = tiktoken.Encoding(os.path.basename(rank_file), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[rank_file]


def safe_parts(text: str, longest: int = LONG_TEXT) -> list[str]:
    """Cuts text into parts of about `longest` characters, only at boundaries that no piece crosses.

    A single run of letters, digits or marks that is longer stays whole, so the parts always
    encode to the ids of the whole text.
    """
    if len(text) <= longest:
        return [text]
    import regex

    parts, start = [], 0
    for cut in regex.finditer(_SAFE, text):
        if cut.start() - start >= longest:
            parts.append(text[start : cut.start()])
            start = cut.start()
    parts.append(text[start:])
    return parts


def encode_text(text: str, encoder, longest: int = LONG_TEXT) -> list[int]:
    """Ids of one text.  All but the last character of a white-space run before other text form one piece; at the end the whole run does."""
    if len(text) < LONG_SPACE:
        return encoder.encode_ordinary(text)
    import regex

    ids: list[int] = []
    start = 0
    for run in regex.finditer(r"\p{White_Space}{%d,}+" % LONG_SPACE, text):
        for part in safe_parts(text[start : run.start()], longest):
            ids += encoder.encode_ordinary(part)
        start = run.end() - (run.end() < len(text))
        ids += encoder._encode_single_piece(text[run.start() : start])
    for part in safe_parts(text[start:], longest):
        ids += encoder.encode_ordinary(part)
    return ids


def _encode_batch(texts: list[str | None], encoder, longest: int) -> pa.Array:
    """Ids of each text as a list<int32> array; null and empty texts give an empty list."""
    flat: list[np.ndarray] = []
    offsets = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        n = 0
        if text:
            ids = np.asarray(encode_text(text, encoder, longest), np.int32)
            flat.append(ids)
            n = len(ids)
        offsets[i + 1] = offsets[i] + n
    values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    if offsets[-1] > np.iinfo(np.int32).max:
        raise CorpusError("an Arrow batch holds more than 2**31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def token_ids(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", rank_file: str | None = None, longest: int = LONG_TEXT) -> DataFrame:
    """One row (doc_id, ids) for each input row, repeats included.

    An empty and a null text give an empty array; a null id stays null; strings that look like special
    tokens are encoded as plain text; extra columns are ignored; an empty table gives an empty table.
    The work is one narrow pass without a shuffle.
    """
    path = rank_file or default_rank_file()
    source = narrow(documents, doc_id=id_column, text=text_column)

    def make():
        encoder = load_encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = _encode_batch(batch.column(1).to_pylist(), encoder, longest)
            return pa.RecordBatch.from_arrays([pc.cast(batch.column(0), pa.int64()), ids], names=["doc_id", "ids"])

        return step

    return by_batch(source.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), IDS, make)


def decode_ids(encoded: DataFrame, *, id_column: str = "doc_id", ids_column: str = "ids", rank_file: str | None = None) -> DataFrame:
    """(doc_id, text): joins the raw bytes of all ids before decoding, so characters split over ids survive.

    Null ids give an empty text.  Bytes that are not valid UTF-8 raise, as they can't come from token_ids().
    """
    path = rank_file or default_rank_file()
    source = narrow(encoded, doc_id=id_column, ids=ids_column)

    def make():
        decode = load_encoder(path).decode_bytes

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [decode(ids).decode("utf-8") if ids else "" for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([pc.cast(batch.column(0), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

        return step

    return by_batch(source.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), "doc_id long, text string", make)


def token_budget(encoded: DataFrame, group: Column) -> DataFrame:
    """(group_value, documents, tokens, empty): totals for a group expression, with partial sums before the shuffle."""
    return encoded.groupBy(group.alias("group_value")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.size("ids").cast("long")).alias("tokens"),
        F.sum(F.when(F.size("ids") == 0, 1).otherwise(0).cast("long")).alias("empty"),
    )
