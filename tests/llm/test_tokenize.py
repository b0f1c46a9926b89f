import random

import pytest

from plenum.llm import tokenize as tk

encoder = tk.load_encoder(tk.default_rank_file())


def test_parts_and_spaces_never_change_ids(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(tk, "LONG_SPACE", 3)
    for _ in range(4000):
        text = "".join(rng.choice(" a1'.\n　中é́sll\t-٣\x1c\x85") for _ in range(rng.randrange(1, 40)))
        assert tk.encode_text(text, encoder, rng.randrange(1, 6)) == encoder.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 300_000, "a" * 200_000, " " * 100_000 + "x", "word " * 50_000])
def test_very_long_texts(text):
    ids = tk.encode_text(text, encoder)
    assert encoder.decode_bytes(ids).decode() == text


def test_table(spark, clashing):
    rows = [(1, "Hello <|endoftext|> world"), (2, ""), (3, None), (1, "Hello <|endoftext|> world"), (None, "é中🙂")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = tk.token_ids(df)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert out.count() == 5 and got[2] == [] and got[3] == [] and 50256 not in got[1]
    back = {r["doc_id"]: r["text"] for r in tk.decode_ids(out).collect()}
    assert back == {1: rows[0][1], 2: "", 3: "", None: "é中🙂"}
    assert tk.token_ids(df.limit(0)).count() == 0
    assert tk.token_budget(out, out["doc_id"] == 1).count() == 3


def test_equals_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    other = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    other.encode_special_tokens = True
    for text in ("The quick brown fox!", "naïve — café", "<|endoftext|> x", "第3天 ok\n\n  yes"):
        assert other.encode(text, add_special_tokens=False).ids == tk.encode_text(text, encoder)
