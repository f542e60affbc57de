import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathweave.llm import bpe

PATH = bpe.vocabulary("byte_bpe_50k")


def slow(b, piece):
    """Merges the pair of lowest rank, leftmost first, in a plain list."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(b.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in b.ranks]
        if not pairs:
            return tuple(b.ranks[p] for p in parts)
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_merge_equals_the_plain_way(data):
    b = bpe.loaded(PATH)
    assert b.merge(data) == slow(b, data)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab 1é\n\r\t'\x1c\x85 sre²_-<|>", max_size=40))
def test_pieces_and_round_trip(text):
    b = bpe.loaded(PATH)
    assert b.pieces(text) == b.whole(text)
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert b.decode(b.encode(text)) == text


def test_equals_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    b = bpe.loaded(PATH)
    for text in ("Hello  world!\n\n  it's 1st\t", "<|endoftext|> x", "日本語 naïve", "a" * 5000, " " * 300 + "x", "\r\n\r\n", "ab" * 20000):
        assert b.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "hi", 9), (3, "hi", 9), (None, "x", 9), (5, "z" * 300_000, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = bpe.encode_texts(df, "doc_id", "text", PATH)
    out = {r.doc_id: r.ids for r in got.collect()}
    assert out[1] == [] and out[2] == [] and out[3] == bpe.loaded(PATH).encode("hi")
    assert got.count() == 6
    back = {r.doc_id: r.text for r in bpe.decode_ids(got, "doc_id", PATH).collect()}
    assert back[5] == "z" * 300_000 and back[1] == ""
    assert bpe.encode_texts(df.limit(0), "doc_id", "text", PATH).collect() == []
