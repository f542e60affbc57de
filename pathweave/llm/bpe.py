"""Encoding of whole texts with a public byte-level BPE vocabulary.

Method: a text is cut by the vocabulary's pattern; in each piece a priority queue holds the merge ranks of adjacent symbols, which form a
doubly linked list. The lowest rank merges first, the leftmost among equals; entries whose pair has changed meanwhile are stale and
skipped. n bytes take O(n log n), however long a piece is. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabularies lie unless a caller says otherwise.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for text that is all ASCII, where the standard library is three times as fast.
ASCII = r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: A line end between two visible characters is always a piece of its own, so a text may be cut after it.
CUT = r"(?<=[^\s]\n)(?=[^\s])"
#: Pieces up to so many characters are remembered, so many of them a worker; frequent ones are merged once.
SHORT, REMEMBERED = 48, 400_000

_LOW = (1 << 32) - 1


class Bpe:
    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.strings = {b: a for a, b in self.ranks.items()}
        self.whole, self.ascii, self.cut = regex.compile(PATTERN).findall, re.compile(ASCII).findall, re.compile(CUT).split
        self.known: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        out: list[str] = []
        for part in self.cut(text):
            out += self.ascii(part) if part.isascii() else self.whole(part)
        return out

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        ranks, get, n = self.ranks, self.ranks.get, len(piece)
        whole = get(piece)
        if whole is not None:
            return (whole,)
        # symbol i covers piece[i:after[i]]; before[i] is where the symbol to its left starts; rank[i] is that of i and its right neighbour
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [get(piece[i : i + 2]) for i in range(n - 1)]
        rank.append(None)
        queue = [(r << 32) | i for i, r in enumerate(rank) if r is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & _LOW
            if rank[i] != entry >> 32:
                continue  # stale: this pair isn't there any more
            j = after[i]
            end = after[i] = after[j]
            rank[j] = rank[i] = None
            if end < n:
                before[end] = i
                r = rank[i] = get(piece[i : after[end]])
                if r is not None:
                    heappush(queue, (r << 32) | i)
            left = before[i]
            if left >= 0:
                r = rank[left] = get(piece[left:end])
                if r is not None:
                    heappush(queue, (r << 32) | left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose strings are ordinary text; none for null and empty text."""
        out: list[int] = []
        if not text:
            return out
        known, add = self.known, out.extend
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            add(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def loaded(path: str, data: bytes | None = None) -> Bpe:
    """The encoder of a vocabulary, built once a worker process; from the file unless its contents are given."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(read(path) if data is None else data)
    return _LOADED[path]


def shipped(df: DataFrame, path: str):
    """The vocabulary file, read on the driver and sent to the executors: a megabyte or so, whatever the texts."""
    return df.sparkSession.sparkContext.broadcast(read(path))


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def encode_texts(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, ids): the token ids of each text, one row per row; null and empty texts give an empty list.

    Rows, repeated ones included, are taken as they come; a null id stays null. path is read on the driver and sent to the executors. The
    rows don't leave their partition. Other columns aren't read, whatever their names.
    """
    kind = docs.select(id_col).schema[0]
    words = shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(path, words.value).encode
        for batch in batches:
            offsets, flat = [0], []
            for text in batch.column(1):
                flat.extend(encode(text.as_py()))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, id_col: str, path: str) -> DataFrame:
    """(id, text): the texts again; null and empty texts both come back empty."""
    kind = encoded.select(id_col).schema[0]
    words = shipped(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = loaded(path, words.value).decode
        for batch in batches:
            texts = pa.array([decode(ids) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind.dataType.simpleString()}, text string")
