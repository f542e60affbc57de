"""Repetition inside a single document.

Method: compression bands. A document's words become codes of four bytes each, so that every word weighs the same, and zstandard compresses
the codes of the whole document and of fixed chunks. A ratio below the limit for that length means repetition. The same is done to the
raw bytes to tell incompressible text.

The limit for n words comes from the passages that are looked for: if half of the words lie in passages of ``size`` words that occur ``times`` times, that half
takes one copy and a match for each other one, the rest at most its own size. A fast level finds most repetition; since it leaves positions out of its index
where a long run has no match, texts that it finds too little in are compressed again at a level that indexes every position.
The share of repeated content is then measured exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

#: Bytes that a match takes at most, bytes that a text takes besides, and the slack of the limit.
MATCH, BESIDE, SLACK = 6.0, 20.0, 0.02
#: Limits of the ratio of raw bytes by number of bytes: up to so many bytes, incompressible above that ratio.
INCOMPRESSIBLE = ((128, 1.2), (1024, 0.95), (float("inf"), 0.9))
CHUNK = 1024
LEVEL, EXACT_LEVEL, RAW_LEVEL = 9, 16, 3
#: Words of a run without matches up to which the fast level indexes every position.
INDEXED = 64

_WORDS = re.compile(r"[^\W_]+").findall


def limit(table, n: int) -> float:
    return next(v for most, v in table if n <= most)


def repetitive_limit(n: int, size: int = 6, times: int = 4) -> float:
    """The ratio up to which n words may have half of them in passages of ``size`` words that occur ``times`` times."""
    repeated = 1 / times + (1 - 1 / times) * min(1.0, MATCH / (4 * size))
    return 0.5 + 0.5 * repeated + BESIDE / (4 * n) + SLACK


def _ratio(data: bytes, level: int = LEVEL) -> float:
    """Compressed by plain size; the window always spans all of the data, and at the exact level so does the index."""
    log = min(27, max(10, len(data).bit_length()))
    more = {"chain_log": log + 1, "hash_log": log} if level == EXACT_LEVEL else {"enable_ldm": len(data) > 1 << 22}
    params = zstandard.ZstdCompressionParameters.from_level(level, window_log=log, write_content_size=False, write_checksum=False, **more)
    return len(zstandard.ZstdCompressor(compression_params=params).compress(data)) / len(data)


def _lower_words(text: str) -> list[str]:
    low = text.lower()
    # the one letter that becomes two characters would split a word
    return _WORDS(low) if len(low) == len(text) else [w.lower() for w in _WORDS(text)]


def repeated_share(words: list[int] | np.ndarray, size: int = 6, times: int = 4) -> float:
    """Share of the words that lie in a passage of ``size`` words occurring at least ``times`` times; occurrences may overlap."""
    n = len(words)
    if n < size + times - 1:
        return 0.0
    rank, many = np.unique(np.asarray(words, dtype=np.int64), return_inverse=True, return_counts=True)[1:]
    length, blocks = 1, {1: rank.astype(np.int64)}
    while length * 2 <= size:  # ranks of passages of 2, 4, ... words from pairs of shorter ones: exact, no hashing
        if many.max() < times:  # no passage occurs more often than its parts
            return 0.0
        a = blocks[length]
        pair = a[: len(a) - length] * (n + 1) + a[length:]
        rank, many = np.unique(pair, return_inverse=True, return_counts=True)[1:]
        blocks[length * 2] = rank.astype(np.int64)
        length *= 2
    whole, have = blocks[length], length
    while have < size:
        step = max(k for k in blocks if k <= size - have)
        b = blocks[step][have : have + n - have - step + 1]
        whole = np.unique(whole[: len(b)] * (n + 1) + b, return_inverse=True)[1].astype(np.int64)
        have += step
    hit = np.bincount(whole)[whole] >= times
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: len(hit)] += hit
    edge[size : size + len(hit)] -= hit
    return float((np.cumsum(edge[:n]) > 0).sum() / n)


def measure(text: str | None, size: int = 6, times: int = 4) -> tuple:
    """(words, ratio, lowest chunk ratio, raw ratio, band, share). The share is exact in every band."""
    words = _lower_words(text) if text else []
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not words:
        return 0, None, None, _ratio(raw, RAW_LEVEL) if raw else None, "empty", 0.0
    n = len(words)
    codes: dict[str, int] = {}
    seq = [codes.setdefault(w, len(codes)) for w in words]
    table = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in codes), dtype=np.uint32, count=len(codes))
    stream = table[seq].tobytes()
    most = repetitive_limit(n, size, times)
    ratio = _ratio(stream)
    if ratio > most and n > INDEXED:
        ratio = min(ratio, _ratio(stream, EXACT_LEVEL))
    chunks = [ratio] if n <= CHUNK else [_ratio(stream[i : i + 4 * CHUNK]) for i in range(0, len(stream), 4 * CHUNK)]
    raw_ratio = _ratio(raw, RAW_LEVEL)
    # fewer words can't hold a passage that often
    if n >= size + times - 1 and (ratio <= most or min(chunks) <= repetitive_limit(min(n, CHUNK), size, times)):
        band = "repetitive"
    else:
        band = "incompressible" if raw_ratio > limit(INCOMPRESSIBLE, len(raw)) else "normal"
    return n, ratio, min(chunks), raw_ratio, band, repeated_share(seq, size, times)


def repetition(docs: DataFrame, id_col: str, text_col: str, size: int = 6, times: int = 4) -> DataFrame:
    """(id, n_words, ratio, chunk_ratio, raw_ratio, band, share), one row per row.

    Null texts and texts without words have band ``empty`` and share 0. Repeated rows are measured each. Rows don't leave
    their partition; other columns aren't read.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [measure(t if isinstance(t, str) else None, size, times) for t in b.iloc[:, 1]]
            out = pd.DataFrame(rows, columns=["n_words", "ratio", "chunk_ratio", "raw_ratio", "band", "share"])
            out.insert(0, id_col, b.iloc[:, 0].to_numpy())
            yield out

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, n_words bigint, ratio double, chunk_ratio double, raw_ratio double, band string, share double")
