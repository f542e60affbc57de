"""Languages of documents and of mixed-language segments.

Method: compression classification. Sentences are encoded with zstandard once per language, each time with a raw-content dictionary of
that language; the smallest encoding wins. Over the sentences of a text the cheapest sequence of languages counts, a change of
language costing some bytes; where the margin to the next language is narrow, a segment is rejected and has no language.
The dictionaries are built from a bounded sample of labelled rows: labels may be wrong, so each half of the sample is
classified with dictionaries of the other half, only sentences that agree with their label stay in, and this is done again
with the cleaner halves. Unlabelled texts, each in one language, may join the sample where their language is clear.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample: rows per language from which dictionaries are built, and bytes of a dictionary.
SAMPLE_ROWS, DICTIONARY = 500, 96_000
#: Compression levels for texts and for the sample: higher ones tell the same languages and take up to five times as long; lower ones for the sample let wrong sentences in.
LEVEL, FIT_LEVEL = 3, 9
#: Rounds of cleaning the sample, and the share of its bytes by which a sentence must be smaller than in the next language to stay in.
ROUNDS, CLEAR = 2, 0.1
#: Bytes that a change of language costs. The least margin to the next language, as a share of a segment's bytes, is half of what all but LOWEST of the
#: held-out sentences have that are in the language of their label, and at least MARGIN.
CHANGE, MARGIN, LOWEST = 4.0, 0.03, 0.01

#: Precedes everything that is compressed: it makes each block compressible, else zstandard would store short ones as they are.
_FILL = bytes(64)

_TAG = re.compile(r"<[^<>]*>")
_ASIDE = re.compile(r"\([^()]*\)|«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]")
_END = re.compile(r"(?<=[.!?])\s+")
_NOT_WORD = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d+")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: each ends with . ! or ? before white space or the end, tags aside."""
    if not text:
        return []
    return [s for s in (p.strip() for p in _END.split(_TAG.sub(" ", text))) if s]


def without_asides(sentence: str) -> str:
    """The sentence without what stands in brackets or quotation marks, such as titles in another language, if anything is left."""
    rest = _ASIDE.sub(" ", sentence)
    return rest if _NOT_WORD.sub("", rest) else sentence


def plain(sentence: str) -> bytes:
    """What is compressed: lower case without accents, figures, punctuation and asides."""
    s = unicodedata.normalize("NFKD", without_asides(sentence).casefold())
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = _NOT_WORD.sub(" ", _DIGITS.sub(" ", s)).strip()
    return f" {s} ".encode("utf-8", "replace") if s else b""


class Dictionaries(dict):
    """Dictionaries by language, and the least margin by which the best language must be ahead of the next."""

    margin: float = MARGIN


class Languages:
    """A compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.codes = sorted(dictionaries)
        self.margin = getattr(dictionaries, "margin", MARGIN)
        self.coders = []
        for code in self.codes:
            d = zstandard.ZstdCompressionDict(dictionaries[code], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(dictionaries[code]), source_size=256, write_content_size=False, write_dict_id=False, write_checksum=False)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def sizes(self, data: bytes) -> list[int]:
        data = _FILL + data
        return [len(c(data)) for c in self.coders]

    def best(self, data: bytes, margin: float = 1.0) -> str | None:
        s = self.sizes(data)
        if len(s) == 1:
            return self.codes[0]
        first, second = sorted(range(len(s)), key=s.__getitem__)[:2]
        return self.codes[first] if s[second] - s[first] >= margin else None

    def tag(self, parts: Sequence[str]) -> list[tuple[str | None, float | None]]:
        """(language, confidence) of each sentence; (None, None) for those without words, (None, confidence) for those that are rejected.

        The cheapest sequence of languages: what the encodings take, and CHANGE bytes for every change. A run of sentences in one language is
        rejected if it isn't ahead of the next language by the margin, a share of its bytes.
        """
        sized = [(i, self.sizes(d), len(d)) for i, p in enumerate(parts) if (d := plain(p))]
        out: list[tuple[str | None, float | None]] = [(None, None)] * len(parts)
        if not sized:
            return out
        k = len(self.codes)
        cost, back = list(map(float, sized[0][1])), []
        for _, s, _ in sized[1:]:
            low = min(range(k), key=cost.__getitem__)
            step = [low if cost[low] + CHANGE < cost[j] else j for j in range(k)]
            cost = [cost[step[j]] + (CHANGE if step[j] != j else 0) + s[j] for j in range(k)]
            back.append(step)
        at = min(range(k), key=cost.__getitem__)
        line = [at]
        for step in reversed(back):
            at = step[at]
            line.append(at)
        line.reverse()
        # a run's margin is that of its sum
        lo = 0
        while lo < len(line):
            hi = lo
            while hi < len(line) and line[hi] == line[lo]:
                hi += 1
            sums = [sum(sized[i][1][j] for i in range(lo, hi)) for j in range(k)]
            own = sums[line[lo]]
            rest = min((v for j, v in enumerate(sums) if j != line[lo]), default=own * 2)
            clear = k == 1 or rest - own >= self.margin * sum(sized[i][2] for i in range(lo, hi))
            for i in range(lo, hi):
                out[sized[i][0]] = (self.codes[line[lo]] if clear else None, max(0.0, 1 - own / rest))
            lo = hi
        return out

    def segments(self, text: str | None) -> list[tuple[int, int, str | None, float, str]]:
        """(number, first sentence, language, confidence, text) of each segment, the longest runs of sentences in one language.

        Sentences without words belong to the segment before them, or to the next one at the start. What is rejected is a segment of its own, without language.
        """
        parts = sentences(text)
        tags = self.tag(parts)
        out: list[list] = []
        for n, (p, (lang, conf)) in enumerate(zip(parts, tags), 1):
            if out and (conf is None or out[-1][3] is None or out[-1][2] == lang):
                seg = out[-1]
                seg[3] = conf if seg[3] is None else seg[3] if conf is None else max(seg[3], conf)
                seg[2] = seg[2] or lang
                seg[4] += " " + p
            else:
                out.append([len(out) + 1, n, lang, conf, p])
        return [(no, n, lang, conf or 0.0, text) for no, n, lang, conf, text in out]


def locale_code(locale: Column, locales: Sequence[tuple[str, str]]) -> Column:
    """The language that a locale names by its first part (code or code3), or null; case, region and blanks don't matter."""
    first = F.lower(F.regexp_extract(F.trim(locale), r"^\s*([A-Za-z]+)", 1))
    names = [x for code, code3 in locales for x in (F.lit(code.lower()), F.lit(code), F.lit(code3.lower()), F.lit(code))]
    return F.create_map(*names)[first] if names else F.lit(None).cast("string")


def _dictionary(parts: Sequence[bytes], size: int) -> bytes:
    """Distinct sentences, as many as there is room for, those that recur last: near offsets are cheap."""
    out, used = [], 0
    for p in dict.fromkeys(parts):
        if used + len(p) > size:
            break
        out.append(p)
        used += len(p)
    return b"".join(reversed(out))


def _sample(rows: DataFrame, keys: list[str], bound: int) -> list:
    """At most ``bound`` texts per language: of each of so many hash cells the one with the least hash, by partial aggregation."""
    h = F.xxhash64("text")
    cells = rows.withColumn("h", h).withColumn("cell", F.pmod("h", F.lit(bound)))
    return cells.groupBy(*keys, "cell").agg(F.min_by("text", F.struct("h", "text")).alias("text")).orderBy(*keys, "cell").collect()


def _cleaned(by: dict[str, list[list[bytes]]], kept: dict[str, list[list[bytes]]], size: int) -> dict[str, list[list[bytes]]]:
    """Of each half of ``by`` the sentences that dictionaries from the other half of ``kept`` find clearly in their language."""
    out: dict[str, list[list[bytes]]] = {k: [[], []] for k in by}
    for half in (0, 1):
        other = Languages({k: _dictionary(v[1 - half], size) or b" " * 8 for k, v in kept.items()}, FIT_LEVEL)
        for code, halves in by.items():
            out[code][half] = [d for d in halves[half] if other.best(d, CLEAR * len(d)) == code]
    return out


def fit(rows: DataFrame, text_col: str, lang_col: str, more: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS, size: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionaries by language from at most ``sample_rows`` labelled rows per language, and as many unlabelled ones of ``more`` (text_col).

    The sample is bounded, so it may come to the driver. Null texts, texts without letters and null labels aren't taken. The margin for rejection
    is taken from the held-out halves.
    """
    usable = "text is not null and text rlike '[a-zA-Z]'"
    labelled = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(usable).where("lang is not null")
    by: dict[str, list[list[bytes]]] = {}
    for n, r in enumerate(_sample(labelled, ["lang"], sample_rows)):
        halves = by.setdefault(r.lang, [[], []])
        halves[n % 2] += [d for s in sentences(r.text) if len(d := plain(s)) > 4]
    kept = _cleaned(by, by, size)
    if more is not None:
        # a text has all its sentences in the language of the whole, also those that no dictionary knows yet
        known = Languages({k: _dictionary(v[0] + v[1], size) or b" " * 8 for k, v in kept.items()}, FIT_LEVEL)
        for n, r in enumerate(_sample(more.select(F.col(text_col).alias("text")).where(usable), [], sample_rows) if by else []):
            parts = [d for s in sentences(r.text) if len(d := plain(s)) > 4]
            if parts and (code := known.best(b"".join(parts), CLEAR * sum(map(len, parts)))):
                by[code][n % 2] += parts
                kept[code][n % 2] += parts
    for _ in range(ROUNDS):
        kept = _cleaned(by, kept, size)
    out = Dictionaries({k: _dictionary(v[0] + v[1], size) for k, v in kept.items() if v[0] or v[1]})
    ahead = []  # by how much held-out sentences are ahead of the next language
    for half in (0, 1):
        other = Languages({k: _dictionary(v[1 - half], size) or b" " * 8 for k, v in kept.items()})
        for lang, halves in kept.items():
            for d in halves[half] if len(other.codes) > 1 else ():
                s = other.sizes(d)
                own = s[other.codes.index(lang)]
                if own == min(s):
                    ahead.append((sorted(s)[1] - own) / len(d))
    if ahead:
        out.margin = max(MARGIN, sorted(ahead)[int(LOWEST * len(ahead))] / 2)
    return out


def segments(rows: DataFrame, id_col: str, text_col: str, dictionaries: dict[str, bytes]) -> DataFrame:
    """(id, seg_no, first_sent, lang, confidence, text): the segments of each row's text, counted from 1.

    Null and empty texts have none; a text without words has one without language and confidence 0. Repeated rows
    are done each. Without dictionaries no segment has a language. Rows don't leave their partition; the
    dictionaries go with the task, at most DICTIONARY bytes a language.
    """
    kind = rows.select(id_col).schema[0].dataType.simpleString()
    model: list[Languages] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not model:
            model.append(Languages(dictionaries or {"": b"        "}))
        for b in batches:
            out = [(i, *s) for i, t in zip(b.iloc[:, 0], b.iloc[:, 1]) if isinstance(t, str) for s in model[0].segments(t)]
            done = pd.DataFrame(out, columns=[id_col, "seg_no", "first_sent", "lang", "confidence", "text"])
            if not dictionaries:
                done["lang"], done["confidence"] = None, 0.0
            yield done

    return rows.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, seg_no int, first_sent int, lang string, confidence double, text string")


def mislabelled(rows: DataFrame, id_col: str, label_col: str, segs: DataFrame) -> DataFrame:
    """The segments of texts whose label names no language, another than that of the text, or that have several languages.

    rows has one row per id; label_col holds the language that the label names, or null. Texts in which no segment has a language are none.
    """
    texts = segs.where("lang is not null").groupBy(id_col).agg(F.min("lang").alias("one"), F.max("lang").alias("other"))
    bad = rows.select(id_col, label_col).join(texts, id_col).where(F.col(label_col).isNull() | (F.col("one") != F.col("other")) | (F.col("one") != F.col(label_col)))
    return segs.join(bad.select(id_col), id_col, "left_semi")
