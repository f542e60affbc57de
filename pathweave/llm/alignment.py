"""Sentence alignment of texts with their rough translations in another language.

Method: a hidden Markov model. States are the source sentences, spans of two of them for merged sentences, and a null state for what was
added; the target sentences are emissions, a jump between source sentences costs by how likely its distance is, and the best path is
decoded. A sentence's emission weighs each word's translation against a language model of the target language, so that common
phrases count little, and names, figures and rare words much. It is taken over clauses, so a span emits its two parts in turn.

Texts are tagged and cut into words once (``prepared``). Lexicons are word translation models, and all texts count for them. A first one is had by EM in Spark over
co-occurring words, first in whole texts, then in the sentences that these align; pairs of languages without the most common source language are composed
through it. Then each target sentence counts with the source sentence that the first lexicon finds for it, as sums of expected translations
by word in partitions and then over all; what few sentences say is drawn towards the first lexicon. The language model counts all texts as well. The chances of jumps
and of the null state are counted over the decoded paths of all texts, in two rounds; emissions don't depend on them and are taken once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written
from .langid import Languages, sentences, without_asides

#: Rounds of EM over whole texts and over the sentences that these align.
TEXT_ROUNDS, SENTENCE_ROUNDS = 8, 6
#: Texts, or pairs of sentences, whose expected translations a task sums at a time; cells of the table that it holds for that, pairs of words that it
#: takes at once, and source words of a row of sums.
TEXTS, SENTENCES, CELLS, PIECE, ROWS = 4_000, 16_000, 8_000_000, 1_000_000, 64
#: Share of a word's likeliest translation from which on another is told apart in EM; the chance of those below is even.
APART = 0.01
#: What the first lexicon is worth, in pairs of sentences, beside those counted over all texts.
PRIOR = 3.0
#: How likely a translation must be, and how many pairs of sentences must have the word, if the first lexicon doesn't have it.
NEW, NEW_SEEN = 0.5, 12
#: Bounds of what goes to all tasks, per language: words that have translations, and successions of two words, the most frequent ones. A word beyond
#: has no translation and counts like a name, by itself; a succession beyond is taken for as likely as its second word.
LEXICON_WORDS, SUCCESSIONS = 50_000, 200_000
#: Rows of counts that a task holds before it hands them on.
HELD = 300_000
#: Pairs of sentences with a word from which on its translations are known.
SEEN = 3
#: Rounds in which the chances of jumps and of the null state are counted.
JUMP_ROUNDS = 2
#: Least log odds of a pair; least and most cost of leaving clauses out, which else is what they speak against the source; bounds of the weight of
#: a word without its translation, a figure and a name that aren't there, a name, a figure and a word that are.
LEAST, CUT, CUT_MOST = 3.5, 0.7, 2.5
#: Weight of a text's share of sentences without a source in the odds of each sentence.
NULL = 2.0
LOST, WRONG, SLIPPED, NAMED, COUNTED, MOST = -7.0, -5.0, -1.5, 2.5, 4.0, 4.0
TRUST = 0.9
LOG_LOST = math.log(1 - TRUST)
#: Jumps before any were counted: log odds, by distance (0: the next sentence; beyond 3 all alike), against the null state.
JUMPS = {0: 0.0, **{d: -min(2.0, 0.4 + 0.3 * math.log(1 + abs(d)) + (0.6 if d == -1 else 0)) for d in (-4, -3, -2, -1, 1, 2, 3, 4)}}

_TOKEN = re.compile(r"(?<!\d)\d{1,3}(?:[.,\s  ]\d{3})+(?!\d)|\d+|[^\W\d_]+|[,;:]")
_FIGURES = re.compile(r"\D+")


def tokens(sentence: str) -> list[str]:
    """Words in lower case without accents, figures without separators, and the marks between clauses."""
    s = unicodedata.normalize("NFKD", without_asides(sentence).casefold())
    s = "".join(c for c in s if not unicodedata.combining(c))
    return [_FIGURES.sub("", t) if t[0].isdigit() else t for t in _TOKEN.findall(s)]


def words(sentence: str) -> list[str]:
    return [t for t in tokens(sentence) if t not in ",;:"]


def near(a: str, b: str) -> bool:
    """One character more, less or other, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 2:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    return ra[1:] == rb[1:] or ra[1:] == rb or ra == rb[1:] or (len(ra) == len(rb) > 1 and ra[:2] == rb[1::-1] and ra[2:] == rb[2:])


@dataclass
class Lexicon:
    """tables: (source language, target language) -> word -> {translation: p}; lm: language -> bigram and word counts; names: words that stay as they are."""

    tables: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict)
    single: dict = field(default_factory=dict)
    names: set = field(default_factory=set)
    content: dict = field(default_factory=dict)
    jumps: dict = field(default_factory=lambda: dict(JUMPS))

    def close(self) -> Lexicon:
        """Translations relative to the best one of each word, and the words of each language that are translations of some word."""
        for pair, table in self.tables.items():
            self.names |= {w for w, row in table.items() if row.get(w, 0) >= 0.3 and max(row, key=row.get) == w}
            self.tables[pair] = {w: {t: 0.95 * p / max(row.values()) for t, p in row.items() if p > 0.25 * max(row.values())} for w, row in table.items()}
        for (_, b), table in self.tables.items():
            self.content.setdefault(b, set()).update(t for row in table.values() for t, p in row.items() if p > 0.5)
        for words_ in self.content.values():
            words_ -= self.names
        return self

    def predicted(self, lang: str, before: str, word: str, seen: Counter, n_seen: int) -> float:
        """How likely the word is to follow, as the language and the text at hand have it."""
        one = self.single.get(lang) or {}
        total = one.get("", 1)
        if word[0].isdigit():
            word, unit = "0", 0.004
        else:
            unit = 1.0
        p = (one.get(word, 0) + 0.05) / (total + 100)
        after = self.pairs.get(lang, {}).get(before)
        if after:
            p = (after.get(word, 0) + 2 * p) / (after[""] + 2)
        p *= unit
        if unit < 1 or word not in one or word in self.names:
            p = 0.6 * p + 0.4 * max(0, seen[word if unit == 1 else ""] - 1) / max(1, n_seen)
        return min(0.98, max(1e-6, p))


@dataclass
class Table:
    """p(target word | source word) by number; word 0 is the empty source word. Of each source word, what each other translation has, and the texts with it."""

    source: np.ndarray
    target: np.ndarray
    p: np.ndarray
    rest: np.ndarray
    docs: np.ndarray

    def dense(self, lo: int, hi: int) -> np.ndarray:
        """All source words by the target words from lo to hi."""
        out = np.repeat(self.rest[:, None], hi - lo, axis=1)
        here = (self.target >= lo) & (self.target < hi)
        out[self.source[here], self.target[here] - lo] = self.p[here]
        return out

    def sparse(self, src: list[str], tgt: list[str], keep: int = 12, least: float = 0.03) -> dict[str, dict[str, float]]:
        out: dict[str, dict[str, float]] = defaultdict(dict)
        some = np.flatnonzero((self.source > 0) & (self.p >= least))
        for i in some[np.lexsort((self.target[some], -self.p[some], self.source[some]))]:
            if len(row := out[src[self.source[i] - 1]]) < keep:
                row[tgt[self.target[i]]] = float(self.p[i])
        return dict(out)

    def close(self, src: list[str], tgt: list[str], least: float = 0.3) -> dict[str, dict[str, float]]:
        """How near each translation comes to the best one."""
        best = np.zeros(len(self.rest), dtype=np.float32)
        np.maximum.at(best, self.source, self.p)
        out: dict[str, dict[str, float]] = defaultdict(dict)
        for i in np.flatnonzero((self.source > 0) & (self.p >= least * best[self.source])):
            out[src[self.source[i] - 1]][tgt[self.target[i]]] = float(self.p[i] / best[self.source[i]])
        return dict(out)


def _sums(docs: DataFrame, sizes: dict[str, int], tables: dict[tuple[str, str], Table]) -> DataFrame:
    """(a, b, block, at, n): expected translations summed over docs, by ROWS source words; of each word also the docs with it and the sum of all its translations, after the last target word."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def summed(a: str, b: str, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        n_s, n_t, table = sizes[a] + 1, sizes[b], shared.value.get((a, b))
        width = max(1, CELLS // n_s)
        s_all, t_all = np.concatenate([s for s, _ in held]), np.concatenate([t for _, t in held])
        s_len, t_len = (np.array([len(d[k]) for d in held]) for k in (0, 1))
        seen, s_from, doc = np.bincount(s_all, minlength=n_s), np.cumsum(s_len) - s_len, np.repeat(np.arange(len(held)), t_len)
        for lo in range(0, n_t, width):
            w = min(n_t, lo + width) - lo
            p = table.dense(lo, lo + w).ravel() if table else np.ones(n_s * w, dtype=np.float32)
            count = np.zeros(n_s * w)
            here = (t_all >= lo) & (t_all < lo + w)
            t, n, at_s = t_all[here] - lo, s_len[doc[here]], s_from[doc[here]]
            end = np.cumsum(n)
            k = 0
            while k < len(t):  # each target word with all source words of its text
                stop = max(k + 1, int(np.searchsorted(end, end[k] - n[k] + PIECE, "right")))
                own, start = n[k:stop], end[k:stop] - n[k:stop] - (end[k] - n[k])
                at = s_all[np.repeat(at_s[k:stop] - start, own) + np.arange(own.sum())] * w + np.repeat(t[k:stop], own)
                part = p[at]
                part /= np.repeat(np.add.reduceat(part, start), own)
                count += np.bincount(at, part, len(count))
                k = stop
            count = count.reshape(n_s, w)
            least = 0.1 * APART * count.max(axis=1, keepdims=True)
            least[0] = 0
            rows = []
            for block in range(0, n_s, ROWS):
                own = count[block : block + ROWS]
                i, j = np.nonzero((own > 0) & (own >= least[block : block + ROWS]))
                k = np.arange(len(own)) * (n_t + 2) + n_t
                at = np.concatenate([i * (n_t + 2) + j + lo, k, k + 1]).astype(np.int32)
                n = np.concatenate([own[i, j], seen[block : block + ROWS] if lo == 0 else np.zeros(len(own)), own.sum(axis=1)]).astype(np.float32)
                rows.append((a, b, block, at.tobytes(), n.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["a", "b", "block", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []
        for batch in batches:
            for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((a, b) != pair or len(held) >= SENTENCES):
                    yield from summed(*pair, held)
                    held = []
                pair = a, b
                held.append((np.frombuffer(s, np.int32), np.frombuffer(t, np.int32)))
        if held:
            yield from summed(*pair, held)

    return docs.mapInArrow(run, "a string, b string, block int, at binary, n binary")


def _em(docs: DataFrame, sizes: dict[str, int], tables: dict[tuple[str, str], Table], rounds: int) -> dict[tuple[str, str], Table]:
    """Tables by pair of languages after rounds of EM over all docs (a, b, s, t: the numbers of their words), from ``tables`` or from even chances.

    To the driver and to all tasks go the translations that APART tells apart, of as many words as ``sizes`` has.
    """

    def merged(key: tuple, pieces: pa.Table) -> pa.Table:
        a, b, block = (x.as_py() for x in key)
        n_t, n_s = sizes[b], min(ROWS, sizes[a] + 1 - key[2].as_py())
        c = np.zeros(n_s * (n_t + 2))
        for at, n in sorted(zip(pieces["at"].to_pylist(), pieces["n"].to_pylist())):
            c[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.float32)
        c = c.reshape(n_s, n_t + 2)
        p = c[:, :n_t] / np.maximum(c[:, n_t + 1 :], 1e-9)
        least = APART * p.max(axis=1, keepdims=True)
        if block == 0:
            least[0] = 0
        kept = (p > 0) & (p >= least)
        i, j = np.nonzero(kept)
        rest = np.maximum(1e-9, (1 - np.where(kept, p, 0).sum(axis=1)) / np.maximum(1, n_t - kept.sum(axis=1)))
        packed = [(i + block).astype(np.int32), j.astype(np.int32), p[i, j].astype(np.float32), rest.astype(np.float32), c[:, n_t].astype(np.float32)]
        return pa.Table.from_pydict({"a": [a], "b": [b], "block": pa.array([block], pa.int32()), **{k: [x.tobytes()] for k, x in zip(("s", "t", "p", "rest", "docs"), packed)}})

    for _ in range(rounds):
        done = _sums(docs, sizes, tables).groupBy("a", "b", "block").applyInArrow(merged, "a string, b string, block int, s binary, t binary, p binary, rest binary, docs binary")
        parts: dict[tuple[str, str], list] = defaultdict(list)
        for a, b, block, *columns in _columns(done, "a", "b", "block", "s", "t", "p", "rest", "docs"):
            parts[a, b].append((block, columns))
        tables = {}
        for pair, rows in parts.items():
            rows.sort()
            tables[pair] = Table(*(np.frombuffer(b"".join(c[k] for _, c in rows), kind) for k, kind in enumerate((np.int32, np.int32, np.float32, np.float32, np.float32))))
    return tables


def _spread(docs: DataFrame, each: int) -> DataFrame:
    """Docs by pair of languages, in parts of about ``each``: the fewer parts, the fewer sums of the same words."""
    parts = {(r.a, r.b): -(-r.n // each) for r in docs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per pair of languages
    if not parts:
        return docs
    key = F.create_map(*[F.lit(x) for (a, b), k in parts.items() for x in (f"{a}\t{b}", k)])[F.concat_ws("\t", "a", "b")]
    return docs.withColumn("part", F.pmod(F.xxhash64("s", "t"), key)).repartition(max(2, sum(parts.values())), "a", "b", "part").sortWithinPartitions("a", "b", "part").drop("part")


def _vocabularies(texts: DataFrame) -> dict[str, list[str]]:
    """The words of each language that two texts have, the most frequent ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            cols = list(zip(*((*k, v) for k, v in n.items())))
            n.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["a", "x", "n"])

        for batch in batches:
            for s_tags, s_toks, s_lang, t_tags, t_toks, t_lang in zip(*(c.to_pylist() for c in batch.columns)):
                for lang, tags, toks in ((s_lang, s_tags, s_toks), (t_lang, t_tags, t_toks)):
                    n.update({(lang, w) for s in _words_in(lang, *_unpacked(tags, toks)) for w in s if not w[0].isdigit()})
                if len(n) > HELD:
                    yield out()
        if n:
            yield out()

    counted = texts.select("s_tags", "s_toks", "s_lang", "t_tags", "t_toks", "t_lang").mapInArrow(run, "a string, x string, n long").groupBy("a", "x").agg(F.sum("n").alias("n")).where("n >= 2")
    by = Window.partitionBy("a").orderBy(F.desc("n"), "x")
    made: dict[str, list] = defaultdict(list)
    for a, x, r in _columns(counted.withColumn("r", F.row_number().over(by)).where(F.col("r") <= LEXICON_WORDS), "a", "x", "r"):
        made[a].append((r, x))
    return {a: [x for _, x in sorted(rows)] for a, rows in made.items()}


def _docs(texts: DataFrame, numbers: dict[str, dict[str, int]], close: dict | None) -> DataFrame:
    """(a, b, s, t): the numbers of the words of whole texts, in both directions; with ``close``, of the pairs of sentences that belong together by it.

    close: (a, b) -> word -> how near each of its translations comes to the best one.
    """
    shared = texts.sparkSession.sparkContext.broadcast((numbers, close))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, near_by = shared.value
        for batch in batches:
            rows = []
            for s_tags, s_toks, s_lang, t_tags, t_toks, t_lang in zip(*(c.to_pylist() for c in batch.columns)):
                left, right = _words_in(s_lang, *_unpacked(s_tags, s_toks)), _words_in(t_lang, *_unpacked(t_tags, t_toks))
                for a, b, src, tgt in ((s_lang, t_lang, left, right), (t_lang, s_lang, right, left)):
                    for s, t in _paired(src, tgt, near_by.get((a, b), {}), ids.get(b, {})) if near_by is not None else [([w for x in src for w in x], [w for x in tgt for w in x])]:
                        i = sorted({ids[a][w] for w in s if w in ids.get(a, ())})
                        j = sorted({ids[b][w] for w in t if w in ids.get(b, ())})
                        if i and j:
                            rows.append((a, b, np.array([0, *(x + 1 for x in i)], np.int32).tobytes(), np.array(j, np.int32).tobytes()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.binary()))], ["a", "b", "s", "t"])

    return texts.select("s_tags", "s_toks", "s_lang", "t_tags", "t_toks", "t_lang").mapInArrow(run, "a string, b string, s binary, t binary")


def _paired(source: list[list[str]], target: list[list[str]], close: dict, known: dict[str, int]) -> Iterator[tuple[list[str], list[str]]]:
    """Each target sentence with the source sentence that most of its words come from, if half of them do."""
    made = [(_best(close, s), set(s)) for s in source]
    for t in target:
        top, at = 0.5 * len(t), None
        same = [w for w in set(t) if w[0].isdigit() or w not in known]
        for k, (best, bag) in enumerate(made):
            hit = sum(best.get(w, 0.0) for w in t) + sum(w in bag for w in same)
            if hit > top:
                top, at = hit, k
        if at is not None:
            yield source[at], t


def _direct(texts: DataFrame) -> dict[tuple[str, str], dict]:
    """Tables from all texts, which are of two languages each, for these languages in both directions."""
    vocab = _vocabularies(texts)
    sizes, numbers = {a: len(v) for a, v in vocab.items()}, {a: {w: i for i, w in enumerate(v)} for a, v in vocab.items()}
    whole = _em(written(_spread(written(_docs(texts, numbers, None), "words"), TEXTS), "words"), sizes, {}, TEXT_ROUNDS)
    close = {(a, b): table.close(vocab[a], vocab[b]) for (a, b), table in whole.items()}
    fine = _em(written(_spread(written(_docs(texts, numbers, close), "paired"), SENTENCES), "paired"), sizes, whole, SENTENCE_ROUNDS)
    out = {}
    for (a, b), table in whole.items():
        # a word needs some occurrences; one that too few pairs of sentences have keeps what whole texts say, if enough texts have it
        in_pairs = fine[a, b].docs if (a, b) in fine else np.zeros(len(table.docs))
        few = {w for i, w in enumerate(vocab[a], 1) if in_pairs[i] < SEEN}
        often = {w for i, w in enumerate(vocab[a], 1) if table.docs[i] >= 4 * SEEN}
        out[a, b] = {w: r for w, r in table.sparse(vocab[a], vocab[b]).items() if w in few and w in often}
        if (a, b) in fine:
            out[a, b] |= {w: r for w, r in fine[a, b].sparse(vocab[a], vocab[b]).items() if w not in few}
    return out


def _compose(first: dict, second: dict, keep: int = 12, least: float = 0.03) -> dict:
    out = {}
    for a, row in first.items():
        c: Counter = Counter()
        for h, p in row.items():
            for b, q in second.get(h, {}).items():
                c[b] += p * q
        kept = {b: min(1.0, p) for b, p in c.most_common(keep) if p >= least}
        if kept:
            out[a] = kept
    return out


def _tables(texts: DataFrame, hub: str) -> dict:
    """First tables of all pairs of languages, from all texts; those without the hub go through it."""
    langs = sorted({x for r in texts.select("s_lang", "t_lang").distinct().collect() for x in r})  # a row per pair of languages
    told = _direct(texts.where((F.col("s_lang") == hub) | (F.col("t_lang") == hub)))
    out = {pair: told.get(pair, {}) for a in langs for b in langs if a != b and hub in (pair := (a, b))}
    for a in langs:
        for b in langs:
            if a != b and hub not in (a, b):
                out[a, b] = _compose(out[a, hub], out[hub, b])
    return out


def _packed(text: str, model: Languages) -> tuple[str, str, str | None]:
    """A text's languages by sentence and tokens by sentence, each as one string, and the language of most of its sentences."""
    parts = sentences(text)
    tags = [x or "" for x, _ in model.tag(parts)]
    most = Counter(x for x in tags if x).most_common(1)
    return "\t".join(tags), "\t".join(" ".join(tokens(p)) for p in parts), most[0][0] if most else None


def _unpacked(tags: str, toks: str) -> tuple[list[str | None], list[list[str]]]:
    return [x or None for x in tags.split("\t")], [t.split(" ") if t else [] for t in toks.split("\t")]


_PREPARED = "s_tags string, s_toks string, s_lang string, t_tags string, t_toks string, t_lang string"


def prepared(pairs: DataFrame, id_col: str, dictionaries: dict[str, bytes]) -> DataFrame:
    """(id, s_tags, s_toks, s_lang, t_tags, t_toks, t_lang) of rows (id, source, target): tagged and cut into words; rows with a null or empty side are left out."""
    kind = pairs.select(id_col).schema[0].dataType.simpleString()
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Languages(dictionaries or {"": b"        "}))
            made.append(lru_cache(4096)(lambda t: _packed(t, made[0])))  # a source has several targets
        for b in batches:
            rows = [(i, *made[1](s), *_packed(t, made[0])) for i, s, t in zip(*(c.to_pylist() for c in b.columns)) if sentences(s) and sentences(t)]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), *[pa.array(c, pa.string()) for c in cols[1:]]], [id_col, *(x.split()[0] for x in _PREPARED.split(", "))])

    return pairs.select(id_col, "source", "target").mapInArrow(run, f"`{id_col}` {kind}, {_PREPARED}")


def _words_in(lang: str, tags: list, toks: list) -> list[list[str]]:
    return [[t for t in ts if t not in ",;:"] for ts, x in zip(toks, tags) if x == lang]


def _best(table: dict, source: Iterable[str]) -> dict[str, float]:
    """What the words of a source sentence may become, at best how likely."""
    best: dict[str, float] = {}
    for w in source:
        for t, p in table.get(w, {}).items():
            if p > best.get(t, 0.0):
                best[t] = p
    return best


def _counts(texts: DataFrame, first: dict, known: dict) -> DataFrame:
    """(kind, a, b, x, y, n) summed over all texts: "t" expected translations of x as y and "s" sentences with x, from language a to b, in sentences that belong
    together by the first lexicon; "w" and "g" words y, alone and after x, of language a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, float] = defaultdict(float)

        def out() -> pa.RecordBatch:
            rows = list(zip(*((*k, v) for k, v in sums.items())))
            sums.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in rows[:5]], pa.array(rows[5], pa.float64())], ["kind", "a", "b", "x", "y", "n"])

        for batch in batches:
            for s_tags, s_toks, t_tags, t_toks in zip(*(c.to_pylist() for c in batch.columns)):
                (tags_s, toks_s), (tags_t, toks_t) = _unpacked(s_tags, s_toks), _unpacked(t_tags, t_toks)
                for tags, toks in ((tags_s, toks_s), (tags_t, toks_t)):
                    for lang, ts in zip(tags, toks):
                        before = "."
                        for t in ts if lang else ():
                            t = "0" if t[0].isdigit() else t
                            sums["g", lang, "", before, t] += 1
                            sums["w", lang, "", "", t] += 1
                            before = t
                sources = [(a, [t for t in dict.fromkeys(ts) if t not in ",;:"]) for a, ts in zip(tags_s, toks_s) if a]
                made: dict = {}
                for b, ts in zip(tags_t, toks_t):
                    targets = [t for t in dict.fromkeys(ts) if t not in ",;:"] if b else []
                    top, at = 0.5 * len(targets), None
                    for k, (a, ws) in enumerate(sources if targets else ()):
                        if a == b or (a, b) not in first:
                            continue
                        if (k, b) not in made:
                            made[k, b] = _best(first[a, b], ws), set(ws)
                        best, bag = made[k, b]
                        vocab = known.get(b, ())
                        hit = sum(best.get(t, 0.0) if t in vocab else 1.0 if t in bag else 0.0 for t in targets)
                        if hit > top:
                            top, at = hit, k
                    if at is None:
                        continue
                    a, ws = sources[at]
                    table = first[a, b]
                    ws = [w for w in ws if not w[0].isdigit()]
                    bag = set(ws)
                    for t in targets:
                        if not t[0].isdigit():
                            if t in bag:
                                continue  # it stays as it is
                            odds = [(w, table.get(w, {}).get(t, 0.002)) for w in ws]
                            total = sum(p for _, p in odds) + 0.02
                            for w, p in odds:
                                if p >= 0.1 * total:
                                    sums["t", a, b, w, t] += p / total
                    for w in ws:
                        sums["s", a, b, w, ""] += 1
            if len(sums) > HELD:
                yield out()
        if sums:
            yield out()

    return texts.select("s_tags", "s_toks", "t_tags", "t_toks").mapInArrow(run, "kind string, a string, b string, x string, y string, n double").groupBy("kind", "a", "b", "x", "y").agg(F.sum("n").alias("n"))


def _drawn(first: dict, counted: dict, seen: dict) -> dict:
    """Translations by the counts over all texts, drawn towards the first lexicon; a word that it doesn't have needs a translation that is likely by the counts alone."""
    out = {pair: dict(table) for pair, table in first.items()}
    for pair, table in counted.items():
        for w, row in table.items():
            before, n = first.get(pair, {}).get(w), seen[(*pair, w)]
            if before is not None:
                out[pair][w] = {t: (row.get(t, 0.0) + PRIOR * p) / (n + PRIOR) for t, p in before.items()}
            elif n >= NEW_SEEN and (kept := {t: m / n for t, m in row.items() if m >= NEW * n}):
                out.setdefault(pair, {})[w] = kept
    return out


def _columns(df: DataFrame, *names: str) -> Iterator[tuple]:
    """Rows of bounded results, by way of columns: a fraction of the memory of row objects."""
    for batch in df.select(*names).toArrow().to_batches(max_chunksize=10_000):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _learnt(texts: DataFrame) -> Lexicon:
    """A lexicon from prepared texts, all of them, without chances of jumps.

    Languages are those found in the texts. To the driver come the translations that count and the most frequent successions of words.
    """
    told = texts.where("s_lang is not null and t_lang is not null and s_lang != t_lang")
    many = sorted(((r.n, r.s_lang) for r in told.groupBy("s_lang").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # a row per language
    out = Lexicon()
    first = _tables(told, many[0][1]) if many else {}
    scaled = {pair: {w: {t: p / max(row.values()) for t, p in row.items() if p >= 0.3 * max(row.values())} for w, row in table.items()} for pair, table in first.items()}
    known: dict[str, set] = defaultdict(set)
    for (_, b), table in first.items():
        known[b].update(t for row in table.values() for t in row)
    counts = written(_counts(texts, scaled, dict(known)), "counts")
    by = Window.partitionBy("a", "b").orderBy(F.desc("n"), "x")
    often = counts.where((F.col("kind") == "s") & (F.col("n") >= SEEN)).withColumn("r", F.row_number().over(by)).where(F.col("r") <= LEXICON_WORDS).select("a", "b", "x", F.col("n").alias("seen"))
    best = counts.where("kind = 't'").join(often, ["a", "b", "x"]).where(F.col("n") >= 0.02 * F.col("seen"))
    new: dict = defaultdict(lambda: defaultdict(dict))
    weight: dict = {}
    for a, b, x, y, n, seen in _columns(best, "a", "b", "x", "y", "n", "seen"):
        new[a, b][x][y] = n
        weight[a, b, x] = seen
    out.tables = _drawn(first, {pair: dict(table) for pair, table in new.items()}, weight)
    words_ = counts.where("kind = 'w'").withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "y"))).where(F.col("r") <= SUCCESSIONS)
    totals = {r.a: r.n for r in counts.where("kind = 'w'").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    single: dict = defaultdict(dict)
    for a, y, n in _columns(words_, "a", "y", "n"):
        single[a][y] = n
    out.single = {lang: {**c, "": totals[lang]} for lang, c in single.items()}
    after = counts.where("kind = 'g'")
    sums = after.groupBy("a", "x").agg(F.sum("n").alias("all"))
    pairs_: dict = defaultdict(lambda: defaultdict(dict))
    ranked = after.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "x", "y"))).where(F.col("r") <= SUCCESSIONS)
    for a, x, y, n, every in _columns(ranked.join(sums, ["a", "x"]), "a", "x", "y", "n", "all"):
        pairs_[a][x][y] = n
        pairs_[a][x][""] = every
    out.pairs = {lang: dict(x) for lang, x in pairs_.items()}
    return out.close()


def fit(texts: DataFrame) -> Lexicon:
    """A lexicon from prepared texts, all of them, with the chances of jumps in their decoded paths."""
    out = _learnt(texts)
    out.jumps = _jumps(written(_scored(texts.withColumn("no", F.lit(0)), "no", out), "scored"), out)
    return out


class Aligner:
    def __init__(self, lexicon: Lexicon):
        self.lex = lexicon

    def _weights(self, target: list[str], lang: str, sources: list[tuple[dict, set[str]]], seen: Counter, n_seen: int, nearby: dict) -> np.ndarray:
        """Log odds of each target token, given each source sentence (what its words may become, its words), against what the language model expects; marks weigh nothing."""
        lex, before = self.lex, "."
        out = np.zeros((len(sources), len(target)))
        content = lex.content.get(lang, ())
        for j, t in enumerate(target):
            figure = t[0].isdigit()
            if t not in ",;:":
                p0 = lex.predicted(lang, before, t, seen, n_seen)
                known = not figure and t in content
                by_itself = not known or len(t) > 3
                if not known:
                    if t not in nearby:
                        if "" not in nearby:
                            sized = nearby[""] = defaultdict(list)
                            for s in set().union(*(bag for _, bag in sources)):
                                sized[s[0].isdigit(), len(s)].append(s)
                        nearby[t] = {s for n in (-1, 0, 1) for s in nearby[""].get((figure, len(t) + n), ()) if near(t, s)}
                    slips = nearby[t]
                log, top = {}, MOST if known else COUNTED if figure else NAMED
                for i, (told, bag) in enumerate(sources):
                    p = 0.98 if by_itself and t in bag else told.get(t, 0.0) if known else 0.15 if slips and not slips.isdisjoint(bag) else 0.0
                    w = log.get(p)
                    if w is None:
                        w = math.log(TRUST * p / p0 + 1 - TRUST)
                        if known:
                            w = min(MOST, w if w > 0 else w / LOG_LOST * LOST)
                        else:
                            w = WRONG if figure and not p else min(top, max(SLIPPED, w))
                        w = log[p] = (1 - p0) * w  # a word that had to follow says nothing
                    out[i, j] = w
            before = "0" if figure else t
        return out

    def path(self, tags_l: list, toks_l: list, tags_r: list, toks_r: list) -> list[tuple[int, ...]]:
        """The source sentences of each target sentence: none, one, or the two of a span."""
        return self.best(self.states(tags_l, toks_l, tags_r, toks_r))

    def states(self, tags_l: list, toks_l: list, tags_r: list, toks_r: list) -> list[list[tuple[float, tuple[int, ...]]]]:
        """Of each target sentence the source sentences that it may have, the null state first, and its emissions."""
        bags = [{t for t in ts if t not in ",;:"} for ts in toks_l]
        seen = Counter("" if t[0].isdigit() else t for ts in toks_r for t in ts)
        n_seen = sum(seen.values())
        told: dict = {}
        nearby: dict = {}
        states: list[list[tuple[float, tuple[int, ...]]]] = []
        for ts, lang in zip(toks_r, tags_r):
            own: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
            fits = [i for i, (x, bag) in enumerate(zip(tags_l, bags)) if lang and x and x != lang and bag]
            if fits and ts:
                for i in fits:
                    if (i, lang) not in told:
                        told[i, lang] = _best(self.lex.tables.get((tags_l[i], lang), {}), bags[i])
                near_ = nearby.setdefault((lang, tuple(fits)), {})
                w = self._weights(ts, lang, [(told[i, lang], bags[i]) for i in fits], seen, n_seen, near_)
                edges = [0, *(j + 1 for j, t in enumerate(ts) if t in ",;:" and 0 < j < len(ts) - 1), len(ts)]
                clause = np.add.reduceat(w, edges[:-1], axis=1) if len(edges) > 2 else w.sum(axis=1, keepdims=True)
                best_left = self._ranges(clause)
                whole = best_left[:, -1].tolist()
                own += [(whole[k], (i,)) for k, i in enumerate(fits) if whole[k] >= LEAST]
                if clause.shape[1] > 1:
                    best_right = self._ranges(clause[:, ::-1])[:, ::-1]
                # spans of two: one emits the clauses up to a cut, the other the rest
                for c in range(1, clause.shape[1]):
                    a, b = best_left[:, c - 1], best_right[:, c]
                    for k in np.flatnonzero(a >= LEAST):
                        for m in np.flatnonzero(b >= LEAST):
                            if k != m:
                                own.append((float(a[k] + b[m]) - CUT, (fits[k], fits[m])))
            states.append(own)
        return states

    def best(self, states: list[list[tuple[float, tuple[int, ...]]]]) -> list[tuple[int, ...]]:
        path = self._decode(states)
        # where few sentences have a source the null state is more likely for each: decoded again with that
        filled = (sum(bool(s) for s in path) + 1) / (len(path) + 2)
        if (more := NULL * math.log((1 - filled) / filled)) > 0:
            path = self._decode([[(e - more * len(s), s) for e, s in own if not s or e - more * len(s) >= LEAST * len(s)] for own in states])
        return path

    @staticmethod
    def _ranges(clause: np.ndarray) -> np.ndarray:
        """For each source and number of clauses from the left: the best run of clauses among them, less the cost of what is left out at either end."""
        rows, n = clause.shape
        if n == 1:
            return clause
        out = np.full((rows, n), -np.inf)
        sums = np.concatenate([np.zeros((rows, 1)), np.cumsum(clause, axis=1)], axis=1)
        for hi in range(1, n + 1):
            for lo in range(hi):
                v = sums[:, hi] - sums[:, lo]
                if lo:
                    v = v - np.clip(-sums[:, lo], CUT, CUT_MOST)
                for end in range(hi, n + 1):
                    w = v - np.clip(sums[:, hi] - sums[:, end], CUT, CUT_MOST) if end > hi else v
                    out[:, end - 1] = np.maximum(out[:, end - 1], w)
        return out

    def _decode(self, states: list[list[tuple[float, tuple[int, ...]]]]) -> list[tuple[int, ...]]:
        """The best path: emissions plus jumps between the last source of one sentence and the first of the next; null keeps the place."""

        jumps = self.lex.jumps

        def jump(a: int, b: int) -> float:
            return jumps[max(-4, min(4, b - a - 1))]

        paths: dict[int, tuple[float, tuple | None]] = {-1: (0.0, None)}  # by place: score, chain
        for own in states:
            new: dict[int, tuple[float, tuple | None]] = {}
            for place, (score, chain) in paths.items():
                for emission, span in own:
                    s = score + emission + (jump(place, span[0]) + (jump(span[0], span[1]) if len(span) > 1 else 0) if span else 0.0)
                    end = span[-1] if span else place
                    if end not in new or s > new[end][0]:
                        new[end] = (s, (chain, span))
            paths = new
        _, chain = max(paths.values(), key=lambda x: x[0])
        out = []
        while chain is not None:
            chain, span = chain[0], chain[1]
            out.append(span)
        return out[::-1]


_SCORED = "told boolean, sizes binary, odds binary, spans binary"


def _scored(texts: DataFrame, id_col: str, lexicon: Lexicon) -> DataFrame:
    """(id, told, sizes, odds, spans): the states of each text but for the null state, by target sentence; told: both sides have a language of their own.

    The lexicon goes with the task, its size bounded by LEXICON_WORDS and SUCCESSIONS.
    """
    kind = texts.select(id_col).schema[0].dataType.simpleString()
    made: list[Aligner] = []
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Aligner(shared.value))
        for b in batches:
            rows = []
            for i, s_tags, s_toks, s_lang, t_tags, t_toks, t_lang in zip(*(c.to_pylist() for c in b.columns)):
                states = [own[1:] for own in made[0].states(*_unpacked(s_tags, s_toks), *_unpacked(t_tags, t_toks))]
                spans = np.array([(*span, -1)[:2] for own in states for _, span in own], np.int32)
                rows.append((i, bool(s_lang and t_lang and s_lang != t_lang), np.array([*map(len, states)], np.int32).tobytes(), np.array([e for own in states for e, _ in own], np.float64).tobytes(), spans.tobytes()))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (b.column(0).type, pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds)], [id_col, *(x.split()[0] for x in _SCORED.split(", "))])

    return texts.select(id_col, "s_tags", "s_toks", "s_lang", "t_tags", "t_toks", "t_lang").mapInArrow(run, f"`{id_col}` {kind}, {_SCORED}")


def _states(sizes: bytes, odds: bytes, spans: bytes) -> list[list[tuple[float, tuple[int, ...]]]]:
    own = iter(zip(np.frombuffer(odds, np.float64).tolist(), np.frombuffer(spans, np.int32).reshape(-1, 2).tolist()))
    return [[(0.0, ()), *((e, (i,) if j < 0 else (i, j)) for e, (i, j) in islice(own, n))] for n in np.frombuffer(sizes, np.int32).tolist()]


def _jumps(scored: DataFrame, lexicon: Lexicon) -> dict[int, float]:
    """Log odds of a sentence with a source, by where it lies, against one without, counted over the decoded paths of all texts."""

    def counter(aligner: Aligner):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for b in batches:
                for x in zip(*(c.to_pylist() for c in b.columns)):
                    place = -1
                    for span in aligner.best(_states(*x)):
                        seen[None] += not span
                        for i in span:
                            seen[max(-4, min(4, i - place - 1))] += 1
                            place = i
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int32()), pa.array(seen.values(), pa.int64())], ["d", "n"])

        return run

    jumps = lexicon.jumps
    for _ in range(JUMP_ROUNDS):
        told = scored.where("told").select("sizes", "odds", "spans")
        counts = told.mapInArrow(counter(Aligner(Lexicon(jumps=jumps))), "d int, n long").groupBy("d").agg(F.sum("n").alias("n"))
        seen = dict.fromkeys([None, *JUMPS], 1.0)
        for r in counts.collect():  # ten rows
            seen[r.d] += r.n
        none = seen.pop(None)
        jumps = {d: math.log(n / none) for d, n in seen.items()}
    return jumps


def _decoded(scored: DataFrame, id_col: str, jumps: dict[int, float]) -> DataFrame:
    kind = scored.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Lexicon(jumps=jumps))
        for b in batches:
            ids, left, right = [], [], []
            for i, *x in zip(*(c.to_pylist() for c in b.columns)):
                for j, span in enumerate(aligner.best(_states(*x)), 1):
                    for k in dict.fromkeys(span):
                        ids.append(i)
                        left.append(k + 1)
                        right.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(left, pa.int32()), pa.array(right, pa.int32())], [id_col, "source_sent", "target_sent"])

    return scored.select(id_col, "sizes", "odds", "spans").mapInArrow(run, f"`{id_col}` {kind}, source_sent int, target_sent int")


def align(texts: DataFrame, id_col: str, lexicon: Lexicon) -> DataFrame:
    """(id, source_sent, target_sent) for prepared texts; sentences count from 1, a merged one gives a row per part.

    Texts with a null or empty side, in the same language or about something else give none. Repeated rows are aligned each. Rows don't leave their partition.
    """
    return _decoded(_scored(texts, id_col, lexicon), id_col, lexicon.jumps)


def align_all(texts: DataFrame, id_col: str) -> DataFrame:
    """``align`` with the lexicon that is fitted to the texts themselves, whose emissions are taken once."""
    lexicon = _learnt(texts)
    scored = written(_scored(texts, id_col, lexicon), "scored")
    return _decoded(scored, id_col, _jumps(scored, lexicon))
