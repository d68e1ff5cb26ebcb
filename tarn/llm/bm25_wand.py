"""Benchmark decontamination by a BM25 inverted index with block-max WAND.

The benchmark's items are indexed in parts of at most ``PART`` words; every passage of every document
is a query. A part's score is the share of its own full BM25 score that the passage reaches, so one
threshold serves parts of any length. Parts lie in small blocks, and a term has a bound in each block
where it occurs.

The search is that of block-max WAND, taken for many passages at a time. A passage's terms come in the
order of their bounds up to a pivot; those before the pivot can't reach the threshold by themselves, so
their (long) postings aren't walked. The block bounds of the terms from the pivot on are summed,
and a block is alive if they reach the threshold with all that the terms before the pivot could add. Of
these, cursors are moved to live blocks alone; where the bounds still reach the threshold, postings are
scored. Nothing is lost: see the brute force in the tests, which also counts what is touched.

Parts that reach the threshold are verified: the passage (for an item of several parts as much longer
as the item is) must hold enough of the question's word triples and of the answer's word pairs, or most of
the whole item's triples. Items of under ``LEAST_WORDS`` words must be there as an exact run of words.

Passages are ``2 * PART`` words from every ``PART``-th word on, so each run of ``PART`` words is within
one. Neither depends on other items, nor on how the index is cut into shards.

Scale: documents are searched where they lie, without a shuffle. The index is sent to executors in
shards of at most ``SHARD_ITEMS`` items and ``SHARD_CHARS`` characters (about), one pass for each;
frequencies of terms count over all shards. What a search holds at once is bounded by ``MOST_BOUNDS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat
from math import fsum, inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import importable, lasting, series_slices, slices

SHARD_ITEMS = 20_000
SHARD_CHARS = 16_000_000
K1, B = 1.2, 0.75
PART = 64
BLOCK = 8
#: Bounds that are held at once.
MOST_BOUNDS = 1_000_000
#: Terms before the pivot reach at most this share of the threshold.
BEFORE_PIVOT = 0.5
LEAST_WORDS = 5
_SLACK = 1e-9

_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_ANSWER = re.compile(r"(?:^|\s)(?:answer|a)\s*:", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation parts them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words: what comes before and after its last answer mark, or else its last sentences, or else its last quarter.

    The last sentences are as few as have ``LEAST_WORDS``, if as many words are before them.
    """
    marks = list(_ANSWER.finditer(text))
    if marks and (after := words(text[marks[-1].end() :])) and (before := words(text[: marks[-1].start()])):
        return before, after
    every = words(text)
    cut = len(every)
    for sentence in reversed(_SENTENCE.split(text)):
        cut -= len(words(sentence))
        if len(every) - cut >= LEAST_WORDS:
            break
    if cut < LEAST_WORDS:
        cut = len(every) - max(1, len(every) // 4)
    return every[:cut], every[cut:]


def grams(part: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """Runs of n words, or of all of them if there are fewer."""
    n = min(n, len(part))
    return {tuple(part[i : i + n]) for i in range(len(part) - n + 1)} if n else set()


def overlap(part: set[tuple[bytes, ...]], passage: list[bytes], runs: dict[int, set]) -> float:
    """The share of the part's runs of words that the passage has. runs: those of the passage, by length."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    if n not in runs:
        runs[n] = grams(passage, n)
    return len(part & runs[n]) / len(part)


def cut(n: int) -> list[tuple[int, int]]:
    """(start, stop) of the parts of an item of n words: one, or as many of about the same length as it takes."""
    k = -(-n // PART)
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of n numbers from each start."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def holds(run: list[bytes], passage: list[bytes]) -> bool:
    """Whether the passage has the run of words."""
    n = len(run)
    return any(passage[i : i + n] == run for i in range(len(passage) - n + 1))


class Index:
    """A shard of items: the postings of their parts, with gains as shares of each part's full score.

    Postings are in the order of term and part; an entry is those of a term in a block of ``BLOCK``
    parts, and has their largest gain as its bound.
    """

    def __init__(self, items: list[tuple[int | None, str]], n_parts: int, mean_words: float, frequency: dict[bytes, int]) -> None:
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.parts: list[tuple[int, int, int]] = []  # item, words of it before the part and after it
        self.terms: dict[bytes, int] = {}
        term, part, gain = [], [], []
        for k, text in enumerate(self.texts):
            every = words(text)
            for start, stop in cut(len(every)):
                counts: dict[bytes, int] = {}
                for x in every[start:stop]:
                    counts[x] = counts.get(x, 0) + 1
                norm = K1 * (1 - B + B * (stop - start) / mean_words)
                own = {x: float(np.log1p((n_parts - frequency[x] + 0.5) / (frequency[x] + 0.5)) * c * (K1 + 1) / (c + norm)) for x, c in counts.items()}
                total = fsum(own.values())
                for x, g in own.items():
                    term.append(self.terms.setdefault(x, len(self.terms)))
                    part.append(len(self.parts))
                    gain.append(g / total)
                self.parts.append((k, start, len(every) - stop))
        self.n_blocks = max(1, -(-len(self.parts) // BLOCK))
        order = np.lexsort((part, term))
        self.part, self.gain = np.array(part, np.int64)[order], np.array(gain)[order]
        key = np.array(term, np.int64)[order] * self.n_blocks + self.part // BLOCK
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.entry, self.entry_at = key[first], np.append(first, len(key))
        self.bounds = np.maximum.reduceat(self.gain, first) if len(key) else np.empty(0)
        self.term_at = np.searchsorted(self.entry, np.arange(len(self.terms) + 1) * self.n_blocks)
        self.term_bound = np.maximum.reduceat(self.bounds, self.term_at[:-1]) if len(key) else np.empty(0)
        self._checks: dict[int, tuple] = {}
        self.touched = 0

    def check(self, item: int) -> tuple[list[bytes], set, set, set]:
        """An item's words, and the runs of its question, its answer and the whole. A few are kept."""
        if item not in self._checks:
            if len(self._checks) >= 1000:
                self._checks.clear()
            every = words(self.texts[item])
            q, a = question_and_answer(self.texts[item])
            self._checks[item] = every, grams(q, 3), grams(a, 2), grams(every, 3)
        return self._checks[item]

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, part) of all parts whose score is at least the threshold. The pairs are distinct and in the order of passage."""
        found = [np.empty((2, 0), np.int64)]
        n = self.term_at[term + 1] - self.term_at[term]
        last = np.append(np.flatnonzero(passage[1:] != passage[:-1]) + 1, len(passage)) if len(passage) else []
        total, s = np.cumsum(n), 0
        while s < len(passage):  # as many passages as have so many bounds, one at least
            k = np.searchsorted(total[np.asarray(last) - 1], (total[s - 1] if s else 0) + MOST_BOUNDS, side="right")
            e = int(max(last[max(k - 1, 0)], last[np.searchsorted(last, s, side="right")]))
            found.append(self._search(passage[s:e], term[s:e], threshold - _SLACK))
            s = e
        return tuple(np.concatenate(found, axis=1))

    def _search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        base, passage = passage[0], passage - passage[0]
        order = np.lexsort((self.term_bound[term], passage))
        passage, term = passage[order], term[order]
        bound = self.term_bound[term]
        first = np.searchsorted(passage, np.arange(passage[-1] + 2))
        reach = np.cumsum(bound)
        before = reach - np.concatenate(([0.0], reach))[first[passage]] < BEFORE_PIVOT * threshold
        could = np.bincount(passage[before], weights=bound[before], minlength=len(first))
        # from the pivot on: the sum of the bounds in each block
        at, n = term[~before], self.term_at[term[~before] + 1] - self.term_at[term[~before]]
        entry = spread(self.term_at[at], n)
        key = np.repeat(passage[~before], n) * self.n_blocks + self.entry[entry] % self.n_blocks
        self.touched += len(entry)
        if not len(entry):
            return np.empty((2, 0), np.int64)
        order = np.argsort(key, kind="stable")
        key, entry = key[order], entry[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sums, size, key = np.add.reduceat(self.bounds[entry], new), np.diff(np.append(new, len(entry))), key[new]
        alive = sums + could[key // self.n_blocks] >= threshold
        entry, size, sums, key = entry[np.repeat(alive, size)], size[alive], sums[alive], key[alive]
        # before the pivot: the bounds in live blocks alone
        lazy = np.flatnonzero(before)  # in the order of passage
        low = np.searchsorted(passage[lazy], key // self.n_blocks)
        n = np.searchsorted(passage[lazy], key // self.n_blocks, side="right") - low
        which, wanted = np.repeat(np.arange(len(key)), n), term[lazy[spread(low, n)]] * self.n_blocks + np.repeat(key % self.n_blocks, n)
        there = np.minimum(np.searchsorted(self.entry, wanted), len(self.entry) - 1)
        hit = self.entry[there] == wanted
        which, there = which[hit], there[hit]
        self.touched += len(there)
        alive = sums + np.bincount(which, weights=self.bounds[there], minlength=len(key)) >= threshold
        # the postings of what is alive
        entry = np.concatenate([entry[np.repeat(alive, size)], there[alive[which]]])
        of = np.concatenate([np.repeat(key[alive], size[alive]), key[which[alive[which]]]]) // self.n_blocks
        n = self.entry_at[entry + 1] - self.entry_at[entry]
        posting = spread(self.entry_at[entry], n)
        self.touched += len(posting)
        key, where = np.unique(np.repeat(of, n) * len(self.parts) + self.part[posting], return_inverse=True)
        key = key[np.bincount(where, weights=self.gain[posting], minlength=len(key)) >= threshold]
        return np.stack([base + key // len(self.parts), key % len(self.parts)])

    def score(self, part: int, passage: list[bytes]) -> float:
        """A part's score for a passage; the same whatever else is in the shard."""
        gains = []
        for x in set(passage):
            if (t := self.terms.get(x)) is not None:
                low, high = self.entry_at[self.term_at[t]], self.entry_at[self.term_at[t + 1]]
                at = low + int(np.searchsorted(self.part[low:high], part))
                if at < high and self.part[at] == part:
                    gains.append(float(self.gain[at]))
        return fsum(gains)

    def leaks(self, texts: list[str | None], threshold: float, least_question: float, least_answer: float, least_whole: float = inf) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question and answer overlap) of verified items, the best passage of each.

        Both overlaps are enough, or that of the whole item is; a short item is there word for word.
        """
        if not self.parts:
            return []
        split = [words(t) for t in texts]
        n = np.array([len(w) for w in split])
        passages = np.maximum(-(-n // PART) - 1, 1)  # the last block of words is within the passage before
        firsts = np.cumsum(passages) - passages
        flat = np.fromiter(map(self.terms.get, chain.from_iterable(split), repeat(-1)), np.int64, int(n.sum()))
        block = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)) // PART
        low, most = np.repeat(firsts, n), np.repeat(passages, n) - 1
        known = flat >= 0
        flat, block, low, most = flat[known], block[known], low[known], most[known]
        both = np.concatenate([low + np.minimum(block, most), low + np.clip(block - 1, 0, most)])
        key = np.unique(both * len(self.terms) + np.concatenate([flat, flat]))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        last, runs = (-1, 0, 0), {}
        for b, part in zip(*(x.tolist() for x in self.search(key // len(self.terms), key % len(self.terms), threshold))):
            k = int(np.searchsorted(firsts, b, side="right")) - 1
            item, before, after = self.parts[part]
            at = (b - int(firsts[k])) * PART
            passage = split[k][at : at + 2 * PART]
            if (score := self.score(part, passage)) < threshold - _SLACK:
                continue
            every, question, answer, whole = self.check(item)
            if before or after:
                passage = split[k][max(0, at - before) : at + 2 * PART + after]
            if last != (b, before, after):
                last, runs = (b, before, after), {}
            q, a = overlap(question, passage, runs), overlap(answer, passage, runs)
            if len(every) < LEAST_WORDS:
                leaky = holds(every, passage)
            else:
                leaky = q >= least_question and a >= least_answer or overlap(whole, passage, runs) >= least_whole
            if leaky:
                best[k, item] = max(best.get((k, item), (0.0, 0.0, 0.0)), (score, q, a))
        return [(k, item, *x) for (k, item), x in sorted(best.items())]


def index_shards(benchmark: DataFrame, shard_items: int = SHARD_ITEMS, shard_chars: int = SHARD_CHARS) -> Iterator[Index]:
    """The index, shard by shard. Items without a word (also null ones) can't be anywhere and aren't indexed."""
    importable(benchmark.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if w := words(t):
                    parts = cut(len(w))
                    rows.append((i, t, len(w), len(parts), [x.decode("utf-8", "surrogatepass") for s, e in parts for x in dict.fromkeys(w[s:e])]))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item_id", "text", "n", "parts", "terms"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = lasting(items.mapInArrow(count, "item_id long, text string, n long, parts long, terms array<string>"))
    n_items, n_parts, n_words, n_chars = items.agg(F.count(F.lit(1)), F.sum("parts"), F.sum("n"), F.sum(F.length("text"))).first()
    if not n_items:
        return
    shards = max(-(-n_items // shard_items), -(-n_chars // shard_chars))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    frequency = lasting(items.select(F.explode("terms").alias("term")).groupBy("term").count())
    for k in range(shards):
        here = items.filter(shard == k)
        own = here.select(F.explode("terms").alias("term")).distinct().join(frequency, "term").toPandas()
        rows = sorted(((r.item_id, r.text) for r in here.select("item_id", "text").toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield Index(rows, n_parts, n_words / n_parts, {t.encode("utf-8", "surrogatepass"): c for t, c in zip(own["term"], own["count"])})


#: Chance matches that reach such a score have none of the question's triples; edited copies keep a share.
THRESHOLD, LEAST_QUESTION, LEAST_ANSWER, LEAST_WHOLE = 0.5, 0.25, 0.25, 0.55


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_question: float = LEAST_QUESTION, least_answer: float = LEAST_ANSWER, least_whole: float = LEAST_WHOLE) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of each verified leak.

    A row for each document row and item: the best passage. Null and empty texts have none; null ids
    and repeated rows are rows like any other. An item of several parts has the score of its best one.
    An item of under five words leaks where its words are in a row. An item without words, or a null one,
    can't leak. An empty table on either side gives no rows. Only doc_id, text and item_id, text are read.
    """
    importable(docs.sparkSession)
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in index_shards(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                ids, found = batch.column(0).to_pylist(), sent.value.leaks(batch.column(1).to_pylist(), threshold, least_question, least_answer, least_whole)
                rows = [(ids[k], sent.value.ids[item], *x) for k, item, *x in found]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.float64()] * 3))], names=[x.split()[0] for x in schema.split(", ")])

        part = frame.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _leaks_any(sent, threshold: float, least_question: float, least_answer: float, least_whole: float):
    """A function of a text column: does it leak an item of the shard?"""

    def leaky(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part, some in series_slices(texts):
            flags, start = np.zeros(len(part), bool), 0
            for x in some:
                flags[[start + k for k, *_ in sent.value.leaks(x, threshold, least_question, least_answer, least_whole)]] = True
                start += len(x)
            yield pd.Series(flags)

    return F.pandas_udf(leaky, "boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_question: float = LEAST_QUESTION, least_answer: float = LEAST_ANSWER, least_whole: float = LEAST_WHOLE) -> DataFrame:
    """The documents without a verified leak, with all their columns; see ``find_leaks``."""
    importable(docs.sparkSession)
    for index in index_shards(benchmark):
        docs = docs.filter(~_leaks_any(docs.sparkSession.sparkContext.broadcast(index), threshold, least_question, least_answer, least_whole)("text"))
    return docs
