"""Quality rules: a decision list learned by sequential covering.

Statistics of labelled documents teach ordered rules. Each is a conjunction of thresholds, grown
term by term on two thirds of the rows while the information gain lasts, then pruned on the rest;
the rows that it covers leave, and the next rule is grown. The list becomes one Spark ``CASE``.

Scale: statistics are made where the documents lie, without a shuffle. Rules are fitted on at most
``sample_rows`` labelled documents (numbers alone reach the driver).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import importable, rest_class, slices

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def text_counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of a text; words are runs of anything but the six ASCII white-space characters."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    in_words = sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    covered = 0
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered += i + 3 - max(end, i)
                end = i + 3
    return (
        len(words), len(text) - (len(raw) - in_words), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), covered,
        len(lines), len(raw) - len(raw.translate(None, _UPPER)), raw.count(b"!") + raw.count(b"?"),
    )


def document_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``COUNTS`` (long) of each row."""
    importable(docs.sparkSession)
    frame = docs.select(*keep, "text")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema if f.name != "text"), *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [text_counts(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[*keep, *COUNTS])

    return frame.mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """What the rules may test."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_a_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "marks_a_word": per("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Term:
    """feature > threshold, or feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information that a term adds, for each of the positives that it keeps."""
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))
    return np.where(p > 0, p * bits, 0.0)


def grow(x: dict[str, np.ndarray], bad: np.ndarray, thresholds: int = 64, most_terms: int = 4, least_gain: float = 1e-6) -> list[Term]:
    """Terms that, one after another, best tell the bad rows."""
    inside, terms = np.ones(len(bad), bool), []
    while len(terms) < most_terms and (n0 := float((inside & ~bad).sum())) and (p0 := float((inside & bad).sum())):
        best, chosen = least_gain, None
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, thresholds + 2)[1:-1], method="lower"))
            order = np.argsort(v, kind="stable")
            at = np.searchsorted(v[order], cuts, side="right")
            p_low = np.concatenate(([0], np.cumsum(b[order])))[at].astype(float)
            n_low = at - p_low
            for above, p, n in ((True, p0 - p_low, n0 - n_low), (False, p_low, n_low)):
                gains = _gain(p0, n0, p, n)
                k = int(gains.argmax())
                if gains[k] > best and (v > cuts[k]).any():  # halfway to the next value
                    best, chosen = float(gains[k]), Term(name, above, float((cuts[k] + v[v > cuts[k]].min()) / 2))
        if chosen is None:
            break
        terms.append(chosen)
        inside &= chosen.holds(x[chosen.feature])
    return terms


def _covers(terms: list[Term], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    inside = np.ones(n, bool)
    for t in terms:
        inside &= t.holds(x[t.feature])
    return inside


def prune(terms: list[Term], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[list[Term], float]:
    """The first terms that have the best (p - n) / (p + n) on these rows, and the share of bad rows there."""
    best, kept, share = -np.inf, terms, 0.0
    for k in range(len(terms), 0, -1):
        inside = _covers(terms[:k], x, len(bad))
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= best:
            best, kept, share = worth, terms[:k], p / (p + n) if p + n else 0.0
    return kept, share


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, least_share: float = 0.6, seed: int = 7) -> list[list[Term]]:
    """The rules, in their order; each one says that a document is bad. No rows or no bad rows: no rules."""
    rules, left = [], np.ones(len(bad), bool)
    fold = np.random.default_rng(seed).permutation(len(bad)) % 3
    while len(rules) < most_rules and (left & bad).sum() >= 5:
        growing, pruning = left & (fold != 0), left & (fold == 0)
        terms = grow({k: v[growing] for k, v in x.items()}, bad[growing])
        if not terms:
            break
        terms, share = prune(terms, {k: v[pruning] for k, v in x.items()}, bad[pruning])
        inside = _covers(terms, x, len(bad)) & left
        if share < least_share or not (inside & bad).sum():
            break
        rules.append(terms)
        left &= ~inside
    return rules


def first_rule(rules: list[list[Term]]) -> Column:
    """The list as an expression over ``COUNTS``: the number (from 0) of the first rule that says bad, or null."""
    out = None
    for k, terms in enumerate(rules):
        every = terms[0].column()
        for t in terms[1:]:
            every = every & t.column()
        out = F.when(every, F.lit(k)) if out is None else out.when(every, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def verdict(rules: list[list[Term]]) -> Column:
    """True where no rule says bad."""
    return first_rule(rules).isNull()


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> list[list[Term]]:
    """Rules from at most ``sample_rows`` labelled documents, those with the least hashes of their ids.

    Rows whose crc32 of the id, modulo 3, is 1 are left out, to measure on. Labels of null quality
    and rows that fail the base rules teach nothing. Repeated labels, and rows of one id with the same
    counts, teach once; if ids have several texts, at most ``sample_rows`` rows teach all the same.
    """
    usable = F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (rest_class("doc_id", 3) != 1)
    order = (F.xxhash64("doc_id"), "doc_id", "quality")
    chosen = labels.filter(usable).select("doc_id", "quality").distinct().orderBy(*order).limit(sample_rows)
    taught = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counted = document_counts(taught, ("doc_id", "quality")).filter(~base_failed()).distinct()
    rows = counted.orderBy(*order, *COUNTS).limit(sample_rows).select("quality", *(c.alias(k) for k, c in features().items())).toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)  # the same order on any cluster
    return learn({k: rows[k].to_numpy(float) for k in features()}, (rows["quality"] == 0).to_numpy())


def apply_rules(docs: DataFrame, rules: list[list[Term]]) -> DataFrame:
    """doc_id, ``COUNTS``, base_failed, kept (not base_failed, and no rule says bad) and rule (the first that does) of each row.

    A null or empty text has counts of 0 and fails the base rules. Null ids and repeated rows are
    rows like any other; an empty table gives no rows. Only doc_id and text are read.
    """
    return document_counts(docs).withColumn("base_failed", base_failed()).withColumn("rule", first_rule(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
