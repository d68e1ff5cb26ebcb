"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own and its neighbours'; the field joins them
with transition weights. Forward-backward gives the marginal of every line, and a document's
quality is the mean of its lines' marginals, weighted by their length.

Labels are of documents, so the labels of their lines are latent. A field without transitions and
neighbours, taught that all lines are as their document is, says which lines look otherwise; they are
believed as far as the document's pooled marginal stays on its side. The field itself is then fitted
to documents so labelled and to splices of them, where good lines stand beside bad ones, and
the lines are labelled once more by it.

Scale: scoring is without a shuffle, in slices of bounded size. The field is fitted on at most
``sample_rows`` labelled documents of ``sample_bytes`` of line features in all, which alone (no texts)
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import forget, importable, lasting, rest_class, series_slices, slices

#: Classes of bytes that are counted in each line.
CLASSES = {
    "upper": bytes(range(0x41, 0x5B)),
    "lower": bytes(range(0x61, 0x7B)),
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "high": bytes(range(0x80, 0x100)),
}
_TABLES = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in CLASSES.items()}
#: Features of a line: shares of its bytes, then these.
OWN = (*CLASSES, "is_blank", "short", "length", "word_length", "ends_in_stop", "repeated", "no_stop_long")
#: Features that are also taken from the lines before and after.
SHARED = [OWN.index(k) for k in ("upper", "shout", "symbol", "lower", "stop", "repeated")]
N_FEATURES = 1 + len(OWN) + 2 * len(SHARED) + 2
#: How far on its side the pooled label of a document's lines is held.
MARGIN = 0.05


def own_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``OWN`` of all lines of the texts, the lines' lengths in bytes, and the lines of each text (one at least)."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends - starts
    counts = np.array([r.count(b"\n") + 1 for r in raws])
    share = {name: np.add.reduceat(table[data], starts, dtype=np.int32) / np.maximum(lengths, 1) for name, table in _TABLES.items()}
    repeated = np.zeros(len(starts))
    k = 0
    for r in raws:
        seen: set[bytes] = set()
        for line in r.split(b"\n"):
            if line in seen:
                repeated[k] = len(line) > 0
            seen.add(line)
            k += 1
    last = data[np.maximum(ends - 1, 0)]
    ends_in_stop = (np.isin(last, np.frombuffer(b".!?:;\"'", np.uint8))) & (lengths > 0)
    words = share["blank"] * lengths + 1
    own = np.stack([
        *share.values(), lengths == 0, lengths < 40, np.log1p(lengths) / 8, np.minimum(lengths / words, 40) / 10,
        ends_in_stop, repeated, (share["stop"] == 0) & (lengths > 200),
    ], axis=1)
    return own.astype(np.float32), lengths, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All features of lines, from their own."""
    firsts = np.cumsum(counts) - counts
    at_start, at_end = np.zeros(len(own), bool), np.zeros(len(own), bool)
    at_start[firsts] = True
    at_end[firsts + counts - 1] = True
    before, after = np.roll(own[:, SHARED], 1, axis=0), np.roll(own[:, SHARED], -1, axis=0)
    before[at_start], after[at_end] = 0, 0
    return np.concatenate([np.ones((len(own), 1)), own, before, after, at_start[:, None], at_end[:, None]], axis=1).astype(np.float32)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, the lines' lengths in bytes, and the lines of each text (one at least)."""
    own, lengths, counts = own_features(texts)
    return with_neighbours(own, counts), lengths, counts


@dataclass
class Chain:
    """A two-state field: line weights (for good, against bad) and transition weights [from, to]."""

    weights: np.ndarray
    transitions: np.ndarray

    def messages(self, scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds of each line, of chains that follow one another."""
        (t00, t01), (t10, t11) = self.transitions
        order = np.argsort(-counts, kind="stable")
        firsts = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
        ahead, back = scores.astype(float).copy(), np.zeros(len(scores))
        for t in range(1, len(alive)):
            at = firsts[: alive[t]] + t
            a = ahead[at - 1]
            ahead[at] += np.logaddexp(t01, a + t11) - np.logaddexp(t00, a + t10)
        for t in range(len(alive) - 1, 0, -1):
            at = firsts[: alive[t]] + t
            c = scores[at] + back[at]
            back[at - 1] = np.logaddexp(t10, t11 + c) - np.logaddexp(t00, t01 + c)
        return ahead, back

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The probability that each line is good."""
        ahead, back = self.messages(x @ self.weights, counts)
        return 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))

    def gradient(self, x: np.ndarray, counts: np.ndarray, good: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood, each line weighted by the worth of its document."""
        scores = x @ self.weights
        ahead, back = self.messages(scores, counts)
        marginal = 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))
        d_weights = ((good - marginal) * worth) @ x
        last = np.cumsum(counts) - 1
        link = np.ones(len(good), bool)
        link[last] = False
        i = np.flatnonzero(link)
        a, c = ahead[i], scores[i + 1] + back[i + 1]
        joint = np.stack([self.transitions[0, 0] + 0 * a, self.transitions[0, 1] + c, self.transitions[1, 0] + a, self.transitions[1, 1] + a + c])
        joint = np.exp(joint - joint.max(axis=0))
        expected = (joint / joint.sum(axis=0)) @ worth[i]
        y = good[i].astype(int) * 2 + good[i + 1].astype(int)
        seen = np.bincount(y, weights=worth[i], minlength=4)
        return d_weights, (seen - expected).reshape(2, 2)


def climb(x: np.ndarray, counts: np.ndarray, good: np.ndarray, worth: np.ndarray, start: np.ndarray, rounds: int, free: np.ndarray | None = None, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Weights and transitions, in a row, after steps of Adam on the log likelihood of the line labels. free: the ones to move."""
    params, m, v = start.copy(), 0.0, 0.0
    for step in range(1, rounds + 1):
        dw, dt = Chain(params[:-4], params[-4:].reshape(2, 2)).gradient(x, counts, good, worth)
        g = np.concatenate([dw, dt.ravel()]) - decay * params
        if free is not None:
            g = g * free
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return params


def held(odds: np.ndarray, lengths: np.ndarray, counts: np.ndarray, good: np.ndarray, margin: float = MARGIN) -> np.ndarray:
    """Line labels from log odds, all those of a document moved by the least that keeps its pooled probability on its side."""
    toward = np.where(good, 1.0, -1.0)

    def probabilities(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(odds + np.repeat(toward * by, counts), -60, 60)))
        mean = pooled(p, lengths, counts)
        return p, np.where(good, mean >= 1 - margin, mean <= margin)

    low, high = np.zeros(len(counts)), np.full(len(counts), 120.0)
    for _ in range(40):
        _, right = probabilities((low + high) / 2)
        low, high = np.where(right, low, (low + high) / 2), np.where(right, (low + high) / 2, high)
    _, right = probabilities(np.zeros(len(counts)))
    return (probabilities(np.where(right, 0.0, high))[0] >= 0.5).astype(float)


def splices(counts: np.ndarray, good: np.ndarray, n: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Line numbers of n texts that are made of runs of lines of good and bad documents in turn."""
    firsts, out = np.cumsum(counts) - counts, []
    sides = [np.flatnonzero((good == g) & (counts > 1)) for g in (True, False)]
    if not all(map(len, sides)):
        return out
    for _ in range(n):
        runs = []
        turn = int(rng.integers(2))
        for k in range(2 * int(rng.integers(1, 3))):
            d = int(rng.choice(sides[(turn + k) % 2]))
            size = int(min(counts[d], rng.integers(1, 9)))
            runs.append(firsts[d] + int(rng.integers(0, counts[d] - size + 1)) + np.arange(size))
        out.append(np.concatenate(runs))
    return out


def train(own: np.ndarray, lengths: np.ndarray, counts: np.ndarray, good: np.ndarray, rounds: int = 100, seed: int = 7) -> Chain:
    """Fit a chain to documents' own line features and labels (good, for each document); the two labels weigh alike."""
    start = np.zeros(N_FEATURES + 4)
    if not len(counts):
        return Chain(start[:-4], start[-4:].reshape(2, 2))
    x = with_neighbours(own, counts)
    share = np.clip(good.mean(), 0.02, 0.98)
    # each document weighs the same whatever its lines, which weigh by their length, and so do the labels
    worth_of = lambda lengths, counts: (lengths + 1.0) / np.repeat(np.add.reduceat(lengths + 1.0, np.cumsum(counts) - counts), counts) / len(counts)
    worth = np.repeat(np.where(good, 0.5 / share, 0.5 / (1 - share)), counts) * worth_of(lengths, counts)
    alone = np.zeros(len(start))
    alone[: 1 + len(OWN)] = 1
    params = climb(x, counts, np.repeat(good.astype(float), counts), worth, start, rounds, alone)
    mixed = splices(counts, good, len(counts), np.random.default_rng(seed))
    if mixed:
        rows, sizes = np.concatenate(mixed), np.array([len(r) for r in mixed])
        x_all = np.concatenate([x, with_neighbours(own[rows], sizes)])
        counts_all, worth_all = np.concatenate([counts, sizes]), np.concatenate([worth, worth_of(lengths[rows], sizes)])
    else:
        rows, x_all, counts_all, worth_all = np.empty(0, int), x, counts, worth
    # the lines' labels by what is fitted so far, then a chain for them, and once more
    for start, more in ((start, rounds + rounds // 5), (None, rounds * 3 // 5)):
        chain = Chain(params[:-4], params[-4:].reshape(2, 2))
        label = held(np.add(*chain.messages(x @ chain.weights, counts)), lengths, counts, good)
        params = climb(x_all, counts_all, np.concatenate([label, label[rows]]), worth_all, params if start is None else start, more)
    return Chain(params[:-4], params[-4:].reshape(2, 2))


def pooled(marginals: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean marginal of each document's lines, weighted by length + 1."""
    firsts = np.cumsum(counts) - counts
    w = lengths + 1.0
    return np.add.reduceat(marginals * w, firsts) / np.add.reduceat(w, firsts)


def score_texts(chain: Chain, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its quality, its lines, and how many of them are bad."""
    x, lengths, counts = line_features(texts)
    marginals = chain.marginals(x, counts)
    bad = np.add.reduceat((marginals < 0.5).astype(np.int64), np.cumsum(counts) - counts)
    return np.clip(pooled(marginals, lengths, counts), 0.0, 1.0), counts, bad


def _features_of(frame: DataFrame) -> DataFrame:
    """doc_id, quality, and the document's own line features and their lengths as bytes."""
    importable(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, lengths, counts = own_features(batch.column(1).to_pylist())
            cuts = np.cumsum(counts)[:-1]
            parts = [pa.array([p.tobytes() for p in np.split(v, cuts)], pa.binary()) for v in (own, lengths.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *parts], names=["doc_id", "quality", "own", "lengths"])

    return frame.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "doc_id long, quality int, own binary, lengths binary")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4_000, sample_bytes: int = 64_000_000, rounds: int = 100) -> Chain:
    """A chain from at most ``sample_rows`` labelled documents, those with the least hashes of their ids.

    Of these, whole documents are taken in that order as long as their line features fit into
    ``sample_bytes``; one that doesn't is passed over. Rows whose crc32 of the id as text, modulo 3,
    is 1 are never learned from. Labels of null quality teach nothing; without any, every score is 0.5.
    Repeated labels, and rows of one id with the same features, teach once.
    """
    usable = F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (rest_class("doc_id", 3) != 1)
    chosen = labels.filter(usable).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    features = lasting(_features_of(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).withColumn("mark", F.xxhash64("own", "lengths")))
    sizes = features.select("doc_id", "quality", "mark", F.length("own").alias("size")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "mark").limit(sample_rows).collect()
    taken, left = set(), sample_bytes
    for r in sizes:
        if r.size <= left:
            taken.add((r.doc_id, r.quality, r.mark))
            left -= r.size
    key = ["doc_id", "quality", "mark"]
    picked = docs.sparkSession.createDataFrame(sorted(taken), "doc_id long, quality int, mark long")
    rows = features.join(F.broadcast(picked), key).groupBy(*key).agg(F.first("own").alias("own"), F.first("lengths").alias("lengths")).toPandas().sort_values(key)
    forget(features)
    own = np.frombuffer(b"".join(rows["own"]), np.float32).reshape(-1, len(OWN))
    counts = rows["lengths"].map(len).to_numpy(int) // 8
    return train(own, np.frombuffer(b"".join(rows["lengths"]), np.int64), counts, rows["quality"].to_numpy() == 1, rounds)


def quality_function(chain: Chain):
    """Of a text column: quality, n_lines and n_bad_lines."""

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for _, some in series_slices(texts):
            parts = [score_texts(chain, x) for x in some] or [(np.empty(0), np.empty(0, int), np.empty(0, int))]
            yield pd.DataFrame({name: np.concatenate(v) for name, v in zip(("quality", "n_lines", "n_bad_lines"), zip(*parts))})

    # not deterministic for Spark: else a filter on the score would compute it twice
    return F.pandas_udf(score, "quality double, n_lines long, n_bad_lines long").asNondeterministic()


def label_lines(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, line (from 0), good (the probability that it is) and label (1 good, 0 bad) of each line of each row.

    Lines are what ``\\n`` parts, so a null or empty text has one. Only doc_id and text are read.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, _, counts = line_features(batch.column(1).to_pylist())
            good = chain.marginals(x, counts)
            place = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(place, pa.int64()), pa.array(good), pa.array((good >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "good", "label"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line long, good double, label int")


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """All columns of the documents, then quality_score (0 to 1), predicted (1 from 0.5 on), n_lines and n_bad_lines.

    A null text counts as empty, which is a chain of one blank line with a score like any other.
    Null ids and repeated rows are rows like any other; an empty table gives no rows. Columns that
    are named so already are replaced.
    """
    importable(docs.sparkSession)
    found, taken = "found", {c.lower() for c in docs.columns}
    while found in taken:
        found += "_"
    scored = docs.withColumn(found, quality_function(chain)("text"))
    quality = F.col(f"{found}.quality")
    new = {"quality_score": quality, "predicted": (quality >= 0.5).cast("int"), "n_lines": F.col(f"{found}.n_lines"), "n_bad_lines": F.col(f"{found}.n_bad_lines")}
    return scored.withColumns(new).drop(found)


def keep_good(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents of a score of 0.5 or more, with all their columns, whatever these are named."""
    importable(docs.sparkSession)
    return docs.filter(quality_function(chain)("text")["quality"] >= 0.5)
