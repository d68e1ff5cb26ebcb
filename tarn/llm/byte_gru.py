"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are read in windows of ``WINDOW``; the network labels every byte with language
probabilities, from what comes before and after it in its window, and a document's probability of
a language is the mean over all its bytes. It is written and trained in numpy, by backpropagation
through time.

Scale: prediction needs no shuffle and runs over many windows at once, whatever documents they are
from, so a very long text is no longer chain than a short one. Training takes the whole texts of at most
``sample_rows`` documents, of ``sample_bytes`` in all, to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import importable, rest_class, slices

WINDOW = 128
#: Windows that go through the network at once.
BATCH = 4096
UNDETERMINED = "und"


@dataclass
class Direction:
    """One direction's weights: an input row for each byte, and what the state adds. Gates: update, reset, candidate."""

    inputs: np.ndarray  # (256, 3h)
    states: np.ndarray  # (3h, h)

    @property
    def size(self) -> int:
        return self.states.shape[1]

    def run(self, columns: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the columns (steps, batch) of bytes: (steps, h, batch)."""
        h = self.size
        table = np.ascontiguousarray(self.inputs.T)
        state = np.zeros((h, columns.shape[1]), np.float32)
        out = np.empty((len(columns), h, columns.shape[1]), np.float32)
        for t, column in enumerate(columns):
            x, g = np.take(table, column, axis=1), self.states @ state
            gates = x[: 2 * h]
            gates += g[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)  # a sigmoid by tanh
            gates *= 0.5
            gates += 0.5
            candidate = x[2 * h :]
            candidate += gates[h:] * g[2 * h :]
            np.tanh(candidate, out=candidate)
            new = out[t]
            np.subtract(state, candidate, out=new)
            new *= gates[:h]
            new += candidate
            if keep is not None:
                keep.append((state, gates, candidate, g[2 * h :]))
            state = new
        return out

    def back(self, columns: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of inputs and states, given those of the states after each column."""
        h = self.size
        d_inputs, d_states = np.zeros_like(self.inputs), np.zeros_like(self.states)
        ahead = np.zeros_like(d_out[0])
        for t in range(len(columns) - 1, -1, -1):
            state, gates, candidate, g = keep[t]
            update, reset = gates[:h], gates[h:]
            d = d_out[t] + ahead
            d_candidate = d * (1 - update) * (1 - candidate**2)
            d_update = d * (state - candidate) * update * (1 - update)
            d_reset = d_candidate * g * reset * (1 - reset)
            to_inputs = np.concatenate([d_update, d_reset, d_candidate])
            to_states = np.concatenate([d_update, d_reset, d_candidate * reset])
            np.add.at(d_inputs, columns[t], to_inputs.T)
            d_states += to_states @ state.T
            ahead = d * update + self.states.T @ to_states
        return d_inputs, d_states


@dataclass
class Network:
    """Both directions, and the layer over their states."""

    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # (languages, 2h)
    bias: np.ndarray  # (languages, 1)

    @staticmethod
    def fresh(languages: list[str], h: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
        return Network(languages, Direction(draw(256, 3 * h), draw(3 * h, h)), Direction(draw(256, 3 * h), draw(3 * h, h)), draw(len(languages), 2 * h), np.zeros((len(languages), 1), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.ahead.inputs, self.ahead.states, self.back.inputs, self.back.states, self.out, self.bias]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of each language at each position: (steps, languages, batch)."""
        columns = np.ascontiguousarray(windows.T)
        scores = self.out[:, : self.ahead.size] @ self.ahead.run(columns)
        scores += self.out[:, self.ahead.size :] @ self.back.run(columns[::-1])[::-1]
        scores += self.bias
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def gradients(self, windows: np.ndarray, language: np.ndarray, filled: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over the last ``filled`` positions of each window."""
        columns = np.ascontiguousarray(windows.T)
        reverse = columns[::-1]
        kept, kept_back = [], []
        a, b = self.ahead.run(columns, kept), self.back.run(reverse, kept_back)[::-1]
        both = np.concatenate([a, b], axis=1)
        scores = self.out @ both + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=1, keepdims=True)
        p[:, language, np.arange(len(language))] -= 1
        p *= ((np.arange(len(p))[:, None] >= len(p) - filled) / (filled * p.shape[2])).astype(np.float32)[:, None, :]
        d_both = self.out.T @ p
        h = self.ahead.size
        d_out = np.einsum("tlb,thb->lh", p, both, optimize=True)
        return [*self.ahead.back(columns, kept, d_both[:, :h]), *self.back.back(reverse, kept_back, d_both[::-1, h:]), d_out, p.sum(axis=(0, 2))[:, None]]


def at_end(windows: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """The first ``filled`` bytes of each window moved to its end, behind zeros."""
    steps = np.arange(windows.shape[1])[None]
    back = windows.shape[1] - filled[:, None]
    return np.where(steps >= back, windows[np.arange(len(windows))[:, None], (steps - back) % windows.shape[1]], 0).astype(np.uint8)


def windows_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all the bytes of texts that aren't empty, how much of each is filled, and the windows of each text."""
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    held = -(-sizes // WINDOW)
    firsts = np.cumsum(held) - held
    data = np.zeros(int(held.sum()) * WINDOW, np.uint8)
    for raw, first in zip(raws, firsts):
        data[first * WINDOW : first * WINDOW + len(raw)] = np.frombuffer(raw, np.uint8)
    filled = np.full(len(data) // WINDOW, WINDOW)
    filled[firsts + held - 1] = sizes - (held - 1) * WINDOW
    return data.reshape(-1, WINDOW), filled, held


def train(texts: list[bytes], language: np.ndarray, languages: list[str], h: int = 8, steps: int = 500, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit a network by Adam to whole texts, as bytes: each language is drawn alike, then each text, then each of its windows."""
    net = Network.fresh(languages, h, seed)
    rng = np.random.default_rng(seed)
    windows, full, held = windows_of(texts)
    firsts = np.cumsum(held) - held
    rows = [np.flatnonzero(language == k) for k in range(len(languages))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    for step in range(1, steps + 1):
        drawn = np.concatenate([rng.choice(r, -(-batch // len(rows))) for r in rows])
        at = firsts[drawn] + rng.integers(0, held[drawn])
        # half of them as short texts come: fewer bytes, behind zeros
        filled = np.minimum(full[at], np.where(rng.random(len(drawn)) < 0.5, rng.integers(8, WINDOW + 1, len(drawn)), WINDOW))
        slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.parts(), net.gradients(at_end(windows[at], filled), language[drawn], filled), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def pooled(net: Network, texts: list[str]) -> np.ndarray:
    """The mean of each text's position probabilities (texts, languages); the texts aren't empty."""
    windows, filled, held = windows_of([t.encode("utf-8", "surrogatepass") for t in texts])
    firsts = np.cumsum(held) - held
    sizes = np.add.reduceat(filled, firsts)
    sums = np.empty((len(windows), len(net.languages)))
    full = np.flatnonzero(filled == WINDOW)
    for k in range(0, len(full), BATCH):
        sums[full[k : k + BATCH]] = net.probabilities(windows[full[k : k + BATCH]]).sum(axis=0).T
    # a partly filled window has its bytes at its end, behind zeros, and only their positions count
    rest = np.flatnonzero(filled < WINDOW)
    for k in range(0, len(rest), BATCH):
        at = rest[k : k + BATCH]
        n = filled[at]
        p = net.probabilities(at_end(windows[at], n))
        sums[at] = (p * (np.arange(WINDOW)[:, None] >= WINDOW - n)[:, None, :]).sum(axis=0).T
    return np.add.reduceat(sums, firsts, axis=0) / sizes[:, None]


def fit(docs: DataFrame, sample_rows: int = 4_000, sample_bytes: int = 32_000_000, h: int = 8, steps: int = 500) -> Network | None:
    """A network from the whole texts of at most ``sample_rows`` documents, those with the least hashes of their ids.

    Of these, documents are taken in that order as long as they fit into ``sample_bytes``; one that
    doesn't is passed over. Documents whose crc32 of the id as text, modulo 5, is 0 are never learned
    from, nor those of a null language, or of a null or empty text. Without such documents there is no network.
    """
    usable = F.col("lang").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull() & (rest_class("doc_id", 5) != 0)
    key = ["doc_id", "lang", "mark"]
    marked = docs.filter(usable).select("doc_id", "lang", F.xxhash64("text").alias("mark"), "text")
    sizes = marked.select(*key, F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), *key).limit(sample_rows).collect()
    taken, left = set(), sample_bytes
    for r in sizes:
        if r.size <= left and (r.doc_id, r.lang, r.mark) not in taken:
            taken.add((r.doc_id, r.lang, r.mark))
            left -= r.size
    if not taken:
        return None
    picked = docs.sparkSession.createDataFrame(sorted(taken), marked.select(*key).schema)
    rows = marked.join(F.broadcast(picked), key).groupBy(*key).agg(F.first("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.lang, r.mark))
    languages = sorted({r.lang for r in rows})
    return train([r.text.encode("utf-8", "surrogatepass") for r in rows], np.array([languages.index(r.lang) for r in rows]), languages, h, steps)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score (the mean probability of that language) of each row.

    A text that is null or has no letter is ``und`` with a score of 0, and so is every text if there
    is no network. Null ids and repeated rows are rows like any other; an empty table gives no rows.
    Ties go to the first language in alphabetical order. Only doc_id and text are read.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            texts = batch.column(1).to_pylist()
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            at = [k for k, t in enumerate(texts) if net is not None and has_letter(t)]
            if at:
                p = pooled(net, [texts[k] for k in at])
                best = p.argmax(axis=1)
                scores[at] = np.clip(p[np.arange(len(at)), best], 0, 1)
                for k, b in zip(at, best):
                    names[k] = net.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
