"""Best-two-fit packing of documents into sequences of bounded length.

Each bin is filled greedily with the longest pieces that fit. Then its smallest piece is put back
if two unpacked pieces together fill the widened gap more tightly; of the pairs that fill it best, the
one with the longest piece is taken.

Scale: tokens are counted where the documents lie, and only (id, piece, length) rows are shuffled.
The pieces are dealt by hash into groups of about ``GROUP_PIECES``, each packed on its own in one
task of bounded memory; a group leaves a partly filled bin or two, of thousands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import tokens
from tarn.llm.common import importable, lasting, slices

GROUP_PIECES = 16_384

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens: full ones, but for the first if n is no multiple."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def document_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32.

    A null or empty text has the end id alone. Documents over the capacity are cut into pieces of
    that length, the first of which may be shorter; no token is lost. Null ids and repeated rows
    are documents like any other; an empty table has no pieces. Only doc_id and text are read.
    """
    path = vocabulary or tokens.default_vocabulary()
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.document_ids(text, encode, end_id).astype("<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length (from 0) and its offset there. Equal lengths are taken in their order."""
    lengths = np.asarray(lengths, dtype=np.int64)
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    at = np.concatenate(([0], np.cumsum(counts)))[:-1]  # the next of each length, in order
    sizes = np.arange(capacity + 1)
    left = counts.copy()
    below = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the largest length left, up to each

    def change(size: int, by: int) -> None:
        nonlocal below
        left[size] += by
        if left[size] == max(by, 0):  # the last one went, or the first came back
            below = np.maximum.accumulate(np.where(left > 0, sizes, 0))

    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    made = 0
    remaining = len(lengths)
    while remaining:
        gap, members = capacity, []
        while gap and (size := int(below[gap])):
            members.append(size)
            change(size, -1)
            gap -= size
        if gap:
            small = members[-1]  # they are in decreasing order
            room = gap + small
            first = np.flatnonzero(left[: room + 1])
            second = below[room - first]
            twice = (second == first) & (left[first] < 2)
            second[twice] = below[first[twice] - 1]
            total = np.where(second > 0, first + second, 0)
            if len(total) and (best := int(total.max())) > small:
                k = int(np.flatnonzero(total == best)[-1])
                pair = [int(first[k]), int(second[k])]
                for size in pair:
                    change(size, -1)
                change(small, 1)
                members = members[:-1] + pair
        place = 0
        for size in members:
            row = order[at[size]]
            at[size] += 1
            bins[row], offsets[row] = made, place
            place += size
        made += 1
        remaining -= len(members)
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces (a written table, with a length column) and their sequence_id and offset.

    Every piece is in one sequence, gapless from offset 0. No rows give no rows.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    schema = f"{PIECES}, sequence_id long, offset long"

    def run(key: tuple, rows: pa.Table) -> pa.Table:  # Arrow, as pandas would make floats of ids beside a null
        rows = rows.drop_columns(["spread"]).sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "length")])
        bins, offsets = best_two_fit(rows["length"].to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array(bins * groups + key[0].as_py())).append_column("offset", pa.array(offsets))

    importable(pieces.sparkSession)
    return pieces.withColumn("spread", spread).groupBy("spread").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their places: see ``document_pieces`` and ``pack_pieces``."""
    return pack_pieces(lasting(document_pieces(docs, capacity, end_id, vocabulary)), capacity)
