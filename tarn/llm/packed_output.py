"""Token ids as packed matrices.

Best-fit-decreasing: pieces from the longest to the shortest each go to the bin with the least
room that is enough, found by a segment tree over the room that bins have left.

The number of rows depends on how the documents are partitioned, as each task packs its own: many
small files leave a loose row each.

Scale: no shuffle. Each task packs the documents of its own partition in blocks of bounded size
and writes whole matrix rows, so that ids never leave the task that made them. A block leaves a
bin or two partly filled, of thousands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm import tokens
from tarn.llm.common import importable, slices

#: Tokens that a task gathers before it packs them: 32 MB of ids.
BLOCK_TOKENS = 8_000_000

PACKED = "sequence_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>"


class CapacityTree:
    """Counts bins by the room they have left; finds the least room that is enough."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def at_least(self, room: int) -> int:
        """The least room of a bin that is this or more, or -1."""
        node = room + self.leaves
        if self.count[node]:
            return room
        while node > 1:
            if not node & 1 and self.count[node + 1]:  # the right sibling has larger rooms
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The pieces of each bin, in the order in which they were put there."""
    tree, with_room, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = tree.at_least(n)
        if room < 0:
            at, room = len(bins), capacity
            bins.append([])
        else:
            at = with_room[room].pop()
            tree.add(room, -1)
        bins[at].append(i)
        if room > n:
            with_room[room - n].append(at)
            tree.add(room - n, 1)
    return bins


def pack_block(pieces: list[tuple[int | None, int, np.ndarray]], capacity: int, pad_id: int, kind: str) -> list[tuple]:
    """The matrix rows for (doc_id, piece, ids): as in ``PACKED`` but for the id of the row."""
    rows = []
    for members in best_fit_decreasing([len(x[2]) for x in pieces], capacity):
        ids, places = np.full(capacity, pad_id, dtype=kind), np.zeros(capacity, "<u2" if capacity <= 65536 else "<u4")
        ends = [0]
        for i in members:
            part = pieces[i][2]
            ids[ends[-1] : ends[-1] + len(part)] = part
            places[ends[-1] : ends[-1] + len(part)] = np.arange(len(part))
            ends.append(ends[-1] + len(part))
        rows.append((ends[-1], ids.tobytes(), places.tobytes(), ends, [pieces[i][0] for i in members], [pieces[i][1] for i in members]))
    return rows


def packed_matrices(docs: DataFrame, capacity: int = 1024, end_id: int = 2, pad_id: int = 0, vocabulary: str | None = None, id_bytes: int = 2) -> DataFrame:
    """A row for each packed sequence of the documents' ids.

    input_ids: ``capacity`` little-endian unsigned ids of ``id_bytes`` bytes, padded with pad_id
    from n_tokens on. position_ids: 16-bit places that start again from 0 at each segment.
    cu_seqlens: where segments start, and n_tokens. doc_ids, pieces: whose they are; a document
    over the capacity has several, whose ids in the order of ``piece`` are the whole document.
    Null and empty texts have the end id alone; null ids and repeated rows are kept as they come;
    an empty table gives no rows. Only doc_id and text are read.
    """
    path = vocabulary or tokens.default_vocabulary()
    kind = {2: "<u2", 4: "<u4"}[id_bytes]
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, made = tokens.encoder(path), TaskContext.get().partitionId(), 0
        names = [x.split()[0] for x in PACKED.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))

        def flush(pieces: list) -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = [((part << 33) + made + k, *row) for k, row in enumerate(pack_block(pieces, capacity, pad_id, kind))]
            made += len(rows)
            for k in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1024]), kinds)], names=names)

        pieces, held = [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.document_ids(text, encode, end_id)
                if id_bytes == 2 and ids.max() > 65535:
                    raise ValueError("ids over 65535 need id_bytes=4")
                ids = ids.astype(kind)
                pieces += [(doc_id, k, ids[s : s + capacity]) for k, s in enumerate(range(0, len(ids), capacity))]
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield from flush(pieces)
                    pieces, held = [], 0
        if pieces:
            yield from flush(pieces)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the matrices as Parquet files: their input_ids column, read in order, is the matrix."""
    packed_matrices(docs, **options).write.parquet(path)
