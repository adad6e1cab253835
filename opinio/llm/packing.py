"""Pack documents into training sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (a piece of n tokens
costs n * n). A piece goes to an open sequence that has room for it under every one of
them: by the smallest residual norm, or the largest weighted dot-product of the piece's
needs with what is left. Capacities are fractions of a whole sequence, so that weights
compare like with like.

Each task packs what it reads, in windows of bounded size, longest pieces first, and takes
sequences with room left over into its next window: no shuffle, no group that one task
would have to hold, and the same result whenever a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import functions as F

from opinio.llm.common import query, table
from opinio.llm.tokenizing import encoder

#: Pieces sorted and placed together, and open sequences taken to the next window.
WINDOW = 8192
CARRIED = 4096

#: Sequence numbers of one task; tasks count from different multiples of it.
TASK_STRIDE = 1 << 40


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    #: "norm": least squared residual; "dot": largest dot-product of need and residual.
    choose: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


class Bins:
    """Open sequences of one task."""

    def __init__(self, limits: Limits, first_number: int):
        self.limits = limits
        self.full = np.array([limits.tokens, limits.documents, limits.cost], dtype=np.float64)
        self.weights = np.array(limits.weights, dtype=np.float64)
        self.left = np.empty((0, 3))
        self.number = np.empty(0, dtype=np.int64)
        self.next = first_number

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence number and offset of each piece, the longest placed first."""
        n, open_ = len(lengths), len(self.number)
        left = np.empty((open_ + n, 3))
        left[:open_] = self.left
        number = np.empty(open_ + n, dtype=np.int64)
        number[:open_] = self.number
        numbers, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for i in np.argsort(-lengths, kind="stable"):
            length = float(lengths[i])
            need = np.array([length, 1.0, length * length])
            room = left[:open_]
            fits = np.flatnonzero((room[:, 0] >= need[0]) & (room[:, 1] >= 1.0) & (room[:, 2] >= need[2]))
            if len(fits):
                if self.limits.choose == "dot":
                    score = -(room[fits] / self.full) @ (self.weights * need / self.full)
                else:
                    score = (((room[fits] - need) / self.full) ** 2) @ self.weights
                at = fits[np.argmin(score)]
            else:
                at, open_ = open_, open_ + 1
                left[at], number[at] = self.full, self.new()
            numbers[i], offsets[i] = number[at], self.limits.tokens - left[at, 0]
            left[at] -= need
        # Sequences without room for one more token are done; so are the fullest beyond the bound.
        room = np.flatnonzero((left[:open_] >= 1.0).all(axis=1))
        room = room[np.argsort(-left[room, 0], kind="stable")[:CARRIED]]
        self.left, self.number = left[room].copy(), number[room].copy()
        return numbers, offsets


def cut(n_tokens: int, most: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be shorter."""
    if n_tokens <= most:
        return [(0, n_tokens)]
    head = n_tokens % most
    starts = ([0] if head else []) + list(range(head, n_tokens, most))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n_tokens])]


OUT = "piece int, start long, length long, ids binary, sequence_id long, offset long"


def _packer(limits: Limits, path: str, separator: int, id_type: pa.DataType):
    end = int(separator).to_bytes(4, "little")
    schema = pa.schema(
        [
            ("doc_id", id_type),
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        bins = Bins(limits, TaskContext.get().partitionId() * TASK_STRIDE)
        waiting: list[tuple] = []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            lengths = np.array([r[3] for r in rows], dtype=np.int64)
            whole = lengths == limits.tokens
            numbers, offsets = np.empty(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
            numbers[whole] = [bins.new() for _ in range(int(whole.sum()))]
            numbers[~whole], offsets[~whole] = bins.place(lengths[~whole])
            columns = [*zip(*rows), numbers, offsets]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, limits.tokens)):
                    waiting.append((doc_id, k, start, length, ids[4 * start : 4 * (start + length)]))
                    if len(waiting) >= WINDOW:
                        yield packed(waiting)
                        waiting = []
        if waiting:
            yield packed(waiting)

    return pack


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), separator: int = 0) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``; other columns are ignored) in sequences.

    A document is the ids of its text and then ``separator``; a null text is an empty one,
    so every document has a piece. ``ids`` holds the piece's ids as little-endian unsigned
    32-bit numbers. A repeated row is packed as often as it occurs, a null id stays null,
    an empty table gives no rows. A document longer than a sequence is cut into whole
    sequences with the shorter piece first. ``limits.cost`` and ``limits.documents`` must
    let a whole sequence's piece through.
    """
    if limits.cost < limits.tokens**2 or limits.documents < 1:
        raise ValueError("a piece as long as a sequence must fit into an empty one")
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType
    packer = _packer(limits, tokenizer, separator, to_arrow_type(kind))
    return rows.mapInArrow(packer, f"doc_id {kind.simpleString()}, {OUT}")


@query("op2_packing")
def op2_packing(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        "piece",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "sequence_id",
        "offset",
    )
