"""Packing: minimum bin slack, planned on the histogram of lengths, placed on Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import dense_number, materialize, small_parts
from ledgerloom.llm.tokenizing import IdEncoder, Vocabulary, crc32, default_vocabulary, piece_bounds

CAPACITY = 1024
END_ID = 2

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


def document_pieces(
    docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces of every document's ids (with the end id), without the ids themselves.

    A null text is empty and has the end id only.  Rows that share an id, or have
    none, give the pieces of each; an empty table gives none.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = IdEncoder(vocabulary)
        for batch in small_parts(batches, 1):
            docs_out, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                for k, (at, size) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    docs_out.append(doc_id)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(crc32(ids[4 * at : 4 * (at + size)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs_out, pa.int64()),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=list(PIECE_COLUMNS),
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA)


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences that each hold ``items``: (length, how many), longest first."""

    items: tuple[tuple[int, int], ...]
    times: int


def fullest(counts: dict[int, int], capacity: int) -> tuple[tuple[int, int], ...]:
    """The combination of available lengths with the largest sum within capacity.

    Subset sums are the bits of an integer; a length with a count is added in
    powers of two.  The longest available piece is always taken, so that long
    pieces aren't left over; the rest of the bin is filled as full as possible.
    """
    lengths = sorted(counts, reverse=True)
    longest = lengths[0]
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in lengths:
        left = min(counts[size] - (size == longest), room // size) if size else 0
        part = 1
        while left > 0:
            many = min(part, left)
            steps.append((size, many, reach))
            reach |= (reach << (size * many)) & mask
            left -= many
            part *= 2
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    taken: dict[int, int] = {longest: 1}
    for size, many, before in reversed(steps):
        if not before >> target & 1:
            target -= size * many
            taken[size] = taken.get(size, 0) + many
    return tuple(sorted(taken.items(), reverse=True))


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up the histogram, each the fullest at its turn.

    A pattern is repeated while all its lengths last: it stays feasible, and no
    fuller one can appear as lengths only disappear.  A repetition ends when a
    length runs short, so the number of patterns follows the number of distinct
    lengths (at most ``capacity``), not the number of documents.
    """
    counts = {int(k): int(v) for k, v in histogram.items() if v > 0}
    plan: list[Pattern] = []
    while counts:
        items = fullest(counts, capacity)
        times = min(counts[size] // many for size, many in items)
        for size, many in items:
            counts[size] -= many * times
            if not counts[size]:
                del counts[size]
        plan.append(Pattern(items, times))
    return plan


def plan_lookup(plan: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces a sequence, offset)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern in plan:
        offset = 0
        for size, many in pattern.items:
            rank = used.get(size, 0)
            rows.setdefault(size, []).append((rank, sequence, many, offset))
            used[size] = rank + many * pattern.times
            offset += size * many
        sequence += pattern.times
    return {size: np.array(v, np.int64) for size, v in rows.items()}


def place(pieces: DataFrame, lookup: dict[int, np.ndarray]) -> DataFrame:
    """Sequence and offset of every ranked piece, by binary search in the plan.

    The plan travels with the task; its size is bounded by the capacity.
    """

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank_in_length").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                table = lookup[int(size)]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                turn = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + turn // row[:, 2]
                offset[at] = row[:, 3] + turn % row[:, 2] * size
            kept = [c for c in batch.schema.names if c != "_rank_in_length"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    schema = ", ".join([PIECE_SCHEMA, "sequence_id bigint", "offset bigint"])
    return pieces.mapInArrow(seat, schema)


def pack_documents(
    docs: DataFrame,
    vocabulary: Vocabulary | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as it finds.

    Texts are tokenized once into a narrow table of pieces.  The driver sees their
    histogram by length, ``capacity`` numbers whatever the input, and plans on it.
    Pieces are numbered within their length (a length as common as any is numbered
    in many tasks) and look up their place.  Repeated rows are packed each; an empty
    table gives no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    cut = document_pieces(docs, vocabulary, capacity, end_id).withColumn("_row", F.monotonically_increasing_id())
    pieces = materialize(cut, "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lookup = plan_lookup(minimum_bin_slack(histogram, capacity))
    ranked = dense_number(pieces, ["length"], ["_row"], "_rank_in_length", max(histogram.values(), default=0))
    return place(ranked.select(*PIECE_COLUMNS, "_rank_in_length"), lookup)
