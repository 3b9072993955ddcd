"""Hierarchical packing of documents into training windows of several lengths.

A document's full windows of the longest tier go out as they are. What is left goes to the smallest tier that holds
it. Tiers are packed from the longest down: the longest document left opens a window of its tier, the window's gap
takes the longest documents of shorter tiers that fit, and the last bit of the gap takes the head of a short document
that is cut there. So windows are full. What is left at the end of a task is cut to windows of powers of two. Windows
of a tier are dealt to step groups of equal tokens in serpentine order of their attention cost.

Every input partition is packed on its own, in pools of `pool_ids` ids, without a shuffle: no task ever holds more than
a pool and one document, and a lost task is packed again from its own input alone.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.tokens import batches_of, word_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
SCHEMA = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (c.split() for c in PIECES.split(", "))])


class Piece:
    """A stretch of a document that is not yet in a window."""

    __slots__ = ("doc", "ids", "start", "stop")

    def __init__(self, doc, ids, start, stop):
        self.doc, self.ids, self.start, self.stop = doc, ids, start, stop

    def __len__(self):
        return self.stop - self.start

    def head(self, n: int) -> Piece:
        """Cut the first n ids off."""
        self.start += n
        return Piece(self.doc, self.ids, self.start - n, self.start)


def fill_windows(pieces: Sequence[Piece], tiers: Sequence[int]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (tier, pieces) and what is left over, which is less than one window of the longest tier."""
    longest, out = tiers[-1], []
    left: list[tuple[int, int, Piece]] = []
    for k, p in enumerate(pieces):
        while len(p) >= longest:
            out.append((longest, [p.head(longest)]))
        if len(p):
            left.append((len(p), k, p))
    left.sort(key=lambda x: x[:2])
    while left:
        n, k, p = left.pop()
        tier = tiers[bisect.bisect_left(tiers, n)]
        window, gap = [p], tier - n
        while gap and left:
            at = bisect.bisect_right(left, gap, key=lambda x: x[0])
            if at:
                m, _, q = left.pop(at - 1)
                window.append(q)
                gap -= m
            else:
                m, j, q = left.pop(0)
                window.append(q.head(gap))
                bisect.insort(left, (m - gap, j, q), key=lambda x: x[:2])
                gap = 0
        if gap:
            return out, window
        out.append((tier, window))
    return out, []


def power_windows(pieces: Sequence[Piece], longest: int) -> list[tuple[int, list[Piece]]]:
    """The last pieces of a task in windows whose lengths are powers of two, the longest first."""
    queue, out = [p for p in pieces if len(p)], []
    total = sum(map(len, queue))
    while total:
        room = size = min(longest, 1 << (total.bit_length() - 1))
        window = []
        while room:
            take = min(room, len(queue[0]))
            window.append(queue[0].head(take))
            room -= take
            if not len(queue[0]):
                queue.pop(0)
        out.append((size, window))
        total -= size
    return out


def step_groups(windows: Sequence[tuple[int, list[Piece]]], step_ids: int) -> list[int]:
    """A group number per window: groups hold windows of one length and at most `step_ids` ids, and costs (the sum of
    squared piece lengths) are dealt in serpentine order."""
    groups, base = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}):
        own = [k for k, (t, _) in enumerate(windows) if t == tier]
        n = -(-len(own) * tier // max(step_ids, tier))
        own.sort(key=lambda k: (-sum(len(p) ** 2 for p in windows[k][1]), k))
        for turn, k in enumerate(own):
            lap, at = divmod(turn, n)
            groups[k] = base + (n - 1 - at if lap % 2 else at)
        base += n
    return groups


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: Sequence[int] = (512, 1024, 2048, 4096), pool_ids: int = 1 << 21, step_ids: int = 1 << 16) -> DataFrame:
    """Pieces of all rows of `docs`: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group`.

    NULL and empty texts are the end id alone. Rows with equal doc_id are packed as separate documents, a NULL doc_id
    stays NULL, other columns are ignored, an empty table gives no rows. `tiers` are ascending powers of two.
    """
    tiers = tuple(tiers)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        pool, held, sequence, group = [], 0, 0, 0

        def rows(windows):
            nonlocal sequence, group
            out = []
            numbers = step_groups(windows, step_ids)
            for (tier, window), g in zip(windows, numbers):
                at = 0
                for p in window:
                    crc = zlib.crc32(p.ids[p.start : p.stop].astype("<u4").tobytes())
                    out.append((p.doc, p.start, len(p), crc, len(p.ids), base + sequence, at, tier, base + group + g))
                    at += len(p)
                sequence += 1
            group += 1 + max(numbers, default=-1)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)

        for big in batches:
            for b in batches_of(big):
                for doc, ids in zip(b.column(0).to_pylist(), encoder.ids(b.column(1).to_pylist(), end_id)):
                    pool.append(Piece(doc, ids, 0, len(ids)))
                    held += len(ids)
                if held >= pool_ids:
                    windows, pool = fill_windows(pool, tiers)
                    held = sum(map(len, pool))
                    yield from rows(windows)
        windows, pool = fill_windows(pool, tiers)
        yield from rows(windows + power_windows(pool, tiers[-1]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, PIECES)
