"""Hierarchical packing of tokenized documents into windows of several sizes.

Each task packs the documents that it reads, so nothing is shuffled and a lost task is simply run
again. A document's tail is routed to the least window size that holds it; windows are opened from
the longest down and their gaps are filled from shorter tiers, longest first. The last gap is filled
by cutting a shorter document, so a window is padded only at the very end of a task, and there the
rest is laid into windows of powers of two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text, _vocab

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"
#: Tokens that a task holds at most, but for one document.
BLOCK_TOKENS = 1_000_000


class _Packer:
    """Windows of one task. Items are (length, number, start): what is left of a document from start on."""

    def __init__(self, tiers: tuple[int, ...], group_tokens: int, base: int):
        self.tiers, self.group_tokens, self.base = tiers, group_tokens, base
        self.docs: dict[int, list] = {}  # number -> [doc_id, ids, tokens not placed yet]
        self.pool: list[tuple[int, int, int]] = []
        self.rows: list[tuple] = []
        self.numbered = self.sequences = self.held = self.groups = 0
        self.open: dict[int, list[int]] = {}  # window -> [step group, windows in it]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, top = len(ids) // 4, self.tiers[-1]
        self.docs[self.numbered] = [doc_id, ids, n]
        self.held += n
        for start in range(0, n - n % top, top):
            self.emit([(top, self.numbered, start)], top)
        if n % top:
            insort(self.pool, (n % top, self.numbered, n - n % top))
        self.numbered += 1

    def emit(self, pieces: list[tuple[int, int, int]], window: int) -> None:
        group = self.open.setdefault(window, [self.groups, 0])
        if not group[1]:
            group[0], self.groups = self.groups, self.groups + 1
        group[1] = (group[1] + 1) % max(1, self.group_tokens // window)
        offset, sequence = 0, self.base + self.sequences
        for length, number, start in pieces:
            doc = self.docs[number]
            crc = zlib.crc32(memoryview(doc[1])[4 * start : 4 * (start + length)])
            self.rows.append((doc[0], start, length, crc, len(doc[1]) // 4, sequence, offset, window, self.base + group[0]))
            offset += length
            doc[2] -= length
            self.held -= length
            if not doc[2]:
                del self.docs[number]
        self.sequences += 1

    def fill(self, window: int) -> list[tuple[int, int, int]]:
        """Pieces for one window, from the pool's longest down; the last is cut to fit."""
        pieces, gap = [], window
        while gap and self.pool:
            k = bisect_right(self.pool, (gap, self.numbered, 0)) - 1
            if k >= 0:
                piece = self.pool.pop(k)
            else:
                length, number, start = self.pool.pop(0)
                piece = (gap, number, start)
                insort(self.pool, (length - gap, number, start + gap))
            pieces.append(piece)
            gap -= piece[0]
        return pieces

    def pack(self) -> None:
        """Packs the pool until it doesn't fill a window any more."""
        left = sum(x[0] for x in self.pool)
        while self.pool:
            window = next(t for t in self.tiers if t >= self.pool[-1][0])
            if left < window:
                break
            self.emit(self.fill(window), window)
            left -= window

    def finish(self) -> None:
        self.pack()
        left = sum(x[0] for x in self.pool)
        while left:
            window = 1 << (left.bit_length() - 1)
            self.emit(self.fill(window), window)
            left -= window

    def batch(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*self.rows, strict=True) if self.rows else [[]] * len(names))], names=names)
        self.rows = []
        return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    tiers: tuple[int, ...] = (512, 1024, 2048, 4096),
    group_tokens: int = 65536,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document, with its place in a sequence (see SCHEMA).

    ``vocabulary`` is the path of a word-level BPE file that every executor has; ``end_id`` ends each
    document. ``tiers`` are powers of two, ascending. Sequences of one ``window`` and ``step_group``
    have ``group_tokens`` tokens together, but for the last groups of a task.

    A null text counts as empty: its one piece is the end id. A null id stays null. Rows that repeat
    an id are documents of their own. Texts of any length are cut into whole windows first. Other
    columns are ignored, and an empty table gives none. sequence_id and step_group are unique, not
    gapless.
    """
    end = end_id.to_bytes(4, "little")
    _text.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocab.word_ids(vocabulary)
        context = TaskContext.get()
        packer = _Packer(tiers, group_tokens, (context.partitionId() if context else 0) << 32)
        try:
            for batch in batches:
                texts = _text.column(batch, 1)
                for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                    packer.add(doc_id, words.ids(text) + end)
                    if packer.held >= BLOCK_TOKENS:
                        packer.pack()
                        yield packer.batch()
            packer.finish()
            yield packer.batch()
        finally:
            words.clear()  # what it remembers is for one task; the worker lives on

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_text.tidy(task), SCHEMA)
