"""Packing documents into windows of a fixed number of tokens, online, by the sum-of-squares rule.

Every task packs the documents it reads, in the order it reads them, and keeps the windows that are partly filled. A
level array counts them by fill level. Whole windows are cut off a document first; the rest goes to the level at which
the sum of the squared counts grows least (the rule spreads windows over levels, so that for any rest there is soon one
that it completes). A task keeps ``OPEN`` windows at most: beyond that, the fullest is completed by cutting the document.

At the end of a task the emptiest windows are cut up to complete the fullest. What is left is less than one window; it
is cut into sequences whose lengths are powers of two, which need no padding.

There is no shuffle and no state between tasks; a task that is run again writes the same pieces. Null and empty texts
have the end id alone. Repeated ids are packed as separate documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textwarden.llm.columns import narrowed
from textwarden.llm.tokens import word_tokenizer

WINDOW = 2048
OPEN = 256
# Texts tokenized, and pieces handed on, at once.
TEXTS = 256
PIECES = 2048


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens),
            Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens),
        )


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    level: int = 0

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.level += len(piece.ids)


class SumOfSquares:
    """Partly filled windows, and how many there are at each level."""

    def __init__(self, size: int = WINDOW, most: int = OPEN) -> None:
        self.size, self.most, self.open = size, most, 0
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: list[list[Window]] = [[] for _ in range(size + 1)]

    def best_level(self, length: int) -> int:
        """Level that gets a piece of this length; 0 is a new window. Of equal levels the fullest."""
        levels = np.flatnonzero(self.counts[: self.size + 1 - length])
        levels = np.concatenate([[0], levels])
        after = levels + length
        change = np.where(after == self.size, 0, 2 * self.counts[after] + 1)
        change = change - np.where(levels == 0, 0, 2 * self.counts[levels] - 1)
        return int(levels[len(levels) - 1 - np.argmin(change[::-1])])

    def place(self, piece: Piece) -> Iterator[Window]:
        """Put a document away; yields the windows that become full."""
        while len(piece.ids) >= self.size:
            head, piece = piece.cut(self.size)
            full = Window()
            full.put(head)
            yield full
        while length := len(piece.ids):
            level = self.best_level(length)
            if level == 0 and self.open >= self.most:
                level = int(np.flatnonzero(self.counts)[-1])
            window = self._take(level) if level else Window()
            head, piece = piece.cut(min(length, self.size - level))
            window.put(head)
            if window.level == self.size:
                yield window
            else:
                self._keep(window)

    def _take(self, level: int) -> Window:
        self.counts[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def _keep(self, window: Window) -> None:
        self.counts[window.level] += 1
        self.open += 1
        self.windows[window.level].append(window)

    def finish(self) -> Iterator[Window]:
        """Close all windows: full ones, then at most one rest in powers of two."""
        left = [w for level in range(self.size, 0, -1) for w in self.windows[level]]
        while len(left) > 1:
            fullest = left[0]
            giver = left[-1]
            piece = giver.pieces.pop()
            room = self.size - fullest.level
            if len(piece.ids) > room:
                piece, rest = piece.cut(room)
                giver.pieces.append(rest)
            giver.level -= len(piece.ids)
            fullest.put(piece)
            if not giver.level:
                left.pop()
            if fullest.level == self.size:
                yield left.pop(0)
        for window in left:
            pieces = window.pieces[::-1]
            while window.level:
                part = Window()
                power = 1 << window.level.bit_length() - 1
                while part.level < power:
                    head, rest = pieces.pop().cut(power - part.level)
                    part.put(head)
                    if len(rest.ids):
                        pieces.append(rest)
                window.level -= power
                yield part


SCHEMA = (
    "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _pieces(windows: Iterator[Window], first_id: int) -> Iterator[tuple]:
    for sequence_id, window in enumerate(windows, first_id):
        offset = 0
        for p in window.pieces:
            raw = p.ids.astype("<u4", copy=False)
            yield p.doc_id, p.start, len(raw), raw, zlib.crc32(raw.tobytes()), p.doc_tokens, sequence_id, offset
            offset += len(raw)


def _rows(pieces: list[tuple]) -> pa.RecordBatch:
    doc_id, start, length, ids, crc, tokens, sequence, offset = zip(*pieces, strict=True)
    ends = pa.array(np.cumsum([0, *length]), pa.int32())
    numbers = [pa.array(c, pa.int64()) for c in (doc_id, start, length, crc, tokens, sequence, offset)]
    numbers.insert(3, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).view(np.int32))))
    return pa.RecordBatch.from_arrays(
        numbers, names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece, ``SCHEMA``. ``tokenizer`` is the content of a tokenizer file, see ``WordTokenizer``."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        coder = word_tokenizer(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                for doc_id, ids in zip(
                    batch["doc_id"].to_pylist(), coder.encode(batch["text"].to_pylist()), strict=True
                ):
                    yield Piece(doc_id, 0, np.append(ids, np.uint32(end_id)), len(ids) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = SumOfSquares(window)

        def windows() -> Iterator[Window]:
            for piece in documents(batches):
                yield from packer.place(piece)
            yield from packer.finish()

        held: list[tuple] = []
        for piece in _pieces(windows(), TaskContext.get().partitionId() << 40):
            held.append(piece)
            if len(held) == PIECES:
                yield _rows(held)
                held = []
        if held:
            yield _rows(held)

    return narrowed(docs, id_col, text_col).mapInArrow(run, SCHEMA)
