"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every input partition packs its own documents in one pass. Whole windows of a long
document are closed at once; its rest goes, whole, to the fill level that keeps the sum
of squared counts of partly filled windows smallest. A window that is full but for a
small gap leaves the levels and is topped up with the first tokens of the next document.
When a partition ends, the emptiest open windows top up the fullest ones, and the last
short window is cut at powers of two, so that nothing is padded.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.llm.common import table
from strandlight.llm.word_bpe import WordIds

WINDOW = 4096
END_ID = 2
#: Fill levels of a window, and the part of it that is a small gap.
LEVELS, GAP = 64, 32
#: Open windows of a partition, of at most WINDOW * 4 bytes of ids each. With more, the fullest is topped up next.
MAX_OPEN = 256
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

Piece = tuple  # (doc, start, ids as little-endian uint32 bytes)


class Packer:
    """Windows by fill level; closed ones are handed to emit as lists of pieces."""

    def __init__(self, emit: Callable[[list[Piece]], None], window: int = WINDOW, max_open: int = MAX_OPEN) -> None:
        self.emit, self.window, self.max_open = emit, window, max_open
        self.step, self.nearly = max(1, window // LEVELS), window - max(1, window // GAP)
        n = window // self.step + 1
        self.levels = np.zeros(n, np.int64)  # open windows by level
        self.top = np.zeros(n, np.int64)  # the fill of the window that is next of its level
        self.open: list[list[tuple[int, list[Piece]]]] = [[] for _ in range(n)]
        self.n_open = 0
        self.waiting: tuple[int, list[Piece]] | None = None  # the window that is topped up now

    def level_for(self, size: int) -> int | None:
        """The level (None: a new window) with the least growth of the sum of squares; the fullest of equals."""
        n = self.levels
        own = 0 if size > self.nearly else 2 * int(n[size // self.step]) + 1
        at = np.flatnonzero((n > 0) & (self.top + size <= self.window))
        if not len(at):
            return None
        fill = self.top[at] + size
        to = fill // self.step
        grow = 1 - 2 * n[at] + np.where(fill > self.nearly, 0, 2 * n[to] + 1)
        grow[to == at] = 0
        best = len(grow) - 1 - int(np.argmin(grow[::-1]))
        return int(at[best]) if grow[best] <= own else None

    def _pop(self, level: int) -> tuple[int, list[Piece]]:
        found = self.open[level].pop()
        self.levels[level] -= 1
        self.n_open -= 1
        self.top[level] = self.open[level][-1][0] if self.open[level] else 0
        return found

    def add(self, doc: object, ids: bytes) -> None:
        full = self.window * 4
        at = 0
        if self.waiting:
            fill, pieces = self.waiting
            at = min(len(ids), full - fill * 4)
            pieces.append((doc, 0, ids[:at]))
            self._settle(fill + at // 4, pieces)
        while len(ids) - at >= full:
            self.emit([(doc, at // 4, ids[at : at + full])])
            at += full
        if at < len(ids):
            size = (len(ids) - at) // 4
            level = self.level_for(size)
            fill, pieces = (0, []) if level is None else self._pop(level)
            pieces.append((doc, at // 4, ids[at:]))
            self._settle(fill + size, pieces)

    def _settle(self, fill: int, pieces: list[Piece]) -> None:
        """Close a window, have it wait for the next document, or keep it at its level."""
        was_waiting, self.waiting = self.waiting is not None, None
        if fill == self.window:
            self.emit(pieces)
        elif fill > self.nearly or was_waiting:
            self.waiting = (fill, pieces)
        else:
            level = fill // self.step
            self.open[level].append((fill, pieces))
            self.levels[level] += 1
            self.top[level] = fill
            self.n_open += 1
            if self.n_open > self.max_open:
                self.waiting = self._pop(int(np.flatnonzero(self.levels)[-1]))

    def finish(self) -> None:
        """Top up the fullest open windows from the emptiest ones, and cut the last short one at powers of two."""
        windows = deque(sorted((w for level in self.open for w in level), key=lambda w: w[0]))
        if self.waiting:
            windows.append(self.waiting)
        self.open, self.n_open, self.waiting = [[] for _ in self.open], 0, None
        self.levels[:], self.top[:] = 0, 0
        while windows:
            fill, pieces = windows.pop()
            while fill < self.window and windows:
                rest, giving = windows.popleft()
                while giving and fill < self.window:
                    doc, start, ids = giving.pop()
                    take = min(self.window - fill, len(ids) // 4)
                    pieces.append((doc, start, ids[: take * 4]))
                    fill += take
                    rest -= take
                    if take * 4 < len(ids):
                        giving.append((doc, start + take, ids[take * 4 :]))
                if giving:
                    windows.appendleft((rest, giving))
            if fill == self.window:
                self.emit(pieces)
                continue
            while pieces:
                size = 1 << (fill.bit_length() - 1)
                now, room, left = [], size, []
                for doc, start, ids in pieces:
                    take = min(room, len(ids) // 4)
                    if take:
                        now.append((doc, start, ids[: take * 4]))
                        room -= take
                    if take * 4 < len(ids):
                        left.append((doc, start + take, ids[take * 4 :]))
                self.emit(now)
                pieces, fill = left, fill - size


def _runner(path: str, window: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(path)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        out: list[list] = [[] for _ in range(7)]
        held = 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal sequence, held
            offset = 0
            for (doc, total), start, ids in pieces:
                n = len(ids) // 4
                for column, x in zip(out, (doc, start, n, total, sequence, offset, ids), strict=True):
                    column.append(x)
                offset += n
                held += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            b = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:6]), pa.array(out[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            out, held = [[] for _ in range(7)], 0
            return b

        packer = Packer(emit, window)
        for b in batches:
            docs = b.column(0).to_pylist()
            for doc, ids in zip(docs, encode(x.as_py() or "" for x in b.column(1)), strict=True):
                packer.add((doc, len(ids) // 4 + 1), ids + end)
                if held > 2 << 20:
                    yield flush()
            del b, docs  # before the next batch comes
        packer.finish()
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids holds the piece's ids as little-endian 32-bit integers. The pieces of a sequence
    by offset are its content; a sequence is as long as the window or a power of two, so
    that none needs padding. Defined cases: a null or empty text is the end id alone;
    rows that repeat a doc_id are packed each for itself; a null doc_id stays null; an
    empty table packs to nothing. There is no shuffle, and a task keeps at most MAX_OPEN
    open windows, whatever the number or length of its documents: with more, the fullest
    one is topped up with the next documents' first tokens, as a nearly full one is.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_runner(tokenizer_path, window, end_id), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_digest(packed: DataFrame) -> DataFrame:
    """The packed pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(pack(table(spark, sf_dir, "documents"), default_tokenizer()))
