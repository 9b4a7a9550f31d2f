"""Sum-of-squares online packing.

Documents become token ids with an end id and are packed in the order in which a task reads them.
Whole windows are cut from documents as long as the capacity or longer; what is left of each goes,
uncut, to the fill level that leaves the least sum of squares of the numbers of partially filled
windows per level. These numbers stand in one array, ``count[level]``: putting ``size`` tokens into a
window of level h changes the sum by ``2 count[h + size] + 1`` there and by ``1 - 2 count[h]`` here;
an empty or a full window counts nothing. Of equally good levels the fullest is taken.

The windows still open when a task ends would be padded. Since documents may be cut, the tokens of
the emptiest of them fill up the fullest, and the last window left is cut into windows of powers of
two, as such windows are not padded; windows that hold a power of two stay as they are. The same
filling (without the last cut) closes windows when more than ``max_open`` are open, which bounds a
task's memory to ``max_open * capacity`` ids whatever it reads.

One narrow stage packs any number of documents: each task has its level array and its windows, no row
is shuffled, and no window is shared. A task that runs again writes the same windows from the same
rows. Every task leaves at most as many short windows as the capacity has bits.

NULL text is the empty text: its end id only. Ids may be NULL, rows may repeat (each takes a place of
its own), extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lacuna.llm.base import documents, small_batches, table
from lacuna.llm.tokens import BYTE_VOCABULARY, encoder, vocabulary_path, with_end

CAPACITY = 2048
END = 1
MAX_OPEN = 4096
WORST = np.int64(1) << 40


class Piece:
    """Ids of a document from ``start`` on."""

    __slots__ = ("doc", "start", "tokens", "ids")

    def __init__(self, doc: int | None, start: int, tokens: int, ids: np.ndarray):
        self.doc, self.start, self.tokens, self.ids = doc, start, tokens, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.tokens, self.ids[:n]), Piece(self.doc, self.start + n, self.tokens, self.ids[n:])


def is_power(n: int) -> bool:
    return n & (n - 1) == 0


class Levels:
    """The open windows of a task by fill level. Methods return the windows they close, as piece lists."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.count = np.zeros(capacity, np.int64)
        self.into = np.ones(capacity + 1, np.int64)  # what one more window of a level adds to the sum
        self.into[capacity] = 0
        self.out_of = np.full(capacity, WORST)  # what one window less adds; no window: never
        self.out_of[0] = 0
        self.open = 0

    def _change(self, level: int, by: int) -> None:
        self.count[level] += by
        n = int(self.count[level])
        self.into[level] = 2 * n + 1
        self.out_of[level] = 1 - 2 * n if n else WORST
        self.open += by

    def level_for(self, size: int) -> int:
        cost = self.into[size:] + self.out_of[: self.capacity - size + 1]
        return self.capacity - size - int(np.argmin(cost[::-1]))

    def put(self, piece: Piece) -> list[list[Piece]]:
        """Place a piece shorter than the capacity."""
        size = len(piece.ids)
        level = self.level_for(size)
        window = []
        if level:
            window = self.windows[level].pop()
            self._change(level, -1)
        window.append(piece)
        return self._reopen(window, level + size)

    def _reopen(self, window: list[Piece], level: int) -> list[list[Piece]]:
        if level == self.capacity:
            return [window]
        self.windows[level].append(window)
        self._change(level, 1)
        return self.fill() if self.open > self.max_open else []

    def _take_all(self, levels: Iterator[int]) -> list[tuple[int, list[Piece]]]:
        taken = []
        for level in levels:
            taken += [(level, w) for w in self.windows[level]]
            self._change(level, -len(self.windows[level]))
            self.windows[level] = []
        return taken

    def fill(self, ends: bool = False) -> list[list[Piece]]:
        """Fill the fullest open windows from the emptiest; the last one stays open unless ``ends``."""
        every = range(self.capacity - 1, 0, -1)
        closed = [w for _, w in self._take_all(h for h in every if is_power(h))] if ends else []
        rest = self._take_all(iter(every))  # the fullest first
        last = len(rest) - 1
        i = 0
        while i < last:
            level, window = rest[i]
            gap = self.capacity - level
            had, donor = rest[last]
            while gap and donor:
                piece = donor.pop()
                if len(piece.ids) > gap:
                    piece, back = piece.cut(gap)
                    donor.append(back)
                window.append(piece)
                gap -= len(piece.ids)
                had -= len(piece.ids)
            level = self.capacity - gap
            rest[i], rest[last] = (level, window), (had, donor)
            if not gap:
                closed.append(window)
                i += 1
            if not donor:
                last -= 1
        if i <= last:
            level, window = rest[i]
            if level == self.capacity:
                closed.append(window)
            elif ends:
                closed += powers(window)
            else:
                closed += self._reopen(window, level)
        return closed


def powers(window: list[Piece]) -> list[list[Piece]]:
    """The window cut into windows that hold powers of two, the greatest first."""
    left = sum(len(p.ids) for p in window)
    out, queue = [], window[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        some: list[Piece] = []
        while size:
            piece = queue.pop()
            if len(piece.ids) > size:
                piece, back = piece.cut(size)
                queue.append(back)
            some.append(piece)
            size -= len(piece.ids)
        out.append(some)
    return out


def pack_online(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, max_open: int = MAX_OPEN, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens (how many its sequence holds) and, if asked for, the ids."""
    small_batches(df.sparkSession)
    path = path or vocabulary_path(BYTE_VOCABULARY)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        levels = Levels(capacity, max_open)
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, flat, offsets in encode(batch.column("text").cast(pa.string())):
                flat, offsets = with_end(flat, offsets, end)
                closed: list[list[Piece]] = []
                for doc, a, z in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    whole = a + (z - a) // capacity * capacity
                    closed += [[Piece(doc, at - a, z - a, flat[at : at + capacity])] for at in range(a, whole, capacity)]
                    if whole < z:
                        closed += levels.put(Piece(doc, whole - a, z - a, flat[whole:z].copy()))
                yield rows(closed, sequence)
                sequence += len(closed)
        yield rows(levels.fill(ends=True), sequence)

    def rows(closed: list[list[Piece]], sequence: int) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names]
        tokens, bounds = [], [0]
        for number, window in enumerate(closed, sequence):
            offset = 0
            held = sum(len(p.ids) for p in window)
            for p in window:
                n = len(p.ids)
                for column, value in zip(out, (p.doc, p.start, n, zlib.crc32(p.ids.tobytes()), p.tokens, number, offset, held)):
                    column.append(value)
                offset += n
                if ids:
                    tokens.append(p.ids)
                    bounds.append(bounds[-1] + n)
        columns: list[pa.Array] = [pa.array(c, pa.int64()) for c in out]
        if ids:
            columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<u4"), *tokens]).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * ids)

    schema = ", ".join(f"{n} long" for n in names) + (", ids array<int>" if ids else "")
    return documents(df, id_col, text_col).mapInArrow(pack, schema)


def op12_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens, by one level array per task."""
    return pack_online(table(spark, sf_dir, "documents"))
