"""Sum-of-squares online packing of tokenized documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lagmill.llm.arrays import filled, slices, tidy, word_lists
from lagmill.llm.tokens import piece_encoder

SIZE = 2048
#: Partially filled windows that a task keeps; beyond it the fullest level is emptied.
OPEN = 512
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class SumOfSquares:
    """Windows of ``size`` ids. ``counts[h]`` is the number of windows filled up to level ``h``, 0 < h < size.

    A piece goes to the level where the sum of squared counts ends up smallest; equal ones: to the fullest. Full windows
    leave at once. When more than ``most`` windows are open, those of the most crowded level are laid end to end and cut
    at ``size``; so are all at the end, and what is left over then is parted into sequences of powers of two, which need
    no padding.
    """

    def __init__(self, size: int = SIZE, first: int = 0, most: int = OPEN):
        self.size, self.next_id, self.most = size, first, most
        self.counts = np.zeros(size, np.int64)
        self.levels: list[list[list[tuple]]] = [[] for _ in range(size)]
        self.open = 0
        self.rows: list[tuple] = []

    def _emit(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def _keep(self, window: list[tuple], level: int) -> None:
        self.levels[level].append(window)
        self.counts[level] += 1
        self.open += 1

    def _take(self, level: int) -> list[tuple]:
        self.counts[level] -= 1
        self.open -= 1
        return self.levels[level].pop()

    def level_for(self, length: int) -> int:
        """Fill level at which a piece of ``length`` < size is placed; 0 is a new window."""
        upto = self.size - length
        used = np.flatnonzero(self.counts[:upto + 1])
        if not len(used):
            return 0
        after = self.counts.take(used + length, mode="clip")
        if used[-1] == upto:  # a window that gets full is counted no more
            after[-1] = 0
        change = 2 * (after - self.counts[used]) + 2 - (used == upto)
        best = len(used) - 1 - int(np.argmin(change[::-1]))
        return int(used[best]) if change[best] <= 2 * self.counts[length] + 1 else 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.size
        for start in range(0, whole, self.size):
            self._emit([(doc, start, ids[start:start + self.size], total)])
        if whole < total:
            self._place((doc, whole, ids[whole:].copy(), total))
        if self.open > self.most:
            crowded = int(np.argmax(self.counts))
            rest = self._lay([self._take(crowded) for _ in range(int(self.counts[crowded]))])
            if rest:
                self._keep(rest, sum(len(p[2]) for p in rest))

    def _place(self, piece: tuple) -> None:
        level = self.level_for(len(piece[2]))
        window = (self._take(level) if level else []) + [piece]
        filled_to = level + len(piece[2])
        self._emit(window) if filled_to == self.size else self._keep(window, filled_to)

    def _lay(self, windows: list[list[tuple]]) -> list[tuple]:
        """Emits full sequences of the windows' pieces laid end to end; returns the rest."""
        row, room = [], self.size
        for doc, start, ids, total in (p for w in windows for p in w):
            while len(ids):
                row.append((doc, start, ids[:room], total))
                start, ids, room = start + len(ids[:room]), ids[room:], room - len(ids[:room])
                if not room:
                    self._emit(row)
                    row, room = [], self.size
        return row

    def finish(self) -> None:
        rest = self._lay([self._take(h) for h in range(self.size - 1, 0, -1) for _ in range(int(self.counts[h]))])
        left = sum(len(p[2]) for p in rest)
        while left:
            part = 1 << (left.bit_length() - 1)
            row, room = [], part
            while room:
                doc, start, ids, total = rest.pop(0)
                row.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= len(row[-1][2])
            self._emit(row)
            left -= part

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [[]] * len(PIECES)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence.

    Documents are tokenized (``tokenizer`` is a vocabulary file that parts words at white space), ``end_id`` is added, and
    each task packs the documents it reads, in their order: no shuffle, open windows bounded, no sequence across tasks.
    Null and empty texts are the end id alone; repeated rows are packed each; only ``doc_id`` and ``text`` are read. An
    empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = piece_encoder(tokenizer)
        packer = SumOfSquares(size, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in slices(batch):
                bounds, flat = word_lists(filled(part.column("text")))
                lengths, ids = encoder.encode(flat)
                ends = np.concatenate([[0], np.cumsum(lengths)])[bounds]
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    packer.add(doc, np.append(ids[ends[k]:ends[k + 1]], np.uint32(end_id)))
                yield packer.drain()
        packer.finish()
        yield packer.drain()

    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
