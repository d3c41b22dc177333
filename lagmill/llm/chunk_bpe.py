"""BPE encoding that reuses content-defined chunks, and decoding."""

from __future__ import annotations

import hashlib
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.llm.arrays import filled, ragged, slices
from lagmill.llm.tokens import PieceEncoder, byte_table

#: Bytes under the rolling hash, and low bits of it that must be zero at a cut: chunks of 1 KB on average.
WINDOW, CUT_BITS = 32, 10
#: Most chunks in the table of shared chunks. It bounds what is kept ready, not what is right: any other chunk is encoded
#: where it stands.
SHARED_CHUNKS = 4096
#: Longer chunks (one in three thousand) are not tabled, so that the table has at most 32 MB of text.
LONGEST = 8192
#: Bytes of chunks that a task remembers besides.
MEMORY = 16 << 20

_GEAR = np.random.default_rng(20240).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Whether a chunk may start at each byte: the rolling hash of the ``WINDOW`` bytes before it says so.

    Only the first of neighbouring cut points counts (runs of one byte would else be cut everywhere), and none lies inside a
    character. The hash looks at bytes only, so equal passages are cut alike wherever they stand.
    """
    h = _GEAR[data]
    step = 1
    factor = np.uint32(0x9E3779B1)
    with np.errstate(over="ignore"):
        while step < WINDOW:  # hash of 2 * step bytes from two hashes of step bytes
            h[step:] = h[step:] + factor * h[:-step]
            factor = factor * factor
            step *= 2
    hit = (h >> np.uint32(32 - CUT_BITS)) == 0
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = hit
    cut[2:] &= ~hit[:-1]
    cut[:-1] &= (data & 0xC0) != 0x80
    return cut[:-1]


def safe_points(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a space after a visible ASCII character. The vocabulary's pattern always parts a text there,
    whatever surrounds it, so ids on both sides are independent."""
    safe = np.zeros(len(data), bool)
    safe[1:] = (data[1:] == 0x20) & (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    return safe


class Layout:
    """Texts of a slice as one byte array, with chunk bounds and safe points."""

    def __init__(self, texts: pa.Array):
        texts = filled(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        self.buffer = texts.buffers()[2]
        self.bounds = offsets
        self.data = np.frombuffer(self.buffer, np.uint8)[:offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
        n = len(self.data)
        cut, safe = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        if n > WINDOW:
            cut[:-1] = cut_points(self.data)
            starts = self.bounds[:-1]
            near = ragged(starts, np.minimum(self.bounds[1:] - starts, WINDOW))
            cut[near] = False  # a full window inside the document, else the text before it would matter
        if n:
            safe[:-1] = safe_points(self.data)
        cut[self.bounds] = True
        safe[self.bounds] = True
        self.cuts = np.flatnonzero(cut)
        self.safe = np.flatnonzero(safe)

    def bytes(self, a: int, b: int) -> bytes:
        return self.data[a:b].tobytes()


class ChunkEncoder:
    """Ids of texts from ids of their chunks. ``shared`` maps bytes of chunks to their ids."""

    def __init__(self, path: str, shared: dict | None = None):
        self.pieces = PieceEncoder(path)
        self.shared = shared or {}
        self.recent: OrderedDict[bytes, tuple] = OrderedDict()
        self.held = 0

    def encode_chunks(self, chunks: list[bytes]) -> list[tuple[np.ndarray, int, int]]:
        """(ids, ids of its first piece, ids of its last piece) of each chunk by itself; pieces end at safe points."""
        data = np.frombuffer(b"".join(chunks), np.uint8)
        ends = np.cumsum([len(c) for c in chunks])
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = safe_points(data)
        cut[0] = cut[ends] = True
        places = np.flatnonzero(cut)
        strings = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data))
        lengths, ids = self.pieces.encode(strings)
        after = np.concatenate([[0], np.cumsum(lengths)])
        last = np.searchsorted(places, ends)
        first = np.concatenate([[0], last[:-1]])
        return [(ids[after[a]:after[b]], int(lengths[a]), int(lengths[b - 1])) for a, b in zip(first, last)]

    def _chunks(self, layout: Layout) -> list[tuple]:
        own = [layout.bytes(a, b) for a, b in zip(layout.cuts[:-1], layout.cuts[1:])]
        new = [c for c in dict.fromkeys(own) if c not in self.shared and c not in self.recent]
        fresh = dict(zip(new, self.encode_chunks(new))) if new else {}
        out = [self.shared.get(c) or fresh.get(c) or self.recent[c] for c in own]
        for c, entry in fresh.items():
            self.recent[c] = entry
            self.held += len(c) + entry[0].nbytes
        while self.held > MEMORY:
            c, entry = self.recent.popitem(last=False)
            self.held -= len(c) + entry[0].nbytes
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Chunk ids are kept up to the nearest safe points around each cut; between those points the
        text is encoded again, over as many chunks as it takes until both sides end at a safe point."""
        layout = Layout(texts)
        if not len(layout.data):
            return [np.zeros(0, np.uint32) for _ in range(len(texts))]
        entries = self._chunks(layout)
        cuts, safe = layout.cuts, layout.safe
        at = np.searchsorted(safe, cuts)
        clean = safe[np.minimum(at, len(safe) - 1)] == cuts
        before, behind = safe[np.maximum(at - 1, 0)], safe[np.minimum(at, len(safe) - 1)]
        left, right = np.where(clean, cuts, before), np.where(clean, cuts, behind)
        joins = sorted({(int(a), int(b)) for a, b in zip(left[~clean], right[~clean])})
        repaired = {}
        if joins:
            lengths, ids = self.pieces.encode(pa.array([layout.bytes(a, b).decode() for a, b in joins], pa.large_string()))
            repaired = dict(zip((a for a, _ in joins), np.split(ids, np.cumsum(lengths)[:-1])))
        out, row, done = [], [], -1
        doc = 0
        bounds = layout.bounds
        while doc < len(texts) and bounds[doc] == bounds[doc + 1]:
            out.append(np.zeros(0, np.uint32))
            doc += 1
        for k, (ids, first, last) in enumerate(entries):
            start, stop = right[k], left[k + 1]
            if start < stop:
                row.append(ids[0 if clean[k] else first:len(ids) - (0 if clean[k + 1] else last)])
            if not clean[k + 1] and left[k + 1] > done:
                row.append(repaired[int(left[k + 1])])
                done = left[k + 1]
            if cuts[k + 1] == bounds[doc + 1]:
                out.append(np.concatenate(row) if row else np.zeros(0, np.uint32))
                row = []
                doc += 1
                while doc < len(texts) and bounds[doc] == bounds[doc + 1]:
                    out.append(np.zeros(0, np.uint32))
                    doc += 1
        return out


class Decoder:
    """Text of ids of a byte-level vocabulary, special ids included; broken UTF-8 becomes replacement characters."""

    def __init__(self, path: str):
        self.table, self.starts, self.lengths = byte_table(path)

    def decode(self, ids: np.ndarray) -> str:
        return self.table[ragged(self.starts[ids], self.lengths[ids])].tobytes().decode("utf-8", "replace")


def shared_chunks(docs: DataFrame, path: str, most: int = SHARED_CHUNKS) -> dict:
    """Chunks that save most when encoded once: the ``most`` with the largest (times found - 1) x bytes.

    All chunks of all texts are counted, by digest and within tasks first. Only chosen chunks are then carried as text,
    encoded once each, and brought back; at most ``most`` chunks of at most ``LONGEST`` bytes.
    """
    import xxhash

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for part in slices(batch):
                layout = Layout(part.column("text"))
                found.update((xxhash.xxh3_64_intdigest(layout.bytes(a, b)) >> 1, int(b - a))
                             for a, b in zip(layout.cuts[:-1], layout.cuts[1:]) if b - a <= LONGEST)
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in keys], pa.int64()), pa.array([n for _, n in keys], pa.int64()),
                                              pa.array(list(found.values()), pa.int64())], ["digest", "size", "n"])

    texts = docs.select("text").where("text <> ''")
    counted = texts.mapInArrow(count, "digest long, size long, n long").groupBy("digest", "size").agg(F.sum("n").alias("n"))
    chosen = counted.where("n > 1").orderBy(F.expr("(n - 1) * size").desc(), "digest", "size").limit(most)
    wanted = frozenset(r["digest"] for r in chosen.collect())
    if not wanted:
        return {}
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out = []
            for part in slices(batch):
                layout = Layout(part.column("text"))
                for a, b in zip(layout.cuts[:-1], layout.cuts[1:]):
                    if b - a <= LONGEST:
                        chunk = layout.bytes(a, b)
                        digest = xxhash.xxh3_64_intdigest(chunk) >> 1
                        if digest in known.value and digest not in seen:
                            seen.add(digest)
                            out.append((digest, chunk))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())],
                                             ["digest", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            entries = encoder.encode_chunks(chunks) if chunks else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.binary()), pa.array([e[0].tobytes() for e in entries], pa.binary()),
                 pa.array([e[1] for e in entries], pa.int64()), pa.array([e[2] for e in entries], pa.int64())],
                ["chunk", "ids", "first", "last"])

    once = texts.mapInArrow(fetch, "digest long, chunk binary").groupBy("digest").agg(F.min("chunk").alias("chunk"))
    rows = once.select("chunk").mapInArrow(encode, "chunk binary, ids binary, first long, last long").collect()
    return {bytes(r["chunk"]): (np.frombuffer(bytes(r["ids"]), np.uint32), r["first"], r["last"]) for r in rows}


def encode_documents(docs: DataFrame, path: str, most: int = SHARED_CHUNKS) -> DataFrame:
    """``doc_id``, ``n_tokens``, digests of the ids and of the text decoded from them, for every row.

    Ids are those of the tokenizers library for the whole text (``path`` is a byte-level vocabulary), without truncation and
    padding; special strings in a text get their special ids. Null texts are empty; repeated rows give repeated results;
    only ``doc_id`` and ``text`` are read. Texts are never shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = ChunkEncoder(path, shared.value), Decoder(path)
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                     pa.array([hashlib.sha256(decoder.decode(x).encode()).hexdigest() for x in ids], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
