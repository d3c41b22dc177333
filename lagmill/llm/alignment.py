"""Alignment of the tokens of two vocabularies over the same bytes.

Token ends that both sides share cut a text into groups. They are found by divide and conquer: an interval is cut at a common
end near its middle, which a bisection of the other side's ends confirms, and both halves are cut again; an interval without
one is a group. A space or line feed after a character that is no white space starts a token in both vocabularies (checked
when the files are read), so what stands between two of them, a piece, is divided once per distinct piece and task and then
looked up.

Counts of linked ids are corpus-wide: a block of documents asks once for each of its id pairs, and the answers meet the
block's documents again as short lists of numbers; texts never move.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.llm.arrays import filled, ragged, slices
from lagmill.llm.tokens import PieceEncoder, byte_table
from lagmill.session import scratch_folder

#: Bytes of text per block.
BLOCK_BYTES = 4 << 20
#: Distinct pieces a task remembers.
PIECES = 250_000
#: Pieces that are learned at once.
LEARNED = 20_000
#: White space besides ASCII; where a text has any, only spaces after visible ASCII characters part pieces.
_WIDE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def shared_groups(ends_a: np.ndarray, ends_b: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Groups (first A token, token after the last, first B token, token after the last) of many intervals at once, in order.

    ``a`` and ``b`` are bounds of token ranges that end together; ends rise over all of them. Each round halves every open
    interval at the common end found nearest to its middle; the middle's neighbours are tried in turn, all intervals together.
    """
    a0, a1, b0, b1 = (np.asarray(x, np.int64) for x in (*a, *b))
    done: list[tuple[np.ndarray, ...]] = []
    while len(a0):
        inner = a1 - a0 - 1  # ends that might be common; the last end of an interval is
        middle = a0 + inner // 2
        cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)
        trying = np.flatnonzero((inner > 0) & (b1 - b0 > 1))
        step = 0
        while len(trying):
            at = middle[trying] + ((step + 1) // 2 if step % 2 else -(step // 2))
            valid = (at >= a0[trying]) & (at < a1[trying] - 1)
            probe = trying[valid]
            end = ends_a[at[valid]]
            place = np.searchsorted(ends_b, end)
            hit = ends_b[place] == end
            cut_a[probe[hit]], cut_b[probe[hit]] = at[valid][hit] + 1, place[hit] + 1
            step += 1
            trying = trying[(cut_a[trying] < 0) & (step <= inner[trying])]
        leaf = cut_a < 0
        done.append((a0[leaf], a1[leaf], b0[leaf], b1[leaf]))
        open_ = ~leaf
        a0, a1, b0, b1 = (np.concatenate(x) for x in (
            (a0[open_], cut_a[open_]), (cut_a[open_], a1[open_]), (b0[open_], cut_b[open_]), (cut_b[open_], b1[open_])))
    if not done:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    out = [np.concatenate(x) for x in zip(*done)]
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray, lengths_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) places of all tokens that share a byte; both sides cover the same bytes."""
    first = np.searchsorted(ends_b, ends_a - lengths_a, side="right")
    count = np.searchsorted(ends_b, ends_a, side="left") - first + 1
    return np.repeat(np.arange(len(ends_a)), count), ragged(first, count)


@lru_cache(2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(2)
def _plain_tokenizer(path: str):
    """Takes the strings of special tokens for text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(2)
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all ids one after another, start and length of each id's) of a sentence-piece vocabulary."""
    p = _processor(path)
    parts = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]
    if any(c in p.id_to_piece(i).lstrip("▁") for i in range(p.get_piece_size()) for c in "▁\n"):
        raise ValueError("a piece of this vocabulary reaches across a space or a line feed")
    lengths = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


def cut_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row bounds, pieces) of texts that each start with a space: parted before spaces and line feeds that follow no white space."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[:offsets[-1]]
    cut = np.zeros(len(data) + 1, bool)
    visible = data[:-1] > 0x20
    if _WIDE.search(texts.buffers()[2].to_pybytes()[:offsets[-1]].decode()):
        visible &= data[:-1] < 0x7F
    cut[1:-1] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & visible
    cut[offsets] = True
    places = np.flatnonzero(cut)
    pieces = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data))
    return np.searchsorted(places, offsets), pieces


class Aligner:
    """Alignments of pieces, each distinct one worked out once. ``path_a`` is byte-level, ``path_b`` a sentence-piece model."""

    def __init__(self, path_a: str, path_b: str):
        self.encoder, self.plain = PieceEncoder(path_a, entries=1), _plain_tokenizer(path_a)
        self.processor = _processor(path_b)
        self.bytes_a, self.bytes_b = byte_table(path_a), piece_table(path_b)
        self.space = self.processor.piece_to_id("▁")
        self.names_a = [str(i) for i in range(len(self.bytes_a[1]))]
        self.names_b = [str(i) for i in range(len(self.bytes_b[1]))]
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        #: Per piece: A tokens, B tokens, groups, links, whether both sides give back its bytes.
        self.numbers = np.zeros((0, 5), np.int64)
        self.pair_places: dict[int, int] = {}
        self.pairs = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def _ids_b(self, pieces: list[str]) -> list[list[int]]:
        """The model puts a space before a text itself, but not before an empty one; before a line feed it stays alone."""
        found = self.processor.encode([p[p[0] == " ":] for p in pieces], out_type=int, num_threads=1)
        return [(x or [self.space]) if p[0] == " " else x[1:] for p, x in zip(pieces, found)]

    def learn(self, pieces: list[str]) -> None:
        """Adds new pieces. Those with the start of a special string are encoded by themselves."""
        special = [p for p in pieces if "<|" in p]
        if special:
            pieces = [p for p in pieces if "<|" not in p]
            ids = [x.ids for x in self.plain.encode_batch(special, add_special_tokens=False)]
            self._add(special, np.array([len(x) for x in ids]), np.array([i for x in ids for i in x], np.int64))
        if pieces:
            lengths, ids = self.encoder.encode(pa.array(pieces, pa.large_string()))
            self._add(pieces, lengths, ids.astype(np.int64))

    def _add(self, pieces: list[str], count_a: np.ndarray, ids_a: np.ndarray) -> None:
        found = self._ids_b(pieces)
        count_b = np.array([len(x) for x in found], np.int64)
        ids_b = np.fromiter((i for x in found for i in x), np.int64, int(count_b.sum()))
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        own = np.frombuffer(b"".join(raw), np.uint8)
        same = np.ones(len(pieces), bool)
        for count, ids, (data, start, length) in ((count_a, ids_a, self.bytes_a), (count_b, ids_b, self.bytes_b)):
            piece = np.repeat(np.arange(len(pieces)), count)
            same &= np.bincount(piece, length[ids], len(pieces)).astype(np.int64) == size
            fit = same[piece]
            given = data[ragged(start[ids[fit]], length[ids[fit]])]
            wanted = np.repeat(same, size)
            wrong = np.repeat(np.arange(len(pieces)), size)[wanted][given != own[wanted]]
            same[wrong] = False
        keep_a, keep_b = np.repeat(same, count_a), np.repeat(same, count_b)
        ids_a, ids_b, count_a, count_b = ids_a[keep_a], ids_b[keep_b], np.where(same, count_a, 0), np.where(same, count_b, 0)
        length_a = self.bytes_a[2][ids_a]
        ends_a, ends_b = np.cumsum(length_a), np.cumsum(self.bytes_b[2][ids_b])
        last_a, last_b = np.cumsum(count_a), np.cumsum(count_b)
        a0, a1, b0, b1 = shared_groups(ends_a, ends_b, ((last_a - count_a)[same], last_a[same]), ((last_b - count_b)[same], last_b[same]))
        piece_a = np.repeat(np.arange(len(pieces)), count_a)
        n_groups = np.bincount(piece_a[a0], minlength=len(pieces)) if len(a0) else np.zeros(len(pieces), np.int64)
        words_a, words_b = [self.names_a[i] for i in ids_a.tolist()], [self.names_b[i] for i in ids_b.tolist()]
        written = [f"{','.join(words_a[p:q])}|{','.join(words_b[r:s])}" for p, q, r, s in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist())]
        ends = np.cumsum(n_groups).tolist()
        self.groups += [";".join(written[p:q]) for p, q in zip([0, *ends[:-1]], ends)]
        x, y = overlaps(ends_a, ends_b, length_a)
        n_links = np.bincount(piece_a[x], minlength=len(pieces)) if len(x) else np.zeros(len(pieces), np.int64)
        key, inverse = np.unique((ids_a[x] << 32) | ids_b[y], return_inverse=True)
        code = np.fromiter((self.pair_places.setdefault(k, len(self.pair_places)) for k in key.tolist()), np.int64, len(key))
        new = code >= len(self.pairs)
        self.pairs = np.concatenate([self.pairs, key[new][np.argsort(code[new])]])
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, code[inverse]])
        self.places.update(zip(pieces, range(len(self.places), len(self.places) + len(pieces))))
        self.numbers = np.concatenate([self.numbers, np.stack([count_a, count_b, n_groups, n_links, same.astype(np.int64)], 1)])

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...]]:
        """Of texts with a space before each: (A tokens, B tokens, groups and links per text; digests of groups; (text, pair,
        times) of linked id pairs, pairs as places in ``self.pairs``). Texts that a side does not give back have no tokens."""
        bounds, pieces = cut_pieces(texts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.places) + len(distinct) > PIECES:
            self.forget()
        new = [p for p in distinct if p not in self.places]
        for k in range(0, len(new), LEARNED):
            self.learn(new[k:k + LEARNED])
        del new
        place = np.fromiter((self.places[p] for p in distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        n = len(texts)
        text = np.repeat(np.arange(n), np.diff(bounds))
        whole = np.ones(n, bool)
        whole[text[self.numbers[place, 4] == 0]] = False
        whole &= np.diff(np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)) > 1
        place, text = place[whole[text]], text[whole[text]]
        totals = np.stack([np.bincount(text, self.numbers[place, k], n) for k in range(4)], 1).astype(np.int64)
        after = np.cumsum(np.bincount(text, minlength=n))
        listed = place.tolist()
        digests = [hashlib.sha256(";".join(map(self.groups.__getitem__, listed[p:q])).encode()).hexdigest() if q > p else ""
                   for p, q in zip([0, *after[:-1].tolist()], after.tolist())]
        one, times = np.unique(text * len(self.places) + place, return_counts=True)
        text, place = one // len(self.places), one % len(self.places)
        count = self.numbers[place, 3]
        width = max(len(self.pairs), 1)
        key = np.repeat(text, count) * width + self.links[ragged(self.starts[place], count)]
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.repeat(times, count)[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        return totals, digests, (key[heads] // width, key[heads] % width, np.add.reduceat(times, heads) if len(heads) else times)


_ROWS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, at array<int>, times array<int>, "
         "pairs array<long>, docs array<long>")


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _blocks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit=BLOCK_BYTES):
                texts = filled(part.column("text"))
                spaced = filled(pa.array([" " + t for t in texts.to_pylist()], pa.large_string()))
                totals, digests, (text, pair, times) = aligner.align(spaced)
                own, at = np.unique(pair, return_inverse=True)
                n = part.num_rows
                empty = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), *(pa.array(totals[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(np.full(n, number)),
                    _lists(at, np.bincount(text, minlength=n), pa.int32()), _lists(times, np.bincount(text, minlength=n), pa.int32()), empty, empty], names=_NAMES)
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    none, none, none, none, none, pa.nulls(1, pa.string()), pa.array([number]), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())),
                    _lists(aligner.pairs[own], np.array([len(own)]), pa.int64()), _lists(np.bincount(at, minlength=len(own)), np.array([len(own)]), pa.int64())], names=_NAMES)
                number += 1

    return run


_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block with the counts of their links."""
    place = right.column("at").to_numpy()
    counts, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    counts[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
    lists = left.column("at").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(left.num_rows), sizes)
    at, times = lists.flatten().to_numpy(), left.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    sums = []
    for values in (best, counts):
        total = np.zeros(left.num_rows, np.int64)
        np.add.at(total, row, times * values[at])
        sums.append(pa.array(total))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    return pa.table([*(left.column(c) for c in names), *sums, left.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row of ``docs`` (doc_id, text).

    Both sides encode the text with a space before it, without special tokens. Groups end where tokens of both sides end; a
    link is a pair of tokens that share a byte; its count is the number of rows whose texts link the two ids. Null and empty
    texts, and texts of which a side does not give back the bytes, have no tokens: zeros and an empty digest. Rows with one
    or no ``doc_id`` are rows of their own. Other columns are not read.
    """
    spark = docs.sparkSession
    path, counted = scratch_folder(spark, "aligned"), scratch_folder(spark, "pair-counts")
    docs.select("doc_id", "text").mapInArrow(_blocks(path_a, path_b), _ROWS).write.parquet(path)
    rows = spark.read.parquet(path)
    asked = rows.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "p")).select(
        "block", "at", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    asked.groupBy("pair").agg(F.sum("docs").alias("count")).write.parquet(counted)
    counts = spark.read.parquet(counted).withColumn("a", F.shiftright("pair", 32))
    # One row per id of the first vocabulary at most.
    most = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("most")))
    judged = counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    answers = asked.join(judged, "pair").select(F.col("block").alias("asker"), "at", "count", "best")
    aligned = rows.where("pairs is null").drop("pairs", "docs")
    return aligned.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_counted, _RESULT)
