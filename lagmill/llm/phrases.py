"""Mining of collocations from a weighted de Bruijn graph of words.

An edge is a gram of ``LONGEST`` words from its first three to its last three, its weight the number of its occurrences. The
last words of a piece of text are edges into an end symbol, one for each word that has too few words after it, so the count of
a shorter gram is the flow out of its node: the weights of all edges that begin with it, ends included. Single words are
counted before.

1. A block of documents gives its words, coded by its own dictionary; words are counted over the corpus per language.
2. A rare word is in no candidate: it parts a piece as a mark does. Blocks get numbers for their other words, and give their
   distinct edges. Edges meet once, in order: runs of equal first words are the flows out of nodes.
3. Edges between nodes that have no other edge are joined to paths. A path tells at once what its inner grams lie in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagmill.llm.arrays import filled, give_back, slices, tidy, word_lists
from lagmill.session import batches_of, scratch_folder

LONGEST = 4
LEAST = 30
BLOCK_BYTES = 6 << 20
#: Texts come to workers in batches of so many bytes; words and edges go back so many rows at once, codes so many to a row. What
#: is handed over stands in memory beside the heap, which tasks fill.
BATCH_BYTES, ROWS_AT_ONCE, PART_CODES, EDGES_AT_ONCE = 4 << 20, 1 << 13, 1 << 16, 1 << 15
#: Parts in which the edges of a block are sorted.
SHARES = 4
#: The table of blocks: small row groups, and numbers of words take less room by this codec.
BLOCK_FILES = {"parquet.block.size": 8 << 20, "compression": "zstd"}
#: One node in so many ends a path, and so many rounds double what a path pointer spans: paths stay short, cycles are cut.
CUT_NODES, ROUNDS = 8, 5
#: A word that makes one of so many words is hot: edges that begin with two of them are dealt out by their third word too.
HOT_SHARE = 10_000
#: Parts in which the best of a language are found before they meet.
PARTS = 64
UNKNOWN = "und"
_MARKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[list(_MARKS + b"\t")] = 32
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True


def piece_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text of each word, lower-cased words of all texts, whether each word begins a piece)."""
    texts = filled(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[:offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    plain = _LOWER[data]
    bounds, words = word_lists(pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(plain), None, 0, texts.offset))
    inside = plain != 32
    before = np.concatenate([[False], inside[:-1]])[:len(inside)]
    before[offsets[:-1][offsets[:-1] < len(before)]] = False
    starts = np.flatnonzero(inside & ~before)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    marks = np.searchsorted(np.flatnonzero(_IS_MARK[data]), starts)
    fresh = (np.diff(marks, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0)
    return owner, words, fresh


_BLOCK = "block long, at int, lang string, word string, times long, codes binary, size int"


class _Block:
    """Words of consecutive texts, coded by parts of few texts: of a whole block only codes and distinct words are held."""

    def __init__(self):
        self.langs, self.words, self.fresh, self.bytes = [], [], [], 0

    def add(self, part: pa.RecordBatch, size: int) -> None:
        owner, words, fresh = piece_words(part.column("text"))
        langs = pc.fill_null(part.column("lang").cast(pa.string()), UNKNOWN).dictionary_encode()
        self.langs.append(langs.take(pa.array(owner)))
        self.words.append(words.dictionary_encode())
        self.fresh.append(fresh)
        self.bytes += size

    @staticmethod
    def _one(parts: list[pa.DictionaryArray]) -> tuple[np.ndarray, pa.Array]:
        """Places of all parts in one list of values, and that list."""
        parts = pa.chunked_array(parts).unify_dictionaries().chunks
        return np.concatenate([x.indices.to_numpy() for x in parts]), parts[-1].dictionary

    def told(self, number: int) -> Iterator[pa.RecordBatch]:
        (lang, langs), (word, words) = self._one(self.langs), self._one(self.words)
        places = np.flatnonzero(np.concatenate(self.fresh))
        self.langs = self.words = self.fresh = []
        width = max(len(words), 1)
        key = lang.astype(np.int64) * width
        key += word
        del lang, word
        met = pa.array(key).dictionary_encode()
        del key
        own, met = met.dictionary.to_numpy(), met.indices.to_numpy()
        order = np.argsort(own)
        own, times = own[order], np.bincount(met, minlength=len(own))[order]
        place = np.empty(len(own), np.uint16 if len(own) < 1 << 16 else np.uint32)
        place[order] = np.arange(1, len(own) + 1)
        codes = np.insert(place[met], places, 0)
        del met, places
        n = len(own)
        columns = {"at": pa.array(np.arange(n, dtype=np.int32)), "lang": langs.take(pa.array(own // width)), "word": words.take(pa.array(own % width)).cast(pa.string()), "times": pa.array(times.astype(np.int64))}
        rows = _rows(number, n, columns)
        for at in range(0, n, ROWS_AT_ONCE):
            yield rows.slice(at, ROWS_AT_ONCE)
        for at, start in enumerate(range(0, max(len(codes), 1), PART_CODES)):
            part = pa.array([codes[start:start + PART_CODES].tobytes()], pa.binary())
            yield _rows(number, 1, {"at": pa.array([at], pa.int32()), "codes": part, "size": pa.array([n], pa.int32())})


def _rows(number: int, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Rows of a block; columns that are not given are null."""
    kinds = {"block": pa.int64(), "at": pa.int32(), "lang": pa.string(), "word": pa.string(), "times": pa.int64(), "codes": pa.binary(), "size": pa.int32()}
    columns = {"block": pa.array(np.full(n, number)), **columns}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block its distinct (language, word) with counts, each with its place ``at``, and the words of its texts as such places
    plus one in ``codes``, cut into parts that ``at`` numbers; zero parts pieces. ``size`` tells how many words there are. Rows
    are small, and a block goes on over batches."""
    number, block = TaskContext.get().partitionId() << 32, _Block()
    for batch in batches:
        for part in slices(batch, limit=max(BLOCK_BYTES // 8, 1)):
            size = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if block.words and block.bytes + size > BLOCK_BYTES:
                yield from block.told(number)
                number, block = number + 1, _Block()
            block.add(part, size)
    if block.words:
        yield from block.told(number)


def distinct_edges(codes: np.ndarray, ids: np.ndarray, share: int = 0, shares: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first two words, last two words, times) of the distinct edges of a sequence of places in ``ids``, a rising list that
    begins with zero; zero parts pieces. Each word begins one edge; what reaches past its piece is zero. One share of several
    has the edges of every so many first words."""
    begins = np.flatnonzero((codes > 0) & (codes % shares == share) if shares > 1 else codes > 0)
    base = np.uint64(len(ids))
    grams = [codes[begins].astype(np.uint64)]
    for k in range(1, LONGEST):
        later = codes.take(begins + k, mode="clip").astype(np.uint64)
        later[(grams[-1] == 0) | (begins + k >= len(codes))] = 0
        grams.append(later)
    del begins, later
    high, low = grams[0] * base + grams[1], grams[2] * base + grams[3]
    del grams
    narrow = len(ids) <= 1 << 16
    if not narrow:  # two words fit into half a key only by a list of their own
        (highs, high), (lows, low) = np.unique(high, return_inverse=True), np.unique(low, return_inverse=True)
    span = base * base if narrow else np.uint64(max(len(lows), 1))
    key, times = np.unique(high.astype(np.uint64) * span + low.astype(np.uint64), return_counts=True)
    high, low = np.divmod(key, span) if len(key) else (key, key)
    if not narrow:
        high, low = highs[high.astype(np.int64)], lows[low.astype(np.int64)]
    word = lambda x: ids[x.astype(np.int64)]
    return (word(high // base) << 32) | word(high % base), (word(low // base) << 32) | word(low % base), times


def _whole(left: pa.Table) -> pa.Table:
    """The codes of a block as one row, from its parts."""
    parts = left.sort_by("part").column("codes")
    codes = b"".join([x.as_buffer() for x in parts])
    ends = pa.py_buffer(np.array([0, len(codes)]))
    return pa.table({"codes": pa.LargeBinaryArray.from_buffers(pa.large_binary(), 1, [None, ends, pa.py_buffer(codes)]), "size": left.column("size").slice(0, 1)})


def _edges(left: pa.Table, right: pa.Table) -> pa.Table:
    """Edges of a block; words without a number part pieces too."""
    out = []
    ids = right.column("id").to_numpy()
    order = np.argsort(ids)
    own = np.concatenate([[0], ids[order]])
    at = right.column("at").to_numpy().astype(np.int64)[order] + 1
    for raw, size in zip(left.column("codes"), left.column("size").to_pylist()):
        codes = np.frombuffer(raw.as_buffer(), np.uint16 if size < 1 << 16 else np.uint32)
        place = np.zeros(size + 1, np.uint16 if len(own) <= 1 << 16 else np.uint32)
        place[at] = np.arange(1, len(own))
        codes = place[codes]
        for share in range(SHARES):
            high, low, times = distinct_edges(codes, own, share, SHARES)
            two = (high & _LOW) != 0  # of single words all is known
            whole = pa.RecordBatch.from_arrays([pa.array(x[two].astype(np.int64)) for x in (high, low, times)], names=["hi", "lo", "n"])
            out += [whole.slice(k, EDGES_AT_ONCE) for k in range(0, len(whole), EDGES_AT_ONCE)]
            del high, low, times, two, whole
        del codes, place, raw
        give_back()  # workers stay beside those of later stages
    return pa.Table.from_batches(out, pa.schema([(c, pa.int64()) for c in ("hi", "lo", "n")]))


class _Runs:
    """Sums of runs of equal keys over consecutive batches; the last run stays open for the next batch."""

    def __init__(self):
        self.key, self.total, self.partial = None, 0, False

    def add(self, key: tuple[np.ndarray, ...], n: np.ndarray, partial: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        heads = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])]))
        keys, sums = [k[heads] for k in key], np.add.reduceat(n, heads)
        open_ = partial[heads] if partial is not None else np.zeros(len(heads), bool)
        if self.key is not None:
            if all(k[0] == own for k, own in zip(keys, self.key)):
                sums[0] += self.total
            else:
                keys = [np.concatenate([[own], k]) for k, own in zip(keys, self.key)]
                sums, open_ = np.concatenate([[self.total], sums]), np.concatenate([[self.partial], open_])
        self.key, self.total, self.partial = [k[-1] for k in keys], sums[-1], open_[-1]
        return *(k[:-1] for k in keys), sums[:-1], open_[:-1]

    def rest(self) -> tuple[np.ndarray, ...]:
        return *(np.array([k]) for k in self.key or ()), np.array([self.total]), np.array([self.partial])


_LOW = (1 << 32) - 1


def _flows(least: int):
    """Counts of grams from edges in order of their words. Sums of salted nodes are parts and all told."""
    def told(size: int, hi, lo, n, partial) -> pa.RecordBatch:
        real = ((n >= least) | partial) & ((hi & _LOW if size == 2 else lo >> 32 if size == 3 else lo & _LOW) != 0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(real.sum(), size, np.int32)), *(pa.array(x[real].astype(np.int64)) for x in (hi, lo, n))], names=["len", "hi", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        four, three, two = _Runs(), _Runs(), _Runs()
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, n = (batch.column(c).to_numpy() for c in ("hi", "lo", "n"))
            yield told(4, *four.add((hi, lo), n))
            yield told(3, *three.add((hi, lo & ~_LOW), n))
            high, sums, partial = two.add((hi,), n, (hi & hi >> 32 & 1) == 1)
            yield told(2, high, np.zeros_like(high), sums, partial)
        if four.key is not None:
            yield told(4, *four.rest())
            yield told(3, *three.rest())
            high, sums, partial = two.rest()
            yield told(2, high, np.zeros_like(high), sums, partial)

    return run


def _first(c: str) -> Column:
    return F.shiftright(F.col(c), 32)


def _second(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit((1 << 32) - 1))


def _both(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 32).bitwiseOR(b)


def _word(k: int) -> Column:
    return (_first, _second)[k % 2](("hi", "lo")[k // 2])


def _gram(words: list[Column]) -> tuple[Column, Column]:
    """(hi, lo) of a gram of up to four words."""
    four = [*words, *[F.lit(0).cast("long")] * (LONGEST - len(words))]
    return _both(four[0], four[1]), _both(four[2], four[3])


def word_numbers(words: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """(lang, word, n, id) of words that occur ``least`` times or more in their language; ids are small, distinct and positive,
    and those of hot words odd.

    Ids are ranks within hashed buckets, so no task orders all words."""
    counted = words.groupBy("lang", "word").agg(F.sum("times").alias("n"))
    buckets = 1 << 12
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(buckets))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("lang", "word"))
    frequent = counted.where(F.col("n") >= least).withColumn("bucket", bucket)
    frequent.select("lang", "word", "n", (rank.cast("long") * buckets + F.col("bucket") - buckets + 1).alias("id")).write.parquet(path)
    written = words.sparkSession.read.parquet(path)
    hot = F.col("n") * HOT_SHARE >= written.agg(F.sum("n").alias("all")).scalar()
    return written.select("lang", "word", "n", (F.col("id") * 2 + hot.cast("long")).alias("id"))


def gram_counts(edges: DataFrame, least: int = LEAST) -> DataFrame:
    """(len, hi, lo, n) of grams of two to four words that occur ``least`` times or more, from all edges (hi, lo, n).

    One shuffle: edges of a node come together in order, except that those of hot word pairs are dealt out by their third
    word; the parts of such a pair's count are summed afterwards."""
    hot = F.col("hi").bitwiseAND(F.shiftright("hi", 32)).bitwiseAND(F.lit(1)) == 1
    met = edges.repartition(F.col("hi"), F.when(hot, _first("lo"))).sortWithinPartitions("hi", "lo")
    return met.mapInArrow(tidy(_flows(least)), "len int, hi long, lo long, n long").groupBy("len", "hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def unary_paths(edges: DataFrame, at) -> DataFrame:
    """(words, weights) of paths: edges (hi, lo, n) in a row, joined at nodes with one edge in and one out.

    Pointers to the edge before are doubled ``ROUNDS`` times; each round is a table that ``at`` names. Some nodes, by hash, end
    a path in any case. What no pointer reaches the head of by then (a cycle) stays as paths of one edge."""
    spark = edges.sparkSession
    e = edges.select("hi", "lo", "n")
    out_hi, out_lo = _gram([_word(0), _word(1), _word(2)])
    in_hi, in_lo = _gram([_word(1), _word(2), _word(3)])
    this = F.struct("hi", "lo")
    ends = e.select(out_hi.alias("h"), out_lo.alias("l"), this.alias("leaves"), F.lit(None).cast("struct<hi:bigint,lo:bigint>").alias("enters")).unionByName(
        e.select(in_hi.alias("h"), in_lo.alias("l"), F.lit(None).cast("struct<hi:bigint,lo:bigint>").alias("leaves"), this.alias("enters")))
    nodes = ends.groupBy("h", "l").agg(F.count("leaves").alias("outs"), F.count("enters").alias("ins"), F.max("leaves").alias("next"), F.max("enters").alias("prev"))
    inner = nodes.where((F.col("outs") == 1) & (F.col("ins") == 1) & (F.col("next") != F.col("prev")) & (F.pmod(F.xxhash64("h", "l"), F.lit(CUT_NODES)) != 0))
    links = inner.select(F.col("next.hi").alias("hi"), F.col("next.lo").alias("lo"), "prev")
    path = at("path-0")
    e.join(links, ["hi", "lo"], "left").select(
        "hi", "lo", "n", F.coalesce("prev", this).alias("to"), F.when(F.col("prev").isNull(), 0).otherwise(1).alias("far")).write.parquet(path)
    for k in range(1, ROUNDS + 1):
        now = spark.read.parquet(path)
        beyond = now.select(F.col("hi").alias("to_hi"), F.col("lo").alias("to_lo"), F.col("to").alias("next_to"), F.col("far").alias("more"))
        path = at(f"path-{k}")
        now.withColumns({"to_hi": F.col("to.hi"), "to_lo": F.col("to.lo")}).join(beyond, ["to_hi", "to_lo"]).select(
            "hi", "lo", "n", F.col("next_to").alias("to"), (F.col("far") + F.col("more")).alias("far")).write.parquet(path)
    reached = spark.read.parquet(path)
    head = F.when(F.col("far") < 1 << ROUNDS, F.col("to")).otherwise(this)
    grouped = reached.select(head.alias("head"), F.when(F.col("far") < 1 << ROUNDS, F.col("far")).otherwise(0).alias("far"), "hi", "lo", "n").groupBy("head").agg(
        F.array_sort(F.collect_list(F.struct("far", "hi", "lo", "n"))).alias("p"))
    last = F.transform("p", lambda x: x["lo"].bitwiseAND(F.lit((1 << 32) - 1)))
    first = F.array(F.shiftright("head.hi", 32), F.col("head.hi").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("head.lo", 32))
    return grouped.select(F.concat(first, last).alias("words"), F.transform("p", lambda x: x["n"]).alias("weights"))


def covers(paths: DataFrame, counts: DataFrame) -> DataFrame:
    """(len, hi, lo, cover): for grams of two and three words the largest count of a longer candidate they lie in.

    A path gives one row for each place of a gram in it, with the largest weight of the edges around that place."""
    def of(size: int) -> DataFrame:
        # Place i of a gram of this size lies in edges i - (LONGEST - size) to i.
        places = F.sequence(F.lit(0), F.size("words") - size)
        most = lambda i: F.array_max(F.slice("weights", F.greatest(i - (LONGEST - size), F.lit(0)) + 1, F.least(i, F.size("weights") - 1) - F.greatest(i - (LONGEST - size), F.lit(0)) + 1))
        rows = F.transform(places, lambda i: F.struct(*[F.get("words", i + k).alias(f"w{k}") for k in range(size)], most(i).alias("cover")))
        out = paths.select(F.inline(rows))
        hi, lo = _gram([F.col(f"w{k}") for k in range(size)])
        return out.select(F.lit(size).alias("len"), hi.alias("hi"), lo.alias("lo"), "cover")

    three = counts.where("len = 3")
    zero = F.lit(0).cast("long").alias("lo")
    inside = three.select(F.lit(2).alias("len"), "hi", zero, F.col("n").alias("cover")).unionByName(
        three.select(F.lit(2).alias("len"), _both(_word(1), _word(2)).alias("hi"), zero, F.col("n").alias("cover")))
    return of(3).unionByName(of(2)).unionByName(inside).groupBy("len", "hi", "lo").agg(F.max("cover").alias("cover"))


def scored(candidates: DataFrame, counts: DataFrame, numbers: DataFrame) -> DataFrame:
    """``candidates`` (len, hi, lo, a) with ``l``, ``r`` and ``score`` of the lowest-scoring cut, the first of equal ones."""
    single = numbers.select(F.lit(1).alias("len"), F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), "n")
    known = counts.unionByName(single)

    def cut(size: int, k: int) -> Column:
        words = [_word(i) for i in range(size)]
        (a, b), (c, d) = _gram(words[:k]), _gram(words[k:])
        return F.struct(F.lit(k).alias("k"), F.lit(k).alias("len_l"), a.alias("hi_l"), b.alias("lo_l"), F.lit(size - k).alias("len_r"), c.alias("hi_r"), d.alias("lo_r"))

    cuts = F.when(F.col("len") == 2, F.array(cut(2, 1))).when(F.col("len") == 3, F.array(*[cut(3, k) for k in (1, 2)])).otherwise(
        F.array(*[cut(4, k) for k in (1, 2, 3)]))
    rows = candidates.select("len", "hi", "lo", "a", F.inline(cuts))
    side = lambda s: known.select(*[F.col(c).alias(f"{c}_{s}") for c in ("len", "hi", "lo")], F.col("n").alias(s))
    both = rows.join(side("l"), ["len_l", "hi_l", "lo_l"]).join(side("r"), ["len_r", "hi_r", "lo_r"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    both = both.withColumns({"_n": wide("a") * F.lit(2_000_000).cast("decimal(7,0)"), "_d": wide("l") + wide("r")}).withColumn("score", F.expr("_n div _d"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    return both.groupBy("len", "hi", "lo", "a").agg(best).select("len", "hi", "lo", "a", "b.l", "b.r", "b.score")


def mine_phrases(docs: DataFrame, best: int = 2000, least: int = LEAST) -> DataFrame:
    """The ``best`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts (null: none) are lower-cased in A to Z, parted at ``[.,;:!?\\n\\v\\f\\r]`` and then at spaces and tabs. A candidate is a
    phrase of two to four words that occurs ``a >= least`` times within pieces. Of the cuts into two parts that occur l and r
    times the one with the lowest floor(2000000 a / (l + r)) counts. Candidates that lie inside a longer one with at least 80 %
    of their count go. ``n`` counts all words of a language (null: ``und``). Ties go by ``a``, then by phrase in bytes. Repeated
    rows count as often as they stand; other columns are not read.
    """
    spark = docs.sparkSession
    run = scratch_folder(spark, "phrases")
    at = lambda name: f"{run}/{name}"
    with batches_of(spark, BATCH_BYTES):
        docs.select("lang", "text").mapInArrow(tidy(_blocks), _BLOCK).write.options(**BLOCK_FILES).parquet(at("blocks"))
    blocks = spark.read.parquet(at("blocks"))
    words = blocks.where(F.col("word").isNotNull()).select("block", "at", "lang", "word", "times")
    numbers = word_numbers(words, at("words"), least)
    answers = words.join(numbers.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("asker"), "at", "id")
    coded = blocks.where(F.col("codes").isNotNull()).select("block", F.col("at").alias("part"), "codes", "size")
    edges = coded.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(lambda left, right: _edges(_whole(left), right), "hi long, lo long, n long")
    gram_counts(edges, least).write.parquet(at("grams"))
    counts = spark.read.parquet(at("grams"))
    paths = unary_paths(counts.where("len = 4"), at)
    told = counts.join(covers(paths, counts), ["len", "hi", "lo"], "left")
    open_ = told.where(F.col("cover").isNull() | (F.col("cover").cast("decimal(20,0)") * 5 < F.col("n").cast("decimal(20,0)") * 4))
    judged = scored(open_.select("len", "hi", "lo", F.col("n").alias("a")), counts, numbers)
    spelled = judged.select("*", F.posexplode(F.slice(F.array(*[_word(k) for k in range(LONGEST)]), F.lit(1), F.col("len"))).alias("k", "id"))
    spelled = spelled.join(numbers.select("id", "lang", "word"), "id").groupBy("hi", "lo", "len", "a", "l", "r", "score").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = spelled.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = part.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    totals = words.groupBy("lang").agg(F.sum("times").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
