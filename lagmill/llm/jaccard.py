"""Jaccard self-join of documents on word shingles by chosen paths.

Sets are stood for by minima of hashed shingles: two sets agree on a minimum with the probability of their similarity. A path
samples one or two of the minima at each node, the same for every set, and goes on with the values found there; sets with
equal paths meet in a bucket. A run follows every set to ``DEPTH``; runs are repeated until similar sets have met with the
target probability. Buckets are compared by brute force on short sketches; large ones in blocks. Sets that sketches call
similar, with a margin, form clusters, and within clusters all pairs are verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.llm.arrays import filled, mixed, ragged, run_hashes, slices, word_hashes, word_lists
from lagmill.llm.components import components
from lagmill.session import scratch_folder

SHINGLE = 5
#: Similarity as a fraction: 4 / 5.
NEAR = (4, 5)
MINIMA = 64
DEPTH = 3
RECALL = 0.999
#: Chance that a node of a path samples two minima, not one: 1.25 on average, the inverse of the similarity.
SECOND = 0.25
#: Share of equal minima from which a pair is verified: 3.6 standard deviations below the similarity.
MARGIN = 0.62
#: Sets of a bucket, and of a cluster, that are compared within one group of rows; more are cut into blocks of about so many.
BUCKET_BLOCK, CLUSTER_BLOCK = 400, 150
_ODD = (np.random.default_rng(5).integers(1 << 62, 1 << 63, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def chance_to_meet(similarity: float, depth: int = DEPTH) -> float:
    """Probability that two sets share a path of ``depth`` nodes in one run."""
    meet = 1.0
    for _ in range(depth):
        one = similarity * meet
        meet = (1 - SECOND) * one + SECOND * (1 - (1 - one) ** 2)
    return meet


def runs_needed(recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - chance_to_meet(NEAR[0] / NEAR[1])))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles of each text, their distinct hashes in order). Fewer words than a shingle are one shingle."""
    bounds, flat = word_lists(texts)
    h = word_hashes(flat)
    lengths = np.diff(bounds)
    starts = ragged(bounds[:-1], np.maximum(lengths - SHINGLE + 1, 0))
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths - SHINGLE + 1, 0))
    hashes = run_hashes(h, SHINGLE)[starts] if len(starts) else np.zeros(0, np.uint64)
    few = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(few):
        alone = np.array([run_hashes(h[bounds[k]:bounds[k + 1]], int(lengths[k]))[0] for k in few], np.uint64)
        hashes, owner = np.concatenate([hashes, mixed(alone + _STEP)]), np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=len(lengths)), hashes[new]


def sketches(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name of each set that is not empty, its minima)."""
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    minima = np.empty((len(heads), MINIMA), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(MINIMA if len(heads) else 0):
            minima[:, k] = mixed(np.minimum.reduceat(hashes * _ODD[k], heads)) >> np.uint64(32)
    return names(sizes, hashes), minima


def names(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Name of each set that is not empty; equal sets have equal names."""
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mixed(hashes + _STEP), heads) if len(heads) else np.zeros(0, np.uint64)
        return mixed(sums + sizes[sizes > 0].astype(np.uint64))


def paths(minima: np.ndarray, runs: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of all paths of all runs; a path names its run, the minima it sampled and their values."""
    rows, found = [], []
    with np.errstate(over="ignore"):
        for run in range(runs):
            row = np.arange(len(minima))
            path = np.full(len(minima), np.uint64(run + 1) * _STEP, np.uint64)
            for _ in range(depth):
                draw = mixed(path + np.uint64(17))
                first = (draw % np.uint64(MINIMA)).astype(np.int64)
                second = ((draw >> np.uint64(20)) % np.uint64(MINIMA)).astype(np.int64)
                two = np.flatnonzero(((draw >> np.uint64(40)) < np.uint64(int(SECOND * (1 << 24)))) & (second != first))
                at = np.concatenate([np.arange(len(row)), two])
                coordinate = np.concatenate([first, second[two]])
                row = row[at]
                path = mixed(path[at] * _STEP + mixed((coordinate.astype(np.uint64) << np.uint64(32)) + minima[row, coordinate]))
            rows.append(row)
            found.append(path)
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _linked(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest position that links reach, for each position; ``label`` has what earlier links reach."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows in order, cut only where a key changes, so that a group is never parted."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None and rest.num_rows else table
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.ones(table.num_rows, bool)
    change[1:] = False
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _in_blocks(rows: DataFrame, sizes: DataFrame, key: str, block: int) -> DataFrame:
    """Rows of groups of two or more, once for each pair (p, q) of blocks of their group that holds theirs.

    ``sizes`` has the number of rows of each group; a group of up to ``block`` rows is one pair.
    """
    many = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return (
        rows.join(sizes.where("size > 1").withColumn("blocks", many), key).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("size", "blocks", "other")
        .repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", "node")
    )


def near_by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between sets of a bucket whose sketches agree enough; of the buckets at hand a spanning forest only."""
    least = int(math.ceil((MARGIN + (1 - MARGIN) / 256) * MINIMA))
    for table in _groups(batches, ["path", "p", "q"]):
        node = table.column("node").to_numpy()
        own, p, q = (table.column(c).to_numpy() for c in ("own", "p", "q"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, MINIMA)
        bounds = _bounds(table, ["path", "p", "q"])
        end = np.repeat(bounds[1:], np.diff(bounds))
        after = end - np.arange(len(node)) - 1
        total = np.cumsum(after)
        distinct, place = np.unique(node, return_inverse=True)
        label = np.arange(len(distinct))
        at = 0
        while at < len(node):
            base = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + 200_000, side="right")))
            a = np.repeat(np.arange(at, stop), after[at:stop])
            b = ragged(np.arange(at, stop) + 1, after[at:stop])
            across = (p[a] == q[a]) | (own[a] != own[b])
            a, b = a[across], b[across]
            close = (sketch[a] == sketch[b]).sum(axis=1) >= least
            a, b = a[close], b[close]
            label = _linked(place[a], place[b], label)
            at = stop
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(distinct[moved]), pa.array(distinct[label[moved]])], ["a", "b"])


def near_by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, links, peer) for each group of a cluster: the copies of the sets it is near to, and a set its links reach."""
    for table in _groups(batches, ["label", "p", "q"]):
        bounds = _bounds(table, ["label", "p", "q"])
        out = []
        for x, y in zip(bounds[:-1], bounds[1:]):
            part = table.slice(x, y - x)
            node, pick = np.unique(part.column("node").to_numpy(), return_index=True)  # repeated rows give a set twice
            part = part.take(pa.array(pick))
            if len(node) < 2:
                continue
            own, copies = part.column("own").to_numpy(), part.column("copies").to_numpy()
            tokens = [np.frombuffer(v, np.uint64) for v in part.column("shingles").to_pylist()]
            size = np.array([len(t) for t in tokens])
            shared = _common(tokens, size)
            near = (NEAR[0] + NEAR[1]) * shared >= NEAR[0] * (size[:, None] + size[None])
            np.fill_diagonal(near, False)
            if part.column("p")[0].as_py() != part.column("q")[0].as_py():
                near &= own[:, None] != own[None]
            a, b = np.nonzero(near)
            if len(a):
                label = _linked(a, b, np.arange(len(node)))
                out.append((node, near @ copies, node[label]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["node", "links", "peer"])


def _common(tokens: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Number of shared tokens of each two sets, by products of 0/1 matrices over 4,096 tokens at a time."""
    _, inverse, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(tokens)), size)
    rank = np.cumsum(times > 1) - 1  # a token of one set is shared with none
    several = times[inverse] > 1
    row, column = row[several], rank[inverse[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(tokens), len(tokens)), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        have = np.zeros((len(tokens), min(4096, int(column[-1]) + 1 - low)), np.float32)
        have[row[a:b], column[a:b] - low] = 1
        shared += have @ have.T
    return shared


def near_classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) for every row of ``docs``.

    Documents are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. ``class_id`` is the
    smallest ``doc_id`` that links reach, ``n_copies`` the rows with the same set, this one included, ``n_links`` the other
    rows it is linked to, copies included. Texts without words are linked to none; a null ``doc_id`` has its own null class.
    Repeated rows are copies. Only ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    runs = runs_needed(recall)
    sets_at, distinct_at = scratch_folder(spark, "sets"), scratch_folder(spark, "distinct")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, hashes = shingle_sets(filled(part.column("text")))
                name, minima = sketches(sizes, hashes)
                node = np.zeros(len(sizes), np.uint64)
                node[sizes > 0] = name
                packed = np.full(len(sizes), None, object)
                packed[sizes > 0] = [m.tobytes() for m in minima]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(node.view(np.int64), mask=sizes == 0), pa.array(packed, pa.binary())],
                    ["doc_id", "node", "minima"])

    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, node long, minima binary").write.parquet(sets_at)
    members = spark.read.parquet(sets_at)
    (members.where("node is not null and doc_id is not null").groupBy("node")
     .agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("minima").alias("minima")).write.parquet(distinct_at))
    distinct = spark.read.parquet(distinct_at)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                minima = np.frombuffer(b"".join(part.column("minima").to_pylist()), np.uint32).reshape(-1, MINIMA)
                row, path = paths(minima, runs)
                # A path that two samples lead to counts once.
                _, once = np.unique(mixed(path + row.astype(np.uint64)), return_index=True)
                yield pa.RecordBatch.from_arrays([_signed(path[once]), part.column("node").take(pa.array(row[once]))], ["path", "node"])

    steps = distinct.select("node", "minima").mapInArrow(follow, "path long, node long")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(-1, MINIMA).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([m.tobytes() for m in minima], pa.binary())], ["node", "sketch"])

    short = distinct.select("node", "minima").mapInArrow(shorten, "node long, sketch binary")
    met = steps.join(steps.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "path")
    met_at = scratch_folder(spark, "met")
    met.join(short, "node").write.parquet(met_at)
    met = spark.read.parquet(met_at)
    buckets = _in_blocks(met.select("path", "node", "sketch"), met.select("path", "size").distinct(), "path", BUCKET_BLOCK)
    clusters = components(buckets.select("path", "p", "q", "own", "node", "sketch").mapInArrow(near_by_sketch, "a long, b long"))

    sizes = clusters.groupBy("label").agg(F.count("*").alias("size"))
    wanted = clusters.join(distinct.select("node", "first", "copies"), "node").withColumnRenamed("first", "doc_id")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, hashes = shingle_sets(filled(part.column("text")))
                name = names(sizes, hashes)
                ends = np.cumsum(sizes)
                keep = np.flatnonzero((sizes > 0))
                keep = keep[name.view(np.int64) == part.column("node").to_numpy()[keep]]  # of rows with one doc_id, the right text
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(keep)) for c in ("label", "node", "copies")),
                     pa.array([hashes[ends[k] - sizes[k]:ends[k]].tobytes() for k in keep], pa.binary())],
                    ["label", "node", "copies", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id").select("label", "node", "copies", "text")
    sets = texts.mapInArrow(whole, "label long, node long, copies long, shingles binary")
    verified_at = scratch_folder(spark, "verified")
    (_in_blocks(sets, sizes, "label", CLUSTER_BLOCK).select("label", "p", "q", "own", "node", "copies", "shingles")
     .mapInArrow(near_by_sets, "node long, links long, peer long").write.parquet(verified_at))
    verified = spark.read.parquet(verified_at)
    classes = components(verified.where("node <> peer").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    named = (
        distinct.select("node", "first", "copies").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    )
    least = named.groupBy("label").agg(F.min("first").alias("class_id"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = named.join(least, "label").join(links, "node", "left").select("node", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    known = known.withColumnRenamed("node", "known_node")
    return members.join(known, F.when(F.col("doc_id").isNotNull(), F.col("node")) == F.col("known_node"), "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows of a class other than its first document; all columns as they are.

    Rows of one ``doc_id`` are one document. Rows with a null ``doc_id`` and texts without words stay.
    """
    classes = near_classes(docs).where("doc_id is not null and class_id <> doc_id").select("doc_id").distinct()
    return docs.join(classes, "doc_id", "left_anti")
