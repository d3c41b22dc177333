"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact scaled forward scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.llm.arrays import filled, slices, word_lists
from lagmill.session import scratch_folder

STATES = 8
#: Words of at least one in so many tokens (no more words than that can be) have a class of their own; the others share
#: classes by hash.
OWN_SHARE, SHARED_CLASSES = 1 << 15, 1024
#: Rounds on the starting sample (at most so many documents and ids), then over all training documents.
START_DOCUMENTS, SPAN_IDS, START_ROUNDS, ROUNDS = 600, 500, 15, 3
#: Characters of the documents that are encoded together with the counts of their words.
GROUP_CHARS = 6_000_000
#: The end of a document as a word: no word holds white space.
END = "\n"
#: Strength of the prior that keeps every class possible in every state.
PRIOR = 50.0


def lower_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    return word_lists(pc.ascii_lower(filled(texts)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, A-Z lower-cased, with one end per document; counted within tasks before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, flat = lower_words(part.column("text"))
                coded = flat.dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END])]), pa.array(np.append(n, part.num_rows))],
                    ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shared_class() -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(SHARED_CLASSES)).cast("int")


def with_classes(counts: DataFrame, tokens: int) -> tuple[DataFrame, int]:
    """((word, n, class), number of classes): frequent words follow the shared classes, in order."""
    names = sorted(r["word"] for r in counts.where(F.col("n") * OWN_SHARE >= tokens).select("word").collect())  # OWN_SHARE at most
    own = counts.sparkSession.createDataFrame([(w, SHARED_CLASSES + k) for k, w in enumerate(names)], "word string, class int")
    joined = counts.join(F.broadcast(own), "word", "left")
    return joined.select("word", "n", F.coalesce("class", _shared_class()).alias("class")), SHARED_CLASSES + len(names)


@dataclass
class Model:
    """``start`` (K), ``move`` (K x K) and ``emit`` (classes x K) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Packed:
    """Sequences side by side in time: the longest first, so that those still running at a step are the first ones."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        steps = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        row = np.repeat(np.arange(len(sizes)), sizes)
        time = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.ids = np.empty(len(row), np.int64)
        if len(row):
            self.ids[self.at[time] + row] = np.concatenate([sequences[k] for k in self.order])


def states(model: Model, packed: Packed, seen: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(scale of each step, scaled states if kept) from the emission probabilities ``seen`` of each step."""
    scales = np.empty(len(packed.ids))
    kept = np.empty_like(seen) if keep else None
    ones = np.ones(len(model.start))
    state = None
    for t, n in enumerate(packed.active):
        a, b = packed.at[t], packed.at[t + 1]
        state = (model.start if t == 0 else state[:n] @ model.move) * seen[a:b]
        scale = np.dot(state, ones, out=scales[a:b])
        state = np.divide(state, scale[:, None], out=kept[a:b] if keep else state)
    return scales, kept


def forward(model: Model, packed: Packed, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(natural log likelihood of each sequence in the packed order, scale of each step, scaled states if kept)."""
    scales, kept = states(model, packed, model.emit[packed.ids], keep)
    logs = np.zeros(len(packed.order))
    place = np.arange(len(packed.ids)) - np.repeat(packed.at[:-1], packed.active)
    np.add.at(logs, place, np.log(scales))
    return logs, scales, kept


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions (Baum-Welch) over some sequences."""
    packed = Packed(sequences)
    k = len(model.start)
    starts, moves, emissions = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))
    if not len(packed.ids):
        return starts, moves, emissions
    seen = model.emit[packed.ids]
    scales, gamma = states(model, packed, seen, True)
    seen /= scales[:, None]
    back = np.ascontiguousarray(model.move.T)
    beta = np.ones((0, k))
    for t in range(len(packed.active) - 1, -1, -1):
        a, b, n = packed.at[t], packed.at[t + 1], packed.active[t]
        if len(beta) < n:  # sequences that end here
            beta = np.concatenate([beta, np.ones((n - len(beta), k))])
        gamma[a:b] *= beta
        if t:
            weighted = np.multiply(beta, seen[a:b], out=seen[a:b])
            before = packed.at[t - 1]
            moves += gamma[before:before + n].T @ weighted  # not yet multiplied: the scaled states of the step before
            beta = weighted @ back
    for j in range(k):
        emissions[:, j] = np.bincount(packed.ids, gamma[:, j], len(model.emit))
    return gamma[:packed.active[0]].sum(axis=0), moves * model.move, emissions


def improved(counts: tuple[np.ndarray, np.ndarray, np.ndarray], overall: np.ndarray) -> Model:
    """The model of most likelihood for the counts, with priors; ``overall`` is the share of each class."""
    starts, moves, emissions = counts
    k = len(starts)
    emit = emissions + PRIOR * overall[:, None]
    return Model((starts + 1) / (starts.sum() + k), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def beginning(overall: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    emit = (overall[:, None] + 1e-12) * rng.uniform(0.5, 1.5, (len(overall), states))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def encoded_documents(docs: DataFrame, known: DataFrame, tokens: int, kinds: int, class_size: np.ndarray, chars: int) -> DataFrame:
    """Per document its class ids and what needs the counts of its words.

    Documents are dealt by hash into groups of about ``GROUP_CHARS`` characters. Each group asks for its distinct words; the
    join on words meets a frequent word once per group, and the answers go back to the group. No list of all words is held.
    ``class_size`` is the sum of tokens and kinds of each class.
    """
    groups = max(1, -(-chars // GROUP_CHARS))
    grouped = docs.select("doc_id", "held_out", "learned", "text").withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))

    def ask(key, table):
        found = [lower_words(part.column("text"))[1].unique() for batch in table.combine_chunks().to_batches() for part in slices(batch)]
        words = pa.chunked_array([*found, [END]], found[0].type if found else pa.string()).unique().cast(pa.string())
        return pa.table({"g": pa.array(np.full(len(words), key[0].as_py(), np.int32)), "word": words})

    asked = grouped.groupBy("g").applyInArrow(ask, "g int, word string")
    answers = asked.join(known, "word", "left").select("g", "word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", _shared_class()).alias("class"))
    total = float(tokens + kinds + 1)
    log_total = np.log10(total)

    def encode(left, right):
        words = right.column("word").combine_chunks().cast(pa.large_string())
        n = right.column("n").to_numpy().astype(np.float64)
        code = right.column("class").to_numpy().astype(np.int64)
        base = np.log10(n + 1) - log_total
        inner = np.where(code >= SHARED_CLASSES, 0.0, np.log10(n + 1) - np.log10(class_size[code] + 1))
        end = words.index(pa.scalar(END, pa.large_string())).as_py() if left.num_rows else 0
        out = {k: [] for k in ("doc_id", "held_out", "learned", "n_tokens", "n_known", "base_score", "inner", "ids")}
        for batch in left.combine_chunks().to_batches():
            for part in slices(batch):
                bounds, flat = lower_words(part.column("text"))
                at = pc.index_in(flat.cast(pa.large_string()), words).to_numpy(zero_copy_only=False).astype(np.int64)
                for k in range(part.num_rows):
                    row = np.append(at[bounds[k]:bounds[k + 1]], end)
                    out["n_tokens"].append(len(row))
                    out["n_known"].append(int((n[row] > 0).sum()))
                    out["base_score"].append(float(base[row].sum()))
                    out["inner"].append(float(inner[row].sum()))
                    out["ids"].append(code[row].astype("<u2").tobytes())
                for c in ("doc_id", "held_out", "learned"):
                    out[c] += part.column(c).to_pylist()
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "held_out": pa.array(out["held_out"], pa.bool_()),
                         "learned": pa.array(out["learned"], pa.bool_()),
                         "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
                         "base_score": pa.array(out["base_score"], pa.float64()), "inner": pa.array(out["inner"], pa.float64()),
                         "ids": pa.array(out["ids"], pa.binary())})

    return grouped.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(
        encode, "doc_id long, held_out boolean, learned boolean, n_tokens long, n_known long, base_score double, inner double, ids binary")


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column("ids").to_pylist()]


def train(encoded: DataFrame, overall: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch. The starting point comes from spans at random places of a bounded number of documents, those of the
    smallest hashes; each round then counts over all rows of ``encoded``.

    A task adds up its counts; tasks' counts are summed per (state, class) by Spark; the driver gets one row of each.
    """
    spark = encoded.sparkSession
    h = F.xxhash64("doc_id", "ids")
    beyond = F.greatest(F.length("ids") / 2 - SPAN_IDS, F.lit(0)).cast("long")
    span = F.substr(F.col("ids"), (2 * F.pmod(F.xxhash64(h), beyond + 1) + 1).cast("int"), F.lit(2 * SPAN_IDS))
    first = encoded.select(h.alias("h"), span.alias("ids")).orderBy("h", "ids").limit(START_DOCUMENTS)
    sample = [np.frombuffer(bytes(r["ids"]), "<u2").astype(np.int64) for r in first.collect()]
    model = beginning(overall)
    for _ in range(START_ROUNDS if sample else 0):
        model = improved(expected(model, sample), overall)

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for part in slices(batch, "ids", 1 << 20):
                    found = expected(sent.value, _sequences(part))
                    sums = found if sums is None else tuple(x + y for x, y in zip(sums, found))
            if sums is not None:
                table = np.concatenate([sums[0][None], sums[1], sums[2]])
                row, column = np.nonzero(table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row.astype(np.int32)), pa.array(column.astype(np.int32)), pa.array(table[row, column])], ["row", "state", "n"])

        k = len(model.start)
        table = np.zeros((1 + k + len(overall), k))
        summed = encoded.select("ids").mapInArrow(count, "row int, state int, n double").groupBy("row", "state").agg(F.sum("n").alias("n"))
        for r in summed.collect():  # one row per state and class
            table[r["row"], r["state"]] = r["n"]
        model = improved((table[0], table[1:1 + k], table[1 + k:]), overall)
        sent.unpersist()
    return model


def score_documents(docs: DataFrame, held_out: Column, learned: Column, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all texts by a model of those that meet ``learned``.

    ``doc_id``, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (seen in training), ``train_tokens``,
    ``base_score`` (add-one unigram) and ``score``, the model's log10 probability: that of the text's classes, by the exact
    forward recursion over the whole text, and that of each word within its class. Null texts are empty (one token);
    repeated rows are scored each; only ``doc_id`` and ``text`` are read. Without training texts all words are unknown.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                      F.coalesce(learned, F.lit(False)).alias("learned"))
    counts_at, encoded_at = scratch_folder(spark, "counts"), scratch_folder(spark, "classes")
    word_counts(own.where("learned")).write.parquet(counts_at)
    counts = spark.read.parquet(counts_at)
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known, n_classes = with_classes(counts, tokens)
    overall, class_size = np.ones(n_classes), np.zeros(n_classes)
    for r in known.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # one row per class
        overall[r["class"]] += r["n"]
        class_size[r["class"]] = r["n"] + r["v"]
    chars = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    encoded_documents(own, known, tokens, kinds, class_size, chars).write.parquet(encoded_at)
    encoded = spark.read.parquet(encoded_at)
    model = spark.sparkContext.broadcast(train(encoded.where("learned"), overall / overall.sum(), rounds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                packed = Packed(_sequences(part))
                logs = np.empty(part.num_rows)
                logs[packed.order] = forward(model.value, packed, False)[0]
                total = logs / np.log(10) + part.column("inner").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")),
                     pa.array(np.full(part.num_rows, tokens, np.int64)), part.column("base_score"), pa.array(total)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                     "base_score double, score double")
