"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.llm.arrays import filled, mixed, ragged, slices, tidy, word_lists

BUCKETS = 1 << 15
DIMENSIONS = 16
#: Bytes of the subwords of ``<word>``; the word itself is one more.
GRAMS = (2, 3, 4)
#: Bounds of the training sample: rows, and characters of the excerpt that stands for a longer text.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 20_000
EPOCHS, RATE = 4, 0.5
#: Share of correctly labelled calibration rows that rejection may cost.
COST = 0.002
UNDETERMINED = "und"


def subwords(words: pa.Array, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(number of subwords of each word, their buckets word by word)."""
    parts = [_subwords(words.slice(at, at_once)) for at in range(0, len(words), at_once)]
    return (np.concatenate([c for c, _ in parts]), np.concatenate([b for _, b in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    left, right, empty = (pa.scalar(x, words.type) for x in ("<", ">", ""))
    marked = pc.binary_join_element_wise(left, words, right, empty)
    lengths = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer("".join(marked.to_pylist()).encode(), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(data))  # bytes from here to the end of the word
    places, keys = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = h * np.uint64(257) + data[at + k]
            places.append(at)
            keys.append(h)
        # The word as a whole: a sum of its bytes, each mixed with its place.
        place = (np.arange(len(data)) - np.repeat(starts, lengths)).astype(np.uint64)
        whole = np.add.reduceat(mixed(data + (place << np.uint64(8))), starts) if len(data) else np.zeros(0, np.uint64)
    places.append(starts)
    keys.append(whole)
    place, key = np.concatenate(places), np.concatenate(keys)
    word = np.searchsorted(ends, place, side="right")
    order = np.argsort(word, kind="stable")
    bucket = (mixed(key[order]) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return np.bincount(word, minlength=len(lengths)), bucket


@dataclass
class Model:
    """``table`` holds embedding times softmax weights of each bucket, ``bias`` the classes' biases."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def _sums(self, words: pa.Array, at_once: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
        """(number of subwords of each word, sum of their rows of ``table``); only a block's rows are held at once."""
        counts, sums = [], []
        for at in range(0, len(words), at_once):
            n, buckets = _subwords(words.slice(at, at_once))
            counts.append(n)
            sums.append(np.add.reduceat(self.table[buckets].astype(np.float64), np.cumsum(n) - n))
        return np.concatenate(counts), np.concatenate(sums)

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Class probabilities of each text; of a text without words those of the bias alone."""
        bounds, flat = word_lists(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if len(flat):
            coded = flat.dictionary_encode()
            counts, sums = self._sums(coded.dictionary)
            codes = coded.indices.to_numpy()
            rows = np.flatnonzero(bounds[1:] > bounds[:-1])
            total = np.add.reduceat(counts[codes].astype(np.float64), bounds[:-1][rows])
            out[rows] = np.add.reduceat(sums[codes], bounds[:-1][rows]) / total[:, None]
        return softmax((out + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent over one text at a time; every fifth text is held back to set temperature and threshold."""
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    bounds, flat = word_lists(pa.array(texts, pa.large_string()))
    coded = flat.dictionary_encode()
    counts, buckets = subwords(coded.dictionary)
    heads, codes = np.cumsum(counts) - counts, coded.indices.to_numpy()
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    features = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        word, times = np.unique(codes[a:b], return_counts=True)
        found, inverse = np.unique(buckets[ragged(heads[word], counts[word])], return_inverse=True)
        weight = np.bincount(inverse, np.repeat(times, counts[word]).astype(float), len(found))
        features.append((found.astype(np.int32), (weight / max(weight.sum(), 1)).astype(np.float32)))
    order = rng.permutation(len(texts))
    held, learned = order[::5], np.setdiff1d(order, order[::5])
    steps, step = max(1, EPOCHS * len(learned)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(learned):
            found, weight = features[k]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = weight @ vectors[found]
            error = softmax((mean @ weights + bias)[None])[0]
            error[target[k]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * error
            vectors[found] -= rate * np.outer(weight * len(found), back) / max(1.0, (weight * weight).sum() * len(found) ** 2) ** 0.5
    model = Model(languages, (vectors @ weights).astype(np.float32), bias, 1.0, 0.0)
    calibrate(model, [texts[k] for k in held], target[held])
    return model


def calibrate(model: Model, texts: list[str], target: np.ndarray) -> None:
    """Temperature of least log loss on held-back rows; a threshold of at most twice the probability of a guess, and one that
    rejects at most ``COST`` of the rightly labelled."""
    if not len(texts):
        return
    logits = np.log(model.probabilities(pa.array(texts, pa.large_string())) + 1e-300)
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(target)), target] + 1e-300).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    shares = softmax(logits / model.temperature)
    right = shares.max(axis=1)[shares.argmax(axis=1) == target]
    floor = 1 / len(model.languages)
    model.threshold = float(min(np.quantile(right, COST), 2 * floor)) if len(right) else floor


def quotas(sizes: dict[str, int], rows: int) -> dict[str, int]:
    """Rows of each language, ``rows`` at most in all: half of them in equal parts, half by share of the texts."""
    if not sizes:
        return {}
    equal, total = max(1, rows // (2 * len(sizes))), sum(sizes.values())
    rest = max(0, rows - equal * len(sizes))
    return {lang: min(n, equal + rest * n // total) for lang, n in sizes.items()}


def sample(docs: DataFrame, fold: Column | None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` distinct labelled texts (text, lang, h), of each language those with the smallest hashes.

    Every language has its quota, however rare it is (of more than ``rows`` languages the most frequent). A text of more than
    ``SAMPLE_CHARS`` characters gives an excerpt of that length from a place its hash names. The bounds hold at any size.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if fold is not None:
        usable = usable.where(fold)
    keyed = usable.select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    found = keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    sizes = {r["lang"]: max(1, r["n"]) for r in found}
    # Texts below the cutoff of their language are about twice those wanted, and some more for rare ones.
    drawn = [(lang, q, min((1 << 63) - 1, int(((2 * q + 20) / sizes[lang]) * (1 << 64)) - (1 << 63)))
             for lang, q in quotas(sizes, rows).items()]
    limits = docs.sparkSession.createDataFrame(drawn, "lang string, quota int, cutoff long")
    size = F.length("text")
    place = F.when(size > SAMPLE_CHARS, F.pmod(F.xxhash64("h"), size - SAMPLE_CHARS + 1)).otherwise(0).cast("int") + 1
    near = keyed.join(F.broadcast(limits), "lang").where("h <= cutoff").select(
        "lang", "h", "quota", F.substr(F.col("text"), place, F.lit(SAMPLE_CHARS)).alias("text")).dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return near.withColumn("rank", rank).where("rank <= quota").select("text", "lang", "h")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_rejected``, from the whole text alone.

    ``lang_pred`` is ``und`` with score 0 for null texts and texts without a letter (they are rejected), else the most
    probable learned language (the first in order, of equal ones) with its calibrated probability; rows below the threshold
    are rejected. Columns of these names in ``docs`` are replaced; all others, repeated rows included, pass through.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_rejected")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("lang_rejected", "boolean")
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for part in slices(batch):
                texts = filled(part.column("text"))
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                shares = m.probabilities(texts) if m.languages else np.zeros((len(texts), 1))
                letters = letters & bool(m.languages)
                best = shares.argmax(axis=1)
                score = np.where(letters, shares.max(axis=1), 0.0)
                names = [m.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(score), pa.array(~letters | (score < m.threshold))],
                    [*keep, "lang_pred", "score", "lang_rejected"])

    return docs.select(*keep).mapInArrow(tidy(run), schema)


def train(docs: DataFrame, fold: Column | None = None) -> Model:
    """Model of the labelled rows that meet ``fold``, fitted in one task on a sample of bounded size; the driver gets the
    model only. Without any such row everything is undetermined."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["h"])
        if rows:
            model = fit([r["text"] for r in rows], [r["lang"] for r in rows])
            parts = (model.languages, model.table, model.bias, model.temperature, model.threshold)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], ["model"])

    found = sample(docs, fold).repartition(1).mapInArrow(tidy(learn), "model binary").collect()
    return Model(*pickle.loads(bytes(found[0][0]))) if found else Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
