"""Removal of word passages that also stand in an earlier document, by recompression.

Recompression shortens a sequence round by round: runs of one symbol get a name, then pairs of neighbours whose first symbol
falls in the left half of the alphabet and whose second in the right half. Names and halves are functions of content, so all
tasks name alike without exchanging a dictionary, and equal passages get equal symbols except near their ends.

1. Symbols after ``LONG_ROUNDS`` rounds, neighbouring two of them, and whole documents are counted over the corpus. Where the
   smallest document of such a name is smaller, the whole passage is known to be repeated.
2. Each other window of ``WINDOW`` words is represented by the highest symbol that its own words determine (pairs only, since
   runs depend on what lies outside). Equal windows have equal representatives, so a window whose representative stands in
   one document only is not repeated.
3. What is left is compared by hashes of the whole windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lagmill.llm.arrays import filled, mixed, ragged, run_hashes, slices, word_hashes, word_lists

WINDOW = 13
LONG_ROUNDS = 12
ANCHOR_ROUNDS = 4
#: Characters of the documents that are worked on together.
GROUP_CHARS = 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _left_half(names: np.ndarray, round_: int) -> np.ndarray:
    return (mixed(names + np.uint64(round_ + 1) * _OTHER) & np.uint64(1)) == 0


def _pair_names(a: np.ndarray, b: np.ndarray, round_: int) -> np.ndarray:
    return mixed(a * _ODD + mixed(b + np.uint64(round_) * _OTHER))


def _without(places: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    kept = np.ones(len(arrays[0]), bool)
    kept[places] = False
    return [a[kept] for a in arrays]


def long_symbols(names: np.ndarray, doc: np.ndarray, rounds: int = LONG_ROUNDS) -> tuple[np.ndarray, ...]:
    """(name, first word, word after the last, document) of each symbol after all rounds; symbols stay within documents."""
    n = len(names)
    start = np.arange(n)
    opens = np.concatenate([[True], doc[1:] != doc[:-1]])[:n]  # a document begins with this symbol
    with np.errstate(over="ignore"):
        for r in range(rounds):
            if len(names) < 2:
                break
            more = np.flatnonzero((names[1:] == names[:-1]) & ~opens[1:]) + 1
            if len(more):
                runs = np.flatnonzero(np.concatenate([[True], np.diff(more) > 1]))
                heads = more[runs] - 1
                size = np.diff(np.append(runs, len(more))) + 1
                names[heads] = mixed(names[heads] * _OTHER + size.astype(np.uint64) * _ODD)
                names, start, opens = _without(more, names, start, opens)
            left = _left_half(names, r)
            first = np.flatnonzero(left[:-1] & ~left[1:] & ~opens[1:])
            names[first] = _pair_names(names[first], names[first + 1], r)
            names, start, opens = _without(first + 1, names, start, opens)
    return names, start, np.append(start[1:], n)[:len(start)], doc[start]


def long_passages(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(name, first word, word after the last, document) of symbols, neighbouring symbols and whole documents."""
    names, start, end, owner = long_symbols(h.copy(), doc)
    if not len(names):
        return names, start, end, owner
    with np.errstate(over="ignore"):
        two = np.flatnonzero(owner[1:] == owner[:-1])
        pair = mixed(names[two] * _OTHER + mixed(names[two + 1] ^ _ODD))
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        place = (np.arange(len(names)) - np.repeat(heads, np.diff(np.append(heads, len(names))))).astype(np.uint64)
        whole = mixed(np.add.reduceat(mixed(names + place * _ODD), heads) + _OTHER)
    last = np.append(heads[1:], len(names)) - 1
    three = last - heads > 1  # of one or two symbols the others are the whole
    name = np.concatenate([names, pair, whole[three]])
    first = np.concatenate([start, start[two], start[heads][three]])
    stop = np.concatenate([end, end[two + 1], end[last][three]])
    document = np.concatenate([owner, owner[two], owner[heads][three]])
    enough = stop - first >= WINDOW
    return name[enough], first[enough], stop[enough], document[enough]


def window_anchors(h: np.ndarray, doc: np.ndarray, rounds: int = ANCHOR_ROUNDS) -> np.ndarray:
    """For each word the representative of the window that starts there (meaningless where the document ends before).

    The pair of two symbols follows from these alone; a symbol that stays single in a round also depends on the neighbour it
    might have joined. ``low`` and ``high`` bound the words a symbol depends on. A window is represented by the symbol of the
    latest round among those that depend on its words only, the one with the largest name of several; without any, by its
    own hash.
    """
    n = len(h)
    best = np.zeros(n, np.uint64)
    names, owner = h.copy(), doc
    low = np.arange(n)
    high = low + 1
    far = 1 << 40
    with np.errstate(over="ignore"):
        for r in range(rounds):
            if len(names) < 2:
                break
            left = _left_half(names, r)
            near = owner[1:] == owner[:-1]
            first = np.flatnonzero(left[:-1] & ~left[1:] & near)
            single_low, single_high = low.copy(), high.copy()
            # A left symbol stays single because of the symbol after it, a right one because of the one before it.
            after = np.append(np.where(near, high[1:], far), far)
            before = np.append(-far, np.where(near, low[:-1], -far))
            single_high[left] = np.maximum(high, after)[left]
            single_low[~left] = np.minimum(low, before)[~left]
            pair_low, pair_high = np.minimum(low[first], low[first + 1]), np.maximum(high[first], high[first + 1])
            name = _pair_names(names[first], names[first + 1], r)
            fits = pair_high - pair_low <= WINDOW
            value = (name[fits] >> np.uint64(4)) | (np.uint64(r + 1) << np.uint64(60))
            # Windows that hold the symbol's words start from high - WINDOW to low, inside the document.
            lowest = np.maximum(pair_high[fits] - WINDOW, 0)
            count = pair_low[fits] - lowest + 1
            np.maximum.at(best, ragged(lowest, count), np.repeat(value, count))
            names[first] = name
            low, high = single_low, single_high
            low[first], high[first] = pair_low, pair_high
            kept = np.ones(len(names), bool)
            kept[first + 1] = False
            names, low, high, owner = names[kept], low[kept], high[kept], owner[kept]
    whole = run_hashes(h, WINDOW)
    bare = np.flatnonzero(best[:len(whole)] == 0)
    best[bare] = whole[bare] >> np.uint64(4)
    return best


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of documents, hash of each word, document of each word)."""
    bounds, flat = word_lists(filled(part.column("text")))
    return bounds, word_hashes(flat), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches():
        yield from slices(batch)


def _inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """Whether a window of ``WINDOW`` words starts at each word and ends in the same document."""
    inside = np.zeros(n, bool)
    lengths = np.maximum(np.diff(bounds) - WINDOW + 1, 0)
    inside[ragged(bounds[:-1], lengths)] = True
    return inside


def _known(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Whether the window that starts at each word lies in one of the passages."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + np.maximum(sizes - WINDOW + 1, 0), -1)
    return np.cumsum(mark)[:n] > 0


#: What a group asks: for each name its smallest and largest document there.
ASKED = pa.schema([("name", pa.int64()), ("g", pa.int32()), ("least", pa.int64()), ("most", pa.int64())])
_FAR = np.iinfo(np.int64).max


def _asked(names: list[np.ndarray], docs: list[np.ndarray], g: int) -> pa.Table:
    """One row per distinct name."""
    name = np.concatenate(names) if names else np.zeros(0, np.uint64)
    if not len(name):
        return ASKED.empty_table()
    doc = np.concatenate(docs)
    real = doc > -(1 << 63)  # null documents
    name, doc = name[real], doc[real]
    if not len(name):
        return ASKED.empty_table()
    order = np.argsort(name)
    name, doc = name[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    return pa.Table.from_arrays([_signed(name[heads]), pa.array(np.full(len(heads), g, np.int32)),
                                 pa.array(np.minimum.reduceat(doc, heads)), pa.array(np.maximum.reduceat(doc, heads))], schema=ASKED)


class Told:
    """Smallest documents of names that a group asked for."""

    def __init__(self, table: pa.Table, kind: int):
        table = table.filter(pc.equal(table.column("kind"), kind))
        self.name, self.least = table.column("name").combine_chunks(), table.column("least").to_numpy().astype(np.int64)

    def of(self, names: np.ndarray) -> np.ndarray:
        """Smallest document of each name; the largest integer where none was told."""
        if not len(self.name) or not len(names):
            return np.full(len(names), _FAR)
        place = pc.fill_null(pc.index_in(_signed(names), self.name), -1).to_numpy(zero_copy_only=False)
        return np.where(place >= 0, self.least[place], _FAR)


def _documents_of(part: pa.RecordBatch) -> np.ndarray:
    """A null document has no smaller one, and is smaller than none."""
    return pc.fill_null(part.column("doc_id"), -(1 << 63)).to_numpy(zero_copy_only=False)


def _open_windows(part: pa.RecordBatch, told: Told) -> tuple[np.ndarray, ...]:
    """(hashes of words, document of each word, starts of windows that no long passage decides, whether a window starting
    at each word is known to be repeated)."""
    bounds, h, doc = _words(part)
    name, first, stop, owner = long_passages(h, doc)
    found = told.of(name) < _documents_of(part)[owner]
    known = _known(first[found], (stop - first)[found], len(h))
    return h, doc, np.flatnonzero(_inside(bounds, len(h)) & ~known), known


def _answers(asked: DataFrame, kind: int) -> DataFrame:
    """(g, kind, name, least) of names whose smallest document in the corpus is smaller than some document of the group.

    A name has one row per group of documents at most, so that a passage that stands everywhere is still a short list. One
    shuffle by name serves the minimum and the join, as long as both read the same columns and rows; hence the conditions
    that always hold."""
    by_name = asked.where("name is not null and least is not null and most is not null").repartition("name")
    least = by_name.groupBy("name").agg(F.min("least").alias("first"), F.max("most").alias("last"), F.min("g").alias("any"))
    least = least.where("first < last and any >= 0").select("name", "first")
    return by_name.join(least, "name").where("first < most and least >= first").select(
        "g", F.lit(kind).alias("kind"), "name", F.col("first").alias("least"))


def _answers_any(asked: DataFrame) -> DataFrame:
    """(g, kind, name, least) of names that stand in two documents, for all groups that have them: the smallest document's
    group must ask for its windows too. ``g`` is -1 - group where two documents of the group have the name."""
    by_name = asked.repartition("name")
    several = by_name.groupBy("name").agg(F.count("g").alias("groups"), F.min("g").alias("low")).where("groups > 1 or low < 0").select("name")
    group = F.when(F.col("g") < 0, -1 - F.col("g")).otherwise(F.col("g"))
    return by_name.join(several, "name").select(group.alias("g"), F.lit(1).alias("kind"), "name", F.lit(0).cast("long").alias("least"))


def answered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with a group ``g`` and all other columns in ``rest``; the answers to what each group asked)."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-chars // GROUP_CHARS))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")])
    texts = docs.select("doc_id", "text", rest.alias("rest"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"))
    by_group = texts.groupBy("g")
    asked = "name long, g int, least long, most long"

    def passages(key, table):
        names, docs_ = [], []
        for part in _rows(table):
            name, _, _, owner = long_passages(*_words(part)[1:])
            names.append(name)
            docs_.append(_documents_of(part)[owner])
        return _asked(names, docs_, key[0].as_py())

    def anchors(key, left, right):
        told, names, docs_ = Told(right, 0), [], []
        for part in _rows(left):
            h, doc, at, _ = _open_windows(part, told)
            names.append(window_anchors(h, doc)[at])
            docs_.append(_documents_of(part)[doc[at]])
        table = _asked(names, docs_, key[0].as_py())
        g = np.where(table.column("least").to_numpy() < table.column("most").to_numpy(), -1 - key[0].as_py(), key[0].as_py())
        return pa.table({"name": table.column("name"), "g": pa.array(g.astype(np.int32))})

    def windows(key, left, right):
        told, shared, names, docs_ = Told(right, 0), Told(right, 1), [], []
        for part in _rows(left):
            h, doc, at, _ = _open_windows(part, told)
            at = at[shared.of(window_anchors(h, doc)[at]) < _FAR]
            names.append(run_hashes(h, WINDOW)[at])
            docs_.append(_documents_of(part)[doc[at]])
        return _asked(names, docs_, key[0].as_py())

    long = _answers(by_group.applyInArrow(passages, asked), 0)
    anchored = _answers_any(by_group.cogroup(long.groupBy("g")).applyInArrow(anchors, "name long, g int"))
    told = long.unionByName(anchored)
    return texts, long.unionByName(_answers(by_group.cogroup(told.groupBy("g")).applyInArrow(windows, asked), 2))


_WORD = re.compile("[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without repeated words, and ``n_words``, ``n_removed``, ``kept_sha256``.

    A word goes if it lies in a window of 13 words of its document that also starts in a document with a smaller ``doc_id``;
    windows are those of the input. Words go with the white space after them; a text without such words stays as it is.
    ``kept_sha256`` is the digest of the kept words joined by one space. A null text has no words and stays null; a null
    ``doc_id`` is smaller than none and none is smaller than it; rows of one ``doc_id`` are one document to each other.
    Other columns pass through; those with the names of results are replaced. Windows are told apart by 64-bit hashes.
    """
    own = ("n_words", "n_removed", "kept_sha256")
    keep = [c for c in docs.columns if c not in own]
    texts, answers = answered(docs.select(*keep))
    out = T.StructType([*(f for f in texts.schema if f.name in ("doc_id", "text", "rest")), T.StructField("n_words", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def remove(left, right):
        told, single, parts = Told(right, 0), Told(right, 2), []
        for part in _rows(left):
            column = part.column("text")
            values = filled(column)
            bounds, _ = word_lists(values)
            h, doc, at, known = _open_windows(part, told)
            known[at] = single.of(run_hashes(h, WINDOW)[at]) < _documents_of(part)[doc[at]]
            gone = np.zeros(len(h) + WINDOW, np.int64)
            starts = np.flatnonzero(known)
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + WINDOW, -1)
            gone = np.cumsum(gone)[:len(h)] > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
            new, digests = [], []
            for k, text in enumerate(values.to_pylist()):
                if removed[k]:
                    cut = gone[bounds[k]:bounds[k + 1]]
                    text = "".join(w for w, drop in zip(_WORD.findall(text), cut) if not drop)
                digests.append(hashlib.sha256(b" ".join(text.encode().split())).hexdigest())
                new.append(text)
            new = pc.if_else(pc.is_null(column), pa.scalar(None, pa.string()), pa.array(new, pa.string()))
            parts.append(pa.table({"doc_id": part.column("doc_id"), "text": new, "rest": part.column("rest"),
                                   "n_words": pa.array(np.diff(bounds)), "n_removed": pa.array(removed), "kept_sha256": digests}))
        return pa.concat_tables(parts) if parts else to_arrow_schema(out).empty_table()

    done = texts.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(remove, out)
    return done.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in keep], *own)
