"""Ids of short pieces of text by a public tokenizer, each distinct piece encoded once per Python worker as long as it is remembered."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lagmill.llm.arrays import ragged, word_hashes

SEPARATOR = "<|endoftext|>"
#: Vocabularies of this form part words into runs of letters, digits and runs of other characters, in small letters.
_WORD_FORM = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
     {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
)
#: Pieces that such a vocabulary neither changes nor parts.
_PLAIN = r"^([a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+)$"
_LETTER, _DIGIT, _MARK, _APOSTROPHE, _ODD = range(5)


def _byte_kinds() -> np.ndarray:
    """Kind of each byte; the letters of U+00C0 to U+00FF count with both bytes, other characters are odd."""
    kinds = np.full(256, _ODD, np.uint8)
    kinds[0x21:0x7F] = _MARK
    kinds[ord("'")] = _APOSTROPHE
    kinds[ord("0"):ord("9") + 1] = _DIGIT
    kinds[ord("a"):ord("z") + 1] = kinds[ord("A"):ord("Z") + 1] = kinds[0x80:0xC0] = kinds[0xC3] = _LETTER
    return kinds


def _cuts() -> np.ndarray:
    """Whether a piece ends between bytes of two kinds: at and after each digit, after letters, between a mark and a letter. An
    apostrophe stays with what follows, as ``'s`` is one piece."""
    cut = np.zeros((5, 5), bool)
    cut[:4, _DIGIT] = cut[_DIGIT, :4] = cut[_LETTER, [_MARK, _APOSTROPHE]] = cut[_MARK, _LETTER] = True
    return cut.ravel()


_KINDS, _CUTS = _byte_kinds(), _cuts()


def parted(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of pieces of each word, pieces of all words one after another, in small letters).

    Words are not empty. A vocabulary of ``_WORD_FORM`` gives the pieces of a word the ids that it gives the word. Words with
    characters that a look at two bytes does not settle, or with ``<|``, are one piece and stay as they are.
    """
    if not len(words):
        return np.zeros(0, np.int64), words
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64, len(words) + 1, 8 * words.offset)
    text = np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0]))
    ends = ends - ends[0]
    kinds = _KINDS[text]
    now, then = text[:-1], text[1:]
    late = now == 0xC3
    odd = kinds == _ODD
    odd[:-1] |= (late & ((then == 0x97) | (then == 0xB7))) | ((now == ord("<")) & (then == ord("|")))  # \u00d7, \u00f7
    small = text + np.where((text >= ord("A")) & (text <= ord("Z")), np.uint8(32), np.uint8(0))
    small[1:] += np.where(late & (then <= 0x9E), np.uint8(32), np.uint8(0))
    if odd.any():
        whole = np.repeat(np.logical_or.reduceat(odd, ends[:-1]), np.diff(ends))
        small = np.where(whole, text, small)
        kinds[whole] = _ODD
    new = np.zeros(len(text), bool)
    new[1:] = _CUTS[kinds[:-1] * np.uint8(5) + kinds[1:]]
    new[ends[:-1]] = True
    starts = np.append(np.flatnonzero(new), len(text))
    pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(small))
    return np.add.reduceat(new, ends[:-1], dtype=np.int64), pieces


@lru_cache(2)
def _tokenizer(path: str):
    """One per Python worker; its own threads are off, as Spark's tasks fill the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceEncoder:
    """Ids of pieces, exactly as the tokenizers library encodes each piece by itself.

    New pieces are joined by the tokenizer's special string, encoded in long texts and parted at its id; a piece that holds
    ``<|`` itself is encoded alone. Pieces are remembered until new ones would make more than ``entries``; then memory starts anew.
    """

    def __init__(self, path: str, entries: int = 400_000, joined: int = 512):
        self.tokenizer = _tokenizer(path)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.entries, self.joined = entries, joined
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(x.ids, np.uint32) for x in found]

    def _learn(self, pieces: list[str]) -> None:
        special = [p for p in pieces if "<|" in p]
        plain = [p for p in pieces if "<|" not in p] if special else pieces
        flat, lengths = [], []
        for at in range(0, len(plain), self.joined):
            ids = self._ids([SEPARATOR.join(plain[at:at + self.joined])])[0]
            parted = ids == self.separator
            flat.append(ids[~parted])
            lengths.append(np.diff(np.concatenate([[-1], np.flatnonzero(parted), [len(ids)]])) - 1)
        for ids in self._ids(special):
            flat.append(ids)
            lengths.append(np.array([len(ids)]))
        if not flat:
            return
        new, sizes = np.concatenate(flat), np.concatenate(lengths)
        self.places.update(zip([*plain, *special], range(len(self.places), len(self.places) + len(pieces))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.flat = np.concatenate([self.flat, new])

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, ids of all pieces one after another)."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.places]
        if len(self.places) + len(new) > self.entries:
            self._forget()
            new = distinct
        self._learn(new)
        places = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        lengths = self.lengths[places]
        return lengths, self.flat[ragged(self.starts[places], lengths)]


class WordEncoder(PieceEncoder):
    """Ids of words by a vocabulary of ``_WORD_FORM``: known are the pieces that words share, as one Arrow array.

    A table of slots, twice as many as entries at least, finds a piece by its hash; what is found is compared with the piece.
    The vocabulary's own model encodes pieces that need no other step; the end of each shows in its last id.
    """

    def __init__(self, path: str, entries: int, joined: int = 512):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path, entries, joined)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True

    @staticmethod
    def fits(path: str) -> bool:
        tokenizer = _tokenizer(path)
        state = lambda part: json.loads(part.__getstate__()) if part else {}
        form = (state(tokenizer.normalizer).get("normalizers"), state(tokenizer.pre_tokenizer).get("pretokenizers"))
        return form == _WORD_FORM and bool(getattr(tokenizer.model, "end_of_word_suffix", None))

    def _forget(self) -> None:
        super()._forget()
        self.known, self.hashes = pa.array([], pa.large_string()), np.zeros(0, np.uint64)
        self.slots = np.full(1 << (2 * self.entries).bit_length(), -1, np.int32)

    def _find(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Place of each piece, -1 of those not known."""
        places = np.full(len(pieces), -1, np.int64)
        if not len(self.known):
            return places
        left, slot = np.arange(len(pieces)), self._slot(hashes)
        while len(left):
            at = self.slots[slot]
            hit = (at >= 0) & (self.hashes[at] == hashes[left])
            places[left[hit]] = at[hit]
            on = (at >= 0) & ~hit
            left, slot = left[on], self._slot(slot[on] + 1)
        found = np.flatnonzero(places >= 0)
        same = pc.equal(self.known.take(pa.array(places[found])), pieces.take(pa.array(found))).to_numpy(zero_copy_only=False)
        places[found[~same]] = -1
        return places

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers & numbers.dtype.type(len(self.slots) - 1)).astype(np.int64)

    def _place(self, hashes: np.ndarray) -> None:
        """Gives new pieces slots. Many may want one: who wrote last has it, the others go on."""
        left, slot, first = np.arange(len(hashes)), self._slot(hashes), len(self.hashes)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = first + left[free]
            on = self.slots[slot] != first + left
            left, slot = left[on], self._slot(slot[on] + 1)
        self.hashes = np.concatenate([self.hashes, hashes])

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, ids of all) of pieces that match ``_PLAIN``."""
        found = [np.array(self.model.encode_batch_fast([" ".join(pieces[at:at + self.joined])], add_special_tokens=False)[0].ids, np.uint32)
                 for at in range(0, len(pieces), self.joined)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        lengths = np.diff(np.concatenate([[-1], np.flatnonzero(self.last[ids])]))
        if len(lengths) != len(pieces):
            raise ValueError("a piece without a last id")
        return lengths, ids

    def _other(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of all other pieces, in their order."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        encoder = PieceEncoder.__new__(PieceEncoder)
        encoder.__dict__ |= {"tokenizer": self.tokenizer, "separator": self.separator, "entries": len(pieces), "joined": 64}
        encoder._forget()
        return encoder.encode(pa.array(pieces, pa.large_string()))

    def _learn(self, pieces: pa.Array) -> None:
        plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        (a, x), (b, y) = self._plain(pieces.filter(pa.array(plain)).to_pylist()), self._other(pieces.filter(pa.array(~plain)).to_pylist())
        sizes = np.concatenate([a, b])
        starts, lengths = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        starts[order], lengths[order] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, x, y])
        self.known = pa.concat_arrays([self.known, pieces])

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all words one after another)."""
        number, pieces = parted(words)
        if not len(pieces):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        hashes = word_hashes(distinct)
        places = self._find(distinct, hashes)
        new = np.flatnonzero(places < 0)
        if len(self.known) + len(new) > self.entries:
            self._forget()
            if len(distinct) > self.entries:
                self.slots = np.full(1 << (2 * len(distinct)).bit_length(), -1, np.int32)
            new = np.arange(len(distinct))
        if len(new):
            places[new] = len(self.known) + np.arange(len(new))
            self._place(hashes[new])
            self._learn(distinct.take(pa.array(new)))
        places = places[coded.indices.to_numpy()]
        lengths = self.lengths[places]
        return np.add.reduceat(lengths, np.cumsum(number) - number), self.flat[ragged(self.starts[places], lengths)]


@lru_cache(1)
def piece_encoder(path: str) -> PieceEncoder:
    """One per Python worker: what one task has learned serves the next."""
    return WordEncoder(path, entries=1 << 20) if WordEncoder.fits(path) else PieceEncoder(path, entries=1 << 20, joined=64)


@lru_cache(2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all ids one after another, start and length of each id's) of a byte-level vocabulary.

    A byte stands for the character of its own code where that is printable, else for the next free one from 256 on.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    code = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    tokens = {i: bytes(code[c] for c in t) for t, i in file["model"]["vocab"].items()}
    tokens |= {t["id"]: t["content"].encode() for t in file["added_tokens"]}
    parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths
