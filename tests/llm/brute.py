"""Plain Python statements of what the operators compute, and a table of awkward rows."""

from __future__ import annotations

import random
import re
from collections import defaultdict

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, row int, score string, k int"


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def awkward(n: int = 40, seed: int = 4) -> list[tuple]:
    """Rows with nulls, empty and very long texts, ties, repeats and columns named like results and helpers."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "zürich", "日本", "it's", "x1", "#$%", "<|endoftext|>", "aa", "12", "naïve", "re-do"] + [f"w{k}" for k in range(60)]
    para = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = para(40)
    texts = [None, "", " \n\t ", "one", "two words", "12 34 !!", "a\x0bb\x0cc\rd e f g", para(6000), shared, shared, shared + " tail",
             para(20) + "\n" + shared + "\n" + para(9), "the the the the the " * 30, "\n\n" + para(12) + "\n" + para(3)]
    for _ in range(n):
        base = shared.split() if rng.random() < 0.5 else para(rng.choice([3, 12, 45])).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        texts.append(rng.choice(["", "\n"]).join([" ".join(base), "\n" + para(8)]))
    rows = [(k * 3 + 1, t, "en" if k % 2 else None, "s", 0, "x", k, "y", k) for k, t in enumerate(texts)]
    return rows + [rows[8], rows[8], rows[7]] + [(None, shared, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def lines_kept(rows):
    """(doc_id, text) -> text without lines equal to, or near to, an earlier line."""
    place = lambda d: -(1 << 63) if d is None else d
    items = []
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            w = words(line)
            if w:
                items.append(((place(d), i), line.strip(WHITE), frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1)))))
    first = {}
    for p, line, s in sorted(items, key=lambda x: x[0]):
        first.setdefault(line, (p, s))
    ordered = sorted((p, line, s) for line, (p, s) in first.items())
    near = {line for k, (_, line, s) in enumerate(ordered) if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for _, _, o in ordered[:k])}
    gone = {(p, line) for p, line, _ in items if line in near or first[line][0] != p}
    keep = lambda d, i, line: ((place(d), i), line.strip(WHITE)) not in gone
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if keep(d, i, x)) for d, t in rows]


def near_links(rows):
    """(class, links) of each row: five-word shingle sets with a similarity of 0.8 or more."""
    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()

    sets = [shingles(t) if d is not None else frozenset() for d, t in rows]
    link = [[j for j, b in enumerate(sets) if j != i and a and b and 9 * len(a & b) >= 4 * (len(a) + len(b))] for i, a in enumerate(sets)]
    label = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(link):
            least = min([label[i], *(label[j] for j in near)]) if near else label[i]
            if least != label[i]:
                label[i], changed = least, True
    return list(zip(label, map(len, link)))


def repeats_removed(rows, window=13):
    """(words, kept words) of each row: windows that also start in a document with a smaller id go."""
    least = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i:i + window])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def repeat_words(text):
    """Words in windows of eight that are found twice or more."""
    w, seen = words(text), defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i:i + 8])].append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)})
