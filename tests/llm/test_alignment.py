"""Token alignment and phrases against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from lagmill.llm import alignment, phrases
from lagmill.llm.queries import BYTE_BPE, PIECE_BPE
from lagmill.session import batches_of

ODD = ["  lead", "trail  ", "a  b\n\n c", "<|endoftext|> and <|x", "<s> </s> <0x0A>", "▁ bar", "tab\tx 　y \xa0 z", "  q", " ", "\n", "naïve déjà 日本語 тест", "x" * 300]
ROWS = brute.awkward() + [(500 + k, t, None, None, None, None, None, None, None) for k, t in enumerate(ODD)]


def token_bytes():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    a, b = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a.encode_special_tokens = True

    def of_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    return a, b, lambda i: bytes(code[c] for c in a.id_to_token(i)), of_b


def aligned(rows):
    """What each row holds, straight from the definition."""
    a, b, bytes_a, bytes_b = token_bytes()
    found = []
    for d, t in rows:
        x, y = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        raw = (" " + (t or "")).encode()
        p, q = [bytes_a(i) for i in x], [bytes_b(i) for i in y]
        if not t or b"".join(p) != raw or b"".join(q) != raw:
            found.append((d, [], [], [], []))
            continue
        ends_x, ends_y = np.cumsum([len(v) for v in p]).tolist(), np.cumsum([len(v) for v in q]).tolist()
        common, groups, i, j = set(ends_x) & set(ends_y), [], 0, 0
        for end in sorted(common):
            k, m = ends_x.index(end) + 1, ends_y.index(end) + 1
            groups.append((x[i:k], y[j:m]))
            i, j = k, m
        links = []
        lo = 0
        for i, (id_x, end) in enumerate(zip(x, ends_x)):
            begin = end - len(p[i])
            while ends_y[lo] <= begin:
                lo += 1
            k = lo
            while k < len(y) and ends_y[k] - len(q[k]) < end:
                links.append((id_x, y[k]))
                k += 1
        found.append((d, x, y, groups, links))
    held = Counter(pair for *_, links in found for pair in set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = Counter()
    for d, x, y, groups, links in found:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out[d, len(x), len(y), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if x else ""] += 1
    return out


def test_alignment_by_definition(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 20_000)
    docs = spark.createDataFrame(ROWS, brute.SCHEMA).repartition(3)
    got = alignment.align_documents(docs, BYTE_BPE, PIECE_BPE)
    assert Counter(map(tuple, got.collect())) == aligned([(r[0], r[1]) for r in ROWS])
    assert alignment.align_documents(docs.limit(0), BYTE_BPE, PIECE_BPE).count() == 0


def test_groups_of_random_ends():
    rng = np.random.default_rng(5)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, total + 1, rng.integers(1, 30)), total)) for _ in range(2)]
        bounds = [(np.array([0]), np.array([len(e)])) for e in ends]
        a0, a1, b0, b1 = alignment.shared_groups(*ends, *bounds)
        assert ends[0][a1 - 1].tolist() == ends[1][b1 - 1].tolist() == sorted(set(ends[0]) & set(ends[1]))
        assert a0.tolist() == [0, *a1[:-1]] and b0.tolist() == [0, *b1[:-1]]


def mined(rows, least, best):
    f, n = defaultdict(Counter), Counter()
    for t, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang or "und"][tuple(w[i:i + m])] += 1
    out = Counter()
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = {x for g, a in candidates.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) for x in [g[i:i + m]] if 100 * a >= 80 * counts[x]}
        scored = []
        for g, a in candidates.items():
            if g not in inside:
                score, k = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:best], 1):
            out[lang, rank, phrase.decode(), -a, left, right, n[lang], -s] += 1
    return out


def test_phrases_by_definition(spark, monkeypatch):
    rows = [(r[1], r[2]) for r in ROWS] + [("A b, a B c. a b c d e f g h " * 9, "en"), ("loop " * 50 + "\n" + "p q " * 40, "de"), ("x.y", None)] * 2
    docs = spark.createDataFrame([(t, lang, "p", 1) for t, lang in rows], "text string, lang string, phrase string, n int").repartition(5)
    for least, best, size in ((2, 2000, 3000), (5, 20, 1 << 20)):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
        monkeypatch.setattr(phrases, "HOT_SHARE", 40 if least == 2 else 10_000)
        assert Counter(map(tuple, phrases.mine_phrases(docs, best, least).collect())) == mined(rows, least, best)
    assert phrases.mine_phrases(docs.limit(0)).count() == 0


def test_pieces_take_little_memory():
    """Places of marks are held, not a number for each byte: workers share the memory of an executor."""
    import tracemalloc

    texts = pa.array(["Ab cdefgh, ijklm\tnopqrs. tuvwxy " * 20_000] * 4 + [None, "", ",a;b", "c"], pa.string())
    size = sum(len(t or "") for t in texts.to_pylist())
    tracemalloc.start()
    try:
        owner, words, fresh = phrases.piece_words(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 12 * size
    assert fresh[:8].tolist() == [True, False, True, False, True, False, False, True] and words[:6].to_pylist() == ["ab", "cdefgh", "ijklm", "nopqrs", "tuvwxy", "ab"]
    assert owner[-3:].tolist() == [6, 6, 7] and fresh[-3:].all() and words[-3:].to_pylist() == ["a", "b", "c"]


def test_workers_of_phrases_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(phrases, "give_back", lambda: given.append(1), raising=False)
    left = pa.table({"codes": pa.array([np.array([0, 1, 2, 1, 2], np.uint16).tobytes()] * 2, pa.binary()), "size": pa.array([2, 2])})
    edges = phrases._edges(left, pa.table({"id": pa.array([4, 6]), "at": pa.array([0, 1])}))
    assert len(given) == 2 and edges.num_rows == 6


def _task(monkeypatch, number=0):
    monkeypatch.setattr(phrases, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Own", (), {"partitionId": lambda self: number})())}))


def test_blocks_are_handed_over_in_small_rows(monkeypatch):
    """What a worker holds and hands over has a bound far below a block: it stands beside the heap of the executor."""
    import tracemalloc

    _task(monkeypatch, 3)
    rng = np.random.default_rng(4)
    names = np.array([f"w{k}" for k in range(120_000)])
    texts = [" ".join(names[rng.integers(0, 120_000, 5_000)]) + "." for _ in range(150)]
    langs = ["en", None, "de"] * 50
    batches = [pa.RecordBatch.from_pydict({"lang": langs[k:k + 120], "text": texts[k:k + 120]}) for k in (0, 120)]
    assert 4 << 20 < sum(map(len, texts)) < phrases.BLOCK_BYTES
    tracemalloc.start()
    try:
        given = list(phrases._blocks(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert max(map(pa.ipc.get_record_batch_size, given)) < 1 << 20 and peak < 6 * sum(map(len, texts))
    out = [r for batch in given for r in batch.to_pylist()]
    words, parts = [r for r in out if r["word"] is not None], [r for r in out if r["codes"] is not None]
    assert {r["block"] for r in out} == {3 << 32}  # a block goes on over batches
    assert [r["at"] for r in words] == [*range(len(words))] and [r["at"] for r in parts] == [*range(len(parts))] and len(parts) > 5
    assert Counter({(r["lang"], r["word"]): r["times"] for r in words}) == Counter((lang or "und", w) for lang, t in zip(langs, texts) for w in t[:-1].split())
    codes = np.frombuffer(b"".join(r["codes"] for r in parts), np.uint32)
    want = [x for lang, t in zip(langs, texts) for x in [None, *((lang or "und", w) for w in t[:-1].split())]]
    assert [None if c == 0 else (words[c - 1]["lang"], words[c - 1]["word"]) for c in codes.tolist()] == want and {r["size"] for r in parts} == {len(words)}


def test_blocks_without_words_and_long_texts(monkeypatch):
    _task(monkeypatch)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 64)
    texts = [None, "", " ., ", "long " * 40, "a", "b. c", None, "d " * 60]
    out = [r for b in phrases._blocks(iter([pa.RecordBatch.from_pydict({"lang": pa.array([None] * 8, pa.string()), "text": pa.array(texts, pa.string())})])) for r in b.to_pylist()]
    assert Counter({(r["block"], r["word"]): r["times"] for r in out if r["word"] is not None}).total() == 40 + 3 + 60
    assert {r["block"] for r in out if r["word"] == "long"}.isdisjoint({r["block"] for r in out if r["word"] == "a"})
    assert {r["block"] for r in out} == {r["block"] for r in out if r["codes"] is not None}
    assert not list(phrases._blocks(iter([])))


def test_edges_take_little_memory():
    """Edges of a block are sorted in shares and given in small batches."""
    import tracemalloc

    codes = np.random.default_rng(2).integers(0, 90_000, 400_000).astype(np.uint32)
    cuts = np.split(codes, [65_536, 131_072, 300_000])
    left = pa.table({"part": [2, 0, 3, 1], "codes": pa.array([cuts[k].tobytes() for k in (2, 0, 3, 1)], pa.binary()), "size": [89_999] * 4})
    ids = np.arange(1, 90_000) * 3
    tracemalloc.start()
    try:
        edges = phrases._edges(phrases._whole(left), pa.table({"id": ids, "at": np.arange(len(ids))}))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    high, low, times = phrases.distinct_edges(codes, np.arange(90_000) * 3)
    two = (high & 0xFFFFFFFF) != 0
    got = sorted(zip(*(edges.column(c).to_pylist() for c in ("hi", "lo", "n"))))
    assert got == sorted(zip(high[two].tolist(), low[two].tolist(), times[two].tolist()))
    assert max(b.num_rows for b in edges.to_batches()) <= 1 << 15 and peak < 60 * len(codes)


def test_batches_of_a_size_end_with_the_job(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda: spark.range(4000).selectExpr("repeat('x', 1000) AS text").coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    was = key in spark.conf.getAll, spark.conf.get(key)
    with batches_of(spark, 100_000):
        assert max(r["n"] for r in sizes()) < 200
    assert (key in spark.conf.getAll, spark.conf.get(key)) == was and max(r["n"] for r in sizes()) > 200


def test_edges_of_wide_vocabularies():
    codes = np.random.default_rng(2).integers(0, 90_000, 300_000)
    ids = codes * 3
    high, low, times = phrases.distinct_edges(codes, np.arange(90_000) * 3)
    assert times.sum() == (ids > 0).sum()
    padded = np.append(ids, [0] * 3)
    want = Counter()
    for i in np.flatnonzero(ids):
        g = padded[i:i + 4].tolist()
        stop = g.index(0) if 0 in g else 4
        want[tuple(g[:stop] + [0] * (4 - stop))] += 1
    got = Counter({(h >> 32, h & 0xFFFFFFFF, x >> 32, x & 0xFFFFFFFF): n for h, x, n in zip(high.tolist(), low.tolist(), times.tolist())})
    assert got == want
