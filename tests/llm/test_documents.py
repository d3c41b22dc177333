"""Operators over documents against brute force, on awkward rows and on empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagmill.llm import chunk_bpe, fingerprints, hmm, jaccard, langid, lines, packing, quality, substrings, tokens
from lagmill.llm.arrays import word_hashes
from lagmill.llm.queries import BYTE_BPE, WORD_BPE

ROWS = brute.awkward()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encoding_equals_the_library_and_round_trips(docs, empty):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for d, t in PAIRS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, chunk_bpe.encode_documents(docs, BYTE_BPE).collect())) == want
    assert chunk_bpe.encode_documents(empty, BYTE_BPE).count() == 0


def test_chunk_joins_are_repaired_at_any_cut(monkeypatch):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    monkeypatch.setattr(chunk_bpe, "CUT_BITS", 2)
    texts = [t for _, t in PAIRS if t is None or len(t) < 3000] + ["aaaa" * 50, "it'll  we's\n\n  <|endoftext|>x  " * 20, "日本語" * 40]
    shared = dict(zip([b"the of and w1 w2"], chunk_bpe.ChunkEncoder(BYTE_BPE).encode_chunks([b"the of and w1 w2"])))
    got = chunk_bpe.ChunkEncoder(BYTE_BPE, shared).encode(pa.array(texts, pa.string()))
    assert [list(g) for g in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_shared_chunks_are_found_and_used(spark):
    text = " ".join(f"word{k * k % 9973}" for k in range(3000))
    docs = spark.createDataFrame([(k, text + f" {k}") for k in range(6)], "doc_id long, text string").repartition(3)
    shared = chunk_bpe.shared_chunks(docs, BYTE_BPE)
    assert shared and all(chunk.decode() in text + " " for chunk in shared)


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprint_documents(docs).collect()
    assert len(got) == len(ROWS)
    first = {}
    for d, t in PAIRS:
        if d is not None:
            first[d] = min(first.get(d, t or ""), t or "")
    ids = sorted(first, reverse=True)
    following = {d: first[ids[(k + 1) % len(ids)]] for k, d in enumerate(ids)}
    want = Counter()
    for d, t in PAIRS:
        t = t or ""
        half = len(t) // 2
        want[d, len(t), sha(t[:len(t) - half] + following.get(d, "")[:half])] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = defaultdict(set)
    for r in got:
        prints[{d: t or "" for d, t in PAIRS}.get(r.doc_id) if r.doc_id is not None else None].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for t, p in prints.items() if t is not None)
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_empty_bins_take_any_filled_bin_with_the_same_chance(spark):
    rows = [([100 + b if b in filled else None for b in range(fingerprints.BINS)], len(filled))
            for filled in ([7], [3, 90, 91], [1, 2, 3, 4, 200], list(range(0, 256, 2)))]
    df = spark.createDataFrame(rows, "v array<bigint>, filled int")
    for values, filled in df.select(fingerprints.densify(F.col("v")), "filled").collect():
        taken = Counter(values)
        assert len(values) == fingerprints.BINS and sum(taken.values()) == fingerprints.BINS and None not in taken
        if filled in (3, 5):
            assert len(taken) == filled and min(taken.values()) > 0.5 * fingerprints.BINS / filled


def test_rows_without_an_id_have_no_next_document(spark):
    rows = [(None, "a b c d e f g")] * 40 + [(1, "h i j k"), (2, None)]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    alone = [r for r in got if r.doc_id is None]
    assert len(got) == 42 and {(r.n_chars, r.edited_sha256, r.near_next) for r in alone} == {(13, sha("a b c d"), 0.0)}


def test_likeness_estimates_the_jaccard_similarity(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 800)]
    pairs, true = [], []
    sets = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    for size in (30, 120, 800):
        for share in (0.0, 0.3, 0.7, 1.0):
            a = base[:size]
            b = a[:int(size * share)] + [f"v{k}" for k in rng.integers(0, 5000, size - int(size * share))]
            pairs.append((" ".join(a), " ".join(b)))
            true.append(len(sets(a) & sets(b)) / len(sets(a) | sets(b)))
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    got = df.select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b")))).collect()
    assert max(abs(g[0] - t) for g, t in zip(got, true)) < 0.16
    assert np.mean([abs(g[0] - t) for g, t in zip(got, true)]) < 0.05


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = defaultdict(list)
    for d, t in PAIRS:
        ids[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    got = packing.pack_documents(docs, WORD_BPE).collect()
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        covered[r.doc_id, r.doc_tokens].extend(range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, lists in ids.items():
        for n, copies in Counter(map(len, lists)).items():
            assert Counter(covered[d, n]) == Counter({k: copies for k in range(n)})
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack_documents(empty, WORD_BPE).count() == 0


def test_known_pieces_are_not_learned_again(monkeypatch):
    """Only new pieces count towards what is remembered, and tasks of a worker share one memory."""
    learned, learn = [], tokens.PieceEncoder._learn
    monkeypatch.setattr(tokens.PieceEncoder, "_learn", lambda self, pieces: (learned.extend(pieces), learn(self, pieces))[1])
    encoder, plain = tokens.PieceEncoder(WORD_BPE, entries=100), Tokenizer.from_file(WORD_BPE)
    for k in (0, 0, 20, 60):  # 80 words; the same; 20 of them new; 40 new: memory starts anew
        pieces = [f"Wort{x}," for x in range(k, k + 80)]
        lengths, ids = encoder.encode(pa.array(pieces))
        wanted = [plain.encode(p, add_special_tokens=False).ids for p in pieces]
        assert lengths.tolist() == [len(w) for w in wanted] and ids.tolist() == sum(wanted, [])
    assert len(learned) == 80 + 0 + 20 + 80
    assert tokens.piece_encoder(WORD_BPE) is tokens.piece_encoder(WORD_BPE)


def test_words_share_pieces(monkeypatch):
    """Capitals and marks around a word give no new pieces, and ids stay those of the library, whatever characters meet."""
    encoder, plain = tokens.piece_encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    learned, kind = [], type(encoder)
    learn = kind._learn
    monkeypatch.setattr(kind, "_learn", lambda self, pieces: (learned.extend(pieces), learn(self, pieces))[1])
    kind(WORD_BPE, entries=100).encode(pa.array(["Straße", "STRAßE,", "(straße).", "straße's", "Straße's,", "Éa", "éa,", "(straße,", "éa).", "ÉA,", "(éa", "Straße)."], pa.large_string()))
    assert len(learned) <= 8
    odd = [*map(chr, range(1, 0x300)), "\u0301", "\u0331", "\u0338", "Σ", "ж", "語", "\u212a", "😀", "ﬁ", "\u2028", "<|", "|>", "'s", "<|ENDOFTEXT|>", "<|endoftext|>"]
    forms = ("{0}", "a{0}b", "H{0}", "{0}H.", "!{0}x", "1{0}'S", "{0}{0}", "é{0}É", "'{0}T", "={0}", "{0}|", "<{0}>", "foo'{0}re,{0}5")
    words = [w for c in odd for f in forms for w in f.format(c).split(" ") if w and not set(w) & set("\t\n\v\f\r")]
    wanted = [plain.encode(w, add_special_tokens=False).ids for w in words]
    for entries in (1 << 16, 3):
        encoder = kind(WORD_BPE, entries=entries)
        for part in (slice(None), slice(None, None, 7)):
            lengths, ids = encoder.encode(pa.array(words[part], pa.large_string()))
            assert lengths.tolist() == [len(w) for w in wanted[part]] and ids.tolist() == sum(wanted[part], [])


def test_known_pieces_take_little_memory():
    """A worker keeps what it knows when its task is over, beside the tasks of all later stages."""
    import tracemalloc

    words = pa.array(["".join(chr(97 + k // 26 ** e % 26) for e in range(4)) + "ung" for k in range(100_000)], pa.large_string())
    encoder = type(tokens.piece_encoder(WORD_BPE))(WORD_BPE, entries=1 << 17)
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        encoder.encode(words)
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert held < 100 * len(words)


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = packing.SumOfSquares(16)
    for _ in range(300):
        packer.counts = rng.integers(0, 4, 16)
        packer.counts[0] = 0
        length = int(rng.integers(1, 16))

        def squares(h):
            n = np.append(packer.counts, 0)
            n[h] -= h > 0
            n[h + length] += 1
            return int((n[1:16] ** 2).sum())

        fits = [h for h in range(17 - length) if h == 0 or packer.counts[h]]
        best = min(map(squares, fits))
        assert packer.level_for(length) == max(h for h in fits if squares(h) == best)


def test_open_windows_stay_bounded():
    packer = packing.SumOfSquares(64, most=5)
    for k in range(200):
        packer.add(k, np.full(40, k, np.uint32))
        assert packer.open <= 6
    packer.finish()
    rows = packer.drain()
    assert sum(rows["length"].to_pylist()) == 200 * 40


def test_lines(docs, empty):
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    want = Counter((*r[:1], t, *r[2:]) for r, t in zip(ROWS, brute.lines_kept(PAIRS)))
    assert Counter(tuple(r)[:9] for r in got.collect()) == want
    assert lines.dedup_lines(empty).count() == 0


def test_short_lines_are_one_shingle(spark):
    rows = [(1, "Menu\nhome page here\n\nHome"), (2, "Menu\n \na b c d"), (3, " Menu \nhome\thome\n\na  b c d\na b c d e"), (4, "Menu"),
            (5, "home  page here\na b c d"), (6, "a b c"), (None, "x\nx"), (7, "x y\nx"), (4, "Menu\nMenu")]
    want = [(1, "Menu\nhome page here\n\nHome", 4, 0), (2, "\u0020\na b c d", 3, 1), (3, "home\thome\n\na b c d e", 5, 2), (4, "", 1, 1),
            (5, "", 2, 2), (6, "a b c", 1, 0), (None, "x", 2, 1), (7, "x y", 2, 1), (4, "", 2, 2)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_counters_of_shingles(spark):
    """Each counter has its shingles, a group several counters; words are those of the pattern, whatever parts them."""
    texts = [" ".join(f"w{(k * m) % 997}" for m in range(1, 12)) for k in range(3000)] + ["a\tb  c d\x0be", "a b\x0cc\rd e f", "a b c d", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    split = df.select(lines._words(F.col("line")).alias("a"), lines.words(F.col("line")).alias("b")).collect()
    assert all(r.a == r.b for r in split) and split[3000].a == list("abcde")
    shingles = [h for r in df.select(lines._shingles(F.col("line")).alias("s")).collect() for h in r.s]
    wanted = Counter(h & (lines.COUNTERS - 1) for h in shingles)
    got = lines._counted(df)
    assert {r.c: r.n for r in got.collect() if r.n} == wanted
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert f"& {lines.GROUPS - 1}" in plan and lines.GROUPS <= 1 << 16


def test_shingles_written_out(spark):
    """Compiled windows are those of ``_shingles`` at any length; prefixes are the first tokens in one order, with and without
    ranks, and no ranks are copied into rows."""
    n = [1, 4, 5, 6, 36, 37, lines.WRITTEN_OUT + 3, lines.WRITTEN_OUT + 4, lines.WRITTEN_OUT + 5, 700]
    texts = [" ".join(f"w{(k * m) % 5003}" for m in range(size)) for k in (0, 1, 7) for size in n] + ["a b c d e a b c d e a b", "a  b\tc d e f"]
    texts += [f"all of these words are common u{k} v{k}" for k in range(300)]
    df = spark.createDataFrame([(k, 0, k, t) for k, t in enumerate(texts)], "doc long, at int, k long, line string")
    low = (1 << lines.HASH_BITS) - 1
    sets = {r.k: {h & low for h in r.s} for r in df.select("k", lines._shingles(F.col("line")).alias("s")).collect()}
    got = {r.k: r.shingles for r in lines._with_shingles(df, "k").collect()}
    assert all(len(got[k]) == len(s) and set(got[k]) == s for k, s in sets.items())
    counts = Counter(h & (lines.COUNTERS - 1) for s in sets.values() for h in s)
    rank = lambda h: int(math.log2(counts[h & (lines.COUNTERS - 1)] + 1) * 64)
    for ranks, of in ((lines._counters(df), rank), (F.array().cast("array<int>"), lambda h: 0)):
        rows = lines._prefixes(df, ranks)
        for r in rows.collect():
            assert r.size == len(sets[r.k])
            assert r.prefix == sorted((of(h) << lines.HASH_BITS) + h for h in sets[r.k])[: r.size - -(-4 * r.size // 5) + 1]
        assert "ubquery" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_shuffled_once_in_line_dedup(docs):
    """The join that verifies candidates and the one that removes lines read one shuffle."""
    got = lines.dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_removed", "text")
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert any("ReusedExchange" in row and "text#" in row for row in final.splitlines())


def test_quality(docs, empty):
    got = quality.ledger(docs)
    assert "g" in got.columns and "text" not in got.columns
    want = Counter()
    for d, t in PAIRS:
        w, full = brute.words(t), [x for x in (t or "").split("\n") if brute.words(x)]
        want[d, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), brute.repeat_words(t)] += 1
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()) == want
    rows = got.collect()
    names = quality.POLICIES[3]
    whole = quality.mask(names)
    for r in quality.ablation(got, names).collect():
        bit = quality.mask([r["rule"]])
        assert r.failed == sum(bool(x.failed_bits & bit) for x in rows)
        assert r.failed_alone == sum((x.failed_bits & whole) == bit for x in rows)
        assert r.kept == sum(not x.failed_bits & whole for x in rows)
        assert r.kept_without == sum(not x.failed_bits & (whole - bit) for x in rows)
    assert got.where(quality.passes(names)).count() == sum(not x.failed_bits & whole for x in rows)
    assert quality.ledger(empty).count() == 0 and quality.ablation(quality.ledger(empty), names).count() == len(names)


def test_language(spark, sf_dir, docs, empty):
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(known, ~held)
    found = langid.identify(known.where(held), model)
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    assert found.where("lang_rejected").count() <= 0.02 * found.count()
    got = langid.identify(docs, model)
    assert sorted(got.columns) == sorted({*docs.columns, "lang_pred", "score", "lang_rejected"})
    for r in got.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert letters or r.lang_rejected
    assert langid.identify(empty, model).count() == 0
    assert [r.lang_pred for r in langid.identify(docs.limit(3), langid.train(empty)).collect()] == ["und"] * 3


def test_subwords_are_summed_in_blocks():
    """The rows of all subwords of a slice are not held at once: workers share the memory of an executor."""
    import tracemalloc

    rng = np.random.default_rng(3)
    model = langid.Model(list("abcd"), rng.normal(size=(langid.BUCKETS, 4)).astype(np.float32), np.zeros(4), 1.0, 0.0)
    words = ["".join(chr(97 + k // 26 ** e % 26) for e in range(4)) + "keitung" for k in range(60_000)]
    texts = pa.array([" ".join(words[k:k + 300]) for k in range(0, len(words), 300)], pa.large_string())
    tracemalloc.start()
    try:
        got = model.probabilities(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6
    counts, buckets = langid.subwords(pa.array(words[:300], pa.large_string()))
    wanted = langid.softmax(model.table[buckets].astype(np.float64).sum(axis=0)[None] / counts.sum())
    assert np.allclose(got[0], wanted[0])


def test_rare_languages_and_long_texts_are_learned(spark):
    letters = {"aa": "bcdfg", "bb": "hjklm", "cc": "npqrs"}
    rng = np.random.default_rng(4)
    text = lambda lang, n: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(n))
    rows = [(k, text("aa", 12), "aa") for k in range(600)] + [(k, text("bb", 12), "bb") for k in range(4)]
    rows += [(k, text("cc", langid.SAMPLE_CHARS // 4), "cc") for k in range(3)] + [(0, text("aa", 12), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    drawn = langid.sample(docs.unionByName(docs.where("lang = 'aa'")), None, 60).collect()
    assert Counter(r.lang for r in drawn)["bb"] == 4 and Counter(r.lang for r in drawn)["cc"] == 3
    assert len(drawn) <= 60 and len({r.h for r in drawn}) == len(drawn)
    assert {len(r.text) for r in drawn if r.lang == "cc"} == {langid.SAMPLE_CHARS}
    assert langid.quotas({"a": 10_000, "b": 3}, 100) == {"a": 74, "b": 3} and langid.quotas({}, 100) == {}
    assert sum(langid.quotas({str(k): 50 for k in range(30)}, 40).values()) <= 40


def test_near_classes(docs, empty):
    want = Counter((d, c, n) for (d, _), (c, n) in zip(PAIRS, brute.near_links(PAIRS)))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_classes(docs).collect()) == want
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _ in want}
    assert jaccard.near_classes(empty).count() == 0


def test_large_buckets_and_clusters_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(jaccard, "CLUSTER_BLOCK", 4)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[:60] + [f"x{k}"] + base[60:])) for k in range(25)] + [(99, "other text of no kin to the rest")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_classes(docs).collect()}
    assert got == {(k, 0, 24) for k in range(25)} | {(99, 99, 0)}


def test_paths_meet_as_often_as_computed():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(200):
        a = rng.integers(0, 1 << 32, (1, jaccard.MINIMA), dtype=np.uint32)
        b = np.where(rng.random((1, jaccard.MINIMA)) < 0.8, a, a + 1).astype(np.uint32)
        met += bool(set(jaccard.paths(a, jaccard.runs_needed())[1]) & set(jaccard.paths(b, jaccard.runs_needed())[1]))
    assert met >= 196


def test_scores(docs, empty):
    held, learned = F.col("doc_id") % 7 == 2, F.col("doc_id") % 7 != 2
    got = hmm.score_documents(docs, held, learned, rounds=1).collect()
    tokens = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in brute.words(t)] + ["\n"]
    counts = Counter(x for d, t in PAIRS if d is not None and d % 7 != 2 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in PAIRS:
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t))
        want[d, d is not None and d % 7 == 2, len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score_documents(empty, held, learned, rounds=1).count() == 0


def test_scores_beat_the_base_on_unseen_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    found = hmm.score_documents(docs, held, ~held).where("held_out").agg(F.avg(F.expr("score / n_tokens")), F.avg(F.expr("base_score / n_tokens"))).first()
    assert found[0] > found[1]


def test_forward_equals_the_sum_over_all_state_paths():
    import itertools

    rng = np.random.default_rng(8)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 2, 6, 4)]
    packed = hmm.Packed(sequences)
    logs = np.empty(5)
    logs[packed.order] = hmm.forward(model, packed, False)[0]
    starts, moves, emissions = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, log in zip(sequences, logs):
        total, weights = 0.0, []
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * np.prod([model.emit[x, z] for x, z in zip(s, path)]) * np.prod([model.move[a, b] for a, b in zip(path, path[1:])])
            total += p
            weights.append((path, p))
        assert abs(math.log(total) - log) < 1e-9
        for path, p in weights:
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for x, z in zip(s, path):
                emissions[x, z] += p / total
    for mine, theirs in zip(hmm.expected(model, sequences), (starts, moves, emissions)):
        np.testing.assert_allclose(mine, theirs, atol=1e-9)


def test_counts_need_no_likelihoods(monkeypatch):
    """A round of training reads emissions once and forms no likelihoods; sequences that end early begin anew backwards."""
    rng = np.random.default_rng(5)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    sequences = [rng.integers(0, 5, n) for n in (4, 1, 9, 4)]
    alone = [hmm.expected(model, [s]) for s in sequences]
    monkeypatch.setattr(hmm, "forward", lambda *_: pytest.fail("likelihoods formed"))
    for together, parts in zip(hmm.expected(model, sequences), zip(*alone)):
        assert np.allclose(together, sum(parts))
    assert np.isclose(hmm.expected(model, sequences)[2].sum(), 18)


def test_repeats(docs, empty):
    got = substrings.remove_repeats(docs)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept_sha256"]
    want = Counter((d, n, n - len(kept), sha(" ".join(kept))) for (d, _), (n, kept) in zip(PAIRS, brute.repeats_removed(PAIRS)))
    rows = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want
    assert all(sha(" ".join(brute.words(r.text))) == r.kept_sha256 for r in rows)
    untouched = {(r.doc_id, r.text) for r in rows if not r.n_removed}
    assert untouched <= set(PAIRS)
    assert substrings.remove_repeats(empty).count() == 0


def test_word_hashes_follow_content():
    rng = random.Random(5)
    words = ["", "a", "ab", "a\0", "é" * 40, "x" * 64, "x" * 65, "x" * 5000] + ["".join(rng.choices("abé日\0", k=rng.randrange(90))) for _ in range(2000)]
    h = word_hashes(pa.array(words * 2, pa.large_string()))
    assert h[:len(words)].tolist() == h[len(words):].tolist()
    assert len(set(h.tolist())) == len(set(words))
    assert word_hashes(pa.array(words, pa.large_string()).slice(7, 90)).tolist() == h[7:97].tolist()
    assert word_hashes(pa.array(words)).tolist() == h[:len(words)].tolist()
    assert not len(word_hashes(pa.array([], pa.large_string())))


def test_equal_windows_have_equal_representatives():
    rng = np.random.default_rng(6)
    for alphabet in (2, 3, 8, 50):
        h = chunk = rng.integers(1, 1 << 63, alphabet, dtype=np.uint64)[rng.integers(0, alphabet, 600)]
        del chunk
        doc = np.repeat(np.arange(6), 100)
        h[300:360] = h[20:80]
        h[550:600] = h[130:180]
        best = substrings.window_anchors(h, doc)
        inside = substrings._inside(np.arange(0, 601, 100), 600)
        seen = {}
        for i in np.flatnonzero(inside):
            assert seen.setdefault(h[i:i + 13].tobytes(), best[i]) == best[i]


def test_long_symbols_name_equal_content_alike():
    rng = np.random.default_rng(9)
    h = rng.integers(1, 1 << 63, 4, dtype=np.uint64)[rng.integers(0, 4, 3000)]
    h[2000:2700] = h[100:800]
    h[900:960] = h[900]
    doc = np.repeat(np.arange(3), 1000)
    name, first, stop, owner = substrings.long_passages(h, doc)
    content = {}
    for n, a, b in zip(name, first, stop):
        assert content.setdefault(n, h[a:b].tobytes()) == h[a:b].tobytes()
    assert len(content) < len(name)
