"""Line deduplication by an exact set-similarity join. DataFrame functions only.

Tokens of a line are its five-word shingles. They are put in one order for all lines, rare ones first, so that two lines of
similarity 0.8 share a token within the first fifth of each (the prefix). The order comes from counts of all shingles of all
lines in ``COUNTERS`` hashed counters: a list of bounded size in which frequent shingles stand out.

A line of fewer than five words is one shingle of all its words: similar to a line with the same words, and to no other. Its
words name it, so that such lines meet by name and never enter the join.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagmill.llm.columns import WHITE, let, window_hashes, words
from lagmill.session import scratch_folder

SHINGLE = 5
COUNTERS = 1 << 18
#: Groups that Spark's aggregation finds without its slower second map; a group has several counters.
GROUPS = 1 << 16
#: Bits of a token that are its hash; those above are its rank, 64 steps for each doubling of its counter.
HASH_BITS = 51
_LOW = (1 << HASH_BITS) - 1
_NO_KEY = -(1 << 63)
#: Shingles of a line that are written out one by one, as plain expressions; longer lines take a lambda function.
WRITTEN_OUT, _BLOCK = 256, 32


def _key(c: str = "doc_id") -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(_NO_KEY))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, at, line) of all lines that are not blank, without the white space around them; ``k`` names the line."""
    split = docs.select(_key().alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    trimmed = split.select("doc", "at", F.trim("line", F.lit(WHITE)).alias("line")).where("line <> ''")
    return trimmed.select("doc", "at", "line", _plain(F.col("line")).alias("plain")).select(
        "doc", "at", "line", F.xxhash64("plain", F.length("plain")).alias("k"))


def _long_enough(line: Column) -> Column:
    """Whether a line has a shingle of five words."""
    return line.rlike(r"^[ \t-\r]*(?:[^ \t-\r]+[ \t-\r]+){%d}[^ \t-\r]" % (SHINGLE - 1))


def _plain(line: Column) -> Column:
    """What names a trimmed line; of fewer than five words those alone count, not the white space between them."""
    return F.when(_long_enough(line), line).otherwise(F.regexp_replace(line, r"[ \t-\r]+", " "))


def _name(line: Column) -> Column:
    return let(_plain(line), lambda t: F.xxhash64(t, F.length(t)))


def _words(line: Column) -> Column:
    """Words of a trimmed line. Without a pattern where one space stands between words, as nearly everywhere."""
    line = F.coalesce(line, F.lit(""))
    other = reduce(or_, [F.contains(line, F.lit(c)) for c in ("  ", *WHITE.replace(" ", ""))])
    return F.when(other, words(line)).otherwise(F.split(line, " "))


def _shingles(line: Column) -> Column:
    return F.array_distinct(window_hashes(F.transform(_words(line), lambda w: F.xxhash64(w)), SHINGLE))


def _with_shingles(lines: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``lines`` and ``shingles``, the lower bits of ``_shingles``. Lambda functions are not compiled, plain
    expressions are: hence the windows of all but the longest lines are written out, in blocks that a line reaches or not."""
    window = lambda i: "xxhash64(" + ", ".join(f"get(hashes, {i + k})" for k in range(SHINGLE)) + f") & {_LOW}L"
    blocks = [f"if(size(hashes) > {b + SHINGLE - 1}, array({', '.join(map(window, range(b, b + _BLOCK)))}), array_repeat(0L, 0))"
              for b in range(0, WRITTEN_OUT, _BLOCK)]
    n = F.size("hashes") - (SHINGLE - 1)
    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    longest = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(SHINGLE)]).bitwiseAND(F.lit(_LOW)))
    written = F.slice(F.expr(f"concat({', '.join(blocks)})"), F.lit(1), F.greatest(n, F.lit(0)))
    hashed = lines.select(*keep, F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.select(*keep, F.when(n <= WRITTEN_OUT, written).otherwise(longest).alias("windows")).select(
        *keep, F.array_distinct("windows").alias("shingles"))


def _counter(h: Column) -> Column:
    return h.bitwiseAND(F.lit(COUNTERS - 1))


def _counted(lines: DataFrame) -> DataFrame:
    """(c, n): the shingles of all lines in each counter; the counters c, c + ``GROUPS``, .. are columns of one group."""
    h, parts = F.col("h"), range(COUNTERS // GROUPS)
    part = F.shiftright(_counter(h), GROUPS.bit_length() - 1)
    # An explode that is not outer would filter by all windows written out, which the optimizer copies and takes minutes over.
    groups = _with_shingles(lines).select(F.explode_outer("shingles").alias("h")).where("h is not null").groupBy(h.bitwiseAND(F.lit(GROUPS - 1)).cast("int").alias("g")).agg(
        *[F.count_if(part == k).alias(f"n{k}") for k in parts])
    return groups.select(F.inline(F.array(*[F.struct((F.col("g") + k * GROUPS).cast("long").alias("c"), F.col(f"n{k}").alias("n")) for k in parts])))


def _counters(lines: DataFrame) -> Column:
    """Ranks of all counters as one array. It is a literal: the value of a subquery would be copied into each row. The driver
    gets ``COUNTERS`` numbers at most."""
    ranks = ["0"] * COUNTERS
    for c, n in _counted(lines).where("n > 0").collect():
        ranks[c] = str(int(math.log2(n + 1) * 64))
    return F.split(F.lit(",".join(ranks)), ",").cast("array<int>")


def _prefixes(lines: DataFrame, ranks: Column) -> DataFrame:
    """(doc, at, k, size, prefix): the number of tokens of each line and the first ones in the order of all lines: rank above,
    hash below. None is null, so that they are sorted as plain numbers."""
    keep = ("doc", "at", "k")
    rank = lambda h: F.coalesce(F.get(ranks, _counter(h).cast("int")), F.lit(0)).cast("long")
    sets = _with_shingles(lines, *keep).select(
        *keep, F.sort_array(F.transform("shingles", lambda h: F.shiftleft(rank(h), HASH_BITS) + h)).alias("tokens"))
    # Similar lines share one of the first size - ceil(0.8 size) + 1 tokens.
    return sets.select(*keep, F.size("tokens").alias("size"), F.expr(
        "slice(tokens, 1, cast(size(tokens) - floor((size(tokens) * 4 + 4) / 5) + 1 as int))").alias("prefix"))


def _may_match() -> Column:
    """Of lines x and y that share a token: whether it is the first that they share, and the length and positional filters
    hold. What follows the first shared token must suffice for the overlap of 0.8; each pair is met at that token only."""
    x, y, i, j = (F.col(c) for c in ("x.size", "y.size", "x.pos", "y.pos"))
    enough = 9 * (F.least(x - i, y - j)) >= 4 * (x + y)
    return (5 * x >= 4 * y) & (5 * y >= 4 * x) & enough & ~F.arrays_overlap("x.before", "y.before")


def _similar(pairs: DataFrame, named: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines whose shingles have a Jaccard similarity of 0.8 or more. Only lines of pairs are read."""
    keys = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    places = keys.join(firsts, "k").groupBy("doc").agg(F.collect_list(F.struct("at", "k")).alias("wanted"))
    # One shuffle of texts serves this join and that of dedup_lines, as long as both read the same columns: hence a condition
    # that always holds.
    texts = named.join(places.withColumnRenamed("doc", "_doc"), "_doc").where(
        reduce(or_, [F.col(f"`{c}`").isNull() for c in named.columns], F.size("wanted") > 0))
    found = let(F.split("text", "\n"), lambda lines: F.transform(
        "wanted", lambda w: F.struct(w["k"].alias("k"), F.trim(F.get(lines, w["at"]), F.lit(WHITE)).alias("line"))))
    sets = texts.select(F.inline(found))
    # Of repeated rows of a document the one with the named line counts.
    sets = sets.where(F.xxhash64("line", F.length("line")) == F.col("k")).groupBy("k").agg(F.first(_shingles(F.col("line"))).alias("set"))
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _later(similar: DataFrame, firsts: DataFrame) -> DataFrame:
    """The later line of each pair, by its first place."""
    placed = similar.join(firsts.select(F.col("k").alias("a"), F.struct("doc", "at").alias("p")), "a").join(
        firsts.select(F.col("k").alias("b"), F.struct("doc", "at").alias("q")), "b")
    return placed.select(F.when(F.col("p") < F.col("q"), F.col("b")).otherwise(F.col("a")).alias("k")).distinct()


def removed_lines(docs: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places of all lines, first place of each distinct line, names of lines that are similar to a line with an earlier first
    place). ``named`` is ``docs`` with the key ``_doc``.

    Tokens of one line only are dropped before lines are joined on their prefix tokens.
    """
    spark = docs.sparkSession
    at = {name: scratch_folder(spark, name) for name in ("places", "firsts", "tokens", "pairs")}
    lines = _lines(docs)
    # Lines of fewer than five words have no shingles: no counts, no prefixes.
    _prefixes(lines, _counters(lines)).write.parquet(at["places"])
    placed = spark.read.parquet(at["places"])
    places = placed.select("doc", "at", "k")
    places.groupBy("k").agg(F.min(F.struct("doc", "at")).alias("p"), F.count("*").alias("n")).select("k", "p.doc", "p.at", "n").write.parquet(at["firsts"])
    firsts = spark.read.parquet(at["firsts"])
    once = placed.where("size > 0").groupBy("k").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    rows = once.select("k", "size", F.posexplode("prefix").alias("pos", "token"))
    several = rows.withColumn("lines", F.count("*").over(W.partitionBy("token"))).where("lines > 1").drop("lines")
    several.write.parquet(at["tokens"])
    # For each line and token the line's earlier tokens, of those that it may share.
    shared = spark.read.parquet(at["tokens"]).groupBy("k").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    shared = shared.select("k", "size", F.transform("t", lambda e: e["token"]).alias("all"), F.posexplode("t").alias("n", "e"))
    shared = shared.select("k", "size", "e.pos", "e.token", F.expr("slice(all, 1, n)").alias("before"))
    met = shared.alias("x").join(shared.alias("y"), F.col("x.token") == F.col("y.token")).where((F.col("x.k") < F.col("y.k")) & _may_match())
    met.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).write.parquet(at["pairs"])
    return places, firsts, _later(_similar(spark.read.parquet(at["pairs"]), named, firsts), firsts)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without lines that an earlier line equals or is similar to, and ``n_lines``, ``n_removed``.

    Lines are ordered by (doc_id, number in the text), null ids first. A line goes if an equal one stands earlier, or if its
    five-word shingles have a Jaccard similarity of 0.8 or more to those of a line that first stands earlier (kept or not).
    Fewer than five words are one shingle: such a line goes if a line of the same words stands earlier. Blank lines stay.
    Rows of one ``doc_id`` share their places: equal lines at one place do not remove each other. Null texts stay null. Other
    columns pass through; those with names of results are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    named = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("_doc", _key())
    places, firsts, later = removed_lines(docs, named)
    gone = F.coalesce("similar", F.lit(False))
    # What a document needs to know of each of its lines: one row for each line that does not stay everywhere.
    marks = (
        places.join(firsts.select("k", F.col("doc").alias("d0"), F.col("at").alias("a0"), "n")
                                       .join(later.withColumn("similar", F.lit(True)), "k", "left").where(gone | (F.col("n") > 1)), "k")
        .where(gone | (F.col("d0") != F.col("doc")) | (F.col("a0") != F.col("at"))).groupBy("doc").agg(F.collect_set(F.struct("at", "k")).alias("_gone"))
    )
    joined = named.join(marks.withColumnRenamed("doc", "_doc"), "_doc", "left")

    def of(lines: Column) -> Column:
        name = lambda line: let(F.trim(line, F.lit(WHITE)), _name)
        return F.filter(lines, lambda line, i: ~(F.array_contains("_gone.at", i) & F.array_contains(
            "_gone", F.struct(i.alias("at"), name(line).alias("k")))))

    split = F.split("text", "\n")
    lines = F.when(F.col("_gone").isNull(), split).otherwise(of(split))
    out = joined.withColumn("_kept", lines).withColumn("n_lines", F.coalesce(F.size(split), F.lit(0))).withColumn(
        "n_removed", F.coalesce(F.col("n_lines") - F.size("_kept"), F.lit(0)))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text")
    return out.select(*[text if c == "text" else F.col(f"`{c}`") for c in keep], "n_lines", "n_removed")
