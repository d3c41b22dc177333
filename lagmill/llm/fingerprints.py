"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.llm.columns import let, window_hashes, words
from lagmill.session import scratch_folder

SHINGLE = 5
BINS = 256
BITS = 4
#: Hashed lookups per empty bin before the filled bins are ranked for it.
ROUNDS = 16


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all word shingles; a text of fewer words is one shingle, a text without words has none."""
    def of(h: Column) -> Column:
        short = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
        return F.when(F.size(h) < width, short).otherwise(window_hashes(h, width))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def bin_minima(hashes: Column, bins: int = BINS) -> Column:
    """Array of ``bins`` smallest hashes, null where empty. High bits name the bin, so one sort finds all minima."""
    shift = 64 - (bins.bit_length() - 1)
    place = lambda x: F.shiftrightunsigned(x, shift).cast("int")

    def pick(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (place(F.get(s, i - 1)) != place(x)))

    def spread(firsts: Column) -> Column:
        by_bin = F.map_from_arrays(F.transform(firsts, place), firsts)
        full = F.size(firsts) == bins
        # Signed order puts bins of negative hashes first: the same rotation for every text, undone here.
        turned = F.concat(F.slice(firsts, bins // 2 + 1, bins // 2), F.slice(firsts, 1, bins // 2))
        return F.when(full, turned).otherwise(let(by_bin, lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.element_at(m, b))))

    return let(F.sort_array(hashes), lambda s: let(pick(s), spread))


def densify(minima: Column, bins: int = BINS, rounds: int = ROUNDS) -> Column:
    """Empty bins take the value of a filled bin found by hashed lookups, each bin by a sequence of its own.

    Sequences are the same for every text. A bin that ``rounds`` lookups leave empty takes the filled bin whose number has
    the smallest hash with its own: again any filled bin with the same chance, and the same one in texts that share it.
    """
    def fill(v: Column) -> Column:
        donors = lambda b: F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda t: F.get(v, F.pmod(F.hash(b, t), F.lit(bins))))
        found = lambda b: F.get(F.filter(donors(b), lambda x: x.isNotNull()), F.lit(0))
        numbered = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("bin"), x.alias("value"))), lambda s: s["value"].isNotNull())

        def spread(filled: Column) -> Column:
            ranked = lambda b: F.array_min(F.transform(
                filled, lambda s: F.struct(F.xxhash64(b, s["bin"]).alias("rank"), s["value"].alias("value"))))["value"]
            return F.transform(v, lambda x, b: F.coalesce(x, found(b), ranked(b)))

        return F.when(F.forall(v, lambda x: x.isNotNull()), v).otherwise(let(numbered, spread))

    return let(minima, fill)


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Low ``bits`` (4) bits of each bin, packed: one hexadecimal digit a bin. Empty for a text without words."""
    if bits != 4:
        raise ValueError("one hexadecimal digit holds a bin: bits must be 4")

    def pack(h: Column) -> Column:
        low = F.transform(densify(bin_minima(h, bins), bins), lambda x: F.lower(F.hex(x.bitwiseAND(F.lit(15)))))
        return F.when(F.size(h) == 0, F.lit("")).otherwise(F.array_join(low, ""))

    return let(shingle_hashes(text), pack)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity: the share of equal bins less what chance makes equal, from 0 to 1.

    Two texts without words are alike (1); one without words is unlike any other (0).
    """
    def match(x: Column, y: Column) -> Column:
        return F.length(F.array_join(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(p == q, F.lit("1")).otherwise("")), ""))

    chance = 2.0 ** -bits
    share = match(a, b).cast("double") / bins
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def next_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, next_key): the next smaller key, and the largest after the smallest. Only keys are shuffled.

    Keys are cut into ranges; a range finds its own successors, and the largest keys of the ranges (one row each) say what
    follows its smallest. The ranges are written once, so that both uses see the same cuts.
    """
    spark = docs.sparkSession
    path = scratch_folder(spark, "keys")
    # A sort deals the keys out by range; with the partition number beside them the cuts are fixed for both uses.
    docs.select(key).where(F.col(key).isNotNull()).distinct().sort(key).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    inside = Window.partitionBy("_range").orderBy(key)
    tops = ranged.groupBy("_range").agg(F.max(key).alias("_top"))
    # One row per range, never per key.
    below = tops.withColumn("_below", F.coalesce(F.lag("_top").over(Window.orderBy("_range")), F.max("_top").over(Window.partitionBy())))
    return (
        ranged.withColumn("_next", F.lag(key).over(inside)).join(F.broadcast(below), "_range")
        .select(key, F.coalesce("_next", "_below").alias("next_key"))
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The edited text replaces the last half of the code points by as many first ones (or all) of the next document in
    descending ``doc_id``. Null texts are empty. Of repeated ``doc_id`` the text that sorts first stands for the next
    document; each row keeps its own result; rows with a null ``doc_id`` have no next document, keep their first half and are
    never shuffled. Only ``doc_id`` and ``text`` are read. Texts are shuffled once by ``doc_id``, and of each next document
    only the part that is needed.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Both uses of the shuffled texts have the same columns and no null ids, so that one shuffle serves them.
    own = texts.where("doc_id is not null").withColumnRenamed("doc_id", "key")
    printed = own.withColumn("fingerprint", fingerprint(F.col("text")))
    lengths = own.groupBy(F.col("key").alias("doc_id")).agg(F.max(F.length("text")).alias("longest"))
    links = next_documents(docs).withColumnRenamed("next_key", "next_id")
    needs = links.join(lengths, "doc_id").select(
        F.col("next_id").alias("key"), F.col("doc_id").alias("for_id"), F.floor(F.col("longest") / 2).cast("int").alias("need"))
    # A running count, not row_number(): the optimizer would put a row limit below one of two equal shuffles of the texts.
    first = F.count("*").over(Window.partitionBy("key").orderBy("text").rowsBetween(Window.unboundedPreceding, 0)) == 1
    prints = printed.withColumn("first", first)
    heads = prints.where("first").join(needs, "key").select(
        F.col("for_id").alias("key"), F.expr("left(text, need)").alias("head"), F.col("fingerprint").alias("next_fingerprint"))
    alone = texts.where("doc_id is null").withColumn("fingerprint", fingerprint(F.col("text"))).withColumns(
        {"head": F.lit(None).cast("string"), "next_fingerprint": F.lit(None).cast("string")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = (
        printed.join(heads, "key", "left").withColumnRenamed("key", "doc_id").unionByName(alone).withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("edited", F.concat(F.call_function("left", F.col("text"), (F.col("n_chars") - half).cast("int")),
                                       F.coalesce(F.call_function("left", F.col("head"), half), F.lit(""))))
        .withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    )
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("next_fingerprint")), F.lit(0.0)).alias("near_next"))
