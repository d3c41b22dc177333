"""Quality rules as a ledger: measurements and failure bits once, policies and ablations by bit masks afterwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.llm.columns import WHITE, let, window_hashes, words

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the measurements; ``bit`` is its place in the ledger and never used again."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("short_words", 3, "word_chars < 2 * n_words"),
    Rule("long_words", 4, "word_chars > 15 * n_words"),
    Rule("repeated_lines", 5, "10 * n_dup_lines > 3 * n_lines"),
)
BASE = ("few_words", "repeated_windows")
#: Versions are only ever added: a stored ledger can be judged by any of them.
POLICIES = {1: BASE, 2: (*BASE, "symbols"), 3: (*BASE, "symbols", "short_words", "long_words", "repeated_lines")}


def mask(names, rules=RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in windows found at least twice in the text, the first finding included."""
    def count(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(marked, covered))

    def covered(m: Column) -> Column:
        twice = F.filter(m, lambda x, k: (F.get(m, k - 1)["h"] == x["h"]) | (F.get(m, k + 1)["h"] == x["h"]))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda x, k: F.least(F.lit(WINDOW), x - F.coalesce(F.get(s, k - 1), x - WINDOW))),
            F.lit(0), lambda a, b: a + b))

    return let(hashes, count)


def ledger(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the measurements and ``failed_bits``: bit ``r.bit`` is set where rule ``r`` fails.

    One pass, no shuffle. A null text has no words and no lines. Lines count only if they hold a word. Columns of ``docs``
    with names of results are replaced; repeated rows are judged each for itself.
    """
    own = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failed_bits")
    keep = [c for c in docs.columns if c not in own and c != text and not c.startswith("_q_")]
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    parts = docs.select(*keep, value.alias("_q_text"), words(F.col(text)).alias("_q_words"), lines.alias("_q_lines"))
    measured = parts.select(
        *keep, F.size("_q_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_q_words", "")).cast("bigint").alias("word_chars"),
        (F.length("_q_text") - F.length(F.regexp_replace("_q_text", "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        F.size("_q_lines").cast("bigint").alias("n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(window_hashes(F.transform("_q_words", lambda w: F.xxhash64(w)), WINDOW)).cast("bigint").alias("n_repeat_words"),
    )
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("bigint") for r in rules), F.lit(0).cast("bigint"))
    return measured.withColumn("failed_bits", bits)


def passes(names, rules=RULES) -> Column:
    """Whether a ledger row passes a policy, given as its rule names."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(names, rules))) == 0


def ablation(judged: DataFrame, names, rules=RULES) -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it fails, and rows kept with and without it.

    Rows are counted per distinct bit pattern first (at most 2 to the number of rules), so any policy is judged on those.
    An empty ledger gives zeros.
    """
    whole = mask(names, rules)
    patterns = judged.groupBy("failed_bits").agg(F.count("*").alias("n"))
    hit = F.col("failed_bits").bitwiseAND(F.lit(whole))
    sums = []
    for r in rules:
        if r.name in names:
            bit = F.lit(1 << r.bit)
            total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
            sums.append(F.struct(F.lit(r.name).alias("rule"), total(hit.bitwiseAND(bit) != 0).alias("failed"),
                                 total(hit == bit).alias("failed_alone"), total(hit == 0).alias("kept"),
                                 total(hit.bitwiseAND(F.lit(whole - (1 << r.bit))) == 0).alias("kept_without")))
    return patterns.agg(F.array(*sums).alias("r")).select(F.inline("r"))
