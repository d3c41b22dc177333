"""URL filter: host-suffix and path-prefix expressions joined to rules on short digest prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the hexadecimal digest that the join compares; the whole digest is confirmed afterwards.
SHORT = 8


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.call_function("substring", url, at + 3)).otherwise("")


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _expression(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), directory), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", unruled: str = "allow", no_host: str = "block") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; ``rules`` has ``host``, ``path``, ``verdict``.

    A rule fits its host and all subdomains when the path starts with the rule's path. The longest rule wins; of equally
    long ones the longer host, then ``block``. Each URL is expanded once per distinct URL, and only into the shapes (labels
    of the host, slashes of the path) that some rule has, so very long hosts and paths stay linear. The directory of a rule
    (its path up to the last slash) is what is hashed; the rest of its path is compared after the join.

    Without a fitting rule the verdict is ``unruled``, or ``no_host`` for URLs without a host (null ones too). Repeated
    rows are kept; columns of ``pages`` with the names of results are replaced; rules with a null part are ignored.
    """
    known = (
        rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
        .withColumn("labels", _count(F.col("host"), ".") + 1)
        .withColumn("slashes", _count(F.col("path"), "/"))
        .withColumn("digest", _expression(F.col("host"), _directory(F.col("path"), F.col("slashes"))))
        .select(F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"),
                "verdict", "labels", "slashes", "digest", F.substring("digest", 1, SHORT).alias("short"))
    )
    shapes = known.select(F.collect_set(F.struct("labels", "slashes"))).scalar()
    distinct = pages.select(F.col(url).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    parts = distinct.select("_url", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path")).withColumn(
        "host_labels", _count(F.col("host"), ".") + 1).withColumn("path_slashes", _count(F.col("path"), "/"))
    expanded = (
        parts.where("host <> ''").withColumn("shape", F.explode(shapes))
        .where("shape.labels <= host_labels and shape.slashes <= path_slashes")
        .select("_url", "path", _expression(F.expr("substring_index(host, '.', -shape.labels)"),
                                            _directory(F.col("path"), F.col("shape.slashes"))).alias("full"))
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    order = F.struct(F.length("rule"), "host_length", "verdict")
    best = (
        expanded.join(known, "short").where("full = digest and startswith(path, rule_path)")
        .groupBy("_url").agg(F.max_by(F.struct("rule", "verdict"), order).alias("_best"))
    )
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    joined = pages.select(*[F.col(c) for c in keep]).join(best, F.col(url) == F.col("_url"), "left")
    host = url_host(F.col(url))
    return joined.select(
        *keep, host.alias("host"), url_path(F.col(url)).alias("path"), F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.when(host == "", F.lit(no_host)).otherwise(F.lit(unruled))).alias("verdict"))


def _directory(path: Column, slashes: Column) -> Column:
    """The first ``slashes`` slashes of a path and what stands before them."""
    return F.when(slashes == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), slashes), F.lit("/")))
