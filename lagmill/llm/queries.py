"""Registered queries of the operators, and the SQL that states their results where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagmill.llm.alignment import align_documents
from lagmill.llm.chat import conversation_digests, format_conversations
from lagmill.llm.chunk_bpe import encode_documents
from lagmill.llm.fingerprints import fingerprint_documents
from lagmill.llm.hmm import score_documents
from lagmill.llm.jaccard import near_classes
from lagmill.llm.langid import identify, train
from lagmill.llm.lines import dedup_lines
from lagmill.llm.packing import pack_documents
from lagmill.llm.phrases import mine_phrases
from lagmill.llm.quality import BASE, POLICIES, ledger, mask, passes
from lagmill.llm.substrings import remove_repeats
from lagmill.llm.urls import judge_urls

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@_query("op1_chunk_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_documents(spark, sf_dir), BYTE_BPE)


@_query("op2_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_documents(spark, sf_dir))


@_query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), WORD_BPE)


@_query("op4_lines")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
     g AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM d, unnest(generate_series(1, len(w) - 7)) AS t(i)),
     r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
     c AS (SELECT doc_id, sum(least(8, coalesce(i - before, 8))) AS n
           FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) AS b GROUP BY doc_id),
     m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
           FROM d LEFT JOIN c USING (doc_id)),
     b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 3 * n_lines) AS kept,
       CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
            + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 15 * n_words)::INT
            + 32 * (10 * n_dup_lines > 3 * n_lines)::INT AS BIGINT) AS failed_bits
FROM b"""


@_query("op5_quality", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ledger(_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base.alias("base_failed"), passes(POLICIES[max(POLICIES)]).alias("kept"), "failed_bits")


def _fold(n: int):
    """The remainder that parts documents into folds; 2 is held out."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@_query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = train(docs, _fold(4) != 2)
    return identify(docs.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "text"), model).drop("text")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
OP7_SQL = r"""
WITH r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                           ('org', '/fr/', 'allow')),
     u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     s AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM u),
     b AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM s, r
           WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN b USING (k)"""


@_query("op7_url_filter", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@_query("op9_hmm_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir), _fold(7) == 2, _fold(7) != 2)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
           FROM documents),
     g AS (SELECT doc_id, i, hash(list_slice(w, i, i + 12)) AS g FROM d, unnest(generate_series(1, len(w) - 12)) AS t(i)),
     m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
     r AS (SELECT g.doc_id, i FROM g JOIN m USING (g) WHERE least < g.doc_id),
     x AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(13) AS s(k)),
     k AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
     p AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(generate_series(1, len(w))) AS t(i)),
     q AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN q USING (doc_id)"""


@_query("op10_substrings", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
           FROM documents),
     s AS (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS s FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i)
           WHERE len(w) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n))
SELECT doc_id, CAST(count(b) AS BIGINT) AS n_links FROM d LEFT JOIN l ON a = doc_id GROUP BY doc_id"""


@_query("op8_near_documents")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_documents(spark, sf_dir))


OP11_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
     e AS (SELECT *, CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 END AS markers,
                  length(regexp_replace(replace(text, '\', '\\'), '(<)(/?s>|</?(?:SYS|ROLE|TEXT)>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) AS escaped,
                  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                  last_value(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
           FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(markers + escaped) AS BIGINT) AS formatted_chars,
       count(*) FILTER (NOT (role = 'system' AND before IS NULL OR role = 'user' AND coalesce(before, '') IN ('', 'system', 'assistant')
                             OR role = 'assistant' AND coalesce(before, '') = 'user')) AS n_misplaced,
       max(final) = 'assistant' AS complete
FROM e GROUP BY conv_id"""


@_query("op11_chat", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
        for k, role in enumerate(("user", "assistant"))])))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted)
    return conversation_digests(format_conversations(rows))


@_query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(_documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


OP13_SQL = r"""
WITH p AS (SELECT lang, doc, k, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[.,;:!?\x0A-\x0D]') AS pieces FROM documents) AS d, unnest(pieces) WITH ORDINALITY AS u(piece, k)),
     g AS MATERIALIZED (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS f
           FROM p, range(1, 5) AS s(m), unnest(generate_series(1, len(w) - m + 1)) AS t(i) GROUP BY ALL),
     n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
     c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= 30),
     k AS MATERIALIZED (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
                        FROM c, range(1, 4) AS t(k) WHERE k < m),
     s AS (SELECT k.*, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
           FROM k JOIN g AS x ON x.lang = k.lang AND x.phrase = p JOIN g AS y ON y.lang = k.lang AND y.phrase = q),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     i AS MATERIALIZED (SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, f AS longer
                        FROM c, range(2, 4) AS q(size), unnest(generate_series(1, m - size + 1)) AS t(i) WHERE size < m),
     o AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN i USING (lang, phrase) WHERE 100 * longer >= 80 * f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n USING (lang) ANTI JOIN o USING (lang, phrase) QUALIFY rank <= 2000"""


@_query("op13_phrases", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_documents(spark, sf_dir))
