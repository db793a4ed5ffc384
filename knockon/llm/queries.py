"""The training-data operators as registered queries, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knockon.llm import (corpus_queries, decontam, exact_dedup, htmltext, langid, mixing, pii, simhash, toxicity,
                         urlfilter, warc)

SHINGLE_WORDS = 3
SIMHASH_DISTANCE = 2

#: The mix: target entropy, half way from the natural to the largest, and most passes over a source.
MIX_FLATTEN = 0.5
MIX_REPEATS = 1.1

#: Site rules: host with its subdomains, start of the path, verdict.
SITE_RULES = [
    urlfilter.site_rule("com", "/", "allow"),
    urlfilter.site_rule("example.com", "/en/", "block"),
    urlfilter.site_rule("www.example.com", "/en/", "allow"),
    urlfilter.site_rule("net", "/es/", "block"),
    urlfilter.site_rule("net", "/fr/", "block"),
]
#: Patterns of link farms and shops; each match holds the literal tokens whole.
URL_PATTERNS = [
    urlfilter.Rule("spam-farm host", "block", r"^(?:[^/]*\.)?spam-farm\.", ("spam-farm",)),
    urlfilter.Rule("cheap-pills host", "block", r"^(?:[^/]*\.)?cheap-pills\.", ("cheap-pills",)),
    urlfilter.Rule("casino host", "block", r"^(?:[^/]*[.-])?(?:online-)?casino[a-z0-9-]*\.", ()),
    urlfilter.Rule("adult path", "block", r"/(?:xxx|porn)(?:/|$)", ()),
]

_SQL_LOWER = ("translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              "'abcdefghijklmnopqrstuvwxyz')")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), prefer="max")
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"),
                                 shingle=SHINGLE_WORDS, distance=SIMHASH_DISTANCE)
    return groups.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"), flatten=MIX_FLATTEN, repeats=MIX_REPEATS)
    return mixing.schedule(planned).drop("row").withColumnRenamed("id", "doc_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.with_hits(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                               _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h.item)))
    out = found.select("doc_id", F.col("__n_words").alias("n_words"),
                       decontam.hit_words(F.col("__hits")).alias("n_hit"),
                       F.size(items).cast("long").alias("n_items"),
                       F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", decontam.is_contaminated(F.col("n_hit"), F.col("n_words")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts,
                        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(_table(spark, sf_dir, "pages"), SITE_RULES + URL_PATTERNS, hostless=True)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def damaged(record, data):
    """What a damaged replica holds: some records lost, in some the middle byte changed."""
    at = F.floor(F.octet_length(data) / 2).cast("int")
    changed = F.concat(F.substring(data, F.lit(1), at),
                       F.when(F.substring(data, at + 1, F.lit(1)) == F.lit(b"#"), F.lit(b"+")).otherwise(F.lit(b"#")),
                       F.substring(data, at + 2, F.octet_length(data)))
    return F.when(record % 101 == 7, F.lit(None)).when(record % 97 == 5, changed).otherwise(data)


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records, audited against a replica with damage planted by page_id."""
    pages = _table(spark, sf_dir, "pages")
    found = warc.audit(*warc.replicas(pages, [None, damaged]))
    return found.select(F.col("record").cast("long").alias("page_id"), "status",
                        F.col("length_a").alias("length"), F.col("digest_a").alias("record_sha256"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_temperature_mixing": op4_temperature_mixing,
    "op5_html_extraction": op5_html_extraction,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_pii": op7_pii,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_warc_fixity": op10_warc_fixity,
    **corpus_queries.QUERIES,
}

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLES = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_SQL_LOWER.format('text')} AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d""",
    "op6_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(_SQL_LOWER.format('text'))} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_SQL_LOWER.format('text'))} AS w
              FROM benchmark),
        bw AS (SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[pos:pos + 12], ' ') AS words
               FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS pos
                     FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM bw),
        dw AS (SELECT doc_id, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS words
               FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos
                     FROM d, sizes WHERE len(w) >= size)),
        hit AS (SELECT doc_id, pos, dw.size AS size, item FROM dw JOIN bw USING (size, words)),
        spots AS (SELECT doc_id, count(DISTINCT spot) AS n
                  FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS spot FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
                  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(spots.n, 0) AS n_hit,
               coalesce(items.n, 0) AS n_items, sha256(coalesce(items.names, '')) AS items_sha256,
               coalesce(spots.n, 0) > 0 AND 20 * coalesce(spots.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_url_filter": rf"""
        WITH u AS (
            SELECT page_id, {_SQL_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        r(rule, host, path, verdict) AS (VALUES
            ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
            ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
            ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        best AS (
            SELECT u.host AS host, u.path AS path, arg_max(rule, length(rule)) AS rule,
                   arg_max(verdict, length(rule)) AS verdict
            FROM (SELECT DISTINCT host, path FROM u) u
            JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
            GROUP BY ALL)
        SELECT page_id, u.host AS host, u.path AS path, best.rule AS rule,
               coalesce(best.verdict, CASE WHEN
                   regexp_matches(u.host || u.path, '^([^/]*\.)?(spam-farm|cheap-pills)\.')
                   OR regexp_matches(u.host || u.path, '^([^/]*[.-])?(online-)?casino[a-z0-9-]*\.')
                   OR regexp_matches(u.host || u.path, '/(xxx|porn)(/|$)')
                   THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path""",
    "op10_warc_fixity": """
        WITH p AS (
            SELECT page_id, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10),
                'WARC-Record-ID: <urn:record:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', url,
                chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ',
                strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), html,
                chr(13), chr(10), chr(13), chr(10)) AS record
            FROM pages)
        SELECT page_id, CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'changed' END AS status,
               strlen(record)::BIGINT AS length, sha256(record) AS record_sha256
        FROM p WHERE page_id % 101 = 7 OR page_id % 97 = 5""",
    **corpus_queries.ORACLES,
}
