"""Registered queries of the operators on whole corpora: source audit, vector codes, repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knockon.llm import divergence, passages, veccode


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccode.compress(_table(spark, sf_dir, "embeddings")).drop("label").withColumnRenamed("id", "vec_id")


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return found.drop("cuts").withColumnRenamed("id", "doc_id")


QUERIES = {
    "op11_source_divergence": op11_source_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_repeated_passages": op13_repeated_passages,
}


def _code_rounds(rounds: int = veccode.ROUNDS) -> str:
    """CTEs of the rounds: a<i> assigns the parts to the entries c<i>, c<i+1> are the floor means."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""
        a{i} AS MATERIALIZED (
            SELECT r, part, min(far) AS far, arg_min(entry, far * 256 + entry) AS entry
            FROM (SELECT x.r AS r, x.part AS part, c.entry AS entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS far
                  FROM x JOIN c{i} c USING (part, pos) GROUP BY ALL)
            GROUP BY ALL)""")
        if i < rounds:
            out.append(f"""
        m{i} AS (SELECT part, entry, pos, sum(v) AS total, count(*) AS n
                 FROM x JOIN a{i} USING (r, part) GROUP BY ALL),
        c{i + 1} AS MATERIALIZED (
            SELECT part, entry, pos, coalesce(CAST((total - (((total % n) + n) % n)) // n AS BIGINT), v) AS v
            FROM c{i} LEFT JOIN m{i} USING (part, entry, pos))""")
    return ",".join(out)


_SQL_LOWER = ("translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              "'abcdefghijklmnopqrstuvwxyz')")
_TERMS = "regexp_extract_all({}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op11_source_divergence": f"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          {_TERMS.format(_SQL_LOWER.format('text'))} AS w FROM documents),
        tf AS (SELECT doc_id, lang, source, term, count(*)::HUGEINT AS n
               FROM (SELECT doc_id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
        kept AS MATERIALIZED (SELECT lang, term FROM tf GROUP BY ALL HAVING count(*) >= 10),
        v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY ALL),
        c AS MATERIALIZED (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM tf JOIN kept USING (lang, term) GROUP BY ALL),
        g AS MATERIALIZED (
            SELECT g.lang AS lang, g.source AS source, coalesce(sum(c.n), 0)::HUGEINT AS size
            FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS MATERIALIZED (
            SELECT g.lang AS lang, g.source AS source, kept.term AS term, coalesce(c.n, 0) AS n,
                   1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.size + 2 * v.v) AS p
            FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
        l AS (SELECT lang, sum(size)::HUGEINT AS size FROM g GROUP BY ALL),
        q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c.n)::HUGEINT + 2) // (any_value(l.size) + 2 * any_value(v.v)) AS q
              FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY ALL),
        pairs AS (
            SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang AS lang, x.source AS source, y.source AS item,
                              sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                       FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
                       GROUP BY ALL) f
            ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
                  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
                   FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
        WHERE part = 'pair' OR rank <= 10""",
    "op12_vector_codes": f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS r
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        dim AS (SELECT len(embedding) // 4 AS size FROM kept WHERE r = 1),
        x AS MATERIALIZED (
            SELECT r, spot // size AS part, spot % size AS pos, v
            FROM (SELECT r, generate_subscripts(embedding, 1) - 1 AS spot, floor(1024 * unnest(embedding))::BIGINT AS v
                  FROM kept), dim),
        c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, v FROM x WHERE r <= 256),
        {_code_rounds()},
        codes AS (SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code,
                         sum(far)::BIGINT AS error FROM a4 GROUP BY r)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c4) AS codebooks_sha256
        FROM kept JOIN codes USING (r)""",
    "op13_repeated_passages": """
        WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS MATERIALIZED (SELECT doc_id, spot, substr(h, 2 * spot + 1, 100) AS s
              FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS spot FROM d WHERE length(h) >= 100)),
        f AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT doc_id, spot FROM s JOIN f USING (s) WHERE doc_id > least),
        marked AS (SELECT doc_id, spot, CASE WHEN spot <= lag(spot) OVER w + 50 THEN 0 ELSE 1 END AS fresh
                   FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY spot)),
        spans AS (SELECT doc_id, min(spot) AS a, max(spot) + 50 AS b
                  FROM (SELECT doc_id, spot, sum(fresh) OVER (PARTITION BY doc_id ORDER BY spot) AS run FROM marked)
                  GROUP BY doc_id, run),
        sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id),
        pieces AS (
            SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
            UNION ALL SELECT d.doc_id, coalesce(max(spans.b), 0), length(any_value(h)) // 2
            FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id),
        left_ AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h
                  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id AS doc_id, length(d.h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
               coalesce(n, 0) AS n_spans, sha256(unhex(left_.h)) AS kept_sha256
        FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN left_ USING (doc_id)""",
}
