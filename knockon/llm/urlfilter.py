"""URL filtering by pattern rules that are indexed by their rarest literal token.

Native DataFrame code.  Rules and URLs are cut into tokens (runs of letters,
digits and hyphens, lower-cased).  Token counts over all URLs choose each rule's
rarest literal token, and a join of URL tokens with that index gives the
candidate rules; only those run their regular expression.  Every distinct URL is
judged once; copies of a URL share its verdict.

Site rules (a host with its subdomains, and a path prefix) are pattern rules
too; of the rules that fit, the longest decides, block before allow on a tie,
then by name.  Other patterns decide only where no site rule fits.

Defined results: a null url, or one without ``://``, has empty host and path
and no rule; a URL with an empty host and a path meets no rule unless ``hostless``
is set, which lets patterns see its path; rules without a literal token are tried
on every URL; an empty rule
list gives every URL the default verdict; repeated rows get a row each; extra
columns are not read by ``judge``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knockon.llm.common import ascii_lower, shared_table

_SEPARATORS = "[^a-z0-9-]+"
#: Rules whose index is broadcast; parts of a token in the join of larger indexes; rules that may lack a literal.
BROADCAST_RULES, SALTS, ALWAYS_RULES = 20_000, 64, 200


@dataclass(frozen=True)
class Rule:
    """``regex`` (Java) is searched in ``host + path``; ``literals`` are tokens that every match holds whole."""

    name: str
    verdict: str
    regex: str
    literals: tuple[str, ...]
    site: bool = False


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains, and the paths that start with ``path``.

    The last part of the path may go on in the URL, so only parts that end
    inside the rule are whole tokens.
    """
    whole = [t for t in re.split(_SEPARATORS, host.lower()) if t]
    inner = re.split(r"[^A-Za-z0-9-]+", path)[:-1]
    return Rule(host + path, verdict, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path),
                tuple(whole + [t.lower() for t in inner if t]), True)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(host)


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table: rule, verdict, regex, literals, site."""
    shape = "array<struct<rule:string,verdict:string,regex:string,literals:array<string>,site:boolean>>"
    rows = [F.struct(F.lit(r.name), F.lit(r.verdict), F.lit(r.regex), F.array(*map(F.lit, r.literals)).cast("array<string>"),
                     F.lit(r.site)) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows).cast(shape)))


def _with_index(tokens: DataFrame, index: DataFrame, small: bool) -> DataFrame:
    """``tokens`` joined to ``index`` on token; neither way gathers the URLs of a frequent token in one task."""
    if small:
        return tokens.join(F.broadcast(index), "token")
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return tokens.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(
        salted, ["token", "salt"]).drop("salt")


def rarest_tokens(rules: DataFrame, tokens: DataFrame, small: bool = True) -> DataFrame:
    """``rules`` with ``token``: of each rule's literals the one in fewest URLs, null without literals."""
    wanted = rules.select("rule", "regex", F.explode("literals").alias("token")).distinct()
    counts = _with_index(tokens, wanted.select("token").distinct(), small).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))
    rarest = (wanted.join(counts, "token", "left").groupBy("rule", "regex")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t")))
    return rules.join(rarest, ["rule", "regex"], "left").withColumn("token", F.col("t.token")).drop("t")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, url_col: str = "url", id_col: str = "page_id",
          default: str = "allow", hostless: bool = False) -> DataFrame:
    """One row per input row: id, host, path, rule (site rule or null), pattern (other rule or null), verdict.

    ``rules`` is a list, or a table shaped like ``rules_table``.  Up to
    ``BROADCAST_RULES`` rules the index is broadcast, beyond that it is joined by
    salted tokens.  ``hostless`` judges paths without a host too.
    """
    spark = pages.sparkSession
    rules = rules_table(spark, rules) if isinstance(rules, list) else shared_table(rules, "url-patterns")
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    urls = shared_table(rows.select("host", "path").where("host <> '' or path <> ''" if hostless else "host <> ''").distinct(), "urls")
    tokens = (urls.select("host", "path", F.explode(F.array_distinct(F.split(
        ascii_lower(F.concat("host", "path")), _SEPARATORS))).alias("token")).where("token <> ''"))
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    indexed = shared_table(rarest_tokens(rules, tokens, small).drop("literals"), "url-rules")
    kept = ["host", "path", "rule", "verdict", "regex", "site"]
    candidates = _with_index(tokens, indexed.where("token is not null"), small).select(*kept)
    # rules without a literal meet every URL: a stated set, bounded, in one row of lists
    always = indexed.where("token is null").select("rule", "verdict", "regex", "site").limit(ALWAYS_RULES + 1).collect()
    if len(always) > ALWAYS_RULES:
        raise ValueError(f"more than {ALWAYS_RULES} rules have no literal token")
    if always:
        each = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in kept[2:]]) for r in sorted(always)])
        candidates = candidates.unionByName(urls.select("host", "path", F.inline(each)).select(*kept))
    fits = candidates.where(F.regexp_like(F.concat("host", "path"), F.col("regex")))
    order = F.struct((-F.length("rule")).alias("length"), (F.col("verdict") != "block").alias("allows"),
                     F.col("rule"), F.col("verdict"))
    decided = fits.groupBy("host", "path").agg(F.min(F.when(F.col("site"), order)).alias("own"),
                                               F.min(F.when(~F.col("site"), order)).alias("other"))
    return rows.join(decided, ["host", "path"], "left").select(
        "id", "host", "path", F.col("own.rule").alias("rule"), F.col("other.rule").alias("pattern"),
        F.coalesce("own.verdict", "other.verdict", F.lit(default)).alias("verdict"))
