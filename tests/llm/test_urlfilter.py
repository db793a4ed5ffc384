import random
import re

import pytest
from pyspark.sql import functions as F

from knockon.llm import urlfilter
from knockon.llm.queries import SITE_RULES, URL_PATTERNS
from tests.llm.helpers import CLASHING

SITES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def brute(url):
    host, path = parts(url)
    fits = [(h + p, v) for h, p, v in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        rule, verdict = max(fits, key=lambda f: len(f[0]))
        return host, path, rule, verdict
    bad = any(re.search(r.regex.replace("(?s)", ""), host + path) for r in URL_PATTERNS) if host else False
    return host, path, None, "block" if bad else "allow"


def table(spark, urls):
    rows = [(i % 50 if i % 7 else None, u) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in CLASHING + (
        "host", "path", "verdict", "regex", "pattern")})


def urls():
    draw = random.Random(4)
    hosts = ["a.com", "COM", "example.com", "www.Example.com", "x.www.example.com", "notexample.com", "example.net",
             "net", "spam-farm.org", "b.spam-farm.example.org", "myspam-farm.org", "cheap-pills.net", "casino.org",
             "online-casino7.org", "a.org", "", "user@a.com", "a.com:80", "Кириллица.com"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/en/x?y=/es/", "/es/1", "/fr/#t", "/es", "?q=/en/", "#/en/", "/xxx/", "/porn",
             "/a/xxx", "/xxxy", "/en//x", "/a\nb"]
    out = [f"{draw.choice(['http', 'https', ''])}://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(600)]
    return out + [None, "", "no scheme", "mailto:a@b.c", "http://a.org/r?u=http://b.com/", "x" * 50_000,
                  "http://a.org/" + "y" * 50_000] + ["http://hot.example.com/en/1"] * 300


def test_matches_brute_force(spark):
    got = urlfilter.judge(table(spark, urls()), SITE_RULES + URL_PATTERNS)
    rows = sorted(((r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=repr)
    assert rows == sorted((brute(u) for u in urls()), key=repr)


def test_a_large_index_is_joined_by_salted_tokens(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 3)
    rules = urlfilter.rules_table(spark, SITE_RULES + URL_PATTERNS)
    got = urlfilter.judge(table(spark, urls()), rules)
    rows = sorted(((r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=repr)
    assert rows == sorted((brute(u) for u in urls()), key=repr)
    monkeypatch.setattr(urlfilter, "ALWAYS_RULES", 1)
    with pytest.raises(ValueError):
        urlfilter.judge(table(spark, urls()), rules)


def test_only_candidates_are_tried_and_the_rarest_token_leads(spark):
    tokens = spark.createDataFrame([("h1", "com"), ("h2", "com"), ("h3", "com"), ("h1", "example")], "host string, token string")
    rules = urlfilter.rules_table(spark, SITE_RULES + URL_PATTERNS)
    lead = {r.rule: r.token for r in urlfilter.rarest_tokens(rules, tokens).collect()}
    assert lead["com/"] == "com" and lead["www.example.com/en/"] in ("www", "en")
    assert lead["spam-farm host"] == "spam-farm" and lead["adult path"] is None


def test_ties_defaults_and_empty_tables(spark):
    two = [urlfilter.site_rule("a.org", "/x/", "allow"), urlfilter.site_rule("a.org", "/x/", "block")]
    pages = table(spark, ["http://a.org/x/1", "http://b.org/"])
    assert sorted(r.verdict for r in urlfilter.judge(pages, two).collect()) == ["allow", "block"]
    assert {r.verdict for r in urlfilter.judge(pages, [], default="block").collect()} == {"block"}
    assert urlfilter.judge(pages.where("url = ''"), SITE_RULES).count() == 0


def test_query_judges_paths_without_a_host_as_its_sql_does(spark, tmp_path):
    import duckdb

    from knockon.llm import queries

    table(spark, ["file:///xxx/a", "http:///porn/", "file:///tmp/a", "http:///com/", None, "no scheme"]).select(
        F.monotonically_increasing_id().alias("page_id"), "url").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = {r[0]: r[-1] for r in db.execute(queries.ORACLES["op8_url_filter"]).fetchall()}
    got = {r.page_id: r.verdict for r in queries.op8_url_filter(spark, str(tmp_path)).collect()}
    assert got == want and sorted(got.values()) == ["allow"] * 4 + ["block"] * 2
