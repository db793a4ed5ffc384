import pytest

from knockon.llm import htmltext
from tests.llm.helpers import CLASHING

CASES = [
    (None, ""), ("", ""), ("plain & simple", "plain & simple"), ("a < b and c > d", "a < b and c > d"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<html><head><title>T</title><style>p{}</style></head><body><p>x</p></body></html>", "x"),
    ("<title>T</title>shown", "shown"),
    ("<p>a <b>bold</b>  and\n<i>it</i>", "a bold and it"),
    ("<script>var t='</p>';</script><p>x", "x"),
    ("<script>never closed <p>x", ""),
    ("<!-- c --><p>x<!-- unclosed", "x"),
    ("<p hidden>no</p><p style='display: none'>no</p><p style='color:red'>yes</p>", "yes"),
    ("<div hidden><p>no</p><ul><li>no</ul></div><p>yes", "yes"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<ul><li>a<ol><li>x<li>y</ol></ul>", "- a\n  1. x\n  2. y"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<p>a</p><hr><p>b</p>", "a\n\nb"),
    ("<pre>  keep\n   this  </pre>after", "  keep\n   this  \n\nafter"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>",
     "Name      | N\nlong name | 1\nx         | 22"),
    ("<p>t</p><table><caption>C</caption><tr><td>a</td></tr></table><p>u</p>", "t\n\nC\na\n\nu"),
    ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb |"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in | ner | out"),
    ("<h1>H</h1>text<h2>I</h2>", "H\n\ntext\n\nI"),
    ("&copy; &lt;b&gt; &#65; &unknown; &amp;amp;", "© <b> A &unknown; &amp;"),
    ("<img alt='pic'> <img src=x><input type=submit value=Go>", "[pic] Go"),
    ("a</p>b", "a\n\nb"), ("</div></table>x", "x"), ("<b><i>x</b>y</i>z", "xyz"),
    ("<p>x <a href='a>b'>link</a></p>", "x link"),
    ("<select><option>a<option>b</select>c", "c"),
    ("<textarea>no <b>tags</b></textarea>", "no <b>tags</b>"),
    ("<template><p>no</p></template><noscript>no</noscript>yes", "yes"),
    ("<P>UP</P><DIV HIDDEN>no</DIV>", "UP"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_rendering(page, text):
    assert htmltext.render(page) == text


def test_deep_and_long_pages():
    assert htmltext.render("<div>" * 20_000 + "x") == "x"
    assert htmltext.render("<p>" + "word " * 200_000).count("word") == 200_000
    assert htmltext.render("<" * 5000) == "<" * 5000


def test_every_visible_word_survives(spark):
    """On the pages table: words outside tags, head, script, style and comments, in order, and no others."""
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    cut = re.compile(r"(?s)<!--.*?-->|<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>")
    for r in pages:
        want = html.unescape(re.sub(r"<[^>]+>", "  ", cut.sub(" ", r.html))).split()
        got = htmltext.render(r.html).split()
        assert [w for w in got if w != "-"] == want, r.page_id


def test_extract_handles_edges(spark):
    from pyspark.sql import functions as F
    rows = [(1, p) for p, _ in CASES] + [(None, "<p>x"), (1, "<p>one<p>two")]
    table = spark.createDataFrame(rows, "page_id long, html string").withColumns(
        {c: F.lit("x") for c in CLASHING + ("n_chars", "n_lines")})
    got = htmltext.extract(table).collect()
    assert sorted(r.text for r in got) == sorted([t for _, t in CASES] + ["x", "one\n\ntwo"])
    assert all(r.n_chars == len(r.text) and r.n_lines == len(r.text.split("\n")) * bool(r.text) for r in got)
    assert htmltext.extract(table.where("page_id = 99")).count() == 0


def test_markup_is_found_in_linear_time_as_by_the_pattern():
    import random
    import re
    import time
    began = time.perf_counter()
    for page in ("<a " * 300_000 + "'", "<a \"x\" " * 100_000 + "'", "<a" + "\"" * 100_001, "<" * 500_000):
        htmltext.render(page)
    assert time.perf_counter() - began < 8
    token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
                       r"|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
    draw = random.Random(9)
    for _ in range(3000):
        page = "".join(draw.choice(["<", ">", "a", "/", "'", '"', " ", "b=", "<!--", "-->", "<p", "!"])
                       for _ in range(draw.randint(1, 25)))
        tokens, at = htmltext.Tokens(page), 0
        while True:
            want, got = token.search(page, at), tokens.next(at)
            assert (want is None) == (got is None), page
            if not want:
                break
            assert (*want.span(), want[1], want[2], want[3] or "") == got, page
            at = want.end()
