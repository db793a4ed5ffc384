import random
import re

from knockon.llm import pii
from tests.llm.helpers import EDGE_ROWS, docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text, kind):
    out = []
    for m in re.finditer(PATTERNS[kind], text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
            continue
        if kind == "phone" and not 8 <= len(digits) <= 15:
            continue
        if kind == "card":
            double = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if not 16 <= len(digits) <= 19 or sum(double) % 10:
                continue
        out.append(m.span())
    return out


def test_base_detectors_match_their_patterns():
    draw = random.Random(9)
    pieces = ["a", "b@", "@", ".", "x.y", "1", "22", "255", "256", "+", "+1 (555) 555-1234", " ", "-", "é", "@c.d",
              "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "000255", "%", "_", "a@b.c"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 12)))
        for kind, find in pii.DETECTORS.items():
            assert find(text) == brute(text, kind), (kind, text)


def added(text):
    return [(k, text[a:b]) for k, v in pii.added_spans(text, pii.base_spans(text)).items() for a, b in v]


def test_disguises_map_back_to_their_source():
    assert added("mail john.doe [at] example [dot] com now") == [("email", "john.doe [at] example [dot] com")]
    assert added("mail john at example dot com now") == [("email", "john at example dot com")]
    assert added("jane(at)mail.example.org") == [("email", "jane(at)mail.example.org")]
    assert added("call plus one five five five one two three four five six seven!") == [
        ("phone", "plus one five five five one two three four five six seven")]
    assert added("from 192[.]168[.]1[.]5 on") == [("ip", "192[.]168[.]1[.]5")]
    assert added("10 dot 0 dot 0 dot 1") == [("ip", "10 dot 0 dot 0 dot 1")]
    assert added("＋１ （５５５） ５５５－１２３４") == [("phone", "＋１ （５５５） ５５５－１２３４")]
    assert added("jоhn@exаmple.com") == [("email", "jоhn@exаmple.com")]
    assert added("cuatro " + "uno " * 15) == [("card", "cuatro " + "uno " * 14 + "uno")]
    assert added("a​b@c​.de") == [("email", "a​b@c​.de")]


def test_plain_prose_gains_nothing():
    for text in ("look at this point we made", "meet me at example.com", "one two three", "she is at home dot",
                 "nine of ten, one or two", "a (at) b", "Punkt eins zwei", "été à la maison", "α and β"):
        assert added(text) == [], text


def test_base_spans_stay(spark):
    texts = ["write a@b.co or c [at] d [dot] com", None, "", "a@b.co" * 3, "x" * 200_000 + " a@b.co"]
    rows = EDGE_ROWS + [(50 + i, t) for i, t in enumerate(texts)]
    got = pii.find(docs(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    first = next(r for r in got if r.id == 50)
    assert [texts[0][s.start:s.end] for s in first.spans] == ["a@b.co", "c [at] d [dot] com"]
    masked = {r.doc_id: r.text for r in pii.mask(docs(spark, rows, clash=True)).collect()}
    assert masked[50] == "write <email> or <email>" and masked[51] is None and masked[52] == ""
    assert pii.find(docs(spark, [])).count() == 0


def test_long_runs_take_linear_time():
    import time
    began = time.perf_counter()
    assert pii.ips("1" * 1_000_000) == []
    blanks = " " * 1_000_000
    assert pii.deobfuscated("x" + blanks + "a [at] b [dot] com").text.endswith("a@b.com")
    assert pii.deobfuscated("a" + blanks + "[at]" + blanks + "b.de").text == "a@b.de"
    assert pii.cards("1 " * 300_000) == [] and pii.phones("+1" + "(" * 500_000) == []
    assert time.perf_counter() - began < 8


def test_rows_of_numbers_match_the_pattern():
    import random
    import re
    draw = random.Random(4)
    whole = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(300):
        text = "".join(draw.choice([".", "1", "25", "300", "0007", " ", "..", "a"]) for _ in range(30))
        want = [m.span() for m in whole.finditer(text) if all(int(n) <= 255 for n in m[0].split("."))]
        assert pii.ips(text) == want, text
