import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from tallyspark.llm import chat, html_text, pii

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(s))) % 10 == 0
    tests = {
        "email": (EMAIL, lambda s: True),
        "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (CARD, lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (PHONE, lambda s: 8 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in r.finditer(text) if ok(m[0])] for k, (r, ok) in tests.items()}


def test_pii_base_equals_regex():
    rng, anchors = random.Random(1), pii.automaton()
    pieces = ["a@b.co", "@", "+1 (017) 555-7713", "+", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", ".", " ", "-", "x", "é", "12", "(", "a@b@c.d", "1.2.3.4.5.6.7.8", "4417744280351547", "\n", "a.b", "00000001.2.3.4", "+49 30-12345678 ", "漢"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        found = pii.find_spans(text, anchors)
        assert {k: found.get(k, []) for k in pii.BASE_KINDS} == brute_pii(text), text


def test_pii_added_kinds_and_mask():
    anchors = pii.automaton()
    text = 'see https://bob:pw@host.example/x token = "908038b7daaf91e730d2f64001c52934d43d9336" IBAN: DE89 3704 0044 0532 0130 00 ok'
    found = pii.find_spans(text, anchors)
    assert [text[s:e] for s, e in found["url"]] == ["https://bob:pw@host.example/x"]
    assert [text[s:e] for s, e in found["secret"]] == ["908038b7daaf91e730d2f64001c52934d43d9336"]
    assert [text[s:e] for s, e in found["account"]] == ["DE89 3704 0044 0532 0130 00"]
    assert pii.mask("a b@c.de f", [("email", 2, 8)]) == "a <email> f"


def test_pii_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a@b.co", None)], "doc_id long, text string, spans string")
    rows = pii.scan(docs).collect()
    assert [len(r.spans) for r in rows] == [0, 0, 0, 1]
    assert pii.scan(docs.limit(0)).count() == 0


def brute_turns(turns):
    h = hashlib.sha256()
    for role, text in turns:
        h.update(f"{role or ''}\n{text or ''}\n".encode())
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng, rows, want = random.Random(2), [], {}
    pieces = ["<|im_end|>", "<|", "<\\|", "<\\\\|im_start|>", "\n", "a", "é", "\\", "<", "|", "%3C", "$1"]
    for c in range(60):
        turns = []
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "to%3Col\n<x", None])
            text = None if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
            turns.append((role, text))
            rows.append((c, t, role, text, "clash"))
        want[c] = brute_turns(turns)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target string").repartition(5)
    examples = chat.expand(df)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(examples).collect()}
    assert got == want
    # every control string in the output is the template's own
    n = df.groupBy("conv_id").count().collect()
    whole = {r.conv_id: r.w for r in examples.groupBy("conv_id").agg(F.max_by("formatted", "target").alias("w")).collect()}
    assert all(whole[r.conv_id].count("<|im_start|>") == r["count"] == whole[r.conv_id].count("<|im_end|>") for r in n)
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


def test_chat_query_equals_sql(spark):
    from tallyspark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = {r[0]: r[1:5] for r in con.execute(ORACLES["op8_chat_formatting"]).fetchall()}
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op8_chat_formatting"](spark, SF).collect()}
    assert got == want and -1 in got


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy &amp; win</div><aside class="sidebar"><p>Side</p></aside>
<article><h1>Head &amp; tail</h1><p><b>First  para.<br><p>Second
 line &eacute;.</p><p>S.</p><form><input value=x>Sign up</form><ul><li>One<li>Two</ul><div id="comments"><p>nice post</p></div></article>
<footer>&copy; x</footer>"""


def test_html_article():
    assert html_text.extract(PAGE) == "Head & tail\nFirst para.\nSecond line é.\nS.\nOne\nTwo"


def test_html_without_article():
    body = "<div><p>" + "Long text of the page goes here, word after word. " * 5 + "</p><p>" + "More of it follows in this second part. " * 6 + "</p></div>"
    page = f"<body><div class=menu><a>x</a></div>{body}<div class='footer'>f</div></body>"
    assert html_text.extract(page).split("\n")[0].startswith("Long text") and len(html_text.extract(page).split("\n")) == 2


def test_html_all_content_regions():
    def text(word, n=8):
        return " ".join(f"The {word} part of this page has words that go on for a while." for _ in range(n))

    beside = f"<body><div>{text('body', 30)}</div><article>Short teaser.</article></body>"
    assert text("body", 30) in html_text.extract(beside).split("\n")
    siblings = "".join(f"<article><h2>Head {w}</h2><p>{text(w, n)}</p><p>Ok.</p></article>" for w, n in (("first", 4), ("second", 9), ("third", 6)))
    want = [x for w, n in (("first", 4), ("second", 9), ("third", 6)) for x in (f"Head {w}", text(w, n), "Ok.")]
    assert html_text.extract(f"<body><div class=menu>m</div>{siblings}</body>").split("\n") == want
    direct = f"<main><p>{text('direct', 3)}</p><article><p>{text('nested', 12)}</p></article><p>{text('last', 3)}</p></main>"
    assert html_text.extract(direct).split("\n") == [text("direct", 3), text("nested", 12), text("last", 3)]
    # links by a region, and comments of less weight, are no content; short lines between content lines are
    links = "<div><a href=a>Home</a></div><div><a href=b>News</a></div>"
    page = f"<body>{links}<div><p>{text('a')}</p><p>Ok.</p><p>No.</p><p>So.</p><p>Yes.</p><p>Go.</p><p>{text('b')}</p></div><article class=comment>{text('c', 3)}</article>{links}</body>"
    assert html_text.extract(page).split("\n") == [text("a"), "Ok.", "No.", "So.", "Yes.", "Go.", text("b")]


def test_html_names_within_the_article():
    long = "This part of the article has words that go on for quite a while. " * 6
    parts = f'<section id="discussion"><h3>Discussion</h3><p>{long}a</p></section><h2 id="related-work">Related work</h2><p class="legal-basis">{long}b</p><p class="legal">{long}c</p>'
    boxes = '<div class="share-buttons"><a href=x>Mail</a> <a href=y>Post</a></div><div class="comments"><p>' + long + "d</p></div>"
    want = ["Discussion", long + "a", "Related work", long + "b", long + "c"]
    assert html_text.extract(f"<body><article>{parts}{boxes}</article><p id=legal>{long}e</p></body>").split("\n") == want


def test_html_ratios_decide():
    long = [f"Part {w} of the text has words that go on for quite a while. " * 5 + w for w in "abcd"]
    # an advert without an end tag takes its own short lines only, wherever the article ends
    for end in ("</article>", "", "</article></body></html>"):
        page = f'<body><article><h1>Head</h1><p>{long[0]}</p><div class="ad">Buy<br>now<p>{long[1]}</p><p>{long[2]}</p>{end}'
        assert html_text.extract(page).split("\n") == ["Head", long[0], long[1], long[2]]
    # one with an end tag goes whole, however long
    assert html_text.extract(f'<article><p>{long[0]}</p><div class="ad"><p>{long[1]}</p></div><p>{long[2]}</p></article>').split("\n") == [long[0], long[2]]
    # menus of plain items go before and after the text; a list within it stays, in an article anywhere
    menu = "<ul><li>News<li>Sports<li>Terms</ul>"
    text = f"<div><p>{long[0]}</p><p>{long[1]}</p><ul><li>One<li>Two</ul><p>{long[2]}</p></div>"
    want = [long[0], long[1], "One", "Two", long[2]]
    assert html_text.extract(f"<body>{menu}{text}{menu}</body>").split("\n") == want
    assert html_text.extract(f"<body>{menu}<article>{text}{menu}</article>{menu}</body>").split("\n") == [*want, "News", "Sports", "Terms"]
    # without ratios a page of short items only is all content
    assert html_text.extract(menu).split("\n") == ["News", "Sports", "Terms"]


def test_html_edges(spark):
    assert [html_text.extract(x) for x in (None, "", "<nav>a</nav>", "plain", "<p>a<p>b", "<")] == ["", "", "", "plain", "a\nb", "<"]
    assert html_text.extract("<article>" + "<div>" * 3000 + "x" + "</div>" * 3000 + "</article>") == "x"
    pages = spark.createDataFrame([(1, "u", None, "c"), (1, "u", None, "c"), (None, None, "<p>a</p>", "c")], "page_id long, url string, html string, text string")
    assert [r.text for r in html_text.extract_pages(pages).collect()] == ["", "", "a"]
    assert html_text.extract_pages(pages.limit(0)).count() == 0
