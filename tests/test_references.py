"""Character references: equal to the standard library's reading, and seen through by every operator."""

import html
import random
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import functions as F

from leafmill.functions.references import decode
from leafmill.operators.convert import html_to_markdown, html_to_text
from leafmill.operators.extract import page_links
from leafmill.operators.hygiene import page_findings, scan_metadata, strip_active_content
from leafmill.operators.profile import page_profile

ODD = [
    "", "&", "&&", "&;", "&#;", "&#x;", "&#xg", "&amp;amp;", "&ampamp", "&notit;", "&notin;", "a&b;c", "&#38;#38;", "&#0000000000000065;",
    "&#99999999999999999999;", "&#xFFFFFFFFFFFF;", "&AMP", "&é;", "&#65&#66", "&#x110000;", "&#xD800;", "&#xFFFE;", "&#x1FFFF;", "&#xFDD0;",
    "x &lt y", "&nbsp", "&NotEqualTilde;", "&#13;&#10;", "&quot;&apos;", "&#x1F600;",
]


def test_as_the_standard_library_reads_them(spark):
    rng = random.Random(1)
    texts = ODD + ["&" + n for n in html5] + ["&" + n + "x" for n in html5]
    texts += [f"&#{i};" for i in range(300)] + [f"&#x{i:X}" for i in range(0x2FF0, 0x3010)]
    texts += ["".join(rng.choice(["&", "#", "x", "amp", "lt;", "not", "1", "6", ";", " ", "a", "é", "\n"]) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    for r in df.select("t", decode(F.col("t")).alias("d")).collect():
        assert r.d == html.unescape(r.t), r.t
    assert spark.createDataFrame([(None,)], "t string").select(decode(F.col("t"))).first()[0] is None


HIDDEN = {
    1: '<meta http-equiv="refr&#101;sh" content="0;&#117;rl=//e.x">',
    2: '<a href="j&#97;vascript:x()">a</a><a href="&#x6A;avascript&colon;y()">b</a>',
    3: '<a href="java&Tab;script:z()">c</a><a href="&#104;ttp://o.example/">d</a>',
    4: '<meta http-equiv="&#114;efresh&#10;" content="5"><script src="&sol;s.js"></script>',
    5: '<p title="&quot; onclick=&quot;x()">quiet</p><!-- kept --><style>b{}</style>',
    6: '<iframe src="&#47;f"></iframe><form action="&#x2F;g">',
}


class Reader(HTMLParser):
    """Refreshes and targets of a page with everything decoded."""

    def __init__(self, page):
        super().__init__()
        self.found = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        values = dict(reversed(attrs))
        if tag == "meta" and (values.get("http-equiv") or "").strip().lower() == "refresh":
            self.found.append("refresh")
        if tag in ("script", "iframe", "form") or any(n.startswith("on") or n == "href" for n, _ in attrs):
            self.found.append(tag)


def web(spark, pages):
    return spark.createDataFrame([(i, f"http://s.example/{i}", p) for i, p in pages.items()], "page_id bigint, url string, html string")


def test_nothing_active_hides_behind_references(spark):
    pages = web(spark, HIDDEN)
    found = {(r.page_id, r.category): r["items"] for r in page_findings(pages).collect()}
    assert found == {
        (1, "open_action"): ["URI"], (2, "annot_actions"): ["JavaScript", "JavaScript"], (3, "annot_actions"): ["JavaScript", "URI"],
        (4, "open_action"): ["Destination (non-action)"], (4, "javascript"): ["/s.js"], (6, "embedded_files"): ["/f"], (6, "xfa"): ["form"],
    }
    clean = {r.page_id: r for r in strip_active_content(pages).collect()}
    for i, page in HIDDEN.items():
        assert bool(Reader(page).found) == clean[i].changed and Reader(clean[i].html).found == []
    assert clean[5].html == HIDDEN[5]
    links = {(r.page_id, r.ord): r for r in page_links(pages, ("script", "external", "internal")).collect()}
    assert [links[k].kind for k in ((2, 1), (2, 2), (3, 2))] == ["script", "script", "external"]
    assert links[(3, 2)].uri == "http://o.example/"


def test_what_stays_of_a_changed_page_stays_as_it_is(spark):
    page = "<p>a</p><!-- kept --><style>b{}</style><script>x</script>z"
    assert strip_active_content(web(spark, {1: page})).first().html == "<p>a</p><!-- kept --><style>b{}</style> z"


def test_decoded_in_text_titles_and_metadata(spark):
    page = '<title>It&rsquo;s &#8220;so&#8221;</title><meta name="author" content="Bj&ouml;rn &amp;amp; co"><p>1 &ne; 2 &hellip;</p>'
    pages = web(spark, {1: page})
    assert "It’s “so”" in html_to_text(pages).first().text and "1 ≠ 2 …" in html_to_text(pages).first().text
    assert "1 ≠ 2 …" in html_to_markdown(pages).first().markdown
    assert page_profile(pages).first().title == "It’s “so”"
    assert {r.field: r.value for r in scan_metadata(pages).collect()} == {"Title": "It’s “so”", "Author": "Björn &amp; co"}
