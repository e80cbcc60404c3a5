"""Markup that hides, and markup that keeps a search busy. Results are judged by another reader."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from leafmill.operators.convert import html_to_markdown, html_to_text
from leafmill.operators.extract import page_links
from leafmill.operators.hygiene import page_findings, scan_metadata, strip_active_content, strip_metadata
from leafmill.operators.profile import page_profile
from leafmill.operators.quality import repair_pages, structure_check

SITE = "http://s.example.com"
OPERATORS = {
    "text": html_to_text, "markdown": html_to_markdown, "links": page_links, "findings": page_findings,
    "strip": strip_active_content, "metadata": scan_metadata, "strip metadata": strip_metadata,
    "profile": page_profile, "structure": structure_check, "repair": repair_pages,
}
HOSTILE = ["<", "<a ", "<meta ", "<title>", "<!--", "<script ", "<a href=\"", "<b x='", "</", "= ", "<h1 ", "<a></a"]


class Reader(HTMLParser):
    """Active parts of a page as the standard library reads it."""

    def __init__(self, html: str):
        super().__init__()
        self.active: list[str] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "iframe", "frame", "object", "embed", "applet", "form"):
            self.active.append(tag)
        for name, value in attrs:
            if value is not None and (name.startswith("on") or name in ("formaction", "xlink:href") or (name == "href" and tag in ("a", "area", "base"))):
                self.active.append(name)


QUOTED = {
    1: '<img alt=">" src=x onerror=alert(1)>',
    2: '<a title="a>b" href="javascript:alert(1)">t</a>',
    3: '<a title="see href=foo" href="/real">r</a>',
    4: '<area href="javascript:x()"><button formaction=/go>b</button><svg><a xlink:href="/y">z</a></svg>',
    5: '<base href="http://evil.example/"><frame src=f><applet code=c></applet>',
    6: "<p title='> onclick=no'>quiet</p>",
    7: '<a href="mailto:a@b.example">m</a>',
    8: "<p a=\"1\"onclick='x'b=2>near</p>",
}


def web(spark, htmls):
    return spark.createDataFrame([(i, f"{SITE}/{i}", h) for i, h in htmls.items()], "page_id bigint, url string, html string")


@pytest.mark.parametrize("name", OPERATORS)
def test_hostile_pages_end_in_seconds(spark, name):
    pages = web(spark, {i: piece * (1_000_000 // len(piece)) for i, piece in enumerate(HOSTILE)})
    start = time.perf_counter()
    OPERATORS[name](pages).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - start < 90


def test_values_in_quotes(spark):
    pages = web(spark, QUOTED)
    found = {(r.page_id, r.category) for r in page_findings(pages).collect()}
    assert {p for p, _ in found} == {1, 2, 3, 4, 5, 7, 8}
    assert {(1, "page_actions"), (2, "annot_actions"), (5, "embedded_files"), (8, "page_actions")} <= found
    links = {(r.page_id, r.href) for r in page_links(pages, ("external", "internal", "script", "mail")).collect()}
    assert links == {(2, "javascript:alert(1)"), (3, "/real"), (7, "mailto:a@b.example")}
    assert [r.kind for r in page_links(pages).collect()] == ["mail"]
    for r in strip_active_content(pages).collect():
        assert Reader(r.html).active == [], r
        assert r.changed == bool(Reader(QUOTED[r.page_id]).active), r
    text = {r.page_id: r.text for r in html_to_text(pages).collect()}
    assert text[1] == "" and text[2] == "t" and text[6] == "quiet\n" and text[8] == "near\n"
    kept = {r.page_id: r.html for r in strip_active_content(pages).collect()}
    assert 'title="see href=foo"' in kept[3] and 'title="a>b"' in kept[2]
