import random

import pytest

from leafmill.operators.hygiene import (
    active_content_summary,
    page_findings,
    scan_active_content,
    scan_metadata,
    strip_active_content,
    strip_metadata,
)

SITE = "http://s.example.com"

ACTIVE = {
    1: '<meta http-equiv="refresh" content="5; url=/next"><p>a</p>',
    2: "<body onload='go()' class=x onunknown=y><p>b</p></body>",
    3: '<script>var a = "<form onclick=1>";</script><script src="/s.js"></script>tail',
    4: '<iframe src="/f.html"></iframe><object data="o.swf"></object><embed>',
    5: '<p onclick="x()" ONMOUSEDOWN = "y()" title="keep">c</p>',
    6: '<a href="http://o.example.org">d</a><a id=i href=\'javascript:z()\'>e</a><a href=f.html>f</a>',
    7: "<form action=/go><input></form>",
    8: "<!-- <script>no</script> <form> --><style>a{b:c}</style><p>on fire = hot</p><a name=n>x</a>",
    9: "".join(f'<b onfocus="f{i}()">x</b>' for i in range(12)),
    10: "kept <script>never closed <p>",
    11: '<scr<script></script>ipt>alert(1)</script><a href="1" href="2" x="y" href=3>g</a>',
}


def web(spark, htmls):
    rows = [(i, f"{SITE}/{i}", h) for i, h in htmls.items()]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_findings(spark):
    got = {}
    for r in scan_active_content(web(spark, ACTIVE)).collect():
        got.setdefault(r["page_id"], {}).setdefault(r["category"], {})[r["ord"]] = r["item"]
        assert r["page_no"] == r["page_id"]
    listed = {
        p: {c: [v for _, v in sorted(items.items())] for c, items in cats.items()} for p, cats in got.items()
    }
    assert listed[1] == {"open_action": ["URI"]}
    assert listed[2] == {"doc_aa": ["load", "unknown"]}
    assert listed[3] == {"javascript": ["inline", "/s.js"]}
    assert listed[4] == {"embedded_files": ["/f.html", "o.swf", "unnamed"]}
    assert listed[5] == {"page_actions": ["click", "mousedown"]}
    assert listed[6] == {"annot_actions": ["URI", "JavaScript", "GoTo"]}
    assert listed[7] == {"xfa": ["form"]}
    assert 8 not in listed
    assert listed[9] == {"page_actions": ["focus"] * 12}


def test_strip_leaves_nothing_to_find(spark):
    clean = strip_active_content(web(spark, ACTIVE)).collect()
    html = {r["page_id"]: r["html"] for r in clean}
    changed = {r["page_id"]: r["changed"] for r in clean}
    again = page_findings(web(spark, html)).collect()
    assert again == []
    assert not changed.pop(8) and all(changed.values())
    assert html[8] == ACTIVE[8]
    assert 'title="keep"' in html[5] and ">c</p>" in html[5]
    assert all(f">{t}</a>" in html[6] for t in "def") and "id=i" in html[6]
    assert "href" not in html[11] and 'x="y"' in html[11]
    assert html[10].startswith("kept ") and "never" not in html[10]
    assert "tail" in html[3]


def test_summary(spark):
    many = {i: f"<form>{'<script></script>' * (i % 4)}" for i in range(1, 31)}
    rows = active_content_summary(page_findings(web(spark, many))).collect()
    by_category = {}
    for r in rows:
        by_category.setdefault(r["category"], []).append(r)
    assert {c: (rs[0]["total"], rs[0]["more"], len(rs)) for c, rs in by_category.items()} == {
        "xfa": (30, 20, 10),
        "javascript": (sum(i % 4 for i in many), sum(i % 4 for i in many) - 10, 10),
    }
    assert sorted(r["ord"] for r in by_category["xfa"]) == list(range(1, 11))


def test_summary_order(spark):
    pages = {i: f'<iframe src="{i}a"></iframe><iframe src="{i}b"></iframe>' for i in range(1, 9)}
    rows = active_content_summary(page_findings(web(spark, pages))).collect()
    got = [r["item"] for r in sorted(rows, key=lambda r: r["ord"])]
    assert got == [f"{i}{x}" for i in range(1, 6) for x in "ab"]


META = {
    1: '<html class=a lang="en"><head><title> A &amp; B </title><meta charset="utf-8">'
    '<meta content="who" name="author"><meta name=keywords content=\'k1, k2\'>'
    '<meta name="generator" content="g"><meta name="description" content="' + "d" * 90 + '"></head>',
    2: "<p>nothing</p><script>'<title>no</title>'</script><!-- <meta charset=x> -->",
    3: "<html lang=de><title></title>",
}


def test_metadata(spark):
    got = {(r["page_id"], r["field"]): r["value"] for r in scan_metadata(web(spark, META)).collect()}
    assert got == {
        (1, "Title"): "A & B",
        (1, "Charset"): "utf-8",
        (1, "Language"): "en",
        (1, "Author"): "who",
        (1, "Keywords"): "k1, k2",
        (1, "Generator"): "g",
        (1, "Description"): "d" * 90,
        (3, "Language"): "de",
    }
    rows = {r["page_id"]: r for r in strip_metadata(web(spark, META)).collect()}
    assert {p: r["changed"] for p, r in rows.items()} == {1: True, 2: False, 3: True}
    assert rows[1]["html"] == "<html class=a ><head></head>"
    assert rows[2]["html"] == META[2]
    assert scan_metadata(web(spark, {p: r["html"] for p, r in rows.items()})).count() == 0


# Fragments that make broken, nested and cut-off markup when strung together.
FRAGMENTS = [
    "<script>", "</script>", "<a ", "<a", "<A\n", 'href="x"', "href=y", "onclick='y'", " onload=z", ">", "<",
    "<!--", "-->", "<iframe", "<form", "form>", " ", "text", "<style>", "</style>", '"', "'", "=",
    "<meta http-equiv=refresh>", "<body", "<p ", "</p>", "ipt>", "<scr", "href", "on", "<meta", "<title>",
    "</title>", "<html lang=x", 'lang="e"', "<html", ' x="', "/",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_nothing_is_left_in_broken_markup(spark, seed):
    rng = random.Random(seed)
    htmls = {i: "".join(rng.choices(FRAGMENTS, k=rng.randrange(1, 14))) for i in range(8000)}
    pages = web(spark, htmls)
    clean = strip_active_content(pages, keep=("url",))
    assert [r["page_id"] for r in page_findings(clean).collect()] == []
    found = {r["page_id"] for r in page_findings(pages).select("page_id").distinct().collect()}
    assert {r["page_id"] for r in clean.filter("changed").collect()} == found
    same = clean.filter("not changed").collect()
    assert all(r["html"] == htmls[r["page_id"]] for r in same)
    assert scan_metadata(strip_metadata(pages, keep=("url",))).collect() == []
