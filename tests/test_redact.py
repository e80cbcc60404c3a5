import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leafmill.functions.masking import parse_terms
from leafmill.operators.redact import redact_apply, redact_find, redact_page_counts

MASK = "█"


def pages(spark, texts):
    rows = [(1, i, t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, page_no int, text string")


def masked(text, terms):
    """Union of the matches of every term on the original text."""
    hit = set()
    for t in terms:
        for m in re.finditer(re.escape(t), text, re.IGNORECASE):
            hit |= set(range(*m.span()))
    return "".join(MASK if i in hit else c for i, c in enumerate(text))


def test_terms():
    assert parse_terms(" a, b ,, a,A") == ["a", "b", "A"]
    with pytest.raises(ValueError):
        parse_terms(" , ")


def test_listed_cases(spark):
    texts = ["therest", "ÉCOLE école", "rest in there", "nothing", "", "a.c abc a.c", "aaaa xax", "a(b"]
    terms = ["there", "rest", "École", "a.c", "aa", "a("]
    rows = redact_apply(pages(spark, texts), terms).collect()
    got = {r["page_no"]: r["text"] for r in rows}
    assert [got[i] for i in range(1, len(texts) + 1)] == [masked(t, terms) for t in texts]
    assert got[1] == MASK * 7
    assert {r["page_no"] for r in rows if r["redacted"]} == {1, 2, 3, 6, 7, 8}
    assert redact_find(pages(spark, list(got.values())), terms).count() == 0


def test_counts(spark, small_blocks):
    texts = ["the there", "The", "no", "x"] * 5 + ["there there"]
    found = {(r["page_no"], r["term"]): r["n"] for r in redact_find(pages(spark, texts), "the, there, ,").collect()}
    assert found[(1, "the")] == 2 and found[(1, "there")] == 1 and (2, "there") not in found
    rows = redact_page_counts(pages(spark, texts), "the, there, ,").collect()
    total = sum(found.values())
    assert {r["page_no"]: r["matches"] for r in rows} == {
        i: n for i in range(1, 22) if (n := sum(v for (p, _), v in found.items() if p == i))
    }
    assert {r["doc_matches"] for r in rows} == {total}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.text(alphabet="abAc.", min_size=1, max_size=4), min_size=1, max_size=4),
    st.lists(st.text(alphabet="abABc. ", max_size=14), min_size=40, max_size=80),
)
def test_against_plain_union(spark, terms, texts):
    terms = parse_terms(terms)
    got = {r["page_no"]: r["text"] for r in redact_apply(pages(spark, texts), terms).collect()}
    assert [got[i] for i in range(1, len(texts) + 1)] == [masked(t, terms) for t in texts]
