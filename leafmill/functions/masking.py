"""Finding and destroying terms in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the character that replaces every destroyed one.
MASK = "█"


def parse_terms(terms: str | list[str]) -> list[str]:
    """Terms of a comma list, trimmed, blanks dropped, repeats collapsed, order kept."""
    given = terms.split(",") if isinstance(terms, str) else terms
    found = list(dict.fromkeys(t.strip() for t in given if t.strip()))
    if not found:
        raise ValueError("at least one term to search for is needed")
    return found


def term_pattern(term: str) -> str:
    """Literal, case-insensitive also beyond ASCII."""
    return "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", term)


def count_term(text: Column, term: str) -> Column:
    return F.regexp_count(text, F.lit(term_pattern(term))).cast("int")


def _same(a: str, b: str) -> bool:
    return a == b or a.lower() == b.lower() or a.upper() == b.upper()


def may_cross(a: str, b: str) -> bool:
    """True when a match of ``a`` can run into a match of ``b`` with each sticking out.

    Containment does not count. With ``a == b`` this asks whether a term overlaps itself.
    """
    return any(_same(a[-n:], b[:n]) for n in range(1, min(len(a), len(b))))


def _mask_one(text: Column, term: str) -> Column:
    return F.regexp_replace(text, term_pattern(term), MASK * len(term))


def mask_terms(text: Column, terms: list[str]) -> Column:
    """Replace every character that belongs to a match of any term.

    Each term is matched on the original text. Terms that cannot partly overlap give the same
    result when masked one after the other, longest first, which is cheap. The others are masked
    separately and the masks are laid over each other, on rows where two of them match.
    """
    crossing = {
        t
        for t in terms
        for u in terms
        if t != u and (may_cross(t, u) or may_cross(u, t))
    } | {t for t in terms if MASK in t}
    # a term inside a crossing one must see the original text as well
    crossing |= {
        t for t in terms for c in list(crossing) if t != c and t.lower() in c.lower()
    }
    plain = sorted((t for t in terms if t not in crossing), key=len, reverse=True)
    separate = [t for t in terms if t in crossing]

    if not separate:
        for term in plain:
            text = _mask_one(text, term)
        return text

    chain = text
    for term in plain:
        chain = _mask_one(chain, term)
    masks = ([chain] if plain else []) + [_mask_one(text, t) for t in separate]
    hits = [m != text for m in masks]
    laid = F.split(masks[0], "")
    for mask in masks[1:]:
        laid = F.zip_with(
            laid, F.split(mask, ""), lambda x, y: F.when(x == MASK, x).otherwise(y)
        )
    n_hits = sum((h.cast("int") for h in hits), F.lit(0))
    single = text
    for mask, hit in zip(reversed(masks), reversed(hits)):
        single = F.when(hit, mask).otherwise(single)
    return F.when(n_hits >= 2, F.array_join(laid, "")).otherwise(single)
