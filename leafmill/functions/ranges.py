"""Page range expressions such as ``1-3,5``.

Fixed rules of the grammar:

* blank, ``all`` and ``each`` (any case, outer white space ignored) mean every page on its own;
* parts are separated by commas, white space around a part is ignored, empty parts are skipped;
* a part is ``n`` or ``a-b`` in ASCII digits without inner white space;
* ``a`` below 1, ``b`` above the page total or ``a`` above ``b`` spoils the whole expression;
* an expression without any part is invalid; order and repeats are kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import let, strip

RANGES_TYPE = "array<struct<a:int,b:int>>"
EVERY_PAGE = ("", "all", "each")
RANGE_PART = "^([0-9]+)(?:-([0-9]+))?$"


def _normal(spec: Column) -> Column:
    return F.lower(strip(F.coalesce(spec, F.lit(""))))


def is_every_page(spec: Column) -> Column:
    return _normal(spec).isin(*EVERY_PAGE)


def _range(part: Column) -> Column:
    first = F.regexp_extract(part, RANGE_PART, 1)
    last = F.regexp_extract(part, RANGE_PART, 2)
    return F.struct(
        first.try_cast("int").alias("a"),
        F.when(last == "", first).otherwise(last).try_cast("int").alias("b"),
    )


def listed_ranges(spec: Column, total: Column) -> Column:
    """Ranges in the order written, or NULL when the expression is invalid.

    Not meant for expressions that stand for every page: those would need one element per page.
    """
    parts = F.filter(F.transform(F.split(_normal(spec), ","), strip), lambda p: p != "")
    return let(
        F.transform(parts, _range),
        lambda found: F.when(
            (F.size(found) > 0)
            & F.forall(
                found,
                lambda r: F.coalesce(
                    (r["a"] >= 1) & (r["b"] <= total) & (r["a"] <= r["b"]), F.lit(False)
                ),
            ),
            found,
        ),
    ).cast(RANGES_TYPE)
