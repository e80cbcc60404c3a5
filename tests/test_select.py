"""Page selection against a plain reading, with documents that cross block borders."""

import random
import time

from leafmill.operators.select import delete_pages, extract_pages, split_by_ranges, split_report

# the ranges an expression stands for; it is invalid for documents that end before one of them does
EVERY, NEVER = "every page", [(1, 10**6)]
MEANT = {
    "": EVERY, "all": EVERY, "1": [(1, 1)], "2-3": [(2, 3)], "1-2,2": [(1, 2), (2, 2)], "5,4-6,1": [(5, 5), (4, 6), (1, 1)],
    "9": [(9, 9)], "1 - 2": NEVER, "1-11": [(1, 11)], "3,3": [(3, 3), (3, 3)], "2-4,6-7,4-6": [(2, 4), (6, 7), (4, 6)],
}
SPECS = list(MEANT)


def reading(spec, total):
    if MEANT[spec] == EVERY:
        return [(p, p) for p in range(1, total + 1)]
    return MEANT[spec] if all(b <= total for _, b in MEANT[spec]) else None



def tables(spark):
    rng = random.Random(5)
    totals = {i: rng.choice([1, 2, 3, 4, 5, 8, 9, 11]) for i in range(66)}
    specs = {i: SPECS[i % len(SPECS)] for i in totals}
    pages = [(d, p, f"text {d} {p}") for d, n in totals.items() for p in range(1, n + 1)]
    rng.shuffle(pages)
    return (
        spark.createDataFrame(pages, "doc_id bigint, page_no int, text string"),
        spark.createDataFrame(list(specs.items()), "doc_id bigint, spec string"),
        totals,
        specs,
    )


def test_split(spark, small_blocks):
    pages, specs_df, totals, specs = tables(spark)
    want = set()
    for d, n in totals.items():
        for a, b in reading(specs[d], n) or []:
            name = f"{d}_p{a}" if a == b else f"{d}_p{a}-{b}"
            want |= {(d, name, p - a + 1, p, f"text {d} {p}") for p in range(a, b + 1)}
    got = [tuple(r) for r in split_by_ranges(pages, specs_df).collect()]
    assert len(got) == len(want) and set(got) == want


def chosen(totals, specs, drop):
    want = set()
    for d, n in totals.items():
        ranges = reading(specs[d], n)
        if ranges is None:
            want.add((d, "invalid", None, None, None))
            continue
        picked = {p for a, b in ranges for p in range(a, b + 1)}
        kept = [p for p in range(1, n + 1) if (p in picked) != drop]
        if drop and not kept:
            want.add((d, "refused", None, None, None))
        want |= {(d, "ok", i, p, f"text {d} {p}") for i, p in enumerate(kept, 1)}
    return want


def test_extract_and_delete(spark, small_blocks):
    pages, specs_df, totals, specs = tables(spark)
    for operator, drop in ((extract_pages, False), (delete_pages, True)):
        got = [tuple(r) for r in operator(pages, specs_df).collect()]
        want = chosen(totals, specs, drop)
        assert len(got) == len(want) and set(got) == want


def test_extract_and_delete_share_the_pages(spark, small_blocks):
    pages, specs_df, totals, specs = tables(spark)
    sound = {d for d in totals if reading(specs[d], totals[d]) is not None}
    parts = [
        {(r["doc_id"], r["src_page_no"]) for r in op(pages, specs_df).collect() if r["src_page_no"]}
        for op in (extract_pages, delete_pages)
    ]
    assert not parts[0] & parts[1]
    assert parts[0] | parts[1] == {(d, p) for d in sound for p in range(1, totals[d] + 1)}


def test_gaps_and_missing_documents_are_told(spark):
    """Page numbers that lack, repeat or are absent: no page is lost without a word."""
    numbers = {1: [2, 3, 70_000], 2: [1, 2, 3], 3: [1, 1, 3], 4: [1, None, 2], 5: [0, 1, 2], 6: [1, 2, 4, 5, 3]}
    rows = [(d, p, f"t{p}") for d, ps in numbers.items() for p in ps]
    pages = spark.createDataFrame(rows, "doc_id bigint, page_no int, text string")
    specs = spark.createDataFrame([(d, "1-2") for d in numbers] + [(9, "1"), (10, "all")], "doc_id bigint, spec string")
    status = {1: "gaps", 2: "ok", 3: "gaps", 4: "gaps", 5: "gaps", 6: "ok", 9: "missing", 10: "missing"}
    for operator, kept in ((extract_pages, {2: [1, 2], 6: [1, 2]}), (delete_pages, {2: [3], 6: [3, 4, 5]})):
        found = operator(pages, specs).collect()
        assert {r.doc_id: r.status for r in found} == status
        assert sum(r.status != "ok" for r in found) == 6
        got = {d: sorted(r.src_page_no for r in found if r.doc_id == d) for d in kept}
        assert got == kept
    assert {r.doc_id: r.status for r in split_report(pages, specs).collect()} == status
    assert {r.doc_id for r in split_by_ranges(pages, specs).collect()} == {2, 6}


def test_many_ranges_over_many_pages(spark):
    """100,000 pages and 20,000 ranges of one document, in seconds."""
    n, rng = 100_000, random.Random(3)
    pages = spark.range(1, n + 1).selectExpr("7L doc_id", "CAST(id AS INT) page_no", "'x' text")
    starts = [rng.randrange(1, n - 12) for _ in range(20_000)]
    ranges = [(a, a + rng.randrange(0, 12)) for a in starts]
    specs = spark.createDataFrame([(7, ",".join(f"{a}-{b}" for a, b in ranges))], "doc_id bigint, spec string")
    picked = {p for a, b in ranges for p in range(a, b + 1)}
    start = time.perf_counter()
    assert split_by_ranges(pages, specs).count() == sum(b - a + 1 for a, b in set(ranges))
    kept = extract_pages(pages, specs).selectExpr("count(*)", "sum(src_page_no)", "max(page_no)").first()
    assert tuple(kept) == (len(picked), sum(picked), len(picked))
    left = delete_pages(pages, specs).selectExpr("count(*)", "sum(src_page_no)", "max(page_no)").first()
    assert tuple(left) == (n - len(picked), n * (n + 1) // 2 - sum(picked), n - len(picked))
    assert time.perf_counter() - start < 60
