"""Licence scans against every window of every text, looked at one by one."""

import random
from collections import defaultdict

import regex

from leafmill.llm import licenses
from leafmill.llm.batches import importable


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]


def shingles(ws):
    return [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]


def plain(rows, templates, least=licenses.CONTAINMENT):
    out = []
    for d, text in rows:
        grams = shingles(words(text or ""))
        for name, template in templates.items():
            ws = words(template)
            size = licenses.SMALLEST
            while size < len(ws):
                size *= 2
            own, step, span = set(shingles(ws)), size // 4, size + size // 4 - 2
            shares = {at: len(own & set(grams[at : at + span])) / len(own) for at in range(0, len(grams), step)}
            good = {at: x for at, x in shares.items() if x >= least}
            if good:
                best = max(good.values())
                out.append((d, name, best, min(at for at, x in good.items() if x == best), len(good)))
    return sorted(out)


def test_equal_to_all_windows(spark):
    importable(spark)
    rng = random.Random(8)
    rows = []
    for i in range(120):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            notice = words(rng.choice(list(licenses.TEMPLATES.values())))
            for _ in range(rng.randrange(3)):  # some words changed, some lost
                notice[rng.randrange(len(notice))] = rng.choice(["x", ""])
            at = rng.randrange(len(text) + 1)
            text[at:at] = notice
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else ", ".join(text)))
    rows += [(200, None), (201, ""), (202, "Released under"), (203, "Released under the MIT License."), (203, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0.")]
    rows += [(204, "x " * 60_000 + licenses.TEMPLATES["GPL-3.0"] + " y" * 60_000), (205, "Licensed under the Apache License, Version 2.0. " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' license_id", "1 row", "2 at", "3 size", "4 shingles")
    got = sorted(((r.doc_id, r.license_id, r.containment, r.first_word, r.n_windows) for r in licenses.scan(df.repartition(5)).collect()), key=str)
    want = defaultdict(int)
    for d, text in rows:
        for row in plain([(0, text)], licenses.TEMPLATES):
            want[(d, *row[1:])] += 1
    found = defaultdict(int)
    for r in got:
        found[r] += 1
    assert found == want and len(want) > 60


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
