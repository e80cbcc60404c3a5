"""Language identification against the same formula written plainly, for documents and web pages."""

import math
import random
from collections import defaultdict

import pytest

from leafmill.llm import language
from leafmill.llm.batches import importable
from leafmill.llm.queries import page_language

SMALL = "/root/testdata/sf0.001"
WORDS = {"en": "the cat and dog of this house", "de": "der hund und die katze im haus", "fr": "le chat et le chien de la maison"}


def grams(text):
    b = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32) >> 17 for i in range(len(b) - 2)]


def softmax(x):
    top = max(x)
    raised = [math.exp(v - top) for v in x]
    return [v / sum(raised) for v in raised]


def plain(rows, training=None, wanted=None):
    """``rows`` of id, text, declared, host, suffix."""
    training = [(r[1], r[2]) for r in rows] if training is None else training
    texts = defaultdict(int)
    for _, declared in training:
        if declared not in (None, "und"):
            texts[declared] += 1
    names = sorted(x for x, n in texts.items() if n >= language.LEAST)
    n = len(names) + 2
    counts = [defaultdict(int) for _ in range(n - 1)]
    for text, declared in training:
        if declared not in (None, "und"):
            own = counts[names.index(declared) if declared in names else n - 2]
            for g in grams(text):
                own[g] += 1
    sizes = [sum(c.values()) + 0.5 * language.SLOTS for c in counts]

    def log_of(slot):
        each = [(c[slot] + 0.5) / s for c, s in zip(counts, sizes, strict=True)]
        together = (sum(c[slot] for c in counts) + 0.5 * (n - 1)) / sum(sizes)
        return [math.log(p) for p in [*each, (together + 1 / language.SLOTS) / 2]]

    fits = []
    for _, text, *_ in rows:
        own = grams(text)
        logs = {g: log_of(g) for g in set(own)}
        scale = min(1.0, 150 / max(1, len(own)))
        fits.append([scale * sum(logs[g][k] for g in own) for k in range(n)])
    shares = [softmax(f) for f in fits]
    world = [1 + sum(s[k] for s in shares) for k in range(n)]
    prior = [w / sum(world) for w in world]
    sums = [defaultdict(lambda: [0.0] * n) for _ in range(3)]  # declared, host, suffix
    for r, s in zip(rows, shares, strict=True):
        for key, table in zip(r[2:], sums, strict=True):
            if key is not None:
                table[key] = [a + b for a, b in zip(table[key], s, strict=True)]
    out = []
    for r, fit, own in zip(rows, fits, shares, strict=True):
        def shrunk(key, table, above, strength, own=own):
            rest = [0.0] * n if key is None else [max(0.0, a - b) for a, b in zip(table[key], own, strict=True)]
            return [(a + strength * p) / (sum(rest) + strength) for a, p in zip(rest, above, strict=True)]

        by_suffix = shrunk(r[4], sums[2], prior, 200.0)
        by_host = shrunk(r[3], sums[1], by_suffix, 20.0)
        score = [math.log(p) + f for p, f in zip(by_host, fit, strict=True)]
        for key, table in ((r[2], sums[0]), (r[4], sums[2])):
            if key is not None:
                score = [x + math.log((table[key][k] + 0.5) / (world[k] + 1)) for k, x in enumerate(score)]
        found = softmax(score)
        best = found.index(max(found))
        name = [*names, "und", "und"][best]
        out.append((r[0], r[2], name, found[best], name in (names if wanted is None else wanted) and name != "und" and found[best] >= 0.5))
    return out


def same(df, want):
    assert df.columns == ["id", "declared", "language", "posterior", "kept"]
    key = lambda r: (str(r[0]), str(r[1]), r[3])
    got, want = sorted(map(tuple, df.collect()), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3], rel=1e-4, abs=1e-6), (a, b)


SCHEMA = "id long, text string, declared string, host string, suffix string"


def odd_rows():
    rng = random.Random(9)
    rows = []
    for i in range(60):
        own = rng.choice(list(WORDS))
        words = WORDS[own].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), own if i % 7 else "de", f"h{i % 4}", "xx" if i % 3 else None))
    rows += [(70, None, "en", "h1", None), (71, "", None, None, None), (72, "ab", "zz", "h2", "xx"), (73, "the dog", "fi", None, "yy"), (74, "ABC the", "und", "h0", "xx")]
    return rows + [rows[3], rows[3], (None, "le chat", "fr", "h3", None), (75, "der hund " * 20_000, None, "h1", None)]


def test_documents_equal_the_plain_formula(spark):
    importable(spark)
    df = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "'c' fit", "1 share", "2 declared_sum", "3 _rows")
    same(language.identify(df.repartition(5)), plain(odd_rows()))
    same(language.identify(df, ["de"]), plain(odd_rows(), wanted=["de"]))


def test_hot_host_in_slices(spark, eager_salting):
    same(language.identify(spark.createDataFrame(odd_rows(), SCHEMA)), plain(odd_rows()))


def test_pages_equal_the_plain_formula(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang").collect()
    rows = [tuple(r) for r in language.of_pages(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()]
    assert {r[2] for r in rows} <= {"de", "en", "es", "fr", None} and all(r[3] and r[4] for r in rows)
    want = plain(rows, [(d.text, d.lang.lower() if d.lang else None) for d in docs])
    same(page_language(spark, SMALL).withColumnRenamed("page_id", "id"), want)


def test_declared_language_as_browsers_read_it(spark):
    far = "data-x='" + "y" * 900 + "'"
    pages = {
        1: '<html lang="de-AT">a', 2: f"<html {far} lang=FR>", 3: '<html data-a="<html lang=en>" lang=\'es\'>', 4: "<html lang=english>",
        5: "<!-- <html lang=de> --><html>", 6: "<p>", 7: None, 8: "", 9: '<html data-lang="it">', 10: '<html lang="&#100;e">',
    }
    df = spark.createDataFrame([(i, f"http://h{i}.de/x", h) for i, h in pages.items()], "page_id long, url string, html string")
    got = {r.id: r.declared for r in language.of_pages(df).collect()}
    assert {k: v for k, v in got.items() if k != 10} == {1: "de", 2: "fr", 3: "es", 4: None, 5: None, 6: None, 7: None, 8: None, 9: None}
    assert {r.suffix for r in language.of_pages(df).collect()} == {"de"}


def test_many_languages_none_is_left_out(spark):
    """Seventy declarations, each with words of its own; a filter on the result costs nothing new."""
    rng = random.Random(4)
    words = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(70)}
    rows = [(k * 10 + i, " ".join(rng.choice(w) for _ in range(60)), name, None, None) for k, (name, w) in enumerate(words.items()) for i in range(6)]
    found = language.identify(spark.createDataFrame(rows, SCHEMA))
    assert sum(r.language == r.declared and r.kept for r in found.collect()) >= 0.99 * len(rows)
    plan = found.filter("kept").select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "aggregate(" not in plan and plan.count("MapInArrow") <= 1
