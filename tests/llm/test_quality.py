"""Quality classification against the same model and formulas written plainly, and rows not fitted on."""

import math
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import quality
from leafmill.llm.batches import importable

SMALL = "/root/testdata/sf0.001"
MIX = 0x9E3779B97F4A7C15


def features(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    codes = [xxhash.xxh3_64_intdigest(w) for w in words]
    one, two = np.zeros(128), np.zeros(128)
    for c in codes:
        one[(c * MIX % 2**64) >> 57] += 1
    for a, b in zip(codes, codes[1:], strict=False):
        two[((a * MIX + b) % 2**64 * MIX % 2**64) >> 57] += 1
    n = max(1, len(words))
    return np.array([*np.sqrt(one / n), *np.sqrt(two / n), *quality.surface(text.encode())])


def fitted(x, y):
    """Logistic model of plain numpy, with weights for the features as they are."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
    return lambda v: ((v - mean) / spread) @ w[:-1] + w[-1]


def plain(docs, labels):
    """docs: doc_id, text, source, lang; labels: doc_id, quality."""
    marks = defaultdict(list)
    for d, q in labels:
        if d is not None and q is not None:
            marks[d].append(q)
    held = [(features(t or ""), np.mean(marks[d])) for d, t, *_ in docs if d in marks]
    y = np.array([m for _, m in held])
    model = fitted(np.array([x for x, _ in held], np.float32).astype(float), y)
    usual = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    odds = [min(30.0, max(-30.0, model(features(t or "")))) for _, t, *_ in docs]
    p = [1 / (1 + math.exp(-o)) for o in odds]
    mean = min(1 - 1e-6, max(1e-6, sum(p) / len(p)))
    hosts, paths = defaultdict(list), defaultdict(list)
    for (_, _, source, lang), q in zip(docs, p, strict=True):
        hosts[source or ""].append(q)
        paths[source or "", "/".join(x for x in (source, lang) if x is not None)].append(q)

    def strength(sites, above):
        n = sum(len(v) for v in sites.values())
        between = sum(len(v) * (np.mean(v) - above(k)) ** 2 for k, v in sites.items())
        within = sum(above(k) * (1 - above(k)) for k in sites)
        room = n - sum(len(v) ** 2 for v in sites.values()) / n
        variance = (between - within) / room if room > 0 else 0
        spread = np.mean([above(k) * (1 - above(k)) for k in sites])
        return min(1e4, max(1.0, spread / variance - 1)) if variance > 0 and spread else 1e4

    a = strength(hosts, lambda k: mean)
    b = strength(paths, lambda k: (sum(hosts[k[0]]) + a * mean) / (len(hosts[k[0]]) + a))
    out = []
    for (d, _, source, lang), q, o in zip(docs, p, odds, strict=True):
        host, path = hosts[source or ""], paths[source or "", "/".join(x for x in (source, lang) if x is not None)]
        by_host = (sum(host) - q + a * mean) / (len(host) - 1 + a)
        by_path = (sum(path) - q + b * by_host) / (len(path) - 1 + b)
        prior = min(1 - 1e-6, max(1e-6, by_path))
        final = 1 / (1 + math.exp(-(o - usual + math.log(prior / (1 - prior)))))
        out.append((d, o - usual, by_host, by_path, final, final >= 0.5))
    return out


def same(df, want):
    key = lambda r: (str(r[0]), round(r[1], 3))
    got, want = sorted(map(tuple, df.collect()), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[5] == b[5] and a[1:5] == pytest.approx(b[1:5], abs=2e-3), (a, b)


def rows_of(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source", "lang")
    more = [(-1, None, None, None), (-2, "", "s", None), (-3, " \n", None, "en"), (-4, "One two", "s", "en"), (-4, "One two", "s", "en"), (None, "x y z", "s", "en"), (-5, "word " * 100_000, "s", "de")]
    return given.unionByName(spark.createDataFrame(more, given.schema))


def test_equal_to_the_plain_model(spark, eager_salting):
    importable(spark)
    docs = rows_of(spark)
    marks = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()] + [(-4, 1), (-4, 0), (-5, 0), (10**9, 1), (None, 1), (3, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    want = plain([tuple(r) for r in docs.collect()], marks)
    same(quality.classify(docs.selectExpr("*", "'c' host", "1 path", "2 odds", "3 p", "4 x", "5 y"), labels), want)


def test_labelled_rows_not_fitted_on(spark):
    importable(spark)
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.classify(docs, labels.filter("doc_id % 2 = 0"))
    right = judged.join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("mark")), "doc_id").selectExpr("count(*)", "count_if(kept = (mark = 1))").first()
    assert right[0] > 1500 and right[1] >= 0.99 * right[0]


def test_words_tell_what_the_surface_does_not(spark):
    """Texts of the same shape; only their words differ."""
    importable(spark)
    rng = np.random.default_rng(1)
    good, bad, both = (["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)] for _ in range(3))
    rows = [(i, " ".join([*rng.choice(good if i % 2 else bad, 15), *rng.choice(both, 45)]), f"s{i % 5}", "en") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, quality int")
    unseen = [r for r in quality.classify(docs, labels).collect() if r.doc_id >= 500]
    assert sum(r.kept == bool(r.doc_id % 2) for r in unseen) >= 0.95 * len(unseen)
