"""The operators on small fixtures: nulls, empty and long texts, ties, repeats, empty tables."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat, forest, language, licenses, maxent, quality, vptree
from leafmill.llm.links import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


# near duplicates


def exact(texts):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def test_forest_equals_all_pairs(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(200)) for _ in range(4)]
    rows = []
    for i in range(160):
        words = base[i % 4].split()
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE\ttwo"), (205, "long " * 50_000), (206, base[0].upper())]
    got = {r[0]: tuple(r[1:]) for r in forest.near_duplicates(docs(spark, rows)).collect()}
    assert got == exact(dict(rows))


def test_forest_on_the_small_table_repeats_and_nothing(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in given.collect()}
    assert {r[0]: tuple(r[1:]) for r in forest.near_duplicates(given).collect()} == exact(texts)
    twice = forest.near_duplicates(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((r.component_id, r.kept, r.doc_id is None) for r in twice) == [(1, False, True), (1, True, False), (1, True, False)]
    assert forest.near_duplicates(docs(spark, []).limit(0)).count() == 0


def test_forest_keeps_a_star_together(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(500, " ".join(base))]
    for i in (x for x in range(1001) if x != 500):
        words = list(base)
        for k, at in enumerate(rng.sample(range(200), 5)):
            words[at] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    got = forest.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == 1001 and {r.component_id for r in got} == {0} and [r.doc_id for r in got if r.kept] == [0]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 400)] + [(5, 1000 + i) for i in range(300)] + [(9, 3), (9, 3)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert {got[i] for i in range(100, 401)} == {100} and {got[1000 + i] for i in range(300)} == {5} and got[9] == got[3] == 3


# vantage points


def test_factor_one_is_exact_and_the_default_finds_most(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(1500)] + [(2000 + i, [0.5] * 12) for i in range(200)]
    rows += [(3000, None), (3001, [0.0] * 12), (3002, [math.nan] * 12), (3003, [1.0, None] * 6), (3004, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id % 100 = 0")
    ids = np.array([i for i, v in rows[:1700]])
    data = np.array([v for _, v in rows[:1700]], np.float32).astype(float)
    want = {}
    for q in ids[ids % 100 == 0]:
        gap = np.sqrt(((data - data[ids == q][0]) ** 2).sum(axis=1))
        want[int(q)] = [int(ids[k]) for k in np.lexsort((ids, gap)) if ids[k] != q][:10]
    for factor, least in ((1.0, 1.0), (None, 0.9)):
        got: dict[int, list] = {}
        for r in vptree.search(vectors, queries, factor=factor).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert set(got) == set(want)
        assert sum(len(set(got[q]) & set(want[q])) for q in want) >= least * 10 * len(want)
        if factor == 1.0:
            assert got == want
    assert vptree.search(vectors.limit(0), queries.limit(0)).count() == 0


# chat


def test_escape_gives_the_text_back(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["<|", "|>", "\\", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "é🎉", "a", "\n", "<", "|", ">", "turn"]) for _ in range(rng.randrange(12))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("*", chat.unescape(F.col("e")).alias("u"))
    for r in rows.collect():
        assert r.u == r.t
        assert not any(x in r.e for x in ("<|", "|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>"))


def test_conversation_digests(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a<|end|>\\"), (1, 1, "assistant", "a<|end|>\\"), (2, 0, None, None), (None, 0, "user", "x\n<s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    learned = "a<|end|>\\" * 2
    assert got[1].n_turns == 3 and got[1].loss_chars == len(learned) and got[1].loss_sha256 == sha(learned)
    assert got[1].turns_sha256 == sha("user\nq\n" + "assistant\na<|end|>\\\n" * 2)
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0
    assert got[None].turns_sha256 == sha("user\nx\n<s>\n")
    assert chat.conversation_digests(df.limit(0)).count() == 0


def test_layouts_by_fingerprint(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"extra":1}',
        '{"prompt":"q","completion":"a"}', '{"question":"q","answer":"a","system":"s"}',
        '{"instruction":"q","input":"i","output":"a"}', '{"other":1}', "no json", None,
    ]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    rows = {r.conv_id: r for r in chat.canonical_records(df, "record").collect()}
    qa = [("user", "q"), ("assistant", "a")]
    turns = {k: r.turns and [tuple(t) for t in r.turns] for k, r in rows.items()}
    assert turns == {0: qa, 1: qa, 2: qa, 3: [("system", "s"), *qa], 4: [("user", "q\ni"), qa[1]], 5: None, 6: None, 7: None}
    assert [rows[i].layout for i in (5, 6, 7)] == ["unknown"] * 3


def test_tables_by_fingerprint(spark):
    turn = "struct<role:string,content:string>"
    tables = [
        spark.createDataFrame([(1, 1, "gpt", "a", "x"), (1, 0, "human", "q", "x")], "conv_id long, turn long, role string, text string, system string"),
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], f"conv_id long, messages array<{turn}>").withColumn("extra", F.lit(1)),
        spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, completion string"),
    ]
    got = [tuple(chat.conversation_digests(t).first()) for t in tables]
    assert got[0] == got[1] == got[2] and got[0][1] == 2
    assert chat.hash_of(["b", "a.c"]) == spark.range(1).select(chat.fingerprint_of(["b", "a.c"])).first()[0]
    with pytest.raises(ValueError):
        chat.conversation_digests(spark.createDataFrame([(1, "x")], "conv_id long, other string"))


def test_records_without_turns_stay(spark):
    records = ['{"other":1}', '{"messages":[]}', None, '{"messages":[{"content":"q"},{"role":"assistant","content":"a"}]}']
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    got = {r.conv_id: r.formatted for r in chat.format_records(chat.canonical_records(df, "record")).collect()}
    assert set(got) == {0, 1, 2, 3} and [got[i] for i in range(3)] == [None] * 3
    assert got[3] == "<|turn|><|text|>q<|end|><|turn|>assistant<|text|>a<|end|>"


# licences


def test_licences_in_every_place(spark):
    filler = " ".join(f"w{i}" for i in range(500))
    rows = [(i, f"{filler[: i * 37]} {text} {filler}") for i, text in enumerate(licenses.TEMPLATES.values())]
    rows += [(100, filler), (101, None), (102, ""), (103, "Released under"), (104, "x " * 100_000 + licenses.TEMPLATES["MIT"])]
    got: dict[int, dict] = {}
    for r in licenses.scan(docs(spark, rows).withColumn("license_id", F.lit("clash"))).collect():
        got.setdefault(r.doc_id, {})[r.license_id] = r.containment
    for i, name in enumerate(licenses.TEMPLATES):
        assert got[i][name] == 1.0
    assert set(got) == {*range(len(licenses.TEMPLATES)), 104}


# quality, language


def test_quality_on_labels(spark):
    given, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.kept for r in quality.classify(given, labels).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows}
    assert len(rows) == given.count()
    assert sum(rows[d] == bool(q) for d, q in marks.items()) >= 0.95 * len(marks)


def test_quality_without_labels_nulls_and_nothing(spark):
    df = docs(spark, [(1, None), (2, ""), (2, ""), (3, "word " * 200_000)]).withColumn("source", F.lit(None).cast("string"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality.classify(df, labels).collect()] == [True] * 4
    assert quality.classify(df.limit(0), labels).count() == 0


def test_language_of_the_small_table(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(language.of_documents(given)).collect()
    assert len(rows) == given.count()
    assert sum(r.language == r.declared for r in rows) >= 0.97 * len(rows)


def test_language_against_wrong_and_missing_evidence(spark):
    english, german = "the cat and the dog of this house " * 20, "der hund und die katze von diesem haus " * 20
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", "h", "s") for i in range(40)]
    rows += [(90, english, "de", "h", "s"), (91, None, None, None, None), (92, "", "en", "h", "s"), (93, german * 3000, None, None, "xx")]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {r.id: r.language for r in language.identify(df).collect()}
    assert got[90] == "en" and got[92] == "en" and got[93] == "de" and len(got) == 44
    assert language.identify(df.limit(0)).count() == 0


def test_foreign_and_non_language_texts_go(spark):
    rng = random.Random(3)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bad = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita. " * 5,
        "Det var en gang en konge som hadde tre sønner og ingen av dem visste hva de skulle gjøre med riket. " * 5,
        "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。" * 5,
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(600)), "#$%& @@ 12 " * 30,
    ]
    wrong = spark.createDataFrame([(-1 - i, t, None, None, len(t)) for i, t in enumerate(bad)], DOC)
    both = given.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(wrong)
    rows = language.identify(language.of_documents(both), ["de", "en", "es", "fr"]).collect()
    clean = [r.kept for r in rows if r.id >= 0]
    assert [(r.id, r.language) for r in rows if r.id < 0 and r.kept] == [] and sum(clean) >= 0.95 * len(clean)
    some = language.identify(language.of_documents(given), ["de"]).filter("kept").select("language").distinct().collect()
    assert [r.language for r in some] == ["de"]


def test_rare_declarations_are_a_class_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(language, "LEAST", 15)
    monkeypatch.setattr(language, "HELD", 1)
    words = {"en": "the cat and the dog of this house ", "de": "der hund und die katze von diesem haus ", "fi": "kissa ja koira tässä talossa ovat "}
    rows = [(i, words[x] * 20, x, x, None) for x, n in (("en", 30), ("de", 20), ("fi", 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {tuple(r) for r in language.identify(df).select("declared", "language", "kept").collect()}
    assert got == {("en", "en", True), ("de", "de", True), ("fi", language.OTHER, False)}


# language model


def test_language_model(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-2, "")], given.schema)
    texts = [(r.doc_id, r.text or "") for r in given.unionByName(more).collect()]
    counts: dict[bytes, int] = {}
    tokens = [(d, [*t.encode().lower().split(), b"\n"]) for d, t in texts]
    for d, words in tokens:
        if not maxent.held_out(d):
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    rows = maxent.score(given.unionByName(more)).collect()
    assert len(rows) == len(texts)
    want = {d: (len(ws), sum(w in counts for w in ws), sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens}
    for r in rows:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.train_tokens == n
        assert r.base_score == pytest.approx(want[r.doc_id][2]) and r.held_out == maxent.held_out(r.doc_id)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_class_scores_are_probabilities_and_training_helps(spark):
    # the start knows the word before; only the class two back says here which class follows
    n = maxent.CLASSES
    kinds, places = np.arange(n), []
    after_row, after_two = np.zeros((n, n)), np.zeros((n, n, n))
    for two in range(6):
        for before in range(8):
            counts = {(7 * two + k) % n: 9.0 - k for k in range(5)}
            places.append((two * n + before, sum(counts.values())))
            for kind, x in counts.items():
                after_row[before, kind] += x
                after_two[two, before, kind] += x
    weights, seen = maxent.train(spark.createDataFrame(places, "place long, n double"), after_row, after_two, kinds, steps=6)
    assert seen[-1] > seen[0]
    assert np.exp(weights.log_softmax(np.arange(50))).sum(axis=1) == pytest.approx(np.ones(50))
    # the likelihood is that of the counts
    logs = weights.log_softmax(np.array([p for p, _ in places]))
    total = sum(after_two[p // n, p % n] @ logs[i] for i, (p, _) in enumerate(places)) / after_row.sum()
    assert total == pytest.approx(seen[-1])


def test_long_conversations_with_clashing_columns(spark):
    long = "x</s>[INST] y " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 at", "'l' lead", "2 size", "3 parts", "4 t", "'f' formatted")
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n".encode()).hexdigest()
    assert got[1].loss_chars == len(long) and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0)
