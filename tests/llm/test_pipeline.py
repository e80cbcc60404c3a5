"""The pipeline: what each stage keeps, against what its operator or a plain reading says of its own input."""

import random

import pytest

import corpus_pipeline
from leafmill.llm import language, quality
from leafmill.llm.batches import written
from tests.llm.test_packing import check
from tests.llm.test_small import exact

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    given = corpus_pipeline.ready(spark).read.parquet(f"{SMALL}/documents.parquet")
    base = [" ".join(given.filter("lang = 'en'").first().text.split()[:150])][0].split()
    more = []
    for i in range(6):
        words = list(base)
        words[rng.randrange(len(words))] = f"changed{i}"
        more.append((5000 + i, " ".join(words), "en", "planted", 1))
    more += [(6000, "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura " * 6, None, "planted", 1), (6001, None, None, None, None), (6002, "", "en", "planted", 0), (None, "a null id", "en", "planted", 9)]
    return written(given.unionByName(spark.createDataFrame(more, given.schema)), "planted-documents")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_stages_one_after_the_other(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "MinHash near-dedup", "packing"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    good = written(stages["quality classifier"](spark, docs, SMALL), "t1")
    gone = {r.doc_id for r in quality.classify(docs, labels).filter("NOT kept").collect()}
    assert good.columns == COLUMNS and ids(good) == [d for d in ids(docs) if d is None or d not in gone]
    assert gone and 5000 not in gone

    said = written(stages["language ID"](spark, good, SMALL), "t2")
    judged = language.identify(language.of_documents(good), corpus_pipeline.WANTED).collect()
    gone = {r.id for r in judged if not r.kept}
    assert said.columns == COLUMNS and ids(said) == [d for d in ids(good) if d is None or d not in gone]
    assert 5000 in ids(said)

    once = written(stages["MinHash near-dedup"](spark, said, SMALL), "t3")
    groups = exact({r.doc_id: r.text for r in said.collect() if r.doc_id is not None})
    assert once.columns == COLUMNS
    assert ids(once) == sorted([d for d, (_, _, kept) in groups.items() if kept] + [d for d in ids(said) if d is None], key=str)
    assert [d for d in ids(once) if d is not None and 5000 <= d < 5010] == [5000]

    pieces = stages["packing"](spark, once, SMALL)
    check(pieces, once.collect(), 2048)


def test_whole_run_on_the_given_table(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length", "ids_crc32"} <= set(rows[0].asDict())
    assert len({r.doc_id for r in rows}) > 50
