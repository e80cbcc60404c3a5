"""Packing against the tokenizer itself, and the promises of the schedule."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leafmill.llm import packing
from leafmill.llm.packing import Schedule, TextIds
from leafmill.llm.queries import WORD_MODEL

FIELDS = "doc_id long, text string, source string"


def test_ids_equal_the_library():
    own, library = TextIds(open(WORD_MODEL, "rb").read()), Tokenizer.from_file(WORD_MODEL)
    rng = random.Random(3)
    texts = ["", " ", "Don't STOP<|endoftext|>Now <|ENDOFTEXT|>", "é É ́x", "İ Σς", "a\x1cb\x85c", "x" * 9000]
    texts += ["a. b.. c.,d e'. f's. 9%\n7$", "a.́ b .c", "é. ß! x.<|endoftext|>. y.", "a.\x0bb.\x1cc.", "end.", " lead"]
    texts += ["".join(rng.choice(" \nabAB'é!?.,;<|endoftext|>１9́") for _ in range(rng.randrange(50))) for _ in range(500)]
    ids, counts = own(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        at += n


def test_forgetting_words_changes_nothing():
    own = TextIds(open(WORD_MODEL, "rb").read())
    texts = [f"word{i} word{i % 7}" for i in range(300)]
    whole = own(pa.array(texts))[0]
    own.words.limit = 20
    assert np.concatenate([own(pa.array([t]))[0] for t in texts]).tolist() == whole.tolist()


@pytest.mark.parametrize("weights", [[5, 3, 1], [1, 1, 1], [0.9, 0.05, 0.05]])
def test_schedule_is_a_gapless_deficit_round_robin(weights):
    totals, quantum = [1000, 333, 64], 16
    plan = Schedule(totals, weights, quantum)
    spans = []
    for q, total in enumerate(totals):
        slot = np.arange(-(-total // quantum))
        at = plan.place(np.full(len(slot), q), slot)
        size = np.minimum(quantum, total - slot * quantum)
        spans += list(zip(at.tolist(), (at + size).tolist(), [q] * len(slot), strict=True))
    spans.sort()
    assert spans[0][0] == 0 and spans[-1][1] == sum(totals)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    # while all queues last, each has its share up to a quantum
    given, share = defaultdict(int), np.array(weights) / sum(weights)
    for a, b, q in spans:
        given[q] += b - a
        if any(given[k] >= t for k, t in enumerate(totals)):
            break
        for k in range(3):
            assert abs(given[k] - share[k] * b) <= 2 * quantum


def check(pieces, docs, size):
    library = Tokenizer.from_file(WORD_MODEL)
    want = defaultdict(list)
    for d in docs:
        want[d.doc_id].append([*library.encode(d.text or "", add_special_tokens=False).ids, 1])
    rows = pieces.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for doc_id, own in by_doc.items():
        if len(want[doc_id]) == 1:
            (ids,), at = want[doc_id], 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
    total = sum(len(x) for v in want.values() for x in v)
    assert sorted(by_sequence) == list(range(-(-total // size)))
    for k, own in by_sequence.items():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own])
        assert [r.offset for r in own] == [0, *ends[:-1].tolist()]
        assert ends[-1] == size or k == max(by_sequence)


def test_query_over_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(packing.pack(docs.repartition(3), WORD_MODEL), docs.collect(), packing.SIZE)


def test_nulls_repeats_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    rows = [(i, "one two three " * (i % 5), f"s{i % 9}" if i % 4 else None) for i in range(60)] + [(7, "again", "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, FIELDS)
    pieces = packing.pack(docs, WORD_MODEL, size=64, quantum=8)
    check(pieces, docs.collect(), 64)
    made = packing.sequences(pieces, 64).collect()
    total = sum(r.n_tokens for r in made)
    assert total == pieces.groupBy().sum("length").first()[0]
    assert all(len(r.ids) == 64 or r.n_tokens & (r.n_tokens - 1) == 0 for r in made)


def test_given_weights_decide_the_mixture(spark):
    docs = spark.createDataFrame([(i, "word " * 99, "ab"[i % 2]) for i in range(40)], FIELDS)
    rows = packing.pack(docs, WORD_MODEL, size=200, quantum=10, weights={"a": 3, "b": 1}).filter("sequence_id < 10").collect()
    for k in range(10):
        share = sum(r.length for r in rows if r.sequence_id == k and r.source == "a")
        assert abs(share - 150) <= 10


def test_words_with_marks_and_many_at_once():
    own, library = TextIds(open(WORD_MODEL, "rb").read()), Tokenizer.from_file(WORD_MODEL)
    for words in ([f"w{i}" for i in range(200)], ["a|b", "|", "||", "c"], ["́x", "​", "ok", "x" * 3000]):
        flat, counts = own.library([w.encode() for w in words])
        got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
        assert got == [library.encode(w, add_special_tokens=False).ids for w in words]
    ids, counts = own(pa.array([" ".join(f"v{i} | z|{i}" for i in range(300))]))
    assert ids.tolist() == library.encode(" ".join(f"v{i} | z|{i}" for i in range(300)), add_special_tokens=False).ids


def test_every_source_keeps_its_share(spark):
    """Over 500 sources, far beyond the queues of their own; the smallest one has the largest weight."""
    rows = [(i, "word " * 39, f"s{i % 520:03d}") for i in range(2600)] + [(9000 + i, "tail " * 39, "small") for i in range(4)]
    docs = spark.createDataFrame(rows, FIELDS).repartition(6)
    pieces = packing.pack(docs, WORD_MODEL, size=1040, quantum=2, weights={"small": 0.05, "s000": 0.01})
    check(pieces, docs.collect(), 1040)
    held = defaultdict(lambda: defaultdict(int))
    for r in pieces.collect():
        held[r.sequence_id][r.source] += r.length
    # sources without a weight have that of their tokens
    one = 200 / (2604 * 40)
    whole = 0.05 + 0.01 + 519 * one
    for k in range(3):  # the 160 tokens of the small source last for three windows at its weight
        assert abs(held[k]["small"] - 0.05 / whole * 1040) <= 4
        assert abs(held[k]["s000"] - 0.01 / whole * 1040) <= 4
    assert sum(held[k]["small"] for k in range(5)) == 160
    for k in range(3):
        for source in ("s001", "s300", "s519"):
            assert abs(held[k][source] - one / whole * 1040) <= 4
    assert len(held[0]) > 350


def test_weights_that_cannot_be_kept_to_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], FIELDS)
    for weights in ({"absent": 1.0}, {"x": 0.0}, {"x": -1.0}):
        with pytest.raises(ValueError):
            packing.pack(docs, WORD_MODEL, weights=weights)


def test_long_text_clashing_columns_and_joins_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    rows = [(1, "long " * 200_000, "x"), (2, None, None), (3, "a b", "y"), (None, "c", "y")]
    docs = spark.createDataFrame(rows, FIELDS).selectExpr("*", "'q' queue", "1 part", "2 n", "3 ids", "4 runs", "5 start")
    check(packing.pack(docs, WORD_MODEL, keep_ids=False), docs.collect(), packing.SIZE)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], FIELDS), WORD_MODEL).count() == 0
