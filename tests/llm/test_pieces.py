"""Pieces against the library itself, on the given texts and on odd ones."""

from __future__ import annotations

import hashlib
import random
import subprocess
import sys

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import Row

from leafmill.llm import pieces
from leafmill.llm.batches import WordIds, size_slices
from leafmill.llm.pieces import NORMALIZER_FIELD, Codec, fields
from leafmill.llm.queries import PIECE_MODEL

MODEL = open(PIECE_MODEL, "rb").read()
ODD = ["", " ", "  a ", "a  b", "▁x", "\n\t\x00é🎉", "<s> </s> <unk>", "a" * 30_000, " " * 500, "ﬁ Ａ é　x"]


def mixed(n: int) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choice(" \n▁aé🎉<s>\x00Ａﬁ　xyz") for _ in range(rng.randrange(40))) for _ in range(n)]


def per_text(found):
    ids, begin, end, counts = found
    at = 0
    for n in counts:
        yield ids[at : at + n].tolist(), begin[at : at + n].tolist(), end[at : at + n].tolist()
        at += n


def test_ids_equal_the_library_and_spans_cover_the_source():
    codec, library = Codec(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = ODD + mixed(800)
    for text, (ids, begin, end) in zip(texts, per_text(codec.encode(texts)), strict=True):
        assert ids == library.encode(text)
        assert codec.decode(ids) == library.decode(library.encode(text))
        if text:
            assert begin[0] == 0 and end[-1] == len(text.encode()) and begin[1:] == end[:-1]


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_character_map_of_another_normaliser(prefix, squeeze):
    """The map of the library's NFKC rules, put into the same vocabulary."""
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    spec = next(v for n, v, _ in fields(rules) if n == NORMALIZER_FIELD)
    blob = next(v for n, v, _ in fields(spec) if n == 2)

    def number(n: int) -> bytes:
        return bytes([n & 127 | 128]) + number(n >> 7) if n > 127 else bytes([n])

    body = b"\x12" + number(len(blob)) + blob + bytes([0x18, prefix, 0x20, squeeze, 0x28, 1])
    model = b"".join(raw for n, _, raw in fields(MODEL) if n != NORMALIZER_FIELD) + b"\x1a" + number(len(body)) + body
    codec, library = Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ODD + mixed(400)
    for text, (ids, begin, end) in zip(texts, per_text(codec.encode(texts)), strict=True):
        assert ids == library.encode(text)
        assert begin == sorted(begin) and end == sorted(end)
    (ids, begin, end), = per_text(codec.encode(["ﬁn Ａb"]))
    assert begin[0] == 0 and end[-1] == len("ﬁn Ａb".encode())


def test_query_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([Row(doc_id=-1, text=None), Row(doc_id=-2, text=""), Row(doc_id=-2, text="")], docs.schema)
    docs = docs.unionByName(extra)
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rows = pieces.encode_digests(docs, PIECE_MODEL).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.span_bytes == len(texts[r.doc_id].encode())


def test_other_columns_stay_and_clashes_are_refused(spark):
    df = spark.createDataFrame([("a b", 1)], "text string, extra int")
    assert pieces.encode(df, PIECE_MODEL).columns == ["text", "extra", "ids", "piece_starts", "piece_ends"]
    with pytest.raises(ValueError, match="ids"):
        pieces.encode(df.withColumnRenamed("extra", "IDS"), PIECE_MODEL)
    assert pieces.encode_digests(df.selectExpr("1L doc_id", "text").limit(0), PIECE_MODEL).count() == 0


def test_no_rows_and_long_texts(spark):
    kind = "doc_id long, text string"
    assert pieces.encode_digests(spark.createDataFrame([], kind), PIECE_MODEL).count() == 0
    long = "Many words, ändern sich nie. " * 20_000
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    row = pieces.encode_digests(spark.createDataFrame([(1, long), (1, long)], kind), PIECE_MODEL).collect()[1]
    assert row.n_tokens == len(library.encode(long))


GROWTH = """
import re, sys
sys.path[:0] = {path!r}
import pyarrow as pa
from leafmill.llm import pieces
from leafmill.llm.batches import text_slices, texts_of

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

codec = pieces.Codec(open({model!r}, "rb").read())
before, most = held(), 0
for n in range(60):
    texts = [" ".join(f"w{{(n * 200 + i) * 50 + k:x}}" for k in range(50)) for i in range(200)]
    for part in text_slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text", getattr(pieces, "SLICE_BYTES", 1 << 20)):
        codec.encode(texts_of(part, "text"))
    most = max(most, held())
print(most - before)
"""


def test_many_words_take_bounded_memory():
    """Four workers and the heap share an executor."""
    code = GROWTH.format(path=sys.path, model=PIECE_MODEL)
    assert float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 95


def test_long_words_are_forgotten_sooner():
    known = WordIds(lambda words: [list(w) for w in words], limit=10)
    for n in range(50):
        word = bytes([n]) * 100
        ids, counts = known.of([word])
        assert ids.tolist() == list(word) and counts.tolist() == [100]
    assert len(known.number) <= 3 and known.used <= 300


def test_another_copy_of_the_model_takes_no_other_codec():
    assert pieces._codec(lambda: bytes(bytearray(MODEL))) is pieces._codec(lambda: bytes(bytearray(MODEL)))


def test_slices_follow_the_number_of_ids():
    lists = pa.array([[1] * 60, None, [], [1] * 60, [1] * 500, [1]], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([lists], ["ids"])
    parts = [p.column(0).to_pylist() for p in size_slices(batch, lists.value_lengths(), 100)]
    assert [x for p in parts for x in p] == lists.to_pylist()
    assert [sum(len(x or []) for x in p) for p in parts] == [60, 60, 501]
    assert not list(size_slices(batch.slice(0, 0), lists.value_lengths().slice(0, 0), 100))


def test_text_and_ids_can_be_left_out(spark):
    df = spark.createDataFrame([(1, "many words", "x"), (2, None, "y"), (3, "", "z"), (4, "ä" * 90, "x")], "id int, text string, more string")
    coded = pieces.encode(df, PIECE_MODEL, keep_text=False)
    assert coded.columns == ["id", "more", "ids", "piece_starts", "piece_ends"]
    found = pieces.decode(coded, PIECE_MODEL, keep_ids=False)
    assert found.columns == ["id", "more", "piece_starts", "piece_ends", "decoded"]
    rows = {r.id: (r.more, r.decoded) for r in found.collect()}
    assert rows == {1: ("x", "many words"), 2: ("y", ""), 3: ("z", ""), 4: ("x", "ä" * 90)}
