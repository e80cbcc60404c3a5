"""SentencePiece encoding with the byte span of every piece, and decoding.

A text is normalised by the model's compiled character map: at every position the longest key of
the map wins and is replaced, all else is copied. Every byte of the normalised text knows the byte
of the source where its segment began, so that each piece is projected to the source.

Cutting into pieces is left to the library, on a copy of the model whose own normalisation is
switched off. Where no piece of the vocabulary has a word mark after another character, no merge
crosses a word, and words are encoded apart and remembered.

Defined results: null and empty texts have no pieces and decode to the empty text; other columns
are kept, and a clash with the new columns is refused; repeated rows stay; texts of any length are
read whole, in slices of words; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.batches import WordIds, give_back, lists, shared_bytes, size_slices, text_slices, texts_of

MARK = "▁"
# Field numbers of the model file (ModelProto, its pieces and its normaliser).
PIECE_FIELD, NORMALIZER_FIELD = 1, 3
PIECE_TEXT, PIECE_TYPE = 1, 3
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
USER_DEFINED, BYTE = 4, 6
UNKNOWN_TYPE = 2
# What a worker holds at once, beside one text: words it knows, bytes of text it cuts, ids it decodes.
# An executor runs two workers per task, and each comes to hold the words when it is used again.
KEPT_WORDS = 200_000
SLICE_BYTES, SLICE_IDS = 1 << 18, 1 << 16


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """Fields of a protocol buffer message: number, value, and the bytes of the whole field."""
    at = 0
    while at < len(data):
        begin = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value, data[begin:at]


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double-array trie and its replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if size else []
        self.replacements = blob[4 + size :] if blob else b""
        # first bytes at which any key can begin
        self.heads = frozenset(b for b in range(256) if self.units and self._step(self._root(), b) is not None)

    def __bool__(self) -> bool:
        return bool(self.units)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _step(self, node: int, byte: int) -> tuple[int, int] | None:
        """Node under ``byte``: its own place, and the base of its children."""
        at = node ^ byte
        if at >= len(self.units) or (self.units[at] & 0x800000FF) != byte:
            return None
        return at, at ^ self._offset(self.units[at])

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """End of the longest key that begins at ``at``, and its replacement."""
        found, node = None, self._root()
        for i in range(at, len(data)):
            step = self._step(node, data[i])
            if step is None:
                break
            place, node = step
            if self.units[place] >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1, self.replacements[value : self.replacements.index(b"\0", value)]
        return found


def _width(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        rules = next((v for n, v, _ in fields(model) if n == NORMALIZER_FIELD), b"")
        flags = {n: v for n, v, _ in fields(rules)}
        self.map = CharacterMap(flags.get(CHARSMAP, b""))
        self.prefix, self.squeeze, self.escape = (bool(flags.get(k, 1)) for k in (DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE))
        plain = b"".join(raw for n, _, raw in fields(model) if n != NORMALIZER_FIELD)
        off = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
        self.cutter = sentencepiece.SentencePieceProcessor()
        self.cutter.LoadFromSerializedProto(plain + bytes([NORMALIZER_FIELD << 3 | 2, len(off)]) + off)
        self.decoder = sentencepiece.SentencePieceProcessor()
        self.decoder.LoadFromSerializedProto(model)
        pieces = [{n: v for n, v, _ in fields(v)} for n, v, _ in fields(model) if n == PIECE_FIELD]
        kinds = [p.get(PIECE_TYPE, 1) for p in pieces]
        if USER_DEFINED in kinds:
            raise ValueError("models with user-defined symbols are not supported")
        self.width = np.array([1 if k == BYTE else len(p[PIECE_TEXT]) for k, p in zip(kinds, pieces, strict=True)])
        # without byte fallback an unknown run has no fixed width, so its text must be looked at
        self.unknown = -1 if BYTE in kinds else kinds.index(UNKNOWN_TYPE)
        mark = MARK.encode()
        apart = self.escape and not any(mark in p[PIECE_TEXT][1:].lstrip(mark) and p[PIECE_TEXT].lstrip(mark).find(mark) >= 0 for p in pieces)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if apart else r"(?s).+").findall
        # with a mark before every word, words are known without their first mark
        self.marked = apart and self.prefix and not self.squeeze
        # where no piece holds a line feed, nothing merges across one
        self.lines = self.marked and not any(b"\n" in p[PIECE_TEXT] for p in pieces)
        self.known = WordIds(lambda words: self.cutter.encode(list(map(self._whole, words)), num_threads=1), limit=KEPT_WORDS)

    def _whole(self, word: str) -> str:
        return word if not self.marked or self.lines and word[:1] == "\n" else MARK + word

    def words(self, text: str, normal: str) -> list[str]:
        """Stretches of a normalised text that no merge crosses."""
        if self.marked and not self.map and MARK not in text and "  " not in text and text[:1] not in ("", " "):
            if not self.lines:
                return text.split(" ")
            if " \n" not in text:
                return text.replace("\n", " \n").split(" ")
        found = self.cut(normal)
        if not self.marked:
            return found
        if not self.lines:
            return [w[1:] for w in found]
        return [x for w in found for x in (("", w[1:]) if w[1:2] == "\n" else (w[1:],))]

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes and its end the source byte it stems from."""
        source = text.encode("utf-8", "surrogatepass")
        if not source:
            return "", np.zeros(1, np.int64)
        if self.map or self.squeeze:
            return self._by_map(source)
        raw = np.frombuffer(source, np.uint8)
        wide = (raw == 32) * 2 if self.escape else np.zeros(len(raw), np.int64)
        lead = (3 if self.escape else 1) if self.prefix else 0
        starts = np.zeros(lead + int(wide.sum()) + len(raw) + 1, np.int64)
        starts[lead:-1] = np.repeat(np.arange(len(raw)), wide + 1)
        starts[-1] = len(raw)
        mark = MARK if self.escape else " "
        return (mark if self.prefix else "") + (text.replace(" ", MARK) if self.escape else text), starts

    def _by_map(self, source: bytes) -> tuple[str, np.ndarray]:
        segments = []
        at, heads = 0, self.map.heads
        while at < len(source):
            hit = self.map.longest(source, at) if source[at] in heads else None
            end, to = hit or (at + _width(source[at]), source[at : at + _width(source[at])])
            segments.append((at, end, to))
            at = end
        if self.squeeze:
            while segments and segments[0][2] == b" ":
                segments.pop(0)
        out, starts = [], []
        mark = MARK.encode() if self.escape else b" "

        def put(data: bytes, origin: int) -> None:
            out.append(data)
            starts.extend([origin] * len(data))

        if segments and self.prefix:
            put(mark, segments[0][0])
        after_space = self.squeeze
        for begin, _, to in segments:
            if after_space:
                to = to.lstrip(b" ")
            if to:
                after_space = self.squeeze and to.endswith(b" ")
                put(to.replace(b" ", mark), begin)
        data, end = b"".join(out), len(source)
        if self.squeeze:
            while data.endswith(mark):
                end = starts[len(data) - len(mark)]
                data = data[: -len(mark)]
        return data.decode("utf-8", "surrogatepass"), np.array([*starts[: len(data)], end], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, source byte spans (start, end) of all texts, and the number of ids of each text."""
        words, sizes, aligned = [], [], []
        for text in texts:
            normal, starts = self.normalise(text)
            found = self.words(text, normal)
            words += found
            sizes.append(len(found))
            aligned.append(starts)
        ids, per_word = self.known.of(words)
        ends_of_words = np.concatenate([[0], np.cumsum(per_word)])
        per_text = np.diff(ends_of_words[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])])
        width = self.width[ids]
        if self.unknown >= 0 and (ids == self.unknown).any():
            self._widen(words, ids, per_word, width)
        # places of the piece ends in the alignments of all texts, laid one after the other
        shift = np.cumsum([0, *(len(a) for a in aligned)])[:-1]
        through = np.cumsum(width)
        first = np.concatenate([[0], np.cumsum(per_text)])[:-1]
        before = np.concatenate([[0], through])[first]
        stop = through - np.repeat(before, per_text) + np.repeat(shift, per_text)
        source = np.concatenate(aligned) if aligned else np.zeros(0, np.int64)
        return ids, source[stop - width], source[stop], per_text

    def _widen(self, words: list[str], ids: np.ndarray, per_word: np.ndarray, width: np.ndarray) -> None:
        at = 0
        for word, n in zip(words, per_word, strict=True):
            if (ids[at : at + n] == self.unknown).any():
                spans = self.cutter.encode(self._whole(word), out_type="immutable_proto").pieces
                width[at : at + n] = [len(p.surface.encode()) for p in spans]
            at += n

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode(ids) if ids else ""


def _with_columns(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    if clash := {f.name.lower() for f in schema.fields} & {k.lower() for k in kinds}:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in kinds.items())])


def _without(schema: T.StructType, columns: list[str], gone: str | None) -> tuple[T.StructType, list[int]]:
    """``schema`` without ``gone``, and the places of the other ``columns``."""
    places = [i for i, c in enumerate(columns) if c != gone]
    return T.StructType([schema.fields[i] for i in [*places, *range(len(columns), len(schema.fields))]]), places


def _codec(model: Callable[[], bytes], kept: dict = {}) -> Codec:  # noqa: B006  one per worker process
    data = model()
    if kept.get("data") != data:  # not one more codec for another broadcast of the same model
        kept.clear()
        kept.update(data=data, codec=Codec(data))
    return kept["codec"]


def encode(df: DataFrame, model_path: str, text: str = "text", piece_ids: str = "ids",
           starts: str = "piece_starts", ends: str = "piece_ends", keep_text: bool = True) -> DataFrame:
    """Adds the piece ids of ``text`` and the bytes of the source that each piece covers.

    Span i is ``[starts[i], ends[i])`` in UTF-8; spans follow each other and cover the text but for
    what normalisation removes. Ids equal the library's, without begin and end ids or sampling.
    Without ``keep_text`` the text itself is not returned.
    """
    model = shared_bytes(df.sparkSession, model_path)
    numbers = T.ArrayType(T.IntegerType(), False)
    schema = _with_columns(df.schema, **{piece_ids: numbers, starts: numbers, ends: numbers})
    schema, kept = _without(schema, df.columns, None if keep_text else text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for part in text_slices(batch, text, SLICE_BYTES):
                ids, begin, end, counts = codec.encode(texts_of(part, text))
                new = [lists(x.astype(np.int32), counts, pa.int32()) for x in (ids, begin, end)]
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), *new], names=schema.names)
            give_back()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, piece_ids: str = "ids", text: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Adds the text of ``piece_ids``; null and no ids give the empty text.

    Without ``keep_ids`` the ids themselves are not returned.
    """
    model = shared_bytes(df.sparkSession, model_path)
    schema, kept = _without(_with_columns(df.schema, **{text: T.StringType()}), df.columns, None if keep_ids else piece_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for part in size_slices(batch, pc.list_value_length(batch.column(piece_ids)), SLICE_IDS):
                found = [codec.decode(x or []) for x in part.column(piece_ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(found, pa.string())], names=schema.names)
            give_back()

    return df.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes`` of every whole text.

    ``span_bytes`` is the number of source bytes that the pieces cover.
    """
    coded = encode(docs.select("doc_id", "text"), model_path, keep_text=False).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.aggregate(
            F.zip_with("piece_ends", "piece_starts", lambda b, a: (b - a).cast("long")),
            F.lit(0).cast("long"),
            lambda x, y: x + y,
        ).alias("span_bytes"),
    )
    return decode(coded, model_path, keep_ids=False).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "span_bytes"
    )
