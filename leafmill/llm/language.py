"""Language identification by fusing evidence about a text, its markup, its address and its host.

The posterior of a language is the product of: the likelihood of the text under hashed byte
trigrams; the chance of the declared language given it; the chance of the address suffix given it;
and the prior of its host, smoothed towards the host's suffix, which is smoothed towards all texts.
Trigrams of a text depend on each other, so that its likelihood counts as ``EFFECTIVE`` trigrams at
most. Confusions and priors are grouped sums of the texts' own posteriors; a text is left out of
the priors of its host.

Text models are trained on all texts with a declared language, one for every declaration that at least
``LEAST`` texts share, however many there are: a model takes ``SLOTS`` numbers. Rarer declarations, too
few to learn from, have one model together, whose texts are ``OTHER`` and not kept, instead of going
to one of the modelled languages. A further class competes with the same evidence, ``OTHER``: an even
mixture, trigram by trigram, of all these texts together and of uniform bytes, which fits texts in no
modelled language and texts that are no language better than any one language does. A text is kept if
its language has a posterior of ``SURE`` or more and is wanted; ``OTHER`` is never wanted.

Evidence is fused in batches, whose cost is that of one pass over the languages per text. Joins on
hosts and declarations are cut into slices where one of them owns many texts.

Defined results: null and empty texts, and texts under three bytes, have no text evidence and go by
the rest; texts of any length are read whole; null or unknown declarations, suffixes and hosts are no
evidence; of equal posteriors the language first in order wins; repeated rows count and stay; without
any declaration the language is null and nothing is kept; other columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.html import attribute_value, markup, tags, visible_text
from leafmill.functions.urls import host_of
from leafmill.llm.batches import bytes_of, lists, text_slices, written
from leafmill.plans.scale import spread_join

#: Texts that share a declaration before it has a model of its own.
LEAST = 5
#: Languages whose counts a task holds at a time.
HELD = 64
SLOTS = 1 << 15
EFFECTIVE = 150
SURE = 0.5
OTHER = "und"  # undetermined: none of the modelled languages
HOST_STRENGTH, SUFFIX_STRENGTH = 20.0, 200.0


def slots(text: bytes) -> np.ndarray:
    """Slot of every byte trigram of a text, A-Z in lower case."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(17)).astype(np.int64)


def train(texts: DataFrame, languages: list[str]) -> np.ndarray:
    """Log likelihood of every slot under each language, all rarer ones and ``OTHER``: ``SLOTS`` x
    (languages + 2).

    ``texts`` has ``text`` and ``declared``; the driver gets one row per language.
    """
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for language, own in sums.items():
                slot = np.flatnonzero(own)
                each = pa.array(np.full(len(slot), language, np.int32))
                yield pa.RecordBatch.from_arrays([each, pa.array(slot.astype(np.int32)), pa.array(own[slot])], names=["language", "slot", "n"])
            sums.clear()

        for batch in batches:
            for part in text_slices(batch, "text"):
                for text, declared in zip(bytes_of(part, "text"), part.column("declared").to_pylist(), strict=True):
                    if declared is not None and declared != OTHER:
                        at, language = slots(text), number.get(declared, len(number))
                        if language not in sums:
                            if len(sums) == HELD:
                                yield from out()
                            sums[language] = np.zeros(SLOTS, np.int64)
                        if len(at) > 4096:
                            sums[language] += np.bincount(at, minlength=SLOTS)
                        else:
                            np.add.at(sums[language], at, 1)
        yield from out()

    def dense(group: pa.Table) -> pa.Table:
        counts = np.zeros(SLOTS)
        counts[group.column("slot").to_numpy()] = group.column("n").to_numpy()
        return pa.table({"language": group.column("language").slice(0, 1).cast(pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    rows = texts.select("text", "declared").mapInArrow(run, "language int, slot int, n bigint").groupBy("language", "slot").agg(F.sum("n").alias("n"))
    counts = np.full((SLOTS, len(languages) + 1), 0.5)
    for r in rows.groupBy("language").applyInArrow(dense, "language int, counts binary").toLocalIterator():
        counts[:, r.language] += np.frombuffer(r.counts)
    together = counts.sum(axis=1)
    other = (together / together.sum() + 1 / SLOTS) / 2
    return np.log(np.column_stack([counts / counts.sum(axis=0), other])).astype(np.float32)


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def evidence(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """``rows`` without ``text`` but with ``fit``, the tempered log likelihood of each language, and
    ``share``, the posteriors by it alone."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest) + ", fit array<double>, share array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = np.zeros((part.num_rows, table.shape[1]))
                for i, text in enumerate(bytes_of(part, "text")):
                    at = slots(text)
                    if len(at):
                        found[i] = table[at].sum(axis=0, dtype=np.float64) * min(1.0, EFFECTIVE / len(at))
                wide = np.full(len(found), table.shape[1])
                both = (lists(x.ravel(), wide, pa.float64()) for x in (found, softmax(found)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *both], names=[*rest, "fit", "share"])

    return rows.mapInArrow(run, schema)


def _sums(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Summed shares of each language by ``key`` and the number of rows; null keys are left out."""
    sums = [F.sum(F.col("share")[i]).alias(f"_{i}") for i in range(n)]
    grouped = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*sums, F.count(F.lit(1)).alias("_rows"))
    return grouped.select(key, F.array(*(f"_{i}" for i in range(n))).alias(name), "_rows")


def _with_sums(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """``rows`` with what belongs to their key; a key of many rows is met in slices."""
    name = next(c for c in sums.columns if c not in (key, "_rows"))
    none = F.lit(None).cast(sums.schema[name].dataType).alias(name)
    rest = rows.filter(F.col(key).isNull()).select("*", none)
    spread = spread_join(rows.filter(F.col(key).isNotNull()), sums.withColumnRenamed("_rows", "_many"), [key], ["id", "fit"], rows="_many")
    return spread.select(*rows.columns, name).unionByName(rest)


def _matrix(column: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column, zero where null, and which are not null."""
    held = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(held), n))
    out[held] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out, held


def fused(rows: DataFrame, world: np.ndarray) -> DataFrame:
    """``id, declared, best, posterior`` from all evidence of ``rows``; ``world`` are the summed shares.

    In batches, so that a filter on the result cannot take it apart.
    """
    n = len(world)
    prior, schema = world / world.sum(), f"id {rows.schema['id'].dataType.simpleString()}, declared string, best int, posterior double"

    def shrunk(sums: pa.ListArray, own: np.ndarray, above: np.ndarray, strength: float) -> np.ndarray:
        others, held = _matrix(sums, n)
        others = np.maximum(others - own * held[:, None], 0.0)
        return (others + strength * above) / (others.sum(axis=1, keepdims=True) + strength)

    def chance(sums: pa.ListArray) -> np.ndarray:
        values, held = _matrix(sums, n)
        return np.where(held[:, None], np.log((values + 0.5) / (world + 1)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fit, own = (_matrix(batch.column(c), n)[0] for c in ("fit", "share"))
                by_suffix = shrunk(batch.column("suffix_sum"), own, prior, SUFFIX_STRENGTH)
                by_host = shrunk(batch.column("host_sum"), own, by_suffix, HOST_STRENGTH)
                scores = np.log(by_host) + fit + chance(batch.column("declared_sum")) + chance(batch.column("suffix_sum"))
                found = softmax(scores)
                best = found.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("declared"), pa.array(best.astype(np.int32)), pa.array(found[np.arange(len(best)), best])],
                    names=["id", "declared", "best", "posterior"],
                )

    return rows.select("id", "declared", "fit", "share", "declared_sum", "suffix_sum", "host_sum").mapInArrow(run, schema)


def identify(rows: DataFrame, wanted: list[str] | None = None, sure: float = SURE, training: DataFrame | None = None) -> DataFrame:
    """``id, declared, language, posterior, kept`` of ``rows`` with ``id, text, declared, host, suffix``.

    ``wanted`` names the languages to keep, by default every modelled one.
    Text models come from ``training`` (``text, declared``), by default from ``rows``.
    """
    training = rows if training is None else training
    common = training.filter(F.col("declared") != OTHER).groupBy("declared").count().filter(F.col("count") >= LEAST).collect()
    languages = sorted(r.declared for r in common)
    n = len(languages) + 2
    if not languages:
        return rows.select("id", "declared", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("kept"))
    known = written(evidence(rows.select("id", "declared", "host", "suffix", "text"), train(training, languages)), "text-evidence")
    total = known.agg(*(F.sum(F.col("share")[i]).alias(f"_{i}") for i in range(n))).first()
    world = np.array([v or 0.0 for v in total]) + 1.0
    joined = known
    for key in ("declared", "suffix", "host"):
        joined = _with_sums(joined, written(_sums(known, key, n, key + "_sum"), key + "-sums"), key)
    best = fused(joined, world)
    names = F.array(*map(F.lit, [*languages, OTHER, OTHER]))
    language = F.get(names, F.col("best"))
    accepted = language.isin([x for x in (languages if wanted is None else wanted) if x != OTHER])
    return best.select("id", "declared", language.alias("language"), "posterior", (accepted & (F.col("posterior") >= sure)).alias("kept"))


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence columns of ``documents``: the declared ``lang``, the source as host, no suffix."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.lower("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence columns of web pages: ``lang`` of the markup, host and last label of the address."""
    host = host_of(F.col("url"))
    lang = attribute_value(F.get(tags(markup(F.col("html")), "html"), F.lit(0)), "lang")
    return pages.select(
        F.col("page_id").alias("id"), visible_text(F.col("html")).alias("text"),
        F.nullif(F.lower(F.regexp_extract(lang, "^([a-zA-Z]{2,3})(?![a-zA-Z])", 1)), F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"),
    )
