"""Conversations of any layout as canonical turns, and as marked text with a loss mask.

A layout is recognised by its fingerprint: the hash of the nested field paths it has, out of all
paths that the known layouts use. The fingerprint selects a declarative mapping to canonical turns
``array<struct<role, text>>``. Tables are recognised by their schema, JSON records row by row. A
table that has all fields of one row per turn is read so whatever else it has; a table of any
other unknown layout is refused.

Everything is built-in expressions. Defined results: null texts and roles are empty; repeated
rows are turns of their own, ordered by turn, role and text; null conversation ids form one
conversation; records of an unknown layout keep their row, with layout ``unknown`` and null
turns, and formatted they give null texts, as do conversations without turns; texts of any length are kept whole; other columns of a
table are ignored, whatever their names; an empty table gives no conversation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks of the format, none of which can occur in an escaped text.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Starts of control strings of common chat formats; the character after the group
# gets a backslash before it.
CONTROL = r"(\\|(?<=<)(?:\||/?s>)|(?<=\[)/?INST\]|(?<=<)</?SYS>>|(?<=\|)>)"
ESCAPED = r"(?s)\\(.)"
# Role names of common formats.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and where its parts are; ``list`` is the array of turns."""

    name: str
    paths: tuple[str, ...]
    list: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, str], ...] = ()


#: One row per turn.
TURN_ROWS = Layout("turn rows", ("conv_id", "role", "text", "turn"), role="role", text="text")
RECORDS = (
    Layout("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Layout("from-value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("prompt-completion", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt-response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("question-answer", ("answer", "question"), turns=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction-output", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction-input-output", ("input", "instruction", "output"), turns=(("user", "instruction+input"), ("assistant", "output"))),
)
SYSTEM = "system"
CONVERSATION = "conv_id"
KNOWN_PATHS = tuple(sorted({p for x in RECORDS for p in x.paths} | {SYSTEM}))


#: Paths that tables of the known layouts use.
TABLE_PATHS = {*KNOWN_PATHS, *TURN_ROWS.paths}


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves of a schema; ``[]`` marks the elements of an array."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def _hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def fingerprint_of(paths: tuple[str, ...] | list[str]) -> Column:
    return _hash(F.array(*map(F.lit, paths)) if paths else F.array().cast("array<string>"))


def hash_of(paths: tuple[str, ...] | list[str]) -> int:
    """Value of ``fingerprint_of(paths)``, without a job."""
    value = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), seed=42)
    return value - (1 << 64) if value >> 63 else value


def _table_layouts() -> dict[int, tuple[Layout, bool]]:
    """Layout, and whether it has a system text, by the fingerprint of a table."""
    known = {hash_of(TURN_ROWS.paths): (TURN_ROWS, False)}
    for layout in RECORDS:
        known[hash_of((*layout.paths, CONVERSATION))] = layout, False
        known[hash_of((*layout.paths, CONVERSATION, SYSTEM))] = layout, True
    return known


def table_layout(schema: T.StructType) -> tuple[Layout, bool]:
    """Layout that the fingerprint of a table's schema selects, and whether it has a system text."""
    paths = field_paths(schema)
    known = _table_layouts()
    for used in ([p for p in paths if p in TABLE_PATHS], [p for p in paths if p in TURN_ROWS.paths]):
        if hash_of(used) in known:
            return known[hash_of(used)]
    raise ValueError(f"no mapping for the fields {paths}")


def _present(record: Column, path: str) -> Column:
    """Whether a record has a field, in any element where the path leads through an array."""
    if "[]." in path:
        array, field = path.split("[].")
        elements = F.try_variant_get(record, "$." + array, "array<variant>")
        return F.exists(elements, lambda x: F.try_variant_get(x, "$." + field, "variant").isNotNull())
    return F.try_variant_get(record, "$." + path, "variant").isNotNull()


def record_fingerprint(record: Column) -> Column:
    """Fingerprint of a JSON record, as a variant: the hash of the known paths that it has."""
    present = F.array(*(F.when(_present(record, p), F.lit(p)) for p in KNOWN_PATHS))
    return _hash(F.filter(present, lambda p: p.isNotNull()))


def _turn(role: Column, text: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    names = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    return F.struct(F.coalesce(names[role], role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _record_turns(layout: Layout, record: Column) -> Column:
    def get(path: str) -> Column:
        parts = [F.try_variant_get(record, "$." + p, "string") for p in path.split("+")]
        return F.concat_ws("\n", *parts) if len(parts) > 1 else parts[0]

    if layout.list:
        found = F.try_variant_get(record, "$." + layout.list, f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
        return F.transform(found, lambda x: _turn(x[layout.role], x[layout.text]))
    return F.array(*(_turn(F.lit(role), get(path)) for role, path in layout.turns))


def canonical_records(df: DataFrame, record: str, conv_id: str = "conv_id") -> DataFrame:
    """``conv_id, fingerprint, layout, turns`` of JSON records in any of the known layouts."""
    parsed = df.select(F.col(conv_id).alias("conv_id"), F.try_parse_json(F.col(record)).alias("_record"))
    v = F.col("_record")
    marked = parsed.withColumn("fingerprint", record_fingerprint(v))
    name, turns = F.lit("unknown"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in RECORDS:
        for system in (False, True):
            paths = tuple(sorted((*layout.paths, SYSTEM))) if system else layout.paths
            own = _record_turns(layout, v)
            if system:
                own = F.concat(F.array(_turn(F.lit(SYSTEM), F.try_variant_get(v, "$." + SYSTEM, "string"))), own)
            hit = F.col("fingerprint") == fingerprint_of(paths)
            name, turns = F.when(hit, F.lit(layout.name)).otherwise(name), F.when(hit, own).otherwise(turns)
    return marked.select("conv_id", "fingerprint", name.alias("layout"), turns.alias("turns"))


def canonical_rows(table: DataFrame) -> DataFrame:
    """``conv_id, turn, t``: canonical turns of a table, by the mapping its fingerprint selects.

    ``t`` is null in the only row of a conversation without turns.
    """
    layout, system = table_layout(table.schema)
    if layout is TURN_ROWS:
        return table.select(F.col(CONVERSATION), F.col("turn"), _turn(F.col(layout.role), F.col(layout.text)).alias("t"))

    def get(path: str) -> Column:
        parts = [F.col(p).cast("string") for p in path.split("+")]
        return F.concat_ws("\n", *parts) if len(parts) > 1 else parts[0]

    if layout.list:
        turns = F.transform(layout.list, lambda x: _turn(x[layout.role].cast("string"), x[layout.text].cast("string")))
    else:
        turns = F.array(*(_turn(F.lit(role), get(path)) for role, path in layout.turns))
    if system:
        turns = F.concat(F.array(_turn(F.lit(SYSTEM), get(SYSTEM))), turns)
    return table.select(CONVERSATION, F.posexplode_outer(turns).alias("turn", "t"))


def escape(text: Column) -> Column:
    """``text`` with a backslash inside every control string; ``unescape`` gives it back."""
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


def _marked(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """Parts of a marked turn: before the text, the text, after it."""
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT)), escape(text), F.lit(END)


def format_rows(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` of canonical rows; without turns both are null.

    ``loss_spans`` holds ``start`` (code points before it) and ``length`` of the texts of the role
    ``learn`` in ``formatted``. A conversation becomes one value, so its rows meet in one task;
    nothing else does.
    """
    lead, body, tail = _marked(F.col("t.role"), F.col("t.text"))
    order = ["turn", "t.role", "t.text"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.select("conv_id", "turn", "t", lead.alias("lead"), body.alias("body"), tail.alias("tail"))
        .withColumn("size", F.length("lead") + F.length("body") + F.length("tail"))
        .withColumn("at", F.coalesce(F.sum(F.col("size").cast("long")).over(before), F.lit(0).cast("long")))
    )
    span = F.struct((F.col("at") + F.length("lead")).alias("start"), F.length("body").cast("long").alias("length"))
    parts = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("at", F.concat("lead", "body", "tail").alias("marked"))))).alias("parts"),
        F.array_sort(F.collect_list(F.when(F.col("t.role") == learn, span))).alias("loss_spans"),
    )
    some = F.size("parts") > 0
    return parts.select(
        "conv_id", F.when(some, F.array_join(F.transform("parts", lambda p: p.marked), "")).alias("formatted"), F.when(some, F.col("loss_spans")).alias("loss_spans")
    )


def format_turn_rows(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` of a table in any of the known layouts."""
    return format_rows(canonical_rows(rows), learn)


def format_records(canonical: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` of canonical turns; null turns stay null."""
    return format_rows(canonical.select("conv_id", F.posexplode_outer("turns").alias("turn", "t")), learn)


def read_back(formatted: Column) -> Column:
    """Turns ``array<struct<role, text>>`` out of marked text."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        cut = F.split(F.regexp_replace(part, r"<\|end\|>$", ""), r"<\|text\|>")
        return F.struct(unescape(cut[0]).alias("role"), unescape(cut[1]).alias("text"))

    return F.transform(parts, turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    texts = F.transform(spans, lambda s: unescape(F.substring(formatted, s.start.cast("int") + 1, s.length.cast("int"))))
    return F.array_join(texts, "")


def conversation_digests(*tables: DataFrame) -> DataFrame:
    """Digests of what can be read back from the formatted conversations of tables, each in its layout."""
    out = format_rows(reduce(DataFrame.unionByName, map(canonical_rows, tables))).select(
        "conv_id", "formatted",
        read_back(F.col("formatted")).alias("turns"),
        under_mask(F.col("formatted"), F.col("loss_spans")).alias("learned"),
    )
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
