"""Finding and removing metadata and active content of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import html as h
from leafmill.functions.text import let
from leafmill.functions.urls import SCHEME
from leafmill.session import durable
from leafmill.sources.tables import with_host, with_page_no

SHOWN_FINDINGS = 10

# What counts as active content.
EVENT = r"on[a-z]+"
ROOTS = ("<html", "<body")
EMBEDDING = ("iframe", "frame", "object", "embed", "applet")
LINKING = ("a", "area", "base")
TARGETS = r"xlink:href|formaction"
GONE = tuple(f"{mark}{name}" for name in (*EMBEDDING, "form") for mark in ("<", "</"))


def scan_metadata(page_table: DataFrame) -> DataFrame:
    """Present metadata fields of each page: ``page_id, field, value``."""
    pieces, metas = F.col("_pieces"), F.col("_metas")

    def first(tags: Column, attribute: str) -> Column:
        """The first value of an attribute on any of the tags."""
        values = F.transform(tags, lambda t: h.value_of(t, attribute))
        return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))

    def named(name: str) -> Column:
        own = F.filter(metas, lambda t: F.lower(h.value_of(t, "name")) == name)
        return h.value_of(F.get(own, F.lit(0)), "content")

    fields = {
        "Title": h.title(pieces),
        "Charset": first(metas, "charset"),
        "Language": h.value_of(h.attributes(F.get(h.tags(pieces, "html"), F.lit(0))), "lang"),
        **{name.title(): named(name) for name in ("description", "author", "keywords", "generator")},
    }
    found = F.array(
        *[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()]
    )
    return (
        page_table.select("page_id", h.markup(F.col("html")).alias("_pieces"))
        .select("page_id", "_pieces", F.transform(h.tags(pieces, "meta"), h.attributes).alias("_metas"))
        .select("page_id", F.inline(F.filter(found, lambda f: f["value"] != "")))
    )


def strip_metadata(page_table: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages without title, meta tags and language; scripts and comments are left alone.

    ``keep`` names further columns to carry along, here and below.
    """

    def cleaned(piece: Column, name: Column) -> Column:
        return (
            F.when(name.isin("<meta", "<title"), F.lit(""))
            .when(name == "<html", h.without_attributes(piece, "lang"))
            .otherwise(piece)
        )

    clean = h.with_markup(F.col("html"), cleaned)
    return page_table.select("page_id", *keep, "html", clean.alias("_clean")).select(
        "page_id",
        *keep,
        (F.col("_clean") != F.col("html")).alias("changed"),
        F.col("_clean").alias("html"),
    )


def _or(text: Column, fallback: str) -> Column:
    return F.when(text == "", F.lit(fallback)).otherwise(text)


def _link_action(href: Column) -> Column:
    """What following a target does; blanks, which browsers drop from it, hide no scheme."""
    href = F.translate(href, "\t\n\r", "")
    scheme = F.lower(F.regexp_extract(href, SCHEME, 1))
    return (
        F.when(scheme == "javascript", F.lit("JavaScript"))
        .when((scheme != "") | href.startswith("//"), F.lit("URI"))
        .otherwise(F.lit("GoTo"))
    )


def _is_refresh(read: Column) -> Column:
    """Whether the attributes of a meta tag make it a refresh."""
    return F.coalesce(F.lower(h.value_of(read, "http-equiv")) == "refresh", F.lit(False))


def page_findings(page_table: DataFrame) -> DataFrame:
    """Findings gathered per page and category: ``page_id, host, category, items``.

    Narrow. The categories are fixed; empty ones give no row. The attributes of a tag are read
    once, and their values decoded.
    """
    opened = F.filter(F.col("_pieces"), lambda p: p.rlike("^<[a-zA-Z]"))
    read = F.transform(opened, lambda p: F.struct(h.name_of(p).alias("name"), h.attributes(p).alias("read")))
    tags = F.col("_tags")

    def named(*names: str) -> Column:
        return F.filter(tags, lambda t: t["name"].isin(*(f"<{n}" for n in names)))

    def value(tag: Column, attribute: str) -> Column:
        return F.coalesce(h.value_of(tag["read"], attribute), F.lit(""))

    def events(of: Column) -> Column:
        """Names of the events that tags handle, without ``on``."""
        names = F.flatten(F.transform(of, lambda t: F.transform(t["read"], lambda a: a["name"])))
        return F.transform(
            F.filter(names, lambda n: n.rlike(f"^{EVENT}$")), lambda n: F.substring(n, F.lit(3), F.length(n))
        )

    def targets(of: Column, attribute: str) -> Column:
        return F.filter(F.transform(of, lambda t: h.value_of(t["read"], attribute)), lambda v: v.isNotNull())

    refresh = F.transform(
        F.filter(named("meta"), lambda t: _is_refresh(t["read"])),
        lambda t: F.when(F.lower(value(t, "content")).contains("url"), F.lit("URI")).otherwise(
            F.lit("Destination (non-action)")
        ),
    )
    links = [targets(named(*LINKING), "href"), *(targets(tags, a) for a in TARGETS.split("|"))]
    categories = {
        "open_action": refresh,
        "doc_aa": events(F.filter(tags, lambda t: t["name"].isin(*ROOTS))),
        "javascript": F.transform(named("script"), lambda t: _or(value(t, "src"), "inline")),
        "embedded_files": F.transform(
            named(*EMBEDDING), lambda t: _or(F.concat(value(t, "src"), value(t, "data")), "unnamed")
        ),
        "page_actions": events(F.filter(tags, lambda t: ~t["name"].isin(*ROOTS))),
        "annot_actions": F.transform(F.concat(*links), _link_action),
        "xfa": F.transform(named("form"), lambda t: F.lit("form")),
    }
    found = F.array(
        *[F.struct(F.lit(k).alias("category"), v.alias("items")) for k, v in categories.items()]
    )
    return (
        with_host(page_table)
        .select("page_id", "host", h.markup(F.col("html")).alias("_pieces"))
        .select("page_id", "host", read.alias("_tags"))
        .select("page_id", "host", F.inline(F.filter(found, lambda f: F.size(f["items"]) > 0)))
    )


def scan_active_content(page_table: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """One row per finding with its page and place within page and category."""
    items = page_findings(page_table).select(
        "page_id", "host", "category", F.posexplode("items").alias("_at", "item")
    )
    return with_page_no(items, page_table, numbers).select(
        "page_id", "host", "page_no", "category", (F.col("_at") + 1).alias("ord"), "item"
    )


def active_content_summary(findings: DataFrame, shown: int = SHOWN_FINDINGS) -> DataFrame:
    """Count, first ``shown`` findings and number of further ones per site and category.

    ``findings`` comes from ``page_findings``. What two branches need of them is kept first, so that
    pages are read once. The first items of a group are among those of its first pages: a rank on
    its own, so that every task gives on no more than the first pages it has. The totals are summed
    up beside it, by task before the shuffle.
    """
    keys = ["host", "category"]
    kept = durable(
        findings.select(*keys, "page_id", F.size("items").alias("_n"), F.slice("items", 1, shown).alias("_first"))
    )
    group = Window.partitionBy(*keys)
    pages = kept.withColumn("_at", F.row_number().over(group.orderBy("page_id"))).filter(F.col("_at") <= shown)
    items = (
        pages.select(*keys, "page_id", F.posexplode("_first").alias("_pos", "item"))
        .withColumn("ord", F.row_number().over(group.orderBy("page_id", "_pos")))
        .filter(F.col("ord") <= shown)
    )
    totals = kept.groupBy(*keys).agg(F.sum("_n").alias("total"))
    return items.join(totals, keys).select(
        *keys, "total", F.greatest(F.col("total") - shown, F.lit(0)).alias("more"), "ord", "item"
    )


def _quiet(piece: Column) -> Column:
    """A piece whose opening tag handles no event and carries no target; the rest of it stays."""

    def changed(tag: Column) -> Column:
        rest = F.substring(piece, F.length(tag) + 1, F.length(piece))
        return F.concat(h.without_attributes(tag, rf"{EVENT}|{TARGETS}"), rest)

    return F.when(piece.rlike("(?is)^<[a-z].*?(?:on|xlink|formaction)"), let(h.opening(piece), changed)).otherwise(piece)


def _is_active(pieces: Column) -> Column:
    """Whether any piece of a page is what ``page_findings`` reports."""
    whole = ("<script", "<form", *(f"<{n}" for n in EMBEDDING))

    def by_attributes(name: Column, read: Column) -> Column:
        links = name.isin(*(f"<{n}" for n in LINKING))
        return F.exists(
            read, lambda a: a["name"].rlike(f"^(?:{EVENT}|{TARGETS})$") | (links & (a["name"] == "href"))
        ) | ((name == "<meta") & _is_refresh(read))

    def active(piece: Column) -> Column:
        return piece.rlike("^<[a-zA-Z]") & let(
            h.name_of(piece), lambda name: name.isin(*whole) | let(h.attributes(piece), lambda read: by_attributes(name, read))
        )

    return F.exists(pieces, active)


def strip_active_content(page_table: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages without anything ``page_findings`` reports; links keep their text.

    A removed part leaves a blank, so that its neighbours cannot join into a new tag; what stays,
    stays as it is.
    """

    def cleaned(piece: Column, name: Column) -> Column:
        refresh = (name == "<meta") & _is_refresh(h.attributes(piece))
        links = name.isin(*(f"<{n}" for n in LINKING))
        return (
            F.when((name == "<script") | name.isin(*GONE) | refresh, F.lit(" "))
            .when(links, h.without_attributes(piece, rf"{EVENT}|{TARGETS}|href"))
            .otherwise(_quiet(piece))
        )

    def result(pieces: Column) -> Column:
        changed = lambda active: F.struct(
            active.alias("changed"),
            F.when(active, h.with_markup(F.col("html"), cleaned, pieces)).otherwise(F.col("html")).alias("html"),
        )
        return let(_is_active(pieces), changed)

    found = page_table.select("page_id", *keep, let(h.markup(F.col("html")), result).alias("_clean"))
    return found.select("page_id", *keep, "_clean.changed", "_clean.html")
