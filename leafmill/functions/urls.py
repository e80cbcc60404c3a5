"""URL columns: host, reference resolution, kind of a link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import let

# The parts of a URL as in RFC 3986.
SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
NO_FRAGMENT = r"^([^#]*)"
NO_QUERY = r"^([^?#]*)"
DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path; only paths that have them pay for it."""
    segments = F.split(path, "/")
    none = F.array().cast("array<string>")

    def step(kept: Column, s: Column) -> Column:
        return (
            F.when(s == ".", kept)
            .when(
                s == "..",
                F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))),
            )
            .otherwise(F.array_append(kept, s))
        )

    closed = F.when(path.rlike(r"(?:^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.aggregate(
        segments, none, step, lambda kept: F.concat(F.array_join(kept, "/"), closed)
    )
    return F.when(path.rlike(DOT_SEGMENT), joined).otherwise(path)


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` as found on the page at ``base``."""
    origin = F.regexp_extract(base, ORIGIN, 1)
    path = F.regexp_extract(base, PATH, 1)
    ref_path = F.regexp_extract(ref, NO_QUERY, 1)
    ref_rest = F.substring(ref, F.length(ref_path) + 1, F.length(ref))
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(ref.rlike(SCHEME), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, SCHEME, 0), ref))
        .when(ref.startswith("/"), F.concat(origin, _remove_dots(ref_path), ref_rest))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, NO_FRAGMENT, 1), ref))
        .when(ref.startswith("?"), F.concat(F.regexp_extract(base, NO_QUERY, 1), ref))
        .otherwise(F.concat(origin, _remove_dots(F.concat(folder, ref_path)), ref_rest))
    )


def link_kind(base: Column, ref: Column) -> Column:
    """``external``, ``internal``, ``anchor``, ``script`` or ``mail``."""
    scheme = F.lower(F.regexp_extract(ref, SCHEME, 1))
    return (
        F.when(ref.startswith("#"), F.lit("anchor"))
        .when(scheme == "javascript", F.lit("script"))
        .when(scheme == "mailto", F.lit("mail"))
        .when(
            ref.startswith("//"),
            let(
                host_of(F.concat(F.lit("http:"), ref)),
                lambda h: F.when(h == host_of(base), "internal").otherwise("external"),
            ),
        )
        .when(scheme == "", F.lit("internal"))
        .when(scheme.isin("http", "https") & (host_of(ref) == host_of(base)), F.lit("internal"))
        .otherwise(F.lit("external"))
    )
