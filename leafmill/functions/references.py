"""Character references of HTML: decimal, hexadecimal and named, decoded in one pass.

The text is cut at everything that looks like a reference, each piece is decoded on its own, and what
it gives is not read again. Names come from the table of the standard library, as browsers know them;
names known without a semicolon are also found at the beginning of a longer one.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import let

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
UNKNOWN = "�"
LAST = 0x10FFFF
KEY_END, VALUE_END = "\x1e", "\x1f"


def _names() -> str:
    """Every name with its characters, the long-known names first, as a map is searched from the front."""
    order = sorted(html5, key=lambda n: (n.rstrip(";") not in name2codepoint, n))
    return VALUE_END.join(f"{n}{KEY_END}{html5[n]}" for n in order)


def _beginnings() -> str:
    """Names that need no semicolon, longest first."""
    names = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "^&(" + "|".join(names) + ")"


def _controls() -> str:
    """The characters for the numbers 0x80 to 0x9F: those of Windows 1252, where it has them."""

    def one(code: int) -> str:
        try:
            return bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(code)

    return "".join(map(one, range(0x80, 0xA0)))


NAMES, BEGINNINGS, CONTROLS = _names(), _beginnings(), _controls()
# numbers that stand for no character, but for the last two of every plane
NO_CHARACTER = "[\x01-\x08\x0b\x0e-\x1f\x7f\ufdd0-\ufdef]"


def _character(code: Column) -> Column:
    """The character of a number, as browsers read it; empty for numbers that are no characters."""

    none = code.between(0xD800, 0xDFFF) | (code > LAST)

    def read(raw: Column) -> Column:
        gone = raw.rlike(NO_CHARACTER) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
        return (
            F.when(code.between(0x80, 0x9F), F.substring(F.lit(CONTROLS), (code - 0x7F).cast("int"), F.lit(1)))
            .when((code == 0) | none, F.lit(UNKNOWN))
            .when(gone, F.lit(""))
            .otherwise(raw)
        )

    return let(F.decode(F.unhex(F.lpad(F.hex(F.when(none, 0).otherwise(code)), 8, "0")), "UTF-32"), read)


def _number(piece: Column) -> Column:
    is_hex = F.lower(F.substring(piece, 3, 1)) == "x"

    def read(digits: Column) -> Column:
        code = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        return F.when(F.length(digits) > 9, F.lit(UNKNOWN)).otherwise(let(code, _character))

    return let(F.concat(F.lit("0"), F.regexp_replace(F.lower(piece), "^&#x?0*|;$", "")), read)


def _name(piece: Column) -> Column:
    def named(names: Column) -> Column:
        def begun(name: Column) -> Column:
            rest = F.substring(piece, F.length(name) + 2, F.length(piece))
            return F.when(name == "", piece).otherwise(F.concat(F.try_element_at(names, name), rest))

        known = F.try_element_at(names, F.substring(piece, F.lit(2), F.length(piece)))
        return F.coalesce(known, let(F.regexp_extract(piece, BEGINNINGS, 1), begun))

    return named(F.str_to_map(F.lit(NAMES), F.lit(VALUE_END), F.lit(KEY_END)))


def decode(text: Column) -> Column:
    """``text`` with its character references resolved; NULL stays NULL."""

    def one(piece: Column) -> Column:
        return F.when(piece.startswith("&#"), _number(piece)).otherwise(_name(piece))

    def decoded(whole: Column) -> Column:
        found = F.transform(F.regexp_extract_all(whole, F.lit(REFERENCE), F.lit(0)), one)
        parts = F.zip_with(F.split(whole, REFERENCE), found, lambda t, c: F.concat(t, F.coalesce(c, F.lit(""))))
        return F.when(F.contains(whole, F.lit("&")), F.array_join(parts, "")).otherwise(whole)

    return let(text, decoded)
