"""Plain text columns: white space, words, lines, pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when text is split into words.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as patterns, all of them and those other than blank and newline. The few
# beyond Latin-1 sit behind one range test, so an ordinary character is refused quickly.
WIDE_SPACE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
SPACE = rf"[\t-\r\x1c-\x20\x85\xa0{WIDE_SPACE}]+"
ONLY_SPACE = rf"\A[\t-\r\x1c-\x20\x85\xa0{WIDE_SPACE}]*+\z"
RARE_SPACE = rf"[\t\x0b-\r\x1c-\x1f\x85\xa0{WIDE_SPACE}]"


# Characters of a text among which its frequent ones are looked for first.
COMMON_PREFIX = 48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda that refers to an outer expression evaluates it again for every element, so
    ``transform(sequence(..), k -> slice(split(text), k))`` splits the text once per page.
    Binding the value as a lambda variable keeps such expressions linear in the text.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove white space at both ends (``trim`` alone removes only blanks)."""
    return F.trim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """Nothing but white space; decided at the first other character."""
    return F.coalesce(text, F.lit("")).rlike(ONLY_SPACE)


def word_count(text: Column) -> Column:
    """Runs of characters other than white space.

    Most text has only blanks and newlines, which a plain split handles without the pattern.
    """
    plain = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(
        text.rlike(RARE_SPACE), F.size(F.array_remove(F.split(text, SPACE), ""))
    ).otherwise(F.size(F.array_remove(F.split(plain, " "), "")))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_count(text: Column) -> Column:
    """Lines of a text; an empty text is one empty line."""
    text = F.coalesce(text, F.lit(""))
    rest = F.replace(text, F.lit("\n"), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest) + 1


def kilobytes(size: Column) -> Column:
    return size / F.lit(1024.0)


def saved_percent(before: Column, after: Column) -> Column:
    """Share of ``before`` that is gone, in percent; 0 when there was nothing before."""
    return F.when(before == 0, F.lit(0.0)).otherwise((before - after) / before * 100.0)


def pages_of(text: Column, lines_per_page: int) -> Column:
    """Array of page texts, ``lines_per_page`` lines each."""
    return let(
        lines(text),
        lambda all_lines: F.transform(
            F.sequence(
                F.lit(0),
                F.floor((F.size(all_lines) - 1) / F.lit(lines_per_page)).cast("int"),
            ),
            lambda k: F.array_join(
                F.slice(all_lines, k * lines_per_page + 1, F.lit(lines_per_page)), "\n"
            ),
        ),
    )


def _longest_run_sorted(text: Column) -> Column:
    """Count of the most frequent character by sorting: equal characters become one run."""
    runs = F.regexp_extract_all(
        F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0)
    )
    return F.array_max(F.transform(runs, F.length))


def largest_char_share(text: Column) -> Column:
    """Share of the most frequent character; 1.0 for an empty text.

    The text stays one value in its row; no row per character is ever made. The characters of a
    short prefix are removed one after the other, those most frequent in it first, and what each
    removal takes away is its count. The rest is soon no longer than the best count and cannot beat
    it: then no more are looked at. Only where it stays longer, the rest is sorted to find its own most
    frequent character.
    """

    def remove(state: Column, char: Column) -> Column:
        less = let(
            F.replace(state["rest"], char, F.lit("")),
            lambda rest: F.struct(
                rest.alias("rest"),
                F.greatest(state["best"], F.length(state["rest"]) - F.length(rest)).alias("best"),
            ),
        )
        return F.when(F.length(state["rest"]) > state["best"], less).otherwise(state)

    def in_turn(prefix: Column) -> Column:
        without = lambda c: F.length(F.replace(prefix, c, F.lit("")))
        ranked = F.transform(F.array_distinct(F.split(prefix, "")), lambda c: F.struct(without(c).alias("left"), c.alias("char")))
        return F.transform(F.sort_array(ranked), lambda r: r["char"])

    prefix_chars = let(F.left(text, F.lit(COMMON_PREFIX)), in_turn)
    start = F.struct(text.alias("rest"), F.lit(0).alias("best"))
    most = let(
        F.aggregate(prefix_chars, start, remove),
        lambda end: F.when(
            F.length(end["rest"]) > end["best"],
            F.greatest(end["best"], _longest_run_sorted(end["rest"])),
        ).otherwise(end["best"]),
    )
    return F.when(F.length(text) > 0, most / F.length(text)).otherwise(F.lit(1.0))


def has_dominant_char(text: Column, share: float) -> Column:
    """Whether one character makes up at least ``share`` of ``text``; true for an empty text.

    All but ``1 - share`` of the text is then that character, so it must show up in a prefix one
    longer than that, and only the few characters of the prefix need counting.
    """
    n = F.length(text)
    prefix = F.left(text, F.floor(n * (1 - share)).cast("int") + 2)
    count = lambda c: n - F.length(F.replace(text, c, F.lit("")))
    return F.when(
        n > 0,
        F.exists(F.array_distinct(F.split(prefix, "")), lambda c: count(c) / n >= share),
    ).otherwise(F.lit(True))
