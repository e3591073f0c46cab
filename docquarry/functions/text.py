"""String building blocks with the whitespace, rounding and tokenising rules the operators share.

Everything here returns a ``Column`` built from Spark functions, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.rows import let

# The characters that count as whitespace, and the subset that ends a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set by Unicode category: separators, and the control characters among them.
WHITESPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
# The line ends that ordinary text does without.
RARE_LINE_END = r"[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
WORD_CHAR = r"[\p{L}\p{N}_]"


def strip(col: Column) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.trim(col, F.lit(WHITESPACE))


def words(col: Column) -> Column:
    """Whitespace tokens, in order, with no empty ones."""
    return F.array_remove(F.split(col, WHITESPACE_CLASS + "+"), "")


def lines(col: Column) -> Column:
    """Physical lines. A trailing break leaves one blank line, which no caller distinguishes."""
    return let(
        col, lambda text: F.when(text.rlike(RARE_LINE_END), F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))
    )


def word_tokens(col: Column, min_len: int = 1) -> Column:
    """Lower-cased runs of word characters at least ``min_len`` long."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"{WORD_CHAR}{{{min_len},}}"), F.lit(0))


def ascii_terms(col: Column) -> Column:
    """Distinct lower-cased runs of ASCII letters and digits."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(col, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)
    )


def pyround(col: Column, digits: int) -> Column:
    """Round half to even on the binary value: ``rint(x * 10^n) / 10^n``."""
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def cut_at_last_space(col: Column) -> Column:
    """Text before the last blank, or all of it when it has none."""
    return F.regexp_replace(col, r"(?s) [^ ]*\z", "")


def first_line(col: Column) -> Column:
    return F.element_at(F.split(col, LINE_BREAK, 2), 1)


def nonblank(col: Column) -> Column:
    """NULL for NULL, empty or all-whitespace text, else the text itself."""
    return F.when(strip(col) != "", col)
