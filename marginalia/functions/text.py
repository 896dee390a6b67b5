"""Text expressions: comment prose, snippets, trimming. All are JVM-side ``Column`` functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as one character class without and with the line feed.
# \x{...} is read alike by Java's regex and by RE2.
H = r"[\t\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS = H[:1] + r"\n" + H[1:]

# The same characters to trim with: a trim looks at the ends only, a regular expression at every blank.
H_CHARS = "\t\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = "\n" + H_CHARS


def trim_ws(text: Column) -> Column:
    """Trim Unicode white space (SQL ``trim`` only strips blanks)."""
    return F.btrim(text, F.lit(WS_CHARS))


def _without(prefix: str):
    """A step that takes ``prefix`` off a line's start."""
    return lambda line: F.when(line.startswith(prefix), F.substring(line, len(prefix) + 1, 1 << 30)).otherwise(line)


# Applied to each line in order.
COMMENT_STEPS = (
    lambda line: F.ltrim(line, F.lit(H_CHARS)), _without("/**"), _without("/*"), lambda line: F.rtrim(line, F.lit(H_CHARS)),
    lambda line: F.when(line.endswith("*/"), F.substring(line, F.lit(1), F.char_length(line) - 2)).otherwise(line),
    _without("//"), _without("#"), _without("*"), lambda line: F.btrim(line, F.lit(H_CHARS)),
)


def comment_text(comment: Column) -> Column:
    """What a human wrote: comment markers off every line, lines joined with a blank."""
    lines = F.split(comment, "\n", -1)
    for step in COMMENT_STEPS:
        lines = F.transform(lines, step)
    return trim_ws(F.array_join(lines, " "))


def char_count(text: Column) -> Column:
    """Characters, not bytes."""
    return F.char_length(text)


def newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int")


def end_line(line: Column, text: Column) -> Column:
    """Last line a text starting on ``line`` reaches."""
    return line + newlines(text)


def snippet(text: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters, cut with an ellipsis."""
    lines = F.split(trim_ws(F.replace(text, F.lit("\r\n"), F.lit("\n"))), "\n", -1)
    joined = F.array_join(F.transform(lines, lambda line: F.btrim(line, F.lit(H_CHARS))), " ")
    return F.when(F.char_length(joined) <= limit, joined).otherwise(
        F.concat(F.substring(joined, 1, limit - 1), F.lit("…")))


def cap_lines(text: Column, limit: int, marker: Column) -> tuple[Column, Column]:
    """First ``limit`` lines plus a truncation marker, and whether anything was cut (P20)."""
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.slice(lines, 1, limit), "\n")
    cut = F.size(lines) > limit
    return F.when(cut, F.concat(kept, marker)).otherwise(text), F.when(cut, F.octet_length(kept)).otherwise(
        F.octet_length(text))
