"""Text functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed set of white space: space, tab, line feed, vertical tab, carriage return, form feed.
BLANKS = " \t\n\x0b\r\f"


def tokens(text: Column, delimiters: str) -> Column:
    """Parts between any of the delimiters; empty ones vanish."""
    return F.filter(F.split(text, "[" + re.sub(r"([\\\]\[^-])", r"\\\1", delimiters) + "]+"), lambda x: x != "")


def six_decimals(x: Column) -> Column:
    """A float with six decimals as C's %.6f has it: its exact value, halves to the even digit.

    A million times a float is exact in a double. Java's own format rounds halves up.
    """
    y = x.cast("double")
    size = F.abs(y)
    millions = F.rint(size * 1_000_000).cast("long")
    below = (millions - millions % 1_000_000) / 1_000_000
    digits = F.when(size < 9e9, F.format_string("%d.%06d", below.cast("long"), millions % 1_000_000))
    digits = digits.when(size < 9e18, F.concat(size.cast("long").cast("string"), F.lit(".000000")))  # a whole number
    digits = digits.when(F.isnan(y), "nan").when(size == float("inf"), "inf").otherwise(F.format_string("%.6f", size))
    return F.when(x.isNotNull(), F.concat(F.when(y.cast("string").startswith("-"), "-").otherwise(""), digits))


def trim_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^['\"]+|['\"]+$", "")


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def concat_delimited(a: Column, b: Column, delimiter: str) -> Column:
    """a, delimiter, b; where one is null or empty, the other alone."""
    return F.array_join(F.filter(F.array(a, b), lambda x: x.isNotNull() & (x != "")), delimiter)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def attach_extension(name: Column, extension: str) -> Column:
    return F.concat(name, F.lit("."), F.lit(extension))


def attach_path(path: str, name: Column) -> Column:
    return F.concat(F.lit(path.rstrip("/") + "/"), name)


def to_radix(value: Column, radix: int) -> Column:
    """Digits of a number in a radix up to 16; nothing for negative numbers."""
    return F.when(value < 0, "").otherwise(F.lower(F.conv(value.cast("string"), 10, radix)))


def occurrences(text: Column, pattern: Column) -> Column:
    """0-based positions of a pattern, overlapping ones too."""
    room = F.length(text) - F.length(pattern)
    places = F.when((room < 0) | (F.length(pattern) == 0), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), room))
    return F.filter(places, lambda p: F.substr(text, p + 1, F.length(pattern)) == pattern)


def array_occurrences(letters: Column, pattern: list[int]) -> Column:
    """The same of a pattern in an array of letters."""
    n = F.size(letters) - len(pattern)
    places = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda p: F.slice(letters, p + 1, len(pattern)) == F.array(*map(F.lit, pattern)))


def good_suffix(pattern: Column) -> Column:
    """For each place j from 0 to its length the shift of a pattern whose letters from j on matched and the one before didn't.

    That is the least shift at which the matched letters, as far as they still lie over the pattern, meet equal ones,
    and the letter before them another one; at place 0, where all matched, the pattern's period.
    """
    n = F.length(pattern)
    at = lambda i: F.substr(pattern, i + 1, F.lit(1))

    def fits(j: Column, k: Column) -> Column:
        low = F.greatest(j, k)
        same = F.forall(F.when(low < n, F.sequence(low, n - 1)).otherwise(F.array().cast("array<int>")), lambda i: at(i - k) == at(i))
        return same & ((j == 0) | (k >= j) | (at(j - 1 - k) != at(j - 1)))

    return F.transform(F.sequence(F.lit(0), n), lambda j: F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: fits(j, k))))


def printed_sequence(url: Column, alphabet: Column, letters: Column, columns: int = 80) -> Column:
    """Two headed lines, then rows of numbers set to the right, each row after the place of its first.

    A number's width is the longest one's and a blank; a row has as many as fit `columns` with a blank more each.
    """
    texts = F.transform(letters, lambda x: x.cast("string"))
    width = F.array_max(F.transform(texts, F.length)) + 1
    count = F.greatest(F.lit(1), F.floor(F.lit(columns) / (width + 1)).cast("int"))
    row = lambda i: F.concat(F.lit("\n"), F.lpad(i.cast("string"), 5, " "), F.lit("\t"), F.array_join(F.transform(F.slice(texts, i + 1, count), lambda t: F.lpad(t, width, " ")), ""))
    rows = F.when(F.size(letters) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size(letters) - 1, count), row), "")).otherwise("")
    return F.concat(F.lit(">"), url, F.lit("\n>"), alphabet, F.lit("\n"), rows)


def picture(places: Column, length: Column, width: int = 20) -> Column:
    """A bar of '-' with '*' at the places, scaled to min(width, length) characters."""
    n = F.least(F.lit(width), length)
    marks = F.transform(places, lambda p: F.floor(p * n / length).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.array_contains(marks, i), "*").otherwise("-")), "")


def printed_alignment(a: list[int], b: list[int], cells: list[int], columns: int = 80) -> str:
    """Two rows of numbers at a time, of a and what is aligned with it in b, a dash for nothing.

    cells are a traceback's: places from 1 in a and b, from the end to the start, one after another. Each row begins
    with the place of its first number, that of b with the place that is aligned next.
    """
    width = max(len(str(x)) for x in [*a, *b, 0]) + 1
    count = max(1, columns // (width + 1))
    partner: dict[int, int] = {}
    ahead = [*zip(cells[::2], cells[1::2])][::-1]
    for i, j in ahead:
        partner.setdefault(i - 1, j)
    out = []
    for start in range(0, len(a), count):
        upcoming = next((j for i, j in ahead if i - 1 >= start), ahead[-1][1] if ahead else 0)
        places = range(start, min(start + count, len(a)))
        top = "".join(str(a[i]).rjust(width) for i in places)
        below = "".join(str(b[partner[i] - 1] if i in partner else "-").rjust(width) for i in places)
        out.append(f"{start:5d}\t{top}\n{upcoming:5d}\t{below}\n")
    return "\n".join(out)
