"""Text, number and date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[filled(t) for t in texts])


def prefix(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def preview(text: Column, size: int) -> Column:
    """The first `size` characters, with dots where something was cut."""
    return F.when(F.length(text) > size, F.concat(prefix(text, size), F.lit("..."))).otherwise(text)


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z0-9]", "")


def alphanumeric_words(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z0-9\s]", "")


def hyphenated(text: Column, size: int = 30) -> Column:
    """Cleared of special characters, spaces as hyphens, cut."""
    return prefix(F.replace(alphanumeric_words(text), F.lit(" "), F.lit("-")), size)


def compacted(text: Column, size: int = 30) -> Column:
    """Cleared of special characters and of spaces, cut."""
    return prefix(F.replace(alphanumeric_words(text), F.lit(" "), F.lit("")), size)


def words(text: Column, min_chars: int = 1) -> Column:
    """The words of at least that many characters."""
    return F.regexp_extract_all(text, F.lit(rf"\S{{{min_chars},}}"), F.lit(0))


def first_words(text: Column, n: int, min_chars: int = 1) -> Column:
    return F.array_join(F.slice(words(text, min_chars), 1, n), " ")


def without(text: Column, part: Column) -> Column:
    """Every occurrence of `part` removed, case kept in mind."""
    return F.replace(text, part, F.lit(""))


def capitalized(text: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def first_integer(text: Column) -> Column:
    """The first run of digits as a number; 0 where there is none."""
    digits = F.nullif(F.regexp_extract(text, r"([0-9]+)", 1), F.lit(""))
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def price(text: Column) -> Column:
    """The first amount in a price text such as `$3,400` or `US $225.00`; null where there is none."""
    digits = F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.nullif(F.replace(digits, F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def magnitude(text: Column) -> Column:
    """The number in a count text such as `(1.3K)`, `2005 Reviews` or `98.3% positive`."""
    pattern = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s?([kKmM]?)(?:[^a-zA-Z]|$)"
    bare = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
    digits = first_filled(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, bare, 1))
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    scale = F.when(unit == "k", F.lit(1e3)).when(unit == "m", F.lit(1e6)).otherwise(F.lit(1.0))
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double") * scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where whole is 0 or null."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def tokens(text: Column, chars_per_token: int = 4) -> Column:
    """Token estimate: characters, floor-divided."""
    return F.floor(F.length(text) / F.lit(chars_per_token)).cast("bigint")


def kilobytes(text: Column) -> Column:
    """Characters / 1024."""
    return F.length(text) / F.lit(1024.0)


def stem(path: Column) -> Column:
    """File name without directories and without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def minute_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmm")


def second_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def iso_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def listing_date(text: Column, report_year: Column) -> Column:
    """A listing date such as `Dec-26 23:22` or `12/17`, completed by the year of the report."""
    month_name = F.try_to_timestamp(F.concat(report_year, F.lit("-"), text), F.lit("yyyy-MMM-d HH:mm"))
    month_number = F.try_to_timestamp(F.concat(report_year, F.lit("/"), text), F.lit("yyyy/M/d"))
    script_text = F.regexp_extract(text, r"^[A-Z][a-z]{2} ([A-Z][a-z]{2} [0-9]{2} [0-9]{4} [0-9:]{8})", 1)
    script_date = F.try_to_timestamp(filled(script_text), F.lit("MMM dd yyyy HH:mm:ss"))
    return F.coalesce(month_name, month_number, script_date)
