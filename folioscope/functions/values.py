"""Tolerant parsing and normalising of registry text."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal text as a spreadsheet would accept it; suffixes such as "12d" and words such as "nan"
# that a plain cast lets through are refused.
NUMERIC_TEXT = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*\z"
BLANKS = " \t\n\r\x0b\x0c"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, so that NaN never compares as the largest number."""
    return F.when(F.abs(c) <= sys.float_info.max, c)


def parsed_number(c: Column) -> Column:
    """Number of a text, NULL where it is none; ``c`` occurs once. Too many digits give an infinity."""
    return F.regexp_extract(c.cast("string"), NUMERIC_TEXT, 1).try_cast("double")


def number_or_null(c: Column) -> Column:
    return finite(parsed_number(c))


def money_text(c: Column) -> Column:
    return F.replace(c.cast("string"), F.lit(","), F.lit(""))


def money_or_null(c: Column) -> Column:
    return number_or_null(money_text(c))


def whole(number: Column) -> Column:
    """Integer of a number that is one."""
    return F.when((number == F.floor(number)) & (F.abs(number) < 2**31), number).cast("int")


def whole_or_null(c: Column) -> Column:
    return whole(number_or_null(c))


def flag_or_null(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text == "1", 1).when(text == "0", 0)


def upper_text(c: Column) -> Column:
    return F.upper(stripped(c))


def category_or_null(c: Column) -> Column:
    return F.nullif(upper_text(c), F.lit("NONE"))


def text_or_null(c: Column) -> Column:
    text = upper_text(c)
    return F.when(~text.isin("NAN", "NONE", ""), text)


def in_range_or_null(c: Column, low, high) -> Column:
    return F.when(c.between(low, high), c)


def clamped_or_null(c: Column, low, high) -> Column:
    return F.when(c >= low, F.least(c, F.lit(high).cast("double")))


def day_or_null(c: Column, pattern: str = "dd/MM/yyyy") -> Column:
    return F.try_to_date(c, pattern)


def sanitised(c: Column) -> Column:
    """ASCII letters, digits and single blanks only, in upper case."""
    kept = F.regexp_replace(c, r"[^A-Za-z0-9\s]", "")
    return F.upper(F.trim(F.regexp_replace(kept, r"\s+", " ")))


def display_money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def is_cadastral_number(c: Column) -> Column:
    return F.coalesce(F.upper(c).rlike(r"^[A-Z0-9]{20,35}$"), F.lit(False))


def is_folio_number(c: Column) -> Column:
    return F.coalesce(F.upper(c).rlike(r"^[A-Z0-9]+-\d+$"), F.lit(False))


def code_of(c: Column, codes: dict[str, float]) -> Column:
    """Number of a known word, 0 for any other."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(0.0))


def messages(*rules: tuple[Column, Column]) -> Column:
    """Array of the texts whose condition holds; an unknown condition does not."""
    found = F.array(*[F.when(F.coalesce(holds, F.lit(False)), text) for holds, text in rules])
    return F.filter(found, lambda m: m.isNotNull())


def truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def as_int(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def stable_number(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the text of the parts alone, in any engine."""
    text = F.concat_ws("|", *[c.cast("string") for c in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
