"""Parsing of bank statement cells: header keys, dates, numbers, directions, payment modes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Vocabularies and patterns of the statement format.
INCOME_WORDS = (
    "income", "credit", "cr", "deposit", "inflow", "received", "receipt", "revenue", "sale", "sales",
    "money in", "positive",
)
EXPENSE_WORDS = (
    "expense", "debit", "dr", "withdrawal", "withdraw", "payment", "purchase", "outflow", "spent",
    "money out", "negative",
)
PAYMENT_WORDS = {
    "cash": "Cash", "upi": "UPI", "card": "Card", "credit card": "Card", "debit card": "Card", "bank": "Bank",
    "bank transfer": "Bank", "net banking": "Bank", "other": "Other",
}
DATE_FORMATS = ("d-M-yyyy", "d/M/yyyy", "yyyy/M/d", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "M/d/yyyy")
#: One character of white space of any script; Java's own class knows ASCII only.
BLANK = r"[\s\x1C-\x1F\x85\p{Z}]"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE = r"^\+?[0-9]{7,15}$"
CURRENCY = r"^[A-Z]{3}$"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC form. Spark has no function for it; ASCII text skips the Arrow call's result."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def ascii_header_key(text: Column) -> Column:
    """`header_key` of text known to be in NFKC form already."""
    bare = F.lower(F.regexp_replace(text, "﻿", ""))
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def header_key(text: Column) -> Column:
    """Lower-case words of letters and digits with single blanks between them."""
    return ascii_header_key(nfkc(text))


def collapse(text: Column) -> Column:
    """White space runs to one blank, ends trimmed, empty to NULL."""
    return F.nullif(F.trim(F.regexp_replace(text, BLANK + "+", " ")), F.lit(""))


def clean_text(text: Column) -> Column:
    return collapse(nfkc(text))


def normalize_text(text: Column) -> Column:
    """Trimmed, lower case, single blanks; NULL is empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), BLANK + "+", " ")), F.lit(""))


def normalize_amount(amount: Column) -> Column:
    """Two places, half up, as text."""
    return F.round(amount.cast("decimal(28,8)"), 2).cast("decimal(28,2)").cast("string")


def parse_date(text: Column) -> Column:
    """DATE of a cell; NULL where no accepted form fits.

    A text with dashes after four and seven characters is ISO or nothing; otherwise the
    first format that fits decides, day before month.
    """
    iso = text.rlike(r"^.{4}-.{2}-.*$")
    others = F.coalesce(*[F.try_to_date(text, form) for form in DATE_FORMATS])
    return F.when(iso, F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")).otherwise(others)


def parse_number(text: Column) -> Column:
    """DECIMAL(38,6) of a cell; NULL where it is no amount.

    Parentheses negate, currency words and signs go, and of comma and point the last one is
    the decimal mark when both stand and at most two digits follow a comma; a lone comma is
    one when exactly two digits follow it.
    """
    dashes = F.regexp_replace(text, "[−–]", "-")
    negative = dashes.startswith("(") & dashes.endswith(")")
    bare = F.when(negative, F.regexp_replace(dashes, r"^\((.*)\)$", "$1")).otherwise(dashes)
    bare = F.regexp_replace(bare, r"(?i)inr|usd|eur|gbp|rs\.?", "")
    bare = F.regexp_replace(bare, r"[₹$€£¥₩\s]", "")
    tail = F.char_length(F.substring_index(bare, ",", -1))
    both = bare.contains(",") & bare.contains(".")
    comma_last = F.char_length(F.substring_index(bare, ",", -1)) < F.char_length(F.substring_index(bare, ".", -1))
    lone = (F.char_length(F.regexp_replace(bare, "[^,]", "")) == 1) & (tail == 2)
    number = (
        F.when(both & comma_last & (tail <= 2), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(bare, F.lit(","), F.lit("")))
        .when(lone, F.replace(bare, F.lit(","), F.lit(".")))
        .otherwise(F.replace(bare, F.lit(","), F.lit("")))
    )
    value = F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), number.try_cast("decimal(38,6)"))
    return F.when(negative, -value).otherwise(value)


def to_minor(number: Column, is_minor: Column, signed: bool = False) -> Column:
    """Minor units of a parsed number; NULL where a fraction of one would be left (invalid precision)."""
    size = number if signed else F.abs(number)
    scaled = F.when(is_minor, size).otherwise(size * 100)
    return F.when(scaled == F.floor(scaled), scaled.try_cast("decimal(20,0)").try_cast("long"))


def direction_of_key(key: Column) -> Column:
    return F.when(key.isin(*INCOME_WORDS), "income").when(key.isin(*EXPENSE_WORDS), "expense")


def direction(text: Column) -> Column:
    """income, expense, or NULL for a word of neither vocabulary."""
    return direction_of_key(header_key(text))


def payment_mode_of(cleaned: Column) -> Column:
    """`payment_mode` of a text that is clean already."""
    known = F.create_map(*[F.lit(x) for pair in PAYMENT_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ascii_header_key(cleaned)), cleaned)


def payment_mode(text: Column) -> Column:
    """Cash, UPI, Card, Bank or Other for known words; other text is kept."""
    return payment_mode_of(clean_text(text))


def with_nfkc_cells(rows: DataFrame, name: str = "cells") -> DataFrame:
    """`rows` with the texts of an array column in NFKC form; only rows with text beyond ASCII go through Python.

    The rows are read twice, once for each part, so they should be stored.
    """
    odd = F.exists(name, lambda c: F.coalesce(c.rlike(r"[^\x00-\x7F]"), F.lit(False)))
    plain = F.transform(name, lambda c: F.coalesce(c, F.lit("")))
    return rows.filter(~odd).withColumn(name, plain).unionByName(rows.filter(odd).withColumn(name, nfkc_cells(F.col(name))))


def nfkc_cells(cells: Column) -> Column:
    """NFKC form of every text of an array, in one call for the row."""
    apart = "\x1f"
    bare = F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(apart), F.lit(" ")))
    return F.split(nfkc(F.array_join(bare, apart)), apart)
