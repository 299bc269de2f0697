"""Exact money arithmetic on integer minor units, and labels of periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def total(amount: Column) -> Column:
    """Sum of minor units without overflow; NULL over no rows."""
    return F.sum(amount.cast("decimal(20,0)")).cast(WIDE)


def whole(amount: Column) -> Column:
    """A sum as BIGINT, for results."""
    return amount.cast("long")


def hundredths(n: Column, d: Column, scale: int = 100) -> Column:
    """scale * n / d with two places, half up and away from zero, from integers; NULL where d is 0 or NULL."""
    n, d = n.cast(WIDE), d.cast(WIDE)
    steps = F.call_function("div", F.abs(n) * F.lit(200 * scale) + F.abs(d), F.lit(2) * F.abs(d))
    value = F.sign(n).cast("int") * F.sign(d).cast("int") * steps
    return F.when(d != 0, (value.cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,2)"))


def pct(n: Column, d: Column) -> Column:
    """n as a percentage of d; NULL on a zero denominator."""
    return hundredths(n, d)


def pct0(n: Column, d: Column) -> Column:
    """n as a percentage of d; 0.00 on a zero or missing denominator."""
    return F.coalesce(hundredths(n, d), F.lit(0).cast("decimal(18,2)"))


def ratio0(n: Column, d: Column) -> Column:
    """n / d with two places; 0.00 on a zero or missing denominator."""
    return F.coalesce(hundredths(n, d, 1), F.lit(0).cast("decimal(18,2)"))


def signed_change(now: Column, before: Column) -> Column:
    """Change from `before` to `now` in percent of `before`; 0.00 without one."""
    return pct0(now.cast(WIDE) - before.cast(WIDE), before)


def iso_week(day: Column) -> Column:
    """`2026-W01`; the year is that of the week."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def minor_units(major: Column) -> Column:
    """Major units (decimal) to minor; NULL where more than two places would be lost."""
    scaled = major.cast("decimal(28,8)") * 100
    return F.when(scaled == F.floor(scaled), scaled.cast("long"))


def major_units(minor: Column) -> Column:
    return (minor.cast("decimal(20,0)") / F.lit(100)).cast("decimal(20,2)")


def masked_identifier(text: Column) -> Column:
    """Up to four characters stay; longer ones show the last four."""
    return F.when(F.char_length(text) <= 4, text).otherwise(F.concat(F.lit("****"), F.right(text, F.lit(4))))


def format_minor(currency: Column, minor: Column) -> Column:
    """`INR 1,234.50`; a dash for NULL."""
    return F.coalesce(F.concat(currency, F.lit(" "), F.format_number(major_units(minor), 2)), F.lit("—"))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)
