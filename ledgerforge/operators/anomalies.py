"""Anomaly detectors N1-N17; each gives rows of one schema, joined by `detect`.

`metric_value` and `threshold` are decimals; where a detector measures nothing of its own,
the metric is the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import pct0, total
from .analytics import UNCATEGORIZED
from .health import last_two_months
from .scope import KEYS

NUMBER = "decimal(38,6)"
# Second names of anomaly types, and severities.
ALIASES = {
    "unusually_large_income": "large_transaction",
    "unusually_large_expense": "large_transaction",
    "sudden_income_drop": "income_drop",
    "negative_cash_flow_period": "negative_cash_flow",
    "unexpected_payment_mode": "payment_mode_change",
    "repeated_identical_transactions": "duplicate_pattern",
    "very_high_recurring_expenses": "recurring_expense_growth",
}
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def _rows(df: DataFrame, kind, severity: str, date, trigger: str, threshold, metric=None, keys=KEYS, amount=None, category=None) -> DataFrame:
    text = lambda c: c if isinstance(c, Column) else F.lit(c)
    limit = text(threshold).cast(NUMBER)
    return df.select(
        *keys,
        text(kind).alias("type"),
        F.lit(severity).alias("severity"),
        text(date).cast("string").alias("date_detected"),
        F.lit(trigger).alias("trigger_metric"),
        (limit if metric is None else metric.cast(NUMBER)).alias("metric_value"),
        limit.alias("threshold"),
        text(amount).cast("long").alias("affected_amount_minor"),
        text(category).cast("string").alias("affected_category"),
    )


def large_transactions(tx: DataFrame, keys=KEYS) -> DataFrame:
    """Amounts above twice the mean of their direction, compared exactly.

    Means are aggregated and joined back, so a large account is never one window.
    """
    means = tx.groupBy(*keys, "direction").agg(total(F.col("amount_minor")).alias("_sum"), F.count("*").alias("_n"))
    hit = tx.join(means, [*keys, "direction"]).filter(F.col("amount_minor").cast("decimal(20,0)") * F.col("_n") > F.col("_sum") * 2)
    threshold = (F.col("_sum").cast("decimal(24,0)") * 2 / F.col("_n")).cast(NUMBER)
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit(UNCATEGORIZED))
    return _rows(hit, F.concat(F.lit("unusually_large_"), F.col("direction")), "High", F.col("transaction_date"), "amount_minor", threshold, keys=keys, amount=F.col("amount_minor"), category=category)


def repeated_identical(tx: DataFrame, keys=KEYS) -> DataFrame:
    """Groups of two or more equal rows, shown by the first in the order of dates and amounts as text."""
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit(UNCATEGORIZED))
    mode = F.coalesce(F.nullif("payment_mode", F.lit("")), F.lit("Other"))
    groups = tx.groupBy(*keys, "amount_minor", "direction", category.alias("category"), mode.alias("payment_mode")).agg(
        F.count("*").alias("_n"), F.min("transaction_date").alias("_first")
    )
    return _rows(groups.filter("_n >= 2"), "repeated_identical_transactions", "Medium", F.col("_first"), "identical_transaction_count", 2, keys=keys, amount=F.col("amount_minor"), category=F.col("category"))


def month_changes(monthly: DataFrame, keys=KEYS) -> DataFrame:
    """The last observed month against the one before it."""
    two = last_two_months(monthly, keys)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    spent = (F.col("previous_expense_minor") > 0, wide("expense_minor") * 2, wide("previous_expense_minor"))
    earned = (F.col("previous_income_minor") > 0, wide("income_minor") * 2, wide("previous_income_minor"))
    parts = [
        _rows(two.filter(spent[0] & (spent[1] >= spent[2] * 3)), "sudden_expense_spike", "High", F.col("period"), "monthly_expense_growth", 50, keys=keys),
        _rows(two.filter(spent[0] & (spent[1] >= spent[2] * 4)), "expense_explosion", "Critical", F.col("period"), "monthly_expense_growth", 100, keys=keys),
        _rows(two.filter(earned[0] & (earned[1] <= earned[2])), "sudden_income_drop", "High", F.col("period"), "monthly_income_change", -50, keys=keys),
        _rows(two.filter(earned[0] & (F.col("income_minor") == 0)), "income_interruption", "Critical", F.col("period"), "monthly_income_minor", 0, keys=keys),
    ]
    return _union(parts)


def metric_alarms(metrics: DataFrame, keys=KEYS) -> DataFrame:
    """Ratio above 1, stability below 50 where there are rows, recurring burden above 50."""
    ratio, stability = F.col("expense_to_income_ratio"), F.col("cash_flow_stability")
    parts = [
        _rows(metrics.filter(ratio > 1), "high_expense_ratio", "HIGH", None, "expense_to_income_ratio", 1, ratio, keys),
        _rows(metrics.filter((stability < 50) & (F.col("transaction_count") > 0)), "cash_flow_instability", "HIGH", None, "cash_flow_stability", 50, stability, keys),
        _rows(metrics.filter(F.col("recurring_expense_burden") > 50), "very_high_recurring_expenses", "High", None, "recurring_expense_burden", 50, keys=keys),
    ]
    return _union(parts)


def inactive_periods(daily: DataFrame, keys=KEYS) -> DataFrame:
    """Days that follow a gap of more than a week."""
    day = F.col("period").cast("date")
    gaps = daily.withColumn("_before", F.lag(day).over(Window.partitionBy(*keys).orderBy("period")))
    return _rows(gaps.filter(F.datediff(day, F.col("_before")) > 7), "inactive_period", "Low", F.col("period"), "inactive_days", 7, keys=keys)


def negative_days(daily: DataFrame, keys=KEYS) -> DataFrame:
    """Days whose net is below zero."""
    return _rows(daily.filter("net_cash_flow_minor < 0"), "negative_cash_flow_period", "Medium", F.col("period"), "net_cash_flow_minor", 0, keys=keys)


def category_spikes(cat_months: DataFrame, keys=KEYS) -> DataFrame:
    """Categories whose last observed month cost at least half more than the one before."""
    by_month = Window.partitionBy(*keys, "category").orderBy("month")
    newest = Window.partitionBy(*keys, "category").orderBy(F.col("month").desc())
    two = cat_months.withColumns({"_before": F.lag("expense_minor").over(by_month), "_nth": F.row_number().over(newest)})
    hit = two.filter((F.col("_nth") == 1) & (F.col("_before") > 0) & (F.col("expense_minor") * 2 >= F.col("_before") * 3))
    row = {"amount": F.col("last_row.amount_minor"), "category": F.col("category"), "keys": keys}
    growth = pct0(F.col("expense_minor") - F.col("_before"), F.col("_before"))
    return _union(
        [
            _rows(hit, "category_spike", "High", F.col("month"), "category_monthly_growth", 50, **row),
            _rows(hit, "recurring_expense_growth", "HIGH", F.col("month"), "recurring_expense_growth", 50, growth, **row),
        ]
    )


def unexpected_modes(modes: DataFrame, keys=KEYS) -> DataFrame:
    """Modes used once where all modes together were used at least three times."""
    everything = F.sum("count").over(Window.partitionBy(*keys))
    hit = modes.withColumn("_all", everything).filter((F.col("_all") >= 3) & (F.col("count") == 1))
    return _rows(hit, "unexpected_payment_mode", "Medium", None, "payment_mode_count", 1, keys=keys)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def normal_severity(severity: Column) -> Column:
    """LOW to CRITICAL, MEDIUM for anything else."""
    upper = F.upper(severity)
    return F.when(upper.isin(*SEVERITIES), upper).otherwise(F.lit("MEDIUM"))


def finalize(found: DataFrame) -> DataFrame:
    """Severities made uniform (but for the expense spike), and a second row under the newer name.

    One pass: each row becomes an array of itself and its alias.
    """
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    alias = F.try_element_at(names, F.col("type"))
    own = F.when(F.col("type") == "sudden_expense_spike", F.col("severity")).otherwise(normal_severity(F.col("severity")))
    both = F.array_compact(
        F.array(
            F.struct(F.col("type"), own.alias("severity")),
            F.when(alias.isNotNull(), F.struct(alias.alias("type"), normal_severity(F.col("severity")).alias("severity"))),
        )
    )
    rest = [c for c in found.columns if c not in ("type", "severity")]
    return found.withColumn("_as", F.explode(both)).select(*[c for c in found.columns if c in KEYS], F.col("_as.type").alias("type"), F.col("_as.severity").alias("severity"), *[c for c in rest if c not in KEYS])


def detect(tx: DataFrame, daily: DataFrame, monthly: DataFrame, cat_months: DataFrame, modes: DataFrame, metrics: DataFrame, keys=KEYS) -> DataFrame:
    """Every detector's rows, finalized."""
    return finalize(
        _union(
            [
                large_transactions(tx, keys), repeated_identical(tx, keys), month_changes(monthly, keys), metric_alarms(metrics, keys),
                inactive_periods(daily, keys), negative_days(daily, keys), category_spikes(cat_months, keys), unexpected_modes(modes, keys),
            ]
        )
    )


def ordered(anomalies: DataFrame) -> DataFrame:
    """By date (none first), type and severity."""
    return anomalies.orderBy(F.coalesce("date_detected", F.lit("")), "type", "severity")
