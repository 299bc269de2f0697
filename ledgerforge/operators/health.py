"""Health metrics and the score: H1-H11, from the small tables of `analytics`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import WIDE, month, pct0, ratio0, signed_change, total
from .analytics import UNCATEGORIZED
from .scope import KEYS


def last_two_months(monthly: DataFrame, keys=KEYS) -> DataFrame:
    """The last observed month of each account beside the observed month before it."""
    by_month = Window.partitionBy(*keys).orderBy("period")
    newest = Window.partitionBy(*keys).orderBy(F.col("period").desc())
    rows = monthly.select(
        *keys, "period", "income_minor", "expense_minor",
        F.lag("income_minor").over(by_month).alias("previous_income_minor"),
        F.lag("expense_minor").over(by_month).alias("previous_expense_minor"),
        F.row_number().over(newest).alias("_nth"),
    )
    return rows.filter("_nth = 1").drop("_nth")


def category_months(tx: DataFrame, keys=KEYS) -> DataFrame:
    """Expense of each (category, month), with the fields of its last row in the text order of amounts."""
    expense = tx.filter(F.col("direction") == "expense").withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit(UNCATEGORIZED)))
    order = F.struct("transaction_date", F.col("amount_minor").cast("string"), F.coalesce("payment_mode", F.lit("")))
    row = F.struct("transaction_date", "amount_minor", "payment_mode")
    return expense.groupBy(*keys, "category", month(F.col("transaction_date")).alias("month")).agg(
        total(F.col("amount_minor")).alias("expense_minor"), F.max_by(row, order).alias("last_row")
    )


def health_metrics(figures: DataFrame, daily: DataFrame, monthly: DataFrame, categories: DataFrame, cat_months: DataFrame, keys=KEYS) -> DataFrame:
    """One row for each account of `figures`; accounts without rows score 0.

    Stability counts observed days. A missing savings rate counts as 0, and changes are
    against the previous month that has rows.
    """
    K = list(keys)
    days = daily.groupBy(*K).agg(F.count("*").alias("days"), F.count_if(F.col("net_cash_flow_minor") >= 0).alias("calm_days"))
    largest = categories.groupBy(*K).agg(
        total(F.col("amount_minor")).alias("all_minor"), F.max("amount_minor").alias("top_minor"),
        F.max("expense_minor").alias("top_expense_minor"), F.max("income_minor").alias("top_income_minor"),
    )
    by_category = cat_months.groupBy(*K, "category").agg(F.sum("expense_minor").alias("spent"), F.countDistinct("month").alias("months"))
    recurring = by_category.groupBy(*K).agg(F.sum(F.when(F.col("months") >= 2, F.col("spent"))).cast(WIDE).alias("recurring_minor"))
    months = last_two_months(monthly, keys)
    joined = figures
    for part in (days, largest, recurring, months):
        joined = joined.join(part, K, "left")
    zero = F.lit(0)
    income, expense = F.col("total_income_minor"), F.col("total_expense_minor")
    now_in, before_in = F.coalesce("income_minor", income), F.coalesce("previous_income_minor", zero)
    now_out, before_out = F.coalesce("expense_minor", expense), F.coalesce("previous_expense_minor", zero)
    none = F.lit(0).cast("decimal(18,2)")
    metrics = joined.select(
        *K,
        pct0(F.col("calm_days"), F.col("days")).alias("cash_flow_stability"),
        signed_change(now_in, before_in).alias("income_trend"),
        signed_change(now_out, before_out).alias("expense_trend"),
        ratio0(expense, income).alias("expense_to_income_ratio"),
        ratio0(income, expense).alias("income_ratio"),
        F.coalesce("savings_rate", none).alias("savings_rate"),
        pct0(F.coalesce("recurring_minor", zero), expense).alias("recurring_expense_burden"),
        pct0(F.col("top_minor"), F.col("all_minor")).alias("category_concentration"),
        pct0(F.col("top_expense_minor"), expense).alias("largest_expense_percentage"),
        pct0(F.col("top_income_minor"), income).alias("largest_income_percentage"),
        F.when(now_in > before_in, pct0(now_in - before_in, before_in)).otherwise(none).alias("monthly_growth"),
        F.when(now_in < before_in, pct0(before_in - now_in, before_in)).otherwise(none).alias("monthly_decline"),
        F.col("closing_balance_minor").alias("cash_reserve_estimate_minor"),
        "total_income_minor", "total_expense_minor", "net_cash_flow_minor", "transaction_count",
    )
    return with_score(metrics)


def health_score() -> Column:
    """H9: 100 less the penalties; 0 for an account without rows."""

    def steps(name: str, *cases: tuple) -> Column:
        out = None
        for hit, points in cases:
            out = F.when(hit(F.col(name)), points) if out is None else out.when(hit(F.col(name)), points)
        return out.otherwise(0)

    above = lambda x: lambda c: c > F.lit(x)
    below = lambda x: lambda c: c < F.lit(x)
    penalty = (
        steps("expense_to_income_ratio", (above(1), 35), (above(0.75), 20), (above(0.5), 10))
        + steps("savings_rate", (below(0), 25), (below(10), 15), (below(25), 5))
        + steps("cash_flow_stability", (below(50), 25), (below(75), 15), (below(100), 5))
        + steps("category_concentration", (above(60), 10), (above(40), 5))
        + steps("recurring_expense_burden", (above(50), 10), (above(30), 5))
        + steps("monthly_decline", (above(20), 10))
    )
    return F.when(F.col("transaction_count") == 0, 0).otherwise(F.greatest(F.lit(0), F.lit(100) - penalty))


def with_score(metrics: DataFrame) -> DataFrame:
    """Score, level, rating and the metrics' second names."""
    score = F.col("overall_financial_health_score")
    level = F.when(score >= 85, "Excellent").when(score >= 70, "Good").when(score >= 50, "Moderate").when(score >= 25, "Poor").otherwise("Critical")
    named = F.when(F.col("health_level") == "Moderate", "Stable").when(F.col("health_level") == "Poor", "Warning").otherwise(F.col("health_level"))
    return (
        metrics.withColumn("overall_financial_health_score", health_score())
        .withColumn("health_level", level)
        .withColumns({"health_score": score, "health_rating": named, "income_growth": F.col("income_trend"), "expense_growth": F.col("expense_trend")})
    )
