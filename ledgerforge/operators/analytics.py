"""Key figures, trends, breakdowns, budgets: A1-A10. One small aggregate a table, for all accounts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import iso_week, month, pct, total, whole
from .scope import KEYS

PAYMENT_ORDER = ("Cash", "UPI", "Card", "Bank", "Other")
UNCATEGORIZED = "Uncategorized"


def _of(direction: str, amount: str = "amount_minor"):
    return F.when(F.col("direction") == direction, F.col(amount))


def _sides() -> list:
    zero = F.lit(0).cast("decimal(38,0)")
    return [F.coalesce(total(_of(d)), zero).alias(f"{d}_minor") for d in ("income", "expense")]


def kpis(tx: DataFrame, accounts: DataFrame, keys=KEYS) -> DataFrame:
    """A1: one row for each account, of zeros where it has no rows.

    Averages and the income/expense ratio keep 18 places; the latter, the savings rate and
    extremes are NULL where they do not exist.
    """
    sums = tx.groupBy(*keys).agg(
        *_sides(),
        F.count("*").alias("n"),
        F.max(_of("income")).alias("largest_income_minor"),
        F.min(_of("income")).alias("smallest_income_minor"),
        F.max(_of("expense")).alias("largest_expense_minor"),
        F.min(_of("expense")).alias("smallest_expense_minor"),
    )
    joined = accounts.select(*keys, "opening_balance_minor").join(sums, list(keys), "left")
    zero = F.lit(0).cast("decimal(38,0)")
    income, expense = F.coalesce("income_minor", zero), F.coalesce("expense_minor", zero)
    count = F.coalesce("n", F.lit(0))
    return joined.select(
        *keys,
        whole(income).alias("total_income_minor"),
        whole(expense).alias("total_expense_minor"),
        whole(income - expense).alias("net_cash_flow_minor"),
        count.alias("transaction_count"),
        F.when(count == 0, F.lit(0)).otherwise((income + expense).cast("decimal(20,0)") / F.nullif(count, F.lit(0))).cast("decimal(38,18)").alias("average_transaction_minor"),
        "largest_income_minor",
        "smallest_income_minor",
        "largest_expense_minor",
        "smallest_expense_minor",
        F.col("opening_balance_minor").cast("long").alias("opening_balance_minor"),
        (F.col("opening_balance_minor") + whole(income - expense)).cast("long").alias("closing_balance_minor"),
        (income.cast("decimal(20,0)") / F.nullif(expense, zero).cast("decimal(20,0)")).cast("decimal(38,18)").alias("income_expense_ratio"),
        pct(income - expense, income).alias("savings_rate"),
    )


def trend(tx: DataFrame, grain: str = "daily", keys=KEYS) -> DataFrame:
    """A2-A4: income, expense, net and count of each observed day, ISO week or month."""
    period = {"daily": F.date_format("transaction_date", "yyyy-MM-dd"), "weekly": iso_week(F.col("transaction_date")), "monthly": month(F.col("transaction_date"))}[grain]
    sums = tx.groupBy(*keys, period.alias("period")).agg(*_sides(), F.count("*").alias("transaction_count"))
    return sums.select(
        *keys, "period", whole(F.col("income_minor")).alias("income_minor"), whole(F.col("expense_minor")).alias("expense_minor"),
        whole(F.col("income_minor") - F.col("expense_minor")).alias("net_cash_flow_minor"), "transaction_count",
    )


def _breakdown(tx: DataFrame, name: str, value, keys) -> DataFrame:
    sums = tx.groupBy(*keys, value.alias(name)).agg(*_sides(), F.count("*").alias("count"))
    amount = F.col("income_minor") + F.col("expense_minor")
    # The window runs over the few groups of an account, never over its rows.
    everything = F.sum(amount).over(Window.partitionBy(*keys)).cast("decimal(38,0)")
    return sums.select(
        *keys, name, whole(F.col("income_minor")).alias("income_minor"), whole(F.col("expense_minor")).alias("expense_minor"),
        whole(amount).alias("amount_minor"), "count", pct(amount, everything).alias("percentage"),
    )


def category_summary(tx: DataFrame, keys=KEYS) -> DataFrame:
    """A5: breakdown by category; none or empty is `Uncategorized`."""
    return _breakdown(tx, "category", F.coalesce(F.nullif("category", F.lit("")), F.lit(UNCATEGORIZED)), keys)


def payment_mode_summary(tx: DataFrame, keys=KEYS) -> DataFrame:
    """Breakdown by payment mode; unknown modes are `Other`; `mode_order` is the fixed order."""
    known = F.when(F.col("payment_mode").isin(*PAYMENT_ORDER), F.col("payment_mode")).otherwise(F.lit("Other"))
    found = _breakdown(tx, "payment_mode", known, keys)
    order = F.array_position(F.array(*[F.lit(m) for m in PAYMENT_ORDER]), F.col("payment_mode"))
    return found.withColumn("mode_order", order.cast("int"))


def account_summary(figures: DataFrame, keys=KEYS) -> DataFrame:
    """Balances and totals of accounts that have rows."""
    return figures.filter("transaction_count > 0").select(
        *keys, "opening_balance_minor", "closing_balance_minor", "total_income_minor", "total_expense_minor", "net_cash_flow_minor", "transaction_count"
    )


def transaction_rows(tx: DataFrame, keys=KEYS) -> DataFrame:
    """The fields that may be shown."""
    return tx.select(*keys, "transaction_date", "amount_minor", "direction", "category", "payment_mode")


def ledger_summary(ledger: DataFrame, keys=("business_id", "user_id")) -> DataFrame:
    """Totals of a legacy ledger, whose types may be written in any case."""
    kind = F.lower("transaction_type")
    side = lambda d: F.coalesce(total(F.when(kind == d, F.col("amount_minor"))), F.lit(0).cast("decimal(38,0)"))
    return ledger.groupBy(*keys).agg(
        F.count("*").alias("total_transactions"),
        whole(side("income")).alias("total_income_minor"),
        whole(side("expense")).alias("total_expense_minor"),
        whole(side("income") - side("expense")).alias("net_cash_flow_minor"),
    )


def budget_variance(budgets: DataFrame, ledger: DataFrame) -> DataFrame:
    """What each budget allocated, what its category cost, and the difference.

    Expenses are summed by (business, folded category) before the join, so that the ledger is
    shuffled as small sums.
    """
    spent = (
        ledger.filter(F.col("direction") == "expense")
        .groupBy("business_id", F.lower(F.coalesce("category", F.lit(""))).alias("_category"))
        .agg(total(F.col("amount_minor")).alias("_spent"))
    )
    joined = budgets.withColumn("_category", F.lower("category")).join(spent, ["business_id", "_category"], "left")
    actual = whole(F.coalesce("_spent", F.lit(0).cast("decimal(38,0)")))
    return joined.select(
        "business_id", "category", F.col("allocated_minor").cast("long").alias("allocated_minor"), actual.alias("actual_minor"), (F.col("allocated_minor") - actual).cast("long").alias("variance_minor")
    )
