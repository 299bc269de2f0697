"""Profit and loss over several accounts, and table profiles: A11-A14."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def _sum(when=None, amount: str = "amount"):
    value = F.col(amount) if when is None else F.when(when, F.col(amount))
    return F.coalesce(F.sum(value.cast("decimal(20,2)")).cast(MONEY), F.lit(0).cast(MONEY))


def profit_and_loss(main: DataFrame, card: DataFrame, payroll: DataFrame, key: str = "business_id") -> DataFrame:
    """Revenue, costs, profit and yearly turnover of each business of the main account.

    Card rows without category count as spending. Each account is summed before the join; the
    margin is NULL without revenue; less than a year counts as one.
    """
    c = F.col("category")
    first = main.groupBy(key).agg(
        _sum(c == "Sales Revenue").alias("revenue_total"), _sum(c == "Operating Expense").alias("operating_expense"), _sum(c == "COGS").alias("cogs"),
        F.greatest(F.datediff(F.max("date"), F.min("date")) / F.lit(365), F.lit(1.0)).alias("years_covered"),
    )
    second = card.groupBy(key).agg(_sum(~c.eqNullSafe("Payment")).alias("card_spend"))
    third = payroll.groupBy(key).agg(_sum().alias("payroll"))
    joined = first.join(second, key, "left").join(third, key, "left").fillna(0, ["card_spend", "payroll"])
    expenses = F.col("operating_expense") + F.col("cogs") + F.col("card_spend") + F.col("payroll")
    profit = F.col("revenue_total") - F.col("total_expenses")
    return (
        joined.withColumn("total_expenses", expenses.cast(MONEY))
        .withColumn("net_profit", profit.cast(MONEY))
        .withColumn("net_profit_margin", F.try_divide(F.col("net_profit").cast("double") * 100, F.col("revenue_total").cast("double")))
        .withColumn("annual_turnover", F.col("revenue_total").cast("double") / F.col("years_covered"))
    )


def profile(df: DataFrame, date_col: str) -> DataFrame:
    """(column, measure, value): rows, first and last date, missing values and distinct values."""
    aggregates = [F.count("*").cast("string").alias("*|rows"), F.min(date_col).cast("string").alias(f"{date_col}|first"), F.max(date_col).cast("string").alias(f"{date_col}|last")]
    for c in df.columns:
        aggregates.append(F.count_if(F.col(c).isNull()).cast("string").alias(f"{c}|missing"))
    for c in ("category", "type"):
        if c in df.columns:
            aggregates.append(F.array_join(F.sort_array(F.collect_set(c)), ",").alias(f"{c}|values"))
    one = df.agg(*aggregates)
    pairs = F.explode(F.array(*[F.struct(F.lit(n.split("|")[0]).alias("column_name"), F.lit(n.split("|")[1]).alias("measure"), F.col(f"`{n}`").alias("value")) for n in one.columns]))
    return one.select(pairs.alias("p")).select("p.*")


def first_rows(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first rows of a table in a stated order, with their number from 1; each task keeps its own first rows only."""
    found = df.orderBy(*order).limit(n)
    return found.withColumn("row", F.row_number().over(Window.orderBy(*order)).cast("long"))


def source_totals(df: DataFrame, source: str = "source") -> DataFrame:
    """Credits, debits and their difference for each source."""
    sums = df.groupBy(source).agg(_sum(F.lower("type") == "credit").alias("credit"), _sum(F.lower("type") == "debit").alias("debit"))
    return sums.withColumn("net", (F.col("credit") - F.col("debit")).cast(MONEY))


def distinct_categories(df: DataFrame, keys: list[str]) -> DataFrame:
    """The categories that occur in each account."""
    return df.select(*keys, "category").distinct()
