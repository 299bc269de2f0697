"""Constraints as queries: Q1-Q4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Q1: key values that more than one row has, among the rows that the constraint covers."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Q2: rows whose key names no parent; rows without a key are no orphans."""
    held = parent.select(F.col(parent_key or key).alias(key))
    return child.filter(F.col(key).isNotNull()).join(held, key, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Q3: (row, rule) for every value check that a row fails; an unknown result passes, as in SQL."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("rule", F.explode(broken))


def disagreements(identities: DataFrame, ledger: DataFrame) -> DataFrame:
    """Q4: identities whose ledger row is missing or states another amount, date or direction."""
    own = ledger.select("transaction_id", F.col("amount").alias("_amount"), F.col("transaction_date").alias("_date"), F.col("transaction_type").alias("_type"))
    joined = identities.join(own, "transaction_id", "left")
    reason = (
        F.when(F.col("_amount").isNull(), "LEDGER_ROW_MISSING")
        .when((F.col("_amount") * 100).cast("decimal(28,4)") != F.col("amount_minor"), "AMOUNT")
        .when(F.col("_date") != F.col("transaction_date"), "DATE")
        .when(F.col("_type") != F.col("direction"), "DIRECTION")
    )
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select("transaction_id", "reason")
