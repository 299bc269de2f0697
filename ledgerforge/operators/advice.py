"""Recommendations: B1-B8. Rules are data, applied in one pass over a row for each account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scope import KEYS

RANKS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
# Category, title, priority (also the severity) and action of each anomaly type.
ANOMALY_RULES = {
    "negative_cash_flow": ("Cash Flow", "Address negative cash flow", "HIGH", "Review spending and restore positive cash flow."),
    "negative_cash_flow_period": ("Cash Flow", "Address negative cash flow", "HIGH", "Review spending and restore positive cash flow."),
    "high_expense_ratio": ("Expense", "Reduce the expense burden", "HIGH", "Reduce discretionary spending and review major costs."),
    "income_drop": ("Income", "Investigate income decline", "HIGH", "Increase sales activity and review the causes of the decline."),
    "sudden_income_drop": ("Income", "Investigate income decline", "HIGH", "Increase sales activity and review the causes of the decline."),
    "income_interruption": ("Income", "Restore income continuity", "CRITICAL", "Investigate the interruption and restore reliable income activity."),
    "expense_explosion": ("Expense", "Investigate expense explosion", "CRITICAL", "Investigate the expense increase and pause avoidable spending."),
    "sudden_expense_spike": ("Expense", "Investigate expense spike", "HIGH", "Review the affected period and reduce discretionary spending."),
    "large_transaction": ("Risk", "Review the large transaction", "HIGH", "Investigate the large payment before approving similar activity."),
    "unusually_large_income": ("Risk", "Review the large transaction", "MEDIUM", "Verify the unusual income and retain supporting records."),
    "unusually_large_expense": ("Risk", "Review the large transaction", "HIGH", "Investigate the large payment before approving similar activity."),
    "category_spike": ("Category Spending", "Monitor category spending", "HIGH", "Monitor the affected category and reduce avoidable costs."),
    "recurring_expense_growth": ("Expense", "Review recurring expenses", "HIGH", "Review recurring subscriptions and renegotiate fixed costs."),
    "very_high_recurring_expenses": ("Expense", "Review recurring expenses", "HIGH", "Review recurring subscriptions and renegotiate fixed costs."),
    "payment_mode_change": ("Payment Behaviour", "Verify payment behaviour", "MEDIUM", "Verify the unusual payment pattern and monitor future activity."),
    "unexpected_payment_mode": ("Payment Behaviour", "Verify payment behaviour", "MEDIUM", "Verify the unusual payment pattern and monitor future activity."),
    "duplicate_pattern": ("Risk", "Verify repeated transactions", "MEDIUM", "Verify repeated entries and investigate suspicious behaviour."),
    "repeated_identical_transactions": ("Risk", "Verify repeated transactions", "MEDIUM", "Verify repeated entries and investigate suspicious behaviour."),
    "inactive_period": ("Operational", "Review inactive activity", "LOW", "Review the inactive period and confirm that operations are continuing."),
    "inactive_business": ("Operational", "Review inactive activity", "LOW", "Review the inactive period and confirm that operations are continuing."),
    "cash_flow_instability": ("Business Health", "Stabilize cash flow", "HIGH", "Reduce volatility by monitoring inflows and planned outflows."),
}

FIELDS = "category string, title string, priority string, severity string, confidence int, reason string, explanation string, recommended_action string"


def rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RANKS]), level)


def _advice(when: Column, category: str, title: str, priority, confidence: int, reason: str, explanation: Column, action: str) -> Column:
    level = priority if isinstance(priority, Column) else F.lit(priority)
    fields = F.struct(
        F.lit(category).alias("category"), F.lit(title).alias("title"), level.alias("priority"), level.alias("severity"),
        F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"), explanation.alias("explanation"), F.lit(action).alias("recommended_action"),
    )
    return F.when(when, fields)


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def metric_rules(metrics: DataFrame, modes: DataFrame, keys=KEYS) -> DataFrame:
    """The rules over metrics and payment modes that hold, one row each, in the order of the rules."""
    c = F.col
    net, ratio, savings, count = c("net_cash_flow_minor"), c("expense_to_income_ratio"), c("savings_rate"), c("transaction_count")
    decline, growth = c("monthly_decline"), c("monthly_growth")
    stability, reserve, expense = c("cash_flow_stability"), c("cash_reserve_estimate_minor"), c("total_expense_minor")
    order = F.col("mode_order")
    heavy = modes.filter(F.col("percentage") > 80).groupBy(*keys).agg(
        F.min_by("payment_mode", order).alias("heavy_mode"), F.min_by("percentage", order).alias("heavy_share")
    )
    # Conditions, levels, confidences and texts of the rules.
    rules = [
        _advice(net < 0, "Cash Flow", "Address negative cash flow", F.when(ratio > 1, "CRITICAL").otherwise("HIGH"), 95,
            "Net cash flow is below zero in the selected period.",
            _say("Net cash flow of ", net, " minor units is negative; cash outflows exceed inflows. Review spending and restore positive cash flow."),
            "Review spending and restore positive cash flow."),
        _advice(ratio > 0.75, "Expense", "Reduce the expense burden", F.when(ratio > 1, "CRITICAL").otherwise("HIGH"), 93,
            "The expense-to-income ratio exceeds the safe threshold.",
            _say("Expenses consume ", ratio, " times recorded income; the expense-to-income ratio triggered the 0.75 threshold. Reduce discretionary spending and review major costs."),
            "Reduce discretionary spending and review major costs."),
        _advice((savings < 20) & (count > 0), "Savings", "Create a savings buffer", F.when(savings < 0, "HIGH").otherwise("MEDIUM"), 90,
            "The savings rate is below the 20 percent target.",
            _say("The savings rate is ", savings, " percent, below the 20 percent threshold. Allocate more inflows to a cash buffer."),
            "Increase the cash reserve from future inflows."),
        _advice(decline > 20, "Income", "Investigate income decline", "HIGH", 90,
            "Income declined by more than 20 percent between periods.",
            _say("Income decline of ", decline, " percent exceeded the 20 percent threshold. Increase sales activity and review the causes of the decline."),
            "Increase sales activity and review the decline."),
        _advice(growth > 10, "Growth", "Maintain positive income growth", "LOW", 88,
            "Income growth exceeded the 10 percent positive-trend threshold.",
            _say("Income grew by ", growth, " percent, above the 10 percent threshold. Maintain the current sales trend."),
            "Maintain the current sales trend."),
        _advice(c("category_concentration") > 60, "Category Spending", "Monitor category concentration", "HIGH", 89,
            "One category accounts for more than 60 percent of activity.",
            _say("Category concentration is ", c("category_concentration"), " percent, above the 60 percent threshold. Monitor the category and reduce avoidable costs."),
            "Monitor category spending and diversify exposure."),
        _advice(c("recurring_expense_burden") > 50, "Expense", "Review recurring expenses", "HIGH", 92,
            "Recurring expenses consume more than half of total expenses.",
            _say("Recurring expenses represent ", c("recurring_expense_burden"), " percent of expenses, above the 50 percent threshold. Review recurring subscriptions and fixed costs."),
            "Review recurring subscriptions and fixed costs."),
        _advice(reserve.isNotNull() & (expense > 0) & (reserve < expense), "Risk", "Increase the cash reserve", "HIGH", 91,
            "The estimated cash reserve is below one period of expenses.",
            _say("The reserve is ", reserve, " minor units against ", expense, " minor units of expenses, below the one-period reserve threshold. Increase the cash reserve."),
            "Increase the cash reserve from future inflows."),
        _advice((stability < 50) & (count > 0), "Business Health", "Stabilize cash flow", "HIGH", 87,
            "Cash-flow stability is below 50 percent.",
            _say("Only ", stability, " percent of observed periods had stable cash flow, below the 50 percent threshold. Reduce volatility."),
            "Monitor inflows and plan outflows more closely."),
        _advice((growth > 10) & (stability >= 75) & c("health_level").isin("Excellent", "Good"), "Business Health", "Maintain the positive trend", "LOW", 86,
            "Growth and cash-flow stability are both positive.",
            _say("Income growth is ", growth, " percent and cash-flow stability is ", stability, " percent. Maintain the current trend."),
            "Maintain the current trend and continue monitoring."),
        _advice((c("health_level") == "Stable") & (net >= 0) & (ratio <= 0.75) & (savings >= 20) & (stability >= 75), "Business Health", "Maintain stable operations", "LOW", 85,
            "The business has stable cash flow and controlled expenses.",
            _say("Cash-flow stability is ", stability, " percent, the expense-to-income ratio is ", ratio, ", and the savings rate is ", savings, " percent. Maintain the current operating discipline."),
            "Maintain current controls and continue monitoring."),
        _advice(c("heavy_mode").isNotNull(), "Payment Behaviour", "Monitor payment-mode concentration", "MEDIUM", 84,
            "A single payment mode exceeds 80 percent of activity.",
            _say(c("heavy_mode"), " represents ", c("heavy_share"), " percent of activity, above the 80 percent concentration threshold."),
            "Monitor payment behaviour and maintain alternatives."),
    ]
    held = metrics.join(heavy, list(keys), "left").select(*keys, F.posexplode(F.array_compact(F.array(*rules))).alias("position", "rule"))
    return held.select(*keys, F.lit("metric").alias("origin"), F.col("position").cast("long").alias("position"), "rule.*")


def _rule_table(df: DataFrame) -> DataFrame:
    rows = [(kind, *rule) for kind, rule in ANOMALY_RULES.items()]
    return df.sparkSession.createDataFrame(rows, "type string, category string, title string, default_priority string, action string")


def anomaly_rules(anomalies: DataFrame, keys=KEYS) -> DataFrame:
    """Advice from anomalies, the first of each (category, title), and one row where there are several.

    Anomalies of one account are ordered by date, type and severity. Their number is the
    hits of an account, aliases included, so the window that finds the first runs over
    (account, category, title).
    """
    rules = F.broadcast(_rule_table(anomalies))  # one row for each anomaly type
    severity = F.upper("severity")
    level = F.when(rank(severity) <= rank(F.col("default_priority")), severity).otherwise(F.col("default_priority"))
    named = F.replace("type", F.lit("_"), F.lit(" "))
    told = anomalies.join(rules, "type").select(
        *keys, "category", "title", level.alias("priority"), severity.alias("severity"),
        F.when(severity == "CRITICAL", 95).otherwise(88).alias("confidence"),
        F.concat(F.lit("The "), named, F.lit(" anomaly was detected by the health service.")).alias("reason"),
        _say("The health service detected ", named, " with metric value ", _plain(F.col("metric_value")), " against threshold ", _plain(F.col("threshold")), ". ", F.col("action")).alias("explanation"),
        F.col("action").alias("recommended_action"),
        F.struct(F.coalesce("date_detected", F.lit("")).alias("d"), "type", severity.alias("s"), "metric_value", "affected_amount_minor").alias("_order"),
    )
    values = ["priority", "severity", "confidence", "reason", "explanation", "recommended_action"]
    first = told.groupBy(*keys, "category", "title").agg(F.min_by(F.struct(*values), "_order").alias("v"), F.min("_order").alias("_order"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_order", "category", "title")) - 1
    singles = first.select(*keys, F.lit("anomaly").alias("origin"), place.cast("long").alias("position"), "category", "title", "v.*")
    counts = anomalies.groupBy(*keys).agg(F.count("*").alias("n")).filter("n >= 2")
    several = _advice(F.lit(True), "Risk", "Review multiple anomalies", "HIGH", 90, "Multiple deterministic anomalies were reported in the period.",
        _say("The health service reported ", F.col("n"), " anomalies. Review the affected metrics together and verify suspicious behaviour."),
        "Review the affected metrics together.")
    many = counts.select(*keys, F.lit("anomaly").alias("origin"), F.lit(1 << 40).alias("position"), several.alias("rule")).select(*keys, "origin", "position", "rule.*")
    return singles.unionByName(many)


def _plain(number: Column) -> Column:
    """A decimal as text without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def ranked(*parts: DataFrame, keys=KEYS) -> DataFrame:
    """All advice of an account by urgency, with ids from `recommendation-001` on."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = [rank(F.col("priority")), rank(F.col("severity")), "category", "title", F.col("origin").desc(), "position"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return every.withColumn("id", F.format_string("recommendation-%03d", nth)).drop("origin", "position")


def advice_summary(recommendations: DataFrame, keys=KEYS) -> DataFrame:
    """Number of recommendations and the highest priority."""
    return recommendations.groupBy(*keys).agg(F.count("*").alias("recommendation_count"), F.min_by("priority", rank(F.col("priority"))).alias("highest_priority"))
