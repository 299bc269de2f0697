"""Queries over health, anomalies, recommendations and reports.

Each is registered over the quarter that exercises it and, as `_all`, over the whole ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import advice as B
from ..operators import analytics as A
from ..operators import anomalies as N
from ..operators import health as H
from ..operators import reports as R
from .figures import CATEGORY, FIGURES_SQL, MODE, PERIODS, breakdown_sql, double, trend_sql
from .shapes import duck, pct0_sql, shape

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The small tables that everything here is made from, over one set of rows.

    They are aggregates, and many detectors and rules read each of them, so they are kept
    (memory and disk) instead of being made anew from the rows for every reader.
    """

    def __init__(self, spark, sf: str, rows: str = "quarter"):
        self.tx = shape(spark, sf, rows)
        self.figures = A.kpis(self.tx, shape(spark, sf, "accounts")).persist()
        self.daily, self.weekly, self.monthly = (A.trend(self.tx, g).persist() for g in PERIODS)
        self.categories, self.modes = A.category_summary(self.tx).persist(), A.payment_mode_summary(self.tx).persist()
        self.cat_months = H.category_months(self.tx).persist()
        self.metrics = H.health_metrics(self.figures, self.daily, self.monthly, self.categories, self.cat_months).persist()

    def anomalies(self) -> DataFrame:
        return N.detect(self.tx, self.daily, self.monthly, self.cat_months, self.modes, self.metrics)

    def advice(self) -> DataFrame:
        return B.ranked(B.metric_rules(self.metrics, self.modes), B.anomaly_rules(self.anomalies()))

    def sections(self) -> dict[str, DataFrame]:
        return R.sections(self.figures, self.daily, self.weekly, self.monthly, self.categories, self.modes, A.account_summary(self.figures), self.metrics, self.anomalies())


def parts_sql(rows: str) -> str:
    """The same tables for DuckDB, named as in `Tables`."""
    last = "row_number() OVER (PARTITION BY business_id, account_id ORDER BY period DESC)"
    before = "OVER (PARTITION BY business_id, account_id ORDER BY period)"
    return f"""
    figures AS ({FIGURES_SQL.format(rows=rows)}),
    daily AS ({trend_sql(PERIODS["daily"], rows)}),
    weekly AS ({trend_sql(PERIODS["weekly"], rows)}),
    monthly AS ({trend_sql(PERIODS["monthly"], rows)}),
    categories AS ({breakdown_sql("category", CATEGORY, rows)}),
    modes AS ({breakdown_sql("payment_mode", MODE, rows)}),
    cat_months AS (SELECT business_id, account_id, {CATEGORY} AS category, {PERIODS["monthly"]} AS month, CAST(sum(amount_minor) AS BIGINT) AS expense_minor,
                          max_by(amount_minor, {{{{'d': transaction_date, 'a': CAST(amount_minor AS VARCHAR), 'm': coalesce(payment_mode, '')}}}}) AS last_amount
                   FROM {rows} WHERE direction = 'expense' GROUP BY 1, 2, 3, 4),
    two AS (SELECT * FROM (SELECT *, lag(income_minor) {before} AS p_in, lag(expense_minor) {before} AS p_out, {last} AS nth FROM monthly) WHERE nth = 1),
    days AS (SELECT business_id, account_id, count(*) AS days, count(*) FILTER (WHERE net_cash_flow_minor >= 0) AS calm FROM daily GROUP BY 1, 2),
    tops AS (SELECT business_id, account_id, CAST(sum(amount_minor) AS BIGINT) AS every, max(amount_minor) AS top, max(expense_minor) AS top_out, max(income_minor) AS top_in FROM categories GROUP BY 1, 2),
    recurring AS (SELECT business_id, account_id, CAST(coalesce(sum(s) FILTER (WHERE m >= 2), 0) AS BIGINT) AS again
                  FROM (SELECT business_id, account_id, category, sum(expense_minor) AS s, count(DISTINCT month) AS m FROM cat_months GROUP BY 1, 2, 3) GROUP BY 1, 2),
    joined AS (SELECT f.*, coalesce(days, 0) AS days, coalesce(calm, 0) AS calm, coalesce(every, 0) AS every, coalesce(top, 0) AS top, coalesce(top_out, 0) AS top_out, coalesce(top_in, 0) AS top_in,
                      coalesce(again, 0) AS again, coalesce(income_minor, total_income_minor) AS now_in, coalesce(p_in, 0) AS before_in,
                      coalesce(expense_minor, total_expense_minor) AS now_out, coalesce(p_out, 0) AS before_out
               FROM figures f LEFT JOIN days USING (business_id, account_id) LEFT JOIN tops USING (business_id, account_id)
               LEFT JOIN recurring USING (business_id, account_id) LEFT JOIN two USING (business_id, account_id)),
    measured AS (SELECT business_id, account_id, {pct0_sql("calm", "days")} AS cash_flow_stability,
               {pct0_sql("(now_in - before_in)", "before_in")} AS income_trend, {pct0_sql("(now_out - before_out)", "before_out")} AS expense_trend,
               {pct0_sql("total_expense_minor", "total_income_minor", 1)} AS expense_to_income_ratio, {pct0_sql("total_income_minor", "total_expense_minor", 1)} AS income_ratio,
               coalesce(savings_rate, 0.0) AS savings_rate, {pct0_sql("again", "total_expense_minor")} AS recurring_expense_burden,
               {pct0_sql("top", "every")} AS category_concentration, {pct0_sql("top_out", "total_expense_minor")} AS largest_expense_percentage,
               {pct0_sql("top_in", "total_income_minor")} AS largest_income_percentage,
               CASE WHEN now_in > before_in THEN {pct0_sql("(now_in - before_in)", "before_in")} ELSE 0.0 END AS monthly_growth,
               CASE WHEN now_in < before_in THEN {pct0_sql("(before_in - now_in)", "before_in")} ELSE 0.0 END AS monthly_decline,
               closing_balance_minor AS cash_reserve_estimate_minor, total_income_minor, total_expense_minor, net_cash_flow_minor, transaction_count
        FROM joined),
    scored AS (SELECT *, CAST(CASE WHEN transaction_count = 0 THEN 0 ELSE greatest(0, 100
               - CASE WHEN expense_to_income_ratio > 1 THEN 35 WHEN expense_to_income_ratio > 0.75 THEN 20 WHEN expense_to_income_ratio > 0.5 THEN 10 ELSE 0 END
               - CASE WHEN savings_rate < 0 THEN 25 WHEN savings_rate < 10 THEN 15 WHEN savings_rate < 25 THEN 5 ELSE 0 END
               - CASE WHEN cash_flow_stability < 50 THEN 25 WHEN cash_flow_stability < 75 THEN 15 WHEN cash_flow_stability < 100 THEN 5 ELSE 0 END
               - CASE WHEN category_concentration > 60 THEN 10 WHEN category_concentration > 40 THEN 5 ELSE 0 END
               - CASE WHEN recurring_expense_burden > 50 THEN 10 WHEN recurring_expense_burden > 30 THEN 5 ELSE 0 END
               - CASE WHEN monthly_decline > 20 THEN 10 ELSE 0 END) END AS INTEGER) AS overall_financial_health_score FROM measured),
    metrics AS (SELECT *, CASE WHEN overall_financial_health_score >= 85 THEN 'Excellent' WHEN overall_financial_health_score >= 70 THEN 'Good'
               WHEN overall_financial_health_score >= 50 THEN 'Moderate' WHEN overall_financial_health_score >= 25 THEN 'Poor' ELSE 'Critical' END AS health_level FROM scored)""".replace("{{", "{").replace("}}", "}")


def hits_sql(rows: str) -> str:
    """All detectors' rows before they are finalized."""
    key = "business_id, account_id"

    def part(kind: str, severity: str, date: str, metric: str, threshold: str, source: str, amount: str = "NULL", category: str = "NULL") -> str:
        return f"""SELECT {key}, {kind} AS type, '{severity}' AS severity, {date} AS date_detected, CAST({metric} AS DOUBLE) AS metric_value,
                   CAST({threshold} AS DOUBLE) AS threshold, CAST({amount} AS BIGINT) AS affected_amount_minor, CAST({category} AS VARCHAR) AS affected_category FROM {source}"""

    day = "CAST(transaction_date AS VARCHAR)"
    large = f"""(SELECT t.*, s, n FROM {rows} t JOIN (SELECT {key}, direction, CAST(sum(amount_minor) AS HUGEINT) AS s, count(*) AS n FROM {rows} GROUP BY 1, 2, 3) USING ({key}, direction)
                WHERE CAST(amount_minor AS HUGEINT) * n > s * 2)"""
    same = f"(SELECT {key}, amount_minor, direction, {CATEGORY} AS category, coalesce(nullif(payment_mode, ''), 'Other') AS m, count(*) AS n, min(transaction_date) AS transaction_date FROM {rows} GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) >= 2)"
    mean = "round(CAST(s * 2 AS DOUBLE) / n, 2)"
    gap = f"(SELECT *, date_diff('day', lag(CAST(period AS DATE)) OVER (PARTITION BY {key} ORDER BY period), CAST(period AS DATE)) AS gap FROM daily)"
    spike = f"""(SELECT * FROM (SELECT *, lag(expense_minor) OVER (PARTITION BY {key}, category ORDER BY month) AS p, row_number() OVER (PARTITION BY {key}, category ORDER BY month DESC) AS nth FROM cat_months)
                WHERE nth = 1 AND p > 0 AND expense_minor * 2 >= p * 3)"""
    once = f"(SELECT *, sum(count) OVER (PARTITION BY {key}) AS every FROM modes)"
    return " UNION ALL ".join([
        part("'unusually_large_' || direction", "High", day, mean, mean, large, "amount_minor", CATEGORY),
        part("'repeated_identical_transactions'", "Medium", day, "2", "2", same, "amount_minor", "category"),
        part("'sudden_expense_spike'", "High", "period", "50", "50", "two WHERE p_out > 0 AND expense_minor * 2 >= p_out * 3"),
        part("'expense_explosion'", "Critical", "period", "100", "100", "two WHERE p_out > 0 AND expense_minor >= p_out * 2"),
        part("'sudden_income_drop'", "High", "period", "-50", "-50", "two WHERE p_in > 0 AND income_minor * 2 <= p_in"),
        part("'income_interruption'", "Critical", "period", "0", "0", "two WHERE p_in > 0 AND income_minor = 0"),
        part("'high_expense_ratio'", "HIGH", "NULL", "expense_to_income_ratio", "1", "metrics WHERE expense_to_income_ratio > 1"),
        part("'cash_flow_instability'", "HIGH", "NULL", "cash_flow_stability", "50", "metrics WHERE cash_flow_stability < 50 AND transaction_count > 0"),
        part("'very_high_recurring_expenses'", "High", "NULL", "50", "50", "metrics WHERE recurring_expense_burden > 50"),
        part("'inactive_period'", "Low", "period", "7", "7", f"{gap} WHERE gap > 7"),
        part("'negative_cash_flow_period'", "Medium", "period", "0", "0", "daily WHERE net_cash_flow_minor < 0"),
        part("'category_spike'", "High", "month", "50", "50", spike, "last_amount", "category"),
        part("'recurring_expense_growth'", "HIGH", "month", pct0_sql("(expense_minor - p)", "p"), "50", spike, "last_amount", "category"),
        part("'unexpected_payment_mode'", "Medium", "NULL", "1", "1", f"{once} WHERE every >= 3 AND count = 1"),
    ])


NORMAL = "CASE WHEN upper(severity) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN upper(severity) ELSE 'MEDIUM' END"
ALIAS = "CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in N.ALIASES.items()) + " END"
FINAL_SQL = f"""
    hits AS ({{hits}}),
    found AS (SELECT * REPLACE (CASE WHEN type = 'sudden_expense_spike' THEN severity ELSE {NORMAL} END AS severity) FROM hits
              UNION ALL SELECT * REPLACE ({ALIAS} AS type, {NORMAL} AS severity) FROM hits WHERE {ALIAS} IS NOT NULL)"""


def final_sql(rows: str) -> str:
    return FINAL_SQL.replace("{hits}", hits_sql(rows))


#: The whole ledger that belongs to a part of it.
WHOLE = {"quarter": "ledger", "coarse": "coarse_all"}


def register(name: str, build, sql=None, rows: str = "quarter") -> None:
    """`build(spark, sf, rows)` and `sql(rows)` under `name`; over a part, under `name`_all over its whole too."""
    QUERIES[name] = lambda spark, sf: build(spark, sf, rows)
    if sql is not None:
        ORACLE_SQL[name] = duck(sql(rows), rows, "accounts")
    if rows in WHOLE:
        register(f"{name}_all", build, sql, WHOLE[rows])


METRICS = ("cash_flow_stability", "income_trend", "expense_trend", "expense_to_income_ratio", "income_ratio", "savings_rate", "recurring_expense_burden",
           "category_concentration", "largest_expense_percentage", "largest_income_percentage", "monthly_growth", "monthly_decline")
HITS = ("business_id", "account_id", "type", "severity", "date_detected", "metric_value", "threshold", "affected_amount_minor", "affected_category")


def _shown(found: DataFrame) -> DataFrame:
    return double(found, "metric_value", "threshold", places=2).select(*HITS)


register(
    "health_metrics",
    lambda spark, sf, rows: double(Tables(spark, sf, rows).metrics, *METRICS, "income_growth", "expense_growth"),
    lambda rows: f"""WITH {parts_sql(rows)} SELECT *, overall_financial_health_score AS health_score, income_trend AS income_growth, expense_trend AS expense_growth,
        CASE health_level WHEN 'Moderate' THEN 'Stable' WHEN 'Poor' THEN 'Warning' ELSE health_level END AS health_rating FROM metrics""",
)
register(
    "last_two_months",
    lambda spark, sf, rows: H.last_two_months(Tables(spark, sf, rows).monthly),
    lambda rows: f"WITH {parts_sql(rows)} SELECT business_id, account_id, period, income_minor, expense_minor, p_in AS previous_income_minor, p_out AS previous_expense_minor FROM two",
)


def _detector(name: str, pick, kinds: tuple[str, ...], rows: str = "quarter") -> None:
    wanted = ", ".join(f"'{k}'" for k in kinds)
    register(name, lambda spark, sf, rows: _shown(pick(Tables(spark, sf, rows))), lambda rows: f"WITH {parts_sql(rows)} SELECT * FROM ({hits_sql(rows)}) WHERE type IN ({wanted})", rows)


_detector("anomaly_large_transactions", lambda t: N.large_transactions(t.tx), ("unusually_large_income", "unusually_large_expense"))
_detector("anomaly_repeated_identical", lambda t: N.repeated_identical(t.tx), ("repeated_identical_transactions",), "coarse_all")
_detector("anomaly_month_changes", lambda t: N.month_changes(t.monthly), ("sudden_expense_spike", "expense_explosion", "sudden_income_drop", "income_interruption"))
_detector("anomaly_metric_alarms", lambda t: N.metric_alarms(t.metrics), ("high_expense_ratio", "cash_flow_instability", "very_high_recurring_expenses"))
_detector("anomaly_inactive_periods", lambda t: N.inactive_periods(t.daily), ("inactive_period",), "ledger")
_detector("anomaly_negative_days", lambda t: N.negative_days(t.daily), ("negative_cash_flow_period",))
_detector("anomaly_category_spikes", lambda t: N.category_spikes(t.cat_months), ("category_spike", "recurring_expense_growth"))
_detector("anomaly_unexpected_modes", lambda t: N.unexpected_modes(t.modes), ("unexpected_payment_mode",))
register("anomalies", lambda spark, sf, rows: _shown(Tables(spark, sf, rows).anomalies()), lambda rows: f"WITH {parts_sql(rows)}, {final_sql(rows)} SELECT * FROM found")
register("anomalies_coarse", lambda spark, sf, rows: _shown(Tables(spark, sf, rows).anomalies()), lambda rows: f"WITH {parts_sql(rows)}, {final_sql(rows)} SELECT * FROM found", "coarse")

RANK = "CASE {} WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END"
RULES_SQL = """
    metric_advice AS (
        SELECT business_id, account_id, 'Cash Flow' AS category, 'Address negative cash flow' AS title, CASE WHEN expense_to_income_ratio > 1 THEN 'CRITICAL' ELSE 'HIGH' END AS priority, 95 AS confidence FROM metrics WHERE net_cash_flow_minor < 0
        UNION ALL SELECT business_id, account_id, 'Expense', 'Reduce the expense burden', CASE WHEN expense_to_income_ratio > 1 THEN 'CRITICAL' ELSE 'HIGH' END, 93 FROM metrics WHERE expense_to_income_ratio > 0.75
        UNION ALL SELECT business_id, account_id, 'Savings', 'Create a savings buffer', CASE WHEN savings_rate < 0 THEN 'HIGH' ELSE 'MEDIUM' END, 90 FROM metrics WHERE savings_rate < 20 AND transaction_count > 0
        UNION ALL SELECT business_id, account_id, 'Income', 'Investigate income decline', 'HIGH', 90 FROM metrics WHERE monthly_decline > 20
        UNION ALL SELECT business_id, account_id, 'Growth', 'Maintain positive income growth', 'LOW', 88 FROM metrics WHERE monthly_growth > 10
        UNION ALL SELECT business_id, account_id, 'Category Spending', 'Monitor category concentration', 'HIGH', 89 FROM metrics WHERE category_concentration > 60
        UNION ALL SELECT business_id, account_id, 'Expense', 'Review recurring expenses', 'HIGH', 92 FROM metrics WHERE recurring_expense_burden > 50
        UNION ALL SELECT business_id, account_id, 'Risk', 'Increase the cash reserve', 'HIGH', 91 FROM metrics WHERE cash_reserve_estimate_minor IS NOT NULL AND total_expense_minor > 0 AND cash_reserve_estimate_minor < total_expense_minor
        UNION ALL SELECT business_id, account_id, 'Business Health', 'Stabilize cash flow', 'HIGH', 87 FROM metrics WHERE cash_flow_stability < 50 AND transaction_count > 0
        UNION ALL SELECT business_id, account_id, 'Business Health', 'Maintain the positive trend', 'LOW', 86 FROM metrics WHERE monthly_growth > 10 AND cash_flow_stability >= 75 AND health_level IN ('Excellent', 'Good')
        UNION ALL SELECT DISTINCT business_id, account_id, 'Payment Behaviour', 'Monitor payment-mode concentration', 'MEDIUM', 84 FROM modes WHERE percentage > 80)"""
RULE_ROWS = ", ".join(f"('{k}', '{c}', '{t}', '{p}')" for k, (c, t, p, _a) in B.ANOMALY_RULES.items())
ADVICE_SQL = f"""
    told AS (SELECT f.*, r.category AS c, r.title AS t, upper(severity) AS s, CASE WHEN {RANK.format("upper(severity)")} <= {RANK.format("r.p")} THEN upper(severity) ELSE r.p END AS priority
             FROM found f JOIN (SELECT * FROM (VALUES {RULE_ROWS}) AS v(type, category, title, p)) r USING (type)),
    anomaly_advice AS (
        SELECT business_id, account_id, c AS category, t AS title, priority, s AS severity, CASE WHEN s = 'CRITICAL' THEN 95 ELSE 88 END AS confidence
        FROM (SELECT *, row_number() OVER (PARTITION BY business_id, account_id, c, t ORDER BY coalesce(date_detected, ''), type, s, metric_value, affected_amount_minor NULLS FIRST) AS nth FROM told) WHERE nth = 1
        UNION ALL SELECT business_id, account_id, 'Risk', 'Review multiple anomalies', 'HIGH', 'HIGH', 90 FROM found GROUP BY business_id, account_id HAVING count(*) >= 2),
    every AS (SELECT business_id, account_id, category, title, priority, priority AS severity, confidence FROM metric_advice UNION ALL SELECT * FROM anomaly_advice)"""
register(
    "metric_rules",
    lambda spark, sf, rows: B.metric_rules(Tables(spark, sf, rows).metrics, Tables(spark, sf, rows).modes).select("business_id", "account_id", "category", "title", "priority", "confidence"),
    lambda rows: f"WITH {parts_sql(rows)}, {RULES_SQL} SELECT business_id, account_id, category, title, priority, confidence FROM metric_advice",
    "coarse",
)
register(
    "recommendations",
    lambda spark, sf, rows: Tables(spark, sf, rows).advice().select("business_id", "account_id", "category", "title", "priority", "severity", "confidence"),
    lambda rows: f"WITH {parts_sql(rows)}, {final_sql(rows)}, {RULES_SQL}, {ADVICE_SQL} SELECT * FROM every",
)
register("recommendation_texts", lambda spark, sf, rows: Tables(spark, sf, rows).advice())
register(
    "advice_summary",
    lambda spark, sf, rows: B.advice_summary(Tables(spark, sf, rows).advice()),
    lambda rows: f"""WITH {parts_sql(rows)}, {final_sql(rows)}, {RULES_SQL}, {ADVICE_SQL}
        SELECT business_id, account_id, count(*) AS recommendation_count, arg_min(priority, {RANK.format("priority")}) AS highest_priority FROM every GROUP BY 1, 2""",
)
register(
    "chart_rows",
    lambda spark, sf, rows: R.chart_rows(*(A.trend(shape(spark, sf, rows), g) for g in PERIODS)),
    lambda rows: f"WITH {parts_sql(rows)} SELECT *, 'daily' AS grain FROM daily UNION ALL SELECT *, 'weekly' FROM weekly UNION ALL SELECT *, 'monthly' FROM monthly",
)
register(
    "report_fields",
    lambda spark, sf, rows: R.field_rows("income_statement", Tables(spark, sf, rows).sections()["income_statement"]).select("business_id", "account_id", "section", "field", "value"),
    lambda rows: f"""WITH {parts_sql(rows)} SELECT business_id, account_id, 'income_statement' AS section, field, v AS value
        FROM (SELECT business_id, account_id, unnest(['income_minor', 'expense_minor', 'net_cash_flow_minor', 'savings_rate']) AS field,
                     unnest([CAST(total_income_minor AS VARCHAR), CAST(total_expense_minor AS VARCHAR), CAST(net_cash_flow_minor AS VARCHAR), CAST(CAST(savings_rate AS DECIMAL(18, 2)) AS VARCHAR)]) AS v FROM figures)""",
)
register(
    "report_list",
    lambda spark, sf, rows: R.list_rows("category_report", Tables(spark, sf, rows).categories, [F.col("amount_minor").desc(), "category"]),
    lambda rows: f"""WITH {parts_sql(rows)} SELECT business_id, account_id, 'category_report' AS section, row, field, value FROM (
        SELECT business_id, account_id, row_number() OVER (PARTITION BY business_id, account_id ORDER BY amount_minor DESC, category) - 1 AS row,
               unnest(['category', 'amount_minor', 'count', 'income_minor', 'expense_minor', 'percentage']) AS field,
               unnest([category, CAST(amount_minor AS VARCHAR), CAST(count AS VARCHAR), CAST(income_minor AS VARCHAR), CAST(expense_minor AS VARCHAR), CAST(CAST(percentage AS DECIMAL(18, 2)) AS VARCHAR)]) AS value FROM categories)""",
)
register(
    "anomaly_places",
    lambda spark, sf, rows: R.numbered(Tables(spark, sf, rows).anomalies(), R.list_orders("anomaly_report")).select("business_id", "account_id", F.col("_row").alias("row"), "type", "severity", "date_detected"),
    lambda rows: f"""WITH {parts_sql(rows)}, {final_sql(rows)} SELECT business_id, account_id, row_number() OVER (PARTITION BY business_id, account_id ORDER BY coalesce(date_detected, ''), type, severity,
        metric_value NULLS FIRST, affected_amount_minor NULLS FIRST, affected_category NULLS FIRST) - 1 AS row, type, severity, date_detected FROM found""",
)
register("report_rows", lambda spark, sf, rows: R.report_rows(Tables(spark, sf, rows).sections()))
register("report_json", lambda spark, sf, rows: R.report_json(Tables(spark, sf, rows).sections(), generated_at="2026-08-31T00:00:00+00:00"))
