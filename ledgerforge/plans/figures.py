"""Queries over scope, key figures, trends and breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exact import format_minor, masked_identifier
from ..operators import analytics as A
from ..operators import reports as R
from ..operators import scope as S
from .shapes import duck, pct_sql, shape

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def double(df, *columns: str, places: int | None = None):
    """Decimals as DOUBLE, for comparison across engines."""
    return df.withColumns({c: (F.round(c, places) if places is not None else F.col(c)).cast("double") for c in columns})


def _dates_as_text(df):
    """Results show days as text, which every reader prints alike."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def register(name: str, build, sql: str | None = None, *shapes: str) -> None:
    QUERIES[name] = lambda spark, sf: _dates_as_text(build(spark, sf))
    if sql is not None:
        ORACLE_SQL[name] = duck(sql, *shapes)


FIGURES_SQL = f"""
    SELECT a.business_id, a.account_id, CAST(coalesce(i, 0) AS BIGINT) AS total_income_minor, CAST(coalesce(e, 0) AS BIGINT) AS total_expense_minor,
           CAST(coalesce(i, 0) - coalesce(e, 0) AS BIGINT) AS net_cash_flow_minor, CAST(coalesce(n, 0) AS BIGINT) AS transaction_count,
           CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE round(CAST(coalesce(i, 0) + coalesce(e, 0) AS DOUBLE) / n, 4) END AS average_transaction_minor,
           li AS largest_income_minor, si AS smallest_income_minor, le AS largest_expense_minor, se AS smallest_expense_minor,
           a.opening_balance_minor, CAST(a.opening_balance_minor + coalesce(i, 0) - coalesce(e, 0) AS BIGINT) AS closing_balance_minor,
           CASE WHEN coalesce(e, 0) <> 0 THEN round(CAST(coalesce(i, 0) AS DOUBLE) / e, 6) END AS income_expense_ratio,
           {pct_sql("(coalesce(i, 0) - coalesce(e, 0))", "coalesce(i, 0)")} AS savings_rate
    FROM accounts a LEFT JOIN (
        SELECT business_id, account_id, count(*) AS n,
               sum(CASE WHEN direction = 'income' THEN amount_minor END) AS i, sum(CASE WHEN direction = 'expense' THEN amount_minor END) AS e,
               max(CASE WHEN direction = 'income' THEN amount_minor END) AS li, min(CASE WHEN direction = 'income' THEN amount_minor END) AS si,
               max(CASE WHEN direction = 'expense' THEN amount_minor END) AS le, min(CASE WHEN direction = 'expense' THEN amount_minor END) AS se
        FROM {{rows}} GROUP BY business_id, account_id
    ) t ON a.business_id = t.business_id AND a.account_id = t.account_id
"""
SIDES = """CAST(coalesce(sum(CASE WHEN direction = 'income' THEN amount_minor END), 0) AS BIGINT) AS income_minor,
           CAST(coalesce(sum(CASE WHEN direction = 'expense' THEN amount_minor END), 0) AS BIGINT) AS expense_minor"""


def trend_sql(period: str, rows: str) -> str:
    return f"""
        SELECT business_id, account_id, {period} AS period, {SIDES},
               CAST(sum(CASE WHEN direction = 'income' THEN amount_minor ELSE -amount_minor END) AS BIGINT) AS net_cash_flow_minor,
               count(*) AS transaction_count
        FROM {rows} GROUP BY 1, 2, 3"""


def breakdown_sql(name: str, value: str, rows: str) -> str:
    return f"""
        SELECT business_id, account_id, {name}, income_minor, expense_minor, amount_minor, n AS count,
               {pct_sql("amount_minor", "CAST(sum(amount_minor) OVER (PARTITION BY business_id, account_id) AS HUGEINT)")} AS percentage
        FROM (SELECT business_id, account_id, {value} AS {name}, {SIDES}, CAST(sum(amount_minor) AS BIGINT) AS amount_minor, count(*) AS n
              FROM {rows} GROUP BY 1, 2, 3)"""


CATEGORY = "coalesce(nullif(category, ''), 'Uncategorized')"
MODE = "CASE WHEN payment_mode IN ('Cash', 'UPI', 'Card', 'Bank') THEN payment_mode ELSE 'Other' END"
PERIODS = {"daily": "strftime(transaction_date, '%Y-%m-%d')", "weekly": "strftime(transaction_date, '%G-W%V')", "monthly": "strftime(transaction_date, '%Y-%m')"}


def _figures(rows: str):
    def build(spark, sf):
        found = A.kpis(shape(spark, sf, rows), shape(spark, sf, "accounts"))
        found = double(found, "average_transaction_minor", places=4)
        return double(double(found, "income_expense_ratio", places=6), "savings_rate")

    return build


register("kpis", _figures("ledger"), FIGURES_SQL.format(rows="ledger"), "ledger", "accounts")
register("kpis_quarter", _figures("quarter"), FIGURES_SQL.format(rows="quarter"), "quarter", "accounts")
for grain, label in PERIODS.items():
    register(f"trend_{grain}", lambda spark, sf, g=grain: A.trend(shape(spark, sf, "ledger"), g), trend_sql(label, "ledger"), "ledger")
register("category_summary", lambda spark, sf: double(A.category_summary(shape(spark, sf, "ledger")), "percentage"), breakdown_sql("category", CATEGORY, "ledger"), "ledger")
register(
    "payment_mode_summary",
    lambda spark, sf: double(A.payment_mode_summary(shape(spark, sf, "ledger")), "percentage"),
    f"""SELECT *, CAST(list_position(['Cash', 'UPI', 'Card', 'Bank', 'Other'], payment_mode) AS INTEGER) AS mode_order FROM ({breakdown_sql("payment_mode", MODE, "ledger")})""",
    "ledger",
)
for name, rows in (("account_summary", "quarter"), ("account_summary_all", "ledger")):
    register(
        name,
        lambda spark, sf, rows=rows: A.account_summary(A.kpis(shape(spark, sf, rows), shape(spark, sf, "accounts"))),
        f"""SELECT business_id, account_id, opening_balance_minor, closing_balance_minor, total_income_minor, total_expense_minor, net_cash_flow_minor, transaction_count
        FROM ({FIGURES_SQL.format(rows=rows)}) WHERE transaction_count > 0""",
        rows, "accounts",
    )
register("newest_transactions", lambda spark, sf: S.newest_first(shape(spark, sf, "ledger")).select("business_id", "account_id", "transaction_id", "transaction_date", "amount_minor"), "SELECT business_id, account_id, transaction_id, CAST(transaction_date AS VARCHAR) AS transaction_date, amount_minor FROM ledger ORDER BY transaction_date DESC, number DESC", "ledger")
register("accounts_by_name", lambda spark, sf: S.by_name(shape(spark, sf, "accounts"), "business_id", "account_id"), "SELECT * FROM accounts ORDER BY business_id, account_id", "accounts")
register("display_transactions", lambda spark, sf: R.for_display(shape(spark, sf, "ledger")), "SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, amount_minor, direction, currency, category, payment_mode, number FROM ledger", "ledger")
register("transaction_rows", lambda spark, sf: A.transaction_rows(shape(spark, sf, "ledger")), "SELECT business_id, account_id, CAST(transaction_date AS VARCHAR) AS transaction_date, amount_minor, direction, category, payment_mode FROM ledger", "ledger")
register(
    "ledger_summary",
    lambda spark, sf: A.ledger_summary(shape(spark, sf, "legacy")),
    """SELECT business_id, user_id, count(*) AS total_transactions,
              CAST(sum(CASE WHEN lower(transaction_type) = 'income' THEN amount_minor ELSE 0 END) AS BIGINT) AS total_income_minor,
              CAST(sum(CASE WHEN lower(transaction_type) = 'expense' THEN amount_minor ELSE 0 END) AS BIGINT) AS total_expense_minor,
              CAST(sum(CASE WHEN lower(transaction_type) = 'income' THEN amount_minor WHEN lower(transaction_type) = 'expense' THEN -amount_minor ELSE 0 END) AS BIGINT) AS net_cash_flow_minor
       FROM legacy GROUP BY 1, 2""",
    "legacy",
)
register(
    "budget_variance",
    lambda spark, sf: A.budget_variance(shape(spark, sf, "budgets"), shape(spark, sf, "ledger")),
    """SELECT b.business_id, b.category, b.allocated_minor, CAST(coalesce(sum(CASE WHEN direction = 'expense' THEN amount_minor END), 0) AS BIGINT) AS actual_minor,
              CAST(b.allocated_minor - coalesce(sum(CASE WHEN direction = 'expense' THEN amount_minor END), 0) AS BIGINT) AS variance_minor
       FROM budgets b LEFT JOIN ledger t ON t.business_id = b.business_id AND lower(coalesce(t.category, '')) = lower(b.category)
       GROUP BY 1, 2, 3""",
    "budgets", "ledger",
)
register(
    "scope_quarter",
    lambda spark, sf: S.scope(shape(spark, sf, "ledger"), "1998-01-01", "1998-03-31", ["biz_3", "biz_7"]).select("transaction_id", "account_id", "amount_minor"),
    "SELECT transaction_id, account_id, amount_minor FROM ledger WHERE transaction_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' AND business_id IN ('biz_3', 'biz_7')",
    "ledger",
)


def _other_currency(spark, sf):
    number = F.col("number")
    rows = shape(spark, sf, "ledger").withColumn("currency", F.when((number % 1000 == 7) & F.col("business_id").isin("biz_1", "biz_2"), "USD").otherwise(F.col("currency")))
    return rows, shape(spark, sf, "accounts")


register(
    "currency_errors",
    lambda spark, sf: S.currency_guard(*_other_currency(spark, sf))[1],
    """SELECT business_id, account_id, count(*) AS wrong_rows FROM ledger WHERE number % 1000 = 7 AND business_id IN ('biz_1', 'biz_2') GROUP BY 1, 2""",
    "ledger",
)
register("active_bridges", lambda spark, sf: S.active(shape(spark, sf, "bridges"), "bridge"), "SELECT * REPLACE (CAST(verified_at AS VARCHAR) AS verified_at) FROM bridges WHERE status = 'active' AND verified_by IS NOT NULL AND verified_at IS NOT NULL AND verified_by <> proposed_by", "bridges")
register(
    "visible_rows",
    lambda spark, sf: S.visible_to(shape(spark, sf, "ledger"), shape(spark, sf, "memberships"), "usr_2").select("transaction_id", "business_id"),
    "SELECT transaction_id, business_id FROM ledger WHERE business_id IN (SELECT business_id FROM memberships WHERE user_id = 'usr_2' AND status = 'active' AND role IN ('owner', 'manager'))",
    "ledger", "memberships",
)
register(
    "accepted_rows",
    lambda spark, sf: S.accepted(shape(spark, sf, "identities"), shape(spark, sf, "ledger").drop("source_transaction_id")),
    """SELECT i.transaction_id, i.business_id, i.account_id, CAST(i.transaction_date AS VARCHAR) AS transaction_date, i.amount_minor, i.direction, i.currency, l.category, l.payment_mode
       FROM identities i JOIN ledger l USING (transaction_id)""",
    "identities", "ledger",
)
register("user_businesses", lambda spark, sf: S.user_businesses(shape(spark, sf, "memberships"), shape(spark, sf, "businesses")),
         "SELECT m.business_id, m.user_id, m.role, m.status, b.business_name FROM memberships m JOIN businesses b USING (business_id) WHERE m.status = 'active' AND b.status = 'active'", "memberships", "businesses")
register("members", lambda spark, sf: S.members(shape(spark, sf, "memberships"), shape(spark, sf, "users")),
         "SELECT m.*, u.user_name FROM memberships m JOIN users u USING (user_id)", "memberships", "users")
register(
    "active_sessions",
    lambda spark, sf: S.active_sessions(shape(spark, sf, "sessions"), shape(spark, sf, "users"), AS_OF).select("session_id", "user_id", "user_name"),
    f"SELECT session_id, s.user_id, user_name FROM sessions s JOIN users u ON s.user_id = u.user_id WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '{(AS_OF := '2024-01-15 00:00:00')}'",
    "sessions", "users",
)
register(
    "provider_users",
    lambda spark, sf: S.provider_users(shape(spark, sf, "sessions").select(F.col("session_id").alias("subject"), "user_id"), shape(spark, sf, "users")),
    "SELECT s.user_id, session_id AS subject, user_name FROM sessions s JOIN users u ON s.user_id = u.user_id", "sessions", "users",
)
register(
    "resolved_bridges",
    lambda spark, sf: S.resolve_bridge(shape(spark, sf, "businesses"), shape(spark, sf, "bridges"), shape(spark, sf, "registry")),
    """SELECT b.business_id, g.registry_business_id, r.owner_id,
              CASE WHEN b.status <> 'active' THEN 'BUSINESS_INACTIVE' WHEN g.registry_business_id IS NULL THEN 'BRIDGE_MISSING' WHEN r.owner_id IS NULL THEN 'REGISTRY_MISSING' END AS code
       FROM businesses b LEFT JOIN (SELECT * FROM bridges WHERE status = 'active' AND verified_by IS NOT NULL AND verified_by <> proposed_by) g USING (business_id)
       LEFT JOIN registry r ON g.registry_business_id = r.registry_business_id""",
    "businesses", "bridges", "registry",
)
register(
    "foreign_counterparties",
    lambda spark, sf: S.foreign_counterparties(
        shape(spark, sf, "ledger").select("transaction_id", "business_id", F.concat(F.lit("ent_"), F.col("number") % 40).alias("entity_id")),
        shape(spark, sf, "supplier").select(F.concat(F.lit("ent_"), F.col("s_suppkey") % 40).alias("entity_id"), F.concat(F.lit("biz_"), F.col("s_nationkey")).alias("business_id")),
    ).select("transaction_id", "business_id", "entity_id"),
    """SELECT transaction_id, business_id, entity_id FROM (SELECT *, concat('ent_', number % 40) AS entity_id FROM ledger) l
       WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE concat('ent_', s_suppkey % 40) = l.entity_id AND concat('biz_', s_nationkey) = l.business_id)""",
    "ledger",
)
register(
    "shown_accounts",
    lambda spark, sf: shape(spark, sf, "accounts").select(masked_identifier(F.col("account_id")).alias("identifier"), format_minor(F.col("currency"), F.col("opening_balance_minor")).alias("balance"), "business_id"),
    """SELECT business_id, CASE WHEN length(account_id) <= 4 THEN account_id ELSE '****' || right(account_id, 4) END AS identifier,
              currency || ' ' || format('{:,.2f}', CAST(opening_balance_minor AS DOUBLE) / 100) AS balance FROM accounts""",
    "accounts",
)
