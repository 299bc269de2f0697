"""The given tables in the shape of ledgers, accounts and master data.

Each shape is one SQL text that Spark and DuckDB both run; `{orders}` and the like stand for
tables or for other shapes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

SHAPES = {
    "ledger": """
        SELECT concat('txn_', o_orderkey) AS transaction_id, concat('biz_', c_nationkey) AS business_id,
               concat('acc_', c_nationkey, '_', c_mktsegment) AS account_id, CAST(o_orderdate AS DATE) AS transaction_date,
               CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
               CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 2 = 0) THEN 'income' ELSE 'expense' END AS direction,
               'INR' AS currency, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS category,
               CASE o_orderkey % 7 WHEN 0 THEN 'Cash' WHEN 1 THEN 'UPI' WHEN 2 THEN 'Card' WHEN 3 THEN 'Bank' WHEN 4 THEN 'Cheque' WHEN 6 THEN 'UPI' END AS payment_mode,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('SRC-', o_orderkey) END AS source_transaction_id, o_orderkey AS number
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "accounts": """
        SELECT concat('biz_', c_nationkey) AS business_id, concat('acc_', c_nationkey, '_', c_mktsegment) AS account_id, 'INR' AS currency,
               CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS opening_balance_minor
        FROM {customer} GROUP BY c_nationkey, c_mktsegment""",
    "quarter": """
        SELECT * FROM {ledger} WHERE transaction_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'""",
    "coarse": """
        SELECT transaction_id, business_id, account_id, transaction_date,
               (CAST(floor(amount_minor / 1000000) AS BIGINT) + 1) * 1000000 AS amount_minor,
               direction, currency, category, payment_mode, source_transaction_id, number
        FROM {quarter}""",
    "coarse_all": """
        SELECT transaction_id, business_id, account_id, transaction_date,
               (CAST(floor(amount_minor / 1000000) AS BIGINT) + 1) * 1000000 AS amount_minor,
               direction, currency, category, payment_mode, source_transaction_id, number
        FROM {ledger}""",
    "daily_ledger": """
        SELECT concat('evt_', event_id) AS transaction_id, 'biz_events' AS business_id, concat('acc_', user_id) AS account_id,
               CAST(ts AS DATE) AS transaction_date, CAST(round(value * 100) AS BIGINT) AS amount_minor,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'income' ELSE 'expense' END AS direction, 'INR' AS currency,
               event_type AS category, 'UPI' AS payment_mode
        FROM {events} WHERE value > 0.01""",
    "businesses": """
        SELECT concat('biz_', n_nationkey) AS business_id, n_name AS business_name,
               CASE WHEN n_nationkey % 11 = 10 THEN 'disabled' ELSE 'active' END AS status FROM {nation}""",
    "memberships": """
        SELECT concat('biz_', n_nationkey) AS business_id, concat('usr_', n_regionkey) AS user_id,
               CASE n_nationkey % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'manager' WHEN 2 THEN 'member' ELSE 'viewer' END AS role,
               CASE WHEN n_nationkey % 9 = 8 THEN 'disabled' ELSE 'active' END AS status
        FROM {nation}""",
    "users": "SELECT concat('usr_', r_regionkey) AS user_id, r_name AS user_name FROM {region}",
    "bridges": """
        SELECT concat('biz_', n_nationkey) AS business_id, concat('reg_', n_nationkey) AS registry_business_id,
               'usr_a' AS proposed_by, CASE WHEN n_nationkey % 7 = 3 THEN 'usr_a' WHEN n_nationkey % 7 = 5 THEN NULL ELSE 'usr_b' END AS verified_by,
               DATE '2026-01-01' AS verified_at, CASE WHEN n_nationkey % 8 = 6 THEN 'revoked' ELSE 'active' END AS status
        FROM {nation}""",
    "registry": """
        SELECT concat('reg_', n_nationkey) AS registry_business_id, concat('usr_', n_regionkey) AS owner_id FROM {nation} WHERE n_nationkey % 10 <> 9""",
    "budgets": """
        SELECT concat('biz_', n_nationkey) AS business_id, CASE WHEN n_nationkey % 2 = 0 THEN upper(category) ELSE lower(category) END AS category,
               CAST((n_nationkey + 1) * 10000000 AS BIGINT) AS allocated_minor
        FROM {nation} CROSS JOIN (SELECT DISTINCT category FROM {ledger} WHERE category IS NOT NULL) c""",
    "legacy": """
        SELECT transaction_id, business_id, concat('usr_', number % 5) AS user_id, transaction_date, amount_minor,
               CASE WHEN number % 3 = 0 THEN upper(direction) ELSE direction END AS transaction_type, category, payment_mode, number
        FROM {ledger}""",
    "sessions": """
        SELECT concat('ses_', event_id) AS session_id, concat('usr_', user_id % 5) AS user_id, ts + INTERVAL 1 DAY AS expires_at,
               CASE WHEN event_id % 6 = 0 THEN ts END AS revoked_at FROM {events}""",
    "identities": """
        SELECT concat('idn_', number) AS identity_id, transaction_id, business_id, account_id, 'bank' AS source_system, source_transaction_id,
               currency, transaction_date, amount_minor + CASE WHEN number % 200 = 13 THEN 1 ELSE 0 END AS amount_minor, direction, number
        FROM {ledger} WHERE number % 10 = 3""",
    "batch": """
        SELECT number % 50 AS batch_id, number AS position, business_id, account_id, 'bank' AS source_system, source_transaction_id, currency, transaction_date, amount_minor, direction, category, payment_mode FROM {ledger}
        UNION ALL
        SELECT number % 50, number + 100000000, business_id, account_id, 'bank', source_transaction_id, currency, transaction_date, amount_minor, direction, category, payment_mode FROM {ledger} WHERE number % 20 = 0
        UNION ALL
        SELECT number % 50, number + 200000000, business_id, account_id, 'bank', source_transaction_id, currency, transaction_date, amount_minor + 1, direction, category, payment_mode FROM {ledger} WHERE number % 977 = 0""",
    "uploads": """
        SELECT * FROM {batch}
        UNION ALL
        SELECT (number * 7 + 3) % 50, number + 300000000, business_id, account_id, 'bank', source_transaction_id, currency, transaction_date, amount_minor, direction, category, payment_mode FROM {ledger} WHERE number % 3 = 1
        UNION ALL
        SELECT (number * 11 + 5) % 50, number + 400000000, business_id, account_id, 'bank', source_transaction_id, currency, transaction_date, amount_minor + 7, direction, category, payment_mode FROM {ledger} WHERE number % 1301 = 0
        UNION ALL
        SELECT (number * 13 + 1) % 50, number + 500000000, business_id, account_id, 'bank', source_transaction_id, currency, transaction_date, amount_minor + 7, direction, category, payment_mode FROM {ledger} WHERE number % 1301 = 0""",
    "attempts": """
        SELECT concat('att_', event_id) AS attempt_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('att_', event_id - 1) END AS parent_attempt_id FROM {events}""",
    "attempt_events": """
        SELECT concat('att_', event_id) AS attempt_id, ts AS event_time, 'processing' AS status FROM {events}
        UNION ALL SELECT concat('att_', event_id), ts + INTERVAL 1 HOUR, CASE WHEN event_id % 4 = 1 THEN 'failed' ELSE 'completed' END FROM {events} WHERE event_id % 5 <> 2
        UNION ALL SELECT concat('att_', event_id), ts + INTERVAL 2 HOUR, 'failed' FROM {events} WHERE event_id % 15 = 4""",
    "main_account": """
        SELECT concat('biz_', c_nationkey) AS business_id, CAST(o_orderdate AS DATE) AS date,
               CASE o_orderstatus WHEN 'F' THEN 'Sales Revenue' WHEN 'O' THEN 'Operating Expense' ELSE 'COGS' END AS category,
               CASE o_orderstatus WHEN 'F' THEN 'Credit' ELSE 'Debit' END AS type, CAST(o_totalprice AS DECIMAL(18, 2)) AS amount
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "card_account": """
        SELECT concat('biz_', s_nationkey) AS business_id, CASE l_returnflag WHEN 'R' THEN 'Payment' WHEN 'A' THEN NULL ELSE 'Supplies' END AS category,
               CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "payroll": "SELECT concat('biz_', s_nationkey) AS business_id, CAST(abs(s_acctbal) AS DECIMAL(18, 2)) AS amount FROM {supplier}",
    "schemes": """
        SELECT * FROM (VALUES
            ('S1', 'Machinery', 'MACHINERY', 0, 5000000, 'Any', 'Micro', 18, NULL), ('S2', 'Building', 'BUILDING', 0, 2000000, 'Any', 'Micro', 18, NULL),
            ('S3', 'Guarantee', 'Any', 0, 100000000, 'Any', 'Micro', NULL, NULL), ('S4', 'Guarantee', 'Any', 0, 100000000, 'Any', 'Small', NULL, NULL),
            ('S5', 'Starter', 'Any', 0, 50000, 'Any', 'Micro', 18, 65), ('S6', 'Growth', 'Any', 50001, 500000, 'Any', 'Micro', 18, 65),
            ('S7', 'Scale', 'Any', 500001, 1000000, '7', 'Micro', 18, 65), ('S8', 'Large', 'Any', 1000001, 2000000, 'Any', 'Micro', 18, 65),
            ('S9', 'Stand', 'Any', 0, 100000000, 'Any', 'Small', 18, NULL), ('S10', 'Startup', 'Any', 0, 200000000, '3', 'Startup', NULL, 40)
        ) AS s(scheme_id, scheme_name, sector, min_turnover, max_turnover, applicable_states, business_category, min_age, max_age)""",
    "part_schemes": """
        SELECT concat('P', p_partkey) AS scheme_id, p_name AS scheme_name, CASE p_partkey % 4 WHEN 0 THEN 'Any' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'MACHINERY' ELSE 'AUTOMOBILE' END AS sector,
               CAST(p_size AS DOUBLE) * 90000 AS min_turnover, CAST(p_size AS DOUBLE) * 90000 + p_retailprice * 100 AS max_turnover,
               CASE WHEN p_partkey % 5 = 0 THEN 'Any' ELSE CAST(p_partkey % 25 AS VARCHAR(10)) END AS applicable_states,
               CASE p_partkey % 3 WHEN 0 THEN 'Any' WHEN 1 THEN 'Micro' ELSE 'Small' END AS business_category,
               CASE WHEN p_partkey % 7 < 3 THEN 18 + p_partkey % 20 END AS min_age, CASE WHEN p_partkey % 11 < 5 THEN 60 - p_partkey % 20 END AS max_age
        FROM {part}""",
    "profiles": """
        SELECT concat('biz_', c_custkey) AS business_id, c_acctbal * 1000 AS turnover, CAST(c_nationkey AS VARCHAR(10)) AS state, c_mktsegment AS sector,
               CASE c_custkey % 3 WHEN 0 THEN 'Micro' WHEN 1 THEN 'Small' ELSE 'Startup' END AS business_category, 18 + c_custkey % 60 AS owner_age
        FROM {customer}""",
}


def _needs(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shape or given table as a DataFrame."""
    if name not in SHAPES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return query(spark, sf_dir, SHAPES[name])


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    parts = {need: shape(spark, sf_dir, need) for need in set(_needs(sql))}
    return spark.sql(sql, **parts)


def duck(sql: str, *shapes: str) -> str:
    """`sql` for DuckDB with the named shapes, and those they need, as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in SHAPES and name not in order:
            for need in _needs(SHAPES[name]):
                visit(need)
            order.append(name)

    for name in shapes:
        visit(name)
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', SHAPES[n])})" for n in order]
    joined = ",\n".join(parts)
    text = sql.strip()
    if not parts:
        return text
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {joined},\n{text[len('WITH RECURSIVE '):]}"
    return f"WITH {joined},\n{text[5:]}" if text.upper().startswith("WITH ") else f"WITH {joined}\n{text}"


def pct_sql(n: str, d: str, scale: int = 100) -> str:
    """`hundredths` of functions.exact in DuckDB, as DOUBLE."""
    whole = f"(abs(CAST({n} AS HUGEINT)) * {200 * scale} + abs(CAST({d} AS HUGEINT))) // (2 * abs(CAST({d} AS HUGEINT)))"
    return f"(CASE WHEN ({d}) <> 0 THEN CAST(sign({n}) * sign({d}) * ({whole}) AS DOUBLE) / 100 END)"


def pct0_sql(n: str, d: str, scale: int = 100) -> str:
    return f"coalesce({pct_sql(n, d, scale)}, 0.0)"
