"""Queries over identities, contracts, constraints, profiles, schemes, chunks and statement text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact as X
from ..functions import text as T
from ..operators import contract as C
from ..operators import eligibility as E
from ..operators import identity as D
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import retrieval as M
from ..operators import statements as ST
from ..streaming.ingest import ingest
from .figures import _dates_as_text, double
from .shapes import duck, pct0_sql, pct_sql, query, shape

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, build, sql: str | None = None, *shapes: str) -> None:
    QUERIES[name] = lambda spark, sf: _dates_as_text(build(spark, sf))
    if sql is not None:
        ORACLE_SQL[name] = duck(sql, *shapes)


IDENTITY_SQL = """sha256('["v1","' || account_id || '","' || source_system || '","' || currency || '","' || strftime(transaction_date, '%Y-%m-%d') || '",' || amount_minor || ',"' || direction || '"]')"""


def _stored(spark, sf) -> DataFrame:
    return D.with_hash(shape(spark, sf, "identities"))


def _batch(spark, sf) -> DataFrame:
    return D.with_hash(shape(spark, sf, "batch"))


def _judged(spark, sf) -> DataFrame:
    return D.classify_within(D.classify(_batch(spark, sf), _stored(spark, sf)))


register(
    "identity_hash",
    lambda spark, sf: D.with_hash(shape(spark, sf, "ledger").withColumn("source_system", F.lit("bank"))).select("transaction_id", "canonical_identity_hash"),
    f"SELECT transaction_id, {IDENTITY_SQL} AS canonical_identity_hash FROM (SELECT *, 'bank' AS source_system FROM ledger)",
    "ledger",
)
register(
    "identity_hash_odd",
    lambda spark, sf: D.with_hash(shape(spark, sf, "ledger").withColumns({"source_system": F.lit('say "bank"'), "account_id": F.concat(F.lit("\t"), "account_id", F.lit("\x1f\\\\"))})).select("transaction_id", "canonical_identity_hash"),
    """SELECT transaction_id, sha256('["v1","\\t' || account_id || '\\u001f\\\\\\\\","say \\"bank\\"","' || currency || '","' || strftime(transaction_date, '%Y-%m-%d') || '",' || amount_minor || ',"' || direction || '"]') AS canonical_identity_hash FROM ledger""",
    "ledger",
)
register(
    "ledger_hash",
    lambda spark, sf: shape(spark, sf, "legacy").select("transaction_id", D.ledger_hash(F.col("business_id"), F.lit(None).cast("string"), F.col("transaction_date"), X.major_units(F.col("amount_minor")), F.col("transaction_type"), F.col("category"), F.col("payment_mode"), F.lit("  Monthly   Bill "), F.col("user_id")).alias("transaction_hash")),
    """SELECT transaction_id, sha256(lower(business_id) || '||' || CAST(transaction_date AS VARCHAR) || '|' || CAST(amount_minor // 100 AS VARCHAR) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0')
              || '|' || lower(transaction_type) || '|' || lower(coalesce(category, '')) || '|' || lower(coalesce(payment_mode, '')) || '|monthly bill|' || lower(user_id)) AS transaction_hash FROM legacy""",
    "legacy",
)
CLASSIFY_SQL = f"""
    WITH hashed AS (SELECT *, {IDENTITY_SQL} AS h FROM batch), stored AS (SELECT *, {IDENTITY_SQL} AS h FROM identities),
    judged AS (
        SELECT b.*, coalesce(s.identity_id, t.identity_id) AS existing_identity_id,
               CASE WHEN s.identity_id IS NOT NULL THEN CASE WHEN s.h = b.h THEN 'DUPLICATE_SOURCE_ID' ELSE 'SOURCE_IDENTITY_CONFLICT' END
                    WHEN t.identity_id IS NOT NULL THEN 'DUPLICATE_CANONICAL_IDENTITY' ELSE 'UNIQUE' END AS first_outcome
        FROM hashed b LEFT JOIN stored s ON s.business_id = b.business_id AND s.account_id = b.account_id AND s.source_transaction_id = b.source_transaction_id
        LEFT JOIN stored t ON t.business_id = b.business_id AND t.account_id = b.account_id AND t.h = b.h),
    ranked AS (SELECT *, CASE WHEN source_transaction_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY batch_id, source_transaction_id ORDER BY position) END AS ns,
               source_transaction_id IS NOT NULL AND min(h) OVER (PARTITION BY batch_id, source_transaction_id) <> max(h) OVER (PARTITION BY batch_id, source_transaction_id) AS clash,
               row_number() OVER (PARTITION BY batch_id, h ORDER BY position) AS nh FROM judged),
    within_batch AS (SELECT *, CASE WHEN clash AND ns > 1 THEN 'SOURCE_IDENTITY_CONFLICT' WHEN first_outcome <> 'UNIQUE' THEN first_outcome
               WHEN ns > 1 THEN 'DUPLICATE_SOURCE_ID' WHEN nh > 1 THEN 'DUPLICATE_CANONICAL_IDENTITY' ELSE 'UNIQUE' END AS outcome FROM ranked)
    """
register("classify_stored", lambda spark, sf: D.classify(_batch(spark, sf), _stored(spark, sf)).select("batch_id", "position", "outcome", "existing_identity_id"),
         CLASSIFY_SQL + "SELECT batch_id, position, first_outcome AS outcome, existing_identity_id FROM judged", "batch", "identities")
register("classify_batch", lambda spark, sf: _judged(spark, sf).select("batch_id", "position", "outcome"), CLASSIFY_SQL + "SELECT batch_id, position, outcome FROM within_batch", "batch", "identities")
VERDICT_SQL = """SELECT batch_id, n AS record_count, CASE WHEN bad THEN 0 ELSE u END AS inserted_count, CASE WHEN bad THEN 0 ELSE d END AS duplicate_count, CAST(0 AS BIGINT) AS rejected_count,
    CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN 'IDENTITY_CONFLICT' END AS code
    FROM (SELECT batch_id, count(*) AS n, count(*) FILTER (WHERE outcome = 'UNIQUE') AS u, count(*) FILTER (WHERE outcome LIKE 'DUPLICATE%') AS d, bool_or(outcome LIKE '%CONFLICT') AS bad FROM within_batch GROUP BY 1)"""
register("batch_verdicts", lambda spark, sf: D.batch_verdict(_judged(spark, sf)), CLASSIFY_SQL + VERDICT_SQL, "batch", "identities")
register(
    "ingested_rows",
    lambda spark, sf: ingest(shape(spark, sf, "batch"), _stored(spark, sf))[0].select("batch_id", "position", "amount_minor"),
    CLASSIFY_SQL + "SELECT batch_id, position, amount_minor FROM within_batch WHERE outcome = 'UNIQUE' AND batch_id NOT IN (SELECT batch_id FROM within_batch WHERE outcome LIKE '%CONFLICT')",
    "batch", "identities",
)
#: Batch after batch: which of them fail, given those before that failed. Only rows whose source id
#: another batch gives a different identity are looked at.
SEQUENCE_SQL = f"""
    WITH RECURSIVE hashed AS (SELECT *, {IDENTITY_SQL} AS h FROM uploads), stored AS (SELECT *, {IDENTITY_SQL} AS h FROM identities),
    judged AS (
        SELECT b.*, s.identity_id IS NOT NULL AS s_known, s.identity_id IS NOT NULL AND s.h <> b.h AS s_clash, t.identity_id IS NOT NULL AS h_known,
               b.source_transaction_id IS NOT NULL AND min(b.h) OVER (PARTITION BY batch_id, b.source_transaction_id) <> max(b.h) OVER (PARTITION BY batch_id, b.source_transaction_id) AS inner_clash
        FROM hashed b LEFT JOIN stored s ON s.business_id = b.business_id AND s.account_id = b.account_id AND s.source_transaction_id = b.source_transaction_id
        LEFT JOIN stored t ON t.business_id = b.business_id AND t.account_id = b.account_id AND t.h = b.h),
    claims AS (SELECT DISTINCT batch_id, account_id, source_transaction_id AS s, h FROM judged WHERE source_transaction_id IS NOT NULL AND NOT s_known),
    told AS (SELECT account_id, s, list({{'b': batch_id, 'h': h}} ORDER BY batch_id) AS all_of FROM claims GROUP BY 1, 2 HAVING min(h) <> max(h)),
    edges AS (SELECT c.batch_id, list({{'h': c.h, 'before': list_filter(t.all_of, lambda x: x.b < c.batch_id)}}) AS rows FROM claims c JOIN told t ON t.account_id = c.account_id AND t.s = c.s GROUP BY 1),
    own AS (SELECT batch_id, bool_or(s_clash OR inner_clash) AS bad FROM judged GROUP BY 1),
    walk AS (
        SELECT CAST(-1 AS BIGINT) AS b, CAST([] AS BIGINT[]) AS failed
        UNION ALL
        SELECT w.b + 1, CASE WHEN o.bad OR list_bool_or(list_transform(coalesce(e.rows, []), lambda r: list_filter(r.before, lambda x: NOT list_contains(w.failed, x.b))[1].h <> r.h)) THEN list_append(w.failed, w.b + 1) ELSE w.failed END
        FROM walk w LEFT JOIN own o ON o.batch_id = w.b + 1 LEFT JOIN edges e ON e.batch_id = w.b + 1 WHERE w.b < 49),
    failures AS (SELECT unnest(failed) AS batch_id FROM walk WHERE b = 49),
    inserted AS (SELECT * FROM judged WHERE NOT s_known AND NOT h_known AND batch_id NOT IN (SELECT batch_id FROM failures) QUALIFY row_number() OVER (PARTITION BY account_id, h ORDER BY batch_id, position) = 1)
    """
register(
    "sequenced_uploads",
    lambda spark, sf: ingest(shape(spark, sf, "uploads"), _stored(spark, sf))[0].select("batch_id", "position", "account_id", "amount_minor"),
    SEQUENCE_SQL + "SELECT batch_id, position, account_id, amount_minor FROM inserted",
    "uploads", "identities",
)
register(
    "sequenced_verdicts",
    lambda spark, sf: ingest(shape(spark, sf, "uploads"), _stored(spark, sf))[1],
    SEQUENCE_SQL + """SELECT j.batch_id, count(*) AS record_count, CASE WHEN f.batch_id IS NULL THEN count(i.position) ELSE 0 END AS inserted_count, CASE WHEN f.batch_id IS NULL THEN count(*) - count(i.position) ELSE 0 END AS duplicate_count,
        CAST(0 AS BIGINT) AS rejected_count, CASE WHEN f.batch_id IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN f.batch_id IS NOT NULL THEN 'IDENTITY_CONFLICT' END AS code
        FROM judged j LEFT JOIN failures f ON f.batch_id = j.batch_id LEFT JOIN inserted i ON i.batch_id = j.batch_id AND i.position = j.position AND i.h = j.h GROUP BY j.batch_id, f.batch_id""",
    "uploads", "identities",
)
register(
    "repeated_ledger_rows",
    lambda spark, sf: D.flag_repeats(_legacy_twice(spark, sf)).filter("duplicate").select("transaction_id", "business_id"),
    """SELECT transaction_id || '_again' AS transaction_id, business_id FROM legacy WHERE number % 7 = 0""",
    "legacy",
)


def _legacy_twice(spark, sf) -> DataFrame:
    rows = shape(spark, sf, "legacy").withColumns({"transaction_hash": F.sha2("transaction_id", 256), "created_at": F.col("transaction_date")})
    again = rows.filter("number % 7 = 0").withColumn("transaction_id", F.concat("transaction_id", F.lit("_again")))
    return rows.unionByName(again)


register("retry_depth", lambda spark, sf: D.retry_depth(shape(spark, sf, "attempts")),
         "SELECT concat('att_', event_id) AS attempt_id, CAST(event_id % 10 AS BIGINT) AS retry_count, CAST(NULL AS VARCHAR) AS code FROM events WHERE (SELECT count(*) FROM attempts) > 0", "attempts")
register(
    "attempt_status",
    lambda spark, sf: D.attempt_status(shape(spark, sf, "attempt_events")),
    """SELECT attempt_id, coalesce(arg_min(status, event_time) FILTER (WHERE status <> 'processing'), 'processing') AS status FROM attempt_events GROUP BY 1""",
    "attempt_events",
)
BAD_RECORDS = """
    SELECT o_orderkey AS number,
           CASE WHEN o_orderkey % 11 = 1 THEN '1998-02-31' WHEN o_orderkey % 11 = 2 THEN '31/01/1998' WHEN o_orderkey % 11 = 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS transaction_date,
           CASE WHEN o_orderkey % 13 = 1 THEN 0 WHEN o_orderkey % 13 = 2 THEN 100000000000000 WHEN o_orderkey % 13 = 3 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS amount_minor,
           CASE WHEN o_orderkey % 17 = 1 THEN 'Income' WHEN o_orderkey % 17 = 2 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'income' ELSE 'expense' END AS direction,
           CASE WHEN o_orderkey % 19 = 1 THEN repeat('x', 101) WHEN o_orderkey % 19 = 2 THEN ' padded' WHEN o_orderkey % 19 = 3 THEN '' ELSE o_orderpriority END AS category
    FROM {orders}"""
register(
    "check_records",
    lambda spark, sf: C.check_records(query(spark, sf, BAD_RECORDS)).select("number", "code", "field"),
    f"""SELECT number, split_part(v, ':', 1) AS code, split_part(v, ':', 2) AS field FROM (SELECT number, CASE
          WHEN transaction_date IS NULL THEN 'INVALID_FIELD:transaction_date' WHEN amount_minor IS NULL THEN 'INVALID_FIELD:amount_minor' WHEN direction IS NULL THEN 'INVALID_FIELD:direction'
          WHEN TRY_CAST(CASE WHEN regexp_full_match(transaction_date, '\\d{{4}}-\\d\\d-\\d\\d') THEN transaction_date END AS DATE) IS NULL THEN 'INVALID_FIELD:transaction_date'
          WHEN amount_minor NOT BETWEEN 1 AND 99999999999999 THEN 'AMOUNT_OUT_OF_RANGE:amount_minor' WHEN direction NOT IN ('income', 'expense') THEN 'INVALID_FIELD:direction'
          WHEN category = '' OR trim(category) <> category THEN 'INVALID_FIELD:category' WHEN length(category) > 100 THEN 'TEXT_TOO_LONG:category' END AS v
        FROM ({BAD_RECORDS.replace("{orders}", "orders")}))""",
)
register(
    "check_envelopes",
    lambda spark, sf: C.check_envelopes(
        shape(spark, sf, "batch").groupBy("batch_id").agg(F.collect_list("position").alias("records")).select(
            "batch_id", F.when(F.col("batch_id") % 9 == 1, "v0").when(F.col("batch_id") % 9 != 2, "v1").alias("contract_version"), F.when(F.col("batch_id") % 7 == 1, "till").otherwise("bank").alias("source_system"), "records"),
        "v1", "bank", 320).select("batch_id", "code", "field"),
    """SELECT batch_id, split_part(v, ':', 1) AS code, split_part(v, ':', 2) AS field FROM (SELECT batch_id, CASE WHEN batch_id % 9 = 2 THEN 'INVALID_FIELD:contract_version' WHEN batch_id % 9 = 1 THEN 'UNSUPPORTED_CONTRACT_VERSION:contract_version'
              WHEN batch_id % 7 = 1 THEN 'UNSUPPORTED_SOURCE_SYSTEM:source_system' WHEN count(*) > 320 THEN 'RECORD_COUNT_OUT_OF_RANGE:records' END AS v FROM batch GROUP BY 1)""",
    "batch",
)
register(
    "check_accounts",
    lambda spark, sf: C.check_accounts(shape(spark, sf, "customer").select(
        "c_custkey", F.substring("c_name", 1, F.col("c_custkey").cast("int") % 9).alias("account_name"), F.when(F.col("c_custkey") % 5 == 0, "wallet").otherwise("bank").alias("account_type"),
        F.when(F.col("c_custkey") % 7 == 0, "inr").otherwise("INR").alias("currency"), F.lit(None).cast("string").alias("account_identifier"), (F.col("c_custkey") / F.lit(1000)).cast("decimal(18,3)").alias("opening_balance")))
    .select("c_custkey", F.array_join("errors", ",").alias("errors")),
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN length(trim(substr(c_name, 1, CAST(c_custkey % 9 AS INTEGER)))) NOT BETWEEN 2 AND 120 THEN 'name' END, CASE WHEN c_custkey % 5 = 0 THEN 'type' END,
              CASE WHEN c_custkey % 7 = 0 THEN 'currency' END, CASE WHEN c_custkey % 10 <> 0 THEN 'balance' END], lambda x: x IS NOT NULL), ',') AS errors FROM customer""",
)
register(
    "check_businesses",
    lambda spark, sf: C.check_businesses(shape(spark, sf, "supplier").select(
        "s_suppkey", F.col("s_name").alias("business_name"), F.lit("L-1").alias("legal_id"), F.when(F.col("s_suppkey") % 3 == 0, "not an address").otherwise("a@b.example").alias("email"),
        F.when(F.col("s_suppkey") % 4 == 0, "12").otherwise("+4912345678").alias("phone"))).select("s_suppkey", F.array_join("errors", ",").alias("errors")),
    """SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'email' END, CASE WHEN s_suppkey % 4 = 0 THEN 'phone' END], lambda x: x IS NOT NULL), ',') AS errors FROM supplier""",
)
register("duplicate_keys", lambda spark, sf: Q.duplicates(shape(spark, sf, "batch"), ["batch_id", "source_transaction_id"], F.col("source_transaction_id").isNotNull()),
         "SELECT batch_id, source_transaction_id, count(*) AS n FROM batch WHERE source_transaction_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1", "batch")
register("orphan_rows", lambda spark, sf: Q.orphans(shape(spark, sf, "bridges"), shape(spark, sf, "registry"), "registry_business_id").select("business_id", "registry_business_id"),
         "SELECT business_id, registry_business_id FROM bridges WHERE registry_business_id NOT IN (SELECT registry_business_id FROM registry)", "bridges", "registry")
register(
    "value_violations",
    lambda spark, sf: Q.violations(shape(spark, sf, "bridges"), {"verified": F.col("verified_by").isNotNull() | (F.col("status") != "active"), "two_people": F.col("verified_by") != F.col("proposed_by")}).select("business_id", "rule"),
    """SELECT business_id, 'verified' AS rule FROM bridges WHERE verified_by IS NULL AND status = 'active' UNION ALL SELECT business_id, 'two_people' FROM bridges WHERE verified_by = proposed_by""",
    "bridges",
)
register(
    "identity_disagreements",
    lambda spark, sf: Q.disagreements(shape(spark, sf, "identities"), shape(spark, sf, "ledger").filter("number % 50 <> 3").select("transaction_id", X.major_units(F.col("amount_minor")).alias("amount"), "transaction_date", F.col("direction").alias("transaction_type"))),
    """SELECT i.transaction_id, CASE WHEN i.number % 50 = 3 THEN 'LEDGER_ROW_MISSING' ELSE 'AMOUNT' END AS reason FROM identities i WHERE i.number % 50 = 3 OR i.number % 200 = 13""",
    "identities", "ledger",
)
PL_SQL = """
    SELECT business_id, CAST(revenue_total AS DOUBLE) AS revenue_total, CAST(operating_expense AS DOUBLE) AS operating_expense, CAST(cogs AS DOUBLE) AS cogs, round(years_covered, 6) AS years_covered,
           CAST(coalesce(card_spend, 0) AS DOUBLE) AS card_spend, CAST(coalesce(payroll, 0) AS DOUBLE) AS payroll,
           CAST(operating_expense + cogs + coalesce(card_spend, 0) + coalesce(payroll, 0) AS DOUBLE) AS total_expenses,
           CAST(revenue_total - (operating_expense + cogs + coalesce(card_spend, 0) + coalesce(payroll, 0)) AS DOUBLE) AS net_profit,
           round(CAST(revenue_total - (operating_expense + cogs + coalesce(card_spend, 0) + coalesce(payroll, 0)) AS DOUBLE) * 100 / CAST(revenue_total AS DOUBLE), 4) AS net_profit_margin,
           round(CAST(revenue_total AS DOUBLE) / years_covered, 2) AS annual_turnover
    FROM (SELECT business_id, sum(CASE WHEN category = 'Sales Revenue' THEN amount ELSE 0 END) AS revenue_total, sum(CASE WHEN category = 'Operating Expense' THEN amount ELSE 0 END) AS operating_expense,
                 sum(CASE WHEN category = 'COGS' THEN amount ELSE 0 END) AS cogs, greatest(date_diff('day', min(date), max(date)) / 365.0, 1.0) AS years_covered FROM main_account GROUP BY 1)
    LEFT JOIN (SELECT business_id, sum(CASE WHEN category IS DISTINCT FROM 'Payment' THEN amount ELSE 0 END) AS card_spend FROM card_account GROUP BY 1) USING (business_id)
    LEFT JOIN (SELECT business_id, sum(amount) AS payroll FROM payroll GROUP BY 1) USING (business_id)"""


def _profit(spark, sf) -> DataFrame:
    return P.profit_and_loss(shape(spark, sf, "main_account"), shape(spark, sf, "card_account"), shape(spark, sf, "payroll"))


def _profit_shown(spark, sf) -> DataFrame:
    found = double(_profit(spark, sf), "revenue_total", "operating_expense", "cogs", "card_spend", "payroll", "total_expenses", "net_profit")
    return double(double(double(found, "years_covered", places=6), "net_profit_margin", places=4), "annual_turnover", places=2)


register("profit_and_loss", _profit_shown, PL_SQL, "main_account", "card_account", "payroll")
register(
    "table_profile",
    lambda spark, sf: P.profile(shape(spark, sf, "main_account"), "date"),
    """SELECT '*' AS column_name, 'rows' AS measure, CAST(count(*) AS VARCHAR) AS value FROM main_account UNION ALL SELECT 'date', 'first', CAST(min(date) AS VARCHAR) FROM main_account
       UNION ALL SELECT 'date', 'last', CAST(max(date) AS VARCHAR) FROM main_account
       UNION ALL SELECT 'category', 'values', (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT category AS c FROM main_account)) UNION ALL SELECT 'type', 'values', (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT type AS c FROM main_account))
       UNION ALL SELECT unnest(['business_id', 'date', 'category', 'type', 'amount']), 'missing', unnest([CAST(count(*) - count(business_id) AS VARCHAR), CAST(count(*) - count(date) AS VARCHAR), CAST(count(*) - count(category) AS VARCHAR), CAST(count(*) - count(type) AS VARCHAR), CAST(count(*) - count(amount) AS VARCHAR)]) FROM main_account""",
    "main_account",
)
register("first_ledger_rows", lambda spark, sf: P.first_rows(shape(spark, sf, "ledger").select("transaction_id", "transaction_date", "amount_minor"), ["transaction_date", "transaction_id"]),
         "SELECT transaction_id, CAST(transaction_date AS VARCHAR) AS transaction_date, amount_minor, row_number() OVER (ORDER BY ledger.transaction_date, transaction_id) AS row FROM ledger QUALIFY row <= 3", "ledger")
register("source_totals", lambda spark, sf: double(P.source_totals(shape(spark, sf, "main_account"), "business_id"), "credit", "debit", "net"),
         """SELECT business_id, CAST(sum(CASE WHEN type = 'Credit' THEN amount ELSE 0 END) AS DOUBLE) AS credit, CAST(sum(CASE WHEN type = 'Debit' THEN amount ELSE 0 END) AS DOUBLE) AS debit,
            CAST(sum(CASE WHEN type = 'Credit' THEN amount ELSE -amount END) AS DOUBLE) AS net FROM main_account GROUP BY 1""", "main_account")  # fmt: skip
register("distinct_categories", lambda spark, sf: P.distinct_categories(shape(spark, sf, "ledger"), ["account_id"]), "SELECT DISTINCT account_id, category FROM ledger", "ledger")
FITS = """p.turnover BETWEEN s.min_turnover AND s.max_turnover AND s.applicable_states IN ('Any', p.state) AND s.sector IN ('Any', p.sector) AND s.business_category IN ('Any', p.business_category)
          AND (s.min_age IS NULL OR p.owner_age >= s.min_age) AND (s.max_age IS NULL OR p.owner_age <= s.max_age)"""
register(
    "eligibility",
    lambda spark, sf: E.eligibility(shape(spark, sf, "profiles"), shape(spark, sf, "schemes")).select("business_id", "scheme_id", "eligible", F.array_join(F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["check"]), "; ").alias("failed"), F.size("checks").cast("long").alias("checks")),
    f"""SELECT business_id, scheme_id, {FITS} AS eligible,
        array_to_string(list_filter([CASE WHEN NOT p.turnover BETWEEN s.min_turnover AND s.max_turnover THEN 'Turnover within range' END, CASE WHEN s.applicable_states NOT IN ('Any', p.state) THEN 'State matches' END,
            CASE WHEN s.sector NOT IN ('Any', p.sector) THEN 'Sector matches' END, CASE WHEN s.business_category NOT IN ('Any', p.business_category) THEN 'Business category matches' END,
            CASE WHEN p.owner_age < s.min_age THEN 'Owner age >= ' || CAST(s.min_age AS VARCHAR) END, CASE WHEN p.owner_age > s.max_age THEN 'Owner age <= ' || CAST(s.max_age AS VARCHAR) END], lambda x: x IS NOT NULL), '; ') AS failed,
        CAST(4 + CASE WHEN s.min_age IS NULL THEN 0 ELSE 1 END + CASE WHEN s.max_age IS NULL THEN 0 ELSE 1 END AS BIGINT) AS checks
        FROM profiles p, schemes s""",
    "profiles", "schemes",
)
register("eligible_names", lambda spark, sf: E.eligible_names(shape(spark, sf, "profiles"), shape(spark, sf, "schemes")), f"SELECT DISTINCT business_id, scheme_name FROM profiles p, schemes s WHERE {FITS}", "profiles", "schemes")
register("eligible_parts", lambda spark, sf: E.eligible_names(shape(spark, sf, "profiles"), shape(spark, sf, "part_schemes")), f"SELECT DISTINCT business_id, scheme_name FROM profiles p, part_schemes s WHERE {FITS}", "profiles", "part_schemes")
register(
    "turnover_profiles",
    lambda spark, sf: E.profile_from_kpis(_profit_shown(spark, sf), shape(spark, sf, "businesses")),
    f"SELECT b.business_id, business_name, status, annual_turnover AS turnover FROM businesses b JOIN ({PL_SQL}) USING (business_id)",
    "businesses", "main_account", "card_account", "payroll",
)
register(
    "chunks_fixed",
    lambda spark, sf: M.chunk_fixed(shape(spark, sf, "documents")).select("doc_id", "source", "chunk_index", F.char_length("chunk_text").cast("long").alias("chars"), F.md5("chunk_text").alias("chunk_md5")),
    """SELECT doc_id, source, CAST(i AS INTEGER) AS chunk_index, length(substr(text, 1 + 450 * i, 500)) AS chars, md5(substr(text, 1 + 450 * i, 500)) AS chunk_md5
       FROM (SELECT doc_id, source, text, unnest(range(0, (length(text) - 1) // 450 + 1)) AS i FROM documents WHERE length(text) > 0)""",
)
BEHIND = lambda mark: f"nullif(length(regexp_extract(substr(text, start + 251, 250), '(?s)^.*{mark}')), 0)"
register(
    "chunks",
    lambda spark, sf: M.chunk(shape(spark, sf, "documents")).select("doc_id", "source", "chunk_index", F.char_length("chunk_text").cast("long").alias("chars"), F.md5("chunk_text").alias("chunk_md5")),
    f"""WITH RECURSIVE walk AS (
            SELECT doc_id, CAST(0 AS INTEGER) AS chunk_index, CAST(0 AS BIGINT) AS start, CAST(-1 AS BIGINT) AS until FROM documents WHERE length(text) > 0
            UNION ALL
            SELECT doc_id, chunk_index + CASE WHEN until < 0 THEN 0 ELSE 1 END, CASE WHEN until < 0 THEN start ELSE greatest(start + 1, until - 50) END,
                   CASE WHEN until >= 0 THEN -1 WHEN start + 500 >= length(text) THEN length(text) ELSE start + coalesce(250 + {BEHIND(chr(92) + 'n' + chr(92) + 'n')}, 250 + {BEHIND(chr(92) + 'n')}, 250 + {BEHIND(' ')}, 500) END
            FROM walk JOIN documents USING (doc_id) WHERE until < length(text))
        SELECT doc_id, source, chunk_index, until - start AS chars, md5(substr(text, start + 1, until - start)) AS chunk_md5 FROM walk JOIN documents USING (doc_id) WHERE until >= 0""",
)


def _vectors(spark, sf, asked: str) -> tuple[DataFrame, DataFrame]:
    vectors = shape(spark, sf, "embeddings")
    questions = vectors.filter(asked).select(F.col("vec_id").alias("question_id"), "label", "embedding")
    return questions, vectors.select(F.col("vec_id").alias("chunk_id"), "label", "embedding", F.concat(F.lit("text of "), F.col("vec_id")).alias("chunk_text"))


def _hits(spark, sf, asked: str) -> DataFrame:
    return M.top_k(*_vectors(spark, sf, asked), "label")


#: Twenty questions, and a share of all vectors that grows with their table.
for end, asked in (("", "vec_id < 20"), ("_all", "vec_id % 50 = 0")):
    HITS_SQL = f"""SELECT q.vec_id AS question_id, q.label, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), c.vec_id) AS rank,
              round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 4) AS distance FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.{asked}"""
    register(f"nearest_chunks{end}", lambda spark, sf, asked=asked: _hits(spark, sf, asked).withColumns({"distance": F.round("distance", 4), "rank": F.col("rank").cast("long")}), f"SELECT * FROM ({HITS_SQL}) WHERE rank <= 4")
    register(
        f"question_contexts{end}",
        lambda spark, sf, asked=asked: M.context(_hits(spark, sf, asked), *reversed(_vectors(spark, sf, asked))),
        f"SELECT question_id, string_agg('text of ' || chunk_id, chr(10) || chr(10) ORDER BY rank) AS context FROM ({HITS_SQL}) WHERE rank <= 4 GROUP BY 1",
    )
STATEMENT = """
    SELECT o_orderkey AS number, CASE o_orderkey % 8
             WHEN 0 THEN date_format(d, 'yyyy-MM-dd') WHEN 1 THEN date_format(d, 'dd-MM-yyyy') WHEN 2 THEN date_format(d, 'dd/MM/yyyy') WHEN 3 THEN date_format(d, 'yyyy/MM/dd')
             WHEN 4 THEN date_format(d, 'dd.MM.yyyy') WHEN 5 THEN date_format(d, 'd MMM yyyy') WHEN 6 THEN date_format(d, 'd MMMM yyyy')
             ELSE CASE WHEN day(d) > 12 THEN date_format(d, 'MM/dd/yyyy') ELSE date_format(d, 'dd/MM/yyyy') END END AS day_text,
           CASE o_orderkey % 5 WHEN 0 THEN format_number(a, 2) WHEN 1 THEN concat('Rs. ', CAST(a AS STRING)) WHEN 2 THEN concat('(', format_number(a, 2), ')')
             WHEN 3 THEN concat('-', CAST(a AS STRING)) ELSE translate(format_number(a, 2), ',.', '.,') END AS amount_text,
           CASE o_orderkey % 4 WHEN 0 THEN ' Credit ' WHEN 1 THEN 'MONEY-OUT' WHEN 2 THEN 'Dr.' ELSE 'transfer' END AS direction_text,
           CASE o_orderkey % 4 WHEN 0 THEN 'Net  Banking' WHEN 1 THEN 'upi' WHEN 2 THEN 'Cheque  No 7' ELSE '' END AS mode_text
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18, 2)) AS a FROM {orders})"""
register(
    "parsed_cells",
    lambda spark, sf: query(spark, sf, STATEMENT).select(
        "number", T.parse_date(F.col("day_text")).alias("transaction_date"), T.parse_number(F.col("amount_text")).cast("double").alias("amount"),
        T.to_minor(T.parse_number(F.col("amount_text")), F.lit(False)).alias("amount_minor"),
        T.direction(F.col("direction_text")).alias("direction"), T.payment_mode(F.col("mode_text")).alias("payment_mode")),
    """SELECT o_orderkey AS number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS transaction_date,
              CASE WHEN o_orderkey % 5 IN (2, 3) THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS amount, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * 100 AS BIGINT) AS amount_minor,
              CASE o_orderkey % 4 WHEN 0 THEN 'income' WHEN 3 THEN NULL ELSE 'expense' END AS direction,
              CASE o_orderkey % 4 WHEN 0 THEN 'Bank' WHEN 1 THEN 'UPI' WHEN 2 THEN 'Cheque No 7' END AS payment_mode FROM orders""",
)
LAYOUTS = (
    ("pair", ("Posting Date", "Narration", "Debit", "Credit", "Ledger Balance")),
    ("typed", ("Date", "Description", "Amount", "Type", "Category", "Payment Mode")),
    ("signed", ("Transaction Date", "Memo", "Transaction Amount")),
)


def statement_rows(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Cells of many files in three layouts, made from orders: one file for each customer nation and layout."""
    cells = query(spark, sf, STATEMENT).join(query(spark, sf, "SELECT o_orderkey AS number, c_nationkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS a FROM {orders} JOIN {customer} ON o_custkey = c_custkey"), "number")
    plain = F.col("a").cast("string")
    kind = F.pmod(F.col("number"), F.lit(3))
    income = F.col("number") % 2 == 0
    blank = F.lit("")
    made = (
        F.when(kind == 0, F.array(F.col("day_text"), F.lit("text"), F.when(income, blank).otherwise(plain), F.when(income, plain).otherwise(blank), blank))
        .when(kind == 1, F.array(F.col("day_text"), F.lit("text"), plain, F.when(income, "credit").otherwise("debit"), F.lit("Rent"), F.col("mode_text")))
        .otherwise(F.array(F.col("day_text"), F.lit("text"), F.when(income, plain).otherwise(F.concat(F.lit("-"), plain))))
    )
    layout = F.when(kind == 0, "pair").when(kind == 1, "typed").otherwise("signed")
    rows = cells.select(F.concat_ws("-", layout, "c_nationkey").alias("file"), layout.alias("layout"), F.col("number").alias("position"), made.alias("cells"), F.lit(None).cast("string").alias("fault"))
    # Two nations' files hold a date that does not exist.
    bad = F.col("file").isin("typed-3", "pair-4") & (F.pmod("position", F.lit(50)) == 7)
    rows = rows.withColumn("cells", F.when(bad, F.transform("cells", lambda c, k: F.when(k == 0, "31-02-1998").otherwise(c))).otherwise(F.col("cells")))
    layouts = spark.createDataFrame([(name, list(headers)) for name, headers in LAYOUTS], "layout string, headers array<string>")
    return rows, layouts.withColumn("headers", F.transform("headers", lambda h: T.ascii_header_key(h)))


STATEMENT_SQL = """SELECT concat(CASE o_orderkey % 3 WHEN 0 THEN 'pair' WHEN 1 THEN 'typed' ELSE 'signed' END, '-', c_nationkey) AS file, o_orderkey AS position, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS transaction_date,
    CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * 100 AS BIGINT) AS amount_minor, CASE WHEN o_orderkey % 2 = 0 THEN 'income' ELSE 'expense' END AS direction,
    CASE WHEN o_orderkey % 3 = 1 THEN 'Rent' END AS category, CASE WHEN o_orderkey % 3 = 1 THEN CASE o_orderkey % 4 WHEN 0 THEN 'Bank' WHEN 1 THEN 'UPI' WHEN 2 THEN 'Cheque No 7' END END AS payment_method
    FROM orders JOIN customer ON o_custkey = c_custkey"""
register(
    "canonical_statements",
    lambda spark, sf: ST.canonicalize(*statement_rows(spark, sf))[0].select("file", "position", "transaction_date", "amount_minor", "direction", "category", "payment_method"),
    f"SELECT * FROM ({STATEMENT_SQL}) WHERE file NOT IN (SELECT file FROM ({STATEMENT_SQL}) WHERE file IN ('typed-3', 'pair-4') AND position % 50 = 7)",
)
register(
    "rejected_statements",
    lambda spark, sf: ST.canonicalize(*statement_rows(spark, sf))[1],
    f"SELECT file, min(position) AS position, 'INVALID_DATE' AS code FROM ({STATEMENT_SQL}) WHERE file IN ('typed-3', 'pair-4') AND position % 50 = 7 GROUP BY 1",
)
register(
    "exact_functions",
    lambda spark, sf: shape(spark, sf, "ledger").select(
        "transaction_id", X.iso_week(F.col("transaction_date")).alias("week"), X.pct(F.col("amount_minor"), F.col("number") % 5).cast("double").alias("pct"), X.pct0(F.col("amount_minor"), F.col("number") % 5).cast("double").alias("pct0"),
        X.signed_change(F.col("number"), F.col("amount_minor")).cast("double").alias("change"), X.minor_units(X.major_units(F.col("amount_minor"))).alias("minor")),
    f"""SELECT transaction_id, strftime(transaction_date, '%G-W%V') AS week, {pct_sql("amount_minor", "(number % 5)")} AS pct, {pct0_sql("amount_minor", "(number % 5)")} AS pct0,
        {pct0_sql("(number - amount_minor)", "amount_minor")} AS change, amount_minor AS minor FROM ledger""",
    "ledger",
)
