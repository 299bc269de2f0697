"""Finance operators on hand-made rows: boundaries, missing values, order, and invariants."""

import datetime as dt
import hashlib
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerforge.functions import exact as X
from ledgerforge.functions import text as T
from ledgerforge.operators import advice as B
from ledgerforge.operators import analytics as A
from ledgerforge.operators import anomalies as N
from ledgerforge.operators import contract as C
from ledgerforge.operators import eligibility as E
from ledgerforge.operators import health as H
from ledgerforge.operators import identity as I
from ledgerforge.operators import profile as P
from ledgerforge.operators import quality as Q
from ledgerforge.operators import reports as R
from ledgerforge.operators import retrieval as M
from ledgerforge.operators import scope as S
from ledgerforge.operators import statements as ST
from ledgerforge.operators.uploads import read_uploads
from ledgerforge.sources import sinks, statements
from ledgerforge.streaming import ingest as ING

TX = "business_id string, account_id string, transaction_date date, amount_minor long, direction string, currency string, category string, payment_mode string"
ACCOUNTS = "business_id string, account_id string, currency string, opening_balance_minor long"


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def tx(spark):
    rows = [
        ("2026-01-01", 100000, "income", "Sales", "UPI"), ("2026-01-02", 30000, "expense", "Rent", "Bank"), ("2026-01-02", 10000, "expense", None, "Cheque"),
        ("2026-02-10", 20000, "income", "Sales", None), ("2026-02-11", 90000, "expense", "Rent", "Bank"), ("2026-02-11", 90000, "expense", "Rent", "Bank"),
    ]
    return spark.createDataFrame([("b", "a", day(d), n, k, "INR", c, m) for d, n, k, c, m in rows], TX)


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame([("b", "a", "INR", 5000), ("b", "empty", "INR", 700)], ACCOUNTS)


@pytest.fixture(scope="module")
def tables(tx, accounts):
    figures = A.kpis(tx, accounts)
    daily, monthly = A.trend(tx), A.trend(tx, "monthly")
    categories, cat_months = A.category_summary(tx), H.category_months(tx)
    return {"figures": figures, "daily": daily, "monthly": monthly, "categories": categories, "cat_months": cat_months,
            "modes": A.payment_mode_summary(tx), "metrics": H.health_metrics(figures, daily, monthly, categories, cat_months)}


def one(df, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_kpis(tables):
    row = one(tables["figures"], account_id="a")
    assert (row["total_income_minor"], row["total_expense_minor"], row["net_cash_flow_minor"], row["transaction_count"]) == (120000, 220000, -100000, 6)
    assert (row["closing_balance_minor"], row["largest_expense_minor"], row["smallest_income_minor"]) == (-95000, 90000, 20000)
    assert row["savings_rate"] == D("-83.33") and round(row["average_transaction_minor"], 4) == D("56666.6667") and round(row["income_expense_ratio"], 6) == D("0.545455")
    empty = one(tables["figures"], account_id="empty")
    assert empty["transaction_count"] == 0 and empty["savings_rate"] is None and empty["income_expense_ratio"] is None and empty["average_transaction_minor"] == 0 and empty["closing_balance_minor"] == 700


def test_sums_of_all_grains_agree(spark, sf):
    from ledgerforge.plans.shapes import shape

    rows = shape(spark, sf, "ledger")
    sums = {tuple(A.trend(rows, g).agg(F.sum("income_minor"), F.sum("expense_minor"), F.sum("transaction_count")).first()) for g in ("daily", "weekly", "monthly")}
    assert len(sums) == 1
    shares = A.category_summary(rows).groupBy("account_id").agg(F.sum("percentage").alias("s")).filter(F.abs(F.col("s") - 100) > 0.05)
    assert shares.count() == 0


def test_iso_weeks(spark):
    df = spark.createDataFrame([(day("2026-01-01"),), (day("2027-01-02"),)], "d date")
    assert [r[0] for r in df.select(X.iso_week(F.col("d"))).collect()] == ["2026-W01", "2026-W53"]


@pytest.mark.parametrize("n,d,expected", [(1, 3, "33.33"), (-1, 3, "-33.33"), (1, 8, "12.50"), (5, 1000000, "0.00"), (15, 300000, "0.01"), (-15, 300000, "-0.01"), (1, 0, None), (2, 3, "66.67")])
def test_half_up(spark, n, d, expected):
    value = spark.range(1).select(X.pct(F.lit(n), F.lit(d)), X.pct0(F.lit(n), F.lit(d))).first()
    assert value[0] == (None if expected is None else D(expected)) and value[1] == D(expected or "0.00")


def test_breakdowns(tables):
    categories = {r["category"]: r for r in tables["categories"].collect()}
    assert set(categories) == {"Sales", "Rent", "Uncategorized"} and categories["Rent"]["percentage"] == D("61.76")
    modes = {r["payment_mode"]: (r["count"], r["mode_order"]) for r in tables["modes"].collect()}
    assert modes == {"UPI": (1, 2), "Bank": (3, 4), "Other": (2, 5)}


def test_health(tables):
    row = one(tables["metrics"], account_id="a")
    assert row["cash_flow_stability"] == D("50.00") and row["income_trend"] == D("-80.00") and row["expense_trend"] == D("350.00")
    assert row["expense_to_income_ratio"] == D("1.83") and row["recurring_expense_burden"] == D("95.45") and row["monthly_decline"] == D("80.00")
    # 35 ratio, 25 savings, 15 stability, 10 concentration, 10 recurring, 10 decline: floored at 0
    assert row["health_score"] == 0 and row["health_level"] == "Critical"
    empty = one(tables["metrics"], account_id="empty")
    assert empty["health_score"] == 0 and empty["cash_flow_stability"] == 0


@pytest.mark.parametrize("ratio,stability,score,level", [("0.50", "100.00", 100, "Excellent"), ("0.51", "99.99", 85, "Excellent"), ("0.76", "75.00", 75, "Good"), ("1.01", "49.00", 40, "Poor")])
def test_score_boundaries(spark, ratio, stability, score, level):
    row = spark.range(1).select(
        F.lit(1).alias("transaction_count"), F.lit(D(ratio)).alias("expense_to_income_ratio"), F.lit(D("25.00")).alias("savings_rate"), F.lit(D(stability)).alias("cash_flow_stability"),
        F.lit(D("40.00")).alias("category_concentration"), F.lit(D("30.00")).alias("recurring_expense_burden"), F.lit(D("20.00")).alias("monthly_decline"), F.lit(D(0)).alias("income_trend"), F.lit(D(0)).alias("expense_trend"),
    )
    found = H.with_score(row).first()
    assert (found["health_score"], found["health_level"]) == (score, level)


def test_anomalies(tx, tables):
    found = N.detect(tx, tables["daily"], tables["monthly"], tables["cat_months"], tables["modes"], tables["metrics"])
    kinds = {(r["type"], r["severity"], r["date_detected"]) for r in found.collect()}
    for expected in [
        ("sudden_expense_spike", "High", "2026-02"), ("expense_explosion", "CRITICAL", "2026-02"), ("sudden_income_drop", "HIGH", "2026-02"), ("income_drop", "HIGH", "2026-02"),
        ("repeated_identical_transactions", "MEDIUM", "2026-02-11"), ("duplicate_pattern", "MEDIUM", "2026-02-11"), ("inactive_period", "LOW", "2026-02-10"),
        ("negative_cash_flow_period", "MEDIUM", "2026-01-02"), ("category_spike", "HIGH", "2026-02"), ("high_expense_ratio", "HIGH", None), ("unexpected_payment_mode", "MEDIUM", None),
    ]:
        assert expected in kinds
    assert not any(k[0] in ("income_interruption", "cash_flow_instability") for k in kinds)
    growth = found.filter("type = 'recurring_expense_growth' AND date_detected IS NOT NULL").first()
    assert growth["metric_value"] == 500 and growth["affected_amount_minor"] == 90000


def test_large_is_strictly_above_twice_the_mean(spark):
    rows = [("b", "a", day("2026-01-01"), n, "income", "INR", None, None) for n in (100, 100, 100, 300)] + [("b", "c", day("2026-01-01"), n, "income", "INR", None, None) for n in (100, 100, 100, 301)]
    assert [r["account_id"] for r in N.large_transactions(spark.createDataFrame(rows, TX)).collect()] == ["c"]


def test_advice(tx, tables):
    found = N.detect(tx, tables["daily"], tables["monthly"], tables["cat_months"], tables["modes"], tables["metrics"])
    advice = B.ranked(B.metric_rules(tables["metrics"], tables["modes"]), B.anomaly_rules(found))
    rows = [r for r in sorted(advice.collect(), key=lambda r: r["id"]) if r["account_id"] == "a"]
    assert rows[0]["id"] == "recommendation-001" and [r["priority"] for r in rows] == sorted((r["priority"] for r in rows), key=B.RANKS.index)
    titles = [r["title"] for r in rows]
    assert titles.count("Address negative cash flow") == 2  # once from metrics, once from anomalies
    assert "Review multiple anomalies" in titles and "Maintain stable operations" not in titles
    spending = next(r for r in rows if r["title"] == "Reduce the expense burden" and r["confidence"] == 93)
    assert "1.83 times" in spending["explanation"] and spending["priority"] == "CRITICAL"
    assert not [r for r in advice.collect() if r["account_id"] == "empty"]
    summary = one(B.advice_summary(advice), account_id="a")
    assert summary["recommendation_count"] == len(rows) and summary["highest_priority"] == "CRITICAL"


def test_reports(tx, tables):
    weekly = A.trend(tx, "weekly")
    anomalies = N.detect(tx, tables["daily"], tables["monthly"], tables["cat_months"], tables["modes"], tables["metrics"])
    parts = R.sections(tables["figures"], tables["daily"], weekly, tables["monthly"], tables["categories"], tables["modes"], A.account_summary(tables["figures"]), tables["metrics"], anomalies)
    assert set(parts) == set(R.SECTIONS)
    for table in parts.values():
        assert not set(table.columns) & (set(R.SENSITIVE) - {"business_id", "account_id"})
    report = json.loads(one(R.report_json(parts, generated_at="2026-03-01T00:00:00Z"), account_id="a")["json"])
    assert report["sections"]["income_statement"]["savings_rate"] == "-83.33" and len(report["sections"]["category_report"]) == 3
    amounts = [r["amount_minor"] for r in report["sections"]["category_report"]]
    assert amounts == sorted(amounts, reverse=True) and "mode_order" not in json.dumps(report)
    dates = [r.get("date_detected") or "" for r in report["sections"]["anomaly_report"]]
    assert dates == sorted(dates)
    trends = report["sections"]["cash_flow_summary"]["trends"]
    assert list(trends) == ["daily", "weekly", "monthly"]
    for grain, table in (("daily", tables["daily"]), ("weekly", weekly), ("monthly", tables["monthly"])):
        own = sorted(str(r["period"]) for r in table.filter("account_id = 'a'").collect())
        assert own and [r["period"] for r in trends[grain]] == own
    empty = json.loads(one(R.report_json(parts, "executive", "x"), account_id="empty")["json"])
    assert empty["sections"]["cash_flow_summary"]["trends"] == {"daily": [], "weekly": [], "monthly": []}
    assert empty["sections"]["category_report"] == [] and empty["report_type"] == R.COMBINED
    rows = R.report_rows(parts).filter("account_id = 'a' AND section = 'income_statement'").collect()
    assert {r["field"]: r["value"] for r in rows} == {"income_minor": "120000", "expense_minor": "220000", "net_cash_flow_minor": "-100000", "savings_rate": "-83.33"}
    with pytest.raises(ValueError):
        R.report_json(parts, "unknown")


DATES = {"2026-08-31": "2026-08-31", "2026-02-31": None, "31-08-2026": "2026-08-31", "31/08/2026": "2026-08-31", "2026/8/1": "2026-08-01", "1.8.2026": "2026-08-01", "5 Aug 2026": "2026-08-05", "5 August 2026": "2026-08-05", "08/31/2026": "2026-08-31", "31/08/26": None, "": None, "soon": None}
NUMBERS = {"1,234.50": "1234.5", "1.234,50": "1234.5", "1,50": "1.5", "1,500": "1500", "(1,234.50)": "-1234.5", "−12": "-12", "Rs. 99.00": "99", "INR 5": "5", "₹1,00,000": "100000", "12a": None, "": None, "1.2.3": None, "-0.5": "-0.5"}


def test_dates_and_numbers(spark):
    dates = spark.createDataFrame([(k,) for k in DATES], "t string").select("t", T.parse_date(F.col("t")).cast("string"))
    assert {r[0]: r[1] for r in dates.collect()} == DATES
    numbers = spark.createDataFrame([(k,) for k in NUMBERS], "t string").select("t", T.parse_number(F.col("t")))
    assert {r[0]: r[1] for r in numbers.collect()} == {k: None if v is None else D(v) for k, v in NUMBERS.items()}
    words = spark.createDataFrame([("ＣＲＥＤＩＴ", "Net  Banking"), (" Money-Out ", "Cheque 7"), ("other", None)], "d string, m string").select(T.direction(F.col("d")), T.payment_mode(F.col("m")))
    assert [tuple(r) for r in words.collect()] == [("income", "Bank"), ("expense", "Cheque 7"), (None, None)]


FILES = {
    "typed.csv": ("Date,Description,Amount,Type,Category,Payment Mode\n2026-08-31,\"Shop, left\",\"1,234.50\",credit,Sales,upi\n\n2026-09-01,Rent,500,debit,,Cash\n", None, 2),
    "pair.csv": ("﻿Remarks;Txn Date;Withdrawal;Deposit;Running Balance\nx;31/08/2026;10,50;;-5,00\ny;01/09/2026;;20;15\n", None, 2),
    "signed.csv": ("Transaction Date\tMemo\tTransaction Amount\n2026-08-31\ta\t-12.00\n2026-08-31\tb\t3\n", None, 2),
    "minor.csv": ("Date,Amount Minor,Direction\n2026-08-31,1234,income\n", None, 1),
    "positive.csv": ("Date,Amount\n2026-08-31,5\n", "LOW_CONFIDENCE", 0),
    "unknown.csv": ("When,What,How Much\n2026-08-31,x,5\n", "REQUIRED_COLUMN", 0),
    "twice.csv": ("Date,Date,Amount\n2026-08-31,2026-08-31,5\n", "DUPLICATE_HEADER", 0),
    "wide.csv": ("Date,Amount,Direction\n2026-08-31,5,income,extra\n", "MALFORMED_CSV", 0),
    "quote.csv": ('Date,Amount,Direction\n2026-08-31,"5,income\n', "MALFORMED_CSV", 0),
    "both.csv": ("Date,Debit,Credit\n2026-08-31,5,6\n", "INVALID_DIRECTION", 0),
    "part.csv": ("Date,Amount,Direction\n2026-08-31,5.001,income\n2026-08-31,5,income\n", "INVALID_PRECISION", 0),
    "doubled.csv": ('Date,Description,Amount,Direction\n2026-08-31,"two\nlines ""q""",5,income\n2026-09-01,"5"" pipe",6,income\n', None, 2),
    "blank_wide.csv": ("Date,Amount,Direction\n2026-08-31,5,income,\n", "MALFORMED_CSV", 0),
    "wider.csv": ("Date,Amount,Direction\n2026-08-31,5,income,,more\n", "MALFORMED_CSV", 0),
    "again.csv": ("Date,Amount,Direction\n2026-08-31,5,income\nDate,Amount,Direction\n", "INVALID_AMOUNT", 0),
    "header.csv": ("\n ,,\nDate,Amount,Direction\n\n", "EMPTY_CSV", 0),
    "nothing.csv": ("", "EMPTY_CSV", 0),
    "blank.csv": ("\n  \n,,\n", "EMPTY_CSV", 0),
    "inner.csv": ('Date,Description,Amount,Direction\n2026-08-31,5" and 3" pipes,5,income\n', None, 1),
    "apart.csv": ('Date,Description,Amount,Direction\n2026-08-31,5" pipe,5,income\n2026-08-31,3" pipe,5,income\n', None, 2),
    "trailing.csv": ('Date, "Description" ,Amount,Direction\n2026-08-31, "a, b" c,5,income\n', None, 1),
    "late_wide.csv": ("Date,Amount,Direction\n2026-02-31,5,income\n2026-08-31,5,income,x\n", "MALFORMED_CSV", 0),
    "late_sign.csv": ("Date,Amount\n2026-02-31,5\n2026-08-31,none\n", "INVALID_AMOUNT", 0),
    "long.csv": ("Date,Description,Amount,Direction\n2026-02-31," + "x" * 501 + ",5,income\n", "INVALID_DATE", 0),
    "day.csv": ("Date,Amount,Direction\n2026-08-31,5,income\n2026-02-30,5,income\n", "INVALID_DATE", 0),
}


def test_statement_files(spark, tmp_path):
    for name, (body, _, _) in FILES.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    rows, layouts = statements.read_statements(spark, [str(tmp_path / n) for n in FILES])
    accepted, rejected = ST.canonicalize(rows, layouts)
    name = F.element_at(F.split("file", "/"), -1)
    found = {r["f"]: r["n"] for r in accepted.groupBy(name.alias("f")).agg(F.count("*").alias("n")).collect()}
    codes = {r["f"]: r["code"] for r in rejected.select(name.alias("f"), "code").collect()}
    for f, (_, code, n) in FILES.items():
        assert codes.get(f) == code and found.get(f, 0) == n, f
    typed = accepted.filter(name == "typed.csv").orderBy("position").collect()
    assert [(r["amount_minor"], r["direction"], r["category"], r["description"], r["payment_method"]) for r in typed] == [(123450, "income", "Sales", "Shop, left", "UPI"), (50000, "expense", None, "Rent", "Cash")]
    pair = accepted.filter(name == "pair.csv").orderBy("position").collect()
    assert [(r["amount_minor"], r["direction"], r["balance_after_minor"]) for r in pair] == [(1050, "expense", -500), (2000, "income", 1500)]
    said = {f: [r["description"] for r in accepted.filter(name == f).orderBy("position").collect()] for f in ("doubled.csv", "inner.csv", "apart.csv", "trailing.csv")}
    assert said == {"doubled.csv": ['two lines "q"', '5" pipe'], "inner.csv": ['5" and 3" pipes'], "apart.csv": ['5" pipe', '3" pipe'], "trailing.csv": ["a, b c"]}
    by_row = ST.canonicalize(rows, layouts, mode="row")[0]
    assert by_row.filter(name == "day.csv").count() == 1


@pytest.mark.parametrize("seed,delimiter", [(1, ","), (2, ";"), (3, "\t"), (4, "|")])
def test_records_across_slices(spark, tmp_path, seed, delimiter):
    """Files cut into slices of a few bytes give the records that Python's reader gives."""
    import csv
    import io
    import random

    dice = random.Random(seed)
    cell = lambda: dice.choice(["", "a", "b c", "1.50", '5" pipe', '"x"', '"two\nlines"', '"a ""q"" b"', f'"in{delimiter}side"', '""', ' "led"', '"tail" end', '"\n\n"', '"""\n"""'])
    expected = {}
    for k in range(6):
        lines = [delimiter.join(["h1", "h2", "h3", "h4"])] + [delimiter.join(cell() for _ in range(dice.randrange(1, 5))) for _ in range(dice.randrange(1, 60))]
        text = "\n".join(lines) + "\n"
        if text.count('"') % 2 == 0:
            (tmp_path / f"{k}.csv").write_text(text, encoding="utf-8")
            expected[f"{k}.csv"] = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, skipinitialspace=True) if any(r)]
    assert len(expected) > 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        paths = [str(tmp_path / n) for n in expected]
        files = statements.file_layouts(spark, paths)
        records = statements.read_records(spark, paths, files).withColumn("cells", F.transform(statements._cells(F.col("text")), statements._bare)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for n, rows in expected.items():
        found = [r["cells"] for r in sorted((r for r in records if r["file"].endswith(f"/{n}")), key=lambda r: r["position"]) if any(r["cells"])]
        assert found == rows, n


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for name in (blocks.apply(k).toString() for k in range(blocks.size())) if name.startswith("shuffle_")}

    before = shuffled()
    table = sinks.kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(20):
        if left := shuffled() - before:
            time.sleep(0.1)
    assert not left and table.count() == 7
    assert spark.conf.get(sinks.REMOVES_SHUFFLES) == "false"
    sinks.let_go(spark, table)
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        table.collect()


def test_slices_of_lines_are_bounded(spark, tmp_path, monkeypatch):
    """Windows hold a slice of lines in memory, so a part of a file that Spark reads at once is several of them."""
    import csv
    import io
    import random

    monkeypatch.setattr(statements, "SLICE_LINES", 7)
    dice = random.Random(6)
    text = "h1,h2\n" + "".join(dice.choice(['a,b\n', '"two\nlines",b\n', '"a ""q"" b",\n', '5" pipe,3" pipe\n', f'"{"x\n" * dice.randrange(30)}",c\n']) for _ in range(300))
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    paths = [str(tmp_path / "a.csv")]
    lines = statements._lines(spark, paths)
    assert lines.select("file", "block").distinct().count() == 1
    assert lines.groupBy(*statements.SLICE).count().agg(F.max("count")).first()[0] == 7
    records = statements.read_records(spark, paths, statements.file_layouts(spark, paths)).withColumn("cells", F.transform(statements._cells(F.col("text")), statements._bare))
    found = [r["cells"] for r in sorted(records.collect(), key=lambda r: r["position"])]
    assert found == list(csv.reader(io.StringIO(text, newline="")))


GOOD = {"transaction_date": "2026-08-31", "amount_minor": 1234, "direction": "income"}
RECORDS = [
    (GOOD, None, None), ({**GOOD, "note": 1}, "UNKNOWN_FIELD", None), ({"amount_minor": 1, "x": 1}, "UNKNOWN_FIELD", None), ({}, "MISSING_FIELD", "transaction_date"),
    ({"transaction_date": None}, "INVALID_FIELD", "transaction_date"), ({k: GOOD[k] for k in ("transaction_date", "direction")}, "MISSING_FIELD", "amount_minor"),
    ({**GOOD, "amount_minor": "1234"}, "INVALID_FIELD", "amount_minor"), ({**GOOD, "amount_minor": True}, "INVALID_FIELD", "amount_minor"), ({**GOOD, "amount_minor": 12.0}, "INVALID_FIELD", "amount_minor"),
    ({**GOOD, "amount_minor": 0}, "AMOUNT_OUT_OF_RANGE", "amount_minor"), ({**GOOD, "amount_minor": 10**30}, "AMOUNT_OUT_OF_RANGE", "amount_minor"), ({**GOOD, "amount_minor": 99_999_999_999_999}, None, None),
    ({**GOOD, "transaction_date": "2026-02-30"}, "INVALID_FIELD", "transaction_date"), ({**GOOD, "transaction_date": "2026-8-31"}, "INVALID_FIELD", "transaction_date"), ({**GOOD, "transaction_date": 20260831}, "INVALID_FIELD", "transaction_date"),
    ({**GOOD, "direction": "Income"}, "INVALID_FIELD", "direction"), ({**GOOD, "source_transaction_id": None}, None, None), ({**GOOD, "category": None}, "INVALID_FIELD", "category"),
    ({**GOOD, "category": " x"}, "INVALID_FIELD", "category"), ({**GOOD, "category": "\u2003"}, "INVALID_FIELD", "category"), ({**GOOD, "category": "x" * 100}, None, None), ({**GOOD, "category": "x" * 101}, "TEXT_TOO_LONG", "category"),
    ({**GOOD, "description": 5, "category": 5}, "INVALID_FIELD", "category"), ({**GOOD, "balance_after_minor": -99_999_999_999_999}, None, None), ({**GOOD, "balance_after_minor": 10**14}, "BALANCE_OUT_OF_RANGE", "balance_after_minor"),
    ({**GOOD, "balance_after_minor": None}, "INVALID_FIELD", "balance_after_minor"), (5, "INVALID_RECORDS", None), ([GOOD], "INVALID_RECORDS", None), (None, "INVALID_RECORDS", None),
]
WHOLE = {"contract_version": "v1", "source_system": "bank", "records": [GOOD]}
PAYLOADS = [
    (json.dumps(WHOLE), None, None, None), ("\ufeff" + json.dumps(WHOLE), None, None, None), ("{", "INVALID_PAYLOAD", None, None), ("[]", "INVALID_PAYLOAD", None, None), (json.dumps({**WHOLE, "more": 1}), "UNKNOWN_FIELD", None, None),
    (json.dumps({"records": [], "more": 1}), "UNKNOWN_FIELD", None, None), (json.dumps({"records": []}), "MISSING_FIELD", "contract_version", None), (json.dumps({**WHOLE, "source_system": None, "contract_version": "v0"}), "INVALID_FIELD", "source_system", None),
    (json.dumps({**WHOLE, "contract_version": "v0"}), "UNSUPPORTED_CONTRACT_VERSION", "contract_version", None), (json.dumps({**WHOLE, "source_system": ["bank"]}), "INVALID_FIELD", "source_system", None),
    (json.dumps({**WHOLE, "records": None}), "INVALID_RECORDS", "records", None), (json.dumps({**WHOLE, "records": []}), "RECORD_COUNT_OUT_OF_RANGE", "records", None), (json.dumps({**WHOLE, "records": [GOOD] * 4}), "RECORD_COUNT_OUT_OF_RANGE", "records", None),
    (json.dumps({**WHOLE, "records": [GOOD, {**GOOD, "amount_minor": 0}, 7]}), "AMOUNT_OUT_OF_RANGE", "amount_minor", 1),
]


def test_payload_files(spark, tmp_path):
    (tmp_path / "all.json").write_text(json.dumps({**WHOLE, "records": [r for r, _, _ in RECORDS]}))
    _, records = statements.read_payloads(spark, [str(tmp_path / "all.json")])
    assert [(r["code"], r["field"]) for r in C.check_json_records(records).orderBy("position").collect()] == [(c, f) for _, c, f in RECORDS]
    for k, (text, *_) in enumerate(PAYLOADS):
        (tmp_path / f"{k}.txt").write_text(text, encoding="utf-8")
    envelopes, records = statements.read_payloads(spark, [str(tmp_path / f"{k}.txt") for k in range(len(PAYLOADS))])
    verdicts = C.payload_verdicts(C.check_json_envelopes(envelopes, "v1", "bank", 3), C.check_json_records(records))
    found = {int(r["file"].rsplit("/", 1)[1][:-4]): (r["code"], r["field"], r["record_index"]) for r in verdicts.collect()}
    assert found == {k: tuple(rest) for k, (_, *rest) in enumerate(PAYLOADS)}


def test_uploads_of_either_kind(spark, tmp_path):
    csv_text, json_text = "Date,Amount,Direction\n2026-08-31,5,income\n", json.dumps(WHOLE)
    files = {"a.csv": csv_text, "b.JSON": json_text, "c.txt": "\n  " + json_text, "d.txt": csv_text, "e.dat": json_text, "f.csv": json_text, "g": csv_text, "h.json": csv_text}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    types = spark.createDataFrame([("e.dat", "text/csv"), ("d.txt", "Application/vnd.x+JSON"), ("a.csv", "application/json"), ("g", "image/png")], "file_name string, content_type string")
    kinds = {r["file"].rsplit("/", 1)[1]: r["kind"] for r in statements.upload_kinds(spark, [str(tmp_path)], types).collect()}
    assert kinds == {"a.csv": "csv", "b.JSON": "json", "c.txt": "json", "d.txt": "json", "e.dat": "csv", "f.csv": "csv", "g": "csv", "h.json": "json"}
    records, refused = read_uploads(spark, [str(tmp_path)], "v1", "bank", types)
    assert sorted((r["file"].rsplit("/", 1)[1], r["amount_minor"], str(r["transaction_date"])) for r in records.collect()) == [(n, k, "2026-08-31") for n, k in (("a.csv", 500), ("b.JSON", 1234), ("c.txt", 1234), ("g", 500))]
    assert {r["file"].rsplit("/", 1)[1] for r in refused.collect()} == {"d.txt", "e.dat", "f.csv", "h.json"}


BATCH = "batch_id long, position long, business_id string, account_id string, source_system string, source_transaction_id string, currency string, transaction_date date, amount_minor long, direction string, category string, payment_mode string"


def batch_rows(*rows):
    return [(b, p, "biz", "acc", "bank", s, "INR", day("2026-08-31"), n, "income", None, None) for b, p, s, n in rows]


def test_identity_hash(spark):
    row = I.with_hash(spark.createDataFrame(batch_rows((1, 0, "é\"\\", 1234)), BATCH)).first()
    text = json.dumps(["v1", "acc", "bank", "INR", "2026-08-31", 1234, "income"], ensure_ascii=False, separators=(",", ":"))
    assert row["canonical_identity_hash"] == hashlib.sha256(text.encode()).hexdigest()


def test_batches(spark):
    stored = I.with_hash(spark.createDataFrame(batch_rows((0, 0, "S1", 100), (0, 1, None, 200)), BATCH)).withColumn("identity_id", F.concat(F.lit("idn_"), "position"))
    rows = batch_rows((1, 0, "S1", 100), (1, 1, "S9", 200), (1, 2, "S3", 300), (1, 3, "S3", 300), (1, 4, None, 300), (2, 0, "S1", 101), (3, 0, "S5", 1), (3, 1, "S5", 2), (4, 0, None, 7), (4, 1, None, 8))
    judged = I.classify_within(I.classify(I.with_hash(spark.createDataFrame(rows, BATCH)), stored))
    found = {(r["batch_id"], r["position"]): r["outcome"] for r in judged.collect()}
    assert found == {
        (1, 0): "DUPLICATE_SOURCE_ID", (1, 1): "DUPLICATE_CANONICAL_IDENTITY", (1, 2): "UNIQUE", (1, 3): "DUPLICATE_SOURCE_ID", (1, 4): "DUPLICATE_CANONICAL_IDENTITY",
        (2, 0): "SOURCE_IDENTITY_CONFLICT", (3, 0): "UNIQUE", (3, 1): "SOURCE_IDENTITY_CONFLICT", (4, 0): "UNIQUE", (4, 1): "UNIQUE",
    }
    verdicts = {r["batch_id"]: (r["record_count"], r["inserted_count"], r["duplicate_count"], r["status"]) for r in I.batch_verdict(judged).collect()}
    assert verdicts == {1: (5, 1, 4, "completed"), 2: (1, 0, 0, "failed"), 3: (2, 0, 0, "failed"), 4: (2, 2, 0, "completed")}


def test_stream_of_batches(spark, tmp_path):
    incoming, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.createDataFrame(batch_rows((1, 0, "A", 10), (1, 1, "B", 20), (1, 2, "A", 10)), BATCH).coalesce(1).write.parquet(incoming)
    ING.ingest_stream(spark, incoming, out, BATCH, check).awaitTermination()
    spark.createDataFrame(batch_rows((2, 0, "A", 10), (2, 1, "C", 30), (3, 0, "B", 21), (4, 0, "D", 0)), BATCH).coalesce(1).write.mode("append").parquet(incoming)
    ING.ingest_stream(spark, incoming, out, BATCH, check).awaitTermination()
    assert sorted(r["amount_minor"] for r in sinks.committed(spark, out, "ledger").collect()) == [10, 20, 30]
    attempts = {r["batch_id"]: (r["status"], r["inserted_count"]) for r in spark.read.parquet(out + "/attempts").collect()}
    assert attempts == {1: ("completed", 2), 2: ("completed", 1), 3: ("failed", 0), 4: ("failed", 0)}
    # Ingesting again what is stored inserts nothing.
    again, _ = ING.ingest(spark.createDataFrame(batch_rows((9, 0, "A", 10), (9, 1, "C", 30)), BATCH), sinks.committed(spark, out, "identities"))
    assert again.count() == 0


def test_replay_after_a_crash_shows_rows_once(spark, tmp_path, monkeypatch):
    """A run that ends between the ledger and its attempts is repeated by the stream."""
    incoming, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.createDataFrame(batch_rows((1, 0, "A", 10), (1, 1, "B", 20), (1, 2, "C", 30)), BATCH).coalesce(1).write.parquet(incoming)

    def half(accepted, attempts, folder):
        accepted.select(*[c for c in sinks.LEDGER if c in accepted.columns]).write.mode("append").parquet(f"{folder}/ledger")
        raise RuntimeError("crash")

    with monkeypatch.context() as broken:
        broken.setattr(ING, "append", half)
        with pytest.raises(Exception):
            ING.ingest_stream(spark, incoming, out, BATCH, check).awaitTermination()
    ING.ingest_stream(spark, incoming, out, BATCH, check).awaitTermination()
    assert spark.read.parquet(out + "/ledger").count() == 6
    assert sorted(r["amount_minor"] for r in sinks.committed(spark, out, "ledger").collect()) == [10, 20, 30]


@pytest.mark.parametrize("ends_in", ["ledger", "identities", "attempts"])
def test_vacuum_takes_what_broken_runs_left(spark, tmp_path, monkeypatch, ends_in):
    """A run that ends in any of its three writes: its files go, those of committed and of running attempts stay."""
    from datetime import datetime, timedelta

    incoming, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.createDataFrame(batch_rows((1, 0, "A", 10), (1, 1, "B", 20)), BATCH).coalesce(1).write.parquet(incoming)
    ING.ingest_stream(spark, incoming, out, BATCH, check).awaitTermination()
    spark.createDataFrame(batch_rows((2, 0, "A", 10), (2, 1, "C", 30)), BATCH).coalesce(1).write.mode("append").parquet(incoming)

    class Broken(RuntimeError):
        pass

    def partly(accepted, attempts, folder):
        def stop(table):
            if table == ends_in:
                raise Broken("crash")

        stop("nothing")
        accepted.select(*[c for c in sinks.LEDGER if c in accepted.columns]).write.mode("append").parquet(f"{folder}/ledger")
        stop("ledger")
        accepted.select(*[c for c in sinks.IDENTITY if c in accepted.columns]).withColumn("bucket", sinks.bucket_of()).write.mode("append").partitionBy("bucket").parquet(f"{folder}/identities")
        stop("identities")
        stop("attempts")

    with monkeypatch.context() as broken:
        broken.setattr(ING, "append", partly)
        with pytest.raises(Exception, match="crash"):
            ING.ingest_stream(spark, incoming, out, BATCH, check).awaitTermination()
    count = lambda name: spark.read.parquet(f"{out}/{name}").count()
    left = {"ledger": 1, "identities": 0 if ends_in == "ledger" else 1}
    assert {name: count(name) - 2 for name in left} == left
    # Whatever was written after the given time may belong to a run that goes on.
    assert sinks.vacuum(spark, out, datetime(2000, 1, 1)).count() == 0 and {name: count(name) - 2 for name in left} == left
    now = datetime.now() + timedelta(days=1)
    gone = sinks.vacuum(spark, out, now).groupBy("table").agg(F.sum("rows").alias("n")).collect()
    assert {r["table"]: r["n"] for r in gone} == {name: n for name, n in left.items() if n}
    assert count("ledger") == count("identities") == 2
    ING.ingest_stream(spark, incoming, out, BATCH, check).awaitTermination()
    assert sorted(r["amount_minor"] for r in sinks.committed(spark, out, "ledger").collect()) == [10, 20, 30]
    assert sinks.vacuum(spark, out, now).count() == 0 and count("ledger") == count("identities") == 3


def test_white_space_of_any_script(spark):
    from ledgerforge.functions.text import collapse, normalize_text
    from ledgerforge.operators.contract import check_records

    texts = {"\tRent\n": "rent", "\u00a0A\u2028 \u0085b ": "a b", " \u3000": "", None: ""}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_text(F.col("t")).alias("n"), collapse(F.col("t")).alias("c"))
    for r in rows.collect():
        assert r["n"] == texts[r["t"]] and (r["c"] or "").lower() == texts[r["t"]]
    records = [("2026-01-02", 5, "income", c) for c in ("Rent", "\u00a0Rent", "Rent\u2003", "Rent a")]
    found = check_records(spark.createDataFrame(records, "transaction_date string, amount_minor long, direction string, category string")).collect()
    assert {r["category"]: r["code"] for r in found} == {"Rent": None, "\u00a0Rent": "INVALID_FIELD", "Rent\u2003": "INVALID_FIELD", "Rent a": None}


def test_uncommitted_rows_are_not_seen(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.createDataFrame([("t1", "good"), ("t2", "lost")], "transaction_id string, attempt_id string")
    rows.write.parquet(folder + "/ledger")
    spark.createDataFrame([("good", "completed")], "attempt_id string, status string").write.parquet(folder + "/attempts")
    assert [r["transaction_id"] for r in sinks.committed(spark, folder, "ledger").collect()] == ["t1"]


def test_retries_and_status(spark):
    attempts = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("m", "gone"), ("n", "m")], "attempt_id string, parent_attempt_id string")
    found = {r["attempt_id"]: (r["retry_count"], r["code"]) for r in I.retry_depth(attempts).collect()}
    assert found == {"a": (0, None), "b": (1, None), "c": (2, None), "x": (None, "CYCLE"), "y": (None, "CYCLE"), "m": (None, "PARENT_MISSING"), "n": (None, "PARENT_MISSING")}
    events = spark.createDataFrame([("a", 1, "processing"), ("a", 2, "failed"), ("a", 3, "completed"), ("b", 1, "processing")], "attempt_id string, event_time int, status string")
    assert {r["attempt_id"]: r["status"] for r in I.attempt_status(events).collect()} == {"a": "failed", "b": "processing"}


def test_long_retry_chains(spark):
    chain = [(f"a{k}", f"a{k - 1}" if k else None) for k in range(200)] + [(f"m{k}", f"m{k - 1}" if k else "gone") for k in range(150)]
    ring = [(f"r{k}", f"r{(k + 1) % 90}") for k in range(90)]
    found = {r["attempt_id"]: (r["retry_count"], r["code"]) for r in I.retry_depth(spark.createDataFrame(chain + ring, "attempt_id string, parent_attempt_id string")).collect()}
    assert all(found[f"a{k}"] == (k, None) for k in range(200))
    assert all(found[f"m{k}"] == (None, "PARENT_MISSING") for k in range(150)) and all(found[f"r{k}"] == (None, "CYCLE") for k in range(90))


def test_scope_and_access(spark, tx, accounts):
    assert S.scope(tx, "2026-01-02", "2026-02-10").count() == 3
    with pytest.raises(ValueError):
        S.scope(tx, "2026-02-01", "2026-01-01")
    members = spark.createDataFrame([("b", "u", "owner", "active"), ("b", "v", "viewer", "active"), ("b", "w", "owner", "disabled")], "business_id string, user_id string, role string, status string")
    assert [S.visible_to(tx, members, u).count() for u in "uvw"] == [6, 0, 0]
    ok, errors = S.currency_guard(tx.withColumn("currency", F.when(F.col("amount_minor") == 10000, "USD").otherwise("INR")), accounts)
    assert ok.count() == 0 and errors.first()["wrong_rows"] == 1


def test_constraints(spark):
    df = spark.createDataFrame([("k", "p"), ("k", "q"), (None, "q"), (None, "z")], "k string, parent string")
    assert [tuple(r) for r in Q.duplicates(df, ["k"], F.col("k").isNotNull()).collect()] == [("k", 2)]
    parents = spark.createDataFrame([("p",), ("q",)], "parent string")
    assert [r["parent"] for r in Q.orphans(df, parents, "parent").collect()] == ["z"]
    assert Q.violations(df, {"set": F.col("k") == "k"}).count() == 0


def test_profit_and_profile(spark):
    main = spark.createDataFrame([("b", day("2024-01-01"), "Sales Revenue", "Credit", D("730.00")), ("b", day("2025-12-31"), "COGS", "Debit", D("30.00")), ("c", day("2025-01-01"), "COGS", "Debit", D("1.00"))], "business_id string, date date, category string, type string, amount decimal(18,2)")
    card = spark.createDataFrame([("b", "Payment", D("50.00")), ("b", None, D("20.00"))], "business_id string, category string, amount decimal(18,2)")
    pay = spark.createDataFrame([("b", D("100.00"))], "business_id string, amount decimal(18,2)")
    found = {r["business_id"]: r for r in P.profit_and_loss(main, card, pay).collect()}
    assert found["b"]["total_expenses"] == D("150.00") and found["b"]["net_profit"] == D("580.00") and round(found["b"]["annual_turnover"], 2) == 365.0
    assert found["c"]["net_profit_margin"] is None and found["c"]["years_covered"] == 1.0
    profile = {(r["column_name"], r["measure"]): r["value"] for r in P.profile(card, "category").collect()}
    assert profile[("*", "rows")] == "2" and profile[("category", "missing")] == "1"


def test_eligibility(spark):
    schemes = spark.createDataFrame([("s1", "One", "Any", 0.0, 100.0, "Any", "Micro", 18.0, None), ("s2", "Two", "Retail", 0.0, 100.0, "Goa", "Any", None, 60.0)], "scheme_id string, scheme_name string, sector string, min_turnover double, max_turnover double, applicable_states string, business_category string, min_age double, max_age double")
    profiles = spark.createDataFrame([("b", 100.0, "Goa", "Retail", "Micro", 61), ("c", 101.0, "Goa", "Farm", "Micro", 17)], "business_id string, turnover double, state string, sector string, business_category string, owner_age int")
    found = {(r["business_id"], r["scheme_id"]): (r["eligible"], [c["check"] for c in r["checks"] if not c["passed"]]) for r in E.eligibility(profiles, schemes).collect()}
    assert found == {("b", "s1"): (True, []), ("b", "s2"): (False, ["Owner age <= 60"]), ("c", "s1"): (False, ["Turnover within range", "Owner age >= 18"]), ("c", "s2"): (False, ["Turnover within range", "Sector matches"])}
    assert [tuple(r) for r in E.eligible_names(profiles, schemes).collect()] == [("b", "One")]


def test_eligible_names_are_those_of_all_pairs(spark):
    import random

    dice = random.Random(4)
    pick = lambda *values: dice.choice(values)
    amount = lambda: pick(0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 1023.0, 1024.0, 1025.0, 5e5, -3.0)
    schemes = [(f"s{k}", f"Name {k % 40}", pick("Any", "A", "B"), *sorted([amount(), amount()])[:: pick(1, 1, 1, -1)], pick("Any", "x", "y"), pick("Any", "m", "n"), pick(None, 18.0, 30.0), pick(None, 40.0, 60.0)) for k in range(80)]
    profiles = [(f"b{k}", pick(None, amount(), amount()), pick("x", "y", "z", "Any", None), pick("A", "B", "C", None), pick("m", "n", None), pick(None, 17, 18, 35, 61)) for k in range(120)]
    rules = spark.createDataFrame(schemes, "scheme_id string, scheme_name string, sector string, min_turnover double, max_turnover double, applicable_states string, business_category string, min_age double, max_age double")
    people = spark.createDataFrame(profiles, "business_id string, turnover double, state string, sector string, business_category string, owner_age int")
    expected = {(r["business_id"], r["scheme_name"]) for r in E.eligibility(people, rules).filter("eligible").collect()}
    found = [tuple(r) for r in E.eligible_names(people, rules).collect()]
    assert set(found) == expected and len(found) == len(expected) > 100


def most_rows(df):
    """The most rows that any operator of the plan gave when it ran."""
    df.collect()

    def walk(node):
        count = node.metrics().get("numOutputRows")
        within = {"AdaptiveSparkPlan": "executedPlan"}.get(node.nodeName(), "plan" if node.nodeName().endswith("QueryStage") else None)
        below = [getattr(node, within)()] if within else [node.children().apply(k) for k in range(node.children().size())]
        return max([count.get().value() if count.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_eligible_names_meet_once_however_many_schemes_bear_them(spark):
    form = "scheme_id string, scheme_name string, sector string, min_turnover double, max_turnover double, applicable_states string, business_category string, min_age double, max_age double"
    rules = spark.createDataFrame([(f"s{k}", None if k % 3 == 0 else f"Name {k % 3}", "Any", float(k), 800.0 - k, "Any", "Any" if k % 2 else "m", 18.0 if k % 4 == 0 else None, None) for k in range(300)], form)
    profiles = [(f"b{k}", 300.0 + k % 200, "x", "A", "m", 16 + k % 9) for k in range(400)]
    people = spark.createDataFrame(profiles, "business_id string, turnover double, state string, sector string, business_category string, owner_age int")
    assert most_rows(E.eligible_names(people, rules)) <= 3 * 400
    # One business has its profile twice.
    twice = E.eligible_names(people.union(people.limit(1)), rules)
    assert sorted(tuple(r) for r in twice.collect() if r[1]) == sorted((f"b{k}", f"Name {n}") for k in range(400) for n in (1, 2)) and twice.count() == 1200


def batch_text(dice):
    """A JSON batch, sound or spoilt, with brackets and quotes in texts and objects in objects."""
    word = lambda: dice.choice(["a", "}", "{", '"', "\\", "],[", "é", ',{"', "\n", "}}", ""])
    value = lambda deep=0: dice.choice([1, None, True, 1.5, word() + word(), *([[value(deep + 1) for _ in range(dice.randrange(3))], {word() + str(k): value(deep + 1) for k in range(dice.randrange(3))}] if deep < 3 else [])])
    members = {"records": dice.choice([[value() if dice.random() < 0.2 else {"n": k, "v": value()} for k in range(dice.randrange(12))]] * 8 + [5, {"a": {"b": {}}, "c": {"d": {}}}, [[{}, {}, {}]]])}
    for name in ("x", "contract_version"):
        members[name] = dice.choice(["v1", "v1", [{"a": 1}, {"b": 2}, {}], {"a": {"b": 1}}])
    names = dice.sample(sorted(members), k=dice.choice([3, 3, 3, 2]))
    text = dice.choice(["", "", "\ufeff"]) + json.dumps({n: members[n] for n in names}, indent=dice.choice([None, None, 1]), ensure_ascii=dice.random() < 0.5) + dice.choice(["", "\n", "  "])
    at = dice.randrange(len(text))
    return dice.choice([text] * 6 + [text[:at], text[:at] + text[at + 1 :], text[:at] + dice.choice('{}[]",\\') + text[at:], "[" + text + "]", text + text])


@pytest.mark.parametrize("cut", ["64", "128m"])
def test_batches_in_pieces(spark, tmp_path, monkeypatch, cut):
    """Batches read in pieces give the payloads and records that reading each as one value gives."""
    import random

    monkeypatch.setattr(statements, "SLICE_LINES", 5)
    dice = random.Random(8)
    texts = {f"{k}.json": batch_text(dice) for k in range(150)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    shown = lambda df, *columns: sorted([tuple(r) for r in df.select(F.element_at(F.split("file", "/"), -1).alias("file"), *columns).collect()], key=repr)
    whole = spark.createDataFrame([(n, t.removeprefix("\ufeff")) for n, t in texts.items()], "file string, value string").select("file", F.try_parse_json("value").alias("payload"))
    listed = whole.select("file", F.posexplode(F.expr("try_cast(variant_get(payload, '$.records', 'variant') AS ARRAY<VARIANT>)")).alias("position", "record"))
    verdicts = lambda e: shown(C.check_json_envelopes(e, "v1", "bank"), "code", "field")
    spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        envelopes, records = statements.read_payloads(spark, [str(tmp_path)])
        found = shown(records, "position", F.to_json("record")), verdicts(envelopes)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == (shown(listed, "position", F.to_json("record")), verdicts(whole))


def test_a_large_batch_is_no_single_value(spark, tmp_path):
    """Records of a regular batch are read from texts of an object each."""
    rows = [{**GOOD, "description": f"no. {k} {{}}"} for k in range(5000)]
    (tmp_path / "a.json").write_text(json.dumps({**WHOLE, "records": rows}), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(rows), encoding="utf-8")
    assert statements._segments(spark, [str(tmp_path)], None).filter("file LIKE '%a.json'").agg(F.max(F.char_length("text"))).first()[0] < 500
    envelopes, records = statements.read_payloads(spark, [str(tmp_path)])
    assert records.count() == 5000 and envelopes.count() == 2
    assert envelopes.filter("payload IS NOT NULL").agg(F.max(F.char_length(F.to_json("payload")))).first()[0] < 12_000


def test_places_of_one_large_account(spark):
    """Numbers of rows that lie in several ranges, with ties, beside those of small accounts."""
    import random

    dice = random.Random(9)
    rows = [("b", "large", dice.randrange(300), k) for k in range(4000)] + [("b", f"a{k % 7}", k % 3, k) for k in range(60)]
    table = spark.createDataFrame(rows, "business_id string, account_id string, x int, y int").repartition(9)
    found = {(r["account_id"], r["y"]): r["_row"] for r in R.numbered(table, [F.col("x"), F.col("y")]).collect()}
    for account in {r[1] for r in rows}:
        own = sorted((x, y) for _, a, x, y in rows if a == account)
        assert [found[account, y] for _, y in own] == list(range(len(own)))
    lines = R.report_lines({name: table.withColumnRenamed("x", "amount_minor").withColumns({"category": F.lit("c"), "mode_order": F.lit(1), "token": F.lit(1)}) if name in ("category_report", "payment_mode_report") else table for name in R.SECTIONS if name != "anomaly_report"} | {"anomaly_report": table.selectExpr("business_id", "account_id", "'2026' AS date_detected", "'t' AS type", "'s' AS severity", "x AS metric_value", "y AS affected_amount_minor", "'c' AS affected_category")})
    assert lines.filter("section = 'anomaly_report'").count() == len(rows) and lines.filter("section = 'anomaly_report' AND account_id = 'large'").agg(F.max("row")).first()[0] == 3999


def test_sensitive_names_at_any_depth(spark):
    value = """named_struct('token', 1, 'kept', named_struct('path', 2, 'rows', array(named_struct('sql', 3, 'ok', map('session_id', 'x', 'fine', 'y')), NULL)), 'none', CAST(NULL AS STRUCT<token: INT, a: INT>))"""
    table = spark.sql(f"SELECT 'b' AS business_id, 'a' AS account_id, 't' AS transaction_id, {value} AS nested, map(1, named_struct('token', 5, 'b', 6)) AS by_number, array(1, 2) AS plain")
    cleaned = R.without_sensitive(table)
    names = cleaned.schema.simpleString()
    assert all(f"{n}:" not in names for n in ("token", "path", "sql", "transaction_id"))
    row = json.loads(cleaned.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    assert row == {"business_id": "b", "account_id": "a", "nested": {"kept": {"rows": [{"ok": {"fine": "y"}}, None]}, "none": None}, "by_number": {"1": {"b": 6}}, "plain": [1, 2]}
    assert R.without_sensitive(table.select("plain")).schema == table.select("plain").schema


def test_chunks_and_neighbours(spark):
    def split(text, size=500, overlap=50):
        out, start = [], 0
        while start < len(text):
            end = min(len(text), start + size)
            if end < len(text):
                ends = [text.rfind(mark, start + size // 2, end) + len(mark) for mark in ("\n\n", "\n", " ") if mark in text[start + size // 2 : end]]
                end = ends[0] if ends else end
            out.append(text[start:end])
            if end == len(text):
                break
            start = max(start + 1, end - overlap)
        return out

    text = "para one. " * 40 + "\n\n" + "word " * 200 + "x" * 700
    docs = spark.createDataFrame([(1, "t", text), (2, "t", None), (3, "t", ""), (4, "t", "é\n" * 249 + "\n\n" + "🙂 b" * 60_000), (5, "t", "z" * 500), (6, "t", "z" * 501)], "doc_id long, source string, text string")
    made = {}
    for r in M.chunk(docs).orderBy("doc_id", "chunk_index").collect():
        made.setdefault(r["doc_id"], []).append(r["chunk_text"])
    assert made == {r["doc_id"]: split(r["text"]) for r in docs.filter("length(text) > 0").collect()} and len(made[4]) > 300
    docs = docs.filter("doc_id < 4")
    assert M.chunk_fixed(docs).count() == -(-len(text) // 450)
    chunks = spark.createDataFrame([(k, "g", [float(k), 0.0], f"text {k}") for k in range(10)] + [(99, "h", [0.0, 0.0], "far")], "chunk_id long, label string, embedding array<float>, chunk_text string")
    asked = spark.createDataFrame([(1, "g", [2.5, 0.0]), (2, "none", [0.0, 0.0])], "question_id long, label string, embedding array<float>")
    hits = M.top_k(asked, chunks, "label")
    assert [r["chunk_id"] for r in hits.orderBy("rank").collect()] == [2, 3, 1, 4]
    contexts = {r["question_id"]: r["context"] for r in M.context(hits, chunks, asked).collect()}
    assert contexts == {1: "text 2\n\ntext 3\n\ntext 1\n\ntext 4", 2: M.NOTHING}


def test_shown_values(spark):
    row = spark.range(1).select(X.masked_identifier(F.lit("123456")), X.masked_identifier(F.lit("1234")), X.format_minor(F.lit("INR"), F.lit(123450)), X.format_minor(F.lit("INR"), F.lit(None)), X.minor_units(F.lit("1.005")), X.token_hash(F.lit("t"))).first()
    assert list(row[:5]) == ["****3456", "1234", "INR 1,234.50", "—", None] and row[5] == hashlib.sha256(b"t").hexdigest()


def test_every_part_has_its_whole(spark, sf):
    from ledgerforge import catalog
    from ledgerforge.plans.shapes import shape

    parts = "health_metrics last_two_months anomaly_large_transactions anomaly_month_changes anomaly_metric_alarms anomaly_negative_days anomaly_category_spikes anomaly_unexpected_modes anomalies anomalies_coarse"
    parts += " metric_rules recommendations recommendation_texts advice_summary chart_rows report_fields report_list report_rows report_json account_summary nearest_chunks question_contexts"
    for name in parts.split():
        assert f"{name}_all" in catalog.QUERIES and (name in catalog.ORACLE_SQL) == (f"{name}_all" in catalog.ORACLE_SQL)
    assert sum(r["transaction_count"] for r in catalog.QUERIES["account_summary_all"](spark, sf).collect()) == shape(spark, sf, "ledger").count()
    asked = {r["question_id"] for r in catalog.QUERIES["nearest_chunks_all"](spark, sf).collect()}
    assert asked == {r["vec_id"] for r in shape(spark, sf, "embeddings").filter("vec_id % 50 = 0").collect()}
