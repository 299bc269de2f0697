"""Report sections, long rows, charts and JSON: R1-R6, S9, S10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import kept
from .scope import KEYS

# Section names in order, their fields, other names, and keys that must not be shown.
FINANCIAL = ("total_income_minor", "total_expense_minor", "net_cash_flow_minor", "transaction_count", "average_transaction_minor", "income_expense_ratio", "savings_rate", "opening_balance_minor", "closing_balance_minor")
SECTIONS = ("financial_summary", "income_statement", "expense_summary", "cash_flow_summary", "category_report", "payment_mode_report", "account_summary", "business_health_report", "anomaly_report")
COMBINED = "combined_executive_report"
SENSITIVE = ("account_id", "business_id", "canonical_identity_hash", "identity_id", "path", "session_id", "session_token", "source_transaction_id", "sql", "stack_trace", "token", "transaction_id", "transaction_reference")
#: Columns that only order a list.
HIDDEN = ("mode_order",)
#: List sections with as many rows as an account has hits.
MANY = ("anomaly_report",)
TYPE_ALIASES = {"executive": COMBINED, "combined_executive": COMBINED}


def sections(figures: DataFrame, daily: DataFrame, weekly: DataFrame, monthly: DataFrame, categories: DataFrame, modes: DataFrame, accounts: DataFrame, metrics: DataFrame, anomalies: DataFrame) -> dict[str, DataFrame]:
    """The nine sections without sensitive columns; only the account keys stay, to tell rows apart."""
    found = {
        "financial_summary": figures.select(*KEYS, *FINANCIAL),
        "income_statement": figures.select(*KEYS, F.col("total_income_minor").alias("income_minor"), F.col("total_expense_minor").alias("expense_minor"), "net_cash_flow_minor", "savings_rate"),
        "expense_summary": figures.select(*KEYS, "total_expense_minor", "income_expense_ratio", "largest_expense_minor", "smallest_expense_minor"),
        "cash_flow_summary": figures.select(*KEYS, "opening_balance_minor", "closing_balance_minor", "net_cash_flow_minor").join(trends(figures, daily, weekly, monthly), list(KEYS)),
        "category_report": categories,
        "payment_mode_report": modes,
        "account_summary": accounts,
        "business_health_report": metrics,
        "anomaly_report": anomalies,
    }
    return {name: without_sensitive(table) for name, table in found.items()}


def _rewritten(value: Column, kind: T.DataType) -> Column | None:
    """`value` without sensitive names at any depth; None where there are none."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, _rewritten(value.getField(f.name), f.dataType)) for f in kind.fields if f.name not in SENSITIVE]
        if len(parts) == len(kind.fields) and all(part is None for _, part in parts):
            return None
        made = F.struct(*[(value.getField(name) if part is None else part).alias(name) for name, part in parts])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return None if _same(kind.elementType) else F.transform(value, lambda x: _rewritten(x, kind.elementType))
    if isinstance(kind, T.MapType):
        # Names of a map are its keys, known only row by row.
        out = F.map_filter(value, lambda k, _: ~k.isin(*SENSITIVE)) if isinstance(kind.keyType, T.StringType) else value
        return out if _same(kind.valueType) else F.transform_values(out, lambda _, v: _rewritten(v, kind.valueType))
    return None


def _same(kind: T.DataType) -> bool:
    """Whether nothing within a type could be sensitive."""
    if isinstance(kind, T.StructType):
        return all(f.name not in SENSITIVE and _same(f.dataType) for f in kind.fields)
    return _same(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType)


def without_sensitive(table: DataFrame) -> DataFrame:
    """R2: `table` without sensitive columns, fields of structs, and keys of maps, however deep; the account keys stay."""
    names = [f for f in table.schema.fields if f.name in KEYS or f.name not in SENSITIVE]
    return table.select(*[F.col(f.name) if _same(f.dataType) else _rewritten(F.col(f.name), f.dataType).alias(f.name) for f in names])


def trends(figures: DataFrame, daily: DataFrame, weekly: DataFrame, monthly: DataFrame) -> DataFrame:
    """`trends` of every account: its days, weeks and months in order, as lists that grow with the calendar only."""
    out, empty = figures.select(*KEYS), []
    for grain, table in (("daily", daily), ("weekly", weekly), ("monthly", monthly)):
        kinds = dict(table.dtypes)
        names = ["period", *[c for c in table.columns if c not in (*KEYS, "period", *SENSITIVE)]]
        row = F.struct(*[_json_value(c, kinds[c]).alias(c) for c in names])
        out = out.join(table.groupBy(*KEYS).agg(F.sort_array(F.collect_list(row)).alias(grain)), list(KEYS), "left")
        empty.append(F.coalesce(F.col(grain), F.array().cast(out.schema[grain].dataType)).alias(grain))
    return out.select(*KEYS, F.struct(*empty).alias("trends"))


def list_orders(name: str) -> list | None:
    """How the rows of a list section follow each other: ascending values; None for other sections."""
    return {
        "category_report": [-F.col("amount_minor"), F.col("category")],
        "payment_mode_report": [F.col("mode_order")],
        "account_summary": [F.col(k) for k in KEYS],
        "anomaly_report": [F.coalesce("date_detected", F.lit("")), *map(F.col, ("type", "severity", "metric_value", "affected_amount_minor", "affected_category"))],
    }.get(name)


def chart_rows(daily: DataFrame, weekly: DataFrame, monthly: DataFrame) -> DataFrame:
    """The three trends under one another, told apart by `grain`."""
    parts = [t.withColumn("grain", F.lit(g)) for g, t in (("daily", daily), ("weekly", weekly), ("monthly", monthly))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _text(column: str, kind: str):
    value = F.col(column)
    if kind.startswith(("struct", "array")):
        return F.to_json(value)
    return F.date_format(value, "yyyy-MM-dd") if kind == "date" else value.cast("string")


def field_rows(section: str, table: DataFrame) -> DataFrame:
    """A one-row-an-account section as (section, field, value), values as plain text."""
    kinds = dict(table.dtypes)
    fields = sorted(c for c in table.columns if c not in KEYS)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _text(f, kinds[f]).alias("value")) for f in fields]))
    return table.select(*KEYS, F.lit(section).alias("section"), F.lit(None).cast("long").alias("row"), pairs.alias("p")).select(*KEYS, "section", "row", "p.field", "p.value")


def numbered(table: DataFrame, order: list[Column]) -> DataFrame:
    """`table` plus `_row`, the place of each row (from 0) among those of its account.

    An account may hold most rows, so none is ranked as a whole: rows are dealt by ranges of
    account and order, numbered within their range, and each range's rows are moved on by the
    number of the account's rows in earlier ranges.
    """
    keys = {f"_o{k}": c for k, c in enumerate(order)}
    dealt = table.withColumns(keys).repartitionByRange(*KEYS, *keys).withColumn("_part", F.spark_partition_id())
    # Ranges are drawn from a sample; they are stored so that both readers see the same ones.
    dealt = kept(dealt)
    earlier = Window.partitionBy(*KEYS).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*KEYS, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*KEYS, "_part").orderBy(*keys))
    placed = dealt.withColumn("_nth", nth).join(offsets.drop("_n"), [*KEYS, "_part"])
    return placed.withColumn("_row", (F.col("_before") + F.col("_nth") - 1).cast("long")).select(*table.columns, "_row")


def list_rows(section: str, table: DataFrame, order: list) -> DataFrame:
    """A list section as (section, row from 0, field, value).

    Windows run over the few groups of an account; hits, which may be many, are numbered by ranges.
    """
    kinds = dict(table.dtypes)
    fields = sorted(c for c in table.columns if c not in (*KEYS, *HIDDEN))
    few = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order)) - 1
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _text(f, kinds[f]).alias("value")) for f in fields]))
    placed = numbered(table, order) if section in MANY else table.withColumn("_row", few.cast("long"))
    return placed.select(*KEYS, F.lit(section).alias("section"), F.col("_row").alias("row"), pairs.alias("p")).select(*KEYS, "section", "row", "p.field", "p.value")


def report_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """Every section as long rows."""
    out = None
    for name in SECTIONS:
        order = list_orders(name)
        rows = list_rows(name, parts[name], order) if order else field_rows(name, parts[name])
        out = rows if out is None else out.unionByName(rows)
    return out


def report_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """R4, S9 for accounts of any size: (section, row, json), a JSON text for each row of each section.

    Nothing is collected for an account, as `report_json` must for its one text.
    """
    out = None
    for name in SECTIONS:
        order, kinds = list_orders(name), dict(parts[name].dtypes)
        table = parts[name].withColumn("_row", F.lit(None).cast("long")) if not order else numbered(parts[name], order)
        line = F.to_json(F.struct(*[_json_value(c, kinds[c]).alias(c) for c in parts[name].columns if c not in (*KEYS, *HIDDEN)]))
        rows = table.select(*KEYS, F.lit(name).alias("section"), F.col("_row").alias("row"), line.alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def report_json(parts: dict[str, DataFrame], report_type: str = COMBINED, generated_at=None) -> DataFrame:
    """One JSON text for each account: decimals as plain strings, dates ISO.

    `report_type` is a section or the combined report. Lists are collected per account from
    its groups and hits.
    """
    report_type = TYPE_ALIASES.get(report_type, report_type)
    if report_type != COMBINED and report_type not in SECTIONS:
        raise ValueError("the requested report type is not known")
    stamp = F.lit(generated_at) if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    chosen = SECTIONS if report_type == COMBINED else (report_type,)
    base, columns = parts["financial_summary"].select(*KEYS), []
    for name in chosen:
        table = parts[name]
        kinds = dict(table.dtypes)
        texts = [F.to_json(F.struct(*[_json_value(c, kinds[c]).alias(c) for c in table.columns if c not in (*KEYS, *HIDDEN)])).alias("_one")]
        order = list_orders(name)
        one = table.select(*KEYS, *texts, F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order or [F.lit(0)])]).alias("_order"))
        if order:
            rows = F.transform(F.sort_array(F.collect_list(F.struct("_order", "_one"))), lambda r: r["_one"])
            one = one.groupBy(*KEYS).agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("_one"))
            empty = "[]"
        else:
            empty = "{}"
        base = base.join(one.select(*KEYS, F.col("_one").alias(f"_{name}")), list(KEYS), "left")
        columns.append(F.concat(F.lit(f'"{name}":'), F.coalesce(F.col(f"_{name}"), F.lit(empty))))
    body = F.concat(F.lit('{"report_type":"' + report_type + '","generated_at":"'), stamp, F.lit('","sections":{'), F.concat_ws(",", *columns), F.lit("}}"))
    return base.select(*KEYS, F.lit(report_type).alias("report_type"), body.alias("json"))


def _json_value(column: str, kind: str):
    return F.col(column).cast("string") if kind.startswith("decimal") else F.col(column)


def for_display(table: DataFrame) -> DataFrame:
    """The columns that are no identifiers."""
    return table.select(*[c for c in table.columns if not c.endswith("_id")])


def write_json(reports: DataFrame, path: str) -> None:
    """The JSON texts, one a line."""
    reports.select("json").write.text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Long rows as CSV."""
    rows.write.option("header", True).csv(path)
