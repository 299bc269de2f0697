"""From cells of unknown layout to canonical records: P3, P4, P10-P12.

A layout is the list of header keys of a file. Layouts are few and files many, so columns are
mapped on a table with one row a layout; rows then look cells up by the mapped place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_header_key, collapse, direction_of_key, with_nfkc_cells, parse_date, parse_number, payment_mode_of, to_minor
from ..sources.sinks import kept
from .contract import MOST_MINOR, TEXT_LIMITS

# Header names of each role.
ALIASES = {
    "date": ("date", "transaction date", "txn date", "posting date", "value date", "date posted", "posted date"),
    "direction": ("direction", "transaction direction", "debit credit", "credit debit", "cash flow", "flow", "income expense", "expense income"),
    "type": ("type", "transaction type"),
    "debit": ("debit", "debit amount", "withdrawal", "withdrawals", "withdraw", "outflow", "dr"),
    "credit": ("credit", "credit amount", "deposit", "deposits", "inflow", "cr"),
    "amount": (
        "amount minor", "minor amount", "amount in minor units", "amount paise", "amount cents", "amount", "transaction amount",
        "value", "transaction value", "net amount", "amount paid", "total amount", "balance change",
    ),
    "description": ("description", "narration", "remarks", "details", "memo", "transaction details", "transaction description", "particulars"),
    "category": ("category", "expense type", "income type", "transaction type", "expense category"),
    "payment": ("payment mode", "payment method", "method", "mode", "payment type", "transaction mode"),
    "source_id": (
        "source transaction id", "transaction id", "txn id", "reference", "reference id", "transaction reference", "source ref",
        "source reference", "utr", "rrn",
    ),
    "counterparty": ("counterparty", "merchant", "payee", "beneficiary"),
    "subtype": ("subtype", "transaction subtype", "source subtype"),
    "reference": ("source record reference", "record reference", "line number", "row number"),
    "balance": ("balance", "closing balance", "running balance", "ledger balance", "available balance", "balance after"),
}
EXCLUDING = ("date", "direction", "type", "debit", "credit", "amount")
UNSURE = -1


def _let(value: Column, then) -> Column:
    """`then(value)` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _score(header: Column, aliases: Column) -> Column:
    """100 for an alias itself, else 80 and the words of the longest alias whose words all stand in the header."""
    partly = F.transform(aliases, lambda a: F.when(F.size(F.array_except(F.split(a, " "), F.split(header, " "))) == 0, 80 + F.size(F.split(a, " "))).otherwise(0))
    return F.when(F.array_contains(aliases, header), 100).otherwise(F.array_max(partly))


def _choose(headers: Column, excluded: Column, aliases: Column) -> Column:
    """Place of the best header, NULL for none, `UNSURE` for a tie."""
    scores = F.transform(headers, lambda h, k: F.when((h == "") | F.array_contains(excluded, k), 0).otherwise(_score(h, aliases)))

    def place(scores: Column) -> Column:
        best = F.array_max(scores)
        ties = F.size(F.filter(scores, lambda s: s == best))
        return F.when(best > 0, F.when(ties > 1, UNSURE).otherwise(F.array_position(scores, best).cast("int") - 1))

    return _let(scores, place)


def map_headers(layouts: DataFrame) -> DataFrame:
    """For each layout (`layout`, `headers`: array of keys) the place of every role, twice:
    for files whose type column gives the direction (`by_type`) and for others.

    Roles are chosen one after another in a fold, because earlier ones take their column
    away from later ones. `code` is the first failure: repeated headers, a missing date, a tie
    anywhere, or neither amount nor sides.
    """
    both = layouts.withColumn("by_type", F.explode(F.array(F.lit(False), F.lit(True))))
    roles = F.array(*[
        F.struct(F.lit(role).alias("role"), F.array(*map(F.lit, names)).alias("aliases"), F.lit(role in EXCLUDING).alias("takes")) for role, names in ALIASES.items()
    ])
    none = F.lit(None).cast("int")
    nothing = F.array().cast("array<int>")
    begin = F.struct(nothing.alias("taken"), none.alias("direction"), nothing.alias("places"))

    def step(state: Column, role: Column) -> Column:
        def after(place: Column) -> Column:
            # The type column stays free for a category unless it became the direction.
            typed = (role["role"] == "type") & F.col("by_type") & state["direction"].isNull()
            told = F.when(role["role"] == "direction", place).when(typed, place).otherwise(state["direction"])
            took = role["takes"] & place.isNotNull() & ((role["role"] != "type") | typed)
            taken = F.when(took, F.array_append(state["taken"], place)).otherwise(state["taken"])
            return F.struct(taken.alias("taken"), told.alias("direction"), F.array_append(state["places"], place).alias("places"))

        return _let(_choose(F.col("headers"), state["taken"], role["aliases"]), after)

    mapped = both.withColumn("_m", F.aggregate(roles, begin, step))
    at = {role: F.col("_m.direction") if role == "direction" else F.get("_m.places", F.lit(k)) for k, role in enumerate(ALIASES)}
    mapped = mapped.withColumns({f"at_{role}": place for role, place in at.items()})
    shown = F.filter("headers", lambda h: h != "")
    lacking = F.col("at_amount").isNull() & F.col("at_debit").isNull() & F.col("at_credit").isNull()
    code = (
        F.when(F.size(F.array_distinct(shown)) < F.size(shown), "DUPLICATE_HEADER")
        .when(F.size(shown) == 0, "LOW_CONFIDENCE")
        .when(F.col("at_date").isNull(), "REQUIRED_COLUMN")
        .when(F.array_contains("_m.places", UNSURE), "LOW_CONFIDENCE")
        .when(lacking, "REQUIRED_COLUMN")
    )
    unit = lambda role: F.coalesce(F.get("headers", F.col(f"at_{role}")).rlike("minor|paise|cents"), F.lit(False))
    return mapped.select("layout", "by_type", code.alias("layout_code"), (F.size(shown) == 0).alias("no_headers"), unit("amount").alias("amount_minor_units"), unit("balance").alias("balance_minor_units"), *[f"at_{r}" for r in ALIASES])


def _word(clean: Column) -> Column:
    return direction_of_key(ascii_header_key(clean))


def directional_files(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Files without a direction column whose type column holds direction words only, and at least one."""
    plain = mapping.filter("NOT by_type AND at_direction IS NULL AND at_type >= 0").select("layout", "at_type")
    cells = rows.join(_small(plain), "layout").select("file", collapse(F.get("cells", F.col("at_type"))).alias("v"))
    told = cells.filter("v IS NOT NULL").groupBy("file").agg(F.bool_and(_word(F.col("v")).isNotNull()).alias("by_type"))
    return told.filter("by_type")


#: Layouts and facts of files are broadcast up to this number, about 40 MB; more are joined by shuffle.
MOST_LAYOUTS = 50_000


def _small(facts: DataFrame) -> DataFrame:
    return F.broadcast(facts) if facts.count() <= MOST_LAYOUTS else facts


#: What is looked at before what, over a whole file: reading, headers, widths, columns, signs, rows, contract.
READING, HEADERS, WIDTHS, COLUMNS, SIGNS, ROWS, CONTRACT = range(7)


def canonicalize(rows: DataFrame, layouts: DataFrame, mode: str = "file") -> tuple[DataFrame, DataFrame]:
    """(accepted records, rejections) of `rows` (file, layout, position, cells, fault).

    In mode `file` one bad row rejects its file; the code is that of the first check that fails
    anywhere in the file, in the order reading, headers, widths, columns, signs, rows, contract,
    and of its first row there. In mode `row` only bad rows go. `fault` is what reading found wrong
    with a row or its file. Cells are normalised once and stored; the layouts are counted before
    they are broadcast; per-file facts are small sums joined back.
    """
    mapping = kept(map_headers(layouts))
    rows = rows.filter(F.exists("cells", lambda cell: F.trim(F.coalesce(cell, F.lit(""))) != "") | F.col("fault").isNotNull())
    rows = kept(with_nfkc_cells(kept(rows)))
    named = rows.join(_small(kept(directional_files(rows, mapping))), "file", "left").fillna(False, ["by_type"])
    r = named.join(_small(mapping), ["layout", "by_type"], "left")
    cell = lambda role: collapse(F.get("cells", F.when(F.col(f"at_{role}") >= 0, F.col(f"at_{role}"))))
    r = r.withColumns({f"c_{role}": cell(role) for role in ALIASES})
    sided = F.col("at_debit").isNotNull() | F.col("at_credit").isNotNull()
    chosen = F.when(sided, F.coalesce("c_debit", "c_credit", "c_amount")).otherwise(F.col("c_amount"))
    r = r.withColumn("_number", parse_number(chosen)).withColumn("_word", _word(F.col("c_direction")))
    one_sided = (
        F.when(F.col("c_debit").isNotNull(), "expense").when(F.col("c_credit").isNotNull(), "income").otherwise(F.col("_word"))
    )
    by_sign = F.coalesce("_word", F.when(F.col("_number") < 0, "expense").when(F.col("_number") > 0, "income"))
    r = r.withColumn("_direction", F.when(sided, one_sided).otherwise(by_sign))
    r = r.withColumn("_minor", to_minor(F.col("_number"), F.col("amount_minor_units"))).withColumn("_day", parse_date(F.col("c_date")))
    r = r.withColumn("_balance_number", parse_number(F.col("c_balance")))
    r = r.withColumn("_balance", to_minor(F.col("_balance_number"), F.col("balance_minor_units"), signed=True))
    unsigned = F.col("layout").isNotNull() & F.col("at_direction").isNull() & ~sided
    positive = r.filter(unsigned).groupBy("file").agg(((F.min("_number") >= 0) & (F.count("*") == F.count("_number"))).alias("_positive"))
    r = r.join(_small(kept(positive.filter("_positive"))), "file", "left")
    texts = {"source_transaction_id": "c_source_id", "category": "c_category", "description": "c_description", "counterparty": "c_counterparty", "source_subtype": "c_subtype", "source_record_reference": "c_reference"}
    too_long = F.lit(False)
    for field, column in texts.items():
        too_long = too_long | F.coalesce(F.char_length(column) > TEXT_LIMITS[field], F.lit(False))
    headers = F.col("layout_code").isin("DUPLICATE_HEADER") | F.col("no_headers")
    unread = F.coalesce(unsigned & F.col("_number").isNull() & F.col("layout").isNotNull(), F.lit(False))
    found = _first(
        (F.col("layout").isNull() & F.col("fault").isNotNull(), READING, F.col("fault")),
        (headers, HEADERS, F.col("layout_code")),
        (F.col("fault").isNotNull(), WIDTHS, F.col("fault")),
        (F.col("layout_code").isNotNull(), COLUMNS, F.col("layout_code")),
        (unread, SIGNS, F.lit("INVALID_AMOUNT")),
        (F.col("_positive"), SIGNS, F.lit("LOW_CONFIDENCE")),
        (sided & F.col("c_debit").isNotNull() & F.col("c_credit").isNotNull(), ROWS, F.lit("INVALID_DIRECTION")),
        (F.col("_number").isNull(), ROWS, F.lit("INVALID_AMOUNT")),
        (F.col("_direction").isNull(), ROWS, F.when(sided, "INVALID_DIRECTION").otherwise("INVALID_AMOUNT")),
        (F.col("_minor").isNull(), ROWS, F.lit("INVALID_PRECISION")),
        (F.col("_minor") <= 0, ROWS, F.lit("INVALID_AMOUNT")),
        (F.col("_day").isNull(), ROWS, F.lit("INVALID_DATE")),
        (F.col("c_balance").isNotNull() & F.col("_balance_number").isNull(), ROWS, F.lit("INVALID_AMOUNT")),
        (F.col("c_balance").isNotNull() & F.col("_balance").isNull(), ROWS, F.lit("INVALID_PRECISION")),
        (F.col("_minor") > MOST_MINOR, CONTRACT, F.lit("INVALID_AMOUNT")),
        (too_long, CONTRACT, F.lit("INVALID_CANONICAL")),
    )
    r = r.withColumn("_found", found)
    done = r.select(
        "file", "position", F.col("_found.code").alias("code"), F.col("_found.stage").alias("stage"), F.col("_day").alias("transaction_date"), F.col("_minor").alias("amount_minor"), F.col("_direction").alias("direction"),
        *[F.col(column).alias(field) for field, column in texts.items()], payment_mode_of(F.col("c_payment")).alias("payment_method"), F.col("_balance").alias("balance_after_minor"),
    )
    if mode == "row":
        return done.filter("code IS NULL").drop("code", "stage"), done.filter("code IS NOT NULL").select("file", "position", "code")
    done = kept(done)
    worst = F.min(F.struct("stage", "position", "code"))
    verdicts = kept(done.filter("code IS NOT NULL").groupBy("file").agg(worst.alias("w")).select("file", "w.position", "w.code"))
    return done.join(_small(verdicts.select("file")), "file", "left_anti").drop("code", "stage"), verdicts


def _first(*cases: tuple[Column, int, Column]) -> Column:
    """(stage, code) of the first case that holds."""
    out = None
    for hit, stage, code in cases:
        value = F.struct(F.lit(stage).alias("stage"), code.alias("code"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out
