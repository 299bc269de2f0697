"""Contracts of records, envelopes and master data: F5-F7, F9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANK, CURRENCY, EMAIL, PHONE

# Limits of the canonical contract.
MOST_MINOR = 99_999_999_999_999
TEXT_LIMITS = {
    "source_transaction_id": 128, "category": 100, "description": 500, "counterparty": 200, "payment_method": 50,
    "source_subtype": 100, "source_record_reference": 128,
}
ACCOUNT_TYPES = ("bank", "cash", "credit_card", "loan", "other")


def _first(*cases: tuple[Column, str, str | None]) -> Column:
    out = None
    for hit, code, field in cases:
        value = F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def check_records(records: DataFrame) -> DataFrame:
    """`code` and `field` of the first rule that a record breaks, NULL for good ones.

    Absent optional fields are NULL. Dates are texts; `try_to_date` refuses days that do not exist.
    """
    c = F.col
    cases = [(c(f).isNull(), "INVALID_FIELD", f) for f in ("transaction_date", "amount_minor", "direction")]
    date_ok = c("transaction_date").rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_date("transaction_date", "yyyy-MM-dd").isNotNull()
    cases += [
        (~F.coalesce(date_ok, F.lit(False)), "INVALID_FIELD", "transaction_date"),
        (~c("amount_minor").between(1, MOST_MINOR), "AMOUNT_OUT_OF_RANGE", "amount_minor"),
        (~c("direction").isin("income", "expense"), "INVALID_FIELD", "direction"),
    ]
    for field, limit in TEXT_LIMITS.items():
        if field in records.columns:
            bad = (c(field) == "") | c(field).rlike(rf"^{BLANK}|{BLANK}$")
            cases += [(bad, "INVALID_FIELD", field), (F.char_length(field) > limit, "TEXT_TOO_LONG", field)]
    if "balance_after_minor" in records.columns:
        cases.append((~c("balance_after_minor").between(-MOST_MINOR, MOST_MINOR), "BALANCE_OUT_OF_RANGE", "balance_after_minor"))
    return records.withColumn("_first", _first(*cases)).withColumns({"code": c("_first.code"), "field": c("_first.field")}).drop("_first")


def check_envelopes(envelopes: DataFrame, version: str, source: str, max_records: int | None = None) -> DataFrame:
    """the first rule that an envelope breaks; the number of records is bounded only on request."""
    c, n = F.col, F.size("records")
    few = (n < 1) if max_records is None else ~n.between(1, max_records)
    cases = [
        (c("contract_version").isNull(), "INVALID_FIELD", "contract_version"),
        (c("source_system").isNull(), "INVALID_FIELD", "source_system"),
        (c("contract_version") != version, "UNSUPPORTED_CONTRACT_VERSION", "contract_version"),
        (c("source_system") != source, "UNSUPPORTED_SOURCE_SYSTEM", "source_system"),
        (c("records").isNull(), "INVALID_RECORDS", "records"),
        (few, "RECORD_COUNT_OUT_OF_RANGE", "records"),
    ]
    return envelopes.withColumn("_first", _first(*cases)).withColumns({"code": c("_first.code"), "field": c("_first.field")}).drop("_first")


# Fields of the contract, in the order in which they are looked at.
ENVELOPE_FIELDS = ("contract_version", "source_system", "records")
REQUIRED_FIELDS = ("transaction_date", "amount_minor", "direction")
OPTIONAL_FIELDS = ("source_transaction_id", "category", "description", "counterparty", "payment_method", "source_subtype", "source_record_reference", "balance_after_minor")


class _Field:
    """A field of a JSON object held as a variant: whether it is there, its kind and its value."""

    def __init__(self, owner: str, name: str):
        value = F.variant_get(owner, f"$.{name}", "variant")
        self.name, self.absent, kind = name, value.isNull(), F.schema_of_variant(value)
        self.null = F.coalesce(kind == "VOID", F.lit(False))
        self.is_text = F.coalesce(kind == "STRING", F.lit(False))
        #: Whole numbers; 1e2 is none, and 12.0 is a decimal (its zeros are dropped), as are numbers beyond a long.
        large = kind.rlike(r"^DECIMAL\(\d+,0\)$") & (F.abs(F.try_variant_get(owner, f"$.{name}", "decimal(38,0)")) > (1 << 63) - 1)
        self.is_whole = F.coalesce(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | large, F.lit(False))
        self.is_list = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
        self.text = F.when(self.is_text, F.try_variant_get(owner, f"$.{name}", "string"))
        self.whole = F.when(self.is_whole, F.try_variant_get(owner, f"$.{name}", "decimal(38,0)"))


def _unknown(owner: str, known: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.map_keys(F.expr(f"try_cast({owner} AS MAP<STRING, VARIANT>)")), F.array(*map(F.lit, known)))) > 0


def _is_object(owner: str) -> Column:
    return F.coalesce(F.schema_of_variant(owner).startswith("OBJECT"), F.lit(False))


def _bad_text(field: _Field, allow_null: bool = False) -> Column:
    stripped = field.is_text & (field.text != "") & ~F.coalesce(field.text.rlike(rf"^{BLANK}|{BLANK}$"), F.lit(False))
    return ~field.absent & ~F.coalesce(stripped, F.lit(False)) & (~field.null if allow_null else F.lit(True))


def check_json_records(records: DataFrame) -> DataFrame:
    """F5 over JSON itself: `code` and `field` of the first rule that each `record` (a variant) breaks, NULL for good ones.

    A variant tells what a typed row cannot: fields that are absent, null, unknown, or of another
    kind, such as "7" or 12.5 for an amount. Repeated names in one object make the whole text
    unreadable. Whole numbers beyond 38 digits count as floating.
    """
    f = {name: _Field("record", name) for name in (*REQUIRED_FIELDS, *OPTIONAL_FIELDS)}
    cases = [(~_is_object("record"), "INVALID_RECORDS", None), (_unknown("record", (*REQUIRED_FIELDS, *OPTIONAL_FIELDS)), "UNKNOWN_FIELD", None)]
    for name in REQUIRED_FIELDS:
        cases += [(f[name].absent, "MISSING_FIELD", name), (f[name].null, "INVALID_FIELD", name)]
    day, amount = f["transaction_date"].text, f["amount_minor"]
    good_day = day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(day, "yyyy-MM-dd").isNotNull()
    cases += [
        (~F.coalesce(good_day, F.lit(False)), "INVALID_FIELD", "transaction_date"),
        (~amount.is_whole, "INVALID_FIELD", "amount_minor"),
        (~amount.whole.between(1, MOST_MINOR), "AMOUNT_OUT_OF_RANGE", "amount_minor"),
        (~F.coalesce(f["direction"].text.isin("income", "expense"), F.lit(False)), "INVALID_FIELD", "direction"),
    ]
    for name in OPTIONAL_FIELDS[:-1]:
        cases += [(_bad_text(f[name], name == "source_transaction_id"), "INVALID_FIELD", name), (F.char_length(f[name].text) > TEXT_LIMITS[name], "TEXT_TOO_LONG", name)]
    balance = f["balance_after_minor"]
    cases += [(~balance.absent & ~balance.is_whole, "INVALID_FIELD", balance.name), (~balance.whole.between(-MOST_MINOR, MOST_MINOR), "BALANCE_OUT_OF_RANGE", balance.name)]
    return records.withColumn("_first", _first(*cases)).withColumns({"code": F.col("_first.code"), "field": F.col("_first.field")}).drop("_first")


def check_json_envelopes(envelopes: DataFrame, version: str, source: str, max_records: int | None = None) -> DataFrame:
    """F6 over JSON itself: the first rule that each `payload` (a variant, NULL where the text is no JSON) breaks by itself."""
    v, s, r = (_Field("payload", name) for name in ENVELOPE_FIELDS)
    n = F.size(F.expr("try_cast(variant_get(payload, '$.records', 'variant') AS ARRAY<VARIANT>)"))
    cases = [(~_is_object("payload"), "INVALID_PAYLOAD", None), (_unknown("payload", ENVELOPE_FIELDS), "UNKNOWN_FIELD", None)]
    cases += [(x.absent, "MISSING_FIELD", x.name) for x in (v, s, r)] + [(x.null, "INVALID_FIELD", x.name) for x in (v, s)]
    for x, known, code in ((v, version, "UNSUPPORTED_CONTRACT_VERSION"), (s, source, "UNSUPPORTED_SOURCE_SYSTEM")):
        cases += [(~x.is_text, "INVALID_FIELD", x.name), (x.text != known, code, x.name)]
    few = (n < 1) if max_records is None else ~n.between(1, max_records)
    cases += [(~r.is_list, "INVALID_RECORDS", "records"), (few, "RECORD_COUNT_OUT_OF_RANGE", "records")]
    return envelopes.withColumn("_first", _first(*cases)).withColumns({"code": F.col("_first.code"), "field": F.col("_first.field")}).drop("_first")


def payload_verdicts(envelopes: DataFrame, records: DataFrame) -> DataFrame:
    """file, code, field and record_index of each file: its envelope's fault, else that of its first bad record.

    Both sides have been checked; records are summed to one row a file before they meet their envelope.
    """
    first = records.filter("code IS NOT NULL").groupBy("file").agg(F.min(F.struct("position", "code", "field")).alias("r"))
    own = F.col("code").isNull() & F.col("r").isNotNull()
    return envelopes.join(first, "file", "left").select(
        "file", F.when(own, F.col("r.code")).otherwise(F.col("code")).alias("code"), F.when(own, F.col("r.field")).otherwise(F.col("field")).alias("field"), F.when(own, F.col("r.position")).alias("record_index"),
    )


def typed_records(records: DataFrame) -> DataFrame:
    """Records without fault as columns; the field that holds the variant goes."""
    texts = [n for n in (*REQUIRED_FIELDS, *OPTIONAL_FIELDS) if not n.endswith("_minor")]
    values = {n: F.variant_get("record", f"$.{n}", "string") for n in texts} | {n: F.variant_get("record", f"$.{n}", "long") for n in ("amount_minor", "balance_after_minor")}
    return records.filter("code IS NULL").withColumns(values).withColumn("transaction_date", F.to_date("transaction_date")).drop("record", "code", "field")


def _errors(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))
    return df.withColumn("errors", found)


def check_accounts(accounts: DataFrame, types=ACCOUNT_TYPES) -> DataFrame:
    """names of the rules that account master rows break."""
    c = F.col
    scaled = c("opening_balance").cast("decimal(38,8)") * 100
    return _errors(accounts, [
        ("name", F.char_length(F.trim("account_name")).between(2, 120)),
        ("type", c("account_type").isin(*types)),
        ("currency", c("currency").rlike(CURRENCY)),
        ("identifier", c("account_identifier").isNull() | (F.char_length("account_identifier") <= 100)),
        ("balance", c("opening_balance").isNull() | ((scaled == F.floor(scaled)) & (F.abs(scaled) <= 10**15))),
    ])


def check_businesses(businesses: DataFrame) -> DataFrame:
    """Names of the rules that business master rows break."""
    c = F.col
    return _errors(businesses, [
        ("name", F.char_length(F.trim("business_name")).between(2, 150)),
        ("legal_id", c("legal_id").isNull() | (F.char_length("legal_id") <= 100)),
        ("email", c("email").isNull() | c("email").rlike(EMAIL)),
        ("phone", c("phone").isNull() | c("phone").rlike(PHONE)),
    ])
