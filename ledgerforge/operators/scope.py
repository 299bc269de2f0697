"""Which rows take part: dates, accounts, access, status, currency, and the joins behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("business_id", "account_id")


def scope(tx: DataFrame, start=None, end=None, businesses=None, accounts=None) -> DataFrame:
    """rows within the inclusive dates and the named businesses and accounts (None: all)."""
    if start is not None and end is not None and start > end:
        raise ValueError("start must not be after end")
    if start is not None:
        tx = tx.filter(F.col("transaction_date") >= F.lit(start).cast("date"))
    if end is not None:
        tx = tx.filter(F.col("transaction_date") <= F.lit(end).cast("date"))
    if businesses is not None:
        tx = tx.filter(F.col("business_id").isin(*businesses))
    if accounts is not None:
        tx = tx.filter(F.col("account_id").isin(*accounts))
    return tx


def accepted(identities: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows that have an accepted identity; amounts, dates and directions are the identity's."""
    own = ["transaction_id", "business_id", "account_id", "transaction_date", "amount_minor", "direction", "currency"]
    extra = [c for c in ("category", "payment_mode", "source_transaction_id") if c in ledger.columns]
    return identities.select(*own).join(ledger.select("transaction_id", *extra), "transaction_id")


def currency_guard(tx: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of accounts all of whose rows carry the account's currency, the other accounts with a count)."""
    own = accounts.select(*KEYS, F.col("currency").alias("account_currency"))
    wrong = (
        tx.join(own, list(KEYS))
        .groupBy(*KEYS)
        .agg(F.count_if(~F.col("currency").eqNullSafe(F.col("account_currency"))).alias("wrong_rows"))
        .filter("wrong_rows > 0")
    )
    return tx.join(wrong, list(KEYS), "left_anti"), wrong


def active(df: DataFrame, kind: str) -> DataFrame:
    """active rows. A bridge must also be verified, by someone other than its proposer."""
    kept = df.filter(F.col("status") == "active")
    if kind == "bridge":
        checked = F.col("verified_by").isNotNull() & F.col("verified_at").isNotNull()
        kept = kept.filter(checked & (F.col("verified_by") != F.col("proposed_by")))
    return kept


def visible_to(df: DataFrame, memberships: DataFrame, user_id: str, roles=("owner", "manager")) -> DataFrame:
    """F8: rows of businesses where the user is an active member in one of the roles."""
    mine = memberships.filter((F.col("user_id") == user_id) & (F.col("status") == "active") & F.col("role").isin(*roles))
    return df.join(mine.select("business_id"), "business_id", "left_semi")


def newest_first(transactions: DataFrame) -> DataFrame:
    """O1: latest date first; of one date the latest number first. A range-partitioned sort."""
    return transactions.orderBy(F.col("transaction_date").desc(), F.col("number").desc())


def by_name(rows: DataFrame, *names: str) -> DataFrame:
    """Rows in the order of a name, such as businesses, accounts, members, budgets or chunks."""
    return rows.orderBy(*names)


def user_businesses(memberships: DataFrame, businesses: DataFrame) -> DataFrame:
    """Active memberships with their active businesses."""
    return active(memberships, "membership").join(active(businesses, "business").drop("status"), "business_id")


def members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Memberships with the user's name."""
    return memberships.join(users.select("user_id", "user_name"), "user_id")


def active_sessions(sessions: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Sessions neither revoked nor expired at a time, with their users."""
    open_at = F.col("revoked_at").isNull() & (F.col("expires_at") > F.lit(as_of).cast("timestamp"))
    return sessions.filter(open_at).join(users, "user_id")


def provider_users(identities: DataFrame, users: DataFrame) -> DataFrame:
    """Identities at outside providers with their users."""
    return identities.join(users, "user_id")


def resolve_bridge(businesses: DataFrame, bridges: DataFrame, registry: DataFrame) -> DataFrame:
    """Each business with its registry entry and owner, or the code of the step that failed."""
    live = active(bridges, "bridge").select("business_id", "registry_business_id")
    owners = registry.select("registry_business_id", "owner_id")
    found = businesses.join(live, "business_id", "left").join(owners, "registry_business_id", "left")
    code = (
        F.when(F.col("status") != "active", "BUSINESS_INACTIVE")
        .when(F.col("registry_business_id").isNull(), "BRIDGE_MISSING")
        .when(F.col("owner_id").isNull(), "REGISTRY_MISSING")
    )
    return found.select("business_id", "registry_business_id", "owner_id", code.alias("code"))


def foreign_counterparties(transactions: DataFrame, counterparties: DataFrame) -> DataFrame:
    """Transactions whose counterparty does not belong to their business."""
    named = transactions.filter(F.col("entity_id").isNotNull())
    return named.join(counterparties.select("entity_id", "business_id"), ["entity_id", "business_id"], "left_anti")
