"""Identities, duplicates and batch state: D1-D8, J7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_amount, normalize_text
from ..sources.sinks import kept

VERSION = "v1"
SCOPE = ("business_id", "account_id", "source_system")
#: Depth of a parent that is not there; sums with it stay negative.
LOST = -(1 << 62)
COMPONENTS = ("currency", "transaction_date", "amount_minor", "direction")


def _json_text(value: Column) -> Column:
    """A text as JSON, from Spark's own writer without the object around it.

    Control characters are written with capital hexadecimal digits there; they are lowered here,
    unless the backslash before them is itself escaped.
    """
    whole = F.to_json(F.struct(value.alias("a")))
    plain = F.substring(whole, F.lit(6), F.char_length(whole) - 6)
    lowered = plain
    for digit in "ABCDEF":
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}", f"$1{digit.lower()}")
    return F.when(value.rlike(r"[\x00-\x1f]"), lowered).otherwise(plain)


def identity_hash(account_id: Column, source_system: Column, currency: Column, transaction_date: Column, amount_minor: Column, direction: Column, version: Column | None = None) -> Column:
    """SHA-256 of the compact JSON array of the identity's parts; NULL where one is missing, empty or not positive."""
    version = F.lit(VERSION) if version is None else version
    day = F.date_format(transaction_date, "yyyy-MM-dd")
    texts = [version, account_id, source_system, currency, day, direction]
    filled = amount_minor > 0
    for text in texts:
        filled = filled & (text != "")
    parts = [*map(_json_text, texts[:-1]), amount_minor.cast("string"), _json_text(direction)]
    # A missing part leaves the comparison, and so the hash, NULL.
    return F.when(filled, F.sha2(F.concat(F.lit("["), F.array_join(F.array(*parts), ","), F.lit("]")), 256))


def ledger_hash(business_id: Column, entity_id: Column, transaction_date: Column, amount: Column, transaction_type: Column, category: Column, payment_mode: Column, description: Column, user_id: Column) -> Column:
    """SHA-256 of the nine normalised fields joined by bars; missing ones are empty."""
    texts = [business_id, entity_id, transaction_date.cast("string"), normalize_amount(amount), transaction_type, category, payment_mode, description, user_id]
    return F.sha2(F.array_join(F.array(*[normalize_text(t) for t in texts]), "|"), 256)


def with_hash(batch: DataFrame) -> DataFrame:
    return batch.withColumn("canonical_identity_hash", identity_hash(*[F.col(c) for c in ("account_id", "source_system", *COMPONENTS)]))


def classify(batch: DataFrame, identities: DataFrame) -> DataFrame:
    """Each row against the stored identities of its own account: outcome and matching identity.

    A source id that is already stored decides before the hash does. The state is cut to the
    batch's accounts first, and never by date, since a conflict may carry another date. A row
    without an identity (no hash) is `INVALID_IDENTITY`, which fails its batch as a conflict does.
    """
    keys = list(SCOPE)
    state = identities.join(batch.select(*keys).distinct(), keys, "left_semi")
    by_source = state.filter(F.col("source_transaction_id").isNotNull()).select(
        *keys, "source_transaction_id", F.col("identity_id").alias("_s_id"), F.struct(*COMPONENTS).alias("_s")
    )
    by_hash = state.select(*keys, "canonical_identity_hash", F.col("identity_id").alias("_h_id"), F.struct(*COMPONENTS).alias("_h"))
    own = F.struct(*COMPONENTS)
    found = batch.join(by_source, [*keys, "source_transaction_id"], "left").join(by_hash, [*keys, "canonical_identity_hash"], "left")
    outcome = (
        F.when(F.col("canonical_identity_hash").isNull(), "INVALID_IDENTITY")
        .when(F.col("_s_id").isNotNull(), F.when(F.col("_s") == own, "DUPLICATE_SOURCE_ID").otherwise("SOURCE_IDENTITY_CONFLICT"))
        .when(F.col("_h_id").isNull(), "UNIQUE")
        .when(F.col("_h") == own, "DUPLICATE_CANONICAL_IDENTITY")
        .otherwise("CANONICAL_IDENTITY_CONFLICT")
    )
    return found.select(*batch.columns, outcome.alias("outcome"), F.coalesce("_s_id", "_h_id").alias("existing_identity_id"))


#: What `with_repeats` adds.
REPEATS = ("_clash", "_nth_source", "_nth_hash")


def with_repeats(batch: DataFrame, batch_id: str = "batch_id", position: str = "position") -> DataFrame:
    """Places of each row among those of its batch with its source id or its hash, which no outcome changes.

    Windows are over one source id or one hash; rows without source id take no part in the
    first, so they form no group.
    """
    with_id, without = batch.filter("source_transaction_id IS NOT NULL"), batch.filter("source_transaction_id IS NULL")
    by_source = Window.partitionBy(batch_id, "source_transaction_id")
    hashes = F.min("canonical_identity_hash").over(by_source) != F.max("canonical_identity_hash").over(by_source)
    nth = F.row_number().over(by_source.orderBy(position))
    seen = with_id.withColumns({"_clash": hashes, "_nth_source": nth}).unionByName(without.withColumns({"_clash": F.lit(False), "_nth_source": F.lit(1)}))
    # Rows without a hash are no copies of one another.
    known = F.coalesce("canonical_identity_hash", F.concat(F.lit("at "), F.col(position).cast("string")))
    return seen.withColumn("_nth_hash", F.row_number().over(Window.partitionBy(batch_id, known).orderBy(position)))


def outcome_within() -> Column:
    """The outcome of a row with `REPEATS`. The same source id with another hash is a conflict."""
    return (
        F.when(F.col("outcome") == "INVALID_IDENTITY", F.col("outcome"))
        .when(F.col("_clash") & (F.col("_nth_source") > 1), "SOURCE_IDENTITY_CONFLICT")
        .when(F.col("outcome") != "UNIQUE", F.col("outcome"))
        .when(F.col("_nth_source") > 1, "DUPLICATE_SOURCE_ID")
        .when(F.col("_nth_hash") > 1, "DUPLICATE_CANONICAL_IDENTITY")
        .otherwise("UNIQUE")
    )


def classify_within(batch: DataFrame, batch_id: str = "batch_id", position: str = "position") -> DataFrame:
    """Later rows of a batch against its earlier ones; only `UNIQUE` rows change."""
    return with_repeats(batch, batch_id, position).withColumn("outcome", outcome_within()).drop(*REPEATS)


def batch_verdict(batch: DataFrame, batch_id: str = "batch_id") -> DataFrame:
    """One conflict fails the whole batch; otherwise what it inserts and what it repeats."""
    conflict = F.bool_or(F.col("outcome").endswith("CONFLICT") | (F.col("outcome") == "INVALID_IDENTITY"))
    sums = batch.groupBy(batch_id).agg(
        F.count("*").alias("record_count"), F.count_if(F.col("outcome") == "UNIQUE").alias("_unique"), F.count_if(F.col("outcome").startswith("DUPLICATE")).alias("_repeats"), conflict.alias("_conflict")
    )
    none = F.lit(0).cast("long")
    return sums.select(
        batch_id, "record_count",
        F.when(F.col("_conflict"), none).otherwise(F.col("_unique")).alias("inserted_count"),
        F.when(F.col("_conflict"), none).otherwise(F.col("_repeats")).alias("duplicate_count"),
        none.alias("rejected_count"),
        F.when(F.col("_conflict"), "failed").otherwise("completed").alias("status"),
        F.when(F.col("_conflict"), "IDENTITY_CONFLICT").alias("code"),
    )


def flag_repeats(ledger: DataFrame) -> DataFrame:
    """Rows of a legacy ledger that repeat an earlier one; they stay."""
    group = Window.partitionBy("transaction_hash", "business_id", "user_id").orderBy("created_at", "transaction_id")
    return ledger.withColumn("duplicate", F.row_number().over(group) > 1)


def retry_depth(attempts: DataFrame) -> DataFrame:
    """Number of ancestors of each attempt; a missing parent or a cycle gives a code instead.

    Ancestors are found by doubling: after k joins every attempt knows its 2**k-th ancestor,
    so a chain of n needs log2(n) joins. They end when no attempt has an ancestor left, or when
    2**k passes the number of attempts: what then has one is in a cycle or leads to one.
    """
    nodes = attempts.select("attempt_id", F.col("parent_attempt_id").alias("up"), F.when(F.col("parent_attempt_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    lost = nodes.select(F.col("up").alias("attempt_id")).filter("attempt_id IS NOT NULL").distinct().join(nodes.select("attempt_id"), "attempt_id", "left_anti")
    # A parent that does not exist is a chain's end of its own kind.
    table = kept(nodes.unionByName(lost.select("attempt_id", F.lit(None).cast(nodes.schema["up"].dataType).alias("up"), F.lit(LOST).alias("depth"))))
    # Attempts whose chain has ended take no further part on the asking side of a join.
    ended, open_ = table.filter("up IS NULL"), table.filter("up IS NOT NULL")
    done, most, steps, left = [ended], table.count(), 1, open_.count()
    while left and steps <= most:
        asked = kept(open_.join(_ancestors(done, open_), "up").select("attempt_id", F.col("_next").alias("up"), (F.col("depth") + F.col("_more")).alias("depth")))
        done.append(asked.filter("up IS NULL"))
        open_ = asked.filter("up IS NOT NULL")
        left = open_.count()
        steps *= 2
    code = F.when(F.col("depth") < 0, "PARENT_MISSING").when(F.col("up").isNotNull(), "CYCLE")
    whole = open_
    for part in done:
        whole = whole.unionByName(part)
    own = whole.join(attempts.select("attempt_id"), "attempt_id", "left_semi")
    return own.select("attempt_id", F.when(code.isNull(), F.col("depth")).cast("long").alias("retry_count"), code.alias("code"))


def _ancestors(done: list[DataFrame], open_: DataFrame) -> DataFrame:
    """What is known of every attempt so far, keyed for those that ask for their ancestor."""
    whole = open_
    for part in done:
        whole = whole.unionByName(part)
    return whole.select(F.col("attempt_id").alias("up"), F.col("up").alias("_next"), F.col("depth").alias("_more"))


def attempt_status(events: DataFrame) -> DataFrame:
    """The state of each attempt: its first terminal event, else `processing`."""
    terminal = F.col("status").isin("completed", "failed")
    first = F.min_by(F.when(terminal, F.col("status")), F.when(terminal, F.struct("event_time", "status")))
    return events.groupBy("attempt_id").agg(F.coalesce(first, F.lit("processing")).alias("status"))
