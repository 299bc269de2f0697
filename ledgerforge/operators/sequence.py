"""Batches that arrive together, judged one after another: D9's order of uploads.

What a batch inserts decides what later batches repeat or contradict, and a batch that fails
inserts nothing. Only rows that share a source id or an identity with another batch can matter
there. For those a fixpoint is computed in rounds: a row is inserted when its batch completes and
no earlier inserted row holds its source id or identity; a batch fails when an earlier inserted row
holds one of its source ids with another identity. Every round decides whatever hangs on decided
rows only, the earliest open batch at least, so the rounds end; most triggers need two or three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept, let_go
from .identity import SCOPE, classify, outcome_within, with_repeats

HASH = "canonical_identity_hash"


def _shared(rows: DataFrame) -> DataFrame:
    """One row for each (batch, source id, identity) that another batch may meet, with its first position."""
    one = rows.groupBy(*SCOPE, "batch_id", "order", F.col("source_transaction_id").alias("source"), HASH).agg(F.min("position").alias("position"), F.bool_or(F.col("outcome") == "UNIQUE").alias("fresh"))
    # Rows without source id stand alone there, so that they form no group.
    one = one.withColumn("own", F.when(F.col("source").isNull(), F.struct("batch_id", HASH)))
    by_source, by_hash = Window.partitionBy(*SCOPE, "source", "own"), Window.partitionBy(*SCOPE, HASH)
    met = lambda w: F.min("order").over(w) != F.max("order").over(w)
    leads = F.row_number().over(Window.partitionBy(*SCOPE, HASH, "batch_id").orderBy("position")) == 1
    return one.withColumns({"met": met(by_source) | met(by_hash), "leads": leads & F.col("fresh")}).filter("met").drop("met", "fresh")


def _round(state: DataFrame) -> DataFrame:
    """`state` (claims with `put` and `done`, NULL while open) one step further."""
    before = (Window.unboundedPreceding, -1)
    by_source = Window.partitionBy(*SCOPE, "source", "own").orderBy("order", "position").rowsBetween(*before)
    by_hash = Window.partitionBy(*SCOPE, HASH).orderBy("order", "position").rowsBetween(*before)
    # Failed batches and rows that cannot be inserted leave the question at once.
    put = F.coalesce(F.col("put"), F.when(~F.col("leads") | (F.col("done") == F.lit(False)), F.lit(False)))
    s = state.withColumn("put", put)
    s = s.withColumns({
        "holder": F.first(F.when(F.col("put"), F.col(HASH)), ignorenulls=True).over(by_source),
        "open_low": F.min(F.when(F.col("put").isNull(), F.col(HASH))).over(by_source),
        "open_high": F.max(F.when(F.col("put").isNull(), F.col(HASH))).over(by_source),
        "held": F.coalesce(F.bool_or(F.col("put")).over(by_hash), F.lit(False)),
        "open_hash": F.count_if(F.col("put").isNull()).over(by_hash) > 0,
    })
    clash = F.when(F.col("holder").isNotNull(), F.col("holder") != F.col(HASH)).when((F.col("open_low") != F.col(HASH)) | (F.col("open_high") != F.col(HASH)), F.lit(None)).otherwise(F.lit(False))
    s = s.withColumn("clash", clash)
    # A batch may be large, so its rows are summed before they meet.
    verdicts = s.groupBy("batch_id").agg(F.bool_or("clash").alias("failed"), (F.count_if(F.col("clash").isNull()) > 0).alias("unsure"))
    s = s.join(verdicts, "batch_id")
    done = F.coalesce(F.col("done"), F.when(F.col("failed"), F.lit(False)).when(~F.col("unsure"), F.lit(True)))
    s = s.withColumn("done", done)
    settled = (
        F.when(F.col("put").isNotNull(), F.col("put"))
        .when(F.col("holder").isNotNull() | F.col("held") | ~F.col("done"), F.lit(False))
        .when(F.col("open_low").isNotNull() | F.col("open_hash"), F.lit(None))
        .when(F.col("done"), F.lit(True))
    )
    return s.select(*SCOPE, "batch_id", "order", "source", "own", HASH, "position", "leads", settled.alias("put"), "done")


def settle(rows: DataFrame) -> DataFrame:
    """The claims that are inserted: scope, source, identity and order of those that other batches may meet.

    `rows` have been classified against the stored state; batches that fail by themselves are left out.
    """
    state = _shared(rows.filter(F.col("outcome").isin("UNIQUE", "DUPLICATE_CANONICAL_IDENTITY")))
    none = F.lit(None).cast("boolean")
    state, open_ = kept(state.withColumns({"put": none, "done": none})), 1
    while open_:
        last, state = state, kept(_round(state))
        let_go(rows.sparkSession, last)
        open_ = state.filter("put IS NULL OR done IS NULL").count()
    return state.filter("put")


def classify_sequence(batch: DataFrame, identities: DataFrame, order: str = "batch_id") -> DataFrame:
    """D3, D4 and D9 over several batches: outcome of every row as if batch came after batch.

    Rows are stored with their outcome against the stored state and then with their places in their
    batch, so that disk holds the shuffles of one step.
    `order` names a column, equal within a batch, by which batches follow one another; equal ones
    follow by `batch_id`. Stored rows and rows that earlier batches insert are one state.
    """
    columns = batch.columns
    alone = kept(classify(batch.withColumn("order", F.struct(F.col(order).alias("by"), F.col("batch_id").alias("id"))), identities))
    judged = kept(with_repeats(alone))
    let_go(batch.sparkSession, alone)
    alone = judged.withColumn("outcome", outcome_within())
    bad = alone.filter(F.col("outcome").endswith("CONFLICT") | (F.col("outcome") == "INVALID_IDENTITY")).select("batch_id").distinct()
    put = settle(judged.join(bad, "batch_id", "left_anti"))
    by_source = put.filter("source IS NOT NULL").select(*SCOPE, F.col("source").alias("source_transaction_id"), F.col(HASH).alias("_held"), F.col("order").alias("_s_order"))
    by_hash = put.select(*SCOPE, HASH, F.col("order").alias("_h_order"))
    met = judged.join(by_source, [*SCOPE, "source_transaction_id"], "left").join(by_hash, [*SCOPE, HASH], "left")
    known = F.col("_s_order") < F.col("order")
    outcome = (
        F.when(F.col("outcome") == "INVALID_IDENTITY", F.col("outcome"))
        .when(known, F.when(F.col("_held") == F.col(HASH), "DUPLICATE_SOURCE_ID").otherwise("SOURCE_IDENTITY_CONFLICT"))
        .when((F.col("outcome") == "UNIQUE") & (F.col("_h_order") < F.col("order")), "DUPLICATE_CANONICAL_IDENTITY")
        .otherwise(F.col("outcome"))
    )
    given = F.when(known | (F.col("_h_order") < F.col("order")), F.concat(F.lit("idn_"), F.when(known, F.col("_held")).otherwise(F.col(HASH))))
    met = met.withColumns({"outcome": outcome, "existing_identity_id": F.coalesce("existing_identity_id", given)})
    return met.select(*columns, "existing_identity_id", outcome_within().alias("outcome")).select(*columns, "outcome", "existing_identity_id")
