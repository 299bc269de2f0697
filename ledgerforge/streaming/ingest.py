"""Batches arriving over time: D9, as a file stream over the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contract import check_records
from ..operators.identity import batch_verdict, with_hash
from ..operators.sequence import classify_sequence
from ..sources.sinks import append, identities_met_by, kept, let_go


def attempt_of(run: str):
    """The attempt of a batch in one run: a run that is repeated after a crash makes a new one."""
    return F.concat(F.lit("att_"), F.col("batch_id").cast("string"), F.lit(f"_{run}" if run else ""))


def ingest(batch: DataFrame, identities: DataFrame, run: str = "", order: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """(rows to insert, verdict of each batch): contract, identity, stored state, earlier batches, the batch itself.

    Several batches are judged as if they came one after another in the order of the column
    `order`. A record that breaks the contract fails its batch, as a conflict does, and a failed
    batch leaves nothing that later ones could repeat. Identifiers come from the identity hash, so
    a repeated run gives the same rows.
    """
    checked = check_records(batch.withColumn("transaction_date", F.date_format("transaction_date", "yyyy-MM-dd")))
    # Stored, as Spark then knows how small it is and leaves the rows where they are.
    broken = kept(checked.filter("code IS NOT NULL").select("batch_id").distinct())
    hashed = batch.join(broken, "batch_id", "left_anti")
    hashed = hashed if "canonical_identity_hash" in batch.columns else with_hash(hashed)
    # Both results come from one table, so that the second is judged as the first.
    judged = kept(classify_sequence(hashed, identities, order))
    verdicts = batch_verdict(judged)
    good = verdicts.filter(F.col("status") == "completed").select("batch_id")
    new = judged.filter(F.col("outcome") == "UNIQUE").join(good, "batch_id", "left_semi")
    new = new.withColumns({"attempt_id": attempt_of(run), "transaction_id": F.concat(F.lit("txn_"), F.col("canonical_identity_hash")), "identity_id": F.concat(F.lit("idn_"), F.col("canonical_identity_hash"))})
    zero = F.lit(0).cast("long")
    failed = batch.join(broken, "batch_id", "left_semi").groupBy("batch_id").agg(F.count("*").alias("record_count"))
    refused = failed.select("batch_id", "record_count", zero.alias("inserted_count"), zero.alias("duplicate_count"), zero.alias("rejected_count"), F.lit("failed").alias("status"), F.lit("VALIDATION_FAILED").alias("code"))
    return new, verdicts.unionByName(refused)


def ingest_stream(spark: SparkSession, in_dir: str, out_dir: str, schema: str, checkpoint: str, files_a_trigger: int | None = None) -> StreamingQuery:
    """Watch a folder of Parquet batches and append what is new to the tables in `out_dir`.

    Batches of one trigger follow by the time at which their first file was written and by its
    path. The stored identities are the state: no watermark is needed, and copies are found however
    late they come. They lie in folders by account, and a trigger reads those that its accounts are in. A replayed batch finds its own rows stored and inserts nothing; one that
    failed before its attempts were written left rows of an attempt that is never completed,
    which no reader sees, and inserts them under a new one.
    """
    reader = spark.readStream.schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)

    def run(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        batch = kept(with_hash(batch))
        try:
            identities = kept(identities_met_by(batch, out_dir))
        except Exception as missing:  # the first batch finds no tables yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            fields = "identity_id string, business_id string, account_id string, source_system string, source_transaction_id string, currency string, transaction_date date, amount_minor long, direction string, canonical_identity_hash string"
            identities = session.createDataFrame([], fields)
        name = uuid.uuid4().hex
        first = kept(batch.groupBy("batch_id").agg(F.min(F.struct("_written", "_path")).alias("upload")))
        new, verdicts = ingest(batch.drop("_written", "_path").join(first, "batch_id"), identities, name, "upload")
        attempts = verdicts.withColumns({"attempt_id": attempt_of(name), "epoch": F.lit(epoch)})
        append(new, kept(attempts), out_dir)
        let_go(session, batch)

    files = reader.parquet(in_dir).select("*", F.col("_metadata.file_modification_time").alias("_written"), F.col("_metadata.file_path").alias("_path"))
    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
