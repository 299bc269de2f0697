"""Appending batches so that readers see whole ones only: S8."""

from __future__ import annotations

import os
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACCOUNT = ("business_id", "account_id", "source_system")
LEDGER = ("transaction_id", "business_id", "account_id", "transaction_date", "amount_minor", "direction", "currency", "category", "payment_mode", "attempt_id")
IDENTITY = ("identity_id", "transaction_id", "attempt_id", "business_id", "account_id", "source_system", "source_transaction_id", "currency", "transaction_date", "amount_minor", "direction", "canonical_identity_hash")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that `spark.checkpoint.dir` names; only a local session may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "ledgerforge-stored")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there, and lost executors take nothing with them.

    Nothing reads the shuffle files of the write again, so Spark is told to remove them at its end.
    Otherwise they stay until the driver's collector finds that nothing refers to them.
    """
    path, conf = scratch_folder(df.sparkSession), df.sparkSession.conf
    before = conf.get(REMOVES_SHUFFLES, None)
    conf.set(REMOVES_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(REMOVES_SHUFFLES) if before is None else conf.set(REMOVES_SHUFFLES, before)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.kept_at = path
    return stored


def let_go(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete `tables`, which `kept` gave and nothing reads any more."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of the identity table. An account's identities are in one of them.
BUCKETS = 64
#: Batches up to this many rows (some 100 MB of keys) are broadcast to the identities they may meet.
FEW_ROWS = 500_000


def bucket_of() -> Column:
    """The folder of a row's account, for rows with the columns of `ACCOUNT`."""
    return F.pmod(F.xxhash64(*ACCOUNT), F.lit(BUCKETS)).cast("int")


def append(accepted: DataFrame, attempts: DataFrame, folder: str) -> None:
    """Write ledger and identity rows first and the attempts' rows last: these are the commit mark."""
    accepted.select(*[c for c in LEDGER if c in accepted.columns]).write.mode("append").parquet(f"{folder}/ledger")
    identities = accepted.select(*[c for c in IDENTITY if c in accepted.columns]).withColumn("bucket", bucket_of())
    identities.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{folder}/identities")
    attempts.write.mode("append").parquet(f"{folder}/attempts")


def identities_met_by(batch: DataFrame, folder: str) -> DataFrame:
    """Committed identities with the account and either the source id or the hash of some row of `batch`.

    Only folders of accounts in the batch are read (their numbers, at most `BUCKETS`, are the
    driver's). A batch that a count shows to be small is broadcast, so that stored rows are not
    shuffled; the commit mark is looked up for those that match.
    """
    spark = batch.sparkSession
    hit = [r["bucket"] for r in batch.select(bucket_of().alias("bucket")).distinct().collect()]
    stored = spark.read.parquet(f"{folder}/identities").filter(F.col("bucket").isin(hit)).drop("bucket")
    few = batch.count() <= FEW_ROWS
    found = None
    for key in ("source_transaction_id", "canonical_identity_hash"):
        keys = batch.select(*ACCOUNT, key).filter(F.col(key).isNotNull()).distinct()
        met = stored.join(F.broadcast(keys) if few else keys, [*ACCOUNT, key], "left_semi")
        found = met if found is None else found.unionByName(met)
    return _of_completed(found.dropDuplicates(["attempt_id", "identity_id"]), folder)


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of completed attempts only; what a broken run left behind is not seen."""
    return _of_completed(spark.read.parquet(f"{folder}/{name}"), folder)


def abandoned_files(spark: SparkSession, folder: str, name: str, before: datetime) -> DataFrame:
    """(path, rows, written) of the files of a table that were written before `before` and hold no row of a completed attempt.

    A run writes files of its own, so a file belongs to committed attempts or to a broken run;
    one that holds both is kept whole. Only the attempts' names are read, and they are counted
    for each file before anything is shuffled. An empty file holds nothing and is not listed.
    """
    done = spark.read.parquet(f"{folder}/attempts").filter(F.col("status") == "completed").select("attempt_id", F.lit(True).alias("done")).distinct()
    rows = spark.read.parquet(f"{folder}/{name}").select("attempt_id", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("written"))
    held = rows.groupBy("path", "written", "attempt_id").agg(F.count("*").alias("n")).join(done, "attempt_id", "left")
    files = held.groupBy("path", "written").agg(F.sum("n").alias("rows"), F.max("done").alias("done"))
    return files.filter(F.col("done").isNull() & (F.col("written") < F.lit(before))).select("path", "rows", "written")


def vacuum(spark: SparkSession, folder: str, before: datetime) -> DataFrame:
    """Delete what broken runs left in the ledger and the identities; returns (table, path, rows, written) of the deleted files.

    `before` is the start of the oldest run that may still be writing: files of that time or later
    stay, as their attempts may yet be completed. Committed rows are never touched. The list is
    stored before the first file goes, so a vacuum that breaks off is simply run again; the
    driver walks through it a part at a time.
    """
    found = None
    for name in ("ledger", "identities"):
        files = abandoned_files(spark, folder, name, before).select(F.lit(name).alias("table"), "path", "rows", "written")
        found = files if found is None else found.unionByName(files)
    listed = kept(found)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in listed.select("path").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["path"]))
        path.getFileSystem(conf).delete(path, False)
    return listed


def _of_completed(rows: DataFrame, folder: str) -> DataFrame:
    done = rows.sparkSession.read.parquet(f"{folder}/attempts").filter(F.col("status") == "completed").select("attempt_id").distinct()
    return rows.join(done, "attempt_id", "left_semi")
