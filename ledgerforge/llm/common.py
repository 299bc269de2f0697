"""Shared helpers of the text operators: inputs, scratch tables, checked broadcasts."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

#: A side with at most so many rows of three longs (24 MB) may be broadcast after it was counted.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that `with_text_column` has as strings at a time, and bytes that a Python task gets
#: at a time; a longer text is on its own.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of `docs`; a null text counts as empty, further columns are left out."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def with_text_column(docs: DataFrame, make, kind: pa.DataType, name: str) -> DataFrame:
    """`docs` plus a column that `make(list of texts)` gives in tasks; a null text counts as empty.

    All columns stay as they are and nothing is joined or shuffled, so rows may repeat and
    identifiers may be missing. Texts are made strings, and rows handed on, a slice at a time.
    The session's limit on bytes of a batch is set to `BATCH_BYTES` unless it has one: ten thousand
    rows of text take far more, on both sides.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if docs.sparkSession.conf.get(limit, None) is None:
        docs.sparkSession.conf.set(limit, BATCH_BYTES)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, from_arrow_type(kind))])
    at = docs.columns.index("text")

    def add(batches):
        for batch in slices(batches, at, SLICE_BYTES):
            made = make([text or "" for text in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, schema)


def slices(batches, column: str | int, most: int):
    """The batches cut into runs of rows with about `most` bytes of text; at least one row each."""
    for batch in batches:
        size = batch.column(column).nbytes
        rows = max(1, batch.num_rows * most // max(1, size))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def scratch_uri(spark: SparkSession) -> str:
    """A new folder URI below the session's shared checkpoint folder.

    `spark.checkpoint.dir` names the shared folder on a cluster. Only a session
    without it (tests on one machine) gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "ledgerforge-scratch")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and not root.startswith("file:"):
        # A bare path belongs to the cluster's default file system.
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        root = "file://" + os.path.abspath(root) if default.startswith("file:") else default.rstrip("/") + "/" + root.lstrip("/")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_uri(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_one_task(sample: DataFrame, make):
    """`make(rows)` of a bounded sample, computed in a task: rows are dictionaries, and the driver gets the result alone.

    The sample's bound is its caller's; what fitting takes besides is then an executor's memory.
    """

    def run(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(rows))], pa.binary())], names=["made"])

    found = sample.mapInArrow(run, "made binary").first()
    # A sample that is known to be empty has no task.
    return pickle.loads(found["made"]) if found else make(iter(()))


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint when its counted `rows` are few; a shuffle join otherwise."""
    return F.broadcast(df) if rows <= most else df


def unused(name: str, df: DataFrame) -> str:
    """`name`, with as many underscores before it as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
