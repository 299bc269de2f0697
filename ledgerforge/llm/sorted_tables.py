"""Operator 6: token ids in sorted-string-table shards.

A shard holds the documents of one range of identifiers, in ascending order:

    block*  index  filter  footer

* A block holds entries `shared u8, rest u8, length u32, key rest, value`; keys are stored
  without the prefix they share with the key before, except at every `RESTART`-th entry,
  whose offset is listed at the end of the block (`offset u32 *, count u32`). Blocks are
  compressed one by one and carry a checksum.
* The sparse index has one row for each block: its last key, offset, stored size, entries.
* The Bloom filter answers for absent identifiers without reading a block.
* The footer says where index and filter are, and counts documents and ids.

A key is the identifier as 8 big-endian bytes with the sign bit flipped, so that bytes sort
as numbers do, and 4 bytes that count rows of the same identifier. A value is the document's
ids, 2 bytes each where the vocabulary allows it.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_uri, shuffle_partitions, slices, stored, texts
from .tokenizing import BLOCK_CHARS, ByteEncoder, of_worker

MAGIC = b"LFSSTAB1"
BLOCK_BYTES = 64 * 1024
RESTART = 16
BITS_PER_KEY = 10
PROBES = 7
#: index offset, index size, filter offset, filter size, documents, ids, bytes of an id, magic
FOOTER = struct.Struct("<QQQQQQB8s")
ENTRY = struct.Struct("<BBI")
INDEX_ROW = struct.Struct("<12sQIII")
SIGN = 1 << 63


def key_of(doc_id: int, ordinal: int = 0) -> bytes:
    return struct.pack(">QI", (doc_id + SIGN) & (2 * SIGN - 1), ordinal)


def id_of(key: bytes) -> int:
    return struct.unpack(">QI", key)[0] - SIGN


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(keys: list[bytes], size: int) -> np.ndarray:
        base = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        step = (base >> np.uint64(33)) | np.uint64(1)
        return (base[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)

    @classmethod
    def build(cls, keys: list[bytes]) -> "Bloom":
        size = max(64, (len(keys) * BITS_PER_KEY + 7) // 8 * 8)
        flags = np.zeros(size, np.uint8)
        if keys:
            flags[cls._places(keys, size).ravel()] = 1
        return cls(np.packbits(flags))

    def may_hold(self, key: bytes) -> bool:
        at = self._places([key], len(self.bits) * 8)[0]
        return bool(np.all((self.bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1))


class TableWriter:
    """Writes one shard to an open binary stream; entries must come in key order."""

    def __init__(self, stream, id_bytes: int):
        self.stream, self.id_bytes = stream, id_bytes
        self.at = self.docs = self.ids = 0
        self.index: list[bytes] = []
        self.blooms: list[bytes] = []
        self.previous, self.pack = b"", zstandard.ZstdCompressor(level=1)
        self._fresh()

    def _fresh(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.entries, self.restarts = 0, 0, []

    def add(self, doc_id: int, ordinal: int, ids: np.ndarray) -> None:
        key, value = key_of(doc_id, ordinal), ids.astype(f"<u{self.id_bytes}").tobytes()
        if self.docs and key <= self.previous:
            raise ValueError("entries out of order")
        shared = 0
        if self.entries % RESTART:
            while shared < 12 and key[shared] == self.previous[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        part = ENTRY.pack(shared, 12 - shared, len(value)) + key[shared:] + value
        self.parts.append(part)
        self.size += len(part)
        self.entries += 1
        self.docs += 1
        self.ids += len(ids)
        self.previous = key
        self.blooms.append(key[:8])
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.entries:
            return
        tail = struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        packed = self.pack.compress(b"".join(self.parts) + tail)
        self.stream.write(packed)
        self.index.append(INDEX_ROW.pack(self.previous, self.at, len(packed), self.entries, zlib.crc32(packed)))
        self.at += len(packed)
        self._fresh()

    def close(self) -> None:
        self._flush()
        index, bloom = b"".join(self.index), Bloom.build(list(dict.fromkeys(self.blooms))).bits.tobytes()
        footer = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, self.id_bytes, MAGIC)
        self.stream.write(index + bloom + footer)


class TableReader:
    """Binary-search lookups and ordered scans over one shard; reads one block at a time."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER.size)
        at, length, bloom_at, bloom_length, self.docs, self.ids, self.id_bytes, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted table of this format")
        file.seek(at)
        self.index = list(INDEX_ROW.iter_unpack(file.read(length)))
        self.last_keys = [row[0] for row in self.index]
        file.seek(bloom_at)
        self.bloom = Bloom(np.frombuffer(file.read(bloom_length), np.uint8))
        self.unpack = zstandard.ZstdDecompressor()

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, at, size, _, checksum = self.index[k]
        self.file.seek(at)
        packed = self.file.read(size)
        if zlib.crc32(packed) != checksum:
            raise ValueError(f"block {k} is damaged")
        raw = self.unpack.decompress(packed)
        (count,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 - 4 * count
        return raw[:end], list(struct.unpack_from(f"<{count}I", raw, end))

    def _entries(self, raw: bytes, at: int):
        key = b""
        while at < len(raw):
            shared, rest, length = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, f"<u{self.id_bytes}", length // self.id_bytes, at)
            at += length

    def scan(self):
        for k in range(len(self.index)):
            for key, ids in self._entries(self._block(k)[0], 0):
                yield id_of(key), ids

    def lookup(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every row of the identifier: filter, then index, then restart points, then a short walk."""
        low = key_of(doc_id)
        if not self.bloom.may_hold(low[:8]):
            return []
        found, k = [], bisect.bisect_left(self.last_keys, low)
        while k < len(self.index):
            raw, restarts = self._block(k)
            first = lambda at: raw[at + ENTRY.size : at + ENTRY.size + 12]  # noqa: B023, E731
            start = max(0, bisect.bisect_right(restarts, low, key=first) - 1)
            for key, ids in self._entries(raw, restarts[start]):
                if key[:8] > low[:8]:
                    return found
                if key[:8] == low[:8]:
                    found.append(ids)
            k += 1
        return found


def range_splits(docs: DataFrame, parts: int) -> list[int]:
    """Identifiers that cut `docs` into about `parts` even ranges; reads the id column only."""
    error = 1 / (8 * parts)
    cuts = docs.select("doc_id").na.drop().approxQuantile("doc_id", [k / parts for k in range(1, parts)], error) if parts > 1 else []
    return sorted({int(c) for c in cuts})


def bucket_of(column: str, splits: list[int]) -> F.Column:
    """Number of splits below the value: ranges are (split, next split]; null goes first."""
    at = F.array(*[F.lit(s).cast("long") for s in splits]) if splits else F.array().cast("array<long>")
    below = F.size(F.filter(at, lambda s: s < F.col(column)))
    return F.when(F.col(column).isNull() | (F.lit(len(splits)) == 0), F.lit(0)).otherwise(below).cast("int")


def write_tables(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encode `docs`, write the shards, and return one manifest row for each shard.

    Ranges are cut at quantiles of the identifiers, so that the one shuffle sends each
    document once. Rows without identifier cannot be keyed and are left out; rows of the
    same identifier stay together, ordered by their ids. A shard is written under a
    task's own name and then moved, so a repeated task leaves the same file.
    """
    spark = docs.sparkSession
    shards = shards or shuffle_partitions(spark)
    splits = range_splits(docs, shards)
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    shared = spark.sparkContext.broadcast(tokenizer_json)
    folder = scratch_uri(spark)

    def encode(batches):
        encoder = of_worker(("ByteEncoder", tokenizer_path), lambda: ByteEncoder(shared.value))
        width = 2 if encoder.vocabulary.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches, "text", BLOCK_CHARS):
            ids = [np.frombuffer(i + end, "<u4").astype(f"<u{width}").tobytes() for i in encoder(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket"), batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32())],
                names=["bucket", "doc_id", "ids", "width"],
            )

    def write(batches):
        from pyspark import TaskContext

        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer = shard = None
        first = previous = None
        ordinal = 0
        context = TaskContext.get()

        def finish():
            writer.close()
            stream.close()
            final = f"{root}/shard-{shard:06d}.sst"
            store.move(part, final)
            return pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [writer.docs], "n_ids": [writer.ids], "first_id": [first], "last_id": [previous]}, schema=manifest)

        manifest = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
        for batch in batches:
            for bucket, doc_id, ids, width in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids", "width"))):
                if bucket != shard:
                    if writer is not None:
                        yield finish()
                    shard, first, previous = bucket, doc_id, None
                    part = f"{root}/.part-{bucket:06d}-{context.taskAttemptId()}"
                    stream = store.open_output_stream(part)
                    writer = TableWriter(stream, width)
                ordinal = ordinal + 1 if doc_id == previous else 0
                writer.add(doc_id, ordinal, np.frombuffer(ids, f"<u{width}"))
                previous = doc_id
        if writer is not None:
            yield finish()

    encoded = (
        texts(docs)
        .filter("doc_id IS NOT NULL")
        .withColumn("bucket", bucket_of("doc_id", splits))
        .mapInArrow(encode, "bucket int, doc_id long, ids binary, width int")
    )
    return (
        encoded.repartitionById(len(splits) + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", "doc_id", "ids")
        .mapInArrow(write, "shard int, n_docs long, n_ids long, first_id long, last_id long")
        .withColumn("path", F.concat(F.lit(folder + "/shard-"), F.lpad(F.col("shard").cast("string"), 6, "0"), F.lit(".sst")))
    )


def read_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the shards' bytes.

    `manifest` has one row for each shard, so the running count over it stays small. Each
    shard is scanned by one task, block by block.
    """

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, path = pyarrow.fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as file:
                    table = TableReader(file, file.size())
                    keys, starts, counts, sums = [], [], [], []
                    for doc_id, ids in table.scan():
                        keys.append(doc_id)
                        starts.append(start)
                        counts.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        start += len(ids)
                        if len(keys) == 10_000:
                            yield _rows(keys, starts, counts, sums)
                            keys, starts, counts, sums = [], [], [], []
                    yield _rows(keys, starts, counts, sums)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    n = shuffle_partitions(manifest.sparkSession)
    return placed.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(keys: list, starts: list, counts: list, sums: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, counts, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_tables(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Write `docs` as shards and return what reading them back gives.

    Null and empty texts hold the end id only. An empty table has no shards and no rows.
    """
    return read_tables(stored(write_tables(docs, tokenizer_path, end_id, shards)))


def lookup(spark: SparkSession, manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of the asked identifiers, each looked up in the one shard that may hold it."""

    def find(batches):
        for batch in batches:
            rows = {"doc_id": [], "ids": []}
            for uri, wanted in zip(batch.column("path").to_pylist(), batch.column("wanted").to_pylist()):
                store, path = pyarrow.fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as file:
                    table = TableReader(file, file.size())
                    for doc_id in wanted:
                        for ids in table.lookup(doc_id):
                            rows["doc_id"].append(doc_id)
                            rows["ids"].append(ids.astype("i8").tolist())
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    asked = doc_ids.select(F.col("doc_id").alias("wanted_id")).distinct()
    ranges = F.broadcast(manifest.select("path", "first_id", "last_id"))  # one row for each shard
    held = asked.join(ranges, F.col("wanted_id").between(F.col("first_id"), F.col("last_id")))
    salt = F.pmod(F.xxhash64("wanted_id"), F.lit(64))
    by_shard = held.groupBy("path", salt.alias("salt")).agg(F.collect_list("wanted_id").alias("wanted"))
    return by_shard.mapInArrow(find, "doc_id long, ids array<long>")
