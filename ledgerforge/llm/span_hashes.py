"""Operator 10: document fingerprints from prefix polynomial hashes.

For a text of code points c the arrays P[i] = sum(c[j] * b^j for j < i) mod p answer the
hash of any span in constant time, so spans compare without reading them again and the
longest common extension of two positions is found by binary search. Two primes give 62
bits. The fingerprint keeps, for each of `BINS` ranges of the mixed hash, the least hash of
all `WINDOW`-character spans that fall into it; the likeness of two fingerprints is the share
of bins that agree among those filled in either, an estimate of the Jaccard similarity of the
two sets of spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, texts
from .sorted_tables import bucket_of, range_splits

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
WINDOW = 16
BINS = 64
#: Characters hashed at a time when only windows are wanted; bounds memory for very long texts.
BLOCK = 1 << 20
EMPTY_BIN = "----"


class _Powers:
    """b^i and b^-i modulo p, extended by doubling as longer texts come."""

    def __init__(self, base: int, prime: int):
        self.prime, self.up, self.down = prime, np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.base, self.inverse = base, pow(base, -1, prime)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, self.prime)) % np.uint64(self.prime)])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, self.prime)) % np.uint64(self.prime)])
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class PrefixHashes:
    """Prefix arrays of one text (or block of it)."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for powers in _POWERS:
            up, _ = powers.get(self.n)
            terms = (points + np.uint64(1)) * up % np.uint64(powers.prime)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums % np.uint64(powers.prime))

    def span(self, start: int, length: int) -> tuple[int, int]:
        """The hash of a span, the same wherever the span stands."""
        out = []
        for powers, sums in zip(_POWERS, self.sums):
            p = powers.prime
            difference = (int(sums[start + length]) - int(sums[start])) % p
            out.append(difference * int(powers.get(start + 1)[1][start]) % p)
        return out[0], out[1]

    def same(self, start: int, other: "PrefixHashes", other_start: int, length: int) -> bool:
        return self.span(start, length) == other.span(other_start, length)

    def extension(self, start: int, other: "PrefixHashes", other_start: int) -> int:
        """Length of the longest common extension of two positions, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def windows(self, width: int) -> np.ndarray:
        """Mixed 64-bit hashes of all spans of `width` characters."""
        mixed = np.zeros(self.n - width + 1, np.uint64)
        for powers, sums in zip(_POWERS, self.sums):
            p = np.uint64(powers.prime)
            _, down = powers.get(len(mixed))
            value = (sums[width:] + p - sums[:-width]) % p * down % p
            mixed = mixed << np.uint64(31) | value
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ mixed >> np.uint64(32)


def common_prefix(a: np.ndarray, b: np.ndarray, block: int = BLOCK) -> int:
    """Length of the common prefix of two whole texts, block by block until one differs."""
    n = min(len(a), len(b))
    for begin in range(0, n, block):
        x, y = a[begin : min(begin + block, n)], b[begin : min(begin + block, n)]
        same = PrefixHashes(x).extension(0, PrefixHashes(y), 0)
        if same < len(x):
            return begin + same
    return n


def signature(points: np.ndarray) -> np.ndarray:
    """Least hash of each bin (the largest value where a bin has none). A short text is one span."""
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    width = min(WINDOW, len(points))
    if not width:
        return least
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    for begin in range(0, len(points) - width + 1, BLOCK):
        hashes = np.sort(PrefixHashes(points[begin : begin + BLOCK + width - 1]).windows(width))
        bins = hashes >> shift
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        at = bins[first].astype(np.int64)
        least[at] = np.minimum(least[at], hashes[first])
    return least


def show(least: np.ndarray) -> str:
    """Four hex digits a bin, from below the bits that choose the bin."""
    top = np.iinfo(np.uint64).max
    digits = (least >> np.uint64(16) & np.uint64(0xFFFF)).tolist()
    return "".join([EMPTY_BIN if full else f"{d:04x}" for d, full in zip(digits, (least == top).tolist())])


def likeness(a: str, b: str) -> float:
    """Share of agreeing bins among those filled in either; 1 for two empty texts."""
    pairs = [(a[k : k + 4], b[k : k + 4]) for k in range(0, 4 * BINS, 4)]
    filled = [(x, y) for x, y in pairs if x != EMPTY_BIN or y != EMPTY_BIN]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix long"
)


def span_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, made with the next document's beginning.

    "Next" follows descending identifiers; after the last comes the first. Rows of the same
    identifier follow each other by text, and rows without identifier come last. Texts are
    shuffled once into ranges cut at identifiers near their quantiles; the first document of each
    range is sent along to the range before it, so that no order over all rows is needed.
    A single document is its own next one.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = texts(docs, id_col, text_col).withColumn("key", key)
    keys = rows.select(F.col("key").alias("doc_id"))
    top = keys.agg(F.max("doc_id")).first()[0]
    # Quantiles are doubles, which beyond 2**53 need not be any row's identifier.
    near = [min(s, (1 << 63) - 1) for s in range_splits(keys, shuffle_partitions(docs.sparkSession))]
    highest = keys.groupBy(bucket_of("doc_id", near)).agg(F.max("doc_id").alias("high")).collect()
    splits = sorted(r["high"] for r in highest if r["high"] != top)
    # A range's highest identifier is a split, or the overall top: its rows also go, as
    # guests, to the range that comes before it in descending order.
    own = F.struct(bucket_of("key", splits).alias("bucket"), F.lit(False).alias("guest"))
    to_next = F.when(F.col("key").isin(splits) if splits else F.lit(False), F.struct((bucket_of("key", splits) + 1).alias("bucket"), F.lit(True).alias("guest")))
    to_last = F.when(F.col("key") == F.lit(top), F.struct(F.lit(0).alias("bucket"), F.lit(True).alias("guest")))
    placed = rows.withColumn("at", F.explode(F.array_compact(F.array(own, to_next, to_last)))).select("at.bucket", "at.guest", "key", "doc_id", "text")

    def walk(batches):
        names = [part.split(" ")[0] for part in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        held = bucket_now = None
        done: list[tuple] = []

        def finish(doc_id, text, own_print, next_text, next_print):
            k = len(text) // 3
            edited = text[: len(text) - k] + next_text[:k]
            points, edited_points = code_points(text), code_points(edited)
            edited_print = show(signature(edited_points)) if k else own_print
            shared = common_prefix(points, edited_points) if k else len(text)
            digest = hashlib.sha256(edited.encode("utf-8")).hexdigest()
            return doc_id, len(text), digest, own_print, edited_print, likeness(own_print, edited_print), likeness(own_print, next_print), shared

        for batch in batches:
            for bucket, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                if bucket != bucket_now:
                    held, bucket_now = None, bucket
                if held == "over":
                    continue
                own_print = show(signature(code_points(text)))
                if held is not None:
                    done.append(finish(*held, text, own_print))
                held = "over" if guest else (doc_id, text, own_print)
            columns = list(zip(*done)) or [()] * len(kinds)
            done = []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return (
        placed.repartitionById(len(splits) + 1, F.col("bucket"))
        .sortWithinPartitions(F.col("bucket"), F.col("guest"), F.col("key").desc(), F.col("text"))
        .mapInArrow(walk, SCHEMA)
    )
