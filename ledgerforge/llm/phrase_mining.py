"""Phrase collocations by dynamic itemset counting.

The corpus is dealt to `SHARDS` shards, which are scanned in a cycle. Words are counted from the
first scan on. A pair of words becomes active as soon as both words have been seen `LEAST` times,
a triple as soon as both its pairs have: each is counted from the next scan on, whatever length
is then being counted besides, and stops when it has met every shard once. So lengths interleave,
and after three cycles at most all counts are whole.

* Pairs are many and mostly rare: at first they are counted by a hash as wide as the corpus asks
  for. Those that reach the threshold (no pair that does is missed, as collisions only add) are
  then counted as texts for one cycle of their own. Counts of the result are counts of texts.
* Which word or pair was active when is told by one bitmap for each scan. It has 32 bits for each
  entry, 2^28 at most: a fuller one lets more phrases be counted, which the exact counts drop again.
* Nothing is dropped by counting late: a phrase is active once its parts are, and a phrase seen
  `LEAST` times has such parts.

Tasks count slices of text in arrays; Spark sums over tasks, and every scan's sums are written to
the shared folder. A null text is empty, a null `lang` is `und`, rows may repeat, other columns are
left out whatever their names, and a table without words gives no phrases. A text is held by one
task together with arrays of some ten times its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_uri, shuffle_partitions, slices, stored

SHARDS, LEAST = 3, 10
#: A shorter phrase goes when a longer one that holds it has this share of its count, in percent.
COVER = 50
MOST = 2000
SLICE = 6 << 20
FILTER_LOG, FILTER_SHARE = 28, 32
NEVER, START_BITS = 100, 4
#: Capitals are lowered; stops and line ends part pieces (as line feeds), tabs part words.
STOPS = ".,;:!?\x0b\x0c\r"
FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + STOPS + "\t", "abcdefghijklmnopqrstuvwxyz" + "\n" * len(STOPS) + " ")
EXACT = "length int, lang string, phrase string, hash long, n long"
HASHED = "key long, n long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


class Words:
    """The words of some texts in order, with their language and whether the next one follows in the piece."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column("lang").dictionary_encode()
        pieces = pc.split_pattern(batch.column("text"), "\n")
        words = pc.split_pattern(pc.list_flatten(pieces), " ")
        flat, piece = pc.list_flatten(words), pc.list_parent_indices(words)
        filled = pc.greater(pc.binary_length(flat), 0)
        flat, piece = flat.filter(filled).dictionary_encode(), piece.filter(filled).to_numpy()
        self.langs, self.vocabulary = langs.dictionary, flat.dictionary
        self.ids = flat.indices.to_numpy().astype(np.int64)
        row = pc.list_parent_indices(pieces).to_numpy()[piece]
        self.lang = langs.indices.to_numpy().astype(np.int64)[row]
        self.follows = piece[1:] == piece[:-1]
        own, other = _hashes(self.vocabulary), _hashes(self.langs)
        self.keys = _mix(own[self.ids] + other[self.lang] * np.uint64(0x9E3779B97F4A7C15)) if len(self.ids) else np.zeros(0, np.uint64)

    def pair_hashes(self) -> np.ndarray:
        return _mix(self.keys[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.keys[1:])

    def phrases(self, at: np.ndarray, length: int):
        """(lang, phrase, count) of the phrases of `length` words that begin at the positions `at`."""
        width = max(1, len(self.vocabulary))
        code = self.lang[at]
        for k in range(length):
            # Codes stay below positions times words, as they are numbered anew for each word.
            code = np.unique(code * width + self.ids[at + k], return_inverse=True)[1]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        first = at[first]
        texts = [self.vocabulary.take(pa.array(self.ids[first + k])) for k in range(length)]
        return self.langs.take(pa.array(self.lang[first])), texts[0] if length == 1 else pc.binary_join_element_wise(*texts, " "), counts, first


def since(bitmaps, hashes: np.ndarray, bits: int) -> np.ndarray:
    """The scan after which each hash was active, by the first bitmap that holds it."""
    found = np.full(len(hashes), NEVER, np.int64)
    for scan, log, bitmap in bitmaps:
        place = hashes >> np.uint64(bits - log)
        hit = (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
        found[(hit != 0) & (found == NEVER)] = scan
    return found


def _later(times: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    return np.where(allowed, np.maximum(times[:-1], times[1:]), NEVER)


def _now(times: np.ndarray, scan: int, shards: int) -> np.ndarray:
    return (times >= scan - shards) & (times < scan)


def count_hashed(batches, scan: int, shards: int, bits: int, words):
    """Active pairs by hash and by the scan after which they were."""
    for batch in slices(batches, "text", SLICE):
        w = Words(batch)
        if len(w.ids) < 2:
            continue
        active = _later(since(words, w.keys, 64), w.follows)
        now = _now(active, scan, shards)
        keys = (w.pair_hashes()[now] >> np.uint64(64 - bits) << np.uint64(START_BITS)).astype(np.int64) | active[now]
        keys, counts = np.unique(keys, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])


def count_exact(batches, scan: int, shards: int, bits: int, pairs):
    """Words in the first cycle; pairs that reached the threshold and active triples in theirs."""
    for batch in slices(batches, "text", SLICE):
        w = Words(batch)
        found = [(1, np.arange(len(w.ids)))] if scan < shards else []
        if pairs and len(w.ids) > 1:
            reached = np.where(w.follows, since(pairs, w.pair_hashes() >> np.uint64(64 - bits), bits), NEVER)
            found.append((2, np.flatnonzero(_now(reached, scan, shards))))
            found.append((3, np.flatnonzero(_now(_later(reached, np.ones(max(0, len(reached) - 1), bool)), scan, shards))))
        for length, at in found:
            if len(at):
                langs, texts, counts, first = w.phrases(at, length)
                size = len(counts)
                hashes = pa.array((w.keys[first] >> np.uint64(1)).astype(np.int64)) if length == 1 else pa.nulls(size, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, length, np.int32)), langs, texts, hashes, pa.array(counts)], names=["length", "lang", "phrase", "hash", "n"])


def _bitmap(hashes: DataFrame, bits: int, scan: int):
    """(scan, size, bitmap) of a column `hash` of `bits` bits; its words are ored in tasks. None when empty."""
    size = hashes.count()
    if not size:
        return None
    log = min(FILTER_LOG, bits, max(6, (FILTER_SHARE * size).bit_length()))
    place = F.shiftright("hash", bits - log)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    table = hashes.select(F.shiftright(place, 6).alias("k"), bit.alias("b")).groupBy("k").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << log - 6, np.uint64)
    bitmap[table["k"].to_numpy()] = table["b"].to_numpy().view(np.uint64)
    return scan, log, bitmap


def phrase_counts(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): lang, phrase and n of all words, and of all phrases of two or three words seen `least` times."""
    spark = docs.sparkSession
    folder = scratch_uri(spark)
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), *FOLD)
    staged = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"), (F.monotonically_increasing_id() % shards).cast("int").alias("shard"))
    staged.write.partitionBy("shard").parquet(folder)
    corpus = spark.read.schema(staged.schema).parquet(folder)
    # Pairs are fewer than bytes; three bits more keep most of their hashes apart.
    n_bytes = corpus.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(62 - START_BITS, max(8, n_bytes.bit_length() + 3))
    words, running, exact, of_words, of_pairs = None, None, [], [], []
    for scan in range(3 * shards):
        shard = corpus.filter(F.col("shard") == scan % shards).select("lang", "text")
        live = lambda maps: any(scan - shards <= m[0] < scan for m in maps)
        if scan < shards or live(of_pairs):
            seen = spark.sparkContext.broadcast(of_pairs)
            counted = shard.mapInArrow(lambda b, scan=scan, seen=seen: count_exact(b, scan, shards, bits, seen.value), EXACT)
            part = stored(counted.groupBy("length", "lang", "phrase", "hash").agg(F.sum("n").alias("n")))
            exact.append(part.filter("length > 1"))
            seen.unpersist()
        if scan < shards:
            new = part.filter("length = 1").select("lang", "phrase", "hash", "n")
            words = new if words is None else stored(words.unionByName(new).groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n")))
        if live(of_words):
            seen = spark.sparkContext.broadcast(of_words)
            counted = shard.mapInArrow(lambda b, scan=scan, seen=seen: count_hashed(b, scan, shards, bits, seen.value), HASHED)
            if running is not None:
                open_still = F.col("key").bitwiseAND((1 << START_BITS) - 1) >= scan - shards
                counted = counted.unionByName(running.filter(open_still))
            running = stored(counted.groupBy("key").agg(F.sum("n").alias("n")))
            seen.unpersist()
            pairs = _bitmap(running.filter(F.col("n") >= least).select(F.shiftright("key", START_BITS).alias("hash")), bits, scan)
            of_pairs += [pairs] if pairs else []
        if scan < shards:
            often = _bitmap(words.filter(F.col("n") >= least).select("hash"), 63, scan)
            # Words are known by 64 bits in tasks and by 63 in tables: the bitmaps take the first ones of both.
            of_words += [often] if often else []
        if scan >= shards - 1 and not any(scan - shards < m[0] for m in (*of_words, *of_pairs)):
            break
    phrases = exact[0]
    for part in exact[1:]:
        phrases = phrases.unionByName(part)
    phrases = phrases.groupBy("length", "lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return words.select("lang", "phrase", "n"), stored(phrases)


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, most: int = MOST, shards: int = SHARDS) -> DataFrame:
    """The best-scoring phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase seen a times scores floor(1000000 a a / (l r)) where it is cut into parts seen l and r
    times so that this is least, and at the first such place. Arithmetic is decimal, of 38 digits.
    """
    words, phrases = phrase_counts(docs, least, shards)
    often = words.filter(F.col("n") >= least)
    cuts = phrases.select("length", "lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - length)")})
    parts = often.unionByName(phrases.filter("length = 2").select("lang", "phrase", "n"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    scored = cuts.withColumn("score", F.expr("(CAST(1000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0))) DIV (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"))
    lowest = scored.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Pairs inside a triple that is nearly as frequent go.
    triples = phrases.filter("length = 3")
    inside = F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)))
    covered = triples.select("lang", inside.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left_over = lowest.join(covered, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {cover} * a")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    flat = left_over.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.hash("phrase"), F.lit(shuffle_partitions(docs.sparkSession))).alias("salt"))
    # A language may hold most phrases: the best of each salt first, then the best of those.
    salted = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    sums = words.groupBy("lang").agg(F.sum("n").alias("total"))
    return best.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
