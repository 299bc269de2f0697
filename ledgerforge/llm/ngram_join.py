"""Operator 3: n-gram Jaccard join with prefix, length, positional and suffix filters.

Every text becomes the set of its 5-word shingles (64-bit hashes). One order over all
shingles puts rare ones first: by the level of the shingle's bucket in a frequency sketch of
the whole corpus, which grows with it, then by hash. Two sets with Jaccard similarity t share
at least `SHARED` of the first n - ceil(t n) + SHARED shingles of each (all of them where sets
are smaller than that), so sets meet only on those prefixes:

1. equal sets collapse to one id;
2. in each of a few rounds, every one of a set's `LEAST` least hashes that still meets different
   components names two pivots: the sets least and greatest after mixing with it. A set is
   compared with the few pivots that most of its hashes name. This takes a number of pairs
   linear in the sets and joins large groups of near copies into components;
3. all prefix shingles are dealt out once; those in one set only go. Those that meet different
   components are joined with themselves, across components only, under the length, positional
   and index-prefix filters; pairs that share enough of them stay. A set that meets a large
   component is compared with its members until one is similar, and the sets of a shingle that
   many of them share are compared in arrays, part by part; neither needs a row for each pair;
4. each pair passes the suffix filter and is verified once on the whole sets.

No link between different components is lost: a linked pair shares its prefix shingles, and is
either connected by links of step 2 or compared in step 3. Rounds and pivots only decide how
much step 3 is spared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, shuffle_partitions, slices, stored, texts, unused
from .components import components, contracted, labels

WORDS = 5
#: Similarity as a fraction, so that comparisons are exact in integers.
SIMILAR, OF = 75, 100
#: Bytes of text for each bucket of the frequency sketch, and bounds of the number of buckets,
#: as powers of two. Levels, a byte a bucket, are 16 MB at most on the driver and in a broadcast.
BUCKET_BYTES = 256
SKETCH_BITS = (16, 24)
#: Buckets that are summed and sent together.
CHUNK = 1 << 15
#: Shingles whose bucket holds more than so many, and than so many times the mean, count as
#: frequent: they surely meet, so their rows are not gathered to find that out.
FREQUENT, TIMES_MEAN = 4096, 16
#: Least hashes of a set that name its pivots, and how many of them a set and its pivot must share.
LEAST, LEAST_SHARED = 8, 3
#: Halvings of the suffix filter.
SUFFIX_DEPTH = 2
#: Prefix shingles that similar sets must share.
SHARED = 4
#: Hashes of one side of a cell in which sets are verified, about (800 kB), and of a set that gets a
#: side for itself. Hashes of right-hand sets that are looked at together.
CELL_HASHES, LONE, BESIDE = 100_000, 25_000, 1 << 16
#: Components with so many sets are met as a whole by sets outside of them.
LARGE = 50
#: Prefix shingles in so many sets (large components apart) are not joined with themselves.
CROWD = 64
#: A set counts as so many hashes at least where sets of a crowd are cut into parts, so that a part has
#: some 800 sets at most. Numbers of a matrix of sets and hashes that is multiplied at once (16 MB).
LEAST_WEIGHT, MATRIX = 128, 1 << 22
#: Rounds of pivots, and pivots a set is compared with in one.
ROUNDS, PIVOTS = 3, 4
#: Steps in which a round's links are contracted. Labels need not be whole before the end: sets with
#: one label are connected, and those not yet under one label are compared or already linked.
STAR_STEPS = 2
#: Bytes of text cut into words together, and handed on together; a longer text is on its own.
#: Words of a block take some twenty times its bytes, the sets handed on about twice theirs.
BLOCK_BYTES, SLICE_BYTES = 1 << 19, 1 << 21

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, np.bool_)
_SPACE[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted different shingle hashes of each text of an Arrow string column, a block at a time."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    out, begin = [], 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK_BYTES, side="right")) - 1)
        part = offsets[begin : end + 1]
        out += _sets(data[part[0] : part[-1]], part - part[0])
        begin = end
    return out


def _sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    letter = ~_SPACE[data]
    before = np.concatenate([[False], letter[:-1]]) if len(letter) else letter
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(letter & ~before)
    inner = data[letter]
    # Where each word begins among the bytes that belong to words.
    at = np.cumsum(letter)[starts] - 1 if len(starts) else starts
    lengths = np.diff(np.append(at, len(inner)))
    place = np.arange(len(inner)) - np.repeat(at, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()) + 1 if len(lengths) else 1, _STEP))
    word = _mix(np.add.reduceat(_BYTE[inner] * powers[place], at) + lengths.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
    first = np.searchsorted(starts, offsets)
    rolled = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = rolled * _NEXT + word[k : k + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= WORDS:
            out.append(np.unique(rolled[low : high - WORDS + 1]))
        elif high > low:
            short = np.full(1, high - low, np.uint64)
            for k in range(low, high):
                short = short * _NEXT + word[k : k + 1]
            out.append(_mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit id of a set, from its sorted hashes."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def buckets_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bucket of each hash in a sketch of `size` buckets, a power of two."""
    return (hashes >> np.uint64(65 - size.bit_length())).astype(np.int64)


def rare_first(hashes: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in the global order, by sketch level and then by hash, and the levels in it."""
    level = levels[buckets_of(hashes, len(levels))]
    order = np.argsort(level, kind="stable")  # the hashes themselves are sorted
    return hashes[order], level[order]


def prefix_size(n: int) -> int:
    """Shingles of a set of n that any similar set shares at least `SHARED` of."""
    least = -(-SIMILAR * n // OF)
    return n - least + min(SHARED, least)


def needed_overlap(a: int, b: int) -> int:
    """Least intersection of similar sets of these sizes."""
    return -(-SIMILAR * (a + b) // (SIMILAR + OF))


def _suffix_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """A lower bound of the symmetric difference of two sorted arrays: halve both at a pivot of one."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    half = len(y) // 2
    cut = int(x.searchsorted(y[half]))
    met = int(cut < len(x) and x[cut] == y[half])
    left = _suffix_bound(x[:cut], y[:half], depth - 1)
    return left + _suffix_bound(x[cut + met :], y[half + 1 :], depth - 1) + 1 - met


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact decision for two sorted sets: the suffix filter first, then the whole intersection."""
    least = needed_overlap(len(x), len(y))
    if _suffix_bound(x, y, SUFFIX_DEPTH) > len(x) + len(y) - 2 * least:
        return False
    at = y.searchsorted(x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) >= least


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): `key` tells texts apart where identifiers are missing or repeat."""
    return texts(docs).withColumn("key", F.xxhash64("text"))


def sketch_size(docs: DataFrame) -> int:
    """Buckets of the frequency sketch for so much text."""
    total = texts(docs).agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    low, high = SKETCH_BITS
    return 1 << min(high, max(low, (total // BUCKET_BYTES).bit_length()))


def document_sets(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(doc_id, key, n, sid, least) of every row, the levels of the frequency sketch of all shingles, and from which on they are frequent.

    One pass over the texts. Each task adds up its own sketch and emits it once, compressed, in
    chunks that are summed where they meet; the driver gets one byte a bucket.
    """
    size = sketch_size(docs)
    chunk_size = min(CHUNK, size)
    kinds = pa.schema(
        [("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("least", pa.list_(pa.int64())), ("chunk", pa.int32()), ("hits", pa.binary())]
    )

    def scan(batches):
        sketch = np.zeros(size, np.uint32)
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(batch.column("text"))
            rows = len(sets)
            if rows:
                np.add.at(sketch, buckets_of(np.concatenate(sets), size), 1)
            sids = [set_id(s) if len(s) else None for s in sets]
            least = [s[:LEAST].view(np.int64) for s in sets]
            cuts = np.append(0, np.cumsum([len(s) for s in least])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(least) if least else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(sids, pa.int64()),
                    lists,
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.binary()),
                ],
                schema=kinds,
            )
        pack = zstandard.ZstdCompressor(level=1)
        parts = sketch.reshape(-1, chunk_size)
        blank = pa.nulls(len(parts), pa.int64())
        # Byte planes: all but the lowest are nearly empty.
        hits = [pack.compress(part.view(np.uint8).reshape(-1, 4).T.tobytes()) for part in parts]
        yield pa.RecordBatch.from_arrays(
            [blank, blank, blank, blank, pa.nulls(len(parts), pa.list_(pa.int64())), pa.array(range(len(parts)), pa.int32()), pa.array(hits, pa.binary())], schema=kinds
        )

    def add(batches):
        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for chunk, hits in zip(batch.column("chunk").to_pylist(), batch.column("hits").to_pylist()):
                planes = np.frombuffer(unpack.decompress(hits), np.uint8).reshape(4, -1)
                sums[chunk] = sums.get(chunk, 0) + np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
        for chunk, hits in sums.items():
            level = (2 * np.log2(np.maximum(hits, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([int(hits.sum())], pa.int64())], names=["chunk", "levels", "total"]
            )

    found = stored(keyed(docs).mapInArrow(scan, "doc_id long, key long, n long, sid long, least array<long>, chunk int, hits binary"))
    chunks = found.filter("chunk IS NOT NULL").select("chunk", "hits")
    levels, total = np.zeros(size, np.uint8), 0
    for row in chunks.repartition(shuffle_partitions(docs.sparkSession), "chunk").mapInArrow(add, "chunk int, levels binary, total long").collect():
        levels[row["chunk"] * chunk_size : (row["chunk"] + 1) * chunk_size] = np.frombuffer(row["levels"], np.uint8)
        total += row["total"]
    frequent = int(2 * np.log2(max(FREQUENT, TIMES_MEAN * total / size)))
    return found.filter("chunk IS NULL").select("doc_id", "key", "n", "sid", "least"), levels, frequent


def _prefixes(docs: DataFrame, levels: np.ndarray, frequent: int) -> DataFrame:
    """(token, sid, n, pos, common) for the prefix of every set, each set once in a task."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    names = ["token", "sid", "n", "pos", "common"]

    def cut(batches):
        seen: set[int] = set()
        for batch in slices(batches, "text", SLICE_BYTES):
            columns = [[], [], [], [], []]
            for hashes in shingle_sets(batch.column("text")):
                n = len(hashes)
                if not n or (key := set_id(hashes)) in seen:
                    continue
                seen.add(key)
                keep = prefix_size(n)
                ordered, level = rare_first(hashes, shared.value)
                own = (ordered[:keep], np.full(keep, key, np.int64), np.full(keep, n, np.int32), np.arange(keep, dtype=np.int32), level[:keep] > frequent)
                for column, values in zip(columns, own):
                    column.append(values)
            if columns[0]:
                token, *rest = map(np.concatenate, columns)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token.view(np.int64), *rest)], names=names)

    return texts(docs).mapInArrow(cut, "token long, sid long, n int, pos int, common boolean")


def _shared_prefixes(docs: DataFrame, levels: np.ndarray, frequent: int) -> DataFrame:
    """(token, sid, n, pos) of prefix shingles that are in several sets, a stored table.

    All rows are dealt out once. A group has about as many rows as a bucket of the sketch may
    hold below `frequent`; rows of frequent shingles are dealt by set as well.
    """
    # Frequent shingles are groups of one set each here, and pass as they are.
    group = Window.partitionBy("token", "apart")
    rows = _prefixes(docs, levels, frequent).withColumn("apart", F.expr("IF(common, sid, 0)"))
    rows = rows.select("token", "sid", "n", "pos", "common", F.min("sid").over(group).alias("lo"), F.max("sid").over(group).alias("hi"))
    return stored(rows.filter("common OR lo <> hi").select("token", "sid", "n", "pos")).dropDuplicates(["token", "sid"])


def _hashes(wanted: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, hashes) of the wanted set ids, a stored table.

    Only their texts are read again, one text for each set; they are picked by a broadcast
    where a count shows that they are few, by a shuffle otherwise.
    """
    chosen = sets.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("one"))
    chosen = stored(chosen.select("sid", F.col("one.doc_id").alias("one_id"), F.col("one.key").alias("key")))
    few = maybe_broadcast(chosen, chosen.count())
    rows = keyed(docs)
    picked = rows.join(few, (rows["key"] == few["key"]) & rows["doc_id"].eqNullSafe(few["one_id"])).select("sid", "text")

    # Keys are hashes; a set is known by its own id.
    def pack(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            own = [(sid, s) for sid, s in zip(batch.column("sid").to_pylist(), shingle_sets(batch.column("text"))) if set_id(s) == sid]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([s.tobytes() for _, s in own], pa.binary())], names=["sid", "hashes"])

    return picked.mapInArrow(pack, "sid long, hashes binary").dropDuplicates(["sid"])


def crowd_links(one: list[int], two: list[int], held: dict[int, np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what the similar pairs between `one` and `two` connect (among `one`, where `two` is empty).

    All intersections are counted at once: a product of matrices whose columns are the hashes that
    several sets have. Of links that close a circle none is given.
    """
    names = [*one, *two]
    sizes = np.array([len(held[s]) for s in names], np.int64)
    if len(names) < 2:
        return []
    _, column, times = np.unique(np.concatenate([held[s] for s in names]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(names)), sizes)
    met = times[column] > 1
    row, column = row[met], (np.cumsum(times > 1) - 1)[column[met]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = len(one), slice(len(one), None) if two else slice(None)
    common = np.zeros((left, len(two) or left), np.float32)
    wide = max(1, MATRIX // len(names))
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        low, high = np.searchsorted(column, (begin, begin + wide))
        part = np.zeros((len(names), wide), np.float32)
        part[row[low:high], column[low:high] - begin] = 1
        common += part[:left] @ part[right].T
    hit = common * (SIMILAR + OF) >= SIMILAR * (sizes[:left, None] + sizes[right][None, :])
    near = np.zeros((len(names), len(names)), np.bool_)
    near[:left, right] = hit
    near |= near.T
    found, fresh = [], np.ones(len(names), np.bool_)
    for start in range(len(names)):
        reached = [start] if fresh[start] else []
        fresh[start] = False
        while reached:
            k = reached.pop()
            more = np.flatnonzero(near[k] & fresh)
            fresh[more] = False
            found += [(min(names[k], names[m]), max(names[k], names[m])) for m in more.tolist()]
            reached += more.tolist()
    return found


def _check_cell(rows):
    """Links among the sets of one cell: those of a crowd, or of the pairs listed, else one for each left set with some right set."""
    import pandas as pd

    held = {s: np.frombuffer(h, np.uint64) for side, s, h in zip(rows["side"], rows["sid"], rows["hashes"]) if side != 2}
    listed = rows[rows["side"] == 2]
    found = []
    if (rows["side"] > 2).any():
        one, two = (sorted({s for side, s in zip(rows["side"], rows["sid"]) if side == k}) for k in (3, 4))
        found = crowd_links(one, two, held)
    elif len(listed):
        found = [(a, b) for a, b in zip(listed["sid"], listed["other"]) if a in held and b in held and similar(held[a], held[b])]
    else:
        right = sorted({s for side, s in zip(rows["side"], rows["sid"]) if side == 1})
        open_ = {s for side, s in zip(rows["side"], rows["sid"]) if side == 0}
        while right and open_:
            sizes = np.array([len(held[t]) for t in right], np.int64)
            few = max(1, int(np.searchsorted(np.cumsum(sizes), BESIDE)))
            block, right, sizes = right[:few], right[few:], sizes[:few]
            every = np.concatenate([held[t] for t in block])
            owner = np.repeat(np.arange(few), sizes)
            for s in sorted(open_):
                # Intersections of the set with all sets of the block at once.
                own = held[s]
                at = np.minimum(np.searchsorted(own, every), len(own) - 1)
                common = np.bincount(owner[own[at] == every], minlength=few)
                hit = np.flatnonzero(common * (SIMILAR + OF) >= SIMILAR * (len(own) + sizes))
                if len(hit):
                    found.append((min(s, block[hit[0]]), max(s, block[hit[0]])))
                    open_.discard(s)
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones among the different (a, b) pairs of set ids, a stored table.

    Sets are dealt to buckets and pairs to cells of two buckets, so that a set is sent once
    to a cell however many of its pairs are there. A bucket has about `CELL_HASHES` hashes, and
    large sets have buckets of their own.
    """
    sizes = sets.filter("n > 0").select("sid", "n").dropDuplicates(["sid"])
    wanted = stored(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(sizes, "sid"))
    total = wanted.agg(F.sum(F.when(F.col("n") <= LONE, F.col("n")))).first()[0] or 0
    buckets = F.lit(max(1, -(-total // CELL_HASHES)))
    bucket = F.when(F.col("n") > LONE, F.xxhash64("sid")).otherwise(F.pmod(F.xxhash64("sid"), buckets))
    dealt = wanted.select("sid", bucket.alias("bucket"))
    one, two = (dealt.select(F.col("sid").alias(c), F.col("bucket").alias(f"in_{c}")) for c in "ab")
    cells = pairs.join(one, "a").join(two, "b").select("a", "b", F.xxhash64("in_a", "in_b").alias("cell"))
    wanted = wanted.select("sid")
    need = cells.select("cell", F.col("a").alias("sid")).union(cells.select("cell", "b")).distinct()
    sent = need.join(_hashes(wanted, docs, sets), "sid").select("cell", F.lit(0).alias("side"), "sid", F.col("sid").alias("other"), "hashes")
    asked = cells.select("cell", F.lit(2).alias("side"), F.col("a").alias("sid"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("hashes"))
    return sent.union(asked).groupBy("cell").applyInPandas(_check_cell, "a long, b long")


def _crowded(small: DataFrame) -> DataFrame:
    """(token, m, crowd) of shingles that at least `CROWD` sets of different components share.

    `crowd` is the least mixed id of a shingle's sets, which shingles of about the same sets have in common.
    """
    met = small.groupBy("token").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.xxhash64(F.lit(7), "sid")).alias("crowd"))
    return met.filter((F.col("m") >= CROWD) & (F.col("lo") < F.col("hi"))).select("token", "m", "crowd")


def _crowd_cells(small: DataFrame, crowded: DataFrame) -> DataFrame:
    """(cell, side, sid): the sets of crowded shingles, each part of a crowd with each part of it in a cell of its own.

    Shingles of one crowd are taken together, so that sets with many of them in common meet once
    or a few times; where that would make a group of more than twice its largest shingle, they
    are taken one by one. Any two sets of one shingle meet.
    """
    held = stored(small.join(crowded, "token").select("token", "m", "crowd", "sid", "n"))
    sizes = held.groupBy("crowd").agg(F.countDistinct("sid").alias("size"), F.max("m").alias("widest"))
    apart = sizes.select("crowd", (F.col("size") > 2 * F.col("widest")).alias("apart"))
    own = F.when(F.col("apart"), F.xxhash64(F.lit(8), "token")).otherwise(F.col("crowd"))
    held = held.join(apart, "crowd").select(own.alias("crowd"), "sid", "n").distinct()
    weight = F.sum(F.greatest("n", F.lit(LEAST_WEIGHT)).cast("long"))
    parts = held.groupBy("crowd").agg(F.ceil(weight / CELL_HASHES).alias("k"))
    dealt = held.join(parts, "crowd").withColumn("x", F.pmod(F.xxhash64(F.lit(5), "sid"), "k"))
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    cell = F.xxhash64(F.lit(9), "crowd", F.least("x", "y"), F.greatest("x", "y"))
    return dealt.select(cell.alias("cell"), F.when(F.col("x") <= F.col("y"), 3).otherwise(4).alias("side"), "sid")


def _verify_with_large(left: DataFrame, large: DataFrame, crowds: DataFrame | None, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of sets with large components (c, size) that share a prefix shingle with them, and those in `crowds`, cells of crowded shingles.

    One link with a component is enough, so its members are not paired as rows: they are cut
    into parts of about `CELL_HASHES` hashes, as are the sets that meet the component, and each
    part meets each part in a cell of its own. Of two large components only the sets of one are
    dealt to the members of the other.
    """
    named = left.join(large.select("c"), "c").select("token", F.col("c").alias("large")).distinct()
    sides = left.join(large.select("c", "size"), "c", "left")
    meets = stored(sides.join(named, "token").filter("c < large OR (size IS NULL AND c <> large)").select("sid", "large", "n").distinct())
    counts = meets.groupBy("large").agg(F.sum("n").alias("met"))
    parts = large.select(F.col("c").alias("large"), F.ceil(F.col("weight") / CELL_HASHES).alias("k")).join(counts, "large").withColumn("j", F.ceil(F.col("met") / CELL_HASHES))
    part = lambda c, n: F.pmod(F.xxhash64(F.lit(5), c), F.col(n))
    cell = F.xxhash64("large", "x", "y")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = meets.join(parts, "large").withColumn("x", part("sid", "j")).withColumn("y", spread("k")).select(cell.alias("cell"), F.lit(0).alias("side"), "sid")
    members = left.select("sid", F.col("c").alias("large")).distinct().join(parts, "large")
    two = members.withColumn("y", part("sid", "k")).withColumn("x", spread("j")).select(cell.alias("cell"), F.lit(1).alias("side"), "sid")
    dealt = stored(one.union(two) if crowds is None else one.union(two).union(crowds))
    wanted = dealt.select("sid").distinct()
    sent = dealt.join(_hashes(wanted, docs, sets), "sid").select("cell", "side", "sid", F.col("sid").alias("other"), "hashes")
    return sent.groupBy("cell").applyInPandas(_check_cell, "a long, b long")


def _pivot_pairs(placed: DataFrame, number: int) -> DataFrame:
    """(a, b) pairs of sets with pivots of other components, from rows (token, sid, n, c).

    The mixing can be undone, so a minimum alone tells the pivot. Of the pivots that a set's
    shingles name, those named most often are tried; the window is over one set's pivots.
    """
    salt = F.xxhash64(F.lit(number), "token")
    mixed = F.col("sid").bitwiseXOR(salt)
    meets = placed.groupBy("token").agg(F.min(mixed).alias("lo"), F.max(mixed).alias("hi"))
    named = placed.join(meets, "token").select("sid", "n", "c", F.explode(F.array(F.col("lo").bitwiseXOR(salt), F.col("hi").bitwiseXOR(salt))).alias("pivot"))
    named = named.filter("sid <> pivot").groupBy("sid", "n", "c", "pivot").agg(F.count("*").alias("times"))
    own = placed.groupBy("sid").agg(F.first("n").alias("p_n"), F.first("c").alias("p_c")).withColumnRenamed("sid", "pivot")
    close = F.least("n", "p_n") * OF >= F.greatest("n", "p_n") * SIMILAR
    other = named.join(own, "pivot").filter(close & (F.col("c") != F.col("p_c")))
    nth = F.row_number().over(Window.partitionBy("sid").orderBy(F.col("times").desc(), "pivot"))
    best = other.withColumn("nth", nth).filter(F.col("nth") <= PIVOTS)
    return best.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()


def _promising(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pivot pairs whose least hashes overlap as those of similar sets nearly always do; the others are left to step 3."""
    least = sets.filter("n > 0").groupBy("sid").agg(F.first("least").alias("least"))
    one, two = least.select(F.col("sid").alias("a"), F.col("least").alias("x")), least.select(F.col("sid").alias("b"), F.col("least").alias("y"))
    enough = F.least(F.lit(LEAST_SHARED), F.size("x"), F.size("y"))
    return pairs.join(one, "a").join(two, "b").filter(F.size(F.array_intersect("x", "y")) >= enough).select("a", "b")


def _across(left: DataFrame) -> DataFrame:
    """(a, b) pairs of sets of different components that share enough prefix shingles to be similar."""
    x, y = left.alias("x"), left.alias("y")
    small, large = F.col("x.n"), F.col("y.n")
    overlap = F.ceil((small + large) * SIMILAR / F.lit(SIMILAR + OF))
    shared = F.least(F.lit(SHARED), F.ceil(small * SIMILAR / F.lit(OF)))
    # x is the smaller set (ties by id): what it shares lies in its shorter index prefix.
    index_prefix = small - F.ceil(small * (2 * SIMILAR) / F.lit(SIMILAR + OF)) + shared
    met = x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.c") != F.col("y.c"))
        & ((small < large) | ((small == large) & (F.col("x.sid") < F.col("y.sid"))))
        & (small * OF >= large * SIMILAR)
        & (F.col("x.pos") < index_prefix)
        & (F.least("x.pos", "y.pos") + 1 + F.least(small - F.col("x.pos") - 1, large - F.col("y.pos") - 1) >= overlap),
    )
    counts = met.groupBy(F.col("x.sid").alias("u"), F.col("y.sid").alias("v"), shared.alias("least")).agg(F.count("*").alias("times"))
    return counts.filter("times >= least").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    Null and empty texts, and texts of white space only, have no shingles and are linked with
    nothing; equal texts are always linked. Ties cannot occur, repeated rows repeat, an empty
    table gives no rows, and columns besides doc_id and text are ignored. A row without
    doc_id takes part, but cannot name a component.
    """
    members = _grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), "c")
    named = members.filter("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return members.join(named, "c", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _meeting(placed: DataFrame) -> DataFrame:
    """The rows of `placed` (token, c) whose token is met in different components."""
    split = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token")
    return placed.join(split, "token", "left_semi")


def _with_components(rows: DataFrame, final: DataFrame | None) -> DataFrame:
    """`rows` plus c, the component of their sid, which is the sid itself where it is linked with none."""
    if final is None:
        return rows.withColumn("c", F.col("sid"))
    placed = rows.join(final.select(F.col("node").alias("sid"), "component"), "sid", "left")
    return placed.withColumn("c", F.coalesce("component", "sid")).drop("component")


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, c) of every row; c is the same for linked rows, NULL without shingles."""
    sets, levels, frequent = document_sets(docs)
    hashes = sets.filter("n > 0").select("sid", "n", "least").dropDuplicates(["sid"])
    hashes = hashes.select(F.explode("least").alias("token"), "sid", F.col("n").cast("int").alias("n"))
    left = stored(_meeting(_with_components(hashes, None)))
    tried = stars = final = None
    for number in range(ROUNDS):
        pairs = _promising(_pivot_pairs(left, number), sets)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        new = stored(_verify(pairs, docs, sets))
        if not new.limit(1).count():
            break
        stars = contracted(new if stars is None else new.union(stars), STAR_STEPS)
        final = stored(labels(stars))
        left = stored(_meeting(_with_components(left.drop("c"), final)))
    left = stored(_meeting(_with_components(_shared_prefixes(docs, levels, frequent), final)))
    sized = left.select("sid", "c", "n").distinct().groupBy("c").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    large = stored(sized.filter(F.col("size") >= LARGE))
    small = stored(left.join(large, "c", "left_anti"))
    crowded = stored(_crowded(small))
    some = crowded.count()
    rest = _across(small.join(maybe_broadcast(crowded.select("token"), some), "token", "left_anti") if some else small)
    rest = stored(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"))
    crowds = _crowd_cells(small, crowded) if some else None
    late = stored(_verify(rest, docs, sets).union(_verify_with_large(left, large, crowds, docs, sets)))
    links = late if stars is None else late.union(stars)
    final = stored(components(links)) if links.limit(1).count() else None

    return _with_components(sets.select("doc_id", "key", "n", "sid"), final).drop("sid")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group of near copies, with all its columns.

    The row with the smallest doc_id stays; where no row of the group has one, the row whose
    text has the smallest hash. Rows with the same doc_id and text count as the same document
    and stay together. Rows without words are groups of their own.
    """
    members = _grouped(docs).filter("c IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    firsts = members.groupBy("c").agg(F.min(order).alias("first"))
    own = (F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    gone = stored(members.join(firsts, "c").filter(~own).select("doc_id", "key").distinct())
    gone = gone.select(F.col("doc_id").alias(unused("gone_id", docs)), F.col("key").alias(unused("gone_key", docs)))
    same = docs["doc_id"].cast("long").eqNullSafe(gone[0]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone[1])
    return docs.join(gone, same, "left_anti")
