"""Operator 7: best-fit packing by bin completion on the histogram of piece lengths.

Pieces of one length are interchangeable, so the search works on counts by length: at most
`capacity` rows, however large the corpus. It completes the bin of the largest piece left:
fillings of the remaining room are enumerated longest first, dominated ones (where one member
could be swapped for a longer piece that still fits) are skipped, and branches whose waste
passes the bound are pruned. A chosen filling is repeated as often as the counts allow. The
search branches over bins as well: it goes back to a bin and tries fewer repeats and its other
undominated fillings while the waste so far leaves room for fewer bins than the incumbent has.
The best-fit solution is the first incumbent; a lower bound of the bins ends the search.

Spark then deals concrete pieces to the planned places: pieces are numbered within
(length, salt), the few salts are summed, and each number falls into one planned range.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored, texts
from .tokenizing import WordEncoder, of_worker

CAPACITY = 2048
#: Fillings looked at for one bin before the best so far is taken.
NODES = 4000
#: Times the search goes back to a bin before the best solution so far is taken.
TURNS = 1000
#: Bytes of text encoded together; a longer text is on its own. The arrays of a block take some 70 MB,
#: those of 4 MB over 200, beside the 80 MB of the encoder.
BLOCK_BYTES = 1 << 19
#: Pieces numbered together; only sets how finely hot lengths are split.
ROWS_PER_SALT = 20_000

Filling = tuple[tuple[int, int], ...]  # (length, pieces of it), longest first


def _best_fit_fill(room: int, lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """The greedy filling as (index, pieces): the longest piece that fits, as often as it fits, and on."""
    filling, at = [], len(lengths) - 1
    while room > 0:
        at = min(at, int(np.searchsorted(lengths, room, side="right")) - 1)
        if at < 0:
            break
        take = min(int(counts[at]), room // int(lengths[at]))
        if take:
            filling.append((at, take))
            room -= take * int(lengths[at])
        at -= 1
    return filling


def _complete(room: int, lengths: np.ndarray, counts: np.ndarray, nodes: int) -> list[tuple[int, int]]:
    """The filling of `room` with least waste among the undominated ones enumerated.

    Best fit is the first incumbent. A branch ends when even the whole volume of the
    lengths still allowed leaves as much waste as the incumbent (waste bound), or as
    much as swapping a member for a longer piece left out would remove (dominance).
    """
    best = _best_fit_fill(room, lengths, counts)
    best_waste = room - sum(int(lengths[k]) * n for k, n in best)
    volume = np.cumsum(lengths * counts)
    left = nodes

    def search(room: int, at: int, chosen: list[tuple[int, int]], skipped: int, limit: int) -> bool:
        """True ends the whole search: no waste is left, or the nodes are used up."""
        nonlocal best, best_waste, left
        if room < min(best_waste, limit):
            best, best_waste = chosen, room
            if room == 0:
                return True
        while True:
            at = min(at, int(np.searchsorted(lengths, room, side="right")) - 1)
            if at < 0 or room - int(volume[at]) >= min(best_waste, limit):
                return False
            length = int(lengths[at])
            most = min(int(counts[at]), room // length)
            swap = min(limit, skipped - length) if skipped else limit
            for take in range(most, 0, -1):
                left -= 1
                if left <= 0:
                    return True
                held = skipped if take == int(counts[at]) else length
                if search(room - take * length, at - 1, [*chosen, (at, take)], held, swap):
                    return True
            if most:
                skipped = length
            at -= 1

    if best_waste:
        search(room, len(lengths) - 1, [], 0, room + 1)
    return best


def _undominated(room: int, lengths: np.ndarray, counts: np.ndarray, most_waste: int, nodes: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(waste, filling) of the undominated fillings of `room` within `most_waste`, least waste first.

    A filling is dominated where a piece left out would still fit, or would fit in place of a
    shorter member. At most `nodes` are looked at.
    """
    volume = np.cumsum(lengths * counts)
    found, left = [], nodes

    def extend(room: int, at: int, chosen: list[tuple[int, int]], skipped: int, limit: int) -> None:
        nonlocal left
        while left > 0:
            at = min(at, int(np.searchsorted(lengths, room, side="right")) - 1)
            if at < 0:
                if room < limit:
                    found.append((room, chosen))
                return
            if room - int(volume[at]) >= limit:
                return
            length, there = int(lengths[at]), int(counts[at])
            swap = min(limit, skipped - length) if skipped else limit
            for take in range(min(there, room // length), 0, -1):
                left -= 1
                out = take < there
                extend(room - take * length, at - 1, [*chosen, (at, take)], length if out else skipped, min(swap, length) if out else swap)
            skipped, limit = length, min(limit, length)
            at -= 1

    extend(room, len(lengths) - 1, [], 0, most_waste + 1)
    return sorted(found, key=lambda f: f[0])


def least_bins(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins for a histogram with ascending lengths.

    Pieces above half the capacity have a bin each. For every length k up to there, those above
    capacity - k leave no room for pieces of k or more, so these need what the other bins leave.
    """
    half = int(np.searchsorted(lengths, capacity // 2, side="right"))
    pieces, volume = (np.append(0, np.cumsum(v)) for v in (counts, lengths * counts))
    big = int(pieces[-1] - pieces[half])
    shared = np.searchsorted(lengths, capacity - lengths[:half], side="right")
    free = (pieces[shared] - pieces[half]) * capacity - (volume[shared] - volume[half])
    over = volume[half] - volume[:half] - free
    return max(-(-int(volume[-1]) // capacity), big, *(big + -(-over // capacity)).tolist())


def _step(top: int, fill: list[tuple[int, int]], counts: np.ndarray) -> tuple[dict[int, int], int]:
    """(pieces by index of a bin with piece `top` and `fill`, how often the counts allow it)."""
    need = Counter(dict(fill))
    need[top] += 1
    return need, min(int(counts[k]) // n for k, n in need.items())


def _best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """The best-fit solution as (filling, repeats): the longest pieces that fit, bin by bin."""
    lengths, counts = _columns(histogram)
    bins: list[tuple[Filling, int]] = []
    while len(lengths):
        top = len(lengths) - 1
        counts[top] -= 1
        fill = _best_fit_fill(capacity - int(lengths[top]), lengths, counts)
        counts[top] += 1
        need, times = _step(top, fill, counts)
        for k, n in need.items():
            counts[k] -= n * times
        bins.append((_named(need, lengths), times))
        lengths, counts = lengths[counts > 0], counts[counts > 0]
    return bins


def _columns(histogram: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array(sorted(l for l, n in histogram.items() if n > 0), np.int64)
    return lengths, np.array([histogram[int(l)] for l in lengths], np.int64)


def _named(need: dict[int, int], lengths: np.ndarray) -> Filling:
    return tuple(sorted(((int(lengths[k]), n) for k, n in need.items()), reverse=True))


def _branch(histogram: dict[int, int], capacity: int, nodes: int, turns: int, best: int) -> list[tuple[Filling, int]] | None:
    """Bins for the histogram, fewer than `best` of them, or None where none were found.

    Depth first over bins: each one is filled around the largest piece left, first with the
    filling of least waste, repeated as often as the counts allow. Going back to a bin tries fewer
    repeats, down to one, and then its other undominated fillings, by waste. A branch ends
    when its waste exceeds what fewer bins than `best` leave, or by the lower bound of the rest.
    The search ends at the lower bound of all, or after going back `turns` times; without that
    end the result has the fewest bins possible, as far as `nodes` were enough for each bin.
    """
    lengths, counts = _columns(histogram)
    volume, least = int((lengths * counts).sum()), least_bins(lengths, counts, capacity)
    answer = None

    def choices(lengths: np.ndarray, counts: np.ndarray, wasted: int):
        top = len(lengths) - 1
        room = capacity - int(lengths[top])
        rest = counts.copy()
        rest[top] -= 1
        first = _complete(room, lengths, rest, nodes)

        def repeats(fill: list[tuple[int, int]]):
            need, times = _step(top, fill, counts)
            waste = room - sum(int(lengths[k]) * n for k, n in fill)
            while times:
                yield need, times, waste
                times //= 2

        yield from repeats(first)
        kept = rest > 0
        at = np.flatnonzero(kept)
        spare = (best - 1) * capacity - volume - wasted
        for _, fill in _undominated(room, lengths[kept], rest[kept], min(room, spare), nodes):
            fill = [(int(at[k]), n) for k, n in fill]
            if dict(fill) != dict(first):
                yield from repeats(fill)

    stack = [(lengths, counts, 0, 0, choices(lengths, counts, 0))]
    path: list[tuple[Filling, int]] = []
    fresh = True
    while stack and turns > 0 and best > least:
        lengths, counts, used, wasted, more = stack[-1]
        turns -= not fresh
        step = next(more, None)
        fresh = False
        if step is None:
            stack.pop()
            path = path[:-1]
            continue
        need, times, waste = step
        now, lost = used + times, wasted + waste * times
        if lost > (best - 1) * capacity - volume:
            continue
        rest = counts.copy()
        for k, n in need.items():
            rest[k] -= n * times
        kept = rest > 0
        here = (_named(need, lengths), times)
        if not kept.any():
            best, answer = now, [*path, here]
        elif now + least_bins(lengths[kept], rest[kept], capacity) < best:
            path.append(here)
            stack.append((lengths[kept], rest[kept], now, lost, choices(lengths[kept], rest[kept], lost)))
            fresh = True
    return answer


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, turns: int = TURNS) -> list[tuple[Filling, int]]:
    """Fillings with their repeats that hold every piece of the histogram.

    Work and result depend on the number of different lengths, at most `capacity`.
    """
    if any(not 0 < l <= capacity for l in histogram):
        raise ValueError("a piece must have from 1 to `capacity` tokens")
    if not any(histogram.values()):
        return []
    incumbent = _best_fit(histogram, capacity)
    return _branch(histogram, capacity, nodes, turns, sum(times for _, times in incumbent)) or incumbent


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, row_no, piece, start, length and ids_crc32 of every piece; only longer documents are cut.

    `row_no` tells rows of the same identifier apart.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    names = ["doc_id", "row_no", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        encoder = of_worker(("WordEncoder", tokenizer_path), lambda: WordEncoder(shared.value))
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches, "text", BLOCK_BYTES):
            rows = []
            encoded = encoder(batch.column("text").to_pylist())
            for doc_id, row_no, ids in zip(batch.column("doc_id").to_pylist(), batch.column("row_no").to_pylist(), encoded):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, row_no, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    numbered = texts(docs).withColumn("row_no", F.monotonically_increasing_id())
    return numbered.mapInArrow(cut, "doc_id long, row_no long, piece int, start long, length long, ids_crc32 long")


def _places(spark: SparkSession, bins: list[tuple[Filling, int]]) -> DataFrame:
    """One row for each (filling, length): which numbers of that length go where."""
    rows, sequence, used = [], 0, Counter()
    for filling, times in bins:
        offset = 0
        for length, n in filling:
            low = used[length]
            rows.append((length, low, low + n * times, n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    schema = "length long, low long, high long, per_bin long, first_sequence long, first_offset long"
    return spark.createDataFrame(rows, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """`pieces` (with `length`, `doc_id`, `piece`, `row_no`) plus sequence_id and offset.

    The driver sees the histogram only (at most `capacity` rows) and the plan made from it.
    Numbers within a length come from windows over (length, salt), where the salts follow
    the number of pieces; a length that a third of all pieces share is split like any other.
    Ties go by (doc_id, piece, row_no). An empty table gives no rows.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bins = plan_bins(histogram, capacity, nodes)
    salts = max(1, -(-sum(histogram.values()) // ROWS_PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_no", "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row_no")
    numbered = (
        salted.withColumn("inner_no", F.row_number().over(within) - 1)
        .join(starts, ["length", "salt"])
        .withColumn("number", F.col("before") + F.col("inner_no"))
    )
    # The plan has at most `capacity` lengths times fillings, far below a broadcast's limits.
    places = F.broadcast(_places(spark, bins))
    held = numbered.join(places, (numbered["length"] == places["length"]) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    turn = F.col("number") - F.col("low")
    return held.select(
        *[numbered[c] for c in pieces.columns],
        (F.col("first_sequence") + F.floor(turn / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (turn % F.col("per_bin")) * numbered["length"]).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of `docs` with its sequence and offset. Null and empty texts are one piece of the end id."""
    pieces = stored(pieces_of(docs, tokenizer_path, end_id, capacity))
    return pack(pieces, capacity).drop("row_no")
