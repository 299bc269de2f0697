"""Operator 1: line dedup by a segment-partition edit join, in DataFrame functions only.

Lines within `EDITS` edits of each other are near copies. A line of n characters is cut into
EDITS + 1 even segments; if another line is within EDITS edits, at least one segment stands
in it unchanged, shifted by no more than the edits on both sides allow. So each different
line is indexed under its segments, and probes, for every length up to EDITS shorter than its
own, only the few substrings that the position bounds leave. Pairs that meet are verified
with a banded bit-parallel edit distance after common ends are cut off.

Lines shorter than `LEAST_CHARS` allow fewer edits: one from `ONE_EDIT_CHARS` characters on, none
below, where only equal lines are copies. Of two lines the shorter one decides. `least` leaves
shorter lines out altogether. Lines are what stands between line feeds.
"""

from __future__ import annotations

import itertools
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, shuffle_partitions, stored, texts, unused
from .components import components

EDITS = 2
LEAST_CHARS = 20
ONE_EDIT_CHARS = 10
#: Parts of a line for each segment, from one kind of keys to the next finer one, and the lines
#: indexed under a key beyond which they meet under finer keys instead: about as many rows
#: as finer keys would cost a line. The last kind has no crowds.
FINER = (1, 2, 4)
CROWDS = (32, 128, None)
#: Columns of the edit distance after which pairs that are too far apart end.
FIRST_COLUMNS = 24


def text_key(text: Column) -> Column:
    """Tells rows apart whose identifiers are missing or repeat; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_of(docs: DataFrame, least: int = LEAST_CHARS, blank: bool = True, key: bool = False) -> DataFrame:
    """(doc_id, line_no, line) of every line of at least `least` characters; numbers count from 0.

    Without `blank`, lines of white space shorter than `LEAST_CHARS` are left out; with `key`,
    the key of the whole text stands beside each.
    """
    rows = texts(docs)
    # Taken before lines are, else each line would carry and hash the whole text.
    rows = rows.withColumn("key", text_key(F.col("text"))) if key else rows
    rows = rows.select("doc_id", *["key"][: int(key)], F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.filter(F.char_length("line") >= least)
    return rows if blank else rows.filter((F.char_length("line") >= LEAST_CHARS) | _says(F.col("line")))


def _says(line: Column) -> Column:
    """Whether a line has anything but white space."""
    return line.rlike(r"\S")


def allowed(n: Column, edits: int = EDITS) -> Column:
    """The edits within which another line is a near copy of a line of `n` characters that is not longer."""
    return F.when(n >= LEAST_CHARS, edits).when(n >= ONE_EDIT_CHARS, min(1, edits)).otherwise(0)


def _part(length: Column, k: int | Column, parts: int) -> tuple[Column, Column]:
    """(start from 1, size) of part k of a line of `length`; the last ones take the remainder."""
    base, extra = F.floor(length / parts), length % parts
    size = base + F.when(extra > parts - 1 - k, 1).otherwise(0)
    start = 1 + base * k + F.greatest(F.lit(0), extra - (parts - k))
    return start.cast("int"), size.cast("int")


def _by_bytes(line: Column, n: Column, keys) -> Column:
    """`keys(line)`, on bytes where each character is one: the hashes are the same, and cutting needs no counting."""
    return F.when(F.octet_length(line) == n, keys(line.cast("binary"))).otherwise(keys(line))


def index_keys(line: Column, n: Column, edits: int = EDITS) -> Column:
    """The hashes of a line's own segments, each with its length and place."""

    def keys(line: Column) -> Column:
        cuts = [_part(n, k, edits + 1) for k in range(edits + 1)]
        return F.array(*[F.xxhash64(F.lit(k), n, F.substring(line, start, size)) for k, (start, size) in enumerate(cuts)])

    return _by_bytes(line, n, keys)


def probe_keys(line: Column, n: Column, edits: int = EDITS) -> Column:
    """The hashes a line is looked up under: per length and segment, the places the bounds leave.

    With segment k the edits before it are at most k, and those after it at most edits - k;
    a place must satisfy both.
    """

    def keys(line: Column) -> Column:
        out = []
        for shorter in range(edits + 1):
            length = n - shorter
            for k in range(edits + 1):
                start, size = _part(length, k, edits + 1)
                low = max(-k, shorter - (edits - k))
                high = min(k, shorter + (edits - k))
                out += [F.xxhash64(F.lit(k), length, F.substring(line, start + shift, size)) for shift in range(low, high + 1)]
        return F.array(*out)

    return _by_bytes(line, n, keys)


def alignments(parts: int, edits: int) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """(characters more, parts left out, shift of each other part) of all ways to be within `edits`.

    Every edit falls into one part and shifts the later ones by 1, 0 or -1. Where fewer than
    `edits` parts are touched, the first others are left out as well.
    """
    found = set()
    for count in range(edits + 1):
        for places in itertools.combinations_with_replacement(range(parts), count):
            out = sorted(set(places))
            out = tuple(sorted(out + [k for k in range(parts) if k not in out][: edits - len(out)]))
            for moves in itertools.product((-1, 0, 1), repeat=count):
                if sum(moves) >= 0:
                    shifts = tuple(sum(m for p, m in zip(places, moves) if p < k) for k in range(parts) if k not in out)
                    found.add((sum(moves), out, shifts))
    return sorted(found)


def _picked(hashes: Column, n: Column, choices: list[tuple[int, int, list[int]]]) -> Column:
    """One key for each choice (number of the parts left out, characters less, places in `hashes`)."""
    rows = json.dumps([{"out": out, "less": less, "at": at} for out, less, at in choices])
    table = F.from_json(F.lit(rows), "array<struct<out:int,less:int,at:array<int>>>")
    return _let(hashes, lambda h: F.transform(table, lambda c: F.xxhash64(c["out"], n - c["less"], F.transform(c["at"], lambda i: F.get(h, i)))))


def fine_keys(line: Column, n: Column, parts: int, edits: int) -> tuple[Column, Column]:
    """(own keys, keys looked up): hashes of all but `edits` of a line's parts together.

    Of two lines within `edits` of each other, the longer one is looked up under a key of the
    shorter one.
    """
    width = 2 * edits + 1
    ways = alignments(parts, edits)
    numbers = {out: number for number, out in enumerate(sorted({out for _, out, _ in ways}))}
    kept = {out: [k for k in range(parts) if k not in out] for out in numbers}

    def own(k: Column) -> Column:
        return F.xxhash64(F.substring(line, *_part(n, k, parts)))

    def moved(i: Column) -> Column:
        start, size = _part(n - F.floor(i / (parts * width)).cast("int"), F.floor(i / width).cast("int") % parts, parts)
        return F.xxhash64(F.substring(line, start + i % width - edits, size))

    def places(more: int, out: tuple[int, ...], shifts: tuple[int, ...]) -> list[int]:
        return [(more * parts + k) * width + shift + edits for k, shift in zip(kept[out], shifts)]

    index = _picked(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), own), n, [(number, 0, kept[out]) for out, number in numbers.items()])
    cut = F.transform(F.sequence(F.lit(0), F.lit((edits + 1) * parts * width - 1)), moved)
    return index, _picked(cut, n, [(numbers[out], more, places(more, out, shifts)) for more, out, shifts in ways])


def parities(line: Column) -> Column:
    """Two longs: for each of 64 classes of characters, and of pairs that stand side by side, whether their number is odd.

    An edit changes at most two bits of the first and four of the second.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    bit = lambda c: F.call_function("shiftleft", one, F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    return F.aggregate(
        F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)),
        F.struct(F.lit("").alias("last"), zero.alias("single"), zero.alias("double")),
        lambda s, c: F.struct(
            c.alias("last"), s["single"].bitwiseXOR(bit(c)).alias("single"), s["double"].bitwiseXOR(bit(F.concat(s["last"], c))).alias("double")
        ),
    )


def candidates(different: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """Pairs (a, b) of ids of `different` (id, line, n) that share a key; a is not longer than b.

    Lines below `LEAST_CHARS`, where `least` has them, meet lines up to one edit longer.
    """
    pairs = _meet(different.filter(F.col("n") >= LEAST_CHARS) if least < LEAST_CHARS else different, edits)
    if least >= LEAST_CHARS or not edits:
        return pairs
    short = different.filter((F.col("n") >= ONE_EDIT_CHARS) & (F.col("n") <= LEAST_CHARS))
    return pairs.union(_meet(short, 1, LEAST_CHARS - 1))


def _meet(different: DataFrame, edits: int, most: int | None = None) -> DataFrame:
    """The pairs within one number of edits, a of at most `most` characters.

    A pair shares a key of each kind. If one of them has no crowd, the pair is found there;
    otherwise both lines are among the crowded ones, which meet again under finer keys.
    """
    lines, pairs = different, None
    for finer, crowd in zip(FINER, CROWDS):
        line, n = F.col("line"), F.col("n")
        own, sought = (index_keys(line, n, edits), probe_keys(line, n, edits)) if finer == 1 else fine_keys(line, n, finer * (edits + 1), edits)
        found = stored(_met(lines, own, sought, edits, most, crowd))
        here = found.filter("a IS NOT NULL")
        pairs = here if pairs is None else pairs.union(here)
        crowded = found.filter("a IS NULL").select(F.col("b").alias("id"))
        count = crowded.count() if crowd else 0
        if not count:
            break
        lines = different.join(maybe_broadcast(crowded, count), "id", "left_semi").withColumn("odd", parities(line))
        lines = stored(lines.select("id", "line", "n", "odd.single", "odd.double"))
    return pairs.distinct()


def _met(lines: DataFrame, own: Column, sought: Column, edits: int, most: int | None, crowd: int | None) -> DataFrame:
    """Different pairs (a, b) that meet under a key without a crowd, and (NULL, b) for each b at a crowded one.

    Of a crowded key only one indexed line stays, to tell who looks there; sizes are
    aggregated before anything is joined to them. Where `lines` has parities, pairs must be
    close in them.
    """
    odd = [c for c in ("single", "double") if c in lines.columns]
    index = lines.select(F.explode(own).alias("key"), F.col("id").alias("a"), F.col("n").alias("n_a"), *[F.col(c).alias(f"{c}_a") for c in odd])
    probe = lines.select(F.explode(sought).alias("key"), F.col("id").alias("b"), F.col("n").alias("n_b"), *[F.col(c).alias(f"{c}_b") for c in odd])
    if most is not None:
        index = index.filter(F.col("n_a") <= most)
    if crowd is not None:
        sizes = index.groupBy("key").agg(F.count("*").alias("size"), F.min("a").alias("one")).filter(F.col("size") > crowd).select("key", "one")
        index = index.join(sizes, "key", "left").filter("one IS NULL OR a = one")
        index = index.withColumn("a", F.expr("CASE WHEN one IS NULL THEN a END")).drop("one")
    once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    close = once & (F.col("n_b") - F.col("n_a") <= edits)
    for c, flips in zip(odd, (2, 4)):
        close &= F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) <= flips * edits
    return index.join(probe, "key").filter(F.col("a").isNull() | close).select("a", "b").distinct()


def _let(value: Column, then) -> Column:
    """`then(value)` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def common_prefix(x: Column, y: Column, most: Column) -> Column:
    """Length of the common prefix up to `most`, by steps that halve."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.expr("1") * F.pow(F.lit(2), e).cast("int"))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= most) & (F.substring(x, at + 1, step) == F.substring(y, at + 1, step)), at + step).otherwise(at),
    )


def _band(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters, y not shorter and by at most `edits`; above `edits` just larger.

    The rows of a column within `edits` of the diagonal are the bits of one long; vertical
    differences are kept as two of them, and one addition carries matches down the column.
    """
    width, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    n, gap = F.size(x), F.size(y) - F.size(x)
    long = lambda v: F.lit(v).cast("long")
    mask = long(full)

    def column(state: Column, j: Column) -> Column:
        here = F.get(x, j - 1)
        # The characters of y beside this column; places before its start give NULL, no match.
        hits = [F.when(F.get(y, j - 1 - edits + b) == here, long(1 << b)).otherwise(long(0)) for b in range(width)]
        match = reduce(lambda p, q: p.bitwiseOR(q), hits)
        up = F.shiftright(state["up"], 1).bitwiseOR(long(1 << (width - 1)))
        down = F.shiftright(state["down"], 1)

        def advance(match: Column) -> Column:
            flat = (match.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(match).bitwiseOR(down).bitwiseAND(mask)
            return _let(flat, settle)

        def settle(flat: Column) -> Column:
            right = down.bitwiseOR(F.bitwise_not(flat.bitwiseOR(up)).bitwiseAND(mask))
            left = F.shiftleft(flat.bitwiseAND(up), 1)
            stays = F.shiftright(flat, edits).bitwiseAND(F.call_function("shiftleft", long(1), gap)).cast("boolean").cast("int")
            return _let(
                F.shiftleft(right, 1),
                lambda raised: F.struct(
                    left.bitwiseOR(F.bitwise_not(flat.bitwiseOR(raised))).bitwiseAND(mask).alias("up"),
                    raised.bitwiseAND(flat).alias("down"),
                    (state["score"] + 1 - stays).alias("score"),
                ),
            )

        return F.when(state["score"] > edits, state).otherwise(_let(match, advance))

    begin = F.struct(long(full & ~((1 << (edits + 1)) - 1)).alias("up"), long((1 << (edits + 1)) - 1).alias("down"), gap.alias("score"))
    # Most pairs part early, and steps cannot end before their sequence does.
    few = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(FIRST_COLUMNS))), begin, column)
    rest = lambda s: F.aggregate(F.sequence(F.lit(FIRST_COLUMNS + 1), n), s, column, lambda t: t["score"])
    return F.when(n == 0, gap).otherwise(_let(few, lambda s: F.when((s["score"] > edits) | (n <= FIRST_COLUMNS), s["score"]).otherwise(rest(s))))


def line_distance(x: Column, y: Column, edits: int = EDITS) -> Column:
    """Edit distance of two lines, y not shorter and by at most `edits`; anything above `edits` is just larger.

    Common ends are cut off first. Every part is bound once, so that no step is computed anew
    where its result is used.
    """
    n = F.char_length(x)

    def characters(line: Column, front: Column, back: Column) -> Column:
        inner = F.substring(line, front + 1, F.char_length(line) - front - back)
        return F.regexp_extract_all(inner, F.lit("(?s)."), F.lit(0))

    def cut(front: Column) -> Column:
        back = common_prefix(F.reverse(x), F.reverse(y), n - front)
        return _let(back, lambda back: _let(F.struct(characters(x, front, back).alias("x"), characters(y, front, back).alias("y")), lambda p: _band(p["x"], p["y"], edits)))

    return _let(common_prefix(x, y, n), cut)


def verified(pairs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The rows of `pairs` (a, b, x, y: lines, y not shorter) within the edits that x allows.

    Pairs are few bytes but much work each, so they are dealt evenly over the tasks.
    """
    dealt = pairs.repartition(shuffle_partitions(pairs.sparkSession), "a", "b")
    return dealt.filter(line_distance(F.col("x"), F.col("y"), edits) <= allowed(F.char_length("x"), edits))


def line_links(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, blank: bool = True) -> DataFrame:
    """(a, b): ids (64-bit hashes) of different lines within the `allowed` edits of each other.

    Equal lines are collapsed first, with partial aggregation, so a line that a third of all
    documents share is one row. Texts are looked up for the lines in some candidate pair
    only: those are few where lines differ, and picked by a broadcast when a count shows so.
    """
    different = lines_of(docs, least, blank).select("line").distinct()
    different = different.select(F.xxhash64("line").alias("id"), "line", F.char_length("line").alias("n"))
    pairs = stored(candidates(different, edits, least))
    wanted = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    found = stored(different.join(maybe_broadcast(wanted, wanted.count()), "id", "left_semi"))
    one = found.select(F.col("id").alias("a"), F.col("line").alias("x"))
    two = found.select(F.col("id").alias("b"), F.col("line").alias("y"))
    return stored(verified(pairs.join(one, "a").join(two, "b"), edits).select("a", "b"))


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, blank: bool = True) -> DataFrame:
    """One row for each line of at least `least` characters, those that `lines_of` gives.

    Columns: doc_id, line_no (from 0), n_chars, class_doc_id and class_line_no (the first
    place, by doc_id and line_no, of a line that can be reached over links), n_links
    (different lines within the `allowed` edits) and kept (whether the line is that first
    place). Null and empty texts have no line but, with `least` 0, an empty one. Rows of the same doc_id count as one document, so
    lines at equal places are kept alike. Columns besides doc_id and text are ignored.
    """
    return placed_classes(docs, edits, least, blank).drop("key")


def placed_classes(docs: DataFrame, edits: int, least: int, blank: bool) -> DataFrame:
    """`line_classes` plus `key`, the hash of the whole text, which tells rows of equal identifiers apart."""
    links = line_links(docs, edits, least, blank)
    both = links.select("a").union(links.select("b")).withColumnRenamed("a", "id")
    degrees = both.groupBy("id").agg(F.count("*").alias("n_links"))
    linked = stored(components(links).withColumnRenamed("node", "id").join(degrees, "id"))
    places = lines_of(docs, least, blank, key=True).select("doc_id", "key", "line_no", F.char_length("line").alias("n_chars"), F.xxhash64("line").alias("id"))
    placed = stored(
        places.join(maybe_broadcast(linked, linked.count()), "id", "left").select(
            "doc_id", "key", "line_no", "n_chars", F.coalesce("component", "id").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
        )
    )
    # Lines of a kind of their own are their first place. The others' first places are stored
    # before they are joined: a class that holds a third of all lines can then be split.
    here = F.struct("doc_id", "line_no")
    firsts = placed.groupBy("class").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = stored(firsts)
    found = placed.join(maybe_broadcast(firsts, firsts.count()), "class", "left").withColumn("first", F.coalesce("first", here))
    return found.select(
        "doc_id",
        "line_no",
        "n_chars",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"),
        "n_links",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"),
        "key",
    )


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = 0) -> DataFrame:
    """`docs` without the lines that are copies or near copies of an earlier line.

    Short lines of white space part paragraphs and stay.

    All columns stay; `text`, and `n_chars` where it exists, are those of the lines left.
    A document that loses every line goes, blank ones aside; one that had none to lose stays as it is.
    Rows with the same identifier and text count as one, and lines at equal places of rows with
    the same identifier (or with none) as equally early. The numbers of a text's lost lines are
    taken out of the numbers of all its lines by a hash set, so the work is linear in its lines;
    a row holds its text and both lists of numbers. An empty table stays empty, and columns that
    have the names used here keep their values.
    """
    gone_from, gone_key, gone, kept = (unused(name, docs) for name in ("gone_from", "gone_key", "gone", "kept"))
    repeated = placed_classes(docs, edits, least, blank=False).filter("NOT kept")
    by_document = repeated.groupBy(F.col("doc_id").alias(gone_from), F.col("key").alias(gone_key)).agg(F.collect_set("line_no").alias(gone))
    text = docs["text"].cast("string")
    held = docs.join(by_document, docs["doc_id"].cast("long").eqNullSafe(F.col(gone_from)) & (text_key(text) == F.col(gone_key)), "left")
    numbers = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = _let(F.split("text", "\n"), lambda lines: F.transform(numbers(lines), lambda k: F.get(lines, k)))
    held = held.withColumn(kept, F.when(F.col(gone).isNotNull(), left)).filter(F.col(gone).isNull() | F.exists(kept, _says))
    held = held.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        changed = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        held = held.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(changed))
    return held.select(*docs.columns)
