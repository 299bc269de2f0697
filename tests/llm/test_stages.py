"""Stages and operators over odd rows, clashing columns and several blocks, against plain versions."""

import gc
import hashlib
import itertools
import math
import random
import struct
import tracemalloc
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import grouped, shingles, similar
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerforge.llm import components, language_id, ngram_join, packing, sorted_tables, span_hashes, tokenizing, toxicity, transport_streams
from ledgerforge.llm.common import read_table, with_text_column

BYTE = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the stages would take for columns of their own.
CLASHING = ("toxic_score", "lang_share", "gone", "gone_from", "kept", "gone_id", "gone_key", "key", "line_hash", "held_out")


@pytest.fixture(scope="module")
def crowded(docs):
    """The odd texts with all those columns, null in each."""
    return docs.select("*", *[F.lit(None).cast("string").alias(name) for name in CLASHING])


def kept_rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_take_empty_tables(spark, crowded, sf):
    empty = crowded.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, empty, sf)
        assert made.columns == empty.columns and made.collect() == [], name
    assert corpus_pipeline.pack_sequences(spark, empty, sf).collect() == []


def test_language_stage_keeps_what_has_letters(spark, crowded, texts, sf):
    made = corpus_pipeline.drop_unknown_language(spark, crowded, sf)
    assert made.columns == crowded.columns
    assert kept_rows(made) == Counter((i, t) for i, t in texts if any(c.isalpha() for c in t or ""))


def test_near_copy_stage_against_brute_force(spark, crowded, texts, sf):
    made = corpus_pipeline.drop_near_copies(spark, crowded, sf)
    assert made.columns == crowded.columns
    sets = {i: shingles(t) for i, t in texts if i is not None}
    group = grouped(sorted(sets), [(i, j) for i, j in itertools.combinations(sorted(sets), 2) if similar(sets[i], sets[j])])
    assert kept_rows(made) == Counter((i, t) for i, t in texts if i is None or group[i] == i)


def test_toxic_stage_against_plain_scores(spark, crowded, texts):
    dice = random.Random(5)
    rows = []
    for k in range(200):
        own = [dice.choice("alpha beta gamma delta line one text here".split()) for _ in range(12)]
        rows.append((" ".join([*own, "vile"] if k % 2 else own), k % 2))
    model = toxicity.fit(rows)

    def plain(text):
        hit = {model.index[f] for w in toxicity.words(text or "") for f in toxicity.features_of(w) if f in model.index}
        return 1 / (1 + math.exp(-model.bias - sum(model.weights[k] for k in hit)))

    added = spark.createDataFrame([(500, "such a vile thing"), (501, "VILE.")], "doc_id long, text string")
    asked = crowded.unionByName(added, allowMissingColumns=True)
    made = toxicity.keep_below(asked, model, 0.5)
    assert made.columns == crowded.columns
    expected = Counter((i, t) for i, t in [*texts, (500, "such a vile thing"), (501, "VILE.")] if plain(t) < 0.5)
    assert kept_rows(made) == expected and not {500, 501} & {i for i, _ in expected}
    assert len(expected) > len(texts) // 2


def test_held_out_documents(spark, sf):
    """What the models say of documents they did not learn from."""
    folder = sf.replace("sf0.001", "sf0.01")
    docs = read_table(spark, folder, "documents")
    known = language_id.language_id(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'")
    right, total = known.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert total > 100 and right >= 0.98 * total
    labels = read_table(spark, folder, "labels")
    scored = toxicity.toxicity(docs, labels).filter("held_out").join(labels.filter("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id")
    right, total = scored.agg(F.sum((F.col("toxic") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert total > 50 and right >= 0.93 * total


def plain_fingerprint(text):
    """From every window's own sum, in Python integers."""
    points = [ord(c) + 1 for c in text]
    width, full = min(span_hashes.WINDOW, len(points)), 1 << 64
    least = {}
    for i in range(len(points) - width + 1 if width else 0):
        mixed = 0
        for base, prime in zip(span_hashes.BASES, span_hashes.PRIMES):
            value = 0
            for c in reversed(points[i : i + width]):
                value = (value * base + c) % prime
            mixed = mixed << 31 | value
        mixed ^= mixed >> 31
        mixed = mixed * 0x9E3779B97F4A7C15 % full
        mixed ^= mixed >> 29
        mixed = mixed * 0xBF58476D1CE4E5B9 % full
        mixed ^= mixed >> 32
        least[mixed >> 58] = min(least.get(mixed >> 58, full), mixed)
    return [least[k] >> 16 & 0xFFFF if k in least else None for k in range(64)]


def plain_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_fingerprints_against_plain_sums(docs, texts):
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    shown = lambda p: "".join("----" if d is None else f"{d:04x}" for d in p)
    expected = Counter()
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        own, other, after = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(following)
        expected[(i, shown(own), shown(other), plain_likeness(own, other), plain_likeness(own, after))] += 1
    found = span_hashes.span_fingerprints(docs).select("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert Counter(map(tuple, found)) == expected


def test_stored_streams_are_what_is_described(docs):
    media = {(r["doc_id"], r["n_bytes"]): bytes(r["media"]) for r in transport_streams.to_streams(docs).collect()}
    for r in transport_streams.media_columns(docs).collect():
        raw = media[r["doc_id"], r["n_bytes"]]
        assert r["media_bytes"] == len(raw) == 188 * r["n_packets"] and all(raw[k] == 0x47 for k in range(0, len(raw), 188))
        assert r["media_sha256"] == hashlib.sha256(raw).hexdigest()
        payload = b"".join(u.data for u in transport_streams.demultiplex(raw).units)
        shares = [1000 * sum(b >> 5 == k for b in payload) // len(payload) for k in range(8)]
        assert r["feature"].endswith("h" + ".".join(map(str, shares))) and r["feature"].startswith(f"p{len(raw) // 188}u{r['n_units']}t")


def test_shingles_do_not_depend_on_blocks(texts, monkeypatch):
    column = pa.array([t or "" for _, t in texts])
    whole = [s.tolist() for s in ngram_join.shingle_sets(column)]
    assert [len(s) for s in whole] == [len(shingles(t)) for _, t in texts]
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 64)
    assert [s.tolist() for s in ngram_join.shingle_sets(column)] == whole
    assert [s.tolist() for s in ngram_join.shingle_sets(column.slice(5, 9))] == whole[5:14]


def test_components_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 200)
    dice = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        own = list(base) if k % 2 else [f"v{k}x{m}" for m in range(40)]
        for _ in range(dice.randint(0, 3)):
            own[dice.randrange(len(own))] = f"x{dice.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    expected = grouped(sorted(sets), [(i, j) for i, j in itertools.combinations(sorted(sets), 2) if similar(sets[i], sets[j])])
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


def test_many_blocks_of_a_sorted_table(spark):
    dice = random.Random(2)
    rows = [(1000 * k - 30_000, " ".join(f"{dice.randrange(10**6)} word{dice.randrange(99)}" for _ in range(400))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = sorted_tables.write_tables(docs, BYTE, shards=1).cache()
    tokenizer = Tokenizer.from_file(BYTE)
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    # Twice the block size at least, in one shard.
    assert 4 * sum(map(len, ids.values())) > 2 * 65536
    start, expected = 0, Counter()
    for i in sorted(ids):
        expected[(i, start, len(ids[i]), zlib.crc32(struct.pack(f"<{len(ids[i])}I", *ids[i])))] += 1
        start += len(ids[i])
    assert Counter(map(tuple, sorted_tables.read_tables(manifest).collect())) == expected
    asked = spark.createDataFrame([(i + d,) for i, _ in rows[::7] for d in (0, 1)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in sorted_tables.lookup(spark, manifest, asked).collect()}
    assert found == {i: ids[i] for i, _ in rows[::7]}


def test_contracted_links_connect_what_they_did(spark):
    """Components, and edges contracted by a step or two, against a search over random graphs, chains and a hub."""
    draw = random.Random(5)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(30)] + [(2000, 2001 + i) for i in range(200)] + [(7, 7), *[(2000, 2001)] * 3]

    def least(pairs):
        near, found = {}, {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for start in sorted(near):
            todo = [] if start in found else [start]
            while todo:
                node = todo.pop()
                if node not in found:
                    found[node] = start
                    todo += near[node]
        return found

    real = [(a, b) for a, b in edges if a != b]
    table = spark.createDataFrame(edges, "a long, b long")
    expected = least(real)
    assert {r["node"]: r["component"] for r in components.components(table).collect()} == expected
    for steps in (1, 2):
        stars = components.contracted(table, steps)
        kept = [(r["high"], r["low"]) for r in stars.collect()]
        assert len(kept) <= len(set(real)) and least(kept) == expected
        named = {r["node"]: r["component"] for r in components.labels(stars).collect()}
        assert all(expected[node] == expected[to] for node, to in named.items())
    assert components.components(table.limit(0)).count() == 0


def test_sets_of_a_shingle_in_many_sets_meet_without_a_row_for_each_pair(spark, monkeypatch):
    """Seventy unlike texts share most of their shingles; a few are near copies of one of them."""
    base = " ".join(f"w{k}" for k in range(84))
    rows = [(k, base + " " + " ".join(f"u{k}x{j}" for j in range(20))) for k in range(70)]
    rows += [(100 + k, rows[k][1] + " more") for k in (0, 30, 69)] + [(200, rows[30][1] + " other words")]
    met = []

    def across(left, plain=ngram_join._across):
        met.append(left.groupBy("token").count().agg(F.max("count")).first()[0] or 0)
        return plain(left)

    monkeypatch.setattr(ngram_join, "_across", across)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)  # links are found by this step alone
    monkeypatch.setattr(ngram_join, "CELL_HASHES", 2000)  # and in several parts
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: {100: 0, 130: 30, 169: 69, 200: 30}.get(k, k) for k, _ in rows}
    assert met and met[0] < 64


@pytest.mark.parametrize("sides", [1, 2])
def test_links_of_a_crowd_against_all_pairs(monkeypatch, sides):
    monkeypatch.setattr(ngram_join, "MATRIX", 100)
    rng = np.random.default_rng(3)
    sets = {s: np.unique(rng.choice(14, rng.integers(1, 14), replace=False)).astype(np.uint64) for s in range(40)}
    one, two = (list(sets), []) if sides == 1 else (list(range(15)), list(range(15, 40)))

    def groups(links):
        label = {s: s for s in sets}
        for _ in sets:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    pairs = [(a, b) for a in one for b in two or one if a < b and ngram_join.similar(sets[a], sets[b])]
    links = ngram_join.crowd_links(one, two, sets)
    assert set(links) <= set(pairs) and len(links) < len(pairs) and groups(links) == groups(pairs)
    assert ngram_join.crowd_links([1], [], sets) == [] and ngram_join.crowd_links([1], [2], {1: sets[1] + np.uint64(50), 2: sets[2]}) == []


def test_scores_of_words_take_little_memory_and_do_not_depend_on_the_parts(monkeypatch):
    rng = random.Random(4)
    own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rng.randint(1, 40))) for _ in range(900)]
    lines = [" ".join(rng.choices(own[k * 100 : k * 100 + 100], k=300)) for k in range(8)]
    model = language_id.fit([(f"l{k}", line) for k, line in enumerate(lines)], {f"l{k}": 1 for k in range(8)})
    words = language_id.words_of(lines * 25)
    tracemalloc.start()
    whole = language_id.word_scores(model, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words.points) > 1_000_000 and peak < 40 * len(words.points)
    for places in (1, 50, 1 << 30):
        monkeypatch.setattr(language_id, "PLACES", places)
        parts = language_id.word_scores(model, language_id.words_of(lines))
        assert (parts == whole[: len(parts)]).all()


def test_texts_become_strings_a_slice_at_a_time(spark):
    rows = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('four', 1000)").alias("text"))
    sized = with_text_column(rows, lambda texts: [len(texts)] * len(texts), pa.int64(), "together")
    found = sized.agg(F.count("*"), F.sum(F.length("text")), F.max("together")).first()
    assert found[0] == 4000 and found[1] == 16_000_000 and found[2] * 4000 <= 5 << 20


def test_python_tasks_get_few_bytes_at_a_time_unless_the_session_has_a_limit(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(4000, numPartitions=1).select(F.expr("repeat('four', 1000)").alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"]) for b in batches)
    spark.conf.unset(limit)
    try:
        with_text_column(rows, len, pa.int64(), "n")
        assert rows.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0] <= 5 << 20
        sized = with_text_column(rows, lambda texts: [len(texts)] * len(texts), pa.int64(), "together")
        assert sized.agg(F.max("together")).first()[0] * 4000 <= 5 << 18
        spark.conf.set(limit, 3 << 20)
        with_text_column(rows, len, pa.int64(), "n")
        assert spark.conf.get(limit) == str(3 << 20)
    finally:
        spark.conf.unset(limit)


def test_a_worker_lets_go_of_what_it_kept_for_another_stage(monkeypatch):
    monkeypatch.setattr(tokenizing, "_OF_WORKER", {})
    kept = weakref.ref(tokenizing.of_worker("one", lambda: toxicity.Scorer(toxicity.Classifier({}, np.zeros(0), 0.0))))
    gc.disable()
    try:
        tokenizing.of_worker("two", lambda: 2)
        assert kept() is None
    finally:
        gc.enable()


def test_packing_encodes_a_small_block_of_texts_at_a_time(spark, docs, tmp_path, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = Counter(map(tuple, packing.pieces_of(docs, path).select(kept).collect()))
    monkeypatch.setattr(packing, "BLOCK_BYTES", 64)
    assert Counter(map(tuple, packing.pieces_of(docs, path).select(kept).collect())) == whole
    monkeypatch.undo()

    class Together:
        """Gives each text as many ids as there are kilobytes of text in its block."""

        def __init__(self, _):
            pass

        def __call__(self, rows):
            return [bytes(4 * (sum(map(len, rows)) >> 10))] * len(rows)

    (tmp_path / "other.json").write_text("")
    monkeypatch.setattr(packing, "WordEncoder", Together)
    rows = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('four', 1000)").alias("text"))
    found = packing.pieces_of(rows, str(tmp_path / "other.json"), capacity=1 << 20).agg(F.count("*"), F.max("length")).first()
    assert found[0] == 4000 and found[1] <= 600
