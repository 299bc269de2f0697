"""Every operator against a brute-force version, on small texts with every odd case."""

import hashlib
import itertools
import re
import struct
import zlib
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerforge.llm import catalog, language_id, line_dedup, ngram_join, packing, sorted_tables, span_hashes, toxicity, transport_streams
from ledgerforge.llm.bpe_codec import bpe_round_trip
from ledgerforge.llm.token_counts import prove_whole_tokens, token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def grouped(pairs, links):
    """Smallest member of the group of every item."""
    parent = {x: x for x in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in pairs}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_classes(docs, texts):
    lines = {}
    for doc_id, text in texts:
        for k, line in enumerate((text or "").split("\n")):
            if len(line) >= line_dedup.LEAST_CHARS:
                lines.setdefault(line, set()).add((doc_id is not None, doc_id if doc_id is not None else 0, k))
    names = sorted(lines)
    links = [(a, b) for a, b in itertools.combinations(names, 2) if abs(len(a) - len(b)) <= 2 and edit_distance(a[:400], b[:400]) <= 2 and a[400:] == b[400:]]
    group = grouped(names, links)
    first = defaultdict(lambda: (True, 10**9, 0))
    for line in names:
        first[group[line]] = min(first[group[line]], min(lines[line]))
    degree = Counter(x for pair in links for x in pair)
    expected = Counter()
    for doc_id, text in texts:
        for k, line in enumerate((text or "").split("\n")):
            if line in lines:
                known, f_id, f_no = first[group[line]]
                f_id = f_id if known else None
                expected[(doc_id, k, len(line), f_id, f_no, degree[line], doc_id == f_id and k == f_no)] += 1
    assert Counter(map(tuple, line_dedup.line_classes(docs).collect())) == expected


def test_short_lines_have_rows(spark):
    rows = [(1, "Yes.\n\nshort line here\nYes"), (2, "Yes.\n\nshort line herd\nshirt line hard"), (3, "Yes.\n"), (4, "\n"), (5, "a line of 20 letters\na line of 20 letter")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["n_links"], r["kept"]) for r in line_dedup.line_classes(docs, least=0).collect()}
    assert len(found) == sum(text.count("\n") + 1 for _, text in rows)
    assert found[2, 0] == found[3, 0] == (1, 0, 0, False) and found[1, 3] == (1, 3, 0, True)
    assert found[1, 2] == (1, 2, 1, True) and found[2, 2] == (1, 2, 1, False) and found[2, 3] == (2, 3, 0, True)
    assert found[5, 0] == (5, 0, 1, True) and found[5, 1] == (5, 0, 1, False) and found[4, 1] == (1, 1, 0, False)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(docs).collect()}
    assert kept == {1: rows[0][1], 2: "\nshirt line hard", 4: "\n", 5: "a line of 20 letters"}


def test_every_line_matches_duckdb(spark, sf):
    import duckdb

    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    theirs = connection.sql(catalog.ORACLE_SQL["op1_line_dedup_all"]).fetchall()
    assert Counter(map(tuple, catalog.QUERIES["op1_line_dedup_all"](spark, sf).collect())) == Counter(theirs)


def test_repeated_lines_go(docs, no_docs):
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows[15]["text"] == "line one of some length here\nline two of some length here"
    assert rows[16]["text"] == "short" and rows[16]["n_chars"] == 5
    assert 4 not in rows and rows[0]["text"] is None and rows[1]["text"] == ""
    assert line_dedup.without_repeated_lines(no_docs).collect() == []


def test_repeated_lines_of_rows_without_identifier(spark):
    """Rows without identifier, and rows that share one, lose their own lines; further columns keep their values."""
    line = "a line that many documents of this table have"
    rows = [(None, f"{line}\nown words of the first row\n{line}"), (None, f"own words of the second row\n{line}"), (3, f"{line}\nleft alone"), (3, f"other words of the row\n{line}"), (4, line)]
    names = ["gone_from", "gone_key", "gone", "kept", "key", "line_no", "line", "class", "n"]
    docs = spark.createDataFrame([(*r, *range(9)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    made = line_dedup.without_repeated_lines(docs)
    assert made.columns == docs.columns
    # The first place is line 0 of a row without identifier, as it sorts before all others.
    expected = Counter([(None, f"{line}\nown words of the first row"), (None, "own words of the second row"), (3, "left alone"), (3, "other words of the row")])
    found = made.collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == expected and all(tuple(r)[2:] == tuple(range(9)) for r in found)
    # Of two rows with one identifier both keep a line at its first place.
    twice = spark.createDataFrame([(1, f"{line}\na"), (1, f"{line}\nb")], "doc_id long, text string")
    assert Counter(r["text"] for r in line_dedup.without_repeated_lines(twice).collect()) == Counter([f"{line}\na", f"{line}\nb"])


def test_many_repeated_lines_of_one_document(spark):
    lines = [f"line number {k} of a long text, unlike others {k * 7919 % 10007}" for k in range(30_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*lines[::-1], "and one line of its own here"]))], "doc_id long, text string")
    made = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(docs, edits=0).collect()}
    assert made == {1: "\n".join(lines), 2: "and one line of its own here"}


def test_transport_streams(docs, texts):
    rows = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["n_faults"]) for r in transport_streams.media_columns(docs).collect())
    expected = Counter()
    for doc_id, text in texts:
        raw = (text or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        expected[(doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), 0)] += 1
    assert rows == expected


def test_damaged_stream():
    payload = bytes(range(256)) * 40
    media = transport_streams.multiplex(payload)
    found = transport_streams.demultiplex(media)
    assert b"".join(u.data for u in found.units) == payload and not found.faults
    assert [u.pts for u in found.units] == [3600 * k for k in range(5)] and [u.random_access for u in found.units] == [True, False, False, False, False]
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    repeated = transport_streams.demultiplex(b"".join(packets[:6] + packets[5:]))
    assert repeated.faults == {"repeated": 1} and b"".join(u.data for u in repeated.units) == payload
    lost = transport_streams.demultiplex(b"".join(packets[:6] + packets[7:]))
    assert lost.faults["gap"] == 1
    broken = bytearray(media)
    broken[20] ^= 255
    assert transport_streams.demultiplex(bytes(broken)).faults["checksum"] == 1
    assert transport_streams.demultiplex(b"\x46" * 188).faults == {"sync": 1}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def similar(a, b):
    return bool(a) and 100 * len(a & b) >= 75 * len(a | b)


def test_ngram_components(docs, texts):
    ids = sorted({i for i, _ in texts if i is not None})
    sets = [(i, shingles(t)) for i, t in texts]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if i is not None and j is not None and i != j and similar(a, b)]
    group = grouped(ids, links)
    expected = Counter((i, len(s), group.get(i)) for i, s in sets)
    assert Counter(map(tuple, ngram_join.ngram_components(docs).collect())) == expected


def test_many_near_copies(spark):
    """A chain and a star of near copies, with outliers that share passages."""
    import random

    random.seed(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(random.randint(0, 9)):
            words[random.randrange(len(words))] = f"x{random.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, " ".join(base[: 20 + k] + [f"y{k}{m}" for m in range(40)])) for k in range(20)]
    sets = [(i, shingles(t)) for i, t in rows]
    group = grouped([i for i, _ in rows], [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if similar(a, b)])
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == group


def test_token_counts(docs, texts):
    expected = Counter((i, len((t or "").encode()), len(ids_of(WORD, t)), len(ids_of(WORD, t)) > 2048) for i, t in texts)
    assert Counter(map(tuple, token_counts(docs, WORD).collect())) == expected
    whole = prove_whole_tokens(open(WORD, encoding="utf-8").read())
    assert "the" in whole and all(len(ids_of(WORD, t)) == 1 for t in sorted(whole)[:200])


def test_round_trip(docs, texts):
    tokenizer = Tokenizer.from_file(WORD)
    expected = Counter()
    for i, t in texts:
        ids = ids_of(WORD, t)
        expected[(i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe_round_trip(docs, WORD).collect())) == expected


def test_sorted_tables(docs, texts, spark):
    keyed = sorted((i, [*ids_of(BYTE, t), 0]) for i, t in texts if i is not None)
    start, expected = 0, Counter()
    for i, ids in keyed:
        expected[(i, start, len(ids), zlib.crc32(packed(ids)))] += 1
        start += len(ids)
    manifest = sorted_tables.write_tables(docs, BYTE, shards=3).cache()
    assert Counter(map(tuple, sorted_tables.read_tables(manifest).collect())) == expected
    asked = spark.createDataFrame([(3,), (14,), (-5,), (999,), (-999,)], "doc_id long")
    found = sorted((r["doc_id"], r["ids"]) for r in sorted_tables.lookup(spark, manifest, asked).collect())
    assert found == sorted((i, ids) for i, ids in keyed if i in (3, 14, -5))


def test_packing(docs, texts):
    rows = packing.packed_documents(docs, WORD).collect()
    expected = Counter()
    for i, t in texts:
        ids = [*ids_of(WORD, t), 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[(i, piece, at, len(part), zlib.crc32(packed(part)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    total = 0
    for _, own in itertools.groupby(sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows), key=lambda r: r[0]):
        at = 0
        for _, offset, length in own:
            assert offset == at
            at += length
        assert at <= 2048
        total += 1
    assert total == -(-sum(r["length"] for r in rows) // 2048)


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece(seed):
    import random

    random.seed(seed)
    histogram = Counter(random.choice([random.randint(1, 100), random.randint(30, 60)]) for _ in range(300))
    bins = packing.plan_bins(histogram, 100)
    held = Counter()
    for filling, times in bins:
        assert sum(length * n for length, n in filling) <= 100
        for length, n in filling:
            held[length] += n * times
    assert held == histogram
    best_fit = sum(t for _, t in packing._best_fit(histogram, 100))
    assert sum(t for _, t in bins) <= best_fit


def test_completion_beats_best_fit():
    histogram = {70: 300, 69: 300, 66: 300, 100: 50, 103: 50, 34: 100}
    least = -(-sum(l * n for l, n in histogram.items()) // 204)
    assert least <= sum(t for _, t in packing.plan_bins(histogram, 204)) <= sum(t for _, t in packing._best_fit(histogram, 204))


def fewest_bins(pieces, capacity):
    """By trying every bin for every piece."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def place(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(pieces):
            best = len(bins)
            return
        for room in {b for b in bins if b + pieces[at] <= capacity}:
            k = bins.index(room)
            place(at + 1, [*bins[:k], room + pieces[at], *bins[k + 1 :]])
        place(at + 1, [*bins, pieces[at]])

    place(0, [])
    return best


def test_branching_over_bins_finds_the_fewest():
    import random

    dice = random.Random(11)
    missed_by_best_fit = 0
    for _ in range(300):
        capacity = dice.choice([20, 50, 100])
        pieces = [dice.randint(capacity // 6, capacity * dice.choice([5, 7, 10]) // 10) for _ in range(dice.randint(1, 10))]
        histogram, fewest = Counter(pieces), fewest_bins(pieces, capacity)
        assert packing.least_bins(*packing._columns(histogram), capacity) <= fewest
        assert sum(t for _, t in packing.plan_bins(histogram, capacity)) == fewest
        missed_by_best_fit += sum(t for _, t in packing._best_fit(histogram, capacity)) > fewest
    assert missed_by_best_fit


def test_fingerprints(docs, texts):
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = Counter()
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        expected[(i, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    rows = span_hashes.span_fingerprints(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == expected
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[3] == prints[4] != prints[7] and span_hashes.likeness(prints[3], prints[5]) > 0.6


def test_common_prefix_goes_past_a_block():
    points = span_hashes.code_points("abcdefgh" * 500)
    for cut in (0, 63, 64, 65, 3000, 3999):
        other = points.copy()
        other[cut] += 1
        assert span_hashes.common_prefix(points, other, 64) == cut
    assert span_hashes.common_prefix(points, points[:3001], 64) == 3001
    text, following = "ab" * 800_000, "c" * 800_000
    edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
    assert span_hashes.common_prefix(span_hashes.code_points(text), span_hashes.code_points(edited)) == len(text) - len(text) // 3 > span_hashes.BLOCK


def test_large_identifiers_keep_their_rows(spark):
    ids = [(1 << 62) + 1001 * k for k in range(200)] + [(1 << 63) - 1 - 2 * k for k in range(200)] + [-(1 << 62) - 1001 * k for k in range(200)]
    texts = {i: f"text {n} of some length" * 3 for n, i in enumerate(ids)}
    found = {r["doc_id"]: r["edited_sha256"] for r in span_hashes.span_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    order = sorted(ids, reverse=True)
    expected = {}
    for own, after in zip(order, [*order[1:], order[0]]):
        k = len(texts[own]) // 3
        expected[own] = hashlib.sha256((texts[own][: len(texts[own]) - k] + texts[after][:k]).encode()).hexdigest()
    assert found == expected


def test_prefix_hashes_compare_spans():
    a, b = "the quick brown fox jumps", "a quick brown fox sleeps"
    x, y = span_hashes.PrefixHashes(span_hashes.code_points(a)), span_hashes.PrefixHashes(span_hashes.code_points(b))
    for i, j in itertools.product(range(len(a)), range(len(b))):
        extension = 0
        while i + extension < len(a) and j + extension < len(b) and a[i + extension] == b[j + extension]:
            extension += 1
        assert x.extension(i, y, j) == extension


def test_languages(spark, docs, texts):
    english = "the house of the people was in the city and there they had their work with others"
    german = "das haus der leute war in der stadt und dort hatten sie ihre arbeit mit den anderen"
    russian = "дом людей был в городе и там у них была работа с другими людьми каждый день"
    spread = lambda text, k: " ".join(text.split()[k % 5 :] + text.split()[: k % 7])
    rows = [(k, spread((english, german, russian)[k % 3], k), ("en", "de", "ru")[k % 3]) for k in range(300)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(0, english), (1, german), (2, russian), (3, f"{english} {english} {german}"), (4, None), (5, "12 !"), (6, "中文字")]
    found = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [found[k]["lang_pred"] for k in (0, 1, 2, 3, 4, 5)] == ["en", "de", "ru", "en", "und", "und"]
    assert found[3]["spans"] == 2 and found[6]["lang_pred"] in ("en", "de", "ru") and found[4]["score"] == 0
    rows = language_id.language_id(docs).collect()
    assert len(rows) == len(texts) and all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_bilingual_documents_stay(spark):
    english = "the house with the green door was there and they thought that nothing would change this weather "
    german = "das haus mit der tür war dort und sie dachten nicht dass sich etwas ändern würde zwischen den zügen "
    russian = "и не что он на я с как это по но они мы "
    languages = {"en": english, "de": german, "ru": russian}
    model = language_id.fit([(k, v * 20) for k, v in languages.items()], dict.fromkeys(languages, 1))
    mixed = [english * 10 + german * n for n in range(8, 13)] + [(english * 8 + russian * n) for n in range(6, 26)]
    # The score is the share of the letters in spans of the language, as sure as those spans are.
    assert all(0.35 < score < 0.85 and spans == 2 for _, score, spans in language_id.predict(model, mixed))
    docs = spark.createDataFrame([(k, text) for k, text in enumerate([*mixed, "12 ...", ""])], "doc_id long, text string")
    assert {r["doc_id"] for r in language_id.keep_known(docs, model, 0.2).collect()} == set(range(len(mixed)))


def test_toxicity_learns_and_forgives(spark):
    import random

    random.seed(1)
    rows = []
    for k in range(600):
        words = [random.choice("we met today at school and talked about work with friends".split()) for _ in range(12)]
        bad = k % 3 == 0
        # Groups are named mostly in abusive texts, so that a plain classifier would blame them.
        if random.random() < (0.7 if bad else 0.05):
            words.insert(3, random.choice(["women", "muslim", "gay"]))
        if bad:
            words.insert(random.randrange(12), random.choice(["horrid", "vile", "rotten"]))
        rows.append((" ".join(words), int(bad)))
    plain, fair = toxicity.fit(rows, penalty=0.0), toxicity.fit(rows)
    neutral, abuse = "we met women at school today", "we met vile friends today"
    assert toxicity.Scorer(fair)(abuse) > 0.5 > toxicity.Scorer(fair)(neutral)
    assert toxicity.Scorer(fair)(neutral) < toxicity.Scorer(plain)(neutral)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(found[k]["predicted"], y) for k, (_, y) in enumerate(rows) if found[k]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert found[9000]["score"] == found[9001]["score"] < 0.5 and len(found) == 602


def test_empty_tables(no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for made in (
        line_dedup.line_classes(no_docs), transport_streams.media_columns(no_docs), ngram_join.ngram_components(no_docs), token_counts(no_docs, WORD),
        language_id.language_id(no_docs), sorted_tables.token_tables(no_docs, BYTE), packing.packed_documents(no_docs, WORD), toxicity.toxicity(no_docs, labels),
        bpe_round_trip(no_docs, WORD), span_hashes.span_fingerprints(no_docs),
    ):
        assert made.collect() == []


def test_scores_without_labels(docs, texts, spark):
    rows = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(rows) == len(texts) and all(0 < r["score"] < 1 for r in rows)


def test_queries_cover_their_tables(spark, sf):
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    whole = pd.read_parquet(f"{sf}/documents.parquet")
    counts = catalog.QUERIES["op4_token_counts"](spark, sf)
    assert counts.count() == len(whole)


def test_crowded_segments_lose_no_link(spark, monkeypatch):
    """With crowds of one line every pair must be found under the finest keys, as by brute force."""
    import random

    from ledgerforge.llm import line_dedup

    monkeypatch.setattr(line_dedup, "CROWDS", (1, 1, None))
    draw, lines = random.Random(11), set()
    for base in ("the quick brown fox jumps over a lazy dog", "abcdefghijklmnopqrstu", "ééé ßß naïve lines of odd letters, too", "twelve chars"):
        for _ in range(40):
            line = list(base)
            for _ in range(draw.randint(0, 3)):
                at = draw.randrange(len(line))
                line[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "e", "é"])
            lines.add("".join(line))
    lines = sorted(lines)
    found = line_dedup.line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), least=0).collect()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def limit(n):
        return 2 if n >= 20 else 1 if n >= 10 else 0

    for row in found:
        own = lines[row["doc_id"]]
        assert row["n_links"] == sum(distance(own, b) <= limit(min(len(own), len(b))) for b in lines if b != own and abs(len(b) - len(own)) <= 2), own


def test_a_second_model_frees_the_first():
    from ledgerforge.llm import tokenizing

    first = tokenizing.of_worker("one", object)
    assert tokenizing.of_worker("one", object) is first
    tokenizing.of_worker("two", object)
    assert list(tokenizing._OF_WORKER) == ["two"]


def test_remembered_pieces_are_bounded():
    from ledgerforge.llm.tokenizing import ENTRY_BYTES, Pieces

    pieces = Pieces(lambda new: [p.encode() for p in new], most=10 * ENTRY_BYTES)
    for k in range(40):
        assert pieces.values([f"a{k}", f"b{k}", "same"]) == [f"a{k}".encode(), f"b{k}".encode(), b"same"]
        assert len(pieces.new) <= 12 and len(pieces.old) <= 12


def test_spans_are_the_best_labelling():
    """Viterbi against all labellings of short documents."""
    import itertools

    import numpy as np

    from ledgerforge.llm.language_id import viterbi

    draw = np.random.default_rng(3)
    for _ in range(20):
        sizes = draw.integers(1, 6, 3)
        doc = np.repeat(np.arange(3), sizes)
        scores = draw.normal(0, 3, (len(doc), 3))
        labels = viterbi(scores, doc, 2.0)

        def total(own, chosen):
            return sum(own[k, c] for k, c in enumerate(chosen)) - 2.0 * sum(a != b for a, b in zip(chosen, chosen[1:]))

        for k in range(3):
            own, chosen = scores[doc == k], labels[doc == k].tolist()
            best = max(total(own, c) for c in itertools.product(range(3), repeat=len(own)))
            assert abs(total(own, chosen) - best) < 1e-9


def test_links_through_rows_without_identifier(spark):
    """1 and 3 are linked only over a text whose row has no identifier; copies without any identifier are thinned too."""
    from ledgerforge.llm.ngram_join import first_of_each, ngram_components

    words = [f"w{k}" for k in range(60)]
    middle, low, high = words, words[:50] + [f"x{k}" for k in range(3)], [f"y{k}" for k in range(3)] + words[10:]
    rows = [(1, " ".join(low)), (None, " ".join(middle)), (3, " ".join(high)), (None, "one text without any identifier here"), (4, "quite another text of six words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_components(docs).collect()}
    assert found[1, 49] == 1 and found[3, 49] == 1 and found[None, 56] == 1 and found[4, 2] == 4
    kept = sorted(r["text"] for r in first_of_each(docs).collect())
    assert kept == sorted([" ".join(low), rows[3][1], rows[4][1]])
