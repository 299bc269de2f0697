"""Phrase mining against a plain count of everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerforge.llm import phrase_mining


def plain(rows, least, cover=50, most=2000):
    seen = {}
    for lang, text in rows:
        own = seen.setdefault("und" if lang is None else lang, Counter())
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = [w for w in re.split("[ \t]", piece) if w]
            own.update(tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    for lang, f in seen.items():
        total, found = sum(c for p, c in f.items() if len(p) == 1), []
        for p, a in f.items():
            if len(p) == 1 or a < least or any(100 * c >= cover * a for q, c in f.items() if len(q) > len(p) and c >= least and p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            yield lang, rank, phrase.decode(), -a, left, right, total, -score


@pytest.fixture(scope="module")
def rows(texts):
    dice = random.Random(11)
    words = ["the", "of", "new", "York", "city", "ça", "naïve", "中文", "\x0bx", "a b", " ", "hot", "dog", "stand"]
    made = [(dice.choice(["en", "fr", None, "und", ""]), " ".join(dice.choice(words) + dice.choice(["", "", "", "", ".", "\t", "\n", "  "]) for _ in range(dice.randrange(0, 90)))) for _ in range(250)]
    return [*made, *[("en", t) for _, t in texts], ("en", "hot dog " * 20_000), ("fr", None), *[("fr", "one same text of six words")] * 40]


@pytest.fixture(scope="module")
def table(spark, rows):
    """With further columns whose names the operator uses itself."""
    return spark.createDataFrame([(k % 7, t, lang, 0, 0, "k") for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, shard int, hash long, phrase string").repartition(5)


@pytest.mark.parametrize("least,shards", [(10, 3), (2, 1), (4, 5)])
def test_collocations(table, rows, least, shards, monkeypatch):
    monkeypatch.setattr(phrase_mining, "SLICE", 20_000)
    made = sorted(map(tuple, phrase_mining.collocations(table, least=least, shards=shards).collect()))
    expected = sorted(plain(rows, least))
    assert made == expected and len(made) > 40


def test_the_best_of_each_language(table, rows):
    assert sorted(map(tuple, phrase_mining.collocations(table, most=7).collect())) == sorted(plain(rows, 10, most=7))


def test_full_bitmaps_lose_nothing(table, rows, monkeypatch):
    monkeypatch.setattr(phrase_mining, "FILTER_LOG", 6)
    assert sorted(map(tuple, phrase_mining.collocations(table).collect())) == sorted(plain(rows, 10))


def test_large_counts_are_exact(spark, monkeypatch):
    """Products beyond 64 bits, from counts that no table of a test could have."""
    a, n = 3_000_000_019, 9_000_000_000_000_000
    words = spark.createDataFrame([("en", "p", n), ("en", "q", n - 2)], "lang string, phrase string, n long")
    phrases = spark.createDataFrame([(2, "en", "p q", a)], "length int, lang string, phrase string, n long")
    monkeypatch.setattr(phrase_mining, "phrase_counts", lambda *_: (words, phrases))
    assert tuple(phrase_mining.collocations(words).first()) == ("en", 1, "p q", a, n, n - 2, 2 * n - 2, 1000000 * a * a // (n * (n - 2)))


def test_empty_table(table):
    assert phrase_mining.collocations(table.limit(0)).collect() == []


def test_first_scan_of_each_hash():
    bitmap = lambda *bits: (np.array([sum(1 << b for b in bits)], np.uint64))
    found = phrase_mining.since([(0, 6, bitmap(3)), (2, 6, bitmap(3, 9))], np.array([3, 9, 10], np.uint64) << np.uint64(4), 10)
    assert found.tolist() == [0, 2, phrase_mining.NEVER]
