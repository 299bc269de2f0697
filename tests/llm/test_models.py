"""The learned parts against plain versions: n-gram sums, spans, samples, and the loss with its gradient."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from ledgerforge.llm import language_id, toxicity

TEXTS = {
    "en": ["the house of the people was in the city", "and there they had their work with others every day"],
    "de": ["das haus der leute war in der stadt", "und dort hatten sie ihre arbeit mit den anderen jeden tag"],
    "ru": ["дом людей был в городе и там", "у них была работа с другими людьми каждый день"],
}


@pytest.fixture(scope="module")
def model():
    return language_id.fit([(k, t) for k, v in TEXTS.items() for t in v * 10], dict.fromkeys(TEXTS, 20))


def plain_words(text):
    """(begin, word) of each maximal run of letters."""
    out, begin = [], None
    for k, c in enumerate(language_id.lowered(text) + " "):
        if c.isalpha() and begin is None:
            begin = k
        elif not c.isalpha() and begin is not None:
            out.append((begin, language_id.lowered(text)[begin:k]))
            begin = None
    return out


def plain_bucket(gram):
    """The hash of an n-gram, character by character, in Python integers."""
    value = (ord(gram[0]) + 1) * 0x9E3779B1 % (1 << 32)
    for c in gram[1:]:
        value = (value ^ value >> 15) + ord(c) & 0xFFFFFFFF
        value = value * 0x85EBCA6B & 0xFFFFFFFF
    return value >> 32 - language_id.TABLE_BITS


def plain_grams(word):
    """(order, bucket) of the n-grams of a word and the blank before it: those that begin at either, and hold no other blank but the one behind."""
    around = f" {word} "
    for begin in range(len(around) - 1):
        for order in language_id.ORDERS:
            gram = around[begin : begin + order]
            if len(gram) == order and gram.strip():
                yield order, plain_bucket(gram)


def plain_scores(languages, word):
    """Sums of log-probabilities from counts in dictionaries."""
    counts = {lang: {o: Counter() for o in language_id.ORDERS} for lang in languages}
    for lang in languages:
        for text in TEXTS[lang] * 10:
            for _, w in plain_words(text):
                for order, bucket in plain_grams(w):
                    counts[lang][order][bucket] += 1
    size = 1 << language_id.TABLE_BITS
    log = lambda lang, o, b: math.log((counts[lang][o][b] + 0.1) / (sum(counts[lang][o].values()) + 0.1 * size))
    sums = dict.fromkeys(languages, 0.0)
    for o, b in plain_grams(word):
        mean = sum(log(lang, o, b) for lang in languages) / len(languages)
        for lang in languages:
            sums[lang] += log(lang, o, b) - mean
    return sums


def test_word_scores_against_dictionaries(model):
    asked = "the Stadt wörk x day"
    words = language_id.words_of([asked])
    found = language_id.word_scores(model, words)
    assert [(int(b) - 1, n) for b, n in zip(words.starts, words.lengths)] == [(b, len(w)) for b, w in plain_words(asked)]
    for row, (_, word) in zip(found, plain_words(asked)):
        expected = plain_scores(model.languages, word)
        for k, lang in enumerate(model.languages):
            if lang == "ru":
                assert row[k] == -1e6  # no Latin letters were seen in it
            else:
                assert abs(row[k] - expected[lang]) < 1e-3, word


def test_spans_have_places_and_posteriors(model):
    english, german = TEXTS["en"][0], TEXTS["de"][1]
    text = f"  {english}. 12 {german}! {TEXTS['ru'][0]}"
    found, none, sure = language_id.label_spans(model, [text, " 12 ", english])
    assert [(text[b:e], lang) for b, e, lang in found.spans] == [(english, "en"), (german, "de"), (TEXTS["ru"][0], "ru")]
    letters = {k: sum(c.isalpha() for c in t) for k, t in (("en", english), ("de", german), ("ru", TEXTS["ru"][0]))}
    assert found.language == "de" and abs(found.score - letters["de"] / sum(letters.values())) < 0.01
    assert (none.language, none.score, none.spans) == ("und", 0.0, []) and sure.score > 0.99 and sure.share == 1
    # Letters whose lower case is longer keep their places.
    odd = f"İİİ {english}"
    assert language_id.label_spans(model, [odd])[0].spans[-1][1] == len(odd)


def test_spans_of_rows(spark, model, docs, texts):
    rows = language_id.identify(docs, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts)
    for r in rows:
        assert r["spans"] == len(r["labelled"]) and 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not r["labelled"])
        assert all(a["end"] <= b["begin"] and a["lang"] != b["lang"] for a, b in zip(r["labelled"], r["labelled"][1:]))


def test_samples_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 40_000)
    monkeypatch.setattr(language_id, "LONGEST_SAMPLED", 5_000)
    rows = spark.createDataFrame([(k, "en" if k % 3 else "de", 1000 if k % 50 else 50_000) for k in range(2000)], "doc_id long, lang string, n_bytes long")
    sums = {r["lang"]: r["s"] for r in language_id.sampled(rows, "lang", 10_000).groupBy("lang").agg({"n_bytes": "sum"}).withColumnRenamed("sum(n_bytes)", "s").collect()}
    assert set(sums) == {"en", "de"} and all(10_000 < s < 80_000 for s in sums.values())
    monkeypatch.setattr(language_id, "SAMPLE_BYTES_ALL", 20_000)
    assert language_id.sampled(rows, "lang", 10_000).count() < 45


def test_gradient_against_differences():
    dice = random.Random(2)
    words = "good bad vile kind woman man muslim christian talk house run".split()
    sets = [({dice.choice(words) for _ in range(5)}, k % 2) for k in range(40)]
    index = {f: k for k, f in enumerate(sorted({f for s, _ in sets for w in s for f in toxicity.features_of(w)}))}
    problem = toxicity.Problem(sets, index, toxicity.IDENTITY_FAMILIES, 3.0)
    assert problem.p > 20
    params = np.random.default_rng(1).normal(0, 0.5, len(index) + 1)
    gradient = problem.gradient(params)
    for k in range(len(params)):
        step = np.zeros(len(params))
        step[k] = 1e-5
        slope = (problem.loss(params + step) - problem.loss(params - step)) / 2e-5
        assert abs(slope - gradient[k]) < 1e-6, k


def test_loss_against_plain_sums():
    sets = [({"vile", "woman"}, 1), ({"kind"}, 0), ({"man", "kind"}, 0)]
    index = {"vile": 0, "woman": 1, "man": 2, "kind": 3}
    problem = toxicity.Problem(sets, index, (("woman", "man"),), 2.0)
    w, bias = [0.7, -0.2, 0.4, -1.1], 0.3
    score = lambda found: 1 / (1 + math.exp(-bias - sum(w[index[x]] for x in found if x in index)))
    likely = -(1.5 * math.log(score(sets[0][0])) + 0.75 * (math.log(1 - score(sets[1][0])) + math.log(1 - score(sets[2][0])))) / 3
    # Each named term is moved on by one and by two within its family of two.
    swaps = [({"vile", "woman"}, {"vile", "man"}), ({"vile", "woman"}, {"vile", "woman"}), ({"man", "kind"}, {"woman", "kind"}), ({"man", "kind"}, {"man", "kind"})]
    change = 2.0 * sum((score(a) - score(b)) ** 2 for a, b in swaps) / 4
    ridge = toxicity.RIDGE * sum(x * x for x in w) / 2 / 2
    assert abs(problem.loss(np.array([*w, bias])) - likely - change - ridge) < 1e-9
