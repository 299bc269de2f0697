"""Operator 5: language identification with spans of mixed-language text.

Each maximal run of letters is a word. The script of its letters narrows the candidate
languages to those seen in that script while learning; each candidate gets the sum of
log-probabilities of the word's character n-grams. Viterbi over the words, with a penalty
for each switch, labels spans; the document takes the language with most letters.

The model is fitted on a bounded sample: of each language about `SAMPLE_PER_LANGUAGE` documents
or `SAMPLE_BYTES` of text, whichever is less (all, where there are fewer), chosen by a hash of the
identifier among texts of at most `LONGEST_SAMPLED` bytes; `SAMPLE_BYTES_ALL` bound all languages
together. Prediction reads every whole text and nothing else.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_one_task, texts, unused, with_text_column
from .tokenizing import blocks, of_worker

#: Documents of each language that the model is fitted on, in expectation.
SAMPLE_PER_LANGUAGE = 1500
#: Bytes of the sample's texts: of one value, of all values, and of one text.
SAMPLE_BYTES, SAMPLE_BYTES_ALL, LONGEST_SAMPLED = 16 << 20, 256 << 20, 1 << 20
#: Every so many-th remainder class of crc32(doc_id) is held out from learning.
FOLDS = 5
#: Log-probability lost by changing the language between two words.
SWITCH_PENALTY = 6.0
TABLE_BITS = 16
ORDERS = (1, 2, 3, 4)
#: A language keeps a script as its own when this share of its letters is in it.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: Letters labelled together, and places whose n-grams are summed together (a longer word is on its
#: own); they bound memory whatever the batch holds.
BLOCK_CHARS, PLACES = 4_000_000, 1 << 18

#: First code points of the ranges that tell scripts apart.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x30000, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPT_STARTS], np.int64)
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_SCRIPT_OF_RANGE = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS], np.int64)


def fold_of(column: str) -> F.Column:
    """crc32 of the identifier's text modulo `FOLDS`; a missing identifier counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def sampled(rows: DataFrame, label: str, each: int) -> DataFrame:
    """About `each` rows or `SAMPLE_BYTES` of every value of `label`, whichever is less.

    `rows` has doc_id and n_bytes. Rows are chosen by a hash of doc_id: one sum, no order. What
    all values take together is bounded too.
    """
    rows = rows.filter(F.col("n_bytes") <= LONGEST_SAMPLED)
    sums = rows.groupBy(label).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
    # Values may be many; a row each with two numbers is all that the driver gets of them.
    sizes = {r[label]: (r["n"], max(1, r["size"])) for r in sums.collect()}
    if not sizes:
        return rows.limit(0)
    most = min(SAMPLE_BYTES, SAMPLE_BYTES_ALL // len(sizes))
    shares = F.create_map(*[x for value, (n, size) in sizes.items() for x in (F.lit(value), F.lit(min(1.0, each / n, most / size)))])
    uniform = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.filter(uniform < shares[F.col(label)])


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters: one megabyte, made once in a process."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


@dataclass
class Words:
    """Words of several texts laid end to end: code points with a blank around every text."""

    points: np.ndarray
    letter: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    doc: np.ndarray


def lowered(text: str) -> str:
    """Lower case of the same length, so that places are those of the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def words_of(rows: list[str]) -> Words:
    rows = [lowered(r) for r in rows]
    joined = " " + " ".join(rows) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(r) for r in rows], np.int64)
    begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    letter = _letters()[points]
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    doc = np.searchsorted(begins, starts, side="right") - 1
    return Words(np.where(letter, points, 32).astype(np.uint32), letter, starts, ends - starts, doc)


def grams(words: Words):
    """For each order the hash bucket of the n-gram at every place.

    N-grams lie within a word and the blank on each side; any other gets the bucket after
    the last. The one that starts at the blank before a word belongs to that word.
    """
    points, letter = words.points, words.letter
    none = np.uint32(1 << TABLE_BITS)
    value = (points + np.uint32(1)) * np.uint32(0x9E3779B1)
    inside = letter
    for order in ORDERS:
        if order > 1:
            value = (value[:-1] ^ value[:-1] >> np.uint32(15)) + points[order - 1 :]
            value *= np.uint32(0x85EBCA6B)
            inside = letter[:-1] | letter[1:] if order == 2 else letter[1:-1] if order == 3 else inside[:-1] & letter[order - 2 : -1]
        yield np.where(inside, value >> np.uint32(32 - TABLE_BITS), none)


def word_sums(words: Words, values: np.ndarray) -> np.ndarray:
    """Sum over each word, and the blank before it, of the values at its places."""
    if not len(words.starts):
        return np.zeros((0, values.shape[1]))
    cuts = np.stack([words.starts - 1, words.starts + words.lengths], axis=1).ravel()
    return np.add.reduceat(values, cuts, axis=0)[::2].astype(np.float64)


def scripts_of(words: Words) -> np.ndarray:
    """The script of each word's first letter."""
    ranges = np.searchsorted(_STARTS, words.points[words.starts], side="right") - 1
    return _SCRIPT_OF_RANGE[ranges]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # float32 [orders, buckets + 1, languages]: log-probabilities
    allowed: np.ndarray  # bool [scripts, languages]
    common: int  # the language with most documents, for words without candidates
    name: str


def fit(rows: list[tuple[str, str]], counts: dict[str, int]) -> Model:
    """Fit on (lang, text) rows; `counts` are documents of each language among all that may be learned from."""
    languages = sorted(counts)
    size = 1 << TABLE_BITS
    seen = np.zeros((len(ORDERS), size, len(languages)), np.float64)
    script_letters = np.zeros((len(SCRIPTS), len(languages)), np.float64)
    for k, language in enumerate(languages):
        own = [text for lang, text in rows if lang == language]
        for begin in range(0, len(own), 256):
            words = words_of(own[begin : begin + 256])
            if not len(words.starts):
                continue
            np.add.at(script_letters[:, k], scripts_of(words), words.lengths)
            for o, bucket in enumerate(grams(words)):
                seen[o, :, k] += np.bincount(bucket, minlength=size + 1)[:size]
    seen += 0.1
    table = np.log(seen / seen.sum(axis=1, keepdims=True))
    if languages:
        table -= table.mean(axis=2, keepdims=True)
    allowed = script_letters >= np.maximum(1, SCRIPT_SHARE * script_letters.sum(axis=0, keepdims=True))
    common = max(range(len(languages)), key=lambda k: (counts[languages[k]], languages[k])) if languages else 0
    # One more bucket, of zeros, for what is no n-gram of a word.
    table = np.pad(table.astype(np.float32), ((0, 0), (0, 1), (0, 0)))
    return Model(languages, table, allowed, common, hashlib.sha256(table.tobytes()).hexdigest())


def word_scores(model: Model, words: Words) -> np.ndarray:
    """[words, languages]: n-gram sums; excluded languages far below, all equal where none is a candidate."""
    scores = np.zeros((len(words.starts), len(model.languages)))
    begin = 0
    while begin < len(words.starts):
        low = words.starts[begin] - 1
        end = max(begin + 1, int(np.searchsorted(words.starts, low + PLACES)))
        # N-grams of the last word look no further than the blank behind it.
        high = words.starts[end - 1] + words.lengths[end - 1] + max(ORDERS)
        part = Words(words.points[low:high], words.letter[low:high], words.starts[begin:end] - low, words.lengths[begin:end], words.doc[begin:end])
        values = np.zeros((len(part.points), len(model.languages)), np.float32)
        for table, bucket in zip(model.table, grams(part)):
            values[: len(bucket)] += table[bucket]
        scores[begin:end] = word_sums(part, values)
        begin = end
    allowed = model.allowed[scripts_of(words)]
    known = allowed.any(axis=1, keepdims=True)
    return np.where(known, np.where(allowed, scores, -1e6), 0.0)


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; documents advance together, one word each at a time."""
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.append(first, len(doc)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    # Documents still running after t words are the first alive[t] in this order.
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    value = scores[first].copy()
    for t in range(1, int(length[0])):
        n = alive[t]
        now = value[:n]
        switch = now.max(axis=1, keepdims=True) - penalty
        stay = now >= switch
        at = first[:n] + t
        back[at] = np.where(stay, own, now.argmax(axis=1)[:, None])
        value[:n] = np.where(stay, now, switch) + scores[at]
    label = value.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        labels[at] = label[:n]
        label[:n] = back[at, label[:n]]
    return labels


@dataclass
class Labelled:
    """What is found in a text: its language, the score, the share of letters labelled with it, and all spans."""

    language: str
    score: float
    share: float
    spans: list[tuple[int, int, str]]  # from, to (code points, the last one out), language


def label_spans(model: Model, rows: list[str]) -> list[Labelled]:
    """Languages and spans of texts.

    A span goes from its first word to its last. Its posterior compares the sums of its words'
    scores over all languages; the score of the text's language is the mean of its spans'
    posteriors, weighted by their share of all letters.
    """
    if not model.languages:
        return [Labelled(UNKNOWN, 0.0, 0.0, []) for _ in rows]
    words = words_of(rows)
    n = len(model.languages)
    scores = word_scores(model, words)
    labels = viterbi(scores, words.doc, SWITCH_PENALTY)
    letters = np.bincount(words.doc * n + labels, words.lengths, len(rows) * n).reshape(-1, n)
    some = letters.sum(axis=1) > 0
    # Words that begin a span, and what each span sums up to.
    begins = np.flatnonzero(np.concatenate([[True], (words.doc[1:] != words.doc[:-1]) | (labels[1:] != labels[:-1])])) if len(labels) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(labels)) - 1 if len(begins) else begins
    sums = np.add.reduceat(scores, begins, axis=0) if len(begins) else np.zeros((0, n))
    span_doc, span_label = words.doc[begins], labels[begins]
    odds = np.exp(sums - sums.max(axis=1, keepdims=True)) if len(begins) else sums
    posterior = odds[np.arange(len(begins)), span_label] / odds.sum(axis=1) if len(begins) else np.zeros(0)
    span_letters = np.add.reduceat(words.lengths, begins) if len(begins) else begins
    unsure = np.bincount(span_doc, np.abs(sums).max(axis=1), len(rows)) == 0 if len(begins) else np.ones(len(rows), bool)
    best = np.where(unsure, model.common, letters.argmax(axis=1))
    own = span_label == best[span_doc]
    whole = np.maximum(1, letters.sum(axis=1))
    score = np.bincount(span_doc[own], (posterior * span_letters)[own], len(rows)) / whole
    share = letters[np.arange(len(rows)), best] / whole
    score = np.where(unsure, 1 / n, score)
    # Places within each text: texts lie behind one another with a blank between them.
    text_begins = 1 + np.cumsum([0, *[len(r) + 1 for r in rows]])[:-1] if rows else np.zeros(0, np.int64)
    first = words.starts[begins] - text_begins[span_doc]
    last = words.starts[ends] + words.lengths[ends] - text_begins[span_doc]
    found = [Labelled(model.languages[b], min(1.0, float(s)), float(h), []) if x else Labelled(UNKNOWN, 0.0, 0.0, []) for b, s, h, x in zip(best, score, share, some)]
    for doc, low, high, label in zip(span_doc.tolist(), first.tolist(), last.tolist(), span_label.tolist()):
        found[doc].spans.append((low, high, model.languages[label]))
    return found


def predict(model: Model, rows: list[str]) -> list[tuple[str, float, int]]:
    """(language, score, number of spans) of each text."""
    return [(f.language, f.score, len(f.spans)) for f in label_spans(model, rows)]


def learn(docs: DataFrame, each: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit a model, in one task, on the bounded sample of rows with a language outside the held-out fold."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold_of("doc_id") != 0)
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    known = known.withColumn("n_bytes", F.octet_length("text").cast("long"))
    sample = sampled(known, "lang", each).select("lang", "text").repartition(1)
    return in_one_task(sample, lambda rows: fit([(r["lang"], r["text"]) for r in rows], counts))


SPAN = "struct<begin:int,end:int,lang:string>"
SCHEMA = f"doc_id long, held_out boolean, lang_pred string, score double, spans int, labelled array<{SPAN}>"
SPAN_KIND = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, number of spans and the spans themselves of every row of `docs`.

    `labelled` has (begin, end, lang) of each span in code points. Null texts and texts without a
    letter are `und` with score 0 and no span; a very long text is labelled whole, in memory of some
    hundred times its size; an empty table gives no rows; columns besides doc_id and text are left out. Letters of a script that no
    learned language uses say nothing; a text of such letters only gets the most frequent
    language. Repeated rows repeat. The model, fixed by `TABLE_BITS` and the number of
    languages, is broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = texts(docs).withColumn("held_out", fold_of("doc_id") == 0)

    def label(batches):
        model = shared.value
        for batch in batches:
            found = []
            text = batch.column("text").to_pylist()
            for begin, end in blocks(text, BLOCK_CHARS):
                found += label_spans(model, text[begin:end])
            spans = [[{"begin": low, "end": high, "lang": lang} for low, high, lang in f.spans] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array([f.language for f in found], pa.string()), pa.array([f.score for f in found], pa.float64()),
                    pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, SPAN_KIND),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "spans", "labelled"],
            )

    return rows.mapInArrow(label, SCHEMA)


def language_id(docs: DataFrame, each: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Learn from `docs` (doc_id, text, lang) and label every row of it."""
    return identify(docs, learn(docs, each))


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs` with a language that holds at least `least` of their letters, with all their columns.

    Only the labels of the spans count, not how sure they are. Texts without a letter go, very long
    ones are labelled whole, an empty table stays empty, and columns of any name keep their values.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    name = model.name

    def shares(rows):
        # Lets go of what the worker kept for the stage before.
        model = of_worker(("language_id", name), lambda: shared.value)
        found = [x for begin, end in blocks(rows, BLOCK_CHARS) for x in label_spans(model, rows[begin:end])]
        return [None if f.language == UNKNOWN else f.share for f in found]

    column = unused("lang_share", docs)
    return with_text_column(docs, shares, pa.float64(), column).filter(F.col(column) >= least).drop(column)
