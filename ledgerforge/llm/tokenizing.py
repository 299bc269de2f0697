"""Exact tokenization of whole texts, piece by piece, with bounded per-worker memory.

Neither vocabulary used here merges across a space, so a text's ids are the concatenation of
the ids of its pieces between spaces and line feeds. The pieces of a block of texts are cut and
numbered in arrays, each different one once. Simple ones, of Latin letters, digits and signs
without apostrophes, are split into pre-tokens where the kind of character changes and merged
together, one rank a round, all in arrays. For other pieces the vocabulary's regular expression
splits, and each Python worker remembers what it found, in two generations of bounded bytes;
those that need Unicode normalisation, and special tokens' strings, go to the tokenizer itself.
"""

from __future__ import annotations

import gc
import json

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: Bytes, about, of each of the two generations of remembered pieces.
GENERATION_BYTES = 64 << 20
#: What an entry takes besides its piece and value.
ENTRY_BYTES = 200
#: Characters of text handled together.
BLOCK_CHARS = 4_000_000
#: Fixed value: the pre-token pattern of the word-end vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the mark at the end of a word in the word-end vocabulary's strings.
WORD_END = "</w>"
#: Below this code point letters, digits and white space are the same in every Unicode
#: version, nothing composes, and lower-casing needs no context.
_PLAIN = regex.compile(r"[\x21-\x7e¡-ɏ]*")
_PLAIN_LINES = regex.compile(r"[\n\x20-\x7e¡-ɏ]*")

#: First code point beyond simple pieces, all of one or two bytes in UTF-8.
SIMPLE_END = 0x250
#: Stands for the ids of a piece that only its whole text tells; no ids are so short.
UNFIT = b"?"


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and their places; those from `SIMPLE_END` on are given as that."""
    places = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[places].astype(np.int32)
    after = np.append(data, 0)[places + 1].astype(np.int32)
    points = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 0x1F) << 6 | after & 0x3F, SIMPLE_END))
    return np.minimum(points, SIMPLE_END), places


_OF_WORKER: dict = {}


def of_worker(key, build):
    """The object built for `key` once in this Python worker, kept for its later tasks.

    A worker serves one model after another, so it keeps one object only: another key lets go
    of the one before, whose remembered values may refer back to it. Being a function of an
    importable module it reaches tasks by reference, so that all of them share this module's
    dictionary.
    """
    if key not in _OF_WORKER:
        _OF_WORKER.clear()
        gc.collect()
        _OF_WORKER[key] = build()
    return _OF_WORKER[key]


def blocks(rows: list[str], chars: int = BLOCK_CHARS):
    """Index ranges of `rows` of about `chars` characters; at least one row each."""
    begin = size = 0
    for k, text in enumerate(rows):
        if size and size + len(text) > chars:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(rows):
        yield begin, len(rows)


def byte_of_char() -> dict[str, int]:
    """The printable stand-in characters of byte-level vocabularies, mapped to their bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Remembered(dict):
    """`dict` that computes missing values and keeps about the last two generations of `most` bytes."""

    def __init__(self, compute, most: int = GENERATION_BYTES):
        super().__init__()
        self.compute, self.most, self.old, self.bytes = compute, most, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if self.bytes >= self.most:
            self.old, self.bytes = dict(self), 0
            self.clear()
        self[key] = value
        self.bytes += ENTRY_BYTES + (len(key) if isinstance(key, str) else 0)
        return value


class Pieces:
    """Values of pieces, resolved many at a time and kept for about two generations of `most` bytes."""

    def __init__(self, resolve, most: int = GENERATION_BYTES):
        self.resolve, self.most, self.new, self.old, self.bytes = resolve, most, {}, {}, 0

    def values(self, pieces: list[str]) -> list:
        """The value of each of some different pieces."""
        found = list(map(self.new.get, pieces))
        need = [k for k, value in enumerate(found) if value is None]
        fresh = []
        for k in need:
            found[k] = self.old.get(pieces[k])
            if found[k] is None:
                fresh.append(k)
        for k, value in zip(fresh, self.resolve([pieces[k] for k in fresh]) if fresh else ()):
            found[k] = value
        for k in need:
            self.new[pieces[k]] = found[k]
            self.bytes += ENTRY_BYTES + len(pieces[k]) + (len(found[k]) if isinstance(found[k], bytes) else 0)
        if self.bytes >= self.most:
            self.old, self.new, self.bytes = self.new, {}, 0
        return found


class Split:
    """The pieces of several texts between single spaces and line feeds, each different one once.

    `pieces` are the different ones, `codes` tells which of them stands at each place, `first`
    at which place each text begins (and the last one ends), and `before` what stands before
    the place: `START` of the text, a `SPACE` or a `FEED`.
    """

    SPACE, START, FEED = 0, 1, 2

    def __init__(self, rows: list[str]):
        column = pa.array(rows, pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(rows) + 1)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        gap = (data == 32) | (data == 10)
        at = np.flatnonzero(gap)
        gaps = np.searchsorted(at, offsets)  # gaps before each text
        texts = np.arange(len(rows))
        place = np.arange(len(at)) + np.repeat(texts, np.diff(gaps))  # of the piece that each gap ends
        ends = np.zeros(len(at) + len(rows) + 1, np.int64)
        ends[place + 1] = at - np.arange(len(at))
        ends[gaps[1:] + texts + 1] = offsets[1:] - gaps[1:]
        self.before = np.full(len(at) + len(rows), self.START, np.int8)
        self.before[place + 1] = np.where(data[at] == 10, self.FEED, self.SPACE)
        self.first = gaps + np.arange(len(rows) + 1)
        self.empty = ends[1:] == ends[:-1]
        joined = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[~gap])))
        coded = joined.dictionary_encode()
        self.codes, self.different = coded.indices.to_numpy(), coded.dictionary

    @property
    def pieces(self) -> list[str]:
        return self.different.to_pylist()


class Values:
    """Ids of several pieces: where those of each begin in one array, and how many they are."""

    def __init__(self, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        self.begins, self.sizes, self.ids = begins, sizes, ids

    @classmethod
    def of(cls, values: list[bytes]) -> "Values":
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        return cls(np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(values), "<u4"))

    def texts(self, slots: np.ndarray, first: np.ndarray) -> list[bytes]:
        """For each text the ids at its slots, end to end, 4 bytes each."""
        own = self.sizes[slots]
        upto = np.append(0, np.cumsum(own))
        take = np.repeat(self.begins[slots] - upto[:-1], own)
        take += np.arange(len(take))
        raw, cuts = self.ids[take].astype("<u4").tobytes(), (4 * upto[first]).tolist()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class Merges:
    """A vocabulary's merges, applied to many pre-tokens at once."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocab, back = model["vocab"], byte_of_char()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.strings = {i: s for s, i in vocab.items()}
        self.byte_ids = np.zeros(256, np.int32)
        self.end_ids = np.zeros(256, np.int32)
        suffix = model.get("end_of_word_suffix") or ""
        for char, byte in back.items():
            self.byte_ids[byte] = vocab[char]
            self.end_ids[byte] = vocab[char + suffix]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, self.NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        # Open addressing: each round places the pairs whose next slot is free.
        keys = (left << np.uint64(32) | right).astype(np.int64)
        slots, todo = self._slot(keys), np.arange(len(pairs))
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        while len(todo):
            free = self.keys[slots[todo]] == -1
            _, first = np.unique(slots[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slots[put]], self.ranks[slots[put]], self.merged[slots[put]] = keys[put], put, made[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            taken = todo[self.keys[slots[todo]] != -1]
            slots[taken] = (slots[taken] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each pair key, or of an empty place where it is no merge."""
        slots = self._slot(keys)
        miss = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))
        while len(miss):
            slots[miss] = (slots[miss] + 1) % len(self.keys)
            at = self.keys[slots[miss]]
            miss = miss[(at != keys[miss]) & (at != -1)]
        return slots

    def apply(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens end to end, number of ids of each)."""
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw = np.frombuffer("".join(tokens).encode("utf-8"), np.uint8)
        chars = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        begins_char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        ends = begins_char[chars]
        symbol = self.byte_ids[raw]
        symbol[ends - 1] = self.end_ids[raw[ends - 1]]
        return self.merge(symbol, np.repeat(np.arange(len(tokens)), np.diff(ends, prepend=0)), len(tokens))

    def merge(self, symbol: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The same from single symbols, each with the number of its pre-token; every pre-token has one."""
        done_words, done_symbols = [], []
        while len(symbol):
            slots = self.find(symbol[:-1].astype(np.int64) << 32 | symbol[1:])
            rank = np.append(self.ranks[slots], self.NONE)
            last = np.append(word[1:] != word[:-1], True)
            rank[last] = self.NONE
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            least = np.repeat(least, sizes)
            over = least == self.NONE
            if over.any():
                done_words.append(word[over])
                done_symbols.append(symbol[over])
            hit = (rank == least) & ~over
            # Where the same pair overlaps itself, every other one counts from the left.
            if (hit[1:] & hit[:-1]).any():
                place = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
                hit &= (place - run) % 2 == 0
            at = np.flatnonzero(hit)
            symbol = symbol.copy()
            symbol[at] = self.merged[slots[at]]
            keep = ~over
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        owner, ids = np.concatenate(done_words), np.concatenate(done_symbols)
        ids = ids[np.argsort(owner, kind="stable")]
        return ids, np.bincount(owner, minlength=words)


class Vocabulary:
    """A tokenizer file: the tokenizer itself, its merges and its pre-token pattern."""

    def __init__(self, tokenizer_json: str, pattern: str, lower: bool):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Merges(json.loads(tokenizer_json)["model"])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower = lower
        self.split = regex.compile(pattern + r"|\n").findall
        # Kinds of the characters of simple pieces, 0 for those that need the pattern, and
        # their lower case, where that takes as many bytes.
        shown = [chr(c) for c in range(SIMPLE_END)]
        small = [c.lower() if lower else c for c in shown]
        fits = [_PLAIN.fullmatch(c) is not None and c not in "'<" and len(d) == 1 and d < chr(SIMPLE_END) and len(c.encode()) == len(d.encode()) for c, d in zip(shown, small)]
        kind = [1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 for c in shown]
        self.kind = np.array([k if ok else 0 for k, ok in zip(kind, fits)] + [0], np.int8)
        self.small = np.array([ord(d) if ok else 0 for d, ok in zip(small, fits)] + [0], np.int32)
        self.digits_apart = not regex.compile(pattern).fullmatch("12")

    def simple_pieces(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Which pieces, UTF-8 bytes between offsets, have characters with a kind only."""
        points, places = _points(data)
        odd = np.append(0, np.cumsum(self.kind[points] == 0))
        chars = np.searchsorted(places, offsets)
        return odd[chars[1:]] == odd[chars[:-1]]

    def simple_ids(self, offsets: np.ndarray, data: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of simple pieces that are not empty, each after a space if `spaced`."""
        if len(offsets) < 2:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        points, places = _points(data)
        kind = self.kind[points]
        begins = np.concatenate([[True], kind[1:] != kind[:-1]])
        if self.digits_apart:
            begins |= kind == 2
        chars = np.searchsorted(places, offsets)
        begins[chars[:-1]] = not spaced
        raw = data
        if self.lower:
            points, raw = self.small[points], data.copy()
            wide = points >= 0x80
            raw[places] = np.where(wide, 0xC0 | points >> 6, points)
            raw[places[wide] + 1] = 0x80 | points[wide] & 0x3F
        starts = np.zeros(len(raw), np.bool_)
        starts[places] = begins
        if spaced:
            raw, starts = np.insert(raw, offsets[:-1], 32), np.insert(starts, offsets[:-1], True)
            offsets = offsets + np.arange(len(offsets))
        symbol = self.merges.byte_ids[raw]
        last = np.append(np.flatnonzero(starts)[1:], len(raw)) - 1
        symbol[last] = self.merges.end_ids[raw[last]]
        word = np.cumsum(starts) - 1
        ids, counts = self.merges.merge(symbol, word, len(last))
        return ids, np.add.reduceat(counts, word[offsets[:-1]])

    def values(self, pieces: pa.Array, remembered: Pieces, spaced: bool) -> tuple[Values, np.ndarray]:
        """The ids of each of several pieces, and the places of those for which `remembered` has `UNFIT`."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        sizes = np.diff(offsets)
        simple = self.simple_pieces(offsets, data) & (sizes > 0)
        slow = np.flatnonzero(~simple)
        ids, counts = self.simple_ids(np.append(0, np.cumsum(sizes[simple])), data[np.repeat(simple, sizes)], spaced)
        found = remembered.values(pieces.take(pa.array(slow)).to_pylist())
        unfit = [k for k, value in enumerate(found) if value is UNFIT]
        for k in unfit:
            found[k] = b""
        rest = Values.of(found)
        number, begin = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        number[simple], begin[simple] = counts, np.cumsum(counts) - counts
        number[slow], begin[slow] = rest.sizes, rest.begins + len(ids)
        return Values(begin, number, np.concatenate([ids.astype(np.uint32), rest.ids])), slow[unfit]

    def plain(self, piece: str) -> bool:
        return _PLAIN.fullmatch(piece) is not None and not any(s in piece for s in self.special)

    def pre_tokens(self, pieces: list[str]) -> list[list[str]]:
        """Pre-tokens of each of several plain pieces."""
        joined = "\n".join(pieces) + "\n"
        out, own = [], []
        for token in self.split(joined.lower() if self.lower else joined):
            if token == "\n":
                out.append(own)
                own = []
            else:
                own.append(token)
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids_of(self, pieces: list[str], before: str = "") -> list[bytes]:
        """Ids of each piece, after the text `before`, as little-endian unsigned 32-bit integers.

        Plain pieces hold no line feed, so one put after each marks its end among the ids.
        """
        joined = before + ("\n" + before).join(pieces) + "\n"
        if _PLAIN_LINES.fullmatch(joined) and not any(s in joined for s in self.special):
            ids, _ = self.merges.apply(self.split(joined.lower() if self.lower else joined))
            ends = np.flatnonzero(ids == self.merges.end_ids[10])
            raw = ids.astype("<u4").tobytes()
            begins = np.append(0, ends[:-1] + 1)
            return [raw[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist())]
        if len(pieces) == 1:
            return [self.encode(before + pieces[0]).astype("<u4").tobytes()]
        plain = [self.plain(p) for p in pieces]
        found = iter(self.ids_of([p for p, ok in zip(pieces, plain) if ok], before)) if any(plain) else iter(())
        return [next(found) if ok else self.encode(before + p).astype("<u4").tobytes() for p, ok in zip(pieces, plain)]


def word_vocabulary(tokenizer_json: str) -> Vocabulary:
    return Vocabulary(tokenizer_json, WORD_PATTERN, lower=True)


class WordEncoder:
    """Whole texts to id bytes with the word-end vocabulary; white space only separates."""

    def __init__(self, tokenizer_json: str):
        self.vocabulary = word_vocabulary(tokenizer_json)
        self.pieces = Pieces(self.vocabulary.ids_of)

    def __call__(self, rows: list[str]) -> list[bytes]:
        out = []
        for begin, end in blocks(rows):
            split = Split(rows[begin:end])
            values, _ = self.vocabulary.values(split.different, self.pieces, spaced=False)
            out += values.texts(split.codes, split.first)
        return out


class ByteEncoder:
    """Whole texts to id bytes with the byte-level vocabulary.

    A piece keeps the one space before it, and a line feed between other characters is a
    pre-token of its own. Longer runs of white space join, so a text that has white space in
    a row, other white space within a piece, or a space at its end goes to the tokenizer as a
    whole.
    """

    def __init__(self, tokenizer_json: str):
        self.vocabulary = Vocabulary(tokenizer_json, BYTE_PATTERN, lower=False)
        self.heads = Pieces(lambda pieces: self._ids(pieces, ""), GENERATION_BYTES // 2)
        self.later = Pieces(lambda pieces: self._ids(pieces, " "))
        self.feed = self.vocabulary.encode("\n")
        self.space = regex.compile(r"\s").search

    def _ids(self, pieces: list[str], before: str) -> list[bytes]:
        """Ids of each piece; `UNFIT` for one with white space in it."""
        if not self.space("".join(pieces)):
            return self.vocabulary.ids_of(pieces, before)
        fit = [p for p in pieces if not self.space(p)]
        found = dict(zip(fit, self.vocabulary.ids_of(fit, before))) if fit else {}
        return [found.get(p, UNFIT) for p in pieces]

    def __call__(self, rows: list[str]) -> list[bytes]:
        out = []
        for begin, end in blocks(rows):
            split = Split(rows[begin:end])
            n = len(split.different)
            head = split.before != Split.SPACE
            # One value for each piece after a space, one for each that begins a text or line,
            # and one for a line feed, which is a place of its own.
            used = np.zeros(2 * n, np.bool_)
            slots = split.codes + n * head.astype(np.int64)
            used[slots] = True
            at = np.cumsum(used) - 1
            later, unfit = self.vocabulary.values(split.different.take(pa.array(np.flatnonzero(used[:n]))), self.later, spaced=True)
            heads, unfit_heads = self.vocabulary.values(split.different.take(pa.array(np.flatnonzero(used[n:]))), self.heads, spaced=False)
            total = len(later.ids) + len(heads.ids)
            values = Values(
                np.concatenate([later.begins, heads.begins + len(later.ids), [total]]),
                np.concatenate([later.sizes, heads.sizes, [len(self.feed)]]),
                np.concatenate([later.ids, heads.ids, self.feed]),
            )
            slots = at[slots]
            apart = self._apart(split)
            bad = np.concatenate([unfit, unfit_heads + len(later.sizes)])
            if len(bad):
                apart |= np.logical_or.reduceat(np.isin(slots, bad), split.first[:-1])
            fed = np.flatnonzero(split.before == Split.FEED)
            feeds = np.append(0, np.cumsum(split.before == Split.FEED))[split.first]
            encoded = values.texts(np.insert(slots, fed, len(values.sizes) - 1), split.first + feeds)
            for k in np.flatnonzero(apart).tolist():
                encoded[k] = self.vocabulary.encode(rows[begin + k]).astype("<u4").tobytes()
            out += encoded
        return out

    @staticmethod
    def _apart(split: Split) -> np.ndarray:
        """Which texts have spaces or line feeds in a row, or a space at the end."""
        last = split.first[1:] - 1
        hit = split.empty.copy()
        hit[split.first[:-1]] = False
        hit[last] &= split.before[last] == Split.SPACE
        return np.logical_or.reduceat(hit, split.first[:-1])
