"""Operator 9: BPE encoding by dynamic programming over prefixes, and decoding.

A sequence of tokens is what merging produces exactly when each token merges back to
itself and each neighbouring pair stays apart when its joined symbols are merged. So the
encoding of every prefix ends in one definite token: among the vocabulary strings that are
suffixes of the prefix, the one compatible with the last token of the prefix before it. A
suffix-matching automaton lists the candidates, the table keeps the last token of each
prefix, and following the back-pointers from the end emits the ids.

Null and empty texts have no tokens and decode to the empty text. Repeated rows each give a
row, texts are encoded whole, and columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .tokenizing import GENERATION_BYTES, WORD_END, Pieces, Remembered, Split, Values, Vocabulary, blocks, byte_of_char, of_worker, word_vocabulary

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: One character that stands for the end-of-word mark inside the automaton.
END = "\ue000"
#: Bytes, about, of the remembered pair decisions.
PAIR_BYTES = 2 * GENERATION_BYTES


def id_bytes(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


class PrefixCodec:
    """Encodes single pre-tokens of the word-end vocabulary."""

    def __init__(self, vocabulary: Vocabulary, model: dict):
        self.vocabulary, self.strings = vocabulary, vocabulary.merges.strings
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.char_of_byte = {b: c for c, b in byte_of_char().items()}
        self.compatible = Remembered(self._compatible, PAIR_BYTES)
        self.stands_alone = Remembered(lambda i: self.merge(self.symbols(i)) == [self.strings[i]])
        self.automaton = ahocorasick.Automaton()
        for string, i in model["vocab"].items():
            marked = string[: -len(WORD_END)] + END if string.endswith(WORD_END) else string
            self.automaton.add_word(marked, (len(marked), i))
        self.automaton.make_automaton()

    def symbols(self, token: int) -> list[str]:
        """The token's string as the single symbols that merging starts from."""
        string = self.strings[token]
        if string.endswith(WORD_END) and string != WORD_END:
            body = string[: -len(WORD_END)]
            return [*body[:-1], body[-1] + WORD_END]
        return list(string)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging, lowest rank first; only ever run on one or two tokens' symbols."""
        none = len(self.rank)
        while len(symbols) > 1:
            ranks = [self.rank.get(pair, none) for pair in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == none:
                break
            merged, k = [], 0
            while k < len(symbols):
                if k < len(ranks) and ranks[k] == best:
                    merged.append(symbols[k] + symbols[k + 1])
                    k += 2
                else:
                    merged.append(symbols[k])
                    k += 1
            symbols = merged
        return symbols

    def _compatible(self, key: int) -> bool:
        """Whether the two tokens of the key stay as they are when they stand side by side."""
        left, right = key >> 32, key & 0xFFFFFFFF
        return self.merge(self.symbols(left) + self.symbols(right)) == [self.strings[left], self.strings[right]]

    def encode_mapped(self, mapped: str) -> list[int]:
        """Ids of one pre-token given in the vocabulary's stand-in characters."""
        n = len(mapped)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for at, (length, token) in self.automaton.iter(mapped + END):
            if at < n - 1:
                ending[at + 1].append((length, token))
            elif at == n:
                ending[n].append((length - 1, token))
        last: list[int] = [-1] * (n + 1)
        width = [0] * (n + 1)
        for end in range(1, n + 1):
            for length, token in ending[end]:
                start = end - length
                if start == 0:
                    fits = self.stands_alone[token]
                else:
                    fits = last[start] >= 0 and self.compatible[last[start] << 32 | token]
                if fits:
                    last[end], width[end] = token, length
                    break
        ids, end = [], n
        while end > 0:
            if last[end] < 0:
                raise ValueError(f"no token sequence covers {mapped!r}")
            ids.append(last[end])
            end -= width[end]
        return ids[::-1]

    def encode_plain(self, pre_token: str) -> bytes:
        return id_bytes(self.encode_mapped("".join([self.char_of_byte[b] for b in pre_token.encode("utf-8")])))

    def encode_any(self, piece: str) -> bytes:
        """Ids of a piece that needs the tokenizer's own normalising and splitting."""
        tokenizer = self.vocabulary.tokenizer
        if any(s in piece for s in self.vocabulary.special):
            return self.vocabulary.encode(piece).astype("<u4").tobytes()
        split = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(piece))
        return b"".join([id_bytes(self.encode_mapped(mapped)) for mapped, _ in split])


class TextCodec:
    """Whole texts to id bytes and back to text, remembering repeated pieces."""

    def __init__(self, tokenizer_json: str):
        self.vocabulary = word_vocabulary(tokenizer_json)
        self.codec = PrefixCodec(self.vocabulary, json.loads(tokenizer_json)["model"])
        self.tokens = Remembered(self.codec.encode_plain)
        self.pieces = Pieces(self._ids)
        strings = self.vocabulary.tokenizer
        self.string_bytes = [(strings.id_to_token(i) or "").encode("utf-8") for i in range(strings.get_vocab_size())]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        plain = [self.vocabulary.plain(p) for p in pieces]
        split = iter(self.vocabulary.pre_tokens([p for p, ok in zip(pieces, plain) if ok]))
        return [b"".join([self.tokens[t] for t in next(split)]) if ok else self.codec.encode_any(p) for p, ok in zip(pieces, plain)]

    def encode(self, rows: list[str]) -> list[bytes]:
        out = []
        for begin, end in blocks(rows):
            split = Split(rows[begin:end])
            out += Values.of(self.pieces.values(split.pieces)).texts(split.codes, split.first)
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids: their strings with a blank between them, as without a decoder."""
        return b" ".join([self.string_bytes[i] for i in np.frombuffer(ids, "<u4").tolist()])


def bpe_round_trip(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every row.

    Only the tokenizer file (fixed by the vocabulary) is broadcast; no document is shuffled.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches):
        codec = of_worker(("TextCodec", tokenizer_path), lambda: TextCodec(shared.value))
        for batch in batches:
            encoded = codec.encode(batch.column("text").to_pylist())
            n = [len(ids) // 4 for ids in encoded]
            ids_digest = [hashlib.sha256(ids).hexdigest() for ids in encoded]
            decoded_digest = [hashlib.sha256(codec.decode(ids)).hexdigest() for ids in encoded]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(decoded_digest, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs, id_col, text_col).mapInArrow(encode, SCHEMA)
