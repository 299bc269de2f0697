"""Operator 4: token counts with the whole-token shortcut.

Offline, every vocabulary string is put through the tokenizer alone; those that come
back as exactly one token are proven whole tokens. Online a pre-token found among them
counts as one without any merging; only the rest is merged. Counts are exact.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows each give a row. Very long
texts are read whole. Columns other than the two named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .tokenizing import WORD_END, Pieces, Split, blocks, byte_of_char, of_worker, word_vocabulary

#: Documents above this many tokens are over the limit.
TOKEN_LIMIT = 2048
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def prove_whole_tokens(tokenizer_json: str) -> frozenset[str]:
    """Pre-token strings that the tokenizer turns into one token each, proven one by one."""
    words, back = word_vocabulary(tokenizer_json), byte_of_char()
    texts = []
    for string in words.tokenizer.get_vocab(with_added_tokens=False):
        body = string.removesuffix(WORD_END)
        if body and body != string and all(c in back for c in body):
            try:
                texts.append(bytes(back[c] for c in body).decode("utf-8"))
            except UnicodeDecodeError:
                continue
    texts = [t for t in texts if words.plain(t)]
    alone = [t for t, split in zip(texts, words.pre_tokens(texts)) if split == [t]]
    return frozenset(t for t in alone if len(words.encode(t)) == 1)


class TokenCounter:
    """Counts tokens of whole texts; one instance serves all tasks of a worker."""

    def __init__(self, tokenizer_json: str, whole: frozenset[str]):
        self.words, self.whole = word_vocabulary(tokenizer_json), whole
        self.pieces = Pieces(self._count)

    def _count(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece: one for a proven whole token, else as many as merging leaves."""
        whole, plain = self.whole, [self.words.plain(p) for p in pieces]
        split = self.words.pre_tokens([p for p, ok in zip(pieces, plain) if ok])
        rest = list({t for own in split for t in own if t not in whole})
        merged = dict(zip(rest, self.words.merges.apply(rest)[1].tolist()))
        found = iter([sum([1 if t in whole else merged[t] for t in own]) for own in split])
        return [next(found) if ok else len(self.words.encode(p)) for p, ok in zip(pieces, plain)]

    def __call__(self, rows: list[str]) -> list[int]:
        out = []
        for begin, end in blocks(rows):
            split = Split(rows[begin:end])
            counts = np.array(self.pieces.values(split.pieces), np.int64)
            out += np.add.reduceat(counts[split.codes], split.first[:-1]).tolist()
        return out


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = TOKEN_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs`.

    The tokenizer file and the proven strings (about 3 MB together, fixed by the
    vocabulary) are broadcast; documents are neither shuffled nor collected.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, prove_whole_tokens(tokenizer_json)))

    def count(batches):
        counter = of_worker(("TokenCounter", tokenizer_path), lambda: TokenCounter(*shared.value))
        for batch in batches:
            rows = batch.column("text").to_pylist()
            tokens = counter(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(text.encode("utf-8")) for text in rows], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs, id_col, text_col).mapInArrow(count, SCHEMA)
