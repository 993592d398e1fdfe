"""Greedy word-piece counts by a linear longest-match automaton.

A trie of the vocabulary carries, for every node, a failure link and the number of pieces popped when the
link is followed (linear-time maximum matching). Counting a word needs one step a byte and no pieces are
built. All different words of a slice walk the automaton together, a byte position at a time.

A word is a space followed by a maximal run of bytes other than 0x20 and 0x09-0x0D, case kept. A word that
cannot be covered counts as one piece, unknown. Null, empty and blank texts have 0 words and 0 pieces;
repeated rows are counted once per row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ledgerline.llm.textarrays import id_text, map_slices, raw_bytes

SCHEMA = "doc_id long, n_bytes long, n_words long, n_tokens long, n_unknown long"
NONE = -1


def tiktoken_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as lines:
        return [base64.b64decode(x.split()[0]) for x in lines if x.strip()]


class Automaton:
    """Arrays over trie nodes; node 0 is the root, and nodes are numbered by depth."""

    def __init__(self, vocabulary: list[bytes]):
        vocabulary = sorted({v for v in vocabulary if v})
        prefixes = sorted({v[:k] for v in vocabulary for k in range(1, len(v) + 1)}, key=lambda p: (len(p), p))
        number = {b"": 0} | {p: i + 1 for i, p in enumerate(prefixes)}
        n = len(number)
        parent = np.array([0] + [number[p[:-1]] for p in prefixes])
        byte = np.array([0] + [p[-1] for p in prefixes])
        depth = np.array([0] + [len(p) for p in prefixes])
        whole = np.zeros(n, bool)
        whole[[number[v] for v in vocabulary]] = True
        key = parent[1:] * 256 + byte[1:]
        order = np.argsort(key)
        self.keys, self.targets = key[order], np.arange(1, n)[order]
        self.fail, self.pops = np.full(n, NONE), np.zeros(n, np.int64)
        for d in range(1, int(depth.max(initial=0)) + 1):
            level = np.flatnonzero(depth == d)
            at, popped, to = self.fail[parent[level]].copy(), self.pops[parent[level]].copy(), np.full(len(level), NONE)
            open_ = np.flatnonzero((at != NONE) & ~whole[level])
            while len(open_):
                got = self.step(at[open_], byte[level[open_]])
                to[open_[got != NONE]] = got[got != NONE]
                open_ = open_[got == NONE]
                popped[open_] += self.pops[at[open_]]
                at[open_] = self.fail[at[open_]]
                open_ = open_[at[open_] != NONE]
            self.fail[level], self.pops[level] = np.where(whole[level], 0, to), np.where(whole[level], 1, popped)
        self.flush = np.zeros(n, np.int64)  # pieces left at a word's end, NONE if it can't be covered
        for v in range(1, n):
            rest = NONE if self.fail[v] == NONE else self.flush[self.fail[v]]
            self.flush[v] = NONE if rest == NONE else self.pops[v] + rest

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], NONE) if len(self.keys) else np.full(len(key), NONE)

    def count(self, data: np.ndarray, off: np.ndarray, lead: int | None = None) -> np.ndarray:
        """Pieces of each string data[off[i]:off[i+1]], NONE for one that can't be covered. lead: a byte before each."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        at, state, total = off[:-1][order], np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        longest = int(size.max(initial=0))
        size = size[order]
        for k in range(-1 if lead is not None else 0, longest):
            live = len(size) if k < 0 else int(np.searchsorted(-size, -k))  # strings of more than k bytes come first
            rows = np.arange(live)[state[:live] != NONE]
            byte = np.full(len(rows), lead) if k < 0 else data[at[rows] + k].astype(np.int64)
            while len(rows):
                got = self.step(state[rows], byte)
                state[rows[got != NONE]] = got[got != NONE]
                rows, byte = rows[got == NONE], byte[got == NONE]
                total[rows] += self.pops[state[rows]]
                state[rows] = self.fail[state[rows]]
                left = state[rows] != NONE
                rows, byte = rows[left], byte[left]
        rest = np.where(state == NONE, NONE, self.flush[state])
        out = np.empty(len(size), np.int64)
        out[order] = np.where(rest == NONE, NONE, total + rest)
        return out


def token_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens, n_unknown (words that count as one unknown piece)."""
    automaton = Automaton(vocabulary)

    def make():
        def work(part: pa.RecordBatch):
            texts = pc.fill_null(part.column("text"), "").cast(pa.large_string())
            words = pc.ascii_split_whitespace(texts)
            coded = words.flatten().dictionary_encode()
            per_word = automaton.count(*raw_bytes(coded.dictionary), lead=0x20)
            blank = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) == 0
            rows = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            at = coded.indices.to_numpy(zero_copy_only=False)
            add = lambda v: pa.array(np.bincount(rows, v[at], len(words)).astype(np.int64))
            pieces = np.where(blank, 0, np.where(per_word == NONE, 1, per_word))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), add(~blank), add(pieces), add((per_word == NONE) & ~blank)], names=["doc_id", "n_bytes", "n_words", "n_tokens", "n_unknown"])

        return work

    return map_slices(id_text(docs), make, SCHEMA)
