"""Ids of a public tokenizer for all texts of an Arrow batch, each different part of a word encoded once."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerline.llm.textarrays import ragged, raw_bytes, sum_by

#: Parts of words that one encoder remembers; parts met later are encoded each time they are met.
REMEMBERED = 600_000

ODD, LETTER, DIGIT, MARK = range(4)
#: The classes of WordEncoder.SPLIT by byte; a byte above 0x7F is a letter's where 0xC3 leads it. The quote may open a contraction, so it is odd.
KIND = np.full(256, ODD, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
KIND[0x80:0xC0] = KIND[0xC3] = LETTER
KIND[ord("'")] = ODD
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def cut(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All parts of all words on end, the number of parts of each word, and which parts are odd: whole words, as they are, that hold
    more than letters (ASCII or Latin-1), digits and marks, or hold a quote or the opening of a special token. The other parts are in lower case.

    An odd part never equals one that is not odd, as no such part holds what makes a word odd.
    """
    data, off = raw_bytes(words)
    size = np.diff(off)
    first = off[:-1][size > 0]
    kind, low = KIND[data], LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[after]
    low[after[(second <= 0x9E) & (second != 0x97)]] += 0x20
    kind[after[(second == 0x97) | (second == 0xB7)]] = ODD
    bad = kind == ODD
    opening = (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    opening[first[1:] - 1] = False
    bad[:-1] |= opening
    odd = np.zeros(len(words), bool)
    odd[size > 0] = np.logical_or.reduceat(bad, first)
    within = np.repeat(odd, size)
    np.copyto(low, data, where=within)
    begin = ~within
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begin[first] = True
    starts = np.flatnonzero(begin)
    parts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(low)])
    count = np.diff(np.searchsorted(starts, off))
    return parts, count, np.repeat(odd, count)


class WordEncoder:
    """encode(texts) gives the ids a tokenizers file gives with add_special_tokens=False.

    It needs a tokenizer that drops white space and never joins across it, as word_bpe_49k.json does.
    Plain words (printable ASCII and Latin-1 letters) are cut as the tokenizer's own split pattern cuts them, and their parts,
    which are fewer than the words that hold them, go straight to the BPE model; all others, and any that
    hold the opening of a special token, go through the whole tokenizer.
    """

    # Fixed value: the tokenizer's split pattern, its letter and digit classes written out for plain words.
    PLAIN = re.compile(r"[\x21-\x7eß-öø-ÿ]+")
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spare = iter(range(256, 512))
        self.alphabet = {b: b if b in shown else next(spare) for b in range(256)}
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def part(self, text: str) -> list[int]:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(shown)]

    def word(self, word: str) -> list[int]:
        """An odd word's ids."""
        plain = word.lower()
        if self.PLAIN.fullmatch(plain) and "<|" not in word and (word.isascii() or unicodedata.is_normalized("NFC", word)):
            return [i for p in self.SPLIT.findall(plain) for i in self.part(p)]
        return self.whole.encode(word, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and the number of ids of each text."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        parts, per_word, odd = cut(coded.dictionary)
        met = parts.dictionary_encode()
        which = met.indices.to_numpy(zero_copy_only=False)
        found = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        coder = [self.part] * len(found)
        for k in np.unique(which[odd]).tolist():
            coder[k] = self.word
        known, ends = self.known, self.ends
        index = [known.get(p, -1) for p in found]
        new: list[int] = []
        sizes: list[int] = []
        missing = [k for k, n in enumerate(index) if n < 0]
        for k in missing:
            got = coder[k](found[k])
            new += got
            sizes.append(len(got))
        first = ends[-1]
        fresh = np.array(new, np.uint32)
        size = np.array(sizes, np.int64)
        room = max(0, min(len(missing), REMEMBERED - len(known)))  # the parts remembered come first
        hold = int(size[:room].sum())
        while first + hold > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[first : first + hold] = fresh[:hold]
        for k in missing[:room]:
            known[found[k]] = len(known)
        self.ends = np.concatenate([ends, first + np.cumsum(size[:room])])
        pool = np.concatenate([self.ids[:first], fresh])
        index = np.array(index, np.int64)
        old = index >= 0
        at = np.empty((len(found), 2), np.int64)
        at[old, 0], at[old, 1] = ends[index[old]], ends[index[old] + 1] - ends[index[old]]
        at[~old, 0], at[~old, 1] = first + np.cumsum(size) - size, size
        size = at[which, 1]
        pool = pool[ragged(at[which, 0], size)]  # from here on the ids of all different words
        size = sum_by(size, per_word)
        begin = np.cumsum(size) - size
        place = coded.indices.to_numpy(zero_copy_only=False)
        size = size[place]
        ids = pool[ragged(begin[place], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        last = np.cumsum(counts)
        return ids, ends[last] - ends[last - counts]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by end_id."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    hold = np.ones(len(out), bool)
    hold[np.cumsum(counts + 1) - 1] = False
    out[hold] = ids
    return out, counts + 1
