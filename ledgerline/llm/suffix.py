"""Suffix-array deduplication: symbols covered by a string of `length` symbols that also starts anywhere else.

Symbols are the bytes of a text, or its words (lower case, told apart by a 64-bit hash), so that a passage of words
is found whatever its white space and however few bytes its words have.

1. Every start of a string of `length` symbols takes as key the least hash of the `gram`-symbol strings in it, so equal
   strings take equal keys. Neighbouring starts of one key, LONGEST at most, are a run; a run is kept as (key, hash of
   its symbols, place). This only narrows the search: no repeat is lost.
2. Runs of equal symbols are one class. A class of several runs is repeated throughout; of a class of one run,
   where its key has other classes, or where it holds its key's gram more than once, the symbols are fetched.
3. The fetched runs of a key meet in one task. There a suffix array gives the Burrows-Wheeler transform, and
   threshold-bounded interval expansion derives the common prefixes: intervals of strings are extended
   backwards breadth first, each new interval fixes the common prefix at its end, by increasing value, and the
   expansion stops at `length`. What is not fixed by then has a common prefix of at least `length`: repeated.
   A key whose classes have more than MOST symbols is not gathered as it is: its runs are cut again by keys of another
   hash, which equal strings share as well, and the parts go the same way. Parts that are still too large
   (a passage with the same surroundings thousands of times) are counted by 128-bit digests in a shuffle that
   combines equal ones first.

Nulls and texts shorter than `length` have nothing removed. Repeated rows repeat each other. Strings are judged on
the input, document by document; a doc_id may be null or repeated: rows are told apart by file and place. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import RID, numbered, saved
from ledgerline.llm.textarrays import fold, ragged, raw_bytes, slices, sum_by, xxh64

LENGTH, GRAM = 400, 64
#: Words of a passage that is repeated, and of the strings whose hashes are its keys.
PASSAGE, PASSAGE_GRAM = 50, 8
#: Starts in a run at most; symbols of a key's classes that one task takes together; symbols after which a transform is made.
LONGEST, MOST, BLOCK = 1 << 16, 1 << 22, 1 << 20
#: Text bytes hashed at once: some twenty numbers of eight bytes are held for each.
HASHED_BYTES = 1 << 20
RUNS = "rid long, key long, body long, lo long, hi long, twice boolean"
U = np.uint64


def byte_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts on end, and the offsets of each text's."""
    return raw_bytes(texts)


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    f = fold(texts)
    return xxh64(f.buf, f.start, f.size), f.first


SYMBOLS = {"byte": (byte_symbols, np.uint8), "word": (word_symbols, U)}


class Roller:
    """Hashes of substrings of a byte array from one running sum."""

    # Fixed value: an odd multiplier with well-mixed bits; its powers and its inverse's powers are kept.
    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 1):
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, U)
        self.factor = self.table[0] | U(1)  # for symbols that are hashes already
        self.up = self.down = np.ones(1, U)

    def load(self, data: np.ndarray) -> "Roller":
        if len(self.up) <= len(data):
            n = len(data) + 1
            self.up = np.cumprod(np.append(U(1), np.full(n, U(self.BASE))))
            self.down = np.cumprod(np.append(U(1), np.full(n, U(pow(self.BASE, -1, 1 << 64)))))
        values = self.table[data] if data.dtype == np.uint8 else data * self.factor
        self.sums = np.append(U(0), np.cumsum(values * self.up[: len(data)]))
        return self

    def hash(self, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
        x = (self.sums[hi] - self.sums[lo]) * self.down[lo]
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(29))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours: running minima forwards and backwards in blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.append(x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs_of(data: np.ndarray, off: np.ndarray, length: int, gram: int, roller: Roller) -> tuple[np.ndarray, ...]:
    """Document, key, body hash, first and last start (in the document) of every run, and whether it holds its key's gram twice."""
    size = np.diff(off)
    count = np.maximum(size - length + 1, 0)
    if not count.any():
        return *(np.empty(0, np.int64),) * 5, np.empty(0, bool)
    roller.load(data)
    n = len(data) - gram + 1
    width = length - gram + 1
    hashes = roller.hash(slice(0, n), slice(gram, gram + n))
    least = sliding_least(hashes, width)
    at = ragged(off[:-1], count)
    doc = np.repeat(np.arange(len(size)), count)
    key = least[at]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1
    pieces = (hi - lo) // LONGEST + 1
    if len(lo) < pieces.sum():
        lo = ragged(np.zeros(len(lo), np.int64), pieces) * LONGEST + np.repeat(lo, pieces)
        hi = np.minimum(lo + LONGEST - 1, np.repeat(hi, pieces))
    first, last, d = at[lo], at[hi], doc[lo]
    body = roller.hash(first, last + length) ^ (last - first).astype(U)
    edge = np.full(width - 1, ~U(0))
    chosen = np.flatnonzero(hashes == ~sliding_least(np.concatenate([edge, ~least, edge]), width))  # least of some string's grams
    a, b = np.searchsorted(chosen, first), np.searchsorted(chosen, last + width)
    own = hashes[chosen[ragged(a, b - a)]] == np.repeat(key[lo], b - a)
    twice = sum_by(own.astype(np.int64), b - a) > 1
    return d, key[lo].view(np.int64), body.view(np.int64), first - off[d], last - off[d], twice


def _order(key: np.ndarray, most: int, stable: bool = False) -> np.ndarray:
    """Places of key in rising order, ties in any or in theirs; most: the largest key. Sorting numbers that carry their place beats argsort by far where they fit."""
    bits = len(key).bit_length()
    if int(most).bit_length() + bits > 63:
        return np.argsort(key, kind="stable" if stable else None)
    packed = key << bits | np.arange(len(key))
    packed.sort()
    return packed & ((1 << bits) - 1)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first `depth` symbols at least, ties in any order. text: small numbers, the last one the least and there once."""
    n = len(text)
    bits = int(text.max()).bit_length()
    h = max(1, min(4, 36 // bits))
    symbols = np.append(text, np.zeros(8, text.dtype)).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = key << bits | symbols[j : j + n]
    most = (1 << bits * h) - 1
    while True:
        order = _order(key, most)
        ranks = np.cumsum(np.append(False, np.diff(key[order]) != 0))
        if h >= depth or ranks[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        key = rank * (n + 1)
        if h < n:
            key[: n - h] += rank[h:] + 1
        most = (n + 1) * (n + 1)
        h *= 2


def common_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """text ends with a least symbol. Suffix order, and for each place in it the common prefix with the one before, or -1 if it is at least `length`."""
    n = len(text)
    order = suffix_order(text, length + 1)
    before = text[order - 1]  # the Burrows-Wheeler transform; the text counts as a ring with one end mark
    kinds = int(text.max()) + 1
    back = np.empty(n, np.int64)  # equal symbols keep their order, so an interval's part with one symbol is an interval again, whatever the order of ties
    back[_order(before, kinds - 1, stable=True)] = np.arange(n)
    change = np.append(np.flatnonzero(before[1:] != before[:-1]), n - 1)
    alike = np.repeat(change, np.diff(np.append(-1, change)))  # where the run of one symbol ends
    prefix = np.full(n + 1, -1, np.int32)
    prefix[0] = prefix[n] = 0
    lb, rb = np.array([0]), np.array([n - 1])
    for known in range(length):
        if not len(lb):
            break
        one = alike[lb] >= rb
        whole, size = back[lb[one]], (rb - lb)[one]
        lb, rb = lb[~one], rb[~one]
        members = ragged(lb, rb - lb + 1)
        key = np.repeat(np.arange(len(lb)), rb - lb + 1) * kinds + before[members]
        by = _order(key, len(lb) * kinds, stable=True)
        key = key[by]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else by
        part = back[members[by[first]]]
        lb, rb = np.concatenate([whole, part]), np.concatenate([whole + size, part + np.diff(np.append(first, len(key))) - 1])
        fresh = prefix[rb + 1] < 0
        prefix[rb[fresh] + 1] = known
        lb, rb = lb[fresh], rb[fresh]
    return order, prefix[:n]


def repeated_starts(bodies: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each body, whether the string of `length` symbols at each of its starts is there twice."""
    sizes = np.array([len(b) for b in bodies])
    text = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    begin = np.cumsum(sizes + 1) - sizes
    symbols = np.concatenate(bodies)
    text[ragged(begin, sizes)] = (symbols.astype(np.int64) if symbols.dtype == np.uint8 else np.unique(symbols, return_inverse=True)[1]) + 2
    text[begin - 1] = 1
    order, prefix = common_prefixes(text, length)
    again = prefix < 0
    both = again | np.append(again[1:], False)
    flag = np.zeros(len(text), bool)
    flag[order] = both
    return [flag[b : b + n - length + 1] for b, n in zip(begin.tolist(), sizes.tolist())]


def _ranges(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def _placed(docs: DataFrame, *more: str) -> DataFrame:
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return numbered(columns, "documents").withColumnRenamed(RID, "rid")


def duplicate_ranges(placed: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: str = "byte") -> DataFrame:
    """rid, lo, hi: ranges of starts of repeated strings. placed: rid, text."""
    symbols, kind = SYMBOLS[unit]

    def find(batches):
        roller = Roller()
        for batch in batches:
            for part in slices(batch, most=HASHED_BYTES):
                doc, key, *rest = runs_of(*symbols(part.column("text")), length, gram, roller)
                yield pa.RecordBatch.from_arrays([part.column("rid").take(pa.array(doc)), *map(pa.array, (key, *rest))], names=["rid", "key", "body", "lo", "hi", "twice"])

    runs = saved(placed.select("rid", "text").mapInArrow(find, RUNS), "runs")
    classes = runs.groupBy("key", "body").agg(F.count("*").alias("n"), F.min(F.struct("rid", "lo", "hi", "twice")).alias("at"))
    size = F.col("at.hi") - F.col("at.lo") + length
    keys = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(size).alias("symbols"))
    alone = (F.col("n") == 1) & (F.col("kinds") == 1) & ~F.col("at.twice")
    known = classes.join(keys, "key").filter(~alone).select("key", "body", "n", "kinds", "symbols", "at.twice", "at.rid", "at.lo", "at.hi")
    known = saved(known, "classes")
    asked = known.filter((F.col("kinds") > 1) | (F.col("n") == 1)).select("key", "n", "symbols", "rid", "lo", "hi")
    copies = known.filter("n > 1").select("key", "body")
    whole = runs.join(copies, ["key", "body"], "left_semi").select("rid", "lo", "hi")

    want = F.struct("key", "n", "symbols", "lo", "hi")
    bodies = asked.groupBy("rid").agg(F.collect_list(want).alias("wanted")).join(placed, "rid")  # with all its columns: the same exchange serves the last join

    def fetch(batches):
        for batch in batches:
            for part in slices(batch):
                wanted = part.column("wanted")
                data, off = symbols(part.column("text"))
                rows = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
                got = wanted.flatten()
                lo, hi = got.field("lo").to_numpy(), got.field("hi").to_numpy()
                a, b = off[rows] + lo, off[rows] + hi + length
                for x in range(0, len(rows), 4096):
                    piece = got.slice(x, 4096)
                    columns = [piece.field("key"), piece.field("n"), piece.field("symbols"), part.column("rid").take(pa.array(rows[x : x + 4096])), piece.field("lo"), _binary(data, a[x : x + 4096], b[x : x + 4096])]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "symbols", "rid", "lo", "data"])

    fetched = bodies.mapInArrow(fetch, BODIES)
    hot = asked.filter(F.col("symbols") > MOST).limit(1).count() > 0
    if not hot:
        return whole.union(_expanded(fetched, length, kind))
    fetched = saved(fetched, "bodies")
    parts = saved(_cut_again(fetched.filter(F.col("symbols") > MOST), length, gram, kind), "parts")
    sizes = parts.groupBy("key").agg(F.sum(F.octet_length("data") / kind().itemsize).cast("long").alias("symbols"))
    parts = parts.drop("symbols").join(sizes, "key").select(fetched.columns)
    small = fetched.filter(F.col("symbols") <= MOST).union(parts.filter(F.col("symbols") <= MOST))
    return whole.union(_expanded(small, length, kind)).union(_by_digest(parts.filter(F.col("symbols") > MOST), length, kind))


BODIES = "key long, n long, symbols long, rid long, lo long, data binary"


def _binary(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """data[a:b] for each pair, as its bytes."""
    ends = np.append(0, np.cumsum(b - a)) * data.itemsize
    body = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[ragged(a, b - a)])])
    return body.cast(pa.binary())


def _expanded(fetched: DataFrame, length: int, kind: type) -> DataFrame:
    """rid, lo, hi of repeated starts among the bodies of each key, for those of classes of one run."""

    def expand(batches):
        open_: list[tuple] = []
        held = 0

        def work():
            flags = repeated_starts([np.frombuffer(o[4], kind) for o in open_], length)
            found = [(o[2], o[3] + a, o[3] + b) for o, f in zip(open_, flags) if o[1] == 1 for a, b in zip(*_ranges(f))]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["rid", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "rid", "lo", "data"))):
                if held > BLOCK and row[0] != open_[-1][0]:
                    yield work()
                    open_, held = [], 0
                open_.append(row)
                held += len(row[4]) // kind().itemsize
        if open_:
            yield work()

    return fetched.repartition("key").sortWithinPartitions("key").mapInArrow(expand, "rid long, lo long, hi long")


def _cut_again(fetched: DataFrame, length: int, gram: int, kind: type) -> DataFrame:
    """The bodies cut into runs by keys of another hash: strings that are equal share the new key too, which also holds the old one."""

    def cut(batches):
        roller = Roller(2)
        for batch in batches:
            for one in (batch.slice(i, 1) for i in range(batch.num_rows)):
                data = np.frombuffer(one.column("data")[0].as_py(), kind)
                _, key, _, lo, hi, _ = runs_of(data, np.array([0, len(data)]), length, gram, roller)
                old = one.column("key").to_numpy()[0]
                same = [pa.array(np.repeat(one.column(c).to_numpy(), len(key))) for c in ("n", "symbols", "rid")]
                yield pa.RecordBatch.from_arrays([pa.array(key ^ (old << 1 ^ old >> 3)), *same, pa.array(one.column("lo").to_numpy()[0] + lo), _binary(data, lo, hi + length)], names=["key", "n", "symbols", "rid", "lo", "data"])

    return fetched.mapInArrow(cut, BODIES)


def _by_digest(fetched: DataFrame, length: int, kind: type) -> DataFrame:
    """rid, lo, hi of the strings that are in several runs of fetched, by 128-bit digests."""

    def digests(batches):
        one, two = Roller(11), Roller(12)
        for batch in batches:
            for rid, lo, n, body in zip(*(batch.column(c).to_pylist() for c in ("rid", "lo", "n", "data"))):
                data = np.frombuffer(body, kind)
                at = np.arange(len(data) - length + 1)
                a, b = one.load(data).hash(at, at + length), two.load(data).hash(at, at + length)
                rows = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(rows, rid)), pa.array(lo + at), pa.array(np.full(rows, n))], names=["a", "b", "rid", "lo", "n"])

    strings = fetched.mapInArrow(digests, "a long, b long, rid long, lo long, n long")
    many = strings.groupBy("a", "b").agg(F.count("*").alias("c")).filter("c > 1").select("a", "b")
    return strings.filter("n = 1").join(many, ["a", "b"], "left_semi").select("rid", "lo", F.col("lo").alias("hi"))


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end of the bytes removed), kept (the bytes left, on end).

    passage: also passage_words, the words in strings of that many words that start anywhere else too, found the same way; they are not removed.
    """
    return _cut(_placed(docs), "doc_id", "long", length, gram, "byte", passage)


def shortened(docs: DataFrame, length: int = PASSAGE, gram: int = PASSAGE_GRAM, unit: str = "word") -> DataFrame:
    """docs without the passages of at least `length` words (or bytes) that are anywhere else too; n_chars, if there, is counted anew.

    A word goes with the white space up to the next one; of bytes, characters cut in two are dropped. Other texts stay as they are, nulls too.
    """
    names = docs.columns
    rest = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index("text")
    others = [f"c{i}" for i in range(len(names)) if i != at]
    packed = rest.select(F.struct(F.col(f"c{at}").isNull().alias("none"), *others).alias("__rest"), F.col(f"c{at}").alias("text"), F.lit(None).cast("long").alias("doc_id"))
    kind = packed.schema["__rest"].dataType.simpleString()
    cut = _cut(_placed(packed, "__rest"), "__rest", kind, length, gram, unit)
    # bytes of whole characters decode as they are; a character that a cut has split is dropped
    kept = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(kept), kept).otherwise(_whole_characters(F.col("kept")))
    out = cut.select(F.when(~F.col("__rest.none"), text).alias("text"), "__rest", (F.size("spans") > 0).alias("changed"))
    columns = [F.col("text") if i == at else F.col(f"__rest.c{i}") for i in range(len(names))]
    if "n_chars" in names:
        i = names.index("n_chars")
        columns[i] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns[i])
    return out.select(*(c.alias(n) for c, n in zip(columns, names)))


def _whole_characters(raw):
    """Malformed bytes become U+FFFD and are taken out; texts hold no U+FFFD of their own beside a cut that matters."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\uFFFD", "")


def _covered(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, count: int) -> np.ndarray:
    """How much the ranges lo:hi of each row cover together."""
    size = np.zeros(count, np.int64)
    np.maximum.at(size, rows, hi)
    off = np.append(0, np.cumsum(size))
    edge = np.zeros(off[-1] + 1, np.int64)
    np.add.at(edge, off[rows] + lo, 1)
    np.add.at(edge, off[rows] + hi, -1)
    return sum_by((np.cumsum(edge[:-1]) > 0).astype(np.int64), size)


def _ranges_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, lo and hi of a column of lists of ranges, or of nulls."""
    rows = np.repeat(np.arange(len(column)), np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    got = column.flatten()
    return rows, got.field("lo").to_numpy(), got.field("hi").to_numpy()


def _cut(placed: DataFrame, carried: str, kind: str, length: int, gram: int, unit: str, passage: int | None = None) -> DataFrame:
    """carried, n_bytes, spans, kept; with passage, passage_words."""
    listed = lambda ranges, name: ranges.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias(name))
    joined = placed.join(listed(duplicate_ranges(placed, length, gram, unit), "ranges"), "rid", "left")
    if passage:
        joined = joined.join(listed(duplicate_ranges(placed, passage, min(PASSAGE_GRAM, passage), "word"), "said"), "rid", "left")

    def places(texts: pa.Array, data: np.ndarray, off: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        if unit == "byte":
            return off[rows] + lo, off[rows] + hi + length
        f = fold(texts)
        begin = np.append(f.begin, len(data))
        first, last = f.first[rows] + lo, f.first[rows] + hi + length
        return begin[first], np.where(last < f.first[rows + 1], begin[last], off[rows + 1])

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                data, off = raw_bytes(texts)
                rows, lo, hi = _ranges_in(part.column("ranges"))
                lo, hi = places(texts, data, off, rows, lo, hi)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi, -1)
                gone = np.cumsum(edge[:-1]) > 0
                starts = gone.copy()
                starts[1:] &= ~gone[:-1]
                inner = off[(off > 0) & (off < len(data))]
                starts[inner] = gone[inner]
                stops = gone.copy()
                stops[:-1] &= ~gone[1:]
                stops[inner - 1] = gone[inner - 1]
                a, b = np.flatnonzero(starts), np.flatnonzero(stops) + 1
                doc = np.searchsorted(off, a, side="right") - 1
                count = np.searchsorted(a, off)
                spans = pa.StructArray.from_arrays([pa.array(a - off[doc]), pa.array(b - off[doc])], names=["start", "end"])
                left = np.append(0, np.cumsum(~gone))[off]
                kept = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
                out = {carried: part.column(carried), "n_bytes": pa.array(np.diff(off)), "spans": pa.ListArray.from_arrays(pa.array(count.astype(np.int32)), spans), "kept": kept.cast(pa.binary())}
                if passage:
                    rows, lo, hi = _ranges_in(part.column("said"))
                    out["passage_words"] = pa.array(_covered(rows, lo, hi + passage, part.num_rows))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    more = ", passage_words long" if passage else ""
    return joined.mapInArrow(cut, f"{carried} {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary{more}")
