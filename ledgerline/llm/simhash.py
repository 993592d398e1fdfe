"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits, one for each bit position set in over half of the XXH64 values (seed 42) of all word
shingles, repeats included.

near_duplicates(): two fingerprints link at t or fewer differing bits. The anchors are the words of a covering code on
46 of the 64 bits, two perfect binary Golay codes [23, 12] side by side. Each 23-bit half lies within 3 bits of exactly
one code word, its home. A fingerprint within t bits of x lies, in the two halves together, at most t bits further from
x's home than the covering radius allows, so it is enough to replicate every fingerprint to all anchors within covering
radius plus threshold and to compare it there with the fingerprints that are at home: no link is lost, whatever the
data. Equal fingerprints are one class throughout, so copies are never expanded into pairs; distinct fingerprints
within t bits of one are bounded in number, so links grow with the classes. There are 2**24 anchors: with very
many more classes than that, cells fill up in proportion.

one_of_each(): texts are near-duplicates at a Jaccard similarity of their shingle sets of 0.8 or more. Fingerprints of
such texts differ in some 15 % of their bits, more than any one covering can meet, so fingerprints are longer (WIDE
bits, each set by the same rule for hashes mixed from XXH64), and there are TABLES coverings, each on bits of its own: a
Golay code [23, 12] beside Hamming codes [7, 4], perfect too, so that each fingerprint lies within the covering radius of
exactly one anchor of each table. Fingerprints that meet at an anchor and differ in at most NEAR of their first 128
bits are candidates; every link is then verified on the whole sets of shingles. A pair at 0.8 shares no anchor with chance
0.01, one at 0.85 with 0.002, and of several rows at an anchor each meets the nearest before it alone; so what the fingerprints leave
in different components is then joined exactly (remaining()): no link is lost, whatever the data. Hamming codes are added, and tables with them, as the classes grow (see tables_for), so
that the classes at an anchor stay few.

No table of these is sent to all executors: Spark takes what comes out of Python to be as large as what went in, and so
would gather the replicas of all classes on the driver. Every join here has a hint for sorting instead.

Texts without words (null, empty, blank) have fingerprint zero and link like any other. Repeated rows are rows
of one class. Null doc_ids keep their row and never name a component; a component of null ids alone has a null
id. An empty table gives no rows; other columns are not read, and one_of_each() keeps them whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.storage import RID, Passing, numbered, saved, tidy
from ledgerline.llm.textarrays import P1, P2, fold, id_text, map_slices, ragged, word_runs, xxh64

BITS = 23
GOLAY = 0xC75  # Fixed value: generator polynomial of the binary Golay code [23, 12].
RADIUS = 3
#: Shingles, similarity and fingerprints of near-duplicate texts.
WORDS, SIMILARITY = 5, 0.8
WIDE, TABLES, NEAR = 512, 96, 34
#: Tables at whose anchors classes meet first, and how many of the others are spread at once.
FEW, AT_ONCE = 12, 24
#: Rows of one anchor that later rows are compared with; beyond them only those that were like no row before them.
MOST = 1 << 20
#: Texts, about, whose shingles tell which are common, and how many of these are told apart.
SAMPLE, COMMON = 1 << 14, 1 << 17


def majority(hashes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """For each group of consecutive hashes, the bits set in over half of them; zero for an empty group.

    Eight bits of each hash, one of every byte, are added up at a time in eight counters of a byte, 255 hashes at most; then these sums are.
    """
    out = np.zeros(len(runs), np.uint64)
    full = np.flatnonzero(runs)
    if not len(full):
        return out
    runs = runs[full]
    pieces = -(-runs // 255)
    at = np.repeat(np.cumsum(runs) - runs, pieces) + ragged(np.zeros(len(runs), np.int64), pieces) * 255
    first = np.cumsum(pieces) - pieces
    counts = np.empty((len(runs), 64), np.int64)
    for b in range(8):
        lanes = (hashes >> np.uint64(b)) & np.uint64(0x0101010101010101)
        counts[:, b::8] = np.add.reduceat(np.add.reduceat(lanes, at).view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * counts > runs[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def make():
        def work(part: pa.RecordBatch):
            f = fold(part.column("text"))
            start, size, runs = word_runs(f, words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(majority(xxh64(f.buf, start, size), runs).view(np.int64))], names=["doc_id", "fp"])

        return work

    return map_slices(id_text(docs), make, "doc_id long, fp long")


class Anchors:
    """For a 23-bit word: its home, and the code words up to t bits beyond the covering radius, by excess.

    No table has an entry for each of the 2**23 words: every task makes its own, in two workers of an executor at once.
    """

    def __init__(self, t: int):
        info = np.arange(1 << 12, dtype=np.int64)
        self.high = self._mod(info << 11)  # 11 bits
        code = info << 11 ^ self.high
        one = np.append(0, 1 << np.arange(BITS, dtype=np.int64))
        near = np.unique(one[:, None, None] | one[None, :, None] | one)  # of up to RADIUS bits
        leader = np.zeros(1 << 11, np.int64)
        leader[self.syndrome(near)] = near
        self.leader = leader
        self.lists = []
        far = np.concatenate([np.bitwise_count(code ^ leader[k : k + 64, None]) for k in range(0, 1 << 11, 64)])
        for e in range(t + 1):
            at, word = np.nonzero(far == RADIUS + e if e else far <= RADIUS)
            count = np.bincount(at, minlength=1 << 11)
            self.lists.append((np.cumsum(count) - count, count, info[word]))

    @staticmethod
    def _mod(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for b in range(BITS - 1, 10, -1):
            x ^= np.where((x >> b) & 1, GOLAY << (b - 11), 0)
        return x

    def syndrome(self, w: np.ndarray) -> np.ndarray:
        """The remainder of w: that of its upper 12 bits and the lower 11, which are their own."""
        return self.high[w >> 11] ^ (w & (1 << 11) - 1)

    def home(self, w: np.ndarray) -> np.ndarray:
        return (w ^ self.leader[self.syndrome(w)]) >> 11


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = fp.view(np.uint64)
    low = np.uint64((1 << BITS) - 1)
    return (u & low).astype(np.int64), ((u >> np.uint64(BITS)) & low).astype(np.int64)


def homes(fp: np.ndarray, a: Anchors) -> np.ndarray:
    x, y = _halves(fp)
    return a.home(x) << 12 | a.home(y)


def replicas(fp: np.ndarray, a: Anchors, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of fp and anchor of each replica."""
    x, y = _halves(fp)
    hx, hy, sx, sy = a.home(x), a.home(y), a.syndrome(x), a.syndrome(y)
    rows, keys = [], []
    for ex in range(t + 1):
        for ey in range(t + 1 - ex):
            (bx, cx, ix), (by, cy, iy) = a.lists[ex], a.lists[ey]
            count = cx[sx] * cy[sy]
            row = np.repeat(np.arange(len(fp)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            wide = cy[sy][row]
            rows.append(row)
            keys.append((hx[row] ^ ix[bx[sx][row] + k // wide]) << 12 | (hy[row] ^ iy[by[sy][row] + k % wide]))
    return np.concatenate(rows), np.concatenate(keys)


def links(classes: DataFrame, t: int = 2) -> DataFrame:
    """a, b: all pairs of different fingerprints of column fp that differ in at most t bits, once each."""

    def at_home(batches):
        anchors = Anchors(t)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(homes(b.column("fp").to_numpy(), anchors).astype(np.int32)), b.column("fp")], names=["anchor", "a"])

    def everywhere(batches):
        anchors = Anchors(t)
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                fp = b.column("fp").to_numpy()[k : k + 4096]
                row, key = replicas(fp, anchors, t)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp[row])], names=["anchor", "b"])

    fps = classes.select("fp")
    home, spread = fps.mapInArrow(at_home, "anchor int, a long"), fps.mapInArrow(everywhere, "anchor int, b long")
    return home.hint("merge").join(spread, "anchor").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= t)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, t: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable by links, the document's own included."""
    marked = saved(fingerprints(docs, words), "fingerprints")
    classes = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    star = components(links(classes, t))
    rooted = classes.hint("merge").join(star.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.hint("merge").join(rooted.hint("merge").join(least, "root").select("fp", "component_id"), "fp", "left")


def tables_for(classes: int) -> tuple[int, int]:
    """Hamming codes beside the Golay code, and tables: one code for up to 2**20 classes, then one for each further 2**4, with 2.15 times the tables each, as a pair at 0.8 stays together in 0.47 of its words."""
    more = max(0, -(-(max(classes, 1).bit_length() - 20) // 4))
    return 1 + more, round(TABLES * 2.15**more)


def hamming_home(w: np.ndarray) -> np.ndarray:
    """Four bits that name the only word of the Hamming code [7, 4] within one bit of a 7-bit word."""
    wrong = np.zeros(len(w), np.int64)
    for b in range(7):
        wrong ^= ((w >> b) & 1) * (b + 1)
    fixed = w ^ np.where(wrong > 0, 1 << np.maximum(wrong - 1, 0), 0)
    return (fixed >> 2 & 1) | (fixed >> 3 & 14)  # places 3, 5, 6 and 7 carry the information


class Tables:
    """Coverings of WIDE-bit fingerprints, each on bits of its own; of these the chosen ones."""

    def __init__(self, codes: int, tables: int, chosen: range | None = None):
        rng = np.random.default_rng(7)
        bits = [rng.choice(WIDE, BITS + 7 * codes, replace=False) for _ in range(tables)]
        self.bits = [(t, bits[t]) for t in chosen or range(tables)]
        self.golay = Anchors(0)

    def keys(self, wide: np.ndarray) -> np.ndarray:
        """wide: a row of WIDE // 8 bytes for each fingerprint. Its anchor in every table, the table's number on top."""
        bit = np.unpackbits(wide, axis=1, bitorder="little")
        out = np.empty((len(wide), len(self.bits)), np.int64)
        for i, (t, chosen) in enumerate(self.bits):
            word = lambda a, b: bit[:, chosen[a:b]].astype(np.int64) @ (1 << np.arange(b - a))  # noqa: E731, B023
            key = np.int64(t) << 12 | self.golay.home(word(0, BITS))
            for at in range(BITS, len(chosen), 7):
                key = key << 4 | hamming_home(word(at, at + 7))
            out[:, i] = key
        return out


def wide_fingerprints(hashes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """A row of WIDE // 8 bytes for each group of consecutive hashes; the first eight are the plain fingerprint."""
    out = np.empty((len(runs), WIDE // 64), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDE // 64):
            mixed = hashes
            if k:
                mixed = (hashes ^ (np.uint64(k) * P2)) * P1
                mixed = (mixed ^ (mixed >> np.uint64(29))) * P2
                mixed ^= mixed >> np.uint64(32)
            out[:, k] = majority(mixed, runs)
    return out.view(np.uint8)


def shingle_sets(hashes: np.ndarray, runs: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(runs)
    return [np.unique(hashes[a:b]) for a, b in zip(ends - runs, ends)]


def apart(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows a and b; fp: two numbers of 64 bits a row."""
    return np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int32)


def meetings(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of their key, the rows that are near an earlier row of their key, and the nearest such row before each."""
    here, there = [], []
    todo, back = np.arange(1, len(key)), 1
    while len(todo):
        todo = todo[todo >= back]
        todo = todo[key[todo] == key[todo - back]]
        near = apart(fp, todo, todo - back) <= NEAR
        here.append(todo[near])
        there.append(todo[near] - back)
        todo, back = todo[~near], back + 1
    return (np.concatenate(here), np.concatenate(there)) if here else (np.empty(0, np.int64),) * 2


def candidates(classes: DataFrame, chosen: range = range(FEW), coverings: tuple[int, int] | None = None) -> DataFrame:
    """a, b, d: pairs of classes (cls, wide; or with root, the component they are known to be in) of different components that meet at an anchor of the
    chosen tables and differ in d <= NEAR of 128 bits, enough of them to join all that do; b is the smaller."""
    coverings = coverings or tables_for(classes.count())
    names = ("key", "cls", "root", "fp", "fp2")

    def spread(batches):
        tables = Tables(*coverings, chosen)
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                wide = np.frombuffer(b"".join(part.column("wide").to_pylist()), np.uint8).reshape(part.num_rows, WIDE // 8)
                keys = tables.keys(wide)
                fp = wide[:, :16].copy().view(np.int64)
                each = (part.column("cls").to_numpy(), part.column("root").to_numpy(), fp[:, 0], fp[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(x, keys.shape[1])) for x in each)], names=list(names))

    def meet(batches):
        kept = [np.empty(0, np.int64)] * len(names)
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in names]
            key, cls, root, *both = (np.concatenate(x) for x in zip(kept, new))
            fp = np.column_stack(both).view(np.uint64)
            old = len(kept[0])
            at, to = meetings(key, fp)
            fresh = (at >= old) & (root[at] != root[to])
            x, y = cls[at[fresh]], cls[to[fresh]]
            d = apart(fp, at[fresh], to[fresh])
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.array(d)], names=["a", "b", "d"])
            last = key == key[-1] if len(key) else np.empty(0, bool)
            if last.sum() > MOST:
                alone = np.ones(len(key), bool)
                alone[at] = False
                last &= alone
            kept = [c[last] for c in (key, cls, root, *both)]

    known = classes.select("cls", "wide", "root" if "root" in classes.columns else F.col("cls").alias("root"))
    rows = known.mapInArrow(spread, "key long, cls long, root long, fp long, fp2 long")
    return rows.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(meet, "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b of the pairs whose sets (cls, set) have at least that Jaccard similarity."""

    def alike(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                    hit.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    one = pairs.select("a", "b").hint("merge").join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a")
    return one.hint("merge").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")


def prefixes(hashes: np.ndarray, runs: np.ndarray, common: np.ndarray, seen: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """Of each group of consecutive hashes, taken as a set, the first in order of (times seen, hash): as many as hold one of every
    set that is so similar. The hashes, their groups, sizes of these sets and places there. common: sorted, with times seen; others 0."""
    group = np.repeat(np.arange(len(runs)), runs)
    order = np.lexsort((hashes, group))
    h, group = hashes[order], group[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (group[1:] != group[:-1])
    h, group = h[new], group[new]
    times = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        times = np.where(common[at] == h, seen[at], 0)
    h = h[np.lexsort((times, group))]
    n = np.bincount(group, minlength=len(runs))
    place = np.arange(len(h)) - (np.cumsum(n) - n)[group]
    keep = place <= (n - np.ceil(similarity * n - 1e-6))[group]
    return h[keep], group[keep], n[group[keep]], place[keep]


def across(key: np.ndarray, root: np.ndarray, cls: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float, most: int = 1 << 18):
    """For rows in order of key and root: pairs of classes of one key and different roots whose sizes and places leave room for the similarity, about so many looked at at once."""
    end = np.searchsorted(key, key, "right")
    edge = np.flatnonzero(np.append((key[1:] != key[:-1]) | (root[1:] != root[:-1]), True)) + 1
    start = edge[np.searchsorted(edge, np.arange(len(key)), "right")]
    count = end - start
    some = np.flatnonzero(count)
    chunk = np.cumsum(count[some]) // most
    for rows in np.split(some, np.flatnonzero(np.diff(chunk)) + 1):
        i, j = np.repeat(rows, count[rows]), ragged(start[rows], count[rows])
        need = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6)
        fits = (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= need)
        x, y = cls[i[fits]], cls[j[fits]]
        yield np.unique(np.column_stack([np.maximum(x, y), np.minimum(x, y)]), axis=0)


def whole_keys(batches, columns: tuple[str, ...]):
    """Columns of Arrow batches in order of the first of them, in pieces that hold all rows of their keys."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        new = [batch.column(c).to_numpy() for c in columns]
        if not len(new[0]):
            continue
        cut = int(np.searchsorted(new[0], new[0][-1]))
        if held and (cut or held[-1][0][-1] != new[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in new])]
            held = []
        elif cut:
            yield [c[:cut] for c in new]
        held.append([c[cut:] for c in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def remaining(texts: DataFrame, roots: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: pairs of classes with different roots, among them all that are so similar; b is the smaller. texts: cls, text, also of rows that are no class; roots: cls, root.

    Two similar sets share one of their first hashes, in whatever order all sets are taken. Hashes that are in several of SAMPLE texts come last:
    so few sets meet at one hash. That order alone depends on the sample, not what is found.
    """
    names = ("key", "cls", "n", "place")

    def hashes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        f = fold(part.column("text"))
        start, size, runs = word_runs(f, words)
        return xxh64(f.buf, start, size), runs

    def make_counts():
        def work(part: pa.RecordBatch):
            sets = shingle_sets(*hashes(part))
            h, c = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

        return work

    every = max(1, roots.count() // SAMPLE)
    counted = map_slices(texts.filter(F.pmod(F.xxhash64("cls"), F.lit(every)) == 0), make_counts, "h long, c long", parts=4)
    with tidy(texts.sparkSession):
        often = counted.groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1").orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    common, seen = often.column("h").to_numpy().view(np.uint64), often.column("c").to_numpy()
    order = np.argsort(common)
    common, seen = common[order], seen[order]

    def make():
        def work(part: pa.RecordBatch):
            h, group, n, place = prefixes(*hashes(part), common, seen, similarity)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(24)).astype(np.int64)), part.column("cls").take(pa.array(group)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], names=list(names))

        return work

    def shared(batches):
        for piece in whole_keys(batches, names):
            key = piece[0]
            several = np.zeros(len(key), bool)
            several[1:] = key[1:] == key[:-1]
            several[:-1] |= several[1:]
            yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in piece], names=list(names))

    def meet(batches):
        for key, root, *rest in whole_keys(batches, ("key", "root", "cls", "n", "place")):
            for pairs in across(key, root, *rest, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    shape = "key long, cls long, n int, place int"
    first = map_slices(texts, make, shape, parts=4).repartition("key").sortWithinPartitions("key").mapInArrow(shared, shape)
    rooted = first.hint("merge").join(roots, "cls").select("key", "root", "cls", "n", "place")
    return rooted.repartition("key").sortWithinPartitions("key", "root").mapInArrow(meet, "a long, b long").distinct()


def similar(classes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """node, root of all classes that links join. classes: cls, wide; texts: cls, text.

    First each class is verified with the nearest it met at anchors of FEW tables; then, of the pairs that these links leave in different components, every one;
    then those in different components that meet in the other tables, so that a group that is joined by then is not met in each of them again; then
    every other pair across components that can be so similar, whether its fingerprints met or not. Where the first tables find nothing, that
    comes at once.
    """
    passing, linked = Passing(classes.sparkSession), Passing(classes.sparkSession)

    def make():
        def work(part: pa.RecordBatch):
            f = fold(part.column("text"))
            start, size, runs = word_runs(f, words)
            got = shingle_sets(xxh64(f.buf, start, size), runs)
            yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([x.view(np.int64) for x in got], pa.list_(pa.int64()))], names=["cls", "set"])

        return work

    def sets_of(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        return passing.saved(map_slices(texts.hint("merge").join(asked, "cls"), make, "cls long, set array<long>", parts=4), "sets")

    def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return linked.saved(verified(pairs, sets, similarity), "links")

    def rooted(columns: list[str], star: DataFrame) -> DataFrame:
        named = star.withColumnRenamed("node", "cls")
        return passing.saved(classes.select(columns).hint("merge").join(named, "cls", "left").select(*columns, F.coalesce("root", "cls").alias("root")), "roots")

    pairs = passing.saved(candidates(classes), "candidates")
    sets = sets_of(pairs)
    nearest = pairs.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    links = alike(nearest, sets)
    star = components(links)
    if not pairs.isEmpty():
        root = lambda c: star.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        rest = pairs.hint("merge").join(nearest, ["a", "b"], "left_anti").hint("merge").join(root("a"), "a", "left").hint("merge").join(root("b"), "b", "left")
        links = links.union(alike(rest.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")), sets))
        star = components(links)
        passing.drop()
        coverings = tables_for(classes.count())
        known = rooted(["cls", "wide"], star)
        met = [passing.saved(candidates(known, range(k, min(k + AT_ONCE, coverings[1])), coverings), "candidates") for k in range(FEW, coverings[1], AT_ONCE)]
        pairs = passing.saved(reduce(DataFrame.union, met).select("a", "b").distinct(), "candidates")
        star = components(links.union(alike(pairs, sets_of(pairs))))
    passing.drop()
    left = passing.saved(remaining(texts, rooted(["cls"], star), words, similarity), "remaining")
    last = alike(left, sets_of(left))
    if not last.isEmpty():
        star = components(star.select(F.col("node").alias("a"), F.col("root").alias("b")).union(last))
    passing.drop()
    linked.drop()
    return star


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component of similar texts: that of the smallest doc_id, of those the one whose text has the least checksum (a null
    text before all), and of equal texts one of them, the first where they are in one file; null ids come last."""
    placed = numbered(docs, "documents")

    def make():
        def work(part: pa.RecordBatch):
            f = fold(part.column("text"))
            start, size, runs = word_runs(f, words)
            hashes = xxh64(f.buf, start, size)
            digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in shingle_sets(hashes, runs)]
            wide = [x.tobytes() for x in wide_fingerprints(hashes, runs)]
            mark = [0 if t is None else zlib.crc32(t.encode()) + 1 for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(mark, pa.int64()), pa.array(digest, pa.binary()), pa.array(wide, pa.binary())], names=["rid", "doc_id", "mark", "digest", "wide"])

        return work

    read = placed.select(F.col(RID).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = map_slices(read, make, "rid long, doc_id long, mark long, digest binary, wide binary", parts=4)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "rid")).alias("first")
    classes = saved(marked.groupBy("digest").agg(F.min("rid").alias("cls"), F.min_by("wide", "rid").alias("wide"), first), "classes")
    star = similar(classes, read.select(F.col("rid").alias("cls"), "text"), words, similarity)
    rooted = classes.select("cls", "first").hint("merge").join(star.withColumnRenamed("node", "cls"), "cls", "left")
    stay = rooted.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.rid").alias(RID))
    return placed.hint("merge").join(stay, RID, "left_semi").select(*(placed[f"`{c}`"] for c in docs.columns))


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
