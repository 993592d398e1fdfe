"""Language-model scores by context-tree weighting over binary-decomposed bytes.

The text that is coded is a document's token sequence: words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z
lowered) with one space between, and an end byte. Every byte is eight binary decisions. Each decision, named by
the bits of the byte already known, has a context tree of its own over the preceding bytes up to DEPTH. At a
node the bits counted give a Krichevsky-Trofimov estimate; the weighted probability of a node is the mean of its
own estimate's block probability and the product of its children's, so all depths are mixed by how well each
explained the corpus. Scores add up log10 of the mixed predictions, and never leave zero for unseen bytes.

Counting: the byte (DEPTH+1)-grams of all learned documents, summed in each task, then by a shuffle; they are dealt into
buckets by the last two bytes of their context, as many as keep a bucket near BUCKET grams. Trees are weighted from the
leaves up, a bucket at a time, and the last two levels by two small aggregations. Every counted node takes part in
prediction: of the counted grams the most frequent, KEPT at most, are scored by all nodes once, and their scores are sent
to the executors, as are the nodes with a context of under two bytes (65,535 at most). Every other gram of a document,
counted or not, travels in an array to its bucket, meets all nodes of the bucket there, and comes back as one sum for each
document and bucket. A bucket is worked on by several tasks, each with a copy of its counts, where the texts came in more
than TASKS tasks.

Base: unigram counts of all words; those that make up at least FREQUENT of all tokens, so at most 1 / FREQUENT
words, are sent to the executors, and the others' (document, word) pairs are joined with the counts, so no word is
a hot key.

Null, empty and blank texts are the end alone. Repeated rows are scored each; null doc_ids are never learned
from where learn is null. Without learned documents every bit has probability one half and the base is 0 or
below by its formula. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import saved, settled
from ledgerline.llm.textarrays import END, Folded, fold, id_text, map_slices, slice_bytes, slices, sum_by, word_strings

DEPTH = 5
#: Grams whose score is sent to the executors at most (16 bytes each).
KEPT = 1 << 20
#: Grams of a bucket, as far as two bytes of context can tell them apart; input tasks that share one copy of a bucket.
BUCKET, TASKS = 1 << 17, 1024
FREQUENT = 2.0**-20
#: Entries that one task sums up before it merges them, and bits of the number of places of the two tables in which a worker looks grams up.
MERGE, PLACES = 1_500_000, (21, 20)
#: Slices are that much smaller than those of other operators: some thirty numbers of eight bytes are held for each byte.
PARTS = 8
U = np.uint64
NODES = "depth int, node long, n0 long, n1 long, weighted double, stop double"


def grams(f: Folded, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of the depth + 1 bytes that end at each coded byte, the last byte lowest; coded bytes per document."""
    sizes = sum_by((f.size + 1).astype(np.int64), f.words)
    sizes = np.where(f.words > 0, sizes, 1)
    stream = np.full(int(sizes.sum()) + depth * len(sizes), END, np.uint8)
    ends = np.cumsum(sizes + depth)
    real = np.ones(len(stream), bool)
    for j in range(depth):
        real[ends - sizes - 1 - j] = False
    written = real.copy()
    written[(ends - 1)[f.words == 0]] = False
    stream[written] = f.buf
    padded = np.concatenate([np.zeros(7, np.uint8), stream])
    code = np.ndarray(len(stream), ">u8", padded, strides=(1,)).astype(U) & U((1 << 8 * (depth + 1)) - 1)  # the eight bytes up to each one
    return code[real], sizes


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.log(x)
    for k in range(1, 8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability, and the share of it that stops at the node. below: summed logs of the children."""
    own = block(n0.astype(float), n1.astype(float))
    if below is None:
        return own, np.ones(len(own))
    weighted = np.logaddexp(own, below) - np.log(2)
    return weighted, np.exp(np.minimum(own - np.log(2) - weighted, 0))


def bit_nodes(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (context, known bits) of the grams, with the zeros and ones counted there."""
    byte, context = code & U(255), code >> U(8) << U(8)
    keys, zero, one = [], [], []
    for i in range(8):
        keys.append(context | U(1 << i) | (byte >> U(8 - i)))
        bit = ((byte >> U(7 - i)) & U(1)).astype(np.int64)
        zero.append(n * (1 - bit))
        one.append(n * bit)
    return _summed(np.concatenate(keys), np.concatenate(zero), np.concatenate(one))


def parent(node: np.ndarray, depth: int) -> np.ndarray:
    """The node one context byte shorter, for nodes of that depth."""
    return node & U((1 << (8 * depth)) - 1)


def subtree(code: np.ndarray, n: np.ndarray, depth: int, top: int):
    """(depth, node, n0, n1, weighted, stop) arrays of levels depth to top."""
    node, n0, n1 = bit_nodes(code, n)
    below = None
    for d in range(depth, top - 1, -1):
        weighted, stop = weigh(n0, n1, below)
        yield d, node, n0, n1, weighted, stop
        if d > top:
            node, n0, n1, below = _summed(parent(node, d), n0, n1, weighted)


def _batch(d: int, node, n0, n1, weighted, stop) -> pa.RecordBatch:
    columns = [np.full(len(node), d, np.int32), node.view(np.int64), n0, n1, weighted, stop]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["depth", "node", "n0", "n1", "weighted", "stop"])


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """code, n over all documents given."""
    most = max(1, slice_bytes() // PARTS)

    def run(batches):
        held = [(np.empty(0, U), np.empty(0, np.int64))]
        for batch in batches:
            for part in slices(batch, most=most):
                code = grams(fold(part.column("text")), depth)[0]
                code.sort()
                first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
                held.append((code[first], np.diff(np.append(first, len(code)))))
                if sum(len(h[0]) for h in held) > MERGE:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    if len(held[0][0]) > MERGE // 2:
                        yield _codes(*held.pop())
                        held = [(np.empty(0, U), np.empty(0, np.int64))]
        yield _codes(*_summed(*map(np.concatenate, zip(*held))))

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _codes(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])


class Model:
    """Nodes by depth: sorted keys, probability of a one, share that stops."""

    def __init__(self, depth: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.depth, self.levels = depth, levels

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        total = np.zeros(len(code))
        byte = code & U(255)
        for i in range(8):
            known = U(1 << i) | (byte >> U(8 - i))
            p, deeper = np.full(len(code), 0.5), np.zeros(len(code), bool)
            for d in range(self.depth, -1, -1):
                keys, one, stop = self.levels[d]
                if not len(keys):
                    continue
                want = ((code >> U(8)) & U((1 << (8 * d)) - 1)) << U(8) | known
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                own = one[at].astype(float)
                p = np.where(hit, np.where(deeper, stop[at] * own + (1 - stop[at]) * p, own), p)
                deeper = hit
            total += np.log10(np.where((byte >> U(7 - i)) & U(1) == 1, p, 1 - p))
        return total


class Scorer:
    """Scores of known grams, found by a place of their own: in one table, else in a second, else by search. NaN for all others."""

    EMPTY = U((1 << 64) - 1)

    def __init__(self, codes: np.ndarray, values: np.ndarray, places: tuple[int, int]):
        """codes: the grams, those that come first get their places first."""
        self.tables = []
        for k, bits in enumerate(places):
            held, score = np.full(1 << bits, self.EMPTY, U), np.zeros(1 << bits)
            at = self._place(codes, k, bits)
            held[at[::-1]], score[at[::-1]] = codes[::-1], values[::-1]
            self.tables.append((bits, held, score))
            left = held[at] != codes
            codes, values = codes[left], values[left]
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]

    @staticmethod
    def _place(code: np.ndarray, table: int, bits: int) -> np.ndarray:
        factor = U((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[table])  # Fixed values: odd numbers with well-mixed bits
        return ((code ^ (code >> U(29))) * factor >> U(64 - bits)).view(np.int64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        out = todo = None
        for k, (bits, held, score) in enumerate(self.tables):
            asked = code if todo is None else code[todo]
            at = self._place(asked, k, bits)
            hit = held[at] == asked
            if todo is None:
                out = np.where(hit, score[at], np.nan)
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] = score[at[hit]]
                todo = todo[~hit]
        if len(self.codes) and len(todo):
            at = np.minimum(np.searchsorted(self.codes, code[todo]), len(self.codes) - 1)
            hit = self.codes[at] == code[todo]
            out[todo[hit]] = self.values[at[hit]]
        return out


def buckets_of(context: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a two-byte context: neighbouring contexts fall apart."""
    return ((context * U(40503) & U(0xFFFF)) % U(buckets)).astype(np.int32)


def _context(code: np.ndarray, top: int) -> np.ndarray:
    return code >> U(8) & U((1 << 8 * top) - 1)


BLOBS = "bucket int, copy int, base long, at binary, code binary, n binary"


def _blob(data: np.ndarray, cuts: list[int]) -> pa.Array:
    """The bytes of data between the cuts."""
    ends = np.array(cuts, np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _cuts(sorted_keys: np.ndarray) -> list[int]:
    return [*np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])).tolist(), len(sorted_keys)] if len(sorted_keys) else [0]


def count_blobs(counts: DataFrame, buckets: int, copies: int, top: int) -> DataFrame:
    """counts (code, n) as arrays by bucket, each for every copy."""

    def run(batches):
        for b in batches:
            code, n = b.column("code").to_numpy().view(U), b.column("n").to_numpy()
            bucket = buckets_of(_context(code, top), buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = _cuts(bucket[order])
            m = len(cuts) - 1
            for copy in range(copies):
                columns = [pa.array(bucket[order][cuts[:-1]]), pa.array(np.full(m, copy, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), _blob(code[order], cuts), _blob(n[order], cuts)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "copy", "base", "at", "code", "n"])

    return counts.select("code", "n").mapInArrow(run, BLOBS)


def by_bucket(batches):
    """(counted codes, their counts, the arrays asked for them) of each bucket; the latter as an iterator to be used up. Rows come in order of bucket, copy and base, counts first."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "copy", "base", "at", "code", "n"))))
    row = next(rows, None)
    while row is not None:
        here, codes, n = row[:2], [np.empty(0, U)], [np.empty(0, np.int64)]
        while row is not None and row[:2] == here and row[2] is None:
            codes.append(np.frombuffer(row[4], U))
            n.append(np.frombuffer(row[5], np.int64))
            row = next(rows, None)

        def asked():
            nonlocal row
            while row is not None and row[:2] == here:  # noqa: B023
                yield row[2], np.frombuffer(row[3], np.int32), np.frombuffer(row[4], U), np.frombuffer(row[5], np.int32)
                row = next(rows, None)

        yield np.concatenate(codes), np.concatenate(n), asked()
        for _ in asked():
            pass


def _dealt(blobs: DataFrame) -> DataFrame:
    return blobs.repartition("bucket", "copy").sortWithinPartitions("bucket", "copy", "base")


@dataclass
class Fitted:
    """first: the nodes of the levels above those of the buckets; codes, values: grams and their scores, the most frequent first; counts: code, n of all."""

    first: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    codes: np.ndarray
    values: np.ndarray
    counts: DataFrame
    buckets: int


def _level(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return node, ((n1 + 0.5) / (n0 + n1 + 1)).astype(np.float32), stop.astype(np.float32)


def bucket_model(code: np.ndarray, n: np.ndarray, first: list, depth: int, top: int) -> Model:
    """All nodes of a bucket, below the first levels."""
    levels = [*first, *[_level(np.empty(0, U), *(np.empty(0),) * 3)] * (depth + 1 - top)]
    for d, node, n0, n1, _, stop in subtree(code, n, depth, top) if len(code) else ():
        levels[d] = _level(node, n0, n1, stop)
    return Model(depth, levels)


def fit(docs: DataFrame, depth: int = DEPTH, most: int = KEPT) -> Fitted:
    """The context tree of all documents given."""
    top = min(2, depth)
    counts = saved(gram_counts(id_text(docs), depth), "grams")
    kinds = counts.count()
    buckets = max(1, -(-kinds // BUCKET))
    blobs = _dealt(count_blobs(counts, buckets, 1, top))

    def weigh_subtrees(batches):
        for code, n, _ in by_bucket(batches):
            for d, node, n0, n1, weighted, stop in subtree(code, n, depth, top):
                if d == top:
                    yield _batch(d, node, n0, n1, weighted, stop)

    level = saved(blobs.mapInArrow(weigh_subtrees, NODES), "nodes")
    first = []
    for d in range(top - 1, -1, -1):
        up = level.groupBy(F.col("node").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1).cast("long")).alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))

        def weigh_level(batches, d=d):
            for b in batches:
                n0, n1 = b.column("n0").to_numpy(), b.column("n1").to_numpy()
                yield _batch(d, b.column("node").to_numpy().view(U), n0, n1, *weigh(n0, n1, b.column("below").to_numpy()))

        level = saved(up.mapInArrow(weigh_level, NODES), "nodes")
        got = level.toArrow()  # at most 255 times 1 or 256 rows
        node, n0, n1, stop = (got.column(c).to_numpy() for c in ("node", "n0", "n1", "stop"))
        order = np.argsort(node.view(U))
        first.insert(0, _level(node.view(U)[order], n0[order], n1[order], stop[order]))
    least = _least(counts, most)
    head = docs.sparkSession.sparkContext.broadcast(first)

    def score(batches):
        for code, n, _ in by_bucket(batches):
            want = n >= least
            if want.any():
                value = bucket_model(code, n, head.value, depth, top).log10(code[want])
                yield pa.RecordBatch.from_arrays([pa.array(code[want].view(np.int64)), pa.array(n[want]), pa.array(value)], names=["code", "n", "value"])

    got = saved(blobs.mapInArrow(score, "code long, n long, value double"), "scores").toArrow()  # at most `most` rows
    order = np.argsort(-got.column("n").to_numpy(), kind="stable")
    return Fitted(first, got.column("code").to_numpy().view(U)[order], got.column("value").to_numpy()[order], counts, buckets)


def _least(counts: DataFrame, most: int) -> int:
    """The smallest count such that no more than `most` grams have it or a larger one, among the powers of the fourth root of two."""
    room, least = most, 1 << 62
    steps = F.floor(F.log2("n") * 4)
    for r in counts.groupBy(steps.alias("step")).agg(F.count("*").alias("grams"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():  # at most 256 rows
        room -= r.grams
        if room < 0:
            break
        least = r.least
    return least


def rare_scores(asked: DataFrame, fitted: Fitted, copies: int, broadcast, depth: int) -> DataFrame:
    """rid, score: the summed log10 of the probabilities of the grams asked for, by all counted nodes, a row for each bucket of a document."""
    top = min(2, depth)

    def run(batches):
        for code, n, blobs in by_bucket(batches):
            model = None
            for base, at, want, times in blobs:
                model = model or bucket_model(code, n, broadcast.value[0], depth, top)
                found, place = np.unique(want, return_inverse=True)
                value = model.log10(found)[place] * times
                doc, back = np.unique(at, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(base + doc.astype(np.int64)), pa.array(np.bincount(back, value, len(doc)))], names=["rid", "score"])

    both = count_blobs(fitted.counts, fitted.buckets, copies, top).union(asked.select("bucket", "copy", "base", "at", "code", "n"))
    return _dealt(both).mapInArrow(run, "rid long, score double")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents given; the end is the word "\\n"."""
    most = max(1, slice_bytes() // PARTS)

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch, most=most):
                got = pc.value_counts(word_strings(fold(part.column("text"))))
                word = pa.concat_arrays([got.field(0), pa.array(["\n"], pa.large_string())])
                held.append(pa.table({"word": word.cast(pa.string()), "n": pa.concat_arrays([got.field(1), pa.array([part.num_rows], pa.int64())])}))
                if len(held) > 8:
                    held = [_merged(held)]
                    if held[0].num_rows > MERGE:
                        yield from held.pop().to_batches()
        if held:
            yield from _merged(held).to_batches()

    return docs.select("text").mapInArrow(run, "word string, n long").filter("word != ''").groupBy("word").agg(F.sum("n").alias("n"))


def _merged(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def scores(docs: DataFrame, learn: Column, depth: int = DEPTH, most: int = KEPT) -> DataFrame:
    """doc_id, n_bytes (coded), n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. learn: of doc_id."""
    spark = docs.sparkSession
    text = settled(id_text(docs), "documents")
    learned = text.filter(learn)
    fitted = fit(learned, depth, most)
    top, buckets = min(2, depth), fitted.buckets
    known = spark.sparkContext.broadcast((fitted.first, fitted.codes, fitted.values))
    copies = -(-text.rdd.getNumPartitions() // TASKS)
    counts = saved(word_counts(learned), "words")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    spread = 0.1 * (kinds + 1) + total
    frequent = counts.filter((F.col("n") >= FREQUENT * total) | (F.col("word") == "\n")).toArrow()  # at most 1 / FREQUENT words, and the end
    common = spark.sparkContext.broadcast((frequent.column("word").combine_chunks().cast(pa.large_string()), frequent.column("n").to_numpy()))

    def make():
        scorer, context, seen = Scorer(*known.value[1:], PLACES), TaskContext.get(), [0]
        words, n = common.value
        value, there = np.log10((n + 0.1) / spread), (n > 0).astype(float)
        ends = pc.index_in(pa.scalar("\n", pa.large_string()), words).as_py()
        end = (value[ends], 1) if ends is not None else (float(np.log10(0.1 / spread)), 0)

        def work(part: pa.RecordBatch):
            rows = part.num_rows
            rid = np.arange(seen[0], seen[0] + rows) | (context.partitionId() << 40)
            seen[0] += rows
            folded = fold(part.column("text"))
            code, sizes = grams(folded, depth)
            value_of = scorer(code)
            rare = np.isnan(value_of)
            score = sum_by(np.where(rare, 0, value_of), sizes)
            doc = folded.doc
            coded = word_strings(folded).dictionary_encode()
            place = coded.indices.to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(coded.dictionary, words), -1).to_numpy(zero_copy_only=False)[place]
            hit = at >= 0
            tokens = np.bincount(doc, minlength=rows) + 1
            base = np.bincount(doc[hit], value[at[hit]], rows) + end[0]
            sure = np.bincount(doc[hit], there[at[hit]], rows).astype(np.int64) + end[1]
            yield _columns(rows, rid=rid, word=pa.array([f" {r}" for r in rid]), doc_id=part.column("doc_id"), n_bytes=sizes, n_tokens=tokens, n_known=sure, base_score=base, score=score)
            width = max(len(coded.dictionary), 1)
            key, tf = np.unique(doc[~hit] * width + place[~hit], return_counts=True)
            yield _columns(len(key), rid=rid[key // width], word=coded.dictionary.take(pa.array(key % width)).cast(pa.string()), tf=tf)
            if rare.any():
                at, asked = np.repeat(np.arange(rows, dtype=np.int32), sizes)[rare], code[rare]
                bucket = buckets_of(_context(asked, top), buckets)
                order = np.lexsort((asked, at, bucket))
                at, asked, bucket = at[order], asked[order], bucket[order]
                first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (asked[1:] != asked[:-1])))
                times = np.diff(np.append(first, len(at))).astype(np.int32)
                at, asked, bucket = at[first], asked[first], bucket[first]
                cuts = _cuts(bucket)
                m = len(cuts) - 1
                yield _columns(m, bucket=bucket[cuts[:-1]], copy=np.full(m, context.partitionId() % copies, np.int32), base=np.full(m, rid[0]), at=_blob(at, cuts), code=_blob(asked, cuts), n=_blob(times, cuts))

        return work

    parts = map_slices(text, make, parts=PARTS, schema=", ".join(f"{k} {v}" for k, v in PARTS_SCHEMA.items()))
    parts = saved(parts, "parts")
    blobs = parts.filter("bucket IS NOT NULL")
    parts = parts.filter("bucket IS NULL")
    parts = parts.select("rid", "word", "tf", "doc_id", "n_bytes", "n_tokens", "n_known", "base_score", "score")
    joined = parts.join(counts, "word", "left")
    times = F.coalesce("n", F.lit(0))
    base = F.coalesce("base_score", F.col("tf") * F.log10((times + 0.1) / F.lit(spread)))
    sure = F.coalesce("n_known", F.when(times > 0, F.col("tf")).otherwise(0))
    rows = joined.select("rid", "doc_id", "n_bytes", "n_tokens", sure.alias("n_known"), base.alias("base_score"), "score")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("n_bytes", "long"), ("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"))]
    rows = rows.union(rare_scores(blobs, fitted, copies, known, depth).select("rid", *nothing, "score"))
    whole = rows.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score")
    )
    return whole.select("doc_id", "n_bytes", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))



PARTS_SCHEMA = {"rid": "long", "word": "string", "tf": "long", "doc_id": "long", "n_bytes": "long", "n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "bucket": "int", "copy": "int", "base": "long", "at": "binary", "code": "binary", "n": "binary"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}


def _columns(rows: int, **given) -> pa.RecordBatch:
    """A batch of PARTS_SCHEMA; what is not given is NULL."""
    columns = [given[k] if isinstance(given.get(k), pa.Array) else pa.array(given[k], _ARROW[t]) if k in given else pa.nulls(rows, _ARROW[t]) for k, t in PARTS_SCHEMA.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(PARTS_SCHEMA))
