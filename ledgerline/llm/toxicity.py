"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words (lower case, punctuation at their ends dropped) and the first four and five characters of longer
words. Those whose presence goes with the label in the labelled sample (chi-square, one-sided) and that explain
positive examples which stronger terms don't yet explain span the vector space; inverse document frequencies are counted over all documents. The examples are held in an inverted index
dealt into blocks, each with its largest weight per term: blocks are visited by falling upper bound and the
search stops when no block left can beat the k-th best cosine, so the neighbours found are exact. Neighbours
vote with their cosines; votes are made into probabilities by isotonic regression over the examples' own
leave-one-out votes. A text without any such term gets the toxic share of the examples without any.

Everything learned is bounded by the words of EXAMPLES texts, whatever the tables' size; one shuffle of the
sample's terms, one pass for document frequencies, one narrow pass that scores every whole text.

Nulls: a null or empty text has no terms; null ids or labels are not learned from; of several labels of one
doc_id the largest counts; rows with one doc_id are scored each. With no usable labels the score is 0.5 / 1.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import saved
from ledgerline.llm.textarrays import id_text, map_slices, slice_bytes, slices

#: Labelled rows the model is fitted on, chosen by a hash of their doc_id.
EXAMPLES = 16_384
#: A term must be in that many examples, and pass that chi-square.
LEAST_DF, LEAST_CHI2 = 3, 15.0
#: An example is explained once it holds that many chosen terms.
ENOUGH = 3
NEIGHBOURS = 15
BLOCK = 64
OPENINGS = (4, 5)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def terms_of(texts: pa.Array, vocabulary: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, term number and occurrences of each different term of each text, and the terms. vocabulary: only these, so numbered."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    rows = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    plain = pc.ascii_trim(pc.utf8_lower(coded.dictionary), characters=PUNCTUATION)
    star, blank = pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string())
    length = pc.utf8_length(plain)
    openings = [pc.if_else(pc.greater(length, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(plain, 0, k), star, blank), blank) for k in OPENINGS]
    found = pa.chunked_array([plain, *openings]).combine_chunks()
    if vocabulary is None:
        coded = found.dictionary_encode()
        vocabulary, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number[pc.equal(found, "").to_numpy(zero_copy_only=False)] = -1
    else:
        number = pc.fill_null(pc.index_in(found, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row, term = np.tile(rows, 1 + len(OPENINGS)), number.reshape(-1, len(plain))[:, at].ravel()
    row, term = row[term >= 0], term[term >= 0]
    key, count = np.unique(row * max(len(vocabulary), 1) + term, return_counts=True)
    return key // max(len(vocabulary), 1), key % max(len(vocabulary), 1), count, vocabulary


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """doc_id, text, y of a bounded sample of labelled documents, one row for each different text."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().filter(learn)
    chosen = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))


def _exploded(df: DataFrame, vocabulary: pa.Array | None, keep: list[str], schema: str) -> DataFrame:
    def make():
        def work(part: pa.RecordBatch):
            row, term, count, words = terms_of(part.column("text"), vocabulary)
            name = words.take(pa.array(term)).cast(pa.string()) if vocabulary is None else pa.array(term.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row)) for k in keep), name, pa.array(count.astype(np.int32))], names=[*keep, "term", "tf"])

        return work

    return map_slices(df, make, schema, parts=4)


class Index:
    """Examples as unit vectors in an inverted index with block maxima."""

    def __init__(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int):
        self.idf, self.n = idf, n
        weight = (1 + np.log(np.maximum(tf, 1))) * idf[term]
        norm = np.sqrt(np.bincount(row, weight * weight, n))
        order = np.lexsort((row, term))
        self.row, self.weight, term = row[order], (weight / norm[row])[order], term[order]
        self.at = np.searchsorted(term, np.arange(len(idf) + 1))
        self.blocks = -(-n // BLOCK)
        key, first = np.unique(term * max(self.blocks, 1) + self.row // BLOCK, return_index=True)
        self.block, self.block_term = key % max(self.blocks, 1), key // max(self.blocks, 1)
        self.largest = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.block_first = np.append(first, len(self.row))
        self.block_at = np.searchsorted(self.block_term, np.arange(len(idf) + 1))

    def nearest(self, term: np.ndarray, tf: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above zero, ties to the smaller number; but: an example left out."""
        q = (1 + np.log(tf)) * self.idf[term]
        q /= np.sqrt((q * q).sum())
        bound = np.zeros(self.blocks)
        for t, w in zip(term, q):
            a, b = self.block_at[t], self.block_at[t + 1]
            bound[self.block[a:b]] += w * self.largest[a:b]
        found_row, found = np.empty(0, np.int64), np.empty(0)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        step, at = 4, 0
        while at < len(order):
            visit = order[at : at + step]
            if len(found) == k and bound[visit[0]] < found[-1] - 1e-12:
                break
            rows, got = [], []
            for t, w in zip(term, q):
                a, b = self.block_at[t], self.block_at[t + 1]
                hit = a + np.flatnonzero(np.isin(self.block[a:b], visit))
                for h in hit:
                    x, y = self.block_first[h], self.block_first[h + 1]
                    rows.append(self.row[x:y])
                    got.append(w * self.weight[x:y])
            row, place = np.unique(np.concatenate(rows), return_inverse=True)
            cosine = np.bincount(place, np.concatenate(got))
            row, cosine = np.concatenate([found_row, row[row != but]]), np.concatenate([found, cosine[row != but]])
            best = np.lexsort((row, -cosine.round(12)))[:k]
            found_row, found = row[best], cosine[best]
            at, step = at + step, step * 2
        return found_row, np.minimum(found, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step means of y over x by pooling adjacent violators, with one half of a vote for either label in each pool."""
    order = np.argsort(x, kind="stable")
    at, first = np.unique(x[order], return_index=True)
    total, count = np.add.reduceat(y[order].astype(float), first), np.diff(np.append(first, len(x))).astype(float)
    pools: list[list[float]] = []
    for a, t, c in zip(at, total, count):
        pools.append([a, t, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, t2, c2 = pools.pop()
            pools[-1][1] += t2
            pools[-1][2] += c2
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


class Model:
    """What the executors need: terms, index, labels, evidence ids and the calibration."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, ids: np.ndarray, y: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray):
        used = np.unique(row)
        clean = np.setdiff1d(np.arange(len(y)), used)
        self.none = float((y[clean].sum() + 0.5) / (len(clean) + 1))
        self.vocabulary, self.ids, self.y = vocabulary, ids[used], y[used]
        row = np.searchsorted(used, row)
        self.index = Index(row, term, tf, idf, len(used))
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(len(used) + 1))
        votes = []
        for i in range(len(used)):
            mine = order[cuts[i] : cuts[i + 1]]
            votes.append(self.vote(*self.index.nearest(term[mine], tf[mine], NEIGHBOURS, but=i)))
        self.steps, self.values = isotonic(np.array(votes), self.y) if votes else (np.array([0.0]), np.array([self.none]))

    def vote(self, row: np.ndarray, cosine: np.ndarray) -> float:
        """Cosine-weighted share of toxic neighbours, drawn towards one half when cosines are few or small."""
        return float((cosine[self.y[row] == 1].sum() + 0.05) / (cosine.sum() + 0.1))

    def calibrated(self, vote: float) -> float:
        return float(self.values[max(0, np.searchsorted(self.steps, vote, side="right") - 1)])

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list, list]:
        row, term, tf, _ = terms_of(texts, pa.array(self.vocabulary, pa.large_string()))
        out, near, shared = np.full(len(texts), self.none), [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        known: dict[bytes, tuple] = {}
        for i in np.unique(row):
            t, c = term[cuts[i] : cuts[i + 1]], tf[cuts[i] : cuts[i + 1]]
            key = t.tobytes() + c.tobytes()
            if key not in known:
                rows, cosine = self.index.nearest(t, c, NEIGHBOURS)
                known[key] = (self.calibrated(self.vote(rows, cosine)) if len(rows) else self.none, self.ids[rows[:5]].tolist(), [self.vocabulary[x] for x in t])
            out[i], near[i], shared[i] = known[key]
        return out, near, shared


def _explaining(held: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Terms, strongest first, that are in at least LEAST_DF positive examples not yet explained: copies of one example add nothing."""
    order = np.argsort(held[:, 1], kind="stable")
    cuts = np.searchsorted(held[order, 1], np.arange(n + 1))
    seen, keep = np.zeros(len(y), np.int64), []
    for t in range(n):
        rows = held[order[cuts[t] : cuts[t + 1]], 0]
        rows = rows[y[rows] == 1]
        if (seen[rows] < ENOUGH).sum() >= LEAST_DF:
            keep.append(t)
            seen[rows] += 1
    return np.array(keep, np.int64)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, examples: int = EXAMPLES) -> Model:
    """learn: of doc_id, true for rows whose label may be learned."""
    sample = saved(labelled(docs, labels, label, learn, examples), "examples")
    facts = sample.select("doc_id", "y").toPandas()  # at most `examples` rows
    n, positive = len(facts), int(facts["y"].sum())
    vocabulary: list[str] = []
    if 0 < positive < n:
        seen = _exploded(sample, None, ["y"], "y int, term string, tf int").groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
        a, b, pos, neg = F.col("k").cast("double"), (F.col("n") - F.col("k")).cast("double"), float(positive), float(n - positive)
        chi2 = float(n) * F.pow(a * (neg - b) - b * (pos - a), F.lit(2)) / (pos * neg * (a + b) * (F.lit(float(n)) - a - b))
        chosen = seen.filter((F.col("n") >= LEAST_DF) & (F.col("n") < n) & (a * neg > 3 * b * pos)).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2)
        vocabulary = [r.term for r in chosen.orderBy(F.desc("chi2"), "term").collect()]  # terms of bounded examples
    held = np.zeros((0, 3), np.int64)
    if vocabulary:
        place = {d: i for i, d in enumerate(facts["doc_id"])}
        got = _exploded(sample, pa.array(vocabulary, pa.large_string()), ["doc_id"], "doc_id long, term int, tf int").orderBy("doc_id", "term").toPandas()  # chosen terms of bounded examples
        held = np.column_stack([got["doc_id"].map(place).to_numpy(np.int64), got["term"].to_numpy(np.int64), got["tf"].to_numpy(np.int64)])
        keep = _explaining(held, facts["y"].to_numpy(np.int64), len(vocabulary))
        held = held[np.isin(held[:, 1], keep)]
        held[:, 1] = np.searchsorted(keep, held[:, 1])
        vocabulary = [vocabulary[k] for k in keep]
    idf = np.zeros(len(vocabulary))
    if vocabulary:
        df = dict(map(tuple, _document_frequencies(docs, pa.array(vocabulary, pa.large_string())).collect()))  # a row for each term, and one
        total = df.pop(-1, 0)
        idf = np.log((1 + total) / (1 + np.array([df.get(i, 0) for i in range(len(vocabulary))]))) + 1e-6
    return Model(vocabulary, idf, facts["doc_id"].to_numpy(np.int64), facts["y"].to_numpy(np.int64), held[:, 0], held[:, 1], held[:, 2])


def _document_frequencies(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """term, df over all documents; term -1 has their number."""

    def make():
        def work(part: pa.RecordBatch):
            _, term, _, _ = terms_of(part.column("text"), terms)
            got, n = np.unique(term, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(got, -1).astype(np.int32)), pa.array(np.append(n, part.num_rows))], names=["term", "df"])

        return work

    return map_slices(id_text(docs), make, "term int, df long", parts=4).groupBy("term").agg(F.sum("df").alias("df"))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """doc_id, score (0 to 1), predicted, evidence (nearest examples' doc_ids), evidence_terms."""
    model = fit(docs, labels, label, learn, examples)

    def make():
        def work(part: pa.RecordBatch):
            score, near, shared = model.score(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(near, pa.list_(pa.int64())), pa.array(shared, pa.list_(pa.string()))], names=["doc_id", "score", "predicted", "evidence", "evidence_terms"])

        return work

    return map_slices(id_text(docs), make, "doc_id long, score double, predicted int, evidence array<long>, evidence_terms array<string>", parts=4)


def without_toxic(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> DataFrame:
    """docs without the rows predicted toxic, in one narrow pass."""
    model = fit(docs, labels, label, learn)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots and the like
    text, most = f"c{docs.columns.index('text')}", max(1, slice_bytes() // 4)

    def keep(batches):
        for batch in batches:
            for part in slices(batch, text, most):
                yield part.filter(pa.array(model.score(part.column(text))[0] < 0.5))

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def fold_of(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
