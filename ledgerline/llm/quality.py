"""Quality scores by histogram gradient-boosted trees over document statistics.

Each whole text becomes a row of statistics (lengths, character classes, repetition, word shapes). The trees
are grown on the driver from a bounded sample of labelled rows, on at most BINS histogram bins a statistic,
and flattened into arrays: scoring walks all documents of a slice down a tree together, one level a step.
One narrow pass over the texts scores them; another reads the sample's texts.

Nulls: a null text is an empty one, and is scored like any other; null ids or labels are not
learned from; of several labels of one doc_id the largest counts; rows with one doc_id are scored each. With no
usable labels, or labels all alike, every score is their smoothed mean. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from ledgerline.llm.storage import saved
from ledgerline.llm.textarrays import id_text, map_slices, raw_bytes
from ledgerline.llm.toxicity import labelled

#: Labelled rows the trees are grown on, chosen by a hash of their doc_id.
EXAMPLES = 16_384
BINS, TREES, DEPTH, RATE, LEAST_LEAF, RIDGE = 64, 80, 4, 0.15, 8, 1.0

# Classes of bytes that are counted.
CLASSES = {"space": b" ", "line": b"\n\r", "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "stop": b".,;:", "loud": b"!?", "quote": b"'\"()", "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "wide": bytes(range(128, 256))}
NAMES = ["log_bytes", "log_words", "log_lines", *CLASSES, "word_bytes", "word_spread", "long_words", "short_words", "distinct_words", "commonest_word", "repeated_words", "distinct_lines", "line_bytes", "packed", "capital_words", "loud_words", "number_words", "symbol_words"]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    data, off = raw_bytes(texts)
    n = len(texts)
    size = np.diff(off)
    share = lambda a, b: a / np.maximum(b, 1)
    kind = np.full(256, len(CLASSES), np.int64)
    for i, members in enumerate(CLASSES.values()):
        kind[list(members)] = i
    width = len(CLASSES) + 1
    classes = np.bincount(np.repeat(np.arange(n) * width, size) + kind[data], minlength=n * width).reshape(n, width)[:, :-1]

    words = pc.ascii_split_whitespace(texts)
    count = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    at, forms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    length = pc.binary_length(forms).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(n), count)
    full = length[at] > 0
    rows, at = rows[full], at[full]
    count = np.bincount(rows, minlength=n)
    of = lambda v: np.bincount(rows, v[at], n)
    flag = lambda pattern: of(pc.match_substring_regex(forms, pattern).to_numpy(zero_copy_only=False).astype(float))
    mean = share(of(length.astype(float)), count)
    spread = np.sqrt(np.maximum(share(of(length.astype(float) ** 2), count) - mean**2, 0))
    key, times = np.unique(rows * max(len(forms), 1) + at, return_counts=True)
    row = key // max(len(forms), 1)
    distinct = np.bincount(row, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, row, times)
    repeated = np.bincount(row, np.where(times > 2, times, 0), n)

    lines = pc.split_pattern(texts, "\n")
    n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line_rows = np.repeat(np.arange(n), n_lines)
    line = lines.flatten().dictionary_encode()
    kinds = np.bincount(np.unique(line_rows * max(len(line.dictionary), 1) + line.indices.to_numpy(zero_copy_only=False)) // max(len(line.dictionary), 1), minlength=n)
    view = memoryview(np.ascontiguousarray(data))
    packed = np.array([len(zlib.compress(view[a:b], 1)) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], float)
    return np.column_stack(
        [np.log1p(size), np.log1p(count), np.log1p(n_lines), *(share(c, size) for c in classes.T), mean, spread, share(of((length > 14).astype(float)), count), share(of((length < 4).astype(float)), count), share(distinct, count)]
        + [share(most, count), share(repeated, count), share(kinds, n_lines), share(size, n_lines), share(packed, size), share(flag(r"^[A-Z]+[^a-z]*$"), count), share(flag(r"[!?]$"), count), share(flag(r"[0-9]"), count), share(flag(r"[#$%&*+/<=>@^_`{|}~]"), count)]
    )


@dataclass
class Forest:
    """Trees in arrays: node i of a tree goes to 2i+1 where its statistic is at most its cut, else to 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes; -1: stay to the left
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**DEPTH

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(rows) and node[0] < inner:  # every path has the same length
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, f] > cut[node]))
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Newton boosting of the logistic loss; splits on histograms of quantile bins."""
    n, inner = len(y), (1 << DEPTH) - 1
    rate = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    feature, cut, leaf = np.full((TREES, inner), -1), np.zeros((TREES, inner)), np.zeros((TREES, inner + 1))
    if not 0 < y.sum() < n:
        return Forest(base, feature, cut, leaf)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    columns = np.arange(x.shape[1]) * BINS
    score = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, live = (1 << depth) - 1, 1 << depth
            flat = ((node - first)[:, None] * (x.shape[1] * BINS) + columns + binned).ravel()
            hist = lambda w: np.bincount(flat, np.repeat(w, x.shape[1]), live * x.shape[1] * BINS).reshape(live, x.shape[1], BINS).cumsum(2)
            gl, hl, nl = hist(g), hist(h), hist(np.ones(n))
            ga, ha, na = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(nl < LEAST_LEAF) | (na - nl < LEAST_LEAF)] = 0
            gain = gain.reshape(live, -1)
            best = gain.argmax(1)
            for k in range(live):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, best[k]] > 1e-9 and b < len(edges[f]):
                    feature[t, first + k], cut[t, first + k] = f, edges[f][b]
            f = feature[t, node]
            node = 2 * node + 1 + ((f >= 0) & (x[np.arange(n), f] > cut[t, node]))
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + RIDGE)
        score += leaf[t, at]
    return Forest(base, feature, cut, leaf)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, examples: int = EXAMPLES) -> Forest:
    """learn: of doc_id, true for rows whose label may be learned."""
    width = len(NAMES)

    def make():
        def work(part: pa.RecordBatch):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

        return work

    sample = saved(labelled(docs, labels, label, learn, examples), "examples")
    got = map_slices(sample.select("doc_id", "y", "text"), make, "doc_id long, y int, x array<double>").orderBy("doc_id").toPandas()  # at most `examples` rows
    return grow(np.array(got["x"].tolist()).reshape(-1, width), got["y"].to_numpy(float))


def quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", examples: int = EXAMPLES) -> DataFrame:
    """doc_id, score (0 to 1), predicted."""
    forest = fit(docs, labels, label, learn, examples)

    def make():
        def work(part: pa.RecordBatch):
            score = forest.score(statistics(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return work

    return map_slices(id_text(docs), make, "doc_id long, score double, predicted int")
