"""Packing by power-of-two decomposition.

Each document is cut into pieces whose lengths are powers of two: full sequences first, then the binary
digits of the rest, largest first. Pieces of one length form a bucket, every piece is a sequence of its
own, so no sequence crosses documents, and a sequence whose length is a power of two takes no padding.
A narrow pass over the texts: no shuffle.

Null and empty texts hold the end id alone and give one piece of length 1. Repeated rows and repeated or
null doc_ids are packed once per row. An empty table gives no piece. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.textarrays import id_text, map_slices
from ledgerline.llm.tokens import WordEncoder, with_end

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


def binary_pieces(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece, in order. longest: a power of two."""
    docs, lengths = [np.repeat(np.arange(len(counts)), counts // longest)], [np.full(int((counts // longest).sum()), longest)]
    bit = longest >> 1
    while bit:
        has = np.flatnonzero(counts & bit)
        docs.append(has)
        lengths.append(np.full(len(has), bit))
        bit >>= 1
    doc, length = np.concatenate(docs), np.concatenate(lengths)
    order = np.argsort(doc, kind="stable")
    doc, length = doc[order], length[order]
    start = np.cumsum(length) - length
    return doc, start - np.concatenate([[0], np.cumsum(counts)])[doc], length


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket (log2 of length), sequence_id, offset."""
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")

    def make():
        encoder = WordEncoder(tokenizer)

        def work(part: pa.RecordBatch):
            ids, counts = with_end(*encoder.encode(part.column("text")), end_id)
            doc, start, length = binary_pieces(counts, seq_len)
            ends = np.concatenate([[0], np.cumsum(length)]) * 4
            payload = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), payload.cast(pa.binary()), pa.array(counts[doc])], names=["doc_id", "start", "length", "ids", "doc_tokens"])

        return work

    pieces = map_slices(id_text(docs), make, SCHEMA)
    return pieces.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
