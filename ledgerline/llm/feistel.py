"""Training-order materialisation.

Every sequence gets a global slot by a keyed permutation of [0, n): a balanced Feistel network over the next
even power of two, walked again while it lands outside (cycle walking). What is permuted is the sequence's place in
the input: sequences are numbered by path, split and place in the split, so that slots are the same however the input
is split and whichever tasks read it; input that is no plain scan of files is written first in order of doc_id and text.
Slots are dealt out by range, so each output partition holds runs of whole fixed-stride shards in slot order: a reader
finds slot s in shard s // shard_rows at byte (s % shard_rows) * stride, and resumes anywhere without reading what comes
before. write_shards() writes one binary file a shard and a manifest, read_slots() and stream() read them.

Tokens are written once to the shared folder and read back, so the count that fixes n, the numbering and the
shards all see the same rows even if executors are lost. Only one number for each input split comes to
the driver. Null and empty texts give one sequence, the end id alone; repeated rows give sequences each; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import BLOCK, FILE, in_splits, saved
from ledgerline.llm.textarrays import id_text, map_slices
from ledgerline.llm.tokens import WordEncoder, with_end

ROUNDS = 6


class Feistel:
    """A permutation of range(n), fixed by the key."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.default_rng(key).integers(0, 1 << 64, ROUNDS, np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        # The multipliers of splitmix64's finaliser.
        with np.errstate(over="ignore"):
            x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return (x ^ (x >> np.uint64(31))) & self.mask

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ self._round(right, k)
        return right << self.half | left  # the last swap is undone, so the inverse is the same walk with keys reversed

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), keys)
        while (out := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def sequences(docs: DataFrame, tokenizer: str, seq_len: int, end_id: int) -> DataFrame:
    """Documents as sequences of up to seq_len ids; ordinal numbers them within the split (FILE, BLOCK) they are read from. Ids above 65,535 raise."""

    def make():
        encoder, seen = WordEncoder(tokenizer), {}

        def work(part: pa.RecordBatch):
            ids, counts = with_end(*encoder.encode(part.column("text")), end_id)
            if int(ids.max(initial=0)) > 0xFFFF:
                raise ValueError(f"id {int(ids.max())} does not fit into 16 bits")
            n = -(-counts // seq_len)
            doc = np.repeat(np.arange(len(counts)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * seq_len
            length = np.minimum(counts[doc] - start, seq_len)
            ends = np.concatenate([[0], np.cumsum(length)]) * 2
            payload = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())
            file, block = part.column(FILE), part.column(BLOCK)
            code, at = file.dictionary_encode().indices.to_numpy(), block.to_numpy()
            first = [*np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (at[1:] != at[:-1]))).tolist(), len(code)]
            ordinal = np.empty(len(doc), np.int64)
            for a, b in zip(first, first[1:]):
                key, size = (file[a].as_py(), int(at[a])), int(n[a:b].sum())
                lo = int(n[:a].sum())
                ordinal[lo : lo + size] = np.arange(seen.get(key, 0), seen.get(key, 0) + size)
                seen[key] = seen.get(key, 0) + size
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([file.take(take), block.take(take), pa.array(ordinal), part.column("doc_id").take(take), pa.array(start), pa.array(length.astype(np.int32)), payload], names=[FILE, BLOCK, "ordinal", "doc_id", "start", "length", "ids"])

        return work

    placed = in_splits(id_text(docs), "documents", ["doc_id", F.xxhash64("text"), "text"])
    return map_slices(placed, make, f"{FILE} string, {BLOCK} long, ordinal long, doc_id long, start long, length int, ids binary")


def materialise(docs: DataFrame, tokenizer: str, seq_len: int = 512, end_id: int = 1, key: int = 20_240_601, shard_rows: int = 4096, partitions: int | None = None) -> DataFrame:
    """slot, shard, byte_offset, doc_id, start, length, ids: rows in slot order, ids padded with zeros to 2 * seq_len bytes.

    ids are little-endian unsigned 16-bit, so the vocabulary must have at most 65,536 ids.
    """
    spark = docs.sparkSession
    rows = saved(sequences(docs, tokenizer, seq_len, end_id), "sequences")
    sizes = rows.groupBy(FILE, BLOCK).agg((F.max("ordinal") + 1).alias("n")).collect()  # one row for each split of the input
    base, n = {}, 0
    for file, block, count in sorted(map(tuple, sizes)):
        base[file, block] = n
        n += count
    order, stride, bases = Feistel(n, key), 2 * seq_len, spark.sparkContext.broadcast(base)

    def place(batches):
        for b in batches:
            coded = b.column(FILE).dictionary_encode()
            paths, code, block = coded.dictionary.to_pylist(), coded.indices.to_numpy(), b.column(BLOCK).to_numpy()
            pairs, back = np.unique(np.column_stack([code, block]), axis=0, return_inverse=True)
            at = np.array([bases.value[paths[c], k] for c, k in pairs.tolist()], np.int64)[back.ravel()] if len(pairs) else np.empty(0, np.int64)
            slot = pa.array(order.slot(at + b.column("ordinal").to_numpy()))
            yield pa.RecordBatch.from_arrays([slot, b.column("doc_id"), b.column("start"), b.column("length"), b.column("ids")], names=["slot", "doc_id", "start", "length", "ids"])

    placed = rows.mapInArrow(place, "slot long, doc_id long, start long, length int, ids binary")
    shard = F.floor(F.col("slot") / F.lit(shard_rows)).cast("long")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // shard_rows))
    parts = min(parts, shards)
    # Slots are dense, so the ranges are known: nothing is sampled, which would run place() twice.
    dealt = placed.withColumns({"shard": shard}).repartitionById(parts, F.expr(f"cast(shard * {parts} div {shards} as int)")).sortWithinPartitions("slot")
    return dealt.select("slot", "shard", ((F.col("slot") % shard_rows) * stride).alias("byte_offset"), "doc_id", "start", "length", F.rpad(F.col("ids"), stride, F.lit(b"\0")).alias("ids"))


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows of materialise() as one binary file a shard to a folder that all executors reach (any file system pyarrow knows), and gives the manifest:
    shard, rows, stride, crc32, file.

    A shard is written beside its place and then renamed, so it is there whole or not at all; one that is there is not written again, so a run that
    was stopped goes on with the shards that are missing. The manifest is stored as folder/manifest.
    """

    def write(batches):
        from zlib import crc32

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        held: list[bytes] = []
        at = None

        def close():
            data, name = b"".join(held), f"shard-{at:08d}.bin"
            info = system.get_file_info(f"{root}/{name}")
            if info.type != fs.FileType.File or info.size != len(data):
                beside = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(beside) as out:
                    out.write(data)
                system.move(beside, f"{root}/{name}")
            return pa.RecordBatch.from_pylist([{"shard": at, "rows": len(held), "stride": len(held[0]), "crc32": crc32(data), "file": name}], schema=MANIFEST)

        for b in batches:
            for shard, ids in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist()):
                if shard != at and held:
                    yield close()
                    held = []
                at = shard
                held.append(ids)
        if held:
            yield close()

    manifest = rows.select("shard", "ids").mapInArrow(write, "shard long, rows long, stride long, crc32 long, file string")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return rows.sparkSession.read.parquet(f"{folder}/manifest")


MANIFEST = pa.schema([("shard", pa.int64()), ("rows", pa.int64()), ("stride", pa.int64()), ("crc32", pa.int64()), ("file", pa.string())])


def read_slots(folder: str, first: int, count: int, shard_rows: int, seq_len: int) -> np.ndarray:
    """Ids of slots first to first + count, a row each, padded with zeros; fewer at the end. Reads only those bytes."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    stride, out = 2 * seq_len, []
    while count > 0:
        shard, at = divmod(first, shard_rows)
        path = f"{root}/shard-{shard:08d}.bin"
        if system.get_file_info(path).type != fs.FileType.File:
            break
        with system.open_input_file(path) as f:
            f.seek(at * stride)
            data = f.read(min(count, shard_rows - at) * stride)
        if not data:
            break
        out.append(np.frombuffer(data, "<u2").reshape(-1, seq_len))
        first, count = first + len(out[-1]), count - len(out[-1])
    return np.concatenate(out) if out else np.empty((0, seq_len), "<u2")


def stream(folder: str, first: int, batch: int, shard_rows: int, seq_len: int):
    """(slot, ids) batches in training order from a slot on: what a run reads on after it was stopped there."""
    while len(ids := read_slots(folder, first, batch, shard_rows, seq_len)):
        yield first, ids
        first += len(ids)
