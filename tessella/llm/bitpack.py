"""op8: token ids in fixed-width binary files.

Format of a file, little-endian: magic ``TKB1``; u32 bits per id; u32 ids per block; u64 documents, u64 ids, u64 blocks; i64
document ids; u64 document ends (ids before the end); u64 byte offset of each block's payload; then the blocks. An id takes
``bits`` bits, the least that hold the vocabulary. Blocks start on bytes, so any range of ids unpacks by numpy from the blocks
that hold it.

Documents are dealt by ranges of doc_id (rows of one doc_id over several tasks where they are many), sorted in each task, encoded
and written as files of bounded size straight to the shared folder, each under a name of its own; a Parquet manifest, written by Spark,
names the files that count, so that a repeated task's leftovers are never read. The files are read back by the tasks that hold
their manifest rows; neither names nor contents pass through the driver. Null and empty texts give the end id alone; repeated rows are
documents of their own; null doc_ids come first; equal doc_ids stand in the order in which they were read. An empty table gives no row.
Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch_path, slices, table, tidied
from .tokens import coder

MAGIC, HEAD, BLOCK = b"TKB1", struct.Struct("<4sIIQQQ"), 4096
NO_ID = -(2**63)


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of the given width, lowest bit first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if ids.size and bits < 32 and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little").ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = raw[: n * bits // 8].reshape(n, bits // 8)
    else:
        field = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
        own = np.packbits(field, axis=1, bitorder="little")
        out[:, : own.shape[1]] = own
    return out.view("<u4").ravel()


def build(doc_ids: list[int], ends: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """The bytes of one file."""
    parts = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    head = HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids), len(parts))
    at = len(head) + 8 * (2 * len(doc_ids) + len(parts))
    offsets = at + np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]) if parts else []
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), np.asarray(ends, "<u8").tobytes(), np.asarray(offsets, "<u8").tobytes(), *parts])


class TokenFile:
    """Random access to a file's bytes (a buffer or a memory map)."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.bits, self.block, docs, self.n, blocks = HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(self.data, "<i8", docs, at)
        self.ends = np.frombuffer(self.data, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(self.data, "<u8", blocks, at + 16 * docs).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them."""
        start, stop = max(0, start), min(stop, self.n)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        count = min(self.n, (last + 1) * self.block) - first * self.block
        data = self.data[self.offsets[first] : self.offsets[last] + (min(self.n, (last + 1) * self.block) - last * self.block) * self.bits // 8 + 1]
        if self.block * self.bits % 8 == 0:
            whole = unpack(data, self.bits, count)
        else:
            whole = np.concatenate([unpack(self.data[self.offsets[k] :], self.bits, min(self.block, self.n - k * self.block)) for k in range(first, last + 1)])
        return whole[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _put(path: str, data: bytes) -> None:
    """Writes a file to the shared store, whole or not at all."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, at)


def _get(path: str) -> pa.Buffer:
    """A whole file of the shared store."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return f.read_buffer()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, bits: int | None = None, file_ids: int = 4_000_000) -> DataFrame:
    """Writes the documents (doc_id, text) as token files in ascending doc_id order; returns the manifest
    (part long, piece int, path string, docs long, ids long), by part and piece in that order.
    A task's file is cut after about file_ids ids, so memory stays bounded."""

    def run(batches):
        from pyspark import TaskContext

        code, part, piece = coder(tokenizer), TaskContext.get().partitionId(), 0
        width = bits or bits_for(code.vocab)
        end = int(end_id).to_bytes(4, "little")
        own: list[int] = []
        ends: list[int] = []
        data: list[bytes] = []
        n = 0

        def flush():
            path = f"{folder}/part-{part:06d}-{piece:04d}-{uuid.uuid4().hex}.tok"
            _put(path, build(own, ends, np.frombuffer(b"".join(data), "<u4"), width))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (piece, pa.int32()), (path, pa.string()), (len(own), pa.int64()), (n, pa.int64()))], names=["part", "piece", "path", "docs", "ids"])

        for batch in batches:
            for b in slices(batch, 1):
                for i, ids in zip(b.column(0).to_pylist(), code.encode_all(b.column(1).to_pylist())):
                    n += len(ids) // 4 + 1
                    own.append(NO_ID if i is None else i)
                    ends.append(n)
                    data += (ids, end)
                    if n >= file_ids:
                        yield flush()
                        own, ends, data, n, piece = [], [], [], 0, piece + 1
        if own:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialise(dealt.mapInArrow(tidied(run), "part long, piece int, path string, docs long, ids long"), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Reads token files back: one row (doc_id, start, n_tokens, ids_crc32, ids binary) for each document. start counts the
    ids of all documents before it, over all files."""
    # sums over files in two steps: within a part, then over the parts, of which there are as many as tasks that wrote
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("ids").over(Window.partitionBy("part").orderBy("piece")) - F.col("ids")
    files = manifest.withColumn("within", within).join(parts, "part").select("path", (F.col("base") + F.col("within")).alias("before"))
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(_get(path))
                starts = np.concatenate([[0], f.ends[:-1]]) if len(f.ends) else f.ends
                a = 0
                while a < len(f.ends):  # parts of about a million ids
                    b = max(a + 1, int(np.searchsorted(f.ends, starts[a] + 1_000_000, "right")))
                    first = int(starts[a])
                    data = f.ids(first, int(f.ends[b - 1])).astype("<u4").tobytes()
                    cut = (4 * (np.concatenate([starts[a:b], f.ends[b - 1 : b]]) - first)).tolist()
                    own = [data[s:e] for s, e in zip(cut, cut[1:])]
                    ids = [None if x == NO_ID else x for x in f.doc_ids[a:b].tolist()]
                    cols = [pa.array(ids, pa.int64()), pa.array(starts[a:b] + base, pa.int64()), pa.array(f.ends[a:b] - starts[a:b], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                    a = b

    return files.mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
