"""Token files (operator 2): ids packed in as few bits as the vocabulary needs, with block offsets.

A file set is a Parquet folder (so any store Spark can write, with atomic commits of retried tasks); each row
holds one shard in the format below, and shards follow one another in ascending id order.

Shard: header (magic, bits, ids per block, documents, ids, blocks), then the documents' ids (int64), their null
flags (uint8), their first positions (uint64, one more than documents), the blocks' byte offsets (uint64, one
more than blocks), and the blocks. A block is its ids, each in ``bits`` bits, least significant bit first,
padded to whole bytes. All numbers are little-endian.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import scan_partitions, small_batches
from riskweave.llm.tokens import worker_encoder
from riskweave.plans.registry import register
from riskweave.sources.files import scratch_path
from riskweave.sources.tables import read_table

MAGIC = b"RWTOK001"
HEADER = "<8sIIQQQ"
BLOCK_IDS = 4096
SHARD_IDS = 1 << 16  # a shard is closed once it holds this many ids; documents are never cut


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def _lanes(bits: int) -> tuple[int, int]:
    """Ids and 64-bit words of the smallest group of whole words."""
    g = math.gcd(bits, 64)
    return 64 // g, bits // g


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    per, words = _lanes(bits)
    n = len(ids)
    if n and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    x = np.zeros((-(-n // per), per), dtype=np.uint64)
    x.reshape(-1)[:n] = ids
    out = np.zeros((len(x), words), dtype="<u8")
    for j in range(per):
        k, shift = divmod(j * bits, 64)
        out[:, k] |= x[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, k + 1] |= x[:, j] >> np.uint64(64 - shift)
    return out.tobytes()[:(n * bits + 7) // 8]


def unpack_ids(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    per, words = _lanes(bits)
    rows = -(-n // per)
    raw = np.zeros(rows * words * 8, dtype=np.uint8)
    got = np.frombuffer(data, dtype=np.uint8)
    raw[:len(got)] = got
    x = raw.view("<u8").reshape(rows, words)
    out = np.empty((rows, per), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(per):
        k, shift = divmod(j * bits, 64)
        v = x[:, k] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (x[:, k + 1] << np.uint64(64 - shift))
        out[:, j] = v & mask
    return out.reshape(-1)[:n]


def write_shard(doc_ids: list[int | None], docs: list[np.ndarray], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    starts = np.cumsum([0, *[len(d) for d in docs]]).astype("<u8")
    ids = np.concatenate(docs) if docs else np.zeros(0, dtype=np.uint32)
    blocks = [pack_ids(ids[i:i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.cumsum([0, *[len(b) for b in blocks]]).astype("<u8")
    return b"".join([
        struct.pack(HEADER, MAGIC, bits, block_ids, len(docs), len(ids), len(blocks)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        starts.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Reads a shard; ``ids(a, b)`` unpacks only the blocks that hold positions a to b - 1."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block_ids, n_docs, self.n_ids, n_blocks = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEADER)
        flat = np.frombuffer(data, dtype="<i8", count=n_docs, offset=at)
        null = np.frombuffer(data, dtype=np.uint8, count=n_docs, offset=at + 8 * n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(flat, null, strict=True)]
        at += 9 * n_docs
        self.starts = np.frombuffer(data, dtype="<u8", count=n_docs + 1, offset=at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.offsets = np.frombuffer(data, dtype="<u8", count=n_blocks + 1, offset=at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (n_blocks + 1):]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        parts = [unpack_ids(self.payload[self.offsets[k]:self.offsets[k + 1]], self.bits,
                            min(self.block_ids, self.n_ids - k * self.block_ids)) for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block_ids:stop - first * self.block_ids]


def write_token_files(documents: DataFrame, path: str, tokenizer_path: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the file set: every whole text's ids and ``end_id``, documents in ascending ``id_col`` order (null
    ids first; rows with equal ids in order of their text). A null text is an empty one. Rows: part (range of
    ids), seq, first (ids before the shard in its part), n_ids, shard."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.repartitionByRange(scan_partitions(documents), "_id", F.xxhash64("_text")).sortWithinPartitions("_id", "_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_encoder(tokenizer_path)
        bits = bits_for(max(encoder.size, end_id + 1))
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        ids, docs, size = [], [], 0

        def shard():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([first], pa.int64()),
                 pa.array([size], pa.int64()), pa.array([write_shard(ids, docs, bits)], pa.binary())],
                names=["part", "seq", "first", "n_ids", "shard"])

        for b in batches:
            for d, (tokens, _) in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
                ids.append(d)
                docs.append(np.append(tokens, np.uint32(end_id)))
                size += len(tokens) + 1
                if size >= SHARD_IDS:
                    yield shard()
                    seq, first, ids, docs, size = seq + 1, first + size, [], [], 0
        if ids:
            yield shard()

    rows.mapInArrow(encode, "part int, seq long, first long, n_ids long, shard binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the file set: doc_id, start (ids of all documents before it), n_tokens,
    ids (binary, little-endian unsigned 32-bit)."""
    small_batches(spark)
    files = spark.read.parquet(path)
    # One row per part, so at most as many as the write had partitions.
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, data in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                s = Shard(data)
                ids = s.ids(0, s.n_ids).astype("<u4")
                n = np.diff(s.starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.starts[:-1] + first),
                     pa.array(n), pa.array([ids[a:a + k].tobytes() for a, k in zip(s.starts, n, strict=False)], pa.binary())],
                    names=["part", "doc_id", "_start", "n_tokens", "ids"])

    docs = files.select("part", "first", "shard").mapInArrow(decode, "part int, doc_id long, _start long, n_tokens long, ids binary")
    return docs.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("_start") + F.col("_before")).alias("start"), "n_tokens", "ids")


@register("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token_files")
    write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
