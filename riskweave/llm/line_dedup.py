"""Line dedup (operator 6): sharded minimal perfect hash over line hashes, probed by documents.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least
``min_chars`` code points that are found in two documents or more lose all their lines except in the document of
smallest id. Only 128-bit hashes of keys travel: those of repeated keys are dealt to shards, and each shard builds
a minimal perfect hash whose slots index arrays of fingerprints, document counts and keepers. Documents send their
line hashes to the shards' arrays (a shard with many probes is answered by several tasks with a copy of its arrays)
and get back the keys they must drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import ASCII_SPACE, small_batches
from riskweave.plans.registry import register
from riskweave.sources.files import stage
from riskweave.sources.tables import read_table

MIN_CHARS = 10
KEYS_PER_SHARD = 1 << 14
PROBES_PER_TASK = 1 << 14
LAST = (1 << 63) - 1  # stands for a null id: later than all others
_GAMMA = 2.0
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct (h1, h2) pairs: on each level a pair that is alone in its slot stays,
    the others go on to the next level. A pair's number is the count of taken slots before its own."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bool arrays
        self.ranks = []
        base = 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - bits)
            base += int(bits.sum())

    @staticmethod
    def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(h1 + _mix(h2 + np.uint64(level * _ODD & 0xFFFFFFFFFFFFFFFF))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels = []
        while len(h1):
            if len(levels) == 100:
                raise ValueError("the pairs are not distinct")
            size = max(8, int(_GAMMA * len(h1)))
            slot = cls._slot(h1, h2, len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone)
            rest = ~alone[slot]
            h1, h2 = h1[rest], h2[rest]
        return cls(levels)

    def numbers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each pair; -1, or some other pair's number, for one that was not built in."""
        out = np.full(len(h1), -1, dtype=np.int64)
        open_ = np.arange(len(h1))
        for level, bits in enumerate(self.levels):
            slot = self._slot(h1[open_], h2[open_], level, len(bits))
            hit = bits[slot]
            out[open_[hit]] = self.ranks[level][slot[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *[len(b) for b in self.levels]], dtype="<i8")
        return b"".join([sizes.tobytes(), *[np.packbits(b).tobytes() for b in self.levels]])

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, dtype="<i8", count=1)[0])
        at, levels = 8 * (n + 1), []
        for size in np.frombuffer(data, dtype="<i8", count=n, offset=8).tolist():
            take = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, take, at), count=size).astype(bool))
            at += take
        return cls(levels)


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the line's key, None for a key below ``min_chars`` code points."""
    key = line.strip(ASCII_SPACE).lower()
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _line_hashes(documents: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc): the distinct keys of each row's lines."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, keys = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                own = {k for line in t.split(b"\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}
                keys += own
                docs.append((d, len(own)))
            h = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            doc = np.repeat(np.array([d for d, _ in docs], dtype=np.int64), [n for _, n in docs])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(doc)],
                                             names=["h1", "h2", "doc"])

    return documents.select("_doc", "_text").mapInArrow(split, "h1 long, h2 long, doc long")


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = rows.h1.to_numpy().view(np.uint64), rows.h2.to_numpy().view(np.uint64)
    table = PerfectHash.build(h1, h2)
    n = table.numbers(h1, h2)
    fingerprint, count, keeper = np.empty(len(n), np.uint64), np.empty(len(n), np.uint16), np.empty(len(n), np.int64)
    fingerprint[n], count[n], keeper[n] = h2, np.minimum(rows.n.to_numpy(), 65535), rows.keeper.to_numpy()
    return pd.DataFrame({"shard": rows.shard.iloc[:1], "hash": [table.to_bytes()], "fingerprints": [fingerprint.tobytes()],
                         "counts": [count.tobytes()], "keepers": [keeper.tobytes()]})


def _probe_shard(probes: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
    """The probes whose line must go: found by fingerprint, in two documents or more, kept elsewhere."""
    if not len(arrays) or not len(probes):
        return pd.DataFrame({"doc": pd.Series(dtype=np.int64), "key": pd.Series(dtype=object)})
    a = arrays.iloc[0]
    fingerprint, count = np.frombuffer(a.fingerprints, np.uint64), np.frombuffer(a.counts, np.uint16)
    keeper = np.frombuffer(a.keepers, np.int64)
    h1, h2 = probes.h1.to_numpy().view(np.uint64), probes.h2.to_numpy().view(np.uint64)
    doc = probes.doc.to_numpy()
    n = PerfectHash.from_bytes(a.hash).numbers(h1, h2)
    go = (n >= 0) & (fingerprint[n] == h2) & (count[n] >= 2) & (keeper[n] != doc)
    key = np.stack([h1[go], h2[go]], axis=1)
    return pd.DataFrame({"doc": doc[go], "key": [k.tobytes() for k in key]})


def line_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id_col, ``kept_text`` (the lines that stay, joined by a newline), ``n_lines``,
    ``n_dropped`` and the ``keep`` columns. A null or empty text is one empty line. Rows with equal ids are one
    document; a null id counts as the largest. A line repeated within its document only is left alone, and
    the document of smallest id keeps all its occurrences. Text is never shortened: whole lines go or stay."""
    spark = documents.sparkSession
    small_batches(spark)
    kind = dict(documents.dtypes)
    rows = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_doc"), F.col(id_col).alias("_id"),
                            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
                            *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)])
    probes = stage(spark, _line_hashes(rows, min_chars), "line_hashes")
    found = probes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("keeper"), F.max("doc").alias("_last"))
    repeated = stage(spark, found.where(F.col("keeper") < F.col("_last")).drop("_last"), "repeated_lines")
    n_shards = max(1, -(-repeated.count() // KEYS_PER_SHARD))
    shard = F.pmod(F.col("h1"), F.lit(n_shards)).alias("shard")
    arrays = repeated.select("h1", "h2", "n", "keeper", shard).groupBy("shard").applyInPandas(
        _build_shard, "shard long, hash binary, fingerprints binary, counts binary, keepers binary")
    sent = probes.select("h1", "h2", "doc", shard)
    # How many tasks answer a shard: by its number of probes (a very common line sends very many).
    copies = stage(spark, sent.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(PROBES_PER_TASK)).alias("_copies")), "shard_copies")
    sent = sent.join(copies, "shard").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("_copies"))).drop("_copies")
    arrays = arrays.join(copies, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    go = sent.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInPandas(_probe_shard, "doc long, key binary")
    drops = go.groupBy(F.col("doc").alias("_of")).agg(F.collect_set("key").alias("_drop"))  # at most a document's lines
    joined = rows.join(drops, F.col("_doc") == F.col("_of"), "left").drop("_of", "_doc")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").to_pylist()
            total = [t.count("\n") + 1 for t in texts]
            gone = [0] * len(texts)
            for i, drop in enumerate(b.column("_drop").to_pylist()):
                if drop:
                    go = set(drop)
                    lines = texts[i].encode("utf-8", "surrogatepass").split(b"\n")
                    stay = [x for x in lines if len(x) < min_chars or line_key(x, min_chars) not in go]
                    gone[i] = len(lines) - len(stay)
                    texts[i] = b"\n".join(stay).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 *[b.column(f"_c{i}") for i in range(len(keep))]], names=["_id", "kept_text", "n_lines", "n_dropped", *[f"_c{i}" for i in range(len(keep))]])

    extra = "".join(f", _c{i} {kind[c]}" for i, c in enumerate(keep))
    out = joined.mapInArrow(rebuild, f"_id {kind[id_col]}, kept_text string, n_lines long, n_dropped long{extra}")
    return out.select(F.col("_id").alias(id_col), "kept_text", "n_lines", "n_dropped", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)])


_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@register("op6_line_dedup", _SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
