"""Packing (operator 4): order-preserving dynamic programming over window cuts.

Documents follow one another in order; the stream of their ids is cut into windows of at most ``length`` ids.
A cut costs nothing at a document's end, a little at a sentence's end and more inside a sentence; a window costs
its padding. The cheapest cuts are found by dynamic programming whose transition, the minimum of
(cost so far + position) over the last ``length`` positions, is kept in a monotone queue.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import scan_partitions, small_batches
from riskweave.llm.tokens import worker_encoder
from riskweave.plans.registry import register
from riskweave.sources.tables import read_table

LENGTH = 2048
SENTENCE_CUT, INNER_CUT = 1, 4
STRIDE = 24  # no two neighbouring candidate cuts are further apart than this
STREAM_IDS = 1 << 20  # ids that one run of the dynamic programming covers


def padding(n: int, length: int = LENGTH) -> int:
    """A window of n ids is padded to ``length``, except where n is a power of two."""
    return 0 if n & (n - 1) == 0 else length - n


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut (from 0 to its end) and what a cut there costs."""
    total = int(doc_ends[-1])
    marks = np.unique(np.concatenate([[0], sentence_ends, doc_ends]))
    extra = -(-np.diff(marks) // stride) - 1  # inner cuts between neighbours
    base = np.repeat(marks[:-1], extra)
    nth = np.arange(len(base)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    at = np.unique(np.concatenate([marks, base + nth * stride]))
    cost = np.full(len(at), INNER_CUT, dtype=np.int64)
    cost[np.searchsorted(at, sentence_ends)] = SENTENCE_CUT
    cost[np.searchsorted(at, doc_ends)] = 0
    cost[0] = 0
    assert at[-1] == total
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Cut positions (the first 0, the last the stream's end) of least padding plus cut costs."""
    n = len(at)
    exact: dict[int, list[int]] = {}
    size = length // 8
    while size < length:  # windows of a power of two need no padding
        to = np.searchsorted(at, at + size)
        hit = np.flatnonzero((to < n) & (at[np.minimum(to, n - 1)] == at + size))
        for i, j in zip(hit.tolist(), to[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
        size *= 2
    pos, pen = at.tolist(), cost.tolist()
    best, came = [0] * n, [0] * n
    queue = deque([(0, 0, 0)])  # (position, cost so far + position, index), costs rising
    for j in range(1, n):
        p = pos[j]
        low = p - length
        while queue[0][0] < low:
            queue.popleft()
        _, g, i = queue[0]
        c = length - p + g
        if j in exact:
            for e in exact[j]:
                if best[e] < c:
                    c, i = best[e], e
        c += pen[j]
        best[j], came[j] = c, i
        g = c + p
        while queue and queue[-1][1] >= g:
            queue.pop()
        queue.append((p, g, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(pos[j])
        j = came[j]
    return [0, *reversed(cuts)]


def tail_cuts(start: int, stop: int, length: int = LENGTH) -> list[int]:
    """Cuts of the last window: into powers of two, where these cuts cost less than its padding."""
    n = stop - start
    if INNER_CUT * (n.bit_count() - 1) >= padding(n, length):
        return [stop]
    out = []
    for bit in range(n.bit_length() - 1, -1, -1):
        if n >> bit & 1:
            start += 1 << bit
            out.append(start)
    return out


def pack(documents: DataFrame, tokenizer_path: str, end_id: int, length: int = LENGTH,
         id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> DataFrame:
    """One row per piece of a document in a sequence: id_col, start (ids of its document before it), length,
    ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (in its sequence).

    Documents are taken in ascending id order (null ids first; rows with equal ids in order of their text) within
    ranges of ids; each range is one task's stream, cut in runs of ``STREAM_IDS`` ids whose last window is carried
    into the next run. A null text is an empty one, of which only ``end_id`` is packed. Repeated rows are packed each. ``keep_words``: whether a
    worker remembers words' ids from task to task (faster), or gives their memory back at each task's end."""
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)[id_col]
    rows = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.repartitionByRange(scan_partitions(documents), "_id", F.xxhash64("_text")).sortWithinPartitions("_id", "_text")
    schema = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_encoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        # Documents not yet packed: id, ids left, sentence ends in them, ids already packed, all ids.
        names, left, ends, done, total, size = [], [], [], [], [], 0

        def flush(last: bool):
            nonlocal names, left, ends, done, total, size, sequence
            doc_ends = np.cumsum([len(x) for x in left])
            begin = doc_ends - [len(x) for x in left]
            sentences = np.concatenate([e + b for e, b in zip(ends, begin, strict=True)])
            cuts = best_cuts(*candidates(doc_ends, np.unique(sentences)), length)
            if last:
                cuts = [*cuts[:-1], *tail_cuts(cuts[-2], cuts[-1], length)]
            elif len(cuts) > 2:
                cuts = cuts[:-1]
            cuts = np.array(cuts)
            stop = int(cuts[-1])
            edges = np.unique(np.concatenate([cuts, doc_ends[doc_ends <= stop]]))
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(doc_ends, a, side="right")
            window = np.searchsorted(cuts, a, side="right") - 1
            stream = np.concatenate(left).astype("<u4")
            base = np.array(done)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[d] for d in doc.tolist()], names_type), pa.array(a - begin[doc] + base[doc]), pa.array(b - a),
                 pa.array([stream[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()),
                 pa.array(np.array(total, dtype=np.int64)[doc]), pa.array(window + sequence), pa.array(a - cuts[window])],
                names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequence += len(cuts) - 1
            keep = int(np.searchsorted(doc_ends, stop, side="right"))
            names, left, ends, done, total = names[keep:], left[keep:], ends[keep:], done[keep:], total[keep:]
            if left and (cut := stop - int(begin[keep])) > 0:
                left[0], ends[0], done[0] = left[0][cut:], ends[0][ends[0] > cut] - cut, done[0] + cut
            size = sum(len(x) for x in left)

        names_type = None
        for batch in batches:
            names_type = batch.schema.field(0).type
            for d, (ids, sentence) in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                names.append(d)
                left.append(np.append(ids, np.uint32(end_id)))
                ends.append(sentence[sentence < len(ids)])
                done.append(0)
                total.append(len(ids) + 1)
                size += len(ids) + 1
                if size >= STREAM_IDS:
                    yield from flush(False)
        if left:
            yield from flush(True)
        if not keep_words:
            encoder.forget()

    return rows.mapInArrow(run, schema)


@register("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
