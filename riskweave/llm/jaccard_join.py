"""N-gram Jaccard join (operator 8): vertical partitioning of word shingles.

Shingles have one global order: their 64-bit hashes, the very common ones last. The order is cut into fragments.

1. Texts with the same shingle set form a class; from here on only classes matter, so copies cost nothing more.
2. A class sends the first part of its set (40 %, see ``prefix_length``) to the fragments. Each fragment counts in how
   many classes a shingle occurs. A linked pair has 80 % of its shingles in common, so each partner has at least
   ``spare(n) + 1`` of these shingles in common with it: classes with fewer shared ones are out, and of the others the
   ``spare(n)`` most frequent shingles are not needed to find the pair. Unshared shingles also bound what a class can
   have in common with a linked one, so most pairs that share a passage only are never formed.
3. The sets of the remaining classes are searched once more, whole and among themselves: what a set shares with any other
   bounds all its overlaps, which leaves out nearly all copies that were changed too much to be linked, and orders its
   shingles by the number of classes that hold them. The rarest make the blocks (classes that hold one shingle); the place
   of a shingle and the sizes in a block bound the overlap again; of blocks with the same members one is kept.
4. Instead of all pairs of a block, its members meet the block's most central member (whose shingles are the most shared
   ones, as those of a text that others were copied from); linked classes get a common label, and only classes of
   different labels meet again, at the next central member. When few pairs of different labels are left (or a round finds
   no link), these are all verified.
5. A pair is verified exactly: both sets are cut into fragments, overlaps are counted per fragment and summed per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import give_back_memory, parallelism, small_batches
from riskweave.llm.components import components
from riskweave.llm.shingles import Shingler
from riskweave.plans.registry import register
from riskweave.sources.files import stage
from riskweave.sources.tables import read_table

PERCENT = 80
CHUNK = 1 << 20  # shingles that a task gathers before it sends them
FRAGMENT_SHINGLES = 1 << 19  # shingles that one fragment holds, about
CUTS = 4  # fragments that verified sets are cut into
# Common shingles go last in the global order: those in so many texts of a chunk, the most frequent so many of each
# chunk, and of these the most frequent so many (a list of fixed size, which is broadcast). They only make the search
# faster: any order gives the same links.
CHUNK_TEXTS, CHUNK_COMMON, MOST_COMMON = 2, 40_000, 400_000
BLOOM_BITS = 26  # of the filter that spares sending sets nobody asks for: 8 MB, whatever the corpus


def needed(n: int) -> int:
    """Shingles that a set of n has in common with any linked one, at least."""
    return -(-PERCENT * n // 100)


def extra(n: int) -> int:
    return max(1, n // 5)


def prefix_length(n: int) -> int:
    """In global order, the first shingles of a set of n: they hold the first ``extra(n)`` common ones of any link."""
    return n - needed(n) + extra(n)


def spare(n: int) -> int:
    """Shared prefix shingles that a set of n may leave aside (the most frequent ones): a partner has at least
    needed(n) shingles, so both prefixes hold extra(needed(n)) common ones and the rarest of these stays in both."""
    return extra(needed(n)) - 1


def _sets(batch: pa.RecordBatch, shingler: Shingler):
    for text in batch.column("_text").cast(pa.large_binary()).to_pylist():
        s = shingler.sets(text)
        yield s, xxhash.xxh3_128_digest(s.tobytes())


def _signatures(rows: DataFrame) -> DataFrame:
    """kind 0: (id, n, c) of every row, c the class; kind 1: (shingle, texts) that are common in a chunk."""
    kind = dict(rows.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(), {}, 0
        names = ["kind", "id", "n", "c", "shingle", "texts"]

        def common(id_type):
            every, count = np.unique(np.concatenate(list(held.values())), return_counts=True)
            hot = np.flatnonzero(count >= CHUNK_TEXTS)
            hot = hot[np.argsort(-count[hot], kind="stable")[:CHUNK_COMMON]]
            m = len(hot)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, np.int32)), pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
                 pa.array(every[hot].view(np.int64)), pa.array(count[hot].astype(np.int64))], names=names)

        for b in batches:
            n, c = [], []
            for s, key in _sets(b, shingler):
                n.append(len(s))
                c.append(key)
                if len(s) and key not in held:
                    held[key] = s
                    size += len(s)
            m = len(n)
            id_type = b.column("_id").type
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), b.column("_id"), pa.array(n, pa.int64()), pa.array(c, pa.binary()),
                                              pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
            if size >= CHUNK:
                yield common(id_type)
                held, size = {}, 0
        if held:
            yield common(id_type)
        held = {}
        give_back_memory()

    return rows.mapInArrow(run, f"kind int, id {kind}, n long, c binary, shingle long, texts long")


POSTINGS = "fragment long, shingles binary, owners binary, keys binary, sizes binary, starts binary"


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by place of their bytes: the upper ones are mostly zero, so they take little room in a shuffle."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _late(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of the shingles are very common ones (``common``, sorted)."""
    if not len(common):
        return np.zeros(len(s), dtype=bool)
    return common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s


def _chunk_postings(keys: list, sizes: list, parts: list, common: np.ndarray, fragments: int) -> Iterator[pa.RecordBatch]:
    """A chunk's shingles, one row per fragment (negative, and spread over many: the very common ones): the shingles,
    for each the step to the number of its class in the row's own list, and that list (16-byte keys, set sizes, and the
    place among the class's shingles of its first one here; the others follow it there)."""
    flat = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p) for p in parts])
    place = np.concatenate([np.arange(len(p), dtype=np.uint32) for p in parts])
    at = np.array((flat >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32), dtype=np.int64)
    at[_late(flat, common)] = -1 - int.from_bytes(keys[0][:4], "big") % fragments
    order = np.argsort(at, kind="stable")
    stops = np.flatnonzero(np.diff(at[order], append=fragments + 1))
    raw, n = np.frombuffer(b"".join(keys), dtype="V16"), np.array(sizes, dtype=np.uint32)
    begin = 0
    for stop in (stops + 1).tolist():
        rows_ = order[begin:stop]
        own, first, number = np.unique(owner[rows_], return_index=True, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(at[rows_[0]])]), pa.array([flat[rows_].tobytes()], pa.binary()), pa.array([_planes(np.diff(number, prepend=0))], pa.binary()),
             pa.array([raw[own].tobytes()], pa.binary()), pa.array([_planes(n[own])], pa.binary()), pa.array([_planes(place[rows_[first]])], pa.binary())],
            names=["fragment", "shingles", "owners", "keys", "sizes", "starts"])
        begin = stop


def _postings(rows: DataFrame, hot: np.ndarray, fragments: int) -> DataFrame:
    """Prefix shingles of each chunk's classes."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, common = Shingler(), shared.value
        keys, sizes, parts, seen, size = [], [], [], set(), 0
        for b in batches:
            for s, key in _sets(b, shingler):
                if 100 * len(s) < PERCENT * (len(s) + 1) or key in seen:  # so small a set has no link but to equal ones
                    continue
                seen.add(key)
                late = _late(s, common)
                s = np.concatenate([s[~late], s[late]])
                keys.append(key)
                sizes.append(len(s))
                parts.append(s[:prefix_length(len(s))])
                size += len(parts[-1])
                if size >= CHUNK:
                    yield from _chunk_postings(keys, sizes, parts, common, fragments)
                    keys, sizes, parts, seen, size = [], [], [], set(), 0
        if parts:
            yield from _chunk_postings(keys, sizes, parts, common, fragments)
        keys, sizes, parts, seen = [], [], [], set()
        give_back_memory()

    return rows.mapInArrow(run, POSTINGS)


def _whole_postings(sets: DataFrame, hot: np.ndarray, fragments: int) -> DataFrame:
    """All shingles of the searched classes' sets."""
    shared = sets.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, parts, size = [], [], [], 0
        for b in batches:
            for c, n, part in zip(*[b.column(x).to_pylist() for x in ("c", "n", "part")], strict=True):
                if not part:
                    continue
                keys.append(c)
                sizes.append(n)
                parts.append(np.frombuffer(part, np.uint64))
                size += len(parts[-1])
                if size >= CHUNK:
                    yield from _chunk_postings(keys, sizes, parts, shared.value, fragments)
                    keys, sizes, parts, size = [], [], [], 0
        if parts:
            yield from _chunk_postings(keys, sizes, parts, shared.value, fragments)
        keys, sizes, parts = [], [], []
        give_back_memory()

    return sets.mapInArrow(run, POSTINGS)


def _keys16(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())


def _shared(table: pa.Table, hot: np.ndarray, texts: np.ndarray):
    """One fragment: the shingles that occur in two classes or more, with each of these classes and their number.
    The common ones (``hot``, sorted) are known to be shared; ``texts`` has their (approximate) numbers."""
    flat, keys, sizes, places = [], [], [], []
    for s, o, k, n, f in zip(*[table.column(c).to_pylist() for c in ("shingles", "owners", "keys", "sizes", "starts")], strict=True):
        number = np.cumsum(_from_planes(o), dtype=np.int64)
        flat.append(np.frombuffer(s, np.uint64))
        keys.append(np.frombuffer(k, "<u8").reshape(-1, 2)[number])
        sizes.append(_from_planes(n)[number])
        # A class's shingles stand together in the row, in the order of its prefix.
        start = np.searchsorted(number, np.arange(number[-1] + 1))
        places.append(_from_planes(f)[number] + (np.arange(len(number)) - start[number]).astype(np.uint32))
    flat, keys, sizes, places = np.concatenate(flat), np.concatenate(keys), np.concatenate(sizes), np.concatenate(places)
    common = table.column("fragment")[0].as_py() < 0
    if not common:
        order = np.argsort(flat)
        same = np.zeros(len(flat) + 1, dtype=bool)
        same[1:-1] = flat[order][1:] == flat[order][:-1]
        many = order[same[1:] | same[:-1]]  # equal to a neighbour
        flat, keys, sizes, places = flat[many], keys[many], sizes[many], places[many]
    # One class may come from several chunks.
    order = np.lexsort((keys[:, 1], keys[:, 0], flat))
    flat, keys, sizes, places = flat[order], keys[order], sizes[order], places[order]
    again = (flat[1:] == flat[:-1]) & (keys[1:] == keys[:-1]).all(axis=1)
    new = np.concatenate([[True], ~again])[:len(flat)]
    flat, keys, sizes, places = flat[new], keys[new], sizes[new], places[new]
    if common:
        df = texts[np.searchsorted(hot, flat)]
    else:
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        df = count[at]
        more = df >= 2
        flat, keys, sizes, places, df = flat[more], keys[more], sizes[more], places[more], df[more]
    return flat, keys, sizes, places, df


def _shared_shingles(hot: np.ndarray, texts: np.ndarray):
    """One row per class and shared shingle of a fragment."""

    def run(table: pa.Table) -> pa.Table:
        flat, keys, sizes, places, df = _shared(table, hot, texts)
        give_back_memory()
        return pa.table({"shingle": pa.array(flat.view(np.int64)), "c": _keys16(keys), "n": pa.array(sizes.astype(np.int64)),
                         "df": pa.array(df.astype(np.int64)), "place": pa.array(places.astype(np.int32))})

    return run


def _shared_parts(hot: np.ndarray, texts: np.ndarray, buckets: int):
    """One row per bucket of classes of a fragment: the classes, how many shared shingles each has there, the sum of
    their numbers of classes, and the rarest of them (as many as a class can need) with these numbers."""

    def run(table: pa.Table) -> pa.Table:
        flat, keys, sizes, _, df = _shared(table, hot, texts)
        bucket = (keys[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((flat, df, keys[:, 1], keys[:, 0], bucket))
        flat, keys, n, df, bucket = flat[order], keys[order], sizes[order].astype(np.int64), df[order].astype(np.int64), bucket[order]
        begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])[:len(flat)])
        count = np.diff(begin, append=len(flat))
        total = np.add.reduceat(df, begin) if len(begin) else begin
        rank = np.arange(len(flat)) - np.repeat(begin, count)
        rare = rank <= n - -(-PERCENT * n // 100)
        taken = np.add.reduceat(rare.astype(np.int64), begin) if len(begin) else begin
        edge = np.flatnonzero(np.diff(bucket[begin], prepend=-1))  # classes that begin a bucket
        rows = []
        for a, b in zip(edge.tolist(), np.append(edge, len(begin))[1:].tolist(), strict=True):
            here = slice(begin[a], begin[b] if b < len(begin) else len(flat))
            rows.append((int(bucket[begin[a]]), keys[begin[a:b]].tobytes(), np.stack([n[begin[a:b]], count[a:b], total[a:b], taken[a:b]]).astype(np.int64).tobytes(),
                         flat[here][rare[here]].tobytes(), df[here][rare[here]].tobytes()))
        give_back_memory()
        return pa.table([pa.array([r[x] for r in rows], t) for x, t in enumerate([pa.int64()] + 4 * [pa.binary()])],
                        names=["bucket", "keys", "numbers", "shingles", "df"])

    return run


def _class_rows(table: pa.Table) -> pa.Table:
    """One bucket of classes: each class's e - needed(n) + 1 rarest shared shingles, with e less one for each rarer one."""
    parts = [table.column(x).to_pylist() for x in ("keys", "numbers", "shingles", "df")]
    keys = np.frombuffer(b"".join(parts[0]), "<u8").reshape(-1, 2)
    n, count, total, taken = np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in parts[1]], axis=1)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(np.concatenate([[False], (keys[order][1:] != keys[order][:-1]).any(axis=1)]))
    _, first = np.unique(number, return_index=True)
    keys, n = keys[first], n[first]
    e, t = np.bincount(number, weights=count).astype(np.int64), np.bincount(number, weights=total)
    flat, df = np.frombuffer(b"".join(parts[2]), np.uint64), np.frombuffer(b"".join(parts[3]), np.int64)
    owner = np.repeat(number, taken)
    order = np.lexsort((flat, df, owner))
    owner, flat = owner[order], flat[order]
    held = np.bincount(owner, minlength=len(n))
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(held) - held, held)
    rest = e[owner] - rank
    keep = rest >= -(-PERCENT * n[owner] // 100)
    owner = owner[keep]
    give_back_memory()
    return pa.table({"shingle": pa.array(flat[keep].view(np.int64)), "c": _keys16(keys[owner]), "n": pa.array(n[owner]),
                     "e": pa.array(rest[keep]), "w": pa.array((t / n)[owner])})


def _least(n) -> Column:
    """``needed`` as an expression."""
    return F.ceil(PERCENT * F.col(n) / 100).cast("long")


def _members(blocks: DataFrame) -> DataFrame:
    """(shingle, c, n, e, w), without members whose e, what they can have in common with a class that shares no rarer
    shingle, is too little for the smallest size in the block, and without blocks of one. Of blocks with the same members
    the rarest is kept, where e is greatest for all of them."""
    for _ in range(2):  # the second time with the sizes that are left
        size = blocks.groupBy("shingle").agg(F.min("n").alias("_n"))
        blocks = blocks.join(size, "shingle").where((100 + PERCENT) * F.col("e") >= PERCENT * (F.col("n") + F.greatest("_n", _least("n")))).drop("_n")
    found = blocks.groupBy("shingle").agg(F.count("*").alias("k"), F.sum("e").alias("t"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("y"))
    one = found.where(F.col("k") > 1).groupBy("k", "x", "y").agg(F.max(F.struct("t", "shingle")).alias("m")).select(F.col("m.shingle").alias("shingle"))
    return blocks.join(one, "shingle")


def _searched_blocks(spark: SparkSession, sets: DataFrame, hot: np.ndarray, texts: np.ndarray) -> DataFrame:
    """The blocks of a second search, among the classes of the first one only. A shingle that none of these others has
    cannot be in common with a linked class, wherever it stands in the order: what is left of a set (e shingles) bounds
    every overlap, so a class with e < needed(n) is out, and of the others the e - needed(n) + 1 rarest suffice. A linked
    pair is found where its rarest common shingle is: there the rarer ones of either set are not in common, so each row's
    e leaves them out."""
    total = sets.agg(F.coalesce(F.sum(F.length("part")), F.lit(0)) / 8).first()[0]
    fragments = max(1, math.ceil(total / FRAGMENT_SHINGLES))  # and as many buckets of classes
    parts = _whole_postings(sets, hot, fragments).groupBy("fragment").applyInArrow(
        _shared_parts(hot, texts, fragments), "bucket long, keys binary, numbers binary, shingles binary, df binary")
    rows = parts.groupBy("bucket").applyInArrow(_class_rows, "shingle long, c binary, n long, e long, w double")
    return stage(spark, rows, "searched_blocks")


def _let_through(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose class is among the ``keys`` (and a few others), found where they are read."""
    shared = sets.sparkSession.sparkContext.broadcast(_bloom(keys))

    @F.arrow_udf("boolean")
    def asked(c: pa.Array) -> pa.Array:
        spots = np.frombuffer(b"".join(c.to_pylist()), ">u4").reshape(-1, 4)[:, :3].astype(np.int64) % (1 << BLOOM_BITS)
        return pa.array((shared.value[spots >> 6] >> (spots & 63) & 1).all(axis=1))

    return sets.where(asked("c"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sets link: overlaps per fragment, summed per pair. Only sets of these pairs are shuffled."""

    @F.arrow_udf("long")
    def overlap(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([len(np.intersect1d(np.frombuffer(i, np.uint64), np.frombuffer(j, np.uint64), assume_unique=True))
                         for i, j in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int64())

    left = _let_through(sets, pairs.select(F.col("a").alias("c"))).select(F.col("c").alias("a"), "cut", F.col("part").alias("pa"))
    right = _let_through(sets, pairs.select(F.col("b").alias("c"))).select(F.col("c").alias("b"), "cut", F.col("part").alias("pb"))
    both = pairs.join(left, "a").join(right, ["b", "cut"])
    total = both.groupBy("a", "b", "na", "nb").agg(F.sum(overlap("pa", "pb")).alias("o"))
    return total.where(100 * F.col("o") >= PERCENT * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _bloom(keys: DataFrame) -> np.ndarray:
    """A bit field of fixed size with three bits set for each 16-byte key."""
    spots = [F.conv(F.hex(F.substring("c", 1 + 4 * i, 4)), 16, 10).cast("long") % F.lit(1 << BLOOM_BITS) for i in range(3)]
    words = (keys.select(F.explode(F.array(*spots)).alias("p")).select((F.col("p") / 64).cast("long").alias("w"), (F.col("p") % 64).alias("b"))
             .distinct().groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(b as int))")).alias("v")).toPandas())
    field = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.int64)
    field[words.w.to_numpy()] = words.v.to_numpy()
    return field


def _asked_sets(rows: DataFrame, field: np.ndarray) -> DataFrame:
    """(c, cut, part, n): sets that the bit field lets through, cut into ``CUTS`` fragments; once per class."""
    shared = rows.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, wanted, seen = Shingler(), shared.value, set()
        edges = [np.uint64(i << 62) for i in range(1, CUTS)]
        for b in batches:
            c, cut, part, n = [], [], [], []
            for s, key in _sets(b, shingler):
                spots = [int.from_bytes(key[4 * i:4 * i + 4], "big") % (1 << BLOOM_BITS) for i in range(3)]
                if key in seen or not all(int(wanted[p >> 6]) >> (p & 63) & 1 for p in spots):
                    continue
                if len(seen) < CHUNK // 8:
                    seen.add(key)
                for i, piece in enumerate(np.split(s, np.searchsorted(s, edges))):
                    c.append(key)
                    cut.append(i)
                    part.append(piece.tobytes())
                    n.append(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(cut, pa.int32()), pa.array(part, pa.binary()), pa.array(n, pa.int64())],
                                             names=["c", "cut", "part", "n"])

    return rows.mapInArrow(run, "c binary, cut int, part binary, n long").dropDuplicates(["c", "cut"])


def _class_links(spark: SparkSession, blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): classes that have links, and the smallest class of their component (as ``components`` gives them)."""
    # Sizes that allow a link, and enough shingles that both can have in common.
    near = (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & ((100 + PERCENT) * F.least("ea", "eb") >= PERCENT * (F.col("na") + F.col("nb")))
    here, links, tried = blocks.withColumn("label", F.col("c")), None, None
    while True:
        # Each block's most central member; blocks under one label are done.
        first = here.groupBy("shingle").agg(F.max(F.struct("w", "c", "n", "e", "label")).alias("h"), F.min("label").alias("_l"), F.max("label").alias("_m"))
        first = first.where(F.col("_l") != F.col("_m")).select("shingle", F.col("h.c").alias("a"), F.col("h.n").alias("na"), F.col("h.e").alias("ea"), F.col("h.label").alias("la"))
        met = stage(spark, here.join(first, "shingle").where(F.col("c") != F.col("a")), "block_members")
        pairs = met.where(F.col("label") != F.col("la")).select("a", F.col("c").alias("b"), "na", F.col("n").alias("nb"), "ea", F.col("e").alias("eb")).where(near).select("a", "b", "na", "nb").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(spark, pairs, "pairs")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        new = stage(spark, _linked(pairs, sets), "links")
        links = new if links is None else links.unionByName(new)
        # A label: the smallest class one or two links away. (Not yet the whole component; it only saves verifying.)
        up = links.groupBy(F.col("b").alias("_c")).agg(F.min("a").alias("_up"))
        top = up.select(F.col("_c").alias("_d"), F.col("_up").alias("_top"))
        label = up.join(top, F.col("_up") == F.col("_d"), "left").select("_c", F.coalesce("_top", "_up").alias("_to"))
        here = met.join(label, F.col("c") == F.col("_c"), "left").select("shingle", "c", "n", "e", "w", F.coalesce("_to", "c").alias("label"))
        here = stage(spark, here, "relabelled")
        same = here.groupBy("shingle", "label").agg(F.count("*").alias("k"))
        left = same.groupBy("shingle").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("s"))
        size = left.where(F.col("m") * F.col("m") > F.col("s")).agg(
            F.sum((F.col("m") * F.col("m") - F.col("s")) / 2).alias("pairs"), F.sum("m").alias("members")).first()
        # Pairs of different labels that a member has in a block, on average, are about what its class has left.
        if not size.members or size.pairs / size.members <= 4 or not new.take(1):
            break
    x = here.select("shingle", F.col("c").alias("a"), F.col("n").alias("na"), F.col("e").alias("ea"), F.col("label").alias("la"))
    y = here.select("shingle", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("e").alias("eb"), F.col("label").alias("lb"))
    pairs = x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & near).select("a", "b", "na", "nb").distinct()
    last = stage(spark, pairs.join(tried, ["a", "b"], "left_anti"), "last_pairs")
    return components(links.unionByName(_linked(last, sets)))


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, ``n_shingles`` (size of its set of 5-word shingles) and ``component_id``, the smallest
    id that links reach from it. Two rows link when 100 * intersection >= 80 * union of their sets, so rows of equal sets
    always do. A null text or one without words has an empty set and is linked with nothing: its component is its own id.
    Null ids are never the smallest; rows with equal ids are rows of their own. Every link between different sets counts:
    there is no cap on a block, a group or a text."""
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    both = stage(spark, _signatures(rows), "signatures")
    docs = both.where("kind = 0").select("id", "n", "c")
    total = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    common = both.where("kind = 1").groupBy("shingle").agg(F.sum("texts").alias("texts")).orderBy(F.desc("texts"), "shingle").limit(MOST_COMMON).toPandas()
    hot, texts = common.shingle.to_numpy(np.int64).view(np.uint64), common.texts.to_numpy(np.int64)
    hot, texts = hot[np.argsort(hot)], texts[np.argsort(hot)]
    fragments = max(parallelism(documents), math.ceil(0.4 * total.shingles / FRAGMENT_SHINGLES))
    shared = _postings(rows, hot, fragments).groupBy("fragment").applyInArrow(_shared_shingles(hot, texts), "shingle long, c binary, n long, df long, place int")
    # The most frequent shared shingles of a class come first; a class has at most prefix_length(n) of them.
    listed = shared.groupBy("c", "n").agg(F.collect_set(F.struct("df", "shingle", "place")).alias("s"), F.sum("df").alias("t"))
    least = F.expr(f"({PERCENT} * n + 99) div 100")
    aside = F.greatest(F.lit(1), F.expr(f"(({PERCENT} * n + 99) div 100) div 5")) - 1
    # How central a class is: the mean number of classes that hold one of its prefix shingles.
    prefix = F.col("n") - least + F.greatest(F.lit(1), F.expr("n div 5"))
    # All but the unshared shingles in front of the spare(n) + 1st shared one: the most shingles that it can have in common
    # with a linked class. A common shingle that has at most spare(n) common ones before it is within the partner's prefix
    # too, however many of its own the partner has; an unshared one further back may be common and behind that prefix.
    most = F.col("n") - (F.try_element_at(F.sort_array(F.col("s.place")), (aside + 1).cast("int")) - aside)
    # Computed before the explode, once per class and not per shingle.
    bounded = listed.select("c", "n", most.cast("long").alias("e"), (F.col("t") / prefix).alias("w"),
                            F.slice(F.sort_array("s", asc=False), (aside + 1).cast("int"), F.size("s")).alias("s")).where(F.col("e") >= least)
    kept = bounded.select("c", "n", "e", "w", F.explode("s").alias("s"))
    every = stage(spark, kept.select("c", "n", "e", "w", F.col("s.shingle").alias("shingle")), "all_blocks")
    size = every.groupBy("shingle").agg(F.count("*").alias("k")).where(F.col("k") > 1)
    searched = every.join(size.select("shingle"), "shingle", "left_semi").select("c").distinct()
    sets = stage(spark, _asked_sets(rows, _bloom(searched)), "asked_sets")
    blocks = stage(spark, _members(_searched_blocks(spark, sets, hot, texts)), "blocks")
    links = _class_links(spark, blocks, sets)
    # Components of classes, then of rows; a class or component of any size is one partial minimum per task.
    least_id = docs.where("n > 0").groupBy("c").agg(F.min("id").alias("id"))
    named = least_id.join(links.select(F.col("a").alias("c"), F.col("b").alias("_to")), "c", "left").select("c", "id", F.coalesce("_to", "c").alias("label"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    classes = named.join(smallest, "label").select("c", "component_id")
    out = docs.join(classes, "c", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


@register("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
