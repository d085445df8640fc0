"""Cross-tokenizer alignment (operator 11): merge_asof per batch, keyed by document.

Each token of one side looks up, by its start, the other side's token that covers this start; both directions together
give all overlaps. Where two overlapping tokens end at the same byte, a group ends. Links are all pairs of tokens of a
group. How telling a link is depends on the corpus: its count is the number of documents that hold its id pair linked.

Documents are staged with the number of each distinct pair within their block (one Arrow batch); a block's pairs with
their document counts are summed over the corpus, and the totals come back to the block, not to each document.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import ASCII_SPACE, flat_bytes, small_batches
from riskweave.plans.registry import register
from riskweave.sources.files import stage
from riskweave.sources.tables import read_table

PIECE_BYTES = 256_000  # texts that are aligned at once hold so many bytes; a longer text is aligned alone
MAX_WORDS = 300_000  # distinct words whose tokens a task remembers at once
ID_BITS = 32  # a pair's key: A's id in the upper bits, B's in the lower
# Fixed value: Unicode's white space characters, at which byte-level vocabularies split before they merge.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_level_bytes() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the
    other bytes in ascending order for the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelSide:
    """Tokens of texts that begin with a space, by a byte-level vocabulary file; strings of special tokens are plain
    text. Its split never joins a blank to a character before it, so words with the blanks before them stand alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        byte = byte_level_bytes()
        names = {i: t for t, i in config["model"]["vocab"].items()}
        names |= {t["id"]: t["content"] for t in config.get("added_tokens", [])}
        self.table = [bytes(byte[c] for c in names.get(i, "")) if all(c in byte for c in names.get(i, "")) else b""
                      for i in range(max(names) + 1)]
        split = config.get("pre_tokenizer") or {}
        self.by_word = (config.get("normalizer") is None and split.get("type") == "ByteLevel" and bool(split.get("use_regex"))
                        and not split.get("add_prefix_space"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceSide:
    """Tokens of texts that begin with a space, by a piece model that itself puts a space before what it gets. Where no
    piece goes on from another character to a space or newline, merges stay within a word and the blanks before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("▁")
        crossing = re.compile(f"[^{BLANKS}][ \n]| \n")
        self.by_word = (b"identity" in self.model.serialized_model_proto() and self._given_back(" a  b ")
                        and not any(crossing.search(p.replace("▁", " ")) for p in pieces))

    def _given_back(self, text: str) -> bool:
        return b"".join(self.table[i] for i in self.model.encode(text)) == b" " + text.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [([self.space] if t == " " else ids) if t[0] == " " else ids[1:] for t, ids in zip(texts, found, strict=True)]


def word_starts(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words begin, each with the blanks before it: at a text's start, and at a space or newline behind a character
    that is surely no blank (after some rare characters a word goes on, which does no harm)."""
    blank = np.isin(flat, np.frombuffer(ASCII_SPACE, dtype=np.uint8))
    at = np.flatnonzero(((flat[1:] == ord(" ")) | (flat[1:] == ord("\n"))) & ~blank[:-1]) + 1
    # Blanks beyond ASCII are C2 xx, or three bytes from E1, E2 or E3 on.
    two, three = flat[np.maximum(at - 2, 0)], flat[np.maximum(at - 3, 0)]
    other = (flat[at - 1] >= 0x80) & ((two == 0xC2) | (three == 0xE1) | (three == 0xE2) | (three == 0xE3))
    begins = np.zeros(len(flat), dtype=bool)
    begins[at[~other]] = True
    begins[starts[:-1][np.diff(starts) > 0]] = True
    return np.flatnonzero(begins)


class Words:
    """The tokens of both sides of the words met so far: flat ids, and each word's start and length in them."""

    def __init__(self, sides: tuple):
        self.sides = sides
        self.clear()

    def clear(self):
        self.number: dict[bytes, int] = {}
        self.good = np.zeros(0, dtype=bool)
        self.flat = [np.zeros(0, dtype=np.int32) for _ in self.sides]
        self.start = [np.zeros(0, dtype=np.int64) for _ in self.sides]
        self.length = [np.zeros(0, dtype=np.int64) for _ in self.sides]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words; unknown ones are encoded."""
        fresh = [w for w in words if w not in self.number]
        if len(self.number) + len(fresh) > MAX_WORDS and self.number:
            self.clear()
            fresh = words
        if fresh:
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
            texts = [w.decode() for w in fresh]
            good = np.ones(len(fresh), dtype=bool)
            for k, side in enumerate(self.sides):
                found = side.encode(texts)
                if b"".join(map(side.table.__getitem__, itertools.chain.from_iterable(found))) != b"".join(fresh):
                    good &= np.fromiter((b"".join(map(side.table.__getitem__, ids)) == w for ids, w in zip(found, fresh, strict=True)),
                                        dtype=bool, count=len(fresh))
                length = np.fromiter(map(len, found), dtype=np.int64, count=len(fresh))
                begin = len(self.flat[k]) + np.cumsum(length) - length
                flat = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(length.sum()))
                self.flat[k] = np.concatenate([self.flat[k], flat])
                self.start[k], self.length[k] = np.concatenate([self.start[k], begin]), np.concatenate([self.length[k], length])
            self.good = np.concatenate([self.good, good])
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))


class Aligner:
    """Aligns two sides' tokens of many texts at once."""

    def __init__(self, a, b):
        self.sides = (a, b)
        self.by_word = a.by_word and b.by_word
        self.words = Words(self.sides)
        self.lengths = [np.array([len(t) for t in s.table], dtype=np.int64) for s in self.sides]
        # Decimal ids with the sign behind them, as a document's groups are written.
        self.marked = [[np.array([f"{i}{sign}" for i in range(len(s.table))], dtype=object) for sign in (",", end)]
                       for s, end in zip(self.sides, "|;", strict=True)]

    def tokens(self, flat: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both sides' ids of all texts (each empty, or with a space before it), and how many each text has; none for
        texts that a side does not give back."""
        at = word_starts(flat, starts) if self.by_word else starts[:-1][np.diff(starts) > 0]
        edges = np.append(at, len(flat)).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(flat)]).dictionary_encode()
        word = self.words.numbers(found.dictionary.to_pylist())[found.indices.to_numpy()]
        text = np.searchsorted(starts, at, side="right") - 1
        bad = np.zeros(len(starts) - 1, dtype=bool)
        bad[text[~self.words.good[word]]] = True
        held = ~bad[text]
        word, text = word[held], text[held]
        ids, counts = [], []
        for all_ids, start, length in zip(self.words.flat, self.words.start, self.words.length, strict=True):
            n = length[word]
            ids.append(all_ids[np.arange(int(n.sum())) + np.repeat(start[word] - (np.cumsum(n) - n), n)].astype(np.int64))
            counts.append(np.bincount(text, weights=n, minlength=len(starts) - 1).astype(np.int64))
        return ids, counts

    def align(self, flat: np.ndarray, starts: np.ndarray) -> dict[str, list | np.ndarray]:
        """Columns with one value per text: n_a, n_b, n_groups, groups (as written), and the distinct linked pairs of
        every text as (pairs, links) with ``starts`` where each text's begin."""
        (a, b), counts = self.tokens(flat, starts)
        n_texts = len(starts) - 1
        docs = [np.repeat(np.arange(n_texts), n) for n in counts]
        # Positions run on from text to text; both sides' bytes of a text are the same, so both run alike.
        ends = [np.cumsum(length[x]) for length, x in zip(self.lengths, (a, b), strict=True)]
        group_a, group_b = groups(docs, ends, [e - length[x] for e, length, x in zip(ends, self.lengths, (a, b), strict=True)])
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        first_a, first_b = np.searchsorted(group_a, np.arange(n_groups + 1)), np.searchsorted(group_b, np.arange(n_groups + 1))
        doc_of_group = docs[0][first_a[:-1]]
        pairs, links, pair_starts = linked_pairs((a, b), (group_a, group_b), doc_of_group, n_texts)
        return {"n_a": counts[0], "n_b": counts[1], "n_groups": np.bincount(doc_of_group, minlength=n_texts),
                "groups": self._written((a, b), (group_a, group_b), (first_a, first_b), counts),
                "pairs": pairs, "links": links, "starts": pair_starts}

    def _written(self, ids, group, first, counts) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per text: a group's A ids, then its B ids."""
        n = [len(x) for x in ids]
        text = np.empty(n[0] + n[1], dtype=object)
        for side in (0, 1):
            last = np.zeros(n[side], dtype=bool)
            last[first[side][1:] - 1] = True
            # Before a token stand its own side's earlier ones and the other side's of earlier groups (A: its own group's too).
            place = np.arange(n[side]) + (first[1][group[0]] if side == 0 else first[0][group[1] + 1])
            text[place] = np.where(last, self.marked[side][1][ids[side]], self.marked[side][0][ids[side]])
        stops = np.cumsum(counts[0] + counts[1])
        text = text.tolist()
        return ["".join(text[e - k:e])[:-1] for e, k in zip(stops.tolist(), (counts[0] + counts[1]).tolist(), strict=True)]


def groups(docs: list[np.ndarray], ends: list[np.ndarray], starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The group number of each token of both sides, running on from document to document."""
    frames = [pd.DataFrame({"doc": d, "start": s, "own": np.arange(len(d))}) for d, s in zip(docs, starts, strict=True)]
    overlaps = []
    for side in (0, 1):
        covering = frames[1 - side].rename(columns={"own": "other"})
        hit = pd.merge_asof(frames[side], covering, on="start", by="doc", direction="backward")
        found = (hit["own"].to_numpy(), hit["other"].to_numpy(dtype=np.int64))
        overlaps.append(found if side == 0 else found[::-1])
    over_a, over_b = (np.concatenate([o[i] for o in overlaps]) for i in (0, 1))
    closed = ends[0][over_a] == ends[1][over_b]
    out = []
    for side, over in ((0, over_a), (1, over_b)):
        last = np.zeros(len(docs[side]), dtype=np.int64)
        last[over[closed]] = 1
        out.append(np.cumsum(last) - last)
    return out[0], out[1]


def _distinct(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and how often (with what weight in all) each occurs."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    if weight is None:
        return key[at], np.diff(at, append=len(key))
    return key[at], np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, dtype=np.int64)


def linked_pairs(ids, group, doc_of_group: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct id pairs of each document with their links: (pairs, links, where each document's begin). Repeated ids of
    a group are counted before they are paired, so a group makes at most one row per pair of distinct ids."""
    sides = []
    for x, g in zip(ids, group, strict=True):
        key, n = _distinct(g << ID_BITS | x)
        g = key >> ID_BITS
        sides.append((g, key & ((1 << ID_BITS) - 1), n, np.bincount(g, minlength=len(doc_of_group))))
    (ga, a, na, _), (_, b, nb, wide) = sides
    begin = np.cumsum(wide) - wide
    times = wide[ga]  # each distinct A id of a group meets the group's distinct B ids
    left = np.repeat(np.arange(len(a)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + begin[ga][left]
    pair, link, doc = a[left] << ID_BITS | b[right], na[left] * nb[right], doc_of_group[ga[left]]
    known, number = np.unique(pair, return_inverse=True)
    key, link = _distinct(doc * max(len(known), 1) + number, link)
    doc = key // max(len(known), 1)
    return known[key - doc * max(len(known), 1)], link, np.searchsorted(doc, np.arange(n_docs + 1))


def worker_aligner(sides: tuple) -> Aligner:
    """The aligner that this Python worker keeps from task to task: vocabularies and tables, of fixed size. The words
    that a task has met are dropped when it ends."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    kept = sys.modules.setdefault("_riskweave_worker", types.ModuleType("_riskweave_worker")).__dict__
    key = ("aligner", *((kind.__name__, path) for kind, path in sides))
    if key not in kept:
        kept[key] = Aligner(*(kind(path) for kind, path in sides))
    kept[key].words.clear()  # a task that failed leaves some
    return kept[key]


STAGED = ("id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, block long, row long, "
          "pair_at array<int>, links array<long>, block_pairs array<long>, block_docs array<int>")


def align_documents(documents: DataFrame, sides: tuple, id_col: str = "doc_id", text_col: str = "text",
                    with_groups: bool = False) -> DataFrame:
    """One row per input row, with its tokens' groups and links. ``sides``: two (class, vocabulary file) pairs, A and B.

    Columns: id, n_a, n_b, n_groups, groups_sha256 (and the written ``groups`` if asked for), block, row (number in the
    block), pair_at and links (its distinct pairs as positions in the block's list, and how often each is linked), and on
    a block's first row block_pairs and block_docs (its distinct pairs, ascending, and how many of its documents hold
    each). A null or empty text, or one whose bytes a tokenizer does not give back, has no tokens: zeros and ''.
    Repeated rows count as a document each; null ids stay."""
    spark = documents.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), F.when(text != "", F.concat(F.lit(" "), text)).otherwise("").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = worker_aligner(sides)
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            flat, starts = flat_bytes(b.column(1))
            # Cut where the next PIECE_BYTES begin.
            cuts = [0, *(np.flatnonzero(np.diff(starts[1:] // PIECE_BYTES)) + 1).tolist(), b.num_rows]
            parts = [aligner.align(flat[starts[x]:starts[y]], starts[x:y + 1] - starts[x]) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if x < y]
            pairs, links = np.concatenate([p["pairs"] for p in parts]), np.concatenate([p["links"] for p in parts])
            shift = np.cumsum([0, *[len(p["pairs"]) for p in parts]])
            starts = np.concatenate([*(p["starts"][:-1] + s for p, s in zip(parts, shift, strict=False)), shift[-1:]])
            known, at = np.unique(pairs, return_inverse=True)
            lead = [None] * (b.num_rows - 1)
            groups_of = [g for p in parts for g in p["groups"]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(np.concatenate([p[c] for p in parts]), pa.int64()) for c in ("n_a", "n_b", "n_groups")),
                 pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups_of], pa.string()),
                 pa.array(groups_of if with_groups else [None] * len(groups_of), pa.string()),
                 pa.array(np.full(b.num_rows, block)), pa.array(np.arange(b.num_rows, dtype=np.int64)),
                 pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(links, pa.int64())),
                 pa.array([known, *lead], pa.list_(pa.int64())),
                 pa.array([np.bincount(at, minlength=len(known)), *lead], pa.list_(pa.int32()))],
                names=[c.split()[0] for c in STAGED.split(", ")])
            block += 1
        aligner.words.clear()

    return rows.mapInArrow(run, STAGED.format(kind=dict(rows.dtypes)["id"]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a_id, b_id, n_docs, best`` per linked id pair of the (staged) aligned corpus: documents that hold it, and
    whether no pair of this A id is held by more."""
    blocks = aligned.where(F.col("block_pairs").isNotNull())
    pairs = blocks.select(F.explode(F.arrays_zip("block_pairs", "block_docs")).alias("p"))
    total = pairs.groupBy(F.col("p.block_pairs").alias("pair")).agg(F.sum("p.block_docs").alias("n_docs"))
    total = total.select("pair", F.shiftright("pair", ID_BITS).alias("a_id"), "n_docs")
    top = total.groupBy("a_id").agg(F.max("n_docs").alias("top"))  # at most one row per id of A's vocabulary
    out = total.join(top, "a_id")
    return out.select("a_id", F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b_id"), "n_docs",
                      (F.col("n_docs") == F.col("top")).alias("best"))


def link_scores(spark: SparkSession, aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``align_documents``, which is
    staged: links, links whose pair is the commonest of its A id (ties included), and the sum of all links' counts."""
    aligned = stage(spark, aligned, "aligned")
    counts = stage(spark, pair_counts(aligned), "pair_counts")
    # A block asks for its pairs once: rows are blocks times distinct pairs, and a pair has at most one row per block.
    asked = aligned.where(F.col("block_pairs").isNotNull()).select("block", F.posexplode("block_pairs").alias("at", "pair"))
    told = (asked.join(counts.withColumn("pair", F.shiftleft("a_id", ID_BITS).bitwiseOR(F.col("b_id"))), "pair")
            .select(F.col("block").alias("of_block"), "at", "n_docs", "best"))
    kind = dict(aligned.dtypes)["id"]
    docs = aligned.select("block", "id", "n_a", "n_b", "n_groups", "groups_sha256", "pair_at", "links")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        n_docs, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        at = right["at"].to_numpy()
        n_docs[at], best[at] = right["n_docs"].to_numpy(), right["best"].to_numpy()
        lists, links = left["pair_at"].combine_chunks(), left["links"].combine_chunks().flatten().to_numpy()
        pair = lists.flatten().to_numpy()
        stops = np.cumsum(lists.value_lengths().to_numpy())
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (links, links * best[pair], links * n_docs[pair])]
        sums = [x[stops] - np.concatenate([[0], x[stops[:-1]]]) for x in sums]
        same = [left[c] for c in ("id", "n_a", "n_b", "n_groups")]
        return pa.table([*same, *(pa.array(x, pa.int64()) for x in sums), left["groups_sha256"]],
                        names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return docs.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(
        score, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


@register("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    sides = ((ByteLevelSide, public_tokenizers.path("byte_bpe_50k.json")), (PieceSide, public_tokenizers.path("piece_bpe_32k.model")))
    return link_scores(spark, align_documents(read_table(spark, sf_dir, "documents"), sides))
