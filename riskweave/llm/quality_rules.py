"""Quality rules (operator 13): a linear-chain conditional random field marks lines as content or boilerplate.

A text's lines with a word are one sequence. Each line has a few numbers (words, letters' case, signs, repeats of lines and
of word triples), each put in a bin; a bin has a weight per label, and so has each change from label to label. Viterbi
decoding finds the best labels of the whole sequence, and a text is kept if enough of its words stand in content lines.

Weights maximise the likelihood of labelled sequences (forward-backward, gradient steps). Labels exist per document only:
lines first take their document's label; then, of low-quality documents, the lines that their own numbers place with
content change to content, and the chain is fitted on that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import ASCII_SPACE, flat_bytes, small_batches
from riskweave.plans.registry import register
from riskweave.sources.tables import read_table

CONTENT, BOILERPLATE = 0, 1
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_SHARE = 0.5  # of a text's words that must stand in content lines
# The fit's bounded sample of labelled rows: this many per class, of at most so many characters each.
SAMPLE_PER_CLASS = 1000
SAMPLE_CHARS = 20_000
STEPS, LINE_STEPS = 120, 60
PENALTY = 1e-3
# Upper bounds of the bins of each number of a line.
SHARES = (0.0, 0.03, 0.1, 0.25, 0.5, 0.8)
BINS = {
    "words": (1, 2, 4, 8, 16, 64),
    "word_chars": (2.0, 3.5, 5.0, 7.0, 10.0, 20.0),
    "upper": SHARES, "digits": SHARES, "symbols": SHARES, "stops": SHARES, "marks": SHARES, "repeated": SHARES, "symbol_words": SHARES,
    "line_again": (0,), "ends": (0,),
}
WIDTH = {k: len(v) + 1 for k, v in BINS.items()}
FIRST = dict(zip(BINS, np.cumsum([0, *WIDTH.values()])[:-1].tolist(), strict=True))
SIZE = sum(WIDTH.values())


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, dtype=np.uint8)] = True
    return out


def _each(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the ascending positions lie in each stretch from one start to the next."""
    return np.diff(np.searchsorted(at, starts))


def _codes(flat: np.ndarray, held: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of equal strings: the ``held`` bytes, one string after another, of these lengths."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths),
                                               [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat[held]))])
    found = strings.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it occurred before."""
    _, first, number, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(key), dtype=bool)
    later[first] = False
    return times[number] > 1, later


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of a column without nulls: the base numbers per text; and for its lines with a word, in order, their bins (one
    column per number), their words, and where each text's lines begin (one more than texts)."""
    flat, starts = flat_bytes(texts)
    n_texts = len(starts) - 1
    held = ~_table(ASCII_SPACE)[flat]
    opens = held.copy()
    opens[1:] &= ~held[:-1]
    text_begin = starts[:-1][np.diff(starts) > 0]
    opens[text_begin] = held[text_begin]
    word = np.flatnonzero(opens)
    before = np.concatenate([[0], np.cumsum(held)])  # bytes of words before each byte
    word_bytes = np.diff(before[word], append=before[-1])
    lead = np.flatnonzero(held & ((flat & 0xC0) != 0x80))
    symbol = np.flatnonzero(_table(SYMBOLS)[flat])
    n_words = _each(word, starts)
    doc_of_word = np.repeat(np.arange(n_texts), n_words)

    # Words in triples that a text holds twice or more.
    code, distinct = _codes(flat, held, word_bytes)
    in_repeat = np.zeros(len(word), dtype=bool)
    if len(word) > 2:
        _, two = np.unique(code[:-1] * distinct + code[1:], return_inverse=True)
        whole = doc_of_word[:-2] == doc_of_word[2:]
        triple = (doc_of_word[:-2] * (int(two.max()) + 1) + two[:-1]) * distinct + code[2:]
        again = np.zeros(len(word) - 2, dtype=bool)
        again[whole] = _again(triple[whole])[0]
        for k in range(3):
            in_repeat[k:len(word) - 2 + k] |= again

    # Lines: as many as newlines, and one more, per text.
    newline = flat == ord("\n")
    ends = np.flatnonzero(newline)
    n_lines = _each(ends, starts) + 1
    last = np.cumsum(n_lines) - 1
    begin = np.empty(int(n_lines.sum()), dtype=np.int64)
    first_line = np.zeros(len(begin), dtype=bool)
    first_line[last - n_lines + 1] = True
    begin[first_line], begin[~first_line] = starts[:-1], ends + 1
    stop = np.append(begin[1:], len(flat))
    stop[~np.append(first_line[1:], True)] -= 1
    line_code, _ = _codes(flat, ~newline, stop - begin)
    doc_of_line = np.repeat(np.arange(n_texts), n_lines)
    edges = np.append(begin, len(flat))
    line_words = _each(word, edges)
    real = line_words > 0
    twice, later = _again(doc_of_line[real] * (int(line_code.max(initial=0)) + 1) + line_code[real])
    base = {"word_chars": _each(lead, starts), "n_symbols": _each(symbol, starts),
            "n_dup_lines": np.bincount(doc_of_line[real][later], minlength=n_texts),
            "n_repeat_words": np.bincount(doc_of_word[in_repeat], minlength=n_texts), "n_words": n_words}

    def count(mask: np.ndarray) -> np.ndarray:
        return _each(np.flatnonzero(mask), edges)[real]

    words, chars = line_words[real], np.maximum(_each(lead, edges)[real], 1)
    upper, lower = count((flat >= 65) & (flat <= 90)), count(((flat >= 97) & (flat <= 122)) | (flat >= 0xC0))
    marked = word[_each(symbol, np.append(word, len(flat))) > 0] if len(word) else word
    # The last byte of a line's words.
    final = flat[np.maximum(before.searchsorted(before[stop[real]], side="left") - 1, 0)] if real.any() else np.zeros(0, np.uint8)
    numbers = {
        "words": words, "word_chars": chars / words, "upper": upper / np.maximum(upper + lower, 1),
        "digits": count((flat >= 48) & (flat <= 57)) / chars, "symbols": count(_table(SYMBOLS)[flat]) / chars,
        "stops": count(_table(b"!?")[flat]) / words, "marks": count(_table(b".,;:-_=/\\()[]{}+~^\"'`@")[flat]) / chars,
        "repeated": _each(word[in_repeat], edges)[real] / words, "symbol_words": _each(marked, edges)[real] / words,
        "line_again": twice, "ends": _table(b".!?:;\"')")[final],
    }
    bins = np.stack([np.searchsorted(BINS[k], np.asarray(v, dtype=np.float64), side="left") + FIRST[k] for k, v in numbers.items()], axis=1)
    return base, bins, words, np.searchsorted(doc_of_line[real], np.arange(n_texts + 1))


class Chain:
    """Sequences one after another in arrays, walked step by step with all sequences that long side by side."""

    def __init__(self, starts: np.ndarray):
        size = np.diff(starts)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        self.first, self.size = starts[:-1][order], size[order]
        rising = -self.size
        # Items at step t of the sequences longer than t.
        self.steps = [self.first[:int(np.searchsorted(rising, -t, side="left"))] + t for t in range(int(size.max(initial=0)))]

    def best(self, scores: np.ndarray, change: np.ndarray, opening: np.ndarray) -> np.ndarray:
        """Viterbi: the labels of greatest total score (ties: the smaller label)."""
        n, labels = scores.shape
        came = np.zeros((n, labels), dtype=np.int8)
        value = np.zeros((n, labels))
        for t, at in enumerate(self.steps):
            if t == 0:
                value[at] = scores[at] + opening
                continue
            ways = value[at - 1][:, :, None] + change
            came[at] = ways.argmax(axis=1)
            value[at] = ways.max(axis=1) + scores[at]
        out = np.zeros(n, dtype=np.int8)
        final = self.first + self.size - 1
        out[final] = value[final].argmax(axis=1) if len(final) else 0
        for at in reversed(self.steps[1:]):
            out[at - 1] = came[at, out[at]]
        return out

    def expected(self, scores: np.ndarray, change: np.ndarray, opening: np.ndarray):
        """Forward-backward: each item's label probabilities, and the expected label changes of all sequences."""
        n, labels = scores.shape
        ahead, scale = np.zeros((n, labels)), np.ones(n)
        local = np.exp(scores - scores.max(axis=1, keepdims=True))
        step = np.exp(change)
        for t, at in enumerate(self.steps):
            x = local[at] * (np.exp(opening) if t == 0 else ahead[at - 1] @ step)
            scale[at] = x.sum(axis=1)
            ahead[at] = x / scale[at, None]
        back = np.ones((n, labels))
        changes = np.zeros((labels, labels))
        for at in reversed(self.steps[1:]):
            x = local[at] * back[at] / scale[at, None]
            changes += (ahead[at - 1].T @ x) * step
            back[at - 1] = x @ step.T
        return ahead * back, changes


def fit(texts: list[str], quality: list[int]) -> dict[str, np.ndarray]:
    """Weights from texts and their labels (1 good, 0 bad). Without examples of both, every line is content."""
    model = {"bins": np.zeros((SIZE, 2)), "change": np.zeros((2, 2)), "opening": np.zeros(2)}
    good = np.asarray(quality, dtype=bool)
    if good.all() or not good.any():
        model["bins"][:WIDTH["words"], CONTENT] = 1.0
        return model
    _, bins, _, starts = measure(pa.array(texts, pa.large_string()))
    chain = Chain(starts)
    alone = Chain(np.arange(len(bins) + 1))
    bad_line = np.repeat(~good, np.diff(starts))
    first = _climb(bins, alone, bad_line.astype(np.int8), LINE_STEPS, with_changes=False)
    label = bad_line & (_scores(bins, first) @ np.array([-1.0, 1.0]) > 0)
    return _climb(bins, chain, label.astype(np.int8), STEPS, with_changes=True)


def _scores(bins: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    out = np.zeros((len(bins), 2))
    for k in range(bins.shape[1]):
        out += model["bins"][bins[:, k]]
    return out


def _climb(bins: np.ndarray, chain: Chain, label: np.ndarray, steps: int, with_changes: bool) -> dict[str, np.ndarray]:
    """Gradient steps (with moments) on the likelihood of the labels, less a quadratic penalty."""
    lines = np.arange(len(bins))
    given = np.zeros((len(bins), 2))
    given[lines, label] = 1
    later = np.concatenate([np.zeros(0, dtype=np.int64), *chain.steps[1:]])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[later - 1], label[later]), 1)
    model = {"bins": np.zeros((SIZE, 2)), "change": np.zeros((2, 2)), "opening": np.zeros(2)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    for step in range(1, steps + 1):
        share, changes = chain.expected(_scores(bins, model), model["change"], model["opening"])
        miss = given - share
        grad = {"bins": np.stack([sum(np.bincount(bins[:, k], weights=miss[:, y], minlength=SIZE) for k in range(bins.shape[1]))
                                  for y in (0, 1)], axis=1),
                "change": (seen - changes) if with_changes else np.zeros((2, 2)),
                "opening": miss[chain.first].sum(axis=0) if with_changes else np.zeros(2)}
        for k, g in grad.items():
            g = g / max(len(bins), 1) - PENALTY * model[k]
            m, v = moments[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            model[k] += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return model


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> dict[str, np.ndarray]:
    """Fit on a bounded sample: per class the ``SAMPLE_PER_CLASS`` labelled ids of smallest hash, each with its smallest
    text of at most ``SAMPLE_CHARS`` characters. Null ids, labels and texts are left out; an id with several labels
    counts as the largest."""
    lab = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y")))
    picked = None
    for y in (0, 1):
        part = lab.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_PER_CLASS)
        picked = part if picked is None else picked.unionByName(part)
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(
        F.col("_text").isNotNull() & (F.length("_text") <= SAMPLE_CHARS))
    # The id list has at most 2 * SAMPLE_PER_CLASS rows, a bounded broadcast, and so has the result.
    rows = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).collect()
    rows.sort(key=lambda r: r._id)
    return fit([r._text for r in rows], [r._y for r in rows])


def judge(documents: DataFrame, model: dict[str, np.ndarray], keep_share: float = KEEP_SHARE,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words, base_failed, content_share, labels, kept``,
    one row per input row.

    ``labels``: of each line with a word, in order, 0 content or 1 boilerplate; ``content_share``: of the words, those in
    content lines (0 without words). A null text is an empty one; texts without words fail the base rules. Texts of any
    length are read whole, and equal texts get equal results."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    names = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            base, bins, words, starts = measure(b.column(1))
            label = Chain(starts).best(_scores(bins, model), model["change"], model["opening"])
            content = np.concatenate([[0], np.cumsum(words * (label == CONTENT))])[starts]
            share = np.diff(content) / np.maximum(base["n_words"], 1)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(base[k], pa.int64()) for k in names), pa.array(failed), pa.array(share),
                 pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(label, pa.int8())), pa.array(~failed & (share >= keep_share))],
                names=[id_col, *names, "base_failed", "content_share", "labels", "kept"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, " + ", ".join(f"{k} long" for k in names)
                           + ", base_failed boolean, content_share double, labels array<tinyint>, kept boolean")


@register("op13_quality_rules")
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, model).select("doc_id", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words",
                                     "base_failed", "kept", "content_share")
