"""Token ids of whole texts with a public tokenizer, fast for corpora whose words repeat."""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the split pattern of the public word-level BPE file; it never matches white space, and the
# file's normaliser works character by character, so a text's ids are those of its words, one after another.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# What a Python worker remembers at once: words as they stand, and the stems and other parts they are made of.
MAX_WORDS, MAX_PARTS = 250_000, 900_000
PIECE_BYTES = 4_000_000  # text that is split into words at once
_CLOSERS = "\"')]}»”’*"
_SENTENCE = frozenset(".!?…")


def words_stand_alone(config: dict) -> bool:
    """Whether encoding word by word provably equals encoding the whole text."""
    norm = config.get("normalizer") or {}
    parts = norm.get("normalizers", [norm] if norm else [])
    for p in parts:
        if p["type"] not in ("NFC", "Lowercase") and not (
                p["type"] == "Replace" and p["pattern"] == {"Regex": r"\s+"} and p["content"] == " "):
            return False
    pre = config.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return (first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD_PATTERN}
            and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or " " in t["content"]
                        for t in config.get("added_tokens", [])))


# Lower-cased lines: a stem of Latin letters with any punctuation behind, or anything else. The split pattern cuts
# exactly between stem and punctuation, and lower-casing these letters one by one is what the normaliser does.
_LINES = re.compile("^(?:([a-zß-öø-ÿā-\u012f\u0131-\u024f]+)([.,;:!?]*)|.*)$", re.MULTILINE)
_JOINED = 2000  # stems that are encoded in one call


class _Index(dict):
    """key -> number; new keys are noted in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


def worker_encoder(path: str) -> TextEncoder:
    """The encoder for a tokenizer file that this Python worker keeps from task to task: the words it has learnt
    (a bounded number) need not be looked up again."""
    kept = sys.modules.setdefault("_riskweave_worker", types.ModuleType("_riskweave_worker")).__dict__
    if path not in kept:
        kept[path] = TextEncoder(path)
    return kept[path]


class TextEncoder:
    """``encode`` gives, for each text, its ids and the positions (numbers of ids before them) where a
    sentence ends. Null counts as empty. Each distinct word, and each distinct lower-case stem of words, is
    looked up once while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_word = words_stand_alone(config)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        vocab = config.pop("model")["vocab"] if self.by_word else {}
        self.last = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)  # ids that end a part of a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # Lower-case letters need no normaliser, and between blanks no pattern.
        self.stems = Tokenizer(self.tokenizer.model)
        self.stems.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._clear()

    def forget(self):
        """Give back the memory of all words and parts met so far."""
        self._clear()

    def _clear_words(self):
        self.words = _Index()
        self.first = np.zeros(0, dtype=np.int32)  # of each word: the part it starts with, the one behind
        self.second = np.zeros(0, dtype=np.int32)
        self.ends = np.zeros(0, dtype=bool)

    def _clear(self):
        self._clear_words()
        self.parts = _Index()
        self.parts[""] = 0
        self.starts, self.lens = np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int32)  # of each part in flat
        self.flat = np.zeros(0, dtype=np.uint32)

    def encode(self, texts: pa.Array | Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.large_string())
        column = column.cast(pa.large_string()).fill_null("")
        upto = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            done = int(upto[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, done + PIECE_BYTES, side="right")))
            yield from self._group(column.slice(at, stop - at), int(upto[stop - 1]) - done)
            at = stop

    def _group(self, column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.by_word:
            for e in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False):
                yield np.array(e.ids, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        elif size > PIECE_BYTES:  # one long text
            pieces = [self._words(pa.array([p], pa.large_string()))[0] for p in _cut(column[0].as_py())]
            base = np.cumsum([0, *[len(ids) for ids, _ in pieces]])
            yield (np.concatenate([ids for ids, _ in pieces]),
                   np.concatenate([ends + b for (_, ends), b in zip(pieces, base, strict=False)]))
        else:
            yield from self._words(column)

    def _words(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(self.parts) > MAX_PARTS:
            self._clear()
        elif len(self.words) > MAX_WORDS:
            self._clear_words()
        split = pc.ascii_split_whitespace(column)
        upto = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        upto = upto - upto[0]
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.words.__getitem__, distinct), dtype=np.int32, count=len(distinct))
        codes = number[words.indices.to_numpy()]
        self._learn()
        parts = np.empty(2 * len(codes), dtype=np.int32)
        parts[::2], parts[1::2] = self.first[codes], self.second[codes]
        lens = self.lens[parts]
        behind = np.cumsum(lens, dtype=np.int32)
        after = np.concatenate([[0], behind[1::2]])  # ids before each word, and all
        at = np.repeat(self.starts[parts] - (behind - lens), lens)
        at += np.arange(len(at), dtype=np.int32)
        ids = self.flat[at]
        ends = self.ends[codes]
        out = []
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            first = int(after[a])
            out.append((ids[first:int(after[b])], (after[a + 1:b + 1][ends[a:b]] - first).astype(np.int64)))
        return out

    def _learn(self):
        fresh, self.words.fresh = self.words.fresh, []
        if not fresh:
            return
        lines = "\n".join(fresh)
        if "\u0130" in lines:  # its lower case is two characters
            lines = "\n".join("" if "\u0130" in w else w for w in fresh)
        found = _LINES.findall(lines.lower())
        odd = [i for i, (stem, _) in enumerate(found) if not stem]
        first = np.fromiter(map(self.parts.__getitem__, [stem for stem, _ in found]), dtype=np.int32, count=len(found))
        second = np.fromiter(map(self.parts.__getitem__, [tail for _, tail in found]), dtype=np.int32, count=len(found))
        ends = np.fromiter((tail[-1:] in _SENTENCE for _, tail in found), dtype=bool, count=len(found))
        stems = [p for p in self.parts.fresh if p[0].isalpha()]
        new, self.parts.fresh = [*stems, *[p for p in self.parts.fresh if not p[0].isalpha()]], []
        known = len(self.parts)
        for i in odd:  # encoded as they are, and not shared with stems
            w = fresh[i]
            if w + "\n" not in self.parts:
                dict.__setitem__(self.parts, w + "\n", len(self.parts))
                new.append(w)
            first[i], second[i] = self.parts[w + "\n"], 0
            ends[i] = w.rstrip(_CLOSERS)[-1:] in _SENTENCE
        self.first, self.second = np.concatenate([self.first, first]), np.concatenate([self.second, second])
        self.ends = np.concatenate([self.ends, ends])
        ids = [np.array(e.ids, dtype=np.uint32) for e in self.stems.encode_batch_fast(
            [" ".join(stems[i:i + _JOINED]) for i in range(0, len(stems), _JOINED)], add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
        stops = np.flatnonzero(self.last[flat]) + 1
        if len(stops) != len(stems) or (len(flat) and stops[-1] != len(flat)):
            raise ValueError("the tokenizer does not mark the ends of words")
        rest = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(new[len(stems):], add_special_tokens=False)]
        lens = np.concatenate([np.diff(stops, prepend=0), np.fromiter(map(len, rest), dtype=np.int32, count=len(rest))]).astype(np.int32)
        starts = len(self.flat) + np.cumsum(lens, dtype=np.int32) - lens
        # Part numbers were given in order of appearance; the new ones are in order of ``new``.
        size = len(self.parts)
        at = np.array([self.parts[p] for p in new[:len(new) - size + known]] + list(range(known, size)), dtype=np.int32)
        self.starts, self.lens = np.resize(self.starts, size), np.resize(self.lens, size)
        self.starts[at], self.lens[at] = starts, lens
        self.flat = np.concatenate([self.flat, flat, *rest])


def _cut(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE_BYTES characters, cut only at blanks."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        cut = max(text.rfind(c, at, at + PIECE_BYTES) for c in " \n")
        if cut <= at:
            later = [i for c in " \n" if (i := text.find(c, at + PIECE_BYTES)) >= 0]
            if not later:
                break
            cut = min(later)
        yield text[at:cut]
        at = cut
    yield text[at:]
