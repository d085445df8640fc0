"""Alignment, fill-in-the-middle and quality rules against plain versions, on awkward texts."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from helpers import awkward, documents, sentence, words_of
from tokenizers import Tokenizer

from riskweave.llm import alignment as A
from riskweave.llm import fill_middle as M
from riskweave.llm import quality_rules as Q
from riskweave.llm.common import flat_bytes
from riskweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIDES = ((A.ByteLevelSide, BYTE), (A.PieceSide, PIECE))
ODD = ["a <M> b\n", "<P", "x<\nS>y\n\n\nz", "\n\n\n", "no newline", "<S>", "tail <", "<|endoftext|> plain <0x41> <s> </s>", "▁ odd ▁▁",
       "  two  spaces \n", "é ﬁ ½ Ａ", "东京都の天気 \U0001f600\U0001f600", "\x00\x01 \x7f", "aaaa" * 300, "  x   y", "# * $ % & | < >",
       "a\r\n b;\r c\t\t d\t\n e", "x\u00a0 y\u2003 z\u3000\nw\u1680 v \x1c u\x1c\x1d t!\x1c!", "é è\nà \n ü\n\nñ  \n", " lead\n", "\nstart", "don't I'll  we've 12 345 !!! ..."]


def rows():
    out = awkward() + [(500 + i, t, "en", "s") for i, t in enumerate(ODD)]
    return out + [(3, "same id again\nsecond line", "en", "s"), (None, None, None, None), out[5], out[5]]


# ---- fill-in-the-middle -------------------------------------------------------------------------------------------

def plain_fill(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_fill_middle_matches_plain_version(spark, rate, spm):
    data = rows()
    got = M.restore_text(M.fill_middle(documents(spark, data), middle_rate=rate, spm_rate=spm)).collect()
    want = Counter((d, *plain_fill(d, t, rate, spm), t or "") for d, t, _, _ in data)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want


def test_fill_middle_cuts_at_every_line():
    text = "é\n\nß x\nlast"
    flat, starts = np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())])
    for i, j in itertools.product(range(5), repeat=2):
        units, form, p, m, moved, out = M.cut_and_move(flat, starts, np.array([[i, j, 0, 99]]), 100, 50)
        lines = ["é\n", "\n", "ß x\n", "last"]
        a, b = sorted((i, j))
        assert moved.tobytes().decode() == f"<P>{''.join(lines[:a])}<S>{''.join(lines[b:])}<M>{''.join(lines[a:b])}"
        assert (units[0], p[0], m[0]) == (4, len("".join(lines[:a])), len("".join(lines[a:b])))
        assert M.move_back(moved, out, form == 0)[0].tobytes().decode() == text


def test_fill_middle_of_nothing_and_bad_outputs(spark):
    assert M.restore_text(M.fill_middle(documents(spark, []))).count() == 0
    one = spark.createDataFrame([(None, None, 1), ("a", None, 2), (None, "psm", 3), ("", "plain", 4)], "output string, form string, restored int")
    assert [r.restored for r in M.restore_text(one).collect()] == [None, "a", None, ""]
    bad = spark.createDataFrame([("no markers", "psm")], "output string, form string")
    with pytest.raises(Exception, match="each marker once"):
        M.restore_text(bad).collect()


# ---- alignment ----------------------------------------------------------------------------------------------------

class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(BYTE)
        self.a.encode_special_tokens = True
        with open(BYTE, encoding="utf-8") as f:
            names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
        # The usual byte table: 188 characters stand for themselves, the rest count up from 256.
        keep = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
        byte = {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in keep)}
        self.name = {i: bytes(byte[c] for c in t) for i, t in names.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [self.name[i] for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                   for p in map(self.b.id_to_piece, b)]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return []
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        out = [([], []) for _ in cuts]
        for ids, ends, side in ((a, ends_a, 0), (b, ends_b, 1)):
            for i, e in zip(ids, ends, strict=True):
                out[next(k for k, c in enumerate(cuts) if e <= c)][side].append(i)
        return out


def short(data):
    return [(d, t[:3000] if t and len(t) > 3000 else t, la, s) for d, t, la, s in data]  # the plain version is quadratic


@pytest.mark.parametrize("piece", [A.PIECE_BYTES, 200])
def test_alignment_matches_plain_version(spark, monkeypatch, piece):
    monkeypatch.setattr(A, "PIECE_BYTES", piece)
    data = short(rows())
    plain = Plain()
    grouped = [plain.groups(t) for _, t, _, _ in data]
    assert sum(not g for g in grouped) < 12 and any(len(a) > 1 and len(b) > 1 for g in grouped for a, b in g)
    links = [Counter(p for a, b in g for p in itertools.product(a, b)) for g in grouped]
    count = Counter(p for x in links for p in x)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    want = Counter()
    for (d, *_), g, x in zip(data, grouped, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        want[(d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values()),
              sum(n for p, n in x.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in x.items()),
              hashlib.sha256(text.encode()).hexdigest() if g else "")] += 1
    got = A.link_scores(spark, A.align_documents(documents(spark, data), SIDES)).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want


def test_word_wise_tokens_are_those_of_whole_texts():
    sides = tuple(kind(path) for kind, path in SIDES)
    assert all(s.by_word for s in sides)
    aligner = A.Aligner(*sides)
    texts = [" " + t for _, t, _, _ in short(rows()) if t]
    flat, starts = flat_bytes(pa.array(texts))
    assert len(A.word_starts(flat, starts)) > 5 * len(texts)
    (a, b), counts = aligner.tokens(flat, starts)
    for side, ids, n in zip(sides, (a, b), counts, strict=True):
        for text, upto, k in zip(texts, np.cumsum(n), n, strict=True):
            assert k == 0 and "▁" in text or ids[upto - k:upto].tolist() == side.encode([text])[0]


def test_alignment_of_long_text_and_nothing(spark):
    rng = random.Random(1)
    text = sentence(rng, 60_000)
    got = {r.id: r for r in A.align_documents(documents(spark, [(1, text, "", ""), (2, "x", "", "")]), SIDES, with_groups=True).collect()}
    a = Tokenizer.from_file(BYTE).encode(" " + text, add_special_tokens=False).ids
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(text)
    parts = [g.split("|") for g in got[1].groups.split(";")]
    assert [int(i) for p in parts for i in p[0].split(",")] == a and [int(i) for p in parts for i in p[1].split(",")] == b
    assert len(parts) == got[1].n_groups and got[1].groups_sha256 == hashlib.sha256(got[1].groups.encode()).hexdigest()
    empty = A.align_documents(documents(spark, [(1, None, "", ""), (2, "", "", "")]), SIDES)
    assert {(r.doc_id, r.n_links, r.count_sum, r.groups_sha256) for r in A.link_scores(spark, empty).collect()} == {(1, 0, 0, ""), (2, 0, 0, "")}
    assert A.link_scores(spark, A.align_documents(documents(spark, []), SIDES)).count() == 0


def test_pair_counts_and_best(spark):
    docs = documents(spark, [(1, "the cat", "", ""), (2, "the dog", "", ""), (3, "the cat the cat", "", "")])
    from riskweave.sources.files import stage
    counts = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in A.pair_counts(stage(spark, A.align_documents(docs, SIDES), "t")).collect()}
    a = Tokenizer.from_file(BYTE).encode(" the", add_special_tokens=False).ids
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE).encode("the")
    assert counts[(a[0], b[0])] == (3, True)


# ---- quality rules ------------------------------------------------------------------------------------------------

def plain_base(text):
    text = text or ""
    words = words_of(text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i, t in enumerate(zip(words, words[1:], words[2:], strict=False)) if triples[t] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(words), failed)


def test_base_numbers_match_plain_version(spark):
    data = rows() + [(700, "a b c a b c d", "", ""), (701, "a a a a", "", ""), (702, "x y\nx y\n\n\nx y \nx y", "", ""), (703, "a b", "", "")]
    got = Q.judge(documents(spark, data), Q.fit([], [])).collect()
    want = Counter((d, *plain_base(t)) for d, t, _, _ in data)
    assert Counter((r.doc_id, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_words, r.base_failed) for r in got) == want
    text = {d: t for d, t, _, _ in data if d is not None and d != 3}
    for r in got:
        assert r.kept == (not r.base_failed)  # a model without bad examples finds content only
        if r.doc_id in text:
            assert len(r.labels) == sum(bool(words_of(x)) for x in (text[r.doc_id] or "").split("\n"))
    assert Q.judge(documents(spark, []), Q.fit([], [])).count() == 0


def test_line_numbers(spark):
    _, bins, words, starts = Q.measure(pa.array(["One TWO.\n\nab cd\n### x", "", "ab cd\nab cd"]))
    assert words.tolist() == [2, 2, 2, 2, 2] and starts.tolist() == [0, 3, 3, 5]

    def column(name):
        k = list(Q.BINS).index(name)
        return (bins[:, k] - Q.FIRST[name]).tolist()

    assert column("words") == [1] * 5
    assert column("ends") == [1, 0, 0, 0, 0]
    assert column("line_again") == [0, 0, 0, 1, 1]
    assert column("symbol_words") == [0, 0, 4, 0, 0]
    assert column("upper") == [5, 0, 0, 0, 0]  # 4 of 6 letters


def brute_chain(scores, change, opening):
    """Best labels, label probabilities and expected changes, by all label sequences."""
    n = len(scores)
    ways = list(itertools.product(range(2), repeat=n))
    total = np.array([opening[w[0]] + sum(scores[i, y] for i, y in enumerate(w)) + sum(change[a, b] for a, b in zip(w, w[1:], strict=False)) for w in ways])
    p = np.exp(total - total.max())
    p /= p.sum()
    share, changes = np.zeros((n, 2)), np.zeros((2, 2))
    for w, q in zip(ways, p, strict=True):
        for i, y in enumerate(w):
            share[i, y] += q
        for a, b in zip(w, w[1:], strict=False):
            changes[a, b] += q
    return ways[int(total.argmax())], share, changes


def test_viterbi_and_forward_backward_match_all_sequences():
    rng = np.random.default_rng(3)
    sizes = [4, 0, 1, 7, 2, 0, 7]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    scores, change, opening = rng.normal(size=(starts[-1], 2)) * 2, rng.normal(size=(2, 2)), rng.normal(size=2)
    chain = Q.Chain(starts)
    best = chain.best(scores, change, opening)
    share, changes = chain.expected(scores, change, opening)
    total = np.zeros((2, 2))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if a < b:
            way, own, moved = brute_chain(scores[a:b], change, opening)
            assert tuple(best[a:b]) == way and np.allclose(share[a:b], own)
            total += moved
    assert np.allclose(changes, total)
    assert Q.Chain(np.array([0])).best(np.zeros((0, 2)), change, opening).tolist() == []


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(5)
    starts = np.array([0, 3, 5])
    chain, label = Q.Chain(starts), np.array([0, 1, 1, 0, 0])
    scores, change, opening = rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)

    def value(s):
        out = 0.0
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            ways = [opening[w[0]] + sum(s[a + i, y] for i, y in enumerate(w)) + sum(change[x, y] for x, y in zip(w, w[1:], strict=False))
                    for w in itertools.product(range(2), repeat=b - a)]
            given = tuple(label[a:b])
            own = opening[given[0]] + sum(s[a + i, y] for i, y in enumerate(given)) + sum(change[x, y] for x, y in zip(given, given[1:], strict=False))
            out += own - np.log(np.exp(ways).sum())
        return out

    share, _ = chain.expected(scores, change, opening)
    for i, y in itertools.product(range(5), range(2)):
        step = scores.copy()
        step[i, y] += 1e-5
        assert (value(step) - value(scores)) / 1e-5 == pytest.approx(float(label[i] == y) - share[i, y], abs=1e-3)


def test_quality_on_documents_not_trained_on(spark):
    larger = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels.where("doc_id % 2 = 0"))
    quality = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    got = [r for r in Q.judge(docs, model).collect() if r.doc_id in quality and not r.base_failed]
    tell = Counter((quality[r.doc_id], r.kept) for r in got)
    assert tell[1, True] >= 0.98 * (tell[1, True] + tell[1, False])
    assert tell[0, False] >= 0.85 * (tell[0, True] + tell[0, False])


def test_mixed_texts_are_marked_line_by_line(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels)
    good = [r.text for r in docs.join(labels, "doc_id").where("quality = 1 and toxic = 0 and lang = 'en' and length(text) < 4000").limit(3).collect()]
    junk = "\n".join(f"### $$$ word{i}*** other{i}%%% &&&" for i in range(4))
    text = good[0] + "\n" + junk + "\n" + good[1]
    n = [sum(bool(words_of(x)) for x in t.split("\n")) for t in (good[0], junk, good[1])]
    [row] = Q.judge(documents(spark, [(1, text, "", "")]), model).collect()
    assert sum(row.labels[n[0]:n[0] + n[1]]) == n[1] and sum(row.labels) <= n[1] + 1
    assert row.kept


def test_training_with_repeated_and_null_ids(spark):
    data = [(1, "good words here.", "", ""), (1, "another text of it.", "", ""), (None, "x", "", ""), (2, "### $$$", "", ""), (4, None, "", "")] * 3
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 0), (4, 1), (5, None)], "doc_id long, quality int")
    model = Q.train(documents(spark, data), labels)
    assert all(np.isfinite(v).all() for v in model.values())


def test_queries_cover_the_tables(spark):
    import __spark_entry__ as entry
    entry.queries()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert QUERIES["op11_alignment"](spark, SF).count() == n
    got = QUERIES["op13_quality_rules"](spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == n
    for r in got:
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_words, r.base_failed) == plain_base(text[r.doc_id])
        assert not (r.base_failed and r.kept)
