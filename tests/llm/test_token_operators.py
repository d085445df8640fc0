"""Token files and packing: exact round trips against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, documents
from tokenizers import Tokenizer

from riskweave.llm import packing as P
from riskweave.llm import token_files as T
from riskweave.llm import tokens as K

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["ä ̈b", "x\x1cy\x85z don't I'll 12% <|endoftext|> foo<|startoftext|>bar", "Σας ΣΑΣ. İ ŉ ǅ ẞ.", "  lead", "a" * 5000, "it's. don't!? \"Quoted.\" .,; ,x", "क़ e\u0301 Ａ"]


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizer(ids_of, monkeypatch):
    texts = [r[1] for r in awkward()] + ODD
    for piece in (K.PIECE_BYTES, 300):
        monkeypatch.setattr(K, "PIECE_BYTES", piece)
        for path in (PATH, public_tokenizers.path("byte_bpe_50k.json")):
            encoder, t = K.TextEncoder(path), Tokenizer.from_file(path)
            assert encoder.by_word == (path == PATH)
            for text, (ids, ends) in zip(texts, encoder.encode(texts), strict=True):
                assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids
                assert (np.diff(ends) >= 0).all() and (not len(ends) or 0 <= ends[0] and ends[-1] <= len(ids))


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 20, 31, 32])
def test_bit_packing_round_trip(bits):
    for n in (0, 1, 5, 63, 64, 65, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = T.pack_ids(ids, bits)
        assert len(data) == (n * bits + 7) // 8
        assert (T.unpack_ids(data, bits, n) == ids).all()
    with pytest.raises(ValueError):
        T.pack_ids(np.array([1 << bits], dtype=np.uint64), bits)


def test_shard_random_access():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 49408, n, dtype=np.uint32) for n in (3, 0, 5000, 1, 9000)]
    s = T.Shard(T.write_shard([None, 4, 4, 7, 9], docs, 16, block_ids=1000))
    every = np.concatenate(docs)
    assert s.doc_ids == [None, 4, 4, 7, 9] and s.starts.tolist() == np.cumsum([0, 3, 0, 5000, 1, 9000]).tolist()
    for a, b in [(0, 0), (0, 14004), (999, 1001), (5003, 5004), (14003, 14004)]:
        assert (s.ids(a, b) == every[a:b]).all()


@pytest.mark.parametrize("shard_ids", [T.SHARD_IDS, 50])
def test_token_files_round_trip(spark, tmp_path, ids_of, monkeypatch, shard_ids):
    monkeypatch.setattr(T, "SHARD_IDS", shard_ids)
    rows = awkward() + [(500 + i, t, "en", "s") for i, t in enumerate(ODD)] + [(3, "same id again", "en", "s")]
    path = str(tmp_path / "files")
    T.write_token_files(documents(spark, rows), path, PATH, end_id=2)
    got = sorted(T.read_token_files(spark, path).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    assert len(got) == len(want)
    at = 0
    by_id = defaultdict(list)
    for d, text, _, _ in rows:
        by_id[d].append(ids_of(text) + [2])
    for r, w in zip(got, want, strict=True):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.doc_id == w[0] and r.start == at and r.n_tokens == len(ids)
        by_id[r.doc_id].remove(ids)
        at += len(ids)


def test_token_files_of_nothing(spark, tmp_path):
    T.write_token_files(documents(spark, []), str(tmp_path / "none"), PATH, end_id=2)
    assert T.read_token_files(spark, str(tmp_path / "none")).count() == 0


def check_packing(rows, got, ids_of, length=2048):
    whole = defaultdict(list)
    for r in got:
        whole[r.doc_id].append(r)
    want = defaultdict(list)
    for d, text, _, _ in rows:
        want[d].append(ids_of(text) + [1])
    for d, docs in want.items():
        total = sorted(i for ids in docs for i in ids)
        assert total == sorted(i for r in whole[d] for i in np.frombuffer(r.ids, "<u4").tolist())
        if len(docs) == 1:
            at = 0
            for r in sorted(whole[d], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(docs[0])
                assert np.frombuffer(r.ids, "<u4").tolist() == docs[0][at:at + r.length]
                at += r.length
            assert at == len(docs[0])
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    pad = used = 0
    for pieces in windows.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= length
        pad, used = pad + P.padding(at, length), used + at
    return pad / max(used, 1)


@pytest.mark.parametrize("stream", [P.STREAM_IDS, 5000])
def test_packing_holds_every_id_once(spark, ids_of, monkeypatch, stream):
    monkeypatch.setattr(P, "STREAM_IDS", stream)
    rows = awkward() + [(500 + i, t, "en", "s") for i, t in enumerate(ODD)] + [(3, "same id again", "en", "s")]
    got = P.pack(documents(spark, rows).repartition(2), PATH, 1).collect()
    assert check_packing(rows, got, ids_of) < 0.05


def test_packing_of_nothing(spark):
    assert P.pack(documents(spark, []), PATH, 1).count() == 0


def test_best_cuts_are_optimal():
    rng = random.Random(0)
    for trial in range(60):
        length = 64
        docs = np.cumsum([rng.randint(1, 90) for _ in range(rng.randint(1, 6))])
        sentences = np.unique([rng.randint(1, int(docs[-1])) for _ in range(rng.randint(0, 9))]).astype(np.int64)
        at, cost = P.candidates(docs, sentences, stride=rng.choice([3, 8, 24]))
        pos, pen = at.tolist(), cost.tolist()
        best = [0] + [10**9] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                n = pos[j] - pos[i]
                if n <= length:
                    fill = 0 if n in (8, 16, 32, 64) else length - n
                    best[j] = min(best[j], best[i] + fill + pen[j])
        cuts = P.best_cuts(at, cost, length)
        index = {p: i for i, p in enumerate(pos)}
        found = sum((0 if b - a in (8, 16, 32, 64) else length - b + a) + pen[index[b]] for a, b in zip(cuts, cuts[1:], strict=False))
        assert cuts[0] == 0 and cuts[-1] == pos[-1] and found == best[-1], trial


def test_tail_is_cut_only_where_that_saves_padding():
    assert P.tail_cuts(10, 10 + 2040) == [2050]
    assert P.tail_cuts(0, 1500) == [1024, 1280, 1408, 1472, 1488, 1496, 1500]


def test_crc_is_of_little_endian_ids(spark, ids_of):
    from pyspark.sql import functions as F
    r = P.pack(documents(spark, [(1, "hello", "en", "s")]), PATH, 1).select(F.crc32("ids").alias("x")).first()
    assert r.x == zlib.crc32(np.array([*ids_of("hello"), 1], dtype="<u4").tobytes())
