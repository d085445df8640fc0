"""Jaccard join: links between texts of unequal length, against all pairs."""

import random
from collections import Counter

import pytest
from helpers import documents, sentence
from test_text_operators import plain_components

from riskweave.llm import jaccard_join as J


def found(spark, rows, parts=3):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(documents(spark, rows).repartition(parts)).collect())


def appended_pairs(seed):
    """Groups of two: a text and the same with up to a quarter more shingles of its own behind, before or around it."""
    rng, rows = random.Random(seed), []
    for i in range(160):
        n = rng.choice([20, 50, 100, 100, 100, 300])
        words, more = sentence(rng, n + 4).split(), [f"o{i}x{j}" for j in range(n // 4 - rng.choice([0, 0, 0, 1, 2]))]
        cut = rng.choice([0, len(more), rng.randint(0, len(more))])
        rows += [(2 * i, " ".join(words), "en", "s"), (2 * i + 1, " ".join(more[:cut] + words + more[cut:]), "en", "s")]
    return rows


@pytest.mark.parametrize("most_common", [0, 400_000])
def test_texts_with_appended_words_stay_linked(spark, monkeypatch, most_common):
    monkeypatch.setattr(J, "MOST_COMMON", most_common)
    rows = appended_pairs(1)
    want = Counter(plain_components(rows))
    assert sum(c == 2 for c in Counter(k[2] for k in want).values()) > 100  # most are linked
    assert found(spark, rows) == want


def test_smallest_sets_with_links(spark):
    """Four shingles in a set of five are a link; three in a set of four are none."""
    rng, rows = random.Random(4), []
    for n in (5, 6, 7, 8, 9, 10):
        words = sentence(rng, n).split()
        for text in (words, words + ["end"], ["start"] + words):
            rows.append((len(rows), " ".join(text), "en", "s"))
    got = found(spark, rows)
    assert got == Counter(plain_components(rows))
    eight = {(9, 4, 9), (10, 5, 9), (11, 5, 9)}
    assert eight <= set(got)


@pytest.mark.parametrize("most_common, chunk", [(400_000, 1 << 20), (50, 400), (0, 3000)])
def test_copies_about_as_far_from_their_origin_as_a_link_allows(spark, monkeypatch, most_common, chunk):
    """Copies, copies of copies, cut and lengthened ones, most of them near the similarity of 0.8, and texts that only
    share a passage: links that the bounds must not lose and pairs that they may leave out."""
    monkeypatch.setattr(J, "MOST_COMMON", most_common)
    monkeypatch.setattr(J, "CHUNK", chunk)
    rng, texts = random.Random(11), []
    for _ in range(4):
        made = [sentence(rng, rng.choice([40, 90, 150])).split()]
        passage = made[0][:30]
        for k in range(45):
            words = list(rng.choice(made[:8]))
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"new{len(texts)}x{rng.randrange(10 ** 6)}"
            cut = rng.choice([0, 0, rng.randint(0, len(words) // 6)])
            words = words[cut:] + [f"tail{k}x{i}" for i in range(rng.choice([0, 0, 0, len(words) // 8]))]
            made.append(words)
        texts += [" ".join(w) for w in made] + [" ".join(passage + sentence(rng, rng.randint(5, 60)).split()) for _ in range(15)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    want = Counter(plain_components(rows))
    assert 20 < len({k[2] for k in want}) < len(rows) - 60
    assert found(spark, rows, 5) == want


def test_a_fragment_without_shared_shingles_has_no_rows():
    import numpy as np

    none = np.zeros(0, np.uint64)
    [batch] = J._chunk_postings([b"a" * 16, b"b" * 16], [9, 9], [np.arange(9, dtype=np.uint64), np.arange(9, 18, dtype=np.uint64)], none, 1)
    assert J._shared_parts(none, none, 3)(J.pa.Table.from_batches([batch])).num_rows == 0


def test_only_sets_of_the_asked_classes_are_let_through(spark):
    """A round verifies few pairs: the sets of all other classes stay where they are read, and no asked one is lost."""
    import hashlib

    keys = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    sets = spark.createDataFrame([(k, cut, b"", 9) for k in keys for cut in range(2)], "c binary, cut int, part binary, n long")
    asked = spark.createDataFrame([(k,) for k in keys[:40]], "c binary")
    got = Counter(bytes(r.c) for r in J._let_through(sets, asked).collect())
    assert all(got[k] == 2 for k in keys[:40])
    assert len(got) < 50
    assert J._let_through(sets, asked.where("false")).count() == 0


def test_numbers_of_postings_by_place_of_their_bytes():
    """Small numbers, as set sizes and places are, compress to less than as plain 32-bit ones; all come back."""
    import numpy as np

    rng = np.random.default_rng(3)
    few = rng.integers(0, 60_000, 5000).astype(np.uint32)
    for numbers in (few, np.array([0, 1, 255, 256, (1 << 32) - 1], np.uint32), np.zeros(0, np.uint32)):
        assert (J._from_planes(J._planes(numbers)) == numbers).all()
    size = [len(J.pa.Codec("lz4_raw").compress(raw)) for raw in (J._planes(few), few.tobytes())]
    assert size[0] < 0.8 * size[1]
