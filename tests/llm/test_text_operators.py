"""Mixing, line dedup, Jaccard join, URL filter: against plain versions on small awkward inputs."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, documents, sentence, words_of
from pyspark.sql import functions as F

from riskweave.llm import jaccard_join as J
from riskweave.llm import line_dedup as L
from riskweave.llm import mixing as M
from riskweave.llm import url_filter as U
from riskweave.llm.components import components
from riskweave.llm.shingles import Shingler

SPACE = " \t\n\x0b\x0c\r"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- mixing

def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else weight[s] * level
            left -= target[s] if over else 0
        open_ -= over or open_
    return target


def test_mix_matches_plain_version(spark):
    rows = awkward()
    got = M.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(words_of(text))
    target = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert {s: taken[s] for s in sizes} == {s: int(np.floor(t + 0.5)) for s, t in target.items()}
    assert Counter(r.size for r in got) == Counter(len(words_of(t)) for _, t, _, _ in rows)


def test_mix_is_stable_under_partitioning_and_epochs_repeat(spark):
    df = documents(spark, awkward())
    key = lambda d: sorted((str(r.doc_id), r.size, r.taken) for r in d.collect())
    assert key(M.mix(df.repartition(1))) == key(M.mix(df.repartition(13, "n_chars")))
    tiny = documents(spark, [(1, "a b c", "en", "x"), (2, "a " * 1000, "en", "y"), (2, "a " * 1000, "en", "y")])
    assert {(r.doc_id, r.taken) for r in M.mix(tiny).collect() if r.doc_id == 1} == {(1, 9)}


def test_mix_of_nothing(spark):
    assert M.mix(documents(spark, [])).count() == 0
    assert [r.taken for r in M.mix(documents(spark, [(1, None, None, None)])).collect()] == [0]


# ---- line dedup

def plain_dedup(rows):
    key = lambda x: x.strip(SPACE).translate(ASCII)
    rank = lambda d: (d is None, d or 0)
    holders = defaultdict(set)
    for d, text, _, _ in rows:
        for x in (text or "").split("\n"):
            holders[key(x)].add(rank(d))
    out = []
    for d, text, _, _ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == rank(d)]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


@pytest.mark.parametrize("keys,probes", [(1 << 14, 1 << 14), (3, 4)])
def test_line_dedup_matches_plain_version(spark, monkeypatch, keys, probes):
    monkeypatch.setattr(L, "KEYS_PER_SHARD", keys)
    monkeypatch.setattr(L, "PROBES_PER_TASK", probes)
    rows = awkward() + [(7, "The very common LINE of many documents", "en", "s"), (200, "äöüäöüäöü\nÄöüäöüäöüä", "en", "s"),
                        (201, "äöüäöüäöü\nÄöüäöüäöüä ", "en", "s"), (202, "own line twice\nown line twice", "en", "s")]
    got = [(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in L.line_dedup(documents(spark, rows), keep=("c",)).collect()]
    assert Counter(got) == Counter(plain_dedup(rows))
    assert any(g[3] for g in got)


def test_line_dedup_of_nothing(spark):
    assert L.line_dedup(documents(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_survives_bytes():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    h1[:100] = h1[0]  # only the second half tells these apart
    table = L.PerfectHash.from_bytes(L.PerfectHash.build(h1, h2).to_bytes())
    assert sorted(table.numbers(h1, h2).tolist()) == list(range(5000))
    other = table.numbers(h2, h1)
    assert other.min() >= -1 and other.max() < 5000


# ---- Jaccard join

def plain_sets(text):
    w = [x.translate(ASCII) for x in words_of(text)]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = [plain_sets(r[1]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def near_groups(seed=3):
    """Chains and stars of near copies, texts that share a passage only, and a group of copies."""
    import random
    rng = random.Random(seed)
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words), "en", "s"))
        n += 1

    passage = sentence(rng, 40).split()
    for _ in range(12):
        words = sentence(rng, rng.choice([9, 24, 60, 150])).split()
        for _ in range(rng.randint(1, 7)):  # a chain: each differs a little from the one before
            add(words)
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "x" + str(rng.randrange(1000))
    for _ in range(25):
        add(sentence(rng, rng.randint(0, 50)).split() + passage + sentence(rng, rng.randint(0, 50)).split())
    star = sentence(rng, 100).split()
    for i in range(60):
        add(star[:i] + ["y" + str(i)] + star[i + 1:])
    for _ in range(20):
        add(star)
    return rows


def test_jaccard_components_match_all_pairs(spark):
    rows = awkward() + [(1000 + d, *r) for d, *r in near_groups()] + [(5, "one two", "en", "s")]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(documents(spark, rows).repartition(5)).collect()]
    assert Counter(got) == Counter(plain_components(rows))


def test_jaccard_common_shingles_and_many_fragments(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 2000)
    monkeypatch.setattr(J, "FRAGMENT_SHINGLES", 200)
    rows = near_groups(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(documents(spark, rows).repartition(3)).collect()]
    assert Counter(got) == Counter(plain_components(rows))


def test_jaccard_of_nothing(spark):
    assert J.jaccard_components(documents(spark, [])).count() == 0


def test_shingles_equal_sets_of_words(monkeypatch):
    import riskweave.llm.shingles as S
    texts = [r[1] for r in awkward()] + [r[1] for r in near_groups()]
    s = Shingler()
    seen = {}
    for t in texts:
        assert len(s.sets(t)) == len(plain_sets(t))
        whole = s.sets(t)
        monkeypatch.setattr(S, "PIECE_WORDS", 50)
        assert (s.sets(t) == whole).all()
        monkeypatch.undo()
        for h in whole.tolist():
            seen[h] = seen.get(h, 0) + 1
    assert len(seen) == len(set().union(*[plain_sets(t) for t in texts]))


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 100 == 0, 0).otherwise(1)).alias("b"))
    got = {r.a: r.b for r in components(edges).collect()}
    assert got == {i: (i - 1) // 100 * 100 + 1 for i in range(1, 301) if (i - 1) % 100}


# ---- URL filter

URLS = ["http://A.Example.NET/en/x?q#f", "https://example.net/de/", "http://example.net", "http://net/", "http://xnet/a", "http://a.org/fr/",
        "http://a.org/fr", "//no.scheme/x", "", None, "http://example.com/de/y", "http://www.example.com?x=/de/", "ftp://u@h.net:80/p", "://x.net/z",
        "http://a.net/b://c", "http://" + "s." * 3000 + "net/" + "p/" * 3000, "http://a.net#/x", "http://a.net//en/"]


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[:min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host):]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = host.translate(ASCII)
    fits = [(len(r.text), len(r.host), r.verdict, r.text) for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("limit", [U.MAX_TRIE_CHARS, 0])
def test_url_filter_matches_plain_version(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "MAX_TRIE_CHARS", limit)
    rules = [*U.PAGE_RULES, U.Rule("block", "a.net", "/b"), U.Rule("allow", "a.net", "/b"), U.Rule("block", "org", "/f"), U.Rule("allow", "h.net:80", "/p")]
    urls = URLS[:-3] + URLS[-2:] if limit == 0 else URLS
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, "http://net/", "h", "p"), (1, urls[1], "h", "p")],
                                  "page_id long, url string, host string, path string")
    for given in (rules, spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")):
        got = U.url_filter(pages, given).collect()
        want = [(i, *plain_verdict(u, rules)) for i, u in enumerate(urls)] + [(None, *plain_verdict("http://net/", rules)), (1, *plain_verdict(urls[1], rules))]
        assert Counter(map(tuple, got)) == Counter(want)
    assert U.url_filter(pages.where("false"), rules).count() == 0


def test_line_digest_is_sha256_of_kept_text(spark):
    got = L.line_dedup(documents(spark, [(1, "ä b", "en", "s")])).select(F.sha2("kept_text", 256).alias("h")).first().h
    assert got == hashlib.sha256("ä b".encode()).hexdigest()
