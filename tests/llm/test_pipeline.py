"""The pipeline's stages: columns, what they drop, and what they keep."""

from collections import Counter

import corpus_pipeline as C
from helpers import awkward, documents, words_of
from test_text_operators import near_groups, plain_components, plain_dedup, plain_targets
from test_token_operators import PATH, check_packing

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return documents(spark, rows).select(*C.COLUMNS, "host")


def test_stage_names_and_columns(spark):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in C.STAGES[:-1]:
        assert step(spark, docs, SF).columns == docs.columns
    assert C.ORACLE_SQL is None


def test_toxic_documents_go_and_clean_ones_stay(spark):
    import riskweave.llm.toxicity as X
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r.score for r in X.score_texts(docs, X.train(docs, labels)).collect()}
    kept = {r.doc_id: r.text for r in C.drop_toxic(spark, docs, SF).collect()}
    assert set(kept) == {d for d, s in scored.items() if s < 0.3}
    assert all(r.text == kept[r.doc_id] for r in docs.collect() if r.doc_id in kept)


def test_lines_and_near_duplicates(spark):
    rows = awkward() + [(1000 + d, *r) for d, *r in near_groups()]
    got = C.drop_repeated_lines(spark, docs_of(spark, rows), SF).collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == Counter((d, t, len(t)) for d, t, _, _ in plain_dedup(rows))
    got = C.drop_near_duplicates(spark, docs_of(spark, rows), SF).collect()
    want = {d for d, _, c in plain_components(rows) if d is None or d == c}
    assert Counter(r.doc_id for r in got) == Counter(want)


def test_mix_repeats_and_cuts(spark):
    rows = awkward()
    got = C.mix_sources(spark, docs_of(spark, rows), SF).collect()
    sizes, text = Counter(), {d: t for d, t, _, _ in rows}
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t))
    taken = Counter()
    for r in got:
        taken[r.source] += len(words_of(r.text))
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert {s: taken[s] for s in sizes} == {s: int(t + 0.5) for s, t in plain_targets(sizes).items()}


def test_run_equals_its_stages(spark):
    got = C.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in C.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, SF).collect(), docs.schema)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    check_packing(rows, got, lambda x: t.encode(x or "", add_special_tokens=False).ids)
