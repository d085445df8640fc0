"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of ``documents``;
the last returns the pieces of documents in sequences. ``run`` writes what a stage returns to the shared folder and
reads it again, so that a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import WORD
from riskweave.llm.jaccard_join import jaccard_components
from riskweave.llm.line_dedup import line_dedup
from riskweave.llm.mixing import mix
from riskweave.llm.packing import pack
from riskweave.llm.toxicity import THRESHOLD, score_texts, train
from riskweave.sources.files import stage
from riskweave.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
END_ID = 1


def _documents(rows: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with ``text`` as their text and ``n_chars`` its length."""
    return rows.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, rejects go; all others stay as they are."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score_texts(docs.select(*COLUMNS), model).where(F.col("score") < THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that a document of smaller id has too."""
    return _documents(line_dedup(docs, keep=("lang", "source")), "kept_text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id stays; documents that link with nothing stay, and so
    do documents without an id, which could not be told apart. Rows of equal id are one document."""
    found = jaccard_components(docs)
    keep = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    whole = docs.select(*COLUMNS)
    return whole.where(F.col("doc_id").isNotNull()).join(keep, "doc_id", "left_semi").unionByName(whole.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole, and the one that a source's budget ends in up to that word."""
    mixed = mix(docs, keep=("text", "lang")).where(F.col("taken") > 0)
    rest = F.col("taken") % F.col("size")
    parts = F.concat(F.array_repeat("size", F.floor(F.col("taken") / F.col("size")).cast("int")),
                     F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    copies = mixed.withColumn("words", F.explode(parts))
    with_blanks = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    begin = F.array_join(F.slice(with_blanks, 1, F.col("words").cast("int")), "")
    return _documents(copies.withColumn("mixed_text", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(begin)), "mixed_text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' ids in sequences of at most 2048, one row per piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, keep_words=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# No SQL: a trained classifier and the tokenizer are not expressible; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(spark, step(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
