"""I/O queries: CSV/JSON round trips, staged tables, partitioned sink, streaming tagging.

Each query writes under a fresh folder of the shared checkpoint root, reads it back, and
returns what it read, so the oracle can check the round trip is lossless.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators import lexicon as LX
from riskweave.operators import text as TX
from riskweave.plans import roles as R
from riskweave.plans import sqlfrag as S
from riskweave.plans.registry import register
from riskweave.session import checkpoint_dir
from riskweave.sources import files as IO
from riskweave.sources.tables import Tables
from riskweave.streaming.tagging import run_tagging_stream

DOC_CSV_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()),
                               T.StructField("text", T.StringType())])
CONV_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                            T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


@register("src_csv_roundtrip", "SELECT doc_id, source, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM documents")
def src_csv_roundtrip(spark, sf_dir):
    """S1 + K1 + K4: documents (commas, quotes, newlines inside) → CSV → read back losslessly."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "source", "text")
    path = IO.scratch_path(spark, "csv")
    IO.write_csv(d, path)
    back = IO.read_csv(spark, path, DOC_CSV_SCHEMA)
    return back.select("doc_id", "source", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@register("src_json_roundtrip", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def src_json_roundtrip(spark, sf_dir):
    """S2 + S3 + K2: conversations → JSON Lines in many files → one glob scan with a schema."""
    c = Tables(spark, sf_dir).conversations
    path = IO.scratch_path(spark, "json")
    IO.write_json(c.repartition(8, "conv_id"), path)
    back = IO.read_json(spark, os.path.join(path, "*.json"), CONV_SCHEMA)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@register("stage_reuse", S.with_ctes(["filings"]) + "SELECT doc_id, length(text)::BIGINT AS n_chars FROM filings")
def stage_reuse(spark, sf_dir):
    """Normalised filings staged once as Parquet and reused (build on first use)."""
    t = Tables(spark, sf_dir)
    root = IO.scratch_path(spark, "stages")
    first = IO.load_or_build(spark, root, "filings_norm", lambda: TX.normalize(R.filings(t)))
    again = IO.load_or_build(spark, root, "filings_norm", lambda: TX.normalize(R.filings(t)))
    assert first.schema == again.schema
    return again.select("doc_id", F.length("text").cast("long").alias("n_chars"))


@register("sink_partitioned", "SELECT source AS symbol, count(*)::BIGINT AS n_rows FROM documents GROUP BY source")
def sink_partitioned(spark, sf_dir):
    """K3: one output folder per company via ``partitionBy`` (no per-company loop)."""
    d = Tables(spark, sf_dir).documents.select("doc_id", F.col("source").alias("symbol"), "n_chars")
    path = IO.scratch_path(spark, "by_symbol")
    IO.write_partitioned(d, path, "symbol")
    return spark.read.parquet(path).groupBy("symbol").agg(F.count("*").cast("long").alias("n_rows"))


@register("stream_tagging", S.with_ctes(["tagged"]) + """
SELECT symbol, count(*)::BIGINT AS n_sentences, count_if(topic_ids <> [-1])::BIGINT AS n_tagged FROM tagged GROUP BY symbol""")
def stream_tagging(spark, sf_dir):
    """Streaming: file-source stream of filings tagged in micro-batches (availableNow); equals
    the batch result."""
    t = Tables(spark, sf_dir)
    checkpoint_dir(spark)
    lex = LX.trim(R.topic_lexicon(t, spark)).checkpoint()
    out = IO.scratch_path(spark, "stream_out")
    ck = IO.scratch_path(spark, "stream_ckpt")
    lemmas, stop = R.lemmas_df(spark), R.stopwords_df(spark)

    def to_sentences(batch):
        return TX.sentences(TX.normalize(R.as_filings(batch)), ["doc_id", "symbol", "filing_time"])

    run_tagging_stream(spark, os.path.join(sf_dir, "documents*.parquet"), out, ck, to_sentences, lex, stop, lemmas)
    res = spark.read.parquet(out)
    return res.groupBy("symbol").agg(F.count("*").cast("long").alias("n_sentences"),
                                     F.count_if(F.col("topic_ids") != F.array(F.lit(-1))).cast("long").alias("n_tagged"))


@register("vectors_text_roundtrip", f"""
SELECT CAST(vec_id AS VARCHAR) AS word, len(embedding)::BIGINT AS dim,
       {S.round6('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} AS checksum FROM embeddings""")
def vectors_text_roundtrip(spark, sf_dir):
    """Vectors written in the word-vector text layout and parsed back in one scan."""
    from riskweave.functions.misc import round6
    emb = Tables(spark, sf_dir).embeddings
    path = IO.scratch_path(spark, "vectors_txt")
    IO.write_vectors_text(emb, path, "vec_id", "embedding")
    back = IO.read_vectors_text(spark, path)
    total = F.aggregate(back["vector"], F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return back.select("word", F.size("vector").cast("long").alias("dim"), round6(total).alias("checksum"))
