"""Text operators: each is a DataFrame → DataFrame job over a document table.

Long tables instead of nested lists: one row per sentence / paragraph / token, keyed by the
document key plus a position, so every later step is a plain join or aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave import constants as C
from riskweave.functions import text as FT


def normalize(df: DataFrame, text_col: str = "text", out_col: str = "text") -> DataFrame:
    """NFKD→ASCII, remove e-mails and URLs, keep letters/digits/whitespace/punctuation."""
    # Whole texts go to Python: a worker's memory is that of a batch, so batches are bounded.
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(C.BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", C.BATCH_BYTES)
    return df.withColumn(out_col, FT.normalize_text(F.col(text_col)))


def sentences(df: DataFrame, keys: Sequence[str], text_col: str = "text",
              min_tokens: int = C.SENTENCE_MIN_TOKENS) -> DataFrame:
    """T4: one row per sentence ``(keys..., sent_pos, sentence)``; short sentences dropped.

    ``sent_pos`` is the piece index before the length filter, so it is stable and unique.
    The explode is narrow (no shuffle); the document stays in its partition.
    """
    exploded = df.select(*keys, F.posexplode(FT.sentence_pieces(F.col(text_col))).alias("sent_pos", "sentence"))
    return exploded.where(FT.word_count(F.col("sentence")) >= min_tokens)


def paragraphs(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """T5: split on ``".\\n"``, collapse whitespace, end each paragraph with one ``.`` (Q18)."""
    pieces = df.select(*keys, F.posexplode(F.split(F.col(text_col), r"\.\n", -1)).alias("para_pos", "p"))
    body = F.regexp_replace(F.regexp_replace(F.col("p"), r"\s+", " "), r"\.$", "")
    return pieces.select(*keys, "para_pos", F.concat(body, F.lit(".")).alias("paragraph"))


def tokens(df: DataFrame, keys: Sequence[str], text_col: str = "text",
           stopwords: DataFrame | None = None, lemmas: DataFrame | None = None,
           keep_position: bool = False) -> DataFrame:
    """One row per token occurrence ``(keys..., [tok_pos], token)``.

    Lemmatisation (T3) is a broadcast join to a ``(word, lemma)`` table, then stopwords are
    removed with a broadcast anti join (J9). Both dimension tables are small and bounded.
    """
    if keep_position:
        out = df.select(*keys, F.posexplode(FT.raw_tokens(F.col(text_col))).alias("tok_pos", "token"))
    else:
        out = df.select(*keys, F.explode(FT.raw_tokens(F.col(text_col))).alias("token"))
    if lemmas is not None:
        out = lemmatize(out, lemmas)
    if stopwords is not None:
        out = remove_stopwords(out, stopwords)
    return out


def lemmatize(df: DataFrame, lemmas: DataFrame, col: str = "token") -> DataFrame:
    """Replace a word by its lemma where the dictionary has one (identity otherwise)."""
    joined = df.join(first_lemmas(lemmas), F.col(col) == F.col("_w"), "left")
    return joined.withColumn(col, F.coalesce(F.col("_l"), F.col(col))).drop("_w", "_l")


def first_lemmas(lemmas: DataFrame) -> DataFrame:
    """(_w, _l): one lemma per word, of its first part of speech in the order n, v, a, r, s (words of
    a dictionary without a ``pos`` column: the smallest lemma)."""
    rank = F.instr(F.lit("nvars"), F.col("pos")) if "pos" in lemmas.columns else F.lit(0)
    return lemmas.groupBy(F.col("word").alias("_w")).agg(F.min(F.struct(rank.alias("r"), "lemma")).alias("_b")).select(
        "_w", F.col("_b.lemma").alias("_l"))


def remove_stopwords(df: DataFrame, stopwords: DataFrame, col: str = "token") -> DataFrame:
    """Anti join against the stopword list (Spark broadcasts it where it is small)."""
    sw = stopwords.select(F.col("word").alias("_sw"))
    return df.join(sw, F.col(col) == F.col("_sw"), "left_anti")


def voice(df: DataFrame, sentence_col: str = "sentence") -> DataFrame:
    """``is_active`` unless the sentence matches the passive surface pattern."""
    return df.withColumn("is_active", ~FT.passive_voice(F.col(sentence_col)))


# Capitalised word runs ("Rio Tinto", "Canada") stand in for named entities (T9, re-aimed).
ENTITY_RE = r"[A-Z][a-z]+(?: [A-Z][a-z]+)*"
# Java matches a repeated group by recursion, which ends the executor on a run of some thousand words, unless the group never
# gives a word back. Nothing follows it, so it never has to: the matches are the same.
JAVA_ENTITY_RE = ENTITY_RE + "+"


def candidate_terms(paras: DataFrame, keys: Sequence[str], text_col: str = "paragraph",
                    stopwords: Sequence[str] = C.STOPWORDS, lemmas: DataFrame | None = None) -> DataFrame:
    """Candidate terms per paragraph as a long table ``(keys..., kind, term)``.

    * ``key``: content tokens (lemmatised, stopwords removed);
    * ``ent``: capitalised word runs, lower-cased;
    * ``nck``: bigrams of adjacent tokens where neither is a stopword.
    All three are array expressions over the paragraph (no Python); the fixed stopword list is
    an ``isin`` literal list, which the optimizer turns into a hash ``InSet``.
    """
    sw = list(stopwords)
    # tokens once per paragraph; later expressions reference the column instead of re-running the regex
    toks = paras.select(*keys, FT.raw_tokens(F.col(text_col)).alias("_tk"),
                        F.regexp_extract_all(F.col(text_col), F.lit(JAVA_ENTITY_RE), 0).alias("_ent"))
    masked = F.transform("_tk", lambda x: F.when(~x.isin(*sw), x))
    toks = toks.withColumn("_m", masked)
    n = F.size("_m")
    left = F.slice("_m", 1, F.greatest(n - 1, F.lit(0)))
    right = F.slice("_m", 2, F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))
    # all three kinds in ONE array → one explode (the base projection is computed once)
    tagged = F.concat(
        F.transform("_tk", lambda x: F.struct(F.lit("key").alias("kind"), x.alias("term"))),
        F.transform("_ent", lambda x: F.struct(F.lit("ent").alias("kind"), F.lower(x).alias("term"))),
        F.transform(F.filter(pairs, lambda x: x.isNotNull()),
                    lambda x: F.struct(F.lit("nck").alias("kind"), x.alias("term"))))
    out = toks.select(*keys, F.inline(tagged))
    if lemmas is not None:
        out = out.join(first_lemmas(lemmas), (F.col("kind") == "key") & (F.col("term") == F.col("_w")), "left")
        out = out.withColumn("term", F.coalesce("_l", "term")).drop("_w", "_l")
    return out.where(~((F.col("kind") == "key") & F.col("term").isin(*sw)))


def content_chunks(paras: DataFrame, keys: Sequence[str], text_col: str = "paragraph", max_words: int = 3,
                   stopwords: Sequence[str] = C.STOPWORDS) -> DataFrame:
    """Variable-length chunks ``(keys..., chunk)``: of every maximal run of tokens without a stopword, all stretches of
    2 to ``max_words`` words, once per occurrence. Array expressions over the paragraph: no shuffle, no Python."""
    marked = F.transform(FT.raw_tokens(F.col(text_col)), lambda x: F.when(x.isin(*stopwords), F.lit("|")).otherwise(x))
    runs = F.filter(F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda r: F.trim(r)), lambda r: r != "")

    def stretches(run):
        words = F.split(run, " ")
        sizes = F.filter(F.array(*[F.lit(n) for n in range(2, max_words + 1)]), lambda n: n <= F.size(words))
        return F.flatten(F.transform(sizes, lambda n: F.transform(
            F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))

    return paras.select(*keys, F.explode(F.flatten(F.transform(runs, stretches))).alias("chunk"))
