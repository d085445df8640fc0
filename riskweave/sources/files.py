"""File sources and sinks: CSV/JSON with explicit schemas, whole-text HTML, staged Parquet.

All paths are under shared storage (the session's checkpoint folder by default); nothing is
written to a machine-local folder on a cluster.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root (never reused, never deleted here)."""
    return "/".join([checkpoint_dir(spark).rstrip("/"), "riskweave", name, uuid.uuid4().hex])


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back: cuts the lineage, is computed once,
    and keeps column pruning for its readers (a row ``checkpoint()`` has none)."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K1/K4: CSV with header; every field quoted and quotes doubled, so commas, quotes and
    newlines inside text survive (the original fell back to a spreadsheet for that)."""
    (df.write.mode("overwrite").option("header", True).option("quoteAll", True)
       .option("escape", '"').csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV/TSV with header and quoted embedded separators / newlines; explicit schema."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("sep", sep).csv(path))


def write_json(df: DataFrame, path: str) -> None:
    """K2: JSON Lines (one record per line, many part files)."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path_or_glob: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """JSON records (a glob of many files is one parallel scan); explicit schema."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path_or_glob)


# FIXED VALUES: the layout of a filings folder (symbol, form, filing date) and the years whose filings have the section.
FILING_PATH_RE = r"/([^/]+)/10-K/(20[0-9]{2})([0-9]{2})[0-9]+/"
FIRST_FILING_YEAR, LAST_FILING_YEAR = 2006, 2029
FILE_TASKS_PER_CORE = 4


def read_html_files(spark: SparkSession, path_glob: str, path_re: str = FILING_PATH_RE, first_year: int = FIRST_FILING_YEAR,
                    last_year: int = LAST_FILING_YEAR, whole_tree: bool = False) -> DataFrame:
    """Whole HTML files as ``(path, symbol, year, month, html)``, one row per file. ``path_re`` has the symbol, the
    year and the month as groups; files with other paths or of other years are never opened: the conditions are on the
    files' paths alone, so the scan drops them when it lists its files. ``whole_tree``: folders are searched at any depth and
    their names are not taken for columns, whose types would be inferred from all paths on the driver."""
    path = F.col("_metadata.file_path")
    year = F.regexp_extract(path, path_re, 2)
    files = spark.read.option("recursiveFileLookup", whole_tree).text(path_glob, wholetext=True).where(
        path.rlike(path_re) & (year >= F.lit(str(first_year))) & (year <= F.lit(str(last_year))))
    # Spark plans a file as 4 MB at least, so small files would make a task for a handful of them.
    files = files.coalesce(FILE_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return files.select(path.alias("path"), F.regexp_extract(path, path_re, 1).alias("symbol"), year.cast("int").alias("year"),
                        F.regexp_extract(path, path_re, 3).cast("int").alias("month"), F.col("value").alias("html"))


def write_html_files(df: DataFrame, path: str, html_col: str, by: Sequence[str]) -> None:
    """One file per row, in folders ``name=value`` of the ``by`` columns, which together are a key. Each task moves its own
    files to their place when it ends (a task that is run again overwrites them); else the driver moves them one by one."""
    writer = df.select(*by, F.col(html_col).alias("value")).write.mode("overwrite").partitionBy(*by)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """A Parquet folder per value of ``by``; a rerun replaces only the folders of values it has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """K3: one output folder per key value (``partitionBy``) instead of a per-company loop."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def input_key(spark: SparkSession, df: DataFrame) -> str:
    """A key of what ``df`` would give now: its optimised plan (without expression numbers) and the path, length and
    modification time of every file it reads, listed once per folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    plan = re.sub(r"#\d+L?|\bplan_id=\d+", "", df._jdf.queryExecution().optimizedPlan().toString())
    wanted = set(df.inputFiles())
    known = {}
    for folder in sorted({w.rsplit("/", 1)[0] for w in wanted}):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        for f in path.getFileSystem(conf).listStatus(path):
            known[f.getPath().toUri().getRawPath()] = f"{f.getLen()} {f.getModificationTime()}"
    files = sorted(f"{w} {known.get(jvm.java.net.URI(w).getRawPath())}" for w in wanted)
    return hashlib.sha256("\n".join([plan, *files]).encode()).hexdigest()[:24]


def load_or_build(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a staged Parquet table when it is complete (its success marker is there), otherwise
    build, write and reuse it. A folder without the marker is a write that broke off and is replaced; any
    other error surfaces. A stage is that of ``build``'s plan and of the files it reads as they are now
    (``input_key``): another plan or changed files make another stage; Python functions count by name only.

    Writing the stage also cuts the lineage for everything downstream."""
    df = build()
    path = os.path.join(root, name, input_key(spark, df))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_vectors_text(df: DataFrame, path: str, key: str, vec_col: str) -> None:
    """Word-vector text layout: one ``key v1 v2 ... vN`` line per vector (Parquet is the better
    store after the first load; this exists to read and write the interchange format)."""
    line = F.concat_ws(" ", F.col(key).cast("string"), F.array_join(F.transform(vec_col, lambda x: x.cast("string")), " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def read_vectors_text(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """``word v1 ... vN`` lines → ``(word, vector array<float>)``; a ``count dim`` header
    line (two integers) is skipped. One parallel scan, no driver-side parsing."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"))
    lines = lines.where((F.col("v") != "") & ~F.col("v").rlike(r"^[0-9]+ +[0-9]+$"))  # blank lines, header
    parts = lines.select(F.split("v", " +").alias("p"))
    vec = F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float"))
    out = parts.select(F.col("p")[0].alias("word"), vec.alias("vector"))
    return out.where(F.size("vector") == dim) if dim else out
