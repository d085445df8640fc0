"""URL filter (operator 7): allow and block rules in a trie over reversed host labels and path segments.

A rule ``host/path`` fits its host and every subdomain, when the url's path starts with the rule's path.
Of all rules that fit, the longest (characters of host and path) wins; of equally long ones the one with
the longer host; of an allow and a block rule for the same host and path, block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.plans.registry import register
from riskweave.sources.tables import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
# A trie is broadcast up to this many characters of rules; beyond it the rules stay a table and are joined.
MAX_TRIE_CHARS = 32_000_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # starts with /

    @property
    def text(self) -> str:
        return self.host + self.path


class Node:
    """One host label or one whole path segment; ``ends`` holds rules whose path ends inside a segment."""

    __slots__ = ("ends", "labels", "segments")

    def __init__(self):
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.ends: dict[str, tuple[int, int, str, str]] = {}


def build_trie(rules: Iterable[Rule]) -> Node:
    root = Node()
    for r in rules:
        if r.verdict not in ("allow", "block") or not r.path.startswith("/"):
            raise ValueError(f"not a rule: {r}")
        node = root
        for label in reversed(r.host.translate(_ASCII_LOWER).split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, last = r.path[1:].split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        # Greater is stronger: length, then host length, then block before allow.
        found = (len(r.text), len(r.host), r.verdict, r.text)
        node.ends[last] = max(found, node.ends.get(last, found))
    return root


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    end = len(url)
    stops = [i for c in "?#" if (i := url.find(c, at + 3)) >= 0]
    path_end = min([end, *stops])
    slash = url.find("/", at + 3, path_end)
    host_end = slash if slash >= 0 else path_end
    return url[at + 3:host_end].translate(_ASCII_LOWER), url[host_end:path_end]


def longest_match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """(rule text, verdict) of the strongest rule that fits, or None."""
    best = None
    node = root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        at, rest = node, path[1:].split("/") if path.startswith("/") else []
        for segment in rest:
            for n in range(len(segment) + 1) if at.ends else ():
                found = at.ends.get(segment[:n])
                if found is not None and (best is None or found > best):
                    best = found
            at = at.segments.get(segment)
            if at is None:
                break
    return (best[3], best[2]) if best else None


def url_filter(pages: DataFrame, rules: Iterable[Rule] | DataFrame, id_col: str = "page_id",
               url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict`` (rule null and verdict ``default`` where no
    rule fits, so also for null and malformed urls). Repeated rows stay. ``rules`` is a list, or a
    DataFrame (verdict, host, path); the trie is broadcast while its rules have at most
    ``MAX_TRIE_CHARS`` characters, a larger rule table is joined on the url's host suffixes and path
    prefixes instead, with the same result."""
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0
        if size > MAX_TRIE_CHARS:
            return _joined(rows, rules, id_col, default)
        rules = [Rule(r.verdict, r.host, r.path) for r in rules.select("verdict", "host", "path").collect()]
    else:
        rules = list(rules)
        if sum(len(r.text) for r in rules) > MAX_TRIE_CHARS:
            spark = pages.sparkSession
            return _joined(rows, spark.createDataFrame(rules, "verdict string, host string, path string"), id_col, default)
    build_trie(rules)  # refuses malformed rules before a job starts
    shared = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in rules])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = build_trie(Rule(*r) for r in shared.value)
        for b in batches:
            parts = [split_url(u) for u in b.column("url").to_pylist()]
            found = [longest_match(trie, h, p) or (None, default) for h, p in parts]
            cols = [[h for h, _ in parts], [p for _, p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in cols]],
                                             names=[id_col, "host", "path", "rule", "verdict"])

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _joined(rows: DataFrame, rules: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same verdicts through equi-joins: each distinct (host, path) meets the rules of its host
    suffixes whose path is one of its own prefixes; the strongest wins by a partial maximum."""
    has = F.col("url").contains("://")
    rest = F.when(has, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    urls = rows.withColumn("_rest", rest)
    host = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    urls = urls.select(F.col(id_col), F.translate(host, UPPER, LOWER).alias("host"),
                       F.regexp_extract(F.expr("substring(_rest, length(regexp_extract(_rest, '^([^/?#]*)', 1)) + 1)"),
                                        r"^([^?#]*)", 1).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda n: F.array_join(F.slice(labels, -n, n), "."))
    keys = urls.select("host", "path").distinct().withColumn("_h", F.explode(suffixes)).where(F.startswith("path", F.lit("/")))
    keys = keys.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.length("path")),
                                                       lambda n: F.substring(F.col("path"), F.lit(1), n))))
    r = rules.select(F.translate("host", UPPER, LOWER).alias("_h"), F.col("path").alias("_p"),
                     F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("m"), "verdict",
                              F.concat("host", "path").alias("rule")).alias("_r"))
    best = keys.join(r, ["_h", "_p"]).groupBy("host", "path").agg(F.max("_r").alias("_r"))
    return urls.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.lit(default)).alias("verdict"))


# The rules of the production query.
PAGE_RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
              Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

_SQL = """
WITH r AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
                                ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
v AS (SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM v
"""


@register("op7_url_filter", _SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read_table(spark, sf_dir, "pages"), PAGE_RULES)
