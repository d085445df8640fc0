"""Relational queries: versions, detail joins, entity resolution, lookups, flags, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.misc import epoch_ms_to_date, ntz_to_epoch_ms
from riskweave.operators import relational as RL
from riskweave.plans import roles as R
from riskweave.plans import sqlfrag as S
from riskweave.plans.q_text import tagged_filing_sentences
from riskweave.plans.registry import register
from riskweave.sources.tables import Tables

# Transcript-version role on `events` (FIXTURES.md B).
VERSION_EVENT_TYPE = "purchase"
VERSION_DATE_FLOOR = "2024-01-08"
# Company-resolution role: a query name is the customer's name without its last character.
EXEC_SPEAKER = "assistant"


def latest_versions(t: Tables):
    e = t.events.where((F.col("event_type") == VERSION_EVENT_TYPE)
                       & (F.col("ts") >= F.lit(VERSION_DATE_FLOOR).cast("timestamp_ntz")))
    e = e.select(F.col("user_id").alias("key_dev_id"), "event_id", "value",
                 F.date_format("ts", "yyyy-MM-dd").alias("creation_date"),
                 F.date_format("ts", "HH:mm:ss").alias("creation_time"))
    return RL.latest_version(e, "key_dev_id", [F.desc("creation_date"), F.desc("creation_time")])


@register("latest_version", f"""
SELECT key_dev_id, event_id, value, creation_date, creation_time FROM (
  SELECT user_id AS key_dev_id, event_id, value, strftime(ts, '%Y-%m-%d') AS creation_date,
         strftime(ts, '%H:%M:%S') AS creation_time,
         rank() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d') DESC, strftime(ts, '%H:%M:%S') DESC) AS rk
  FROM events WHERE event_type = {S.lit(VERSION_EVENT_TYPE)} AND ts >= TIMESTAMP '{VERSION_DATE_FLOOR}') WHERE rk = 1""")
def latest_version(spark, sf_dir):
    """W1 + P7: newest version per key (ties kept) after the type + date-floor filter."""
    return latest_versions(Tables(spark, sf_dir))


def _detail(t: Tables):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    latest = RL.latest_version(o, "o_custkey", [F.desc("o_orderdate")])
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    p = t.part.select("p_partkey", "p_name")
    j = latest.join(li, latest.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("transcript_id"),
                    F.col("l_linenumber").cast("long").alias("component_order"),
                    F.col("l_returnflag").alias("speaker_type"), F.col("p_name").alias("component_text"))


@register("transcript_detail", """
SELECT o.o_custkey AS company_id, o.o_orderkey AS transcript_id, l.l_linenumber::BIGINT AS component_order,
       l.l_returnflag AS speaker_type, p.p_name AS component_text
FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rk FROM orders) o
JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey WHERE o.rk = 1""")
def transcript_detail(spark, sf_dir):
    """Latest detail version ⋈ person rows ⋈ component text (three-way inner equi join)."""
    return _detail(Tables(spark, sf_dir))


@register("attach_symbol", """
SELECT m.symbol, count(*)::BIGINT AS n_rows FROM lineitem l LEFT JOIN
  (SELECT s_suppkey, min(s_name) AS symbol FROM supplier GROUP BY s_suppkey) m ON l.l_suppkey = m.s_suppkey
GROUP BY m.symbol""")
def attach_symbol(spark, sf_dir):
    """Left join on differently named keys to a de-duplicated dimension (no fan-out)."""
    t = Tables(spark, sf_dir)
    meta = RL.dedupe_dimension(t.supplier.select("s_suppkey", F.col("s_name").alias("symbol")), "s_suppkey", sentinel=-1)
    j = t.lineitem.select("l_suppkey").join(meta,
                                            F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return j.groupBy("symbol").agg(F.count("*").cast("long").alias("n_rows"))


def _resolution_queries(t: Tables):
    """Company names to resolve: customer-name prefixes and (unmatched) supplier names."""
    nat = t.nation.select("n_nationkey", "n_name")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey")
    cq = c.join(nat, ((F.col("c_nationkey") + F.col("c_custkey")) % 25) == F.col("n_nationkey")).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("query_id"),
        F.expr("substring(c_name, 1, length(c_name) - 1)").alias("name"), F.lower("n_name").alias("country_name"))
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    sq = s.join(nat, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("query_id"),
        F.col("s_name").alias("name"), F.upper("n_name").alias("country_name"))
    return cq.unionByName(sq)


_RESOLUTION_Q_SQL = f"""
q0 AS (SELECT 'c' || c_custkey AS query_id, substr(c_name, 1, length(c_name) - 1) AS name, lower(n_name) AS country_name
       FROM customer JOIN nation ON (c_nationkey + c_custkey) % 25 = n_nationkey
       UNION ALL
       SELECT 's' || s_suppkey, s_name, upper(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey),
q AS (SELECT q0.*, n.n_nationkey AS country_id FROM q0 LEFT JOIN nation n ON lower(n.n_name) = lower(q0.country_name))"""


@register("country_lookup", f"WITH {_RESOLUTION_Q_SQL}\nSELECT DISTINCT country_name, country_id FROM q")
def country_lookup(spark, sf_dir):
    """Case-insensitive country name → id via a broadcast dimension."""
    t = Tables(spark, sf_dir)
    names = _resolution_queries(t).select("country_name").distinct()
    return RL.lookup_ci(names, "country_name", t.nation, "n_name", "n_nationkey", "country_id")


@register("entity_resolve_prefix", f"""WITH {_RESOLUTION_Q_SQL},
cand AS (SELECT q.query_id, q.country_id, e.c_custkey AS id, e.c_nationkey AS cty
         FROM q JOIN customer e ON starts_with(lower(e.c_name), lower(q.name))),
in_c AS (SELECT query_id, min(id) AS id_in FROM cand WHERE cty = country_id GROUP BY query_id),
any_c AS (SELECT query_id, id AS id_any FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cty DESC, id ASC) AS rn FROM cand) WHERE rn = 1)
SELECT q.query_id, q.name, q.country_id, coalesce(id_in, id_any) AS resolved_id,
       CASE WHEN id_in IS NOT NULL THEN 'in_country' WHEN id_any IS NOT NULL THEN 'any_country' ELSE 'not_found' END AS match_type
FROM q LEFT JOIN in_c USING (query_id) LEFT JOIN any_c USING (query_id)""")
def entity_resolve_prefix(spark, sf_dir):
    """J6 + J7: resolve company names by case-insensitive prefix, in-country first, with fallback."""
    t = Tables(spark, sf_dir)
    q = RL.lookup_ci(_resolution_queries(t), "country_name", t.nation, "n_name", "n_nationkey", "country_id")
    ents = t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity_name"),
                             F.col("c_nationkey").alias("country_id"))
    r = RL.resolve_by_prefix(q, ents)
    return r.select("query_id", "name", "country_id", "resolved_id", "match_type")


@register("has_child_flag", """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_transcript FROM customer""")
def has_child_flag(spark, sf_dir):
    """Per company, whether any child (transcript/order) row exists."""
    t = Tables(spark, sf_dir)
    return RL.has_child(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey", "has_transcript")


@register("speaker_filter", S.with_ctes(["transcripts"]) + f"""
SELECT transcript_id, component_order, length(text)::BIGINT AS n_chars FROM transcripts WHERE speaker_type = {S.lit(EXEC_SPEAKER)}""")
def speaker_filter(spark, sf_dir):
    """Keep executive utterances only (filter authored before any text work)."""
    tr = R.transcripts(Tables(spark, sf_dir))
    return tr.where(F.col("speaker_type") == EXEC_SPEAKER).select(
        "transcript_id", "component_order", F.length("text").cast("long").alias("n_chars"))


@register("cols_by_regex", "SELECT COLUMNS('.*(orderkey|linenumber|price).*') FROM lineitem")
def cols_by_regex(spark, sf_dir):
    """Select columns whose name CONTAINS a pattern (colRegex is a full match, so wrap in .*)."""
    li = Tables(spark, sf_dir).lineitem
    return li.select(li.colRegex("`.*(orderkey|linenumber|price).*`"))


@register("epoch_to_date", """
SELECT event_id, epoch_ms, strftime(make_timestamp(epoch_ms * 1000), '%Y-%m-%d') AS event_date
FROM (SELECT event_id, epoch_us(ts) // 1000 AS epoch_ms FROM events)""")
def epoch_to_date(spark, sf_dir):
    """Epoch milliseconds → 'yyyy-MM-dd' (UTC session time zone)."""
    e = Tables(spark, sf_dir).events
    ms = ntz_to_epoch_ms(F.col("ts"))
    return e.select("event_id", ms.alias("epoch_ms"), epoch_ms_to_date(ms).alias("event_date"))


@register("json_field", """
SELECT event_type, count(*)::BIGINT AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY event_type""")
def json_field(spark, sf_dir):
    """Parse a JSON text column and aggregate one field."""
    e = Tables(spark, sf_dir).events
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("event_type").agg(F.count("*").cast("long").alias("n"), F.sum(k).cast("long").alias("sum_k"))


@register("forward_fill", S.with_ctes(["tagged"]) + """
SELECT doc_id, sent_pos::BIGINT AS sent_pos,
       last_value(CASE WHEN topic_ids[1] >= 0 THEN topic_ids[1] END IGNORE NULLS) OVER
         (PARTITION BY doc_id ORDER BY sent_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS topic_ffill
FROM tagged""")
def forward_fill(spark, sf_dir):
    """Carry the last seen topic forward over untagged sentences, per document in order."""
    tg = tagged_filing_sentences(spark, sf_dir)
    first = F.when(F.col("topic_ids")[0] >= 0, F.col("topic_ids")[0])
    tg = tg.select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), first.alias("topic_first"))
    return RL.forward_fill(tg, "topic_first", ["doc_id"], ["sent_pos"], "topic_ffill").drop("topic_first")


@register("hash_sample", S.with_ctes(["sentences"]) + """
SELECT doc_id, sent_pos::BIGINT AS sent_pos, sentence FROM sentences ORDER BY md5(CAST(doc_id AS VARCHAR) || '-' || CAST(sent_pos AS VARCHAR)) LIMIT 100""")
def hash_sample(spark, sf_dir):
    """A stable sample of exactly 100 sentences, chosen by key hash (sampling is the feature)."""
    s = R.filing_sentences(Tables(spark, sf_dir)).select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), "sentence")
    key = F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("sent_pos").cast("string"))
    return RL.stable_sample(s, key, 100)


@register("train_test_split", """
SELECT CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 1000 < 100 THEN 'test' ELSE 'train' END AS split,
       count(*)::BIGINT AS n, sum(quality)::BIGINT AS n_positive FROM labels GROUP BY 1""")
def train_test_split(spark, sf_dir):
    """10 % test split by key hash (reproducible, independent of partitioning)."""
    lab = Tables(spark, sf_dir).labels
    sp = RL.hash_split(lab, F.col("doc_id"), 0.1)
    return sp.groupBy("split").agg(F.count("*").cast("long").alias("n"), F.sum("quality").cast("long").alias("n_positive"))
