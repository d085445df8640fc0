"""DuckDB SQL fragments mirroring the role builders and shared text steps (oracle side).

Regexes come from ``riskweave.functions.text`` so both engines use the same patterns.
"""

from __future__ import annotations

from riskweave import constants as C
from riskweave.functions import text as FT
from riskweave.plans import roles as R


def lit(s: str) -> str:
    """SQL string literal (backslashes are literal in DuckDB strings)."""
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(cols)}))"


def norm(col: str) -> str:
    x = f"regexp_replace(strip_accents({col}), {lit(FT.NON_ASCII_RE)}, '', 'g')"
    x = f"regexp_replace({x}, {lit(FT.EMAIL_RE)}, '', 'g')"
    x = f"regexp_replace({x}, {lit(FT.URL_RE)}, '', 'g')"
    return f"regexp_replace({x}, {lit(FT.NOT_KEPT_RE)}, '', 'g')"


def round6(expr: str) -> str:
    """Mirror of ``functions.misc.round6``: exact decimal at 10 places, then half-up to 6."""
    return f"round(({expr})::DECIMAL(38,10), 6)::DOUBLE"


def word_count(col: str) -> str:
    return f"len(regexp_extract_all({col}, {lit(FT.WORD_RE)}))"


def raw_tokens(col: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({col}), {lit(FT.TOKEN_RE)}), "
            f"lambda t: length(t) BETWEEN {C.TOKEN_MIN_LEN} AND {C.TOKEN_MAX_LEN} AND NOT starts_with(t, '_'))")


def sentence_parts(col: str) -> str:
    ws = FT.WS
    return f"string_split(regexp_replace({col}, '([.!?])' || {lit(ws)} || '+', '\\1' || chr(1), 'g'), chr(1))"


def stopword_share(col: str) -> str:
    sw = "[" + ", ".join(lit(w) for w in C.STOPWORDS) + "]"
    tk = raw_tokens(col)
    return (f"CASE WHEN len({tk}) > 0 THEN len(list_filter({tk}, lambda x: list_contains({sw}, x))) / len({tk}) "
            "ELSE 0.0 END")


def passive(col: str) -> str:
    return f"regexp_matches(lower({col}), {lit(FT.PASSIVE_RE)})"


def md5_int(col: str) -> str:
    return f"('0x' || substr(md5({col}), 1, 8))::BIGINT"


def lex_counts_sql(names) -> str:
    topic = f"({md5_int("coalesce(source, '')")} % {len(names)})::INTEGER"
    return (f"SELECT {topic} AS topic_num, token, count(*) AS cnt FROM doc_tokens "
            f"WHERE length(token) >= {R.LEXICON_MIN_LEN} GROUP BY 1, 2")


def lexicon_sql(names, counts_rel: str) -> str:
    return ("SELECT topic_num, token AS keyword, "
            "CASE WHEN length(token) % 5 = 0 THEN 1 END AS \"drop\", round(cnt / max(cnt) OVER (PARTITION BY topic_num), 4) AS cosine_score, "
            f"[{', '.join(lit(n) for n in names)}][topic_num + 1] AS topic_name FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY topic_num ORDER BY cnt DESC, token ASC) AS rn FROM {counts_rel}) "
            f"WHERE rn <= {R.LEXICON_TOP}")


STOPWORDS = values([(w,) for w in C.STOPWORDS], ["word"])
# One lemma per word, by part of speech in the order n, v, a, r, s.
LEMMAS = ("(SELECT word, min_by(pos, instr('nvars', pos)) AS pos, min_by(lemma, instr('nvars', pos)) AS lemma FROM "
          + values(R.LEMMA_ROWS, ["word", "pos", "lemma"]) + " GROUP BY word)")

FILING_TIME = ("concat(CAST(2006 + doc_id % 15 AS VARCHAR), '-', "
               "lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0'))")

# CTE bodies, composed by name into WITH clauses.
CTE = {
    "stopwords": STOPWORDS,
    "lemmas": LEMMAS,
    "filings": f"SELECT doc_id, source AS symbol, {FILING_TIME} AS filing_time, {norm('text')} AS text FROM documents",
    "sent_split": f"SELECT doc_id, symbol, filing_time, {sentence_parts('text')} AS parts FROM filings",
    "sent_all": ("SELECT doc_id, symbol, filing_time, unnest(parts) AS sentence, "
                 "generate_subscripts(parts, 1) - 1 AS sent_pos FROM sent_split"),
    "sentences": (f"SELECT s.doc_id, s.sent_pos, s.symbol, s.filing_time, s.sentence, NOT {passive('s.sentence')} AS is_active, "
                  f"round({stopword_share('s.sentence')}, 6) AS p_noise, "
                  "coalesce(l.quality = 1, false) AS is_action, coalesce(l.toxic = 1, false) AS is_noise "
                  f"FROM sent_all s LEFT JOIN labels l USING (doc_id) WHERE {word_count('s.sentence')} >= {C.SENTENCE_MIN_TOKENS}"),
    "sent_tok_raw": f"SELECT doc_id, sent_pos, unnest({raw_tokens('sentence')}) AS token FROM sentences",
    "sent_tokens": ("SELECT r.doc_id, r.sent_pos, coalesce(l.lemma, r.token) AS token FROM sent_tok_raw r "
                    "LEFT JOIN lemmas l ON r.token = l.word "
                    "WHERE coalesce(l.lemma, r.token) NOT IN (SELECT word FROM stopwords)"),
    "doc_norm": f"SELECT doc_id, source, {norm('text')} AS text FROM documents",
    "doc_tok_raw": f"SELECT doc_id, source, unnest({raw_tokens('text')}) AS token FROM doc_norm",
    "doc_tokens": ("SELECT r.doc_id, r.source, coalesce(l.lemma, r.token) AS token FROM doc_tok_raw r "
                   "LEFT JOIN lemmas l ON r.token = l.word "
                   "WHERE coalesce(l.lemma, r.token) NOT IN (SELECT word FROM stopwords)"),
    "lex_counts": lex_counts_sql(R.CLUSTERS),
    "lexicon": lexicon_sql(R.CLUSTERS, "lex_counts"),
    "lex_trim": "SELECT * FROM lexicon WHERE \"drop\" IS DISTINCT FROM 1",
    "hits": ("SELECT DISTINCT t.doc_id, t.sent_pos, x.topic_num AS topic FROM sent_tokens t "
             "JOIN (SELECT DISTINCT keyword, topic_num FROM lex_trim) x ON t.token = x.keyword"),
    "tagged": ("SELECT s.*, coalesce(h.topic_ids, [-1]) AS topic_ids, coalesce(c.n_tokens, 0) AS n_tokens, "
               "coalesce(c.n_hit_tokens, 0) AS n_hit_tokens FROM sentences s LEFT JOIN "
               "(SELECT doc_id, sent_pos, list_sort(list(topic)) AS topic_ids FROM hits GROUP BY 1, 2) h "
               "USING (doc_id, sent_pos) LEFT JOIN (SELECT t.doc_id, t.sent_pos, count(*) AS n_tokens, "
               "count(x.keyword) AS n_hit_tokens FROM sent_tokens t LEFT JOIN (SELECT DISTINCT keyword FROM lex_trim) x "
               "ON t.token = x.keyword GROUP BY 1, 2) c USING (doc_id, sent_pos)"),
    "transcripts": ("SELECT conv_id AS transcript_id, turn AS component_order, role AS speaker_type, text "
                    "FROM conversations"),
    "vec_slots": (f"SELECT token, {md5_int('token')} % (SELECT count(*) FROM embeddings) AS vec_id "
                  "FROM (SELECT DISTINCT token FROM sent_tokens)"),
    "word_vectors": "SELECT v.token, e.embedding AS vector FROM vec_slots v JOIN embeddings e USING (vec_id)",
    "emb_x": ("SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"),
    "bag_top": ("SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(sum(x * m), 8) DESC, vec_id) AS rn FROM emb_x "
                "JOIN (SELECT label, i, avg(x) AS m FROM emb_x GROUP BY 1, 2) USING (label, i) GROUP BY label, vec_id"),
    "bag_vectors": ("SELECT b.label AS topic, vec_id, embedding AS vector FROM bag_top b JOIN embeddings USING (vec_id) "
                    f"WHERE rn <= {R.BAG_SIZE}"),
}

# Dependencies so that ``with_ctes`` can pull in everything a query needs, in order.
DEPS = {
    "filings": [], "sent_split": ["filings"], "sent_all": ["sent_split"], "sentences": ["sent_all"],
    "sent_tok_raw": ["sentences"], "sent_tokens": ["sent_tok_raw", "lemmas", "stopwords"],
    "doc_norm": [], "doc_tok_raw": ["doc_norm"], "doc_tokens": ["doc_tok_raw", "lemmas", "stopwords"],
    "lex_counts": ["doc_tokens"], "lexicon": ["lex_counts"], "lex_trim": ["lexicon"],
    "hits": ["sent_tokens", "lex_trim"], "tagged": ["sentences", "hits", "sent_tokens", "lex_trim"],
    "stopwords": [], "lemmas": [], "transcripts": [],
    "vec_slots": ["sent_tokens"], "word_vectors": ["vec_slots"], "emb_x": [], "bag_top": ["emb_x"], "bag_vectors": ["bag_top"],
}


def with_ctes(names, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause containing ``names`` and their dependencies, then ``extra`` CTEs."""
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({body})" for n, body in (extra or [])]
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""
