"""Filing pages: section bounds from heading elements, and the fields of the header block.

Headings are found by a fold over a page's tags (one pass, the open elements on a stack): an element is a heading if its
whole text, entities decoded, matches a pattern. The fold is one small Arrow UDF that returns two positions per page;
cutting, cleaning and everything after it are column expressions.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose whole text may be a heading. The inline ones count only at the beginning of a line: a bold mention
# within a sentence is none.
INLINE = frozenset(("b", "strong", "font"))
HEADING_ELEMENTS = frozenset(("p", "div", "table", "h1", "h2", "h3", "h4", "h5", "h6")) | INLINE
# HTML lets the end of a paragraph be left out: these elements end it.
CLOSE_P = frozenset("address article aside blockquote center dir div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu "
                    "nav ol p pre section table ul".split())
BREAKS = CLOSE_P | {"br", "body", "caption", "dd", "dt", "li", "tbody", "td", "th", "thead", "tr"}
TAG_RE = re.compile(r"<!--.*?-->|<(script|style|title)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>", re.DOTALL | re.IGNORECASE)
BODY_RE = re.compile(r"<html.*?>(.*?)</html>", re.DOTALL | re.IGNORECASE)
HEADING_DROP_RE = re.compile(r"[.:,;]")
PROBE_CHARS = 256  # of an element's text that are tested first, to see whether the rest can still match


def clean_heading(text: str) -> str:
    """a text as it is compared with heading patterns: without ``. : , ;``, white space collapsed."""
    return re.sub(r"\s+", " ", HEADING_DROP_RE.sub("", text)).strip()


def heading_elements(page: str, kinds: dict, begin: int = 0, stop: int | None = None) -> list[tuple[str, int, int]]:
    """(kind, first position, position behind) of every heading element of ``page[begin:stop]`` whose whole text matches
    the pattern (a compiled ``regex``) of a kind. Elements left open end with what contains them."""
    pieces: list[str] = []  # text between tags
    stack: list[tuple[str, int, int, bool]] = []  # open elements: tag, position, pieces before, whether it may be a heading
    found = []
    stop = len(page) if stop is None else stop
    at, line_begins = begin, True

    def end(i: int, where: int):
        _, first, before, counts = stack.pop(i)
        if not counts:
            return
        probe, size = [], 0
        for piece in pieces[before:]:
            probe.append(piece)
            size += len(piece)
            if size > PROBE_CHARS:
                break
        probe_text = clean_heading("".join(probe))
        for kind, pattern in kinds.items():
            if pattern.fullmatch(probe_text, partial=size > PROBE_CHARS):
                if size <= PROBE_CHARS or pattern.fullmatch(clean_heading("".join(pieces[before:]))):
                    found.append((kind, first, where))

    def end_from(i: int, where: int):
        while len(stack) > i:
            end(len(stack) - 1, where)

    def innermost(tag: str) -> int:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)

    for m in TAG_RE.finditer(page, begin, stop):
        if m.start() > at:
            pieces.append(html_lib.unescape(page[at:m.start()]))
            line_begins = line_begins and not pieces[-1].strip()
        at = m.end()
        if m[3] is None:  # a comment, or an element whose text is not shown
            continue
        tag = m[3].lower()
        line_begins = line_begins or tag in BREAKS
        if not m[2]:
            if tag in CLOSE_P and (i := innermost("p")) > innermost("table"):
                end_from(i, m.start())
            if tag in HEADING_ELEMENTS and not m[0].endswith("/>"):
                stack.append((tag, m.start(), len(pieces), tag not in INLINE or line_begins))
        elif tag in HEADING_ELEMENTS and (i := innermost(tag)) >= 0:
            if tag not in INLINE:
                end_from(i + 1, m.start())
            end(i, at)
        elif tag in CLOSE_P and (i := innermost("p")) > innermost("table"):
            end_from(i, m.start())
    if at < stop:
        pieces.append(html_lib.unescape(page[at:stop]))
    end_from(0, stop)
    return found


def section_bounds(page: str | None, start, end) -> tuple[int | None, int | None, str | None]:
    """(first position, position behind, error) of the section between a start and an end heading. Of the starts with an
    end behind them the last counts, and the end next to it, so a table of contents is never the section."""
    body = BODY_RE.search(page or "")
    if body is None:
        return None, None, "no html body"
    found = heading_elements(page, {"start": start, "end": end}, body.start(1), body.end(1))
    ends = [first for kind, first, _ in found if kind == "end"]
    last = max(ends, default=-1)
    behind = max((b for kind, _, b in found if kind == "start" and b <= last), default=None)
    if behind is None:
        return None, None, "no end heading after a start" if any(f[0] == "start" for f in found) else "no start heading"
    return behind, min(e for e in ends if e >= behind), None


def with_section_html(df: DataFrame, html_col: str, start: Sequence[str], end: Sequence[str], out: str, error: str) -> DataFrame:
    """Adds the section's HTML (null where there is none) and what is missing (null where nothing is)."""
    patterns = ["|".join(f"(?:{p})" for p in x) for x in (start, end)]

    @F.arrow_udf("first int, behind int, error string")
    def bounds(pages: pa.Array) -> pa.Array:
        import regex  # tells whether a text may still go on to match

        compiled = [regex.compile(p, flags=regex.IGNORECASE | regex.DOTALL) for p in patterns]
        rows = [section_bounds(p, *compiled) for p in pages.to_pylist()]
        return pa.array([{"first": a, "behind": b, "error": e} for a, b, e in rows],
                        pa.struct([("first", pa.int32()), ("behind", pa.int32()), ("error", pa.string())]))

    found = df.withColumn("_at", bounds(F.col(html_col)))
    cut = F.substring(F.col(html_col), F.col("_at.first") + 1, F.col("_at.behind") - F.col("_at.first"))
    return found.withColumn(out, cut).withColumn(error, F.col("_at.error")).drop("_at")


def header_fields(text: Column) -> Column:
    """The header block's ``NAME: value`` lines as a map, names in upper case with ``_`` between words (of a repeated
    name the first line counts; null without a block)."""
    block = F.regexp_extract(text, r"(?is)<SEC-HEADER>(.*?)</SEC-HEADER>", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda s: F.instr(s, ":") > 1)
    name = lambda s: F.upper(F.regexp_replace(F.trim(F.regexp_extract(s, r"^([^:]*):", 1)), r"[^A-Za-z0-9]+", "_"))
    value = lambda s: F.regexp_replace(F.regexp_extract(s, r"^[^:]*:(.*)$", 1), r"^\s+|\s+$", "")
    names = F.transform(lines, name)
    entries = F.filter(F.transform(lines, lambda s, i: F.struct(name(s).alias("k"), value(s).alias("v"), i.alias("i"))),
                       lambda e: F.array_position(names, e["k"]) == e["i"] + 1)
    fields = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], e["v"])))
    return F.when(text.rlike(r"(?is)<SEC-HEADER>.*?</SEC-HEADER>"), fields)


def filing_headers(df: DataFrame, text_col: str) -> DataFrame:
    """The input with ``fields`` (the header's map), ``form`` and ``filed`` (date; null where it is none)."""
    d = df.withColumn("fields", header_fields(F.col(text_col)))
    return (d.withColumn("form", F.col("fields")["CONFORMED_SUBMISSION_TYPE"])
             .withColumn("filed", F.try_to_timestamp(F.col("fields")["FILED_AS_OF_DATE"], F.lit("yyyyMMdd")).cast("date")))
