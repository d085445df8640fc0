"""Fill-in-the-middle (operator 12): displacement scatter over the bytes of a batch of texts.

A text is a run of lines (each with its newline). Two cuts between lines give prefix, middle and suffix, which the
output holds in another order behind markers. Per batch the cuts are scanned from the newline bytes; a difference array
holds, at each part's first byte, by how much the shift of its bytes differs from the shift of the part before; its
cumulative sum is every byte's way to its place in the output, and one scatter builds all outputs of the batch.
Restoring finds the markers, forms the same differences and gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import flat_bytes, small_batches
from riskweave.plans.registry import register
from riskweave.sources.tables import read_table

# The three markers have this form, with letters P (prefix), S (suffix) and M (middle).
MARKER = b"<%c>"
WIDTH = 3
PLAIN, PSM, SPM = "plain", "psm", "spm"


def texts_of(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The column whose texts' bytes stand one after another in ``flat``."""
    binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1,
                                              [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(flat)])
    return binary.cast(pa.large_string())


def markers(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The markers inside texts: (number of the text, position in flat, letter), by position."""
    at = np.flatnonzero(flat[:-2] == ord("<")) if len(flat) > 2 else np.zeros(0, dtype=np.int64)
    at = at[(flat[at + 2] == ord(">")) & np.isin(flat[at + 1], np.frombuffer(b"PSM", dtype=np.uint8))]
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + WIDTH <= starts[text + 1]
    at, text = at[inside], text[inside]
    return text, at, flat[at + 1]


def ways(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Where each of ``size`` bytes goes. ``parts``: (first byte, length, place of the first byte), which together hold
    every byte once. Between two parts' first bytes the shift stays, so only its differences are set."""
    at, length, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
    held = length > 0
    order = np.argsort(at[held], kind="stable")
    at, shift = at[held][order], (place[held] - at[held])[order]
    kind = np.int32 if size < 1 << 30 else np.int64
    step = np.zeros(size, dtype=kind)
    step[at] = np.diff(shift, prepend=0)
    way = np.cumsum(step, dtype=kind)
    way += np.arange(size, dtype=kind)
    return way


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def cut_and_move(flat: np.ndarray, starts: np.ndarray, hashes: np.ndarray, middle_rate: int, spm_rate: int):
    """For texts with four hash numbers each: (units, forms, code points of prefix and of middle, output bytes, their
    starts). Forms are 0 plain, 1 psm, 2 spm."""
    n_texts = len(starts) - 1
    size = np.diff(starts)
    newline = np.flatnonzero(flat == ord("\n"))
    upto = np.searchsorted(newline, starts)  # newlines before each text
    lines = np.diff(upto)
    ends_open = np.zeros(n_texts, dtype=np.int64)
    full = np.flatnonzero(size > 0)
    ends_open[full] = flat[starts[1:][full] - 1] != ord("\n")
    units = lines + ends_open
    first, second = hashes[:, 0] % (units + 1), hashes[:, 1] % (units + 1)
    bounds = np.concatenate([newline, [0]])

    def cut(k: np.ndarray) -> np.ndarray:
        """The byte behind the first k units of each text."""
        behind = bounds[np.minimum(upto[:-1] + k - 1, len(newline))] + 1
        return np.where(k == 0, starts[:-1], np.where(k > lines, starts[1:], behind))

    a, b = cut(np.minimum(first, second)), cut(np.maximum(first, second))
    plain = (size == 0) | (hashes[:, 2] % 100 >= middle_rate)
    plain[markers(flat, starts)[0]] = True
    form = np.where(plain, 0, np.where(hashes[:, 3] % 100 < spm_rate, 2, 1))
    begin, end = starts[:-1], starts[1:]
    prefix, middle, suffix = a - begin, b - a, end - b
    out_starts = _starts(size + np.where(plain, 0, 3 * WIDTH))
    out = out_starts[:-1]
    # Places of the parts: plain keeps them, psm is P prefix S suffix M middle, spm is S suffix P prefix M middle.
    place_p = np.choose(form, [out, out + WIDTH, out + 2 * WIDTH + suffix])
    place_s = np.choose(form, [out + prefix + middle, out + 2 * WIDTH + prefix, out + WIDTH])
    place_m = np.choose(form, [out + prefix, out + 3 * WIDTH + prefix + suffix, out + 3 * WIDTH + prefix + suffix])
    moved = np.empty(int(out_starts[-1]), dtype=np.uint8)
    moved[ways([(begin, prefix, place_p), (a, middle, place_m), (b, suffix, place_s)], len(flat))] = flat
    for place, letter in ((place_p, b"P"), (place_s, b"S"), (place_m, b"M")):
        for i, byte in enumerate(MARKER % letter):
            moved[place[~plain] - WIDTH + i] = byte
    lead = _starts((flat & 0xC0) != 0x80)  # code points before each byte
    return units, form, lead[a] - lead[begin], lead[b] - lead[a], moved, out_starts


def move_back(moved: np.ndarray, out_starts: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and starts from outputs and whether each is plain, nothing else."""
    text, at, letter = markers(moved, out_starts)
    other = ~plain[text]
    text, at, letter = text[other], at[other], letter[other]
    found = np.full((256, len(plain)), -1, dtype=np.int64)
    found[letter, text] = at
    p, s, m = found[ord("P")], found[ord("S")], found[ord("M")]
    if (found[[ord("P"), ord("S"), ord("M")]][:, ~plain] < 0).any() or len(text) != 3 * int((~plain).sum()):
        raise ValueError("an output that is not plain must hold each marker once")
    begin, end = out_starts[:-1], out_starts[1:]
    psm = p < s
    # A plain output is one part, here called the prefix.
    at_p, len_p = np.where(plain, begin, p + WIDTH), np.where(plain, end - begin, np.where(psm, s, m) - p - WIDTH)
    at_s, len_s = s + WIDTH, np.where(plain, 0, np.where(psm, m, p) - s - WIDTH)
    at_m, len_m = m + WIDTH, np.where(plain, 0, end - m - WIDTH)
    starts = _starts(len_p + len_m + len_s)
    place = starts[:-1]
    way = ways([(place, len_p, at_p), (place + len_p, len_m, at_m), (place + len_p + len_m, len_s, at_s)], int(starts[-1]))
    return moved[way], starts


def fill_middle(documents: DataFrame, seed: int = 7, middle_rate: int = 100, spm_rate: int = 50,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output``, one row per input row.

    ``n``: lines of the text. The four hash numbers of a row are the first 8-digit groups of the hex sha256 of
    ``seed:id``; the first two choose the cuts, the third whether the text is moved at all (``middle_rate`` percent),
    the fourth the form (``spm_rate`` percent spm, else psm). Texts that are empty or hold a marker stay plain, with null
    lengths. A null text is an empty one; a null id hashes as no digits. Repeated rows give equal results."""
    spark = documents.sparkSession
    small_batches(spark)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]
    rows = documents.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), digest.alias("_digest"))
    rows = rows.select(F.col(id_col), "_text", *numbers)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([PLAIN, PSM, SPM])
        for b in batches:
            if not b.num_rows:
                continue
            hashes = np.stack([b.column(2 + i).to_numpy() for i in range(4)], axis=1)
            units, form, prefix, middle, moved, starts = cut_and_move(*flat_bytes(b.column(1)), hashes, middle_rate, spm_rate)
            plain = form == 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(units), pa.array(names[form].tolist(), pa.string()), pa.array(prefix, mask=plain),
                 pa.array(middle, mask=plain), texts_of(moved, starts).cast(pa.string())],
                names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(move, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n long, form string, prefix_chars long, "
                                 "middle_chars long, output string")


def restore_text(outputs: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "restored") -> DataFrame:
    """The input's rows and columns with ``text_col`` added: the exact text, from output and form alone. A null output
    gives a null text; a null form counts as plain. An output that is not plain without each marker once is an error."""
    small_batches(outputs.sparkSession)

    @F.arrow_udf("string")
    def back(moved: pa.Array, form: pa.Array) -> pa.Array:
        if not len(moved):
            return pa.array([], pa.string())
        null = np.asarray(moved.is_null())
        plain = np.array([f in (None, PLAIN) for f in form.to_pylist()]) | null
        text = texts_of(*move_back(*flat_bytes(moved.fill_null("")), plain)).cast(pa.string())
        return pa.array([None if z else t for z, t in zip(null, text.to_pylist(), strict=True)], pa.string()) if null.any() else text

    return outputs.withColumn(text_col, back(F.col(output_col), F.col(form_col)))


@register("op12_fill_middle", sql=r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
nums AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM cut),
parts AS (
  SELECT doc_id, t, n,
         array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM nums)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts""")
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore_text(fill_middle(read_table(spark, sf_dir, "documents"), seed=7, middle_rate=100, spm_rate=50))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
