"""Splitting oversized items at natural boundaries, with overlap between consecutive pieces.

One packer serves both kinds of items. An item is a run of positions lo..hi; a cut at p ends a piece
at p - 1. Cut positions come in levels, from the most natural (sections, given split lines) to the
least (words); below the last level every position can be cut. A piece that still fits takes in as
much as it can: the recursion tries the highest level first and goes one level down only where no
cut of that level is in reach. The next piece starts ``overlap`` positions before the cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text levels, from the highest to the lowest: a cut is where a match ends or, for sections, begins.
SECTION = re.compile(r"^(?=\\(?:part|chapter|section|subsection|subsubsection|bibliography)\b|#{1,6} |<(?:section|article|h[1-6])\b)", re.M)
PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
SENTENCE = re.compile(r"[.!?…]+[\"')\]}”’]*\s+|[。！？]")
WORD = re.compile(r"\s+")


#: Pieces, and characters in them, that a worker holds before it hands them on.
CHUNK_PIECES, CHUNK_CHARACTERS = 20_000, 16_000_000


def _frames(rows: Iterator[tuple], columns: list[str], text: int | None = None) -> Iterator[pd.DataFrame]:
    """Rows in frames of bounded size; ``text`` is the place of a text column."""
    out, n = [], 0
    for r in rows:
        out.append(r)
        n += len(r[text]) if text is not None else 0
        if len(out) >= CHUNK_PIECES or n >= CHUNK_CHARACTERS:
            yield pd.DataFrame(out, columns=columns)
            out, n = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns)


def _best_cut(levels: Sequence[Sequence[int]], depth: int, after: int, upto: int) -> tuple[int, int]:
    """The last cut in (after, upto] of the highest level that has one: (position, level)."""
    if depth == len(levels):
        return upto, depth
    cuts = levels[depth]
    k = bisect_right(cuts, upto)
    if k and cuts[k - 1] > after:
        return cuts[k - 1], depth
    return _best_cut(levels, depth + 1, after, upto)


def pack(lo: int, hi: int, limit: int, overlap: int, levels: Sequence[Sequence[int]]) -> Iterator[tuple[int, int, int]]:
    """Pieces (first, last, level of the cut that ends it; -1 for the last piece) of lo..hi.

    Every piece holds at most ``limit`` positions, shared ones included. A cut is taken only if the
    next piece begins later than this one. An overlap of ``limit`` or more leaves no room to advance
    and is lowered to ``limit - 1``; a negative one counts as 0; limit must be at least 1.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    overlap = max(0, min(overlap, limit - 1))
    start = lo
    while hi - start + 1 > limit:
        # the cut must lie behind the shared positions, and behind lo so that no piece is empty
        p, level = _best_cut(levels, 0, start + overlap, start + limit)
        yield start, p - 1, level
        start = max(p - overlap, lo)
    if hi >= start:
        yield start, hi, -1


def parse_range(text: str, lo: str, hi: str) -> tuple:
    """Columns of the first and last index of a range given as text ('3:9', '3:1:9', 'UnitRange(3, 9)',
    any blanks) or as two integers; the integers hold where both are there."""
    nums = F.regexp_extract_all(F.col(text), F.lit(r"(-?\d+)"), 1)
    n = F.size(nums)
    a = F.when(n >= 2, F.try_element_at(nums, F.lit(1)).try_cast("long"))
    b = F.when(n >= 2, F.try_element_at(nums, F.lit(-1)).try_cast("long"))
    return F.coalesce(F.col(lo).cast("long"), a), F.coalesce(F.col(hi).cast("long"), b)


def range_items(df: DataFrame) -> DataFrame:
    """One row for each range of the rectangles: domain_id, grid_id, axis, lo, hi, max_len, overlap_len.

    Rectangles delivered repeatedly count once (of differing values the greatest holds). Ranges whose
    ends are given nowhere, whose limit is null or below 1, and null ids are left out; a null overlap
    counts as 0.
    """
    xa, xb = parse_range("xrange", "i_lo", "i_hi")
    ya, yb = parse_range("yrange", "j_lo", "j_hi")
    parsed = df.select("domain_id", "grid_id", "max_len", F.coalesce("overlap_len", F.lit(0)).alias("overlap_len"), xa.alias("xa"), xb.alias("xb"), ya.alias("ya"), yb.alias("yb"))
    one = parsed.groupBy("domain_id").agg(*[F.max(c).alias(c) for c in ("grid_id", "max_len", "overlap_len", "xa", "xb", "ya", "yb")])
    long = one.select("domain_id", "grid_id", "max_len", "overlap_len", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("xa").alias("lo"), F.col("xb").alias("hi")), F.struct(F.lit("y").alias("axis"), F.col("ya").alias("lo"), F.col("yb").alias("hi")))).alias("r"))
    return long.select("domain_id", "grid_id", "r.axis", "r.lo", "r.hi", "max_len", "overlap_len").filter("domain_id is not null and lo is not null and hi is not null and max_len >= 1")


def split_ranges(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Pieces of all ranges longer than their limit, cut at the split lines of their grid and axis.

    Result: domain_id, axis, piece (from 1), lo, hi, cut_kind ('line', 'forced' or 'last': how the
    piece ends). Ranges within the limit and empty ranges (lo > hi) have no rows; lines at null
    positions and repeated lines do not matter; a grid without lines is cut by force. A grid has at
    most as many lines as rows or columns, so its list of them fits one row.
    """
    long = items.filter("hi - lo + 1 > max_len")
    per = lines.filter("pos is not null").groupBy("grid_id", "axis").agg(F.array_sort(F.collect_set("pos")).alias("cuts"))
    joined = long.join(per, ["grid_id", "axis"], "left").select("domain_id", "axis", "lo", "hi", "max_len", "overlap_len", "cuts")

    def pieces(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                cuts = [] if r.cuts is None else list(map(int, r.cuts))
                for k, (a, b, level) in enumerate(pack(int(r.lo), int(r.hi), int(r.max_len), int(r.overlap_len), [cuts])):
                    yield r.domain_id, r.axis, k + 1, a, b, ("line", "forced")[level] if level >= 0 else "last"

    columns = ["domain_id", "axis", "piece", "lo", "hi", "cut_kind"]
    return joined.mapInPandas(lambda b: _frames(pieces(b), columns), "domain_id long, axis string, piece long, lo long, hi long, cut_kind string")


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """'clean' or 'forced' for each split range. Packing takes the last line in reach, after which a
    range can be cut at lines alone exactly if no cut had to be forced."""
    worst = F.max(F.when(F.col("cut_kind") == "forced", 1).otherwise(0))
    return pieces.groupBy("domain_id", "axis").agg(worst.alias("w")).select("domain_id", "axis", F.when(F.col("w") == 1, "forced").otherwise("clean").alias("cut_kind"))


def text_levels(text: str) -> list[list[int]]:
    """Cut positions of a text by level: sections, paragraphs, sentences, words."""
    return [[m.start() for m in SECTION.finditer(text)]] + [[m.end() for m in p.finditer(text)] for p in (PARAGRAPH, SENTENCE, WORD)]


LEVEL_NAMES = ("section", "paragraph", "sentence", "word", "character")


def split_texts(docs: DataFrame, id_col: str, text_col: str, limit: int, overlap: int) -> DataFrame:
    """Pieces of all texts, whole: id, piece (from 1), start (from 0), piece_text, cut_kind.

    ``limit`` and ``overlap`` are in characters. cut_kind names the boundary at which the piece ends
    ('end' for the last). A text within the limit is one piece; null and empty texts give none.
    Leaving out the shared characters, the pieces of a text joined together are the text.
    """

    def pieces(batches):
        for pdf in batches:
            for key, text in zip(pdf["k"], pdf["t"], strict=True):
                if text is None or text == "":
                    continue
                levels = text_levels(text) if len(text) > limit else []
                for k, (a, b, level) in enumerate(pack(0, len(text) - 1, limit, overlap, levels)):
                    yield key, k + 1, a, text[a : b + 1], LEVEL_NAMES[level] if level >= 0 else "end"

    columns = ["k", "piece", "start", "piece_text", "cut_kind"]
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    return rows.mapInPandas(lambda b: _frames(pieces(b), columns, 3), f"k {kind}, piece long, start long, piece_text string, cut_kind string").withColumnRenamed("k", id_col)
