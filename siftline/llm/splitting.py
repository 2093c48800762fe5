"""Splitting oversized items at natural boundaries (problem 5).

The size of a text is its number of words, runs of characters other than space,
tab, CR and LF. The start offset of each word is the prefix table from tokens to
characters; paragraph, sentence and clause ends are sorted arrays of word
indexes. A piece of at least half the limit ends at the last paragraph end not beyond
the limit, else the last sentence end, else the last clause end, each found by binary
search, else by a hard cut at the limit. The next piece begins ``overlap`` words before that end.

Only texts above their limit leave the JVM: the word count is a Spark expression.

Defined results: null and empty texts, and texts not above the limit, come out as
one piece; a null or non-positive limit means no limit; null or negative overlap
is 0 and an overlap that is not below the limit is one less than the limit, so pieces
always advance. Every word of the text lies in at least one piece and
``text[start_offset:end_offset]`` is the piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^ \t\r\n]+")
#: Where a piece may end, best first.
BOUNDARIES = {
    "paragraph": re.compile(r"\n[ \t\r]*\n\s*"),
    "sentence": re.compile(r"[.!?…。！？][\"'”’)\]]*(?=\s)|\r?\n"),
    "clause": re.compile(r"[,;:](?=\s)"),
}


def word_count(c: Column) -> Column:
    """Number of words, in the JVM; 0 for null and blank texts."""
    inner = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[ \t\r\n]+")))


def boundary_table(text: str, starts: np.ndarray) -> np.ndarray:
    """One ascending array of all boundaries: kind * (words + 1) + the words before it."""
    width = len(starts) + 1
    kinds = []
    for kind, pattern in enumerate(BOUNDARIES.values()):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        kinds.append(kind * width + np.unique(np.searchsorted(starts, ends)))
    return np.concatenate(kinds)


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """(start, end, words, overlap with the piece before in characters, boundary) of each piece."""
    spans = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
    n = len(spans)
    if limit is None or limit <= 0 or n <= limit:
        return [(0, len(text), n, 0, "whole")]
    overlap = min(max(overlap or 0, 0), limit - 1)
    shortest = max(limit // 2, overlap + 1)
    table, names = boundary_table(text, spans[:, 0]), list(BOUNDARIES)
    kinds = np.arange(len(names)) * (n + 1)
    cuts = [(0, 0, "")]  # (first word, end word, boundary) of each piece, after a start
    first = 0
    while first + limit < n:
        # the last boundary of each kind within the limit, by one search each
        at = table[np.maximum(np.searchsorted(table, kinds + first + limit, side="right") - 1, 0)] - kinds if len(table) else kinds - 1
        good = np.flatnonzero((at >= first + shortest) & (at <= first + limit))
        end, name = (int(at[good[0]]), names[good[0]]) if len(good) else (first + limit, "hard")
        cuts.append((first, end, name))
        first = end - overlap
    cuts.append((first, n, "end"))
    out = []
    for (_, before, _), (first, end, name) in zip(cuts, cuts[1:]):
        a, b = int(spans[first, 0]), int(spans[end - 1, 1])
        out.append((a, b, end - first, max(0, int(spans[before - 1, 1]) - a) if before else 0, name))
    return out


def split_oversized(df: DataFrame, *, id: str = "id", text: str = "text", limit: str = "chunk_size", overlap: str = "chunk_overlap") -> DataFrame:
    """Pieces of every row: id, piece, text, token_count, start_offset, end_offset, overlap_prev_chars, boundary."""
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(limit).cast("int").alias("lim"), F.col(overlap).cast("int").alias("ov"), word_count(F.col(text)).alias("words"))
    above = F.coalesce((F.col("lim") > 0) & (F.col("words") > F.col("lim")), F.lit(False))
    whole = rows.where(~above).select(
        "id", F.lit(0).alias("piece"), "text", F.col("words").alias("token_count"), F.lit(0).alias("start_offset"), F.coalesce(F.length("text"), F.lit(0)).alias("end_offset"), F.lit(0).alias("overlap_prev_chars"), F.lit("whole").alias("boundary"),
    )

    columns = whole.columns

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for key, t, lim, ov in zip(pdf["id"], pdf["text"], pdf["lim"], pdf["ov"]):
                ov = 0 if ov is None or ov != ov else int(ov)
                out += [(key, i, t[a:b], w, a, b, o, k) for i, (a, b, w, o, k) in enumerate(split_text(t, int(lim), ov))]
            yield pd.DataFrame(out, columns=columns)

    kind = dict(rows.dtypes)["id"]
    cuts = rows.where(above).select("id", "text", "lim", "ov").mapInPandas(cut, f"id {kind}, piece int, text string, token_count int, start_offset int, end_offset int, overlap_prev_chars int, boundary string")
    return whole.unionByName(cuts)
