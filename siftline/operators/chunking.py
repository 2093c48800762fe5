"""Token chunks with overlap at paragraph and sentence ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import TOKEN, tokens

TOKEN_RE = regex.compile(TOKEN)
PARAGRAPH_END = regex.compile(r"\n[ \t]*\n\s*")
SENTENCE_END = regex.compile(r"[.!?][\"')\]]*(?=\s)")


def token_offsets(text: Column) -> Column:
    """array<int>: start of each token; the tokens part the text without loss."""
    start = F.aggregate(tokens(text), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, t: F.struct((s["at"] + F.length(t)).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])
    return start


def estimate_chunks(n_tokens: Column, size: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), n_tokens - overlap) / max(1, size - overlap)).cast("int"))


def fixed_windows(n_tokens: Column, size: int, overlap: int) -> Column:
    """array<struct<start,end>>: windows of ``size`` tokens that share ``overlap``."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n_tokens - size) / step).cast("int"))
    return F.when(n_tokens <= 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n_tokens).alias("end"))))


def boundary_ranks(text: str, starts: np.ndarray) -> np.ndarray:
    """What begins at each token: 2 a paragraph, 1 a sentence, 0 neither; one more place for the end of the text."""
    rank = np.zeros(len(starts) + 1, np.int8)
    for value, pattern in ((1, SENTENCE_END), (2, PARAGRAPH_END)):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        rank[np.searchsorted(starts, ends)] = value
    return rank


def split_tokens(text: str, size: int, overlap: int) -> list[tuple[int, ...]]:
    """(start token, end token, start, end, overlap tokens, overlap characters) of each chunk."""
    starts = np.fromiter((m.start() for m in TOKEN_RE.finditer(text)), np.int64)
    if not len(starts):
        return []
    rank, at = boundary_ranks(text, starts), np.append(starts, len(text))
    shortest = max(size // 2, overlap + 1)
    first, last = [0], []
    while first[-1] + size < len(starts):
        window = rank[first[-1] + shortest : first[-1] + size + 1][::-1]
        last.append(first[-1] + size - int(window.argmax()))  # of the highest rank the last place; of none the full size
        first.append(last[-1] - overlap)
    last.append(len(starts))
    shared = [0, *(e - s for e, s in zip(last, first[1:]))]
    chars = [0, *(int(at[e] - at[s]) for e, s in zip(last, first[1:]))]
    return [(s, e, int(at[s]), int(at[e]), n, c) for s, e, n, c in zip(first, last, shared, chars)]


def chunk_spans(df: DataFrame, *, text: str = "text", size: int = 512, overlap: int = 64, keep: list[str] | None = None) -> DataFrame:
    """Chunks: kept columns, chunk_index, token and character ranges, overlap in tokens and characters, text.

    A chunk ends at the last paragraph end in (start + least - 1, start + size], else
    the last sentence end, else after ``size`` tokens; the next starts ``overlap``
    tokens before. One pass without a shuffle. Null and empty texts have no chunk.
    """
    if not 0 <= overlap <= size // 2:
        raise ValueError("overlap must lie between 0 and half of size")
    keep = [c for c in df.columns if c != text] if keep is None else keep
    kind = "array<struct<start_token:int,end_token:int,start_offset:int,end_offset:int,overlap_prev_tokens:int,overlap_prev_chars:int>>"

    @F.pandas_udf(kind)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: split_tokens(t, size, overlap))

    names = ("start_token", "end_token", "start_offset", "end_offset", "overlap_prev_tokens", "overlap_prev_chars")
    cut = df.where(F.length(text) > 0).select(*keep, F.col(text).alias("_t"), F.posexplode(spans(F.col(text))).alias("chunk_index", "_s"))
    return cut.select(*keep, "chunk_index", *[F.col(f"_s.{c}").alias(c) for c in names], F.substring("_t", F.col("_s.start_offset") + 1, F.col("_s.end_offset") - F.col("_s.start_offset")).alias("text"))


def token_histogram(counts: DataFrame, size: int, bins: int = 12) -> DataFrame:
    """(bin, n): equal bins on [0, size], the last one closed."""
    b = F.least(F.width_bucket(F.col("n"), F.lit(0.0), F.lit(float(size)), F.lit(bins)), F.lit(bins))
    return counts.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
