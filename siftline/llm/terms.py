"""Terms of texts: counts over the whole corpus and fixed-width term vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.blocks import SCHEMA, block_rows, n_tasks, sum_blocks

WORD = re.compile(r"[^\W\d_]{2,}")
SLOT_BITS = 20  # of the counters of terms


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Hashes(dict):
    """64-bit hashes of terms, kept between texts."""

    def __missing__(self, term: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[term] = x = xxhash.xxh64_intdigest(term)
        return x


_hashes = _Hashes()


def term_hashes(terms: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, terms), np.uint64, len(terms))


def slots(hashes: np.ndarray) -> np.ndarray:
    """The counter of each term."""
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def document_frequencies(df: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """(texts with a word, texts that hold a term, by counter) over all rows.

    Every term of every text counts, in 2 ** SLOT_BITS counters: a table of fixed size
    whatever the vocabulary. Terms that share a counter share its sum.
    """
    size = 1 << SLOT_BITS

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        for batch in it:
            found = [list(ws) for t in batch.column(0).to_pylist() if (ws := set(words(t)))]
            seen[size] += len(found)
            if found:
                seen[:size] += np.bincount(slots(term_hashes([w for ws in found for w in ws])), minlength=size)
        yield block_rows(seen.astype("<i8"), 8192)

    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    seen = sum_blocks(rows.mapInArrow(count, SCHEMA), "<i8", 8192, size + 1, n_tasks(rows))
    return int(seen[size]), seen[:size]


def sign_rows(hashes: np.ndarray, width: int = 128) -> np.ndarray:
    """One row of +1/-1 a term, its own hash bits: a random projection that needs no fitting."""
    out = np.empty((len(hashes), -(-width // 64)), np.uint64)
    for k in range(out.shape[1]):
        x = (hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    bits = np.unpackbits(out.view(np.uint8), axis=1)[:, :width]
    return (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(width))
