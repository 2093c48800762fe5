"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 7).

A text longer than ``leaf_chars`` is cut into halves, again and again, the halves are
encoded on their own and joined pairwise. A join looks for the last place in the left
half and the first in the right where the split pattern parts the text whatever stands
around it (``STABLE``), in windows around the cut that double until both sides have
one; what lies between is encoded anew and replaces the tokens on both sides, and
everything beyond is as in the encoding of the whole.

Runs longer than ``run_chars`` that the pattern cannot split are joined token by token:
a window of tokens around the cut is encoded anew and doubles until it begins and ends
with the very tokens the two sides have there. That is exact: a token sequence is the
BPE encoding of a run if and only if every two adjacent tokens are the encoding of
their own concatenation; inside the window this holds by construction, and a window
whose first and last tokens agree leaves every pair across its edges as it was.

In a text longer than ``long_chars`` the leaves become rows, so all executors share one
huge text. The lengths decide where work is done, not what comes out.

Defined results: null, empty texts -> empty list. Strings of special tokens are
ordinary text. Rows are kept as they are, replayed ones too; the id column need
not be unique or non-null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed package of public vocabularies keeps ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def join_halves(enc, left: list[int], right: list[int], window: int = 8) -> list[int]:
    """The encoding of one unsplit run from the encodings of its two parts."""
    if not left or not right:
        return left + right
    while True:
        a, b = left[-window:], right[:window]
        mid = enc._encode_single_piece(enc.decode_bytes(a + b))
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        if (whole_left or mid[0] == a[0]) and (whole_right or mid[-1] == b[-1]):
            return left[: len(left) - len(a)] + mid + right[len(b) :]
        window *= 2


def encode_run(enc, run: str, leaf_chars: int) -> list[int]:
    """Tree concatenation of one run inside one process."""
    if len(run) <= leaf_chars:
        return enc._encode_single_piece(run)
    half = len(run) // 2
    return join_halves(enc, encode_run(enc, run[:half], leaf_chars), encode_run(enc, run[half:], leaf_chars))


#: Between a letter or digit and a blank with a letter or a mark the pattern always parts, and looks neither back nor ahead.
STABLE = regex.compile(r"(?<=[\p{L}\p{N}])(?= \p{L}|[^\s\p{L}\p{N}'])")


def _token_tail(enc, ids: list[int], text: str) -> int:
    """How many of the last tokens spell ``text``."""
    left, n = len(text.encode()), 0
    while left > 0:
        n += 1
        left -= len(enc.decode_single_token_bytes(ids[-n]))
    assert left == 0, "no token boundary at a stable place"
    return n


def join_texts(enc, left_text: str, left: list[int], right_text: str, right: list[int], window: int = 64) -> list[int]:
    """The encoding of ``left_text + right_text`` from the encodings of both."""
    while True:
        a, b = max(0, len(left_text) - window), min(window, len(right_text))
        last = None
        for last in STABLE.finditer(left_text, a):
            pass
        first = STABLE.search(right_text, 0, b)
        if (last or a == 0) and (first or b == len(right_text)):
            break
        window *= 2
    cut = last.start() if last else 0
    end = first.start() if first else len(right_text)
    keep = len(left) - _token_tail(enc, left, left_text[cut:])
    drop = len(right) - _token_tail(enc, right, right_text[end:])
    return left[:keep] + enc.encode_ordinary(left_text[cut:] + right_text[:end]) + right[drop:]


def encode_text(enc, text: str, leaf_chars: int) -> list[int]:
    """Tree concatenation of one text inside one process."""
    if len(text) <= leaf_chars:
        return enc.encode_ordinary(text)
    half = len(text) // 2
    a, b = text[:half], text[half:]
    return join_texts(enc, a, encode_text(enc, a, leaf_chars), b, encode_text(enc, b, leaf_chars))


def encode_whole(enc, text: str, leaf_chars: int, run_chars: int) -> list[int]:
    """The encoding of a text of any kind: long runs apart, all else by ``encode_text``."""
    if len(text) <= min(leaf_chars, run_chars):
        return enc.encode_ordinary(text)
    if not regex.search(rf"\S{{{run_chars}}}|\s{{{run_chars}}}", text):
        return encode_text(enc, text, leaf_chars)
    out: list[int] = []
    for is_run, part in _segments(text, run_chars, run_chars):
        out += encode_run(enc, part, leaf_chars) if is_run else encode_text(enc, part, leaf_chars)
    return out


def _segments(text: str, run_chars: int, block_chars: int) -> Iterator[tuple[bool, str]]:
    """(is one pre-token, text) in order; cuts lie between pre-tokens only.

    The pattern looks ahead from white space, so a part that is split again never
    ends in it: cuts wait for the next pre-token after a word, and white space before
    a long run stands alone, one pre-token at a time.
    """
    start = last = 0
    blanks: list[tuple[int, int]] = []  # white-space pre-tokens since the last word
    for m in regex.finditer(PATTERN, text):
        s, e = m.span()
        if e - s > run_chars:
            word_end = blanks[0][0] if blanks else s
            if word_end > start:
                yield False, text[start:word_end]
            for x, y in blanks:
                yield True, text[x:y]
            yield True, text[s:e]
            start, blanks = e, []
        else:
            if s - start >= block_chars and not blanks:
                yield False, text[start:s]
                start = s
            blanks = [*blanks, (s, e)] if text[s:e].isspace() else []
        last = e
    if last > start:
        yield False, text[start:last]


def encode_corpus(
    df: DataFrame,
    text: str = "text",
    *,
    path: str | None = None,
    out: str = "ids",
    long_chars: int = 200_000,
    run_chars: int = 2_000,
    leaf_chars: int = 1_000,
    count_only: bool = False,
) -> DataFrame:
    """``df`` with ``out``: array<int> of token ids, or their number with ``count_only``.

    The vocabulary is read from ``path`` once in each Python worker. ``out``
    replaces a column of that name.
    """
    path = path or vocabulary_path()
    kind = "int" if count_only else "array<int>"

    @F.pandas_udf(kind)
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in parts:
            ids = (encode_whole(enc, t, leaf_chars, run_chars) if t else [] for t in s)
            yield pd.Series([len(x) for x in ids] if count_only else list(ids), index=s.index, dtype="int32" if count_only else object)

    short = df.where(F.col(text).isNull() | (F.length(text) <= long_chars)).withColumn(out, encode(text))
    result = [c for c in df.columns if c != out] + [out]
    long = _encode_long(df.where(F.length(text) > long_chars), text, path, out, 10 * run_chars)
    if count_only:
        long = long.withColumn(out, F.size(out))
    return short.select(*result).unionByName(long.select(*result))


def _encode_long(df: DataFrame, text: str, path: str, out: str, run_chars: int, rounds: int = 2) -> DataFrame:
    """Encode texts above the limit with their pieces spread over all tasks."""
    row = F.struct(*[F.col(c) for c in df.columns if c != out])
    # equal texts share one encoding
    keyed = df.select(row.alias("_row"), F.col(text).alias("_text"), F.sha2(F.col(text), 256).alias("_key"))

    def pieces(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for key, t in zip(pdf["_key"], pdf["_text"]):
                rows = []
                for seq, (is_run, part) in enumerate(_segments(t, run_chars, run_chars)):
                    step = run_chars if is_run else len(part)
                    rows += [(key, seq, i, part[o : o + step], is_run) for i, o in enumerate(range(0, len(part), step))]
                yield pd.DataFrame(rows, columns=["_key", "_seq", "_leaf", "_part", "_run"])

    def leaves(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in it:
            ids = [enc._encode_single_piece(p) if run else enc.encode_ordinary(p) for p, run in zip(pdf["_part"], pdf["_run"])]
            yield pdf[["_key", "_seq", "_leaf"]].assign(_ids=ids)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        enc, parts = encoder(path), list(pdf.sort_values("_leaf")["_ids"].map(list))
        while len(parts) > 1:
            parts = [join_halves(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        first = pdf.iloc[0]
        return pd.DataFrame({"_key": [first["_key"]], "_seq": [first["_seq"]], "_leaf": [int(pdf["_leaf"].min()) // 64], "_ids": [parts[0]]})

    schema = "_key string, _seq int, _leaf int, _ids array<int>"
    parts = (
        keyed.dropDuplicates(["_key"])
        .mapInPandas(pieces, "_key string, _seq int, _leaf int, _part string, _run boolean")
        .repartition("_key", "_seq", "_leaf")
        .mapInPandas(leaves, schema)
    )
    for _ in range(rounds):  # 64 leaves to a join; the last join takes what two rounds leave
        parts = parts.groupBy("_key", "_seq", F.floor(F.col("_leaf") / 64).alias("_up")).applyInPandas(lambda _, pdf: joined(pdf), schema)
    parts = parts.groupBy("_key", "_seq").applyInPandas(lambda _, pdf: joined(pdf), schema)
    whole = parts.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_seq", "_ids"))).alias("_s"))
    whole = whole.select(F.col("_key"), F.flatten(F.col("_s._ids")).alias(out))
    return keyed.join(whole, "_key", "left").select("_row.*", F.coalesce(F.col(out), F.array().cast("array<int>")).alias(out))
