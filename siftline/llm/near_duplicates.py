"""Near-duplicate records with small edits (problem 2).

Texts are folded to words (case, spacing, list marks and punctuation do not
count) and equal ones become one class, of which one row goes on. MinHash values of
word shingles make band keys, which go on while their shingles are usual ones; texts
that share a key are candidates and are compared where they meet, by a second
signature, of words with multiplicity, in batches: after each batch a candidate is
dropped if the posterior probability that its similarity reaches ``least`` has fallen
below ``miss``. Survivors are verified exactly on their words. Linked classes
form groups by connected components.

A band key with more than ``block`` texts is not cut: its texts are laid out in
blocks and every pair of blocks is compared under a key of its own.

The similarity of two texts is the number of words they have in common, with
multiplicity, over the number of words of the longer: 1 less this is the least
share of words to be replaced, inserted or deleted when sentences may move freely.
``least_pairs`` of their word pairs must agree too, so shared vocabulary alone is
no link.

Defined results: null texts and texts without a word take no part; identical texts
have similarity 1; ids repeated with the same text count once; of an id with several
texts all take part; texts of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.blocks import SCHEMA, block_rows, n_tasks, sum_blocks
from siftline.llm.components import connected_components, pairs_of_groups
from siftline.sources.shared import materialize

HASHES, BATCH = 48, 16  # 48 hashes of 4 bits are compared 16, one word of 64 bits, at a time
SKETCH = HASHES // 2  # bytes
SLOT_BITS = 20  # of the counters of shingles
POSTS_A_TASK = 2_000_000


def fold_words(text: Column) -> Column:
    """Lower-case words with one space between; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


@lru_cache(maxsize=512)
def _coefficient(k: int) -> np.uint64:
    return np.random.Generator(np.random.PCG64([20240229, k])).integers(1, 2**64 - 1, dtype=np.uint64) | np.uint64(1)


def word_hashes(texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of each text) of folded texts; each distinct word of a batch is hashed once."""
    lists = pc.split_pattern(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), " ")
    words = lists.flatten().dictionary_encode()
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return ids[words.indices.to_numpy()], np.diff(lists.offsets.to_numpy()).astype(np.int64)


def shingles(words: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all word shingles, number of each text) from ``word_hashes``; every text has at least one."""
    flat, lens = words
    flat = np.concatenate([flat, np.zeros(size - 1, np.uint64)])
    total = lens.sum()
    h = np.zeros(total, np.uint64)
    own = np.repeat(np.cumsum(lens), lens)  # end of the text a position belongs to
    at = np.arange(total)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < own, flat[k : total + k], np.uint64(0))
    # a shingle starts where it fits; a short text has one from its first word
    starts = np.cumsum(lens) - lens
    fits = (at + size <= own) | (at == np.repeat(starts, lens))
    h = h[fits]
    h ^= h >> np.uint64(31)
    return h, np.add.reduceat(fits.astype(np.int64), starts)


def _least(h: np.ndarray, cut: np.ndarray, k: int) -> np.ndarray:
    """The least of the k-th of a family of 32-bit hashes over each run of ``h`` (well mixed)."""
    return np.minimum.reduceat((h * _coefficient(k)).view(np.uint32)[1::2], cut)


def shingle_slots(h: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def usual_shingles(texts: DataFrame, size: int, n: int, *, share: float = 0.001, least: int = 16) -> np.ndarray:
    """For each counter whether its shingles are usual: counted ``share`` times the number of texts, and ``least`` times.

    All shingles of all texts are counted in 2 ** SLOT_BITS counters, so neither the
    layout of files nor a bound on their number decides. Shingles that share a counter
    share its verdict, in every text alike.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in it:
            if batch.num_rows:
                total += np.bincount(shingle_slots(shingles(word_hashes(batch.column(0)), size)[0]), minlength=len(total))
        yield block_rows(total.astype("<i8"), 8192)

    rows = texts.select("words")
    seen = sum_blocks(rows.mapInArrow(count, SCHEMA), "<i8", 8192, 1 << SLOT_BITS, n_tasks(rows))
    return seen >= max(least, share * n)


def band_keys(words: tuple[np.ndarray, np.ndarray], size: int, usual: np.ndarray, bands: int, *, depth: int = 3, weight: float = 0.3) -> np.ndarray:
    """Keys of shape (bands, texts).

    A key is the least shingle of a text under the hash of the band; in every other band
    usual shingles come in with ``weight`` (their hashes are divided by it). Where the
    least one is usual, the key goes on with the least under a further hash, up to
    ``depth``. All of it depends on the shingle alone, so two texts go the same way as
    far as they agree. Weighted bands find edited copies with fewer chance meetings, the
    others variants of a passage that is in so many texts that all of it is usual.
    """
    h, counts = shingles(words, size)
    owner = np.repeat(np.arange(len(counts)), counts)
    common = usual[shingle_slots(h)]
    # usual and other shingles apart; texts without one of a kind keep the greatest value
    kinds = []
    for part in (common, ~common):
        doc = owner[part]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        kinds.append((h[part], first, doc[first]))

    def least(k: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
        two = []
        for x, first, doc in kinds:
            m = np.full(len(counts), 2**32 - 1, np.float64)
            if len(x):
                m[doc] = _least(x, first, k)
            two.append(m)
        won = two[0] / (weight if weighted else 1.0) < two[1]
        return np.where(won, two[0], two[1]).astype(np.uint64), won

    base = [least(100 + b, b % 2 == 1) for b in range(bands)]
    more = [least(200 + b, b % 2 == 1) for b in range(bands)]  # keys go on with those, each in a few bands
    out = np.empty((bands, len(counts)), np.uint64)
    for b in range(bands):
        key, on = np.full(len(counts), b + 1, np.uint64), np.ones(len(counts), bool)
        for d in range(depth):
            m, won = base[b] if d == 0 else more[(b + 2 * (d - 1) * (bands // 3)) % bands]
            step = (key ^ m) * np.uint64(0x9E3779B97F4A7C15)
            key = np.where(on, step ^ (step >> np.uint64(29)), key)
            on &= won
        out[b] = key
    return out


def sketches(words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash of the words with multiplicity, 4 bits a hash, uint64 of shape (HASHES / BATCH, texts).

    The n-th time a word stands in a text is an element of its own, so that texts which
    have ``least`` of the words of the longer in common have a Jaccard similarity of at
    least ``least / (2 - least)``, however edits are spread and sentences moved.
    """
    h, counts = words
    cut = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    order = np.argsort((doc << np.uint64(40)) | (h >> np.uint64(24)), kind="stable")
    g = h[order]
    new = np.r_[True, g[1:] != g[:-1]]
    new[cut] = True
    at = np.arange(len(g))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    g = (g + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(31)
    out = np.zeros((HASHES // BATCH, len(counts)), np.uint64)
    for k in range(HASHES):
        m = _least(g, cut, k).astype(np.uint64)
        m ^= (m >> np.uint64(11)) ^ (m >> np.uint64(19))
        out[k // BATCH] |= (m & np.uint64(15)) << np.uint64(4 * (k % BATCH))
    return out


@lru_cache(maxsize=8)
def least_matches(least_jaccard: float, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest matches that keep P(J >= least | matches) at ``miss``."""
    j = (np.arange(2000) + 0.5) / 2000  # uniform prior
    c = j + (1 - j) / 16  # a hash of four bits agrees by chance
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            logp = m * np.log(c) + (n - m) * np.log1p(-c)
            p = np.exp(logp - logp.max())
            if p[j >= least_jaccard].sum() / p.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


def surviving(s: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs that no batch prunes. ``s``: rows of sketches, one word a batch."""
    matches = np.zeros(len(a), np.int16)
    for k, need in enumerate(least):
        x = s[k][a] ^ s[k][b]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        matches += np.int16(BATCH) - np.bitwise_count(x & np.uint64(0x1111111111111111)).astype(np.int16)
        keep = matches >= need
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b


def words_agree(a: str, b: str, least: float, least_pairs: float) -> float | None:
    """The similarity of two folded texts, or None below the thresholds."""
    x, y = a.split(" "), b.split(" ")
    longer = max(len(x), len(y))
    if min(len(x), len(y)) < least * longer:
        return None
    same = sum((Counter(x) & Counter(y)).values()) / longer
    if same < least:
        return None
    if longer > 2:
        p, q = Counter(zip(x, x[1:])), Counter(zip(y, y[1:]))
        if sum((p & q).values()) < least_pairs * (longer - 1):
            return None
    return same


def _arrow(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _binary(x: np.ndarray) -> pa.Array:
    n, w = x.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = np.frombuffer(col.buffers()[2], np.uint8)
    first = np.frombuffer(col.buffers()[1], np.int32)[col.offset] if len(col) else 0
    return flat[first : first + len(col) * width].reshape(len(col), width)


def _pairs_by_size(starts: np.ndarray, sizes: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside every run, many runs of one size at a time."""
    for size in np.unique(sizes):
        if size < 2:
            continue
        i, j = np.triu_indices(size, 1)
        where = starts[sizes == size]
        step = max(1, most // len(i))
        for k in range(0, len(where), step):
            w = where[k : k + step, None]
            yield (w + i).ravel(), (w + j).ravel()


def _bucket_pairs(block: int, least: tuple[int, ...]):
    """Partitions sorted by key and h -> (key, h, sketch, part, other).

    ``part`` -1: a surviving pair (h, other). Else: an entry of a key above
    ``block``, to be met in blocks. A text under a key counts once. Memory holds one
    batch and one block.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SKETCH), np.uint8))
        keys, hs, sk = no
        spilled: tuple[int, int, int] | None = None  # key above the block size, its entries so far, the last of them

        def solve(keys, hs, sk) -> Iterator[pa.RecordBatch]:
            s = np.ascontiguousarray(np.ascontiguousarray(sk).view(np.uint64).T)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            found = [np.stack([hs[a], hs[b]], axis=1) for a, b in (surviving(s, a, b, least) for a, b in _pairs_by_size(starts, sizes)) if len(a)]
            if found:
                x = np.unique(np.concatenate(found), axis=0)
                yield _arrow(key=np.zeros(len(x), np.int64), h=x[:, 0], sketch=pa.array([None] * len(x), pa.binary()), part=np.full(len(x), -1, np.int32), other=x[:, 1])

        def spill(keys, hs, sk, begin: int) -> pa.RecordBatch:
            return _arrow(key=keys, h=hs, sketch=_binary(sk), part=((begin + np.arange(len(keys))) // block).astype(np.int32), other=np.zeros(len(keys), np.int64))

        for batch in it:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            hs = np.concatenate([hs, batch.column(1).to_numpy()])
            sk = np.concatenate([sk, _matrix(batch.column(2), SKETCH)])
            new = np.r_[spilled is None or (int(keys[0]), int(hs[0])) != spilled[::2], (keys[1:] != keys[:-1]) | (hs[1:] != hs[:-1])]
            keys, hs, sk = keys[new], hs[new], sk[new]
            if spilled:
                n = int((keys == spilled[0]).sum())
                if n:
                    yield spill(keys[:n], hs[:n], sk[:n], spilled[1])
                    spilled = (spilled[0], spilled[1] + n, int(hs[n - 1]))
                    keys, hs, sk = keys[n:], hs[n:], sk[n:]
                if not len(keys):
                    continue
                spilled = None
            last = int(np.searchsorted(keys, keys[-1]))  # entries of the last key may go on in the next batch
            runs = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[runs, len(keys)])
            small = np.repeat(sizes <= block, sizes)
            done = np.arange(len(keys)) < last
            if (done & small).any():
                yield from solve(keys[done & small], hs[done & small], sk[done & small])
            for s, n in zip(runs, sizes):
                if n > block and s < last:
                    yield spill(keys[s : s + n], hs[s : s + n], sk[s : s + n], 0)
            keys, hs, sk = keys[last:], hs[last:], sk[last:]
            if len(keys) > block:
                yield spill(keys, hs, sk, 0)
                spilled = (int(keys[0]), len(keys), int(hs[-1]))
                keys, hs, sk = no
        if len(keys):
            yield from solve(keys, hs, sk)

    return run


def candidate_links(texts: DataFrame, n: int, *, shingle: int, bands: int, least_jaccard: float, miss: float, block: int) -> DataFrame:
    """(a, b): hashes of distinct texts whose similarity no batch ruled out. ``texts``: h, words, one row for each of ``n`` texts."""
    shared = texts.sparkSession.sparkContext.broadcast(usual_shingles(texts, shingle, n))

    def post(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            h, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            if not len(h):
                continue
            words = word_hashes(batch.column(1).take(pa.array(first)))
            keys = band_keys(words, shingle, shared.value, bands)
            s = np.ascontiguousarray(sketches(words).T).view(np.uint8).reshape(len(h), SKETCH)
            yield _arrow(key=keys.ravel().view(np.int64), h=np.tile(h, bands), sketch=_binary(np.tile(s, (bands, 1))))

    posts = texts.select("h", "words").mapInArrow(post, "key bigint, h bigint, sketch binary")
    least = least_matches(least_jaccard, miss)
    schema = "key bigint, h bigint, sketch binary, part int, other bigint"
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * bands // POSTS_A_TASK))
    met = materialize(posts.repartition(tasks, "key").sortWithinPartitions("key", "h").mapInArrow(_bucket_pairs(block, least), schema), "met")
    pairs = met.where(F.col("part") < 0).select(F.col("h").alias("a"), F.col("other").alias("b"))

    # keys above the block size: every pair of blocks under its own key
    rest = met.where(F.col("part") >= 0).select("key", "h", "sketch", "part")
    blocks = rest.groupBy("key").agg((F.max("part") + 1).alias("n"))
    laid = rest.join(blocks, "key").select("key", "h", "sketch", "part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("with"))
    laid = laid.select("key", "h", "sketch", "part", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"))

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.ascontiguousarray(np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1).T)
        h, lo = pdf["h"].to_numpy(), (pdf["part"] == pdf["lo"]).to_numpy()
        same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        left, right = (np.arange(len(h)),) * 2 if same else (np.flatnonzero(lo), np.flatnonzero(~lo))
        out = []
        for i in left:
            js = right[right > i] if same else right
            a, b = surviving(s, np.full(len(js), i), js, least)
            out.append(np.stack([np.minimum(h[a], h[b]), np.maximum(h[a], h[b])], axis=1))
        x = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": x[:, 0], "b": x[:, 1]})

    more = laid.groupBy("key", "lo", "hi").applyInPandas(lambda _, pdf: cross(pdf), "a bigint, b bigint")
    return pairs.unionByName(more).where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Survivors up to this number are broadcast to pick their texts (8 bytes each); above it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def near_duplicate_links(
    df: DataFrame, *, id: str = "id", text: str = "text", shingle: int = 3, bands: int = 18,
    miss: float = 0.01, least: float = 0.8, least_pairs: float = 0.5, block: int = 2048,
) -> tuple[DataFrame, DataFrame]:
    """(members: id, class), (links: a, b, similarity between classes).

    Edits of a fifth of the words, spread evenly, leave no five-word shingle and two
    fifths of the three-word shingles, so shingles are of three words.
    """
    folded = df.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), fold_words(F.col(text)).alias("words")).where(F.col("words") != "")
    keyed = materialize(folded.select("id", F.unhex(F.md5("words")).alias("class"), F.xxhash64("words").alias("h"), "words"), "folded")
    members = keyed.select("id", "class").distinct()
    # of equal texts the row of the least id stands for all from here on
    copies = members.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    spare = materialize(members.join(copies, "class").where(F.col("id") != F.col("first")).select("id", "class"), "spare")
    distinct = keyed.join(F.broadcast(spare) if spare.count() <= BROADCAST_ROWS else spare, ["id", "class"], "left_anti")
    n = keyed.count() - spare.count()
    pairs = materialize(candidate_links(distinct.select("h", "words"), n, shingle=shingle, bands=bands, least_jaccard=least / (2 - least), miss=miss, block=block), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    few = pairs.count() * 2 <= BROADCAST_ROWS
    texts = distinct.select("h", "class", "words").join(F.broadcast(wanted) if few else wanted, "h", "left_semi").dropDuplicates(["class"])
    texts = materialize(texts, "texts")
    side = lambda s: texts.select(F.col("h").alias(s), F.col("class").alias(f"class_{s}"), F.col("words").alias(f"words_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("class_a", "class_b", "words_a", "words_b")

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            s = [words_agree(x, y, least, least_pairs) for x, y in zip(pdf["words_a"], pdf["words_b"])]
            out = pd.DataFrame({"a": pdf["class_a"], "b": pdf["class_b"], "similarity": pd.array(s, "Float64").astype("float64")})
            yield out[out["similarity"].notna()]

    return members, both.mapInPandas(verify, "a binary, b binary, similarity double")


def near_duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row an id: id, class, group (the least class linked), links (to other classes), best (its highest similarity)."""
    links = materialize(links, "links")
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("class"), "similarity"), F.struct(F.col("b").alias("class"), "similarity"))).alias("e")).select("e.*")
    ends = ends.groupBy("class").agg(F.count("*").alias("links"), F.max("similarity").alias("best"))
    groups = connected_components(links).withColumnRenamed("node", "class").withColumnRenamed("component", "group")
    return members.join(groups.join(ends, "class"), "class", "left").select("id", "class", F.coalesce("group", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"), "best")


def near_duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of ids of each group."""
    grouped = near_duplicate_groups(members, links).select("group", "id")
    return pairs_of_groups(grouped, ["group"], "id").select("id_a", "id_b")


def duplicate_fields(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, is_duplicate_of (the least id of the group; null for itself), duplicate_similarity, links."""
    g = near_duplicate_groups(members, links)
    heads = g.groupBy("group").agg(F.min("id").alias("head"))
    copies = g.groupBy("class").agg(F.count("*").alias("copies"))
    one = F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("best"))
    own = F.col("id") == F.col("head")
    return g.join(heads, "group").join(copies, "class").select("id", F.when(~own, F.col("head")).alias("is_duplicate_of"), F.when(~own, one).alias("duplicate_similarity"), "links")
