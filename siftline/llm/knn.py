"""Most similar vectors for every vector (problem 1).

A permutation index. Pivots are a bounded sample of the vectors; a vector is
represented by the ordered list of its nearest pivots and is posted, with its
packed form, in the inverted file of each of them. A vector meets the entries of
the files it is posted in, ranks them by the footrule distance of the two ordered
lists, and the best of the ranking (all that tie with the last of them too) are
ranked again by exact cosine similarity.

Pivots are sampled from the vectors themselves, so dense regions have as many more
pivots as they have vectors and files stay of even length; vectors of one
direction are one class and are indexed once. Files expected to exceed ``block``
entries (by a bounded sample) are laid out in blocks, of entries and of queries, and
each pair of blocks is met under a key of its own.

Defined results: a vector is usable if it has ``dim`` finite values, not all zero;
length does not matter. Of ties at the k-th place the lower id comes first. Equal
replayed rows count once; an id with several usable vectors keeps the one packed
least. Similarities are those of directions packed in 12 bits a component, exact
to about 1e-4.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.llm.near_duplicates import _arrow, _binary, _matrix
from siftline.sources.shared import materialize

STEPS = 2047  # 12 bits a component
SALTS = 16


def packed_width(dim: int) -> int:
    return -(-dim // 2) * 3


def pack_rows(x: np.ndarray) -> np.ndarray:
    """Rows as 12-bit fractions of their largest component, two to three bytes; equal directions pack equally."""
    top = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30)
    q = (np.rint(x / top * STEPS) + 2048).astype(np.uint16)
    if q.shape[1] % 2:
        q = np.hstack([q, np.full((len(q), 1), 2048, np.uint16)])
    a, b = q[:, 0::2], q[:, 1::2]
    return np.stack([a >> 4, ((a & 15) << 4) | (b >> 8), b & 255], axis=2).astype(np.uint8).reshape(len(x), -1)


def unpack_rows(m: np.ndarray, dim: int) -> np.ndarray:
    """Unit rows of what ``pack_rows`` made."""
    t = m.reshape(len(m), -1, 3).astype(np.int16)
    x = np.empty((len(m), t.shape[1] * 2), np.float32)
    x[:, 0::2] = ((t[:, :, 0] << 4) | (t[:, :, 1] >> 4)) - 2048
    x[:, 1::2] = (((t[:, :, 1] & 15) << 8) | t[:, :, 2]) - 2048
    x = x[:, :dim]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def pack_directions(df: DataFrame, id: str, vector: str, dim: int) -> DataFrame:
    """(id, v): packed directions of the usable vectors."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1)
            x[~ok] = 0
            top = np.abs(x).max(axis=1)
            ok &= top > 0
            yield _arrow(id=batch.column(0).filter(pa.array(ok)), v=_binary(pack_rows(x[ok]).reshape(-1, packed_width(dim))))

    whole = df.where(F.col(id).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()))
    return whole.select(F.col(id).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(pack, "id string, v binary")


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ordered list of nearest pivots of each row."""
    out = np.empty((len(x), length), np.int32)
    for s in range(0, len(x), 256):
        d = -(x[s : s + 256] @ pivots.T)
        near = np.argpartition(d, length - 1, axis=1)[:, :length] if length < len(pivots) else np.tile(np.arange(len(pivots)), (len(d), 1))
        order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
        out[s : s + 256] = np.take_along_axis(near, order, 1)
    return out


def footrule_agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the footrule distance of two ordered lists falls short of its maximum, halved.

    With weights length - position (0 outside the list), the distance is the sum of
    absolute weight differences, length * (length + 1) - 2 * sum of least weights.
    """
    n = a.shape[1]
    kind = np.int8 if n * (n + 1) // 2 < 128 else np.int16
    out = np.zeros((len(a), len(b)), kind)
    for i in range(n):
        for j in range(n):
            out += (a[:, i, None] == b[None, :, j]) * kind(n - max(i, j))
    return out


def k_nearest_classes(
    vectors: DataFrame, dim: int, *, drawn_from: Callable | None = None, n: int | None = None, k: int = 10, min_similarity: float = -1.0, pivots_a_root: float = 12.0, least_pivots: int = 64, most_pivots: int = 65_536,
    length: int = 4, rerank: int = 256, block: int = 8192, sample: int = 65_536,
) -> DataFrame:
    """(a, b, similarity): up to k nearest distinct directions b of each direction a.

    ``vectors``: (id, v) with distinct v. ``sample`` bounds the pivots and the rows
    from which file lengths are estimated. ``n`` (about the number of vectors) and
    ``drawn_from`` (gives the vectors whose id meets a condition, copies among them)
    may stand in where
    ``vectors`` is costly, since both read it once more.
    """
    n = vectors.count() if n is None else n
    m = int(min(max(least_pivots, pivots_a_root * n**0.5), most_pivots, sample, max(1, n)))
    share = min(1.0, 1.3 * max(m, min(sample, 4 * m)) / max(1, n))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    drawn = (drawn_from(part) if drawn_from is not None else vectors.where(part("id"))).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(min(sample, 4 * m)).collect()
    empty = vectors.sparkSession.createDataFrame([], "a string, b string, similarity float")
    if not drawn:
        return empty
    seen = unpack_rows(np.stack([np.frombuffer(v, np.uint8) for v in dict.fromkeys(bytes(r["v"]) for r in drawn)]), dim)
    pivots = np.ascontiguousarray(seen[:m])
    length, width = min(length, len(pivots)), packed_width(dim)
    used = np.bincount(nearest_pivots(seen, pivots, length).ravel(), minlength=len(pivots))
    salts = np.maximum(1, np.ceil(used * (n / len(seen)) / block)).astype(np.int32) if n > block else np.ones(len(pivots), np.int32)
    shared = vectors.sparkSession.sparkContext.broadcast((pivots, salts))  # at most most_pivots rows

    def post(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, salts = shared.value
        for batch in it:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1), width)
            lists = nearest_pivots(unpack_rows(m, dim), pivots, length)
            row = np.repeat(np.arange(len(m)), length)
            cell, spread = lists.ravel(), salts[lists.ravel()]
            home = (row * 2654435761 % (1 << 31)) % spread
            many = spread > 1
            if many.any():  # in a file of several blocks every block of queries meets every block of entries under a key of its own
                again = np.repeat(np.flatnonzero(many), spread[many])
                other = np.concatenate([np.arange(k) for k in spread[many]])
                own = home[again]
                ask, give = (own << 20) | other, (other << 20) | own
                flag = np.r_[np.full((~many).sum(), 3), np.where(other == own, 3, 2), np.ones((other != own).sum(), int)]
                pair = np.r_[np.zeros((~many).sum(), int), ask, give[other != own]]
                again = np.r_[again, again[other != own]]
                row, cell = np.r_[row[~many], row[again]], np.r_[cell[~many], cell[again]]
            else:
                flag, pair = np.full(len(row), 3), np.zeros(len(row), int)
            yield _arrow(cell=(cell.astype(np.int64) << 40) | pair, role=flag.astype(np.int8), id=batch.column(0).take(pa.array(row)), v=_binary(np.hstack([m[row], lists[row].astype("<u2").view(np.uint8)])))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(cells: np.ndarray, role: np.ndarray, ids: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            got: list[tuple] = []
            for s, e in zip(starts, np.r_[starts[1:], len(cells)]):
                if e - s < 2:
                    continue
                part = np.ascontiguousarray(m[s:e])
                x, lists = unpack_rows(part[:, :width], dim), part[:, width:].copy().view("<u2")
                is_entry, is_query = np.flatnonzero(role[s:e] & 1), np.flatnonzero(role[s:e] & 2)
                y, ylists = x[is_entry], lists[is_entry]
                here = cells[s] >> 40
                before = np.cumsum(lists == here, axis=1) == 0  # pivots nearer than this one
                for q in range(0, len(is_query), 1024):
                    who = is_query[q : q + 1024]
                    a, al = x[who], lists[who]
                    rank = footrule_agreement(al, ylists)
                    for i in range(length):  # a pair is ranked in the file of the first pivot they share
                        rows = np.flatnonzero(before[who, i])
                        if len(rows):
                            rank[rows] *= ~(al[rows, i, None, None] == ylists[None]).any(axis=2)
                    sim = a @ y.T
                    sim[who[:, None] == is_entry[None]] = -2
                    if rank.shape[1] > rerank:
                        edge = np.partition(rank, rank.shape[1] - rerank, axis=1)[:, -rerank, None]
                        sim[rank < np.maximum(edge, 1)] = -2
                    sim[rank < 1] = -2
                    if sim.shape[1] > k:
                        edge = np.partition(sim, sim.shape[1] - k, axis=1)[:, -k, None]
                        keep = (sim >= edge) & (sim >= max(min_similarity, -1.5))
                    else:
                        keep = sim >= max(min_similarity, -1.5)
                    i, j = np.nonzero(keep)
                    got.append((ids[s + who[i]], ids[s + is_entry[j]], sim[i, j]))
            if got:
                yield _arrow(a=pa.array(np.concatenate([g[0] for g in got]), pa.string()), b=pa.array(np.concatenate([g[1] for g in got]), pa.string()), similarity=np.concatenate([g[2] for g in got]).astype(np.float32))

        def gathered(until: int | None) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            if until is not None and until < len(t):
                held.extend(t.slice(until).combine_chunks().to_batches())
                t = t.slice(0, until)
            if len(t):
                t = t.combine_chunks()
                yield from solve(t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), _matrix(t.column(3), width + 2 * length))

        for batch in it:
            if not batch.num_rows:
                continue
            held.append(batch)
            cells = batch.column(0).to_numpy()
            if cells[0] != cells[-1] or held[0].column(0)[0].as_py() != cells[-1]:
                last = sum(b.num_rows for b in held[:-1]) + int(np.searchsorted(cells, cells[-1]))
                yield from gathered(last)
        if held:
            yield from gathered(None)

    posts = vectors.select("id", "v").mapInArrow(post, "cell bigint, role tinyint, id string, v binary")
    found = posts.repartition("cell").sortWithinPartitions("cell").mapInArrow(search, "a string, b string, similarity float")
    best = found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return best.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def k_nearest(df: DataFrame, *, id: str = "id", vector: str = "embedding", dim: int, k: int = 10, min_similarity: float = -1.0, **options) -> DataFrame:
    """(id, neighbour_id, similarity, rank) of up to k nearest ids of every usable id."""
    packed = pack_directions(df, id, vector, dim)
    classes = packed.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")
    # the sample is drawn before vectors are packed: the filter reaches the scan
    few = lambda part: pack_directions(df.where(part(F.col(id).cast("string"))), id, vector, dim)
    near = k_nearest_classes(classes, dim, drawn_from=few, n=df.where(F.col(vector).isNotNull()).count(), k=k, min_similarity=min_similarity, **options)
    # Ids of one direction: most directions have one id and stand for themselves.
    members = packed.select(F.unhex(F.md5("v")).alias("h"), "id").distinct()
    shared = members.groupBy("h").agg(F.min("id").alias("class"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    # copies of one direction are spread over SALTS keys, so a vector repeated very often is no hot key
    copies = materialize(members.join(shared, "h").select("class", "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")), "copies")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    # of a class, its least k + 1 ids suffice to fill any list
    first = materialize(copies.withColumn("_r", F.row_number().over(W.partitionBy("class").orderBy("id"))).where(F.col("_r") <= k + 1).select("class", F.col("id").alias("other")), "first")
    # the salted sides grow with the copies: never broadcast
    own = copies.hint("merge").join(first.select("class", "other", salts), ["class", "salt"]).select("id", F.col("other").alias("neighbour_id"), F.lit(1.0).cast("float").alias("similarity"))
    wide = near.join(first.withColumnRenamed("class", "b"), "b", "left").select("a", F.coalesce("other", "b").alias("neighbour_id"), "similarity")
    wide = wide.join(first.select(F.col("class").alias("a"), F.lit(SALTS).alias("n")).distinct(), "a", "left")
    single = wide.where(F.col("n").isNull()).select(F.col("a").alias("id"), "neighbour_id", "similarity")
    several = wide.where(F.col("n").isNotNull()).select(F.col("a").alias("class"), "neighbour_id", "similarity", salts)
    wide = single.unionByName(several.hint("merge").join(copies, ["class", "salt"]).select("id", "neighbour_id", "similarity"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id"))
    lists = own.unionByName(wide).where(F.col("id") != F.col("neighbour_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbour_id", "similarity", "rank")
