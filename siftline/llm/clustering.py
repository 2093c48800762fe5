"""Grouping records into similarity clusters (problem 3).

Texts become unit vectors of weighted terms, projected to a fixed width. The
similarity of two clusters is the mean cosine of all pairs of their members, which
the sums of their vectors give exactly. All mutually best pairs merge at once,
round after round, until no such pair reaches the threshold.

Rounds run first inside cells (each record goes to the nearest of a bounded sample
of records, a large cell in blocks), from single records on and down to ``close``, a
similarity above the threshold, so that what a cell separates can still meet; then on
the sparse graph that joins each cluster so found with its most similar ones, down to
``threshold``. When two clusters merge, their edges unite. Rounds on the graph are
joins while it has more than ``finish_edges`` edges; below that bound one task runs the
same rounds, with the same result.

Clusters are what the linkage leaves: none is dissolved, however small, and there is
no bound on their number.

Defined results: null texts and texts without a term of weight are in no cluster; ids
repeated count once; equal texts share a cluster; ids number clusters by their
least member; of equally similar partners the least id is best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.llm.knn import k_nearest_classes, pack_rows
from siftline.llm.near_duplicates import _arrow, _binary, _matrix
from siftline.llm.terms import document_frequencies, sign_rows, slots, term_hashes, words
from siftline.sources.shared import materialize

WIDTH = 128


def _pack8(x: np.ndarray) -> np.ndarray:
    top = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-9)
    return np.rint(x / top * 127).astype(np.int8).view(np.uint8)


def _unpack8(m: np.ndarray) -> np.ndarray:
    x = m.view(np.int8).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def text_vectors(df: DataFrame, id: str, text: str, *, power: float = 1.25, rare: float = 0.005) -> DataFrame:
    """(id, v) of every text with a term of weight.

    Weights are log tf times idf to ``power``; a term that less than the share ``rare``
    of the texts hold weighs less by the square root of what it falls short, as such
    terms tell writers and firms apart rather than matters.
    """
    n, seen = document_frequencies(df, text)
    idf = np.log(np.maximum(n / np.maximum(seen, 1), 1.0)) ** power * np.sqrt(np.minimum(1.0, np.maximum(seen, 1) / max(1, n) / rare))
    shared = df.sparkSession.sparkContext.broadcast(idf.astype(np.float32))  # one number a counter

    def embed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in it:
            local: dict[str, int] = {}
            counts = [[(local.setdefault(w, len(local)), c) for w, c in Counter(words(t)).items()] for t in batch.column(1).to_pylist()]
            h = term_hashes(list(local))
            signs, heavy = sign_rows(h, WIDTH), idf[slots(h)]
            keep, xs = [], []
            for i, pairs in enumerate(counts):
                if not pairs:
                    continue
                k, tf = np.array(pairs).T
                w = np.log1p(tf).astype(np.float32) * heavy[k]
                if w.any():
                    keep.append(i)
                    xs.append(w @ signs[k])
            v = _pack8(np.stack(xs)) if xs else np.zeros((0, WIDTH), np.uint8)
            yield _arrow(id=batch.column(0).take(pa.array(keep, pa.int64())), v=_binary(v))

    rows = df.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(embed, "id string, v binary")


# --- rounds of mutually best merges -----------------------------------------


def merge_dense(x: np.ndarray, weight: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of the rows of ``x`` (sums of ``weight`` unit vectors), all pairs known."""
    label, alive = np.arange(len(x)), np.arange(len(x))
    total, w = (x @ x.T).astype(np.float64), weight.astype(np.float64)
    while len(alive) > 1:
        mean = total / (w[:, None] * w[None])
        np.fill_diagonal(mean, -np.inf)
        best = mean.argmax(axis=1)
        at = np.arange(len(alive))
        a = np.flatnonzero((best[best] == at) & (at < best) & (mean[at, best] >= threshold))
        if not len(a):
            break
        b = best[a]
        total[a] += total[b]
        total[:, a] += total[:, b]
        w[a] += w[b]
        to = np.arange(len(x))
        to[alive[b]] = alive[a]
        label = to[label]
        keep = np.ones(len(alive), bool)
        keep[b] = False
        total, w, alive = total[keep][:, keep], w[keep], alive[keep]
    return label


def edge_means(a: np.ndarray, b: np.ndarray, sums: np.ndarray, weight: np.ndarray, step: int = 100_000) -> np.ndarray:
    """Mean similarity of all pairs between the clusters at the ends of each edge."""
    dots = [np.einsum("ij,ij->i", sums[a[s : s + step]], sums[b[s : s + step]], dtype=np.float64) for s in range(0, len(a), step)]
    return np.concatenate([*dots, np.zeros(0)]) / (weight[a] * weight[b])


def merge_sparse(a: np.ndarray, b: np.ndarray, sums: np.ndarray, weight: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of the nodes after all rounds on an edge list (each edge once)."""
    n = len(sums)
    label, sums, weight = np.arange(n), sums.astype(np.float64), weight.astype(np.float64)
    mean = edge_means(a, b, sums, weight)
    while len(a):
        u, v, s = np.r_[a, b], np.r_[b, a], np.r_[mean, mean]
        order = np.lexsort((v, -s, u))
        at = order[np.r_[True, u[order][1:] != u[order][:-1]]]
        best, high = np.full(n, -1), np.full(n, -np.inf)
        best[u[at]], high[u[at]] = v[at], s[at]
        x = np.flatnonzero((best >= 0) & (high >= threshold))
        x = x[(best[best[x]] == x) & (x < best[x])]
        if not len(x):
            break
        to = np.arange(n)
        to[best[x]] = x
        sums[x] += sums[best[x]]
        weight[x] += weight[best[x]]
        label = to[label]
        key, first = np.unique(np.minimum(to[a], to[b]).astype(np.int64) * n + np.maximum(to[a], to[b]), return_index=True)
        mean = mean[first]
        a, b = key // n, key % n
        keep = a != b
        a, b, mean = a[keep], b[keep], mean[keep]
        changed = np.zeros(n, bool)
        changed[x] = True
        again = changed[a] | changed[b]
        mean[again] = edge_means(a[again], b[again], sums, weight)
    return label


def _sums(pdf_column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(pdf_column), "<f4").reshape(len(pdf_column), WIDTH)


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "weight": [int(pdf["weight"].sum())], "sum": [_sums(pdf["sum"]).sum(axis=0).astype("<f4").tobytes()]})


def merge_rounds(edges: DataFrame, nodes: DataFrame, threshold: float, *, finish_edges: int = 500_000, most_rounds: int = 200) -> DataFrame:
    """(node, cluster) of every node. ``edges``: a < b. ``nodes``: node, weight, sum.

    The graph says which clusters may merge; how similar they are is always taken
    from all pairs of their members.
    """
    edges = materialize(edges.select("a", "b").distinct(), "graph")
    label = nodes.select("node", F.col("node").alias("cluster"))
    nodes = nodes.select(F.col("node").alias("cluster"), "weight", "sum")

    def means(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x, y = _sums(pdf["sa"]), _sums(pdf["sb"])
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "s": np.einsum("ij,ij->i", x, y, dtype=np.float64) / (pdf["wa"].to_numpy() * pdf["wb"].to_numpy().astype(float))})

    for _ in range(most_rounds):
        if edges.count() <= finish_edges:
            break
        full = edges.join(nodes.toDF("a", "wa", "sa"), "a").join(nodes.toDF("b", "wb", "sb"), "b")
        scored = full.select("a", "b", "wa", "wb", "sa", "sb").mapInPandas(means, "a string, b string, s double")
        ends = scored.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "s"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "s"))).alias("e")).select("e.*")
        best = ends.groupBy("u").agg(F.min_by("v", F.struct((-F.col("s")).alias("n"), "v")).alias("v"), F.max("s").alias("s")).where(F.col("s") >= threshold)
        moved = best.alias("x").join(best.alias("y"), (F.col("x.u") == F.col("y.v")) & (F.col("x.v") == F.col("y.u")) & (F.col("x.u") < F.col("x.v"))).select(F.col("x.v").alias("old"), F.col("x.u").alias("new"))
        moved = materialize(moved, "moved")
        if moved.isEmpty():
            edges = edges.limit(0)
            break
        label = materialize(label.join(moved, F.col("cluster") == F.col("old"), "left").select("node", F.coalesce("new", "cluster").alias("cluster")), "label")
        shifted = nodes.join(moved, F.col("cluster") == F.col("old"), "left").select(F.coalesce("new", "cluster").alias("cluster"), "weight", "sum")
        nodes = materialize(shifted.groupBy("cluster").applyInPandas(_add, "cluster string, weight bigint, sum binary"), "nodes")
        e = edges.join(moved.toDF("a", "na"), "a", "left").join(moved.toDF("b", "nb"), "b", "left").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")).where(F.col("a") != F.col("b"))
        edges = materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph")
    else:
        if edges.count() > finish_edges:
            raise RuntimeError(f"linkage not finished after {most_rounds} rounds")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["b"].isna()]
        e = pdf[pdf["b"].notna()]
        names = known["a"].to_numpy().astype(str)
        order = np.argsort(names)
        names = names[order]
        got = merge_sparse(np.searchsorted(names, e["a"].to_numpy().astype(str)), np.searchsorted(names, e["b"].to_numpy().astype(str)), _sums(known["sum"])[order], known["weight"].to_numpy()[order], threshold)
        return pd.DataFrame({"cluster": names, "to": names[got]})

    ends = edges.select(F.explode(F.array("a", "b")).alias("cluster")).distinct()
    left = nodes.join(ends, "cluster", "left_semi").select(F.col("cluster").alias("a"), F.lit(None).cast("string").alias("b"), "weight", "sum")
    rest = left.unionByName(edges.select("a", "b", F.lit(None).cast("bigint").alias("weight"), F.lit(None).cast("binary").alias("sum")))
    last = rest.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(finish, "cluster string, to string")  # at most finish_edges edges and their ends
    return label.join(last, "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster"))


def cell_clusters(vectors: DataFrame, threshold: float, *, pivots_a_root: float = 4.0, most_pivots: int = 8192, block: int = 2048) -> DataFrame:
    """Rounds inside cells. Rows of (id, node): the cluster of a record; rows of (null, node, weight, sum): the clusters."""
    n = vectors.count()
    m = int(min(max(1, pivots_a_root * n**0.5), most_pivots))
    share = min(1.0, 1.5 * 2 * m / max(1, n))
    drawn = vectors.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(2 * m).collect()
    seen = _unpack8(np.stack([np.frombuffer(r["v"], np.uint8) for r in drawn])) if drawn else np.zeros((0, WIDTH), np.float32)
    pivots = np.ascontiguousarray(np.unique(seen[:m], axis=0)) if len(seen) else seen
    used = np.bincount((seen @ pivots.T).argmax(axis=1), minlength=len(pivots)) if len(seen) else np.ones(1)
    salts = np.maximum(1, np.ceil(used * (n / max(1, len(seen))) / (4 * block))).astype(np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((pivots, salts))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, salts = shared.value
        for batch in it:
            if not batch.num_rows:
                continue
            x = _unpack8(_matrix(batch.column(1), WIDTH))
            cell = np.concatenate([(x[s : s + 4096] @ pivots.T).argmax(axis=1) for s in range(0, len(x), 4096)])
            yield _arrow(cell=(cell << 20) | (np.arange(len(cell)) % salts[cell]), id=batch.column(0), v=batch.column(1))

    def rounds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(ids: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            forms, inverse, weight = np.unique(m.view([("", m.dtype)] * m.shape[1]).ravel(), return_inverse=True, return_counts=True)
            x = _unpack8(np.ascontiguousarray(forms).view(np.uint8).reshape(len(forms), WIDTH)) * weight[:, None]
            label = merge_dense(x, weight, threshold)[inverse.ravel()]
            sums, w = np.zeros((len(forms), WIDTH), np.float32), np.bincount(label, minlength=len(forms))
            np.add.at(sums, label, _unpack8(m))
            used = np.flatnonzero(w)
            order = np.argsort(ids, kind="stable")
            name: dict[int, str] = {}
            for i in order:
                name.setdefault(int(label[i]), ids[i])
            yield _arrow(id=pa.array(ids, pa.string()), node=pa.array([name[int(k)] for k in label], pa.string()), weight=np.zeros(len(ids), np.int64), sum=pa.array([None] * len(ids), pa.binary()))
            yield _arrow(id=pa.array([None] * len(used), pa.string()), node=pa.array([name[int(k)] for k in used], pa.string()), weight=w[used].astype(np.int64), sum=_binary(np.ascontiguousarray(sums[used]).view(np.uint8).reshape(len(used), 4 * WIDTH)))

        held_ids: list[np.ndarray] = []
        held_m: list[np.ndarray] = []
        at, count = None, 0
        for batch in it:
            cells, ids, m = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2), WIDTH)
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else []
            for s, e in zip(starts, np.r_[starts[1:], len(cells)]):
                for q in range(s, e, block):
                    z = min(e, q + block)
                    if held_ids and (cells[q] != at or count + z - q > block):
                        yield from solve(np.concatenate(held_ids), np.concatenate(held_m))
                        held_ids, held_m, count = [], [], 0
                    held_ids.append(ids[q:z])
                    held_m.append(m[q:z].copy())
                    at, count = cells[q], count + z - q
        if held_ids:
            yield from solve(np.concatenate(held_ids), np.concatenate(held_m))

    placed = vectors.select("id", "v").mapInArrow(place, "cell bigint, id string, v binary").repartition("cell").sortWithinPartitions("cell", "id")
    return placed.mapInArrow(rounds, "id string, node string, weight bigint, sum binary")


def cluster_vectors(vectors: DataFrame, *, threshold: float = 0.14, close: float = 0.25, neighbours: int = 24, finish_edges: int = 500_000) -> DataFrame:
    """(id, cluster) of every vector. ``vectors``: id, v; written and read again."""
    vectors = materialize(vectors.dropDuplicates(["id"]), "vectors")
    cells = materialize(cell_clusters(vectors, max(close, threshold)), "cells")
    nodes = cells.where(F.col("id").isNull()).select("node", "weight", "sum")

    def widen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _matrix(batch.column(1), 4 * WIDTH).copy().view("<f4") if batch.num_rows else np.zeros((0, WIDTH), np.float32)
            yield _arrow(id=batch.column(0), v=_binary(pack_rows(x)))

    directions = materialize(nodes.select("node", "sum").mapInArrow(widen, "id string, v binary"), "directions")
    near = k_nearest_classes(directions.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), WIDTH, k=neighbours, length=6, rerank=256)
    # clusters of one direction stand under one id in the index; they join it by an edge
    same = directions.join(directions.groupBy("v").agg(F.min("id").alias("b")), "v").where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b")
    edges = near.select("a", "b").unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    label = materialize(merge_rounds(edges, nodes, threshold, finish_edges=finish_edges), "clusters")

    return cells.where(F.col("id").isNotNull()).select("id", "node").join(label, "node").select("id", "cluster")


def number_clusters(assigned: DataFrame) -> DataFrame:
    """(id, cluster_id, size): clusters are numbered 0, 1, ... by their least member id.

    Least ids are sorted in ranges; the numbers of a range begin where the counts of
    those before it end, so no task holds more than a range.
    """
    first = assigned.groupBy("cluster").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    first = materialize(first.repartitionByRange("first").withColumn("range", F.spark_partition_id()), "first")
    before = W.partitionBy().orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = first.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(W.partitionBy("range").orderBy("first")) - 1 + F.col("start")
    numbered = first.join(F.broadcast(starts), "range").select("cluster", "size", number.cast("int").alias("cluster_id"))
    return assigned.join(numbered, "cluster").select("id", "cluster", "cluster_id", "size")


def describe_clusters(assigned: DataFrame, vectors: DataFrame, typical: int = 5) -> DataFrame:
    """cluster_id, size and the ids nearest to the centre, best first. ``vectors``: id, v."""
    placed = materialize(number_clusters(assigned).join(vectors.dropDuplicates(["id"]), "id").select("id", "cluster_id", "size", "v"), "placed")

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:  # partial sums of a batch: a large cluster is never gathered
            x = _unpack8(_matrix(pa.array(pdf["v"], pa.binary()), WIDTH)) if len(pdf) else np.zeros((0, WIDTH), np.float32)
            kinds, at = np.unique(pdf["cluster_id"].to_numpy(), return_inverse=True)
            total = np.zeros((len(kinds), WIDTH), np.float32)
            np.add.at(total, at, x)
            yield pd.DataFrame({"cluster": kinds.astype(str), "weight": np.bincount(at, minlength=len(kinds)).astype("int64"), "sum": [r.tobytes() for r in total]})

    schema = "cluster string, weight bigint, sum binary"
    part = placed.select("cluster_id", "v").mapInPandas(sums, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    centres = part.groupBy("cluster", "salt").applyInPandas(_add, schema).groupBy("cluster").applyInPandas(_add, schema)

    def nearness(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = _unpack8(_matrix(pa.array(pdf["v"], pa.binary()), WIDTH))
                c = _sums(pdf["sum"])
                pdf = pdf.assign(similarity=np.einsum("ij,ij->i", x, c) / np.maximum(np.linalg.norm(c, axis=1), 1e-9))
            else:
                pdf = pdf.assign(similarity=0.0)
            yield pdf[["id", "cluster_id", "size", "similarity"]]

    near = placed.join(centres.select(F.col("cluster").cast("int").alias("cluster_id"), "sum"), "cluster_id").mapInPandas(nearness, "id string, cluster_id int, size bigint, similarity double")
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("similarity"), "id"))
    best = near.withColumn("r", rank).where(F.col("r") <= typical)
    return best.groupBy("cluster_id", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
