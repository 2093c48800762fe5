"""Clusters of vectors: k-means, silhouette, numbering, labels by key terms."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Common English words left out of labels; a longer list may be passed.
STOP_WORDS = tuple("a about after again all also although an and any are as asked at be because been before being both but by can comes could did do does each either every few first for from had has have her his how if in into is it its last least less may more most must neither no nobody not of often on one only or other our out over own part please same see she should so some such than that the their them then there these they this those to under until up use used was we were what when where which while who whom why will with without would you your".split())


def kmeans(vectors: DataFrame, k: int, seed: int = 42, restarts: int = 3, max_iter: int = 100) -> DataFrame:
    """(id, label) of the best of several seeded runs. ``vectors``: id, v (array<double>)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("id", array_to_vector("v").alias("features")).sort("id").cache()
    try:
        models = [KMeans(k=k, seed=seed + i, maxIter=max_iter).fit(data) for i in range(restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        return best.transform(data).select("id", F.col("prediction").alias("label"), "features")
    finally:
        data.unpersist()


def silhouette(labelled: DataFrame) -> float:
    """Mean silhouette by cosine distance; a singleton counts 0."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    if labelled.select("label").distinct().limit(2).count() < 2:
        return 0.0
    return ClusteringEvaluator(predictionCol="label", featuresCol="features", distanceMeasure="cosine").evaluate(labelled)


def _rows_of(batch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each 64-bit hash; every salt gives another."""
    z = h + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54


def _seeds(data: DataFrame, most: int, starts: int, seed: int) -> np.ndarray:
    """(starts, most, dimensions): k-means++ seeds of every start, one pass a seed; a start with k clusters takes the first k.

    A row is drawn in proportion to its squared distance from the seeds before it: the
    least of -ln(u) / d^2 over all rows, so partitions and their order make no difference.
    """
    chosen: list[np.ndarray] = []
    for step in range(most):
        held = np.stack(chosen, 1) if chosen else None

        def draw(it, held=held, step=step):
            best: dict[int, tuple] = {}
            for batch in it:
                x, h = _rows_of(batch), batch.column("h").to_numpy().view(np.uint64)
                for start in range(starts):
                    d = _distances(x, held[start]).min(1) if held is not None else np.ones(len(x))
                    d[d <= 1e-12 * (x * x).sum(1)] = 0
                    at = -np.log(_uniform(h, (seed * starts + start) * most + step)) / np.where(d > 0, d, 1)
                    i = np.lexsort((at, d <= 0))[0]
                    if start not in best or (d[i] <= 0, at[i]) < best[start][:2]:
                        best[start] = (bool(d[i] <= 0), float(at[i]), x[i])
            if best:
                yield pa.RecordBatch.from_pylist([{"start": s, "equal": e, "at": t, "v": v.tolist()} for s, (e, t, v) in best.items()], pa.schema([("start", pa.int32()), ("equal", pa.bool_()), ("at", pa.float64()), ("v", pa.list_(pa.float64()))]))

        drawn = data.mapInArrow(draw, "start int, equal boolean, at double, v array<double>")
        got = {r["start"]: r["v"] for r in drawn.groupBy("start").agg(F.min_by("v", F.struct("equal", "at")).alias("v")).collect()}
        chosen.append(np.array([got[start] for start in range(starts)]))
    return np.stack(chosen, 1)


def _sums(data: DataFrame, centres: list[np.ndarray], *, many: bool, unit: bool = False) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(members, their sums, squared distances in all) of each set of centres, in one pass.

    ``many``: there are many partitions, which are added up before the driver gets one
    row a centre. ``unit``: sums of vectors of length one.
    """
    every, ends = np.concatenate(centres), np.cumsum([len(c) for c in centres])
    out = "part int, centre int, n double, cost double, s array<double>"

    def add(it):
        n, cost, sums = np.zeros(len(every)), np.zeros(len(every)), np.zeros(every.shape)
        for batch in it:
            for x in np.array_split(_rows_of(batch), -(-batch.num_rows // 2048)) if batch.num_rows else ():
                d = _distances(x, every)
                member = np.zeros(d.shape)
                for a, b in zip([0, *ends], ends):
                    member[np.arange(len(x)), a + d[:, a:b].argmin(1)] = 1
                n += member.sum(0)
                cost += (member * d).sum(0)
                sums += member.T @ (_unit(x) if unit else x)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": np.int32(TaskContext.get().partitionId()), "centre": np.arange(len(every), dtype=np.int32), "n": n, "cost": cost, "s": list(sums)}))

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        return pd.DataFrame({"part": [0], "centre": pdf["centre"].iloc[:1].to_numpy(), "n": [pdf["n"].sum()], "cost": [pdf["cost"].sum()], "s": [np.sum(list(pdf["s"]), axis=0)]})

    parts = data.mapInArrow(add, out)
    if many:
        parts = parts.groupBy("centre").applyInPandas(total, out)
    n, cost, sums = np.zeros(len(every)), np.zeros(len(every)), np.zeros(every.shape)
    for r in sorted(parts.collect(), key=lambda r: (r["centre"], r["part"])):
        n[r["centre"]] += r["n"]
        cost[r["centre"]] += r["cost"]
        sums[r["centre"]] += r["s"]
    return [(n[a:b], sums[a:b], float(cost[a:b].sum())) for a, b in zip([0, *ends], ends)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _silhouettes(data: DataFrame, centres: list[np.ndarray], known: list[tuple]) -> list[float]:
    """Mean silhouette by cosine distance of each set of centres over all rows; a singleton counts 0.

    The mean distance to a cluster is one less the product with the mean of its unit
    vectors, so one pass does for all sets. ``known``: ``_sums`` of unit vectors.
    """

    def score(it):
        total = np.zeros(len(centres))
        for batch in it:
            for x in np.array_split(_rows_of(batch), -(-batch.num_rows // 2048)) if batch.num_rows else ():
                u, rows = _unit(x), np.arange(len(x))
                for i, (c, (n, s, _)) in enumerate(zip(centres, known)):
                    own = _distances(x, c).argmin(1)
                    far = np.maximum(n - u @ s.T, 0)  # summed distances to each cluster
                    a = np.maximum(far[rows, own] - (1 - (u * u).sum(1)), 0) / np.maximum(n[own] - 1, 1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        other = np.where(n > 0, far / n, np.inf)
                        other[rows, own] = np.inf
                        b = other.min(1)
                        total[i] += np.where((n[own] > 1) & np.isfinite(b), np.nan_to_num((b - a) / np.maximum(a, b)), 0).sum()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    rows = sorted(data.mapInArrow(score, "part int, s array<double>").collect(), key=lambda r: r["part"])
    return list(np.sum([r["s"] for r in rows], axis=0) / sum(known[0][0]))


def choose_k(vectors: DataFrame, *, most: int = 12, seed: int = 42, restarts: int = 1, max_iter: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """(id, cluster_id): the first best k by silhouette; fewer than three rows are one cluster.

    All starts of all k move together: one pass over the rows for each seed, and one for
    each of at most ``max_iter`` rounds, in which only those take part whose centres
    still move by more than ``tolerance``. An empty cluster keeps its centre.
    """
    n = vectors.count()
    ks = range(2, min(most, n - 1) + 1)
    one = vectors.select("id", F.lit(0).alias("cluster_id"))
    if not ks:
        return one
    tasks = max(min(8, -(-n // 1000)), -(-n // 50_000))
    data = vectors.select("id", F.col("v").cast("array<double>").alias("v"), F.xxhash64(F.col("id").cast("string")).alias("h")).repartition(tasks, "id").sortWithinPartitions("id").cache()
    try:
        seeds = _seeds(data, ks[-1], restarts, seed)
        centres = [seeds[start, :k].copy() for k in ks for start in range(restarts)]
        moving = list(range(len(centres)))
        for _ in range(max_iter):
            for i, (size, s, _) in zip(list(moving), _sums(data, [centres[i] for i in moving], many=tasks > 8)):
                new = np.where(size[:, None] > 0, s / np.maximum(size, 1)[:, None], centres[i])
                if ((new - centres[i]) ** 2).sum(1).max() <= tolerance**2:
                    moving.remove(i)
                centres[i] = new
            if not moving:
                break
        cost = [c for *_, c in _sums(data, centres, many=tasks > 8)]
        kept = [centres[min(range(j * restarts, (j + 1) * restarts), key=cost.__getitem__)] for j in range(len(ks))]
        known = _sums(data, kept, many=tasks > 8, unit=True)
        best, found = -1.0, None
        for c, (size, *_), s in zip(kept, known, _silhouettes(data, kept, known)):
            if (size > 0).sum() > 1 and s > best + 1e-12:
                best, found = s, c
    finally:
        data.unpersist()
    if found is None:
        return one

    def label(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_distances(_rows_of(batch), found).argmin(1).astype(np.int32))], names=["id", "label"])

    return renumber(data.mapInArrow(label, f"id {vectors.schema['id'].dataType.simpleString()}, label int"))


def renumber(labelled: DataFrame) -> DataFrame:
    """(id, cluster_id): clusters numbered by their least member."""
    first = labelled.groupBy("label").agg(F.min("id").alias("first"))
    numbers = first.select("label", (F.row_number().over(W.partitionBy().orderBy("first")) - 1).alias("cluster_id"))  # one row a cluster
    return labelled.join(numbers, "label").select("id", "cluster_id")


def member_hash(members: DataFrame) -> DataFrame:
    """(cluster_id, size, member_hash): 16 hex digits of sha256 over the sorted ids parted by line ends.

    The hash is defined over the whole list, so the ids of a cluster meet in one row;
    where clusters outgrow that, ``member_fingerprint`` tells the same changes apart.
    """
    return members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.left(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), "\n"), 256), F.lit(16)).alias("member_hash"))


def member_fingerprint(members: DataFrame) -> DataFrame:
    """(cluster_id, size, fingerprint): sum of hashes of the ids, whatever their order; combined on the map side."""
    h = F.xxhash64(F.col("id").cast("string")).cast("decimal(38,0)")
    return members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.sum(h).cast("string").alias("fingerprint"))


def key_terms(texts: DataFrame, *, top: int = 3, stop: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(cluster_id, rank, term, score): class-based tf-idf with rows of unit length.

    ``texts``: cluster_id, text. tf = 1 + ln n, idf = ln((1 + N) / (1 + df)) + 1 over
    clusters; ties by term.
    """
    stop = list(stop)
    terms = texts.select("cluster_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{3,})"), F.lit(1))).alias("term")).where(~F.col("term").isin(stop))
    counts = terms.groupBy("cluster_id", "term").agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = counts.select("cluster_id").distinct().agg(F.count("*").alias("total"))
    w = (1 + F.log("n")) * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)
    weighed = counts.join(df, "term").crossJoin(F.broadcast(total)).withColumn("w", w)  # total is one row
    norm = weighed.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = weighed.join(norm, "cluster_id").withColumn("score", F.round(F.col("w") / F.col("norm"), 6))
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("cluster_id", "rank", "term", "score")


def labels(terms: DataFrame, clusters: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """(cluster_id, label, label_source): a cached label by member hash, else key terms, else ``Topic <id>``."""
    by_terms = terms.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.initcap("term").alias("term")))), lambda x: x["term"]), ", ").alias("words"))
    out = clusters.join(by_terms, "cluster_id", "left")
    if cached is not None:
        out = out.join(cached.select("member_hash", F.col("label").alias("held")), "member_hash", "left")
    else:
        out = out.withColumn("held", F.lit(None).cast("string"))
    return out.select("cluster_id", F.coalesce("held", "words", F.concat(F.lit("Topic "), F.col("cluster_id").cast("string"))).alias("label"), F.when(F.col("held").isNotNull(), "llm").otherwise("keywords").alias("label_source"))


def centroids(vectors: DataFrame) -> DataFrame:
    """(cluster_id, centroid): mean vector of each cluster scaled to unit length. ``vectors``: cluster_id, v."""
    parts = vectors.select("cluster_id", F.posexplode(F.col("v").cast("array<double>")).alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg("x").alias("x"))
    listed = parts.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    n = F.greatest(F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return listed.select("cluster_id", F.transform("m", lambda x: x / n).alias("centroid"))


def principal_plane(vectors: DataFrame) -> DataFrame:
    """(id, x, y): two principal components, the largest loading of each positive. ``vectors``: id, v."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("f"))
    centred = StandardScaler(inputCol="f", outputCol="c", withMean=True, withStd=False).fit(data).transform(data)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    pc = model.pc.toArray()
    sign = [1.0 if pc[abs(pc[:, j]).argmax(), j] > 0 else -1.0 for j in range(2)]
    p = vector_to_array("p")
    return model.transform(centred).select("id", F.round(p[0] * sign[0], 4).alias("x"), F.round(p[1] * sign[1], 4).alias("y"))
