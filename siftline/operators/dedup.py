"""Duplicate links between chunks: roots, orphans, repair, upload decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.sources.shared import materialize


def link_batch(batch: DataFrame, existing: DataFrame, threshold: float) -> DataFrame:
    """(id, source, parent, similarity) for linked rows.

    ``batch``: id, earlier, similarity (best earlier row of the batch). ``existing``:
    id, chunk_id, similarity, dup_of (nearest stored row and its root). A stored
    neighbour at the threshold links to its root; a batch neighbour wins only if it
    is strictly more similar.
    """
    old = existing.where(F.col("similarity") >= threshold).select("id", F.coalesce("dup_of", "chunk_id").alias("old"), F.col("similarity").alias("old_s"))
    new = batch.where(F.col("similarity") >= threshold).select("id", F.col("earlier").alias("new"), F.col("similarity").alias("new_s"))
    by_batch = F.col("new_s").isNotNull() & (F.col("old_s").isNull() | (F.col("new_s") > F.col("old_s")))
    both = old.join(new, "id", "full_outer")
    return both.select("id", F.when(by_batch, "batch").otherwise("existing").alias("source"), F.when(by_batch, F.col("new")).otherwise(F.col("old")).alias("parent"), F.when(by_batch, F.col("new_s")).otherwise(F.col("old_s")).alias("similarity"))


def roots(links: DataFrame, *, most_rounds: int = 40) -> DataFrame:
    """(id, root, depth) of every linked row by pointer jumping. ``links``: id, parent.

    A link counts if its target exists and lies before the row, so chains end. Each
    round doubles the reach; the number of rounds is the logarithm of the depth.
    """
    ids = links.select(F.col("id").alias("parent"))
    at = links.where(F.col("parent") < F.col("id")).join(ids, "parent", "left_semi").select("id", F.col("parent").alias("root"), F.lit(1).alias("depth"))
    at = materialize(at, "roots")
    for _ in range(most_rounds):
        up = at.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        nxt = materialize(at.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "roots")
        at = nxt.select("id", "root", "depth")
        if nxt.where("moved").isEmpty():
            return at
    raise RuntimeError(f"links not resolved after {most_rounds} rounds")


def orphans(chunks: DataFrame, replaced: DataFrame) -> DataFrame:
    """Duplicates outside the replaced documents whose canonical lies in one. ``replaced``: document_id."""
    heads = chunks.join(replaced, "document_id", "left_semi").select(F.col("id").alias("is_duplicate_of"))
    return chunks.join(heads, "is_duplicate_of", "left_semi").join(replaced, "document_id", "left_anti").select("id", "is_duplicate_of")


def link_states(chunks: DataFrame, replaced: DataFrame) -> DataFrame:
    """(id, state): canonical, broken, replaced or linked; a replaced target makes its row canonical."""
    gone = replaced.select(F.col("document_id").alias("target_doc"), F.lit(True).alias("gone"))
    target = chunks.select(F.col("id").alias("is_duplicate_of"), F.col("document_id").alias("target_doc")).join(gone, "target_doc", "left")
    state = F.when(F.col("is_duplicate_of").isNull(), "canonical").when(F.col("target_doc").isNull(), "broken").when(F.col("gone"), "replaced").otherwise("linked")
    return chunks.select("id", "is_duplicate_of").join(target, "is_duplicate_of", "left").select("id", state.alias("state"))


def inherit_clusters(chunks: DataFrame, rooted: DataFrame) -> DataFrame:
    """(id, cluster_id): the cluster of the root, -1 if it has none."""
    of = chunks.select(F.col("id").alias("root"), "cluster_id")
    return chunks.select("id").join(rooted.select("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root")).join(of, "root", "left").select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def upload_actions(files: DataFrame) -> DataFrame:
    """new, retry, rechunk or duplicate, from the upload of the same content before."""
    w = W.partitionBy("sha256").orderBy("created_at", "id", "version", "status", "chunk_size")
    before, size = F.lag("status").over(w), F.lag("chunk_size").over(w)
    action = F.when(F.row_number().over(w) == 1, "new").when(before == "error", "retry").when(~size.eqNullSafe(F.col("chunk_size")), "rechunk").otherwise("duplicate")
    return files.withColumn("action", action)
