"""Snapshots of the corpus: upsert, merge, delete, replace, with one pointer flip a commit."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], by: list[str], ties: list[str] | None = None) -> DataFrame:
    """One row a key: greatest ``by``, then least ``ties``; by aggregation, not by sort."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*by)
    best = df.groupBy(*keys).agg(F.max(order).alias("_o"))
    again = df.join(best, keys).where(order == F.col("_o"))
    pick = F.min(F.struct(*(ties or []), *[c for c in rest if c not in (ties or [])])) if ties else F.first(F.struct(*rest))
    return again.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merge_columns(records: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``records`` with the non-null values of ``changes``; keys without a record are ignored."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    return records.join(new, key, "left").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in records.columns if c != key])


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def put_if_absent(held: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``incoming`` to append: keys not held, the first of each."""
    fresh = incoming.join(held.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(F.struct(order, *[c for c in incoming.columns if c not in (key, order)])).alias("_r")).select(key, "_r.*")


def promote(kept: DataFrame, lost: DataFrame) -> DataFrame:
    """Links to lost canonicals go to the least of the rows that shared one; that row becomes canonical. ``lost``: id."""
    heirs = kept.join(lost.select(F.col("id").alias("is_duplicate_of")), "is_duplicate_of", "left_semi").groupBy("is_duplicate_of").agg(F.min("id").alias("heir"))
    link = F.when(F.col("heir") == F.col("id"), F.lit(None)).otherwise(F.coalesce("heir", "is_duplicate_of"))
    return kept.join(heirs, "is_duplicate_of", "left").withColumn("is_duplicate_of", link).drop("heir")


def delete_documents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunks after documents are deleted, duplicates promoted. ``gone``: document_id."""
    kept = delete(chunks, gone, ["document_id"])
    lost = chunks.join(gone, "document_id", "left_semi").select("id")
    return promote(kept, lost)


def replace_versions(chunks: DataFrame, valid: DataFrame) -> DataFrame:
    """The chunks of valid versions only, links re-pointed. ``valid``: document_id, v."""
    kept = chunks.join(valid, ["document_id", "v"], "left_semi")
    targets = kept.where(F.col("is_duplicate_of").isNotNull()).select(F.col("is_duplicate_of").alias("id")).distinct()
    return promote(kept, targets.join(kept.select("id"), "id", "left_anti"))


class SnapshotStore:
    """Immutable snapshot folders and a pointer file; a reader sees one commit or the next, never a part."""

    def __init__(self, spark: SparkSession, path: str, meta: dict | None = None):
        self.spark, self.path = spark, Path(path)
        self.path.mkdir(parents=True, exist_ok=True)
        state = self._state()
        if meta and state["meta"] and state["meta"] != meta:
            raise ValueError(f"the store holds {state['meta']}, not {meta}")
        if meta and not state["meta"]:
            self._point(state["snapshot"], meta)

    def _state(self) -> dict:
        pointer = self.path / "CURRENT"
        return json.loads(pointer.read_text()) if pointer.exists() else {"snapshot": 0, "meta": None}

    def _point(self, snapshot: int, meta: dict | None) -> None:
        fd, tmp = tempfile.mkstemp(dir=self.path)
        with os.fdopen(fd, "w") as f:
            json.dump({"snapshot": snapshot, "meta": meta}, f)
        os.replace(tmp, self.path / "CURRENT")

    @property
    def snapshot(self) -> int:
        return self._state()["snapshot"]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.path / f"snapshot={self.snapshot}" / name))

    def commit(self, tables: dict[str, DataFrame], expected: int | None = None) -> int:
        """Write all tables of the next snapshot, then flip the pointer if it is still where it was."""
        state = self._state()
        if expected is not None and state["snapshot"] != expected:
            raise RuntimeError("another commit came first")
        nxt = state["snapshot"] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(self.path / f"snapshot={nxt}" / name))
        if self._state()["snapshot"] != state["snapshot"]:
            raise RuntimeError("another commit came first")
        self._point(nxt, state["meta"])
        return nxt
