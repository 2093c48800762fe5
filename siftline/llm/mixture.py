"""Mixing sources to target weights (problem 8).

Each source is a stream of blocks of one size in tokens. Block ``j`` of a source with
share ``u`` has the Pfair window from release ``floor(j / u)`` to deadline
``ceil((j + 1) / u)``; at each slot the released block with the earliest deadline is
taken, so at every moment each source is within one block of its share.

The schedule is laid out in periods of about ``period`` blocks, each in its own row: what
a source has in a period is the difference of its rounded shares at both ends, so sources
are within one block at the ends, within one block of the shares of the period inside it,
and within two of the target anywhere. Block size and period do not depend on the
size of the corpus, and no task holds more than a period.

Documents take their place in their source's stream by a prefix sum of tokens in two
levels (hash buckets, then rows in a bucket), so no source, however large, is sorted
in one task. The report is measured on the mix itself.

Defined results: documents with null source or a source without target count in
the total of tokens only; null and empty texts have no tokens and no place in the
mix; an empty corpus gives a report with zero tokens; a target of weight 0 is
reachable with no tokens; rows replayed with the same id count once; the last document
of a source may go beyond its target by less than its own length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The table of targets is brought to the driver; more rows than this are an error.
MAX_SOURCES = 10_000


def source_label(c: Column) -> Column:
    """Labels that differ in case, outer blanks or the mark between words become one."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def edf_slots(blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of the earliest-deadline-first schedule over Pfair windows."""
    total = sum(blocks.values())
    waiting = [(0, -(-total // n), s, 0) for s, n in sorted(blocks.items()) if n > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        n = blocks[s]
        if j + 1 < n:
            heapq.heappush(waiting, ((j + 1) * total // n, -(-(j + 2) * total // n), s, j + 1))
    return out


def mixture_targets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: what it needs, what it has with all repeats, what it is to get.

    ``sizes``: doc_id, source, n_tokens. ``targets``: source, weight, max_repeats.
    """
    per = sizes.groupBy(source_label(F.col("source")).alias("label")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    wanted = targets.where(F.col("source").isNotNull()).select("source", source_label(F.col("source")).alias("label"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats")).dropDuplicates(["label"])
    have = F.coalesce("tokens", F.lit(0)) * F.col("max_repeats")
    need = F.col("weight") * F.col("all_tokens")
    return (
        wanted.join(per, "label", "left")
        .crossJoin(total)  # one row
        .select(
            "source", "label", "weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), "all_tokens",
            have.alias("available_tokens"), need.alias("target_tokens"), F.least(have.cast("double"), need).alias("planned_tokens"),
        )
    )


def mixture_report(sizes: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """``mixture_targets`` with what the schedule gave: tokens, documents, most occurrences of one, blocks, whether the target is reached, actual share."""
    mix = mix_sources(sizes, targets, **options)
    once = mix.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("times"), F.max("block").alias("block"))
    got = once.groupBy(F.col("source").alias("label")).agg(F.sum("n_tokens").alias("mixed_tokens"), F.sum("times").alias("mixed_documents"), F.max("times").cast("int").alias("most_repeats"), (F.max("block") + 1).alias("blocks"))
    full = mixture_targets(sizes, targets).join(got, "label", "left")
    full = full.select(*[c for c in full.columns if c not in got.columns], "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in got.columns if c != "label"])
    full = full.withColumn("reachable", F.col("mixed_tokens") >= F.col("target_tokens"))
    return full.withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.sum("mixed_tokens").over(W.partitionBy())), F.lit(0.0)))  # one row a target


def quotas(blocks: dict[str, int], period: int, periods: int) -> dict[str, tuple[int, int]]:
    """(first block, number of blocks) of each source in one of ``periods`` periods."""
    return {s: (a, b - a) for s, n in blocks.items() for a, b in [((2 * period * n + periods) // (2 * periods), (2 * (period + 1) * n + periods) // (2 * periods))]}


def mix_sources(sizes: DataFrame, targets: DataFrame, *, block_tokens: int = 4096, period: int = 4096, rows_a_bucket: int = 1_000_000) -> DataFrame:
    """The mix: slot, source, block, doc_id, occurrence, n_tokens.

    Read in the order of slot, every source keeps its share. A document occurs at
    most ``max_repeats`` times; a source that needs less than a full pass more
    takes a hash-ordered part of its documents.
    """
    spark = sizes.sparkSession
    rows = mixture_targets(sizes, targets).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    rows = [r for r in rows if r["planned_tokens"] > 0]
    sizes = sizes.where(F.col("n_tokens") > 0).select("doc_id", source_label(F.col("source")).alias("label"), "n_tokens").dropDuplicates(["doc_id"])
    blocks = {r["label"]: max(1, round(r["planned_tokens"] / block_tokens)) for r in rows}
    plan = spark.createDataFrame([(r["label"], float(r["planned_tokens"]), float(r["tokens"]), blocks[r["label"]]) for r in rows], "label string, want double, pass_tokens double, blocks long")
    periods = max(1, sum(blocks.values()) // period)

    def schedule(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p in pdf["id"]:
                mine = quotas(blocks, int(p), periods)
                start = sum(a for a, _ in mine.values())
                slots = edf_slots({s: n for s, (_, n) in mine.items()})
                yield pd.DataFrame([(s, mine[s][0] + j, start + t) for s, j, t in slots], columns=["label", "block", "slot"])

    slots = spark.range(0, periods, numPartitions=min(periods, 10_000)).mapInPandas(schedule, "label string, block long, slot long")

    n = sum(r["documents"] for r in rows)
    buckets = max(64, -(-n // rows_a_bucket))
    h = F.xxhash64("doc_id")
    placed = sizes.join(F.broadcast(plan), "label").withColumn("hash", h).withColumn("bucket", F.pmod(h, F.lit(buckets)))
    sums = placed.groupBy("label", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    before = W.partitionBy("label").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("label", "bucket", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)).alias("bucket_start"))
    inside = W.partitionBy("label", "bucket").orderBy("hash", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.join(starts, ["label", "bucket"]).withColumn("at", F.col("bucket_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    passes = F.ceil((F.col("want") - F.col("at")) / F.col("pass_tokens")).cast("int")  # passes that begin at this document before the target is met
    occurrences = placed.where(passes > 0).withColumn("occurrence", F.explode(F.sequence(F.lit(0), passes - 1)))
    at = F.col("occurrence") * F.col("pass_tokens") + F.col("at")
    block = F.least(F.floor(at * F.col("blocks") / F.col("want")), F.col("blocks") - 1)
    return occurrences.withColumn("block", block).join(slots, ["label", "block"]).select("slot", F.col("label").alias("source"), "block", "doc_id", "occurrence", "n_tokens")

