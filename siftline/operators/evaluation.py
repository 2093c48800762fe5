"""Relevance, ranking metrics, judge scores and parameter grids."""

from __future__ import annotations

import hashlib
import json
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of a grid.
MAX_CELLS, MAX_VALUES = 12, 6


def span_matches(left: DataFrame, right: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows of both sides of one document whose overlap is at least ``share`` of the shorter.

    ``left``: doc, a_start, a_end, ...; ``right``: doc, b_start, b_end, .... An equi-join
    on the document with a range condition.
    """
    over = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    shorter = F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))
    return left.join(right, "doc").where((over > 0) & (over >= share * shorter))


def hit_and_rank(judged: DataFrame, n: int) -> DataFrame:
    """(query_id, hit, mrr) of ranked rows (query_id, rank, relevant)."""
    inside = judged.where(F.col("rank") <= n)
    return inside.groupBy("query_id").agg(F.max(F.col("relevant").cast("double")).alias("hit"), F.round(F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


def metric_means(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, mean, n): nulls left out; the mean of none is null."""
    long = rows.unpivot(keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"))


def share(flag: Column) -> Column:
    """Mean of a flag over a group, four places."""
    return F.round(F.avg(flag.cast("double")), 4)


def correctness(tp: Column, fp: Column, fn: Column, similarity: Column) -> Column:
    f1 = F.coalesce(F.try_divide(tp, tp + 0.5 * (fp + fn)), F.lit(0.0))
    return F.round(0.75 * f1 + 0.25 * F.greatest(F.lit(0.0), similarity), 4)


def grid(values: dict[str, list]) -> list[dict]:
    """All cells in the order of the keys, the last key fastest; an empty grid is one cell."""
    errors = {k: "too many values" for k, v in values.items() if len(set(map(str, v))) > MAX_VALUES} | {k: "no values" for k, v in values.items() if not v}
    if errors:
        raise ValueError(errors)
    cells = [dict(zip(values, c)) for c in product(*values.values())]
    if len(cells) > MAX_CELLS:
        raise ValueError({"grid": f"more than {MAX_CELLS} cells"})
    return cells


def parse_grid_line(text: str) -> list[float]:
    """Distinct numbers of a comma-separated line, in order."""
    found: list[float] = []
    for part in text.split(","):
        try:
            v = float(part.strip())
        except ValueError:
            continue
        if v not in found:
            found.append(v)
    return found


def varying_keys(cells: list[dict]) -> list[str]:
    return [k for k in cells[0] if len({str(c[k]) for c in cells}) > 1] if cells else []


def index_key(corpus: list[str], **build) -> str:
    """Hash of what an index is built from; the order of the corpus does not matter."""
    return hashlib.sha256(json.dumps({"corpus": sorted(corpus), **build}, sort_keys=True).encode()).hexdigest()


def worst_case_calls(questions: int, cells: int, builds: list[tuple[int, bool, bool]]) -> int:
    """Model calls at most: 2 a question and 8 for each cell of it, and for each index not cached its chunks if it has a graph, plus 12 labels."""
    return questions * (2 + 8 * cells) + sum(0 if cached else (chunks if graph else 0) + 12 for chunks, graph, cached in builds)
