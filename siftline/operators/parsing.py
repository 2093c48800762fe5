"""Pages of a document: repeated edge lines, concatenation with offsets, page lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.functions.text import line_key, strip

#: Lines from the edge of a page that may be headers or footers, and the least number of pages.
EDGE_LINES, LEAST_PAGES = 2, 3


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc, page, line, text, key, edge): lines of every page. ``pages``: doc, page, text."""
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("key", line_key(F.col("text")))
    w = W.partitionBy("doc", "page")
    filled = lines.where(F.col("key") != "")
    edge = (F.row_number().over(w.orderBy("line")) <= EDGE_LINES) | (F.row_number().over(w.orderBy(F.desc("line"))) <= EDGE_LINES)
    return filled.withColumn("edge", edge)


def repeated_edges(pages: DataFrame) -> DataFrame:
    """(doc, key, pages): edge lines on more than half of the pages of documents with at least three."""
    n = pages.groupBy("doc").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= LEAST_PAGES)
    seen = page_lines(pages).where("edge").groupBy("doc", "key").agg(F.count_distinct("page").alias("pages"))
    return seen.join(n, "doc").where(F.col("pages") * 2 > F.col("n")).select("doc", "key", "pages")


def remove_repeated_edges(pages: DataFrame) -> DataFrame:
    """(doc, page, text): pages without repeated edge lines.

    Where a document loses any line, all its blank lines go too; documents without
    repeats keep their pages as they are.
    """
    repeated = repeated_edges(pages).select("doc", "key", F.lit(True).alias("gone"))
    touched = repeated.select("doc").distinct()
    kept = page_lines(pages).join(touched, "doc", "left_semi").join(repeated, ["doc", "key"], "left").where(~(F.coalesce("gone", F.lit(False)) & F.col("edge")))
    cleaned = kept.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    changed = pages.join(touched, "doc", "left_semi").select("doc", "page").join(cleaned, ["doc", "page"], "left").select("doc", "page", F.coalesce("text", F.lit("")).alias("text"))
    return pages.join(touched, "doc", "left_anti").select("doc", "page", "text").unionByName(changed)


def page_offsets(pages: DataFrame) -> DataFrame:
    """(doc, page, start, end) in the text of non-empty pages joined by blank lines."""
    filled = pages.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")
    before = W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return filled.select("doc", "page", start.alias("start"), (start + F.length("text")).alias("end"))


def page_at(offsets: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, offset, page): the first page that ends beyond the offset, else the last. ``spans``: doc, page, start, end.

    Ends and offsets of a document are one list, read from the highest place down: the
    page seen last before an offset is its page. The work grows with the list, not with
    pages times offsets. The list begins with the last page, for offsets beyond all ends.
    """
    none, far = F.lit(None), F.lit(2**63 - 1)
    pages = spans.where(F.col("doc").isNotNull()).select("doc", "page", "end")
    last = pages.groupBy("doc").agg(F.max_by("page", F.struct("end", "page")).alias("page")).select("doc", none.cast("long").alias("offset"), F.lit(0).alias("kind"), far.alias("at"), "page")
    asked = offsets.select("doc", "offset").distinct().select("doc", F.col("offset").cast("long").alias("offset"), F.lit(1).alias("kind"), F.coalesce(F.col("offset").cast("long"), far).alias("at"), none.cast(spans.schema["page"].dataType).alias("page"))
    ends = pages.where(F.col("end").isNotNull()).select("doc", none.cast("long").alias("offset"), F.lit(2).alias("kind"), F.col("end").cast("long").alias("at"), "page")
    # an offset stands before the pages that end at it; of pages with one end the first is read last
    down = W.partitionBy("doc").orderBy(F.desc("at"), "kind", F.desc("page")).rowsBetween(W.unboundedPreceding, W.currentRow)
    read = last.unionByName(asked).unionByName(ends).withColumn("found", F.last("page", ignorenulls=True).over(down))
    return read.where(F.col("kind") == 1).select("doc", F.col("offset").cast(offsets.schema["offset"].dataType).alias("offset"), F.coalesce("found", F.lit(1)).alias("page"))


def page_count(text: Column) -> Column:
    return F.size(F.split(text, "\f"))
