"""Property graph with provenance: merge, removal, neighbourhood, search, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.functions.text import normalise_name
from siftline.sources.shared import materialize

# Entity types; any other is OTHER.
TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "PRODUCT", "CONCEPT", "EVENT", "DATE", "OTHER")
MAX_ENTITIES, MAX_NAME, MAX_DESCRIPTION, MAX_ALIASES = 20, 120, 300, 5


def entity_type(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.isin(*TYPES), t).otherwise("OTHER")


def validate_extraction(entities: DataFrame) -> DataFrame:
    """(chunk_id, entities, accepted): one name out of bounds or too many entities rejects the whole chunk."""
    size = F.length(F.col("name"))
    return entities.groupBy("chunk_id").agg(F.count("*").alias("entities"), ((F.count("*") <= MAX_ENTITIES) & F.bool_and(F.coalesce((size >= 1) & (size <= MAX_NAME), F.lit(False)))).alias("accepted"))


def merge_entities(mentions: DataFrame) -> DataFrame:
    """One vertex a normalised name. ``mentions``: seq, name, type, description, chunk_id.

    The first spelling is kept; type and description are the first that say
    something; provenance is a count of distinct chunks. Every attribute is an
    aggregate with map-side combine, so a name with very many mentions is no hot task.
    """
    m = mentions.withColumn("key", normalise_name(F.col("name"))).where(F.col("key") != "")
    first = lambda c, when=None: F.min_by(c, F.when(when, F.col("seq")) if when is not None else F.col("seq"))
    kind = entity_type(F.col("type"))
    return m.groupBy("key").agg(
        first(F.col("name")).alias("name"), F.coalesce(first(kind, kind != "OTHER"), F.lit("OTHER")).alias("type"), F.coalesce(first(F.col("description"), F.coalesce(F.col("description"), F.lit("")) != ""), F.lit("")).alias("description"),
        F.count_distinct("chunk_id").alias("chunks"), F.count("*").alias("mentions"),
    )


def alias_claims(mentions: DataFrame, vertices: DataFrame) -> DataFrame:
    """(alias, key): the first vertex to claim an alias that is no vertex itself. ``mentions``: seq, name, aliases."""
    claims = mentions.select("seq", normalise_name(F.col("name")).alias("key"), F.explode("aliases").alias("a")).withColumn("alias", normalise_name(F.col("a")))
    claims = claims.where((F.col("alias") != "") & (F.col("alias") != F.col("key")) & (F.col("key") != ""))
    free = claims.join(vertices.select(F.col("key").alias("alias")), "alias", "left_anti")
    return free.groupBy("alias").agg(F.min_by("key", F.struct("seq", "key")).alias("key"))


def merge_relations(relations: DataFrame, vertices: DataFrame) -> DataFrame:
    """(source, relation, target, provenance): merged by ends and relation; missing ends, self-loops and empty relations dropped."""
    keys = vertices.select("key")
    kept = relations.where((F.col("source") != F.col("target")) & (F.col("relation") != "")).join(keys.withColumnRenamed("key", "source"), "source", "left_semi").join(keys.withColumnRenamed("key", "target"), "target", "left_semi")
    return kept.groupBy("source", "relation", "target").agg(F.count_distinct("chunk_id").alias("provenance"))


def degrees(edges: DataFrame) -> DataFrame:
    """(key, degree): in and out, multi-edges counted."""
    return edges.select(F.explode(F.array("source", "target")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))


def remove_provenance(owners: DataFrame, gone: DataFrame, replace: DataFrame | None = None) -> DataFrame:
    """(key, chunk_ids) after chunks vanish or give way to others; owners left without provenance go.

    ``owners``: key, chunk_ids. ``gone``: chunk_id. ``replace``: chunk_id, by.
    """
    links = owners.select("key", F.explode("chunk_ids").alias("chunk_id"))
    if replace is not None:
        links = links.join(replace, "chunk_id", "left").select("key", F.coalesce("by", "chunk_id").alias("chunk_id"))
    kept = links.join(gone, "chunk_id", "left_anti")
    return kept.groupBy("key").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, limit: int = 200) -> DataFrame:
    """(query_id, key, hop): breadth first from the seeds, at most ``limit`` vertices a query, nearest first.

    Order within a level is that of a queue: by the place of the vertex that reached
    it first, then by key. ``seeds``: query_id, key.
    """
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    w = W.partitionBy("query_id")
    found = seeds.distinct().withColumn("pos", F.row_number().over(w.orderBy("key"))).where(F.col("pos") <= limit).select("query_id", "key", F.lit(0).alias("hop"), "pos")
    found = materialize(found, "bfs")
    for hop in range(1, hops + 1):
        frontier = found.where(F.col("hop") == hop - 1).select("query_id", F.col("key").alias("source"), "pos")
        reached = frontier.join(both, "source").groupBy("query_id", F.col("target").alias("key")).agg(F.min("pos").alias("by"))
        new = reached.join(found.select("query_id", "key"), ["query_id", "key"], "left_anti")
        last = found.groupBy("query_id").agg(F.max("pos").alias("last"))
        new = new.withColumn("r", F.row_number().over(w.orderBy("by", "key"))).join(last, "query_id").withColumn("pos", (F.col("last") + F.col("r")).cast("int")).where(F.col("pos") <= limit)
        found = materialize(found.unionByName(new.select("query_id", "key", F.lit(hop).alias("hop"), "pos")), "bfs")
    return found.select("query_id", "key", "hop")


def induced_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    keys = kept.select("key").distinct()
    return edges.join(keys.withColumnRenamed("key", "source"), "source", "left_semi").join(keys.withColumnRenamed("key", "target"), "target", "left_semi")


def evidence(vertex_chunks: DataFrame, edge_chunks: DataFrame, hops: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, via, rank) from citing vertices and edges of a neighbourhood.

    ``vertex_chunks``: key, name, chunk_id. ``edge_chunks``: source, target, chunk_id.
    ``hops``: query_id, key, hop. Scores are rounded before they are ordered.
    """
    v = hops.join(vertex_chunks, "key").select("query_id", "chunk_id", (1.0 / (1 + F.col("hop"))).alias("s"), "name")
    a, b = hops.toDF("query_id", "source", "ha"), hops.toDF("query_id", "target", "hb")
    e = edge_chunks.join(a, "source").join(b, ["query_id", "target"]).select("query_id", "chunk_id", (1.0 / (1 + F.greatest("ha", "hb"))).alias("s"), F.lit(None).cast("string").alias("name"))
    g = v.unionByName(e).groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 4).alias("score"), F.array_sort(F.collect_set("name")).alias("via"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def find(vertices: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    """Vertices whose key or alias holds the needle: exact first, then degree, then key. ``vertices``: key, aliases, degree."""
    n = F.lit(needle)
    hit = F.contains("key", n) | F.exists("aliases", lambda a: F.contains(normalise_name(a), n))
    return vertices.where(hit).orderBy((F.col("key") != n), F.desc("degree"), "key").limit(limit)


def overview(vertices: DataFrame, types: list[str] | None, limit: int) -> DataFrame:
    kept = vertices.where(F.col("type").isin(types)) if types else vertices
    return kept.orderBy(F.desc("degree"), "key").limit(limit)


def match_vertices(exact: DataFrame, similar: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, key, score, exact): the best of each key, exact matches first, at most ``limit`` a query."""
    both = exact.select("query_id", "key", F.lit(1.0).alias("score"), F.lit(True).alias("exact")).unionByName(similar.select("query_id", "key", "score", F.lit(False).alias("exact")))
    best = both.groupBy("query_id", "key").agg(F.max_by("score", F.struct("exact", "score")).alias("score"), F.bool_or("exact").alias("exact"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("score"), "key"))).where(F.col("rank") <= limit)


def triples(edges: DataFrame, names: DataFrame, hops: DataFrame, limit: int = 30) -> DataFrame:
    """(query_id, source, relation, target, hop, rank): edges of a neighbourhood in words, nearest first."""
    a, b = hops.toDF("query_id", "source", "ha"), hops.toDF("query_id", "target", "hb")
    e = edges.join(a, "source").join(b, ["query_id", "target"]).withColumn("hop", F.greatest("ha", "hb"))
    e = e.join(names.toDF("source", "source_name"), "source").join(names.toDF("target", "target_name"), "target")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("hop", "source_name", "relation", "target_name"))
    return e.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", F.col("source_name").alias("source"), "relation", F.col("target_name").alias("target"), "hop", "rank")
