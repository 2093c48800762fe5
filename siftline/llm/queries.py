"""Queries of the training-data problems, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.clustering import cluster_vectors, describe_clusters, number_clusters, text_vectors
from siftline.llm.components import pairs_of_groups
from siftline.llm.knn import k_nearest
from siftline.llm.mixture import mix_sources, mixture_report
from siftline.llm.names import common_table, link_entities, name_pairs, short_form_table, vocabulary_table
from siftline.llm.near_duplicates import duplicate_fields, near_duplicate_links, near_duplicate_pairs
from siftline.llm.pii import given_table, mask_pii, pii_findings
from siftline.llm.splitting import split_oversized, word_count
from siftline.llm.subjects import document_subjects
from siftline.llm.tokenize import encode_corpus
from siftline.sources.shared import materialize
from siftline.sources.tables import table


def _valid_files(spark: SparkSession, d: str) -> DataFrame:
    """The valid row of each file: highest version, then latest update."""
    return table(spark, d, "source_document").where(F.col("id").isNotNull()).groupBy(F.col("id").alias("document_id")).agg(F.max_by(F.struct("chunk_size", "chunk_overlap"), F.struct("version", "updated_at", "chunk_size")).alias("p")).select("document_id", "p.*")


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "chunk_vector").where(F.col("model") == "minihash-96-v2").select("chunk_id", "embedding")
    return k_nearest(vectors, id="chunk_id", dim=96, k=10, min_similarity=0.75)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = p1_neighbours(spark, d)
    return near.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(*near_duplicate_links(table(spark, d, "chunk").select("id", "text")))


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_fields(*near_duplicate_links(table(spark, d, "chunk").select("id", "text")))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return materialize(text_vectors(table(spark, d, "chunk"), "id", "text"), "texts")


def p3_assignment(spark: SparkSession, d: str) -> DataFrame:
    return number_clusters(cluster_vectors(_vectors(spark, d))).select("id", "cluster_id")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    return describe_clusters(cluster_vectors(vectors), vectors)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    probe = table(spark, d, "cluster_probe").select("batch", F.col("chunk_id").alias("id")).distinct()
    return pairs_of_groups(probe.join(cluster_vectors(_vectors(spark, d)), "id"), ["batch", "cluster"], "id").select("batch", "id_a", "id_b")


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    vertices = table(spark, d, "vertex").select("id", "name", "type", "description", "aliases")
    mentions = table(spark, d, "extracted_entity").select("name", "type", "description", "aliases")
    read = vertices.drop("id").unionByName(mentions).select(F.trim("name").alias("name"), F.upper(F.trim("type")).alias("type"), "description", "aliases")
    known = read.select("name", "type").distinct()
    common = materialize(common_table(known.where(F.col("type").isin("ORGANIZATION", "LOCATION", "PRODUCT")).select("name", F.lit(False).alias("person")), least=5), "common")
    given = materialize(given_table(known.where(F.col("type") == "PERSON")), "given")
    short = short_form_table(read, vocabulary_table(given, common))
    return link_entities(vertices.where(F.col("id").isNotNull()), vocabulary_table(given, common, short))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(p4_entities(spark, d))


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    files = _valid_files(spark, d)
    least = files.agg(F.min("chunk_size").alias("least"))  # one row: texts no file calls oversized stay out of the join
    chunks = table(spark, d, "chunk").select("id", "document_id", "text").withColumn("n", word_count(F.col("text"))).join(F.broadcast(least), F.col("n") > F.col("least")).select("id", "document_id", "text")
    return chunks.join(files, "document_id").dropDuplicates(["id"])


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_oversized(spark, d)).where(F.col("boundary") != "whole")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where(F.col("piece") == 1).select("id")


def _texts_with_pii(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk").select(F.lit("chunk").alias("record_kind"), F.col("id"), "text")
    questions = table(spark, d, "eval_question").select(F.lit("eval_question").alias("record_kind"), F.col("id").cast("string").alias("id"), F.col("question").alias("text"))
    return chunks.unionByName(questions)


def _given(spark: SparkSession, d: str) -> DataFrame:
    return given_table(table(spark, d, "extracted_entity").where(F.upper(F.trim("type")) == "PERSON"))


def _key(spark: SparkSession) -> bytes:
    """The key of pseudonyms, a setting of the session; without one stand-ins are for show only."""
    return spark.conf.get("spark.siftline.pseudonym.key", "for show only").encode()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts_with_pii(spark, d).select(F.concat_ws("\t", "record_kind", "id").alias("key"), "text")
    found = pii_findings(texts, _given(spark, d), id="key", key=_key(spark))
    parts = F.split("record_id", "\t", 2)
    return found.select(parts[0].alias("record_kind"), parts[1].alias("record_id"), "start_offset", "end_offset", "type")


def p6_masked(spark: SparkSession, d: str) -> DataFrame:
    return mask_pii(_texts_with_pii(spark, d), _given(spark, d), key=_key(spark)).select("record_kind", "id", "masked", "pseudonymous")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _document_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return encode_corpus(docs, out="n_tokens", count_only=True).select("doc_id", "source", "n_tokens")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture_report(materialize(_document_sizes(spark, d), "sizes"), table(spark, d, "mix_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).where(~F.col("reachable")).select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(materialize(_document_sizes(spark, d), "sizes"), table(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return document_subjects(table(spark, d, "documents").select("doc_id", "text", "lang"), table(spark, d, "subject_label"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "subject_area").select("subject").distinct()
    return p9_shares(spark, d).select("doc_id", "subject").join(known, "subject", "left_semi").select("doc_id", "subject")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_fields, p3_found, p3_assignment, p3_clusters, p4_found, p4_entities, p5_found, p5_pieces, p6_found, p6_masked, p7_ids, p8_found, p8_report, p8_mix, p9_found, p9_shares)}


WORDS = r"len(regexp_extract_all(coalesce(c.text, ''), '[^ \t\r\n]+'))"


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"""
            select distinct c.id from chunk c
            join (select id, arg_max(chunk_size, version) as chunk_size from source_document group by id) f on f.id = c.document_id
            where {WORDS} > f.chunk_size""",
    }
