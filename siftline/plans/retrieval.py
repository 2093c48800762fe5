"""Queries of vectors, clusters, filters, fusion and rerank."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.functions import vectors as V
from siftline.operators import clusters, corpus, dedup, retrieval
from siftline.plans.ingest import CHUNKS, DOCS, chunks, documents
from siftline.sources.tables import table

QUERIES, ORACLE = {}, {}
DOT = "list_dot_product(a.embedding::double[], b.embedding::double[])"
RUNS = "(select run_id, rank_no, chunk_id, any_value(similarity) as similarity, any_value(rerank_score) as rerank_score from retrieval_candidate group by all)"
UNIQUE = "(select run_id, chunk_id, min(rank_no) as rank_no, max(similarity) as similarity, max(rerank_score) as rerank_score from retrieval_candidate group by 1, 2)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def asked(e: DataFrame) -> DataFrame:
    """The stated query set of searches: ids divisible by 20."""
    return e.where(F.col("id") % 20 == 0)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk of a run once: first rank, best scores."""
    return table(spark, d, "retrieval_candidate").groupBy(F.col("run_id").alias("query_id"), "chunk_id").agg(F.min("rank_no").alias("rank"), F.max("similarity").alias("similarity"), F.max("rerank_score").alias("rerank_score"))


@query("select vec_id as id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, round(embedding[1]::double / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-12), 6) as first from embeddings")
def prj7_l2_norm(spark, d):
    e = embeddings(spark, d)
    return e.select("id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(V.l2_normalise(F.col("v"))[0], 6).alias("first"))


@query()
def prj8_principal_plane(spark, d):
    return clusters.principal_plane(embeddings(spark, d).select("id", "v"))


@query(f"select a.vec_id as query_id, b.vec_id as id, round({DOT}, 6) as similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 qualify row_number() over (partition by a.vec_id order by round({DOT}, 9) desc, b.vec_id) = 1")
def jn6_nearest_neighbour(spark, d):
    e = embeddings(spark, d).select("id", "v")
    return V.exact_top_k(asked(e), e, 1).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query(f"select a.vec_id as query_id, b.vec_id as id, round({DOT}, 6) as similarity from embeddings a join embeddings b on a.vec_id > b.vec_id where a.vec_id % 20 = 0 qualify row_number() over (partition by a.vec_id order by round({DOT}, 9) desc, b.vec_id) = 1")
def jn7_best_earlier(spark, d):
    e = embeddings(spark, d).select("id", "v")
    return V.exact_top_k(asked(e), e, 1, earlier=True).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query(f"""with old as (select a.vec_id as id, coalesce(case when b.vec_id % 7 = 0 and b.vec_id > 0 then b.vec_id - 1 end, b.vec_id) as parent, {DOT} as s from embeddings a join embeddings b on b.vec_id % 20 <> 0 where a.vec_id % 20 = 0 qualify row_number() over (partition by a.vec_id order by round({DOT}, 9) desc, b.vec_id) = 1),
  new as (select a.vec_id as id, b.vec_id as parent, {DOT} as s from embeddings a join embeddings b on a.vec_id > b.vec_id and b.vec_id % 20 = 0 where a.vec_id % 20 = 0 qualify row_number() over (partition by a.vec_id order by round({DOT}, 9) desc, b.vec_id) = 1),
  l as (select coalesce(o.id, n.id) as id, n.s is not null and (o.s is null or n.s > o.s) as by_batch, o.parent as op, o.s as os, n.parent as np, n.s as ns from (select * from old where s >= 0.3) o full join (select * from new where s >= 0.3) n on n.id = o.id)
  select id, case when by_batch then 'batch' else 'existing' end as source, case when by_batch then np else op end as parent, round(case when by_batch then ns else os end, 6) as similarity from l""")
def jn8_link_batch(spark, d):
    """Rows of the stated query set arrive as a batch and are linked to earlier rows of it or to stored rows and their roots."""
    e = embeddings(spark, d).select("id", "v")
    batch, stored = asked(e), e.where(F.col("id") % 20 != 0)
    earlier = V.exact_top_k(batch, batch, 1, earlier=True).select(F.col("query_id").alias("id"), F.col("id").alias("earlier"), "similarity")
    root = F.when((F.col("chunk_id") % 7 == 0) & (F.col("chunk_id") > 0), F.col("chunk_id") - 1)  # what the stored row is a duplicate of
    nearest = V.exact_top_k(batch, stored, 1).select(F.col("query_id").alias("id"), F.col("id").alias("chunk_id"), "similarity").withColumn("dup_of", root)
    return dedup.link_batch(earlier, nearest, 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"select a.vec_id as query_id, b.vec_id as id, round({DOT}, 6) as similarity, row_number() over (partition by a.vec_id order by round({DOT}, 9) desc, b.vec_id)::int as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 and b.label < 8 qualify rank <= 10")
def vec3_knn_topk(spark, d):
    e = embeddings(spark, d)
    return V.exact_top_k(asked(e).select("id", "v"), e.where("label < 8").select("id", "v"), 10).withColumn("similarity", F.round("similarity", 6))


@query(f"""select query_id, id, similarity from (select a.vec_id as query_id, b.vec_id as id, round({DOT}, 6) as similarity, row_number() over (partition by a.vec_id order by round({DOT}, 9) desc, b.vec_id) as r from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) where r <= 3 and similarity >= 0.3""")
def vec6_entity_search(spark, d):
    # the best three of each probe first, the threshold after
    e = embeddings(spark, d).select("id", "v")
    best = V.exact_top_k(asked(e), e, 3).select("query_id", "id", F.round("similarity", 6).alias("similarity"))
    return best.where(F.col("similarity") >= 0.3)


@query(f"select a.vec_id as id, round(coalesce({DOT} / nullif(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 0), 0), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def vec5_exact_cosine(spark, d):
    e = embeddings(spark, d)
    nxt = e.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return e.join(nxt, "id").select("id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("similarity"))


@query(f"""with c as (select id, is_duplicate_of as head from {CHUNKS}), h as (select u.run_id as query_id, u.chunk_id, u.rank_no as rank, u.similarity, case when k.id is not null then c.head else u.chunk_id end as key from {UNIQUE} u left join c on c.id = u.chunk_id left join c k on k.id = c.head)
  select query_id, key as chunk_id, max(similarity) as similarity, coalesce(list(chunk_id order by rank, chunk_id) filter (where chunk_id <> key), []) as collapsed_from, row_number() over (partition by query_id order by min(rank), key)::int as rank from h group by query_id, key""")
def vec4_collapse(spark, d):
    canonical = chunks(spark, d).select(F.col("id").alias("chunk_id"), F.col("is_duplicate_of").alias("head"))
    return retrieval.collapse(candidates(spark, d).select("query_id", "rank", "chunk_id", "similarity"), canonical)


@query(f"select c.id from {CHUNKS} c where c.document_id in (select id from {DOCS} where status = 'ready') and c.cluster_id in (0, 1, 2)")
def flt1_metadata_filter(spark, d):
    ready = documents(spark, d).where(F.col("status") == "ready").select(F.col("id").alias("document_id"))
    return chunks(spark, d).where(F.col("cluster_id").isin(0, 1, 2)).join(ready, "document_id", "left_semi").select("id")


@query(f"select u.run_id, u.chunk_id, coalesce(c.cluster_id in (0, 1, 2), false) as passes from {UNIQUE} u left join {CHUNKS} c on c.id = u.chunk_id")
def flt2_filter_after_search(spark, d):
    c = chunks(spark, d).select(F.col("id").alias("chunk_id"), "cluster_id")
    return candidates(spark, d).join(c, "chunk_id", "left").select(F.col("query_id").alias("run_id"), "chunk_id", F.coalesce(F.col("cluster_id").isin(0, 1, 2), F.lit(False)).alias("passes"))


@query(f"select run_id, chunk_id, case when similarity < 0.6 then printf('similarity %.2f < threshold %.2f', similarity, 0.6::double) end as reason from {UNIQUE}")
def flt3_threshold_reason(spark, d):
    return candidates(spark, d).select(F.col("query_id").alias("run_id"), "chunk_id", retrieval.below_threshold(F.col("similarity"), 0.6).alias("reason"))


@query(f"select c.id from {CHUNKS} c where c.document_id not in (select id from {DOCS} where extension = 'pdf')")
def flt4_not_in_documents(spark, d):
    pdf = documents(spark, d).where(F.col("extension") == "pdf").select(F.col("id").alias("document_id"))
    return chunks(spark, d).select("id", "document_id").join(pdf, "document_id", "left_anti").select("id")


@query(f"select id, document_id from {CHUNKS} where page <= 2 and page_end >= 2 and is_duplicate_of is null")
def flt5_page_containment(spark, d):
    return chunks(spark, d).where((F.col("page") <= 2) & (F.col("page_end") >= 2) & F.col("is_duplicate_of").isNull()).select("id", "document_id")


@query(f"select id, filename from {DOCS} where status = 'ready'")
def flt8_ready_documents(spark, d):
    return documents(spark, d).where(F.col("status") == "ready").select("id", "filename")


@query(f"""with cur as (select chunk_size, list(sha256 order by sha256) as now from {DOCS} where status = 'ready' group by 1), idx as (select chunk_size, list(sha256 order by sha256) as built from (select * from source_document qualify row_number() over (partition by id order by version, updated_at) = 1) where status = 'ready' group by 1)
  select chunk_size, coalesce(now <> built, true) as stale from cur left join idx using (chunk_size)""")
def flt9_stale_index(spark, d):
    # the index of each chunk size was built from first versions; counts by content are compared, no list is gathered
    count = lambda df, name: df.where(F.col("status") == "ready").groupBy("chunk_size", "sha256").agg(F.count("*").alias(name))
    first = table(spark, d, "source_document").groupBy("id").agg(F.min_by(F.struct("status", "chunk_size", "sha256"), F.struct("version", "updated_at")).alias("f")).select("id", "f.*")
    now, built = count(documents(spark, d), "now"), count(first, "built")
    both = now.join(built, ["chunk_size", "sha256"], "full_outer").groupBy("chunk_size").agg(F.bool_or(~F.col("now").eqNullSafe(F.col("built"))).alias("stale"))
    return both.join(now.select("chunk_size").distinct(), "chunk_size", "left_semi")


@query("select distinct s.sha256 as sha from (select unnest(relevant_spans).sha256 as sha256 from eval_question) s where s.sha256 is not null and s.sha256 not in (select sha256 from source_document where sha256 is not null)")
def flt10_missing_originals(spark, d):
    s = table(spark, d, "eval_question").select(F.explode("relevant_spans.sha256").alias("sha")).where(F.col("sha").isNotNull()).distinct()
    return s.join(table(spark, d, "source_document").select(F.col("sha256").alias("sha")), "sha", "left_anti")


CENTROID_SQL = "(with p as (select label, i, avg(x) as m from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2) select label, list(m order by i) as m, sqrt(sum(m * m)) as n from p group by 1)"


@query(f"select label as cluster_id, round(m[1] / greatest(n, 1e-12), 5) as first, round(m[64] / greatest(n, 1e-12), 5) as last from {CENTROID_SQL}")
def agg5_centroids(spark, d):
    c = clusters.centroids(embeddings(spark, d).select(F.col("label").alias("cluster_id"), "v"))
    return c.select("cluster_id", F.round(F.element_at("centroid", 1), 5).alias("first"), F.round(F.element_at("centroid", -1), 5).alias("last"))


@query(f"select e.vec_id as id, round(max(list_dot_product(e.embedding::double[], c.m) / greatest(c.n, 1e-12)), 5) as score from embeddings e, {CENTROID_SQL} c where e.vec_id % 20 = 0 group by 1")
def agg6_off_topic(spark, d):
    e = embeddings(spark, d)
    c = clusters.centroids(e.select(F.col("label").alias("cluster_id"), "v")).select(F.col("cluster_id").cast("long").alias("id"), F.col("centroid").alias("v"))
    shifted = c.withColumn("id", -1 - F.col("id"))  # apart from the ids of queries
    return V.exact_top_k(asked(e).select("id", F.col("v").cast("array<double>").alias("v")), shifted, 1).select(F.col("query_id").alias("id"), F.round("similarity", 5).alias("score"))


@query(f"""with v as (select run_id as query_id, chunk_id, row_number() over (partition by run_id order by rank_no, chunk_id) as rv from {UNIQUE}), g as (select run_id as query_id, chunk_id, row_number() over (partition by run_id order by rerank_score desc, chunk_id) as rg from {UNIQUE} where rerank_score is not null)
  , f as (select query_id, chunk_id, rv, rg, round(coalesce(0.7 / (60 + rv), 0) + coalesce((1 - 0.7::double) / (60 + rg), 0), 9) as score, case when rv is not null and rg is not null then 'both' when rv is not null then 'vector' else 'graph' end as source from v full outer join g using (query_id, chunk_id))
  select query_id, chunk_id, score, source, row_number() over (partition by query_id order by score desc, rv nulls last, rg nulls last, chunk_id)::int as rank from f where score > 0""")
def rnk1_weighted_rrf(spark, d):
    return retrieval.weighted_rrf(*_two_lists(spark, d), 0.7)


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vector order and, for evidence from elsewhere, the order of rerank scores."""
    c = candidates(spark, d)
    return retrieval.ranked_unique(c, [F.col("rank")]), retrieval.ranked_unique(c.where(F.col("rerank_score").isNotNull()), [F.desc("rerank_score")])


@query(f"""with v as (select run_id as query_id, chunk_id, row_number() over (partition by run_id order by rank_no, chunk_id) as rv from {UNIQUE}), g as (select * from (select run_id as query_id, chunk_id, row_number() over (partition by run_id order by rerank_score desc, chunk_id) as rg from {UNIQUE} where rerank_score is not null) where rg <= 5 and chunk_id in (select id from {CHUNKS} where is_duplicate_of is null))
  , f as (select query_id, chunk_id, rv, rg, round(coalesce(0.7 / (60 + rv), 0) + coalesce((1 - 0.7::double) / (60 + rg), 0), 9) as score, case when rv is not null and rg is not null then 'both' when rv is not null then 'vector' else 'graph' end as source from v full outer join g using (query_id, chunk_id))
  , r as (select query_id, chunk_id, score, source, row_number() over (partition by query_id order by score desc, rv nulls last, rg nulls last, chunk_id)::int as rank from f where score > 0)
  select * from r where rank <= 5 and query_id in (select query_id from g)
  union all select query_id, chunk_id, round(0.7 / (60 + rv), 9), 'vector', rv::int from v where rv <= 5 and query_id not in (select query_id from g)""")
def rnk2_fusion_stage(spark, d):
    allowed = chunks(spark, d).where(F.col("is_duplicate_of").isNull()).select(F.col("id").alias("chunk_id"))
    return retrieval.fuse(*_two_lists(spark, d), allowed, 0.7, 5)


@query(f"""with v as (select run_id as query_id, chunk_id, rank_no from {UNIQUE}), g as (select run_id as query_id, chunk_id from {UNIQUE} where rerank_score is not null)
  select v.query_id, count(*) filter (where g.chunk_id is not null) as both_lists, count(*) filter (where g.chunk_id is null) as vector_only from v left join g using (query_id, chunk_id) group by 1""")
def agg17_source_counts(spark, d):
    f = retrieval.weighted_rrf(*_two_lists(spark, d), 0.7)
    return f.groupBy("query_id").agg(F.count_if(F.col("source") == "both").alias("both_lists"), F.count_if(F.col("source") == "vector").alias("vector_only"))


QA_SQL = f"(select distinct q.id as query_id, s.chunk_id, q.question, c.text from (select id, question, unnest(relevant_spans) as s from eval_question) q join {CHUNKS} c on c.id = q.s.chunk_id)"
OVERLAP_SQL = "len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))))::double / nullif(len(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))), 0)"


@query(f"""with s as (select query_id, chunk_id, round(coalesce({OVERLAP_SQL}, 0), 6) as score, row_number() over (partition by query_id order by chunk_id)::int as before from {QA_SQL})
  select *, row_number() over (partition by query_id order by score desc, before, chunk_id)::int as after from s qualify after <= 4""")
def rnk3_overlap_rerank(spark, d):
    return _reranked(spark, d, 4)


def _reranked(spark: SparkSession, d: str, top_n: int) -> DataFrame:
    s = table(spark, d, "eval_question").select(F.col("id").alias("query_id"), "question", F.explode("relevant_spans.chunk_id").alias("chunk_id")).distinct()
    c = chunks(spark, d).select(F.col("id").alias("chunk_id"), "text")
    ranked = s.join(c, "chunk_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("chunk_id")))
    return retrieval.rerank(ranked, retrieval.overlap_score(F.col("question"), F.col("text")), top_n).select("query_id", "chunk_id", "score", "before", "after")


@query(f"""with s as (select query_id, chunk_id, round(coalesce({OVERLAP_SQL}, 0), 6) as score, row_number() over (partition by query_id order by chunk_id)::int as before from {QA_SQL}), r as (select *, row_number() over (partition by query_id order by score desc, before, chunk_id)::int as after from s qualify after <= 4)
  select query_id, count(*) filter (where before <> after) as moved from r group by 1""")
def rnk8_moved(spark, d):
    return _reranked(spark, d, 4).groupBy("query_id").agg(F.count_if(F.col("before") != F.col("after")).alias("moved"))


@query(f"select id, document_id, chunk_index from {CHUNKS} order by document_id, chunk_index, id limit 50 offset 100")
def rnk4_page(spark, d):
    return chunks(spark, d).select("id", "document_id", "chunk_index").orderBy("document_id", "chunk_index", "id").offset(100).limit(50)


@query("select arg_max(id, (updated_at, id)) as id, max(updated_at) as updated_at from source_document where status = 'ready'")
def rnk5_latest_ingest(spark, d):
    return table(spark, d, "source_document").where(F.col("status") == "ready").agg(F.max_by("id", F.struct("updated_at", "id")).alias("id"), F.max("updated_at").alias("updated_at"))


@query(f"select id, row_number() over (order by created_at desc, id)::int as place from {DOCS}")
def rnk6_newest_first(spark, d):
    # places by range partitions: no task sorts the whole table
    t = documents(spark, d).select("id", "created_at").repartitionByRange(F.desc("created_at"), "id").sortWithinPartitions(F.desc("created_at"), "id").withColumn("part", F.spark_partition_id())
    from siftline.sources.shared import materialize

    t = materialize(t, "ordered")
    before = t.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy().orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.desc("created_at"), "id"))
    return t.withColumn("r", inside).join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("r")).cast("int").alias("place"))


@query()
def rnk7_seeded_sample(spark, d):
    return chunks(spark, d).where(F.col("is_duplicate_of").isNull()).select("id").orderBy(F.xxhash64("id", F.lit(42)), "id").limit(40)


@query(f"""with u as (select run_id as query_id, chunk_id, rank_no::bigint as p from {UNIQUE} union all select run_id, chunk_id, 1000 + row_number() over (partition by run_id order by rerank_score desc, chunk_id) from {UNIQUE} where rerank_score is not null)
  select query_id, chunk_id, row_number() over (partition by query_id order by min(p), chunk_id)::int as place from u group by 1, 2""")
def set1_ordered_union(spark, d):
    v, g = _two_lists(spark, d)
    first = candidates(spark, d).select("query_id", "chunk_id", F.col("rank").cast("long").alias("p"))
    both = first.unionByName(g.select("query_id", "chunk_id", (F.col("rank") + 1000).cast("long").alias("p"))).groupBy("query_id", "chunk_id").agg(F.min("p").alias("p"))
    return both.select("query_id", "chunk_id", F.row_number().over(W.partitionBy("query_id").orderBy("p", "chunk_id")).alias("place"))


@query("select vec_id as id, (dense_rank() over (order by first) - 1)::int as cluster_id from (select vec_id, min(vec_id) over (partition by label) as first from embeddings)")
def clu4_renumber(spark, d):
    return clusters.renumber(embeddings(spark, d).select("id", "label"))


@query()
def clu3_choose_k(spark, d):
    return clusters.choose_k(embeddings(spark, d).select("id", F.col("v").cast("array<double>").alias("v")), most=12, restarts=10)


@query("select label as cluster_id, count(*) as size, left(sha256(string_agg(vec_id::varchar, chr(10) order by vec_id::varchar)), 16) as member_hash from embeddings group by 1")
def agg11_member_hash(spark, d):
    return clusters.member_hash(embeddings(spark, d).select("id", F.col("label").alias("cluster_id")))


STOP_SQL = ", ".join(f"'{w}'" for w in clusters.STOP_WORDS)
TERM_SQL = f"""with t as (select cluster_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as term from {CHUNKS} where cluster_id >= 0), c as (select cluster_id, term, count(*) as n from t where term not in ({STOP_SQL}) group by 1, 2),
  d as (select term, count(*) as df from c group by 1), w as (select cluster_id, term, (1 + ln(n)) * (ln((1 + (select count(distinct cluster_id) from c)) / (1 + df)::double) + 1) as w from c join d using (term)),
  s as (select cluster_id, term, round(w / sqrt(sum(w * w) over (partition by cluster_id)), 6) as score from w), r as (select *, row_number() over (partition by cluster_id order by score desc, term)::int as rank from s)"""


@query(f"{TERM_SQL} select cluster_id, rank, term, score from r where rank <= 3")
def agg12_tfidf_labels(spark, d):
    return clusters.key_terms(chunks(spark, d).where(F.col("cluster_id") >= 0).select("cluster_id", "text"))


@query(f"select count(*) as kept, count(distinct term) as terms from (select unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as term from {CHUNKS}) where term not in ({STOP_SQL})")
def agg13_stop_words(spark, d):
    t = chunks(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{3,})"), F.lit(1))).alias("term")).where(~F.col("term").isin(*clusters.STOP_WORDS))
    return t.agg(F.count("*").alias("kept"), F.count_distinct("term").alias("terms"))


@query(f"""{TERM_SQL}, l as (select cluster_id, string_agg(upper(left(term, 1)) || substr(term, 2), ', ' order by rank) as label from r where rank <= 3 group by 1), ids as (select distinct cluster_id from {CHUNKS} where cluster_id is not null)
  select i.cluster_id, coalesce(l.label, 'Topic ' || i.cluster_id) as label, 'keywords' as label_source from ids i left join l using (cluster_id)""")
def clu5_labels(spark, d):
    c = chunks(spark, d)
    ids = c.where(F.col("cluster_id").isNotNull()).select("cluster_id").distinct()
    return clusters.labels(clusters.key_terms(c.where(F.col("cluster_id") >= 0).select("cluster_id", "text")), ids)


@query(f"select id from {CHUNKS} where is_duplicate_of is null union select c.id from {CHUNKS} c join {CHUNKS} o on c.is_duplicate_of = o.id where o.document_id in (select id from {DOCS} where version > 1)")
def set7_canonical_union(spark, d):
    c = chunks(spark, d).select("id", "document_id", "is_duplicate_of")
    gone = documents(spark, d).where(F.col("version") > 1).select(F.col("id").alias("document_id"))
    heads = c.join(gone, "document_id", "left_semi").select(F.col("id").alias("is_duplicate_of"))
    return c.where(F.col("is_duplicate_of").isNull()).select("id").unionByName(c.join(heads, "is_duplicate_of", "left_semi").select("id")).distinct()


HYBRID_SQL = f"""with q as (select vec_id, label from embeddings where vec_id % 20 = 0),
  v as (select a.vec_id as q, b.vec_id as id, row_number() over (partition by a.vec_id order by round({DOT}, 9) desc, b.vec_id) as rv from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 qualify rv <= 10),
  g as (select q.vec_id as q, b.vec_id as id, row_number() over (partition by q.vec_id order by abs(b.vec_id - q.vec_id), b.vec_id) as rg from q join embeddings b on b.vec_id <> q.vec_id and abs(b.vec_id - q.vec_id) <= 10 qualify rg <= 10),
  f as (select q, id, rv, rg, round(coalesce(0.7 / (60 + rv), 0) + coalesce((1 - 0.7::double) / (60 + rg), 0), 9) as s from v full outer join g using (q, id)),
  r as (select q, id, row_number() over (partition by q order by s desc, rv nulls last, rg nulls last, id) as r from f qualify r <= 4)
  select r.q as query_id, max((e.label = q.label)::int)::double as hit, round(coalesce(1.0 / min(r) filter (where e.label = q.label), 0), 6) as mrr from r join embeddings e on e.vec_id = r.id join q on q.vec_id = r.q group by 1"""


@query(HYBRID_SQL)
def hybrid_retrieval_eval(spark, d):
    """Search, a second list by nearness of id, fusion, the best four, hit and reciprocal rank by equal label."""
    e = embeddings(spark, d)
    q = asked(e)
    vector = V.exact_top_k(q.select("id", "v"), e.select("id", "v"), 10).select("query_id", F.col("id").alias("chunk_id"), "rank")
    near = q.select(F.col("id").alias("query_id"), F.explode(F.sequence(F.col("id") - 10, F.col("id") + 10)).alias("id")).where(F.col("id") != F.col("query_id")).join(e.select("id"), "id", "left_semi")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.abs(F.col("id") - F.col("query_id")), "id"))
    graph = near.withColumn("rank", rank).where(F.col("rank") <= 10).select("query_id", F.col("id").alias("chunk_id"), "rank")
    best = retrieval.weighted_rrf(vector, graph, 0.7).where(F.col("rank") <= 4)
    judged = best.join(e.select(F.col("id").alias("chunk_id"), F.col("label").alias("found")), "chunk_id").join(q.select(F.col("id").alias("query_id"), "label"), "query_id")
    same = F.col("found") == F.col("label")
    return judged.groupBy("query_id").agg(F.max(same.cast("double")).alias("hit"), F.round(F.coalesce(1.0 / F.min(F.when(same, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


@query()
def vec1_embed_documents(spark, d):
    from siftline.providers import embed_column

    return chunks(spark, d).where(F.col("text").isNotNull()).select("id", embed_column(F.col("text")).alias("embedding"))


@query()
def clu1_kmeans(spark, d):
    return clusters.kmeans(embeddings(spark, d).select("id", F.col("v").cast("array<double>").alias("v")), 8, restarts=2).select("id", "label")


@query("""with e as (select vec_id, label, embedding::double[] as v from embeddings), n as (select label, count(*) as n from e group by 1),
  d as (select a.vec_id, a.label, b.label as other, sum(1 - list_cosine_similarity(a.v, b.v)) as s from e a join e b on a.vec_id <> b.vec_id group by 1, 2, 3),
  x as (select d.vec_id, sum(case when other = d.label then d.s / (n.n - 1) end) as own, min(case when other <> d.label then d.s / n.n end) as near from d join n on n.label = d.other where other <> d.label or n.n > 1 group by 1)
  select round(avg(coalesce((near - own) / greatest(own, near), 0)), 4) as silhouette from x""")
def clu2_silhouette(spark, d):
    """Of the labels that come with the vectors."""
    labelled = embeddings(spark, d).select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features"), F.col("label").cast("int").alias("label"))
    return spark.createDataFrame([(round(clusters.silhouette(labelled), 4),)], "silhouette double")


@query("select label as cluster_id, count(*) as size from embeddings group by 1")
def agg11_member_fingerprint(spark, d):
    return clusters.member_fingerprint(embeddings(spark, d).select("id", F.col("label").alias("cluster_id"))).select("cluster_id", "size")
