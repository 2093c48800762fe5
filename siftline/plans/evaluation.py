"""Queries of evaluation: relevance, metrics, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.functions import vectors as V
from siftline.operators import evaluation as E
from siftline.operators import retrieval
from siftline.plans.guards import QUESTIONS, answers, questions
from siftline.plans.ingest import CHUNKS, DOCS, chunks, documents
from siftline.plans.retrieval import OVERLAP_SQL, QA_SQL, UNIQUE, candidates
from siftline.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SPAN_SQL = f"(select q.id as query_id, d.id as doc, q.s.start_offset as a, q.s.end_offset as b from (select id, unnest(relevant_spans) as s from {QUESTIONS}) q join {DOCS} d on d.sha256 = q.s.sha256)"


@query(f"select distinct s.query_id, c.id as chunk_id from {SPAN_SQL} s join {CHUNKS} c on c.document_id = s.doc where least(s.b, c.end_offset) - greatest(s.a, c.start_offset) > 0 and least(s.b, c.end_offset) - greatest(s.a, c.start_offset) >= 0.5 * least(s.b - s.a, c.end_offset - c.start_offset)")
def jn10_span_overlap(spark, d):
    return _relevant(spark, d)


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    s = questions(spark, d).select(F.col("id").alias("query_id"), F.explode("relevant_spans").alias("s")).select("query_id", F.col("s.sha256").alias("sha256"), F.col("s.start_offset").alias("a_start"), F.col("s.end_offset").alias("a_end"))
    left = s.join(documents(spark, d).select(F.col("id").alias("doc"), "sha256"), "sha256").drop("sha256")
    right = chunks(spark, d).select(F.col("document_id").alias("doc"), F.col("id").alias("chunk_id"), F.col("start_offset").alias("b_start"), F.col("end_offset").alias("b_end"))
    return E.span_matches(left, right).select("query_id", "chunk_id").distinct()


WANTED = f"(select distinct s.chunk_id from (select unnest(relevant_spans) as s from {QUESTIONS}))"


@query(f"select run_id, chunk_id, bool_or(chunk_id in (select chunk_id from {WANTED}) or len(list_intersect(coalesce(collapsed_from, []), (select list(chunk_id) from {WANTED}))) > 0) as relevant from retrieval_candidate group by 1, 2")
def jn11_item_relevance(spark, d):
    return _judged(spark, d).select(F.col("query_id").alias("run_id"), "chunk_id", "relevant")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with relevance: the chunk or one collapsed into it is asked for by a question."""
    wanted = questions(spark, d).select(F.explode("relevant_spans.chunk_id").alias("item")).distinct().withColumn("hit", F.lit(True))
    items = table(spark, d, "retrieval_candidate").select(F.col("run_id").alias("query_id"), "chunk_id", "rank_no", F.explode(F.concat(F.array("chunk_id"), F.coalesce("collapsed_from", F.array().cast("array<string>")))).alias("item"))
    return items.join(wanted, "item", "left").groupBy("query_id", "chunk_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("relevant"), F.min("rank_no").alias("rank"))


@query(f"""with j as (select run_id, chunk_id, min(rank_no) as rank, bool_or(chunk_id in (select chunk_id from {WANTED}) or len(list_intersect(coalesce(collapsed_from, []), (select list(chunk_id) from {WANTED}))) > 0) as relevant from retrieval_candidate group by 1, 2)
  select run_id as query_id, max(relevant::int)::double as hit, round(coalesce(1.0 / min(rank) filter (where relevant), 0), 6)::double as mrr from j where rank <= 5 group by 1""")
def agg3_4_hit_mrr(spark, d):
    return E.hit_and_rank(_judged(spark, d), 5)


@query(f"select 'similarity' as metric, round(avg(similarity), 4) as mean, count(similarity) as n from {UNIQUE} union all select 'rerank_score', round(avg(rerank_score), 4), count(rerank_score) from {UNIQUE}")
def agg1_metric_means(spark, d):
    return E.metric_means(candidates(spark, d).select("similarity", "rerank_score"), [], ["similarity", "rerank_score"])


@query("select event_type as cell, round(avg(value), 4) as mean_value, count(*) as events, count(distinct user_id) as runs, coalesce(round(avg(value)), 0)::bigint as latency_ms, count(*) filter (where value is null) > 0 as partial from events group by 1")
def agg2_cell_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("cell")).agg(F.round(F.avg("value"), 4).alias("mean_value"), F.count("*").alias("events"), F.count_distinct("user_id").alias("runs"), F.coalesce(F.round(F.avg("value")), F.lit(0)).cast("long").alias("latency_ms"), (F.count_if(F.col("value").isNull()) > 0).alias("partial"))


@query("select coalesce(event_type, 'total') as stage, count(*) as calls, round(sum(value), 2) as units from events group by rollup (event_type)")
def agg14_usage_meter(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("units")).select(F.coalesce("event_type", F.lit("total")).alias("stage"), "calls", "units")


@query(f"select document_id, count(*) as total, count(*) filter (where cluster_id >= 0) as clustered from {CHUNKS} group by 1")
def agg16_totals(spark, d):
    return chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(F.col("cluster_id") >= 0).alias("clustered"))


# stand-in verdicts: a passage supports a question if at least a quarter of its words overlap
JUDGED_SQL = f"(select query_id, chunk_id, coalesce({OVERLAP_SQL}, 0) as o from {QA_SQL})"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    s = questions(spark, d).select(F.col("id").alias("query_id"), "question", F.explode("relevant_spans.chunk_id").alias("chunk_id")).distinct()
    return s.join(chunks(spark, d).select(F.col("id").alias("chunk_id"), "text"), "chunk_id").select("query_id", "chunk_id", retrieval.overlap_score(F.col("question"), F.col("text")).alias("o"))


@query(f"select query_id, round(avg((o < 0.25)::int), 4) as unsupported, round(avg((o >= 0.25)::int), 4) as faithfulness, round(avg((o >= 0.5)::int), 4) as context_precision from {JUDGED_SQL} group by 1")
def agg18_20_judge_shares(spark, d):
    o = F.col("o")
    return _verdicts(spark, d).groupBy("query_id").agg(E.share(o < 0.25).alias("unsupported"), E.share(o >= 0.25).alias("faithfulness"), E.share(o >= 0.5).alias("context_precision"))


@query(f"select q.id as query_id, coalesce(round(avg((j.o >= 0.3)::int), 4), 0) as recall from {QUESTIONS} q left join {JUDGED_SQL} j on j.query_id = q.id group by 1")
def agg21_context_recall(spark, d):
    return questions(spark, d).select(F.col("id").alias("query_id")).join(_verdicts(spark, d), "query_id", "left").groupBy("query_id").agg(F.coalesce(E.share(F.col("o") >= 0.3), F.lit(0.0)).alias("recall"))


@query(f"""with v as (select query_id, count(*) filter (where o >= 0.5) as tp, count(*) filter (where o < 0.25) as fp, count(*) filter (where o >= 0.25 and o < 0.5) as fn, avg(o) as s from {JUDGED_SQL} group by 1)
  select query_id, round(0.75 * coalesce(tp / nullif(tp + 0.5::double * (fp + fn), 0), 0) + 0.25 * greatest(0, s), 4)::double as correctness from v""")
def agg22_correctness(spark, d):
    o = F.col("o")
    v = _verdicts(spark, d).groupBy("query_id").agg(F.count_if(o >= 0.5).alias("tp"), F.count_if(o < 0.25).alias("fp"), F.count_if((o >= 0.25) & (o < 0.5)).alias("fn"), F.avg(o).alias("s"))
    return v.select("query_id", E.correctness(F.col("tp"), F.col("fp"), F.col("fn"), F.col("s")).alias("correctness"))


@query()
def agg23_relevancy(spark, d):
    from siftline.providers import embed_column

    a = answers(spark, d).select("id", X.strip_citations(F.col("answer")).alias("answer")).join(questions(spark, d).select("id", "question"), "id")
    v = a.select("id", embed_column(F.col("question")).alias("q"), embed_column(F.col("answer")).alias("a"))
    return v.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), V.cosine(F.col("q"), F.col("a")))), 4).alias("relevancy"))


@query(f"select chunk_size, count(*) as documents, sum(chunk_count)::bigint as chunks, (2 + 8 * 4) * 10 + sum(chunk_count)::bigint + 12 as calls from {DOCS} where status = 'ready' group by 1")
def agg25_call_estimate(spark, d):
    ready = documents(spark, d).where(F.col("status") == "ready").groupBy("chunk_size").agg(F.count("*").alias("documents"), F.sum("chunk_count").cast("long").alias("chunks"))
    return ready.withColumn("calls", F.lit(E.worst_case_calls(10, 4, [(0, True, False)])).cast("long") + F.col("chunks"))


@query(f"with m as (select run_id, round(avg(similarity), 4) as mean from {UNIQUE} group by 1) select run_id, mean, mean = max(mean) over () as best from m where mean is not null")
def agg26_best_mean(spark, d):
    m = candidates(spark, d).groupBy(F.col("query_id").alias("run_id")).agg(F.round(F.avg("similarity"), 4).alias("mean")).where(F.col("mean").isNotNull())
    return m.crossJoin(F.broadcast(m.agg(F.max("mean").alias("top")))).select("run_id", "mean", (F.col("mean") == F.col("top")).alias("best"))  # top is one row


@query(f"with m as (select run_id, avg(similarity) as s, avg(rerank_score) as r from {UNIQUE} group by 1) select metric from (select 'similarity' as metric, count(s) = count(*) as ok from m union all select 'rerank_score', count(r) = count(*) from m) where ok")
def agg27_comparable_metrics(spark, d):
    m = candidates(spark, d).groupBy("query_id").agg(F.avg("similarity").alias("similarity"), F.avg("rerank_score").alias("rerank_score"))
    long = m.unpivot(["query_id"], ["similarity", "rerank_score"], "metric", "mean")
    return long.groupBy("metric").agg(F.count("mean").alias("n"), F.count("*").alias("all")).where(F.col("n") == F.col("all")).select("metric")


@query(f"with s as (select cluster_id, count(*) as n, row_number() over (order by count(*) desc, cluster_id) as r from {CHUNKS} where cluster_id >= 0 group by 1) select case when r <= 8 then cluster_id::varchar else 'other' end as series, sum(n)::bigint as points from s group by 1")
def agg28_scatter_groups(spark, d):
    s = chunks(spark, d).where(F.col("cluster_id") >= 0).groupBy("cluster_id").agg(F.count("*").alias("n"))
    top = s.orderBy(F.desc("n"), "cluster_id").limit(8).select("cluster_id", F.lit(True).alias("own"))
    return s.join(top, "cluster_id", "left").groupBy(F.when(F.col("own"), F.col("cluster_id").cast("string")).otherwise("other").alias("series")).agg(F.sum("n").cast("long").alias("points"))


@query("select (row_number() over (order by top_k, weight) - 1)::int as cell, top_k, weight from (select unnest([5, 10]) as top_k), (select unnest([0.5::double, 0.7::double, 0.9::double]) as weight)")
def set4_grid(spark, d):
    cells = E.grid({"top_k": [5, 10], "weight": [0.5, 0.7, 0.9]})
    return spark.createDataFrame([(i, c["top_k"], c["weight"]) for i, c in enumerate(cells)], "cell int, top_k int, weight double")


@query(f"select q.id, count(r.chunk_id) as retrieved from (select id, unnest(list_distinct(list_transform(relevant_spans, lambda s: s.chunk_id))) as chunk_id from {QUESTIONS}) q left join (select distinct run_id, chunk_id from retrieval_candidate) r using (chunk_id) group by 1")
def jn2_results_of_questions(spark, d):
    q = questions(spark, d).select("id", F.explode(F.array_distinct("relevant_spans.chunk_id")).alias("chunk_id"))
    r = candidates(spark, d).select("chunk_id", F.col("query_id").alias("run_id"))
    return q.join(r, "chunk_id", "left").groupBy("id").agg(F.count("run_id").alias("retrieved"))


@query(f"select dataset_id, count(*) as questions, count(ground_truth) as answered, sum(len(coalesce(relevant_spans, [])))::bigint as spans from (select distinct id, dataset_id, ground_truth, relevant_spans from eval_question) group by 1")
def jn3_datasets(spark, d):
    q = table(spark, d, "eval_question").dropDuplicates(["id"])
    return q.groupBy("dataset_id").agg(F.count("*").alias("questions"), F.count("ground_truth").alias("answered"), F.sum(F.coalesce(F.size("relevant_spans"), F.lit(0))).cast("long").alias("spans"))


@query()
def gen1_generation(spark, d):
    from siftline.providers import FirstSentence, complete_column

    s = questions(spark, d).select("id", F.explode_outer("relevant_spans.chunk_id").alias("chunk_id"))
    c = s.join(chunks(spark, d).select(F.col("id").alias("chunk_id"), "text"), "chunk_id", "left")
    block = F.when(F.col("text").isNotNull(), F.struct("chunk_id", F.concat(F.lit("["), F.col("chunk_id"), F.lit("] (file)\n"), F.col("text")).alias("b")))
    ctx = c.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n---\n").alias("prompt"))
    asked = ctx.where(F.col("prompt") != "").select("id", complete_column(F.col("prompt"), FirstSentence()).alias("r")).select("id", "r.answer")
    return asked.unionByName(ctx.where(F.col("prompt") == "").select("id", F.lit(X.NO_ANSWER).alias("answer")))


@query(f"select q.id, c.id as chunk_id, c.page from (select id, unnest(list_distinct(list_transform(relevant_spans, lambda s: s.chunk_id))) as chunk_id from {QUESTIONS}) q join {CHUNKS} c on c.id = q.chunk_id")
def gen2_citation_list(spark, d):
    a = answers(spark, d)
    cited = a.select("id", F.explode(X.citations(F.col("answer"), F.col("ids"))[0]).alias("chunk_id"))
    return cited.join(chunks(spark, d).select(F.col("id").alias("chunk_id"), "page"), "chunk_id").select("id", "chunk_id", "page")


@query()
def gen3_synthetic_set(spark, d):
    pool = chunks(spark, d).where(F.col("is_duplicate_of").isNull() & (F.col("token_count") >= 40))
    sample = pool.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(50).join(documents(spark, d).select(F.col("id").alias("document_id"), "sha256", "filename"), "document_id")
    first = F.get(X.sentences(F.col("text")), F.lit(0))
    return sample.select(F.concat(F.lit("What does the file say about: "), F.left(first, F.lit(80)), F.lit("?")).alias("question"), first.alias("ground_truth"), F.array(F.struct("sha256", "start_offset", "end_offset", F.col("id").alias("chunk_id"), "filename", "page")).alias("relevant_spans"))


@query()
def evl2_offline_evaluation(spark, d):
    """One row a run: ranking metrics and stand-in judge scores of its candidates; runs without a score keep nulls."""
    j = _judged(spark, d)
    return E.hit_and_rank(j, 4).join(candidates(spark, d).groupBy("query_id").agg(F.round(F.avg("similarity"), 4).alias("similarity")), "query_id", "left")


@query()
def evl1_online_evaluation(spark, d):
    """Faithfulness, precision and relevancy of each question's answer; null where there is none."""
    shares = QUERIES["agg18_20_judge_shares"](spark, d).select(F.col("query_id").alias("id"), "faithfulness", "context_precision")
    return questions(spark, d).select("id").join(shares, "id", "left").join(QUERIES["agg23_relevancy"](spark, d), "id", "left")


@query(f"select chunk_size, chunk_overlap, count(distinct sha256) as files, sum(chunk_count)::bigint as chunks from {DOCS} where status = 'ready' group by 1, 2")
def evl3_index_builds(spark, d):
    """One throwaway index for each way of chunking; its key hashes what it is built from."""
    ready = documents(spark, d).where(F.col("status") == "ready")
    return ready.groupBy("chunk_size", "chunk_overlap").agg(F.count_distinct("sha256").alias("files"), F.sum("chunk_count").cast("long").alias("chunks"))
