"""Queries of ingest: files, cleaning, tokens, chunks, links between documents, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.functions import text as X
from siftline.operators import chunking, corpus, dedup, parsing
from siftline.sources import files
from siftline.sources.tables import table

DOCS = "(select * from source_document qualify row_number() over (partition by id order by version desc, updated_at desc) = 1)"
CHUNKS = "(select distinct id, document_id, chunk_index, page, page_end, text, token_count, start_offset, end_offset, overlap_prev_chars, cluster_id, is_duplicate_of, duplicate_similarity from chunk)"
TOKEN_SQL = X.TOKEN.replace("'", "''")
STRIP_SQL = r"regexp_replace({0}, '^[ \t\r\n\x0B\f]+|[ \t\r\n\x0B\f]+$', '', 'g')"


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The valid row of each source document."""
    return corpus.latest(table(spark, d, "source_document"), ["id"], ["version", "updated_at"])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without replayed rows."""
    return table(spark, d, "chunk").dropDuplicates(["id"])


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a file as its pages."""
    return chunks(spark, d).select(F.col("document_id").alias("doc"), F.col("chunk_index").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""select distinct id, version, lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) as ext, case when lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) not in ('.pdf', '.docx', '.md', '.txt') then 'unsupported extension' when size_bytes > 26214400 then 'too large' end as reason from source_document""")
def src1_extension_filter(spark, d):
    t = table(spark, d, "source_document")
    return t.select("id", "version", files.extension(F.col("filename")).alias("ext"), files.accepted(F.col("filename"), F.col("size_bytes")).alias("reason")).distinct()


@query("select doc_id, case when coalesce(length(text), 0) = 0 then 'empty' when contains(text, chr(0)) then 'contains NUL' end as reason from documents")
def src2_sniff(spark, d):
    return table(spark, d, "documents").select("doc_id", files.sniff_text(F.col("text")).alias("reason"))


@query("select doc_id, sha256(text) as sha from documents")
def src3_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query()
def src6_markdown_text(spark, d):
    return table(spark, d, "documents").select("doc_id", files.markdown_column(F.col("text")).alias("text"))


@query()
def src7_html_text(spark, d):
    return table(spark, d, "documents").select("doc_id", files.html_column(F.col("text")).alias("text"))


@query("select doc_id, (i - 1)::int as page, length(p[i]) as n_chars from (select doc_id, string_split(text, chr(12)) as p, unnest(range(1, len(string_split(text, chr(12))) + 1)) as i from documents where text is not null)")
def src8_form_feed_pages(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "t")).select("doc_id", "page", F.length("t").alias("n_chars"))


@query("select doc_id, len(string_split(text, chr(12)))::int as pages from documents where text is not null")
def src9_page_count(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", parsing.page_count(F.col("text")).alias("pages"))


@query("""select distinct id, case when coalesce(length(question), 0) not between 3 and 2000 then 1 else 0 end + case when coalesce(length(ground_truth), 0) not between 1 and 5000 then 1 else 0 end + case when coalesce(len(relevant_spans), 0) > 20 then 1 else 0 end as errors from eval_question""")
def src10_golden_validation(spark, d):
    q = table(spark, d, "eval_question")
    e = files.golden_errors(F.col("id"), F.lit(True), F.col("question"), F.col("ground_truth"), F.col("relevant_spans.chunk_id"))
    return q.select("id", F.size(e).alias("errors")).distinct()


@query("""select distinct v.chunk_id, v.document_id, v.model from chunk_vector v where v.chunk_id in (select chunk_id from cluster_probe)""")
def src11_point_read(spark, d):
    return table(spark, d, "chunk_vector").select("chunk_id", "document_id", "model").join(table(spark, d, "cluster_probe").select("chunk_id").distinct(), "chunk_id", "left_semi").distinct()


@query(f"""select distinct v.chunk_id, v.document_id from chunk_vector v where v.is_duplicate_of = '' and v.document_id not in (select id from {DOCS} where status <> 'ready')""")
def src12_canonical_scan(spark, d):
    gone = documents(spark, d).where(F.col("status") != "ready").select(F.col("id").alias("document_id"))
    return table(spark, d, "chunk_vector").where(F.col("is_duplicate_of") == "").select("chunk_id", "document_id").join(gone, "document_id", "left_anti").select("chunk_id", "document_id").distinct()


@query("select id, type, len(aliases)::int as aliases, len(chunk_ids)::int as chunks from vertex")
def src13_graph_load(spark, d):
    return table(spark, d, "vertex").select("id", "type", F.size("aliases").alias("aliases"), F.size("chunk_ids").alias("chunks"))


@query(f"""select distinct s.sha256 as sha, d.id, d.filename from (select unnest(relevant_spans).sha256 as sha256 from eval_question) s join {DOCS} d on d.sha256 = s.sha256""")
def src14_reread_by_hash(spark, d):
    s = table(spark, d, "eval_question").select(F.explode("relevant_spans").alias("s")).select(F.col("s.sha256").alias("sha")).distinct()
    return s.join(documents(spark, d), F.col("sha") == F.col("sha256")).select("sha", "id", "filename").distinct()


NORMAL_SQL = STRIP_SQL.format(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(160), ' ', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t\f\x0B]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')""")


@query(f"select doc_id, md5(t) as hash, coalesce(length(t), 0) as n_chars from (select doc_id, {NORMAL_SQL} as t from documents)")
def prj1_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalise(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("hash"), F.coalesce(F.length("t"), F.lit(0)).alias("n_chars"))


LINE_SQL = "regexp_replace(lower(" + STRIP_SQL.format("l") + "), '[0-9]+', '#', 'g')"


@query(f"select doc_id, (i - 1)::int as line, {LINE_SQL} as key from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)")
def prj2_line_key(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l")).select("doc_id", "line", X.line_key(F.col("l")).alias("key"))


@query(f"""with l as (select document_id as doc, chunk_index as page, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from {CHUNKS}),
  k as (select doc, page, i, {LINE_SQL} as key from l), f as (select *, row_number() over (partition by doc, page order by i) as a, row_number() over (partition by doc, page order by i desc) as b from k where key <> ''),
  n as (select document_id as doc, count(distinct chunk_index) as n from {CHUNKS} group by 1 having count(distinct chunk_index) >= 3)
  select f.doc, f.key, count(distinct page) as pages from f join n using (doc) where a <= 2 or b <= 2 group by f.doc, f.key, n.n having count(distinct page) * 2 > n.n""")
def prj3_repeated_edges(spark, d):
    return parsing.repeated_edges(pages(spark, d))


@query()
def prj3_header_footer(spark, d):
    return parsing.remove_repeated_edges(pages(spark, d))


@query(f"""with p as (select document_id as doc, chunk_index as page, {STRIP_SQL.format("coalesce(text, '')")} as t from {CHUNKS}), f as (select * from p where t <> '')
  select doc, page, coalesce(sum(length(t) + 2) over w, 0)::bigint as start, (coalesce(sum(length(t) + 2) over w, 0) + length(t))::bigint as "end" from f window w as (partition by doc order by page rows between unbounded preceding and 1 preceding)""")
def prj4_page_offsets(spark, d):
    return parsing.page_offsets(pages(spark, d))


@query(f"""with o as (select distinct d.id as doc, s.start_offset as "offset" from (select unnest(relevant_spans) as s from eval_question) join {DOCS} d on d.sha256 = s.sha256 where s.start_offset is not null),
  p as (select document_id as doc, page, start_offset as "start", end_offset as "end" from {CHUNKS})
  select o.doc, o."offset", coalesce(arg_min(p.page, (p."end", p.page)) filter (where o."offset" < p."end"), arg_max(p.page, (p."end", p.page)), 1) as page from o left join p using (doc) group by 1, 2""")
def prj5_page_at(spark, d):
    s = table(spark, d, "eval_question").select(F.explode("relevant_spans").alias("s")).select(F.col("s.sha256").alias("sha256"), F.col("s.start_offset").alias("offset")).where(F.col("offset").isNotNull())
    offsets = s.join(documents(spark, d).select("id", "sha256"), "sha256").select(F.col("id").alias("doc"), "offset")
    spans = chunks(spark, d).select(F.col("document_id").alias("doc"), "page", F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))
    return parsing.page_at(offsets, spans)


@query("select doc_id, case when length(text) > 120 then left(text, 120) || '…' else text end as preview from documents")
def prj6_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text"), 120).alias("preview"))


@query("""select event_id, case when length(props) > 20 then to_json({truncated: true, keys: list_sort(json_keys(props))}) else props end as payload from events""")
def prj9_cap_payload(spark, d):
    return table(spark, d, "events").select("event_id", X.cap_payload(F.col("props"), 20).alias("payload"))


@query(f"select doc_id, len(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}'))::int as n_tokens from documents")
def tok1_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("n_tokens"))


@query("select doc_id, true as lossless from documents where text is not null")
def tok2_lossless(spark, d):
    t = table(spark, d, "documents").where(F.col("text").isNotNull())
    return t.select("doc_id", (F.array_join(X.tokens(F.col("text")), "") == F.col("text")).alias("lossless"))


@query(f"select doc_id, (i - 1)::int as pos, t[i] as token from (select doc_id, regexp_extract_all(text, '{TOKEN_SQL}')[1:300] as t, unnest(range(1, least(300, len(regexp_extract_all(text, '{TOKEN_SQL}'))) + 1)) as i from (select * from documents where length(text) > 0 order by doc_id limit 1))")
def tok3_token_preview(spark, d):
    first = table(spark, d, "documents").where(F.length("text") > 0).agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d")).select("d.*")
    return first.select("doc_id", F.posexplode(F.slice(X.tokens(F.col("text")), 1, 300)).alias("pos", "token"))


@query(f"select count(*) filter (where len(regexp_extract_all(text, '{TOKEN_SQL}')) > 512) as truncated, count(*) as texts from documents")
def tok4_truncated(spark, d):
    return table(spark, d, "documents").agg(F.count_if(X.token_count(F.col("text")) > 512).alias("truncated"), F.count("*").alias("texts"))


@query()
def chk3_boundary_chunks(spark, d):
    return chunking.chunk_spans(table(spark, d, "documents").select("doc_id", "text"), size=200, overlap=40, keep=["doc_id"])


@query(f"""with n as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}'))::int as n from documents)
  select doc_id, (i * 84)::int as "start", least(i * 84 + 100, n)::int as "end" from (select doc_id, n, unnest(range(0, greatest(0, ceil((n - 100) / 84.0)::int) + 1)) as i from n where n > 0)""")
def chk3_fixed_windows(spark, d):
    n = table(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("n"))
    return n.select("doc_id", F.explode(chunking.fixed_windows(F.col("n"), 100, 16)).alias("w")).select("doc_id", "w.start", "w.end")


@query(f"""select c.id, left(c.document_id, 8) || '-v' || regexp_extract(c.id, '-v([0-9]+)-', 1) || '-' || c.chunk_index as built, c.page, c.page_end from {CHUNKS} c""")
def chk4_chunk_rows(spark, d):
    return chunks(spark, d).select("id", F.concat(F.left("document_id", F.lit(8)), F.lit("-v"), F.regexp_extract("id", "-v([0-9]+)-", 1), F.lit("-"), F.col("chunk_index").cast("string")).alias("built"), "page", "page_end")


@query(f"""select id, version, greatest(1, ceil(greatest(0, total_tokens - chunk_overlap) / greatest(1, chunk_size - chunk_overlap)::double)::int) as estimate from {DOCS} where total_tokens is not null""")
def chk5_estimate(spark, d):
    g = F.greatest
    return documents(spark, d).where(F.col("total_tokens").isNotNull()).select("id", "version", g(F.lit(1), F.ceil(g(F.lit(0), F.col("total_tokens") - F.col("chunk_overlap")) / g(F.lit(1), F.col("chunk_size") - F.col("chunk_overlap"))).cast("int")).alias("estimate"))


@query(f"""select least(case when token_count < 0 then 0 else floor(token_count * 12 / 512.0)::int + 1 end, 12)::int as bin, count(*) as n from {CHUNKS} where token_count is not null group by 1""")
def chk6_histogram(spark, d):
    return chunking.token_histogram(chunks(spark, d).where(F.col("token_count").isNotNull()).select(F.col("token_count").cast("double").alias("n")), 512)


@query(f"""select min(token_count) as least, round(avg(token_count), 1) as mean, max(token_count) as most from {CHUNKS}""")
def chk6_stats(spark, d):
    return chunks(spark, d).agg(F.min("token_count").alias("least"), F.round(F.avg("token_count"), 1).alias("mean"), F.max("token_count").alias("most"))


@query(f"select c.id, d.filename, d.extension, c.page from {CHUNKS} c join {DOCS} d on c.document_id = d.id where d.status = 'ready'")
def jn1_chunk_document(spark, d):
    docs = documents(spark, d).where(F.col("status") == "ready").select(F.col("id").alias("document_id"), "filename", "extension")
    return chunks(spark, d).select("id", "document_id", "page").join(docs, "document_id").select("id", "filename", "extension", "page")


@query(f"select c.id, d.filename from {CHUNKS} c join {DOCS} d on c.document_id = d.id where c.is_duplicate_of is null and c.token_count >= 40")
def jn4_sample_pool(spark, d):
    docs = documents(spark, d).select(F.col("id").alias("document_id"), "filename")
    return chunks(spark, d).where(F.col("is_duplicate_of").isNull() & (F.col("token_count") >= 40)).select("id", "document_id").join(docs, "document_id").select("id", "filename")


REPLACED_SQL = f"(select id from {DOCS} where version > 1)"


@query(f"""select c.id, c.is_duplicate_of from {CHUNKS} c join {CHUNKS} o on c.is_duplicate_of = o.id where o.document_id in {REPLACED_SQL} and c.document_id not in {REPLACED_SQL}""")
def jn5_orphans(spark, d):
    gone = documents(spark, d).where(F.col("version") > 1).select(F.col("id").alias("document_id"))
    return dedup.orphans(chunks(spark, d).select("id", "document_id", "is_duplicate_of"), gone)


ROOTS_SQL = f"""with recursive link as (select c.id, c.is_duplicate_of as parent from {CHUNKS} c where c.is_duplicate_of < c.id and c.is_duplicate_of in (select id from chunk)),
  up(id, root, depth) as (select id, parent, 1 from link union all select u.id, l.parent, u.depth + 1 from up u join link l on u.root = l.id)"""


@query(f"{ROOTS_SQL} select id, arg_max(root, depth) as root, max(depth)::int as depth from up group by id")
def jn8_duplicate_roots(spark, d):
    return dedup.roots(chunks(spark, d).select("id", F.col("is_duplicate_of").alias("parent")))


@query(f"""{ROOTS_SQL} select c.id, coalesce(r.cluster_id, -1) as cluster_id from {CHUNKS} c left join (select id, arg_max(root, depth) as root from up group by id) u on u.id = c.id left join {CHUNKS} r on r.id = coalesce(u.root, c.id)""")
def jn12_cluster_inheritance(spark, d):
    c = chunks(spark, d)
    return dedup.inherit_clusters(c.select("id", "cluster_id"), dedup.roots(c.select("id", F.col("is_duplicate_of").alias("parent"))))


@query(f"""select c.id, case when c.is_duplicate_of is null then 'canonical' when o.id is null then 'broken' when o.document_id in {REPLACED_SQL} then 'replaced' else 'linked' end as state from {CHUNKS} c left join {CHUNKS} o on c.is_duplicate_of = o.id""")
def jn9_link_states(spark, d):
    gone = documents(spark, d).where(F.col("version") > 1).select(F.col("id").alias("document_id"))
    return dedup.link_states(chunks(spark, d).select("id", "document_id", "is_duplicate_of"), gone)


@query("""with u as (select distinct id, version, sha256, status, chunk_size, created_at from source_document), o as (select *, row_number() over w as n, lag(status) over w as s, lag(chunk_size) over w as z from u window w as (partition by sha256 order by created_at, id, version, status, chunk_size))
  select id, version, status, chunk_size, case when n = 1 then 'new' when s = 'error' then 'retry' when z is distinct from chunk_size then 'rechunk' else 'duplicate' end as action from o""")
def jn13_same_hash_action(spark, d):
    t = table(spark, d, "source_document").select("id", "version", "sha256", "status", "chunk_size", "created_at").distinct()
    return dedup.upload_actions(t).select("id", "version", "status", "chunk_size", "action")


@query("""select chunk_id, document_id, model from chunk_vector v qualify row_number() over (partition by chunk_id order by (model = 'minihash-96-v2') desc, upserted_at desc, document_id, model) = 1""")
def snk2_upsert(spark, d):
    v = table(spark, d, "chunk_vector").select("chunk_id", "document_id", "model", "upserted_at")
    old = corpus.latest(v.where(F.col("model") != "minihash-96-v2"), ["chunk_id"], ["upserted_at"], ["document_id", "model"])
    new = corpus.latest(v.where(F.col("model") == "minihash-96-v2"), ["chunk_id"], ["upserted_at"], ["document_id", "model"])
    return corpus.upsert(old, new, ["chunk_id"]).select("chunk_id", "document_id", "model")


@query(f"""select c.id, coalesce(v.cluster_id, c.cluster_id) as cluster_id from {CHUNKS} c left join (select chunk_id, max(cluster_id) as cluster_id from chunk_vector where cluster_id >= 0 group by 1) v on v.chunk_id = c.id""")
def snk3_metadata_merge(spark, d):
    v = table(spark, d, "chunk_vector").where(F.col("cluster_id") >= 0).groupBy(F.col("chunk_id").alias("id")).agg(F.max("cluster_id").alias("cluster_id"))
    return corpus.merge_columns(chunks(spark, d).select("id", "cluster_id"), v, "id")


@query(f"select id from {CHUNKS} where document_id not in (select id from {DOCS} where status <> 'ready')")
def snk4_delete(spark, d):
    gone = documents(spark, d).where(F.col("status") != "ready").select(F.col("id").alias("document_id"))
    return corpus.delete(chunks(spark, d).select("id", "document_id"), gone, ["document_id"]).select("id")


@query(f"""with live as (select c.*, regexp_extract(c.id, '-v([0-9]+)-', 1)::int as v from {CHUNKS} c), keep as (select l.* from live l join {DOCS} d on d.id = l.document_id and d.version = l.v),
  heads as (select is_duplicate_of as head, min(id) as heir from keep where is_duplicate_of is not null and is_duplicate_of not in (select id from keep) group by 1)
  select k.id, case when h.heir = k.id then null else coalesce(h.heir, k.is_duplicate_of) end as is_duplicate_of from keep k left join heads h on h.head = k.is_duplicate_of""")
def snk6_replace_version(spark, d):
    c = chunks(spark, d).withColumn("v", F.regexp_extract("id", "-v([0-9]+)-", 1).cast("int"))
    return corpus.replace_versions(c, documents(spark, d).select(F.col("id").alias("document_id"), F.col("version").alias("v"))).select("id", "is_duplicate_of")


@query(f"""with gone as (select id from {DOCS} where status <> 'ready'), keep as (select * from {CHUNKS} where document_id not in (select id from gone)), dead as (select id from {CHUNKS} where document_id in (select id from gone)),
  heirs as (select is_duplicate_of as head, min(id) as heir from keep where is_duplicate_of in (select id from dead) group by 1)
  select k.id, case when h.heir = k.id then null else coalesce(h.heir, k.is_duplicate_of) end as is_duplicate_of from keep k left join heirs h on h.head = k.is_duplicate_of""")
def snk7_delete_cascade(spark, d):
    gone = documents(spark, d).where(F.col("status") != "ready").select(F.col("id").alias("document_id"))
    return corpus.delete_documents(chunks(spark, d), gone).select("id", "is_duplicate_of")


@query("""select e.sha as key, min(e.doc_id) as first_doc from (select sha256(text) as sha, doc_id from documents where text is not null and doc_id % 2 = 1) e where e.sha not in (select sha256(text) from documents where text is not null and doc_id % 2 = 0) group by 1""")
def snk10_put_if_absent(spark, d):
    # the even documents stand for what the cache holds, the odd ones for what comes in
    t = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("key"), "doc_id")
    return corpus.put_if_absent(t.where("doc_id % 2 = 0"), t.where("doc_id % 2 = 1"), "key", "doc_id").select("key", F.col("doc_id").alias("first_doc"))


@query(f"select document_id, count(*) filter (where is_duplicate_of is not null) as duplicates, count(*) as chunks from {CHUNKS} group by 1")
def agg10_duplicates_per_document(spark, d):
    return chunks(spark, d).groupBy("document_id").agg(F.count_if(F.col("is_duplicate_of").isNotNull()).alias("duplicates"), F.count("*").alias("chunks"))


@query("""select last_job_id, count(*) as documents, count(*) filter (where status = 'error') as failed, case when bool_or(status = 'error') then 'warning' else 'success' end as status from (select distinct id, version, status, last_job_id from source_document) group by 1""")
def agg24_job_summary(spark, d):
    t = table(spark, d, "source_document").select("id", "version", "status", "last_job_id").distinct()
    bad = F.col("status") == "error"
    return t.groupBy("last_job_id").agg(F.count("*").alias("documents"), F.count_if(bad).alias("failed"), F.when(F.bool_or(bad), "warning").otherwise("success").alias("status"))
