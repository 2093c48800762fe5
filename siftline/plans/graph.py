"""Queries of the knowledge graph: the extracted one, and a sparse one of customers, suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import graph as G
from siftline.plans.ingest import CHUNKS, DOCS, chunks, documents
from siftline.sources.tables import table

QUERIES, ORACLE = {}, {}
NAME_SQL = r"regexp_replace(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g')), '^(the|a|an) ', '')"
TYPE_SQL = "case when upper(trim({0})) in (" + ", ".join(f"'{t}'" for t in G.TYPES) + ") then upper(trim({0})) else 'OTHER' end"
MENTIONS = "(select mention_id as seq, any_value(name) as name, any_value(type) as type, any_value(description) as description, any_value(aliases) as aliases, any_value(chunk_id) as chunk_id from extracted_entity group by 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_entity").withColumnRenamed("mention_id", "seq").dropDuplicates(["seq"])


def sparse_vertices(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name, key, label, kind: table(spark, d, name).select(F.concat(F.lit(kind[0].lower()), F.col(key).cast("string")).alias("key"), F.col(label).alias("name"), F.lit(kind).alias("type"))
    return t("region", "r_regionkey", "r_name", "REGION").unionByName(t("nation", "n_nationkey", "n_name", "NATION")).unionByName(t("supplier", "s_suppkey", "s_name", "SUPPLIER")).unionByName(t("customer", "c_custkey", "c_name", "CUSTOMER"))


def sparse_edges(spark: SparkSession, d: str) -> DataFrame:
    def t(name: str, a: str, key: str, b: str, to: str, relation: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(a), F.col(key).cast("string")).alias("source"), F.lit(relation).alias("relation"), F.concat(F.lit(b), F.col(to).cast("string")).alias("target"))

    return t("nation", "n", "n_nationkey", "r", "n_regionkey", "part of").unionByName(t("supplier", "s", "s_suppkey", "n", "s_nationkey", "located in")).unionByName(t("customer", "c", "c_custkey", "n", "c_nationkey", "located in"))


EDGE_SQL = "(select 'n' || n_nationkey as source, 'part of' as relation, 'r' || n_regionkey as target from nation union all select 's' || s_suppkey, 'located in', 'n' || s_nationkey from supplier union all select 'c' || c_custkey, 'located in', 'n' || c_nationkey from customer)"
VERTEX_SQL = "(select 'r' || r_regionkey as key, r_name as name, 'REGION' as type from region union all select 'n' || n_nationkey, n_name, 'NATION' from nation union all select 's' || s_suppkey, s_name, 'SUPPLIER' from supplier union all select 'c' || c_custkey, c_name, 'CUSTOMER' from customer)"


@query(f"select mention_id, {NAME_SQL.format('name')} as key from extracted_entity")
def kg1_normalize_name(spark, d):
    return table(spark, d, "extracted_entity").select("mention_id", X.normalise_name(F.col("name")).alias("key"))


@query(r"select distinct o_orderpriority as raw, left(regexp_replace(lower(trim(o_orderpriority)), '[ \t\r\n]+', ' ', 'g'), 60) as relation from orders")
def kg2_normalize_relation(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("raw"), X.normalise_relation(F.col("o_orderpriority")).alias("relation")).distinct()


GRAM_SQL = r"""(with w as (select {id} as id, string_split(trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g')), ' ') as w from {t}), s as (select id, w, unnest(range(1, len(w) + 1)) as i from w), g as (select id, unnest(list_transform(range(1, least(6, len(w) - i + 1) + 1), lambda n: array_to_string(w[i:i + n - 1], ' '))) as g from s)
  select distinct id, regexp_replace(g, '^(the|a|an) ', '') as gram from g where regexp_replace(g, '^(the|a|an) ', '') <> '')"""


@query("select id as p_partkey, gram from " + GRAM_SQL.format(id="p_partkey", c="p_name", t="part"))
def kg3_query_ngrams(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(X.ngrams(F.col("p_name"))).alias("gram"))


@query(f"select chunk_id, count(*) as entities, count(*) <= 20 and bool_and(coalesce(length(name) between 1 and 120, false)) as accepted from {MENTIONS} where chunk_id is not null group by 1")
def kg4_validate_extraction(spark, d):
    return G.validate_extraction(mentions(spark, d).where(F.col("chunk_id").isNotNull()))


@query()
def kg5_rule_extraction(spark, d):
    from siftline.providers import RuleExtractor, extract_entities

    return extract_entities(chunks(spark, d).select("id", "text"), RuleExtractor())


@query(f"""with m as (select *, {NAME_SQL.format('name')} as key, {TYPE_SQL.format('type')} as t from {MENTIONS})
  select key, arg_min(name, seq) as name, coalesce(arg_min(t, seq) filter (where t <> 'OTHER'), 'OTHER') as type, coalesce(arg_min(description, seq) filter (where coalesce(description, '') <> ''), '') as description, count(distinct chunk_id) as chunks, count(*) as mentions from m where key <> '' group by key""")
def kg6_merge_entities(spark, d):
    return G.merge_entities(mentions(spark, d))


@query(f"""with m as (select seq, {NAME_SQL.format('name')} as key, unnest(aliases) as a from {MENTIONS}), c as (select seq, key, {NAME_SQL.format('a')} as alias from m), k as (select distinct {NAME_SQL.format('name')} as key from {MENTIONS})
  select alias, arg_min(key, (seq, key)) as key from c where alias <> '' and alias <> key and key <> '' and alias not in (select key from k where key is not null) group by 1""")
def kg6_alias_claims(spark, d):
    m = mentions(spark, d)
    keys = m.select(X.normalise_name(F.col("name")).alias("key")).distinct()
    return G.alias_claims(m, keys)


@query("select 'c' || o_custkey as source, 'ordered' as relation, 'p' || l_partkey as target, count(distinct o_orderkey) as provenance from orders join lineitem on l_orderkey = o_orderkey group by 1, 3")
def kg7_merge_relations(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    rel = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.lit("ordered").alias("relation"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.col("o_orderkey").alias("chunk_id"))
    keys = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key")).unionByName(table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key")))
    return G.merge_relations(rel, keys)


@query("select id from vertex where id not in (select lower(trim(name)) from extracted_entity where name is not null)")
def kg9_without_mentions(spark, d):
    return table(spark, d, "vertex").select("id").join(table(spark, d, "extracted_entity").select(F.lower(F.trim("name")).alias("id")), "id", "left_anti")


@query("select distinct chunk_id from chunk_vector where model = 'minihash-64-v1' and chunk_id not in (select chunk_id from chunk_vector where model = 'minihash-96-v2')")
def kg10_append_vectors(spark, d):
    v = table(spark, d, "chunk_vector").select("chunk_id", "model")
    return v.where(F.col("model") == "minihash-64-v1").join(v.where(F.col("model") == "minihash-96-v2"), "chunk_id", "left_anti").select("chunk_id").distinct()


@query(f"""with gone as (select id from {CHUNKS} where document_id in (select id from {DOCS} where extension = 'pdf')), l as (select distinct id as key, unnest(chunk_ids) as c from vertex)
  select key, list(c order by c) as chunk_ids from l where c not in (select id from gone) group by 1""")
def kg11_remove_provenance(spark, d):
    pdf = documents(spark, d).where(F.col("extension") == "pdf").select(F.col("id").alias("document_id"))
    gone = chunks(spark, d).join(pdf, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return G.remove_provenance(table(spark, d, "vertex").select(F.col("id").alias("key"), "chunk_ids"), gone)


@query("with k as (select id as key, id as gram from vertex where length(id) > 1), g as (select * from " + GRAM_SQL.format(id="id", c="question", t="(select distinct id, question from eval_question)") + ") select distinct g.id as query_id, k.key from g join k using (gram)")
def kg12_exact_match(spark, d):
    q = table(spark, d, "eval_question").select("id", "question").distinct().select(F.col("id").alias("query_id"), F.explode(X.ngrams(F.col("question"))).alias("gram"))
    keys = table(spark, d, "vertex").where(F.length("id") > 1).select(F.col("id").alias("gram"))
    return q.join(keys, "gram").select("query_id", F.col("gram").alias("key")).distinct()


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"))


UP_SQL = f"""with recursive u as (select source, target from {EDGE_SQL} union select target, source from {EDGE_SQL}), b(q, key, hop) as (select r_regionkey::bigint, 'r' || r_regionkey, 0 from region union all select b.q, u.target, b.hop + 1 from b join u on u.source = b.key where b.hop < 2), h as (select q as query_id, key, min(hop)::int as hop from b group by 1, 2)"""


@query(f"{UP_SQL} select * from h")
def kg13_neighbourhood(spark, d):
    return G.neighbourhood(sparse_edges(spark, d), _regions(spark, d), 2, limit=10**9)


@query(f"""select id as key, degree from vertex where contains(id, 'harbour') or len(list_filter(aliases, lambda a: contains({NAME_SQL.format('a')}, 'harbour'))) > 0 order by (id <> 'harbour'), degree desc, id limit 50""")
def kg14_find(spark, d):
    return G.find(table(spark, d, "vertex").select(F.col("id").alias("key"), "aliases", "degree"), "harbour", 50).select("key", "degree")


@query("select id as key, degree from vertex where type in ('PERSON', 'PRODUCT') order by degree desc, id limit 100")
def kg15_overview(spark, d):
    return G.overview(table(spark, d, "vertex").select(F.col("id").alias("key"), "type", "degree"), ["PERSON", "PRODUCT"], 100).select("key", "degree")


@query(f"select e.source, e.relation, e.target from {EDGE_SQL} e join {VERTEX_SQL} a on a.key = e.source join {VERTEX_SQL} b on b.key = e.target where a.type in ('SUPPLIER', 'NATION') and b.type in ('SUPPLIER', 'NATION')")
def flt7_type_filter(spark, d):
    return G.induced_edges(sparse_edges(spark, d), sparse_vertices(spark, d).where(F.col("type").isin("SUPPLIER", "NATION"))).select("source", "relation", "target")


@query(f"""with deg as (select key, count(*) as degree from (select source as key from {EDGE_SQL} union all select target from {EDGE_SQL}) group by 1), top as (select v.key from {VERTEX_SQL} v join deg using (key) order by degree desc, v.key limit 60)
  select e.source, e.relation, e.target from {EDGE_SQL} e where e.source in (select key from top) and e.target in (select key from top)""")
def kg16_explorer(spark, d):
    e = sparse_edges(spark, d)
    top = G.overview(sparse_vertices(spark, d).join(G.degrees(e), "key"), None, 60)
    return G.induced_edges(e, top).select("source", "relation", "target")


@query(f"select key, count(*) as degree from (select source as key from {EDGE_SQL} union all select target from {EDGE_SQL}) group by 1")
def agg8_degree(spark, d):
    return G.degrees(sparse_edges(spark, d))


@query("select type, count(*) as vertices, sum(degree)::bigint as degree from vertex group by 1")
def agg7_type_histogram(spark, d):
    return table(spark, d, "vertex").groupBy("type").agg(F.count("*").alias("vertices"), F.sum("degree").cast("long").alias("degree"))


@query("""with x as (select distinct e.id as query_id, v.id as key from (select distinct id, question from eval_question) e join vertex v on length(v.id) > 1 and contains(' ' || trim(regexp_replace(lower(e.question), '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g')) || ' ', ' ' || v.id || ' '))
  select query_id, key, row_number() over (partition by query_id order by key)::int as rank from x where len(string_split(key, ' ')) <= 6 qualify rank <= 10""")
def kg18_vertex_matching(spark, d):
    exact = QUERIES["kg12_exact_match"](spark, d)
    none = exact.limit(0).select("query_id", "key", F.lit(0.0).alias("score"))
    return G.match_vertices(exact, none).select("query_id", "key", "rank")


CITES_SQL = "(select 'c' || o_custkey as key, o_orderkey::varchar as chunk_id from orders)"


@query(f"""{UP_SQL}, s as (select h.query_id, c.chunk_id, 1.0 / (1 + h.hop) as s, v.name from h join {CITES_SQL} c using (key) join {VERTEX_SQL} v using (key)), t as (select query_id, chunk_id, s, name from s union all select a.query_id, o.o_orderkey::varchar, 1.0 / (1 + greatest(a.hop, b.hop)), null from orders o join customer on c_custkey = o_custkey join h a on a.key = 'c' || c_custkey join h b on b.key = 'n' || c_nationkey and b.query_id = a.query_id),
  g as (select query_id, chunk_id, round(sum(s), 4)::double as score, list(distinct name) filter (where name is not null) as via from t group by 1, 2)
  select query_id, chunk_id, score, via, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from g""")
def agg9_evidence(spark, d):
    hops = G.neighbourhood(sparse_edges(spark, d), _regions(spark, d), 2, limit=10**9)
    cites = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderkey").cast("string").alias("chunk_id")).join(sparse_vertices(spark, d).select("key", "name"), "key")
    # an order is evidence for its customer and for the edge from the customer to its nation
    placed = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"))
    edges = cites.join(placed, "key").select(F.col("key").alias("source"), "target", "chunk_id")
    return G.evidence(cites, edges, hops)


@query(f"""{UP_SQL}, e as (select a.query_id, x.name as source, e.relation, y.name as target, greatest(a.hop, b.hop) as hop from {EDGE_SQL} e join h a on a.key = e.source join h b on b.key = e.target and b.query_id = a.query_id join {VERTEX_SQL} x on x.key = e.source join {VERTEX_SQL} y on y.key = e.target)
  select *, row_number() over (partition by query_id order by hop, source, relation, target)::int as rank from e qualify rank <= 30""")
def kg19_triples(spark, d):
    hops = G.neighbourhood(sparse_edges(spark, d), _regions(spark, d), 2, limit=10**9)
    return G.triples(sparse_edges(spark, d), sparse_vertices(spark, d).select("key", "name"), hops)


@query("select id as key, list_sort(list_distinct(list_concat(chunk_ids, list_transform(aliases, lambda a: 'alias:' || a)))) as joined from vertex")
def set2_provenance_union(spark, d):
    return table(spark, d, "vertex").select(F.col("id").alias("key"), F.array_sort(F.array_union("chunk_ids", F.transform("aliases", lambda a: F.concat(F.lit("alias:"), a)))).alias("joined"))
