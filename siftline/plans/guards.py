"""Queries of guardrails and scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import text as X
from siftline.functions.checks import verhoeff_steps
from siftline.operators import guardrails as R
from siftline.plans.ingest import CHUNKS, chunks
from siftline.sources.tables import table

QUERIES, ORACLE = {}, {}
QUESTIONS = "(select id, any_value(question) as question, any_value(ground_truth) as ground_truth, any_value(relevant_spans) as relevant_spans from eval_question group by id)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_question").dropDuplicates(["id"])


@query("select id, list_filter([" + ", ".join(f"case when regexp_matches(question, '{p.replace(chr(39), chr(39) * 2)}') then '{n}' end" for n, p in R.INJECTION.items()) + "], lambda x: x is not null) as rules from " + QUESTIONS)
def fn1_injection_rules(spark, d):
    return questions(spark, d).select("id", R.injection_rules(F.col("question")).alias("rules"))


def _digits_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _verhoeff_sql(x: str) -> str:
    """Verhoeff's check of the digits of ``x`` by one table of states, as DuckDB SQL."""
    steps = "".join(str(v) for step in verhoeff_steps() for v in step)
    digits = f"list_transform(string_split(reverse({_digits_sql(x)}), ''), lambda c: c::int)"
    places = f"list_transform(list_zip({digits}, range(len({_digits_sql(x)}))), lambda z: z[1] + 100 * (z[2] % 8))"
    return f"list_reduce(list_concat([0::bigint], {places}), lambda st, z: substr('{steps}', (z + 10 * st + 1)::int, 1)::bigint) = 0"


def _luhn_sql(x: str) -> str:
    d = f"reverse({_digits_sql(x)})"
    return f"list_sum(list_transform(range(len({d})), lambda i: case when i % 2 = 0 then substr({d}, (i + 1)::int, 1)::int else (2 * substr({d}, (i + 1)::int, 1)::int) // 10 + (2 * substr({d}, (i + 1)::int, 1)::int) % 10 end)) % 10 = 0"


def _mask_sql(c: str) -> str:
    """``mask_pii`` of a column, type after type, as DuckDB SQL."""
    for kind, pattern in R.PATTERNS.items():
        check = {"CREDIT_CARD": _luhn_sql, "IN_AADHAAR": _verhoeff_sql}.get(kind)
        if check:
            good = f"list_filter(list_distinct(regexp_extract_all({c}, '{pattern}')), lambda m: {check('m')})"
            c = f"list_reduce(list_concat([{c}], {good}), lambda t, m: replace(t, m, '<{kind}>'))"
        else:
            c = f"regexp_replace({c}, '{pattern}', '<{kind}>', 'g')"
    return c


NUMBERS_SQL = f"select id, unnest(regexp_extract_all(text, '{R.PATTERNS['IN_AADHAAR']}')) as number from {CHUNKS}"


@query(f"select id, number, {_verhoeff_sql('number')} as valid from ({NUMBERS_SQL})")
def fn2_verhoeff(spark, d):
    found = chunks(spark, d).select("id", F.explode(F.regexp_extract_all("text", F.lit(f"({R.PATTERNS['IN_AADHAAR']})"), F.lit(1))).alias("number"))
    return found.select("id", "number", R.verhoeff_valid(F.regexp_replace("number", "[^0-9]", "")).alias("valid"))


EMAIL, PAN, PHONE = (R.PATTERNS[k] for k in ("EMAIL_ADDRESS", "IN_PAN", "PHONE_NUMBER"))


@query(f"select id, len(list_distinct(regexp_extract_all(text, '{EMAIL}')))::int as emails, len(list_distinct(regexp_extract_all(text, '{PAN}')))::int as pans, len(list_distinct(regexp_extract_all(text, '{PHONE}')))::int as phones from {CHUNKS} where text is not null")
def fn3_pii_patterns(spark, d):
    n = lambda k: F.size(R.valid_matches(F.col("text"), k))
    return chunks(spark, d).where(F.col("text").isNotNull()).select("id", n("EMAIL_ADDRESS").alias("emails"), n("IN_PAN").alias("pans"), n("PHONE_NUMBER").alias("phones"))


@query(f"select id, md5(regexp_replace(regexp_replace(text, '{EMAIL}', '<EMAIL_ADDRESS>', 'g'), '{PAN}', '<IN_PAN>', 'g')) as hash from {CHUNKS} where text is not null")
def fn5_mask_plain(spark, d):
    t = F.regexp_replace(F.regexp_replace("text", EMAIL, "<EMAIL_ADDRESS>"), PAN, "<IN_PAN>")
    return chunks(spark, d).where(F.col("text").isNotNull()).select("id", F.md5(t).alias("hash"))


@query(f"select id, {_mask_sql('text')} as masked from {CHUNKS}")
def fn5_pii_mask(spark, d):
    return chunks(spark, d).select("id", R.mask_pii(F.col("text")).alias("masked"))


@query("""select coalesce(upper(trim(type)), '?') as type, count(*) as findings from (select distinct finding_id, type from pii_finding) group by 1""")
def agg15_counts_by_type(spark, d):
    return table(spark, d, "pii_finding").select("finding_id", "type").distinct().groupBy(F.coalesce(F.upper(F.trim("type")), F.lit("?")).alias("type")).agg(F.count("*").alias("findings"))


@query("""with f as (select distinct finding_id, chunk_id, start_offset as s, end_offset as e, score from pii_finding where chunk_id is not null)
  select a.finding_id from f a where not exists (select 1 from f b where b.chunk_id = a.chunk_id and b.finding_id <> a.finding_id and b.s < a.e and a.s < b.e and (b.score > a.score or (b.score = a.score and (b.e - b.s > a.e - a.s or (b.e - b.s = a.e - a.s and b.finding_id < a.finding_id)))))""")
def fn4_overlaps(spark, d):
    """Findings no surer or longer finding of their chunk overlaps."""
    f = table(spark, d, "pii_finding").select("finding_id", "chunk_id", F.col("start_offset").alias("s"), F.col("end_offset").alias("e"), "score").where(F.col("chunk_id").isNotNull()).distinct()
    b = f.select(F.col("chunk_id"), *[F.col(c).alias(f"b_{c}") for c in ("finding_id", "s", "e", "score")])
    size, other = F.col("e") - F.col("s"), F.col("b_e") - F.col("b_s")
    wins = (F.col("b_score") > F.col("score")) | ((F.col("b_score") == F.col("score")) & ((other > size) | ((other == size) & (F.col("b_finding_id") < F.col("finding_id")))))
    beaten = f.join(b, "chunk_id").where((F.col("b_finding_id") != F.col("finding_id")) & (F.col("b_s") < F.col("e")) & (F.col("s") < F.col("b_e")) & wins).select("finding_id")
    return f.select("finding_id").join(beaten, "finding_id", "left_anti")


# answers are the ground truth with the ids of its spans cited, and one id that is unknown
ANSWER_SQL = f"(select id, coalesce(list_distinct(list_transform(relevant_spans, lambda s: s.chunk_id)), []) as ids, coalesce(ground_truth, '') || ' [' || array_to_string(list_concat(coalesce(list_transform(relevant_spans, lambda s: s.chunk_id), []), ['deadbeef-v1-0', 'note']), ', ') || ']' as answer from {QUESTIONS})"


def answers(spark: SparkSession, d: str) -> DataFrame:
    ids = F.coalesce(F.col("relevant_spans.chunk_id"), F.array().cast("array<string>"))
    text = F.concat(F.coalesce("ground_truth", F.lit("")), F.lit(" ["), F.array_join(F.concat(ids, F.array(F.lit("deadbeef-v1-0"), F.lit("note"))), ", "), F.lit("]"))
    return questions(spark, d).select("id", F.array_distinct(ids).alias("ids"), text.alias("answer"))


@query(f"""with p as (select id, ids, list_distinct(list_filter(flatten(list_transform(regexp_extract_all(answer, '\\[([^\\[\\]]+)\\]', 1), lambda g: regexp_split_to_array(g, '[,; ]+'))), lambda x: x <> '')) as parts from {ANSWER_SQL})
  select id, len(list_filter(parts, lambda x: list_contains(ids, x)))::int as valid, len(list_filter(parts, lambda x: not list_contains(ids, x) and regexp_matches(x, '^[0-9a-f]{{8}}-v[0-9]+-[0-9]+$')))::int as unknown from p""")
def fn6_citations(spark, d):
    valid, unknown = X.citations(F.col("answer"), F.col("ids"))
    return answers(spark, d).select("id", F.size(valid).alias("valid"), F.size(unknown).alias("unknown"))


@query(f"select id, md5(replace(answer, ', deadbeef-v1-0', '')) as hash from {ANSWER_SQL} where len(ids) > 0")
def fn7_strip_unknown(spark, d):
    a = answers(spark, d).where(F.size("ids") > 0)
    return a.select("id", F.md5(X.strip_ids(F.col("answer"), X.citations(F.col("answer"), F.col("ids"))[1])).alias("hash"))


@query(f"select id, md5(regexp_replace(regexp_replace(answer, '\\s*\\[[^\\[\\]]+\\]', '', 'g'), '^[ \\t\\r\\n\\x0B\\f]+|[ \\t\\r\\n\\x0B\\f]+$', '', 'g')) as hash from {ANSWER_SQL}")
def fn8_strip_citations(spark, d):
    return answers(spark, d).select("id", F.md5(X.strip_citations(F.col("answer"))).alias("hash"))


BLANK = r"[ \t\r\n\x0B\f]"


@query(rf"""select id, len(list_filter(string_split(regexp_replace(regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g'), '([.!?]){BLANK}+([A-Z0-9\[("''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> ''))::int as n from {CHUNKS} where text is not null""")
def fn9_sentences(spark, d):
    return chunks(spark, d).where(F.col("text").isNotNull()).select("id", F.size(X.sentences(F.col("text"))).alias("n"))


@query(f"select id, case when length(text) - length(replace(text, '**', '')) = 0 then false else ((length(text) - length(replace(text, '**', ''))) / 2)::int % 2 = 1 end as odd_bold from {CHUNKS} where text is not null")
def fn10_odd_bold(spark, d):
    return chunks(spark, d).where(F.col("text").isNotNull()).select("id", (F.regexp_count("text", F.lit(r"\*\*")) % 2 == 1).alias("odd_bold"))


@query()
def fn11_truncated(spark, d):
    return chunks(spark, d).where(F.col("text").isNotNull()).select("id", X.truncate_at_sentence(X.repair_markdown(F.col("text")), 400).alias("text"))


@query(f"select id, regexp_matches(coalesce(ground_truth, ''), '{X.SAYS_NOTHING.replace(chr(39), chr(39) * 2)}') as says_nothing from {QUESTIONS}")
def fn12_no_answer(spark, d):
    g = F.coalesce("ground_truth", F.lit(""))
    return questions(spark, d).select("id", (X.no_answer(g, F.array().cast("array<string>")) != g).alias("says_nothing"))


@query(f"select id, sha256('label' || chr(31) || 'm1' || chr(31) || regexp_replace(lower(regexp_replace(question, '^[ \\t\\r\\n\\x0B\\f]+|[ \\t\\r\\n\\x0B\\f]+$', '', 'g')), '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g')) as key from {QUESTIONS}")
def fn13_cache_key(spark, d):
    return questions(spark, d).select("id", X.cache_key(F.lit("label"), F.lit("m1"), F.col("question")).alias("key"))


@query("select event_id, case when value < 1000 then floor(value)::bigint || ' ms' else printf('%.1f s', floor(value) / 1000) end as label from events where value is not null")
def fn20_duration(spark, d):
    return table(spark, d, "events").where(F.col("value").isNotNull()).select("event_id", X.duration_label(F.floor("value")).alias("label"))


@query(f"select q.id, string_agg('[' || c.id || '] (p. ' || case when c.page = c.page_end then c.page::varchar else c.page || '-' || c.page_end end || ')', ' --- ' order by c.id) as blocks from (select id, unnest(list_distinct(list_transform(relevant_spans, lambda s: s.chunk_id))) as chunk_id from {QUESTIONS}) q join {CHUNKS} c on c.id = q.chunk_id group by 1")
def fn15_prompt_blocks(spark, d):
    c = chunks(spark, d).select(F.col("id").alias("chunk_id"), "page", "page_end")
    pages = F.when(F.col("page") == F.col("page_end"), F.col("page").cast("string")).otherwise(F.concat_ws("-", "page", "page_end"))
    block = F.concat(F.lit("["), F.col("chunk_id"), F.lit("] (p. "), pages, F.lit(")"))
    q = questions(spark, d).select("id", F.explode(F.array_distinct("relevant_spans.chunk_id")).alias("chunk_id")).join(c, "chunk_id")
    return q.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", block.alias("b")))), lambda x: x["b"]), " --- ").alias("blocks"))


@query("select event_id, case when starts_with(props, '{') then props end as object from events")
def fn16_unwrap_json(spark, d):
    return table(spark, d, "events").select("event_id", X.unwrap_json(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).alias("object"))


@query()
def fn19_word_diff(spark, d):
    q = questions(spark, d).select("id", "question", R.mask_pii(F.col("question")).alias("masked")).where(F.col("question") != F.col("masked"))
    return R.with_diff(q, "question", "masked").select("id", F.size("diff").alias("runs"))


@query(f"""select id, n > 25 as blocked, case when n > 25 then 'block' else 'pass' end as length_verdict, case when n > 25 then 'skipped' when score < 0.7 then 'warn' else 'pass' end as topic_verdict
  from (select id, len(regexp_extract_all(question, '[A-Za-z0-9]+')) as n, (length(question) % 10) / 10.0 as score from {QUESTIONS} where question is not null)""")
def grd1_input_guards(spark, d):
    from siftline.config import GuardThresholds

    q = questions(spark, d).where(F.col("question").isNotNull()).select("id", F.col("question").alias("text"), F.size(F.regexp_extract_all("question", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("tokens"), F.lit(0.1).alias("injection_score"), F.lit(0.2).alias("toxicity_score"), ((F.length("question") % 10) / 10.0).alias("similarity"))
    g = R.input_guards(q, GuardThresholds(max_tokens=25, off_topic=0.7))
    return g.select("id", "blocked", F.get("checks", F.lit(0))["verdict"].alias("length_verdict"), F.get("checks", F.lit(4))["verdict"].alias("topic_verdict"))


@query()
def grd3_output_guards(spark, d):
    a = answers(spark, d).select("id", "answer", F.col("ids").alias("context_ids"), ((F.col("id") % 5) / 10.0).alias("unsupported"), F.lit(None).cast("string").alias("regenerated"), F.lit(None).cast("double").alias("regenerated_unsupported"))
    return R.output_guards(a).select("id", "final", "verdict", F.size("cited").alias("cited"))


@query(f"select id, score, score >= 0.8 as blocks from (select id, least(1.0, greatest(0.0, length(question) / 100.0)) as score from {QUESTIONS} where question is not null)")
def fn22_clamp_verdict(spark, d):
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.length("question") / 100.0))
    return questions(spark, d).where(F.col("question").isNotNull()).select("id", s.alias("score"), (s >= 0.8).alias("blocks"))


@query()
def fn18_answer_segments(spark, d):
    return answers(spark, d).select("id", F.explode(X.answer_segments(F.col("answer"), F.col("ids"))).alias("s")).select("id", "s.kind", "s.value")


@query(f"select id, coalesce(question, array_to_string(list_transform(coalesce(relevant_spans, []), lambda s: s.filename), ', ')) as label from {QUESTIONS}")
def fn21_run_label(spark, d):
    files = F.coalesce(F.col("relevant_spans.filename"), F.array().cast("array<string>"))
    return questions(spark, d).select("id", X.run_label(F.col("question"), files).alias("label"))


@query()
def grd4_groundedness(spark, d):
    """Stand-in judge: a sentence of an answer is supported if half of its words stand in the cited chunks."""
    from siftline.operators.retrieval import words

    q = questions(spark, d).select("id", F.explode(X.sentences(F.coalesce("ground_truth", F.lit("")))).alias("sentence"))
    cited = questions(spark, d).select("id", F.explode("relevant_spans.chunk_id").alias("chunk_id")).distinct()
    known = cited.join(chunks(spark, d).select(F.col("id").alias("chunk_id"), "text"), "chunk_id").select("id", F.explode(words(F.col("text"))).alias("w")).distinct()
    said = q.select("id", "sentence", F.explode(words(F.col("sentence"))).alias("w"))
    share = said.join(known.withColumn("in", F.lit(1)), ["id", "w"], "left").groupBy("id", "sentence").agg(F.avg(F.coalesce("in", F.lit(0))).alias("share"))
    return share.select("id", "sentence", (F.col("share") >= 0.5).alias("supported"))


@query(f"select id, {_mask_sql('text')} as served from {CHUNKS}")
def grd6_served_copies(spark, d):
    """What is served of each chunk with the guard on; the stored text stays."""
    return chunks(spark, d).select("id", F.coalesce(R.mask_pii(F.col("text")), F.when(F.col("text").isNotNull(), F.lit(X.WITHHELD))).alias("served"))


def _types_sql(c: str) -> str:
    """Number of types with a valid match in a column, as DuckDB SQL."""
    checks = {"CREDIT_CARD": _luhn_sql, "IN_AADHAAR": _verhoeff_sql}
    has = [f"(len(list_filter(regexp_extract_all({c}, '{p}'), lambda m: {checks[k]('m') if k in checks else 'true'})) > 0)::int" for k, p in R.PATTERNS.items()]
    return " + ".join(has)


@query(f"select id, {_mask_sql('question')} as question, ({_types_sql('question')})::int as types from {QUESTIONS}")
def grd7_masked_queries(spark, d):
    return questions(spark, d).select("id", R.mask_pii(F.col("question")).alias("question"), R.pii_counts(F.col("question")).alias("found")).select("id", "question", F.size("found").alias("types"))


@query()
def kg17_query_entities(spark, d):
    from siftline.providers import RuleExtractor, extract_entities

    return extract_entities(questions(spark, d).select("id", F.col("question").alias("text")), RuleExtractor()).where(F.col("name").isNotNull()).select("id", "name").distinct()


@query()
def str5_redactor(spark, d):
    """Chunks sent in pieces of twenty characters and redacted sentence by sentence."""
    from siftline.streaming.events import redact_deltas

    def send(t: str | None) -> str | None:
        return None if t is None else "".join(redact_deltas([t[i : i + 20] for i in range(0, len(t), 20)], R.mask_string))

    @F.pandas_udf(T.StringType())
    def sent(s: pd.Series) -> pd.Series:
        return s.map(send)

    return chunks(spark, d).select("id", sent("text").alias("out"))
