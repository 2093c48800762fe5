"""Queries of run events and of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.plans.ingest import CHUNKS, DOCS, chunks, documents
from siftline.sources.tables import table
from siftline.streaming import events as S

QUERIES, ORACLE = {}, {}
SEQ = "(select user_id as run_id, event_id, ts, event_type as stage, value, row_number() over (partition by user_id order by ts, event_id)::int as seq from events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def run_events(spark: SparkSession, d: str) -> DataFrame:
    return S.sequence(table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts", F.col("event_type").alias("stage"), "value"))


@query(f"select run_id, event_id, seq from {SEQ}")
def str1_sequence(spark, d):
    return run_events(spark, d).select("run_id", "event_id", "seq")


@query(f"select run_id, seq, stage from {SEQ} where seq > 20 union all select run_id, max(seq) + 1, 'done' from {SEQ} group by 1")
def src15_replay(spark, d):
    return S.replay(run_events(spark, d), 20)


@query(f"select run_id, seq, stage from {SEQ} where seq > 50")
def str2_resume(spark, d):
    return run_events(spark, d).where("seq > 50").select("run_id", "seq", "stage")


@query(f"select run_id, stage, max(seq) as last_seq, round(arg_max(value, seq), 6) as value from {SEQ} group by 1, 2")
def str3_run_fold(spark, d):
    return S.fold(run_events(spark, d)).withColumn("value", F.round("value", 6))


@query(f"select run_id, max(ts) as last from {SEQ} group by 1 having max(ts) < (select max(ts) from events) - interval 3600 seconds")
def str4_retention(spark, d):
    e = run_events(spark, d)
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("run_id").agg(F.max("ts").alias("last"))
    return last.crossJoin(F.broadcast(now)).where(F.col("last") < F.col("now") - F.expr("interval 3600 seconds")).select("run_id", "last")  # now is one row


@query(f"select run_id, seq, stage, coalesce(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by run_id order by seq), 0) as duration_ms from {SEQ}")
def str6_durations(spark, d):
    return S.durations(run_events(spark, d))


@query(f"select run_id, arg_max(stage, seq) as stage, max(seq) as seq from {SEQ} group by 1")
def str7_capture(spark, d):
    return run_events(spark, d).groupBy("run_id").agg(F.max_by("stage", "seq").alias("stage"), F.max("seq").alias("seq"))


@query("select event_type as stage, date_trunc('hour', ts) as start, count(*) as n from events group by 1, 2")
def str_windowed_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage"), F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("stage", F.col("w.start").alias("start"), "n")


@query("select event_id, user_id as run_id from events where event_type = 'purchase'")
def flt6_run_kind(spark, d):
    return table(spark, d, "events").where(F.col("event_type") == "purchase").select("event_id", F.col("user_id").alias("run_id"))


@query(f"select id, filename, status, version from {DOCS}")
def ctl1_documents(spark, d):
    return documents(spark, d).select("id", "filename", "status", "version")


@query(f"select cluster_id as id, count(*) as size, min(id) as first from {CHUNKS} where cluster_id is not null group by 1")
def ctl1_clusters(spark, d):
    return chunks(spark, d).where(F.col("cluster_id").isNotNull()).groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("size"), F.min("id").alias("first"))


@query(f"select run_id, max(ts) as finished, count(*) as events from {SEQ} group by 1 order by finished desc, run_id limit 50")
def ctl2_run_history(spark, d):
    return run_events(spark, d).groupBy("run_id").agg(F.max("ts").alias("finished"), F.count("*").alias("events")).orderBy(F.desc("finished"), "run_id").limit(50)


@query()
def ctl4_schemas(spark, d):
    import json

    from siftline.schemas import export_schemas

    return spark.createDataFrame([(k, json.dumps(v)) for k, v in export_schemas().items()], "name string, schema string")
