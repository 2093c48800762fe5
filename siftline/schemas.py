"""Declared schemas of the relational model, for readers and for export."""

from __future__ import annotations

import json

from pyspark.sql import types as T

_DDL = {
    "run": "id string, kind string, status string, request string, result string, created_at timestamp, finished_at timestamp",
    "stage_event": "id bigint, run_id string, seq int, stage_id string, status string, started_at timestamp, duration_ms int, payload string",
    "document": "id string, filename string, extension string, size_bytes bigint, sha256 string, page_count int, total_tokens int, chunk_count int, duplicate_chunk_count int, chunk_size int, chunk_overlap int, version int, status string, error string, last_job_id string, created_at timestamp, updated_at timestamp",
    "chunk": "id string, document_id string, chunk_index int, page int, page_end int, text string, token_count int, start_offset int, end_offset int, overlap_prev_chars int, cluster_id int, is_duplicate_of string, duplicate_similarity double",
    "cluster": "id int, label string, label_source string, size int, member_hash string",
    "llm_cache": "key string, kind string, model string, value string, created_at timestamp",
    "eval_dataset": "id string, name string, source string, status string, error string, question_count int, meta string, created_at timestamp",
    "eval_question": "id bigint, dataset_id string, idx int, question string, ground_truth string, relevant_spans array<struct<sha256:string,start_offset:int,end_offset:int,chunk_id:string,filename:string,page:int>>",
    "eval_run": "id string, dataset_id string, status string, param_grid map<string,array<double>>, total int, done int, error string, created_at timestamp, finished_at timestamp",
    "eval_result": "id bigint, eval_run_id string, cell int, question_id bigint, status string, answer string, error string, metrics map<string,double>, latency_ms int",
    "eval_index": "id string, dir_name string, chunk_size int, chunk_overlap int, dedup_threshold double, build_graph boolean, corpus array<string>, embedder string, kg_model string, status string, created_at timestamp",
    "vertex": "id string, name string, type string, description string, aliases array<string>, chunk_ids array<string>, degree int",
    "golden_line": "question string, ground_truth string, relevant_chunk_ids array<string>",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])


def export_schemas() -> dict:
    """JSON form of every schema."""
    return {k: json.loads(schema(k).json()) for k in _DDL}
