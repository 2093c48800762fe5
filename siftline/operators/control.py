"""Control surface: health, run slots, recovery, cancellation, logs, errors."""

from __future__ import annotations

import json
import logging
import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NotFound(LookupError):
    pass


class Conflict(RuntimeError):
    pass


def error_envelope(e: Exception) -> dict:
    kind = {"ParameterError": "validation", "NotFound": "not_found", "Conflict": "conflict"}.get(type(e).__name__, "internal")
    return {"error": kind, "message": str(e), "fields": getattr(e, "errors", {})}


class Slots:
    """One ingest at a time, one evaluation at a time, never both."""

    def __init__(self):
        self._lock, self._held = threading.Lock(), set()

    @contextmanager
    def hold(self, kind: str):
        with self._lock:
            if self._held:
                raise Conflict(f"{sorted(self._held)[0]} is running")
            self._held.add(kind)
        try:
            yield
        finally:
            with self._lock:
                self._held.discard(kind)


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": record.created, "level": record.levelname, "message": record.getMessage(), "run_id": getattr(record, "run_id", None)})


def health(spark: SparkSession, tables: dict[str, DataFrame], embedder=None) -> dict:
    """Which parts answer."""
    out = {"spark": spark.version, "embedder": getattr(embedder, "model_name", None)}
    for name, df in tables.items():
        try:
            out[name] = not df.isEmpty()
        except Exception as e:  # noqa: BLE001
            out[name] = type(e).__name__
    return out


def recover(runs: DataFrame) -> DataFrame:
    """Runs left running by a crash become errors."""
    return runs.withColumn("status", F.when(F.col("status") == "running", "error").otherwise(F.col("status")))


def evaluate_until_cancelled(items: list, evaluate, cancelled: threading.Event) -> tuple[list, bool]:
    """(results so far, whether they are partial): the flag is read between items."""
    out = []
    for x in items:
        if cancelled.is_set():
            return out, True
        out.append(evaluate(x))
    return out, False


@contextmanager
def stage(record, run_id: str, stage_id: str):
    """Records running, then success or error with its duration; the error goes on."""
    began = time.monotonic()
    record({"run_id": run_id, "stage": stage_id, "status": "running"})
    try:
        yield
    except Exception:
        record({"run_id": run_id, "stage": stage_id, "status": "error", "duration_ms": round((time.monotonic() - began) * 1000)})
        raise
    record({"run_id": run_id, "stage": stage_id, "status": "success", "duration_ms": round((time.monotonic() - began) * 1000)})
