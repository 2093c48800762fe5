"""Run events, as tables and as streams: sequence, replay, fold, retention, sentence-wise redaction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Complete sentences and lines, then what is still being written.
COMPLETE = re.compile(r"((?:.*(?:[.!?](?=\s)|\n))?)(.*)", re.DOTALL)
WITHHELD = "[withheld: PII redaction was unavailable]"


# --- tables -----------------------------------------------------------------


def sequence(events: DataFrame) -> DataFrame:
    """``events`` with seq: 1, 2, ... within each run, by time then id."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy("run_id").orderBy("ts", "event_id")))


def replay(sequenced: DataFrame, after: int) -> DataFrame:
    """Events after a sequence number, and one ``done`` at the end of each run."""
    rest = sequenced.where(F.col("seq") > after).select("run_id", "seq", "stage")
    done = sequenced.groupBy("run_id").agg((F.max("seq") + 1).cast("int").alias("seq")).select("run_id", "seq", F.lit("done").alias("stage"))
    return rest.unionByName(done)


def fold(sequenced: DataFrame) -> DataFrame:
    """(run_id, stage, last_seq, value): the latest event of each stage. Repeats change nothing."""
    return sequenced.groupBy("run_id", "stage").agg(F.max("seq").alias("last_seq"), F.max_by("value", "seq").alias("value"))


def expired(sequenced: DataFrame, now, keep_seconds: int = 3600) -> DataFrame:
    """Runs whose last event lies more than ``keep_seconds`` before ``now`` (a timestamp column)."""
    return sequenced.groupBy("run_id").agg(F.max("ts").alias("last")).where(F.col("last") < now - F.expr(f"interval {keep_seconds} seconds"))


def durations(sequenced: DataFrame) -> DataFrame:
    """(run_id, seq, stage, duration_ms): time from the event before in the run, 0 for the first."""
    before = F.lag("ts").over(W.partitionBy("run_id").orderBy("seq"))
    return sequenced.select("run_id", "seq", "stage", F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(before.cast("timestamp")), F.lit(0)).alias("duration_ms"))


# --- redaction --------------------------------------------------------------


class Redactor:
    """Masks a text that arrives in pieces, sentence by sentence.

    ``rest`` is what has not been sent; after a failure of ``mask`` one marker goes out
    and nothing more (``silent``), as text that cannot be checked must not be sent.
    """

    def __init__(self, mask: Callable[[str], str], rest: str = "", silent: bool = False):
        self.mask, self.rest, self.silent = mask, rest, silent

    def send(self, piece: str, last: bool = False) -> str:
        if self.silent:
            return ""
        ready, self.rest = COMPLETE.fullmatch(self.rest + piece).groups()
        if last:
            ready, self.rest = ready + self.rest, ""
        try:
            return self.mask(ready) if ready else ""
        except Exception:  # noqa: BLE001
            self.rest, self.silent = "", True
            return WITHHELD


def redact_deltas(deltas: list[str], mask: Callable[[str], str]) -> list[str]:
    """What a stream of deltas sends, piece by piece, then the rest."""
    r = Redactor(mask)
    sent = [*map(r.send, deltas), r.send("", last=True)]
    return [t for t in sent if t]


# --- streams ----------------------------------------------------------------


def deduplicated(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (run_id, seq) once, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


def fold_stream(stream: DataFrame) -> DataFrame:
    """The running fold, for update or complete mode."""
    return stream.groupBy("run_id", "stage").agg(F.max("seq").alias("last_seq"), F.max_by("value", "seq").alias("value"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stage", "n")


def sequence_stream(stream: DataFrame) -> DataFrame:
    """(run_id, event_id, stage, seq): gapless numbers by a counter for each run; events after ``done`` are refused."""

    def count(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, closed = state.get if state.exists else (0, False)
        rows = pd.concat(parts).sort_values(["ts", "event_id"])
        out = []
        for event, stage in zip(rows["event_id"], rows["stage"]):
            if closed:
                break
            n += 1
            closed = stage == "done"
            out.append((key[0], event, stage, n))
        state.update((n, closed))
        yield pd.DataFrame(out, columns=["run_id", "event_id", "stage", "seq"])

    return stream.groupBy("run_id").applyInPandasWithState(count, "run_id bigint, event_id bigint, stage string, seq int", "n int, closed boolean", "append", "NoTimeout")


def redact_stream(stream: DataFrame, mask: Callable[[str], str]) -> DataFrame:
    """(stream_id, out): masked text up to the last sentence end that has arrived. ``stream``: stream_id, seq, delta, final."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        r = Redactor(mask, *(state.get if state.exists else ()))
        rows = pd.concat(parts).sort_values("seq")
        sent = [r.send(delta or "", bool(last)) for delta, last in zip(rows["delta"], rows["final"])]
        state.update((r.rest, r.silent))
        yield pd.DataFrame({"stream_id": key[0], "out": [t for t in sent if t]}, columns=["stream_id", "out"])

    return stream.groupBy("stream_id").applyInPandasWithState(step, T.StructType.fromDDL("stream_id bigint, out string"), T.StructType.fromDDL("buffer string, dead boolean"), "append", "NoTimeout")
