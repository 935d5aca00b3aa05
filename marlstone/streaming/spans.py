"""Streams of spans: late session ids, live sessions, windows.

The state of a trace is its session id once known and the spans that wait for it; both are bounded by a timeout.
Output goes through ``foreachBatch`` into a :class:`VersionedTable`, whose commit names the batch, so a batch that
is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from marlstone.operators import sessions
from marlstone.operators.incremental import VersionedTable

SPAN_SCHEMA = "trace_id string, span_id string, parent_span_id string, name string, start_time_unix_nano bigint, end_time_unix_nano bigint, attributes map<string,string>, status string, session_id string"
OUT = "trace_id string, span_id string, name string, start_time_unix_nano bigint, session string"
#: How long in seconds spans wait for their session.
PATIENCE = 3_600


def read_spans(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the JSON lines files that appear in a folder; lines that are no JSON are skipped."""
    lines = spark.readStream.schema(SPAN_SCHEMA).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch)
    return lines.json(folder).where("span_id is not null")


def with_late_sessions(spans: DataFrame, most_waiting: int | None = None) -> DataFrame:
    """Spans with their session: from themselves, or from whichever span of the trace first names one, before or after.

    A span without one waits in the state of its trace; after ``PATIENCE`` seconds without news it goes out with a null
    session. Only with ``most_waiting`` a trace keeps no more spans than that, and the oldest go out so before.
    """
    session = F.coalesce(*[sessions.known(F.col("attributes")[k]) for k in sessions.SESSION_KEYS], sessions.known(F.col("session_id")))
    rows = spans.select("trace_id", "span_id", "name", "start_time_unix_nano", session.alias("session"))

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, waiting = state.get if state.exists else (None, [])
        waiting = [tuple(w) for w in waiting]
        if state.hasTimedOut:
            state.remove()
            ready, known = waiting, None
        else:
            ready = list(waiting)
            for frame in frames:
                for r in frame.itertuples(index=False):
                    if known is None and isinstance(r.session, str):
                        known = r.session
                    ready.append((r.span_id, r.name, int(r.start_time_unix_nano or 0), r.session if isinstance(r.session, str) else None))
            held = ready if known is None else []
            if most_waiting is not None and len(held) > most_waiting:
                ready, held = held[:-most_waiting], held[-most_waiting:]
            elif known is None:
                ready = []
            state.update((known, held))
            state.setTimeoutDuration(PATIENCE * 1000)
        if ready:
            yield pd.DataFrame([(key[0], *r[:3], r[3] or known) for r in ready], columns=["trace_id", "span_id", "name", "start_time_unix_nano", "session"])

    waiting = "array<struct<span_id: string, name: string, start: bigint, session: string>>"
    return rows.groupBy("trace_id").applyInPandasWithState(follow, OUT, f"known string, waiting {waiting}", "append", GroupStateTimeout.ProcessingTimeTimeout)


def once(spans: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The stream with each span id once within ``lateness``."""
    at = F.timestamp_micros((F.col("start_time_unix_nano") / 1000).cast("bigint"))
    return spans.withColumn("at", at).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["span_id"]).drop("at")


def windowed(spans: DataFrame, size: str = "5 minutes", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """``(start, name, spans, errors)`` by windows of event time; what is later than ``lateness`` is dropped."""
    at = F.timestamp_micros((F.col("start_time_unix_nano") / 1000).cast("bigint"))
    rows = spans.withColumn("at", at).withWatermark("at", lateness)
    return rows.groupBy(F.window("at", size, slide) if slide else F.window("at", size), "name").agg(F.count("*").alias("spans"), F.count_if(F.lower("status") == "error").alias("errors")).select(F.col("window.start").alias("start"), "name", "spans", "errors")


def keep_sessions(spans: DataFrame, table: VersionedTable, checkpoint: str, now: int = 2**62) -> StreamingQuery:
    """Keep a table of sessions (key ``session``) up to date: counts add up, starts and ends widen.

    A span that comes again within an hour is not counted again. Each commit names its batch; one that comes again after a failure is skipped.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if table.manifest()["processed"].get("batch", -1) >= number:
            return
        fresh = sessions.materialised(sessions.adopted(sessions.resolved(batch)), now).drop("traces")
        old = table.read()
        if old is not None:
            touched = old.join(fresh.select("session"), "session", "left_semi")
            fresh = fresh.unionByName(touched).groupBy("session").agg(F.sum("spans").alias("spans"), F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("errors").alias("errors"))
        table.commit(fresh, processed={"batch": number})

    return once(spans).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
