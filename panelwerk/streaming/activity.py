"""Time rules over events, as streams and as batches: worker liveness, upload sessions, job progress, single claims.

States that begin because nothing happens are in ``idle``, the memory is in ``memory_store``.

Each function takes a DataFrame that may be a stream. Streams need a watermark on a TIMESTAMP column; ``timed`` casts and sets it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEARTBEAT_SECONDS, STALE_SECONDS, ABANDONED_SECONDS = 120, 90, 3600


def timed(df: DataFrame, column: str = "ts", delay: str = f"{ABANDONED_SECONDS} seconds") -> DataFrame:
    """Event time as TIMESTAMP with a watermark: rows later than ``delay`` may be dropped."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def sessions(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, start, end, events): spans without a gap of ``seconds`` or more; the end is the last event plus the gap."""
    span = F.session_window("ts", f"{seconds} seconds")
    found = events.groupBy(key, span.alias("w")).agg(F.count("*").alias("events"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def worker_liveness(heartbeats: DataFrame, seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Intervals in which each worker was up."""
    return sessions(heartbeats, "worker_id", seconds)


def overall_liveness(heartbeats: DataFrame, seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Intervals in which any worker was up."""
    return sessions(heartbeats.withColumn("any", F.lit("any")), "any", seconds).drop("any")


def upload_sessions(uploads: DataFrame, seconds: int = STALE_SECONDS) -> DataFrame:
    return sessions(uploads, "export_id", seconds)


def upload_states(sessions: DataFrame, now, seconds: int = STALE_SECONDS, abandoned: int = ABANDONED_SECONDS) -> DataFrame:
    """``sessions`` of uploads with ``state`` at ``now``: ``active``, ``stale`` or ``abandoned`` by the time since their last event.

    A session ends ``seconds`` after its last event, so that it is no longer active at its end.
    """
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("end")) + seconds * 1_000_000
    state = F.when(idle > abandoned * 1_000_000, "abandoned").when(idle > seconds * 1_000_000, "stale").otherwise("active")
    return sessions.withColumn("state", state)


def sessions_by_gaps(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """The batch twin of ``sessions``: a new span starts where the gap to the event before is wide enough."""
    turn = Window.partitionBy(key).orderBy("ts")
    at = F.col("ts").cast("timestamp")
    wide = F.unix_micros(at) - F.lag(F.unix_micros(at)).over(turn) >= seconds * 1_000_000
    rows = events.withColumn("new", F.coalesce(wide, F.lit(True)).cast("int"))
    rows = rows.withColumn("span", F.sum("new").over(turn.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.max("ts").cast("timestamp") + F.expr(f"INTERVAL {seconds} SECONDS")
    return rows.groupBy(key, "span").agg(F.min("ts").cast("timestamp").alias("start"), last.alias("end"), F.count("*").alias("events")).drop("span")


def job_progress(samples: DataFrame) -> DataFrame:
    """First and latest sample of every job, kept up as samples arrive (update mode)."""
    return samples.groupBy("job_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("latest"), F.min_by("progress", "ts").alias("first_progress"), F.max_by("progress", "ts").alias("progress"), F.max("total").alias("total")
    )


def claim_jobs(claims: DataFrame) -> DataFrame:
    """The first claim of each job; of a stream the first to arrive within the watermark, of a batch that of the least (ts, worker_id)."""
    if claims.isStreaming:
        return claims.dropDuplicatesWithinWatermark(["job_id"])
    return claims.groupBy("job_id").agg(F.min_by(F.struct(*claims.columns), F.struct("ts", "worker_id")).alias("c")).select("c.*")


def clean_answers(raw: DataFrame) -> DataFrame:
    """Arriving answers (block_id, kind, answer) as texts with flags; stateless."""
    kind, answer = F.col("kind"), F.col("answer")
    rows = raw.select("block_id", "kind", T.ocr_read(answer, kind).alias("read")).select("block_id", "kind", "read.text", "read.looped")
    review = F.col("looped") | ((F.col("text") != "") & T.needs_review(F.col("text")))
    sign = (kind == "sfx") & T.not_a_sound(F.col("text"))
    return rows.select("block_id", F.when(sign, "other").otherwise(kind).alias("kind"), "text", review.alias("needs_review"))
