"""Running aggregates over feedback and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking


def timed(stream: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """With a watermark on the event time, which must be a zoned timestamp."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def deduplicated(stream: DataFrame, ts: str, key: str, delay: str = "1 hour") -> DataFrame:
    """Each key once: within the watermark in a stream, at all in a table."""
    return timed(stream, ts, delay).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])


def feedback_means(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running mean and count of ratings for each query (id, ts, query, rating); update mode; repeated ids within the watermark count once."""
    rows = deduplicated(stream, "ts", "id", delay).groupBy("query").agg(F.avg("rating").alias("mean"), F.count("*").alias("n"))
    return rows.withColumn("low", F.col("mean") < 0)


def event_windows(stream: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """(start, user_id, events, value) in tumbling or sliding windows; late rows beyond the watermark are left out of closed windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = timed(stream, "ts", delay).groupBy(window.alias("w"), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return rows.select(F.col("w.start").alias("start"), "user_id", "events", "value")


def event_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """(start, end, user_id, events, value) in sessions that end after a gap."""
    rows = timed(stream, "ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "events", "value")


def last_seen(stream: DataFrame) -> DataFrame:
    """(user_id, last_seen, events); update mode. Who is dormant follows from a datediff at read time."""
    return stream.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("events"))


def dormancies(stream: DataFrame, quiet: str = "14 days", delay: str = "1 day", now: Column | None = None) -> DataFrame:
    """(user_id, last_seen, dormant_at): one row each time that a user has been quiet for so long; append mode.

    A session with a gap of ``quiet`` is open as long as its user is active: it is
    emitted, once, when the watermark passes its end, so that late rows within
    ``delay`` still prolong it, and a user who comes back can become dormant again. Of a
    table those count that ended by ``now``, or else by its last event less the delay,
    where the stream's watermark would stand.
    """
    width = F.expr(f"INTERVAL {quiet}")
    rows = timed(stream, "ts", delay).groupBy(F.session_window("ts", quiet).alias("w"), "user_id").agg(F.max("ts").alias("last_seen"))
    rows = rows.select("user_id", "last_seen", (F.col("last_seen") + width).alias("dormant_at"))
    if stream.isStreaming:
        return rows
    last = F.max(F.col("ts").cast("timestamp")) - F.expr(f"INTERVAL {delay}")
    end = stream.agg((last if now is None else F.any_value(now)).alias("end"))
    return rows.crossJoin(F.broadcast(end)).where("dormant_at <= end").drop("end")  # one row


def ingest(pages: DataFrame, path: str, checkpoint: str, size: int = 1000, overlap: int = 200) -> StreamingQuery:
    """Chunk new pages (source, page, text, section) and append the chunks that the table at ``path`` lacks.

    The table is partitioned by source; of what it holds, a batch reads the ids of its own sources alone.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        chunks = chunking.chunk_documents(batch, size, overlap)
        try:
            held = batch.sparkSession.read.parquet(path).select("chunk_id", "source")
            mine = F.broadcast(batch.select("source").distinct())  # prunes partitions; as many sources as the batch has
            chunks = chunks.join(held.join(mine, "source", "left_semi").select("chunk_id"), "chunk_id", "left_anti")
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
        chunks.dropDuplicates(["chunk_id"]).write.mode("append").partitionBy("source").parquet(path)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
