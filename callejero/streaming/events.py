"""Resolution events as streams: sink, replay protection, counters, rate limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an event may carry: never the text of an address.
FIELDS = ("time", "client", "external_id", "decision", "resolution_type", "precision_level", "score", "processing_us", "dataset_version", "normalizer_version")


def event_sink(events: DataFrame, path: str, checkpoint: str, every: str = "1 second", once: bool = False) -> StreamingQuery:
    """Append events as NDJSON. The source is replayable, so nothing is dropped when the sink is slow."""
    kept = events.select(*[c for c in FIELDS if c in events.columns])
    writer = kept.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def replay_protected(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first request of each client and idempotency key; later ones within the watermark are replays."""
    return requests.withWatermark("time", delay).dropDuplicatesWithinWatermark(["client", "key"])


def decision_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("decision", "precision_level").agg(F.count("*").alias("n"))


def rate_limited(requests: DataFrame, rate: float, delay: str = "1 minute") -> DataFrame:
    """client, time, request_id, allowed: a token bucket per client of ``rate`` a second and twice that in burst, by event time.

    A bucket that nobody asks for two seconds is full again, so its state is dropped once the
    watermark (``delay`` behind the newest request) has passed that; it starts full when asked again.
    """
    full_after = 2.0

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (2 * rate, None)
        for batch in batches:
            batch, allowed = batch.sort_values(["time", "request_id"]), []
            for at in batch["time"].map(pd.Timestamp.timestamp):
                tokens = min(2 * rate, tokens + max(0.0, at - last) * rate) if last is not None else tokens
                last = at if last is None else max(last, at)
                allowed.append(tokens >= 1)
                tokens -= 1 if tokens >= 1 else 0
            yield batch[["client", "time", "request_id"]].assign(allowed=allowed)
        state.update((tokens, last))
        state.setTimeoutTimestamp(int(max((last + full_after) * 1000, state.getCurrentWatermarkMs() + 1)))

    timed = requests.withWatermark("time", delay)
    return timed.groupBy("client").applyInPandasWithState(run, "client string, time timestamp, request_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def with_latest_tables(requests: DataFrame, load: Callable[[], tuple[str, dict[str, DataFrame]]], answer: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Answer a stream of requests with the newest published tables.

    Every micro-batch asks ``load`` for (version, tables) first, so a publication holds from the next batch on. Where loading
    fails, the tables of the batch before stay; only without any does the batch fail. ``write``
    gets each batch's answers, with their version.
    """
    held: dict = {}

    def batch(rows: DataFrame, number: int) -> None:
        try:
            held["version"], held["tables"] = load()
        except Exception:  # a half-written or missing publication: go on with what is there
            if not held:
                raise
        write(answer(rows, held["tables"]).withColumn("version", F.lit(held["version"])))

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def dropped_events(buffered: DataFrame, capacity: int) -> DataFrame:
    """second, kept, dropped: what a bounded buffer that is emptied every second would have dropped; this sink drops nothing."""
    n = buffered.groupBy(F.date_trunc("second", "time").alias("second")).agg(F.count("*").alias("n"))
    return n.select("second", F.least("n", F.lit(capacity)).alias("kept"), F.greatest(F.col("n") - capacity, F.lit(0)).alias("dropped"))
