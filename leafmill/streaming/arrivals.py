"""Deliveries as a stream: new files of the change feed become changes, each once.

The state of a record is the greatest (updated_at, arrived_at, feed_id,
status) so far; it lies in the state store, so a batch reads only its own
deliveries and the states of their records. Every delivery is judged against
the state that the one before it left, within a batch as across batches. What
a batch writes is committed with its checkpoint, so a batch that is run again
after a failure writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from leafmill.operators import incremental

FEED = "feed_id long, tab string, rec_id string, status string, updated_at timestamp_ntz, arrived_at timestamp_ntz"


def feed_stream(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """The change feed as Parquet files arrive in a folder."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_at_once).parquet(folder)


CHANGE = "tab string, rec_id string, version long, status string, updated_at timestamp_ntz, arrived_at timestamp_ntz"
STATE = "u long, a long, f long, s string"
_NEVER = -(2**63)


def _judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes among a record's deliveries of a batch, in the order of their arrival."""
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["arrived_at", "feed_id"], kind="stable", ignore_index=True)
    micros = lambda c: [_NEVER if pd.isna(v) else v.value // 1000 for v in rows[c]]
    last = state.get if state.exists else None
    kept = []
    for u, a, f, s in zip(micros("updated_at"), micros("arrived_at"), rows["feed_id"].tolist(), rows["status"].tolist()):
        kept.append(last is None or u > last[0] or u == last[0] and s != last[3])
        last = (u, a, f, s) if last is None else max(last, (u, a, f, s), key=lambda x: (x[0], x[1], x[2], x[3] is not None, x[3] or ""))
    state.update(last)
    out = rows[kept]
    yield pd.DataFrame({"tab": key[0], "rec_id": key[1], "version": out["feed_id"], "status": out["status"], "updated_at": out["updated_at"], "arrived_at": out["arrived_at"]})


def stream_changes(feed: DataFrame) -> DataFrame:
    """The changes of a stream of deliveries.

    Deliveries of one record must not arrive in an earlier file than those
    before them; within a batch their order is by arrival. A batch bounds what
    a record's task holds.
    """
    rows = feed.where("arrived_at is not null and rec_id is not null and tab is not null").select("tab", "rec_id", "feed_id", "status", "updated_at", "arrived_at")
    return rows.groupBy(*incremental.KEY).applyInPandasWithState(_judge, CHANGE, STATE, "append", "NoTimeout")


def write_changes(feed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A query that appends the changes of each batch to ``out`` and ends when all files are read."""
    return stream_changes(feed).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(feed: DataFrame, lateness: str = "3 days", every: str = "1 day") -> DataFrame:
    """Deliveries of each table, status and window of arrival; late windows are dropped from the state by the watermark."""
    timed = feed.withColumn("at", F.col("arrived_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", every), "tab", "status").agg(F.count(F.lit(1)).alias("n"))
