"""Append-only jobs as streams: records once by their hash, sums by window, the review fold."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..lineage import shared_folder
from ..shipping import ship

#: Requests that the fold remembers for each relation: a replay of an older one counts by its revision.
REMEMBERED = 1000


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(stream: DataFrame, at: str, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def window_totals(stream: DataFrame, at: str, value: str, keys: list[str], width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window; with the watermark a window is emitted once it is closed."""
    windowed = stream.withWatermark(at, lateness) if stream.isStreaming else stream
    out = windowed.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def fold_reviews(events: DataFrame) -> DataFrame:
    """The standing action of each relation of a stream of (relation_id, revision, action, request_id).

    A request that was seen already changes nothing; revisions may arrive in any order. The state of a
    relation is its standing action and the last REMEMBERED requests.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, action, seen = state.get if state.exists else (-1, None, [])
        seen = dict.fromkeys(seen)  # in order of arrival
        for batch in batches:
            for row in batch.sort_values("revision").itertuples():
                if row.request_id not in seen:
                    seen[row.request_id] = None
                    if row.revision > revision:
                        revision, action = row.revision, row.action
        state.update((revision, action, list(seen)[-REMEMBERED:]))
        yield pd.DataFrame({"relation_id": [key[0]], "revision": [revision], "action": [action]})

    ship(events.sparkSession)
    return events.groupBy("relation_id").applyInPandasWithState(
        run, "relation_id string, revision long, action string", "revision long, action string, seen array<string>", "update", GroupStateTimeout.NoTimeout
    )


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its rows.

    Appended rows go to a table in the shared folder. The other modes keep their rows in memory, which
    is for tests and small queries.
    """
    writer = stream.writeStream.queryName(name).outputMode(mode).trigger(availableNow=True)
    if mode != "append":
        writer.format("memory").start().awaitTermination()
        return stream.sparkSession.table(name)
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/rows"
    spark.createDataFrame([], stream.schema).write.parquet(out)  # there even if the stream has no rows
    writer.format("parquet").option("path", out).option("checkpointLocation", f"{root}/progress").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
