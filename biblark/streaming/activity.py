"""Activity events as streams: duplicates, counts, jobs in progress, novelty, files that arrive.

Every operator takes a streaming (or batch) DataFrame and leaves partitioning
to Spark: state is keyed, bounded by a watermark, and no batch is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CANCELLED = "annullat|interrott"


def outcome(state: Column, detail: Column) -> Column:
    """A cancelled job counts as ok."""
    return F.when((state == "err") & F.lower(detail).rlike(CANCELLED), "ok").otherwise(state)


def without_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once; ids are remembered for ``delay`` of event time."""
    if not events.isStreaming:
        return events.dropDuplicates(["id"])
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def rolling_counts(events: DataFrame, length: str = "60 seconds", step: str = "10 seconds", delay: str = "1 hour") -> DataFrame:
    """(begin, node, n) of overlapping windows of event time."""
    timed = events.withWatermark("at", delay) if events.isStreaming else events
    return timed.groupBy(F.window("at", length, step).alias("w"), "node").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "node", "n")


def jobs(events: DataFrame) -> DataFrame:
    """(node, at, busy, seconds): a row for each job that closes. A start older than the node's last close is
    passed over; the number of open jobs never falls below zero; seconds run from the last start. Blips and progress
    are left out before the state; of a node's share of a micro-batch only three numbers an event are held."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        busy, started, closed = state.get if state.exists else (0, -1, -1)
        ts, ids, starts = (np.concatenate(c) for c in zip(*((b["ts"].to_numpy(), b["id"].to_numpy(), b["starts"].to_numpy(dtype=bool)) for b in batches), strict=True))
        order = np.lexsort((ids, ts))
        out = []
        for at, is_start in zip(ts[order].tolist(), starts[order].tolist(), strict=True):
            if is_start:
                if at >= closed:
                    busy, started = busy + 1, at
            else:
                busy, closed = max(0, busy - 1), max(closed, at)
                out.append((key[0], at, busy, (at - started) / 1000 if started >= 0 else None))
        state.update((busy, started, closed))
        yield pd.DataFrame(out, columns=["node", "at", "busy", "seconds"])

    narrow = events.where("state in ('start', 'ok', 'err', 'warn')").select("id", "node", (F.col("state") == "start").alias("starts"), "ts")
    return narrow.groupBy("node").applyInPandasWithState(follow, "node string, at long, busy int, seconds double", "busy int, started long, closed long", "append", GroupStateTimeout.NoTimeout)


def daily_log(events: DataFrame, path: str, checkpoint: str):
    """Events as JSON lines in one folder a day."""
    dated = events.withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    return dated.writeStream.partitionBy("day").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that a sweep appends to; empty before the first one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


HIT = "watch string, external_id string, found_at timestamp, state string"


def sweep(found: DataFrame, seen: DataFrame, hits: DataFrame) -> DataFrame:
    """New hits of a batch: neither in the baseline nor found before, each once a watch, the earliest kept."""
    key = ["watch", "external_id"]
    named = found.where("external_id is not null and external_id <> ''")
    fresh = named.join(seen.select(*key), key, "left_anti").join(hits.select(*key), key, "left_anti")
    return fresh.groupBy(*key).agg(F.min("found_at").alias("found_at")).withColumn("state", F.lit("new"))


def run_sweeps(found: DataFrame, seen: DataFrame, path: str, checkpoint: str):
    """Adds the new hits of each micro-batch to ``path``. A batch writes a folder of its own number, so that
    one that is run again after a failure replaces its rows."""

    def add(batch: DataFrame, number: int) -> None:
        hits = stored(batch.sparkSession, path, HIT + ", batch long").where(F.col("batch") != number)
        sweep(batch, seen, hits).select("watch", "external_id", F.col("found_at").cast("timestamp"), "state").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return found.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decided(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """Hits after the user's decisions (watch, external_id, decision): new becomes added or dismissed."""
    made = decisions.select("watch", "external_id", "decision").dropDuplicates(["watch", "external_id"])
    return hits.join(made, ["watch", "external_id"], "left").withColumn("state", F.when((F.col("state") == "new") & F.col("decision").isin("added", "dismissed"), F.col("decision")).otherwise(F.col("state"))).drop("decision")


def debounced(requests: DataFrame, wait_ms: int = 2000) -> DataFrame:
    """(node, first, due): the runs that requests (node, ts) lead to. The first request sets a run off ``wait_ms`` later, those
    in between join it. A run is given out with its first request, so none waits for another one; requests that are
    older than the latest run's first one belong to runs given out before."""

    def collapse(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (first,) = state.get if state.exists else (None,)
        out = []
        for ts in np.unique(np.concatenate([b["ts"].to_numpy() for b in batches])):
            if first is None or ts > first + wait_ms:
                first = int(ts)
                out.append((key[0], first, first + wait_ms))
        state.update((first,))
        yield pd.DataFrame(out, columns=["node", "first", "due"])

    return requests.where("ts is not null").select("node", "ts").groupBy("node").applyInPandasWithState(collapse, "node string, first long, due long", "first long", "append", GroupStateTimeout.NoTimeout)


def arrivals(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """Files of a watched folder, each once: path, digest, size, text title."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", most_files).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", F.sha2("content", 256).alias("file_hash"), "length", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"))


def import_arrivals(files: DataFrame, path: str, checkpoint: str):
    """Appends files whose path and digest are new to ``path``, one folder a batch."""
    schema = "path string, file_hash string, length long, title string, batch long"

    def add(batch: DataFrame, number: int) -> None:
        known = stored(batch.sparkSession, path, schema).where(F.col("batch") != number)
        new = batch.join(known.select("path"), "path", "left_anti").join(known.select("file_hash"), "file_hash", "left_anti")
        first = new.groupBy("file_hash").agg(F.min(F.struct("path", "length", "title")).alias("f"))
        first.select("f.path", "file_hash", "f.length", "f.title").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
