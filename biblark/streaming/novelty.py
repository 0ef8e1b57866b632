"""Saved searches that watch for new works: which are due, what a sweep finds, the feed, and decisions about it.

A watch is named; works have an id of their catalogue. Rows without either count for nothing. Repeated findings count
once, the earliest time kept; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblark.operators.folders import running
from biblark.streaming.activity import sweep

#: Fixed value: hours between two sweeps of a watch.
REST_HOURS = 12
KEY = ["watch", "external_id"]


@dataclass(frozen=True)
class Swept:
    hits: DataFrame  # watch, external_id, found_at, state: to be appended
    seen: DataFrame  # watch, external_id: to be appended
    watches: DataFrame  # watch, last_run: in place of the old table


def due(watches: DataFrame, now: Column, hours: int = REST_HOURS) -> DataFrame:
    """``watches`` (watch, last_run) that never ran or last ran ``hours`` ago or longer."""
    return watches.where(F.col("last_run").isNull() | (F.col("last_run") <= now - F.make_interval(hours=F.lit(hours))))


def swept(found: DataFrame, watches: DataFrame, seen: DataFrame, hits: DataFrame, now: Column, hours: int = REST_HOURS) -> Swept:
    """A sweep over what the catalogues gave back, ``found`` (watch, external_id, found_at). Watches that aren't due are passed
    over. The first sweep of a watch puts everything into the baseline and makes no hits; later ones make a hit of each
    work that is neither in the baseline nor a hit of this watch already. A due watch has run, found or not."""
    ready = due(watches, now, hours)
    asked = found.where("watch is not null and external_id <> ''").join(ready.select("watch", F.col("last_run").isNull().alias("_first")), "watch")
    known = seen.select(*KEY).unionByName(hits.select(*KEY))
    baseline = asked.where("_first").select(*KEY).distinct().join(known, KEY, "left_anti")
    fresh = sweep(asked.where("not _first"), seen, hits)
    ran = ready.select("watch", F.lit(True).alias("_ran"))
    after = watches.join(ran, "watch", "left").select("watch", F.when(F.col("_ran"), now).otherwise(F.col("last_run")).alias("last_run"))
    return Swept(fresh, baseline, after)


def feed(hits: DataFrame) -> DataFrame:
    """(watch, n, place, external_id, found_at) of new hits: each watch with how many it has, the latest first, ties by id, those
    without a time last. Places are running sums over blocks of time, so a watch that holds most hits is spread."""
    new = hits.where("state = 'new'").select(*KEY, "found_at")
    counts = new.groupBy("watch").agg(F.count("*").alias("n"))
    late = F.coalesce(-F.unix_micros(F.col("found_at").cast("timestamp")), F.lit((1 << 62)))
    # Blocks of the order hold 65,536 units; a unit of 100 milliseconds makes them about two hours.
    placed = running(new.withColumns({"_t": F.floor(late / 100_000), "_exact": late}), ["watch"], "_t", F.lit(1), "place", ("_exact", "external_id"))
    return placed.join(counts, "watch").select("watch", "n", "place", "external_id", "found_at")


def dismissed(hits: DataFrame, watches: DataFrame) -> DataFrame:
    """``hits`` after all new ones of ``watches`` (watch) were dismissed at once."""
    gone = watches.select("watch").distinct().withColumn("_gone", F.lit(True))
    return hits.join(gone, "watch", "left").withColumn("state", F.when(F.col("_gone") & (F.col("state") == "new"), "dismissed").otherwise(F.col("state"))).select(*hits.columns)


def accepted(hits: DataFrame, owned: DataFrame, targets: DataFrame) -> DataFrame:
    """(collection_id, document_id) that accepted hits add: ``owned`` (external_id, document_id) names the documents that came of
    them, ``targets`` (watch, collection_id) the collections that watches belong to; watches without one add nothing."""
    added = hits.where("state = 'added'").select(*KEY).distinct()
    return added.join(targets, "watch").join(owned, "external_id").select("collection_id", "document_id").distinct()
