from datetime import datetime, timedelta

from pyspark.sql import functions as F

from biblark.streaming import novelty

NOW = datetime(2024, 5, 1, 12)


def test_first_sweep_makes_no_hits(spark):
    hours = lambda h: NOW - timedelta(hours=h)
    watches = spark.createDataFrame([("new", None), ("due", hours(12)), ("rests", hours(11)), ("idle", hours(99))], "watch string, last_run timestamp")
    found = spark.createDataFrame([("new", "a", NOW), ("due", "a", NOW), ("due", "b", NOW), ("due", "b", hours(1)), ("due", "c", NOW), ("due", "", NOW), ("due", None, NOW), ("rests", "a", NOW), (None, "a", NOW), ("unknown", "a", NOW)], "watch string, external_id string, found_at timestamp")
    seen = spark.createDataFrame([("due", "a")], "watch string, external_id string")
    hits = spark.createDataFrame([("due", "c", NOW, "dismissed")], "watch string, external_id string, found_at timestamp, state string")
    now = F.lit(NOW)
    first = novelty.swept(found, watches, seen, hits, now)
    assert [tuple(r) for r in first.hits.select("watch", "external_id", "found_at", "state").collect()] == [("due", "b", hours(1), "new")]
    assert [tuple(r) for r in first.seen.collect()] == [("new", "a")]
    assert {r["watch"]: r["last_run"] for r in first.watches.collect()} == {"new": NOW, "due": NOW, "rests": hours(11), "idle": NOW}
    # At once nothing but the resting watch can be due; half a day later only new works are hits.
    again = novelty.swept(found, first.watches, seen, hits, now)
    assert again.hits.count() == 0 and again.seen.count() == 0
    later = novelty.swept(found.unionByName(spark.createDataFrame([("new", "z", NOW)], found.schema)), first.watches, seen.unionByName(first.seen), hits.unionByName(first.hits.select(*hits.columns)), F.lit(NOW + timedelta(hours=12)))
    assert sorted((r["watch"], r["external_id"]) for r in later.hits.collect()) == [("new", "z"), ("rests", "a")]


def test_feed_and_decisions(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("w", "a", at(1), "new"), ("w", "b", at(3), "new"), ("w", "c", at(3), "new"), ("w", "d", None, "new"), ("w", "e", at(9), "added"), ("v", "a", at(1), "dismissed")]
    hits = spark.createDataFrame(rows, "watch string, external_id string, found_at timestamp, state string")
    assert [r["external_id"] for r in novelty.feed(hits).orderBy("place").collect()] == ["b", "c", "a", "d"]
    assert {r["n"] for r in novelty.feed(hits).collect()} == {4}
    assert novelty.feed(hits.limit(0)).count() == 0
    after = novelty.dismissed(hits, spark.createDataFrame([("w",), ("w",)], "watch string"))
    assert sorted((r["external_id"], r["state"]) for r in after.where("watch = 'w'").collect()) == [("a", "dismissed"), ("b", "dismissed"), ("c", "dismissed"), ("d", "dismissed"), ("e", "added")]
    owned = spark.createDataFrame([("e", 5), ("a", 6)], "external_id string, document_id long")
    targets = spark.createDataFrame([("w", 70)], "watch string, collection_id long")
    assert [tuple(r) for r in novelty.accepted(hits, owned, targets).collect()] == [(70, 5)]
