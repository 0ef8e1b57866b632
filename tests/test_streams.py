"""Streams: pieces of tokens, runs after requests, jobs, against plain versions."""

import json
import random

from biblark import queries
from biblark.streaming import activity, tokens


def streamed(spark, rows, schema, make, folder, files=4):
    """``rows`` come in several micro-batches."""
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = make(source)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def test_any_cut_gives_the_same_tokens(spark, tmp_path):
    rng = random.Random(2)
    said = ["a", "né", "日本", "", " x\n", "🦜", '"q"']
    plain = "\n".join([*(json.dumps({"response": t}, ensure_ascii=False) for t in said), "no json", "{}", "[]", json.dumps({"response": 3})]).encode()
    events = "\n\n".join([*("data: " + json.dumps({"choices": [{"delta": {"content": t}}]}, ensure_ascii=False) for t in said), ": comment", 'data: {"choices": []}', "data: [DONE]", ""]).encode()
    rows = []
    for stream in range(12):
        data = (plain if stream % 2 else events) if stream < 10 else b""
        cuts = sorted(rng.sample(range(len(data)), min(len(data), 3 * stream)))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        rows += [(stream, i, bytearray(p), i == len(parts) - 1) for i, p in enumerate(parts)]
    rng.shuffle(rows)
    rows += rows[:5]  # pieces that come again
    got = streamed(spark, rows, "stream long, number long, data binary, last boolean", tokens.tokens, tmp_path)
    by = {}
    for r in got:
        by.setdefault(r["stream"], []).append((r["n"], r["token"]))
    assert {k: sorted(v) for k, v in by.items()} == {k: list(enumerate(t for t in said if t)) for k in range(10)}


def test_runs_after_requests(spark, tmp_path):
    """Every run comes out, the last one too."""
    rows = [("a", 1000), ("a", 2500), ("a", 3000), ("a", 3001), ("b", 5), ("a", 9000), ("b", None)]
    got = streamed(spark, rows, "node string, ts long", activity.debounced, tmp_path, 1)
    assert sorted(tuple(r) for r in got) == [("a", 1000, 3000), ("a", 3001, 5001), ("a", 9000, 11000), ("b", 5, 2005)]


def test_runs_over_batches(spark, tmp_path):
    rows = [("a", 1000), ("a", 2000), ("a", 2900), ("a", 4000)]
    got = streamed(spark, rows, "node string, ts long", activity.debounced, tmp_path, 4)
    assert (("a", 4000, 6000) in {tuple(r) for r in got}) and len(got) <= 2


def test_decisions(spark):
    hits = spark.createDataFrame([("w", "1", "new"), ("w", "2", "new"), ("w", "3", "added"), ("v", "1", "new")], "watch string, external_id string, state string")
    made = spark.createDataFrame([("w", "1", "dismissed"), ("w", "2", "nonsense"), ("w", "3", "dismissed")], "watch string, external_id string, decision string")
    assert {(r["watch"], r["external_id"]): r["state"] for r in activity.decided(hits, made).collect()} == {("w", "1"): "dismissed", ("w", "2"): "new", ("w", "3"): "added", ("v", "1"): "new"}


def test_daily_log(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "2024-01-02 23:59:59"), (2, "2024-01-03 00:00:00")], "id long, t string").write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("id long, t string").parquet(f"{tmp_path}/in").select("id", F.col("t").cast("timestamp").alias("at"))
    activity.daily_log(events, f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    assert {(r["id"], str(r["day"])) for r in spark.read.json(f"{tmp_path}/log").select("id", "day").collect()} == {(1, "2024-01-02"), (2, "2024-01-03")}


def test_jobs_of_the_query(spark):
    """All four columns of stream_jobs, against a plain run over the events."""
    folder = "/root/testdata/sf0.001"
    kinds = {"click": "start", "view": "ok", "error": "err"}
    rows = spark.read.parquet(f"{folder}/events.parquet").selectExpr("event_id as id", "user_id % 5 as node", "event_type", "unix_millis(cast(ts as timestamp)) as ts").collect()
    expected, state = [], {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
        busy, started, closed = state.get(r["node"], (0, None, -1))
        kind = kinds.get(r["event_type"])
        if kind == "start" and r["ts"] >= closed:
            busy, started = busy + 1, r["ts"]
        elif kind in ("ok", "err"):
            busy, closed = max(0, busy - 1), max(closed, r["ts"])
            expected.append((f"n{r['node']}", r["ts"], busy, None if started is None else (r["ts"] - started) / 1000))
        state[r["node"]] = busy, started, closed
    got = [tuple(r) for r in queries.QUERIES["stream_jobs"](spark, folder).select("node", "at", "busy", "seconds").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
