"""Registered queries over the activity stream and the novelty feed, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblark.operators.storage import shared_folder
from biblark.plans.library import Library, cte
from biblark.streaming import activity, novelty, tokens


def shared(lib: Library) -> str:
    return f"{shared_folder(lib.spark)}/events-{uuid.uuid4().hex}"


def shaped(df: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "click", "start").when(kind == "view", "ok").when(kind == "error", "err").otherwise("blip")
    at = F.col("ts").cast("timestamp")
    return df.select(F.col("event_id").alias("id"), F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("node"), state.alias("state"), F.col("props").alias("detail"), at.alias("at"), F.unix_millis(at).alias("ts"), "user_id", "value")


def events(lib: Library) -> DataFrame:
    return shaped(lib.table("events"))


def stream(lib: Library) -> DataFrame:
    schema = lib.table("events").schema
    return shaped(lib.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{lib.folder}/events.parque[t]"))


def finished(lib: Library, df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and reads its sink."""
    at = shared(lib)
    df.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return lib.spark.read.schema(df.schema).parquet(f"{at}/out")


def streamed_sweep(lib: Library) -> DataFrame:
    at = shared(lib)
    s = stream(lib)
    found = s.select(F.col("node").alias("watch"), F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("external_id"), F.col("at").alias("found_at"))
    seen = events(lib).where("user_id % 7 = 0").select(F.col("node").alias("watch"), F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("external_id")).distinct()
    activity.run_sweeps(found, seen, f"{at}/hits", f"{at}/state").awaitTermination()
    return activity.stored(lib.spark, f"{at}/hits", activity.HIT + ", batch long").select("watch", "external_id", "state")


def novelty_counts(lib: Library) -> DataFrame:
    return lib.watch_hits.where("state = 'new'").groupBy("watch").agg(F.count("*").alias("n"))


def novel(lib: Library) -> DataFrame:
    """New hits of works that nobody had decided on before they were found, once a watch."""
    key = ["watch", "external_id"]
    first = lib.watch_hits.where("state <> 'new'").groupBy(*key).agg(F.min("found_at").alias("_decided"))
    open_ = lib.watch_hits.where("state = 'new'").join(first, key, "left").where("_decided is null or _decided >= found_at")
    return open_.groupBy(*key).agg(F.min("id").alias("id")).select("id", *key)


NOW = "2024-02-01 12:00:00"


def sweep_result(lib: Library) -> DataFrame:
    """(part, watch, external_id, at) of one sweep of five watches: two at their first, one that rests, one due for an hour and
    one due this minute."""
    now = F.lit(NOW).cast("timestamp")
    kind = F.col("event_type")
    ago = F.when(kind == "view", 13).when(kind == "purchase", 1).when(kind == "signup", 12)
    e = lib.table("events")
    watches = e.select(kind.alias("watch"), (now - F.make_interval(hours=ago)).alias("last_run")).distinct()
    found = e.select(kind.alias("watch"), F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("external_id"), F.col("ts").cast("timestamp").alias("found_at"), "user_id")
    out = novelty.swept(found, watches, found.where("user_id % 7 = 0"), found.where("user_id % 11 = 0"), now)
    parts = [out.hits.select(F.lit("hit").alias("part"), "watch", "external_id", F.col("found_at").alias("at")), out.seen.select(F.lit("seen").alias("part"), "watch", "external_id", F.lit(None).cast("timestamp").alias("at")), out.watches.select(F.lit("watch").alias("part"), "watch", F.lit(None).cast("string").alias("external_id"), F.col("last_run").alias("at"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("at", F.col("at").cast("timestamp_ntz"))


def per_node(lib: Library) -> DataFrame:
    e = events(lib)
    return e.groupBy("node").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("start", "ok", "err")], F.max("ts").alias("last"))


def pieces(lib: Library) -> DataFrame:
    """Every text's words as a model's answer: lines of JSON, every third document as events, cut into 1,000 bytes."""
    words = F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.to_json(F.struct(F.concat(w, F.lit(" ")).alias("response"))))
    event = F.transform(words, lambda w: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(w, F.lit(" ")).alias("content")).alias("delta"))).alias("choices")))))
    lines = F.when(F.col("doc_id") % 3 == 0, F.concat(F.array_join(event, "\n\n"), F.lit("\n\ndata: [DONE]"))).otherwise(F.array_join(plain, "\n"))
    bytes_ = lib.table("documents").select(F.col("doc_id").alias("stream"), F.encode(lines, "utf-8").alias("b"))
    count = F.greatest(F.ceil(F.octet_length("b") / 1000).cast("int"), F.lit(1))
    cut = bytes_.select("stream", "b", count.alias("k"), F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    return cut.select("stream", F.col("i").cast("long").alias("number"), F.substring("b", F.col("i") * 1000 + 1, F.lit(1000)).alias("data"), (F.col("i") == F.col("k") - 1).alias("last"))


def streamed_answers(lib: Library) -> DataFrame:
    """(stream, n, answer): tokens and digest of each answer, from pieces that come in any order."""
    at = shared(lib)
    found = pieces(lib)
    found.repartition(4, F.xxhash64("stream", "number")).write.parquet(f"{at}/pieces")
    source = lib.spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/pieces")
    said = finished(lib, tokens.tokens(source))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda t: t["token"]), "")
    return said.groupBy("stream").agg(F.count("*").alias("n"), F.sha2(F.trim(whole), 256).alias("answer"))


BASE = """e AS (SELECT event_id AS id, 'n' || (user_id % 5) AS node, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'ok' WHEN 'error' THEN 'err' ELSE 'blip' END AS state, ts AS t, epoch_us(ts) // 1000 AS ts, user_id, value FROM events)"""
WINDOWS = f"""WITH {BASE}, k AS (SELECT unnest(range(0, 6)) AS k)
    SELECT make_timestamp(((epoch_us(t) // 600000000) - k) * 600000000) AS begin, node, count(*) AS n FROM e, k GROUP BY 1, 2"""


def utc(df: DataFrame) -> DataFrame:
    return df.withColumn("begin", F.col("begin").cast("timestamp_ntz"))


QUERIES = {
    "event_dedup": (lambda lib: activity.without_repeats(events(lib).unionByName(events(lib))).select("id", "node", "state"), f"WITH {BASE} SELECT id, node, state FROM e"),
    "event_counts_window": (lambda lib: utc(activity.rolling_counts(events(lib), "60 minutes", "10 minutes")), WINDOWS),
    "event_per_node": (per_node, f"WITH {BASE} SELECT node, count(*) FILTER (state = 'start') AS start, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'err') AS err, max(ts) AS last FROM e GROUP BY 1"),
    "event_outcome": (
        lambda lib: events(lib).select("id", activity.outcome(F.col("state"), F.when(F.col("user_id") % 2 == 0, "Operazione ANNULLATA").otherwise("x")).alias("outcome")),
        f"WITH {BASE} SELECT id, CASE WHEN state = 'err' AND user_id % 2 = 0 THEN 'ok' ELSE state END AS outcome FROM e",
    ),
    "ring_latest_n": (lambda lib: events(lib).orderBy(F.desc("ts"), F.desc("id")).limit(600).select("id", "ts"), f"WITH {BASE} SELECT id, ts FROM e ORDER BY ts DESC, id DESC LIMIT 600"),
    "event_filter": (lambda lib: events(lib).where("node = 'n3' and state in ('err', 'warn')").select("id"), f"WITH {BASE} SELECT id FROM e WHERE node = 'n3' AND state IN ('err', 'warn')"),
    "event_days": (lambda lib: events(lib).groupBy(F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")), f"WITH {BASE} SELECT strftime(t, '%Y-%m-%d') AS day, count(*) AS n FROM e GROUP BY 1"),
    "json_props": (lambda lib: lib.table("events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n")), "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1"),
    "novelty_counts": (novelty_counts, cte("SELECT watch, count(*) AS n FROM lib_watch_hits WHERE state = 'new' GROUP BY 1")),
    "novelty_sweep": (
        sweep_result,
        f"""WITH f AS (SELECT event_type AS watch, 'x' || user_id AS external_id, min(ts) AS t, user_id FROM events GROUP BY ALL),
            g AS (SELECT * FROM f WHERE user_id % 7 <> 0 AND user_id % 11 <> 0),
            w AS (SELECT DISTINCT event_type AS watch FROM events)
            SELECT 'hit' AS part, watch, external_id, CAST(t AS TIMESTAMP) AS "at" FROM g WHERE watch IN ('view', 'signup')
            UNION ALL SELECT 'seen', watch, external_id, NULL FROM g WHERE watch IN ('click', 'error')
            UNION ALL SELECT 'watch', watch, NULL, CASE watch WHEN 'purchase' THEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR ELSE TIMESTAMP '{NOW}' END FROM w""",
    ),
    "novelty_feed": (lambda lib: novelty.feed(lib.watch_hits), cte("SELECT watch, count(*) OVER (PARTITION BY watch) AS n, row_number() OVER (PARTITION BY watch ORDER BY found_at DESC, external_id) AS place, external_id, found_at FROM lib_watch_hits WHERE state = 'new'")),
    "novelty_anti": (
        novel,
        cte("SELECT min(id) AS id, watch, external_id FROM lib_watch_hits h WHERE state = 'new' AND NOT EXISTS (SELECT 1 FROM lib_watch_hits o WHERE o.state <> 'new' AND o.watch = h.watch AND o.external_id = h.external_id AND o.found_at < h.found_at) GROUP BY watch, external_id"),
    ),
    "stream_tokens": (
        streamed_answers,
        "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id AS stream, CAST(len(w) AS BIGINT) AS n, sha256(array_to_string(w, ' ')) AS answer FROM w WHERE len(w) > 0",
    ),
    "stream_dedup": (lambda lib: finished(lib, activity.without_repeats(stream(lib)).select("id", "node")), f"WITH {BASE} SELECT id, node FROM e"),
    "stream_jobs": (lambda lib: finished(lib, activity.jobs(stream(lib))), None),
    "stream_novelty": (streamed_sweep, f"WITH {BASE} SELECT DISTINCT node AS watch, 'x' || user_id AS external_id, 'new' AS state FROM e WHERE user_id % 7 <> 0"),
}
