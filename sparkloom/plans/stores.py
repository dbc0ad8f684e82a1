"""Queries over sources, keyed tables and streams, on what they write themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph
from ..session import scratch
from ..sources import files
from ..sources.keyed import KeyedTable
from ..streaming import bus, timers
from .tables import load


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as text files, read back whole; one in five is blank and left out."""
    path = scratch(spark, "nations")
    n = load(spark, sf_dir, "nation")
    body = F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.concat(F.lit("name = "), "n_name", F.lit("\n# region "), F.col("n_regionkey").cast("string")))
    n.select("n_nationkey", body.alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    rows = files.read_texts(spark, path)
    return rows.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), F.trim(F.col("content")).alias("content"), "language")


def found_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted files below a folder, those of odd nations ignored; new ones against an index."""
    path = scratch(spark, "found")
    n = load(spark, sf_dir, "nation")
    n.select("n_nationkey", F.concat("n_name", F.lit("!")).alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = files.discover(spark, path, ignore=[f"n_nationkey={k}/" for k in range(1, 25, 2)])
    rows = found.withColumn("n_nationkey", F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int"))
    known = rows.where("n_nationkey % 4 = 0").select("path", F.lit("2999-01-01").cast("timestamp").alias("indexed_at"))
    fresh = files.stale(found, known).select("path", F.lit(True).alias("new"))
    return rows.join(fresh, "path", "left").select("n_nationkey", "size_bytes", F.coalesce("new", F.lit(False)).alias("new"))


def log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table from an appended log, and one key looked up in it."""
    path = scratch(spark, "log")
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    files.append(e.where("event_id % 2 = 0"), path)
    files.append(e.where("event_id % 2 = 1"), path)
    state = files.latest(spark.read.parquet(path), "user_id", "event_id")
    return state.select("user_id", "event_id", "event_type", "value")


def partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written by label and read back by partition."""
    path = scratch(spark, "vectors")
    files.append(load(spark, sf_dir, "embeddings"), path, by=["label"])
    return spark.read.parquet(path).groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the values that an update gives; nulls keep the old, unknown keys are added."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey") - 1).alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), F.upper(F.concat("c_mktsegment", F.lit("!"))).alias("c_mktsegment"))
    return files.merged(c, new, "c_custkey")


def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    old = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seen"), F.col("o_orderpriority").alias("name"))
    return graph.upserted(old.where("seen % 2 = 0"), old.where("seen % 2 = 1"), ["id"], "seen").select("id", "seen", "name")


def keyed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a keyed table: put, patched with fields of their metadata, deleted, compacted, patched again."""
    o = load(spark, sf_dir, "orders")
    meta = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","seen":1}'))
    table = KeyedTable(spark, scratch(spark, "orders"), "o_orderkey bigint, o_totalprice double, meta string", "o_orderkey", 8)
    table.put(o.select("o_orderkey", "o_totalprice", meta.alias("meta")))
    table.patch(o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, 1.5).alias("o_totalprice"), F.lit('{"seen":2,"by":"a"}').alias("meta")), ["meta"])
    table.delete(o.where("o_orderkey % 5 = 0").select("o_orderkey"))
    table.compacted()
    table.patch(o.where("o_orderkey % 10 < 2").select("o_orderkey", F.lit('{"by":"b"}').alias("meta")), ["meta"])
    field = lambda x: F.get_json_object("meta", f"$.{x}")
    return table.read().select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), field("status").alias("status"), field("seen").cast("int").alias("seen"), field("by").alias("by"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result cache over its log: entries that have not run out or been invalidated by a later
    change, the latest so many of each user; hits of requests at the end."""
    e = load(spark, sf_dir, "events")
    puts = e.where("event_type in ('click', 'view')").select(F.col("user_id").alias("owner"), F.col("event_id").alias("key"), F.col("ts").alias("put_at"), (F.col("event_id") % 7).alias("file"))
    changes = e.where("event_type = 'error'").select((F.col("event_id") % 7).alias("file"), F.col("ts").alias("changed_at"))
    return files.cached(puts, changes, "owner", "key", "file", "2024-01-20 00:00:00", 86400 * 6, 5)


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click and error events of the stream, upserted batch by batch; the latest of each user."""
    log, schema = scratch(spark, "log"), load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").select("user_id", "event_id", "event_type")
    bus.subscribe(stream, F.col("event_type").isin("click", "error"), bus.upsert_into(log, "user_id", "event_id"), scratch(spark, "state")).awaitTermination()
    return files.latest(spark.read.parquet(log), "user_id", "event_id").select("user_id", "event_id", "event_type")


def _written(spark: SparkSession, rows: DataFrame, name: str, mode: str) -> DataFrame:
    """What the stream gives out until it has read all there is: a Parquet folder for each batch, of
    which every one counts if rows are appended and the last if it holds the complete result."""
    path, batches = scratch(spark, name), []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{n}")  # a batch that is run again replaces itself
        batches.append(f"{path}/{n}")

    rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", scratch(spark, name)).trigger(availableNow=True).start().awaitTermination()
    done = batches if mode == "append" else batches[-1:]
    return spark.read.schema(rows.schema).parquet(*done) if done else spark.createDataFrame([], rows.schema)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _written(spark, bus.windowed_counts(stream, "ts", "event_type", "6 hours", "2 days"), "windows", "complete")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of each user in sessions that end after half a day without one."""
    stream = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _written(spark, bus.idle(stream, "ts", "user_id", "12 hours", "40 days"), "sessions", "complete")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("beats").alias("beats"))


def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = stream.select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return _written(spark, bus.cooldown(rows, "user_id", "at", 43200.0), "cooldown", "append").select("user_id", "at")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections that timers have ended: half a day without a beat before the last event of all."""
    with timers.rocksdb(spark):
        return _written(spark, timers.heartbeats(_timed(spark, sf_dir), "user_id", "ts", 43_200_000, "0 seconds"), "ended", "append")


def stream_state_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each user stays with a type of event; six hours end it by a timer."""
    with timers.rocksdb(spark):
        return _written(spark, timers.durations(_timed(spark, sf_dir), "user_id", "ts", "event_type", 21_600_000, "0 seconds"), "spent", "append")


SQL = {
    "text_files": "SELECT n_nationkey, 'name = ' || n_name || chr(10) || '# region ' || n_regionkey || chr(10) AS content, 'text' AS language FROM nation WHERE n_nationkey % 5 <> 0",
    "found_files": "SELECT n_nationkey, strlen(n_name) + 2 AS size_bytes, n_nationkey % 4 <> 0 AS new FROM nation WHERE n_nationkey % 2 = 0",
    "log_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "partitioned_sink": "SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY label",
    "partial_update": """
      WITH n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey - 1 END AS c_custkey, upper(c_mktsegment || '!') AS seg FROM customer WHERE c_custkey % 3 = 0)
      SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, c_name, coalesce(seg, c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey""",
    "node_upsert": "SELECT o_custkey AS id, max(o_orderkey) AS seen, arg_max(o_orderpriority, o_orderkey) AS name FROM orders GROUP BY o_custkey",
    "keyed_updates": """
      SELECT o_orderkey, round(CASE WHEN o_orderkey % 6 = 0 THEN 1.5 ELSE o_totalprice END, 2) AS o_totalprice, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS seen,
             CASE WHEN o_orderkey % 10 < 2 THEN 'b' WHEN o_orderkey % 3 = 0 THEN 'a' END AS by FROM orders WHERE o_orderkey % 5 <> 0""",
    "cache_entries": """
      WITH p AS (SELECT user_id AS owner, event_id AS key, ts AS put_at, event_id % 7 AS file FROM events WHERE event_type IN ('click', 'view') AND ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 6 DAY),
      c AS (SELECT event_id % 7 AS file, max(ts) AS changed_at FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-20' GROUP BY ALL)
      SELECT owner, key FROM p LEFT JOIN c USING (file) WHERE changed_at IS NULL OR changed_at <= put_at QUALIFY row_number() OVER (PARTITION BY owner ORDER BY put_at DESC, key DESC) <= 5""",
    "stream_log": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id",
    "stream_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sessions": """
      WITH e AS (SELECT user_id, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR)::INT, 1) AS new FROM events)
      SELECT user_id, sum(new)::BIGINT AS sessions, count(*) AS beats FROM e GROUP BY user_id""",
    "stream_ended": """
      WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, max(epoch_us(ts) // 1000) OVER () AS mark FROM events), n AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 43200000)::INT, 1) AS new FROM e),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM n)
      SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS beats FROM s GROUP BY user_id, k HAVING max(t) + 43200000 <= max(mark)""",
    "stream_state_times": """
      WITH e AS (SELECT user_id, event_type AS state, epoch_us(ts) // 1000 AS t, max(epoch_us(ts) // 1000) OVER () AS mark FROM events),
      n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, state) - t AS spent FROM e)
      SELECT user_id, state, t AS since, CASE WHEN spent < 21600000 THEN spent ELSE 21600000 END AS spent, coalesce(spent >= 21600000, true) AS timed_out FROM n WHERE spent IS NOT NULL OR t + 21600000 <= mark""",
    "stream_cooldown": """
      WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts))::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))) AS k FROM events),
      r AS (SELECT *, t AS last, true AS ok FROM e WHERE k = 1
        UNION ALL SELECT e.*, CASE WHEN e.t - r.last >= 43200 THEN e.t ELSE r.last END, e.t - r.last >= 43200 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
      SELECT user_id, t AS "at" FROM r WHERE ok""",
}
QUERIES = {f.__name__: f for f in (text_files, found_files, log_latest, partitioned_sink, partial_update, node_upsert, keyed_updates, cache_entries, stream_log, stream_windows, stream_sessions, stream_cooldown, stream_ended, stream_state_times)}
