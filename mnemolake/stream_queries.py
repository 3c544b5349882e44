"""Registered queries of streams: the driver's tables, replayed through stateful streams to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake import session
from mnemolake.queries import query
from mnemolake.sources import growing
from mnemolake.sources.tables import table
from mnemolake.streaming import feeds, timed


def _own(spark: SparkSession) -> SparkSession:
    """A session with the store that timers need; the caller's settings stay."""
    own = spark.newSession()
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), **timed.STORE}.items():
        own.conf.set(k, v)
    return own


def _drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream tells until its input ends."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream with a watermark; `at` is its time."""
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/event[s].parquet")  # a pattern: the table may be one file
    return raw.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "0 seconds")


#: Bytes of the table's files to a shard: some 13,000 events.
SHARD_BYTES = 256 << 10


def _shards(spark: SparkSession, d: str) -> int:
    """Shards whose number grows with the table, so what one holds doesn't."""
    size = int(spark.read.parquet(f"{d}/events.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(timed.SHARDS, -(-size // SHARD_BYTES)) if size < 1 << 50 else timed.SHARDS


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e),
    g AS (SELECT user_id, burst, count(*) AS n, min(ts) AS first, max(ts) AS last FROM b GROUP BY 1, 2)
    SELECT user_id, n, first, last FROM g WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)""")
def debounced_changes(spark, d):
    own = _own(spark)
    out = _drained(timed.debounce(_events(own, d), "user_id", quiet="6 hours", shards=_shards(spark, d)), session.work_folder(spark, "debounce"))
    return out.select("user_id", "n", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'error') AS i FROM events),
    s AS (SELECT user_id, i, ts, ok, true AS tried, CASE WHEN ok THEN 0 ELSE 1 END AS failures, NULL::TIMESTAMP AS until FROM e WHERE i = 1
          UNION ALL
          SELECT user_id, i, ts, ok, tried, CASE WHEN NOT tried THEN f WHEN ok THEN 0 ELSE f + 1 END,
                 CASE WHEN NOT tried THEN u WHEN ok THEN NULL WHEN f + 1 >= 2 THEN ts + INTERVAL 12 HOUR ELSE u END
          FROM (SELECT e.user_id, e.i, e.ts, e.ok, CASE WHEN e.ts >= s.ts + INTERVAL 3 DAY THEN 0 ELSE s.failures END AS f, CASE WHEN e.ts >= s.ts + INTERVAL 3 DAY THEN NULL ELSE s.until END AS u,
                       coalesce(CASE WHEN e.ts >= s.ts + INTERVAL 3 DAY THEN NULL ELSE s.until END <= e.ts, true) AS tried FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)),
    final AS (SELECT user_id, max_by(until, i) AS until, max_by(failures, i) AS failures, max(ts) AS last FROM s GROUP BY 1)
    SELECT user_id, ts AS at, ok, tried, failures::BIGINT AS failures, until AS open_until FROM s
    UNION ALL SELECT user_id, until, NULL, NULL, failures::BIGINT, NULL FROM final WHERE until > last AND until <= (SELECT max(ts) FROM events)""")
def breaker_attempts(spark, d):
    own = _own(spark)
    tries = _events(own, d).withColumn("ok", F.col("event_type") != "error")
    out = _drained(timed.circuit_breaker(tries, "user_id", limit=2, cooldown="12 hours", forget="3 days", shards=_shards(spark, d)), session.work_folder(spark, "breaker"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "open_until")})


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type AS url, ts, event_id, event_id % 4 <> 0 AS ok, CASE WHEN event_id % 5 > 0 THEN 'b' || event_id END AS body, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, url, i, ts, CASE WHEN ok THEN body END AS body, CASE WHEN ok THEN 'fetched' ELSE 'failed' END AS served, CASE WHEN ok THEN ts END AS stored, CASE WHEN ok THEN body END AS held FROM e WHERE i = 1
          UNION ALL
          SELECT e.user_id, e.url, e.i, e.ts, CASE WHEN e.ts - s.stored < INTERVAL 2 DAY THEN s.held WHEN e.ok THEN e.body ELSE s.held END,
                 CASE WHEN e.ts - s.stored < INTERVAL 2 DAY THEN 'cached' WHEN e.ok THEN 'fetched' WHEN s.stored IS NOT NULL THEN 'stale' ELSE 'failed' END,
                 CASE WHEN e.ts - s.stored < INTERVAL 2 DAY OR NOT e.ok THEN s.stored ELSE e.ts END, CASE WHEN e.ts - s.stored < INTERVAL 2 DAY OR NOT e.ok THEN s.held ELSE e.body END
          FROM s JOIN e ON e.user_id = s.user_id AND e.url = s.url AND e.i = s.i + 1)
    SELECT user_id, ts AS at, url, body, served FROM s""")
def cached_pages(spark, d):
    own = _own(spark)
    body = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("b"), "event_id"))
    asked = _events(own, d).select("user_id", F.col("event_type").alias("url"), body.alias("body"), (F.col("event_id") % 4 != 0).alias("ok"), "event_id", "at")
    out = _drained(timed.page_cache(asked, "user_id", ttl="2 days", keep="365 days", order=("event_id",), shards=_shards(spark, d)), session.work_folder(spark, "pages"))
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """A transcript line of each event; half of them are an assistant's."""
    usage = F.struct(F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    kind = F.when(F.col("event_id") % 2 == 0, "assistant").otherwise("user")
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(kind.alias("type"), F.struct(usage.alias("usage")).alias("message"))).alias("value"))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'assistant' ELSE 'user' END AS type, event_id AS input_tokens, user_id AS output_tokens FROM events")
def tailed_lines(spark, d):
    folder, turns = session.work_folder(spark, "tail"), _turns(spark, d)
    lines = growing.growing_lines(spark, f"{folder}/in", suffix=".txt").select(F.from_json("line", feeds._USAGE).alias("e")).select("e.type", "e.message.usage.input_tokens", "e.message.usage.output_tokens")
    for part in (0, 1):  # files arrive between two runs
        turns.filter(F.col("event_id") % 3 == 0 if part else F.col("event_id") % 3 != 0).select("value").write.mode("append").text(f"{folder}/in")
        out = _drained(lines, folder)
    return out


@query("SELECT count(*) FILTER (event_id % 2 = 0) AS turns, coalesce(sum(event_id) FILTER (event_id % 2 = 0), 0)::BIGINT AS input, coalesce(sum(user_id) FILTER (event_id % 2 = 0), 0)::BIGINT AS output FROM events")
def usage_of_files(spark, d):
    folder = session.work_folder(spark, "usage")
    _turns(spark, d).select("value").write.text(f"{folder}/in")
    usage = feeds.file_usage(growing.growing_lines(spark, f"{folder}/in", suffix=".txt"))
    told = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    usage.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(told).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("file").agg(*(F.max_by(c, "batch").alias(c) for c in ("turns", "input", "output")))
    return last.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("turns", "input", "output")))
