"""Logs and usage: rollups, repeats, percentiles, timelines, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Cells that a group's range is cut into.
CELLS = 4096


def usage_rollup(events: DataFrame, types: list[str], at: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """day, one sum for each type (0 if there is none), total."""
    day = F.date_format(F.col(at).cast("timestamp"), "yyyy-MM-dd").alias("day")
    out = events.groupBy(day).pivot(kind, types).agg(F.round(F.sum(value), 6))
    filled = [F.coalesce(F.col(t), F.lit(0.0)).alias(t) for t in types]
    return out.select("day", *filled).withColumn("total", F.round(sum((F.col(t) for t in types), F.lit(0.0)), 6))


def hit_ratio(rollup: DataFrame, hit: str, other: str, least: float = 50_000, broken_below: float = 0.3) -> DataFrame:
    """ratio of hits (null without any), and broken: enough of them at too low a ratio."""
    total = F.col(hit) + F.col(other)
    out = rollup.withColumn("ratio", F.when(total > 0, F.round(F.col(hit) / total, 6)))
    return out.withColumn("broken", F.coalesce((total >= least) & (F.col("ratio") < broken_below), F.lit(False)))


def collapse_repeats(log: DataFrame, per: str, order: str, value: str, least: int = 1) -> DataFrame:
    """per, first, value, n: runs of one value that follow each other."""
    w = Window.partitionBy(per).orderBy(order)
    new = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True)).cast("int")
    runs = log.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(per, "_run", value).agg(F.min(order).alias("first"), F.count("*").alias("n")).drop("_run").filter(F.col("n") >= least)


def nearest_rank(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """by, p, value: the value at index round(p * (n - 1)), halves to even.

    A group's range is cut into cells; counts of cells tell which one holds the index, and only its values are put in
    order, so no task sorts a group."""
    rows = df.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("value"))
    ends = rows.groupBy(by).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    cell = F.when(F.col("high") > F.col("low"), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS)).otherwise(0).cast("long")
    counted = rows.join(ends, by).withColumn("cell", cell).groupBy(by, "cell", "value").agg(F.count("*").alias("m"))
    cells = counted.groupBy(by, "cell").agg(F.sum("m").alias("in_cell"))
    before = F.sum("in_cell").over(Window.partitionBy(by).orderBy("cell")) - F.col("in_cell")  # CELLS + 1 rows of a group at most
    index = F.bround(F.col("p") * (F.col("n") - 1)).cast("long")
    asked = cells.withColumn("before", before).join(ends.select(by, "n"), by).withColumn("p", F.explode(F.array(*map(F.lit, shares)))).withColumn("index", index)
    asked = asked.filter((F.col("index") >= F.col("before")) & (F.col("index") < F.col("before") + F.col("in_cell"))).select(by, "cell", "p", "before", "index")
    upto = F.col("before") + F.sum("m").over(Window.partitionBy(by, "p").orderBy("value"))
    found = counted.join(asked, [by, "cell"]).withColumn("upto", upto)
    return found.filter((F.col("index") < F.col("upto")) & (F.col("index") >= F.col("upto") - F.col("m"))).select(by, "p", "value")


def timeline(log: DataFrame, since: int | None = None, limit: int = 100, id_col: str = "event_id") -> DataFrame:
    """After a cursor in ascending order, else the newest first."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    return log.filter(F.col(id_col) > since).orderBy(id_col).limit(limit) if since is not None else log.orderBy(F.desc(id_col)).limit(limit)


def newest(log: DataFrame, k: int, *order: str) -> DataFrame:
    return log.orderBy(*(F.desc(c) for c in order)).limit(k)


def retain(log: DataFrame, at: str, as_of: str, days: int = 365) -> DataFrame:
    return log.filter(F.col(at).cast("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def otlp_points(payloads: DataFrame, body: str = "body") -> DataFrame:
    """metric, at (ns), value, attributes: sums and gauges of OTLP/JSON metric payloads."""
    point = "struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>,asDouble:double,asInt:string,timeUnixNano:string>"
    kind = f"struct<dataPoints:array<{point}>>"
    schema = f"struct<resourceMetrics:array<struct<scopeMetrics:array<struct<metrics:array<struct<name:string,sum:{kind},gauge:{kind}>>>>>>>"
    metrics = payloads.select(F.from_json(body, schema).alias("j")).select(F.explode("j.resourceMetrics").alias("r")).select(F.explode("r.scopeMetrics").alias("s")).select(F.explode("s.metrics").alias("m"))
    each = metrics.select(F.col("m.name").alias("metric"), F.explode(F.coalesce("m.sum.dataPoints", "m.gauge.dataPoints")).alias("p"))
    attributes = F.map_from_entries(F.transform("p.attributes", lambda a: F.struct(a["key"], a["value"]["stringValue"])))
    return each.select("metric", F.col("p.timeUnixNano").cast("long").alias("at"), F.coalesce("p.asDouble", F.col("p.asInt").cast("double")).alias("value"), attributes.alias("attributes"))


def majority_size(probes: DataFrame, group: str, size: str = "size") -> DataFrame:
    """Rows with `expected` (the most frequent size of their group, the smallest of ties) and `mismatch`."""
    n = probes.groupBy(group, size).agg(F.count("*").alias("_n"))
    best = n.groupBy(group).agg(F.min_by(size, F.struct(-F.col("_n"), F.col(size))).alias("expected"))
    return probes.join(best, group).withColumn("mismatch", F.col(size) != F.col("expected"))


def circuit_states(results: DataFrame, per: str = "origin", order: str = "n", ok: str = "ok", limit: int = 3) -> DataFrame:
    """Each result with `failures` in a row so far and whether the circuit is `open`."""
    w = Window.partitionBy(per).orderBy(order)
    runs = results.withColumn("_run", F.sum(F.col(ok).cast("int")).over(w))
    failures = F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(per, "_run").orderBy(order))
    return runs.withColumn("failures", failures).withColumn("open", F.col("failures") >= limit).drop("_run")


def verdict_order(score: str = "score", relevance: str = "relevance"):
    """Sort keys of judged results: the score as far as there is one (none counts as -1), then relevance."""
    return [F.coalesce(F.col(score).cast("double"), F.lit(-1.0)).desc(), F.col(relevance).desc()]


def transcript_usage(turns: DataFrame, files: int = 200) -> DataFrame:
    """model, messages, input_tokens, output_tokens of assistant turns in the newest files. turns: file, modified, role,
    model, input_tokens, output_tokens."""
    newest = turns.groupBy("file").agg(F.max("modified").alias("modified")).orderBy(F.desc("modified"), "file").limit(files).select("file")
    own = turns.filter("role = 'assistant'").join(F.broadcast(newest), "file", "left_semi")
    return own.groupBy("model").agg(F.count("*").alias("messages"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def short_number(value):
    """Thousands as K, millions as M, with one decimal."""
    return F.when(value >= 1e6, F.concat(F.format_string("%.1f", F.round(value / 1e6, 1)), F.lit("M"))).when(value >= 1e3, F.concat(F.format_string("%.1f", F.round(value / 1e3, 1)), F.lit("K"))).otherwise(F.format_string("%.0f", value))


def daemon_age(at: str, as_of: str):
    """Seconds since a heartbeat, 0 for the future, -1 if there is none."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))
    return F.when(age.isNull(), -1).when(age < 0, 0).otherwise(age)


def drift_union(sources: DataFrame, group: str, ok: str = "ok") -> DataFrame:
    """group, state: bad if any source is bad, ok if some are ok and none is bad, unknown without a verdict."""
    return sources.groupBy(group).agg(F.bool_and(ok).alias("_ok")).select(group, F.when(F.col("_ok").isNull(), "unknown").when(F.col("_ok"), "ok").otherwise("bad").alias("state"))
