"""Streams of changes and events: windows, first sightings, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A Parquet folder as a stream with a watermark."""
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling(stream: DataFrame, size: str, *by: str, at: str = "ts", value: str = "value", slide: str | None = None) -> DataFrame:
    """Count and sum by window."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.groupBy(window, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, gap: str, *by: str, at: str = "ts") -> DataFrame:
    return stream.groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def first_seen(stream: DataFrame, *keys: str) -> DataFrame:
    """Each key once as long as the watermark remembers it."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def fold(stream: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, n, total after each batch: a running fold in the state store."""

    def step(k, batches, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Appends to a Parquet log, each batch once, as far as there is input now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


_USAGE = "type string, message struct<usage:struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>>"


def file_usage(lines: DataFrame) -> DataFrame:
    """file, turns, input, output, cache_read, cache_creation: what the assistant's turns in each transcript used so far,
    told for each file that a batch changes. lines: what sources.growing gives; a file that was written anew counts from
    nothing. Lines that aren't JSON, other entries and missing numbers add nothing."""
    entry = F.from_json("line", _USAGE)
    names = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_creation": "cache_creation_input_tokens"}
    counts = (entry["type"] == "assistant") & entry["message"]["usage"].isNotNull()
    parts = [F.when(counts, F.coalesce(entry["message"]["usage"][c], F.lit(0))).otherwise(0).alias(k) for k, c in names.items()]
    columns = ["turns", *names]

    def step(key, batches, state):
        import pandas as pd

        rows = pd.concat(list(batches))
        before = state.get if state.exists and not rows["anew"].any() else (0,) * len(columns)
        now = tuple(int(b + rows[c].sum()) for b, c in zip(before, columns))
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["file", *columns])

    own = lines.select("file", "anew", F.coalesce(counts, F.lit(False)).cast("long").alias("turns"), *parts)
    kinds = ", ".join(f"{c} long" for c in columns)
    return own.groupBy("file").applyInPandasWithState(step, f"file string, {kinds}", kinds, "update", "NoTimeout")
