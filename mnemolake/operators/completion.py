"""Completion of many prefixes at once: a sorted table of keys, with the answers to short prefixes made beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Letters of a prefix whose answers are ready; also what longer ones are dealt by.
SHORT = 3


def _first(df: DataFrame, per: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(per).orderBy("value"))
    return df.withColumn("rank", place).filter(F.col("rank") <= k)


def index(values: DataFrame, key: str, value: str, k: int = 20, short: int = SHORT) -> tuple[DataFrame, DataFrame]:
    """keys (bucket, key, value): each value under its key in lower case, once, sorted within the buckets of the first
    `short` letters; ready (prefix, value, rank): the first k values of each prefix of up to `short` letters. Rows with a
    null or empty key go; a null value is the key itself."""
    rows = values.filter(F.col(key).isNotNull() & (F.col(key) != "")).select(F.lower(key).alias("key"), F.coalesce(F.col(value).cast("string"), F.col(key)).alias("value")).distinct()
    keys = rows.select(F.substring("key", 1, short).alias("bucket"), "key", "value")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.length("key"), F.lit(short))), lambda n: F.substring("key", F.lit(1), n))
    each = rows.select(F.explode(prefixes).alias("prefix"), "value").distinct()
    return keys.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), _first(each, "prefix", k)


def complete(prefixes: DataFrame, keys: DataFrame, ready: DataFrame, k: int = 20, prefix: str = "prefix", short: int = SHORT) -> DataFrame:
    """prefix, value, rank: for each distinct prefix the first k values whose key begins with it, whatever the case, in
    order of values. Short prefixes look up what is ready; longer ones meet the keys of their bucket. The empty prefix
    lists all; a null one nothing. keys, ready: from index() with the same `short` and no smaller k."""
    asked = prefixes.filter(F.col(prefix).isNotNull()).select(F.col(prefix).alias("prefix"), F.lower(prefix).alias("low")).distinct()
    few = asked.filter(F.length("low") <= short).join(ready.select(F.col("prefix").alias("low"), "value", "rank"), "low").filter(F.col("rank") <= k)
    long = asked.filter(F.length("low") > short).withColumn("bucket", F.substring("low", 1, short))
    met = long.join(keys, "bucket").filter(F.startswith("key", "low")).select("prefix", "value").distinct()
    return few.select("prefix", "value", "rank").unionByName(_first(met, "prefix", k).select("prefix", "value", "rank"))
