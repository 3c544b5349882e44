"""Retrieval metrics, effect sizes and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.operators.ranking import top


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5, by: str | None = None) -> DataFrame:
    """ranked: query_id, doc_id, rank; relevant: query_id, doc_id, gain. Per query: recall, mrr, hit1, ndcg, ap at k; with
    `by` (a column of relevant) their means.

    A document counts once in a ranking. nDCG takes 2**gain - 1 and the ideal order of all gains."""
    rel = relevant.filter("gain > 0")
    once = ranked.filter(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    hit = once.join(rel.select("query_id", "doc_id", "gain"), ["query_id", "doc_id"])
    w = Window.partitionBy("query_id").orderBy("rank")
    got = hit.withColumn("seen", F.row_number().over(w)).groupBy("query_id").agg(
        F.count("*").alias("found"),
        F.min("rank").alias("first"),
        F.sum((F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col("seen") / F.col("rank")).alias("precision"),
    )
    # only the k best of a query are ranked
    best = top(rel, ["query_id"], k, F.desc("gain"), F.asc("doc_id")).groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col("rank") + 1)).alias("idcg"))
    ideal = rel.groupBy("query_id", *([by] if by else [])).agg(F.count("*").alias("n")).join(best, "query_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = ideal.join(got, "query_id", "left").select(
        "query_id",
        *([by] if by else []),
        zero(F.col("found") / F.col("n")).alias("recall"),
        zero(1 / F.col("first")).alias("mrr"),
        zero((F.col("first") == 1).cast("double")).alias("hit1"),
        zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"),
        zero(F.col("precision") / F.col("n")).alias("ap"),
    )
    names = ("recall", "mrr", "hit1", "ndcg", "ap")
    if by is None:
        return out.select("query_id", *(F.round(c, 6).alias(c) for c in names))
    return out.groupBy(by).agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in names))


def cliffs_delta(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """P(a > b) - P(a < b) with its magnitude.

    By counts of values and their running sums rather than all pairs."""
    is_a, is_b = F.col(group) == F.lit(a), F.col(group) == F.lit(b)
    own = df.filter((is_a | is_b) & F.col(value).isNotNull()).groupBy(value).agg(F.count_if(is_a).alias("na"), F.count_if(is_b).alias("nb"))
    # running sums without one task that holds all: sums of value ranges, then within them
    below = own.select(value, "na", "nb").withColumn("bucket", F.floor(F.col(value) / 64))
    per = below.groupBy("bucket").agg(F.sum("nb").alias("nb_bucket"))
    before = per.withColumn("before", F.coalesce(F.sum("nb_bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    each = below.join(before, "bucket").withColumn("less", F.col("before") + F.coalesce(F.sum("nb").over(w), F.lit(0)))
    total = each.agg(F.sum("na").alias("n"), F.sum("nb").alias("m"), F.sum(F.col("na") * F.col("less")).alias("above"), F.sum(F.col("na") * (F.col("less") + F.col("nb"))).alias("not_below"))
    delta = (F.col("above") - (F.col("n") * F.col("m") - F.col("not_below"))) / (F.col("n") * F.col("m"))
    out = total.select(F.round(delta, 6).alias("delta"))
    size = F.abs("delta")
    return out.withColumn("magnitude", F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large"))


def hedges_g(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Difference of means by the pooled deviation, corrected for small samples."""
    x = lambda v: F.when(F.col(group) == F.lit(v), F.col(value).cast("double"))
    s = df.agg(*(f(x(v)).alias(f"{n}{i}") for i, v in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    free = F.col("na") + F.col("nb") - 2
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / free)
    g = (F.col("ma") - F.col("mb")) / pooled * (1 - 3 / (4 * (F.col("na") + F.col("nb")) - 9))
    return s.select(F.round(F.when(pooled > 0, g).otherwise(0.0), 6).alias("g"))


def mulberry32(seed: int, first: int, count: int):
    """Numbers first + 1 to first + count of the generator of that name, from 0 to below 1: its state only counts, so any
    stretch can be had alone."""
    import numpy as np

    mask, u = np.uint64(0xFFFFFFFF), np.uint64
    state = (u(seed & 0xFFFFFFFF) + (np.arange(first + 1, first + count + 1, dtype=np.uint64) & mask) * u(0x6D2B79F5)) & mask
    t = ((state ^ (state >> u(15))) * (state | u(1))) & mask
    t = (t ^ (t + (((t ^ (t >> u(7))) * (t | u(61))) & mask))) & mask
    return ((t ^ (t >> u(14))) & mask) / 4294967296


#: Numbers that are drawn at a time.
DRAWN = 1 << 20


def resampled(sides: list, seed: int, first: int, rounds: int):
    """The mean of each side (values) in rounds first to first + rounds: a column a side. A round draws for one side after
    the other, indices rounded down."""
    import numpy as np

    sides = [np.asarray(s, float) for s in sides]
    size, out = sum(map(len, sides)), np.empty((rounds, len(sides)))
    step = max(1, DRAWN // size)
    for at in range(0, rounds, step):
        n = min(step, rounds - at)
        drawn, begin = mulberry32(seed, (first + at) * size, n * size).reshape(n, size), 0
        for i, side in enumerate(sides):
            out[at : at + n, i] = side[(drawn[:, begin : begin + len(side)] * len(side)).astype(np.int64)].mean(1)
            begin += len(side)
    return out


def _bounds(rounds: int, level: float) -> tuple[int, int]:
    low = round((1 - level) / 2, 12)
    return int(low * rounds), min(rounds - 1, int((1 - low) * rounds))


def bootstrap_interval(values: list[float], seed: int = 1, rounds: int = 10_000, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean from resampled means."""
    if not len(values):
        return (float("nan"), float("nan"))
    means, (low, high) = sorted(resampled([values], seed, 0, rounds)[:, 0].tolist()), _bounds(rounds, level)
    return means[low], means[high]


def bootstrap_delta(a: list[float], b: list[float], seed: int = 1, rounds: int = 10_000, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the difference of means, both sides resampled on their own; none below two values a side."""
    if min(len(a), len(b)) < 2:
        return (float("nan"), float("nan"))
    both, (low, high) = resampled([a, b], seed, 0, rounds), _bounds(rounds, level)
    found = sorted((both[:, 0] - both[:, 1]).tolist())
    return found[low], found[high]


#: Rounds that a row of work stands for.
ROUNDS = 250


def _intervals(sides: DataFrame, names: list[str], seed: int, rounds: int, level: float) -> DataFrame:
    """by, low, high of groups with a column of values for each name: rounds are dealt to tasks, not groups."""
    kind = sides.schema["by"].dataType.simpleString()
    work = sides.select("by", *names, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1), F.lit(ROUNDS))).alias("first"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            for row in frame.itertuples(index=False):
                got = resampled([getattr(row, n) for n in names], seed, row.first, min(ROUNDS, rounds - row.first))
                yield pd.DataFrame({"by": [row.by] * len(got), "stat": got[:, 0] - (got[:, 1] if len(names) > 1 else 0.0)})

    stats = work.repartition("by", "first").mapInPandas(run, f"by {kind}, stat double")
    low, high = _bounds(rounds, level)
    ordered = stats.groupBy("by").agg(F.sort_array(F.collect_list("stat")).alias("stats"))  # a number for each round
    return ordered.select("by", F.round(F.get("stats", F.lit(low)), 6).alias("low"), F.round(F.get("stats", F.lit(high)), 6).alias("high"))


def _values(condition, value: str, most: int):
    """Values in order; more than `most` are an error."""
    held = F.sort_array(F.collect_list(F.when(condition, F.col(value).cast("double"))))
    return F.when(F.size(held) > most, F.raise_error(F.concat(F.lit("a group has more values than "), F.lit(most)))).otherwise(held)


def bootstrap_ci(df: DataFrame, by: str, value: str, seed: int = 1, rounds: int = 10_000, most: int = 1_000_000, level: float = 0.95) -> DataFrame:
    """by, n, mean, low, high: percentile interval of each group's mean from means of values drawn with the fixed
    generator, values in order of size. Groups are per-query metrics; one of more than `most` values is an error. Null
    values don't count, and a group without any has no row."""
    own = df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("by")).agg(F.count("*").alias("n"), F.round(F.avg(F.col(value).cast("double")), 6).alias("mean"), _values(F.lit(True), value, most).alias("a"))
    found = _intervals(own.select("by", "a"), ["a"], seed, rounds, level).withColumnRenamed("by", "_by")
    return own.join(found, own["by"].eqNullSafe(found["_by"])).select(F.col("by").alias(by), "n", "mean", "low", "high")


def bootstrap_delta_ci(df: DataFrame, by: str, side: str, value: str, a, b, seed: int = 1, rounds: int = 10_000, most: int = 1_000_000, level: float = 0.95) -> DataFrame:
    """by, n_a, n_b, delta, low, high: difference of the means of rows whose `side` is a and b, and the percentile interval
    of such differences, both sides drawn on their own; null bounds where a side has under two values."""
    there = F.col(value).isNotNull()
    is_a, is_b = (there & (F.col(side) == F.lit(x)) for x in (a, b))
    own = df.groupBy(F.col(by).alias("by")).agg(F.count_if(is_a).alias("n_a"), F.count_if(is_b).alias("n_b"), F.round(F.avg(F.when(is_a, F.col(value).cast("double"))) - F.avg(F.when(is_b, F.col(value).cast("double"))), 6).alias("delta"), _values(is_a, value, most).alias("a"), _values(is_b, value, most).alias("b"))
    enough = own.filter("n_a >= 2 AND n_b >= 2").select("by", "a", "b")
    found = _intervals(enough, ["a", "b"], seed, rounds, level).withColumnRenamed("by", "_by")
    return own.join(found, own["by"].eqNullSafe(found["_by"]), "left").select(F.col("by").alias(by), "n_a", "n_b", "delta", "low", "high")


def describe(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, mean, low, high, median (mean of both middle values of an even number), stdev (0 below two values)."""
    x = F.col(value).cast("double")
    return df.filter(x.isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.median(x), 6).alias("median"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 6).alias("stdev"))


def wire_tokens(*columns: str):
    """Tokens of a row as compact JSON, four bytes each."""
    return F.ceil(F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})) / 4).cast("long")


def assembly_savings(rows: DataFrame, by: str, bundle: str = "bundle_tokens", naive: str = "naive_tokens", complete: str = "complete") -> DataFrame:
    """by, n, passed (complete answers), and the median saving of those that passed."""
    saved = F.when(F.col(complete) & (F.col(naive) > 0), 1 - F.col(bundle) / F.col(naive))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(complete).alias("passed"), F.round(F.median(saved), 6).alias("median_saved"))


def verdict(n, low, high, delta, epsilon: float = 0.0):
    """directional below five samples; significant if the interval leaves out 0 and the change is large enough."""
    return F.when(n < 5, "directional").when(((low > 0) | (high < 0)) & (F.abs(delta) > epsilon), "significant").otherwise("not significant")


def curation(df: DataFrame, score: str = "score", label: str = "label", drop_below: float = 3.0) -> DataFrame:
    """accuracy, false_positive_rate, false_negatives and how far the classes' mean scores lie apart; rows without score
    are neither."""
    kept, good = F.col(score) >= drop_below, F.col(label) == "relevant"
    x = df.filter(F.col(score).isNotNull())
    return x.agg(F.round(F.avg((kept == good).cast("double")), 6).alias("accuracy"), F.round(F.try_divide(F.count_if(kept & ~good), F.count_if(~good)), 6).alias("false_positive_rate"), F.count_if(~kept & good).alias("false_negatives"), F.round(F.avg(F.when(good, F.col(score))) - F.avg(F.when(~good, F.col(score))), 6).alias("separation"))


def leakage(ranked: DataFrame, owner: DataFrame, k: int = 5) -> DataFrame:
    """queries and leaking queries: those whose first k hold a document of another project. owner: doc_id, project;
    ranked also has the query's project."""
    hit = ranked.filter(F.col("rank") <= k).join(owner.withColumnRenamed("project", "of"), "doc_id")
    return hit.groupBy("query_id").agg(F.max((F.col("project") != F.col("of")).cast("int")).alias("x")).agg(F.count("*").alias("queries"), F.sum("x").alias("leaking"))
