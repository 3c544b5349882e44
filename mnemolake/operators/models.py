"""Steps with an injected model: reranking of candidates, summaries of groups level by level.

A model is a function that `load` makes where it runs, so weights aren't sent with the plan; each Python worker loads it
once. Calls get batches of bounded size, and a call that fails costs its own rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake import session

#: Scores pairs of a query and a passage; higher is better, within a query.
Scorer = Callable[[list[tuple[str, str]]], list[float]]
#: Makes one text of several: topic, texts joined -> summary.
Reducer = Callable[[str, str], str]
POOL, BATCH = 60, 64
_LOADED: dict[str, Callable] = {}


def _model(name: str, load: Callable[[], Callable]) -> Callable:
    """The model of a name, loaded once a worker."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def score_pairs(pairs: DataFrame, load: Callable[[], Scorer], name: str, query: str = "query", passage: str = "passage", batch: int = BATCH) -> DataFrame:
    """The rows with a column logit: the model's score of query and passage, null where the model fails.

    Pairs are scored in batches of `batch`, whatever queries they belong to; a null text counts as empty."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)

    def run(frames) -> Iterator:
        import numpy as np

        for frame in frames:
            logits = np.full(len(frame), np.nan)
            both = list(zip(frame[query].fillna(""), frame[passage].fillna("")))
            for at in range(0, len(both), batch):
                some = both[at : at + batch]
                try:
                    told = [float(x) for x in _model(name, load)(some)]
                except Exception:  # the model's own failure, of whatever kind
                    continue
                if len(told) == len(some):
                    logits[at : at + batch] = told
            yield frame.assign(logit=logits)

    scored = pairs.mapInPandas(run, f"{kinds}, logit double")
    return scored.withColumn("logit", F.when(~F.isnan("logit"), F.col("logit")))


def rerank(candidates: DataFrame, load: Callable[[], Scorer], name: str, k: int = 10, pool: int = POOL, margin: float | None = None, batch: int = BATCH, id_col: str = "doc_id") -> DataFrame:
    """query_id, id, score, logit, rank: candidates (query_id, query, id, passage, score, rank) in the order of the model.

    The first `pool` candidates of a query, k at least, are scored; equal logits keep their order. With `margin`, what is
    more than that below the query's best goes. A query of which some pair couldn't be scored keeps its first order, with
    null logits and nothing dropped."""
    some = candidates.filter(F.col("rank") <= max(pool, k)).select("query_id", "query", id_col, "passage", "score", F.col("rank").alias("before"))
    scored = score_pairs(some, load, name, batch=batch).drop("query", "passage")
    own = Window.partitionBy("query_id")
    scored = scored.withColumn("best", F.when(F.count("*").over(own) == F.count("logit").over(own), F.max("logit").over(own)))
    scored = scored.withColumn("logit", F.when(F.col("best").isNotNull(), F.col("logit")))
    if margin is not None:
        scored = scored.filter(F.col("best").isNull() | (F.col("logit") >= F.col("best") - margin))
    place = F.row_number().over(own.orderBy(F.desc("logit"), "before", id_col))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", id_col, "score", "logit", "rank")


#: Places of notes that are reduced together at the first level, and by how much that grows from level to level.
WIDTH, GROWTH = 1024, 8


def reduce_notes(notes: DataFrame, load: Callable[[], Reducer], name: str, most: int = 12_000, topic: str = "topic", order: str = "ordinal", text: str = "text", width: int = WIDTH) -> DataFrame:
    """topic, summary, truncated, levels: the notes of each topic reduced, level by level, until one text is left.

    Notes in order of `order`, a whole number from 0 on, are packed as long as their lengths together stay within `most`
    characters; a longer one is cut there, and `truncated` says so. Each pack is one call of the model. What the calls
    give are the notes of the next level; of those, more than most / GROWTH characters are cut, so levels shrink and end.
    A call that fails gives the beginning of its texts.

    Packs don't cross multiples of `width` places at the first level, GROWTH times as many at the next, and so on: a task
    holds a stretch of a topic, not the topic, and packs don't depend on how rows lie in partitions. Null texts count as
    empty; a topic's notes with equal numbers are taken in order of their texts."""
    spark = notes.sparkSession
    folder, limit, n, done = session.work_folder(spark, "summaries"), max(1, most // GROWTH), 0, None
    columns = "topic string, block long, place long, text string, truncated boolean"

    def reduce(frame):
        import pandas as pd

        frame = frame.sort_values(["block", "place", "text"], kind="stable")
        label, packs, size = frame["topic"].iloc[0], [], 0
        for note in frame["text"].str.slice(0, most):
            if not packs or size and size + len(note) > most:
                packs.append([])
                size = 0
            packs[-1].append(note)
            size += len(note)
        rows = []
        for i, pack in enumerate(packs):
            whole = "\n\n---\n\n".join(pack)
            try:
                told = str(_model(name, load)(label, whole))
            except Exception:  # the model's own failure, of whatever kind
                told = whole
            rows.append((label, int(frame["stretch"].iloc[0]), i, told[:limit]))
        cut = bool(frame["truncated"].any() or (frame["text"].str.len() > most).any())
        return pd.DataFrame(rows, columns=["topic", "block", "place", "text"]).assign(truncated=cut)

    at = F.col(order).cast("long")
    level = notes.select(F.col(topic).cast("string").alias("topic"), F.floor(at / width).alias("stretch"), F.lit(0).cast("long").alias("block"), at.alias("place"), F.coalesce(text, F.lit("")).alias("text"), F.lit(False).alias("truncated"))
    while True:
        path = f"{folder}/level={n}"
        level.groupBy("topic", "stretch").applyInPandas(reduce, columns).write.parquet(path)
        level, n = spark.read.schema(columns).parquet(path), n + 1
        counts = level.groupBy(F.col("topic").alias("own")).agg(F.count("*").alias("n"))
        of = lambda some: level.join(some, level["topic"].eqNullSafe(some["own"]), "left_semi")
        told = of(counts.filter("n = 1")).select("topic", F.col("text").alias("summary"), "truncated", F.lit(n).alias("levels"))
        done = told if done is None else done.unionByName(told)
        more = counts.filter("n > 1")
        if more.isEmpty():
            return done
        level = of(more).withColumn("stretch", F.floor(F.col("block") / GROWTH))
