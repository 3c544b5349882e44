import math
import re
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from mnemolake.functions import text as T
from mnemolake.operators import completion, models, ranking
from mnemolake.plans import search

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def overlap():
    """A scorer: how many words of the query a passage has."""
    return lambda pairs: [float(len(set(q.split()) & set(p.split()))) for q, p in pairs]


PASSAGES = ["red fox", "blue fox runs", "red blue fox", "none", "red blue", None]


def candidates(spark):
    rows = [(q, "red blue fox", i, p, 1.0 / (i + 1), i + 1) for q in (1, 2) for i, p in enumerate(PASSAGES)]
    return spark.createDataFrame(rows, "query_id long, query string, doc_id long, passage string, score double, rank int")


@pytest.mark.parametrize("batch", [1, 2, 5, 64])
def test_rerank_is_the_same_for_any_batch(spark, batch):
    got = models.rerank(candidates(spark), overlap, "overlap", k=5, batch=batch).orderBy("query_id", "rank").collect()
    want = [(2, 3.0), (0, 2.0), (1, 2.0), (4, 2.0), (3, 0.0)]  # equal logits keep their order
    assert [(r.doc_id, r.logit) for r in got] == want * 2 and [r["rank"] for r in got] == [1, 2, 3, 4, 5] * 2


def test_rerank_pool_margin_and_failures(spark):
    c = candidates(spark)
    assert [r.doc_id for r in models.rerank(c, overlap, "overlap", k=2, pool=2).filter("query_id = 1").orderBy("rank").collect()] == [0, 1]
    assert {r.doc_id for r in models.rerank(c, overlap, "overlap", margin=1.0).collect()} == {0, 1, 2, 4}

    def brittle():
        def score(pairs):
            if any("runs" in p for _, p in pairs):
                raise RuntimeError("no model")
            return [1.0 if p == "none" else 0.0 for _, p in pairs]

        return score

    mixed = c.withColumn("passage", F.when(F.col("query_id") == 2, F.lit("none")).otherwise(F.col("passage")))
    got = models.rerank(mixed, brittle, "brittle", k=3, margin=0.5, batch=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.logit) for r in got] == [(1, 0, None), (1, 1, None), (1, 2, None), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)]
    short = models.rerank(c, lambda: lambda pairs: [1.0], "short", k=2, batch=4).orderBy("query_id", "rank").collect()
    assert [(r.doc_id, r.logit) for r in short] == [(0, None), (1, None)] * 2  # an answer of the wrong size is a failure
    assert models.rerank(c.limit(0), overlap, "overlap").count() == 0


def test_reranked_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha\nalpha beta"), (3, "alpha")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "alpha beta")], "query_id long, query string")
    got = search.reranked_search(docs, asked, lambda: lambda pairs: [float(len(p)) for _, p in pairs], "length", k=2).orderBy("rank").collect()
    assert [(r.doc_id, r.logit) for r in got] == [(1, 16.0), (2, 16.0)] or [r.doc_id for r in got][0] in (1, 2)
    assert all(r.logit is not None for r in got)


def plain_tree(texts, reduce, most):
    """The level-by-level reduction of one topic, without stretches."""
    level, cut = [t[:most] for t in texts], any(len(t) > most for t in texts)
    while True:
        packs, size = [], 0
        for t in level:
            if not packs or size and size + len(t) > most:
                packs.append([])
                size = 0
            packs[-1].append(t)
            size += len(t)
        level = [reduce("t", "\n\n---\n\n".join(p))[: most // models.GROWTH] for p in packs]
        if len(packs) == 1:
            return level[0], cut


def initials(topic, text):
    return "".join(x[:1] for x in text.split("\n\n---\n\n"))


def test_summaries_of_small_topics_follow_the_plain_tree(spark):
    texts = {"a": [f"{i} note" * (i % 4 + 1) for i in range(50)], "b": ["x" * 500], "c": ["only"], "d": ["m" * 30, "", "n" * 30]}
    rows = [(t, i, x) for t, own in texts.items() for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "topic string, ordinal long, text string").repartition(3)
    got = {r.topic: (r.summary, r.truncated) for r in models.reduce_notes(df, lambda: initials, "initials", most=80).collect()}
    assert got == {t: plain_tree(own, initials, 80) for t, own in texts.items()}


def test_large_topics_are_reduced_in_stretches_alike_for_any_partitions(spark):
    n = 5000
    df = spark.range(n).select(F.lit("t").alias("topic"), F.col("id").alias("ordinal"), F.concat(F.lit("w"), "id").alias("text"))
    held = []
    for parts in (2, 7):
        out = models.reduce_notes(df.repartition(parts), lambda: lambda t, x: x.split("\n\n---\n\n")[0] + ".." + x.split("\n\n---\n\n")[-1], "ends", most=160, width=64).collect()
        assert len(out) == 1 and out[0].levels > 2
        held.append(out[0].summary)
    assert held[0] == held[1] and held[0].startswith("w0..")

    def broken():
        raise RuntimeError

    assert models.reduce_notes(spark.createDataFrame([(None, 0, "abc"), (None, 1, None)], "topic string, ordinal long, text string"), broken, "broken").collect()[0].summary == "abc\n\n---\n\n"
    assert models.reduce_notes(df.limit(0), lambda: initials, "initials").count() == 0


NAMES = ["SQLite", "sqlite notes", "Sqlite Notes", "go", "Göteborg", "gopher", "", None, "s", "GO"]


def test_completion_of_many_prefixes(spark):
    values = spark.createDataFrame([(n, f"v:{n}") for n in NAMES] + [("go", "v:go"), ("tag", None)], "name string, shown string")
    asked = ["", "s", "SQL", "sqlite n", "g", "go", "gop", "goph", "x", "sqlite notes and more", None, "s"]
    prefixes = spark.createDataFrame([(p,) for p in asked], "prefix string")
    for k in (2, 20):
        keys, ready = completion.index(values, "name", "shown", k)
        got = {}
        for r in completion.complete(prefixes, keys, ready, k).orderBy("prefix", "rank").collect():
            got.setdefault(r.prefix, []).append(r.value)
        pairs = {(n.lower(), f"v:{n}") for n in NAMES if n} | {("tag", "tag")}
        want = {p: sorted({v for key, v in pairs if key.startswith(p.lower())})[:k] for p in asked if p is not None}
        assert got == {p: v for p, v in want.items() if v}


def test_joint_saturation_of_fields(spark):
    docs = [(1, "spark notes", "join and shuffle"), (2, None, "spark spark spark join"), (3, "other", "spark"), (4, "", None), (5, "more", "nothing here at all")]
    df = spark.createDataFrame(docs, "doc_id long, title string, body string")
    asked = spark.createDataFrame([(1, "spark join"), (2, "spark nowhere"), (3, "the")], "query_id long, query string")
    words = lambda t: [w for w in re.findall(r"[^\W_]+", (t or "").lower()) if len(w) > 1 and w not in T.STOPWORDS]
    fields = {d: (words(t), words(b)) for d, t, b in docs}
    mean = sum(len(a) + len(b) for a, b in fields.values()) / len(docs)

    def score(d, terms):
        total = 0.0
        for t in terms:
            df_ = sum(t in a + b for a, b in fields.values())
            tf = 2 * Counter(fields[d][0])[t] + Counter(fields[d][1])[t]
            idf = max(1e-6, math.log((len(docs) - df_ + 0.5) / (df_ + 0.5))) if df_ else 0
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(map(len, fields[d])) / mean)) if tf else 0
        return round(total, 6)

    got = {(r.query_id, r.doc_id): (r.score, r.mode) for r in ranking.bm25f_topk(df, asked).collect()}
    want = {(1, d): (score(d, ["spark", "join"]), "and") for d in (1, 2)} | {(2, d): (score(d, ["spark"]), "or") for d in (1, 2, 3)}
    assert got == want
