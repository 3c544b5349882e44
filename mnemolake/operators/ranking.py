"""Lexical and vector ranking, fusion, boosts and diversity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake import session
from mnemolake.functions import text as T
from mnemolake.functions import vectors as V

K1, B, RRF_K, DIGITS = 1.5, 0.75, 60, 6


def top(df: DataFrame, per: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank; Spark limits each group before it shuffles."""
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Terms of queries that may travel to every worker.
MOST_TERMS = 1_000_000


#: Bytes of an input that may be dealt anew to use all cores.
SMALL_INPUT = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input dealt to all cores, which a file of few row groups would leave idle. Larger inputs stay as
    they are read: they have splits enough."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_INPUT else df


#: Bytes of an input, as its files hold it, of a part of documents that is ranked at once; parts at most.
PART_BYTES, MOST_PARTS = 4 << 20, 20_000


def by_key(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows dealt by a key to parts whose number grows with the input, so what a task holds doesn't. All that is grouped
    by the key and more afterwards stays in its part, without a further shuffle."""
    size, spark = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), df.sparkSession
    known = size < 1 << 60
    parts = -(-size // PART_BYTES) if known else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, min(parts, MOST_PARTS)), key)


def postings(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Query terms (query_id, term, asked: how many the query has); term frequencies (doc_id, length, term, tf) of documents for those terms; and each term's statistics
    with the corpus'. A document also counts for the empty term, so that one pass over the texts tells the corpus' size
    and mean length too: all that is derived from it shares the shuffle of the texts."""
    terms = queries.select(F.col("query_id"), F.explode(F.array_distinct(T.tokenize(query_text))).alias("term"))
    tokens = by_key(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))).select("doc_id", T.tokenize("text").alias("tokens"))
    small = F.broadcast if terms.count() <= MOST_TERMS else (lambda df: df)
    terms = small(terms.join(small(terms.groupBy("query_id").agg(F.count("*").alias("asked"))), "query_id"))
    asked = small(terms.select("term").unionByName(docs.sparkSession.createDataFrame([("",)], "term string")).distinct())
    each = tokens.select("doc_id", F.size("tokens").alias("length"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term"))
    counted = each.join(asked, "term", "left_semi").groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))
    stats = counted.groupBy("term").agg(F.count("*").alias("df"), F.avg("length").alias("mean"), F.sum("tf").alias("cf")).filter("cf > 0")
    corpus = stats.filter("term = ''").select(F.col("df").alias("n"), "mean")
    # one row of the corpus, and a row for each term
    return terms, counted.filter("term <> ''"), small(stats.filter("term <> ''").select("term", "df").join(F.broadcast(corpus)))


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_text: str = "query") -> DataFrame:
    """query_id, doc_id, matched (distinct terms), asked (terms of the query), score of every pair that shares a term.

    Sum over a query's distinct terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)), with
    idf = ln(1 + (n - df + .5) / (df + .5))."""
    return _pairs(*_parts(docs, queries, doc_id, text, query_text))


def _parts(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_text: str = "query") -> tuple[DataFrame, DataFrame]:
    """What each term gives to a document (doc_id, term, part), by document, and the queries' terms."""
    terms, counted, stats = postings(docs, queries, doc_id, text, query_text)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return counted.join(stats, "term").select("doc_id", "term", part.alias("part")), terms


def _pairs(parts: DataFrame, terms: DataFrame) -> DataFrame:
    return parts.join(terms, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("matched"), F.round(F.sum("part"), DIGITS).alias("score"), F.first("asked").alias("asked"))


#: Orders of a query's documents, each as a number that grows with the rank's quality; ties go by doc_id.
ORDERS = {"score": lambda score, matched, asked: score, "matched": lambda score, matched, asked: matched, "whole": lambda score, matched, asked: score + 1e6 * (matched == asked)}
#: Pairs of a row and a query whose scores a task holds at once.
CELLS = 1 << 21


def _best(parts: DataFrame, terms: DataFrame, k: int, *orders: str) -> DataFrame:
    """The pairs of _pairs() without those that can't be among a query's first k in any of the orders: a task keeps its own
    first k of each query. A common term is asked by most queries, so pairs are many times the documents; they are added
    up as arrays, and only the best leave a task. Queries with more terms than may travel give all pairs."""
    if terms.count() > MOST_TERMS:
        return _pairs(parts, terms)
    by_term = F.broadcast(terms.groupBy("term").agg(F.collect_list(F.struct("query_id", F.col("asked").cast("int").alias("asked"))).alias("asks")))
    each = parts.join(by_term, "term").select("doc_id", "part", "asks").sortWithinPartitions("doc_id")
    kinds = {"query_id": terms, "doc_id": parts}
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c, df in kinds.items()) + ", matched long, score double, asked long"
    return each.mapInArrow(_added(k, orders), schema)


def _added(k: int, orders: tuple[str, ...]):
    """Sums over the terms of each document and query, in order of documents; what a query already has k better ones of,
    of earlier documents too, is left out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known: dict = {}  # queries, by number
        floors = [np.full(0, -np.inf) for _ in orders]  # the k-th best of each query so far

        def tell(table):
            nonlocal floors
            docs = table.column("doc_id").combine_chunks().dictionary_encode("encode")
            asks = table.column("asks").combine_chunks()
            sizes = pc.list_value_length(asks).to_numpy(zero_copy_only=False)
            flat = asks.flatten()
            names = flat.field("query_id").dictionary_encode("encode")
            number = np.array([known.setdefault(v, len(known)) for v in names.dictionary.to_pylist()], np.int64)
            floors = [np.concatenate([f, np.full(len(known) - len(f), -np.inf)]) for f in floors]
            who = names.indices.to_numpy(zero_copy_only=False)
            wide = len(number)
            asked = np.zeros(wide, np.int64)
            asked[who] = flat.field("asked").to_numpy(zero_copy_only=False)
            at = docs.indices.to_numpy(zero_copy_only=False)
            part = table.column("part").to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            step = max(1, CELLS // wide)
            for first in range(0, len(docs.dictionary), step):
                begin, end = np.searchsorted(at, [first, first + step])
                n = int(at[end - 1]) - first + 1
                cell = np.repeat((at[begin:end].astype(np.int64) - first) * wide, sizes[begin:end]) + who[ends[begin] : ends[end]]
                matched = np.bincount(cell, minlength=n * wide).reshape(n, wide)
                score = np.round(np.bincount(cell, np.repeat(part[begin:end], sizes[begin:end]), n * wide).reshape(n, wide), DIGITS)
                keep = np.zeros((n, wide), bool)
                for held, order in zip(floors, orders):
                    value = np.where(matched > 0, ORDERS[order](score, matched, asked), -np.inf).astype(float)
                    open_ = np.flatnonzero((value > held[number]).any(0))  # queries that a document here may serve
                    value = value[:, open_]
                    best = np.argsort(-value, axis=0, kind="stable")[:k]  # documents ascend, so ties go by doc_id
                    top_ = np.take_along_axis(value, best, 0)
                    keep[best, open_] |= top_ > held[number[open_]]
                    if n >= k:
                        held[number[open_]] = np.maximum(held[number[open_]], top_[-1])
                x, y = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(y)), docs.dictionary.take(pa.array(x + first)), pa.array(matched[x, y], pa.int64()), pa.array(score[x, y]), pa.array(asked[y])], ["query_id", "doc_id", "matched", "score", "asked"])

        waiting, pairs = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            pairs += len(batch.column("asks").flatten())
            if pairs < CELLS:
                continue
            table = pa.Table.from_batches(waiting)
            codes = table.column("doc_id").combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(codes, codes[-1]))  # the last document may go on
            if cut:
                yield from tell(table.slice(0, cut))
            waiting = table.slice(cut).combine_chunks().to_batches()
            pairs = sum(len(b.column("asks").flatten()) for b in waiting)
        if waiting:
            yield from tell(pa.Table.from_batches(waiting))

    return run


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, **columns: str) -> DataFrame:
    """query_id, doc_id, score, rank: ties by doc_id."""
    return top(_best(*_parts(docs, queries, **columns), k, "score"), ["query_id"], k, F.desc("score"), F.asc("doc_id")).select("query_id", "doc_id", "score", "rank")


def bm25_or_fallback(docs: DataFrame, queries: DataFrame, k: int = 10, **columns: str) -> DataFrame:
    """All terms must match; queries without such a document fall back to any term. `mode` tells which."""
    scored = _best(*_parts(docs, queries, **columns), k, "whole").withColumn("whole", F.col("matched") == F.col("asked"))
    # whole matches rank first, so the first k of a query tell whether it has any
    ranked = top(scored, ["query_id"], k, F.desc("whole"), F.desc("score"), F.asc("doc_id"))
    any_whole = F.max("whole").over(Window.partitionBy("query_id"))
    chosen = ranked.withColumn("any_whole", any_whole).filter(F.col("whole") | ~F.col("any_whole"))
    return chosen.select("query_id", "doc_id", "score", "rank", F.when(F.col("any_whole"), "and").otherwise("or").alias("mode"))


#: Constants of the ranking function over fields, as the engine that it stands for documents them. (Fixed values.)
FIELDS_K1, FIELDS_B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELD_WEIGHTS = {"title": 2.0, "body": 1.0}


def bm25f_scores(docs: DataFrame, queries: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", query_text: str = "query") -> DataFrame:
    """query_id, doc_id, matched, asked, score of every pair that shares a term in some field.

    A term's frequencies in the fields are weighted and added, tf = sum of weight * n, and saturate together: idf * tf *
    (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)), where length counts the words of all fields, and idf is
    ln((n - df + .5) / (df + .5)), LEAST_IDF at least. All fields are read in one pass, whose shuffle the statistics
    share, dealt by document; a null field is empty."""
    return _pairs(*_field_parts(docs, queries, weights, doc_id, query_text))


def _field_parts(docs: DataFrame, queries: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", query_text: str = "query") -> tuple[DataFrame, DataFrame]:
    weights = weights or FIELD_WEIGHTS
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokenize(query_text))).alias("term"))
    small = F.broadcast if terms.count() <= MOST_TERMS else (lambda df: df)
    terms = small(terms.join(small(terms.groupBy("query_id").agg(F.count("*").alias("asked"))), "query_id"))
    rows = by_key(docs.select(F.col(doc_id).alias("doc_id"), *(F.coalesce(F.col(f), F.lit("")).alias(f"f{i}") for i, f in enumerate(weights))))
    tokens = rows.select("doc_id", *(T.tokenize(f"f{i}").alias(f"t{i}") for i in range(len(weights))))
    length = sum((F.size(f"t{i}") for i in range(len(weights))), F.lit(0))
    # the empty term, of no weight, stands for the document
    weighted = lambda w: lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w"))
    parts = [F.transform(f"t{i}", weighted(w)) for i, w in enumerate(weights.values())]
    each = tokens.select("doc_id", length.alias("length"), F.explode(F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("w"))), *parts)).alias("x")).select("doc_id", "length", "x.*")
    asked = small(terms.select("term").unionByName(docs.sparkSession.createDataFrame([("",)], "term string")).distinct())
    counted = each.join(asked, "term", "left_semi").groupBy("doc_id", "length", "term").agg(F.sum("w").alias("tf"))
    stats = counted.groupBy("term").agg(F.count("*").alias("df"), F.avg("length").alias("mean"))
    corpus = stats.filter("term = ''").select(F.col("df").alias("n"), "mean")
    stats = small(stats.filter("term <> ''").select("term", "df").join(F.broadcast(corpus)))  # one row of the corpus
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (FIELDS_K1 + 1) / (F.col("tf") + FIELDS_K1 * (1 - FIELDS_B + FIELDS_B * F.col("length") / F.col("mean")))
    return counted.filter("term <> ''").join(stats, "term").select("doc_id", "term", part.alias("part")), terms


def bm25f_topk(docs: DataFrame, queries: DataFrame, weights: dict[str, float] | None = None, k: int = 20, doc_id: str = "doc_id", query_text: str = "query") -> DataFrame:
    """query_id, doc_id, score, rank, mode: documents with all of a query's terms in any field ("and"); of queries without
    one, those with some ("or"). Ties by doc_id."""
    scored = _best(*_field_parts(docs, queries, weights, doc_id, query_text), k, "whole").withColumn("whole", F.col("matched") == F.col("asked"))
    ranked = top(scored, ["query_id"], k, F.desc("whole"), F.desc("score"), F.asc("doc_id"))
    chosen = ranked.withColumn("any_whole", F.max("whole").over(Window.partitionBy("query_id"))).filter(F.col("whole") | ~F.col("any_whole"))
    return chosen.select("query_id", "doc_id", "score", "rank", F.when(F.col("any_whole"), "and").otherwise("or").alias("mode"))


#: Queries of a block, and bytes of all blocks that may be sent to every worker.
QUERY_BLOCK, SENT_BYTES = 4096, 64 << 20


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int = 10, group: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """corpus: id, vec; queries: query_id, vec. The k nearest by cosine, ties by id; with group the nearest of each group.

    Queries are packed in blocks of bounded size, batches of the corpus in packs, both as Arrow streams, and joined; no
    vector passes through the driver. A pack answers each query with its own best rows by a product of matrices, so few
    rows are ranked. Blocks that together have SENT_BYTES at most are broadcast, so the corpus isn't shuffled; more are
    dealt with the packs by block and slice. Ids and groups keep their types. Rows and queries without a vector, with a
    null or a component that isn't finite are left out, and a query meets vectors of its own size only."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda df, *more: df.filter((F.size("vec") > 0) & finite).select(*more, F.col("vec").cast("array<double>").alias("vec"))
    asked = whole(queries, "query_id").withColumn("dim", F.size("vec"))
    rows = spread(whole(corpus, "id", *([group] if group else [])))
    kinds = {"query_id": asked, **({group: rows} if group else {}), "id": rows}
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c, df in kinds.items()) + ", score double"
    packs = rows.mapInArrow(_packed, "dim int, held binary")
    n, most = asked.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    blocks = max(1, -(-n // block))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInArrow(_block, "dim int, block int, asked binary")
    if 8 * n * most <= SENT_BYTES:
        met = packs.join(F.broadcast(packed), "dim")
    else:
        slices = packs.sparkSession.sparkContext.defaultParallelism
        dealt = packs.withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = dealt.join(packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), ["dim", "block", "slice"])
    parts = met.select("held", "asked").mapInArrow(_nearest(k, group, [*kinds, "score"]), schema)
    return top(parts, ["query_id", *([group] if group else [])], 1 if group else k, F.desc("score"), F.asc("id"))


def _stream(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as s:
        s.write(table)
    return sink.getvalue().to_pybytes()


def _packed(batches):
    """A row of each batch for each size of vector: its rows, by id."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.list_value_length(batch.column("vec"))
        for dim in pc.unique(sizes):
            own = batch.filter(pc.equal(sizes, dim)).sort_by("id")
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim.as_py()], pa.int32()), "held": pa.array([_stream(own)], pa.binary())})


def _block(table):
    import pyarrow as pa

    return pa.table({"dim": table.column("dim").slice(0, 1), "block": table.column("block").slice(0, 1), "asked": pa.array([_stream(table.select(["query_id", "vec"]))], pa.binary())})


def _opened(packed):
    """A pack's table and its vectors as unit rows."""
    import numpy as np
    import pyarrow as pa

    with pa.ipc.open_stream(pa.py_buffer(packed.as_py())) as s:
        table = s.read_all().combine_chunks()
    m = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return table, m / np.where(n > 0, n, 1)


def _nearest(k: int, group: str | None, columns: list[str]):
    """The nearest rows of each pack for each query of a block, of the whole pack or of each of its groups."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for pack, block in zip(batch.column(0), batch.column(1)):
                (held, rows), (asked, q) = _opened(pack), _opened(block)
                names = held.column(group).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if group else np.zeros(len(rows), int)
                groups = [np.flatnonzero(names == name) for name in np.unique(names)]
                step = max(1, CELLS // len(rows))
                for first in range(0, len(q), step):  # some queries at a time, so the products stay small
                    score = np.round(q[first : first + step] @ rows.T, DIGITS)
                    for own in groups:
                        some = score[:, own] if len(groups) > 1 else score
                        n = min(1 if group else k, len(own))
                        who, at = np.nonzero(some >= np.partition(some, len(own) - n, axis=1)[:, [len(own) - n]])
                        order = np.lexsort((at, -some[who, at], who))  # ids ascend, so ties go by id
                        who, at = who[order], at[order]
                        first_n = np.arange(len(who)) - np.searchsorted(who, who) < n
                        who, at = who[first_n], own[at[first_n]]
                        found = {c: (asked if c == "query_id" else held).column(c).combine_chunks().take(pa.array(who + first if c == "query_id" else at)) for c in columns[:-1]}
                        yield pa.RecordBatch.from_arrays([*found.values(), pa.array(score[who, at])], columns)

    return run


def rrf(lists: list[DataFrame], weights: list[float] | None = None, keys: tuple[str, str] = ("query_id", "doc_id"), k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of rankings with column `rank`: sum of weight / (60 + rank), ties by key. found_by counts
    the lists."""
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("there must be a weight for each list")
    parts = None
    for one, weight in zip(lists, weights):
        part = one.select(*keys, (F.lit(float(weight)) / (RRF_K + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy(*keys).agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("found_by"))
    return top(fused, [keys[0]], k or 1_000_000_000, F.desc("score"), F.asc(keys[1]))


def bm25_rrf(docs: DataFrame, queries: DataFrame, pool: int = 20, weights: tuple[float, float] = (1.0, 0.5), k: int = 10, **columns: str) -> DataFrame:
    """query_id, doc_id, score, found_by, rank: the fusion of a query's first `pool` documents by score and by matched
    terms. Both rankings come from one pass over the scores."""
    scored = _best(*_parts(docs, queries, **columns), pool, "score", "matched")
    both = F.explode(F.array(F.struct(F.lit(0).alias("list"), F.col("score").alias("value")), F.struct(F.lit(1).alias("list"), F.col("matched").cast("double").alias("value"))))
    listed = top(scored.select("query_id", "doc_id", both.alias("x")).select("query_id", "doc_id", "x.*"), ["query_id", "list"], pool, F.desc("value"), F.asc("doc_id"))
    part = F.when(F.col("list") == 0, F.lit(float(weights[0]))).otherwise(F.lit(float(weights[1]))) / (RRF_K + F.col("rank"))
    fused = listed.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"), F.count("*").alias("found_by"))
    return top(fused, ["query_id"], k, F.desc("score"), F.asc("doc_id"))


def recency_factor(age_days: Column, half_life_days: float) -> Column:
    """0.5 ** (age / half-life); 1 for ages in the future, and without a half-life."""
    return F.lit(1.0) if half_life_days <= 0 else F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life_days)


def importance_boost(degree: Column, most: Column, weight: float = 0.15) -> Column:
    return F.when(most > 0, 1 + weight * degree / most).otherwise(1.0)


def usage_boost(used: Column, most: Column, weight: float = 0.15) -> Column:
    return F.when(most > 0, 1 + weight * F.log1p(used) / F.log1p(most)).otherwise(1.0)


def decayed_usage(events: DataFrame, key: str, at: str, as_of: str, window_days: float = 90.0) -> DataFrame:
    """Sum over a key's events of max(0, 1 - age / window) ** 2; events of the future don't count."""
    now = F.lit(as_of).cast("timestamp")
    age = (F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / 86_400_000_000
    weight = F.pow(F.greatest(F.lit(0.0), 1 - age / window_days), F.lit(2.0))
    return events.filter(F.col(at).cast("timestamp") <= now).groupBy(key).agg(F.round(F.sum(weight), DIGITS).alias("usage"))


def host_cap(df: DataFrame, n: int, per: list[str], host: str = "host", rank: str = "rank") -> DataFrame:
    """The first n of each host of a result list (`per`) keep their order at the head, the overflow follows in order: new
    rank in `position`. Rows without a host are never overflow."""
    over = F.row_number().over(Window.partitionBy(*per, host).orderBy(rank)) > n
    out = df.withColumn("overflow", over & (F.col(host) != ""))
    return out.withColumn("position", F.row_number().over(Window.partitionBy(*per).orderBy("overflow", rank)))


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; rows without key go."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def why(lex: Column, sem: Column, graph: Column) -> Column:
    """lex, sem and graph, joined by +, of the ranks that aren't null."""
    return F.array_join(F.array_compact(F.array(F.when(lex.isNotNull(), "lex"), F.when(sem.isNotNull(), "sem"), F.when(graph.isNotNull(), "graph"))), "+")


def mmr(df: DataFrame, k: int, weight: float = 0.5, normalize: bool = True, pool: int = 50) -> DataFrame:
    """Maximal marginal relevance of query_id, id, score, vec: greedily weight * relevance - (1 - weight) * closest
    chosen cosine. Relevance is scaled to 0..1 with normalize. A pool has at most `pool` rows a query, the best ones."""
    small = top(df, ["query_id"], pool, F.desc("score"), F.asc("id")).drop("rank")

    def order(pdf):
        import numpy as np

        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        rel = pdf["score"].to_numpy(float)
        if normalize:
            span = rel.max() - rel.min()
            rel = (rel - rel.min()) / span if span > 0 else np.ones(len(rel))
        if not normalize and weight >= 1:
            return pdf.head(k).assign(rank=range(1, min(k, len(pdf)) + 1))[["query_id", "id", "rank"]]
        vec = [np.asarray(v, float) if v is not None else None for v in pdf["vec"]]
        unit = [v / n if v is not None and (n := np.linalg.norm(v)) > 0 else None for v in vec]
        near, left, chosen = np.zeros(len(pdf)), list(range(len(pdf))), []
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (round(weight * rel[i] - (1 - weight) * (near[i] if chosen else 0.0), 12), -i))
            chosen.append(best)
            left.remove(best)
            for i in left:
                if unit[i] is not None and unit[best] is not None:
                    near[i] = max(near[i], float(unit[i] @ unit[best]))
        return pdf.iloc[chosen].assign(rank=range(1, len(chosen) + 1))[["query_id", "id", "rank"]]

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("query_id", "id"))
    return small.groupBy("query_id").applyInPandas(order, f"{kinds}, rank int")


def greedy_near_dup(df: DataFrame, least: float = 0.92, block: int = 4096) -> DataFrame:
    """group, id, place: in rank order, a row goes if its cosine with a row that stays reaches `least`. Rows without a
    vector, or with a null in it, go too.

    A group is taken in blocks of `block` ranks, one after another for all groups at once: a block loses, in tasks of its
    own, what is near to a row that stayed before, and what is left of it is then looked at in order. So a task holds two
    blocks, whatever the group's size."""
    spark = df.sparkSession
    kept = df.filter(F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull()))
    folder = session.work_folder(spark, "near-duplicates")
    order = F.row_number().over(Window.partitionBy("group").orderBy("rank", "id")) - 1
    kept.select("group", "id", F.col("rank").alias("place"), F.col("vec").cast("array<double>").alias("vec"), order.alias("n")).withColumn("block", F.floor(F.col("n") / block)).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    schema = rows.schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    most = rows.agg(F.max("block")).first()[0]
    stays = None

    def unit(frame):
        import numpy as np

        m = np.stack(frame["vec"].to_numpy())
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def look(frame):
        import numpy as np

        frame = frame.sort_values("n")
        m = unit(frame)
        held, own = np.empty_like(m), []  # the first rows of held are those that stay
        for i in range(len(m)):
            if not own or (held[: len(own)] @ m[i]).max() < least:
                held[len(own)] = m[i]
                own.append(i)
        return frame.iloc[own]

    def near(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"group": [], "n": []})
        a, b = unit(left), unit(right).T
        step = max(1, CELLS // b.shape[1])
        closest = [(a[at : at + step] @ b).max(1) for at in range(0, len(a), step)]  # some rows at a time, so the products stay small
        return left[np.concatenate(closest) >= least][["group", "n"]]

    for number in range(0 if most is None else int(most) + 1):
        now = rows.filter(F.col("block") == number)
        if stays is not None:
            keys = ["group", "b"]
            before = stays.select("group", "vec", F.col("block").alias("b"))
            there = before.select(F.col("group").alias("group"), F.col("b").alias("b")).distinct()
            each = now.join(there, "group").select("group", "b", "n", "vec")
            group_type = schema["group"].dataType.simpleString()
            gone = each.groupBy(*keys).cogroup(before.groupBy(*keys)).applyInPandas(near, f"`group` {group_type}, n int").distinct()
            now = now.join(gone.select(F.col("group").alias("group"), F.col("n").alias("n")), ["group", "n"], "left_anti")
        now.groupBy("group").applyInPandas(look, kinds).write.parquet(f"{folder}/stays={number}")
        stays = spark.read.schema(schema).parquet(*(f"{folder}/stays={i}" for i in range(number + 1)))
    out = rows if stays is None else stays
    return out.select("group", "id", F.col("place").cast("long").alias("place"))


#: Rows of a block of near_pairs(), and of a part of it that meets another at once.
PAIR_BLOCK, PAIR_PART = 32_768, 2048


def near_pairs(df: DataFrame, least: float = 0.92, block: int = PAIR_BLOCK) -> DataFrame:
    """a < b, score: pairs of id, vec with cosine `least` or more, exactly. Rows are cut into blocks and each two blocks
    meet in a group of their own, where products of matrices compare them part by part: only near pairs leave it, the work
    grows with the square of the rows. A row is sent once for each block, so blocks are as large as a task may hold, but
    small inputs have enough of them to use all cores. Rows without a vector are left out; all must have one size."""
    rows = df.filter(V.norm("vec") > 0).select(F.col("id").cast("long").alias("id"), "vec")
    n = rows.count()
    wide = math.isqrt(4 * df.sparkSession.sparkContext.defaultParallelism) + 1
    blocks = max(1, -(-n // block), min(wide, -(-n // PAIR_PART)))
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "vec", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table):
        import numpy as np
        import pyarrow as pa

        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        vec = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = vec.astype(float).reshape(table.num_rows, -1)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        ids, side = table.column("id").to_numpy(), table.column("own").to_numpy()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        found = []
        for p in range(0, len(left), PAIR_PART):
            for q in range(p if i == j else 0, len(right), PAIR_PART):
                x, y = left[p : p + PAIR_PART], right[q : q + PAIR_PART]
                score = m[x] @ m[y].T
                near = np.nonzero(score >= least - 10.0**-DIGITS)  # few are left to round
                score = np.round(score[near], DIGITS)
                a, b = ids[x[near[0]]], ids[y[near[1]]]
                keep = (score >= least) & ((a < b) if i == j and p == q else True)
                a, b, score = a[keep], b[keep], score[keep]
                found.append(pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score}))
        return pa.concat_tables(found) if found else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return met.groupBy("i", "j").applyInArrow(compare, "a long, b long, score double").filter("a < b")


def mean_vectors(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Per key the L2-normalised sum of its vectors."""
    each = df.select(key, F.posexplode(vec).alias("pos", "x")).groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    out = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
    return out.select(key, V.l2_normalize("vec").alias("vec"))
