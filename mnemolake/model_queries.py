"""Registered queries of fielded ranking, reranking, level-by-level summaries, completion and compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions import udfs
from mnemolake.operators import completion, models, ranking
from mnemolake.queries import _RANKED, _TOKENS, _benchmark, query
from mnemolake.sources.tables import table

_FIELDS = f"""
    q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS("text")})) AS term FROM benchmark),
    asked AS (SELECT query_id, count(*) AS asked FROM q GROUP BY 1),
    f AS (SELECT doc_id, {_TOKENS("source || ' ' || lang || ' ' || split_part(coalesce(text, ''), ' ', 1)")} AS t, {_TOKENS("coalesce(text, '')")} AS b FROM documents),
    corpus AS (SELECT count(*) AS n, avg(len(t) + len(b)) AS mean FROM f),
    e AS (SELECT doc_id, len(t) + len(b) AS length, unnest(t) AS term, 2.0::DOUBLE AS w FROM f UNION ALL SELECT doc_id, len(t) + len(b), unnest(b), 1.0::DOUBLE FROM f),
    tf AS (SELECT doc_id, length, term, sum(w) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    part AS (SELECT doc_id, term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS part FROM tf JOIN df USING (term), corpus),
    scored AS (SELECT query_id, doc_id, count(*) AS matched, round(sum(part), 6) AS score FROM part JOIN q USING (term) GROUP BY ALL),
    m AS (SELECT *, matched = asked AS whole FROM scored JOIN asked USING (query_id)),
    k AS (SELECT *, max(whole) OVER (PARTITION BY query_id) AS any_whole FROM m)
"""


def _fielded(spark, d):
    docs = table(spark, d, "documents")
    title = F.concat_ws(" ", "source", "lang", F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1)))
    return docs.select("doc_id", title.alias("title"), F.col("text").alias("body"))


@query(f"WITH {_FIELDS} SELECT query_id, doc_id, score, CASE WHEN any_whole THEN 'and' ELSE 'or' END AS mode, {_RANKED} AS rank FROM k WHERE whole OR NOT any_whole QUALIFY rank <= 20")
def bm25f_search(spark, d):
    return ranking.bm25f_topk(_fielded(spark, d), _benchmark(spark, d))


def _shared_words():
    """A model for tests of the plumbing: how many different words of a query a passage has."""
    return lambda pairs: [float(len({*q.split(" ")} & {*p.split(" ")} - {""})) for q, p in pairs]


@query(f"""WITH {_FIELDS}, pool AS (SELECT query_id, doc_id, score, {_RANKED} AS before FROM k WHERE whole OR NOT any_whole QUALIFY before <= 20),
    s AS (SELECT p.*, len(list_filter(list_intersect(list_distinct(string_split(b.text, ' ')), list_distinct(string_split(d.text, ' '))), lambda w: w <> ''))::DOUBLE AS logit FROM pool p JOIN benchmark b ON b.item_id = p.query_id JOIN documents d USING (doc_id))
    SELECT query_id, doc_id, score, logit, (row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, before))::INT AS rank FROM s QUALIFY rank <= 10""")
def reranked_hits(spark, d):
    asked, docs = _benchmark(spark, d), table(spark, d, "documents").select("doc_id", F.col("text").alias("passage"))
    hits = ranking.bm25f_topk(_fielded(spark, d), asked).join(asked, "query_id").join(docs, "doc_id")
    return models.rerank(hits, _shared_words, "shared words", k=10, pool=20)


@query()
def topic_summaries(spark, d):
    """First and last words of packs of conversations' turns, level by level, per role."""
    turns = table(spark, d, "conversations").select(F.col("role").alias("topic"), (F.col("conv_id") * 100 + F.col("turn")).alias("ordinal"), "text")
    ends = lambda: lambda topic, text: " ".join([*text.split()[:8], "…", *text.split()[-8:]])
    return models.reduce_notes(turns, ends, "ends", most=4000)


@query("""WITH v AS (SELECT DISTINCT lower(p_name) AS key, p_brand AS value FROM part WHERE p_name <> ''), p AS (SELECT DISTINCT substr(p_name, 1, n) AS prefix FROM part, (VALUES (0), (1), (2), (3), (4), (7)) t(n)),
    m AS (SELECT DISTINCT prefix, value FROM p JOIN v ON starts_with(key, lower(prefix)))
    SELECT prefix, value, (row_number() OVER (PARTITION BY prefix ORDER BY value))::INT AS rank FROM m QUALIFY rank <= 5""")
def completed_prefixes(spark, d):
    p = table(spark, d, "part")
    asked = p.select(F.explode(F.array(*(F.substring("p_name", 1, n) for n in (0, 1, 2, 3, 4, 7)))).alias("prefix"))
    keys, ready = completion.index(p, "p_name", "p_brand", 5)
    return completion.complete(asked, keys, ready, 5)


@query("""WITH x AS (SELECT event_id, replace(rpad('{"k":', 5 + (event_id % 400)::INT, ' ') || event_id || ', "t": "' || event_type || '"}', 'purchase', 'a b') AS wide FROM events),
    y AS (SELECT event_id, length(wide) - length(json(wide)) >= 200 AS changed, wide, json(wide)::VARCHAR AS short FROM x)
    SELECT event_id, changed, CASE WHEN changed THEN short ELSE wide END AS text FROM y""")
def compacted_answers(spark, d):
    e = table(spark, d, "events")
    wide = F.replace(F.concat(F.rpad(F.lit('{"k":'), (5 + F.col("event_id") % 400).cast("int"), F.lit(" ")), "event_id", F.lit(', "t": "'), "event_type", F.lit('"}')), F.lit("purchase"), F.lit("a b"))
    answer = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), wide.alias("text"))).alias("content")))
    out = e.select("event_id", udfs.compact_blocks(answer).alias("b"))
    return out.select("event_id", "b.changed", F.get_json_object("b.text", "$.content[0].text").alias("text"))
