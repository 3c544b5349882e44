"""What the third round of findings was about: results that differed from SQL on larger tables, and steps that grew."""

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemolake import page_queries, queries, text_queries  # noqa: F401  (register their queries)
from mnemolake.functions import udfs
from mnemolake.operators import crawl, ranking
from mnemolake.sources import tables

PAGES = [
    (1, "u", "<html><head><title>a &amp;&amp; b&amp</title></head><body><article><h1>a &amp;&amp; b&amp</h1></article></body></html>"),
    (2, "u", '<html><head><title>t = &quot;x &lt;b&gt; &amp;lt; &copy</title></head><body><article><h1>t = &quot;x &lt;b&gt; &amp;lt; &copy</h1></article></body></html>'),
    (3, "u", "<html><head></head><body><article><p>no heading</p></article></body></html>"),
    (4, "u", None),
]


def _same(spark, name, f, sql, folder):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    got = sorted((tuple(r) for r in f(spark, folder).collect()), key=repr)
    assert got == sorted(c.sql(sql[name]).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["page_meta", "selected_headings", "stripped_titles"])
def test_only_whole_references_of_the_sql_count(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    _same(spark, name, queries.QUERIES[name], queries.SQL, str(tmp_path))


def test_the_first_of_each_query_leave_a_task_whatever_the_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(w for j, w in enumerate(["red", "blue", "green", "grey", "pink"]) if (i * 7 + j * i) % (j + 2) == 0) + " x" * (i % 5)) for i in range(300)] + [(400, None), (7, "red red")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red blue"), (2, "green"), (3, "grey pink red"), (4, "none")], "query_id long, query string")
    monkeypatch.setattr(ranking, "PART_BYTES", 64)
    for cells in (1 << 21, 50):
        monkeypatch.setattr(ranking, "CELLS", cells)
        scored = ranking.bm25_scores(docs, asked)
        want = ranking.top(scored, ["query_id"], 5, F.desc("score"), F.asc("doc_id")).select("query_id", "doc_id", "score", "rank")
        assert sorted(ranking.bm25_topk(docs, asked, 5).collect()) == sorted(want.collect())
        a, b = (ranking.top(scored, ["query_id"], 5, F.desc(c), F.asc("doc_id")) for c in ("score", "matched"))
        assert sorted(ranking.bm25_rrf(docs, asked, 5, k=4).collect()) == sorted(ranking.rrf([a, b], [1.0, 0.5], k=4).select("query_id", "doc_id", "score", "found_by", "rank").collect())
        found = {r.query_id: r.mode for r in ranking.bm25_or_fallback(docs, asked, 5).collect()}
        assert found == {r.query_id: "and" if r.w else "or" for r in scored.groupBy("query_id").agg(F.bool_or(F.col("matched") == F.col("asked")).alias("w")).collect()}


def test_documents_are_dealt_to_more_parts_as_they_grow(spark, tmp_path):
    spark.range(40_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert ranking.by_key(docs).rdd.getNumPartitions() == 4  # as many as cores
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    ranking.PART_BYTES, before = size // 20, ranking.PART_BYTES
    try:
        assert ranking.by_key(docs).rdd.getNumPartitions() in (20, 21)
    finally:
        ranking.PART_BYTES = before


def test_products_of_a_block_and_a_pack_are_made_piece_by_piece(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rows = np.random.default_rng(3).normal(size=(500, 8))
    of = lambda n, name: pa.table({name: pa.array(range(n)), "vec": pa.array(list(rows[:n]))}).combine_chunks()
    batch = pa.RecordBatch.from_pydict({"held": pa.array([ranking._stream(of(500, "id"))], pa.binary()), "asked": pa.array([ranking._stream(of(90, "query_id"))], pa.binary())})
    told = lambda: pa.Table.from_batches(list(ranking._nearest(3, None, ["query_id", "id", "score"])([batch])))
    whole = told()
    monkeypatch.setattr(ranking, "CELLS", 1000)
    most = max(b.num_rows for b in ranking._nearest(3, None, ["query_id", "id", "score"])([batch]))
    assert most == 6 and told().to_pylist() == whole.to_pylist()


def test_near_pairs_send_a_row_to_few_blocks(spark, monkeypatch):
    import numpy as np

    rows = np.random.default_rng(5).normal(size=(300, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vec array<double>")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if round(float(unit[a] @ unit[b]), 6) >= 0.9}
    for part in (16, 2048):
        monkeypatch.setattr(ranking, "PAIR_PART", part)
        for block in (70, ranking.PAIR_BLOCK):
            assert {(r.a, r.b) for r in ranking.near_pairs(df, 0.9, block).collect()} == want
    assert ranking.PAIR_BLOCK >= 16 * 2048


def test_parsers_and_rules_use_all_cores(spark):
    pages = spark.range(40).coalesce(1).select(F.col("id").alias("k"), F.format_string('<li class="b_algo"><h2><a href="u%d">t</a></h2></li>', "id").alias("html"))
    assert tables.result_blocks(pages, "k").rdd.getNumPartitions() == 4
    urls = spark.createDataFrame([(f"h/{i}", "h", f"/{i}") for i in range(100)], "url string, host string, path string")
    rules = spark.createDataFrame([("h", "/1", False)], "host string, prefix string, allow boolean")
    out = crawl.robots_gate(urls, rules, rules)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.url for r in out.collect() if not r.allowed} == {f"h/{i}" for i in range(100) if str(i)[0] == "1"}


def test_a_vector_is_embedded_once_a_row(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string").select("id", udfs.embed("text").alias("vec"))
    plan = df.filter(F.size("vec") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [list(r.vec) for r in df.orderBy("id").collect()] == [udfs.hash_embedding("a b"), [0.0] * 256]
