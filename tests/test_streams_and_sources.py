from pyspark.sql import functions as F

from mnemolake.sources import tables
from mnemolake.streaming import feeds

DATA = "/root/testdata/sf0.001"


def drain(stream, name, mode="complete"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_tumbling_windows_match_batch(spark, tmp_path):
    batch = tables.table(spark, DATA, "events")
    batch.write.parquet(str(tmp_path / "events"))
    got = drain(feeds.tumbling(feeds.events(spark, str(tmp_path / "events"), batch.schema), "1 day", "event_type"), "windows")
    want = batch.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert got.agg(F.sum("n")).first()[0] == want.agg(F.sum("n")).first()[0] and got.count() == want.count()


def test_running_fold(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("b", 2, True)], "origin string, n long, ok boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "r"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "r"))
    folded = {r.origin: (r.n, r.total) for r in drain(feeds.fold(source, "origin", "n"), "folded", "update").collect()}
    assert folded == {"a": (3, 6.0), "b": (2, 3.0)}


def test_append_log_once(spark, tmp_path):
    rows = spark.range(5)
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        feeds.append_log(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_notes_and_lines(spark, tmp_path):
    root = tmp_path / "v"
    (root / "P").mkdir(parents=True)
    (root / ".h").mkdir()
    (root / "P" / "a.md").write_text("﻿# Title\nbody")
    (root / ".h" / "b.md").write_text("x")
    (root / "c.txt").write_text("x")
    got = tables.notes(spark, str(root)).collect()
    assert [(r.path, r.title, r.body) for r in got] == [("P/a.md", "Title", "body")]
    lines = tmp_path / "q.jsonl"
    lines.write_text('# note\n\n{"query":"a","k":1}\n')
    assert [(r.query, r.k) for r in tables.json_lines(spark, str(lines), "query string, k int", ("query",)).collect()] == [("a", 1)]


def test_feeds_and_results(spark, tmp_path):
    rss = spark.createDataFrame([("<rss><item><title>T</title><link>https://a.com</link><description><![CDATA[<b>d</b>]]></description></item></rss>",)], "body string")
    assert [tuple(r) for r in tables.rss_items(rss).collect()] == [(0, "T", "https://a.com", "d")]
    page = spark.createDataFrame([('<a class="result__a" href="//d.com/l/?uddg=https%3A%2F%2Fa.com&amp;x=1"><b>A</b> b</a>',)], "html string")
    assert [tuple(r) for r in tables.result_links(page).collect()] == [(0, "https://a.com", "A b")]
    df = spark.createDataFrame([('say "x"', 1)], "a string, b int")
    tables.write_csv(df.coalesce(1), str(tmp_path / "csv"), ["a", "b"])
    assert spark.read.text(str(tmp_path / "csv")).filter("value <> '\"a\",\"b\"'").first()[0] == '"say ""x""","1"'
