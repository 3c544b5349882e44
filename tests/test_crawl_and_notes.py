from pyspark.sql import functions as F

from mnemolake.operators import crawl, knowledge, notes


def test_robots_groups(spark):
    body = "User-agent: a\nUser-agent: *\nDisallow: /x # no\nAllow: /x/y\n\nUser-agent: me\nDisallow:\nDisallow: /z"
    files = spark.createDataFrame([("h", body)], "host string, body string")
    assert {tuple(r) for r in crawl.robots_rules(files).collect()} == {("h", "/x", False), ("h", "/x/y", True)}
    assert {tuple(r) for r in crawl.robots_rules(files, "Me").collect()} == {("h", "/z", False)}


def test_breadth_first(spark):
    web = spark.createDataFrame([("https://a.com/1", ["https://a.com/2", "https://b.com/x"]), ("https://a.com/2", ["https://a.com/3?utm_source=q", "http://www.a.com/1/"]), ("https://a.com/3", [])], "key string, links array<string>")
    got = crawl.crawl(spark.createDataFrame([("https://a.com/1",)], "url string"), lambda f: f.join(web, "key", "left"), ["a.com"], 3)
    assert sorted((r.key, r.depth) for r in got.collect()) == [("https://a.com/1", 0), ("https://a.com/2", 1), ("https://a.com/3", 2)]


def test_retries_and_cooldown(spark):
    tries = spark.createDataFrame([("a", False)] * 3 + [("b", False), ("b", True), ("c", False)], "key string, ok boolean")
    assert {r.key: r.state for r in crawl.retry_state(tries, "key").collect()} == {"a": "abandoned", "b": "done", "c": "queued"}
    assert spark.range(1).select(crawl.cooldown(F.lit(3)), crawl.cooldown(F.lit(9))).first()[:] == (8.0, 60.0)


def test_expansions(spark):
    q = spark.createDataFrame([(1, " a ", ["b", "A", "", "x" * 201, "c"])], "query_id int, query string, expansions array<string>")
    assert [(r.position, r.text) for r in crawl.expansions(q).orderBy("position").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_passages_and_cards(spark):
    chunks = spark.createDataFrame([("p", i, f"c{i}") for i in range(5)], "path string, ordinal int, content string")
    hits = spark.createDataFrame([("p", 1)], "path string, ordinal int")
    assert notes.passage_window(chunks, hits).first().passage == "c0\nc1\nc2"


def test_front_matter_and_lint(spark):
    df = spark.createDataFrame([("T \"q\"", None, "body")], "title string, status string, body string")
    assert notes.front_matter(df, ["title", "status"]).first().text == '---\ntitle: "T \\"q\\""\n---\nbody'
    obs = knowledge.observations(spark.createDataFrame([("n", "- [dec] a b\n- [decision] c d\n- [zzz] e f")], "path string, text string"))
    assert {(r.category, r.advice) for r in notes.lint(obs, {"dec": "decision"}, ["decision"]).collect()} == {("dec", "use decision"), ("zzz", "unknown category")}


def test_tail_and_candidates(spark):
    logs = spark.createDataFrame([("p", "a\n\nb\nc\nd\n")], "path string, text string")
    assert notes.session_tail(logs).first().lines == ["b", "c", "d"]
    src = spark.createDataFrame([("p", "- the build failed again\n- we decided on Spark")], "path string, text string")
    known = spark.createDataFrame([("We decided on Spark!",)], "content string")
    assert {(r.kind, r.place, r.is_known) for r in notes.candidates(src, known).collect()} == {("failure", "FAILURES", False), ("decision", "DECISIONS", True)}
