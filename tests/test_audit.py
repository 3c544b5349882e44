import json

from pyspark.sql import functions as F

from mnemolake.operators import audit, packing

FENCED = "# c\n```\n<<<<<<< not here\n[[nowhere]]\n```\ntext `[[inline]]`\n<<<<<<< HEAD\nx\n<<<<<<< again"
NOTES = [
    ("PROJECTS/a.md", "---\nstatus: hypothesis\ntags: [x]\n---\nsee [[B|label]], [[projects/C#part]], [[gone]], [[gone#x]], [[Gone]], [[<name>]] and [[dir/gone2.md]]", "2023-01-01"),
    ("PROJECTS/c.md", FENCED, "2024-01-01"),
    ("b.md", "---\nstatus: Confirmed\nlast_verified: 2022-06-01\n---\n" + "word " * 100, "2024-01-01"),
    ("SESSION_LOG.md", "x" * 1000, "2024-01-01"),
    ("RESEARCH/d.md", "---\nstatus: confirmed\nlast_verified: bad date\n---\nfine [[a]]", "2024-01-01"),
    ("e.md", None, "2024-01-01"),
]
RULES = {"folders": {"*": {"required": ["status"]}, "PROJECTS": {"required": ["status", "tags", "owner"]}, "RESEARCH": {}, "bad": 7}}


def test_whole_audit(spark):
    notes = spark.createDataFrame(NOTES, "path string, text string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    rules = audit.schema_rules(spark.createDataFrame([(json.dumps(RULES),)], "value string"))
    files = spark.createDataFrame([("x/n.sync-conflict-1.md", "2024-01-01"), ("x/y.tmp", "2023-12-01"), ("ok.md", "2024-01-01")], "path string, modified string")
    index = notes.filter("path <> 'e.md'").select("path", "modified").unionByName(spark.createDataFrame([("old.md", None)], "path string, modified timestamp"))
    found = audit.audit(notes, "2024-01-31", budget=90, log_budget=200, rules=rules, files=files, index=index)
    got = {}
    rows = found.orderBy("kind", "position").collect()
    for r in rows:
        got.setdefault(r.kind, []).append((r.path, r.detail))
    assert all(r.total == len(got[r.kind]) for r in rows)
    assert got["oversized"] == [("SESSION_LOG.md", "250"), ("b.md", "138")] and got["session_log"] == [("SESSION_LOG.md", "250")]
    assert got["conflict_marker"] == [("PROJECTS/c.md", "7")]
    assert got["stale_hypothesis"] == [("PROJECTS/a.md", "395")] and got["unverified"] == [("b.md", "609")]
    assert got["broken_link"] == [("PROJECTS/a.md", t) for t in ("Gone", "dir/gone2.md", "gone")]
    assert got["schema"] == [("PROJECTS/a.md", "owner"), ("PROJECTS/c.md", "status, tags, owner"), ("SESSION_LOG.md", "status"), ("e.md", "status")]
    assert got["conflict"] == [("x/n.sync-conflict-1.md", "")] and got["temporary"] == [("x/y.tmp", "")]
    assert got["drift"] == [("e.md", "missing"), ("old.md", "orphaned")]
    lines = [r.action for r in audit.suggestions(found.unionByName(audit.findings("cold", notes.limit(2).select("path"), "path"))).orderBy("position").collect()]
    assert [x.split(" ")[0] for x in lines] == ["SESSION_LOG.md", "2", "3", "2"] and "largest: SESSION_LOG.md, 250 tokens" in lines[1]
    assert [tuple(r) for r in audit.suggestions(found.limit(0)).collect()] == [(1, audit.NOTHING)]
    assert audit.audit(notes.limit(0), "2024-01-31").count() == 0


def test_bad_configurations_ask_for_nothing(spark):
    for text in ("", "no json", "[]", "{}", '{"folders": 3}', '{"folders": {"a": {"required": "x"}}}'):
        rules = audit.schema_rules(spark.createDataFrame([(text,)], "value string"))
        notes = spark.createDataFrame([("a/b.md", "x")], "path string, text string")
        assert audit.missing_keys(notes, rules).count() == 0
    assert audit.schema_rules(spark.createDataFrame([], "value string")).count() == 0


def test_decay_lists_hypotheses_and_orphans(spark):
    notes = spark.createDataFrame(NOTES, "path string, text string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    relations = spark.createDataFrame([("PROJECTS/a.md", "uses", "b"), ("PROJECTS/c.md", "uses", "nowhere")], "src string, type string, target string")
    got = sorted((r.path, r.reason, r.age_days) for r in audit.decay(notes, relations, "2024-01-31").collect())
    assert got[0] == ("PROJECTS/a.md", "stale hypothesis", 395)
    assert {p for p, reason, _ in got if reason == "orphan"} == {"PROJECTS/c.md", "RESEARCH/d.md", "SESSION_LOG.md", "e.md"}


def passage_by_hand(text, query, most):
    import re

    from mnemolake.functions import text as T

    words = lambda t: [w for w in re.findall(r"[^\W_]+", t.lower()) if len(w) > 1 and w not in T.STOPWORDS]
    parts, terms = [p for p in (x.strip() for x in re.split(r"\n{2,}", text)) if p], set(words(query))
    if not parts:
        return ""
    if not terms:
        return "\n\n".join(parts[:2])[:most]
    hits = [sum(w in terms for w in words(p)) for p in parts]
    best = hits.index(max(hits)) if any(hits) else 0
    out = ""
    for p in parts[best : best + 2]:
        longer = f"{out}\n\n{p}" if out else p
        if len(longer) > most:
            return out or p[:most] + "…"
        out = longer
    return out


def test_passages_by_paragraphs_and_occurrences(spark):
    texts = ["first one\n\nspark spark\nspark\n\n after it \n\nlast", "alpha beta\n\nspark\n\nspark spark", "nothing\n\nhere\n\nat all", "x" * 100 + " spark", "spark\n\n" + "y" * 90, "", None, "\n\n \n\n", "one\n\n\n\nspark"]
    rows = [(i, t, q) for i, t in enumerate(texts) for q in ("spark alpha", "the", "", None)]
    df = spark.createDataFrame(rows, "k int, text string, query string")
    for r in df.select("text", "query", packing.extract_passage(F.col("text"), F.col("query"), 60).alias("p")).collect():
        assert r.p == passage_by_hand(r.text or "", r.query or "", 60), (r.text, r.query)
