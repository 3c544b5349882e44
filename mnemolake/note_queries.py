"""Registered queries over notes, chunks, logs and pages that are rendered from the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as T
from mnemolake.functions import urls
from mnemolake.functions import vectors as V
from mnemolake.operators import crawl, evaluate, filters, graph, hygiene, knowledge, notes, packing, store, sync, telemetry
from mnemolake.queries import _GRAPH, _edges, _nodes, _notes, _resolved, query
from mnemolake.sources import tables as sources
from mnemolake.sources.tables import table

# ---- documents as notes of a vault ----
_PATHS = "v AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'RESEARCH/' || source || '/d' || doc_id || '.md' WHEN 1 THEN 'PROJECTS/' || source || '/d' || doc_id || '.md' WHEN 2 THEN source || '/d' || doc_id || '.md' ELSE 'd' || doc_id || '.md' END AS path FROM documents)"


def _vault(spark, d) -> DataFrame:
    name = F.concat(F.lit("d"), "doc_id", F.lit(".md"))
    folder = F.concat("source", F.lit("/"))
    kind = F.col("doc_id") % 4
    path = F.when(kind == 0, F.concat(F.lit("RESEARCH/"), folder, name)).when(kind == 1, F.concat(F.lit("PROJECTS/"), folder, name)).when(kind == 2, F.concat(folder, name)).otherwise(name)
    return table(spark, d, "documents").withColumn("path", path)


@query(f"WITH {_PATHS} SELECT path FROM v WHERE starts_with(path, 'RESEARCH/')")
def section_rows(spark, d):
    return _vault(spark, d).filter(filters.in_section("path", "research")).select("path")


@query(f"WITH {_PATHS} SELECT CASE WHEN strpos(path, '/') > 1 THEN split_part(path, '/', 1) ELSE '' END AS folder, count(*) AS n FROM v GROUP BY 1")
def folder_counts(spark, d):
    return hygiene.counts(_vault(spark, d).select(filters.folder_of("path").alias("folder")), "folder")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token')")
def keyword_docs(spark, d):
    return table(spark, d, "documents").filter(filters.any_keyword("text", ["License", "TOKEN"])).select("doc_id")


@query("""SELECT page_id, CASE WHEN contains(lower(html), 'verify you are human') THEN 'verify you are human' WHEN contains(lower(html), 'subscribe to read the full') THEN 'subscribe to read the full' END AS reason
    FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Verify you are HUMAN ' || html WHEN 1 THEN html || '<p>Subscribe to read the full' ELSE html END AS html FROM pages)""")
def gated_pages(spark, d):
    kind = F.col("page_id") % 3
    p = table(spark, d, "pages").withColumn("html", F.when(kind == 0, F.concat(F.lit("Verify you are HUMAN "), "html")).when(kind == 1, F.concat("html", F.lit("<p>Subscribe to read the full"))).otherwise(F.col("html")))
    return p.withColumn("text", F.col("html")).select("page_id", filters.gated_reason("html", "text").alias("reason"))


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\x00-\x7F]') OR list_has_any(string_split_regex(lower(text), '[^\p{L}]+'), ['el', 'la', 'los', 'que', 'de', 'y', 'le', 'les', 'des', 'und', 'der', 'die'])""")
def not_english_docs(spark, d):
    return table(spark, d, "documents").filter(filters.not_english("text")).select("doc_id")


@query("""SELECT page_id, lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '\\.([A-Za-z0-9]{1,5})$', 1)) AS extension FROM pages""".replace("\\\\", "\\"))
def url_extensions(spark, d):
    return table(spark, d, "pages").select("page_id", urls.extension("url").alias("extension"))


@query("""SELECT page_id, url AS target FROM pages""")
def redirects_unwrapped(spark, d):
    p = table(spark, d, "pages").withColumn("link", F.concat(F.lit("//duck.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=x")))
    return p.select("page_id", urls.redirect_target("link").alias("target"))


_RULES = [("a", "/", False), ("a", "/1", True), ("b", "/2", False), ("b", "/2", True), ("c", "/3", False)]


@query(f"""WITH u AS (SELECT o_orderkey, ['a', 'b', 'c', 'd'][1 + o_orderkey % 4] AS host, '/' || o_orderkey AS path FROM orders), r(host, prefix, allow) AS (VALUES {", ".join(f"('{h}', '{p}', {a})" for h, p, a in _RULES)}),
    b AS (SELECT u.host || u.path AS url, max(CASE WHEN allow THEN length(prefix) END) AS yes, max(CASE WHEN NOT allow THEN length(prefix) END) AS no FROM u LEFT JOIN r ON u.host = r.host AND starts_with(path, prefix) GROUP BY 1)
    SELECT url, coalesce(yes, 0) >= coalesce(no, 0) AS allowed FROM b""")
def robots_gate(spark, d):
    o = table(spark, d, "orders").select(F.element_at(F.array(*map(F.lit, "abcd")), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("host"), F.concat(F.lit("/"), "o_orderkey").alias("path"))
    rules = spark.createDataFrame(_RULES, "host string, prefix string, allow boolean")
    return crawl.robots_gate(o.withColumn("url", F.concat("host", "path")), rules, rules)


# ---- notes with relations and observations ----
_REL = """rel AS (SELECT 'part/p' || p_partkey AS src, 'made_by' AS type, lower('BRANDS/' || split_part(p_brand, '#', 1)) AS target FROM part UNION ALL SELECT 'part/p' || p_partkey, 'relates_to', lower('TYPES/' || p_type) FROM part)"""


def _kg(spark, d):
    n = _notes(spark, d)
    return n, knowledge.relations(n), knowledge.observations(n)


@query(f"WITH {_REL} SELECT DISTINCT src, target FROM rel")
def broken_links(spark, d):
    n, relations, _ = _kg(spark, d)
    return hygiene.broken_links(relations, n)


@query(f"WITH {_REL} SELECT type, count(*) AS n FROM rel GROUP BY 1")
def relation_counts(spark, d):
    return hygiene.counts(_kg(spark, d)[1], "type")


@query("SELECT 'size' AS category, count(*) AS n FROM part")
def category_counts(spark, d):
    return hygiene.counts(_kg(spark, d)[2], "category")


@query("SELECT 'part/p' || p_partkey AS source_path, 0 AS ordinal, 'is ' || p_size || ' #part/size #fff #t' || p_size % 7 AS content FROM part WHERE p_size % 7 = 3 ORDER BY source_path, ordinal LIMIT 50")
def observations_found(spark, d):
    return knowledge.find_observations(_kg(spark, d)[2], "Size", "#t3", limit=50).select("source_path", "ordinal", "content")


@query(f"""WITH {_REL} SELECT src AS source, type, target, NULL::VARCHAR AS resolved, '' AS context, 'out' AS direction FROM rel WHERE src = 'part/p7'""")
def relations_of_note(spark, d):
    n, relations, _ = _kg(spark, d)
    return knowledge.relations_for(relations, n, "P7")


@query(f"""WITH {_GRAPH}, e AS (SELECT src, type, dst FROM resolved WHERE dst = 'nation/n3' AND src <> dst UNION ALL SELECT src, type, dst FROM resolved WHERE src = 'nation/n3')
    SELECT src AS source, type, dst AS resolved, CASE WHEN src = 'nation/n3' THEN 'out' ELSE 'in' END AS direction FROM e ORDER BY direction DESC, source, type LIMIT 200""")
def relations_both_ways(spark, d):
    found = knowledge.relations_for(_edges(spark, d).withColumn("context", F.lit("")), _nodes(spark, d), "nation/n3")
    return found.select("source", "type", "resolved", "direction")


@query(f"WITH {_GRAPH} SELECT dst AS node, count(*) AS in_degree FROM resolved GROUP BY 1")
def link_importance(spark, d):
    return graph.importance(_resolved(spark, d))


@query(f"WITH {_GRAPH} SELECT DISTINCT src, dst, type FROM resolved ORDER BY src, dst, type LIMIT 500")
def graph_page(spark, d):
    return graph.full_graph(_resolved(spark, d))


@query("""SELECT 'part/p' || p_partkey AS node, CASE WHEN p_partkey % 3 = 0 THEN 'p' || p_partkey ELSE p_name END AS title FROM part""")
def node_titles(spark, d):
    p = table(spark, d, "part")
    path = F.concat(F.lit("part/p"), "p_partkey")
    titles = p.select(path.alias("path"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("title"))
    return graph.label_titles(p.select(path.alias("node")), titles)


@query(f"""WITH {_REL}, k AS (SELECT 'category' AS kind, 'size' AS key, count(*) AS n FROM part UNION ALL SELECT 'relation', type, count(*) FROM rel GROUP BY 2 UNION ALL SELECT 'orphan', 'part/p' || p_partkey, 0 FROM part) SELECT * FROM k""")
def note_report(spark, d):
    return hygiene.report(*_kg(spark, d))


@query(f"""WITH {_REL} SELECT 'folder' AS kind, 'part' AS key, count(*) AS n FROM part UNION ALL SELECT 'category', 'size', count(*) FROM part UNION ALL SELECT 'tag', 'part/size', count(*) FROM part
    UNION ALL SELECT 'tag', 't' || p_size % 7, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'relation', type, count(*) FROM rel GROUP BY 2 UNION ALL SELECT 'chunks', '', count(*) FROM part""")
def stats_bundle(spark, d):
    n, relations, observations = _kg(spark, d)
    return store.stats(n, relations, observations, n)


@query("SELECT 'notes' AS name, count(*) AS n FROM part UNION ALL SELECT 'chunks', count(*) FROM supplier")
def health_counts(spark, d):
    return store.health(notes=_notes(spark, d), chunks=table(spark, d, "supplier"))


@query(f"""WITH {_PATHS}, m AS (SELECT path, DATE '2020-01-01' + (doc_id % 1000)::INT AS modified FROM v),
    n AS (SELECT path, row_number() OVER (ORDER BY modified DESC, path) AS n FROM m QUALIFY n <= 10)
    SELECT 'folder' AS kind, CASE WHEN strpos(path, '/') > 1 THEN split_part(path, '/', 1) ELSE '' END AS key, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'newest', path, n FROM n""")
def vault_stats(spark, d):
    return store.vault_stats(_vault(spark, d).withColumn("modified", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int"))))


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 1")
def dominant_status(spark, d):
    return store.dominant(table(spark, d, "orders"), "o_orderstatus")


@query("SELECT 'c' || c_custkey AS path FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def unenriched_notes(spark, d):
    n = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("path"), "c_custkey")
    every = lambda k, c: n.filter(F.col("c_custkey") % k == 0).select(F.col("path").alias(c))
    return store.unenriched(n, every(2, "src"), every(3, "source_path"), every(5, "path").withColumn("status", F.lit("pending"))).select("path")


@query("SELECT o_orderkey AS id, 'n' || o_custkey AS path FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def suggestions_page(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("n"), "o_custkey").alias("path"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return store.suggestions_page(s, "O").select("id", "path")


@query("SELECT DISTINCT p_name AS value FROM part UNION SELECT 'p' || p_partkey FROM part UNION SELECT DISTINCT p_type FROM part")
def completion_values(spark, d):
    p = table(spark, d, "part")
    return store.completions(p.select(F.concat(F.lit("part/p"), "p_partkey", F.lit(".md")).alias("path"), F.col("p_name").alias("title")), p.select(F.col("p_type").alias("tag")))


@query("""SELECT p_partkey, coalesce('see_also:brands/b' || p_size, '') AS relations, CASE WHEN p_size % 2 = 0 THEN 'fact:' || p_name ELSE '' END AS observations FROM part""")
def valid_proposals(spark, d):
    p = table(spark, d, "part")
    relations = F.array(F.struct(F.lit("See Also").alias("type"), F.concat(F.lit("/BRANDS/B"), "p_size", F.lit(".md#x")).alias("target")), F.struct(F.lit("uses").alias("type"), F.lit(" ").alias("target")))
    observations = F.array(F.struct(F.lit(" Fact").alias("category"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("content")))
    out = store.valid_proposals(p.select(F.col("p_partkey").alias("path"), relations.alias("relations"), observations.alias("observations")))
    joined = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), x[b])), ",")
    return out.select(F.col("path").alias("p_partkey"), joined("relations", "type", "target").alias("relations"), joined("observations", "category", "content").alias("observations"))


# ---- front matter and ages ----
_FRONT = """f AS (SELECT 'n' || o_orderkey AS path, ['hypothesis', 'confirmed', 'draft'][1 + o_orderkey % 3] AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE TIMESTAMP '2001-10-01' END AS since FROM orders)"""


def _fronted(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.element_at(F.array(*map(F.lit, ("hypothesis", "confirmed", "draft"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("---\nstatus: "), status, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('\nlast_verified: "'), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit('"'))).otherwise(""), F.lit("\n---\nbody"))
    return o.select(F.concat(F.lit("n"), "o_orderkey").alias("path"), text.alias("text"), F.lit("2001-10-01").cast("timestamp").alias("modified"))


@query(f"""WITH {_FRONT}, a AS (SELECT path, status, floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(since)) / 86400000000.0)::BIGINT AS age_days FROM f)
    SELECT * FROM a WHERE age_days >= CASE status WHEN 'hypothesis' THEN 90 WHEN 'confirmed' THEN 365 END""")
def confidence_ages(spark, d):
    return hygiene.confidence_ages(_fronted(spark, d), "2002-01-01").select("path", "status", "age_days")


@query(f"WITH {_FRONT} SELECT path FROM f WHERE status = 'hypothesis'")
def hypotheses(spark, d):
    return _fronted(spark, d).filter(notes.is_hypothesis()).select("path")


@query("""WITH x AS (SELECT 'a/n' || o_orderkey || CASE o_orderkey % 50 WHEN 0 THEN '.sync-conflict-1.md' WHEN 1 THEN '.tmp' WHEN 2 THEN ' (1).md' ELSE '.md' END AS path, o_orderkey % 50 AS k, o_orderdate AS since FROM orders)
    SELECT path, CASE WHEN k IN (0, 2) THEN 'conflict' ELSE 'temporary' END AS kind FROM x WHERE k IN (0, 2) OR k = 1 AND epoch_us(TIMESTAMP '2000-01-01') - epoch_us(since) > 3600000000""")
def conflict_files(spark, d):
    k = F.col("o_orderkey") % 50
    path = F.concat(F.lit("a/n"), "o_orderkey", F.when(k == 0, ".sync-conflict-1.md").when(k == 1, ".tmp").when(k == 2, " (1).md").otherwise(".md"))
    return hygiene.conflict_files(table(spark, d, "orders").select(path.alias("path"), F.col("o_orderdate").alias("modified")), "2000-01-01").select("path", "kind")


@query("""WITH x AS (SELECT 's' || s_suppkey AS path, s_suppkey % 28 + 1 AS day FROM supplier) SELECT path, 1 AS ordinal, 31 - day AS age_days FROM x WHERE 31 - day >= 14""")
def pending_promotions(spark, d):
    s = table(spark, d, "supplier")
    text = F.concat(F.lit("# log\n- 2020-01-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"), F.lit(" Status: PENDING idea\n- 2020-01-01 status: done"))
    return hygiene.pending_promotions(s.select(F.concat(F.lit("s"), "s_suppkey").alias("path"), text.alias("text")), "2020-01-31").select("path", "ordinal", "age_days")


@query("SELECT c_mktsegment AS g, count(*) FILTER (c_custkey % 10 = 1) AS missing, count(*) FILTER (c_custkey % 10 = 2) AS stale, count(*) FILTER (c_custkey % 10 IN (1, 2)) = 0 AS ok FROM customer GROUP BY 1")
def content_drift(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_name").alias("path"), F.col("c_name").alias("content"), "c_custkey")
    have = c.filter("c_custkey % 10 <> 1").withColumn("content", F.when(F.col("c_custkey") % 10 == 2, F.lit("old")).otherwise(F.col("content")))
    return hygiene.content_drift(c, have, "g")


@query("""SELECT c_mktsegment AS g, CASE WHEN bool_and(CASE c_custkey % 40 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END) IS NULL THEN 'unknown' WHEN bool_and(CASE c_custkey % 40 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END) THEN 'ok' ELSE 'bad' END AS state FROM customer GROUP BY 1""")
def drift_union(spark, d):
    k = F.col("c_custkey") % 40
    return telemetry.drift_union(table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), F.when(k == 0, False).when(k > 1, True).alias("ok")), "g")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'b' END AS missing FROM customer WHERE c_custkey % 4 < 2""")
def missing_keys(spark, d):
    k = F.col("c_custkey") % 4
    c = table(spark, d, "customer").select("c_custkey", F.when(k == 3, "free").otherwise("x").alias("folder"), F.when(k == 1, F.array(F.lit("a"))).when(k == 2, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("keys"))
    return filters.missing_keys(c, {"*": ["a", "b"], "free": []}).select("c_custkey", F.array_join("missing", ",").alias("missing"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'missing: a, b' WHEN 1 THEN 'missing: b' ELSE 'ok' END AS verdict FROM customer""")
def schema_verdicts(spark, d):
    k = F.col("c_custkey") % 4
    need = F.array_except(F.array(F.lit("a"), F.lit("b")), F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"))))
    return table(spark, d, "customer").select("c_custkey", notes.schema_verdict(need).alias("verdict"))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 12) AS hash FROM customer")
def query_hashes(spark, d):
    return table(spark, d, "customer").select("c_custkey", notes.query_hash(F.col("c_name")).alias("hash"))


@query("SELECT sha1(c_name) AS hash, c_mktsegment AS date, c_name || chr(9) || 'x' AS subject FROM customer WHERE c_custkey % 3 <> 0".replace("sha1(c_name)", "md5(c_name)"))
def history_rows(spark, d):
    line = F.when(F.col("c_custkey") % 3 == 0, F.lit("torn\tline")).otherwise(F.concat_ws("\t", F.md5("c_name"), "c_mktsegment", "c_name", F.lit("x")))
    return notes.history_rows(table(spark, d, "customer").select(line.alias("line")))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '# t' || chr(10) || '## A' || chr(10) || '- x' || chr(10) || '- ' || s_name || chr(10) || chr(10) || '## B' || chr(10) || 'y' WHEN 1 THEN '## A' || chr(10) || '- ' || s_name ELSE 'no' || chr(10) || chr(10) || '## A' || chr(10) || '- ' || s_name END AS text FROM supplier""")
def section_inserts(spark, d):
    k = F.col("s_suppkey") % 3
    text = F.when(k == 0, "# t\n## A\n- x\n\n## B\ny").when(k == 1, "## A").otherwise("no\n")
    return table(spark, d, "supplier").select("s_suppkey", notes.append_under_heading(text, "A", F.col("s_name")).alias("text"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'boolean' WHEN 1 THEN 'null' WHEN 2 THEN 'number' ELSE 'string' END AS kind FROM part""")
def scalar_kinds(spark, d):
    k = F.col("p_size") % 5
    return table(spark, d, "part").select("p_partkey", notes.typed_scalar(F.when(k == 0, "True").when(k == 1, "~").when(k == 2, "-3.5").when(k == 3, "3.").otherwise(F.col("p_name"))).alias("kind"))


# ---- sections of logs ----
_LOG = """l AS (SELECT 's' || s_suppkey AS path, s_suppkey % 12 AS k FROM supplier), x AS (SELECT path, k, unnest(range(0, k + 1)) AS section FROM l), y AS (SELECT path, k, section, CASE section WHEN 0 THEN 'intro' ELSE '## ' || section || chr(10) || 'done ' || section END AS content FROM x)"""


def _logs(spark, d) -> DataFrame:
    parts = F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.concat(F.lit("\n## "), i, F.lit("\ndone "), i))
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), (F.col("s_suppkey") % 12).alias("k")).select("path", F.concat(F.lit("intro"), F.when(F.col("k") > 0, F.array_join(parts, "")).otherwise("")).alias("text"))


@query(f"WITH {_LOG} SELECT path, section, content FROM y")
def log_sections(spark, d):
    return knowledge.sections(_logs(spark, d))


@query(f"WITH {_LOG} SELECT path, section, section <= k - 8 AS archived FROM y WHERE section > 0")
def log_rotation(spark, d):
    return knowledge.rotate(_logs(spark, d)).select("path", "section", "archived")


@query(f"WITH {_LOG} SELECT path, CASE WHEN k = 0 THEN 'intro' WHEN k = 1 THEN 'intro|## 1|done 1' ELSE 'done ' || k - 1 || '|## ' || k || '|done ' || k END AS lines FROM l")
def session_tails(spark, d):
    return notes.session_tail(_logs(spark, d)).select("path", F.array_join("lines", "|").alias("lines"))


# ---- chunks and passages ----
def _turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("path"), F.col("turn").cast("int").alias("ordinal"), F.col("text").alias("content"))


@query("""WITH h AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 = 1) SELECT 'c' || h.conv_id AS path, h.turn::INT AS ordinal, string_agg(c.text, chr(10) ORDER BY c.turn) AS passage FROM h JOIN conversations c ON c.conv_id = h.conv_id AND abs(c.turn - h.turn) <= 1 GROUP BY 1, 2""")
def passage_windows(spark, d):
    t = _turns(spark, d)
    return notes.passage_window(t, t.filter("ordinal % 3 = 1").select("path", "ordinal")).select("path", "ordinal", "passage")


@query("""SELECT conv_id % 5 AS query_id, 'c' || conv_id AS path, turn AS rank FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def best_chunks(spark, d):
    t = table(spark, d, "conversations").select((F.col("conv_id") % 5).alias("query_id"), F.concat(F.lit("c"), "conv_id").alias("path"), F.col("turn").alias("rank"), F.col("turn").alias("ordinal"))
    return notes.best_chunk(t).select("query_id", "path", "rank")


@query("SELECT 'part/p' || p_partkey AS path, p_name || chr(10) || substr(p_type, 1, 12) AS card FROM part")
def note_cards(spark, d):
    p = table(spark, d, "part")
    return notes.cards(p.select(F.concat(F.lit("part/p"), "p_partkey").alias("path"), F.col("p_name").alias("title"), F.col("p_type").alias("body")), 12)


@query("""WITH r AS (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT 'c' || conv_id AS path, turn::INT AS ordinal FROM r WHERE c <= 400 OR n = 1""")
def newest_lines(spark, d):
    return packing.newest_lines(_turns(spark, d), 400, text="content").select("path", "ordinal")


@query("""WITH b AS (SELECT p_brand, p_partkey, p_size, ['patterns', 'stack', 'decisions', 'goal'][1 + p_partkey % 4] AS bucket, p_partkey % 4 AS o FROM part),
    r AS (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY CASE o WHEN 3 THEN 3 ELSE o END DESC, bucket, p_partkey) AS c FROM b) SELECT p_brand, p_partkey, bucket FROM r WHERE c <= 300 OR o = 3""")
def bundle_trim(spark, d):
    bucket = F.element_at(F.array(*map(F.lit, ("patterns", "stack", "decisions", "goal"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("rank"), F.col("p_size").alias("tokens"), bucket.alias("bucket"))
    return packing.trim_bundle(rows, 300, "p_brand").select("p_brand", F.col("rank").alias("p_partkey"), "bucket")


@query("""WITH n AS (SELECT p_brand, p_partkey, p_name, p_type, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, string_agg(p_partkey || ': ' || substr(p_type, 1, (200 / n)::INT), chr(10) || chr(10) ORDER BY p_partkey) AS digest FROM n GROUP BY 1""".replace("(200 / n)::INT", "(200 // n)::INT"))
def topic_digests(spark, d):
    return packing.digest(table(spark, d, "part").select("p_brand", "p_partkey", "p_type"), 200, "p_brand", "p_partkey", "p_type")


@query("""SELECT p_brand, count(*) AS n, count(*) || ' passages, quoted as data' || chr(10) || string_agg('<passage source="' || replace(replace(p_type, '&', '&amp;'), '"', '&quot;') || '">' || p_name || '</passage>', chr(10) ORDER BY p_partkey) AS body FROM (SELECT p_brand, p_partkey, p_name, 'a&"' || p_type AS p_type FROM part) GROUP BY 1""")
def envelopes(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("rank"), F.col("p_name").alias("passage"), F.concat(F.lit('a&"'), "p_type").alias("source"))
    return packing.envelope(rows, "p_brand")


@query("SELECT sum(ceil(strlen(substr(text, 1, 200)) / 4.0))::BIGINT AS passage_tokens, sum(ceil(strlen(text) / 4.0))::BIGINT AS text_tokens, round(1 - sum(ceil(strlen(substr(text, 1, 200)) / 4.0)) / sum(ceil(strlen(text) / 4.0)), 6) AS saved FROM documents")
def passage_savings(spark, d):
    return packing.savings(table(spark, d, "documents").select("text", F.substring("text", 1, 200).alias("passage")))


@query("SELECT p_name AS name, string_agg('## ' || p_partkey || chr(10) || chr(10) || p_type, chr(10) || chr(10) ORDER BY p_partkey) AS document FROM part GROUP BY 1")
def compiled_documents(spark, d):
    return sources.compiled(table(spark, d, "part"), "p_partkey", "p_type", "p_name").withColumnRenamed("p_name", "name")


# ---- scalars ----
@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN rtrim(substr(text, 1, 100)) || '…' ELSE text END AS cut, ceil(strlen(text) / 4.0)::BIGINT AS tokens, '"' || replace(text, '"', '""') || '"' AS field,
    replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM documents""")
def text_scalars(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate("text", 100).alias("cut"), T.token_estimate("text").alias("tokens"), T.csv_field("text").alias("field"), T.escape_attribute("text").alias("escaped"))


@query("SELECT p_partkey, [p_size, p_partkey % 10, 0, 0]::VARCHAR AS key FROM part")
def version_keys(spark, d):
    p = table(spark, d, "part").select("p_partkey", T.version_key(F.concat("p_size", F.lit("."), F.col("p_partkey") % 10)).alias("key"))
    return p.select("p_partkey", F.concat(F.lit("["), F.array_join("key", ", "), F.lit("]")).alias("key"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings")
def cosine_to_first(spark, d):
    e = table(spark, d, "embeddings")
    one = e.filter("vec_id = 0").select(F.col("embedding").alias("other"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(V.cosine("embedding", "other"), 6).alias("score"))


@query("SELECT c_custkey, '[' || c_custkey || '.5,' || c_nationkey || '.25]' AS literal FROM customer")
def vector_literals(spark, d):
    vec = F.array(F.col("c_custkey") + F.lit(0.5), F.col("c_nationkey") + F.lit(0.25))
    return table(spark, d, "customer").select("c_custkey", store.vector_literal(vec).alias("literal"))


@query("""SELECT event_id, CASE WHEN v >= 1e6 THEN printf('%.1fM', round(v / 1e6, 1)) WHEN v >= 1e3 THEN printf('%.1fK', round(v / 1e3, 1)) ELSE printf('%.0f', v) END AS short FROM (SELECT event_id, (event_id * 977 + 13)::DOUBLE AS v FROM events)""")
def short_numbers(spark, d):
    v = (F.col("event_id") * 977 + 13).cast("double")
    return table(spark, d, "events").select("event_id", telemetry.short_number(v).alias("short"))


# ---- logs and telemetry ----
@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def retained_events(spark, d):
    return telemetry.retain(table(spark, d, "events"), "ts", "2024-01-31", 10).select("event_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_events(spark, d):
    return telemetry.newest(table(spark, d, "events"), 20, "ts", "event_id").select("event_id")


@query("SELECT event_type AS metric, event_id AS at, value, user_id::VARCHAR AS user FROM events WHERE value IS NOT NULL")
def otlp_values(spark, d):
    body = F.format_string('{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"%s","sum":{"dataPoints":[{"asDouble":%s,"timeUnixNano":"%s","attributes":[{"key":"user","value":{"stringValue":"%s"}}]}]}}]}]}]}', "event_type", F.col("value").cast("string"), F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    return telemetry.otlp_points(table(spark, d, "events").filter("value is not null").select(body.alias("body"))).select("metric", "at", "value", F.col("attributes")["user"].alias("user"))


@query("""WITH n AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag, l_linenumber AS expected FROM n QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) = 1)
    SELECT l_orderkey, l_linenumber, expected, l_linenumber <> expected AS mismatch FROM lineitem JOIN b USING (l_returnflag)""")
def majority_sizes(spark, d):
    return telemetry.majority_size(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag", "l_linenumber").select("l_orderkey", "l_linenumber", "expected", "mismatch")


@query("""SELECT user_id, CASE WHEN user_id % 5 = 0 THEN -1 ELSE greatest(0, epoch(TIMESTAMP '2024-01-15')::BIGINT - epoch(date_trunc('second', max(ts)))::BIGINT) END AS age FROM events GROUP BY 1""")
def daemon_ages(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("at"))
    return last.withColumn("at", F.when(F.col("user_id") % 5 != 0, F.col("at"))).select("user_id", telemetry.daemon_age("at", "2024-01-15").alias("age"))


@query("""WITH f AS (SELECT user_id AS file, max(ts) AS modified FROM events GROUP BY 1 ORDER BY modified DESC, file LIMIT 50)
    SELECT event_type AS model, count(*) AS messages, sum(event_id) ::BIGINT AS input_tokens, sum(user_id)::BIGINT AS output_tokens FROM events WHERE user_id IN (SELECT file FROM f) AND event_id % 2 = 0 GROUP BY 1""")
def transcript_usage(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("ts").alias("modified"), F.when(F.col("event_id") % 2 == 0, "assistant").otherwise("user").alias("role"), F.col("event_type").alias("model"), F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return telemetry.transcript_usage(e, 50)


@query("SELECT event_id FROM events ORDER BY coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 11 END, -1) DESC, event_id % 7 DESC, event_id LIMIT 40")
def judged_order(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 11).alias("score"), (F.col("event_id") % 7).alias("relevance"))
    return e.orderBy(*telemetry.verdict_order(), "event_id").limit(40).select("event_id")


# ---- sync and crawling ----
@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_versions(spark, d):
    return sync.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def uncovered_pages(spark, d):
    p = table(spark, d, "pages").select("page_id", F.md5(F.col("page_id").cast("string")).alias("hash"))
    return sync.uncovered(p, p.filter("page_id % 3 = 0")).select("page_id")


@query("SELECT page_id % 50 AS hash, arg_min(url, page_id) AS query, max(page_id) AS last_at, min(page_id) AS first_at FROM pages GROUP BY 1")
def upserted_pages(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 50).alias("hash"), F.col("page_id").alias("at"), F.col("url").alias("query"), F.lit("new").alias("status"), F.col("html").alias("body"))
    return sync.upsert_pages(p).select("hash", "query", "last_at", "first_at")


@query("SELECT user_id, count(*) AS attempts, CASE WHEN bool_or(event_type = 'signup') THEN 'done' WHEN count(*) >= 3 THEN 'abandoned' ELSE 'queued' END AS state FROM events GROUP BY 1")
def retry_states(spark, d):
    return crawl.retry_state(table(spark, d, "events").select("user_id", (F.col("event_type") == "signup").alias("ok")), "user_id")


@query("SELECT p_partkey, least(pow(2.0, p_size % 9), 60.0) AS wait FROM part")
def cooldowns(spark, d):
    return table(spark, d, "part").select("p_partkey", crawl.cooldown(F.col("p_size") % 9).alias("wait"))


@query("""WITH g AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type <> 'error' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1) SELECT user_id, floor(epoch(TIMESTAMP '2024-01-20')) - floor(epoch(last)) <= 86400 AS fresh FROM g""")
def cached_snapshots(spark, d):
    s = table(spark, d, "events").select("user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return crawl.cached(s, "2024-01-20", "user_id", "ts", 86400).select("user_id", "fresh")


@query("""SELECT p_brand AS topic, '- ' || p_brand || ': ' || count(*) || ' pages' || CASE WHEN bool_or(p_size = 1) THEN ' (flagged)' ELSE '' END || CASE WHEN bool_or(p_size = 2) THEN ' (consolidated)' ELSE '' END AS line FROM part GROUP BY 1""")
def topic_lines(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("topic"), (F.col("p_size") == 1).alias("flagged"), F.when(F.col("p_size") == 2, "consolidated").otherwise("open").alias("status"))
    return crawl.topic_index(p).select("topic", "line")


@query("""WITH f AS (SELECT p_brand AS topic, lower(p_type || ' ' || p_partkey % 97) AS k, min(p_partkey) AS n FROM part WHERE p_size % 3 <> 0 GROUP BY ALL), g AS (SELECT p_brand AS topic, lower(p_type || ' ' || p_partkey % 97) AS k FROM part WHERE p_size % 3 = 0)
    SELECT topic, k AS lead FROM f WHERE (topic, k) NOT IN (SELECT topic, k FROM g) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n, k) <= 5""")
def new_leads(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("position"), F.lower(F.concat("p_type", F.lit(" "), (F.col("p_partkey") % 97).cast("string"))).alias("lead"), "p_size")
    return crawl.leads(p.filter("p_size % 3 <> 0"), p.filter("p_size % 3 = 0"))


@query("""SELECT user_id AS job, count(*) AS rounds, sum(event_id)::BIGINT AS pages, CASE WHEN bool_or(event_type = 'signup') THEN 'stopped' WHEN bool_or(event_type = 'error') OR NOT bool_or(event_type = 'click') THEN 'failed' WHEN arg_max(event_id % 3, event_id) > 0 THEN 'done-partial' ELSE 'done' END AS outcome FROM events GROUP BY 1""")
def job_outcomes(spark, d):
    is_ = lambda t: F.col("event_type") == t
    return crawl.job_outcome(table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("round"), F.col("event_id").alias("pages"), is_("click").alias("useful"), is_("signup").alias("stopped"), is_("error").alias("fatal"), (F.col("event_id") % 3).alias("open")))


@query("""SELECT p_brand AS topic, count(*) AS n, CASE WHEN bool_or(p_size = 2) THEN 'skip' WHEN count(*) < 8 THEN 'wait' ELSE 'heuristic' END AS plan FROM part GROUP BY 1""")
def consolidation_plans(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_brand").alias("topic")).agg(F.count("*").alias("n"), F.when(F.bool_or(F.col("p_size") == 2), "consolidated").alias("status"))
    return crawl.consolidation_plan(t, 8).select("topic", "n", "plan")


@query("SELECT 'l' || p_partkey AS url, p_name AS title, p_type AS snippet FROM part")
def feed_items(spark, d):
    body = F.concat(F.lit("<rss><item><title><![CDATA["), "p_name", F.lit("]]></title><link>l"), "p_partkey", F.lit("</link><description>"), "p_type", F.lit("</description></item><item><title>none</title></item></rss>"))
    return sources.rss_items(table(spark, d, "part").select(body.alias("body"))).select("url", "title", "snippet")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS value FROM part")
def first_values(spark, d):
    return table(spark, d, "part").select("p_partkey", sources.first_meta(F.lit(None).cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise("  "), F.col("p_type")).alias("value"))


# ---- evaluation ----
@query("""SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high, round(median(n_chars), 6) AS median, round(coalesce(stddev_samp(n_chars), 0), 6) AS stdev FROM documents GROUP BY 1""")
def describe_lengths(spark, d):
    return evaluate.describe(table(spark, d, "documents"), "lang", "n_chars")


@query("SELECT p_partkey, ceil(strlen(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'none': NULL})) / 4.0)::BIGINT AS tokens FROM part")
def wire_cost(spark, d):
    return table(spark, d, "part").withColumn("none", F.lit(None).cast("string")).select("p_partkey", evaluate.wire_tokens("p_partkey", "p_name", "none").alias("tokens"))


@query("""WITH r AS (SELECT lang, ceil(strlen(substr(text, 1, 500)) / 4.0) AS b, ceil(strlen(text) / 4.0) AS n, doc_id % 3 <> 0 AS ok FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (ok) AS passed, round(median(1 - b / n) FILTER (ok AND n > 0), 6) AS median_saved FROM r GROUP BY 1""")
def assembly_savings(spark, d):
    r = table(spark, d, "documents").select("lang", T.token_estimate(F.substring("text", 1, 500)).alias("bundle_tokens"), T.token_estimate("text").alias("naive_tokens"), (F.col("doc_id") % 3 != 0).alias("complete"))
    return evaluate.assembly_savings(r, "lang")


@query("""WITH x AS (SELECT n_chars % 11 AS score, quality = 1 AS good FROM documents JOIN labels USING (doc_id)) SELECT round(avg(((score >= 3) = good)::INT), 6) AS accuracy, round(count(*) FILTER (score >= 3 AND NOT good) / count(*) FILTER (NOT good), 6) AS false_positive_rate, count(*) FILTER (score < 3 AND good) AS false_negatives,
    round(avg(score) FILTER (good) - avg(score) FILTER (NOT good), 6) AS separation FROM x""")
def curation_figures(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("n_chars") % 11).alias("score"), F.when(F.col("quality") == 1, "relevant").otherwise("other").alias("label"))
    return evaluate.curation(x)


@query("""WITH r AS (SELECT item_id AS q, unnest(range(0, 5)) AS i FROM benchmark) SELECT count(DISTINCT q) AS queries, count(DISTINCT q) FILTER ((q + i) % 7 <> q % 7) AS leaking FROM r WHERE i < 1 + q % 3""")
def leakage_probe(spark, d):
    r = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.sequence(F.lit(0), F.lit(4))).alias("i", "n")).filter("i < 1 + query_id % 3")
    ranked = r.select("query_id", (F.col("query_id") + F.col("i")).alias("doc_id"), (F.col("i") + 1).alias("rank"), (F.col("query_id") % 7).alias("project"))
    owner = ranked.select("doc_id", (F.col("doc_id") % 7).alias("project")).distinct()
    return evaluate.leakage(ranked, owner)


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 'directional' WHEN (p_size % 7 - 3 > 0 OR p_size % 7 - 1 < 0) AND abs(p_size % 7 - 2) > 1 THEN 'significant' ELSE 'not significant' END AS verdict FROM part")
def verdicts(spark, d):
    x = F.col("p_size") % 7
    return table(spark, d, "part").select("p_partkey", evaluate.verdict(F.col("p_size"), x - 3, x - 1, x - 2, 1).alias("verdict"))
