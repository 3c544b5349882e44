"""Registered queries of the audit, suggestions, decay and passages, over notes that are rendered from the given tables and
whose links partly resolve."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.operators import audit, knowledge, notes, packing, ranking
from mnemolake.plans import search
from mnemolake.queries import _TOKENS, query
from mnemolake.sources.tables import table

#: Notes of orders: each links to its customer's note, which is there for two of three customers, and to another order.
_NOTES = """cust AS (SELECT 'CUSTOMERS/c' || c_custkey || '.md' AS path, '# ' || c_name || chr(10) || c_mktsegment AS text, TIMESTAMP '2001-01-01' AS modified FROM customer WHERE c_custkey % 3 > 0),
    ord AS (SELECT 'ORDERS/o' || o_orderkey || '.md' AS path, '---' || chr(10) || 'status: ' || CASE o_orderkey % 4 WHEN 0 THEN 'hypothesis' WHEN 1 THEN 'confirmed' ELSE 'draft' END || chr(10) || '---' || chr(10) || '- placed_by [[c' || o_custkey || ']]' || chr(10) || 'see [[ORDERS/O' || o_orderkey + 1 || '|next]] and `[[code]]`' || CASE WHEN o_orderkey % 50 = 0 THEN chr(10) || '<<<<<<< HEAD' ELSE '' END AS text, o_orderdate::TIMESTAMP AS modified, o_orderkey, o_custkey FROM orders),
    n AS (SELECT path, text, modified FROM cust UNION ALL SELECT path, text, modified FROM ord)"""
_AS_OF = "1996-01-01"


def _notes(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 3 > 0")
    customers = c.select(F.concat(F.lit("CUSTOMERS/c"), "c_custkey", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "c_name", F.lit("\n"), "c_mktsegment").alias("text"), F.lit("2001-01-01").cast("timestamp").alias("modified"))
    key = F.col("o_orderkey")
    status = F.when(key % 4 == 0, "hypothesis").when(key % 4 == 1, "confirmed").otherwise("draft")
    text = F.concat(F.lit("---\nstatus: "), status, F.lit("\n---\n- placed_by [[c"), "o_custkey", F.lit("]]\nsee [[ORDERS/O"), (key + 1).cast("string"), F.lit("|next]] and `[[code]]`"), F.when(key % 50 == 0, "\n<<<<<<< HEAD").otherwise(""))
    # the file is small, what is made of its rows and parsed isn't
    orders = ranking.spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select(F.concat(F.lit("ORDERS/o"), "o_orderkey", F.lit(".md")).alias("path"), text.alias("text"), F.col("o_orderdate").cast("timestamp").alias("modified"))
    return customers.unionByName(orders)


_FINDINGS = f"""{_NOTES},
    age AS (SELECT path, o_orderkey % 4 AS kind, floor((epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(modified)) / 86400000000.0)::BIGINT AS days FROM ord),
    f AS (SELECT 'stale_hypothesis' AS kind, path, days::VARCHAR AS detail, days AS size FROM age WHERE kind = 0 AND days >= 90
          UNION ALL SELECT 'unverified', path, days::VARCHAR, days FROM age WHERE kind = 1 AND days >= 365
          UNION ALL SELECT 'oversized', path, ceil(strlen(text) / 4.0)::BIGINT::VARCHAR, ceil(strlen(text) / 4.0)::BIGINT FROM n WHERE ceil(strlen(text) / 4.0) > 26
          UNION ALL SELECT 'conflict_marker', path, '6', 0 FROM ord WHERE o_orderkey % 50 = 0
          UNION ALL SELECT 'schema', path, 'owner', 0 FROM ord
          UNION ALL SELECT 'broken_link', path, 'c' || o_custkey, 0 FROM ord WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 > 0)
          UNION ALL SELECT 'broken_link', path, 'ORDERS/O' || o_orderkey + 1, 0 FROM ord o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = o.o_orderkey + 1)),
    r AS (SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY size DESC, path, detail))::INT AS position, path, detail, size, count(*) OVER (PARTITION BY kind) AS total FROM f)"""


def _audit(spark, d):
    config = spark.range(1).select(F.lit('{"folders": {"*": {"required": ["status"]}, "ORDERS": {"required": ["status", "owner"]}, "CUSTOMERS": {}}}').alias("value"))
    return audit.audit(_notes(spark, d), _AS_OF, budget=26, rules=audit.schema_rules(config))


@query(f"WITH {_FINDINGS} SELECT * FROM r WHERE position <= 100")
def vault_audit(spark, d):
    return _audit(spark, d)


@query(f"""WITH {_FINDINGS}, w AS (SELECT * FROM r WHERE position = 1), s AS (
    SELECT 1 AS place, total || ' notes over the token budget (largest: ' || path || ', ' || detail || ' tokens): split or condense them' AS action FROM w WHERE kind = 'oversized'
    UNION ALL SELECT 2, total || ' broken links: mend or remove their targets' FROM w WHERE kind = 'broken_link')
    SELECT (row_number() OVER (ORDER BY place))::INT AS position, action FROM s""")
def suggested_actions(spark, d):
    return audit.suggestions(_audit(spark, d))


@query(f"""WITH {_NOTES}, age AS (SELECT path, floor((epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(modified)) / 86400000000.0)::BIGINT AS age_days FROM ord WHERE o_orderkey % 4 = 0),
    e AS (SELECT 'ORDERS/o' || o_orderkey || '.md' AS src, 'CUSTOMERS/c' || o_custkey || '.md' AS dst FROM orders WHERE o_custkey % 3 > 0 AND o_custkey IN (SELECT c_custkey FROM customer)
          UNION ALL SELECT 'ORDERS/o' || a.o_orderkey || '.md', 'ORDERS/o' || b.o_orderkey || '.md' FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1)
    SELECT path, 'stale hypothesis' AS reason, age_days FROM age WHERE age_days >= 180
    UNION ALL SELECT path, 'orphan', NULL FROM n WHERE path NOT IN (SELECT src FROM e) AND path NOT IN (SELECT dst FROM e)""")
def decaying_notes(spark, d):
    n = _notes(spark, d)
    return audit.decay(n, knowledge.relations(n), _AS_OF)


@query(f"""WITH p AS (SELECT d.doc_id, b.item_id, b.text AS query, list_filter(list_transform(string_split_regex(coalesce(d.text, ''), '\\n{{2,}}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts
               FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
    h AS (SELECT *, {_TOKENS("query")} AS terms, list_transform(parts, lambda x: len(list_filter({_TOKENS("x")}, lambda t: list_contains({_TOKENS("query")}, t)))) AS hits FROM p),
    a AS (SELECT *, list_position(hits, list_max(hits)) AS best FROM h)
    SELECT doc_id, item_id, CASE WHEN len(parts) = 0 THEN '' WHEN len(terms) = 0 THEN substr(array_to_string(list_slice(parts, 1, 2), chr(10) || chr(10)), 1, 800) WHEN length(list_extract(parts, best)) > 800 THEN substr(list_extract(parts, best), 1, 800) || '…'
           WHEN best = len(parts) OR length(list_extract(parts, best)) + 2 + length(list_extract(parts, best + 1)) > 800 THEN list_extract(parts, best) ELSE list_extract(parts, best) || chr(10) || chr(10) || list_extract(parts, best + 1) END AS passage FROM a""")
def extracted_passages(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    both = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 40).join(asked, "item_id")
    return both.select("doc_id", "item_id", packing.extract_passage(F.col("text"), F.col("query")).alias("passage"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '---' || chr(10) || 'status:' || chr(10) || '  - a' || chr(10) || '---' || chr(10) || 'body' ELSE '---' || chr(10) || CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE 'kind: note' || chr(10) END || 'status: confirmed' || chr(10) || 'n: ' || o_orderkey || chr(10) || '---' || chr(10) || 'body' END AS text,
    CASE WHEN o_orderkey % 5 = 0 THEN ['status'] ELSE []::VARCHAR[] END AS refused, CASE WHEN o_orderkey % 5 IN (0, 1) THEN ['old'] ELSE []::VARCHAR[] END AS not_found FROM orders""")
def edited_notes(spark, d):
    key = F.col("o_orderkey") % 5
    text = F.when(key == 0, "---\nstatus:\n  - a\n---\nbody").when(key == 1, "body").otherwise("---\nkind: note\nold: 1\nstatus: draft\n---\nbody")
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return notes.edit_front_matter(rows, {"status": "confirmed", "n": F.col("o_orderkey")}, ("old",)).select("o_orderkey", "text", "refused", "not_found")


_JUDGED = "j AS (SELECT o_custkey AS query_id, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 11)::DOUBLE END AS relevance, CASE WHEN o_orderkey % 8 = 0 THEN true END AS relevant FROM orders)"


@query(f"""WITH {_JUDGED}, v AS (SELECT *, coalesce(relevance, CASE WHEN relevant IS NULL THEN -1 ELSE 5 END) AS verdict, count(*) FILTER (relevance < 3) OVER (PARTITION BY query_id) AS dropped FROM j)
    SELECT query_id, key, relevance, (row_number() OVER (PARTITION BY query_id ORDER BY verdict DESC, position, key))::INT AS rank, dropped FROM v WHERE relevance IS NULL OR relevance >= 3 QUALIFY rank <= 40""")
def research_verdicts(spark, d):
    key = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), key.alias("key"), F.when(key % 4 > 0, (key % 11).cast("double")).alias("relevance"), F.when(key % 8 == 0, True).alias("relevant"), F.lit(None).cast("array<double>").alias("vec"))
    return search.judged_research(o.withColumn("position", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY key)")), near=None)
