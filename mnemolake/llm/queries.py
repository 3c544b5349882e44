"""The registered queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import bpe, chosen_path, decontaminate, exact_dedup, fill_in_middle, license_scan, line_dedup, metric_tree, periodic_runs, secret_scan, substring_dedup, token_files, toxicity
from mnemolake.llm.common import read_table

SPEC = "byte_bpe_50k.json"
END_ID = 2
TOXIC_FROM = 0.3


def _sha(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(SPEC))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), _sha(F.col("text")).alias("decoded_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(read_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    of = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(found, lambda s: s["kind"] != "entropy")
    return secret_scan.secret_spans(read_table(spark, sf_dir, "documents")).select("doc_id", *(of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), _sha(joined(base)).alias("base_sha256"), joined(found).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), line_dedup.EDITS, points=True)
    return out.select("doc_id", "n_lines", "n_removed", _sha(F.col("kept")).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(toxicity.fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_hits")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(read_table(spark, sf_dir, "documents"), public_tokenizers.path(SPEC), END_ID))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", _sha(F.col("kept")).alias("kept_sha256"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_classes(read_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha(F.col("output")).alias("output_sha256"), _sha(F.col("restored")).alias("restored_sha256"))


def repeating(docs: DataFrame) -> DataFrame:
    """The contract's texts: where crc32(doc_id) is divisible by ten, the words from place a on repeat p of them."""
    words = F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    placed = chosen.withColumns({"n": F.size("w").cast("long"), "g": F.expr("h div 10")})
    placed = placed.withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(1, cast(n as int)), i -> element_at(w, cast(if(i - 1 < a, i, 1 + a + (i - 1 - a) % p) as int))), ' ')")
    return placed.select("doc_id", F.when(F.col("p").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(repeating(read_table(spark, sf_dir, "documents")))
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    told = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("first"), _sha(lines).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", (-F.col("first.before")).alias("start"), F.col("first.length").alias("length"), (-F.col("first.short")).alias("period"), F.expr("1000 * first.length div -first.short").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return metric_tree.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Removes the characters of [\x20\x09-\x0D].
_NORMAL = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"
#: Words between those characters.
_SPLIT = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _template_rows() -> str:
    """The templates' grams as SQL rows: gram, template, at, length, base, label."""
    k = license_scan.K
    rows = [f"('{' '.join(w[i : i + k])}', {n}, {i}, {len(w)}, {base}, '{label}')" for n, base, label, w in license_scan.templates() for i in range(len(w) - k + 1)]
    return ", ".join(rows)


ORACLE_SQL = {
    "op2_license_scan": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda p: {{'p': p - 1, 'gram': w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]}})) AS s FROM d WHERE len(w) >= 3),
        t(gram, template, pos, length, base, label) AS (VALUES {_template_rows()}),
        v AS (SELECT doc_id, template, base, label, length, pos, s.p - pos AS diagonal FROM g JOIN t ON s.gram = t.gram),
        r AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER w > CASE WHEN base THEN 0 ELSE {license_scan.NEAR} END), true)::INT AS new FROM v WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal, pos)),
        n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal, pos) AS run FROM r),
        m AS (SELECT doc_id, base, label, min(diagonal + pos) AS start, count(DISTINCT pos) / (any_value(length) - 2) AS score FROM n GROUP BY doc_id, template, run, base, label),
        k AS (SELECT * FROM m WHERE score >= CASE WHEN base THEN 1.0 ELSE {license_scan.ENOUGH} END)
        SELECT d.doc_id, len(w) AS n_words, count(k.doc_id) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
               coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, coalesce(max(score), 0)::DOUBLE AS score
        FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, len(w)
    """,
    "op3_exact_dedup": f"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, {_NORMAL} AS body FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id)
    """,
    "op9_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
        g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {substring_dedup.WINDOW - 2}), lambda p: {{'p': p, 'g': array_to_string(list_slice(w, p, p + {substring_dedup.WINDOW - 1}), ' ')}})) AS s FROM d WHERE len(w) >= {substring_dedup.WINDOW}),
        f AS (SELECT doc_id, s.p AS p, row_number() OVER (PARTITION BY s.g ORDER BY doc_id, s.p) > 1 AS late FROM g),
        r AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(p, p + {substring_dedup.WINDOW})) AS i FROM f WHERE late) GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)
    """,
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        x AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
        s AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM s
    """,
    "op13_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND len(q.e) = len(c.e) AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10
    """,
    "op10_ngram_jaccard": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
        s AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda p: array_to_string(list_slice(w, p, p + 4), ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
        k AS (SELECT doc_id, sh, min(doc_id) OVER (PARTITION BY sh) AS rep FROM s),
        x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM k WHERE doc_id = rep),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= {chosen_path.LEAST} * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        walk AS (SELECT DISTINCT a AS node, a AS there FROM e UNION SELECT node, e.b FROM walk JOIN e ON walk.there = e.a),
        c AS (SELECT node, min(there) AS low FROM walk GROUP BY 1),
        n AS (SELECT a AS node, count(*) AS links FROM e GROUP BY 1)
        SELECT doc_id, coalesce(low, rep) AS class_id, coalesce(links, 0) AS n_links, len(sh) AS n_shingles FROM k LEFT JOIN c ON c.node = rep LEFT JOIN n ON n.node = rep
    """,
}
