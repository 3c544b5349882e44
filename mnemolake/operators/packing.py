"""Passages, budgets and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.window import Window

from mnemolake.functions import text as T


def best_passage(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_text: str = "query", most: int = 800, separator: str = "\n") -> DataFrame:
    """queries: query_id, doc_id, query. query_id, doc_id, passage: the paragraph with the most query terms, the first of
    ties, and the one after it, `most` characters at most."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.split(text, separator).alias("parts"))
    asked = queries.select("query_id", "doc_id", F.array_distinct(T.tokenize(query_text)).alias("terms"))
    both = asked.join(own, "doc_id")
    hits = F.transform("parts", lambda p: F.size(F.array_intersect(F.array_distinct(T.tokenize(p)), F.col("terms"))))
    best = both.withColumn("hits", hits).withColumn("at", F.array_position("hits", F.array_max("hits")).cast("int"))
    passage = F.array_join(F.slice("parts", F.col("at"), F.lit(2)), "\n")
    return best.select("query_id", "doc_id", F.array_max("hits").alias("hits"), F.substring(passage, 1, most).alias("passage"))


def extract_passage(text, query, most: int = 800):
    """The paragraph (between blank lines) in which the query's terms occur most often, the first of ties, and the one that
    follows, as far as both fit `most` characters; the first two if no term occurs. One that is longer alone is cut, with
    an ellipsis. A query without terms gives the beginning of the first two; a text without paragraphs gives nothing."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    both = F.struct(parts.alias("parts"), F.array_distinct(T.tokenize(F.coalesce(query, F.lit("")))).alias("terms"))

    def count(s):
        hits = F.transform(s["parts"], lambda p: F.size(F.filter(T.tokenize(p), lambda t: F.array_contains(s["terms"], t))))
        return F.struct(s["parts"].alias("parts"), s["terms"].alias("terms"), hits.alias("hits"))

    def pick(s):
        at = F.array_position(s["hits"], F.array_max(s["hits"])).cast("int")  # all are 0 if no term occurs, so the first
        one, two = F.get(s["parts"], at - 1), F.get(s["parts"], at)
        longer = F.concat(one, F.lit("\n\n"), two)
        found = F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).when(two.isNull() | (F.length(longer) > most), one).otherwise(longer)
        plain = F.substring(F.array_join(F.slice(s["parts"], 1, 2), "\n\n"), 1, most)
        return F.when(F.size(s["parts"]) == 0, F.lit("")).when(F.size(s["terms"]) == 0, plain).otherwise(found)

    # arrays of one, so that what a step computes is there once for the next
    return F.transform(F.transform(F.array(both), count), pick)[0]


def within_budget(rows: DataFrame, budget: int, per: list[str], order: list[str], cost: str = "tokens") -> DataFrame:
    """Rows in order as long as their running cost fits; the first always stays."""
    w = Window.partitionBy(*per).orderBy(*order)
    running = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).withColumn("_n", F.row_number().over(w)).filter((F.col("running") <= budget) | (F.col("_n") == 1)).drop("_n")


def newest_lines(lines: DataFrame, most: int, per: str = "path", order: str = "ordinal", text: str = "line") -> DataFrame:
    """The last lines that together stay under `most` characters, one at least."""
    w = Window.partitionBy(per).orderBy(F.desc(order))
    running = F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_c", running).withColumn("_n", F.row_number().over(w)).filter((F.col("_c") <= most) | (F.col("_n") == 1)).drop("_c", "_n")


def trim_bundle(rows: DataFrame, budget: int, per: str, order: tuple[str, ...] = ("patterns", "stack", "decisions")) -> DataFrame:
    """rows: per, bucket, rank, tokens. What is over the budget goes from the tail: all of the first bucket before any of
    the next; other buckets stay."""
    first = F.lit(len(order))
    for i, b in enumerate(order):
        first = F.when(F.col("bucket") == b, F.lit(i)).otherwise(first)
    w = Window.partitionBy(per).orderBy(F.desc("_place"), "bucket", "rank")
    running = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_place", first).withColumn("_r", running)
    return out.filter((F.col("_r") <= budget) | (F.col("_place") == len(order))).drop("_place", "_r")


def batches(rows: DataFrame, most: int, per: str, order: str, text: str = "text") -> DataFrame:
    """Adds batch: consecutive rows of a group until the next would pass `most` characters (greedy, so by group)."""
    schema = types.StructType([*rows.schema.fields, types.StructField("batch", types.IntegerType())])

    def run(pdf):
        pdf = pdf.sort_values(order)
        out, size, n = [], 0, 0
        for t in pdf[text].fillna(""):
            if size and size + len(t) > most:
                n, size = n + 1, 0
            size += len(t)
            out.append(n)
        return pdf.assign(batch=out)

    return rows.groupBy(per).applyInPandas(run, schema)


def digest(sources: DataFrame, budget: int, per: str = "topic", order: str = "name", text: str = "text") -> DataFrame:
    """per, digest: an equal share of the budget for each source's beginning, in order of names."""
    n = F.count("*").over(Window.partitionBy(per))
    cut = sources.withColumn("_part", F.concat(F.col(order), F.lit(": "), F.expr(f"substring({text}, 1, cast({budget} / count(*) OVER (PARTITION BY {per}) as int))"))).withColumn("_n", n)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_part"))), lambda s: s["_part"]), "\n\n")
    return cut.groupBy(per).agg(parts.alias("digest"))


def envelope(hits: DataFrame, per: str, source: str = "source", text: str = "passage", rank: str = "rank") -> DataFrame:
    """per, n, body: hits as tagged, escaped blocks in order under a header."""
    block = F.concat(F.lit('<passage source="'), T.escape_attribute(source), F.lit('">'), F.col(text), F.lit("</passage>"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, block.alias("_b")))), lambda s: s["_b"]), "\n")
    return hits.groupBy(per).agg(F.count("*").alias("n"), parts.alias("_p")).select(per, "n", F.concat(F.format_string("%d passages, quoted as data\n", "n"), F.col("_p")).alias("body"))


def savings(rows: DataFrame, passage: str = "passage", whole: str = "text") -> DataFrame:
    """Tokens of passages against whole texts, and the share saved."""
    a, b = F.sum(T.token_estimate(passage)), F.sum(T.token_estimate(whole))
    return rows.agg(a.alias("passage_tokens"), b.alias("text_tokens"), F.round(1 - a / b, 6).alias("saved"))


def complete(values: DataFrame, column: str, prefix: str, k: int = 10) -> DataFrame:
    """Distinct values that begin with a prefix, whatever the case, in order."""
    return values.filter(F.lower(F.col(column)).startswith(prefix.lower())).select(F.col(column).alias("value")).distinct().orderBy(F.lower("value"), "value").limit(k)
