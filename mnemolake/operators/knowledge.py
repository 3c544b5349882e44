"""Relations, observations, tags and sections parsed from note texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.functions import text as T

#: `- verb [[target]] (context)` and `- [category] content`, a line each.
RELATION = r"^\s*[-*+]\s+([A-Za-z][A-Za-z0-9_-]*)\s+\[\[([^\[\]]+?)\]\]\s*(?:\(([^)]*)\))?\s*$"
OBSERVATION = r"^\s*[-*+]\s+\[(?!\[)([^\]\[]*)\]\s*(.*)$"


def without_code(text: Column) -> Column:
    """Fenced blocks and inline spans blanked."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?(```|\z)", " "), r"`[^`\n]*`", " ")


def lines(notes: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, ordinal, line."""
    return notes.select(F.col(path).alias("path"), F.posexplode(F.split(without_code(F.col(text)), "\n")).alias("ordinal", "line"))


def relations(notes: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """src, type, target, context: `- verb [[target]] (context)` lines, once for a verb and target with the first context;
    other links are relates_to unless a verb names their target."""
    each = lines(notes, path, text)
    part = lambda i: F.regexp_extract("line", RELATION, i)
    typed = each.filter(F.col("line").rlike(RELATION)).select(F.col("path").alias("src"), T.relation_verb(part(1)).alias("type"), T.normalize_target(part(2)).alias("target"), F.trim(part(3)).alias("context"), "ordinal").filter("target <> ''")
    typed = typed.groupBy("src", "type", "target").agg(F.min_by("context", "ordinal").alias("context"))
    links = notes.select(F.col(path).alias("src"), F.explode(T.link_targets(without_code(F.col(text)))).alias("target")).distinct()
    loose = links.join(typed.select("src", "target"), ["src", "target"], "left_anti").select("src", F.lit("relates_to").alias("type"), "target", F.lit("").alias("context"))
    return typed.unionByName(loose)


def observations(notes: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """source_path, ordinal, category, content, tags (lower case): `- [category] text #tag` lines; checkboxes and links
    aren't any."""
    each = lines(notes, path, text).filter(F.col("line").rlike(OBSERVATION))
    category = F.lower(F.trim(F.regexp_extract("line", OBSERVATION, 1)))
    content = F.trim(F.regexp_extract("line", OBSERVATION, 2))
    found = each.select(F.col("path").alias("source_path"), "ordinal", category.alias("category"), content.alias("content")).filter(~F.col("category").isin("", "x"))
    w = Window.partitionBy("source_path").orderBy("ordinal")
    return found.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("tags", T.tags(F.lower("content")))


def relations_for(relations: DataFrame, notes: DataFrame, note: str, direction: str = "both", scope: str | None = None, limit: int = 200) -> DataFrame:
    """source, type, target, resolved, context, direction: relations of a note (a path or a name) outwards, and of other
    notes that point to it. With a scope only those whose source lies in it."""
    from mnemolake.operators import graph
    from mnemolake.operators.filters import in_scope

    if direction not in ("out", "in", "both"):
        raise ValueError("direction is out, in or both")
    asked = relations.sparkSession.createDataFrame([(note,)], "target string")
    own = graph.resolve(asked.select(F.lit("").alias("src"), "target"), notes).select(F.col("dst").alias("note"))
    rows = graph.resolve(relations, notes, "keep").select(F.col("src").alias("source"), "type", "target", F.col("dst").alias("resolved"), "context")
    known = notes.select(F.col("path").alias("resolved"), F.lit(True).alias("known")).distinct()
    rows = rows.join(known, "resolved", "left").withColumn("resolved", F.when(F.col("known"), F.col("resolved"))).drop("known")
    # one row at most
    rows = rows.join(F.broadcast(own))
    if scope:
        rows = rows.filter(in_scope("source", scope))
    is_out = F.col("source") == F.col("note")
    found = rows.withColumn("direction", F.when(is_out, "out").when(F.col("resolved") == F.col("note"), "in")).filter(F.col("direction").isin(["out", "in"] if direction == "both" else [direction]))
    return found.orderBy(F.desc("direction"), "source", "type", "target").limit(limit).select("source", "type", "target", "resolved", "context", "direction")


def find_observations(obs: DataFrame, category: str | None = None, tag: str | None = None, scope: str | None = None, limit: int = 50) -> DataFrame:
    from mnemolake.operators.filters import in_scope

    out = obs
    if category:
        out = out.filter(F.col("category") == category.lower())
    if tag:
        out = out.filter(F.array_contains("tags", tag.removeprefix("#")))
    if scope:
        out = out.filter(in_scope("source_path", scope))
    return out.orderBy("source_path", "ordinal").limit(limit)


def tag_counts(notes: DataFrame, k: int = 25, path: str = "path", text: str = "text") -> DataFrame:
    each = notes.select(F.col(path).alias("path"), F.explode(T.tags(without_code(F.col(text)))).alias("tag"))
    return each.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def sections(notes: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, section, content: `## ` sections; what stands before the first is section 0."""
    each = notes.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("ordinal", "line"))
    w = Window.partitionBy("path").orderBy("ordinal")
    numbered = each.withColumn("section", F.sum(F.col("line").startswith("## ").cast("int")).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda s: s["line"]), "\n")
    return numbered.groupBy("path", "section").agg(joined.alias("content"))


def rotate(notes: DataFrame, keep: int = 8, **columns: str) -> DataFrame:
    """Sections of a log with `archived`: all but the newest `keep`, which come last."""
    w = Window.partitionBy("path").orderBy(F.desc("section"))
    return sections(notes, **columns).filter("section > 0").withColumn("archived", F.row_number().over(w) > keep)


def suggest_structure(notes: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, ordinal, line, suggestion: bullets with an untyped link, and plain bullets of four words or more."""
    each = lines(notes, path, text).filter(F.col("line").rlike(r"^\s*[-*]\s+\S"))
    link = F.col("line").rlike(r"\[\[") & ~F.col("line").rlike(RELATION)
    plain = ~F.col("line").rlike(r"\[") & (F.size(F.split(F.trim("line"), r"\s+")) >= 5)
    return each.withColumn("suggestion", F.when(link, "type the link").when(plain, "add a category")).filter("suggestion is not null")
