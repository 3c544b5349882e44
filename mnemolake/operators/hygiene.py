"""Audits and reports over notes: drift, staleness, duplicates, size, links. Ages are against an explicit `as_of`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as T
from mnemolake.operators import graph


def age_days(at: str, as_of: str):
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 86_400_000_000


def drift(index: DataFrame, disk: DataFrame, key: str, *marks: str) -> DataFrame:
    """key, state: missing (on disk only), orphaned (in the index only), stale (marks differ), same."""
    same = F.lit(True)
    for m in marks:
        same = same & F.col(f"i.{m}").eqNullSafe(F.col(f"d.{m}"))
    both = index.select(key, *marks).alias("i").join(disk.select(key, *marks).alias("d"), F.col(f"i.{key}") == F.col(f"d.{key}"), "full_outer")
    state = F.when(F.col(f"i.{key}").isNull(), "missing").when(F.col(f"d.{key}").isNull(), "orphaned").when(~same, "stale").otherwise("same")
    return both.select(F.coalesce(f"i.{key}", f"d.{key}").alias(key), state.alias("state"))


def stale(notes: DataFrame, at: str, as_of: str, days: int = 180, k: int = 20, key: str = "path") -> DataFrame:
    return notes.withColumn("age_days", F.floor(age_days(at, as_of)).cast("long")).filter(F.col("age_days") >= days).orderBy(F.desc("age_days"), key).limit(k)


def cold(notes: DataFrame, events: DataFrame, key: str, at: str, as_of: str, days: int = 30) -> DataFrame:
    """Notes older than `days` without any event. None at all if there are no events: absence isn't evidence."""
    old = notes.filter(age_days(at, as_of) >= days)
    logged = events.select(F.lit(True).alias("_logged")).limit(1)
    return old.join(events.select(key).distinct(), key, "left_anti").join(logged).drop("_logged")


def oversized(docs: DataFrame, budget: int, k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k largest texts over the budget of tokens, with the true number of such texts."""
    over = docs.select(key, T.token_estimate(text).alias("tokens")).filter(F.col("tokens") > budget)
    return over.orderBy(F.desc("tokens"), key).limit(k).join(F.broadcast(over.agg(F.count("*").alias("total"))))


def broken_links(relations: DataFrame, notes: DataFrame) -> DataFrame:
    """src, target of relations without a note; templates in <> don't count."""
    edges = relations.filter(~F.col("target").rlike("[<>]")).select("src", "target", "type")
    return graph.resolve(edges, notes, "keep").join(notes.select(F.col("path").alias("dst")), "dst", "left_anti").select("src", "target").distinct()


def conflict_files(files: DataFrame, as_of: str, path: str = "path", at: str = "modified") -> DataFrame:
    """Copies that sync tools leave, and temporary files over an hour old."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    kind = F.when(name.rlike(r"(?i)\bconflict(ed)?\b|sync-conflict|\(\d+\)\.md$"), "conflict").when(name.rlike(r"(?i)\.(tmp|swp|part)$|~$") & (age_days(at, as_of) * 24 > 1), "temporary")
    return files.withColumn("kind", kind).filter("kind is not null")


def confidence_ages(notes: DataFrame, as_of: str, text: str = "text", at: str = "modified", limits: dict[str, int] | None = None) -> DataFrame:
    """Notes whose confidence is out of date: a hypothesis after 90 days, a confirmed note after 365, from last_verified,
    else from the file's time."""
    limits = limits or {"hypothesis": 90, "confirmed": 365}
    status = T.front_field(text, "status")
    since = F.coalesce(T.front_field(text, "last_verified").try_cast("timestamp"), F.col(at).cast("timestamp"))
    out = notes.withColumn("status", status).withColumn("since", since).withColumn("age_days", F.floor(age_days("since", as_of)).cast("long"))
    most = F.lit(None).cast("int")
    for name, days in limits.items():
        most = F.when(F.col("status") == name, F.lit(days)).otherwise(most)
    return out.filter(F.col("age_days") >= most)


def pending_promotions(logs: DataFrame, as_of: str, days: int = 14, text: str = "text") -> DataFrame:
    """Dated lines with `status: pending` that have waited."""
    each = logs.select("path", F.posexplode(F.split(text, "\n")).alias("ordinal", "line"))
    found = each.withColumn("at", F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("timestamp")).filter(F.col("line").rlike(r"(?i)status:\s*pending") & F.col("at").isNotNull())
    return found.withColumn("age_days", F.floor(age_days("at", as_of)).cast("long")).filter(F.col("age_days") >= days)


def counts(df: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """by, n: most frequent first."""
    out = df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)
    return out.limit(k) if k else out


def content_drift(source: DataFrame, installed: DataFrame, group: str, path: str = "path", content: str = "content") -> DataFrame:
    """group, missing, stale, ok: files of the source against installed copies by SHA-256."""
    a = source.select(group, path, F.sha2(F.col(content).cast("binary"), 256).alias("want"))
    b = installed.select(group, path, F.sha2(F.col(content).cast("binary"), 256).alias("have"))
    both = a.join(b, [group, path], "left")
    return both.groupBy(group).agg(F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("have") != F.col("want")).alias("stale")).withColumn("ok", (F.col("missing") == 0) & (F.col("stale") == 0))


def report(notes: DataFrame, relations: DataFrame, observations: DataFrame) -> DataFrame:
    """One row a finding: kind, key, n — counts by category and type, hubs and orphans."""
    resolved = graph.resolve(relations, notes)
    nodes = notes.select(F.col("path").alias("node"))
    rows = [
        counts(observations, "category").select(F.lit("category").alias("kind"), F.col("category").alias("key"), "n"),
        counts(relations, "type").select(F.lit("relation").alias("kind"), F.col("type").alias("key"), "n"),
        graph.hubs(resolved).select(F.lit("hub").alias("kind"), F.col("node").alias("key"), F.col("degree").alias("n")),
        graph.orphans(resolved, nodes).select(F.lit("orphan").alias("kind"), F.col("node").alias("key"), F.lit(0).cast("long").alias("n")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
