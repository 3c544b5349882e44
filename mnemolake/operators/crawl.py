"""Crawling as tables: robots rules, frontiers, retries, caches. Fetching itself is injected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.functions import urls


def robots_rules(files: DataFrame, agent: str = "*", host: str = "host", body: str = "body") -> DataFrame:
    """host, prefix, allow: rules of robots.txt files for an agent, else those for all agents.

    Lines of user agents that follow each other open one group; groups are numbered by running sums."""
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    each = files.select(F.col(host).alias("host"), F.posexplode(F.split(body, r"\r?\n")).alias("n", "line")).withColumn("line", line)
    field = F.lower(F.trim(F.regexp_extract("line", r"^([A-Za-z-]+)\s*:", 1)))
    value = F.trim(F.regexp_extract("line", r"^[A-Za-z-]+\s*:(.*)$", 1))
    each = each.withColumn("field", field).withColumn("value", value).filter(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host").orderBy("n")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    grouped = each.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(w))
    agents = grouped.filter("field = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    rules = grouped.filter("field <> 'user-agent'").join(agents, ["host", "group"])
    own = F.col("agent") == agent.lower()
    has_own = F.max(own.cast("int")).over(Window.partitionBy("host")) == 1
    chosen = rules.withColumn("has_own", has_own).filter(own | (F.col("agent") == "*") & ~F.col("has_own"))
    return chosen.filter("value <> ''").select("host", F.col("value").alias("prefix"), (F.col("field") == "allow").alias("allow")).distinct()


def next_frontier(links: DataFrame, seen: DataFrame, rules: list[str], per_host: int | None = None) -> DataFrame:
    """key, url: links in scope whose canonical address wasn't seen; the smallest spelling of each."""
    keyed = links.filter(urls.in_scope("url", rules)).withColumn("key", urls.canonical("url")).filter("key is not null")
    fresh = keyed.groupBy("key").agg(F.min("url").alias("url")).join(seen.select("key"), "key", "left_anti")
    if per_host is None:
        return fresh
    w = Window.partitionBy(urls.host_of("key")).orderBy("key")
    return fresh.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_host).drop("_n")


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], rules: list[str], depth: int = 2, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Pages breadth first. seeds: url; fetch: adds links (array of addresses) to url rows; keep cuts lineage after a level."""
    frontier = keep(next_frontier(seeds, seeds.select(F.lit(None).cast("string").alias("key")).limit(0), rules))
    seen, out = frontier.select("key"), None
    for level in range(depth + 1):
        pages = keep(fetch(frontier).withColumn("depth", F.lit(level)))
        out = pages if out is None else out.unionByName(pages)
        frontier = keep(next_frontier(pages.select(F.explode("links").alias("url")), seen, rules))
        seen = seen.unionByName(frontier.select("key"))
    return out


def cooldown(failures: Column, base_seconds: float = 1.0, most: float = 60.0) -> Column:
    """base * 2 ** failures, capped."""
    return F.least(base_seconds * F.pow(F.lit(2.0), failures), F.lit(most))


def retry_state(attempts: DataFrame, key: str, ok: str = "ok", limit: int = 3) -> DataFrame:
    """key, attempts, state: done after a success, abandoned after `limit` failures, else queued."""
    tried = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.bool_or(ok).alias("_ok"))
    return tried.select(key, "attempts", F.when(F.col("_ok"), "done").when(F.col("attempts") >= limit, "abandoned").otherwise("queued").alias("state"))


def cached(snapshots: DataFrame, as_of: str, key: str = "key", at: str = "at", ttl_seconds: int = 300, ok: str = "ok") -> DataFrame:
    """The latest good snapshot of each key with `fresh`: what isn't fresh is served only if a new fetch fails."""
    good = snapshots.filter(F.col(ok) & (F.col(at).cast("timestamp") <= F.lit(as_of).cast("timestamp")))
    w = Window.partitionBy(key).orderBy(F.desc(at))
    last = good.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return last.withColumn("fresh", F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp")) <= ttl_seconds)


def expansions(queries: DataFrame, key: str = "query_id", original: str = "query", more: str = "expansions", most: int = 5) -> DataFrame:
    """key, position, text: the query itself, then expansions that aren't empty, over 200 characters or repeated."""
    all_ = F.concat(F.array(F.trim(original)), F.transform(F.coalesce(more, F.array().cast("array<string>")), F.trim))
    good = F.filter(all_, lambda x: (x != "") & (F.length(x) <= 200))
    each = queries.select(key, F.posexplode(good).alias("n", "text"))
    first = each.withColumn("_d", F.row_number().over(Window.partitionBy(key, F.lower("text")).orderBy("n"))).filter("_d = 1")
    w = Window.partitionBy(key).orderBy("n")
    return first.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most).select(key, "position", "text")


def topic_index(pages: DataFrame, topic: str = "topic") -> DataFrame:
    """One line a topic: pages, whether some are flagged, whether it is consolidated."""
    out = pages.groupBy(topic).agg(F.count("*").alias("n"), F.bool_or("flagged").alias("flagged"), F.bool_or(F.col("status") == "consolidated").alias("consolidated"))
    mark = F.concat(F.when(F.col("flagged"), " (flagged)").otherwise(""), F.when(F.col("consolidated"), " (consolidated)").otherwise(""))
    return out.withColumn("line", F.concat(F.lit("- "), F.col(topic), F.lit(": "), F.col("n"), F.lit(" pages"), mark))


def leads(found: DataFrame, done: DataFrame, most: int = 5, key: str = "topic", text: str = "lead") -> DataFrame:
    """key, lead: new leads of a topic, the first spellings in order, without those that are done, `most` at most. found:
    key, position, lead; done: key, lead."""
    same = lambda df: df.withColumn("_k", F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))
    fresh = same(found).filter("_k <> ''").join(same(done).select(key, "_k").distinct(), [key, "_k"], "left_anti")
    once = fresh.groupBy(key, "_k").agg(F.min("position").alias("position"), F.min_by(text, "position").alias(text))
    w = Window.partitionBy(key).orderBy("position", "_k")
    return once.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select(key, text)


def consolidation_plan(topics: DataFrame, least: int = 2, model: bool = False):
    """What happens to a topic (status, n): nothing if it is consolidated or small, else a summary by model or by rule."""
    return topics.withColumn("plan", F.when(F.col("status") == "consolidated", "skip").when(F.col("n") < least, "wait").otherwise("model" if model else "heuristic"))


def robots_gate(urls: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """url, allowed: by the rules of hosts whose robots.txt is known; others are open."""
    from mnemolake.operators.filters import robots_allowed
    from mnemolake.operators.ranking import MOST_TERMS

    hosts = known.select("host").distinct()
    small = F.broadcast if hosts.count() <= MOST_TERMS else (lambda df: df)  # as there, hosts are of any size
    told = robots_allowed(urls, rules).join(small(hosts.withColumn("_known", F.lit(True))), "host", "left")
    return told.select("url", (F.col("allowed") | F.col("_known").isNull()).alias("allowed"))


def job_outcome(rounds: DataFrame, job: str = "job") -> DataFrame:
    """job, rounds, pages, outcome of job rounds (round, pages, useful, stopped, fatal, open): stopped before failed (a
    fatal round, or none useful) before done-partial (the last round left something open) before done."""
    total = rounds.groupBy(job).agg(F.count("*").alias("rounds"), F.sum("pages").alias("pages"), F.bool_or("stopped").alias("_s"), F.bool_or("fatal").alias("_f"), F.bool_or("useful").alias("_u"), F.max_by("open", "round").alias("_o"))
    return total.select(job, "rounds", "pages", F.when(F.col("_s"), "stopped").when(F.col("_f") | ~F.col("_u"), "failed").when(F.col("_o") > 0, "done-partial").otherwise("done").alias("outcome"))
