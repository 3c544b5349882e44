"""Tables of a folder, notes, line-delimited JSON and result pages as DataFrames; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.functions import elements
from mnemolake.functions import text as text_functions
from mnemolake.operators.ranking import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without zone become timestamps (UTC), which watermarks need."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def notes(spark: SparkSession, root: str, skip: tuple[str, ...] = (), most_bytes: int = 1 << 20) -> DataFrame:
    """path (below the root), modified, size, text, title, body of Markdown files; hidden and named folders are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z0-9]+:/*", "/")
    full = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    out = files.withColumn("path", F.expr("substring(path, 1)")).withColumn("path", F.substring(full, F.length(base) + 2, F.length(full)))
    hidden = F.col("path").rlike(r"(^|/)\.[^/]+/")
    for s in skip:
        hidden = hidden | F.col("path").startswith(f"{s}/") | F.contains(F.col("path"), F.lit(f"/{s}/"))
    # bytes that aren't UTF-8 become replacement characters
    text = F.regexp_replace(F.make_valid_utf8(F.expr(f"substring(content, 1, {most_bytes})").cast("string")), "^\ufeff", "")
    out = out.filter(~hidden).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), text.alias("text"))
    return out.withColumn("title", text_functions.title_of("text")).withColumn("body", text_functions.body_of("text"))


def json_lines(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of line-delimited JSON; blank lines and # comments are skipped, malformed lines and missing keys are errors."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    for name in required:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is missing"))).otherwise(F.col(name)))
    return rows


def telemetry(spark: SparkSession, path: str, schema: str = "ts timestamp, metric string, type string, model string, value double") -> DataFrame:
    """Line-delimited JSON with torn lines marked in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def rss_items(feeds: DataFrame, body: str = "body") -> DataFrame:
    """position, title, url, snippet of a feed's items."""
    item = feeds.select(F.posexplode(F.regexp_extract_all(body, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("position", "item"))
    field = lambda n: F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{n}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{n}>", 1), "<[^>]+>", " "))
    return item.select("position", field("title").alias("title"), field("link").alias("url"), field("description").alias("snippet")).filter("url <> ''")


def result_links(pages: DataFrame, body: str = "html", link_class: str = "result__a") -> DataFrame:
    """position, url, title of result anchors of a class, redirects unwrapped."""
    from mnemolake.functions import urls

    anchor = rf'(?s)(<a[^>]*class="[^"]*\b{link_class}\b[^"]*"[^>]*>.*?</a>)'
    each = pages.select(F.posexplode(F.regexp_extract_all(body, F.lit(anchor), F.lit(1))).alias("position", "a"))
    url = urls.redirect_target(F.replace(F.regexp_extract("a", r'href="([^"]*)"', 1), F.lit("&amp;"), F.lit("&")))
    title = F.trim(F.regexp_replace(F.regexp_replace("a", "<[^>]+>", " "), r"\s+", " "))
    return each.select("position", url.alias("url"), title.alias("title")).filter("url <> ''")


def result_json(rows: DataFrame, body: str = "body", limit: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep (columns that tell answers apart), position, url, title, content of search answers' results that have a url."""
    schema = "struct<results:array<struct<url:string,title:string,content:string,engine:string,score:double>>>"
    out = rows.select(*keep, F.posexplode(F.from_json(body, schema)["results"]).alias("position", "r")).select(*keep, "position", "r.*")
    return out.filter("url is not null and url <> ''").filter(F.col("position") < limit).fillna({"title": "", "content": ""})


def first_source(*sources: DataFrame) -> DataFrame:
    """The rows of the first source that has any."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("_source", F.lit(i))
        out = part if out is None else out.unionByName(part)
    least = out.agg(F.min("_source").alias("_first"))
    return out.join(F.broadcast(least), F.col("_source") == F.col("_first")).drop("_source", "_first")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Always quoted, quotes doubled."""
    df.select(*columns).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def append_rollup(df: DataFrame, path: str, at: str = "at") -> None:
    """Line-delimited JSON by UTC day."""
    df.withColumn("day", F.date_format(at, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def compiled(sources: DataFrame, name: str = "name", text: str = "text", per: str = "topic") -> DataFrame:
    """per, document: sources in order of names, each under its name."""
    block = F.concat(F.lit("## "), F.col(name), F.lit("\n\n"), F.col(text))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(name, block.alias("_b")))), lambda s: s["_b"])
    return sources.groupBy(per).agg(F.array_join(parts, "\n\n").alias("document"))


def _results(pages: DataFrame, key: str, parser: str, body: str, selectors: dict[str, str]) -> DataFrame:
    # a small file would be one task, and parsing is what takes the time
    each = spread(pages.select(key, body)).select(key, F.posexplode(elements.results(body, parser, **selectors)).alias("position", "r"))
    return each.select(key, "position", "r.title", "r.url", "r.snippet")


def result_blocks(pages: DataFrame, key: str, body: str = "html", **selectors: str) -> DataFrame:
    """key, position, title, url, snippet of result pages that are made of blocks: each with an anchor, perhaps a
    paragraph. selectors: block, anchor, snippet."""
    return _results(pages, key, "blocks", body, selectors)


def result_anchors(pages: DataFrame, key: str, body: str = "html", **selectors: str) -> DataFrame:
    """key, position, title, url, snippet of result anchors, the first of each address; the snippet is the first one
    between its anchor and the next. selectors: anchor, snippet."""
    return _results(pages, key, "anchors", body, selectors)


def generic_links(pages: DataFrame, key: str, query: str, body: str = "html", limit: int = 8) -> DataFrame:
    """key, position, url, title, snippet, alike: anchors of pages that no parser knows, as far as they are like the page's
    query, best first. For pages of which the parsers above find nothing."""
    each = pages.select(key, F.posexplode(elements.generic_results(body, query, limit)).alias("position", "r"))
    return each.select(key, "position", "r.*")


def first_meta(*values):
    """The first value that isn't blank, trimmed; else empty."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values), F.lit(""))
