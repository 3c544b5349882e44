"""Notes as rows: passages with their neighbours, cards, front matter, checks before writing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.functions import text as T


def passage_window(chunks: DataFrame, hits: DataFrame, width: int = 1) -> DataFrame:
    """path, ordinal, passage: hits' chunks with those up to `width` before and after."""
    near = chunks.withColumnRenamed("ordinal", "at").join(hits.select("path", "ordinal"), "path").filter(F.abs(F.col("at") - F.col("ordinal")) <= width)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda s: s["content"])
    return near.groupBy("path", "ordinal").agg(F.array_join(parts, "\n").alias("passage"))


def best_chunk(hits: DataFrame, per: tuple[str, ...] = ("query_id", "path"), order: str = "rank") -> DataFrame:
    w = Window.partitionBy(*per).orderBy(order, "ordinal")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cards(notes: DataFrame, n: int = 240) -> DataFrame:
    """path, card: the title and the beginning of the body."""
    return notes.select("path", F.concat_ws("\n", F.col("title"), F.substring("body", 1, n)).alias("card"))


def failure_list(notes: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, path, rank: candidates that speak of failures or gotchas, in order, as a list to fuse."""
    hit = notes.filter(T.bullet_kind("text").isin("failure", "gotcha")).select("path")
    w = Window.partitionBy("query_id").orderBy("rank", "path")
    return candidates.join(hit, "path", "left_semi").withColumn("rank", F.row_number().over(w))


def front_matter(df: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Adds `text`: the keys that have values as a quoted block, then the body."""
    lines = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), F.to_json(F.struct(F.col(k).cast("string").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(k).cast("string").alias("v")))) - 6))) for k in keys)))
    return df.withColumn("text", F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), F.col(body)))


def typed_scalar(value):
    """Kind of a scalar: boolean, number, null or string."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "false"), "boolean").when(v.isin("", "null", "~"), "null").when(v.rlike(r"^-?\d+(\.\d+)?$"), "number").otherwise("string")


def lint(observations: DataFrame, aliases: dict[str, str], canonical: list[str], most: int = 8) -> DataFrame:
    """source_path, ordinal, category, advice: categories that have a canonical name, or none; `most` a note."""
    advice = F.when(F.col("category").isin(canonical), None)
    for alias, name in aliases.items():
        advice = F.when(F.col("category") == alias, F.lit(f"use {name}")).otherwise(advice)
    known = F.col("category").isin([*canonical, *aliases])
    out = observations.withColumn("advice", F.when(known, advice).otherwise("unknown category")).filter("advice is not null")
    w = Window.partitionBy("source_path").orderBy("ordinal")
    return out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select("source_path", "ordinal", "category", "advice")


def summary_errors(df: DataFrame, text: str = "text", source_chars: str = "source_chars", status: str = "status"):
    """Adds `errors`: what a summary lacks."""
    t = F.col(text)
    checks = {"status": F.coalesce(F.col(status), F.lit("")) != "summarised", "too short": F.length(t) < 200, "no link": ~t.rlike(r"https?://|\[\["), "too long for its source": (F.col(source_chars) >= 2000) & (F.length(t) > 0.6 * F.col(source_chars))}
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items()))))


def candidates(notes: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """path, bullet, kind, place, is_known: bullets worth keeping, and whether one is stored in the same words."""
    each = notes.select("path", F.explode(T.bullets(text)).alias("bullet")).withColumn("kind", T.bullet_kind("bullet")).withColumn("place", T.route_for_kind("kind"))
    have = known.select(F.array_join(T.words("content"), " ").alias("_w")).distinct().withColumn("is_known", F.lit(True))
    return each.withColumn("_w", F.array_join(T.words("bullet"), " ")).join(have, "_w", "left").drop("_w").fillna({"is_known": False})


def session_tail(logs: DataFrame, n: int = 3, text: str = "text") -> DataFrame:
    """The last lines that aren't empty."""
    kept = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return logs.select("path", F.slice(kept, F.greatest(F.size(kept) - (n - 1), F.lit(1)), n).alias("lines"))


def recent_activity(sections: DataFrame, last: int = 15, k: int = 8) -> DataFrame:
    """kind, value, n: the most frequent tags and links of the last sections."""
    own = sections.orderBy(F.desc("section")).limit(last)
    each = own.select(F.lit("tag").alias("kind"), F.explode(T.tags("content")).alias("value")).unionByName(own.select(F.lit("link").alias("kind"), F.explode(T.link_targets("content")).alias("value")))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "value")
    return each.groupBy("kind", "value").agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def compress_index(index: DataFrame, most: int = 120, text: str = "line") -> DataFrame:
    """Lines of an index: headings and bullets, bullets cut at a word; prose over `most` characters goes."""
    bullet = F.col(text).rlike(r"^\s*[-*]\s")
    cut = F.when(F.length(text) > most, F.concat(F.regexp_extract(F.substring(text, 1, most), r"^(.*)\s\S*$", 1), F.lit(" …"))).otherwise(F.col(text))
    return index.filter(bullet | F.col(text).startswith("#") | (F.length(text) <= most)).withColumn(text, F.when(bullet, cut).otherwise(F.col(text)))


def query_hash(query):
    """The first twelve hex digits of the query's SHA-256."""
    return F.substring(F.sha2(query.cast("binary"), 256), 1, 12)


def is_hypothesis(text: str = "text"):
    return T.has_front_status(text, "hypothesis")


def append_under_heading(text, heading: str, bullet):
    """The text with a bullet at the end of a `## ` section; without the section, with a new one at the end."""
    lines = F.split(text, "\n")
    at = F.array_position(lines, f"## {heading}").cast("int")
    after = F.slice(lines, at + 1, F.size(lines))
    nxt = F.array_position(F.transform(after, lambda x: x.startswith("## ")), True).cast("int")
    end = F.when(nxt > 0, at + nxt - 1).otherwise(F.size(lines))  # lines up to the section's end
    # blank lines stay behind the bullet
    filled = F.aggregate(F.slice(lines, 1, end), F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), lambda s, x: F.struct((s["n"] + 1).alias("n"), F.when(F.trim(x) != "", s["n"] + 1).otherwise(s["last"]).alias("last")))["last"]
    put = F.array_join(F.concat(F.slice(lines, 1, filled), F.array(F.concat(F.lit("- "), bullet)), F.slice(lines, filled + 1, F.size(lines))), "\n")
    return F.when(at > 0, put).otherwise(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit(f"\n\n## {heading}\n- "), bullet))


def history_rows(lines: DataFrame, column: str = "line") -> DataFrame:
    """hash, date, subject of tab-separated history lines; others go."""
    part = F.split(column, "\t", 3)
    return lines.filter(F.size(part) == 3).select(part[0].alias("hash"), part[1].alias("date"), part[2].alias("subject"))


def schema_verdict(missing, enforced: bool = False):
    """ok, or a warning with the missing keys; an error where the schema is enforced."""
    told = F.concat(F.lit("missing: "), F.array_join(missing, ", "))
    return F.when(F.size(missing) == 0, F.lit("ok")).otherwise(F.raise_error(told) if enforced else told)


def actions(broken: DataFrame, orphans: DataFrame, stale: DataFrame, drifted: DataFrame) -> DataFrame:
    """position, action: what to do next, one line for each kind of finding there is."""
    rows = [(1, broken, "fix %d broken links"), (2, orphans, "link %d orphaned notes"), (3, stale, "review %d stale notes"), (4, drifted, "reindex %d notes")]
    out = None
    for n, df, text in rows:
        one = df.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(n).alias("position"), F.format_string(text, "n").alias("action"))
        out = one if out is None else out.unionByName(one)
    return out


def reflection(promotions: DataFrame, pairs: DataFrame, ages: DataFrame, activity: DataFrame) -> DataFrame:
    """kind, key, detail: hypotheses that wait, notes that nearly repeat each other, confidence out of date, and what the
    last sessions were about. promotions: path, line; pairs: a, b, score; ages: path, status; activity: kind, value, n."""
    parts = [
        promotions.select(F.lit("promote").alias("kind"), F.col("path").alias("key"), F.col("line").alias("detail")),
        pairs.select(F.lit("merge").alias("kind"), F.col("a").cast("string").alias("key"), F.col("b").cast("string").alias("detail")),
        ages.select(F.lit("verify").alias("kind"), F.col("path").alias("key"), F.col("status").alias("detail")),
        activity.select(F.concat(F.lit("active "), F.col("kind")).alias("kind"), F.col("value").alias("key"), F.col("n").cast("string").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reflection_text(found: DataFrame) -> DataFrame:
    """text: the findings as Markdown, a section for each kind; one row."""
    line = F.concat(F.lit("- "), F.col("key"), F.lit(": "), F.col("detail"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", line.alias("_l")))), lambda s: s["_l"]), "\n")
    each = found.groupBy("kind").agg(parts.alias("_t")).withColumn("_s", F.concat(F.lit("## "), F.col("kind"), F.lit("\n"), F.col("_t")))
    return each.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "_s"))), lambda s: s["_s"]), "\n\n").alias("text"))


FRONT_KEY = r"[A-Za-z0-9_][A-Za-z0-9_.-]*"


def yaml_scalar(value):
    """A scalar as YAML: numbers and booleans as they are, words plain, what could be read as something else quoted."""
    s = value.cast("string")
    safe = s.rlike(r"^[A-Za-z0-9][A-Za-z0-9 _./-]*$") & (s == F.trim(s)) & ~s.rlike(r"(?i)^(true|false|null|yes|no|on|off)$") & ~s.rlike(r"^[0-9.+-]+$")
    quoted = F.to_json(F.struct(s.alias("v")))
    return F.when(safe, s).when(s.isNotNull(), F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def edit_front_matter(df: DataFrame, set: dict[str, object] | None = None, remove: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """The rows with top-level scalar keys of their front matter set and removed, all other lines as they are.

    set: a key's value, a string, a number, a boolean or a column. A note without front matter gets a block; one whose last
    key goes loses it. Adds `refused` (keys whose value goes on in indented lines: such a note stays as it is) and
    `not_found` (keys to remove that aren't there). A null text counts as empty, a null value removes nothing and sets
    nothing. Line ends stay what they are in the note."""
    set = set or {}
    if not set and not remove:
        raise ValueError("nothing to set or remove")
    if bad := [k for k in (*set, *remove) if not re.fullmatch(FRONT_KEY, k)]:
        raise ValueError(f"not keys: {bad}")
    if bad := [k for k, v in set.items() if not isinstance(v, (str, int, float, bool, Column))]:
        raise ValueError(f"not scalars: {bad}")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    block = F.regexp_extract(whole, r"(?s)\A---\r?\n(?:.*?\r?\n)??---(?:\r?\n|\z)", 0)
    out = df.withColumn("_t", whole).withColumn("_b", block).withColumn("_eol", F.when(F.contains(whole, F.lit("\r\n")), "\r\n").otherwise("\n"))
    inner = F.regexp_replace(F.regexp_replace("_b", r"\A---\r?\n", ""), r"(?:\A|\r?\n)---(?:\r?\n)?\z", "")
    lines = F.when((F.col("_b") == "") | (inner == ""), F.array().cast("array<string>")).otherwise(F.split(inner, r"\r?\n"))
    out = out.withColumn("_lines", lines).withColumn("refused", F.array().cast("array<string>")).withColumn("not_found", F.array().cast("array<string>"))

    def place(key: str):
        return F.coalesce(F.array_position(F.transform("_lines", lambda x: x.startswith(f"{key}:")), True), F.lit(0)).cast("int")

    for key, value, gone in [*((k, v, False) for k, v in set.items()), *((k, None, True) for k in remove)]:
        at = place(key)
        nested = (at > 0) & F.coalesce(F.get("_lines", at).rlike(r"^[ \t]"), F.lit(False))
        if gone:
            new, wanted = F.filter("_lines", lambda x, i: i != at - 1), at > 0
        else:
            scalar = F.lit(str(value).lower() if isinstance(value, bool) else str(value)) if isinstance(value, (bool, int, float)) else yaml_scalar(value if isinstance(value, Column) else F.lit(value))
            if isinstance(value, Column) and dict(df.select(value.alias("v")).dtypes)["v"] not in ("string",):
                scalar = value.cast("string")
            line = F.concat(F.lit(f"{key}: "), scalar)
            new = F.when(at > 0, F.transform("_lines", lambda x, i: F.when(i == at - 1, line).otherwise(x))).otherwise(F.array_append("_lines", line))
            wanted = line.isNotNull()
        out = out.withColumn("_new", F.when(nested | ~wanted, F.col("_lines")).otherwise(new)).withColumn("refused", F.when(nested, F.array_append("refused", F.lit(key))).otherwise(F.col("refused")))
        if gone:
            out = out.withColumn("not_found", F.when(at == 0, F.array_append("not_found", F.lit(key))).otherwise(F.col("not_found")))
        out = out.withColumn("_lines", F.col("_new"))
    joined = F.when(F.size("_lines") == 0, F.lit("")).otherwise(F.concat(F.lit("---"), F.col("_eol"), F.array_join(F.transform("_lines", lambda x: F.concat(x, F.col("_eol"))), ""), F.lit("---"), F.col("_eol")))
    edited = F.concat(joined, F.substring("_t", F.length("_b") + 1, F.length("_t")))
    return out.withColumn(text, F.when(F.size("refused") > 0, F.col("_t")).otherwise(edited)).drop("_t", "_b", "_eol", "_lines", "_new")
