"""The whole audit of a vault of notes as one table of findings, and what to do about them.

Findings of a note's own text come from one pass over the notes; only links meet the table of names, by two joins. Each
kind is ranked, worst first, and carries its true number, so a listing may be cut without hiding how much there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.functions import text as T
from mnemolake.operators import graph, hygiene, knowledge

LOG_NAME, MARKER = "SESSION_LOG.md", "<<<<<<< "
#: Days after which a hypothesis waits for a verdict, and a confirmed note for a check. (Fixed values.)
HYPOTHESIS_DAYS, CONFIRMED_DAYS = 90, 365
_FOUND = ("kind", "path", "detail", "size")


def schema_rules(config: DataFrame, column: str = "value") -> DataFrame:
    """folder, required: the rules of a configuration (JSON, one row): {"folders": {folder: {"required": [...]}}}. Nothing
    from a configuration that isn't one; a folder whose rule is no object, or asks for no list, asks for no keys."""
    folders = F.from_json(F.get_json_object(column, "$.folders"), "map<string,string>")
    each = config.select(F.explode(folders).alias("folder", "rule"))
    required = F.from_json(F.get_json_object("rule", "$.required"), "array<string>")
    return each.select("folder", F.coalesce(required, F.array().cast("array<string>")).alias("required"))


def missing_keys(notes: DataFrame, rules: DataFrame) -> DataFrame:
    """path, missing: keys that the rule of a note's first folder (else the rule *) asks for and its front matter lacks."""
    folder = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("")
    block = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    own = notes.select("path", folder.alias("folder"), F.regexp_extract_all(block, F.lit(r"(?m)^([^\s:][^:\n]*?)\s*:"), F.lit(1)).alias("keys"))
    # a rule for each folder that has one: few rows
    with_own = own.join(rules.select("folder", F.col("required").alias("own_rule")), "folder", "left")
    both = with_own.join(rules.filter("folder = '*'").select(F.col("required").alias("any_rule")), F.lit(True), "left")
    missing = F.array_except(F.coalesce("own_rule", "any_rule", F.array().cast("array<string>")), F.col("keys"))
    return both.select("path", missing.alias("missing")).filter(F.size("missing") > 0)


def broken_links(notes: DataFrame) -> DataFrame:
    """path, target (as written, without label and anchor): links of notes, outside code, that no note's name or path
    answers; placeholders in <> don't count."""
    found = F.regexp_extract_all(knowledge.without_code(F.col("text")), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    links = notes.select("path", F.explode(F.array_distinct(found)).alias("link"))
    shown = F.trim(F.substring_index(F.substring_index("link", "|", 1), "#", 1))
    each = links.select("path", shown.alias("target"), T.normalize_target("link").alias("full")).filter("target <> '' AND NOT target RLIKE '[<>]'")
    each = each.withColumn("base", F.regexp_extract("full", r"([^/]*)$", 1))
    whole = F.lower(F.regexp_replace("path", r"(?i)\.md$", ""))
    names = notes.select(F.lower(graph.stem(F.col("path"))).alias("base")).distinct()
    paths = notes.select(whole.alias("full")).distinct()
    return each.join(names, "base", "left_anti").join(paths, "full", "left_anti").select("path", "target").distinct()


def _marker_line(text):
    """The number, from 1, of the first line outside fenced code that begins with the marker; 0: none."""
    start = F.struct(F.lit(False).alias("code"), F.lit(0).alias("n"), F.lit(0).alias("found"))

    def step(s, line):
        fence = F.ltrim(line).startswith("```") | F.ltrim(line).startswith("~~~")
        hit = (s["found"] == 0) & ~s["code"] & line.startswith(MARKER)
        return F.struct((s["code"] != fence).alias("code"), (s["n"] + 1).alias("n"), F.when(hit, s["n"] + 1).otherwise(s["found"]).alias("found"))

    return F.aggregate(F.split(text, "\n"), start, step)["found"]


def audit(notes: DataFrame, as_of: str, budget: int = 8000, log_budget: int = 6000, rules: DataFrame | None = None, files: DataFrame | None = None, index: DataFrame | None = None, limit: int | None = 100) -> DataFrame:
    """kind, position, path, detail, size, total: the first `limit` findings of each kind (None: all), worst first; total
    counts all of the kind. With a limit, each task keeps so many before anything is ranked.

    notes: path, text, modified. Kinds: oversized (tokens over `budget`), session_log (over `log_budget`), conflict_marker
    (its line, the first of a note, outside code), stale_hypothesis and unverified (age in days, by last_verified or else
    the file), schema (keys that `rules`, from schema_rules(), miss), broken_link (a target), conflict and temporary (of
    `files`: path, modified), drift (of `index`: path, modified; its state)."""
    tokens = T.token_estimate(F.coalesce("text", F.lit("")))
    marker = _marker_line(F.coalesce("text", F.lit("")))
    status = F.lower(T.front_field("text", "status"))
    since = F.coalesce(T.front_field("text", "last_verified").try_cast("timestamp"), F.col("modified").cast("timestamp"))
    days = F.greatest(F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(since)) / 86_400_000_000), F.lit(0)).cast("long")
    told = notes.select("path", tokens.alias("tokens"), marker.cast("long").alias("marker"), status.alias("status"), days.alias("days"))

    def when(kind: str, there, detail, size):
        return F.when(there, F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"), size.cast("long").alias("size")))

    own = F.array_compact(
        F.array(
            when("oversized", F.col("tokens") > budget, F.col("tokens"), F.col("tokens")),
            when("session_log", (F.col("path") == LOG_NAME) & (F.col("tokens") > log_budget), F.col("tokens"), F.col("tokens")),
            when("conflict_marker", F.col("marker") > 0, F.col("marker"), F.lit(0)),
            when("stale_hypothesis", (F.col("status") == "hypothesis") & (F.col("days") >= HYPOTHESIS_DAYS), F.col("days"), F.col("days")),
            when("unverified", (F.col("status") == "confirmed") & (F.col("days") >= CONFIRMED_DAYS), F.col("days"), F.col("days")),
        )
    )
    out = told.select("path", F.explode(own).alias("f")).select("f.kind", "path", "f.detail", "f.size")
    zero = F.lit(0).cast("long").alias("size")
    out = out.unionByName(broken_links(notes).select(F.lit("broken_link").alias("kind"), "path", F.col("target").alias("detail"), zero))
    if rules is not None:
        out = out.unionByName(missing_keys(notes, rules).select(F.lit("schema").alias("kind"), "path", F.array_join("missing", ", ").alias("detail"), zero))
    if files is not None:
        out = out.unionByName(hygiene.conflict_files(files, as_of).select("kind", "path", F.lit("").alias("detail"), zero))
    if index is not None:
        out = out.unionByName(hygiene.drift(index, notes, "path", "modified").filter("state <> 'same'").select(F.lit("drift").alias("kind"), "path", F.col("state").alias("detail"), zero))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("size"), "path", "detail"))
    totals = out.groupBy("kind").agg(F.count("*").alias("total"))  # a row for each kind
    ranked = out.withColumn("position", place)
    ranked = ranked if limit is None else ranked.filter(F.col("position") <= limit)
    return ranked.join(F.broadcast(totals), "kind").select("kind", "position", "path", "detail", "size", "total")


#: What to do about a kind of finding, in order; n, path, detail: how many there are, and the worst one. (Own wording.)
_ADVICE = (
    ("session_log", "{path} is over its budget ({detail} tokens): archive old sections"),
    ("oversized", "{n} notes over the token budget (largest: {path}, {detail} tokens): split or condense them"),
    ("broken_link", "{n} broken links: mend or remove their targets"),
    ("orphan", "{n} notes without relations: link them"),
    ("stale", "{n} stale notes (oldest: {path}, {detail} days): review, condense or archive them"),
    ("cold", "{n} notes that no search returned and nobody opened (such as {path}): review them for archiving"),
    ("near_duplicate", "{n} pairs of notes that nearly repeat each other (such as {path} and {detail}): review them"),
)
NOTHING = "no findings: the vault is in good shape"


def findings(kind: str, df: DataFrame, path: str, detail: str | None = None, size: str | None = None) -> DataFrame:
    """Rows of a report as findings of a kind, to be united with those of audit()."""
    rows = df.select(F.lit(kind).alias("kind"), F.col(path).cast("string").alias("path"), (F.col(detail) if detail else F.lit("")).cast("string").alias("detail"), (F.col(size) if size else F.lit(0)).cast("long").alias("size"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("size"), "path", "detail"))
    return rows.withColumn("position", place).withColumn("total", F.count("*").over(Window.partitionBy("kind"))).select("kind", "position", "path", "detail", "size", "total")


def suggestions(found: DataFrame) -> DataFrame:
    """position, action: a line for each kind of finding that asks for action, with the worst one; one line if none does."""
    worst = found.filter("position = 1").select("kind", "path", "detail", "total")
    advice = F.lit(None).cast("string")
    place = F.lit(None).cast("int")
    for i, (kind, line) in enumerate(_ADVICE):
        parts = line.replace("{n}", "\0n\0").replace("{path}", "\0path\0").replace("{detail}", "\0detail\0").split("\0")
        text = F.concat(*(F.col("total").cast("string") if p == "n" else F.col(p) if p in ("path", "detail") else F.lit(p) for p in parts))
        advice, place = F.when(F.col("kind") == kind, text).otherwise(advice), F.when(F.col("kind") == kind, F.lit(i)).otherwise(place)
    lines = worst.select(place.alias("place"), advice.alias("action")).filter("place is not null")
    spare = found.sparkSession.createDataFrame([(99, NOTHING)], "place int, action string")
    both = lines.unionByName(spare)  # a handful of rows
    w = Window.orderBy("place")
    return both.withColumn("position", F.row_number().over(w)).filter((F.col("place") < 99) | (F.col("position") == 1)).select("position", "action")


def decay(notes: DataFrame, relations: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """path, reason, age_days: notes to verify or to link. Hypotheses whose file is `days` old, and notes that no relation
    leads from or to (without an age). notes: path, text, modified."""
    age = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("modified").cast("timestamp"))) / 86_400_000_000).cast("long")
    waiting = notes.filter(T.has_front_status("text", "hypothesis")).select("path", F.lit("stale hypothesis").alias("reason"), age.alias("age_days")).filter(F.col("age_days") >= days)
    lonely = graph.orphans(graph.resolve(relations, notes), notes.select(F.col("path").alias("node")))
    return waiting.unionByName(lonely.select(F.col("node").alias("path"), F.lit("orphan").alias("reason"), F.lit(None).cast("long").alias("age_days")))
