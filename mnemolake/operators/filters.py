"""Predicates that Spark pushes to the scan where their columns are stored."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = ("memory", "research")


def validate_section(section: str | None) -> str | None:
    if section is not None and section not in SECTIONS:
        raise ValueError(f"section is one of {', '.join(SECTIONS)}")
    return section


def in_section(path: str, section: str | None) -> Column:
    """research is what lies below RESEARCH/, memory the rest, None everything."""
    below = F.col(path).startswith("RESEARCH/")
    return {None: F.lit(True), "research": below, "memory": ~below}[validate_section(section)]


def validate_scope(scope: str) -> str:
    """A relative folder or note without drive letter, backslash or `..`."""
    clean = scope.strip().rstrip("/")
    if not clean or clean.startswith("/") or "\\" in clean or re.match(r"^[A-Za-z]:", clean) or ".." in clean.split("/"):
        raise ValueError(f"not a scope: {scope!r}")
    return clean


def in_scope(path: str, scope: str) -> Column:
    """The path itself, its note, or what lies below; case counts, and no character is a wildcard."""
    s = validate_scope(scope)
    return (F.col(path) == s) | (F.col(path) == f"{s}.md") | F.col(path).startswith(f"{s}/")


def folder_of(path: str) -> Column:
    return F.when(F.instr(F.col(path), "/") > 1, F.substring_index(path, "/", 1)).otherwise("")


def any_keyword(text: str, keywords: list[str]) -> Column:
    """Any keyword, whatever its case; all texts without keywords."""
    out = F.lit(not keywords)
    for k in keywords:
        out = out | F.contains(F.lower(F.col(text)), F.lit(k.lower()))
    return out


#: What the HTML of pages that hide their content holds. (Fixed values.)
GATES = (
    "just a moment...", "checking your browser before accessing", "enable javascript and cookies to continue", "verify you are human", "please verify you are a human", "cf-challenge",
    "cf-browser-verification", "/cdn-cgi/challenge-platform", "g-recaptcha", "grecaptcha", "h-captcha", "hcaptcha", "please complete the security check", "attention required! | cloudflare",
    "sign in to continue", "log in to continue", "please log in to view", "subscribe to read the full", "this content is available to subscribers",
)


def gated_reason(html: str, text: str, least: int = 4000) -> Column:
    """Why a page seems gated: a phrase of its HTML, or a short text with a password field; null otherwise."""
    low, out = F.lower(F.col(html)), F.when((F.length(text) < least) & F.col(html).rlike(r"(?i)<input[^>]+type\s*=\s*[\"']?password"), "password field")
    for phrase in reversed(GATES):
        out = F.when(F.contains(low, F.lit(phrase)), phrase).otherwise(out)
    return out


def not_english(text: str, stopwords: tuple[str, ...] = ("el", "la", "los", "que", "de", "y", "le", "les", "des", "und", "der", "die")) -> Column:
    """A character beyond ASCII, or a stop word of another language."""
    words = F.split(F.lower(F.col(text)), r"[^\p{L}]+")
    return F.col(text).rlike(r"[^\x00-\x7F]") | F.arrays_overlap(words, F.array(*map(F.lit, stopwords)))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: url, host, path; rules: host, prefix, allow. Adds allowed: the longest prefix decides, allow wins ties, and
    without a rule a path is allowed."""
    from mnemolake.operators.ranking import MOST_TERMS, by_key

    # a join by host would bring all addresses of a large host to one task
    small = F.broadcast if rules.count() <= MOST_TERMS else (lambda df: df)
    hit = by_key(urls.select("url", "host", "path"), "url").join(small(rules.withColumnRenamed("host", "rule_host")), (F.col("host") == F.col("rule_host")) & F.expr("startswith(path, prefix)"), "left")
    size = F.length("prefix")
    best = hit.groupBy("url", "host", "path").agg(F.max(F.when(F.col("allow"), size)).alias("yes"), F.max(F.when(~F.col("allow"), size)).alias("no"))
    return best.select("url", "host", "path", (F.coalesce("yes", F.lit(0)) >= F.coalesce("no", F.lit(0))).alias("allowed"))


def missing_keys(notes: DataFrame, rules: dict[str, list[str]], folder: str = "folder", keys: str = "keys") -> DataFrame:
    """Notes with the required keys they lack: the folder's rule, else the rule *; an empty rule asks for none."""
    need = F.array(*map(F.lit, rules.get("*", []))).cast("array<string>")
    for name, wanted in rules.items():
        if name != "*":
            need = F.when(F.col(folder) == name, F.array(*map(F.lit, wanted)).cast("array<string>")).otherwise(need)
    return notes.withColumn("missing", F.array_except(need, F.col(keys))).filter(F.size("missing") > 0)
