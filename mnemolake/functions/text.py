"""Text functions on string columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English and Spanish words that carry no topic. (Fixed values.)
STOPWORDS = "a an the of to in and or for on is are was were de la el los las que y en un una con por para del".split()

FAILURE, GOTCHA, PREFERENCE, DECISION = r"\b(fail(ed|ure|s)?|broke|crash(ed|es)?|error)\b", r"\b(gotcha|beware|caveat|careful|watch out)\b", r"\b(prefer(s|red)?|likes?|favou?rs?)\b", r"\b(decid(ed|e|es)|decision|chose|chosen|adopt(ed)?)\b"
KINDS = {"failure": "FAILURES", "gotcha": "GOTCHAS", "preference": "PREFERENCES", "decision": "DECISIONS", "fact": "FACTS"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokenize(text: Column | str, stopwords: list[str] | None = STOPWORDS) -> Column:
    """Words of more than one character that aren't stop words."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(stopwords or []))


def token_estimate(text: Column | str) -> Column:
    """Tokens at four bytes each, rounded up."""
    return F.ceil(F.octet_length(_col(text)) / 4).cast("long")


def title_of(text: Column | str) -> Column:
    """The first heading, else the first line's first 200 characters."""
    t = _col(text)
    heading = F.trim(F.regexp_extract(t, r"(?m)^#+[ \t]+(.*)$", 1))
    return F.when(heading != "", heading).otherwise(F.substring(F.element_at(F.split(t, "\n"), 1), 1, 200))


def body_of(text: Column | str) -> Column:
    """What follows the first heading, else the whole text."""
    t = _col(text)
    rest = F.regexp_extract(t, r"(?ms)^#+[ \t]+[^\n]*\n?(.*)\z", 1)
    return F.when(t.rlike(r"(?m)^#+[ \t]+"), rest).otherwise(t)


def normalize_target(target: Column | str) -> Column:
    """A link's target without label, anchor, outer slashes and .md, in lower case with forward slashes."""
    t = F.substring_index(F.substring_index(_col(target), "|", 1), "#", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.replace(t, F.lit("\\"), F.lit("/")))), r"^/+|/+$", ""), r"\.md$", "")


def plain_references(html: Column | str, *names: str) -> Column:
    """A page in which only the named character references count, and only with their semicolon: any other & stands for
    itself. For a reader of pages that would decode all that HTML knows."""
    return F.regexp_replace(_col(html), f"&(?!(?:{'|'.join(names)});)", "&amp;")


def link_targets(text: Column | str) -> Column:
    """Distinct normalised targets of [[links]], in order."""
    found = F.regexp_extract_all(_col(text), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, normalize_target)), lambda x: x != "")


def is_hex_color(tag: Column | str) -> Column:
    """Three, six or eight hex digits; four only with a letter."""
    t = _col(tag)
    return t.rlike("^[0-9a-fA-F]+$") & (F.length(t).isin(3, 6, 8) & (t.rlike("[a-fA-F]") | F.length(t).isin(6, 8) | (F.length(t) == 3)) | (F.length(t) == 4) & t.rlike("[a-fA-F]"))


def tags(text: Column | str) -> Column:
    """Distinct #tags in order, without what looks like a colour."""
    found = F.regexp_extract_all(_col(text), F.lit(r"(?<![\w#/&])#([\p{L}\p{N}_][\p{L}\p{N}_/-]*)"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda t: ~is_hex_color(t))


def relation_verb(verb: Column | str) -> Column:
    """snake_case."""
    return F.regexp_replace(F.lower(F.trim(_col(verb))), r"[\s-]+", "_")


def bullets(text: Column | str, least: int = 8, least_sentence: int = 16) -> Column:
    """List items of some length; without any, sentences."""
    lines = F.transform(F.split(_col(text), "\n"), lambda x: F.trim(x))
    items = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(r"^([-*+]|\d+[.)])\s+")), lambda x: F.regexp_replace(x, r"^([-*+]|\d+[.)])\s+", "")), lambda x: F.length(x) >= least)
    sentences = F.filter(F.transform(F.split(F.regexp_replace(_col(text), r"\s+", " "), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: F.length(x) >= least_sentence)
    return F.when(F.size(items) > 0, items).otherwise(sentences)


def bullet_kind(text: Column | str) -> Column:
    """failure, gotcha, preference, decision or fact: the first that fits."""
    t = F.lower(_col(text))
    return F.when(t.rlike(FAILURE), "failure").when(t.rlike(GOTCHA), "gotcha").when(t.rlike(PREFERENCE), "preference").when(t.rlike(DECISION), "decision").otherwise("fact")


def route_for_kind(kind: Column | str) -> Column:
    k = _col(kind)
    out = F.lit(KINDS["fact"])
    for name, place in KINDS.items():
        out = F.when(k == name, F.lit(place)).otherwise(out)
    return out


def query_terms(text: Column | str, n: int = 3, least: int = 4) -> Column:
    """The first words of some length."""
    return F.slice(F.filter(words(text), lambda w: F.length(w) >= least), 1, n)


def stem_plural(word: Column) -> Column:
    return F.when((F.length(word) > 4) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def anchor_terms(text: Column | str) -> Column:
    """Distinct singular words of six letters or more, else of four, else all."""
    all_ = words(text)
    long_, mid = F.filter(all_, lambda w: F.length(w) >= 6), F.filter(all_, lambda w: F.length(w) >= 4)
    return F.array_distinct(F.transform(F.when(F.size(long_) > 0, long_).when(F.size(mid) > 0, mid).otherwise(all_), stem_plural))


def truncate(text: Column | str, n: int) -> Column:
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("…"))).otherwise(t)


def lead_excerpt(text: Column | str, n: int = 240) -> Column:
    """The beginning, cut after the last sentence end past the half if there is one."""
    t = F.trim(F.regexp_replace(_col(text), r"\s+", " "))
    head = F.substring(t, 1, n)
    cut = F.regexp_extract(head, rf"(?s)^(.{{{n // 2},}}[.!?])", 1)
    return F.when(F.length(t) <= n, t).when(cut != "", cut).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def escape_attribute(text: Column | str) -> Column:
    t = _col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def csv_field(text: Column | str) -> Column:
    """Always quoted, quotes doubled."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(_col(text), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def has_front_status(text: Column | str, status: str) -> Column:
    """Whether the front matter block says `status:`."""
    block = F.regexp_extract(_col(text), r"(?s)\A---\n(.*?)\n---", 1)
    return block.rlike(rf"(?m)^status:\s*{status}\s*$")


def front_field(text: Column | str, name: str) -> Column:
    """A scalar of the front matter, unquoted; null if there is none."""
    block = F.regexp_extract(_col(text), r"(?s)\A---\n(.*?)\n---", 1)
    value = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(value, r"""^["'](.*)["']$""", "$1"), F.lit(""))


def version_key(version: Column | str) -> Column:
    """An array that orders dotted versions; missing parts count as 0."""
    parts = F.transform(F.split(_col(version), r"\."), lambda x: F.coalesce(F.expr("try_cast(null as int)"), F.regexp_extract(x, r"^(\d+)", 1).try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array(*[F.lit(0)] * 4)), 1, 4)


def suspension_signals(text: Column | str) -> Column:
    """How many phrases say that an account or page is suspended."""
    return F.regexp_count(F.lower(_col(text)), F.lit(r"account (has been )?suspended|page (is )?unavailable|access denied|temporarily disabled|contact (the )?(administrator|support)"))


def backlink_count(text: Column | str, name: str) -> Column:
    import re

    return F.regexp_count(F.lower(_col(text)), F.lit(r"\[\[" + re.escape(name.lower()) + r"(?=[\]#|])"))
