"""The chunk store: what is indexed, with which embedder, and figures about it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import udfs
from mnemolake.functions import vectors as V
from mnemolake.operators import filters, ranking

#: Embedders by name: a function of a text column that gives its vector.
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"hashing-256": udfs.embed}


def get_embedder(name: str) -> Callable[[Column], Column]:
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; there are {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name]


def embedder_for(identity: str | None) -> Callable[[Column], Column] | None:
    """The embedder that wrote rows of an identity, none if it isn't known."""
    return EMBEDDERS.get(identity or "")


def dominant(rows: DataFrame, column: str) -> DataFrame:
    """value, n: the most frequent value, the smallest of ties; no row for an empty table."""
    n = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "value").limit(1)


def indexed_keys(chunks: DataFrame, embedder: str) -> DataFrame:
    """path, mtime of what an embedder has indexed."""
    return chunks.filter(F.col("embedder") == embedder).select("path", "mtime").distinct()


def has_any(chunks: DataFrame, embedder: str | None = None) -> bool:
    return not (chunks if embedder is None else chunks.filter(F.col("embedder") == embedder)).isEmpty()


def vectors_of(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """path, ordinal, vec of the keys that are there."""
    return chunks.join(keys.select("path", "ordinal").distinct(), ["path", "ordinal"]).select("path", "ordinal", "vec")


def mtimes(notes: DataFrame, paths: DataFrame) -> DataFrame:
    return notes.join(paths.select("path").distinct(), "path", "left_semi").select("path", "mtime")


def index_vectors(notes: DataFrame, chunks: DataFrame, embedder: str = "hashing-256") -> DataFrame:
    """path, ordinal, mtime, embedder, heading, content, vec: the chunk table after notes (path, mtime, text) that are new
    or changed were chunked and embedded again; chunks of notes that went, and of other embedders, go. Unchanged chunks
    pass as they are, so a second run embeds nothing. Where notes have a title of their own, it heads what stands before
    the first heading, and a note without a body is one chunk of it."""
    have = indexed_keys(chunks, embedder)
    fresh = notes.join(have, ["path", "mtime"], "left_anti")
    cut = udfs.chunk_note("title", "text") if "title" in fresh.columns else udfs.chunk_text("text")
    made = fresh.select("path", "mtime", F.posexplode(cut).alias("ordinal", "c")).select("path", "ordinal", "mtime", F.lit(embedder).alias("embedder"), "c.*")
    made = made.withColumn("vec", get_embedder(embedder)(F.col("content")))
    kept = chunks.filter(F.col("embedder") == embedder).join(notes.select("path", "mtime"), ["path", "mtime"], "left_semi")
    return kept.select(made.columns).unionByName(made)


def refresh(notes: DataFrame, chunks: DataFrame, fallback: str = "hashing-256") -> DataFrame:
    """index_vectors() with the embedder that most chunks have, so a refresh doesn't mix identities."""
    found = dominant(chunks, "embedder").first()
    return index_vectors(notes, chunks, found["value"] if found and found["value"] in EMBEDDERS else fallback)


def query_vector(vec: Column) -> Column:
    """The vector, null if it is zero: nothing is near to it."""
    return F.when(V.norm(vec) > 0, vec)


def vector_literal(vec: Column) -> Column:
    """[x,y,...]; a component that isn't finite is an error."""
    text = F.concat(F.lit("["), F.array_join(F.transform(vec, lambda x: x.cast("string")), ","), F.lit("]"))
    return F.when(V.is_finite(vec), text).otherwise(F.raise_error(F.lit("a vector has a component that isn't finite")))


def folded_search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", query_text: str = "query") -> DataFrame:
    """bm25_or_fallback() on texts and queries without accents."""
    fold = lambda df, c: df.withColumn(c, udfs.fold(F.coalesce(F.col(c), F.lit(""))))
    return ranking.bm25_or_fallback(fold(docs.select(doc_id, text), text), fold(queries, query_text), k, doc_id=doc_id, text=text, query_text=query_text)


def health(**tables: DataFrame) -> DataFrame:
    """name, n: rows of each table."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stats(notes: DataFrame, relations: DataFrame, observations: DataFrame, chunks: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """kind, key, n: notes by folder, observations by category and by tag, relations by type, chunks; within a scope."""
    own = lambda df, path: df.filter(filters.in_scope(path, scope)) if scope else df
    rows = [
        own(notes, "path").select(F.lit("folder").alias("kind"), filters.folder_of("path").alias("key")),
        own(observations, "source_path").select(F.lit("category").alias("kind"), F.col("category").alias("key")),
        own(observations, "source_path").select(F.lit("tag").alias("kind"), F.explode("tags").alias("key")),
        own(relations, "src").select(F.lit("relation").alias("kind"), F.col("type").alias("key")),
    ]
    if chunks is not None:
        rows.append(own(chunks, "path").select(F.lit("chunks").alias("kind"), F.lit("").alias("key")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("kind", "key").agg(F.count("*").alias("n"))


def vault_stats(notes: DataFrame, k: int = 10, at: str = "modified") -> DataFrame:
    """kind, key, n: notes by top folder, and the k newest notes by rank."""
    folders = notes.groupBy(filters.folder_of("path").alias("key")).agg(F.count("*").alias("n")).select(F.lit("folder").alias("kind"), "key", "n")
    newest = notes.orderBy(F.desc(at), "path").limit(k).agg(F.sort_array(F.collect_list(F.struct(F.col(at), F.lit(0).alias("z"), "path")), asc=False).alias("all"))  # k entries
    # ties by path, ascending
    ranked = newest.select(F.posexplode(F.array_sort("all", lambda x, y: F.when(x[at] > y[at], -1).when(x[at] < y[at], 1).when(x["path"] < y["path"], -1).when(x["path"] > y["path"], 1).otherwise(0))).alias("n", "x"))
    return folders.unionByName(ranked.select(F.lit("newest").alias("kind"), F.col("x.path").alias("key"), (F.col("n") + 1).cast("long").alias("n")))


def unenriched(notes: DataFrame, relations: DataFrame, observations: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Notes without relations, observations and pending suggestions."""
    out = notes
    for df, c in ((relations, "src"), (observations, "source_path"), (suggestions.filter("status = 'pending'"), "path")):
        out = out.join(df.select(F.col(c).alias("path")).distinct(), "path", "left_anti")
    return out


def suggestions_page(suggestions: DataFrame, status: str = "pending", limit: int = 50, scope: str | None = None) -> DataFrame:
    """Suggestions of a status, the oldest first."""
    own = suggestions.filter(F.col("status") == status)
    if scope:
        own = own.filter(filters.in_scope("path", scope))
    return own.orderBy("created_at", "id").limit(limit)


def completions(notes: DataFrame, tags: DataFrame) -> DataFrame:
    """value: what may be completed: titles, names of notes and tags."""
    from mnemolake.operators.graph import stem

    names = notes.select(F.explode(F.array("title", stem(F.col("path")))).alias("value"))
    return names.unionByName(tags.select(F.col("tag").alias("value"))).filter(F.trim("value") != "").distinct()


def valid_proposals(proposals: DataFrame, relation_types: list[str] | None = None) -> DataFrame:
    """path, relations (type, target), observations (category, content): entries that lack a part go, the rest is
    normalised; with relation_types other types go too."""
    from mnemolake.functions.text import normalize_target, relation_verb

    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    relations = F.transform(F.filter("relations", lambda r: filled(r["type"]) & filled(r["target"])), lambda r: F.struct(relation_verb(r["type"]).alias("type"), normalize_target(r["target"]).alias("target")))
    if relation_types is not None:
        relations = F.filter(relations, lambda r: r["type"].isin(relation_types))
    observations = F.transform(F.filter("observations", lambda o: filled(o["category"]) & filled(o["content"])), lambda o: F.struct(F.lower(F.trim(o["category"])).alias("category"), F.trim(o["content"]).alias("content")))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return proposals.select("path", empty(relations, "array<struct<type:string,target:string>>").alias("relations"), empty(observations, "array<struct<category:string,content:string>>").alias("observations"))
