"""A graph of notes: edges src, dst (resolved) with a type, kept unresolved in storage and resolved when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake import session
from mnemolake.functions.text import normalize_target


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?i)\.md$", "")


def resolve(edges: DataFrame, notes: DataFrame, on_missing: str = "drop") -> DataFrame:
    """edges: src, target, type; notes: path. Adds dst: the note at that path, else the smallest path of that name.

    on_missing: drop edges without one, or keep them with the target itself as dst."""
    if on_missing not in ("drop", "keep"):
        raise ValueError("on_missing is drop or keep")
    key = normalize_target("target")
    by_path = notes.groupBy(normalize_target("path").alias("key")).agg(F.min("path").alias("by_path"))
    by_stem = notes.groupBy(F.lower(stem(F.col("path"))).alias("key2")).agg(F.min("path").alias("by_stem"))
    out = edges.withColumn("key", key).withColumn("key2", F.lower(stem(key)))
    out = out.join(by_path, "key", "left").join(by_stem, "key2", "left")
    found = F.coalesce("by_path", "by_stem")
    out = out.withColumn("dst", found if on_missing == "drop" else F.coalesce(found, "key")).drop("key", "key2", "by_path", "by_stem")
    return out.filter(F.col("dst").isNotNull())


def degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, out_degree (every edge), in_degree (without self-links), degree."""
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    ins = edges.filter("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    both = outs.join(ins, "node", "full_outer")
    both = nodes.select("node").join(both, "node", "left") if nodes is not None else both
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return both.select("node", zero("out_degree"), zero("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def importance(edges: DataFrame) -> DataFrame:
    """node, in_degree: self-links count."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


def hubs(edges: DataFrame, k: int = 10) -> DataFrame:
    return degree(edges).orderBy(F.desc("degree"), "node").limit(k)


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without any edge but to themselves: no out-edge and no in-edge of another node."""
    return nodes.select("node").join(degree(edges).select("node"), "node", "left_anti")


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in its own direction and in the other one."""
    names = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *names).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *names))


def untyped_neighbors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, n_seeds: how many distinct seeds a note is next to. A seed gives to all that it points to, other seeds too; a
    note that isn't a seed gets from all seeds that it points to."""
    out, back = _next_to(edges.select("src", "dst").distinct(), seeds)
    return out.unionByName(back).groupBy("node").agg(F.count("*").alias("n_seeds"))


def _next_to(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from a seed to another note, and from other notes to a seed: node is the one that is reached."""
    named = lambda c: seeds.select(F.col("node").alias(c)).distinct()
    out = edges.join(named("src"), "src", "left_semi").filter("src <> dst").withColumnRenamed("dst", "node")
    back = edges.join(named("src"), "src", "left_anti").join(named("dst"), "dst", "left_semi").withColumnRenamed("src", "node")
    return out, back.withColumnRenamed("dst", "src")


def typed_neighbors(edges: DataFrame, seeds: DataFrame, weights: dict[str, float], other: float = 0.5) -> DataFrame:
    """node, score: sum of edge type weights of a note that seeds point to, or that isn't a seed and points to one."""
    weight = F.lit(other)
    for verb, w in sorted(weights.items()):
        weight = F.when(F.col("type") == verb, F.lit(w)).otherwise(weight)
    out, back = _next_to(edges.select("src", "dst", "type"), seeds)
    return out.unionByName(back).withColumn("w", weight).groupBy("node").agg(F.round(F.sum("w"), 6).alias("score"))


def hops(edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """seed, src, dst, type, depth: the edges of paths of up to `depth` (1 to 4) steps that visit no node twice.

    Each level is a join of the paths so far with the edges; a path holds the nodes that it has seen."""
    if not 1 <= depth <= 4 or direction not in ("out", "in", "both"):
        raise ValueError("depth is 1 to 4, direction is out, in or both")
    own = edges.filter(F.col("type").isin(types)) if types else edges
    flipped = own.select(F.col("dst").alias("at"), F.col("src").alias("to"), "src", "dst", "type")
    steps = own.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "dst", "type")
    steps = {"out": steps, "in": flipped, "both": steps.unionByName(flipped)}[direction].distinct()
    paths = seeds.select(F.col("node").alias("seed"), F.col("node").alias("at"), F.array("node").alias("seen"))
    out = None
    for level in range(1, depth + 1):
        moved = paths.join(steps, "at")
        if level > 1:  # a seed's link to itself shows once
            moved = moved.filter(~F.array_contains("seen", F.col("to")))
        found = moved.select("seed", "src", "dst", "type", F.lit(level).alias("depth")).distinct()
        out = found if out is None else out.unionByName(found)
        paths = moved.filter(~F.array_contains("seen", F.col("to"))).select("seed", F.col("to").alias("at"), F.concat("seen", F.array("to")).alias("seen")).distinct()
    return out


def superseded(edges: DataFrame, nodes: DataFrame, verb: str = "supersedes") -> DataFrame:
    """old, new: of the nodes given, those that another one of them supersedes; the smallest such node."""
    own = edges.filter((F.col("type") == verb) & (F.col("src") != F.col("dst")))
    own = own.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return own.groupBy(F.col("dst").alias("old")).agg(F.min("src").alias("new"))


def demote_superseded(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, id, rank: each old id moves right behind its new one if that ranks below it, pair after pair in order of
    the old ids' ranks; pairs that supersede each other stay. pairs: old, new. A query's whole ranking is looked at."""
    mutual = pairs.alias("p").join(pairs.select(F.col("old").alias("n"), F.col("new").alias("o")), (F.col("new") == F.col("n")) & (F.col("old") == F.col("o")), "left_anti")
    rows = ranked.join(mutual.select(F.col("old").alias("id"), "new"), "id", "left")

    def move(pdf):
        first = pdf.sort_values(["rank", "id"])
        # a place behind another is that place and a number, smaller for what came later
        place = {i: (n,) for n, i in enumerate(first["id"].drop_duplicates())}
        for turn, (old, new) in enumerate(first.dropna(subset=["new"])[["id", "new"]].itertuples(index=False)):
            if new in place and place[old] < place[new]:
                place[old] = (*place[new], -turn)
        order = {i: n + 1 for n, i in enumerate(sorted(place, key=place.get))}
        out = pdf[["query_id", "id"]].drop_duplicates().copy()
        out["rank"] = [order[i] for i in out["id"]]
        return out

    return rows.groupBy("query_id").applyInPandas(move, f"query_id {ranked.schema['query_id'].dataType.simpleString()}, id {ranked.schema['id'].dataType.simpleString()}, rank int")


def full_graph(edges: DataFrame, limit: int = 500) -> DataFrame:
    return edges.select("src", "dst", "type").distinct().orderBy("src", "dst", "type").limit(limit)


def genealogy(tree: DataFrame) -> DataFrame:
    """id, parent, label → id, level, line: an indented tree of any depth, depth first by id; sort by `way`. What no root
    leads to, as in a ring, isn't told. Each level is written once, so none is computed again."""
    folder, n, out = session.work_folder(tree.sparkSession, "genealogy"), 0, None
    text = F.col("id").cast("string")
    name = F.lpad(text, F.greatest(F.lit(20), F.length(text)), F.lit("0"))
    level = tree.filter(F.col("parent").isNull()).select("id", "label", F.lit(0).alias("level"), name.alias("way"))
    while True:
        path = f"{folder}/level={n}"
        level.write.parquet(path)
        level, n = tree.sparkSession.read.schema(level.schema).parquet(path), n + 1
        if out is not None and level.isEmpty():
            break
        out = level if out is None else out.unionByName(level)
        above = level.select(F.col("id").alias("parent"), F.col("way").alias("above"))
        level = tree.join(above, "parent").select("id", "label", F.lit(n).alias("level"), F.concat_ws("/", "above", name).alias("way"))
    return out.withColumn("line", F.concat(F.expr("repeat('  ', level)"), F.lit("- "), F.col("label")))


def label_titles(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """node, title: a note's title, else its stem."""
    return nodes.join(notes.select(F.col("path").alias("node"), "title"), "node", "left").select("node", F.coalesce(F.nullif(F.trim("title"), F.lit("")), stem(F.col("node"))).alias("title"))


