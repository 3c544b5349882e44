"""Incremental indexing: snapshots against each other, upserts, deletions, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changes(index: DataFrame, disk: DataFrame, key: str = "path", *marks: str) -> DataFrame:
    """key, change: insert, update (marks differ), skip or remove."""
    same = F.lit(True)
    for m in marks:
        same = same & F.col(f"i.{m}").eqNullSafe(F.col(f"d.{m}"))
    both = index.select(key, *marks).alias("i").join(disk.select(key, *marks).alias("d"), F.col(f"i.{key}") == F.col(f"d.{key}"), "full_outer")
    change = F.when(F.col(f"i.{key}").isNull(), "insert").when(F.col(f"d.{key}").isNull(), "remove").when(same, "skip").otherwise("update")
    return both.select(F.coalesce(f"i.{key}", f"d.{key}").alias(key), change.alias("change"))


def apply_snapshot(current: DataFrame, incoming: DataFrame, key: str = "path", remove: DataFrame | None = None) -> DataFrame:
    """The table after an upsert: incoming rows replace rows of their key, keys in `remove` go."""
    kept = current.join(incoming.select(key), key, "left_anti")
    out = kept.unionByName(incoming)
    return out.join(remove.select(key), key, "left_anti") if remove is not None else out


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def export(notes: DataFrame, since: float | None = None, paths: list[str] | None = None, at: str = "mtime", key: str = "path") -> DataFrame:
    """Changed since a time, or named; all without either."""
    if since is None and paths is None:
        return notes
    wanted = F.lit(False)
    if since is not None:
        wanted = wanted | (F.col(at) >= since)
    if paths:
        wanted = wanted | F.col(key).isin(paths)
    return notes.filter(wanted)


def stale_chunks(chunks: DataFrame, manifest: DataFrame, key: str = "path", at: str = "mtime") -> DataFrame:
    """Keys all of whose chunks are older than the manifest says."""
    both = chunks.select(key, F.col(at).alias("_c")).join(manifest.select(key, F.col(at).alias("_m")), key)
    return both.groupBy(key).agg(F.every(F.col("_c") < F.col("_m")).alias("_all")).filter("_all").select(key)


def plan_resync(gaps: int, same_dimension: bool, limit: int = 200) -> str:
    """full after a change of the vectors' dimension or too many gaps, targeted with some, none without."""
    return "full" if not same_dimension or gaps > limit else "targeted" if gaps else "none"


def activity(changed: DataFrame, at: str, key: str = "path") -> DataFrame:
    """A log row for each change that isn't a skip."""
    return changed.filter("change <> 'skip'").select(F.lit(at).cast("timestamp").alias("at"), F.col(key).alias("path"), "change")


def assert_schema(df: DataFrame, **types: str) -> DataFrame:
    """Refuses a payload without the columns, or with other types."""
    have = dict(df.dtypes)
    wrong = {c: have.get(c) for c, t in types.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"unexpected columns: {wrong}")
    return df


def vector_dimension(df: DataFrame, vec: str = "vec") -> int:
    """The one dimension of a vector column."""
    sizes = [r[0] for r in df.filter(F.col(vec).isNotNull()).select(F.size(vec)).distinct().limit(2).collect()]
    if len(sizes) != 1 or sizes[0] <= 0:
        raise ValueError(f"vectors of one dimension are needed, not {sizes}")
    return sizes[0]


def upsert_pages(pages: DataFrame, key: str = "hash", at: str = "at") -> DataFrame:
    """One row a key: query and status of the first time, body of the last."""
    return pages.groupBy(key).agg(F.min_by("query", at).alias("query"), F.min_by("status", at).alias("status"), F.max_by("body", at).alias("body"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def uncovered(pages: DataFrame, covered: DataFrame, key: str = "hash") -> DataFrame:
    return pages.join(covered.select(key), key, "left_anti")
