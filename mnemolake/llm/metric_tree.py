"""Exact search for the largest inner products with an M-tree: paged metric nodes, searched best first.

Vectors get one more component, which brings all of them to the length R of the longest one. Among points of one length
the largest inner product with a query is the smallest distance to it (the query's own added component is 0), so a metric
tree answers: the distance of q and x follows from the integer <q, x> as sqrt(|q|^2 + R^2 - 2 <q, x>).

The tree's upper level is a directory of at most PIVOTS vectors of the table, taken by hash, with covering radii; each
vector goes to the nearest. What one of them covers is dealt by hash into trees of about TREE vectors, so a dense region
makes more trees, not larger ones. A tree is built in one task, as rows of a table: an entry of a page has its distance to
the page's own vector, and, if it leads to another page, that page's vector and covering radius.

A search visits pages in order of the least distance that anything below can have. It leaves out an entry without
computing its distance where | d(q, page) - d(page, entry) | - radius, both of them stored or known, is beyond what has
been found already. A query first searches one tree of its nearest pivot, which bounds what follows; then all trees that
the bound leaves. Queries meet trees in blocks by a shuffle: neither side passes through the driver.

Equal vectors are told apart by their ids only: the k + 1 smallest ids of each vector stay, cut before the shuffle, and
equal queries are searched once. All comparisons of distances leave room for rounding; scores are exact integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import materialize, small_batches

#: Vectors in the directory at most, in a tree, in a leaf page, entries of an inner page, queries of a block.
PIVOTS, TREE, LEAF, FAN, BLOCK = 256, 4096, 64, 16, 2048
ENTRIES = "pivot long, salt long, page int, child int, id long, v array<long>, dist double, radius double"
ASKS = "pivot long, salt long, part long, q long, v array<long>, least long"
FOUND = "q long, id long, score long"


def scaled(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id and v, the components times `scale`, rounded down. Rows without id, without vector or with a component that is
    null or not finite go."""
    there = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & there)
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return kept.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each size of vector, and their vectors as a matrix of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[offsets[rows][:, None] + np.arange(size)].reshape(len(rows), int(size))


class Space:
    """Distances between vectors that an added component brings to one length."""

    def __init__(self, longest: float) -> None:
        self.square = float(longest)  # of the longest vector's length
        self.exact = self.square < 2.0**52  # then no partial sum of a product leaves the doubles' integers

    def slack(self, size: int, own: float = 0.0) -> float:
        """More than rounding can change a distance."""
        return 4 * np.sqrt((size + 8) * 2.0**-52 * (self.square + own))

    def added(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.square - np.square(v.astype(np.float64)).sum(1)))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows of the table, all of a to all of b."""
        product = a.astype(np.float64) @ b.astype(np.float64).T + self.added(a)[:, None] * self.added(b)[None, :]
        return np.sqrt(np.maximum(0.0, 2 * self.square - 2 * product))

    def scores(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer inner products; in 64-bit integers where doubles could round, right as far as a score fits in those."""
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if self.exact and np.square(q.astype(np.float64)).sum() <= self.square else v @ q

    def to_query(self, scores, own: float):
        """Distances to a query with the square length `own`, from its scores."""
        return np.sqrt(np.maximum(0.0, own + self.square - 2.0 * scores))


def _pages(v: np.ndarray, space: Space) -> Iterator[tuple[int, int, int, float, float]]:
    """Entries (page, child or -1, row, distance to the page's vector, radius) of a tree over the rows of v. Page -1 holds
    the root's entry only."""
    centre = int(np.argmax(v.astype(np.float64) @ v.astype(np.float64).mean(0)))
    todo, pages = [(0, centre, np.arange(len(v)))], 1
    yield -1, 0, centre, 0.0, float(space.between(v, v[[centre]]).max())
    while todo:
        page, centre, rows = todo.pop()
        if len(rows) <= LEAF:
            yield from ((page, -1, int(r), float(d), 0.0) for r, d in zip(rows, space.between(v[rows], v[[centre]])[:, 0]))
            continue
        heads = rows[np.linspace(0, len(rows) - 1, min(FAN, -(-len(rows) // LEAF))).astype(int)]
        apart = space.between(v[rows], v[heads])
        nearest = apart.argmin(1)
        if np.bincount(nearest).max() > 0.9 * len(rows):  # too alike to be told apart by distance
            nearest = np.arange(len(rows)) * len(heads) // len(rows)
        home = space.between(v[heads], v[[centre]])[:, 0]
        for i, head in enumerate(heads.tolist()):
            own = nearest == i
            if own.any():
                yield page, pages, head, float(home[i]), float(apart[own, i].max())
                todo.append((pages, head, rows[own]))
                pages += 1


class Tree:
    """A tree's pages, from its rows of the table."""

    def __init__(self, entries: pa.Table, space: Space) -> None:
        order = np.argsort(entries.column("page").to_numpy(), kind="stable")
        (_, v), = _by_size(entries.column("v"))
        page, self.child, self.id, self.dist, self.radius = (entries.column(c).to_numpy()[order] for c in ("page", "child", "id", "dist", "radius"))
        self.v, self.space = v[order], space
        self.floats = self.v.astype(np.float64) if space.exact else None
        self.begin = np.searchsorted(page, np.arange(-1, int(page[-1]) + 2))
        self.computed = 0

    def _scores(self, at: np.ndarray, q: np.ndarray, floats: bool) -> np.ndarray:
        self.computed += len(at)
        return (self.floats[at] @ q).astype(np.int64) if floats else self.v[at] @ q

    def search(self, q: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """(id, score) of the k largest scores, ties by id; with `least`, only such as can be among k rows of which others
        have that score already."""
        own = float(np.square(q.astype(np.float64)).sum())
        slack = self.space.slack(len(q), own)
        floats = self.floats is not None and own <= self.space.square
        q = q.astype(np.float64) if floats else q
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        far = np.inf if least is None else float(self.space.to_query(least, own)) + slack
        root = float(self.space.to_query(self._scores(np.array([0]), q, floats), own)[0])
        heap = [(max(0.0, root - float(self.radius[0])), 0, root)]
        while heap:
            low, page, home = heapq.heappop(heap)
            if low > far:
                break
            at = np.arange(self.begin[page + 1], self.begin[page + 2])
            at = at[np.abs(home - self.dist[at]) - self.radius[at] <= far + slack]
            if not len(at):
                continue
            scores = self._scores(at, q, floats)
            away = self.space.to_query(scores, own)
            if self.child[at[0]] >= 0:
                lows = np.maximum(0.0, away - self.radius[at])
                for i in np.flatnonzero(lows <= far):
                    heapq.heappush(heap, (float(lows[i]), int(self.child[at[i]]), float(away[i])))
                continue
            if least is not None:
                at, scores = at[scores >= least], scores[scores >= least]
            if len(best) == k and (not len(at) or scores.max() < best[-1]):
                continue
            best, best_id = np.concatenate([best, scores]), np.concatenate([best_id, self.id[at]])
            order = np.lexsort((best_id, -best))[:k]
            best, best_id = best[order], best_id[order]
            if len(best) == k:
                far = min(far, float(self.space.to_query(best[-1], own)) + slack)
        return list(zip(best_id.tolist(), best.tolist()))


class Directory:
    """The upper level: vectors of the table with radii, and the number of trees below each."""

    def __init__(self, vectors: list[list[int]], space: Space) -> None:
        self.space = space
        self.at: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            self.at.setdefault(len(v), []).append(i)
        self.v = {size: np.array([vectors[i] for i in own], np.int64).reshape(len(own), size) for size, own in self.at.items()}
        self.radius: dict[int, float] = {}
        self.trees: dict[int, int] = {}

    def nearest(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pivot and distance of each row; vectors of a size that no pivot has share the pivot -1 - size, at no distance."""
        pivot, away = np.zeros(len(column), np.int64), np.zeros(len(column))
        for rows, v in _by_size(column):
            size = v.shape[1]
            if size in self.v:
                apart = self.space.between(v, self.v[size])
                pivot[rows], away[rows] = np.array(self.at[size])[apart.argmin(1)], apart.min(1)
            else:
                pivot[rows] = -1 - size
        return pivot, away

    def lows(self, q: np.ndarray, own: float) -> list[tuple[float, float, int]]:
        """Least distance below each pivot with q's size, the pivot's own distance, the pivot; nearest first."""
        size = len(q)
        other = [(0.0, 0.0, -1 - size)] if -1 - size in self.trees else []
        if size not in self.v:
            return other
        away = self.space.to_query(self.space.scores(self.v[size], q), own)
        there = [(max(0.0, float(d) - self.radius[p]), float(d), p) for d, p in zip(away, self.at[size]) if p in self.trees]
        return sorted([*there, *other])


def _blocks(asks: DataFrame, entries: DataFrame, space: Space, k: int) -> DataFrame:
    """FOUND: what each query finds in each tree that it asks."""
    keys = ["pivot", "salt", "part"]

    def run(tree: pa.Table, block: pa.Table) -> pa.Table:
        q, ids, scores = [], [], []
        if tree.num_rows and block.num_rows:
            own = Tree(tree, space)
            (rows, vectors), = _by_size(block.column("v"))
            names, least = block.column("q").to_pylist(), block.column("least").to_pylist()
            for row, vector in zip(rows.tolist(), vectors):
                for i, s in own.search(vector, k, least[row]):
                    q.append(names[row])
                    ids.append(i)
                    scores.append(s)
        return pa.table({"q": pa.array(q, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    asks = materialize(asks, "metric-asks")
    wanted = entries.join(asks.select(*(F.col(c).alias(c) for c in keys)).distinct(), ["pivot", "salt"])
    return wanted.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(run, FOUND)


def _ask(queries: DataFrame, directory: Directory, parts: int, first: bool) -> DataFrame:
    """ASKS: for each query its first tree, or all others that its bound `least` leaves."""
    space = directory.space

    def run(batches):
        for batch in batches:
            out = []
            for q, v, least, turn in zip(*(batch.column(i).to_pylist() for i in range(4))):
                vector = np.array(v, np.int64)
                own = float(np.square(vector.astype(np.float64)).sum())
                lows = directory.lows(vector, own)
                if not lows:
                    continue
                home = min((d, p) for _, d, p in lows)[1]
                chosen, part = turn % directory.trees[home], turn % parts
                if first:
                    out.append((home, chosen, part, q, v, None))
                    continue
                slack = space.slack(len(v), own)
                far = np.inf if least is None else float(space.to_query(least, own)) + 2 * slack
                out += [(p, s, part, q, v, least) for low, _, p in lows if low <= far for s in range(directory.trees[p]) if (p, s) != (home, chosen)]
                if len(out) >= BLOCK:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    turn = F.pmod(F.xxhash64("q"), F.lit(1 << 40)).alias("turn")
    return queries.select("q", "v", "least", turn).mapInArrow(run, ASKS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    pivot, salt, part, q, v, least = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(pivot, pa.int64()), pa.array(salt, pa.int64()), pa.array(part, pa.int64()), pa.array(q, pa.int64()), pa.array(v, pa.list_(pa.int64())), pa.array(least, pa.int64())], ["pivot", "salt", "part", "q", "v", "least"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def build(candidates: DataFrame) -> tuple[DataFrame, Directory]:
    """The tree over id and v: its entries as a table, and the directory above. Pivots are PIVOTS rows at most, one for
    each TREE rows, those with the smallest hashes; every row is in the tree."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = candidates.agg(F.count("*"), F.coalesce(F.max(length), F.lit(0.0))).first()
    space, count = Space(longest), min(PIVOTS, -(-n // TREE))
    # four times the share that is needed, so that hashes below it are enough but for a chance of no weight; 64 at least
    share = min(1.0, max(64, 4 * count) / max(1, n))
    few = candidates.withColumn("h", F.pmod(F.xxhash64("v", "id"), F.lit(1 << 40))).filter(F.col("h") <= int(share * (1 << 40)))
    directory = Directory([r.v for r in few.orderBy("h", "id").limit(max(1, count)).collect()], space)

    def assign(batches):
        for batch in batches:
            pivot, away = directory.nearest(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(away), batch.column(0), batch.column(1)], ["pivot", "away", "id", "v"])

    placed = candidates.select("id", "v").mapInArrow(assign, "pivot long, away double, id long, v array<long>")
    for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():
        directory.radius[r.pivot], directory.trees[r.pivot] = r.radius, -(-r.n // TREE)
    trees = F.create_map(*(F.lit(x) for pair in directory.trees.items() for x in pair)) if directory.trees else F.create_map(F.lit(0), F.lit(1))

    def grow(group: pa.Table) -> pa.Table:
        (_, v), = _by_size(group.column("v"))
        page, child, row, dist, radius = zip(*_pages(v, space))
        taken = group.take(pa.array(row))
        return pa.table({"pivot": taken.column("pivot"), "salt": taken.column("salt"), "page": pa.array(page, pa.int32()), "child": pa.array(child, pa.int32()), "id": taken.column("id"), "v": taken.column("v"), "dist": pa.array(dist), "radius": pa.array(radius)})

    salted = placed.withColumn("salt", F.pmod(F.xxhash64("id"), trees[F.col("pivot")].cast("long")))
    return salted.drop("away").groupBy("pivot", "salt").applyInArrow(grow, ENTRIES), directory


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of `queries` the k rows of `vectors` with the largest inner
    product of components times `scale`, rounded down; ties to the smaller vec_id. All, if there are fewer.

    A query's own row, one row of its id and vector, isn't a candidate. Rows count, not ids: a row that is there twice is
    a candidate twice, for its twin too, and answers twice as a query. Rows of a null id, of a null vector or with a
    component that is null or not finite take no part on either side; a vector meets those of its own size only (vectors
    without components score 0). Other columns don't matter. An empty table of either kind gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    same = Window.partitionBy("h", "v").orderBy("id")
    rows = scaled(vectors, id_col, vec_col, scale).withColumn("h", F.xxhash64("v"))
    candidates = materialize(rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).select("id", "v"), "metric-rows")
    entries, directory = build(candidates)
    entries = materialize(entries, "metric-pages")

    asked = scaled(queries, id_col, vec_col, scale).withColumn("h", F.xxhash64("v"))
    once = materialize(asked.groupBy("h", "v").agg(F.min("id").alias("q")), "metric-queries")
    parts = max(1, -(-once.count() // BLOCK))
    first = materialize(_ranked(_blocks(_ask(once.withColumn("least", F.lit(None).cast("long")), directory, parts, True), entries, directory.space, k + 1), k + 1).drop("place"), "metric-first")
    bounds = first.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
    rest = _blocks(_ask(once.join(bounds, "q", "left"), directory, parts, False), entries, directory.space, k + 1)
    best = _ranked(first.unionByName(rest), k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("best"))
    return _told(asked.join(once, ["h", "v"]).join(best, "q"), k)


def _told(answered: DataFrame, k: int) -> DataFrame:
    """One row for each place, without the query's own row."""
    own = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.try_add(a, F.try_multiply(x, x)))
    mine = lambda x: (x["id"] == F.col("id")) & (x["score"] == own)
    place = F.coalesce(F.array_min(F.transform(F.filter("best", mine), lambda x: x["place"])), F.lit(0))
    others: Column = F.slice(F.filter(F.col("best"), lambda x: x["place"] != place), 1, k)
    out = answered.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
