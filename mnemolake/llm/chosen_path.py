"""N-gram Jaccard join by chosen paths.

A document is the set of its word shingles. Documents with equal sets are one class and go on as one representative. In
each run a set descends a tree: at a path it takes each of its shingles with probability 1 / (LEAST * size), decided by a
hash of path and shingle, so that sets at one path take the same shared shingles. Two sets of similarity LEAST share one
chosen shingle on average; a branching process tells how likely they meet at any depth, and the runs are repeated until
the target recall. Buckets (sets at one path) of up to BUCKET sets are compared pair by pair; larger ones are split by
going down. Sets that are still many at the last level are copies of one another or share a passage: all pairs of such a
bucket are compared, block against block in tasks of their own, by sketches and then by their sets; a pair is looked at
only under the smallest such path that it shares, and a task tells the number of links and the components it saw, not
the pairs. Other pairs pass one-bit minwise sketches, then the exact sets are compared. The work on a dense bucket grows
with the square of its different sets.

A class is a connected component of the links; n_links counts the links of a document's set to different sets.

Null and empty texts have no words: they are one class of equal (empty) sets. A text with fewer words than a shingle is
one shingle. Rows that repeat a doc_id are one document: its classes are joined. A null doc_id is a document for each
row; a class of such rows only has a null class_id. Equal sets are told by two independent fingerprints of 64 bits.
Shingles that many documents share cost each of them a few paths, whatever their number; very long texts are worked on
in slices. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import discard, id_and_text, map_batches, materialize, small_batches, string_buffers
from mnemolake.llm.words import U64, grams, mix, not_white, seeds, span_hashes, words

SHINGLE, LEAST, RECALL = 5, 0.8, 0.98
LEVELS, BUCKET = 3, 40
#: 64-bit words of a sketch; a pair passes from this many standard deviations below LEAST on.
SKETCH, SLACK = 4, 4.0
#: Documents to compare that may travel to all workers (40 bytes each); beyond that texts are shuffled by doc_id, once.
FEW = 1_000_000
#: Sets in a block of a bucket that is still large at the last level; a task holds two blocks.
BLOCK = 1024
#: Shingles that are worked on together.
SLICE = 1 << 14


def meets(levels: int, mean: float = 1.0) -> float:
    """How likely two sets that share `mean` chosen shingles at each path still meet at a level."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-mean * p)
    return p


def runs_for(recall: float, levels: int = LEVELS) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meets(levels)))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[tuple[np.ndarray, tuple[int, int]]]:
    """The distinct hashes of each text's shingles, sorted, and two fingerprints of the set."""
    offsets, data = string_buffers(column)
    start, end, h, first = words(offsets, data, not_white())
    other = span_hashes(data, start, end, 33)[0]
    g, g2, out = grams(h, size, 21), grams(other, size, 34), []
    for i, j in zip(first.tolist(), first[1:].tolist()):
        if j - i >= size:
            x, at = np.unique(g[i : j - size + 1], return_index=True)
            y = g2[i : j - size + 1][at]
        elif j > i:
            x, y = grams(h[i:j], j - i, 22), grams(other[i:j], j - i, 35)
        else:
            x = y = np.zeros(0, U64)
        out.append((x, tuple(int(mix(v).sum(dtype=U64).astype(np.int64)) for v in (x, y))))
    return out


def paths(x: np.ndarray, runs: int, levels: int = LEVELS, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path, parent and level of a set in all runs. A path takes the shingles whose product with the path's odd number is
    small, which all sets at the path agree on."""
    held, out = seeds(runs, 23), []
    most = U64(min((1 << 64) - 1, int((1 << 64) / (least * max(1, len(x))))))
    for level in range(1, levels + 1):
        told, found = mix(held), []
        for i in range(0, len(held), 256):
            for j in range(0, len(x), SLICE):
                at, which = np.nonzero(x[None, j : j + SLICE] * (told[i : i + 256] | U64(1))[:, None] <= most)
                found.append((at + i, which + j))
        at, which = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        fresh = mix(told[at] ^ x[which])
        out.append((fresh, held[at], np.full(len(at), level, np.int32)))
        held = fresh
    return tuple(np.concatenate(c) for c in zip(*out))


def sketch(x: np.ndarray, n: int = SKETCH) -> list[int]:
    """One bit of each of 64 * n minimum hashes, as 64-bit numbers."""
    if not len(x):
        return [0] * n
    low = np.full(64 * n, np.iinfo(np.uint64).max, np.uint64)
    constants = seeds(64 * n, 24)
    for at in range(0, 64 * n, 64):
        part = constants[at : at + 64, None]
        for j in range(0, len(x), SLICE):
            np.minimum(low[at : at + 64], (x[None, j : j + SLICE] * part).min(axis=1), out=low[at : at + 64])
    return [int(v) for v in np.packbits((mix(low) & U64(1)).astype(np.uint8)).view("<i8")]


_KEY = ["n", "fp", "fp2"]


def records(df: DataFrame, runs: int, levels: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, fp, fp2 (of the set), sketch, paths."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1))
        trails = [paths(x, runs, levels) for x, _ in sets]
        path, parent, level = (np.concatenate(c) for c in zip(*trails))
        each = pa.StructArray.from_arrays([pa.array(path.astype(np.int64)), pa.array(parent.astype(np.int64)), pa.array(level)], ["path", "parent", "level"])
        trails = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(t[0]) for t in trails)]), pa.int32()), each)
        own = [pa.array(c, pa.int64()) for c in ([len(x) for x, _ in sets], [p[0] for _, p in sets], [p[1] for _, p in sets])]
        return pa.RecordBatch.from_arrays([batch.column(0), *own, pa.array([sketch(x) for x, _ in sets], pa.list_(pa.int64())), trails], ["doc_id", *_KEY, "sketch", "paths"])

    return map_batches(id_and_text(df, id_col, text_col), run, "doc_id long, n long, fp long, fp2 long, sketch array<long>, paths array<struct<path:long,parent:long,level:int>>")


def most_bits(least: float) -> float:
    """Bits in which the sketches of a pair may differ."""
    share = (1 + least) / 2
    return 64 * SKETCH * (1 - share + SLACK * math.sqrt(share * (1 - share) / (64 * SKETCH)))


def _linked(group: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a group of two blocks (or of one with itself) that have links, how many, and the row that names their
    component. Only pairs without a smaller common path count."""
    path, same = group.column("path")[0].as_py(), group.column("i")[0] == group.column("j")[0]
    own, n = group.column("own").to_numpy(), group.column("n").to_numpy()
    left = np.flatnonzero(own == group.column("i")[0].as_py())
    right = left if same else np.flatnonzero(own == group.column("j")[0].as_py())
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right):
        return none, none, none
    marks = np.array(group.column("sketch").to_pylist(), np.int64).view(U64)
    dense = group.column("dense").combine_chunks()
    flat, of = dense.values.to_numpy(), np.repeat(np.arange(len(n)), np.diff(dense.offsets.to_numpy()))
    smaller, number = np.unique(flat[flat < path], return_inverse=True)
    has = np.zeros((len(n), len(smaller)), np.float32)
    has[of[flat < path], number] = 1
    like = np.zeros((len(left), len(right)), bool)
    most = most_bits(least)
    for at in range(0, len(left), 64):
        x = left[at : at + 64]
        near = np.minimum(n[x][:, None], n[right]) >= least * np.maximum(n[x][:, None], n[right])
        near &= np.bitwise_count(marks[x][:, None, :] ^ marks[right]).sum(axis=2) <= most
        if len(smaller):
            near &= has[x] @ has[right].T == 0
        like[at : at + 64] = near
    if same:
        like &= np.arange(len(left))[:, None] < np.arange(len(right))
    rows, columns = like.any(axis=1), like.any(axis=0)
    if not rows.any():
        return none, none, none
    left, right, like = left[rows], right[columns], like[np.ix_(rows, columns)]
    sets = group.column("elements").to_pylist()
    a, b = ([np.frombuffer(sets[i], U64) for i in side] for side in (left.tolist(), right.tolist()))
    both = np.zeros(like.shape, np.float32)
    _, number, count = np.unique(np.concatenate(a + b), return_inverse=True, return_counts=True)
    shared = count > 1  # what only one set has is in no intersection
    column = (np.cumsum(shared) - 1)[number]
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    row, column = row[shared[number]], column[shared[number]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(a) + len(b), 4096), np.float32)
        m[row[i:j], column[i:j] - at] = 1
        both += m[: len(a)] @ m[len(a) :].T
    like &= both >= least * (n[left][:, None] + n[right] - both)
    links = np.zeros(len(n), np.int64)
    np.add.at(links, left, like.sum(axis=1))
    np.add.at(links, right, like.sum(axis=0))
    label = np.arange(len(n))
    while True:
        was = label.copy()
        low = np.where(like, label[left][:, None], len(n)).min(axis=0)
        np.minimum.at(label, right, low)
        low = np.where(like, label[right], len(n)).min(axis=1)
        np.minimum.at(label, left, low)
        if (was == label).all():
            break
    some = np.flatnonzero(links)
    return some, links[some], label[some]


def dense_links(members: DataFrame, least: float) -> DataFrame:
    """node, links, label: what the blocks of large buckets see. members: path, size (of the bucket), node, n, sketch,
    dense (all such paths of the node), elements."""
    cut = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "sketch", "dense", "elements")

    def compare(group: pa.Table) -> pa.Table:
        some, links, label = _linked(group, least)
        node = group.column("node").to_numpy()
        return pa.table({"node": node[some], "links": links, "label": node[label]})

    return met.groupBy("path", "i", "j").applyInArrow(compare, "node long, links long, label long")


def candidates(rows: DataFrame, sets: DataFrame, levels: int, bucket: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """a < b: pairs of nodes that some small bucket brings together; the members of buckets that are still large at the
    last level (path, size, node); and a table that both are made from. rows: node, n, path, parent, level."""
    sizes = materialize(rows.groupBy("path").agg(F.count("*").alias("size"), F.max("level").alias("level")).filter("size > 1"), "buckets")
    large = sizes.filter(F.col("size") > bucket)
    below = rows.filter("level > 1").join(large.select(F.col("path").alias("parent")), "parent", "left_semi")
    live = rows.filter("level = 1").unionByName(below)
    small = live.join(sizes.filter(F.col("size") <= bucket).select("path"), "path")
    alike = lambda m, n: F.least(m, n) >= least * F.greatest(m, n)
    # at most `bucket` entries
    own = small.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("own"))
    two = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["n"].alias("m"), y["n"].alias("n")))))
    pairs = own.select(F.explode(F.filter(two, lambda t: alike(t["m"], t["n"]))).alias("t")).select("t.a", "t.b").filter("a < b").distinct()
    last = live.filter(F.col("level") == levels).select("path", "node").join(large.filter(F.col("level") == levels).select("path", "size"), "path").distinct()
    bits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    marks = lambda node, mark: sets.select(F.col("node").alias(node), F.col("sketch").alias(mark))
    near = pairs.join(marks("a", "sa"), "a").join(marks("b", "sb"), "b").filter(bits <= most_bits(least)).select("a", "b")
    return near, last, sizes


def elements_of(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, elements (the exact set) of the wanted (node, doc_id, fp, fp2)."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shingle_sets(batch.column(1))
        prints = [pa.array([p[i] for _, p in found], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *prints, pa.array([x.tobytes() for x, _ in found], pa.binary())], ["doc_id", "fp", "fp2", "elements"])

    schema = "doc_id long, fp long, fp2 long, elements binary"
    texts = id_and_text(df, id_col, text_col)
    ids = wanted.filter("doc_id is not null").select("doc_id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= FEW else ids.hint("shuffle_hash")
    named = map_batches(texts.join(ids, "doc_id", "left_semi"), of, schema).join(wanted, ["doc_id", "fp", "fp2"]).select("node", "elements")
    nameless = map_batches(texts.filter("doc_id is null"), of, schema).join(wanted.filter("doc_id is null").drop("doc_id"), ["fp", "fp2"]).select("node", "elements")
    return named.unionByName(nameless).dropDuplicates(["node"])


def links(near: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs whose exact sets are similar enough."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, x, y = (c.to_pylist() for c in batch.columns)
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, U64), np.frombuffer(q, U64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= least * (len(p) + len(q) - both))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out)], ["a", "b", "similar"])

    with_both = near.join(whole.select(F.col("node").alias("a"), F.col("elements").alias("xa")), "a").join(whole.select(F.col("node").alias("b"), F.col("elements").alias("xb")), "b")
    return map_batches(with_both.select("a", "b", "xa", "xb"), compare, "a long, b long, similar boolean").filter("similar").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component. edges: a, b. Labels spread to neighbours and then jump to their
    labels' labels, so the rounds grow with the logarithm of a component's width."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        spread = materialize(labels.join(told, F.col("node") == F.col("a")).select("node", F.least("label", "low").alias("label"), F.col("label").alias("was")), "labels-spread")
        jump = spread.join(spread.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        labels = materialize(jump.select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was"), "labels")
        if labels.filter("label != was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_classes(df: DataFrame, least: float = LEAST, recall: float = RECALL, levels: int = LEVELS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_links, n_shingles of every row."""
    small_batches(df.sparkSession)
    all_ = materialize(records(df, runs_for(recall, levels), levels, id_col, text_col).withColumn("node", F.monotonically_increasing_id()), "shingle-records")
    # a set's representative is the first row that has it
    groups = materialize(all_.groupBy(*_KEY).agg(F.min("node").alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("low")), "equal-sets")
    sets = materialize(all_.join(groups.select(F.col("rep").alias("node"), "low"), "node"), "representatives")
    ids = materialize(all_.select("doc_id", "node", *_KEY), "rows")
    discard(all_)
    rows = materialize(sets.filter("n > 0").select("node", "n", F.explode("paths").alias("p")).select("node", "n", "p.*"), "paths")
    near, last, sizes = candidates(rows, sets, levels, bucket, least)
    last = materialize(last, "large-buckets")
    near = materialize(near, "near-pairs")
    discard(rows, sizes)
    dense = materialize(last.groupBy("node").agg(F.collect_list("path").alias("dense")), "paths-of-large-buckets")  # at most a node's paths
    apart = near
    for end, name in (("a", "da"), ("b", "db")):
        apart = apart.join(dense.select(F.col("node").alias(end), F.col("dense").alias(name)), end, "left")
    # a pair that shares a large bucket is looked at there
    apart = materialize(apart.filter(~F.coalesce(F.arrays_overlap("da", "db"), F.lit(False))).select("a", "b"), "pairs")
    nodes = apart.select(F.explode(F.array("a", "b")).alias("node")).unionByName(dense.select("node")).distinct()
    wanted = materialize(ids.join(nodes, "node", "left_semi").select("node", "doc_id", "fp", "fp2"), "sets-to-compare")
    whole = materialize(elements_of(df, wanted, id_col, text_col), "elements")
    members = last.join(dense.join(sets.select("node", "n", "sketch"), "node").join(whole, "node"), "node")
    crowded = materialize(dense_links(members, least).groupBy("node", "label").agg(F.sum("links").alias("links")), "links-in-large-buckets")
    linked = materialize(links(apart, whole, least), "links")
    discard(whole, wanted, last, dense, near, apart)
    # rows that repeat a doc_id are one document
    rep_of = ids.join(groups.filter("copies > 1").select("rep", *_KEY), _KEY, "left").withColumn("rep", F.coalesce("rep", "node"))
    again = rep_of.filter("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("n")).filter("a < b")
    twice = rep_of.join(again.filter("n > 2").select("doc_id", F.col("a").alias("first")), "doc_id").filter("rep > first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    edges = linked.unionByName(crowded.filter("node != label").select(F.col("label").alias("a"), F.col("node").alias("b"))).unionByName(again.filter("n = 2").select("a", "b")).unionByName(twice).distinct()
    degree = linked.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).alias("n")).unionByName(crowded.select(F.col("node").alias("rep"), F.col("links").alias("n"))).groupBy("rep").agg(F.sum("n").alias("n_links"))
    labels = materialize(components(edges).select(F.col("node").alias("rep"), "label"), "components")
    lows = labels.join(groups.select("rep", "low"), "rep").groupBy("label").agg(F.min("low").alias("class_id"))
    classes = materialize(labels.join(lows, "label").join(degree, "rep", "left").select("rep", "class_id", F.lit(True).alias("classed"), "n_links"), "classes")
    # both sides are tables, so a join whose key has very many rows is split when it runs
    copies = groups.filter("copies > 1").select("rep", "low", *_KEY)
    own = ids.join(copies, _KEY, "left").withColumn("low", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("low"))).withColumn("rep", F.coalesce("rep", "node"))
    out = own.join(classes, "rep", "left")
    return out.select("doc_id", F.when(F.col("classed"), F.col("class_id")).otherwise(F.col("low")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
