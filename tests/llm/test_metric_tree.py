import math
import random

import numpy as np
import pyarrow as pa
import pytest

from mnemolake.llm import metric_tree, queries


def by_hand(vectors, asked, k):
    """Rows of (id, components) against rows, in plain integers."""
    scale = lambda rows: [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, pool = [], scale(vectors)
    for i, q in scale(asked):
        own, rows = False, []
        for j, v in pool:
            if len(v) != len(q):
                continue
            if not own and (j, v) == (i, q):
                own = True
                continue
            rows.append((-sum(a * b for a, b in zip(q, v)), j))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(rows)[:k])]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, score string, h int, v double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, None) for i, v in rows], SCHEMA)


def found(spark, vectors, asked, k=10):
    return sorted(tuple(r) for r in metric_tree.top_k(frame(spark, vectors), frame(spark, asked), k).collect())


@pytest.fixture
def small_trees(monkeypatch):
    for name, n in (("TREE", 40), ("LEAF", 4), ("FAN", 3), ("BLOCK", 16)):
        monkeypatch.setattr(metric_tree, name, n)


def test_clusters_copies_and_ties_against_all_products(spark, small_trees):
    dice = random.Random(1)
    centres = [[dice.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + dice.gauss(0, 0.1) for c in dice.choice(centres)]) for i in range(500)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(150)] + [(3000 + i, [0.0] * 6) for i in range(30)]
    rows += [(5000 + i, [7.0 * x for x in rows[i][1]]) for i in range(20)]
    dice.shuffle(rows)
    asked = [r for r in rows if r[0] % 10 == 0]
    assert found(spark, rows, asked) == by_hand(rows, asked, 10)
    assert found(spark, rows, asked[:20], 3) == by_hand(rows, asked[:20], 3)


def test_odd_rows(spark, small_trees):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [0.5, 0.25]), (3, None), (None, [1.0, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]), (6, [nan, 0.0]), (7, []), (8, []), (9, [1.0]), (100, [-0.3, 0.7]), (-5, [1e-9, -1e-9])]
    assert found(spark, rows, rows) == by_hand(rows, rows, 10)
    assert found(spark, rows, rows, 1) == by_hand(rows, rows, 1)
    assert found(spark, rows, []) == [] and found(spark, [], rows) == [] and found(spark, rows[:1], rows[:1]) == []


def test_scores_beyond_the_integers_of_doubles(spark, small_trees):
    dice = random.Random(4)
    rows = [(i, [float(dice.randint(-(2**20), 2**20)) + 1 / 1024 for _ in range(3)]) for i in range(120)]
    assert found(spark, rows, rows[:30]) == by_hand(rows, rows[:30], 10)
    assert max(abs(r[3]) for r in by_hand(rows, rows[:30], 10)) > 2**53


def test_bounds_avoid_computations_and_hold(small_trees):
    dice = np.random.default_rng(2)
    v = (np.repeat(dice.normal(size=(12, 5)), 40, 0) * 1000 + dice.normal(size=(480, 5)) * 10).astype(np.int64)
    space = metric_tree.Space(float((v.astype(float) ** 2).sum(1).max()))
    page, child, row, dist, radius = zip(*metric_tree._pages(v, space))
    leaves = [r for c, r in zip(child, row) if c < 0]
    assert sorted(leaves) == list(range(480))
    entries = pa.table({"page": pa.array(page, pa.int32()), "child": pa.array(child, pa.int32()), "id": pa.array(row, pa.int64()), "v": pa.array(v[list(row)].tolist(), pa.list_(pa.int64())), "dist": pa.array(dist), "radius": pa.array(radius)})
    tree = metric_tree.Tree(entries, space)
    below: dict[int, list[int]] = {}
    for p, c, r in sorted(zip(page, child, row), reverse=True):  # a page's children have larger numbers
        below.setdefault(p, []).extend([r] if c < 0 else below[c])
    for p, c, r, d, far in zip(page, child, row, dist, radius):
        if c >= 0:  # a covering radius covers all below
            assert space.between(v[below[c]], v[[r]]).max() <= far + space.slack(5)
    for i in range(0, 480, 7):
        scores = v @ v[i]
        want = sorted(zip((-scores).tolist(), range(480)))[:5]
        assert [(-s, j) for j, s in tree.search(v[i], 5)] == want
        least = -want[2][0]
        assert [(-s, j) for j, s in tree.search(v[i], 5, least)] == [w for w in sorted(zip((-scores).tolist(), range(480))) if -w[0] >= least][:5]
    assert tree.computed < 0.4 * 480 * 2 * len(range(0, 480, 7))


def test_query_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13_exact_top_k(spark, folder).collect())
    assert got == by_hand(rows, [r for r in rows if r[0] % 100 == 0], 10)
