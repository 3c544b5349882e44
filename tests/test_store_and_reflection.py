import pytest
from pyspark.sql import functions as F

from mnemolake.operators import crawl, evaluate, graph, notes, ranking, store
from mnemolake.sources import tables


def test_index_embeds_only_what_changed(spark):
    first = spark.createDataFrame([("a.md", 1.0, "# A\nalpha text here"), ("b.md", 1.0, "# B\nbeta text here")], "path string, mtime double, text string")
    none = spark.createDataFrame([], "path string, ordinal int, mtime double, embedder string, heading string, content string, vec array<float>")
    chunks = store.index_vectors(first, none)
    assert {r.path for r in chunks.collect()} == {"a.md", "b.md"} and store.has_any(chunks, "hashing-256") and not store.has_any(none)
    marked = chunks.withColumn("content", F.lit("kept as it was"))
    second = spark.createDataFrame([("a.md", 1.0, "# A\nalpha text here"), ("c.md", 2.0, "# C\ngamma")], "path string, mtime double, text string")
    got = {r.path: r for r in store.refresh(second, marked).collect()}
    assert set(got) == {"a.md", "c.md"} and got["a.md"].content == "kept as it was" and "gamma" in got["c.md"].content
    assert sorted(r.path for r in store.indexed_keys(chunks, "hashing-256").collect()) == ["a.md", "b.md"]
    with pytest.raises(ValueError):
        store.get_embedder("none")
    assert store.embedder_for("none") is None and store.embedder_for("hashing-256") is not None


def test_search_without_accents(spark):
    docs = spark.createDataFrame([(1, "La canción del río"), (2, "otra cosa")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cancion rio")], "query_id long, query string")
    assert [(r.doc_id, r.mode) for r in store.folded_search(docs, asked).collect()] == [(1, "and")]


def test_query_vectors_and_literals(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in rows.select(store.query_vector(F.col("v"))).collect()] == [None, [3.0, 4.0]]
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([float("nan")],)], "v array<double>").select(store.vector_literal(F.col("v"))).collect()


def test_neighbours_of_seeds(spark):
    """A seed that another seed points to counts, and so do notes that point to seeds."""
    edges = spark.createDataFrame([("s1", "s2", "uses"), ("s1", "s1", "uses"), ("x", "s1", "part_of"), ("x", "s2", "uses"), ("s2", "y", "uses"), ("s1", "y", "uses")], "src string, dst string, type string")
    seeds = spark.createDataFrame([("s1",), ("s2",)], "node string")
    assert {r.node: r.n_seeds for r in graph.untyped_neighbors(edges, seeds).collect()} == {"s2": 1, "x": 2, "y": 2}
    assert {r.node: r.score for r in graph.typed_neighbors(edges, seeds, {"part_of": 0.7, "uses": 0.5}).collect()} == {"s2": 0.5, "x": 1.2, "y": 1.0}


def test_vector_queries_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0], i % 2) for i in range(20)] + [(50, None, 0)], "id long, vec array<double>, label long")
    asked = rows.filter("id < 5").select(F.col("id").alias("query_id"), "vec")
    whole, cut = (sorted(map(tuple, ranking.vector_topk(rows, asked, 3, block=b).collect())) for b in (100, 2))
    assert whole == cut and len(whole) == 15 and all(r[2] == 1.0 for r in whole)
    near, blocks = (sorted(map(tuple, ranking.near_pairs(rows.select("id", "vec"), 0.999, b).collect())) for b in (100, 3))
    assert near == blocks and len(near) == 30


def test_vector_queries_of_odd_rows_and_any_ids(spark, monkeypatch):
    inf = float("inf")
    rows = [("b", [1.0, 0.0], "x"), ("a", [2.0, 0.0], "x"), ("c", [0.0, 1.0], None), ("d", None, "x"), ("e", [1.0, None], "x"), ("f", [inf, 1.0], "x"), ("g", [1.0], "y"), ("h", [], "y"), ("z", [0.0, 0.0], "y")]
    df = spark.createDataFrame(rows, "id string, vec array<double>, label string")
    asked = df.select(F.col("id").alias("query_id"), "vec")
    want = {("a", "a", 1.0), ("a", "b", 1.0), ("b", "a", 1.0), ("b", "b", 1.0), ("c", "c", 1.0), ("c", "a", 0.0), ("g", "g", 1.0), ("z", "a", 0.0), ("z", "b", 0.0)}
    for sent in (ranking.SENT_BYTES, 0):
        monkeypatch.setattr(ranking, "SENT_BYTES", sent)
        for b in (100, 1):
            assert {(r.query_id, r.id, r.score) for r in ranking.vector_topk(df, asked, 2, block=b).collect()} == want
    grouped = {(r.query_id, r.label, r.id) for r in ranking.vector_topk(df, asked.filter("query_id = 'b'"), group="label").collect()}
    assert grouped == {("b", "x", "a"), ("b", "y", "z"), ("b", None, "c")}
    assert ranking.vector_topk(df, asked.limit(0)).count() == 0 and ranking.vector_topk(df.limit(0), asked).count() == 0


def test_near_duplicates_block_by_block(spark):
    import random

    dice = random.Random(3)
    centres = [[dice.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    rows = [(f"g{i % 3}", i, 1000 - i, [c + dice.gauss(0, 0.15) for c in dice.choice(centres)]) for i in range(240)] + [("g0", 900, 5, None), ("g1", 901, 5, [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "group string, id long, rank int, vec array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = set()
    for g in ("g0", "g1", "g2"):
        stays = []
        for _, i, _, v in sorted((r for r in rows if r[0] == g and r[3] and None not in r[3]), key=lambda r: (r[2], r[1])):
            if all(cos(v, w) < 0.95 for w in stays):
                stays.append(v)
                want.add(i)
    for block in (4096, 17):
        assert {r.id for r in ranking.greedy_near_dup(df, 0.95, block).collect()} == want
    assert ranking.greedy_near_dup(df.limit(0)).count() == 0


def test_reflection_and_actions(spark):
    none = spark.createDataFrame([], "path string, line string")
    promotions = spark.createDataFrame([("a.md", "status: pending x")], "path string, line string")
    pairs = spark.createDataFrame([("a", "b", 0.95)], "a string, b string, score double")
    ages = spark.createDataFrame([("c.md", "hypothesis")], "path string, status string")
    activity = spark.createDataFrame([("tag", "spark", 3)], "kind string, value string, n long")
    found = notes.reflection(promotions, pairs, ages, activity)
    assert {(r.kind, r.key) for r in found.collect()} == {("promote", "a.md"), ("merge", "a"), ("verify", "c.md"), ("active tag", "spark")}
    assert notes.reflection_text(found).first().text.startswith("## active tag\n- spark: 3\n\n## merge\n- a: b")
    assert [r.action for r in notes.actions(promotions, none, ages, none).orderBy("position").collect()] == ["fix 1 broken links", "review 1 stale notes"]


def test_intervals_of_differences():
    low, high = evaluate.bootstrap_delta([5.0, 6.0, 7.0, 8.0], [1.0, 2.0, 3.0, 2.0], rounds=500)
    assert 2 < low < high < 7 and evaluate.bootstrap_delta([1.0], [1.0, 2.0])[0] != evaluate.bootstrap_delta([1.0], [1.0, 2.0])[0]


def test_invalid_bytes_in_notes(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# T\xff\nbody \xe4")
    assert tables.notes(spark, str(tmp_path)).first().text == "# T�\nbody �"


def test_leads_are_told_once(spark):
    found = spark.createDataFrame([("t", 1, " One  lead"), ("t", 2, "one lead"), ("t", 3, "Done"), ("t", 4, "two")], "topic string, position int, lead string")
    done = spark.createDataFrame([("t", "done")], "topic string, lead string")
    assert [r.lead for r in crawl.leads(found, done).orderBy("lead").collect()] == [" One  lead", "two"]


def draws_by_hand(seed):
    """The generator, one number after another."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t = (t ^ (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF))) & 0xFFFFFFFF
        yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296


def test_any_stretch_of_the_generator_and_intervals_by_hand(spark, monkeypatch):
    import itertools
    import random

    for seed in (1, 7, 4294967295):
        whole = list(itertools.islice(draws_by_hand(seed), 500))
        assert evaluate.mulberry32(seed, 0, 500).tolist() == whole and evaluate.mulberry32(seed, 123, 77).tolist() == whole[123:200]
    dice = random.Random(6)
    rows = [(g, s, float(dice.randint(0, 50))) for g in ("x", "y", None) for s in (0, 1, 2) for _ in range(dice.randint(2, 9))] + [("lone", 0, 1.0), ("lone", 1, 2.0), ("lone", 1, 3.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, side int, value double")
    monkeypatch.setattr(evaluate, "DRAWN", 64)

    def by_hand(sides, rounds):
        draw, stats = draws_by_hand(3), []
        for _ in range(rounds):
            means = [sum(s[int(next(draw) * len(s))] for _ in s) / len(s) for s in sides]
            stats.append(means[0] - (means[1] if len(means) > 1 else 0))
        stats.sort()
        return round(stats[int(0.025 * rounds)], 6), round(stats[min(rounds - 1, int(0.975 * rounds))], 6)

    got = {r.g: (r.n, r.low, r.high) for r in evaluate.bootstrap_ci(df, "g", "value", 3, 600).collect()}
    own = {g: sorted(v for h, _, v in rows if h == g and v is not None) for g in ("x", "y", None, "lone")}
    assert got == {g: (len(v), *by_hand([v], 600)) for g, v in own.items()}
    told = {r.g: (r.n_a, r.n_b, r.low, r.high) for r in evaluate.bootstrap_delta_ci(df, "g", "side", "value", 0, 1, 3, 600).collect()}
    for g in ("x", "y", None):
        a, b = (sorted(v for h, s, v in rows if (h, s) == (g, i)) for i in (0, 1))
        assert told[g] == (len(a), len(b), *by_hand([a, b], 600))
    assert told["lone"] == (1, 2, None, None) and told["none"] == (0, 0, None, None)
