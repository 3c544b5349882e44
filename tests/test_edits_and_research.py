import pytest
from pyspark.sql import functions as F

from mnemolake.operators import notes
from mnemolake.plans import search


def edited(spark, texts, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    return [(r.text, r.refused, r.not_found) for r in notes.edit_front_matter(df, **how).orderBy("k").collect()]


def test_front_matter_is_edited_line_by_line(spark):
    note = "---\nstatus: hypothesis # old\ntags:\n  - a\nother: 1\n---\nbody\nstatus: not me\n"
    got = edited(spark, [note, "body only", "---\r\nstatus: x\r\n---\r\nb\r\n", "", None, "---\n---\nb", "---\nno end"], set={"status": "confirmed", "last_verified": "2024-01-31"})
    assert got[0][0] == note.replace("status: hypothesis # old", "status: confirmed").replace("other: 1\n", "other: 1\nlast_verified: \"2024-01-31\"\n")
    block = '---\nstatus: confirmed\nlast_verified: "2024-01-31"\n---\n'
    assert got[1][0] == block + "body only"
    assert got[2][0] == '---\r\nstatus: confirmed\r\nlast_verified: "2024-01-31"\r\n---\r\nb\r\n'
    assert got[3][0] == got[4][0] == block and got[5][0] == block + "b" and got[6][0] == block + "---\nno end"
    assert all(r[1:] == ([], []) for r in got)


def test_removals_refusals_and_scalars(spark):
    got = edited(spark, ["---\na: 1\nb: 2\n---\nx", "---\na: 1\n---\nx", "---\na:\n  - 1\nb: 2\n---\nx", "x"], remove=("a", "c"))
    assert [r[0] for r in got] == ["---\nb: 2\n---\nx", "x", "---\na:\n  - 1\nb: 2\n---\nx", "x"]
    assert [r[1] for r in got] == [[], [], ["a"], []] and [r[2] for r in got] == [["c"], ["c"], ["c"], ["a", "c"]]
    values = {"n": 3, "x": 1.5, "t": True, "plain": "two words", "yes": "Yes", "num": "12", "odd": 'a: "b"', "empty": ""}
    (text, _, _), = edited(spark, ["x"], set=values)
    assert text == '---\nn: 3\nx: 1.5\nt: true\nplain: two words\nyes: "Yes"\nnum: "12"\nodd: "a: \\"b\\""\nempty: ""\n---\nx'
    (text, _, _), = edited(spark, ["x"], set={"k": F.col("k"), "same": F.upper("text"), "none": F.lit(None).cast("string")})
    assert text == "---\nk: 0\nsame: X\n---\nx"
    for bad in ({}, {"set": {"a b": 1}}, {"remove": ("x:",)}, {"set": {"a": ["list"]}}):
        with pytest.raises(ValueError):
            edited(spark, ["x"], **bad)


JUDGED = [("q", "a", 1, 9.0, None, [1.0, 0.0]), ("q", "b", 2, 9.0, None, [0.99, 0.05]), ("q", "c", 3, 2.0, None, [0.0, 1.0]), ("q", "d", 4, None, True, [0.0, 1.0]), ("q", "e", 5, None, None, None), ("q", "f", 6, 4.0, None, [0.7, 0.7]), ("p", "z", 1, 1.0, None, [1.0, 0.0])]


def test_judged_research(spark):
    df = spark.createDataFrame(JUDGED, "query_id string, key string, position int, relevance double, relevant boolean, vec array<double>")
    told = lambda **how: [(r.key, r.dropped) for r in search.judged_research(df, **how).orderBy("query_id", "rank").collect()]
    assert told() == [("a", 1), ("d", 1), ("f", 1), ("e", 1)]  # b repeats a, c and z are rejected
    assert told(near=None) == [("a", 1), ("b", 1), ("d", 1), ("f", 1), ("e", 1)]
    assert [k for k, _ in told(near=None, drop_below=0.0)] == ["z", "a", "b", "d", "f", "c", "e"]
    assert [k for k, _ in told(k=2)] == ["a", "d"]
    assert [k for k, _ in told(near=None, diversify=0.3, k=10)][:2] != ["a", "b"]
