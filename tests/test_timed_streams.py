import time
from datetime import datetime, timedelta

import pytest

from mnemolake.sources import growing
from mnemolake.streaming import feeds, timed

ZERO = datetime(2024, 1, 1)
at = lambda s: ZERO + timedelta(seconds=s)


@pytest.fixture
def rocks(spark):
    """A session of its own with the store that timers need."""
    own = spark.newSession()
    for k, v in timed.STORE.items():
        own.conf.set(k, v)
    return own


class Feed:
    """A folder that gets one file a batch, a query over it, and what the query has told so far."""

    def __init__(self, session, folder, schema, build, **writer):
        self.session, self.folder, self.schema = session, folder, schema
        session.createDataFrame([], schema).write.mode("overwrite").parquet(str(folder / "in"))
        stream = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        self.out, self.writer = build(stream), writer

    def put(self, rows):
        self.session.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def run(self, **trigger):
        return self.out.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "ck")).trigger(**(trigger or {"availableNow": True})).start()

    def told(self):
        try:
            return sorted((tuple(r) for r in self.session.read.parquet(str(self.folder / "out")).collect()), key=repr)
        except Exception:
            return []

    def step(self, rows):
        self.put(rows)
        self.run().awaitTermination()
        return self.told()


CHANGES = "path string, at timestamp"


def test_bursts_by_event_time(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, CHANGES, lambda s: timed.debounce(s.withWatermark("at", "0 seconds"), "path", quiet="2 seconds"))
    assert feed.step([("a", at(0)), ("a", at(1)), ("a", at(2.5)), ("b", at(2))]) == []
    # b's watermark-driven timer fires, a goes on after a restart
    assert feed.step([("a", at(3.5)), ("c", at(4.2))]) == [("b", 1, at(2), at(2))]
    got = feed.step([("a", at(9)), ("a", at(12)), ("z", at(60))])
    assert got == sorted([("b", 1, at(2), at(2)), ("a", 4, at(0), at(3.5)), ("c", 1, at(4.2), at(4.2)), ("a", 1, at(9), at(9)), ("a", 1, at(12), at(12))], key=repr)


def test_bursts_by_the_clock_survive_a_restart(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, CHANGES, lambda s: timed.debounce(s, "path", quiet="6 seconds", clock="processing"))
    feed.put([("a", at(0)), ("a", at(0)), ("b", at(0))])
    q = feed.run(processingTime="200 milliseconds")
    end = time.time() + 30
    while time.time() < end and (q.lastProgress is None or not any(p.numInputRows for p in q.recentProgress)):
        time.sleep(0.1)
    q.stop()  # before the six seconds are over
    early = feed.told()
    q = feed.run(processingTime="200 milliseconds")
    end = time.time() + 40
    while time.time() < end and len(feed.told()) < 2:
        time.sleep(0.3)
    assert [(r[0], r[1]) for r in feed.told()] == [("a", 2), ("b", 1)] and early == []
    feed.put([("a", at(1))])
    end = time.time() + 40
    while time.time() < end and len(feed.told()) < 3:
        time.sleep(0.3)
    q.stop()
    assert [(r[0], r[1]) for r in feed.told()] == [("a", 1), ("a", 2), ("b", 1)]


TRIES = "origin string, at timestamp, ok boolean"


def breaker(**how):
    return lambda s: timed.circuit_breaker(s.withWatermark("at", "0 seconds"), **how)


def test_breaker_opens_and_closes_by_time(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, TRIES, breaker(limit=3, cooldown="60 seconds"))
    got = feed.step([("foo", at(0), False), ("foo", at(1), False), ("bar", at(1), False), ("bar", at(2), True), ("bar", at(3), False)])
    assert got == sorted([("foo", at(0), False, True, 1, None), ("foo", at(1), False, True, 2, None), ("bar", at(1), False, True, 1, None), ("bar", at(2), True, True, 0, None), ("bar", at(3), False, True, 1, None)], key=repr)
    got = feed.step([("foo", at(4), None), ("foo", at(5), True), ("bar", at(6), True)])  # the third failure, then a refused attempt
    assert ("foo", at(4), False, True, 3, at(64)) in got and ("foo", at(5), True, False, 3, at(64)) in got
    got = feed.step([("new", at(70), True)])
    assert ("foo", at(64), None, None, 3, None) in got  # closed by time alone
    got = feed.step([("foo", at(71), False), ("foo", at(72), False)])  # failures stay counted, so one is enough
    assert ("foo", at(71), False, True, 4, at(131)) in got and ("foo", at(72), False, False, 4, at(131)) in got


def test_breaker_forgets_idle_keys(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, TRIES, breaker(limit=2, cooldown="1 second", forget="10 seconds"))
    feed.step([("foo", at(0), False)])
    feed.step([("bar", at(100), True)])
    got = feed.step([("foo", at(101), False), ("foo", at(102), True)])
    assert ("foo", at(101), False, True, 1, None) in got and len(got) == 4


ASKED = "host string, url string, body string, ok boolean, at timestamp"


def test_page_cache(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, ASKED, lambda s: timed.page_cache(s.withWatermark("at", "0 seconds"), ttl="5 seconds", most=2, keep="100 seconds"))
    told = lambda rows: {(r[2], (r[1] - ZERO).total_seconds()): (r[3], r[4]) for r in rows}
    got = told(feed.step([("h", "u1", "one", True, at(0)), ("h", "u1", "two", True, at(4)), ("h", "u2", None, True, at(1)), ("h", "u3", None, False, at(2))]))
    assert got == {("u1", 0): ("one", "fetched"), ("u1", 4): ("one", "cached"), ("u2", 1): (None, "fetched"), ("u3", 2): (None, "failed")}
    got = told(feed.step([("h", "u1", None, False, at(6)), ("h", "u2", "x", True, at(5.5)), ("h", "u3", "three", True, at(7)), ("h", "u1", None, False, at(8))]))
    assert got["u1", 6] == ("one", "stale") and got["u2", 5.5] == (None, "cached")  # an empty answer is remembered, too
    assert got["u3", 7] == ("three", "fetched") and got["u1", 8] == (None, "failed")  # u1 came first and went
    feed.step([("other", "u9", "nine", True, at(500))])
    got = told(feed.step([("h", "u3", None, False, at(501))]))
    assert got["u3", 501] == (None, "failed")  # beyond `keep` nothing is left


def test_lines_of_files_that_grow(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = growing.growing_lines(spark, str(folder), split=40)

    def step():
        n = len(list((tmp_path / "out").glob("*.parquet"))) if (tmp_path / "out").exists() else 0
        before = set((tmp_path / "out").glob("*.parquet")) if n else set()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        fresh = [str(p) for p in set((tmp_path / "out").glob("*.parquet")) - before]
        rows = spark.read.parquet(*fresh).collect() if fresh else []
        return sorted((r.file.rpartition("/")[2], r.offset, r.line, r.anew) for r in rows)

    a, b = folder / "a.jsonl", folder / "b.jsonl"
    assert step() == []
    a.write_bytes(b"one\ntwo\nhalf a li")
    b.write_bytes(("x" * 30 + "\n").encode() * 5 + b"\n")
    (folder / "c.txt").write_bytes(b"other\n")
    long = [("b.jsonl", 31 * i, "x" * 30, True) for i in range(5)] + [("b.jsonl", 155, "", True)]
    assert step() == [("a.jsonl", 0, "one", True), ("a.jsonl", 4, "two", True), *long]
    assert step() == []
    with a.open("ab") as f:
        f.write("ne é\r\nnext".encode())
    assert step() == [("a.jsonl", 8, "half a line é", False)]
    a.write_bytes(b"cut\n")  # shorter than before
    assert step() == [("a.jsonl", 0, "cut", True)]
    a.write_bytes(b"quite another text of more bytes\nand more\n")  # rewritten and longer
    assert step() == [("a.jsonl", 0, "quite another text of more bytes", True), ("a.jsonl", 33, "and more", True)]
    a.write_bytes(b"no line end")
    assert step() == []
    with a.open("ab") as f:
        f.write(b"!\n")
    assert step() == [("a.jsonl", 0, "no line end!", True)]
    b.unlink()
    assert step() == []


def test_ranges_of_a_file_give_each_line_once(tmp_path):
    import io
    import random

    dice = random.Random(2)
    for _ in range(300):
        data = b"".join(b"x" * dice.randint(0, 9) + b"\n" for _ in range(dice.randint(1, 12)))
        begin = dice.choice([0, *(i + 1 for i, c in enumerate(data[:-1]) if c == 10)])
        split, got = dice.randint(1, 20), []
        for at_ in range(begin, len(data), split):
            got += growing.lines_between(io.BytesIO(data), at_, min(at_ + split, len(data)), len(data), at_ == begin)
        want, place = [], begin
        for line in data[begin:].split(b"\n")[:-1]:
            want.append((place, line))
            place += len(line) + 1
        assert got == want


def test_usage_of_transcript_files(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    turn = lambda n, kind="assistant": f'{{"type":"{kind}","message":{{"usage":{{"input_tokens":{n},"output_tokens":2,"cache_read_input_tokens":1}}}}}}\n'
    usage = feeds.file_usage(growing.growing_lines(spark, str(folder)))

    def step():
        usage.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, n: told.update({r.file.rpartition("/")[2]: tuple(r)[1:] for r in df.collect()})).trigger(availableNow=True).start().awaitTermination()
        return told

    told: dict = {}
    a = folder / "a.jsonl"
    a.write_text(turn(5) + "not json\n" + turn(7, "user") + '{"type":"assistant","message":{}}\n' + turn(9)[:20])
    assert step() == {"a.jsonl": (1, 5, 2, 1, 0)}
    with a.open("a") as f:
        f.write(turn(9)[20:])
    (folder / "b.jsonl").write_text(turn(1))
    assert step() == {"a.jsonl": (2, 14, 4, 2, 0), "b.jsonl": (1, 1, 2, 1, 0)}
    a.write_text(turn(3) * 9)
    assert step()["a.jsonl"] == (9, 27, 18, 9, 0)
