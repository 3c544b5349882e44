"""Streams of many keys: a shard's keys come to Python together, with the rows that each key alone would give."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from mnemolake import queries, stream_queries  # noqa: F401  (register their queries)
from mnemolake.streaming import timed

ZERO = datetime(2024, 1, 1)
at = lambda s: ZERO + timedelta(seconds=s)
seconds = lambda t: (t - ZERO).total_seconds()


@pytest.fixture
def replay(spark, tmp_path):
    """What a stream tells of some batches, each in a run of its own, and the number of timers that its first run sets."""
    own = spark.newSession()
    for k, v in timed.STORE.items():
        own.conf.set(k, v)

    def run(schema, batches, build):
        place = tmp_path / str(len(list(tmp_path.iterdir())))
        own.createDataFrame([], schema).write.parquet(f"{place}/in")
        out, timers = build(own.readStream.schema(schema).parquet(f"{place}/in").withWatermark("at", "0 seconds")), []
        for rows in batches:
            own.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
            q = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
            timers.append(max(p.stateOperators[0].customMetrics.get("numRegisteredTimers", 0) for p in q.recentProgress if p.stateOperators))
        return sorted((tuple(r) for r in own.read.parquet(f"{place}/out").collect()), key=repr), timers[0]

    return run


def requests(dice):
    """Three batches of requests of 300 keys, a null among them; each batch is later than the one before."""
    batches, n = [], 0
    for begin in (0, 101, 230):
        rows = []
        for key in dice.sample([None, *range((1 << 53) + 1, (1 << 53) + 300)], 200):
            for _ in range(dice.randint(1, 6)):
                n += 1
                rows.append((key, f"u{dice.randint(1, 4)}", f"b{n}" if n % 5 else None, n % 4 > 0, n, at(begin + dice.randint(0, 400) / 4)))
        dice.shuffle(rows)
        batches.append([*rows, (-1, "end", None, False, 0, at(begin + 100))])  # the watermark
    return batches


def cached(batches, ttl, most, keep):
    """The same of each key, one request after another."""
    held, turn, out = {}, 0, []
    for rows in batches:
        for key, url, body, ok, n, t in sorted(rows, key=lambda r: (r[5], r[4])):
            pages, now = held.setdefault(key, {}), seconds(t)
            for u in [u for u, p in pages.items() if now - p[0] >= keep]:
                if u == url:
                    del pages[u]
            hit = pages.get(url)
            if hit and now - hit[0] < ttl:
                out.append((key, t, url, hit[2], "cached"))
            elif ok:
                if len(pages) >= most:
                    del pages[min(pages, key=lambda u: pages[u][1])]
                turn += 1
                pages[url] = (now, pages[url][1] if url in pages else turn, body)
                out.append((key, t, url, body, "fetched"))
            else:
                out.append((key, t, url, hit and hit[2], "stale" if hit else "failed"))
        end = max(seconds(r[5]) for r in rows)
        for pages in held.values():  # timers
            for u in [u for u, p in pages.items() if p[0] + keep <= end]:
                del pages[u]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards", [3, 256])
def test_page_cache_of_many_keys(replay, shards):
    batches = requests(random.Random(1))
    build = lambda s: timed.page_cache(s, "host", ttl="20 seconds", most=3, keep="90 seconds", order=("n",), shards=shards)
    got, timers = replay("host long, url string, body string, ok boolean, n long, at timestamp", batches, build)
    assert got == cached(batches, 20, 3, 90)
    assert 0 < timers <= shards


@pytest.mark.parametrize("tied", [True, False])
def test_cached_pages_of_one_time_come_in_order_of_events(spark, tmp_path, tied):
    c = duckdb.connect()
    c.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_days((i // {7 if tied else 1})::INT) AS ts, i % 2 AS user_id, 'view' AS event_type, 1.0 AS value, '' AS props FROM range(90) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = queries.QUERIES["cached_pages"](spark, str(tmp_path)).select("user_id", "at", "url", "body", "served").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(c.sql(queries.SQL["cached_pages"]).fetchall(), key=repr)


def bursts(batches, quiet):
    """The same of each key, one change after another; what isn't quiet at the end isn't told."""
    by, out = {}, []
    for key, t in sorted(((r[0], r[-1]) for rows in batches for r in rows), key=lambda r: r[1]):
        mine = by.setdefault(key, [])
        if mine and seconds(t) - seconds(mine[-1][2]) < quiet:
            mine[-1] = (mine[-1][0] + 1, mine[-1][1], t)
        else:
            mine.append((1, t, t))
    end = max(seconds(r[-1]) for rows in batches for r in rows)
    return sorted(((key, *b) for key, mine in by.items() for b in mine if seconds(b[2]) + quiet <= end), key=repr)


@pytest.mark.parametrize("shards", [3, timed.SHARDS])
def test_bursts_of_many_keys(replay, shards):
    batches = [[(r[0], r[-1]) for r in rows] for rows in requests(random.Random(2))]
    got, timers = replay("path long, at timestamp", batches, lambda s: timed.debounce(s, "path", quiet="6 seconds", shards=shards))
    assert got == bursts(batches, 6)
    assert 0 < timers <= shards


def test_a_stream_sets_a_timer_for_a_shard(replay):
    rows = [(f"k{i}", at(i % 5)) for i in range(1000)]
    got, timers = replay("path string, at timestamp", [rows], lambda s: timed.debounce(s, "path", quiet="2 seconds"))
    assert len(got) == 600 and 0 < timers <= timed.SHARDS
