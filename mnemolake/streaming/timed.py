"""Streams whose keys act when time passes: debounce, circuit breaker with cooldown, page cache with expiry.

Each is a state machine of one key, in the state store. Keys are dealt by hash to shards, which are what the store groups
and wakes: the rows of all keys of a shard come to Python together, so neither a call nor a frame is spent on each key. A
shard has one timer, for the first of its keys that is due. A stream keeps its number of shards as long as its checkpoint;
one of very many keys, or of large batches, should have more, so that a shard has some hundreds of keys and its rows of a
batch fit a worker. Keys are of plain types.

`clock` says whose time it is: "event" is the column `at` with a watermark, so a replay gives the same rows; "processing"
is the clock of the machine that runs the batch. The store must be RocksDB's: a session needs STORE before it starts such a
query. State of keys that are idle for long goes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: The setting that timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Shards of a stream, unless it is told otherwise.
SHARDS = 256
_MODE = {"event": "EventTime", "processing": "ProcessingTime"}


def _micros(duration: str) -> int:
    """Microseconds of a duration such as "2 seconds" or "5 minutes"."""
    import pandas as pd

    return int(pd.Timedelta(duration).total_seconds() * 1_000_000)


def _ms(us: int) -> int:
    """Microseconds rounded up to the store's milliseconds."""
    return -(-us // 1000)


class _Timed(StatefulProcessor):
    """Of a shard: times in microseconds, keys as tuples of texts. `expire` is what a machine does when time has passed."""

    columns: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()

    def __init__(self, keys: int, clock: str) -> None:
        self.places, self.event = [f"key{i}" for i in range(keys)], clock == "event"
        self.key_schema = ", ".join(f"{p} string" for p in self.places)

    def init(self, handle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "due long")

    def frame(self, names: list[tuple], owner, *values):
        """Rows of the columns' types after their key, which is the one at `owner` in `names`."""
        import numpy as np
        import pandas as pd

        keys = {p: np.array([n[i] for n in names], object)[owner] for i, p in enumerate(self.places)}
        return pd.DataFrame(keys | {c: pd.array(v, dtype=kind) for c, kind, v in zip(self.columns, self.kinds, values)})

    def rows(self, batches, now_ms: int, *columns: str):
        """The keys of a batch, where the rows of each begin (and the last end), times, and columns of all rows, by key and
        in order of time; with a processing clock, time is now."""
        import numpy as np
        import pandas as pd

        held = pd.concat(list(batches), ignore_index=True)
        if not self.event:
            held["us"] = now_ms * 1000
        held["key"] = held.groupby(self.places, dropna=False, sort=False).ngroup()
        held = held.sort_values(["key", "us", *columns], kind="stable")
        key = held["key"].to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        texts = lambda c: c.astype(object).where(c.notna(), None).tolist()
        names = list(zip(*(texts(held[p].iloc[begins]) for p in self.places)))
        return names, [*begins.tolist(), len(held)], held["us"].to_numpy(np.int64), *(texts(held[c]) for c in columns)

    @staticmethod
    def known(state, names: Iterable[tuple]) -> dict[tuple, tuple]:
        """What a map holds of these keys."""
        return {n: tuple(v) for n in names if (v := state.getValue(n)) is not None} if state.exists() else {}

    def wake(self, due_us: int) -> None:
        """Have the shard woken at a time, unless it will be earlier."""
        due, before = _ms(due_us), self.timer.get()[0] if self.timer.exists() else None
        if before is None or due < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def expire(self, now_ms: int):
        """Rows that time brings, if any, and when the next key is due, if one is."""
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.timer.clear()
        told, due = self.expire(timerValues.getCurrentWatermarkInMs() if self.event else timerValues.getCurrentProcessingTimeInMs())
        if due is not None:
            self.wake(due)
        if told is not None:
            yield told

    def close(self) -> None:
        pass


def _text(key: str, kind: T.DataType) -> Column:
    """A key as text; pandas would make numbers with nulls among them inexact."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key).cast("string")
    return F.hex(key) if isinstance(kind, T.BinaryType) else F.col(key).cast("string")


def _typed(text: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.col(text).cast("long"))
    return F.unhex(text) if isinstance(kind, T.BinaryType) else F.col(text).cast(kind)


def _apply(stream: DataFrame, keys: list[str], at: str, machine: _Timed, more: list[str], clock: str, shards: int) -> DataFrame:
    us = F.unix_micros(F.col(at).cast("timestamp")).alias("us") if machine.event else F.lit(0).cast("long").alias("us")
    kinds = [stream.schema[k].dataType for k in keys]
    texts = [_text(k, kind) for k, kind in zip(keys, kinds)]
    shard = F.pmod(F.xxhash64(*texts), F.lit(shards)).cast("int").alias("shard")
    kept = stream.select(shard, *(t.alias(p) for t, p in zip(texts, machine.places)), *more, us, *([at] if machine.event else []))
    if not machine.event:
        kept = kept.unionByName(_beat(kept))
    schema = machine.key_schema + "".join(f", {c} {_SQL[t]}" for c, t in zip(machine.columns, machine.kinds))
    told = kept.groupBy("shard").transformWithStateInPandas(machine, schema, "Append", _MODE[clock])
    return told.select(*(_typed(p, kind).alias(k) for k, p, kind in zip(keys, machine.places, kinds)), *machine.columns)


def _beat(stream: DataFrame) -> DataFrame:
    """A stream of the same columns that never has a row, but news each second: without news a query that was started
    again runs no batches, and timers fire in batches only."""
    ticks = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.lit(False))
    return ticks.select(*(F.lit(None).cast(t).alias(c) for c, t in stream.dtypes))


_SQL = {"Int64": "long", "boolean": "boolean", "string": "string"}


class _Debounce(_Timed):
    columns, kinds = ("n", "first", "last"), ("Int64",) * 3

    def __init__(self, keys: int, clock: str, quiet: int) -> None:
        super().__init__(keys, clock)
        self.quiet = quiet

    def init(self, handle) -> None:
        super().init(handle)
        self.bursts = handle.getMapState("bursts", self.key_schema, "n long, first long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np

        names, begins, us = self.rows(rows, timerValues.getCurrentProcessingTimeInMs())
        known, begins = self.known(self.bursts, names), np.array(begins)
        begin, sizes = begins[:-1], np.diff(begins)
        pending = np.array([known.get(n, (0, t, t)) for n, t in zip(names, us[begin].tolist())], np.int64)
        before = np.concatenate([us[:1], us[:-1]])
        before[begin] = pending[:, 2]
        cut = us - np.maximum(before, np.repeat(pending[:, 2], sizes)) >= self.quiet
        ended = np.flatnonzero(cut[begin])  # keys whose pending burst is over
        starts = cut.copy()
        starts[begin] = True
        starts = np.flatnonzero(starts)
        ends = np.concatenate([starts[1:], [len(us)]])
        owner = np.repeat(np.arange(len(names)), sizes)[starts]
        bursts = np.stack([ends - starts, us[starts], us[ends - 1]], axis=1)
        goes_on = np.flatnonzero(~cut[starts])  # the first of a key that joins what is pending
        joined = pending[owner[goes_on]]
        bursts[goes_on, 0] += joined[:, 0]
        bursts[goes_on, 1] = np.minimum(bursts[goes_on, 1], joined[:, 1])
        bursts[goes_on, 2] = np.maximum(bursts[goes_on, 2], joined[:, 2])
        last = np.concatenate([owner[1:] != owner[:-1], [True]])
        for name, burst in zip(names, bursts[last].tolist()):
            self.bursts.updateValue(name, tuple(burst))
        self.wake(int(bursts[last, 2].min()) + self.quiet)
        done = np.concatenate([pending[ended], bursts[~last]])
        if len(done):
            yield self.frame(names, np.concatenate([ended, owner[~last]]), *done.T)

    def expire(self, now_ms: int):
        held = [(tuple(k), tuple(v)) for k, v in self.bursts.iterator()]
        done = [(k, v) for k, v in held if _ms(v[2] + self.quiet) <= now_ms]
        if not done:
            return None, min((v[2] + self.quiet for _, v in held), default=None)
        if len(done) == len(held):
            self.bursts.clear()
        else:
            for name, _ in done:
                self.bursts.removeKey(name)
        due = min((v[2] + self.quiet for _, v in held if _ms(v[2] + self.quiet) > now_ms), default=None)
        return self.frame([k for k, _ in done], list(range(len(done))), *map(list, zip(*(v for _, v in done)))), due


def debounce(stream: DataFrame, *keys: str, quiet: str = "2 seconds", at: str = "at", clock: str = "event", shards: int = SHARDS) -> DataFrame:
    """keys, n, first, last (timestamps): one row for each burst of a key's changes, once it has been quiet for `quiet`.

    A burst that goes on is told when it ends, not before; pending ones survive a restart from the checkpoint. A row that
    comes late, but before the watermark, joins the burst that is pending.
    """
    out = _apply(stream, list(keys), at, _Debounce(len(keys), clock, _micros(quiet)), [], clock, shards)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("first", "last")})


class _Breaker(_Timed):
    columns, kinds = ("us", "ok", "tried", "failures", "open_until"), ("Int64", "boolean", "boolean", "Int64", "Int64")

    def __init__(self, keys: int, clock: str, limit: int, cooldown: int, forget: int) -> None:
        super().__init__(keys, clock)
        self.limit, self.cooldown, self.forget = max(1, limit), max(0, cooldown), forget

    def init(self, handle) -> None:
        super().init(handle)
        self.seen = handle.getMapState("seen", self.key_schema, "failures long, until long, last long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        names, begins, times, oks = self.rows(rows, timerValues.getCurrentProcessingTimeInMs(), "ok")
        known, times, owner, told, dues = self.known(self.seen, names), times.tolist(), [], [], []
        for place, name in enumerate(names):
            failures, until, last, due = known.get(name, (0, 0, 0, 0))
            for i in range(begins[place], begins[place + 1]):
                us, ok = times[i], oks[i]
                if last and us >= last + self.forget:
                    failures, until = 0, 0
                if tried := until <= us:
                    failures = 0 if ok else failures + 1
                    until = 0 if ok else us + self.cooldown if failures >= self.limit else until
                last = max(last, us)
                owner.append(place)
                told.append((us, bool(ok), tried, failures, until or None))
            due = until if until > last else last + self.forget
            self.seen.updateValue(name, (failures, until, last, due))
            dues.append(due)
        self.wake(min(dues))
        yield self.frame(names, owner, *map(list, zip(*told)))

    def expire(self, now_ms: int):
        names, told, dues = [], [], []
        for name, (failures, until, last, due) in [(tuple(k), tuple(v)) for k, v in self.seen.iterator()]:
            if _ms(due) > now_ms:
                dues.append(due)
                continue
            if due < last + self.forget:  # the cooldown is over, the failures are remembered
                dues.append(last + self.forget)
                self.seen.updateValue(name, (failures, until, last, last + self.forget))
            else:
                self.seen.removeKey(name)
            if due == until:
                names.append(name)
                told.append((until, None, None, failures, None))
        return self.frame(names, list(range(len(names))), *map(list, zip(*told))) if told else None, min(dues, default=None)


def circuit_breaker(stream: DataFrame, key: str = "origin", ok: str = "ok", at: str = "at", limit: int = 3, cooldown: str = "60 seconds", forget: str = "1 day", clock: str = "event", shards: int = SHARDS) -> DataFrame:
    """key, at, ok, tried, failures, open_until: each attempt in order, whether the breaker lets it pass, and what holds
    after it; when a cooldown ends, a row of its own without ok and tried.

    `limit` failures in a row open the breaker until `cooldown` after the last one; attempts meanwhile aren't tried and
    change nothing. Failures stay counted beyond the cooldown, so the next one opens again; a success clears all. A null
    outcome is a failure. What is known of a key that has no attempt for `forget` goes; that should be over `cooldown`.
    """
    renamed = stream.withColumn("ok", F.coalesce(F.col(ok).cast("boolean"), F.lit(False)))
    out = _apply(renamed, [key], at, _Breaker(1, clock, limit, _micros(cooldown), _micros(forget)), ["ok"], clock, shards)
    return out.select(key, F.timestamp_micros("us").alias("at"), "ok", "tried", "failures", F.timestamp_micros("open_until").alias("open_until"))


class _Cache(_Timed):
    columns, kinds = ("us", "url", "body", "served"), ("Int64", "string", "string", "string")

    def __init__(self, keys: int, clock: str, ttl: int, most: int, keep: int, order: tuple[str, ...]) -> None:
        super().__init__(keys, clock)
        self.ttl, self.most, self.keep, self.order = ttl, most, keep, order

    def init(self, handle) -> None:
        super().init(handle)
        self.entries = handle.getMapState("entries", self.key_schema, "next long, urls array<string>, times array<long>, turns array<long>")
        self.bodies = handle.getMapState("bodies", f"{self.key_schema}, url string", "body string")  # read when asked for

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        names, begins, times, *_, urls, bodies, oks = self.rows(rows, timerValues.getCurrentProcessingTimeInMs(), *self.order, "url", "body", "ok")
        known, times, owner, told, dues = self.known(self.entries, names), times.tolist(), [], [], []
        for place, name in enumerate(names):
            turn, *lists = known.get(name, (0, [], [], []))
            held = {u: (us, nth) for u, us, nth in zip(*lists)}
            stored, seen, changed = set(held), {}, set()

            def body_of(url):
                if url not in seen:
                    seen[url] = self.bodies.getValue((*name, url))[0]
                return seen[url]

            for i in range(begins[place], begins[place + 1]):
                us, url, body = times[i], urls[i], bodies[i]
                hit = held.get(url)
                if hit and us - hit[0] >= self.keep:  # its timer is due
                    del held[url]
                    changed.add(url)
                    hit = None
                if hit and us - hit[0] < self.ttl:
                    told.append((us, url, body_of(url), "cached"))
                elif oks[i]:
                    if len(held) >= self.most:
                        oldest = min(held, key=lambda u: held[u][1])
                        del held[oldest]
                        changed.add(oldest)
                    held[url] = (us, held[url][1] if url in held else turn)
                    seen[url] = body
                    turn += 1
                    changed.add(url)
                    told.append((us, url, body, "fetched"))
                elif hit:
                    told.append((us, url, body_of(url), "stale"))
                else:
                    told.append((us, url, None, "failed"))
                owner.append(place)
            for url in changed:
                if url in held:
                    self.bodies.updateValue((*name, url), (seen[url],))
                elif url in stored:
                    self.bodies.removeKey((*name, url))
            if changed:
                self.put(name, turn, held)
            if held:
                dues.append(min(us for us, _ in held.values()) + self.keep)
        if dues:
            self.wake(min(dues))
        yield self.frame(names, owner, *map(list, zip(*told)))

    def put(self, name: tuple, turn: int, held: dict) -> None:
        if held:
            self.entries.updateValue(name, (turn, list(held), [us for us, _ in held.values()], [nth for _, nth in held.values()]))
        else:
            self.entries.removeKey(name)

    def expire(self, now_ms: int):
        dues = []
        for name, (turn, urls, times, turns) in [(tuple(k), tuple(v)) for k, v in self.entries.iterator()]:
            held = {u: (us, nth) for u, us, nth in zip(urls, times, turns) if _ms(us + self.keep) > now_ms}
            if len(held) < len(urls):
                for url in urls:
                    if url not in held:
                        self.bodies.removeKey((*name, url))
                self.put(name, turn, held)
            if held:
                dues.append(min(us for us, _ in held.values()) + self.keep)
        return None, min(dues, default=None)


def page_cache(stream: DataFrame, key: str = "host", at: str = "at", ttl: str = "5 minutes", most: int = 200, keep: str = "1 day", clock: str = "event", order: tuple[str, ...] = (), shards: int = SHARDS) -> DataFrame:
    """key, at, url, body, served: what each request of a stream of (key, url, body, ok, at) gets from the key's cache.

    body is what a fetch gives now, ok whether it succeeds. "cached": an entry of under `ttl`; "fetched": the fetch, which
    is remembered, an empty body too; "stale": the fetch fails and an older entry answers; "failed": it fails and there
    is none. Failures aren't remembered. A key holds `most` entries; the first entered goes first, and an entry that is
    renewed keeps its turn. Entries of over `keep` go, so idle keys hold no state. Requests of one time come in the order
    of the columns `order`, then by url, body and ok.
    """
    sorted_by = [f"order{i}" for i in range(len(order))]
    asked = stream.select(key, "url", "body", "ok", at, *(F.col(c).alias(s) for c, s in zip(order, sorted_by)))
    out = _apply(asked, [key], at, _Cache(1, clock, _micros(ttl), most, _micros(keep), tuple(sorted_by)), [*sorted_by, "url", "body", "ok"], clock, shards)
    return out.select(key, F.timestamp_micros("us").alias("at"), "url", "body", "served")
