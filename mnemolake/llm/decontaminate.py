"""Benchmark decontamination by template canonicalisation.

Texts are canonicalised word by word: numbers, units after numbers, and names (capitalised words within a sentence, a
run of them as one) become typed placeholders, other words lower case. Windows of canonical words of documents and
items are hash-joined, so a question is found again though its numbers and names were replaced. Windows of one item
that lie on near diagonals of a document make a match; its slots must be consistent: a value of the item stands for one
value of the document throughout.

There are three forms: names within sentences only; names that open a sentence too; and all words plain in lower case,
which finds copies in capitals and items that are mostly numbers. A match is of one form, and good if it has enough of
the item's windows or covers most of its words, so one word replaced in a long item leaves it.

The item side's keys filter documents' windows where they are made if there are few enough (a checked size); else all
windows go into the join. Items shorter than a window are compared as a whole. Windows of a longer item with fewer than
LITERALS words that aren't placeholders say nothing and are left out. An item of one window with so few, but FEWEST at
least, is looked for as a sentence of its own: "What is 99 plus 7?" for "What is 12 plus 30?", but not within a longer
sentence; one of two or three words, none of them a placeholder, is found anywhere. Items of fewer than SHORTEST words say
nothing, wherever they stand.

Null and empty texts match nothing; a window that occurs in several items counts for each; repeated rows give repeated
results; an empty table of documents or items gives an empty result. Items without an item_id can't be told and are left
out. Very long texts are scanned whole. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.llm.common import id_and_text, map_batches, materialize, small_batches, string_buffers
from mnemolake.llm.words import U64, grams, lower_table, mix, starts_of, words

K, LITERALS = 8, 4
#: Words of an item, and those that aren't placeholders in one of a single window, at least.
SHORTEST, FEWEST = 2, 2
#: Share of an item's windows, and of its slots, that a match needs; and how far its diagonals may lie apart.
ENOUGH, CONSISTENT, NEAR = 0.5, 0.8, 6
#: Share of an item's words that make a match whatever its share of windows.
COVERED = 0.75
#: Names within sentences, names also at their start, no placeholders.
FORMS = (0, 1, 2)
#: Keys that may travel to every worker: 8 bytes each.
MAX_KEYS = 1_000_000
#: Units that count after a number. (Fixed values.)
UNITS = "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg t ton tons oz lb lbs pound pounds ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent % $ € £ usd eur dollar dollars euro euros cent cents mph kmh hz khz mhz ghz w kw v a k c f b kb mb gb tb degree degrees"
SLOTS = ("num", "unit", "name")
_CODES = mix(np.array([101, 102, 103], U64))


def _unit_hashes() -> np.ndarray:
    return np.unique(words(*string_buffers(pa.array([UNITS])), _word_bytes())[2])


def _word_bytes() -> np.ndarray:
    out = np.zeros(256, bool)
    out[0x30:0x3A] = out[0x41:0x5B] = out[0x61:0x7B] = out[0x80:] = True
    out[list(b"$%")] = True
    return out


class Canonical:
    """Canonical words of texts that lie one after another."""

    def __init__(self, column: pa.Array):
        offsets, data = string_buffers(column)
        base = int(offsets[0]) if len(offsets) else 0
        data, offsets = data[base : int(offsets[-1])], offsets - base
        digit = (data >= 0x30) & (data <= 0x39)
        plain = lower_table()[data]
        wide = np.flatnonzero(data == 0xC3)
        wide = wide[wide + 1 < len(data)] + 1
        wide = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
        plain[wide] += 0x20  # capitals with accents
        point = np.flatnonzero(((data == 0x2E) | (data == 0x2C))[1:-1] & digit[:-2] & digit[2:]) + 1
        plain[point] = 0x30  # 3.5 is one number
        start, end, h, first = words(offsets, plain, _word_bytes())
        is_upper = (data >= 0x41) & (data <= 0x5A)
        is_upper[wide - 1] = True
        stop = np.zeros(len(data) + 1, np.int64)
        ends = np.isin(data, np.frombuffer(b".!?:\n", np.uint8))
        ends[point] = False
        np.cumsum(ends, out=stop[1:])
        opens = np.ones(len(start), bool)
        opens[1:] = stop[start[1:]] > stop[end[:-1]]
        opens[first[:-1][first[:-1] < len(start)]] = True
        number = digit[start]
        unit = np.isin(h, _unit_hashes())
        unit[1:] &= number[:-1]
        unit[:1] = False
        unit &= ~number
        small = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 0x61) & (data <= 0x7A) | (data >= 0x80) & ~is_upper & (plain == data), out=small[1:])
        # SHOUTED words aren't names
        capital = is_upper[start] & ~unit & (small[end] - small[start] > np.where(data[start] >= 0x80, 1, 0))
        self.start_, self.end_, self.h_, self.first_ = start, end, h, first
        self.number, self.unit, self.capital, self.opens = number, unit, capital, opens
        self.plain, self.data = plain, data

    def form(self, form: int) -> Canonical:
        """Takes on a form."""
        start, end, h, first = self.start_, self.end_, self.h_, self.first_
        name = self.capital & ~self.opens if form == 0 else self.capital
        kind = np.select([self.number, self.unit, name], [0, 1, 2], 3) if form < 2 else np.full(len(start), 3)
        keep = np.ones(len(start), bool)
        if form < 2:
            keep[1:] = ~(name[1:] & name[:-1] & ~self.opens[1:])  # a run of names is one
        before = np.append(0, np.cumsum(keep))
        self.kind = kind[keep]
        self.h = np.where(self.kind < 3, _CODES[np.minimum(self.kind, 2)], h[keep])
        self.opening = self.opens[keep]
        self.start = start[keep]
        last = np.flatnonzero(keep)
        self.end = end[np.append(last[1:] - 1, len(end) - 1)] if len(last) else end[:0]
        self.first = before[first]
        return self

    def window(self, i: int, k: int) -> tuple[str, list[dict]]:
        """Canonical words, and slots with their place, kind and value."""
        shown, slots = [], []
        for j in range(i, i + k):
            kind = self.kind[j]
            if kind < 3:
                shown.append(f"<{SLOTS[kind]}>")
                slots.append({"place": j - i, "kind": SLOTS[kind], "value": self.data[self.start[j] : self.end[j]].tobytes().decode(errors="replace")})
            else:
                shown.append(self.plain[self.start[j] : self.end[j]].tobytes().decode(errors="replace"))
        return " ".join(shown), slots


_SLOT = pa.struct([("place", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
_HIT = pa.list_(pa.struct([("form", pa.int32()), ("n_windows", pa.int32()), ("n_words", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("place", pa.int64()), ("alone", pa.bool_()), ("gram", pa.string()), ("slots", pa.list_(_SLOT))]))
_HITS = "array<struct<form:int,n_windows:int,n_words:int,size:int,hash:long,place:long,alone:boolean,gram:string,slots:array<struct<place:int,kind:string,value:string>>>>"


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, form, n_windows, n_words, size, hash, place, alone (must be a sentence), gram, slots: what is looked for."""
    small_batches(items.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        canonical, found = Canonical(batch.column(1)), [[] for _ in range(batch.num_rows)]
        for form in FORMS:
            own = canonical.form(form)
            for item, (i, j) in enumerate(zip(own.first.tolist(), own.first[1:].tolist())):
                size, hits = min(K, j - i), []
                if j - i >= SHORTEST:
                    h = grams(own.h[i:j], size).astype(np.int64)
                    for at in range(j - i - size + 1):
                        literals = int((own.kind[i + at : i + at + size] == 3).sum())
                        if literals >= (FEWEST if size == j - i else LITERALS):
                            gram, slots = own.window(i + at, size)
                            hits.append({"form": form, "n_words": j - i, "size": size, "hash": int(h[at]), "place": at, "alone": literals < min(LITERALS, size), "gram": gram, "slots": slots})
                found[item] += [hit | {"n_windows": len(hits)} for hit in hits]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _HIT)], ["doc_id", "hits"])

    rows = map_batches(id_and_text(items, id_col, text_col), run, f"doc_id long, hits {_HITS}").filter("doc_id is not null")
    return rows.select(F.col("doc_id").alias("item_id"), F.explode("hits").alias("hit")).select("item_id", "hit.*")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_keys: int = MAX_KEYS) -> DataFrame:
    """doc_id, item_id, form, covered (share of the item's words), share (of the item's windows), consistency (of its slots), same_values (whether all slots hold
    the item's own values), start and end (canonical words) of each match."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = materialize(item_windows(items, item_col, item_text), "item-windows")
    sizes = sorted((r["form"], r["size"]) for r in wanted.select("form", "size").distinct().collect())  # at most K of a form
    keys = wanted.select("form", "size", "hash").distinct().limit(max_keys + 1).collect()
    few = len(keys) <= max_keys and wanted.count() <= 4 * max_keys  # many items may share few keys
    told = spark.sparkContext.broadcast({n: np.array(sorted(r["hash"] for r in keys if (r["form"], r["size"]) == n), np.int64) for n in sizes} if few else None)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        canonical, taken = Canonical(batch.column(1)), None
        found = [[] for _ in range(batch.num_rows)]
        for form, size in sizes:
            own = canonical if form == taken else canonical.form(form)
            taken = form
            at = starts_of(own.first, size)
            code = grams(own.h, size).astype(np.int64)[at] if len(at) else np.zeros(0, np.int64)
            if told.value is not None:
                known = told.value[form, size]
                hit = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
                at, code = at[hit], code[hit]
            doc = np.searchsorted(own.first, at, side="right") - 1
            for i, d, c in zip(at.tolist(), doc.tolist(), code.tolist()):
                gram, slots = own.window(i, size)
                sentence = bool(own.opening[i]) and (i + size == int(own.first[d + 1]) or bool(own.opening[i + size]))
                found[d].append({"form": form, "size": size, "hash": c, "place": i - int(own.first[d]), "alone": sentence, "gram": gram, "slots": slots})
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _HIT)], ["doc_id", "hits"])

    rows = map_batches(id_and_text(docs, id_col, text_col), run, f"doc_id long, hits {_HITS}").filter(F.size("hits") > 0)
    each = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.explode("hits").alias("hit")).select("row", "doc_id", "hit.form", "hit.size", "hit.hash", "hit.gram", F.col("hit.place").alias("doc_place"), F.col("hit.alone").alias("sentence"), F.col("hit.slots").alias("doc_slots"))
    joined = each.join(F.broadcast(wanted) if few else wanted, ["form", "size", "hash", "gram"]).filter(~F.col("alone") | F.col("sentence"))
    near = Window.partitionBy("row", "item_id", "form").orderBy("diagonal", "place")
    voted = joined.withColumn("diagonal", F.col("doc_place") - F.col("place"))
    voted = voted.withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > NEAR, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(near))
    pairs = F.transform(F.arrays_zip("slots", "doc_slots"), lambda x: F.struct(x["slots"]["kind"].alias("kind"), x["slots"]["value"].alias("item"), x["doc_slots"]["value"].alias("doc")))
    merged = voted.withColumn("pairs", pairs).groupBy("row", "doc_id", "item_id", "form", "n_windows", "n_words", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("place", F.col("place") + F.col("size") - 1))))).alias("words"), F.size(F.collect_set("place")).alias("n"), F.min("doc_place").alias("start"), F.max(F.col("doc_place") + F.col("size")).alias("end"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    values = F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p["item"])))
    consistency = F.when(F.size("pairs") == 0, F.lit(1.0)).otherwise(F.size(values) / F.size("pairs"))
    return merged.select("row", "doc_id", "item_id", "form", (F.col("words") / F.col("n_words")).alias("covered"), (F.col("n") / F.col("n_windows")).alias("share"), consistency.alias("consistency"), F.forall("pairs", lambda p: p["item"] == p["doc"]).alias("same_values"), "start", "end")


def contaminated(docs: DataFrame, items: DataFrame, enough: float = ENOUGH, consistent: float = CONSISTENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_places, share, same_values of every document and item of which one match is good enough."""
    good = matches(docs, items, id_col, text_col).filter(((F.col("share") >= enough) | (F.col("covered") >= COVERED)) & (F.col("consistency") >= consistent))
    each = good.groupBy("row", "doc_id", "item_id", "form").agg(F.count("*").alias("n"), F.max("share").alias("share"), F.max("same_values").alias("same_values"))
    return each.groupBy("row", "doc_id", "item_id").agg(F.max("n").alias("n_places"), F.max("share").alias("share"), F.max("same_values").alias("same_values")).drop("row")
