"""Toxicity by a lexicon trie that Levenshtein automata walk, and context windows around the hits.

The lexicon is learned from labelled texts: whole words, and stems (beginnings of words, which languages with endings
need), that occur in toxic texts far more often than in others. Misspelled terms are caught by intersecting the
Levenshtein automaton of a word with the trie of the lexicon. Around each hit a window tells abuse from quotation:
quotation marks, or a verb or noun of reporting, around the term. The score of a text is a logistic function of its
hits by distance and context; its few weights are fitted on the labelled texts.

The classifier is fitted on at most SAMPLE labelled texts, chosen by a hash of their ids; the model is as small, so it
may travel to every executor. Scoring reads every whole text. Null and empty texts have no hits and get the score of
such texts; labels that are null, or of no text, are left out; without labels the lexicon is empty and every text gets
the same score. Repeated rows give repeated scores; an empty table gives an empty result. Extra columns are ignored.
Very long texts are scored whole.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.common import id_and_text, map_batches, materialize, small_batches, string_buffers
from mnemolake.llm.words import grams, not_white
from mnemolake.llm.words import words as words_of

#: Labelled texts to fit on, at most.
SAMPLE = 6_000
#: Lengths of stems; toxic texts of the sample that must hold a term.
STEMS, LEAST_TEXTS = (4, 8), 3
#: Words that a worker remembers in each of two generations: together 25 MB at most.
REMEMBERED = 60_000
#: Share of toxic texts among those that hold a term, after adding PRIOR texts of the usual share.
LEAST_SHARE, PRIOR = 0.6, 2.0
#: Characters looked at on both sides of a hit.
CONTEXT = 48
WORD = re.compile(r"[^\W_]+")
#: Characters written for letters, and marks and words of quotation. (Fixed values.)
LOOKS = str.maketrans("013457@$", "oieastas")
QUOTES = "\"'«»„“”‘’`"
REPORTING = frozenset("said says called calls quote quoted quotes wrote writes word term insult slur dijo dit sagte".split())
FEATURES = ("exact", "stem", "near", "quoted", "top", "some", "short")


class Trie:
    """The lexicon, letter by letter. A node: children by letter, weight of a whole word or None, weight of a stem or None."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.root: list = [{}, None, None]
        for kind, terms in ((1, words), (2, stems)):
            for term, weight in terms.items():
                node = self.root
                for c in term:
                    node = node[0].setdefault(c, [{}, None, None])
                node[kind] = weight
        self.words = {w for w in words if len(w) >= 5}
        self.shorter = {w[:i] + w[i + 1 :] for w in self.words for i in range(len(w))}

    def exact(self, word: str) -> tuple[float, str] | None:
        """Weight and kind of the word, or of its longest stem."""
        node, found = self.root, None
        for c in word:
            node = node[0].get(c)
            if node is None:
                return found
            if node[2] is not None:
                found = (node[2], "stem")
        return (node[1], "exact") if node[1] is not None else found

    def near(self, word: str) -> tuple[float, str] | None:
        """The heaviest word of the lexicon at distance 1: a whole term of five letters or more.

        Only words that share a single deletion with a term are walked."""
        n = len(word)
        if n < 4 or not (word in self.shorter or any((d := word[:i] + word[i + 1 :]) in self.shorter or d in self.words for i in range(n))):
            return None
        best = None
        # the automaton's state: distances of the word's prefixes to the path, of which those up to 1 matter
        stack = [(self.root, tuple(min(i, 2) for i in range(n + 1)), 0)]
        while stack:
            node, row, depth = stack.pop()
            if node[1] is not None and row[n] <= 1 and depth >= 5 and (best is None or node[1] > best[0]):
                best = (node[1], "near")
            for c, child in node[0].items():
                new, low = [min(row[0] + 1, 2)], 2
                for i in range(1, n + 1):
                    d = row[i - 1] if word[i - 1] == c else 1 + min(row[i - 1], row[i], new[i - 1])
                    new.append(min(d, 2))
                    low = min(low, d)
                if min(low, new[0]) <= 1:
                    stack.append((child, tuple(new), depth + 1))
        return best


class Model:
    """Lexicon and weights. to_json() and from_json() keep it."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: list[float] | None = None):
        self.words, self.stems = words, stems
        self.weights = weights or [0.0] * (len(FEATURES) + 1)
        self.trie = Trie(words, stems)
        self.known: dict[str, tuple[float, str] | None] = {}
        self.older: dict[str, tuple[float, str] | None] = {}

    def to_json(self) -> str:
        return json.dumps([self.words, self.stems, self.weights])

    @classmethod
    def from_json(cls, data: str) -> Model:
        return cls(*json.loads(data))

    def _look(self, word: str) -> tuple[float, str] | None:
        found = self.trie.exact(word)
        if found is None and (plain := word.translate(LOOKS)) != word and any(c.isalpha() for c in word):
            found = self.trie.exact(plain)
            word = plain
        return found or self.trie.near(word)

    def hits(self, text: str) -> list[tuple[int, int, float, str, bool]]:
        """(start, end, weight, kind, quoted) of each term in a text."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        low, known, older, out = text.lower(), self.known, self.older, []
        words = set(WORD.findall(low))
        for w in words.difference(known):
            known[w] = older[w] if w in older else self._look(w)
        if not any(map(known.__getitem__, words)):
            return out
        for m in WORD.finditer(low):
            if found := known[m[0]]:
                out.append((m.start(), m.end(), *found, self._quoted(low, m.start(), m.end())))
        return out

    @staticmethod
    def _quoted(text: str, start: int, end: int) -> bool:
        """Whether the window around a term shows it as quoted: marks on both sides, or one mark and a word of reporting."""
        left, right = text[max(0, start - CONTEXT) : start + 1], text[end - 1 : end + CONTEXT]  # with a letter of the term each
        # of marks on one side an odd number is open; apostrophes within words are none
        opened = len(re.findall(rf"(?<!\w)[{QUOTES}]", left)) - len(re.findall(rf"[{QUOTES}](?!\w)", left)) > 0
        closed = len(re.findall(rf"[{QUOTES}](?!\w)", right)) - len(re.findall(rf"(?<!\w)[{QUOTES}]", right)) > 0
        return opened and closed or (opened or closed) and not REPORTING.isdisjoint(WORD.findall(left))

    def features(self, text: str) -> list[float]:
        return self.features_of(self.hits(text), len(text))

    @staticmethod
    def features_of(hits, size: int) -> list[float]:
        own = {"exact": 0.0, "stem": 0.0, "near": 0.0, "quoted": 0.0}
        top = 0.0
        for _, _, weight, kind, quoted in hits:
            own["quoted" if quoted else kind] += weight
            top = max(top, weight if kind != "near" and not quoted else 0.0)
        sums = [math.log1p(own[k]) for k in ("exact", "stem", "near", "quoted")]
        return [*sums, top, float(top > 0), math.log1p((own["exact"] + own["stem"]) * 600 / max(size, 6))]

    def score_of(self, hits, size: int) -> float:
        z = self.weights[-1] + sum(w * x for w, x in zip(self.weights, self.features_of(hits, size)))
        return 1 / (1 + math.exp(-min(max(z, -500), 500)))

    def score(self, text: str) -> float:
        return self.score_of(self.hits(text), len(text))


def terms_of(text: str) -> set[str]:
    """Words of a text, and their stems as stem*."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in range(STEMS[0], min(STEMS[1], len(w) - 1) + 1)}


def lexicon(held: dict[str, tuple[int, int]], n: tuple[int, int]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with weights, from how many other and toxic texts hold each term, and how many texts there are.

    A term must be likelier in toxic texts than chance allows for as many terms as were looked at."""
    usual = min(max(n[1] / max(1, sum(n)), 0.005), 0.5)
    bound = 2 * math.log(max(2, len(held)))
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    for t in sorted(held, key=lambda t: (-held[t][1], len(t), t)):
        c0, c1 = held[t]
        share = (c1 + PRIOR * usual) / (c0 + c1 + PRIOR)
        if share < LEAST_SHARE or len(t.rstrip("*")) < 3 or 2 * (_part(c1, (c0 + c1) * usual) + _part(c0, (c0 + c1) * (1 - usual))) < bound:
            continue
        share = min(share, 0.98)
        weight = round(math.log(share / (1 - share)) - math.log(usual / (1 - usual)), 4)
        if not t.endswith("*"):
            words[t] = weight
        elif not any(t[:k] in stems for k in range(STEMS[0], len(t) - 1)):  # a shorter stem holds it
            stems[t[:-1]] = weight
    for stem in list(stems):  # a stem of a single word isn't needed
        own = [held[w][1] for w in words if w.startswith(stem)]
        if own and held[stem + "*"][1] <= 1.2 * max(own):
            del stems[stem]
    return words, stems


def _part(seen: float, expected: float) -> float:
    return seen * math.log(seen / expected) if seen else 0.0


def fit(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton's method; the last weight is the constant. Hits never count against toxicity:
    weights that would be negative are 0."""
    x = np.hstack([x, np.ones((len(x), 1))])
    live = np.ones(x.shape[1], bool)
    while True:
        w, own = np.zeros(x.shape[1]), x[:, live]
        penalty = ridge * np.eye(own.shape[1])
        penalty[-1, -1] = 1e-3
        v = w[live]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(own @ v, -30, 30)))
            v = v - np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + penalty, own.T @ (p - y) + penalty @ v)
        w[live] = v
        if not (w[:-1] < 0).any():
            return [float(c) for c in w]
        live[:-1] &= w[:-1] > 0


def learn(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled texts in memory; train() does the same with Spark."""
    held: dict[str, list[int]] = {}
    for text, label in zip(texts, toxic):
        for term in terms_of(text):
            held.setdefault(term, [0, 0])[label] += 1
    model = Model(*lexicon({t: tuple(c) for t, c in held.items() if c[1] >= LEAST_TEXTS}, (toxic.count(0), toxic.count(1))))
    if texts:
        model.weights = fit(np.array([model.features(t) for t in texts]), np.array(toxic, float))
    return model


def fold(id_col: str = "doc_id") -> Column:
    """0 to 3 by the id's text; rows of fold 2 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def _keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds the smallest hash of a text's shingles of five words."""
    _, _, h, first = words_of(*string_buffers(batch.column(0)), not_white())
    g = grams(h, 5, 51)
    key = [int((g[i : j - 4] if j - i >= 5 else h[i:j] if j > i else np.zeros(1, np.uint64)).min().astype(np.int64)) for i, j in zip(first.tolist(), first[1:].tolist())]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.int64())], ["text", "toxic", "shingle"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on a bounded sample of the labelled texts that aren't held out: those whose ids hash lowest."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(fold("doc_id") != 2)
    near = marks
    if (total := marks.count()) > sample:
        near = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) <= int(1_000_000 * min(1.0, 1.2 * sample / total)))
    chosen = near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` ids travel
    sampled = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    # copies of a text, near ones too, would make terms of all its words: one text stays for each smallest shingle
    rows = materialize(map_batches(sampled, _keyed, "text string, toxic int, shingle long").dropDuplicates(["toxic", "shingle"]).select("text", "toxic"), "toxicity-sample")
    count = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}

    def count_terms(wanted: set[str] | None):
        def run(batches):
            for batch in batches:
                counts = Counter()
                for text in batch.column(0).to_pylist():
                    counts.update(terms_of(text) if wanted is None else terms_of(text) & wanted)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        return run

    schema = "term string, n long"
    of_toxic = rows.filter("toxic = 1").select("text").mapInArrow(count_terms(None), schema).groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    # terms that several of at most `sample` texts hold
    toxic = {r["term"]: r["n"] for r in of_toxic.collect()}
    others = rows.filter("toxic = 0").select("text").mapInArrow(count_terms(set(toxic)), schema).groupBy("term").agg(F.sum("n").alias("n"))
    other = {r["term"]: r["n"] for r in others.collect()}
    model = Model(*lexicon({t: (other.get(t, 0), n) for t, n in toxic.items()}, (count.get(0, 0), count.get(1, 0))))
    if not count:
        return model
    told = model.to_json()

    def measure(batches):
        own = Model.from_json(told)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([own.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    got = sorted(rows.mapInArrow(measure, "x array<double>, toxic int").collect())
    model.weights = fit(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, score, n_hits of every text; with keep, the rows of docs as they are, in a column `row`, and score."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model.to_json())
    made: list[Model] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Model.from_json(told.value))
        own = made[0]
        hits = [own.hits(t) for t in batch.column(1).to_pylist()]
        sizes = pc.utf8_length(batch.column(1)).to_pylist()
        scores = pa.array([own.score_of(h, n) for h, n in zip(hits, sizes)], pa.float64())
        if keep:
            return pa.RecordBatch.from_arrays([batch.column(2), scores], ["row", "score"])
        return pa.RecordBatch.from_arrays([batch.column(0), scores, pa.array([len(h) for h in hits], pa.int64())], ["doc_id", "score", "n_hits"])

    if keep:
        rows = id_and_text(docs, id_col, text_col, F.struct("*").alias("row"))
        return map_batches(rows, run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, score double, n_hits long")
