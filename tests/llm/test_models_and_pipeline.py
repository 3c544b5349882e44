import random

import pytest

import corpus_pipeline
from mnemolake.llm import decontaminate, queries, toxicity

DATA = "/root/testdata/sf0.001"


def test_trie_and_automaton():
    model = toxicity.Model({"idiot": 5.0, "moron": 4.0, "scum": 4.0}, {"achlich": 3.0})
    assert model.trie.exact("idiot") == (5.0, "exact") and model.trie.exact("achlichung") == (3.0, "stem")
    for word in ("idiott", "idot", "idiat", "xidiot", "ediot"):
        assert model.trie.near(word) == (5.0, "near")
    for word in ("idoit", "idi", "radio", "scam", ""):
        assert model.trie.near(word) is None
    assert [h[3] for h in model.hits("You 1d10t! scum")] == ["exact", "exact"]


def test_automaton_against_all_distances():
    """Every word at distance 1 of a term of five letters or more, and no other."""
    r = random.Random(3)
    terms = {"".join(r.choice("abcd") for _ in range(r.randint(3, 8))): float(i) for i, _ in enumerate(range(60))}
    trie = toxicity.Model(terms, {}).trie

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        word = "".join(r.choice("abcd") for _ in range(r.randint(4, 9)))
        want = max((w for t, w in terms.items() if len(t) >= 5 and distance(t, word) <= 1), default=None)
        got = trie.near(word)
        assert (got and got[0]) == want


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 10)
    model = toxicity.Model({"idiot": 5.0}, {}, [1.0] * 8)
    for i in range(50):
        assert len(model.hits(f"you idiot number{i} some words")) == 1
        assert len(model.known) < 16 and len(model.older) < 16


def test_quotation_lowers_the_score():
    model = toxicity.Model({"idiot": 5.0}, {}, [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, -2.0])
    assert [h[4] for h in model.hits('the word "idiot" is rude, you idiot')] == [True, False]
    assert model.score("you idiot") > model.score('he said "idiot" once') >= model.score("")


def test_learned_lexicon_catches_held_out_texts():
    r = random.Random(1)
    plain = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        words = [r.choice(plain) for _ in range(30)]
        labels.append(i % 8 == 0)
        if labels[-1]:
            words[r.randrange(30)] = r.choice(["grobian", "rascal", "knavely", "knaveful", "knavish"])
        texts.append(" ".join(words))
    labels = [int(x) for x in labels]
    model = toxicity.learn(texts[:450], labels[:450])
    scores = [model.score(t) for t in texts[450:]]
    assert all((s >= 0.3) == bool(y) for s, y in zip(scores, labels[450:]))
    assert toxicity.Model.from_json(model.to_json()).score(texts[0]) == model.score(texts[0])
    assert toxicity.learn([], []).words == {}


def test_scores_of_tables(spark):
    docs = spark.createDataFrame([(i, ("you rascal " if i % 3 == 0 else "you friend ") + str(i), 0.5) for i in range(80)] + [(100, None, 0.5), (None, "", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None) for i in range(80)] + [(5, None, None), (None, 1, None), (999, 1, None)], "doc_id long, toxic int, lang string")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 82 and min(got[i] for i in range(0, 80, 3)) > max(got[i] for i in range(80) if i % 3)
    kept = toxicity.score(docs, model, keep=True)
    assert kept.select("row.*").columns == docs.columns and kept.count() == 82
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0


ITEM = "At the market on Monday, Alice Smith bought 12 apples for 3.50 dollars and gave 12 of them to Robert before lunch."


def test_reparameterised_questions(spark):
    items = spark.createDataFrame([(1, ITEM, 0), (2, "short one", 0), (3, None, 0)], "item_id long, text string, share int")
    changed = ITEM.replace("12", "47").replace("Alice Smith", "Jane Doe").replace("3.50", "9.25").replace("Robert", "Bob")
    docs = [(1, "x y z. " + ITEM), (2, changed), (3, changed.replace("47 of", "48 of")), (4, ITEM.upper()), (5, "nothing of this kind here, 12 apples"), (6, None), (7, "a short one"), (8, ITEM + "\n" + ITEM)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, place int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, items).collect()}
    assert {(1, 1), (2, 1), (8, 1), (7, 2)} <= set(got) and not {d for d, _ in got} & {5, 6}
    assert got[1, 1].same_values and not got[2, 1].same_values and got[8, 1].n_places == 2
    slots = {r.doc_id: r.consistency for r in decontaminate.matches(df, items).filter("item_id = 1").collect()}
    assert slots[2] == 1.0 and slots[3] < 1.0
    without_filter = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, items, max_keys=0).filter("share >= 0.5").collect()}
    assert without_filter == {(r.doc_id, r.item_id) for r in decontaminate.matches(df, items).filter("share >= 0.5").collect()}
    assert decontaminate.contaminated(df, items.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), items).count() == 0


def test_names_at_the_start_numbers_capitals_and_one_other_word(spark):
    apples = "Alice has 12 apples. Bob has 3 apples. Carol takes 4 apples from Bob. How many apples does Alice have?"
    items = spark.createDataFrame([(1, apples), (2, "What is 12 times 7?"), (3, ITEM), (4, "seven of the old boats lay on the beach when the storm came over the hills at night")], "item_id long, text string")
    renamed = apples.replace("Alice", "Dora").replace("Bob", "Emil").replace("Carol", "Frida").replace("12", "15")
    docs = [(1, renamed), (2, "so, what is 12 times 7? 84"), (3, ITEM.upper()), (4, "seven of the old boats lay on the shore when the storm came over the hills at night"), (5, "what is 13 times 7? the boats lay on the beach")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 2)}  # a short item with another number, as a sentence of its own, counts too


def test_exact_passages_of_the_benchmark(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, t in texts.items() if t in d.text}
    assert want <= {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    got = corpus_pipeline.run(spark, DATA)
    assert set(got.columns) == {"doc_id", "n_tokens", "ids", "decoded_sha256"}
    near = {r.doc_id for r in queries.op10_ngram_jaccard(spark, DATA).filter("doc_id = class_id").collect()}
    kept = {r.doc_id for r in got.collect()}
    assert len(kept) == got.count() and kept <= {r.doc_id for r in docs.collect()} and len(kept & near) > 0.6 * len(near)


@pytest.mark.parametrize("name", ["drop_toxic", "drop_repeated_lines", "drop_near_copies", "drop_contaminated"])
def test_stages_on_odd_rows(spark, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, rest int, node long, score double, gone long, missing int, `a.b` int"
    more = ("k", "r", 1, 2, 0.5, 3, 4, 5)
    rows = [(1, None, None, None, None, *more), (2, "", "en", "s", 0, *more), (2, "", "en", "s", 0, *more), (None, "a line\na line", "en", None, 13, *more), (3, "word " * 30, "en", "s", 150, *more)]
    df = spark.createDataFrame(rows, schema)
    out = getattr(corpus_pipeline, name)(spark, df, DATA)
    assert all(r["kept"] == "k" and r["a.b"] == 5 and r["missing"] == 4 for r in out.collect())
    assert out.columns == df.columns and out.filter("doc_id is null").count() == 1 and out.filter("doc_id = 3").count() == 1
    assert getattr(corpus_pipeline, name)(spark, df.limit(0), DATA).count() == 0
