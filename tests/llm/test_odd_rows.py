"""Null and repeated ids, very long texts, clashing columns: cases that the other tests of an operator leave out."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from mnemolake.llm import chosen_path, license_scan, queries, substring_dedup, token_files, toxicity

LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(150_000))


def test_license_places_of_null_ids_and_very_long_texts(spark):
    rows = [(None, "under the MIT license"), (None, None), (1, f"{LONG} apache license version 2 {LONG}"), (1, "nothing")]
    got = sorted(((r.doc_id is None, r.n_words, r.n_base, r.first_word, r.base_labels) for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(True, 4, 1, 0, "mit"), (True, 0, 0, None, ""), (False, 300_004, 1, 150_000, "apache-2"), (False, 1, 0, None, "")], key=repr)


def test_token_files_of_null_and_repeated_ids(spark):
    library = Tokenizer.from_file(public_tokenizers.path(queries.SPEC))
    rows = [(5, "five"), (None, "nobody's"), (2, LONG[:300_000]), (2, "again two"), (None, None), (9, "")]
    df = spark.createDataFrame([(i, t, "clash", 7, 8) for i, t in rows], "doc_id long, text string, tokens string, part int, start int")
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, queries.END_ID] for _, t in rows}
    crc = lambda t: zlib.crc32(np.array(ids[t], "<u4").tobytes())
    got = sorted(token_files.read(token_files.write(df, public_tokenizers.path(queries.SPEC), queries.END_ID)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 2, 2, 5, 9]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -1, len(ids[t]), crc(t)) for i, t in rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_repeats_of_null_and_repeated_ids(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, f"{passage} first"), (3, f"other {passage}"), (3, f"{passage} third"), (7, "short text")]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 26, 0, f"{passage} first"), (3, 26, 25, "other"), (3, 26, 25, "third"), (7, 2, 0, "short text")], key=repr)


def test_near_classes_of_very_long_texts(spark):
    rows = [(1, LONG), (2, LONG.replace("w7919 ", "changed ", 1)), (3, LONG[: len(LONG) // 2]), (4, " ".join(LONG.split()[::-1]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_toxicity_of_very_long_and_repeated_texts(spark):
    model = toxicity.Model({"idiot": 5.0}, {}, [1.0] * 8)
    rows = [(1, LONG + " you idiot"), (1, LONG + " you idiot"), (2, LONG), (None, "you idiot")]
    got = [(r.doc_id, r.score, r.n_hits) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert sorted(got, key=repr) == sorted([(i, model.score(t), int("idiot" in t)) for i, t in rows], key=repr)


def test_last_stage_on_odd_rows(spark):
    library = Tokenizer.from_file(public_tokenizers.path(queries.SPEC))
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "é <|endoftext|> a", "x", 1), (3, LONG[:100_000], "x", 1), (3, LONG[:100_000], "y", 2)]
    out = corpus_pipeline.encode(spark, spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int"), "").collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in rows]
    assert sorted(((r.doc_id, r.ids, r.n_tokens, r.decoded_sha256) for r in out), key=repr) == sorted(((i, x, len(x), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in want), key=repr)


def test_what_each_stage_removes(spark, tmp_path):
    """Stage by stage over planted rows: the toxic one, the repeated line, the near copy, the benchmark passage."""
    words = [f"plain{i}" for i in range(400)]
    clean = {i: " ".join(random.Random(i).choices(words, k=60)) for i in range(1, 40)}
    item = "How many of the red boats that the old captain sold in the harbour last spring were still afloat at noon"
    docs = {**clean, 50: f"{clean[5]} extra", 51: f"intro words here. {item} and an end", 52: f"a line that is long enough to count as one\n{clean[7][:80]}\nmore"}
    labels = [(i, 1, 0) for i in clean] + [(100 + i, 0, 1) for i in range(12)]
    docs |= {100 + i: " ".join([words[(i * 31 + j) % 400] for j in range(20)] + ["grobian"] * 3) for i in range(14)}
    docs[53] = docs[52].split("\n")[0] + "\n" + " ".join(words[j * 3 % 400] for j in range(30))
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, folder).write.parquet(f"{folder}/stage{n}")
        now = spark.read.parquet(f"{folder}/stage{n}")
        left[name] = {r.doc_id: r.text for r in now.collect()}
    toxic, lines, near, bench = left.values()
    assert set(docs) - set(toxic) == {100 + i for i in range(14)}
    assert set(lines) == set(toxic) and lines[53] == docs[53].split("\n")[1] and {i for i in toxic if lines[i] != toxic[i]} == {53}
    assert set(lines) - set(near) == {50} and set(near) - set(bench) == {51}
