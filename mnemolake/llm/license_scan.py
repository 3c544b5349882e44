"""License scans by diagonal voting.

The hashes of all rolling word k-grams of a text are joined with those of the templates. A hit votes for its diagonal,
the text position minus the template position; diagonals of one template that lie close together are merged into a
span, and a span is verified by the k-grams of its template that it holds, words compared. The join's keys are few and
fixed (the templates are part of the program, their number is checked), so their filter runs where the hashes are
made: what has no template hash never leaves the scan.

Lower case is made of A-Z only; words are runs of digits, letters a-z and characters beyond ASCII. Null and empty texts
have no words; very long texts are scanned whole; repeated rows give repeated results; overlapping hits of different
templates all count. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.llm.common import id_and_text, map_batches, small_batches, string_buffers
from mnemolake.llm.words import grams, lower_table, starts_of, words

#: Words of a gram: the shortest phrase has three.
K = 3
#: Phrases that count wherever their words stand consecutively, by label. (Fixed values.)
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Wording of common licence notices, by label. (Fixed values.)
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under a creative commons attribution sharealike license",
    "cc-by": "licensed under a creative commons attribution license",
}
#: Diagonals this near are one span: so many words may be missing or added between two hits.
NEAR = 3
#: A span counts from this share of its template's grams on.
ENOUGH = 0.5
MAX_TEMPLATE_GRAMS = 100_000


def templates(phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> list[tuple[int, bool, str, list[str]]]:
    """(number, whether it is a phrase, label, words) of each template."""
    both = [(True, *x) for x in (PHRASES if phrases is None else phrases).items()] + [(False, *x) for x in (NOTICES if notices is None else notices).items()]
    return [(i, base, label, text.split()) for i, (base, label, text) in enumerate(both)]


def _is_word() -> np.ndarray:
    out = np.zeros(256, bool)
    out[0x30:0x3A] = out[0x61:0x7B] = out[0x80:] = True
    return out


def _hash(parts: list[str]) -> np.ndarray:
    column = pa.array([" ".join(parts)])
    return grams(words(*string_buffers(column), _is_word(), lower_table())[2], K).astype(np.int64)


def hits(df: DataFrame, all_templates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text (row, doc_id, n_words, grams): grams are place, hash and words of each k-gram that starts or
    goes through a template."""
    keys = np.unique(np.concatenate([_hash(t[3]) for t in all_templates])) if all_templates else np.zeros(0, np.int64)
    if len(keys) > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"{len(keys)} template grams are more than {MAX_TEMPLATE_GRAMS}")
    small_batches(df.sparkSession)
    kind = pa.list_(pa.struct([("place", pa.int64()), ("hash", pa.int64()), ("gram", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fold = lower_table()
        offsets, data = string_buffers(batch.column(1))
        start, end, h, first = words(offsets, data, _is_word(), fold)
        at = starts_of(first, K)
        code = grams(h, K).astype(np.int64)[at] if len(at) else np.zeros(0, np.int64)
        near = np.searchsorted(keys, code)
        at, code = (x[keys[np.minimum(near, len(keys) - 1)] == code] if len(keys) else x[:0] for x in (at, code))
        doc = np.searchsorted(first, at, side="right") - 1
        found = [[] for _ in range(len(batch.column(0)))]
        for i, d, c in zip(at.tolist(), doc.tolist(), code.tolist()):
            gram = b" ".join(fold[data[start[j] : end[j]]].tobytes() for j in range(i, i + K))
            found[d].append({"place": i - int(first[d]), "hash": c, "gram": gram.decode()})
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(found, kind)], ["doc_id", "n_words", "grams"])

    return map_batches(id_and_text(df, id_col, text_col), run, "doc_id long, n_words long, grams array<struct<place:long,hash:long,gram:string>>")


def spans(df: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words, template, base, label, start, end (words), score of each verified span; what isn't verified,
    and a text without hits, has a row with nulls."""
    spark = df.sparkSession
    known = templates(phrases, notices)
    if any(base and len(w) < K for _, base, _, w in known):
        raise ValueError(f"a phrase needs {K} words")
    listed = [(int(h), " ".join(w[i : i + K]), n, i, len(w), base, label) for n, base, label, w in known for i, h in enumerate(_hash(w))]
    fixed = F.broadcast(spark.createDataFrame(listed, "hash long, gram string, template int, at int, length int, base boolean, label string"))
    each = hits(df, known, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "n_words", F.explode_outer("grams").alias("hit"))
    each = each.select("row", "doc_id", "n_words", F.col("hit.place").alias("place"), F.col("hit.hash").alias("hash"), F.col("hit.gram").alias("gram"))
    voted = each.join(fixed, ["hash", "gram"], "left").withColumn("diagonal", F.col("place") - F.col("at"))
    # one row for each text without hits and one for each hit: few and narrow
    voted = voted.repartition("row")
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal", "at")
    gap = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > F.when(F.col("base"), 0).otherwise(NEAR)
    runs = voted.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by_diagonal))
    begin = F.col("diagonal") + F.col("at")
    merged = runs.groupBy("row", "doc_id", "n_words", "template", "run", "base", "label", "length").agg(F.min(begin).alias("start"), (F.max(begin) + K).alias("end"), (F.size(F.collect_set("at")) / (F.col("length") - (K - 1))).alias("score"))
    verified = F.col("score") >= F.when(F.col("base"), 1.0).otherwise(ENOUGH)
    return merged.select("row", "doc_id", "n_words", *(F.when(verified, F.col(c)).alias(c) for c in ("template", "base", "label", "start", "end", "score")))


def license_report(df: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best span's)."""
    found = spans(df, phrases, notices, id_col, text_col)
    base = F.col("base") & F.col("start").isNotNull()
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        found.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            labels(F.when(base, F.col("label"))).alias("base_labels"),
            labels(F.when(F.col("start").isNotNull(), F.col("label"))).alias("labels"),
            F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
