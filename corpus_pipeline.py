"""A cleaning pipeline over `documents`: each stage works on what its predecessor kept, written and read again.

Stages judge documents by doc_id: rows that share an id with a document that goes, go too, and rows without an id stay.
Columns other than text and n_chars pass as they are, whatever their names. run() deletes what a stage wrote for itself
once its result is written; who calls a stage alone can do the same with `temporary_tables`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import bpe, chosen_path, decontaminate, line_dedup, toxicity
from mnemolake.llm.common import delete_table, materialize, read_table, shared_dir, temporary_tables
from mnemolake.llm.queries import SPEC, TOXIC_FROM

_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches TOXIC_FROM go."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=True).filter(F.col("score") < TOXIC_FROM).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, but for a few edits, go; documents stay, if need be without text."""
    out = line_dedup.dedup_lines(docs, line_dedup.EDITS, keep_rows=True, points=True)
    there = ~F.col("rest.missing")
    own = {"text": F.when(there, F.col("kept")), "n_chars": F.when(there, F.length("kept"))}
    return out.select(*(own[c].cast(kind).alias(c) if c in own else F.col("rest.row").getField(c).alias(c) for c, kind in docs.dtypes))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a class of near copies the document with the smallest doc_id stays; documents without doc_id stay."""
    gone = chosen_path.near_classes(docs).filter(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    return _without(docs, materialize(gone, "near-copies"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; documents without doc_id stay."""
    gone = decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _without(docs, materialize(gone, "contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the hash of what they decode to."""
    out = bpe.round_trip(docs, public_tokenizers.path(SPEC))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, _Stage]] = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("BPE encoding and decoding", encode)]

#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with temporary_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before is not None:
            delete_table(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
