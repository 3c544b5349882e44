import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemolake.llm import bpe, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"ab'sretlvdm  \n\t.!?,-01 éß中文字", "　", " ", " ", "\u0085", "😀", "<|", "<|endoftext|>", "'ll", "'re", "  ", "\r\n", "don't", "\x1c", "​", "x'", "\0"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.BoundaryCodec(bpe.read_spec(PATH))


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_ids_and_round_trip_match_the_library(codec, tokenizer):
    many = texts(5000, 1) + ["", "a" * 5000, "word " * 3000]
    for text, ids in zip(many, codec.encode([t.encode() for t in many])):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert codec.decode(ids).decode() == tokenizer.decode(want, skip_special_tokens=False)


def test_fragments_are_the_text(codec):
    for t in texts(300, 2):
        assert b"".join(codec.fragments(t.encode())) == t.encode()


def test_tables_with_nulls_and_clashing_columns(spark, tokenizer):
    rows = [(1, "some text", 7), (2, None, 7), (3, "", 7), (1, "some text", 7), (None, "x y", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((a or 0, b or "") for a, b, _ in rows)
    assert all(r.ids == tokenizer.encode(r.text, add_special_tokens=False).ids for r in got)
    assert sorted(bpe.round_trip(df, PATH).collect(), key=repr) == sorted(got, key=repr)
    assert bpe.encode(df.limit(0), PATH).count() == bpe.round_trip(df.limit(0), PATH).count() == 0


def test_remembered_fragments_are_bounded(codec, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 16)  # so that fragments take each other's places
    codec.forget()
    many = texts(400, 5)
    for i in range(0, len(many), 7):
        part = many[i : i + 7]
        assert [x.tolist() for x in codec.encode([t.encode() for t in part])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert len(codec.remembered.lo) == len(codec.remembered.ids) == 16 and codec.remembered.n.max() <= bpe.MOST_IDS
    codec.forget()
    assert codec.remembered is None


def test_files(spark, tokenizer, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.choice([0, 3, 50, 4000])))) for i in range(40)] + [(99, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "start")
    manifest = token_files.write(df, PATH, 2, str(tmp_path / "tokens"), sequence=64)
    got = {x.doc_id: x for x in token_files.read(manifest).collect()}
    assert sorted(token_files.read(manifest, documents=3).collect()) == sorted(got.values())
    at = 0
    for doc, text in sorted(rows, key=lambda x: x[0]):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        x = got[doc]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for m in manifest.collect():
        reader = token_files.TokenReader(m.path)
        last, mask = reader.sequence(m.sequences - 1)
        assert len(last) == 64 and mask.sum() == m.tokens - 64 * (m.sequences - 1)
    assert token_files.read(token_files.write(df.limit(0), PATH, 2, str(tmp_path / "none"))).count() == 0
