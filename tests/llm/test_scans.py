import hashlib
import re

import pytest

from mnemolake.llm import license_scan, secret_scan

PHRASES = {k: v.split() for k, v in license_scan.PHRASES.items()}


def license_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for label, p in PHRASES.items() for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in hits}))


LICENSES = ["Released under the MIT License. Licensed under the Apache License, Version 2.0.", "CC BY-NC! and cc by nc; under the é mit license", "under under the mit license " * 40, None, "", "x", "İ under\nthe MIT license", "This work is licensed under the GNU General Public License, version 3.", "Permission is hereby granted, free of charge, to any person (really) obtaining a copy of this software and associated files"]


def test_license_places(spark):
    df = spark.createDataFrame([(i, t, 0, "a") for i, t in enumerate(LICENSES)] + [(0, LICENSES[0], 0, "a")], "doc_id long, text string, n_words int, labels string")
    got = license_scan.license_report(df).collect()
    assert len(got) == len(LICENSES) + 1
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_by_hand(LICENSES[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].labels == "gpl-3" and by_id[8].labels == "mit" and by_id[8].n_base == 0
    assert license_scan.license_report(df.limit(0)).count() == 0


def base_by_hand(text):
    out = []
    for kind, pattern, keep in (("assign", r"""((?i:[pP]assword|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.A) if keep(m)]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


SECRETS = ["é token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" x", "token: secret: abcdefghijk", "Password='short' API_KEY:longenough1", "AKIAABCDEFGHIJKL12 AKIAX", "toKen: abcdefghijkl", "ſecret=abcdefghij", "a" * 40 + " " + "0123456789abcdef" * 2, "", "中" * 50 + "apikey=ABCDEFGH+/="]


@pytest.mark.parametrize("text", SECRETS)
def test_base_spans(text):
    assert [s for s in secret_scan.scan(text) if s[1] != "entropy"] == base_by_hand(text)


def test_entropy_by_increments_and_allow_list():
    import math
    from collections import Counter

    data = b"aZ3k9Lq0aaaaXy7Pw2Vb5Nc8aaaaaaaaaaaaaaaaaaaaaaZ"
    for i, bits in enumerate(secret_scan.entropies(data)):
        c = Counter(data[i : i + secret_scan.WINDOW])
        assert abs(bits + sum(n / secret_scan.WINDOW * math.log2(n / secret_scan.WINDOW) for n in c.values())) < 1e-9
    kinds = lambda t: [k for _, k, _ in secret_scan.scan(t)]
    assert "entropy" in kinds("key aZ3k9Lq0bXy7Pw2Vb5Nc8Rt4 end")
    assert kinds("id 123e4567-e89b-12d3-a456-426614174000 some/path/of/words-and-more") == []


def test_random_digits_are_found_but_dates_and_numbers_are_not():
    digits = "83920174659102837465"
    assert secret_scan.scan(f"pin {digits} end") == [(4, "entropy", 24)]
    for harmless in ("0" * 24, "12345678901234567890", "98765432109876543210", "20190131235959123456", f"3.{digits}", f"{digits}.5", "1000000000000000000000"):
        assert secret_scan.scan(f"x {harmless} y") == []


def test_secret_tables(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(SECRETS)] + [(50, None, "x")], "doc_id long, text string, found string")
    got = {r.doc_id: r.found for r in secret_scan.secret_spans(df).collect()}
    for i, t in enumerate(SECRETS):
        assert [(s.start, s.kind, s.end) for s in got[i]] == secret_scan.scan(t)
    assert got[50] == [] and secret_scan.secret_spans(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_random_letters_are_found_but_names_and_paths_are_not():
    import random
    import string

    from pyspark.sql import functions

    dice, spans = random.Random(4), lambda t: [s for s in secret_scan.scan(f"x {t} y") if s[1] == "entropy"]
    for alphabet in (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters):
        for n in (20, 30, 40):
            found = sum(bool(spans("".join(dice.choice(alphabet) for _ in range(n)))) for _ in range(300))
            assert found >= 0.85 * 300, (alphabet, n, found)
    names = {x for m in (functions, re, hashlib, pytest, string, random) for x in dir(m)} | {x for c in vars(functions).values() if isinstance(c, type) for x in dir(c)}
    long = [a + b for a in sorted(names) for b in ("", "_of_all_documents", "ForEveryCustomer") if len(a + b) >= 20 and re.fullmatch("[A-Za-z_]+", a)]
    paths = [f"src/main/{a}/{b}" for a in sorted(names)[:60] for b in ("operators/ranking", "Streaming-Sources") if re.fullmatch("[A-Za-z_]+", a)]
    bad = [x for x in long + paths if spans(x)]
    assert len(long) > 500 and len(bad) <= 0.01 * len(long + paths), bad[:9]


def test_very_long_candidates_and_repeated_rows(spark):
    import random
    import string

    dice = random.Random(8)
    key = "".join(dice.choice(string.ascii_letters + string.digits + "+/") for _ in range(200_000))
    rows = [(1, key), (1, key), (2, "a" * 300_000), (3, f"token={key}")]
    got = secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id, [(s.start, s.kind, s.end) for s in r.found]) for r in got)
    assert found[0] == found[1] and found[0][1] and found[0][1][0][0] < 20 and found[0][1][-1][2] > 199_900
    assert found[2] == (2, [(0, "hex", 300_000)]) and found[3][1][0] == (0, "assign", 200_006)
