import hashlib
import random
import re
import zlib

import pytest

from mnemolake.llm import fill_in_middle, periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(s, exponent=4, shortest=6):
    """All maximal stretches of each period; of equal stretches the smallest period."""
    best = {}
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(shortest, exponent * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in best.items())


def row_by_hand(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    ends = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return doc_id, len(runs), *ends, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (2, 2), (3, 5)])
def test_runs_of_random_sequences(exponent, shortest):
    dice = random.Random(exponent)
    for _ in range(1500):
        n, k = dice.randint(0, 48), dice.randint(1, 3)
        s = [dice.randrange(k) for _ in range(n)]
        if n and dice.random() < 0.6:
            a, p = dice.randrange(n), dice.randint(1, max(1, n // 4))
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        assert periodic_runs.runs(s, exponent, shortest) == runs_by_hand(s, exponent, shortest), s
    with pytest.raises(ValueError):
        periodic_runs.runs([1], 1)


def test_ordered_sets_merge_alike_whatever_their_sizes():
    dice = random.Random(5)
    for sizes in ((500, 400), (5000, 70), (300, 3)):
        both = dice.sample(range(-9999, 0), sum(sizes))
        large, small = sorted(both[: sizes[0]]), sorted(both[sizes[0] :])
        whole = sorted(both)
        met = set(periodic_runs._merged(large, small))
        assert large == whole
        new = set(small)
        assert met >= {(a, b) for a, b in zip(whole, whole[1:]) if (a in new) != (b in new)}
        assert all((a in new) != (b in new) for a, b in met)


def test_periodic_query_on_the_whole_table_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, folder).collect())
    want = sorted(row_by_hand(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert got == want and sum(r[1] for r in got) > 10


def test_odd_texts_of_periodic_runs(spark):
    long = " ".join(["so", "it", "goes"] * 30_000)
    texts = [None, "", " \t\r\n\v\f ", "a a a a a", "a a a a a a", "x\ny z\tx y z x y z x y z end", "é é " * 8, "a a " * 9, long, "go " * 6 + "stop " + "go " * 6]
    rows = [(i, t, 0, None) for i, t in enumerate(texts)] + [(4, texts[4], 0, None), (None, texts[5], 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs array<long>")
    got = periodic_runs.find_runs(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[5] if r.doc_id is None else texts[r.doc_id]
        words = WORD.findall(text or "")
        runs = [(0, len(words), 3)] if text is long else runs_by_hand(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic_runs.find_runs(df.limit(0)).collect() == []
    rewritten = queries.repeating(df).collect()
    assert len(rewritten) == len(rows) and {r.text for r in rewritten if r.doc_id is None} == {texts[5]}


def test_conditions_before_the_automaton_keep_all_runs(spark):
    dice = random.Random(9)
    texts = []
    for _ in range(400):
        words = [dice.choice("abcdefgh") for _ in range(dice.randint(0, 60))]
        for _ in range(dice.randint(0, 3)):
            at, unit = dice.randint(0, len(words)), [dice.choice("abcdefgh") for _ in range(dice.randint(1, 6))]
            words[at:at] = (unit * 6)[: dice.randint(4 * len(unit), 6 * len(unit))]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for exponent, shortest in ((4, 6), (2, 4)):
        for r in periodic_runs.find_runs(df, exponent=exponent, shortest=shortest).collect():
            assert [tuple(x) for x in r.runs] == runs_by_hand(texts[r.doc_id].split(), exponent, shortest)


def fim_by_hand(doc_id, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    return n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle_against_slices(spark):
    dice = random.Random(3)
    alphabet = ["a", "\n", "\r", "é", "é", "中", "\U0001F600", "<", "P", ">", "\0", " ", " "]
    sizes = [0, 1, 2, 63, 64, 65, 127, 128, 129, 4096]
    texts = ["".join(dice.choice(alphabet) for _ in range(sizes[i] if i < len(sizes) else dice.randint(0, 300))) for i in range(300)]
    texts += [None, "say <M> here", "<P", "M>", "é\n" * 900_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "y"), (None, "nobody's text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = fill_in_middle.fill_in_middle(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "nobody's text" if r.doc_id is None else texts[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim_by_hand(r.doc_id, text)
        assert r.restored == (text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(df.limit(0)).collect() == []


def test_cuts_at_both_ends_and_marks_that_nearly_arise():
    for text in ("<S<S", "<P<M", ">>", "<", "ab"):
        for h1 in range(len(text) + 1):
            for h2 in range(len(text) + 1):
                for h4 in (0, 50):
                    n, form, p, m, out = fill_in_middle.transform(text, h1, h2, 0, h4)
                    assert (n, p, m) == (len(text), min(h1, h2), abs(h1 - h2)) and fill_in_middle.restore(out, form) == text
