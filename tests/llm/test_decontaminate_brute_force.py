"""Decontamination against a plain version that compares every item with every document, without hashes or joins."""

import random
import re

from mnemolake.llm import decontaminate as d

WORD = re.compile(r"[0-9A-Za-z$%\u0080-\U0010ffff]+(?:(?<=[0-9])[.,](?=[0-9])[0-9A-Za-z$%\u0080-\U0010ffff]+)*")
UNITS = set(d.UNITS.split())


def canonical(text, form):
    """(kind, shown, value, whether it opens a sentence) of each canonical word of a text in a form."""
    out, last_end, before_number, before_name = [], 0, False, False
    for m in WORD.finditer(text):
        word = m[0]
        opens = last_end == 0 and not out or bool(re.search(r"[.!?:\n]", text[last_end : m.start()]))
        number = word[0].isdigit()
        unit = not number and before_number and word.lower() in UNITS
        small = sum(c.islower() for c in word)
        name = form < 2 and not number and not unit and word[0].isupper() and small > 0 and (form == 1 or not opens)
        last_end, before_number = m.end(), number
        if form == 2:
            out.append([3, word.lower(), word, None, opens])
            continue
        if name and before_name and not opens:
            out[-1][2] = text[out[-1][3] : m.end()]
        else:
            kind = 0 if number else 1 if unit else 2 if name else 3
            out.append([kind, f"<{d.SLOTS[kind]}>" if kind < 3 else word.lower(), word, m.start(), opens])
        before_name = name
    return [(*w[:3], w[4]) for w in out]


def places_of(doc, item):
    """Good places of an item in a document, in one form: their number, greatest share, whether one has the item's values."""
    size = min(d.K, len(item))
    literals = lambda i: sum(w[0] == 3 for w in item[i : i + size])
    windows = [i for i in range(len(item) - size + 1) if len(item) >= d.SHORTEST and literals(i) >= (d.FEWEST if size == len(item) else d.LITERALS)]
    sentence = lambda j: doc[j][3] and (j + size == len(doc) or doc[j + size][3])
    hits = sorted((j - i, i) for i in windows for j in range(len(doc) - size + 1) if all(a[:2] == b[:2] for a, b in zip(item[i : i + size], doc[j : j + size])) and (literals(i) >= min(d.LITERALS, size) or sentence(j)))
    runs = []
    for hit in hits:
        if not runs or hit[0] - runs[-1][-1][0] > d.NEAR:
            runs.append([])
        runs[-1].append(hit)
    good = []
    for run in runs:
        pairs = {(item[i + k][0], item[i + k][2], doc[i + diagonal + k][2]) for diagonal, i in run for k in range(size) if item[i + k][0] < 3}
        consistency = len({p[:2] for p in pairs}) / len(pairs) if pairs else 1.0
        share = len({i for _, i in run}) / len(windows)
        covered = len({i + k for _, i in run for k in range(size)}) / len(item)
        if (share >= d.ENOUGH or covered >= d.COVERED) and consistency >= d.CONSISTENT:
            good.append((share, all(p[1] == p[2] for p in pairs)))
    return good


def brute_force(docs, items):
    out = {}
    for doc_id, text in docs:
        for item_id, item in items:
            forms = [places_of(canonical(text or "", form), canonical(item or "", form)) for form in d.FORMS]
            if any(forms):
                out[doc_id, item_id] = (max(map(len, forms)), round(max(s for f in forms for s, _ in f), 9), any(same for f in forms for _, same in f))
    return out


def _question(r):
    names, things = ["Alice", "Bob Stone", "Carol", "Élise", "Dr Vane"], ["apples", "pears", "old boats", "maps"]
    a, b = r.choice(names), r.choice(names)
    return f"{a} has {r.randint(2, 40)} {r.choice(things)} and walks {r.randint(2, 90)} km to the market. Then {b} takes {r.randint(2, 9)}.5 kg of them, so how many are left for {a} at night?"


def test_all_pairs_of_a_fixture(spark):
    r = random.Random(11)
    plain = "the sea was calm and nobody on the long quay spoke a word before the bell rang".split()
    items = [(i, _question(r)) for i in range(8)]
    items += [(20, "What is 12 times 7?"), (21, "short one"), (22, None), (23, ""), (24, " ".join(plain)), (25, items[0][1]), (26, "What is 12 plus 30?"), (27, "Add 12 and 30"), (28, "Paris"), (29, "the long quay")]
    docs = [(1, None), (2, ""), (3, "x"), (4, "What is 13 times 7? What is 12 times 7?")]
    docs += [(5, "Sums: what is 99 plus 7? Add 5 and 6. We add 5 and 6 to what is 1 plus 2 now."), (6, "Paris\nI love Paris in the spring on the long quay"), (7, "We sat.\nThe long quay\nwas wet")]
    for n in range(60):
        filler = " ".join(r.choice(plain) for _ in range(r.randint(0, 30)))
        text = r.choice(items[:8])[1] if n % 3 else _question(r)
        if n % 4 == 1:
            words = text.split()
            words[r.randrange(len(words))] = "other"
            text = " ".join(words)
        if n % 5 == 2:
            text = text.upper()
        if n % 7 == 3:
            text = text + "\n" + text
        if n % 6 == 4:
            cut = r.randint(3, 20)
            text = " ".join(text.split()[:cut])
        docs.append((100 + n, f"{filler}. {text} {filler}"))
    docs.append((500, " ".join(plain[:9] + ["quietly"] + plain[9:])))
    docs.append((501, " ".join(r.choice(plain) for _ in range(20_000)) + ". " + items[1][1]))
    want = brute_force(docs, items)
    df = spark.createDataFrame([(*x, "k", 0.5) for x in docs], "doc_id long, text string, gram string, share double")
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_places int")
    got = {(x.doc_id, x.item_id): (x.n_places, round(x.share, 9), x.same_values) for x in d.contaminated(df, benchmark).collect()}
    assert got == want
    assert {(5, 26), (5, 27), (7, 29)} <= set(want) and want[5, 27][0] == 1 and {item for doc, item in want if doc == 6} == {29} and not any(item == 28 for _, item in want)
    assert len(want) > 40 and {(4, 20), (500, 24), (501, 1)} <= set(want) and not {1, 2, 3} & {doc for doc, _ in want}


def test_repeated_rows_and_ids(spark):
    item = "How many of the 12 old boats did Bob sail over the 40 km to the far harbour?"
    items = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(7, item), (7, item), (None, item), (8, "nothing of it")], "doc_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminated_rows(docs, items)]
    assert sorted(got, key=str) == sorted([(7, 1), (7, 1), (None, 1)], key=str)


def decontaminated_rows(docs, items):
    return d.contaminated(docs, items).collect()
