"""Secret scans by sliding-window entropy.

Candidates are runs of the characters that keys are written in. A window slides over each candidate; the counts of its
characters, and with them the Shannon entropy, are updated as one character enters and one leaves. Windows whose
entropy reaches the threshold of the candidate's character class (digits, hexadecimal, letters and digits, base 64)
are joined to spans. An allow list suppresses what is known to look random and be harmless; the spans of the fixed
patterns always stay. Runs of letters, alone or in names and paths, pass the allow list if they read like words: most of
their neighbouring consonants are pairs that words have, and their capitals stand where words begin.

Null and empty texts have no spans; texts are scanned whole, however long; repeated rows give repeated results. An
empty table gives an empty result. Extra columns are ignored. Places are code points.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from mnemolake.llm.common import id_and_text, map_batches, small_batches

#: Fixed patterns, over Latin-1 bytes with one byte for each code point. (Fixed values.)
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

WINDOW = 20
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Class pattern and entropy, in bits a character, from which a window of WINDOW characters counts.
CLASSES = ((re.compile(rb"[0-9]+"), 2.8), (re.compile(rb"[A-Za-z]+"), 3.1), (re.compile(rb"[0-9a-fA-F]+"), 2.9), (re.compile(rb"[A-Za-z0-9]+"), 3.75), (re.compile(rb"[A-Za-z0-9+/_=-]+"), 3.9))
#: Harmless: UUIDs, dates and times (also 20 to 23 digits in a row), one character over and over.
ALLOWED = tuple(re.compile(p) for p in (rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", rb"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_0-9-]*", rb"(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:[01][0-9]|2[0-3])[0-5][0-9][0-6][0-9][0-9]{6,9}", rb"(.)\1*"))
#: Paths and names: parts of letters or digits.
NAME = re.compile(rb"(?![0-9]+\Z)[/_=-]*(?:[A-Za-z]+|[0-9]+)(?:[/_=-]+(?:[A-Za-z]+|[0-9]+))*[/=_-]*")
#: Pairs of consonants that words of European languages have within. (Fixed values.)
PAIRS = frozenset(
    b"bb bj bl br bs bt cc ch ck cl cr cs ct dd dg dl dr ds dv dw dy ff fl fr ft fs gg gh gl gn gr gs gt hl hm hn hr ht hs "
    b"kl km kn kr ks kt lb lc ld lf lg lh lk ll lm ln lp lr ls lt lv lw ly mb mf mm mn mp ms nb nc nd nf ng nh nj nk nl nm nn np nq nr ns nt nv nw ny nz "
    b"ph pl pp pr ps pt py rb rc rd rf rg rh rj rk rl rm rn rp rq rr rs rt rv rw ry rz sb sc sd sf sg sh sk sl sm sn sp sq sr ss st sv sw sy "
    b"tb tc tf th tl tm tn tp tr ts tt tw ty tz vr wh wl wn wr ws xc xp xt yc yl ym yn yp yr ys yt zz".split()
)
#: Share of neighbouring letters that are other pairs of consonants, and letters a capitalised piece, of what isn't words.
ODD, SHORT_PIECES = 0.17, 2.5
_CONSONANTS = frozenset(b"bcdfghjklmnpqrstvwxz")
_PIECES = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")

#: Digits in the order of counting, and numbers with a decimal point before or after them, are harmless too.
_COUNTING = (b"0123456789" * 2, b"9876543210" * 2)
_FRACTION = re.compile(rb"[0-9][.,]\Z"), re.compile(rb"[.,][0-9]")

_KEY_BYTES = bytes(1 if re.fullmatch(rb"[A-Za-z0-9+/_=-]", bytes([b])) else 0 for b in range(256))
_HEX_BYTES = bytes(1 if re.fullmatch(rb"[0-9a-f]", bytes([b])) else 0 for b in range(256))


def base_spans(text: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    if b"\1" * 32 in text.translate(_HEX_BYTES):
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def _terms(window: int) -> list[float]:
    return [0.0] + [c * math.log2(c) for c in range(1, window + 1)]


_TERMS = _terms(WINDOW)


def entropies(data: bytes, window: int = WINDOW):
    """Entropy of each window, in bits a character, by counts that change with one character in and one out."""
    term = _TERMS if window == WINDOW else _terms(window)
    counts = Counter(data[:window])
    total = sum(term[c] for c in counts.values())
    bits = math.log2(window)
    yield bits - total / window
    for gone, come in zip(data, data[window:]):
        if gone != come:
            a, b = counts[gone], counts[come]
            total += term[a - 1] - term[a] + term[b + 1] - term[b]
            counts[gone], counts[come] = a - 1, b + 1
        yield bits - total / window


def _is_number(text: bytes, start: int, end: int) -> bool:
    word = text[start:end]
    if not word.isdigit():
        return False
    counting = any(all(word[i : i + 10] in c for i in range(0, len(word), 10)) and word[10:] == word[:-10] for c in _COUNTING)
    return counting or bool(_FRACTION[0].search(text[max(0, start - 2) : start]) or _FRACTION[1].match(text[end : end + 2]))


def reads_like_words(word: bytes) -> bool:
    """Whether a name's letters could be words: names without letters are."""
    pieces = _PIECES.findall(word)
    letters = sum(map(len, pieces))
    runs = re.findall(rb"[A-Za-z]+", word)
    if letters < SHORT_PIECES * len(pieces) and any(p.islower() or len(p) > 1 and not p.isupper() for p in pieces) and letters > 2 * len(runs):
        return False
    low = [p.lower() for p in pieces]
    pairs = sum(len(p) - 1 for p in low)
    odd = sum(p[i : i + 2] not in PAIRS for p in low for i in range(len(p) - 1) if p[i] in _CONSONANTS and p[i + 1] in _CONSONANTS)
    return odd < ODD * pairs or pairs < 8


def entropy_spans(text: bytes) -> list[tuple[int, str, int]]:
    if b"\1" * WINDOW not in text.translate(_KEY_BYTES):
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if any(p.fullmatch(word) for p in ALLOWED) or NAME.fullmatch(word) and reads_like_words(word) or _is_number(text, *m.span()):
            continue
        least = next(bits for p, bits in CLASSES if p.fullmatch(word))
        begin = end = None
        for i, bits in enumerate(entropies(word)):
            if bits >= least:
                if begin is not None and i > end:
                    out.append((m.start() + begin, "entropy", m.start() + end))
                    begin = None
                begin, end = i if begin is None else begin, i + WINDOW
        if begin is not None:
            out.append((m.start() + begin, "entropy", m.start() + end))
    return out


def scan(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans of a text, by start, then kind as listed."""
    data = text.encode("latin-1", "replace")
    return sorted(base_spans(data) + entropy_spans(data), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))




def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: doc_id and found, an array of (kind, start, end)."""
    small_batches(df.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": a, "end": b} for a, k, b in scan(t)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return map_batches(id_and_text(df, id_col, text_col), run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")
