"""Functions that Spark has no expression for: Arrow batches through Python."""

from __future__ import annotations

import functools
import hashlib
import html
import re
import unicodedata
from difflib import SequenceMatcher
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

BLOCKS = frozenset("p div section article main header footer ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre br hr figure".split())
DROPPED = frozenset("script style template noscript svg".split())
CHROME = frozenset("nav header footer aside form".split())
VOID = frozenset("br hr img meta link input source area base col embed wbr".split())
ZERO_WIDTH = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
#: Wording of attempts to steer a reader's model, in English and Spanish, and how a line begins that poses as a turn of a
#: chat. (Fixed values.)
FILLER = r"(?:las?|los|todas?|todos?|estas?|esas?|esos|estos|tus|mis|sus|el|lo|cualquier|instrucciones|reglas|indicaciones|directrices|[oó]rdenes|contexto|mensajes?)"
TARGET = r"(?:anteriores|previas|previos|previo|previa|anterior|de\s+arriba)"
INJECTIONS = (
    r"\bignore\s+(?:(?:all|the|any|these|those|my|your)\s+){0,2}(?:previous|prior|above)\b",
    r"\bdisregard\s+(?:(?:the|all|any|these|those|your|my)\s+){0,2}(?:above|previous|prior)\b",
    r"\byou\s+are\s+now\b",
    r"\bnew\s+instructions\b",
    r"\bsystem\s+prompt\b",
    r"\b(?:print|reveal|show|repeat)\s+your\s+(?:system\s+)?(?:prompt|instructions)\b",
    r"\b(?:run|execute)\s+the\s+following\b",
    r"\bexfiltra\w*",
    r"<\/?system\b[^>]*>",
    rf"\b(?:ignora\w*|descarta\w*|olvida\w*)\s+(?:{FILLER}\s+){{0,4}}{TARGET}\b",
    rf"\bhaz\s+caso\s+omiso\s+de\s+(?:{FILLER}\s+){{0,4}}{TARGET}\b",
    r"\bnuevas\s+(?:instrucciones|reglas|directrices|[oó]rdenes)\b",
    r"\b(?:ahora\s+eres|eres\s+ahora|a\s+partir\s+de\s+ahora\s+eres)\b",
    r"\bprompt\s+del?\s+sistema\b",
    r"\b(?:revela\w*|muestra\w*|imprime\w*|repite\w*|comparte\w*|ens[eéií][ñn]a\w*)\s+(?:tu|tus)\s+(?:instrucci[oó]n\w*|prompt|indicaciones|directrices|reglas)\b",
    r"\b(?:ejecuta\w*|corre\w*)\s+(?:el|la|lo|los|las)\s+siguiente",
    r"\b(?:filtra\w*|env[ií]a\w*|manda\w*)\s+(?:(?:los|las|el|mis|tus|sus)\s+){0,2}(?:secretos|credenciales|contrase[nñ]as|claves|tokens|variables\s+de\s+entorno)\b",
)
TURNS = (r"^\s*system\s*:", r"^\s*assistant\s*:", r"^\s*sistema\s*:", r"^\s*asistente\s*:")
_STEER = [re.compile(p, re.I | re.A) for p in INJECTIONS]
_POSE = [re.compile(p, re.I | re.A) for p in TURNS]


def _arrow(kind: str):
    """A pandas UDF that is made when it is used: the type string needs a session."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap


def fold_text(s: str) -> str:
    """Without accents, lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ").lower()


@_arrow("string")
def fold(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


@_arrow("string")
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@_arrow("string")
def slug(s: pd.Series) -> pd.Series:
    """ASCII words joined by dashes, 40 characters at most; untitled without any."""
    def one(x: str) -> str:
        x = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", "-", x).strip("-")[:40].strip("-") or "untitled"

    return s.fillna("").map(one)


def features(text: str) -> list[str]:
    """Words, and trigrams of #word# for those over three letters."""
    out = []
    for w in re.findall(r"[^\W_]+", text.lower()):
        out.append(w)
        if len(w) > 3:
            out += [f"#{w}#"[i : i + 3] for i in range(len(w))]
    return out


def hash_embedding(text: str, dim: int = 256) -> list[float]:
    """Signed feature hashing by BLAKE2b, in single precision, of unit length."""
    return _hash_vector(text, dim).tolist()


@functools.lru_cache(1 << 16)
def _slot(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")


def _hash_vector(text: str, dim: int):
    import numpy as np

    h = np.fromiter(map(_slot, features(text)), np.uint64)
    v = np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0), dim).astype(np.float32)
    n = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v / np.float32(n) if n > 0 else v


def embed(text):
    """Column of hash_embedding() of texts, null as the empty one. A batch is read text by text and written as one array,
    so a task holds neither its texts nor its numbers as objects."""
    import numpy as np

    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), 256), np.float32)
        for i, t in enumerate(texts):
            out[i] = _hash_vector(t.as_py() or "", 256)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 256 * len(texts) + 1, 256, dtype=np.int32)), pa.array(out.ravel()))

    # once for each row: a filter on the vector would otherwise compute it again
    return F.arrow_udf(run, "array<float>").asNondeterministic()(text)


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """Start in a, start in b and length of the longest common block; the earliest in a, then in b, of ties."""
    return tuple(SequenceMatcher(None, a, b, autojunk=False).find_longest_match())


def similarity(a: str, b: str) -> float:
    """Twice the characters in common blocks, found longest first, by all characters; 1 for two empty texts."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@_arrow("double")
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b)])


class _Page(HTMLParser):
    """Visible text, links, assets, title and meta fields of a page."""

    def __init__(self, base: str = "", visible_only: bool = True, main_only: bool = False):
        super().__init__(convert_charrefs=True)
        self.base, self.visible_only, self.main_only = base, visible_only, main_only
        self.text, self.links, self.assets, self.meta = [], [], [], {}
        self.stack: list[tuple[str, bool]] = []
        self.heading, self.json_ld, self._into = "", [], None

    @staticmethod
    def _hides(tag: str, attrs: dict) -> bool:
        style = re.sub(r"\s", "", (attrs.get("style") or "").lower())
        return tag in DROPPED or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in style or "visibility:hidden" in style

    def hidden(self) -> bool:
        return any(h for _, h in self.stack)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in BLOCKS:
            self.text.append("\n")
        if tag == "meta" and (key := a.get("property") or a.get("name")):
            self.meta.setdefault(key.lower(), (a.get("content") or "").strip())
        if tag == "a" and a.get("href") and not self.hidden():
            url = urljoin(self.base, a["href"].strip()).split("#")[0]
            if urlsplit(url).scheme in ("http", "https") and url not in self.links:
                self.links.append(url)
            if url.lower().endswith(".pdf"):
                self.assets.append(("pdf", url))
        if tag == "img":
            for src in [a.get("src") or "", *[x.strip().split(" ")[0] for x in (a.get("srcset") or "").split(",")]]:
                if src:
                    self.assets.append(("image", urljoin(self.base, src)))
        if tag in ("title", "h1") and tag not in self.meta:
            self._into = tag
            self.meta[tag] = ""
        if tag == "script" and "ld+json" in (a.get("type") or ""):
            self._into = "json-ld"
            self.json_ld.append("")
        if tag not in VOID:
            self.stack.append((tag, self._hides(tag, a) or self.main_only and tag in CHROME))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.text.append("\n")
        if self._into == tag or self._into == "json-ld" and tag == "script":
            self._into = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if self._into == "json-ld":
            self.json_ld[-1] += data
        elif self._into:
            self.meta[self._into] += data
        if not (self.visible_only and self.hidden()) and not any(t in ("title", "head") for t, _ in self.stack):
            self.text.append(data)

    def visible(self) -> str:
        lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(self.text).translate(ZERO_WIDTH).split("\n"))
        return "\n".join(x for x in lines if x)


def parse_page(source: str | None, base: str = "", **how) -> _Page:
    p = _Page(base or "", **how)
    p.feed(source or "")
    p.close()
    return p


def by_value(f):
    """A column function of one column that reads an Arrow batch value by value, so no batch is held as objects."""

    def call(column):
        def run(values: pa.Array) -> pa.Array:
            return pa.array((f(v.as_py()) for v in values), pa.string())

        return F.arrow_udf(run, "string")(column)

    return call


def page_text(source):
    """Text without scripts, styles, comments and hidden parts; blocks on lines of their own."""
    return by_value(lambda x: parse_page(x).visible())(source)


@_arrow("string")
def main_text(source: pd.Series) -> pd.Series:
    """Text outside navigation, headers, footers, asides and forms; null under 200 characters."""
    out = source.map(lambda x: parse_page(x, main_only=True).visible())
    return out.where(out.str.len() >= 200, None)


@_arrow("array<string>")
def page_links(source: pd.Series, base: pd.Series) -> pd.Series:
    """Distinct absolute http(s) addresses without fragments, in order."""
    return pd.Series([parse_page(s, b).links for s, b in zip(source, base)])


@_arrow("array<struct<kind:string,url:string>>")
def page_assets(source: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "url": u} for k, u in dict.fromkeys(parse_page(s, b).assets)] for s, b in zip(source, base)])


def _walk(value, key: str):
    if isinstance(value, dict):
        if isinstance(found := value.get(key), str):
            return found
        if isinstance(found, dict) and isinstance(found.get("name"), str):
            return found["name"]
        value = list(value.values())
    return next((f for v in value if (f := _walk(v, key))), None) if isinstance(value, list) else None


def metadata(source: str | None) -> dict:
    import json

    p = parse_page(source)
    data = []
    for x in p.json_ld:
        try:
            data.append(json.loads(x))
        except ValueError:
            pass
    pick = lambda *names: next((re.sub(r"\s+", " ", v).strip() for n in names if (v := p.meta.get(n, "").strip())), None)
    return {"title": pick("og:title", "title", "h1"), "description": pick("og:description", "description"), "site": pick("og:site_name"), "author": pick("author", "article:author") or _walk(data, "author"), "published": pick("article:published_time", "date") or _walk(data, "datePublished")}


@_arrow("struct<title:string,description:string,site:string,author:string,published:string>")
def page_meta(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([metadata(x) for x in source], columns=["title", "description", "site", "author", "published"])


@_arrow("string")
def strip_tags(source: pd.Series) -> pd.Series:
    return source.map(lambda x: re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip(), na_action="ignore")


_HEADING = re.compile(r"#{1,6}\s+(.*\S)")


def sections(text: str, title: str = "") -> list[tuple[str, str]]:
    """(heading, text) in order; what stands before the first heading has the title. Within a fence of ``` or ~~~, which
    ends at the same mark, nothing is a heading."""
    out: list[tuple[str, list[str]]] = [(title.strip(), [])]
    fence = None
    for line in text.split("\n"):
        bare = line.strip()
        mark = bare[:3] if bare[:3] in ("```", "~~~") else None
        heading = None if fence or mark else _HEADING.fullmatch(bare)
        if heading:
            out.append((heading[1], []))
            continue
        if mark:
            fence = mark if fence is None else None if fence == mark else fence
        out[-1][1].append(line)
    return [(h, body) for h, lines in out if (body := "\n".join(lines).strip())]


def chunks(text: str, most: int = 800, least: int = 40, title: str = "") -> list[tuple[str, str]]:
    """(heading, content): pieces of sections of `most` characters at most; a piece under `least` joins the one before. A
    note without a section is one piece: the beginning of its text, or of its title."""
    out: list[tuple[str, str]] = []
    for heading, body in sections(text, title):
        for piece in pack(body, most):
            if out and len(piece) < least:
                out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{piece}")
            else:
                out.append((heading, piece))
    alone = (text if text.strip() else title).strip()[:most]
    return out or ([(title.strip(), alone)] if alone else [])


def pack(text: str, most: int) -> list[str]:
    """Paragraphs packed greedily; a longer one is cut at the last space past the half of a piece, or at its end."""
    out, held = [], ""
    for part in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if held and len(held) + 2 + len(part) > most:
            out.append(held)
            held = ""
        if len(part) <= most:
            held = f"{held}\n\n{part}" if held and part else held or part
            continue
        at = 0
        while at < len(part):
            end = at + most
            if end < len(part) and (space := part.rfind(" ", at + most // 2, end)) > 0:
                end = space
            out.append(part[at:end].strip())
            at = end
    return [x for x in [*out, held] if x]


_CHUNKS = "array<struct<heading:string,content:string>>"


@_arrow(_CHUNKS)
def chunk_text(s: pd.Series) -> pd.Series:
    return s.fillna("").map(lambda x: [{"heading": h, "content": c} for h, c in chunks(x)])


@_arrow(_CHUNKS)
def chunk_note(title: pd.Series, body: pd.Series) -> pd.Series:
    """Chunks of notes whose title stands apart."""
    return pd.Series([[{"heading": h, "content": c} for h, c in chunks(b, title=t)] for t, b in zip(title.fillna(""), body.fillna(""))])


def injection_hits(text: str) -> list[str]:
    """Lines that a pattern fits, then what fits only across line ends and is in no such line."""
    seen = lambda x: unicodedata.normalize("NFKC", x)
    found = [x for x in (y.removesuffix("\r") for y in text.split("\n")) if any(p.search(seen(x)) for p in (*_STEER, *_POSE))]
    whole, held = " ".join(seen(text).split()), [" ".join(seen(x).split()).lower() for x in found]
    for p in _STEER:
        m = p.search(whole)
        if m and not any(m[0].lower() in h for h in held):
            found.append(m[0])
            held.append(m[0].lower())
    return found


@_arrow("array<string>")
def injection_scan(s: pd.Series) -> pd.Series:
    """Lines and phrases that try to steer a reader's model."""
    return s.fillna("").map(injection_hits)


def compact(text: str, head: int = 120, tail: int = 60, repeats: int = 3, least_saved: int = 500) -> str:
    """Console output without colours, repaints and long runs of one line, cut in the middle but for diagnostics."""
    clean = re.sub(r"\x1b\[[0-9;?]*[A-Za-z]", "", text)
    lines = [x.rsplit("\r", 1)[-1] for x in clean.rstrip("\r").split("\n")]
    out: list[str] = []
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j] == lines[i]:
            j += 1
        out += lines[i:j] if j - i <= repeats else [lines[i], f"[… {j - i - 1} more]"]
        i = j
    if len(out) > head + tail:
        keep = {*range(head), *range(len(out) - tail, len(out))}
        for k in range(head, len(out) - tail):
            if re.search(r"\b(error|fail(ed|ure)?|exception|traceback|panic|fatal)\b", out[k], re.I):
                keep |= set(range(k - 1, min(k + 4, len(out))))
        cut, last = [], -1
        for k in sorted(keep):
            if k > last + 1:
                cut.append(f"[… {k - last - 1} lines]")
            cut.append(out[k])
            last = k
        out = cut
    short = "\n".join(out)
    return short if len(text) - len(short) >= least_saved else text


@_arrow("string")
def compact_log(s: pd.Series) -> pd.Series:
    return s.map(compact, na_action="ignore")


def minified(text: str, least_saved: int = 200) -> str:
    """A JSON object or array without white space if that saves `least_saved` characters; anything else as it is."""
    import json

    if text.lstrip()[:1] not in ("{", "["):
        return text
    try:
        short = json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return text
    return short if len(text) - len(short) >= least_saved else text


@_arrow("string")
def minify_json(s: pd.Series) -> pd.Series:
    return s.map(minified, na_action="ignore")


def _shortened(answer: str, shorten, where) -> dict:
    """An answer with the texts in it that `where` finds (holder, key) made shorter; it stays as it is, letter by letter,
    if none gets shorter. Answers that are no JSON are such a text themselves."""
    import json

    before = len(answer)
    try:
        value = json.loads(answer)
    except (ValueError, RecursionError):
        value = answer
    if isinstance(value, str):
        text = shorten(value)
        out = answer if text == value else text if value is answer else json.dumps(text, ensure_ascii=False)
    else:
        changed = False
        for holder, key in where(value):
            text = shorten(holder[key])
            changed, holder[key] = changed or text != holder[key], text
        out = json.dumps(value, ensure_ascii=False) if changed else answer
    return {"text": out, "changed": out != answer, "before": before, "after": len(out)}


def _text_blocks(value):
    """Texts of an answer's content blocks."""
    content = value.get("content") if isinstance(value, dict) else None
    return [(b, "text") for b in content if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)] if isinstance(content, list) else []


#: Fields of a tool's answer that hold its output. (Fixed values.)
OUTPUT_FIELDS = ("stdout", "stderr", "output", "text")


def _outputs(value):
    return [(value, f) for f in OUTPUT_FIELDS if isinstance(value.get(f), str)] if isinstance(value, dict) else []


_SHORTENED = "struct<text:string,changed:boolean,before:int,after:int>"


@_arrow(_SHORTENED)
def compact_blocks(s: pd.Series) -> pd.DataFrame:
    """Answers (JSON) whose text blocks that are JSON themselves lose their white space; other blocks and fields stay."""
    return pd.DataFrame([_shortened(x or "", minified, _text_blocks) for x in s], columns=["text", "changed", "before", "after"])


@_arrow(_SHORTENED)
def compact_outputs(s: pd.Series) -> pd.DataFrame:
    """Answers of tools (JSON) whose output fields are compacted as console output; other fields stay."""
    return pd.DataFrame([_shortened(x or "", compact, _outputs) for x in s], columns=["text", "changed", "before", "after"])


@_arrow("string")
def encode_floats(v: pd.Series) -> pd.Series:
    """Base 64 of little-endian single precision."""
    import base64

    import numpy as np

    return v.map(lambda x: base64.b64encode(np.asarray(x, "<f4").tobytes()).decode(), na_action="ignore")


@_arrow("array<float>")
def decode_floats(s: pd.Series) -> pd.Series:
    import base64

    import numpy as np

    return s.map(lambda x: np.frombuffer(base64.b64decode(x), "<f4").tolist(), na_action="ignore")


@_arrow("string")
def cap_ratio(text: pd.Series, source_chars: pd.Series) -> pd.Series:
    """60 % of the source at most, cut at a sentence end if there is one past the half, with a notice inside the limit."""
    notice = "\n[shortened]"

    def one(x: str, n: int) -> str:
        most = int(0.6 * n)
        if x is None or len(x) <= most:
            return x
        room = max(0, most - len(notice))
        cut = max(x.rfind(". ", room // 2, room), x.rfind("\n", room // 2, room))
        return (x[: cut + 1 if cut > 0 else room].rstrip() + notice)[:most]

    return pd.Series([one(x, n) for x, n in zip(text, source_chars)])
