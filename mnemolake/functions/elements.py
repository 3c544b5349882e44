"""Pages as element trees: selection by CSS selectors, sanitised HTML, result links.

A page is parsed once into a flat list of elements in document order; each knows its parent, its place among its
siblings, and the range of its text among the page's texts, so no walk is recursive and text of nested matches isn't
gathered anew. Broken markup is repaired as far as texts need it: an end tag closes what stands inside it, one without a
start is ignored, paragraphs, items, rows, cells and options end where the next one begins.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from mnemolake.functions.udfs import VOID, by_value, similarity

#: Elements that no reader sees, and styles that hide one; characters without a shape. (Fixed values.)
UNSEEN = frozenset(("script", "style", "template"))
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SHAPELESS = re.compile("[\u200b-\u200f\u2060\ufeff\U000e0000-\U000e007f]")
#: What ends where one of its kind begins, and how far up that goes.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_HEAD = frozenset("base link meta noscript script style template title".split())
_RAW = frozenset(("script", "style"))


class Element:
    """parent; before: the sibling that stands before it; last: its own last child that is an element."""

    __slots__ = ("tag", "attrs", "parent", "before", "last", "place", "children", "begin", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.before, self.last = None, None
        self.place, self.children, self.begin, self.end = 0, [], 0, 0

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class Page(HTMLParser):
    """elements in document order and texts (in order), without those of unseen and hidden elements; comments left out."""

    def __init__(self, source: str | None, seen_only: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.seen_only = seen_only
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self._open = [Element("", {}, None)]
        self._depths: dict[str, list[int]] = {}  # where open elements of each type stand
        self._hidden = 0  # open elements from the outermost hidden one on
        self._document = self._push("html", {})
        self._head = self._push("head", {})
        self._pop()
        self._body = self._push("body", {})
        self.feed(source or "")
        self.close()
        while len(self._open) > 1:
            self._pop()

    def _push(self, tag: str, attrs: dict[str, str]) -> Element:
        parent = self._open[-1]
        e = Element(tag, attrs, parent)
        e.begin = len(self.texts)
        if self._hidden or self.seen_only and (tag in UNSEEN or attrs.get("aria-hidden") == "true" or "hidden" in attrs or HIDING.search(attrs.get("style", ""))):
            self._hidden += 1
        else:
            e.before = parent.last
            e.place = 0 if e.before is None else e.before.place + 1
            parent.last = e
            parent.children.append(e)
            self.elements.append(e)
        self._depths.setdefault(tag, []).append(len(self._open))
        self._open.append(e)
        return e

    def _pop(self) -> None:
        e = self._open.pop()
        e.end = len(self.texts)
        self._depths[e.tag].pop()
        self._hidden = max(0, self._hidden - 1)

    def _depth(self, tags) -> int:
        """Of the innermost open element of these types within the body; 0: none."""
        return max((at[-1] for t in tags if (at := self._depths.get(t)) and at[-1] > 2), default=0)

    def _close(self, depth: int) -> None:
        while len(self._open) > depth:
            self._pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("html", "body", "head"):
            there = {"html": self._document, "body": self._body, "head": self._head}[tag]
            there.attrs = own | there.attrs
            return
        kinds, stop = _ENDS.get(tag, ((), ()))
        for these in ({"td", "th"}, kinds) if tag == "tr" else (kinds,):
            if (depth := self._depth(these)) > self._depth(stop):
                self._close(depth)
        if tag in _END_P and (depth := self._depth(("p",))) > self._depth(("button", "table")):
            self._close(depth)
        # what belongs to the head goes there as long as the body is empty
        if tag in _HEAD and len(self._open) == 3 and not self._body.children:
            self._open[2] = self._head
        self._push(tag, own)
        if tag in VOID:
            self._pop()
            self._leave_head()

    def _leave_head(self) -> None:
        if len(self._open) == 3:
            self._open[2] = self._body

    def handle_endtag(self, tag: str) -> None:
        if depth := self._depth((tag,)):
            self._close(depth)
            self._leave_head()

    def handle_data(self, data: str) -> None:
        if self._hidden:
            return
        at = self._open[-1]
        if at is self._body and not at.children and not data.strip():
            return
        at.children.append(data)
        self.texts.append(data)

    def text(self, e: Element) -> str:
        return "".join(self.texts[e.begin : e.end])

    def shown(self, e: Element) -> str:
        """Text of an element, white space as single blanks, without shapeless characters."""
        return " ".join(SHAPELESS.sub("", self.text(e)).split())

    def render(self) -> str:
        """The page as HTML, without what was left out."""
        out, todo = [], [(self._document, False)]
        while todo:
            x, closes = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif closes:
                out.append(f"</{x.tag}>")
            else:
                out.append(f"<{x.tag}" + "".join(f' {k}="{_attribute(v)}"' for k, v in x.attrs.items()) + ">")
                if x.tag not in VOID:
                    todo.append((x, True))
                    todo += [(c if isinstance(c, Element) else c if x.tag in _RAW else html.escape(c, False).replace("\xa0", "&nbsp;"), False) for c in reversed(x.children)]
        return "".join(out)


def _attribute(value: str) -> str:
    return value.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")


# ---- selectors ----
_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_PART = re.compile(
    rf"""(?P<tag>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*!]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>{_NAME}))\s*(?P<flag>[iIsS])?\s*)?\]
    |:(?P<pseudo>[a-z-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\))?""",
    re.X,
)
_COMBINE = re.compile(r"\s*([>+~])\s*|\s+")
Test = Callable[[Element], bool]


def _attr_test(m: re.Match) -> Test:
    name, op = m["attr"].lower(), m["op"]
    if op is None:
        return lambda e: name in e.attrs
    value = next(v for v in (m["dq"], m["sq"], m["bare"]) if v is not None)
    same = str.lower if m["flag"] in ("i", "I") else str
    want = same(value)
    tests = {"=": lambda v: v == want, "~=": lambda v: want in v.split(), "|=": lambda v: v == want or v.startswith(f"{want}-"), "^=": lambda v: want != "" and v.startswith(want), "$=": lambda v: want != "" and v.endswith(want), "*=": lambda v: want != "" and want in v}
    if op == "!=":
        return lambda e: same(e.attrs.get(name, "")) != want
    return lambda e: name in e.attrs and tests[op](same(e.attrs[name]))


def _nth(arg: str) -> Callable[[int], bool]:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), arg.replace(" ", "").lower())
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not m or not arg:
        raise ValueError(arg)
    a, b = 0 if m[1] is None else int(f"{m[1]}1") if m[1] in ("", "+", "-") else int(m[1]), int(m[2] or 0)
    return lambda n: n == b if a == 0 else (n - b) % a == 0 and (n - b) // a >= 0


def _pseudo_test(name: str, arg: str | None) -> Test:
    plain: dict[str, Test] = {
        "first-child": lambda e: e.place == 0,
        "last-child": lambda e: e.parent.last is e,
        "only-child": lambda e: e.place == 0 and e.parent.last is e,
        "empty": lambda e: not e.children,
    }
    if arg is None:
        return plain[name]
    if name == "nth-child":
        fits = _nth(arg)
        return lambda e: fits(e.place + 1)
    if name in ("not", "is", "where"):
        inner = [_chain(p) for p in _commas(arg)]
        if any(len(c) > 1 for c in inner):
            raise ValueError(arg)  # compounds only
        fits_one = lambda e: any(all(t(e) for t in c[0][1]) for c in inner)
        return (lambda e: not fits_one(e)) if name == "not" else fits_one
    raise ValueError(name)


def _bare(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _part_test(m: re.Match) -> Test:
    if m["tag"]:
        tag = m["tag"].lower()
        return (lambda e: True) if tag == "*" else lambda e: e.tag == tag
    if m["id"]:
        own = _bare(m["id"])
        return lambda e: e.attrs.get("id") == own
    if m["cls"]:
        cls = _bare(m["cls"])
        return lambda e: cls in e.classes
    return _attr_test(m) if m["attr"] else _pseudo_test(m["pseudo"], m["arg"])


def _chain(selector: str) -> list[tuple[str, list[Test]]]:
    """Compounds, each after how it follows the one before."""
    steps, tests, how, at = [], [], " ", 0
    while at < len(selector):
        if tests and (m := _COMBINE.match(selector, at)):
            steps.append((how, tests))
            tests, how, at = [], m[1] or " ", m.end()
            continue
        m = _PART.match(selector, at)
        if not m or m["tag"] and tests:
            raise ValueError(selector)
        tests.append(_part_test(m))
        at = m.end()
    if not tests:
        raise ValueError(selector)
    return [*steps, (how, tests)]


def _fitting(page: Page, steps: list[tuple[str, list[Test]]]) -> list[Element]:
    """Elements that a chain ends at. In document order each element learns which of the chain's beginnings it ends, from
    what its parent and the sibling before it end, and what stands above and before them: one look at each element."""
    none = (0, 0, 0)
    known: dict[int, tuple[int, int, int]] = {}  # what it ends; what it or something above it does; what it or a sibling before does
    out, whole = [], 1 << len(steps) - 1
    for e in page.elements:
        parent, before = known.get(id(e.parent), none), known.get(id(e.before), none) if e.before else none
        reach = {" ": parent[1], ">": parent[0], "+": before[0], "~": before[2]}
        own = 0
        for i, (how, tests) in enumerate(steps):
            if (i == 0 or reach[how] >> i - 1 & 1) and all(t(e) for t in tests):
                own |= 1 << i
        known[id(e)] = (own, own | parent[1], own | before[2])
        if own & whole:
            out.append(e)
    return out


def _commas(selector: str) -> list[str]:
    parts, depth, quote, begin = [], 0, "", 0
    for i, c in enumerate(selector):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            parts.append(selector[begin:i])
            begin = i + 1
    return [p.strip() for p in [*parts, selector[begin:]]]


@functools.lru_cache(256)
def compile_selector(selector: str) -> list:
    """Chains of a selector: types, ids, classes, attributes, the pseudo-classes above, all combinators, lists. ValueError
    or KeyError for anything else."""
    return [_chain(p) for p in _commas(selector)]


def matching(page: Page, selector: str) -> list[Element]:
    """Elements that a selector matches, in document order."""
    chains = compile_selector(selector)
    if len(chains) == 1:
        return _fitting(page, chains[0])
    fits = {id(e) for c in chains for e in _fitting(page, c)}
    return [e for e in page.elements if id(e) in fits]


def select(source: str | None, selector: str | None) -> list[str]:
    """Texts of the seen elements that a selector matches, in document order, without empty ones; none for a selector
    that isn't one."""
    page = Page(source)
    try:
        found = matching(page, selector or "")
    except (ValueError, KeyError):
        return []
    return [t for e in found if (t := page.shown(e))]


def sanitised(source: str | None) -> str:
    """The page without unseen and hidden elements and comments, as HTML."""
    return Page(source).render()


# ---- links of result pages ----
#: Hosts of search pages themselves and endings of addresses that no reader can read. (Fixed values.)
SEARCH_HOSTS = frozenset("duckduckgo.com bing.com microsoft.com brave.com search.brave.com mojeek.com marginalia.nu search.marginalia.nu old-search.marginalia.nu ecosia.org startpage.com".split())
UNREADABLE = frozenset(
    "7z 7zip bz2 rar tar gz xz zip mng pct bmp gif jpg jpeg png tif tiff svg ico webp mp3 wma ogg wav aac mp4 mov avi mpg webm flv wmv m4a m4v xls xlsx ppt pptx doc docx odt ods odp pdf exe bin dmg iso apk jar msi".split()
)
LEAST_TITLE, LEAST_ALIKE, NEAR_TEXT, SNIPPET = 12, 0.3, 600, 400


def _host(url: str) -> str | None:
    m = re.match(r"(?i)https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", url)
    return m[1].lower().removeprefix("www.") if m else None


def _text_between(page: Page, begin: int, end: int, most: int) -> str:
    held = ""
    for piece in page.texts[begin:end]:
        held += piece
        if len(held) >= most:
            break
    return " ".join(held[:most].split())


def generic_links(source: str | None, query: str | None, limit: int = 8) -> list[dict]:
    """Anchors of any page that look like results for a query: url, title, snippet (the text up to the next anchor),
    alike (similarity of both to the query), best first, ties in document order.

    Left out: titles of under LEAST_TITLE characters, repeated addresses, hosts of search pages, files that no page
    shows, and what is LEAST_ALIKE or less like the query.
    """
    page, asked = Page(source, seen_only=False), (query or "").strip().lower()
    anchors = [e for e in page.elements if e.tag == "a"]
    found, seen = [], set()
    for i, e in enumerate(anchors):
        url, title = e.attrs.get("href", ""), " ".join(page.text(e).split())
        host = _host(url)
        ending = re.search(r"\.([a-z0-9]{1,5})$", re.split(r"[?#]", url)[0].lower())
        if host is None or len(title) < LEAST_TITLE or url in seen or host in SEARCH_HOSTS or ending and ending[1] in UNREADABLE:
            continue
        seen.add(url)
        until = next((n.begin for n in anchors[i + 1 :] if n.begin >= e.end), len(page.texts))
        snippet = _text_between(page, e.end, until, NEAR_TEXT)[:SNIPPET]
        alike = similarity(asked, f"{title} {snippet}".lower()) if asked else 0.0
        if alike > LEAST_ALIKE:
            found.append({"url": url, "title": title, "snippet": snippet, "alike": alike})
    return sorted(found, key=lambda f: -f["alike"])[:limit]


def block_results(source: str | None, block: str = "li.b_algo", anchor: str = "h2 > a[href]", snippet: str = "p") -> list[dict]:
    """url, title, snippet of the blocks of a result page that hold an anchor with a title."""
    page = Page(source, seen_only=False)
    blocks, anchors, snippets = ({id(e) for e in matching(page, x)} for x in (block, anchor, snippet))
    out: list[dict] = []
    owner: dict[int, dict] = {}
    for e in page.elements:
        up = owner.get(id(e.parent))
        if id(e) in blocks:
            up = {}
            out.append(up)
        if up is not None:
            owner[id(e)] = up
            for kind, fits in (("a", anchors), ("p", snippets)):
                if kind not in up and id(e) in fits:
                    up[kind] = e
    rows = [{"url": b["a"].attrs["href"], "title": " ".join(page.text(b["a"]).split()), "snippet": " ".join(page.text(b["p"]).split()) if "p" in b else ""} for b in out if "a" in b]
    return [r for r in rows if r["url"] and r["title"]]


def anchor_results(source: str | None, anchor: str = "a.result-header, a.snippet-title, a.h", snippet: str = ".snippet-description") -> list[dict]:
    """url, title, snippet of the result anchors of a page, the first of each address; a snippet is the first one behind
    its anchor and before the next."""
    page = Page(source, seen_only=False)
    anchors, snippets = ({id(e) for e in matching(page, x)} for x in (anchor, snippet))
    out: list[dict] = []
    for e in page.elements:
        if id(e) in anchors and _host(e.attrs.get("href", "")) is not None and page.text(e).strip():
            out.append({"url": e.attrs["href"], "title": " ".join(page.text(e).split()), "snippet": None})
        elif out and out[-1]["snippet"] is None and id(e) in snippets:
            out[-1]["snippet"] = " ".join(page.text(e).split())
    first: dict[str, dict] = {}
    for r in out:
        first.setdefault(r["url"], r | {"snippet": r["snippet"] or ""})
    return list(first.values())


# ---- column functions ----
RESULTS = "array<struct<url:string,title:string,snippet:string>>"


def _udf(f, kind: str):
    return F.pandas_udf(f, kind)


def select_text(source, selector):
    """Column of texts: what `selector` (a column or a string) selects in the pages of `source`."""

    def run(pages: pd.Series, selectors: pd.Series) -> pd.Series:
        return pd.Series([select(p, s) for p, s in zip(pages, selectors)])

    return _udf(run, "array<string>")(source, F.lit(selector) if isinstance(selector, str) else selector)


def sanitised_html(source):
    return by_value(sanitised)(source)


def results(source, parser: str, **selectors: str):
    """Column of results of the pages in `source`; parser: "blocks" or "anchors"."""
    parse = {"blocks": block_results, "anchors": anchor_results}[parser]

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: parse(p, **selectors))

    return _udf(run, RESULTS)(source)


def generic_results(source, query, limit: int = 8):
    def run(pages: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([generic_links(p, q, limit) for p, q in zip(pages, queries)])

    return _udf(run, "array<struct<url:string,title:string,snippet:string,alike:double>>")(source, query)
