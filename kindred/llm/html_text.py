"""Main text of web pages by a minimum cut.

A page becomes a list of text blocks.  A linear classifier gives each block the
cost of calling it boilerplate and the cost of calling it content; these are
the capacities of its edges from the source and to the sink.  Blocks that
follow one another, and blocks under the same parent, are joined by smoothness
edges.  The minimum cut, found by maximum flow, labels all blocks at once.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Smoothness between neighbours in the page, and between neighbours under the same parent, in addition.
NEXT, SIBLING = 0.4, 0.8
#: Weights of the classifier's features (positive: content).
WEIGHTS = {"article": 6.0, "main": 3.0, "boilerplate_tag": -12.0, "boilerplate_name": -12.0, "page_header": -9.0, "link_share": -5.0, "words": 0.7, "sentence": 0.8, "list_item": -0.6, "bias": -1.2}

# Elements whose text is not shown, elements that end a block, elements of boilerplate, elements that end an open paragraph, elements without an end.
HIDDEN = frozenset("script style noscript template head title textarea select option button svg iframe object canvas math audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
ENDS_P = frozenset("p h1 h2 h3 h4 h5 h6 ul ol div section table article footer aside nav header form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role that mark boilerplate where they are a whole token or begin one.
NAMES = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer gdpr masthead menu modal nav navbar navigation newsletter notification notifications outbrain pagination popup promo promoted promotion related replies reply share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split())
# Whole tokens only; words that mark a token's last word as not its subject; words before `header` of a page.
WHOLE = frozenset("header notice notices site-notice".split())
NEGATED = frozenset("no not has have with without hide show is non".split())
PAGE = frozenset("site page main top global web".split())
# Names that count on an article too.
SAID = frozenset("comment comments reply replies".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>", re.S)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)")
_PART = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


@dataclass
class Element:
    name: str
    parent: Element | None
    key: int
    depth: int = 0
    links: int = 0
    block: Element | None = None
    hidden: bool = False
    boilerplate: bool = False
    named: bool = False
    article: bool = False
    main: bool = False
    header: bool = False


@dataclass
class Block:
    owner: Element
    parts: list[str] = field(default_factory=list)
    solid: bool = False
    linked: int = 0
    text: str = ""


def _hides(rest: str) -> bool:
    """Whether the attributes have a `hidden` one that is not false, or a style that does not show the element."""
    low = rest.lower()
    if "hidden" not in low and "none" not in low and "&" not in low:
        return False
    for m in _ATTRIBUTE.finditer(low):
        value = entities.unescape(m[2] or "").strip("\"'")
        if m[1] == "hidden" and value.strip() != "false" or m[1] == "style" and _UNSEEN.search(value):
            return True
    return False


def _boilerplate_names(rest: str) -> set[str]:
    """The words by which tokens of class, id and role mark boilerplate.

    A token counts as a whole, by its first word, or by its last unless the
    first negates it (`no-sidebar`) or it ends in `header` (`entry-header`,
    but `site-header` counts).
    """
    out: set[str] = set()
    for m in _NAMED.finditer(rest):
        for token in _CAMEL.sub("-", entities.unescape(m[1]).strip("\"'")).lower().split():
            parts = _PART.findall(token)
            if token in WHOLE:
                out.add(token)
            elif parts and parts[0] in NAMES:
                out.add(parts[0])
            elif len(parts) > 1 and parts[0] not in NEGATED and (parts[-1] in NAMES or parts[-1] == "header" and parts[0] in PAGE):
                out.add(parts[-1])
    return out


def _child(parent: Element, name: str, rest: str, key: int) -> Element:
    names: set[str] = set()
    if rest and (low := rest.lower()) and ("class" in low or "id" in low or "role" in low) and name not in ("body", "html", "main"):
        names = _boilerplate_names(rest)
        if name == "article":
            names &= SAID
        if parent.article or name == "article":
            names -= WHOLE  # an article has its own header and notices
    inside = parent.article or name == "article"
    child = Element(
        name, parent, key, parent.depth + 1, parent.links + (name == "a"), None,
        hidden=parent.hidden or name in HIDDEN or bool(rest) and _hides(rest),
        boilerplate=parent.boilerplate or name in BOILERPLATE,
        named=(parent.named and name != "main") or bool(names),
        article=inside, main=parent.main or name == "main" or 'role="main"' in rest,
        header=parent.header or (name == "header" and not inside),
    )
    child.block = child if name in BLOCK else parent.block
    return child


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page that are shown, in page order; end tags that are missing are put in.

    Every step takes time that does not grow with the depth of the page, but
    for elements that it closes.
    """
    page = page or ""
    root = Element("", None, 0)
    root.block = root
    at, here, key = 0, root, 0
    open_names: Counter[str] = Counter()
    out: list[Block] = []
    block = Block(root)

    def close() -> None:
        nonlocal block
        text = " ".join("".join(block.parts).split())
        if text:
            block.text = text
            out.append(block)
        block = Block(here)

    def say(text: str, written: bool = True) -> None:
        if text and not here.hidden:
            if written and "&" in text:
                text = entities.unescape(text)
            if not block.solid:
                block.owner = here
                block.solid = not text.isspace()
            block.parts.append(text)
            if here.links:
                block.linked += len(text)

    def rise(to: Element) -> None:
        nonlocal here
        while here is not to:
            open_names[here.name] -= 1
            here = here.parent

    while True:
        m = _TAG.search(page, at)
        say(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if m["data"] is not None:
            say(m["data"], written=False)
        name, ends, rest = (m["name"], m["end"], m["rest"]) if m["name"] else (m["name2"], m["end2"], m["rest2"])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            say(" ")
        if ends:
            if open_names[name] > 0:
                up = here
                while up.name != name:
                    up = up.parent
                ends_block = name in BLOCK or here.block.depth > up.depth
                rise(up.parent)
                if ends_block:
                    close()
            elif name in BLOCK:
                close()
            continue
        if name in ENDS_P:
            rise(above_open(here, "p"))
        if name == "li":
            rise(above_open(here, "li", ("ul", "ol", "menu")))
        key += 1
        inner = _child(here, name, rest, key)
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            if name in BLOCK:
                close()
            continue
        here = inner
        open_names[name] += 1
        if name in BLOCK:
            close()
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            rise(inner.parent)
    close()
    return out


def above_open(here: Element, name: str, until: tuple[str, ...] = ()) -> Element:
    """The parent of the open element `name`, if one is open within the nearest block that holds it; else `here`."""
    up = here.block
    while up.parent is not None:
        if up.name == name:
            return up.parent
        if up.name in until or up.name != "p":
            return here
        up = up.parent.block
    return here


def holder(e: Element) -> Element:
    """The element that holds the block's own element: what siblings share."""
    return e.block.parent or e.block


def content_score(b: Block) -> float:
    e, n = b.owner, b.text.count(" ") + 1
    w = WEIGHTS
    return (
        w["bias"] + w["article"] * e.article + w["main"] * e.main + w["boilerplate_tag"] * e.boilerplate + w["boilerplate_name"] * e.named + w["page_header"] * e.header
        + w["link_share"] * min(1.0, b.linked / len(b.text)) * (0.3 if e.article else 1.0) + w["words"] * min(n, 60) ** 0.5 + w["sentence"] * (b.text[-1] in ".!?…\"'”»") + w["list_item"] * (e.name == "li")
    )


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the blocks on the source's side of a minimum cut (of the smallest ones, that with most content).

    A positive score is the capacity from the source, a negative one that to
    the sink.  Maximum flow by shortest augmenting levels (Dinic).
    """
    n = len(scores)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, x in enumerate(scores):
        if x > 0:
            add(s, i, x, 0.0)
        elif x < 0:
            add(i, t, -x, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        place = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                a, path = s, []
                continue
            while place[a] < len(out[a]):
                e = out[a][place[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                place[a] += 1
            else:
                if not path:
                    break
                e = path.pop()
                a = to[e ^ 1]
                place[a] += 1
    # What cannot reach the sink any more counts as content.
    reach = {t}
    queue = deque([t])
    while queue:
        b = queue.popleft()
        for e in out[b]:
            a = to[e]
            if cap[e ^ 1] > 1e-9 and a not in reach:
                reach.add(a)
                queue.append(a)
    return [i not in reach for i in range(n)]


def main_text(page: str | None) -> str:
    found = blocks(page)
    if not found:
        return ""
    edges = [(i, i + 1, NEXT) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = holder(b.owner).key
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    kept = minimum_cut([content_score(b) for b in found], edges)
    return "\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by line feeds; nothing else goes.  A null or empty
    html, or a page without content, gives an empty text and 0; null ids and
    urls pass through; other columns are not read; repeated rows are repeated;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
