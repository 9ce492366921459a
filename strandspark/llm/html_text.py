"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A logistic classifier over a block's tags, names, links and length gives what it costs to
call it content or boilerplate: the capacities of its edges to the two terminals. Edges between neighbours in the page and
between blocks with the same parent in the document tree are what it costs to label these apart. The minimum cut, found as
a maximum flow, is the cheapest labelling of the whole page. What can't be text at all (scripts, styles, comments in the
markup, head) is no block.

The classifier is trained in numpy on blocks of a bounded sample of pages. The semantic element around a block (article, main;
nav, footer, aside and the like) is its label, and just these elements are hidden from the features in training: what is
learned are class names, links, length and form of a block. What the elements themselves weigh is fixed.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, sampled, table

#: A tag ends at the first > outside of a quoted value, and a value is quoted only right after its =.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_SPACE = re.compile(r"\s+")
#: Elements whose content is no markup, to their end tag. The first two are never text, even without an end tag.
RAW = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
#: Elements whose content isn't shown, or only instead of something else.
MUTE = {"noscript", "template", "svg", "object", "canvas", "select", "datalist", "audio", "video", "annotation", "annotation-xml"}
#: Attributes that have no value.
FLAGS = {"allowfullscreen", "async", "autofocus", "autoplay", "checked", "controls", "default", "defer", "disabled", "download", "hidden", "inert", "ismap", "itemscope", "loop", "multiple", "muted", "nomodule", "novalidate", "nowrap", "open", "playsinline", "readonly", "required", "reversed", "selected"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "math"}
#: Start tags that end an open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in ("p", "div", "article", "section", "header", "footer", "nav", "aside", "main", "ul", "ol", "dl", "table", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "hr", "figure", "address", "fieldset")}
#: Blocks that end an unclosed select or svg.
STARTERS = {"p", "div", "article", "section", "main", "header", "footer", "nav", "aside", "ul", "ol", "dl", "table", "form", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
BOILERPLATE = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "fieldset"}
CONTENT = {"article", "main"}
# What such parts are called in the other languages of the pages, German, French and Spanish.
BAD_ABROAD = "anzeigen? werbung werbe\\w* fusszeile\\w* fuss kopfzeile\\w* seitenleiste\\w* randspalte navigationsleiste hauptmenue? hinweise? kommentar\\w* antworten leserbriefe? anmeld\\w* abonn\\w* suche suchfeld teilen verwandt\\w* empfehl\\w* mehrzum\\w* impressum datenschutz formular\\w* publicites? publicitaire pubs? annonces? pied piedpage piedde\\w* entete bandeau barrelaterale laterale temoins commentaires? reponses? connexion inscription recherche chercher partage\\w* partager apparentes? recommand\\w* formulaire\\w* publicidad anuncios? patrocinad\\w* pie piepagina cabecera encabezado barralateral lateral avisos? comentarios? respuestas? iniciarsesion suscrib\\w* suscrip\\w* boletin busqueda buscar buscador compartir relacionad\\w* recomendad\\w* formulario\\w* migas miettes brotkrumen"
#: Parts of a class token or id that tell boilerplate.
BAD_NAME = re.compile("|".join(BAD_ABROAD.split()) + r"|ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?\w*|consent|notices?|popup|modal|nav\w*|menu\w*|breadcrumbs?|foot\w*|header|masthead|side\w*|widget\w*|related|recommend\w*|share|social|comment\w*|disqus|repl(?:y|ies)|respond|subscri\w*|newsletter|sign\w*|login|search|form|toolbar|pagination|pager|copyright|legal|disclaimer|alert|hidden|skip|tags?|rail|teaser\w*")
GOOD_NAME = re.compile(r"(?:^|[^a-z])(?:article\w*|content\w*|post|entry|story|main|body|text|prose|chapter|artikel\w*|inhalt\w*|beitrag|hauptteil|contenu|corps|texte|articulo|contenido|cuerpo|texto)(?:$|[^a-z])")
#: Tokens that name nothing but content: they hold against bad names of the elements around.
OWN_NAME = re.compile(r"(?:article|content|post|entry|story|main|prose|chapter|artikel|inhalt|beitrag|hauptteil|contenu|articulo|contenido)s?(?:[-_](?:article|content|post|entry|story|main|body|text))*")
#: Parts of tokens that tell a page's layout or state (has-sidebar, comments-open), not what the element is.
STATE = {"has", "no", "not", "with", "without", "layout", "open", "opened", "closed", "enabled", "disabled", "allowed"}
#: Tokens that tell a page's subjects (tag-politics), unless they end in what a list of such is called.
SUBJECT = re.compile(r"(?:tag|category|cat|term|topic|author)[-_](?!.*(?:list|cloud|links?|menu|nav|bar|box|widget)$).+")
#: What can be in the head; any other start tag ends it.
HEAD = {"html", "head", "title", "meta", "link", "base", "style", "script", "noscript", "template", "basefont", "bgsound", "noframes"}
FEATURES = 14


@lru_cache(maxsize=1 << 14)
def told_by(names: str) -> int:
    """-1 where a token of a class, id or the like names boilerplate, else 1 where one names nothing but content, else 0."""
    tokens = names.split()
    for token in tokens:
        parts = re.split("[^a-z]+", token)
        if not SUBJECT.fullmatch(token) and STATE.isdisjoint(parts) and any(map(BAD_NAME.fullmatch, parts)):
            return -1
    return int(any(map(OWN_NAME.fullmatch, tokens)))


class Element:
    """An open element with what it and those around it say, worked out once from its parent's.

    Of the elements around a block the innermost that tells counts. ``inside``: it says content; ``bad``: its name says
    boilerplate; ``kind``: it is an article or main element (True) or one of boilerplate. Pairs are (as it is, as if
    semantic elements had no names).
    """

    __slots__ = ("number", "name", "parent", "depth", "boilerplate", "good", "inside", "bad", "kind")

    def __init__(self, number: int, name: str, names: str, parent: Element | None):
        self.number, self.name, self.parent = number, name, parent
        if parent is None:
            self.depth, self.boilerplate, self.good, self.inside, self.bad, self.kind = 0, False, False, (False, False), (False, False), None
            return
        told, good, content, boilerplate = told_by(names), GOOD_NAME.search(names) is not None, name in CONTENT, name in BOILERPLATE
        self.depth = parent.depth + 1
        self.boilerplate = boilerplate or parent.boilerplate
        self.good = good or parent.good
        self.inside = tuple(False if told < 0 or (boilerplate and not k) else True if good or (content and not k) else parent.inside[k] for k in (0, 1))
        self.bad = tuple(True if told < 0 else False if told > 0 or (content and not k) else parent.bad[k] for k in (0, 1))
        self.kind = True if content else False if boilerplate else parent.kind


@dataclass
class Block:
    """A run of text between block-level tags, in an element."""

    parts: list[str] = field(default_factory=list)
    element: Element | None = None
    linked: int = 0
    size: int = 0

    def text(self) -> str:
        return _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()


_START = re.compile(r"<([a-zA-Z][^\s/>]*)")
_WORD = re.compile(r"[^ \t\r\n/]\S*")


class _Finder:
    """Where a character is next from places that only ascend: each stretch of the page is searched once."""

    def __init__(self, page: str, character: str):
        self.page, self.character, self.at = page, character, -1

    def next(self, place: int) -> int:
        if self.at < place:
            found = self.page.find(self.character, place)
            self.at = found if found >= 0 else len(self.page)
        return self.at


def _is_text(page: str, at: int, ends: _Finder, equals: _Finder) -> bool:
    """Whether what looks like a start tag is a comparison in a sentence, such as a<b and c>d: an inline name, then bare words."""
    m = _START.match(page, at)
    if m is None or m[1].lower() not in INLINE:
        return False
    end = ends.next(m.end())
    if equals.next(m.end()) < end:
        return False
    return any(w not in FLAGS and not w.startswith(("data-", "aria-")) for x in _WORD.finditer(page, m.end(), end) if (w := x[0].rstrip("/").lower()))


def _unseen(attributes: dict[str, str]) -> bool:
    return attributes.get("hidden", "until-found") != "until-found" or re.search(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", attributes.get("style", ""), re.I) is not None


def blocks(page: str) -> list[tuple[str, Element, float]]:
    """(text, element, share of linked characters) of each block with text; the element is the innermost block-level one around it.

    In time that grows with the page alone, however deep its elements are and however many have no end.
    """
    out: list[Block] = []
    now = Block()
    root = Element(0, "", "", None)
    # Open elements: name, mute, inline, the innermost block-level element, where in the stack that is (-1: nowhere).
    stack: list[tuple[str, bool, bool, Element, int]] = []
    opened: dict[str, int] = {}
    traps: list[int] = []  # where select and svg are in the stack
    number, at, mute, head = 0, 0, 0, False
    ends, equals = _Finder(page, ">"), _Finder(page, "=")
    unended: set[str] = set()
    last_end: dict[str, int] = {}
    lowered = None

    def here() -> Element:
        return stack[-1][3] if stack else root

    def close():
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block()

    def add(raw: str):
        if raw and not head and not mute:
            if not now.parts:
                now.element = here()
            now.parts.append(raw)
            now.size += len(raw)
            now.linked += len(raw) if opened.get("a") else 0

    def push(name: str, unseen: bool, inline: bool, names: str = ""):
        nonlocal number, mute
        number += 1
        element = here() if inline else Element(number, name, names, here())
        floor = (stack[-1][4] if stack else -1) if inline else len(stack)
        if name in ("select", "svg"):
            traps.append(len(stack))
        stack.append((name, unseen, inline, element, floor))
        opened[name] = opened.get(name, 0) + 1
        mute += unseen

    def shut(k: int):
        nonlocal mute
        for name, unseen, _, _, _ in stack[k:]:
            opened[name] -= 1
            mute -= unseen
        del stack[k:]
        while traps and traps[-1] >= k:
            traps.pop()

    def ends_later(name: str) -> bool:
        nonlocal lowered
        if name not in last_end:
            lowered = page.lower() if lowered is None else lowered
            last_end[name] = lowered.rfind(f"</{name}")
        return last_end[name] >= at

    while True:
        place = page.find("<", at)
        if place < 0:
            add(page[at:])
            break
        if _is_text(page, place, ends, equals):
            add(page[at:place] + "&lt;")
            at = place + 1
            continue
        m = _TOKEN.match(page, place)
        if m is None:
            add(page[at : place + 1])
            at = place + 1
            continue
        add(page[at:place])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if m[1]:
            if name == "head":
                head = False
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if stack[-1][4] >= k:
                    close()
                shut(k)
            elif name not in INLINE and name not in MUTE and not opened.get("math"):
                close()
            continue
        empty = m[0].endswith("/>")
        if name in RAW:
            end = None if empty or name in unended else _ENDS[name].search(page, at)
            if end:
                if name == "xmp":
                    add(html.escape(page[at : end.start()]))
                at = end.end()
            elif not empty:
                unended.add(name)
                if name in RAW[:2]:
                    at = len(page)
            continue
        if name == "head":
            head = True
        elif name not in HEAD:
            head = False
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        if mute and name in STARTERS and traps and not opened.get("foreignobject"):
            shut(traps[0])  # a block can't be in these: their end tags are missing
        if name in MUTE:
            if not empty and ends_later(name):
                push(name, True, True)
            continue
        inline = name in INLINE or bool(opened.get("math"))
        if not inline:
            close()
            ended = CLOSES.get(name)
            if ended and stack and stack[-1][4] >= 0 and stack[stack[-1][4]][0] in ended:
                shut(stack[-1][4])
        if empty:
            continue
        attributes = {a[1].lower(): (a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3])} if m[3] else {}
        # Names of the whole page tell its layout.
        whole = name in ("html", "body")
        names = "" if whole else " ".join(attributes[a] for a in ("class", "id", "role", "aria-label", "itemprop") if a in attributes).lower()
        push(name, not whole and _unseen(attributes), inline, names)
    close()
    return [(t, b.element, b.linked / max(1, b.size)) for b in out if (t := b.text())]


def features(page: list[tuple[str, Element, float]], hidden: bool = False) -> np.ndarray:
    """A row of numbers for each block; ``hidden``: as if semantic elements had no names."""
    x = np.zeros((len(page), FEATURES))
    for k, (text, element, linked) in enumerate(page):
        words = text.count(" ") + 1
        last = element.name
        x[k] = (
            1,
            element.inside[hidden],
            element.boilerplate and not hidden,
            element.bad[hidden],
            element.good,
            linked,
            linked > 0.5,
            min(1, words / 40),
            words < 4,
            last == "p" or last == "pre" or last == "blockquote",
            last in ("h1", "h2", "h3", "h4", "h5", "h6"),
            last == "li",
            text[-1:] in ".!?…。",
            "©" in text or "copyright" in text.lower(),
        )
    return x


def semantic_labels(page: list[tuple[str, Element, float]]) -> list[int]:
    """1 in an article or main element, 0 in an element of boilerplate, by the innermost of these; -1 in neither.

    Names give no label. Where they contradict an article, as those of comments do, there is none either.
    """
    return [-1 if e.kind is None or (e.kind and e.bad[1]) else int(e.kind) for _, e, _ in page]


def apart(a: Element, b: Element) -> int:
    """How many steps two elements are apart in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a, steps = a.parent, steps + 1
        else:
            b, steps = b.parent, steps + 1
    return steps


#: The classifier before any training: what these elements mean by themselves. Training starts from here.
PRIOR = np.array([-0.5, 3.0, -6.0, -6.0, 1.5, -1.5, -1.5, 2.0, -0.5, 0.5, 0.5, -0.5, 0.5, -2.0])


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, pull: float = 0.02) -> np.ndarray:
    """Logistic weights by gradient descent from the prior, pulled back to it; both labels weigh alike."""
    w = PRIOR.copy()
    if len(y) == 0 or y.min() == y.max():
        return w
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ ((p - y) * weight) + pull * (w - PRIOR))
    return w


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for blocks on the source (content) side of a minimum cut.

    A block with positive ``gain`` has an edge of that capacity from the source, one with negative gain an edge to the sink;
    each edge (a, b, capacity) joins two blocks both ways. Maximum flow by shortest augmenting paths in levels.
    """
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, g in enumerate(gain.tolist()):
        if g > 0:
            link(source, k, g, 0.0)
        elif g < 0:
            link(k, sink, -g, 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for v in queue:
            for e in out[v]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        following = [0] * (n + 2)
        while True:
            path: list[int] = []
            v = source
            while v != sink:
                while following[v] < len(out[v]):
                    e = out[v][following[v]]
                    if room[e] > tiny and level[to[e]] == level[v] + 1:
                        break
                    following[v] += 1
                else:
                    if not path:
                        break
                    v = to[path.pop() ^ 1]
                    following[v] += 1
                    continue
                path.append(e)
                v = to[e]
            if v != sink:
                break
            most = min(room[e] for e in path)
            for e in path:
                room[e] -= most
                room[e ^ 1] += most


def main_text(page: str, weights: np.ndarray, near: float = 0.4, kin: float = 0.4) -> str:
    """The content blocks of a page in page order, joined by one space; empty where there are none."""
    found = blocks(page)
    if not found:
        return ""
    gain = features(found) @ weights
    parents: dict[int, int] = {}
    edges = []
    for k, (_, element, _) in enumerate(found):
        if k:
            edges.append((k - 1, k, near / (1 + apart(element, found[k - 1][1]))))
        parent = element.parent.number if element.parent else 0
        if parent in parents and parents[parent] != k - 1:
            edges.append((parents[parent], k, kin))
        parents[parent] = k
    if (gain > 0).all() or (gain < 0).all():
        keep = [bool(gain[0] > 0)] * len(found)  # one side pays nothing: no cut is cheaper
    else:
        keep = minimum_cut(gain, edges)
    return " ".join(t for (t, _, _), k in zip(found, keep, strict=True) if k)


def _examples(batches):
    for batch in parts(batches, 0):
        x, y = [], []
        for page in batch.column(0).to_pylist():
            found = blocks(page or "")
            labels = np.array(semantic_labels(found), np.int64)
            told = labels >= 0
            x += features(found, hidden=True)[told].tolist()
            y += labels[told].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])


def learned(pages: DataFrame, sample: int = 300, most: int = 100_000) -> np.ndarray:
    """Classifier weights from the blocks of ``sample`` pages, those with the smallest hashes of page_id, ``most`` blocks at most: the bounds of the sample.

    Null page_ids are no part of it, null html has no blocks; without blocks of both labels the weights are those fixed.
    """
    chosen = sampled(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")), "page_id", sample)
    rows = chosen.select("html").mapInArrow(_examples, "x array<double>, y int").limit(most).collect()
    return train(np.array([r["x"] for r in rows], np.float64).reshape(len(rows), FEATURES), np.array([r["y"] for r in rows], np.float64))


def extracted(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html, ...), from the whole html.

    The time that a page takes grows with its length, however deep its elements are and however many lack an end tag. Null and
    empty html and pages without content have an empty text. Page ids and urls stay as they are, null or not;
    repeated rows give the same text; other columns are ignored.
    """

    def run(batches):
        for batch in parts(batches, 2):
            text = [main_text(page or "", weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, learned(pages))
