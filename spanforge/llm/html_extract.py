"""Main-text extraction by tree scoring.

Paragraphs pass points, for their length and commas, to their ancestors: all to
the parent, half to the one above, a third and less beyond. A container's points
are discounted by the share of its text in links. The best container is kept
with those siblings that score well beside it.

Elements, roles and hidden parts that are never main text go at once. Words of a
class or id weigh: each that tells of chrome counts against the element, each
other one for it. Where they count against it the element must have the more
points by its paragraphs. Names that end in a word of chrome (comments, adverts,
cookies, ...), words of place and shape aside, cannot be made up for by prose, as
reader comments are prose too. Where another word follows, as in cookie-recipe,
the last one tells what the element is: inside an article a little prose is
enough, elsewhere it takes as much as for a doubtful word.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrays import slices

_TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]++|<", regex.S)
_ATTR = regex.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([a-zA-Z-]+)")
_SPACE = regex.compile(r"\s+")
#: Fixed values of the format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tr td th thead tbody", "thead": "tbody", "tfoot": "tr td th tbody"}
LIMITS = {"li": "ul ol menu", "dd": "dl", "dt": "dl", "tr": "table", "td": "table", "th": "table", "option": "select", "tbody": "table", "thead": "table", "tfoot": "table"}
CLOSES = {k: (frozenset(v.split()), frozenset(LIMITS[k].split())) for k, v in CLOSES.items()}
#: What never belongs to the main text: elements, roles, and words of a class or id.
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas annotation annotation-xml nav aside footer form button select option textarea input label dialog menu audio video map noembed noframes xmp title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner sponsor sponsored sponsors promo sidebar sidebars menu menus navbar navigation nav breadcrumb breadcrumbs toolbar topbar masthead footer comment comments commentlist disqus cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login widget widgets pagination pager".split()
)
DOUBTFUL = frozenset("rail header foot replies discussion notice notices alert subscription share sharing social related recommended recommendations promoted promotion skip".split())
#: Words that say where or of what form an element is, and those before or after which a name tells of another element.
SHAPES = frozenset("a area bar block body box button buttons col column container content div el group holder icon icons id inner item items left line link links list main outer page pane panel post posts right row section site slot text top bottom ul unit wrap wrapper".split())
ELSEWHERE = frozenset("has with no none without is open closed enabled disabled".split())
#: Points that an element needs for each word against it, and where as many words speak for it.
AGAINST, EVEN = 8.0, 0.5
_WORDS = regex.compile(r"[a-z]+|[A-Z]+[a-z]*")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote", "li", "dd", "figcaption")) | HEADINGS
#: Points that an element starts with by its name.
START = {"article": 30.0, "main": 25.0, "section": 3.0, "div": 3.0, "td": 2.0, "blockquote": 2.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}


class Node:
    __slots__ = ("tag", "parent", "children", "needs", "prose", "letters", "linked", "commas", "gone")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.needs, self.prose, self.letters, self.linked, self.commas, self.gone = 0.0, 0.0, 0, 0, 0, False


def name_points(names: str, tag: str = "div", inside_article: bool = False) -> float:
    """Points that an element of these classes and ids needs by its paragraphs; infinite where none make up for them."""
    needs = 0.0
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not ELSEWHERE.isdisjoint(words):
            continue
        chrome = sum(w in CHROME for w in words)
        doubtful = sum(w in DOUBTFUL and not (w == "header" and inside_article) for w in words)
        others = sum(w not in SHAPES and w not in CHROME and w not in DOUBTFUL for w in words)
        against = chrome + doubtful - others - (tag == "article")
        told = [w for w in words if w not in SHAPES]
        if chrome and (told[-1] in CHROME or not others):
            return float("inf")
        if chrome and not inside_article:
            against = max(against, 1)
        if chrome + doubtful:
            needs = max(needs, AGAINST * against if against > 0 else EVEN)
    return needs


def _needs(tag: str, attrs: str, inside_article: bool) -> float:
    """Points that an element needs to stay; infinite where it never does."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return float("inf")
    if not attrs or tag in ("html", "body"):
        return 0.0
    found = {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return float("inf")
    style = found.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return float("inf")
    names = f"{found.get('class', '')} {found.get('id', '')}"
    return 0.0 if tag == "main" else name_points(names, tag, inside_article)


class Open:
    """The open elements, with the places of each name and of the blocks, so that no search walks through them."""

    def __init__(self, root: Node):
        self.nodes, self.blocks, self.articles = [root], [], 0
        self.places: dict[str, list[int]] = {}

    def last(self, tag: str) -> int:
        """Place of the innermost element of this name; 0 if none is open."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.articles += node.tag in ("article", "main")
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Close the element at this place and all within."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
            self.articles -= node.tag in ("article", "main")


def parse(text: str) -> Node:
    """The tree of a page; elements that never belong to the main text are marked as gone and stay empty."""
    root = at = Node("#root", None)
    position, size = 0, len(text)
    within = Open(root)
    while position < size:
        m = _TOKEN.match(text, position)
        position = m.end()
        tag = m["tag"]
        if tag is None:
            part = m[0]
            if (part[0] != "<" or part == "<") and not at.gone:
                at.children.append(part)
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "br":
                at.children.append(" ")
            elif place := within.last(tag):
                within.close(place)
                at = within.nodes[-1]
            continue
        if tag in BLOCK and tag not in CLOSES:
            if within.blocks and within.nodes[within.blocks[-1]].tag == "p":
                within.close(within.blocks[-1])
        elif tag in CLOSES:
            closes, until = CLOSES[tag]
            place = max(map(within.last, closes))
            if place > max(map(within.last, until)):
                within.close(place)
        at = within.nodes[-1]
        node = Node(tag, at)
        node.needs = _needs(tag, m["attrs"], within.articles > 0)
        node.gone = at.gone or node.needs == float("inf")
        if not at.gone:
            at.children.append(node)
        if tag in RAW:
            end = regex.compile(rf"</{tag}[^>]*>?", regex.I).search(text, position)
            position = end.end() if end else size
        elif tag not in VOID and not m["attrs"].endswith("/"):
            within.push(node)
            at = node
    return root


def _measure(root: Node) -> list[Node]:
    """Text, linked text and commas of every kept element, in page order."""
    order: list[Node] = []
    stack: list[Node] = [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.gone)
    for n in order:
        n.letters, n.linked, n.commas = 0, 0, 0
    for n in reversed(order):
        own = [c for c in n.children if isinstance(c, str)]
        n.letters += sum(len(c.strip()) for c in own)
        n.commas += sum(c.count(",") + c.count("،") + c.count("、") + c.count("，") for c in own)
        if n.tag == "a":
            n.linked = n.letters
        if n.parent is not None:
            n.parent.letters += n.letters
            n.parent.linked += n.linked
            n.parent.commas += n.commas
    return order


def _is_paragraph(n: Node) -> bool:
    if n.tag in PARAGRAPHS:
        return not any(isinstance(c, Node) and c.tag in BLOCK and not c.gone for c in n.children)
    return n.tag in ("div", "section", "article", "main", "body", "center") and any(isinstance(c, str) and c.strip() for c in n.children)


def _worth(n: Node) -> float:
    """Points of a paragraph for its length and commas, less for links; 0 for what is none."""
    if not n.letters or not _is_paragraph(n):
        return 0.0
    worth = (1 + min(n.commas, 10) + min(n.letters / 100, 3)) * (1 - n.linked / n.letters)
    return worth * min(1.0, n.letters / 25)


def _weighed(root: Node) -> list[Node]:
    """The measured elements, less those whose paragraphs have not the points that their names ask for."""
    order = _measure(root)
    if any(n.needs for n in order):
        for n in order:
            n.prose = _worth(n)
        for n in reversed(order):
            if n.prose < n.needs:
                n.gone = True
            elif n.parent is not None:
                n.parent.prose += n.prose
        order = _measure(root)
    return order


def _score(order: list[Node]) -> dict[Node, float]:
    points: dict[Node, float] = {}
    for n in order:
        worth = _worth(n)
        if not worth:
            continue
        holder = n if n.tag not in PARAGRAPHS else n.parent
        share = 1.0
        level = 1
        while holder is not None and level < 6:
            points[holder] = points.get(holder, START.get(holder.tag, 0.0)) + worth * share
            level += 1
            share = 1 / 2 if level == 2 else 1 / (3 * (level - 1))
            holder = holder.parent
    return {n: p * (1 - n.linked / n.letters) if n.letters else 0.0 for n, p in points.items()}


def _blocks(nodes: list[Node]) -> Iterator[str]:
    """Texts of the blocks below some elements, in page order."""
    line: list[str] = []

    def flush() -> Iterator[str]:
        text = _SPACE.sub(" ", html.unescape("".join(line)).replace("\0", "�")).strip()
        line.clear()
        if text:
            yield text

    for top in nodes:
        stack: list = [top]
        while stack:
            n = stack.pop()
            if n is None:
                yield from flush()
            elif isinstance(n, str):
                line.append(n)
            elif not n.gone:
                if n.tag in BLOCK:
                    yield from flush()
                    stack.append(None)
                elif n.tag in ("br", "wbr"):
                    line.append(" " if n.tag == "br" else "")
                stack.extend(reversed(n.children))
        yield from flush()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    scores = _score(_weighed(root))
    best = max(scores, key=scores.get, default=None)
    if best is None or scores[best] <= 0:
        kept = [root]
    else:
        kept = [best]
        if best.parent is not None:
            least = max(10.0, 0.2 * scores[best])
            kept = []
            for n in best.parent.children:
                if not isinstance(n, Node) or n.gone:
                    continue
                density = n.linked / n.letters if n.letters else 1
                prose = n.tag == "p" and (n.letters > 80 and density < 0.25 or 0 < n.letters <= 80 and density == 0)
                title = n.tag in ("h1", "h2") and density < 0.5 and best.tag not in ("article", "main")
                if n is best or scores.get(n, 0) >= least or prose or title:
                    kept.append(n)
    return "\n\n".join(_blocks(kept))


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages.

    A null or empty page, or one without any text to keep, gives an empty text;
    n_chars counts code points. Null and repeated ids, urls and rows stay as
    they are; an empty table gives no rows; other columns are ignored; no text is
    cut, and the time that a page takes grows with its length, however deep it is.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(t) for t in b.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
