"""Operator 9: main text of web pages by composite text density.

The page becomes a tree of any depth (unclosed and wrongly nested tags are tolerated; scripts, styles,
controls, hidden parts and comments hold no text; character references are decoded). For every node the
composite density is its characters for each tag, times a logarithm that link characters and link tags
make smaller; a node's density sum is the sum over its children. The node with the largest sum is the
core, and the smallest density on its path up to the body is the threshold.

The core grows to a parent as long as what the parent adds is text: headings, paragraphs, lists and the
like that links don't fill, or parts at least as dense as the threshold; so sections of one article come
together, and menus, link lists and short notices stop the growth. Inside the core, parts that links fill
and that are less dense than the threshold are cut.

Names are a prior only. Kinds of elements and words in class and id weigh a part's density, in the sums
and against the threshold: parts that are named as menu, advert, notice, form or reader comments weigh
nothing, parts with a name that may also be a subject ("related", "social") a fifth, so dense text under
such a name stays. Headings are never weighed by a name. A name is a class, or a whole id, all of whose words
are names or say nothing ("ad-box"). An id with other words is none; a class with other words ("promo-quote"), and
within an article any id but that of reader comments, is believed only if links, controls or short lines bear
it out.
A named part that holds the page's title or most of its text is its frame and weighs as any other. Without
any name the densities alone decide.

Blocks (paragraphs, headings, list items, cells, and lines that <br> ends) are joined by one newline,
white space inside a block becomes one space. Preformatted text is treated alike.

Defined results: null or empty html gives an empty text; html without tags gives its text; nothing is
cut off, whatever the page's size or depth; ties take the outermost, then first node; rows are
independent, so repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.llm.common import read, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style head template noscript iframe object svg math canvas audio video map".split())
CONTROLS = frozenset("button input select textarea option datalist".split())
FRAME = frozenset("nav aside footer menu dialog form fieldset".split())
APART = frozenset("nav aside footer menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar alert form".split())
#: Elements that hold running text.
FLOW = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure figcaption details hgroup header".split())
#: Words of class and id names of parts that aren't main text, and words that may also be its subject.
SURE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion promotions cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars comment comments commentlist disqus replies respond footer masthead topbar login toolbar".split()
)
UNSURE = frozenset("banner notice notices alert aside widget widgets related recommended recommendations share sharing social reply discussion header skip copyright disclaimer".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Words beside a name that say nothing of the subject.
NEUTRAL = frozenset("box container wrapper wrap block section bar list inner outer top bottom left right site page js slot area panel link links item items content holder group unit title main primary secondary user reader thread form body text button row col module post entry fixed sticky mobile desktop small large global id".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DOUBT = 0.2
#: Share of link characters, and characters of the longest block, that bear a doubtful name out.
LINKED, SHORT = 0.2, 60
#: Share of the page's text that a named part holds if it is the page's frame.
NEARLY_ALL = 0.95
#: An element on the left ends open elements on the right when it starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div article section main body html aside nav footer header form td th blockquote".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "controls")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.kids, self.controls = tag, attrs, up, [], 0


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.open: Counter[str] = Counter()

    def _leave(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node.up is not None and node.tag not in stop:
            if node.tag in tags:
                while self.at is not node:
                    self._up()
                self._up()
                return
            node = node.up

    def _up(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.up or self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.at.up is None:
            self.root.attrs |= {k: v or "" for k, v in attrs}
            return
        if tag in BLOCK:
            self._leave({"p"}, SCOPE)
            self._leave({"head"}, frozenset({"body"}))
        if tag in CLOSES:
            self._leave(CLOSES[tag], SCOPE - {"td", "th"} if tag == "tr" else SCOPE - CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.up is not None and self.at.tag == tag and tag in ("script", "style"):
            self._up()

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.at.kids.append(Node("br", {}, self.at))
        elif tag not in VOID and tag not in ("html", "body"):
            self._leave({tag}, frozenset())

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(html: str) -> Node:
    """The tree of a page; a text without any tag is the root's only child."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _is_silent(node: Node) -> bool:
    """Parts that show no text of their own: scripts, styles, controls, hidden parts."""
    if node.tag in HIDDEN or node.tag in CONTROLS:
        return True
    attrs = node.attrs
    if not attrs:
        return False
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))


def drop_silent(root: Node) -> None:
    stack = [root]
    while stack:
        at = stack.pop()
        at.controls = sum(1 for k in at.kids if not isinstance(k, str) and k.tag in CONTROLS)
        at.kids = [k for k in at.kids if isinstance(k, str) or not _is_silent(k)]
        stack += [k for k in at.kids if not isinstance(k, str)]


def _names(value: str) -> list[set[str]]:
    """Words of each name in a class or id."""
    return [set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())) for v in value.split()]


def _named(node: Node, inside_article: bool) -> tuple[float, bool, bool]:
    """Weight that a node's kind and names give it, whether they name reader comments, and whether that is doubtful."""
    if node.tag in HEADINGS or node.tag in ("article", "main"):
        return 1.0, False, False
    attrs = node.attrs
    if node.tag in FRAME or attrs.get("role", "").lower() in ROLES or node.tag == "header" and not inside_article:
        return 0.0, False, False
    found = (1.0, False, False)
    for words, is_id in [*((w, False) for w in _names(attrs.get("class", ""))), *((w, True) for w in _names(attrs.get("id", "").replace(" ", "-")))]:
        sure, unsure = words & SURE, words & UNSURE
        whole = words <= SURE | UNSURE | NEUTRAL
        doubtful = not whole or is_id and inside_article and not words & COMMENTS
        if sure and not doubtful:
            return 0.0, bool(words & COMMENTS) and node.tag not in FLOW, False
        if is_id and not whole:
            continue
        if sure:
            found = min(found, (0.0, False, True))
        elif unsure and not (inside_article and node.tag == "header"):
            found = min(found, (DOUBT, False, doubtful))
    return found


def _borne_out(f: Figures) -> bool:
    """Whether links, controls or short lines only say that a part isn't running text."""
    return f.controls > 0 or f.link_chars >= LINKED * f.chars or f.longest < SHORT


def priors(root: Node, figures: dict[Node, Figures]) -> dict[Node, float]:
    """Weights below 1 of named nodes. The page's frame ("has-sidebar") weighs 1: it holds a title, a main
    part or an article, or nearly all text that isn't in links, which only reader comments and elements that
    are apart by their kind may do otherwise."""
    out: dict[Node, float] = {}
    page = figures[root].chars - figures[root].link_chars
    titled: set[Node] = set()
    for node in figures:
        if node.tag in ("main", "h1", "article"):
            up = node.up
            while up is not None and up not in titled and not (node.tag == "article" and up.tag in APART):
                titled.add(up)
                up = up.up
    stack = [(root, False)]
    while stack:
        at, inside = stack.pop()
        within = inside or at.tag in ("article", "main")
        for kid in at.kids:
            if not isinstance(kid, str):
                weight, comments, doubtful = _named(kid, within)
                f = figures[kid]
                if weight < 1 and not (doubtful and not _borne_out(f)) and (comments or kid not in titled and (kid.tag in APART or f.chars - f.link_chars <= NEARLY_ALL * page)):
                    out[kid] = weight
                stack.append((kid, within))
    return out


class Figures:
    """Characters, tags, link characters, link tags, controls and longest block of a node, its density and density sum."""

    __slots__ = ("chars", "tags", "link_chars", "link_tags", "controls", "line", "longest", "density", "total")

    def __init__(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = self.controls = self.line = self.longest = 0
        self.density = self.total = 0.0


def _order(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return order


def measure(root: Node, named: bool = True) -> tuple[dict[Node, Figures], dict[Node, float]]:
    """Composite text density of every node, the sums over children, and the weights of named nodes."""
    order = _order(root)
    out: dict[Node, Figures] = {}
    for node in reversed(order):
        f = out[node] = Figures()
        f.controls = node.controls
        for kid in node.kids:
            if isinstance(kid, str):
                f.chars += (n := len(" ".join(kid.split())))
                f.line += n
            else:
                g = out[kid]
                f.controls, f.longest = f.controls + g.controls, max(f.longest, g.longest)
                f.line += 0 if kid.tag in BLOCK else g.line
                f.chars, f.tags = f.chars + g.chars, f.tags + g.tags + 1
                f.link_chars, f.link_tags = f.link_chars + g.link_chars, f.link_tags + g.link_tags
        f.longest = max(f.longest, f.line)
        if node.tag == "a":
            f.link_chars, f.link_tags = f.chars, f.tags + 1
    share = out[root].link_chars / max(1, out[root].chars)
    weights = priors(root, out) if named else {}
    for node, f in out.items():
        f.density = _density(f, share) * weights.get(node, 1.0)
    for node in order:
        out[node].total = sum(out[k].density for k in node.kids if not isinstance(k, str))
    return out, weights


def _density(f: Figures, share: float) -> float:
    """Characters for each tag, times a logarithm of tags and characters that links make smaller."""
    if not f.chars:
        return 0.0
    plain = max(1, f.chars - f.link_chars)
    base = math.log(f.chars / plain * f.link_chars + share * f.chars + math.e)
    ratio = f.chars / max(1, f.link_chars) * max(1, f.tags) / max(1, f.link_tags)
    return f.chars / max(1, f.tags) * max(0.0, math.log(max(ratio, 1.0)) / base)


def _mostly_links(f: Figures) -> bool:
    """What a page has beside its text: menus, link lists, bylines with links."""
    return f.link_tags >= 2 and 2 * f.link_chars > f.chars


def _only_links(f: Figures) -> bool:
    """A block of links inside the text; a list of references, say, has words of its own."""
    return f.link_tags >= 3 and f.link_chars >= 0.9 * f.chars


def core(root: Node, figures: dict[Node, Figures], weights: dict[Node, float]) -> tuple[Node, float]:
    """The node with the largest density sum outside parts that weigh nothing, grown, and the threshold."""
    best, stack = root, [root]
    while stack:
        node = stack.pop()
        if figures[node].total > figures[best].total * (1 + 1e-9):
            best = node
        stack += [k for k in reversed(node.kids) if not isinstance(k, str) and weights.get(k, 1.0) > 0]
    path = [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    threshold = min(figures[n].density / (weights.get(n) or 1.0) for n in path)
    inside = next((i for i in range(len(path) - 1, -1, -1) if path[i].tag in ("article", "main")), -1)
    for i, (inner, outer) in enumerate(zip(path, path[1:])):
        added = [k for k in outer.kids if not isinstance(k, str) and k is not inner and figures[k].chars and weights.get(k, 1.0) > 0]
        text = lambda k: k.tag not in BLOCK or k.tag in FLOW or figures[k].density >= threshold
        if outer.up is None and (len(added) < sum(1 for k in outer.kids if not isinstance(k, str) and k is not inner and figures[k].chars)) and not any(figures[k].density >= threshold or k.tag == "h1" for k in added):
            break
        if any(i + 1 > inside and _mostly_links(figures[k]) or not text(k) for k in added):
            break
        best = outer
    return best, threshold


def cut(node: Node, figures: dict[Node, Figures], weights: dict[Node, float], threshold: float) -> None:
    """Take out of the core what its weight or its links make less dense than the threshold."""
    stack = [node]
    while stack:
        at = stack.pop()
        kept = []
        for kid in at.kids:
            if not isinstance(kid, str):
                if figures[kid].density < threshold and (kid in weights or kid.tag in BLOCK and _only_links(figures[kid])):
                    continue
                stack.append(kid)
            kept.append(kid)
        at.kids = kept


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, empty ones left out."""
    out, line = [], []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        at, done = stack.pop()
        if isinstance(at, str):
            line.append(at)
        elif done or at.tag == "br":
            end()
        else:
            if at.tag in BLOCK:
                end()
                stack.append((at, True))
            stack += [(k, False) for k in reversed(at.kids)]
    end()
    return out


def main_text(html: str | None, named: bool = True) -> str:
    """Main text of one page. named: whether kinds and names of elements weigh."""
    if not html:
        return ""
    root = parse(html)
    drop_silent(root)
    figures, weights = measure(root, named)
    node, threshold = core(root, figures, weights)
    cut(node, figures, weights, threshold)
    return "\n".join(blocks(node))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", 4 << 20):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, url, text, n_chars."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract_pages(read(spark, sf_dir, "pages"))
