"""Main text of web pages by tree scoring.

A page becomes a tree without scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms
and reader comments. Each paragraph earns points for its length and commas and passes them to its
ancestors, less with each level; containers are discounted by the share of their text that stands in
links. From the container of the highest score the search goes up to the lowest one that holds nine tenths of
what the paragraphs of the page earn; all of its blocks are kept, but for link lists beside the best one.

What goes, goes by its tag, its controls or its names, however long it is. A name counts word by word; inside an
article only a name whose other words say nothing of a subject (``ad-slot`` goes, ``modal-verbs`` stays).

Every step visits each character and each node a bounded number of times, in broken markup too: a tag or a quote
that never ends is given up once for the whole page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements that never hold main text.
DROPPED = frozenset(
    "head title script style noscript template nav header footer aside button select option textarea input fieldset iframe object embed svg canvas map audio video dialog menu".split()
)
IN_HEAD = frozenset("head title meta link script style base noscript template".split())
#: Words of names that mark adverts and readers' comments.
OUTSIDERS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promotions promoted
    comment comments commenting reply replies respond disqus discussion discussions""".split()
)
#: Words that mark menus, footers, sidebars and notices.
UNLIKELY = frozenset(
    """sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer cookie cookies gdpr
    popup modal newsletter""".split()
)
#: Words that mark them only where the rest of the name says nothing of a subject.
DOUBTFUL = frozenset(
    """banner banners aside rail header foot consent notice notices alert alerts overlay subscribe subscription signup login share sharing
    social related recommended recommendations toolbar widget widgets search form complementary contentinfo skip dialog""".split()
)
#: Words that say nothing of a subject.
STRUCTURAL = frozenset(
    """area article auto bar block body bottom box btn button buttons card cell center col column container content cta desktop div el
    fixed float full global group head home id in inner inline item items js label large layout left link links list lower main mega mid
    middle mobile module native of on outer page pane panel post posts primary reader readers right row secondary section set side site
    slot small space sticky story sub tab text the thread title to top unit upper user users view web wide wrap wrapper zone""".split()
)
#: Words of the names of elements around an article.
AROUND = frozenset("has with without no is wrap wrapper layout page site content main container".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTROLS = frozenset(("input", "select", "textarea", "button"))
#: Characters of paragraphs for each control that make a form the page's frame instead of a form to fill in.
FRAME_CHARS = 80
#: Share of the points of a page that its container holds.
MOST = 0.9
#: Share of linked characters from which a block beside the best container is a list of links.
LINKED = 0.6
ARTICLE = frozenset(("article", "main"))
_ITEMS = {"li": ("li",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_ITEM_SCOPE = frozenset(("ul", "ol", "table", "select", "dl", "body"))
_P_SCOPE = _ITEM_SCOPE | {"td", "th", "li", "div", "section", "article", "main", "blockquote", "dd"}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that pass the points of their own text to their parent, and those that keep them.
PARAGRAPHS = frozenset(("p", "pre", "td", "th", "blockquote", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption"))
CONTAINERS = frozenset(("div", "section", "article", "main", "body"))
BONUS = {"article": 25.0, "main": 15.0, "div": 2.0, "section": 2.0, "blockquote": 1.0, "body": -5.0, "ul": -3.0, "ol": -3.0, "li": -3.0, "td": 1.0}
SHARES = (1, 2, 6, 9, 12)
LABEL_CHARS = 25


class Node:
    """An element: its tag, attributes, and children that are nodes or text; sums over its subtree; its score."""

    __slots__ = ("attrs", "children", "controls", "depth", "holds_article", "linked", "parent", "points", "prose", "score", "size", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.size = self.linked = self.prose = self.controls = 0
        self.points, self.score, self.holds_article = 0.0, None, False
        self.depth = 0 if parent is None else parent.depth + 1

    @property
    def density(self) -> float:
        """Share of the text that stands in links."""
        return self.linked / max(1, self.size)


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_BREAK = re.compile(r"[\s/]*")
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*|(?=>))))?""")
_BARE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*["']?([^\s>"']*))?""")
#: Elements whose content is no markup up to their end tag.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")}


class _Builder:
    """Builds the tree; end tags that HTML lets a page leave out are supplied."""

    def __init__(self):
        self.root = self.now = Node("body", {}, None)
        self.open: dict[str, int] = {}
        # open paragraphs of each scope that ends the search for one, and open items of each list or table
        self.paragraphs, self.items = [0], [{}]
        self.quoted = True  # whether quotes of attributes are still believed

    def feed(self, html: str) -> None:
        """Read a whole page: tags and text in order. A comment or raw element that never ends takes the rest, as in browsers;
        after a quote that never ends tags end at the next bracket, and after the last bracket all is text."""
        at, end = 0, len(html)
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                lt = end
            if lt > at:
                self.handle_data(unescape(html[at:lt]))
            if lt == end:
                return
            found = _TAG.match(html, lt)
            if not found:
                at = self._other(html, lt)
                continue
            at = self._tag(html, found)

    def close(self) -> None:
        """The page has ended; nothing is held back."""

    def _other(self, html: str, lt: int) -> int:
        """Read what begins with a bracket and is no tag; where it ends."""
        if html.startswith("<!--", lt):
            if html.startswith((">", "->"), lt + 4):
                return html.index(">", lt) + 1
            end = html.find("-->", lt + 4)
            return end + 3 if end >= 0 else len(html)
        if html.startswith(("<!", "<?", "</"), lt):
            end = html.find(">", lt + 2)
            return end + 1 if end >= 0 else len(html)
        self.handle_data("<")
        return lt + 1

    def _tag(self, html: str, found: re.Match) -> int:
        """Read a tag; where it ends. A tag without an end makes the rest of the page text."""
        attrs, at = self._attributes(html, found.end())
        if at < 0:
            self.handle_data(unescape(html[found.start() :]))
            return len(html)
        tag = found[2].lower()
        if found[1]:
            self.handle_endtag(tag)
            return at
        empty = html[at - 2] == "/"
        (self.handle_startendtag if empty else self.handle_starttag)(tag, attrs)
        if tag in RAW and not empty:
            end = RAW[tag].search(html, at)
            return end.start() if end else len(html)
        return at

    def _attributes(self, html: str, start: int) -> tuple[list[tuple[str, str]], int]:
        """Attributes from ``start`` on and where the tag ends; -1 if nowhere."""
        at, attrs = start, []
        while self.quoted:
            at = _BREAK.match(html, at).end()
            if html.startswith(">", at):
                return attrs, at + 1
            found = _ATTR.match(html, at)
            if not found:
                self.quoted = False  # the end of the page
                break
            attrs.append((found[1].lower(), unescape(found[2] or found[3] or found[4] or "")))
            at = found.end()
        end = html.find(">", start)
        if end < 0:
            return [], -1
        return [(m[1].lower(), unescape(m[2] or "")) for m in _BARE.finditer(html, start, end)], end + 1

    def _push(self, node: Node) -> None:
        self.now.children.append(node)
        tag = node.tag
        if tag in VOID:
            return
        self.now = node
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "p":
            self.paragraphs[-1] += 1
        if tag in _ITEMS:
            self.items[-1][tag] = self.items[-1].get(tag, 0) + 1
        if tag in _P_SCOPE:
            self.paragraphs.append(0)
        if tag in _ITEM_SCOPE:
            self.items.append({})

    def _pop(self) -> None:
        tag = self.now.tag
        self.open[tag] -= 1
        if tag in _ITEM_SCOPE:
            self.items.pop()
        if tag in _P_SCOPE:
            self.paragraphs.pop()
        if tag in _ITEMS:
            self.items[-1][tag] -= 1
        if tag == "p":
            self.paragraphs[-1] -= 1
        self.now = self.now.parent

    def _close(self, tags) -> None:
        """Close the innermost open element among ``tags``, which is known to be open."""
        while self.now.tag not in tags:
            self._pop()
        self._pop()

    def handle_starttag(self, tag, attrs):
        if self.open.get("head") and (tag == "body" or tag not in IN_HEAD):
            self._close(("head",))
        if tag in ("html", "body"):
            return
        if tag in ARTICLE:
            for left_open in ("nav", "header"):  # neither holds an article
                if self.open.get(left_open):
                    self._close((left_open,))
        if tag not in INLINE and tag != "br" and self.paragraphs[-1]:
            self._close(("p",))
        if tag in _ITEMS:
            for same in _ITEMS[tag]:
                if self.items[-1].get(same):
                    self._close((same,))
        self._push(Node(tag, dict(reversed(attrs)), self.now))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.now.tag == tag and tag in ("svg", "path", "iframe", "script"):
            self._pop()

    def handle_endtag(self, tag):
        if self.open.get(tag):
            self._close((tag,))

    def handle_data(self, data):
        if self.open.get("head") and self.now.tag == "head" and data.strip():
            self._close(("head",))
        self.now.children.append(data)


def _nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]


def _never(node: Node) -> bool:
    """Whether an element goes for its tag or because it is hidden."""
    if node.tag in DROPPED or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    style = node.attrs.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style


def _named(node: Node, inside: bool) -> bool:
    """Whether an element goes for its names, ``inside`` an article or not."""
    whole = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split()
    for name in whole:
        words = {w.lower() for w in _NAME.findall(name)}
        marked = words & (OUTSIDERS | UNLIKELY | DOUBTFUL)
        if not marked:
            continue
        if words <= OUTSIDERS | UNLIKELY | DOUBTFUL | STRUCTURAL or all(len(w) == 1 for w in words - marked - STRUCTURAL):
            return True
        if not inside and words & (OUTSIDERS | UNLIKELY) and words.isdisjoint(AROUND):
            return True
    return False


def _foreign(node: Node, inside: bool, prose: int) -> bool:
    """Whether an element goes for its names or as a form; ``_measure`` has summed up what it holds, ``prose`` is the page's."""
    names = {n.lower() for n in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split()}
    if node.tag in ARTICLE:
        return not OUTSIDERS.isdisjoint(names)
    if node.holds_article or node.tag in HEADINGS:
        return False  # a wrapper of the article, whatever it is called; headings are named for their subjects
    most = 2 * node.prose > prose
    if node.tag == "form" and not (most and node.prose >= FRAME_CHARS * node.controls):
        return True
    if not (OUTSIDERS | UNLIKELY | DOUBTFUL).isdisjoint(node.attrs.get("role", "").lower().split()):
        return not (most and node.tag == "form")
    words = {w.lower() for name in names for w in _NAME.findall(name)}
    if most and not words.isdisjoint(AROUND) and words.isdisjoint(OUTSIDERS):
        return False  # a frame with a menu or the like in its name
    return _named(node, inside)


def _measure(root: Node) -> None:
    """Sum up text, linked text, prose and controls of every subtree."""
    order = list(_nodes(root))
    for node in reversed(order):
        node.size = node.linked = node.prose = 0
        node.holds_article = node.tag in ARTICLE
        for c in node.children:
            if isinstance(c, str):
                node.size += len(" ".join(c.split()))
            else:
                node.size += c.size
                node.linked += c.linked
                node.prose += c.prose
                node.holds_article |= c.holds_article
        if node.tag == "a":
            node.linked = node.size
        elif node.tag in PARAGRAPHS and not node.prose and node.size - node.linked >= LABEL_CHARS:
            node.prose = node.size - node.linked


def _count_controls(root: Node) -> None:
    """The visible controls of every subtree."""
    for node in reversed(list(_nodes(root))):
        own = node.tag in CONTROLS and node.attrs.get("type", "").lower() != "hidden" and "__" not in node.attrs.get("name", "")
        node.controls = own + sum(c.controls for c in node.children if not isinstance(c, str))


def _without_foreign(root: Node) -> None:
    prose, stack = root.prose, [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ARTICLE
        node.children = [c for c in node.children if isinstance(c, str) or not _foreign(c, inside, prose)]
        stack += [(c, inside) for c in node.children if not isinstance(c, str)]


def _without(root: Node, drop) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not drop(c)]
        stack += [c for c in node.children if not isinstance(c, str)]


def _text(node: Node) -> str:
    """Text of a subtree: block elements and line breaks part words, inline ones do not; white space collapsed."""
    parts: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag in INLINE:
            stack += reversed(x.children)
        else:
            parts.append(" ")
            stack.append(" ")
            stack += reversed(x.children)
    return " ".join("".join(parts).split())


def _own_text(node: Node) -> str:
    """Text of an element without that of block elements below it."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag in INLINE:
            stack += reversed(x.children)
        else:
            parts.append(" ")
    return " ".join("".join(parts).split())


def paragraph_points(text: str) -> float:
    """What a paragraph is worth: one, its commas, and its length up to 300 characters."""
    return 1 + text.count(",") + min(3.0, len(text) / 100)


def _score(root: Node, least_chars: int) -> list[Node]:
    """Give points to the containers of all paragraphs of a length; the scored ones in page order."""
    order = list(_nodes(root))
    for node in order:
        keeps = node.tag in CONTAINERS
        if not keeps and node.tag not in PARAGRAPHS:
            continue
        text = _own_text(node)
        if len(text) < least_chars:
            continue
        points = paragraph_points(text)
        node.points += points * (1 - node.density)
        up = node if keeps else node.parent or node
        for share in SHARES:
            if up is None:
                break
            if up.score is None:
                up.score = BONUS.get(up.tag, 0.0)
            up.score += points / share
            up = up.parent
    for node in reversed(order):
        if node.parent is not None:
            node.parent.points += node.points
    scored = [n for n in order if n.score is not None]
    for node in scored:
        node.score *= 1 - node.density
    return scored


def best_container(root: Node) -> tuple[Node, Node] | None:
    """The element of the highest score, the inner one of equals, and the lowest one from it on that holds most points.

    An article or main element around it is taken instead, and not left for a wider one. Labels count only where there
    is nothing longer.
    """
    scored = _score(root, LABEL_CHARS) or _score(root, 1)
    if not scored:
        return None
    best = max(scored, key=lambda n: (n.score, n.depth))  # the first of equals
    article, up = None, best
    while up is not None:
        if up.tag in ARTICLE:
            article = up
        up = up.parent
    whole = article or best
    while article is None and whole.parent is not None and whole.points < MOST * root.points:
        whole = whole.parent
    return best, whole


def _link_list(node: Node) -> bool:
    return node.tag not in INLINE and node.tag not in HEADINGS and node.size > 0 and node.density >= LINKED


def main_text(html: str | None) -> str:
    """The main text of one page: its blocks in page order, joined by one space; empty if there is none."""
    if not html:
        return ""
    builder = _Builder()
    builder.feed(html)
    root = builder.root
    _count_controls(root)
    _without(root, _never)
    _measure(root)
    _without_foreign(root)
    _measure(root)
    found = best_container(root)
    if found is None:
        return ""
    best, whole = found
    # lists of links beside the best container, on the way up to what is kept
    inner, up = best, best.parent
    while inner is not whole and up is not None:
        up.children = [c for c in up.children if isinstance(c, str) or c is inner or not _link_list(c)]
        inner, up = up, up.parent
    if whole.tag not in ARTICLE or whole.parent is None:
        return _text(whole)
    beside = [x for x in whole.parent.children if not isinstance(x, str) and (x is whole or (x.tag in ARTICLE and x.points > 0 and not _link_list(x)))]
    return " ".join(t for t in map(_text, beside) if t)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append ``text``, the main text of each whole page, and ``n_chars``, its code points. A map without shuffle.

    Null, empty and text-free pages give an empty text; broken markup is read as far as it goes; repeated
    rows are alike; carried columns of these names give way; an empty table gives no rows.
    """
    carried = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]

    @F.pandas_udf(T.StringType())
    def texts(html: pd.Series) -> pd.Series:
        return html.map(main_text, na_action=None)

    text = texts(F.col(html_col).cast("string"))
    out = pages.select(*[F.col(f"`{c}`") for c in carried], text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
