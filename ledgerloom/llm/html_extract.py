"""Main text of web pages by tree scoring.

The page becomes a tree, as browsers close what authors leave open. Parts that are no content (scripts, menus,
forms and what is named like an advert, a notice or a comment list) go. Every paragraph passes points for its
length and commas to its parent and half of them to the grandparent, each container's sum is discounted by the
share of its text that is in links, and the best one is kept, with siblings that score well or read like text.
"""

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object embed applet canvas svg math audio video map head title textarea select option button datalist dialog".split())
APART = frozenset("nav header footer aside form menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
                  "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
_LIST_ITEMS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"},
               "tfoot": {"table"}, "option": {"select"}}
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "thead": {"caption", "colgroup"}, "option": {"option"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words in a class, id or role that mark what is no article text.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert[^\W_]*+|adsense|banner|breadcrumbs?|comments?|commentlist|disqus|respond|replies|consent|cookies?|gdpr|notices?|alerts?|popup|modal|overlay|"
    r"footer|foot|header|masthead|topbar|menu|menubar|nav|navbar|navigation|pagination|pager|promo[^\W_]*+|related|recommend[^\W_]*+|share|sharing|sidebar|side|social|sponsor[^\W_]*+|"
    r"subscri[^\W_]*+|newsletter|signup|login|search|skip|tags?|toolbar|widgets?|outbrain|taboola|rating|contentinfo|complementary|search|dialog|alert)(?:$|[\s_-])", re.IGNORECASE)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|page|post|story|text|blog|hentry)(?:$|[\s_-])", re.IGNORECASE)

#: A sibling of the best container is kept from this share of its score on.
SIBLING_SHARE = 0.2


# What begins a tag, a comment or what browsers read as one. Nothing below steps back, so no page costs more than its length.
_MARKUP = re.compile(r"<(/?[a-zA-Z])|<!--|<[!?/]")
_ONE = r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+)))?+)"
_ATTRIBUTE = re.compile(_ONE)
_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:" + re.sub(r"\((?!\?)", "(?:", _ONE) + r")*+)[\s/]*+>")
_COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.DOTALL)
_BOGUS = re.compile(r"<[^>]*+>")
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style")}


class Node:
    __slots__ = ("tag", "parent", "children", "mark", "score", "length", "linked", "commas", "number")

    def __init__(self, tag: str, parent, mark: str = ""):
        self.tag, self.parent, self.mark, self.children = tag, parent, mark, []
        self.score = 0.0


class _Tree:
    """Nodes with text pieces as children; elements that are never text are left out."""

    def __init__(self):
        self.root = self.at = Node("#root", None)
        self.depth = 0
        self.open: dict[str, list[int]] = {}  # depths of the open elements of a tag
        self.blocks: list[int] = []  # depths of open blocks
        self.silent = 0

    def _push(self, tag: str, mark: str = "") -> None:
        node = Node(tag, self.at, mark)
        self.at.children.append(node)
        self.at = node
        self.depth += 1
        self.open.setdefault(tag, []).append(self.depth)
        if tag in BLOCK:
            self.blocks.append(self.depth)
        self.silent += tag in SILENT

    def _pop(self) -> None:
        self.open[self.at.tag].pop()
        if self.at.tag in BLOCK:
            self.blocks.pop()
        self.silent -= self.at.tag in SILENT
        self.at = self.at.parent
        self.depth -= 1

    def _innermost(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _close(self, tags, beyond: int) -> bool:
        """Closes the innermost of `tags` that is open deeper than `beyond`, with all that it holds."""
        depth = self._innermost(tags)
        if depth <= beyond:
            return False
        while self.depth >= depth:
            self._pop()
        return True

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and self.open.get("p"):
            self._close({"p"}, self._innermost({"table", "td", "th", "button", "object"}))
        if tag in _HEADINGS and self.at.tag in _HEADINGS:
            self._pop()
        if tag in _CLOSES:
            while self._close(_CLOSES[tag], self._innermost(_LIST_ITEMS.get(tag, ()))):
                pass
        if tag == "body" and self.open.get("head"):
            self._close({"head"}, 0)
        if tag in VOID:
            if tag in ("br", "hr"):
                self.at.children.append(Node(tag, self.at))
            return
        if tag in ("html", "body") and self.open.get(tag):
            return
        mark = ""
        for name, value in attrs:
            if value and name in ("class", "id", "role", "aria-label"):
                mark += " " + value
            elif name in ("hidden",) or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*+:\s*+none", value):
                mark += " overlay"
        self._push(tag, mark)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "script", "iframe", "object") and self.at.tag == tag:
            self._pop()

    def handle_endtag(self, tag):
        if tag == "p" and not self.open.get("p"):
            return
        if tag in VOID or not self.open.get(tag):
            return
        if tag in ("html", "body"):
            return
        inline = tag not in BLOCK and tag not in SILENT  # its end tag closes nothing beyond its block
        self._close({tag}, self.blocks[-1] if inline and self.blocks else 0)

    def handle_data(self, data):
        if not self.silent:
            self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a page, in time linear in its length.

    Tags are read as the HTML standard reads them: what the page leaves open at its end, a tag, an attribute's value, a
    comment or a script, takes the rest of the page; a `<` that begins none of these is text.
    """
    tree, at = _Tree(), 0
    while at < len(html):
        mark = _MARKUP.search(html, at)
        end = mark.start() if mark else len(html)
        if end > at:
            tree.handle_data(unescape(html[at:end]))
        if mark is None:
            break
        found = (_TAG if mark[1] else _COMMENT if mark[0] == "<!--" else _BOGUS).match(html, end)
        if found is None:
            break
        at = found.end()
        if not mark[1]:
            continue
        tag = found["name"].lower()
        if found["end"]:
            tree.handle_endtag(tag)
            continue
        attrs = [(m[1].lower(), unescape(m[2] or m[3] or m[4] or "")) for m in _ATTRIBUTE.finditer(found["attributes"]) if m[1]]
        if found[0].endswith("/>"):
            tree.handle_startendtag(tag, attrs)
        else:
            tree.handle_starttag(tag, attrs)
            if tag in _RAW:
                close = _RAW[tag].search(html, at)
                at = close.start() if close else len(html)
    return tree.root


def _apart(node: Node, outer: bool) -> bool:
    """Whether a node is no content by its kind or name. A header within an article holds its title and stays."""
    if node.tag in SILENT:
        return True
    if node.tag in APART and (node.tag != "header" or outer):
        return True
    if node.tag in ("body", "html", "article", "main", "p", "h1", "#root") and not re.search(r"comment", node.mark, re.IGNORECASE):
        return False
    return bool(node.mark) and bool(UNLIKELY.search(node.mark)) and not (LIKELY.search(node.mark) and not re.search(r"comment|sidebar|advert|cookie|footer|nav|menu", node.mark, re.IGNORECASE))


def _measure(root: Node) -> list[Node]:
    """Drops what is no content, in place; gives the nodes in page order with their own text length, linked length and commas."""
    order: list[Node] = []
    stack = [(root, False, False)]
    while stack:
        node, in_link, in_article = stack.pop()
        node.number = len(order)
        order.append(node)
        in_link = in_link or node.tag == "a"
        in_article = in_article or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _apart(c, not in_article)]
        node.length = node.linked = node.commas = 0
        for c in node.children:
            if isinstance(c, str):
                size = len(" ".join(c.split()))
                node.length += size
                node.commas += c.count(",") + c.count("،") + c.count("、") + c.count("，")
                node.linked += size if in_link else 0
        stack.extend((c, in_link, in_article) for c in reversed(node.children) if not isinstance(c, str))
    for node in reversed(order):  # sums over the subtree
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.commas += node.commas
    return order


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _best(order: list[Node]) -> Node | None:
    """The container with most points after the discount; the first of equals."""
    scored = {}
    for node in order:
        own_text = node.tag in ("div", "section", "article", "main", "body", "center") and sum(len(c.strip()) for c in node.children if isinstance(c, str)) >= 25
        if not (node.tag in PARAGRAPH or own_text) or node.length < 25:
            continue
        points = 1 + node.commas + min(node.length / 100, 3)
        up = node if own_text else node.parent
        for share in (1.0, 0.5):
            if up is None:
                break
            up.score += points * share
            scored[up.number] = up
            up = up.parent
    best = None
    for number in sorted(scored):
        node = scored[number]
        bonus = 25 if node.tag in ("article", "main") or LIKELY.search(node.mark) else 0
        node.score = (node.score + bonus) * (1 - _density(node))
        if best is None or node.score > best.score:
            best = node
    return best


def _inner(node: Node) -> set[str]:
    return {c.tag for c in node.children if not isinstance(c, str)}


def _highest(node: Node) -> float:
    """The best score in a node or below it."""
    found, stack = 0.0, [node]
    while stack:
        c = stack.pop()
        found = max(found, c.score)
        stack.extend(d for d in c.children if not isinstance(d, str))
    return found


def _chosen(best: Node) -> list:
    """The best container and those siblings that score well or read like text, in page order."""
    while best.parent is not None and best.tag in PARAGRAPH | {"b", "i", "em", "strong", "span", "ul", "ol", "dl", "table", "tbody", "tr"}:
        best = best.parent
    score, above = best.score, best
    while above is not None and above.tag not in ("article", "main"):
        above = above.parent
    if above is not None and above.length and best.length < above.length:
        best = above
    if best.tag in ("article", "main"):  # what only wraps it has its siblings
        while best.parent is not None and best.parent.tag not in ("body", "html") and best.parent.length == best.length:
            best = best.parent
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    out = []
    for c in best.parent.children:
        if c is best:
            out.append(c)
        elif isinstance(c, Node):
            reads = c.tag in PARAGRAPH and (c.length > 80 and _density(c) < 0.25 or 0 < c.length <= 80 and c.linked == 0)
            points = _highest(c) if c.tag in ("article", "section", "main") else c.score
            if reads or points >= max(10, SIBLING_SHARE * score) and _density(c) < 0.5:
                out.append(c)
    return out


def _blocks(node) -> list[str]:
    """Text of blocks in page order, white space as single spaces."""
    out: list[str] = []
    part: list[str] = []

    def end():
        text = " ".join("".join(part).split())
        part.clear()
        if text:
            out.append(text)

    stack = [node]
    while stack:
        c = stack.pop()
        if c is None:
            end()
        elif isinstance(c, str):
            part.append(c)
        elif c.tag == "br":
            part.append(" ")
        else:
            block = c.tag in BLOCK
            if block:
                end()
                stack.append(None)
            stack.extend(reversed(c.children))
    end()
    return out


def main_text(html: str | None) -> str:
    """The main text of a page, empty if it has none."""
    if not html:
        return ""
    root = parse(html)
    order = _measure(root)
    best = _best(order)
    if best is None:  # nothing reads like a paragraph: what is left of the page
        return " ".join(_blocks(root))
    return " ".join(text for part in _chosen(best) for text in _blocks(part))


def _extracted(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) per row: main text with character references decoded, blocks joined by one space.

    A null or empty page has an empty text.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string")
