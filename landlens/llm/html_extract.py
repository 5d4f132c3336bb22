"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors; a container's points are discounted by
the share of its text that stands in links. The best container is kept with those of its siblings that score
well enough. Everything is in one pass over a page; pages are independent.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas object xmp noframes noembed".split())
DROPPED = frozenset("nav header footer aside form button select dialog menu label fieldset legend input head".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body blockquote html".split())
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An element ends an open element of these names when it opens, up to the named bounds.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id or role that mark what is not the article. The first kind marks it in any name, but for one within an
#: article, the second kind only in names that have no other words than these and the neutral ones: "share-buttons" goes,
#: "share-price" and "side-effects" stay.
SURE = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|gdpr|popup|modal|newsletter|subscribe|signup|login|recommend\w*|sidebar|nav\w*|menu\w*|breadcrumb\w*|masthead|footer|copyright|comment\w*|disqus|pagination|pager|toolbar|complementary|contentinfo")
DOUBTED = re.compile(r"consent|notice\w*|alert|share\w*|social|related|side|widget|header|foot|responses?|replies|reply|search|tags|dialog")
NEUTRAL = frozenset("area articles author bar block bottom box button buttons by center col column container count div footer form group icons id inline inner item items js large left links list mb md media meta middle module more mt news outer panel post posts reader readers right row section sections site slot small sm sticky stories story thread title toggle top unit user users view wp wrap wrapper article body content entry main page text".split())
#: Words that mark the article.
LIKELY = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|newsletter|subscribe|signup|login|share\w*|social|related|recommend\w*|sidebar|side|widget|nav\w*|menu\w*|breadcrumb\w*|header|masthead|footer|foot|copyright|comment\w*|disqus|respons(?:e|es)|replies|reply|pagination|pager|search|toolbar|tags|complementary|contentinfo|navigation|dialog)(?:$|[\s_-])", re.I)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)
#: Elements that take the points of what they hold undiminished.
SEMANTIC = ("article", "main")
#: In such an element the two word lists do not count.
ALWAYS = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMING = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
WHITE = re.compile(r"[\s\xa0]+")


def furniture(names: str, within: bool) -> bool:
    """Whether a class, id or role names what is not the article, for an element ``within`` an article or elsewhere."""
    for name in names.lower().split():
        words = [w for w in re.split("[_-]+", name) if w]
        sure, doubted = (any(kind.fullmatch(w) for w in words) for kind in (SURE, DOUBTED))
        if sure and not within:
            return True
        if (sure or doubted) and all(w in NEUTRAL or w.isdigit() or SURE.fullmatch(w) or DOUBTED.fullmatch(w) for w in words):
            return True
    return False


class Node:
    """An element: ``items`` are its texts and child elements in page order, ``within`` an article or not."""

    __slots__ = ("name", "parent", "within", "items", "dropped", "doubtful", "bonus", "score", "n_text", "n_link", "links")

    def __init__(self, name, parent, dropped=False, bonus=0, doubtful=False):
        self.name, self.parent, self.dropped, self.bonus, self.doubtful = name, parent, dropped, bonus, doubtful
        self.within = parent is not None and (parent.within or parent.name in SEMANTIC)
        self.items, self.score, self.n_text, self.n_link, self.links = [], 0.0, 0, 0, 0

    @property
    def link_density(self) -> float:
        return self.n_link / self.n_text if self.n_text else 0.0


def tags(page: str):
    """(start, end, closing, name, attributes) of each tag; comments and raw elements have no name."""
    at = 0
    while m := TAG.search(page, at):
        at = m.end()
        closing, name, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        name = (name or "").lower()
        if name in RAW and not closing:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            name = ""
        yield m.start(), at, bool(closing), name, attrs or ""


def parse(page: str) -> Node:
    """Tree of elements and decoded texts. Unclosed paragraphs, items and cells end where HTML ends them."""
    root = Node("#page", None)
    cur, at, open_names = root, 0, {}

    def close_to(node):
        """Leave the elements from the current one up to ``node``'s children."""
        nonlocal cur
        while cur is not node:
            open_names[cur.name] -= 1
            cur = cur.parent

    for start, end, closing, name, attrs in tags(page):
        if start > at:
            cur.items.append(html.unescape(page[at:start]))
        at = end
        if not name or (name in ("html", "body") and (closing or open_names.get(name))):
            continue
        if closing:
            if open_names.get(name):
                up = cur
                while up.name != name and not (up.name in ("td", "th") and name not in ("tr", "table", "tbody", "thead", "tfoot")):
                    up = up.parent
                if up.name == name:
                    close_to(up.parent)
            continue
        if name in ENDS_P and open_names.get("p"):
            up = cur
            while up.name != "p" and up.name not in BLOCKS and up is not root:
                up = up.parent
            if up.name == "p":
                close_to(up.parent)
        if name in SIBLINGS:
            ended, bounds = SIBLINGS[name]
            if any(open_names.get(e) for e in ended):
                up, last = cur, None
                while up is not root and up.name not in bounds:
                    last = up if up.name in ended else last
                    up = up.parent
                if last is not None:
                    close_to(last.parent)
        dropped, doubtful, bonus = name in DROPPED, False, 25 if name in SEMANTIC else 0
        if attrs:
            dropped = dropped or bool(HIDDEN.search(attrs))
            names = " ".join(a or b or c for a, b, c in NAMING.findall(attrs))
            if names and name not in ALWAYS:
                likely = bool(LIKELY.search(names))
                unlikely = furniture(names, cur.within or cur.name in SEMANTIC)
                # Both kinds of words, as in "comment-body" or "content with-sidebar": what stands in it decides.
                doubtful = unlikely and likely
                dropped = dropped or (unlikely and not likely)
                bonus += 25 * (likely and not unlikely)
        node = Node(name, cur, dropped, bonus, doubtful)
        cur.items.append(node)
        if name not in VOID:
            cur = node
            open_names[name] = open_names.get(name, 0) + 1
    if at < len(page):
        cur.items.append(html.unescape(page[at:]))
    drop_doubtful(root)
    return root


def drop_doubtful(root: Node) -> None:
    """Elements with words of both kinds go unless they hold the page's heading or article."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Node)]
    holders = set()
    for node in reversed(order):
        if node.name == "h1" or node.name in SEMANTIC or id(node) in holders:
            holders.add(id(node))
            holders.add(id(node.parent))
        elif node.doubtful:
            node.dropped = True


def in_order(root: Node) -> list[Node]:
    """Elements that are not dropped, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.dropped]
    return out


def measure(nodes: list[Node]) -> None:
    """Lengths of text and of link text, summed up the tree."""
    for node in reversed(nodes):
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        node.n_text += own
        if node.name == "a":
            node.n_link, node.links = node.n_text, node.links + 1
        if node.parent:
            node.parent.n_text += node.n_text
            node.parent.n_link += node.n_link
            node.parent.links += node.links


def is_menu(node: Node) -> bool:
    """A list or box of little more than short links, outside an article."""
    return not node.within and node.name in ("ul", "ol", "dl", "div", "section", "table") and node.links >= 3 and node.link_density > 0.8 and node.n_link < 25 * node.links


def pass_points(nodes: list[Node]) -> None:
    """Every paragraph gives 1 point, 1 for each comma and up to 3 for its length to its parent, half to the next
    ancestor, a third of that half and so on; text right in a container counts as a paragraph of it. An article or main
    element takes all that the best of its parts took, whatever lies between."""
    given, first, second, rest = ({} for _ in range(4))  # of a node: all points below it, those at full, half and lower shares
    add = lambda points, node, n: points.__setitem__(node, points.get(node, 0.0) + n)
    for node in reversed(nodes):  # children before parents, so each node hands its sums up once
        up = node.parent
        paragraph = node.name in ("p", "pre", "blockquote", "li", "dd", "td")
        texts = any(isinstance(x, str) and len(x.strip()) >= 25 for x in node.items)
        if (paragraph or (texts and node.name in CONTAINERS)) and node.n_text >= 25:
            commas = sum(x.count(",") for x in node.items if isinstance(x, str))
            points = (1 + commas + min(3.0, node.n_text / 100)) * (1 - node.link_density)
            taker = up if paragraph else node
            if taker is not None:
                add(first, taker, points)
                add(given, taker, points)
        passed = first.get(node, 0.0), second.get(node, 0.0), rest.get(node, 0.0)
        node.score += node.bonus + (given.get(node, 0.0) if node.name in SEMANTIC else sum(passed))
        if up is not None:
            add(given, up, given.get(node, 0.0))
            add(second, up, passed[0] / 2)
            add(rest, up, (passed[1] + passed[2]) / 3)


def container(nodes: list[Node]) -> list[Node]:
    """The best container and its siblings that belong to it, in page order."""
    ranked = [n for n in nodes if n.name in CONTAINERS or n.name == "#page"]
    value = lambda n: n.score * (1 - n.link_density)
    best = max(ranked, key=value)
    if best.parent is None:
        return [best]
    limit = max(10.0, 0.2 * value(best))
    kept = []
    for x in best.parent.items:
        if not isinstance(x, Node) or x.dropped:
            continue
        paragraph = x.name in ("p", "pre", "blockquote") and x.n_text >= 80 and x.link_density < 0.25
        if x is best or (x.name in CONTAINERS and value(x) >= limit and not is_menu(x)) or paragraph:
            kept.append(x)
    return kept


def blocks(kept: list[Node]) -> list[str]:
    """Texts of the blocks below the kept elements, white space made single spaces."""
    out, run = [], []

    def flush():
        text = WHITE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list = list(reversed(kept))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.name in ("br", "hr"):
            run.append(" ")
        elif not x.dropped and not is_menu(x):
            if x.name in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(x.items)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page as text, one line a block; empty if there is none."""
    if not page:
        return ""
    nodes = in_order(parse(page))
    measure(nodes)
    pass_points(nodes)
    return "\n".join(blocks(container(nodes)))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) of every row.

    Null and empty pages give an empty text, a page without paragraphs all its text outside menus and the like.
    Repeated rows give repeated results; other columns are ignored; an empty table gives none. One narrow pass: no shuffle.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
