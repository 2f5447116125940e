"""Main text of HTML pages by composite text density.

The density of a node is its characters per tag, corrected for links: text whose
letters stand mostly in links counts for less. The sum of the densities of a
node's children is highest where many dense blocks stand side by side, which is
the article. The lowest density on the way from that node up to the body is the
threshold: what lies elsewhere and reaches it is article text too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.llm.common import extended, prepare

# Element and class names that mark parts which are not the article.
DROPPED = frozenset(
    "script style noscript template head title button select option textarea input label "
    "iframe object embed canvas svg math audio video map".split())
#: These, and what names and roles mark, may also wrap a whole page; see :func:`dropped`.
MARKED = frozenset("nav footer aside form menu dialog".split())
HEAD = frozenset("title meta link base style script noscript template".split())  # what may stand in a head
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|alert|popup|modal|"
    r"nav|navbar|navigation|menu|breadcrumb\w*|sidebar|side|widget\w*|footer|masthead|share|social|"
    r"related|recommend\w*|newsletter|subscribe|signup|login|comment|comments|comment-list|disqus|replies|pager|pagination|"
    r"copyright|tags|toolbar|search)(?:$|[\s_-])", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment\w*|disqus|replies)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
STATE = re.compile(r"(?:^|\s)(?:has|with|no|is|js)-\S*", re.I)  # says something of the page, not of the node
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
# An open element of the key's group ends where one of these starts.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
INSIDE = frozenset(("article", "main"))


PLAIN, MARK, DROP = 0, 1, 2
#: The share of a page without article or main that a marked node must hold to be its wrapper.
WRAPPER = 0.7


class Tree(HTMLParser):
    """The nodes of a page in order of their start tags, with marks, texts and block bounds.

    What does not belong to an article is marked and stays in the tree, so that omitted
    end tags close it like anything else.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parent, self.marks = ["#root"], [-1], [PLAIN]
        self.comments = [False]
        self.chars, self.link_chars = [0], [0]
        self.open = [0]
        self.links = 0  # open links
        self.texts: list[tuple[int, str | None]] = []  # node and text; None is a block bound

    def parse_marked_section(self, i, report=1):
        """A malformed ``<![`` is a comment up to the next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD and tag not in ("html", "head"):
            self._close_open("head", ())
        if tag in BLOCKS:
            self._close_open("p", ("article", "section", "div", "td", "th", "li", "body", "blockquote", "button"))
            self.texts.append((self.open[-1], None))
        if tag in CLOSES:
            names, scope = CLOSES[tag]
            for name in names.split():
                self._close_open(name, scope)
        if tag == "br" or tag in ("td", "th"):
            self.texts.append((self.open[-1], " "))
        if tag in VOID:
            return
        mark, comments = self._mark(tag, attrs)
        self.tags.append(tag)
        self.parent.append(self.open[-1])
        self.marks.append(mark)
        self.comments.append(comments)
        self.chars.append(0)
        self.link_chars.append(0)
        self.open.append(len(self.tags) - 1)
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(self.tags[i] == tag for i in self.open[1:]):
            while self.tags[self._pop()] != tag:
                pass
        if tag in BLOCKS:
            self.texts.append((self.open[-1], None))

    def handle_data(self, data):
        node = self.open[-1]
        self.texts.append((node, data))
        n = len(data.strip())
        self.chars[node] += n
        if self.links:
            self.link_chars[node] += n

    def _mark(self, tag, attrs) -> tuple[int, bool]:
        """How a node is marked, and whether its names speak of comments."""
        if tag in DROPPED:
            return DROP, False
        inside = any(self.tags[i] in INSIDE for i in self.open)
        mark = MARK if tag in MARKED or (tag == "header" and not inside) else PLAIN
        comments = False
        if tag in INSIDE or tag in ("html", "body"):
            return PLAIN, False
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
                mark = MARK
            if name in ("class", "id") and value:
                value = STATE.sub(" ", value)
                if NOISE.search(value) or (not inside and HEADER.search(value)):
                    mark = MARK
                comments = comments or bool(COMMENTS.search(value))
        return mark, comments

    def _pop(self) -> int:
        node = self.open.pop()
        self.links -= self.tags[node] == "a"
        return node

    def _close_open(self, name: str, scope: tuple[str, ...]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[depth]]
            if tag == name:
                while len(self.open) > depth:
                    self._pop()
                return
            if tag in scope:
                return


def dropped(tree: Tree) -> list[bool]:
    """Whether a node lies in a part that is not the article's.

    A marked node is kept if it wraps the page: if the article or main element with
    most text outside links lies in it, or, on a page without either, if it holds most
    of the page's text (a section of comments never is such a wrapper).
    """
    n = len(tree.tags)
    out = [False] * n
    for i in range(1, n):
        out[i] = tree.marks[i] == DROP or out[tree.parent[i]]
    text = [0 if out[i] else tree.chars[i] - tree.link_chars[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        text[tree.parent[i]] += text[i]
    homes = [i for i in range(n) if tree.tags[i] in INSIDE and not out[i] and text[i]]
    wraps = set()
    if homes:
        node = max(homes, key=lambda i: (text[i], -i))
        while node >= 0:
            wraps.add(node)
            node = tree.parent[node]
    for i in range(1, n):
        marked = tree.marks[i] == MARK and i not in wraps
        if marked and not homes and not tree.comments[i] and text[i] > WRAPPER * text[0]:
            marked = False
        out[i] = out[i] or marked or out[tree.parent[i]]
    return out


def densities(tree: Tree, out: list[bool] | None = None) -> tuple[list[float], list[float]]:
    """Composite density of every node, and the sum over its children; dropped parts count for nothing."""
    n = len(tree.tags)
    out = dropped(tree) if out is None else out
    chars, links = ([0 if o else x for x, o in zip(xs, out, strict=True)] for xs in (tree.chars, tree.link_chars))
    tags, link_tags = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if out[i]:
            continue
        p = tree.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (tree.tags[i] == "a")
    whole, whole_links = max(chars[0], 1), links[0]
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, lc, t, lt = chars[i], links[i], max(tags[i], 1), link_tags[i]
        if c:
            base = math.log(c / max(c - lc, 1) * lc + whole_links / whole * c + math.e)
            ratio = (c / max(lc, 1)) * (t / max(lt, 1))
            density[i] = c / t * math.log(max(ratio, 1.0)) / max(math.log(base), 1e-9) if base > 1.0001 else c / t
            if lc == 0 and whole_links == 0:
                density[i] = c / t
        if i:
            sums[tree.parent[i]] += density[i]
    return density, sums


def chosen(tree: Tree, out: list[bool]) -> list[bool]:
    """Whether a node's own text belongs to the article."""
    density, sums = densities(tree, out)
    n = len(tree.tags)
    best = max(range(n), key=lambda i: (sums[i], -i))
    if sums[best] <= 0:
        best = max(range(n), key=lambda i: (density[i], -i))
    path, node = {best}, best
    threshold = density[best]
    while tree.parent[node] >= 0:
        node = tree.parent[node]
        path.add(node)
        if tree.tags[node] not in ("html", "#root"):
            threshold = min(threshold, density[node])
    kept = [False] * n
    for i in range(n):
        if not out[i] and (i == best or (i and kept[tree.parent[i]]) or (i not in path and density[i] >= threshold > 0)):
            kept[i] = True
    return kept


def main_text(html: str) -> str:
    """The article's blocks, white space folded and trimmed, joined by an empty line."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    out = dropped(tree)
    kept = chosen(tree, out)
    blocks, part = [], []
    for node, text in tree.texts:
        if text is None:
            if out[node]:
                continue
            blocks.append(part)
            part = []
        elif kept[node]:
            part.append(text)
    blocks.append(part)
    folded = (" ".join("".join(b).split()) for b in blocks if b)
    return "\n\n".join(b for b in folded if b)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every page.

    A null or empty page, or one without article text, gives an empty text and 0;
    repeated rows each get their row; other columns are ignored; html is read whole.
    """
    prepare(pages.sparkSession)
    rows = pages.select(*keep, F.col("html").cast("string").alias("_html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) if h.is_valid else "" for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"])

    return rows.mapInArrow(work, extended(rows.drop("_html"), "text string, n_chars long"))
