"""Main text of web pages by tag-path ratios.

A page is read once into text nodes with their root-to-leaf tag path (tags with first class or id).
Per path the text length and the punctuation are added up and divided by its nodes; both ratios are
smoothed along the page and multiplied.  Paths whose mean reaches ``LEVEL`` standard deviations of
the page are content.  Short nodes beside content (headings, one-word paragraphs, table cells,
captions, definitions) belong to it: all that lies in the lowest element around the content is kept,
or in the article or main around that element, however little of the text a part holds.  Where
articles and mains hold most of the content, that is their lowest common element, and of the rest of
the page the containers of content are kept.  Content only by its neighbours along the page counts
with at least one punctuation mark a node, and does not widen that element.  If nothing below the
body holds all content, containers of nothing but links before and behind the content are left out.

Elements that are never main text by their tag are left out before counting, and so are forms and
elements with such a word in their class, id or role, unless they turn out to lie around the main
text (see ``_left_out``).  Words that say what a layout has or lacks (has-sidebar, no-footer) do not count.

Cases: null or empty html, and pages without content, give an empty text; unclosed elements, cut-off
tags and pages cut off in the middle are read to the end; repeated rows are read alike; extra
columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

import html as markup
import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfspark.llm.common import append, query, table

LEVEL = 0.5
KERNEL = np.array([0.1, 0.2, 0.4, 0.2, 0.1])

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:\s+[^\s=>\"'/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?|[^>])*?)(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
RAW = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"},
          "tbody": {"table"}, "tfoot": {"table"}}
KEEPS_P = INLINE | {"br", "img", "input", "p"}
NEVER = set("head nav footer aside script style noscript template iframe svg math canvas object audio video select button dialog menu textarea title".split())
NOT_MAIN = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|menu|nav|navbar|navigation|breadcrumbs?|sidebar|"
                      r"side|aside|foot|footer|masthead|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
                      r"search|share|sharing|social|related|recommended|comments?|respond|replies|disqus|widget|toolbar|pagination|pager|legal|copyright)(?:$|[-_\s])", re.I)
LAYOUT = re.compile(r"(?<![^-_\s])(?:has|no|with|without)[-_]\S*", re.I)
OTHERS = re.compile(r"(?:^|[-_\s])(?:related|recommended|comments?|respond|replies|disqus)(?:$|[-_\s])", re.I)
RANK = {"h1": 1, "article": 2, "main": 3}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


BLOCKS_OF_TEXT = INLINE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre"}


class Open:
    """The open elements of a page.  What a text node or a tag asks of them (its path, its container,
    whether a link is open, which element a tag closes) is known without walking the stack, so that
    pages with very deep nesting are read in linear time."""

    def __init__(self):
        # by depth: tag, number, path, container, whether never main text
        self.tags, self.numbers, self.paths, self.homes, self.never = [], [], [], [], []
        self.where: dict[str, list[int]] = defaultdict(list)        # depths of each tag
        self.solid: list[int] = []      # depths of elements that are not inline
        self.hidden = 0
        self.known: dict[tuple[int, str], int] = {}     # number of a path by that of its parent and its last label

    def push(self, tag: str, label: str, never: bool, number: int) -> None:
        depth = len(self.tags)
        step = (self.paths[-1] if depth else 0, label)
        self.paths.append(self.known.setdefault(step, len(self.known) + 1))
        self.homes.append((self.homes[-1] if depth else 0) if tag in BLOCKS_OF_TEXT else number)
        self.tags.append(tag)
        self.numbers.append(number)
        self.never.append(never)
        self.where[tag].append(depth)
        if tag not in INLINE:
            self.solid.append(depth)
        self.hidden += never

    def pop_to(self, size: int) -> None:
        while len(self.tags) > size:
            tag = self.tags.pop()
            self.where[tag].pop()
            if tag not in INLINE:
                self.solid.pop()
            self.hidden -= self.never.pop()
            for column in (self.numbers, self.paths, self.homes):
                column.pop()

    def end(self, tag: str) -> None:
        """An end tag closes the innermost element of its name; inline ones do not reach beyond a block."""
        if self.where[tag]:
            depth = self.where[tag][-1]
            if tag not in INLINE or not self.solid or self.solid[-1] < depth:
                self.pop_to(depth)

    def close_paragraph(self) -> None:
        if self.solid and self.tags[self.solid[-1]] == "p":
            self.pop_to(self.solid[-1])

    def close_siblings(self, tag: str) -> None:
        """Closes what an element of this name ends, as far as the innermost element that bounds it."""
        bound = max((self.where[x][-1] for x in BOUNDS[tag] if self.where[x]), default=-1)
        found = [self.where[x][k] for x in CLOSES[tag] for k in [bisect_right(self.where[x], bound)] if k < len(self.where[x])]
        if found:
            self.pop_to(min(found))


def text_nodes(page: str):
    """(path, container, text, in a link, element) of each text node that may be main text, in page order,
    None for the end of a block; and (parent, tag) of each element by number, in page order, 0 being
    the page itself.  Paths are numbers."""
    stack = Open()
    out, at, tree = [], 0, [(0, "")]
    doubtful: dict[int, bool] = {}      # elements to be left out, unless they hold the main text: others' words

    def text(piece: str):
        if piece and not stack.hidden:
            if stack.tags:
                out.append((stack.paths[-1], stack.homes[-1], piece, bool(stack.where["a"]), stack.numbers[-1]))
            else:
                out.append((0, 0, piece, False, 0))

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        text(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag not in INLINE:
            out.append(None)
        if m[1]:
            stack.end(tag)
            continue
        if tag in VOID:
            continue
        if tag not in KEEPS_P or tag == "p":
            stack.close_paragraph()
        if tag in CLOSES:
            stack.close_siblings(tag)
        if tag == "body":
            while stack.tags and stack.tags[-1] != "html":
                stack.pop_to(len(stack.tags) - 1)
        names = [a or b or c for _, a, b, c in NAMED.findall(m[3] or "")]
        inside = bool(stack.where["article"] or stack.where["main"])
        left_out = tag in NEVER or (tag == "header" and not inside)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if (m[3] or "").rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        label = tag + "".join("." + x.split()[0].lower() for x in names[:1] if x.split())
        tree.append((stack.numbers[-1] if stack.tags else 0, "" if stack.hidden or left_out else tag))
        if not stack.hidden and not left_out and tag not in ("html", "body", "article", "main"):
            words = " ".join(LAYOUT.sub(" ", x) for x in names)
            if tag == "form" or NOT_MAIN.search(words):
                doubtful[len(tree) - 1] = bool(OTHERS.search(words))
        stack.push(tag, label, left_out, len(tree) - 1)
    text(page[at:])
    if doubtful:
        gone = _left_out(out, tree, doubtful)
        out = [node for node in out if node is None or not gone[node[4]]]
    return out, tree


def _left_out(nodes: list, tree: list, doubtful: dict) -> list:
    """For each element whether it is left out with a doubtful one.  A doubtful element stays if it
    holds a main, article or h1 of higher rank than any beside it, or more than half of the page's
    text, where none of higher rank beside it is a main or article.  Comments and related pages,
    which often are articles of their own, stay only if no main, article or h1 lies beside them.
    What lies in other doubtful elements does not count as beside."""
    n = len(tree)
    size, best = [0] * n, [RANK.get(tag, 0) for _, tag in tree]
    for node in nodes:
        if node is not None:
            size[node[4]] += len(node[2].strip())
    over = [0] * n              # innermost doubtful element at or above; 0 for none
    direct: dict[int, int] = defaultdict(int)       # highest rank of what lies in one, but in no deeper one
    for k in range(1, n):
        over[k] = k if k in doubtful else over[tree[k][0]]
        direct[over[k]] = max(direct[over[k]], best[k])
    for k in range(n - 1, 0, -1):
        size[tree[k][0]] += size[k]
        best[tree[k][0]] = max(best[tree[k][0]], best[k])
    gone, beside = [False] * n, {0: 0}
    for k in range(1, n):
        gone[k] = gone[tree[k][0]]
        if k in doubtful:
            above = over[tree[k][0]]
            beside[k] = rank = max(beside[above], direct[above])
            most = 2 * size[k] > size[0]
            if doubtful[k]:
                stays = rank == 0 and (best[k] > 0 or most)
            else:
                stays = best[k] > rank or most and (best[k] >= rank or rank < RANK["article"])
            gone[k] |= not stays
    return gone


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by one space."""
    (nodes, tree), length, marks, count = text_nodes(page or ""), defaultdict(int), defaultdict(int), defaultdict(int)
    full = []
    for node in nodes:
        if node is not None:
            words = markup.unescape(node[2])
            bare = words.strip()
            if bare:
                full.append((node[0], node[1], len(bare), node[3]))
                length[node[0]] += len(bare)
                marks[node[0]] += len(PUNCTUATION.findall(bare))
                count[node[0]] += 1
    if not full:
        return ""
    ratio = _smooth(np.array([length[x[0]] / count[x[0]] for x in full], float))
    sign = _smooth(np.array([1 + marks[x[0]] / count[x[0]] for x in full], float))
    fused = ratio * sign
    per: dict[int, list[float]] = defaultdict(list)
    for x, value in zip(full, fused):
        per[x[0]].append(float(value))
    limit = LEVEL * float(fused.std())
    content = {path for path, values in per.items() if sum(values) / len(values) >= limit}
    # long by themselves, not only by their neighbours along the page
    own = {path for path in content if length[path] / count[path] * (1 + marks[path] / count[path]) >= limit}
    homes = _homes(full, tree, own or content)
    # sentences that are content by their neighbours are kept where they stand, and stretch nothing
    homes |= {x[1] for x in full if x[0] in content and marks[x[0]] >= count[x[0]]}
    kept = []
    for node in nodes:
        if node is None:
            kept.append(" ")
        elif node[1] in homes:
            kept.append(markup.unescape(node[2]))
    return " ".join("".join(kept).split())


def _smooth(values: np.ndarray) -> np.ndarray:
    """Weighted means over neighbours along the page; the ends repeat."""
    wide = np.pad(values, len(KERNEL) // 2, mode="edge")
    return np.convolve(wide, KERNEL, mode="valid")


def _homes(full: list, tree: list, content: set) -> set:
    """Containers whose text is kept, given the paths of content."""
    weight: dict[int, int] = defaultdict(int)
    for path, home, size, _ in full:
        if path in content:
            weight[home] += size
    if not weight:
        return set()
    named = [False] * len(tree)         # in an article or main
    for k in range(1, len(tree)):
        named[k] = named[tree[k][0]] or tree[k][1] in ("article", "main")
    told = [home for home in weight if named[home]]
    if 2 * sum(weight[home] for home in told) <= sum(weight.values()):
        told = list(weight)
    root = _around(tree, min(told), max(told))
    k = root
    while k and tree[k][1] not in ("article", "main"):
        k = tree[k][0]
    root = k or root
    inside = [False] * len(tree)
    for k in range(len(tree)):
        inside[k] = k == root or k > 0 and inside[tree[k][0]]
    kept = {x[1] for x in full if inside[x[1]]}
    if tree[root][1] in ("", "html", "body"):
        kept -= _linked_edges(full, weight)
    return kept | set(weight)


def _around(tree: list, first: int, last: int) -> int:
    """The lowest element around two; numbers follow the page, so that of the lowest and the highest
    of a set is that of the set."""
    while first != last:
        if first > last:
            first = tree[first][0]
        else:
            last = tree[last][0]
    return first


def _linked_edges(full: list, weight: dict) -> set:
    """Containers before the first and behind the last content that hold nothing but links."""
    at = [k for k, x in enumerate(full) if x[1] in weight]
    edges = full[:at[0]] + full[at[-1] + 1:]
    return {x[1] for x in edges} - {x[1] for x in full if not x[3]}


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""
    def make(batch):
        texts = [main_text(page) for page in batch.column(html).to_pylist()]
        return [texts, [len(t) for t in texts]]
    return append(pages, "text string, n_chars long", make)


@query("op9_main_text")
def op9_main_text(spark, folder):
    """Main text of every page."""
    return extract(table(spark, folder, "pages").select("page_id", "url", "html")).drop("html")
