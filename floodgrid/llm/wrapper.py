"""Main text of web pages by wrapper induction.

Pages of one host come from one template or a few. Each page's tree is folded so that like siblings
are one repeated node; the children of a folded node then differ by tag. All folded trees of a host
are merged into the host's tree, and the tree of every page is aligned to it by
simple tree matching (Yang 1991: the largest match that keeps order and ancestors). Every page votes for each text at its node: at a node of the host's
tree where it is aligned, else at a node that only pages of its own tree have. A node that holds the
same text on enough pages of the host, or of the pages with one tag structure, is *constant*: it is
the template; what varies is content. Regions that HTML itself marks as no content (menus, footers,
forms, adverts and so on) are left out before.

The host's tree holds every place of its pages, so a page can only differ from it in the order of
children. It is therefore never put together: the orders of one place's children are added up over a host's
trees, of places where trees contradict the host's order that order is kept, and only the pages that contradict it meet it.

Copies weigh once: pages of the same texts are one page, and a page weighs 1/m if at least half of
its characters stand in texts that m pages or more of the host hold at their places, aligned or not, leaving out texts that nearly
every page holds. Where pages are mostly template and not nearly all share it, this keeps the template
rather than lose content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .text import Scratch, map_batches, quoted

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not parsed as markup.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes"))
#: Elements that begin a block of text; all others, unknown ones too, are inline.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul "
    "script style noscript template button select textarea iframe".split()
)
#: Texts that this share of a host's pages hold say nothing of whether two pages are copies.
NEARLY_ALL = 0.9
#: Elements that are no content wherever they stand.
DROP = frozenset(
    "head nav footer aside form script style noscript template button select option textarea input iframe object embed svg canvas audio video dialog menu title".split()
)
#: Whole words of class, id or role that mark a region as no content, inside of an article too.
_FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored ad-slot ad-banner ad-container "
    "comment comments comment-list comments-area comment-respond comment-form disqus replies reply respond".split()
)
#: Those that mark it outside of articles; inside, the induced template decides.
_NAMES = _FOREIGN | frozenset(
    "banner promo nav navbar navigation menu menubar main-nav site-nav main-menu nav-menu breadcrumb breadcrumbs "
    "sidebar side side-bar aside footer foot site-footer page-footer header site-header masthead topbar top-bar cookie cookies cookie-banner cookie-notice "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing share-buttons social social-links "
    "related related-posts recommended widget search search-form pagination pager toolbar contentinfo complementary skip skip-link copyright legal disclaimer".split()
)
#: Names of reader comments, as one word.
_COMMENTS = re.compile(r"(?:user|reader|post|blog|article|facebook|fb|disqus)?[-_]?comments?(?:[-_]?(?:list|section|area|form|thread|threads|box|wrap|wrapper|container|respond|block))?")
#: Parts of a name (between hyphens, underscores, or as such) that mark adverts wherever they stand ...
_ADVERT_PARTS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored disqus".split())
#: ... and what surrounds articles or breaks into them, unless the region holds much of the page's text.
_AROUND_PARTS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr notice notices popup modal newsletter subscribe "
    "subscription signup login share sharing social related recommended widget pagination pager promo banner".split()
)
_CONTAINERS = frozenset("div section ul ol dl table span iframe ins".split())
_PART = re.compile(r"[a-z0-9]+")
_GOOD_NAMES = frozenset("article main content post entry story body".split())
#: A good word beside one of these doesn't save the region.
_WORST = _FOREIGN | frozenset("cookie cookies sidebar footer nav navbar navigation".split())
#: What a form that is the page's layout holds, unlike a box of fields.
_STRUCTURE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol table section nav header footer".split())
# as HTML's tokenizer: a quoted value begins right after "=" only, any other quote is an ordinary character;
# a quote that nothing closes is ordinary too, so that the rest of the page stays
_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+"
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))"
_NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_TOKEN = re.compile(
    rf"{_COMMENT}|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)"
    rf"((?:[ \t\n\f\r/]++|{_NAME}(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:{_VALUE}|(?=>)))?+)*+)>",
    re.DOTALL,
)
#: A tag where quotes mean nothing.
_PLAIN = re.compile(rf"{_COMMENT}|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.DOTALL)
_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_ATTRIBUTE = re.compile(rf"({_NAME})(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+({_VALUE}))?+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WHITE = re.compile(r"[ \t\n\f\r]+")
#: What an opening tag closes: a paragraph ends where a block begins, a list item at the next.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset(("ul", "ol", "dl", "table", "select", "body", "html", "div", "article", "section", "main"))


class Node:
    """An element; ``parts`` holds child nodes and texts in page order."""

    __slots__ = ("tag", "parts", "attributes", "holds", "size")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.parts, self.attributes = tag, [], attributes
        #: whether an article or main element stands inside
        self.holds = False
        #: characters of text inside
        self.size = 0

    def said(self) -> dict[str, str]:
        return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(self.attributes)} if self.attributes else {}


class _Open:
    """The open elements, with the places of each tag and of those that end an implied close."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in _SCOPE:
            self.scopes.append(at)

    def close(self, at: int) -> None:
        """Closes the element at a place and all within it."""
        for node in self.stack[at:]:
            self.places[node.tag].pop()
            if node.tag in _SCOPE:
                self.scopes.pop()
        del self.stack[at:]

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def imply(self, *tags: str) -> None:
        """Closes the last of the tags, unless a scope has begun since."""
        at = self.last(*tags)
        if at > (self.scopes[-1] if self.scopes else 0):
            self.close(at)


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are put right as browsers mostly do.

    Takes time linear in the page's length, whatever it holds: where a tag would only end inside of
    a quoted value that runs on to the page's end, quotes mean nothing from there on.
    """
    root = Node("#root")
    opened = _Open(root)
    at, end, last = 0, len(page), page.rfind(">")
    token = _TOKEN
    while at < end:
        start = _START.search(page, at)
        begin = start.start() if start else end
        m = None
        while start and begin <= last or (start and page.startswith("<!--", begin)):
            m = token.match(page, begin)
            if m is None and token is _TOKEN and page[begin + 1] not in "!?":
                token = _PLAIN
                continue
            break
        if m is None:
            opened.stack[-1].parts.append(page[at:])
            break
        if begin > at:
            opened.stack[-1].parts.append(page[at:begin])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            place = opened.last(tag)
            if place:
                opened.close(place)
            continue
        if tag in BLOCK:
            opened.imply("p")
        if tag in _CLOSES:
            opened.imply(*_CLOSES[tag])
        node = Node(tag, m[3].rstrip("/"))
        opened.stack[-1].parts.append(node)
        if tag in ("article", "main"):
            for above in reversed(opened.stack):
                if above.holds:
                    break
                above.holds = True
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            stop = close.start() if close else end
            node.parts.append(page[at:stop])
            at = page.find(">", stop) + 1 if close else end
            at = at or end
        elif tag not in VOID and not (tag in ("svg", "math") and m[3].endswith("/")):
            opened.push(node)
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Sets the size of every node: its own text and that of what it holds, but for scripts and such."""
    order = [root]
    for node in order:
        order.extend(p for p in node.parts if not isinstance(p, str))
    for node in reversed(order):
        node.size = 0 if node.tag in RAW else sum(len(p.strip()) if isinstance(p, str) else p.size for p in node.parts)


def _layout_forms(root: Node) -> set[int]:
    """The ids of forms that are the page's layout: of structure, with over half of the page's text."""
    size: dict[int, tuple[int, bool]] = {}
    forms, todo = [], [(root, False)]
    while todo:
        node, done = todo.pop()
        below = [p for p in node.parts if not isinstance(p, str) and (p.tag not in DROP or p.tag == "form")]
        if not done:
            todo.append((node, True))
            todo.extend((p, False) for p in below)
            continue
        n = sum(len(p.strip()) for p in node.parts if isinstance(p, str)) + sum(size[id(p)][0] for p in below)
        built = any(not isinstance(p, str) and p.tag in _STRUCTURE for p in node.parts) or any(size[id(p)][1] for p in below)
        size[id(node)] = n, built
        if node.tag == "form" and built:
            forms.append(id(node))
    return {f for f in forms if 2 * size[f][0] > size[id(root)][0]}


def _no_content(node: Node, in_article: bool, layout: Callable[[], set[int]] = set, whole: int = 0, comments: bool = False) -> bool:
    """Whether a node is left out with all below it.

    ``layout`` gives the forms that are the page's layout, ``whole`` is the page's size; with
    ``comments`` regions of reader comments stay.
    """
    if node.tag == "form":
        if not node.holds and id(node) not in layout():
            return True
    elif node.tag in DROP or (node.tag == "header" and not in_article and not node.holds):
        return True
    if not node.attributes or node.tag in ("html", "body"):
        return False
    said = node.said()
    if "hidden" in said or said.get("aria-hidden") == "true" or _HIDDEN.search(said.get("style", "")):
        return True
    names = {w for k in ("class", "id", "role") for w in said.get(k, "").lower().split()}
    if any("comment" in w and _COMMENTS.fullmatch(w) for w in names):
        return not comments
    parts = {p for w in names for p in _PART.findall(w)}
    little = 4 * node.size <= whole and not node.holds and parts.isdisjoint(_GOOD_NAMES)
    if little and node.tag in _CONTAINERS and not (parts.isdisjoint(_ADVERT_PARTS) and parts.isdisjoint(_AROUND_PARTS)):
        return True
    if in_article:  # comments may be articles within the article
        return not comments and not names.isdisjoint(_FOREIGN)
    if node.holds or node.tag == "form":
        return False
    if names.isdisjoint(_NAMES) or node.tag in ("article", "main") or said.get("role") in ("main", "article"):
        return False
    return names.isdisjoint(_GOOD_NAMES) or not names.isdisjoint(_WORST)


#: A folded tree: each place's place above it, in page order; the root is 0.
Tree = dict[int, int]


class Block:
    """A text block: the digest of its place in the folded tree, its text, whether it stands in an
    article or main element, and whether in a region that is named as content."""

    __slots__ = ("path", "text", "within", "good")

    def __init__(self, path: int, text: str, within: bool, good: bool):
        self.path, self.text, self.within, self.good = path, text, within, good


def blocks(root: Node) -> list[Block]:
    """Blocks outside of no-content regions, in page order, with their places in the folded tree.

    A place is the digest of the tags from the root down, of any depth. Regions named as reader
    comments stay only where nothing else would: there the name is that of the page's layout.
    """
    return folded(root)[0]


def folded(root: Node) -> tuple[list[Block], Tree]:
    """The blocks (see :func:`blocks`), and the folded tree: each place with the place above it, in page order."""
    every: Tree = {}
    out = _blocks(root, False, every)
    if not out:
        every.clear()
        out = _blocks(root, True, every)
    holding = {0}  # places with text in or below them
    for b in out:
        p = b.path
        while p not in holding:
            holding.add(p)
            p = every[p]
    return out, {p: above for p, above in every.items() if p in holding}


def _blocks(root: Node, comments: bool, tree: Tree) -> list[Block]:
    out: list[Block] = []
    pending: list[str] = []
    state = (0, False, False)
    layout = lru_cache(maxsize=1)(lambda: _layout_forms(root))

    def flush() -> None:
        text = _WHITE.sub(" ", html.unescape("".join(pending))).strip()
        pending.clear()
        if text:
            path, within, good = state
            out.append(Block(path, " ".join(text.split()), within, good))

    # an explicit stack: deep nesting must not overflow
    todo: list[tuple] = [("open", root, (0, False, False))]
    while todo:
        what, node, where = todo.pop()
        if what == "text":
            if not pending:
                state = where
            pending.append(node)
            continue
        if what == "break":
            flush()
            continue
        path, within, good = where
        if _no_content(node, within, layout, root.size, comments):
            if node.tag in BLOCK:
                flush()
            continue
        if node.tag == "br":
            pending.append(" ")
            continue
        if node.tag in BLOCK:
            flush()
            above, path = path, crc32(b"/" + node.tag.encode(), path)
            tree.setdefault(path, above)
            todo.append(("break", node, where))
        within = within or node.tag in ("article", "main")
        good = good or (bool(node.attributes) and not _GOOD_NAMES.isdisjoint(w for k in ("class", "id") for w in node.said().get(k, "").lower().split()))
        todo.extend(("text" if isinstance(part, str) else "open", part, (path, within, good)) for part in reversed(node.parts))
    flush()
    return out


def _children(tree: Tree) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for place, above in tree.items():
        out.setdefault(above, []).append(place)
    return out


def _heaviest(order: list[int], rank: dict[int, int], weight: dict[int, int]) -> list[int]:
    """Of nodes in one order the heaviest part that stands in the other order too."""
    best: list[tuple[int, int]] = []  # weight of the best part that ends here, and its node before
    for i, p in enumerate(order):
        before = max(((best[j][0], j) for j in range(i) if rank[order[j]] < rank[p]), default=(0, -1))
        best.append((before[0] + weight[p], before[1]))
    at = max(range(len(best)), key=lambda i: best[i][0], default=-1)
    out = []
    while at >= 0:
        out.append(order[at])
        at = best[at][1]
    return out[::-1]


def align(a: Tree, b: Tree) -> set[int]:
    """The places that simple tree matching matches in two folded trees.

    As children differ by tag, a node can only be matched to that of its own place, and a node's
    matched children are the heaviest part of those it has in both trees that keeps their order; the
    number of block tags bounds them (ties: those that come first in ``a``). Takes time in the number of
    common places, at any depth.
    """
    in_a, in_b = _children(a), _children(b)
    order = [0]
    for p in order:
        order.extend(c for c in in_a.get(p, ()) if b.get(c) == p)
    common, weight, chosen = set(order), {}, {}
    for p in reversed(order):
        rank = {c: i for i, c in enumerate(in_b.get(p, ()))}
        chosen[p] = _heaviest([c for c in in_a.get(p, ()) if c in common], rank, weight)
        weight[p] = 1 + sum(weight[c] for c in chosen[p])
    matched = [0]
    for p in matched:
        matched.extend(chosen[p])
    return set(matched)


def _ordered(children: Iterable[int], ahead: dict[tuple[int, int], int]) -> list[int]:
    """The children of one place in the host's order, by the weight of the trees where one precedes another.

    Of two children the one that comes first in trees of more weight precedes. The next child is the one
    with the fewest that should precede it left (ties: the smaller place), so orders that don't contradict
    each other all hold.
    """
    left = sorted(children)
    waits = {c: sum(ahead.get((d, c), 0) > ahead.get((c, d), 0) for d in left) for c in left}
    out = []
    while left:
        c = min(left, key=waits.__getitem__)
        left.remove(c)
        out.append(c)
        for d in left:
            waits[d] -= ahead.get((c, d), 0) > ahead.get((d, c), 0)
    return out


def merge(trees: list[tuple[Tree, int]]) -> Tree:
    """One tree of all places of several weighed ones; children stand as most trees have them (see
    :func:`_ordered`). :func:`extract` makes the same orders by Spark, for hosts of any number of trees."""
    above: Tree = {}
    ahead: dict[tuple[int, int], int] = {}
    for tree, weight in trees:
        for p, children in _children(tree).items():
            for i, c in enumerate(children):
                above.setdefault(c, p)
                for d in children[i + 1 :]:
                    ahead[c, d] = ahead.get((c, d), 0) + weight
    below = {p: _ordered(children, ahead) for p, children in _children(above).items()}
    out: Tree = {}
    todo = [0]
    while todo:
        p = todo.pop()
        if p:
            out[p] = above[p]
        todo.extend(reversed(below.get(p, ())))
    return out


def _packed(tree: Tree) -> list[int]:
    return [(p << 32 | above) - (1 << 63) for p, above in tree.items()]


def _unpacked(numbers: list[int] | None) -> Tree:
    return {(x + (1 << 63)) >> 32: (x + (1 << 63)) & 0xFFFFFFFF for x in numbers or ()}


def node_keys(keys: list[int], tree: Tree, moved: dict[int, list[int]], form: int) -> list[int]:
    """Keys of texts with the node in place of the page's place: the host tree's where the page's tree is
    aligned to it, else one that pages of the same tree (``form``) share. ``moved`` has the places whose
    children the host's tree orders otherwise, with that order."""
    if not moved:
        return keys
    matched = align(tree, {c: p for p, children in (_children(tree) | moved).items() for c in children})
    own = lambda k: int.from_bytes(blake2b(b"%d:%d" % (form, k), digest_size=8).digest(), "little", signed=True)
    return [k if (k + (1 << 63)) >> 32 in matched else own(k) for k in keys]


class Shape:
    """A folded tree: one node per distinct path step under a parent, with the texts that stand there."""

    __slots__ = ("tag", "children", "texts", "index")

    def __init__(self, tag: str):
        self.tag, self.children, self.texts, self.index = tag, [], set(), -1


def simple_tree_matching(a: Shape, b: Shape) -> list[tuple[Shape, Shape]]:
    """Pairs of nodes of the largest order- and ancestor-preserving match of two folded trees."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def match(x: Shape, y: Shape) -> int:
        if x.tag != y.tag:
            return 0
        key = (x.index, y.index)
        if key in memo:
            return memo[key][0]
        m, n = len(x.children), len(y.children)
        table = [[0] * (n + 1) for _ in range(m + 1)]
        weights = [[match(p, q) for q in y.children] for p in x.children]
        for i in range(1, m + 1):
            for j in range(1, n + 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + weights[i - 1][j - 1])
        chosen, i, j = [], m, n
        while i and j:
            if weights[i - 1][j - 1] and table[i][j] == table[i - 1][j - 1] + weights[i - 1][j - 1]:
                chosen.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
        memo[key] = (1 + table[m][n], chosen)
        return memo[key][0]

    match(a, b)
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo.extend(memo.get((x.index, y.index), (0, []))[1])
    return out


def _digest(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass"))


def _key(node: int, text: str) -> int:
    """A node and a text, 32 bits each, as a signed number."""
    return (node << 32 | _digest(text)) - (1 << 63)


def content(found: list[Block]) -> list[Block]:
    """The blocks of a page's articles, or of all regions if it has none.

    Where regions named as content hold more text outside of articles than all articles (a teaser
    beside the story), both are content.
    """
    if not any(b.within for b in found):
        return found
    own = sum(len(b.text) for b in found if b.within)
    beside = sum(len(b.text) for b in found if b.good and not b.within)
    return [b for b in found if b.within or (b.good and beside > own)]


def placed(found: list[Block]) -> tuple[int, dict[int, int]]:
    """The tag structure's digest, and the length of each text by its key."""
    return _digest(" ".join(map(str, sorted({b.path for b in found})))), {_key(b.path, b.text): len(b.text) for b in found}


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The page's content, without the texts that ``template`` names at their places."""
    found = blocks(parse(page))
    if template:
        found = [b for b in found if _key(b.path, b.text) not in template]
    return " ".join(b.text for b in content(found))


def extract(
    pages: DataFrame, html_column: str = "html", url: str = "url", share: float = 0.5, least: int = 5
) -> DataFrame:
    """Rows of ``pages`` without the html, with ``text``: the main text, empty if there is none.

    A text is template on a host if pages that weigh ``least`` and a ``share`` of the host's pages,
    or of its pages of one tag structure, hold it at one node; copies and near copies weigh once (see
    the module's text). Null or empty html, and pages of a null url or of a host with fewer pages,
    are extracted without a template; other columns, nulls and repeated rows pass unchanged,
    whatever their names, and a column named ``text`` is replaced; an empty table gives no rows. Whole
    pages are read, in time linear in their length. All trees of a host make its tree. Digests and lengths of
    texts are shuffled, and the pages themselves only if those that lose a text are too many to be broadcast
    with the digests of what they lose.
    """
    tables = Scratch(pages.sparkSession)
    carry = [c for c in pages.columns if c not in (html_column, "text")]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(quoted(url)), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    whole = F.coalesce(F.col(quoted(html_column)).cast("string"), F.lit(""))
    rows = pages.select(F.struct(*(F.col(quoted(c)) for c in carry)).alias("row"), host.alias("host"), F.unhex(F.md5(whole)).alias("digest"), whole.alias("html"))

    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [folded(parse(p)) for p in batch.column(2).to_pylist()]
            found = [placed(b) for b, _ in trees]
            keys = [sorted(size) for _, size in found]
            columns = [*batch.columns[:2], pa.array([g for g, _ in found], pa.int64()), pa.array(keys, longs)]
            columns += [pa.array([[size[k] for k in ks] for (_, size), ks in zip(found, keys, strict=True)], ints), pa.array([_packed(t) for _, t in trees], longs)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "digest", "shape", "keys", "sizes", "tree"])

    def siblings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, form, n, trees = (c.to_pylist() for c in batch.columns)
            out = [(h, f, k, p, cs) for h, f, k, t in zip(host, form, n, trees, strict=True) for p, cs in _children(_unpacked(t)).items() if len(cs) > 1]
            columns = zip((pa.string(), pa.int64(), pa.int64(), pa.int64(), longs), zip(*out, strict=True) if out else [()] * 5, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in columns], names=["host", "form", "n", "above", "children"])

    def disputed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = []
            for pairs in batch.column(2).to_pylist():
                ahead = {(x["first"], x["second"]): x["n"] for x in pairs}
                order = _ordered({c for pair in ahead for c in pair}, ahead)
                at = {c: i for i, c in enumerate(order)}
                orders.append(order if any(at[c] > at[d] for c, d in ahead) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(orders, longs)], names=["host", "above", "order"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, form, tree, moved = (c.to_pylist() for c in batch.columns[3:5] + batch.columns[6:])
            moved = [{x["above"]: x["ordered"] for x in m or ()} for m in moved]
            nodes = [node_keys(k, _unpacked(t) if m else {}, m, f) for k, f, t, m in zip(keys, form, tree, moved, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), pa.array(nodes, longs)], names=["host", "page", "shape", "keys", "sizes", "nodes"])

    filled = rows.where((F.col("host") != "") & (F.col("html") != "")).select("host", "digest", "html")
    read = filled.mapInArrow(shape, "host string, digest binary, shape long, keys array<long>, sizes array<int>, tree array<long>")
    # pages of the same texts at the same places are one page; empty ones say nothing
    read = tables.write(read.where(F.size("keys") > 0).withColumn("page", F.xxhash64("keys", "tree")), "read")
    places = tables.write(read.drop("digest").dropDuplicates(["host", "page"]).withColumn("form", F.xxhash64("tree")), "places")
    # a host's order of children, at places where trees differ; kept if one of them contradicts it
    counted = places.groupBy("host", "form", "tree").agg(F.count("*").alias("n")).select("host", "form", "n", "tree")
    lists = tables.write(counted.mapInArrow(siblings, "host string, form long, n long, above long, children array<long>"), "siblings")
    child = F.xxhash64("children")
    varied = lists.groupBy("host", "above").agg(F.min(child).alias("least"), F.max(child).alias("most")).where("least != most")
    orders = lists.join(varied, ["host", "above"], "left_semi").groupBy("host", "above", "children").agg(F.sum("n").alias("n"))
    pairs = F.expr("inline(flatten(transform(children, (c, i) -> transform(slice(children, i + 2, size(children)), d -> struct(c AS first, d AS second)))))")
    orders = orders.select("host", "above", "n", pairs).groupBy("host", "above", "first", "second").agg(F.sum("n").alias("n"))
    orders = orders.groupBy("host", "above").agg(F.collect_list(F.struct("first", "second", "n")).alias("pairs"))
    orders = orders.mapInArrow(disputed, "host string, above long, order array<long>").where(F.col("order").isNotNull())
    moved = lists.join(orders, ["host", "above"]).withColumn("ordered", F.array_intersect("order", "children")).where("ordered != children")
    moved = moved.groupBy("host", "form").agg(F.collect_list(F.struct("above", "ordered")).alias("moved"))
    # written, so that the pages aren't shuffled by tree if few or no trees contradict their host's
    moved = tables.write(moved, "moved", instead_of=(lists,))
    shapes = places.join(moved, ["host", "form"], "left").select("host", "page", "shape", "keys", "form", "sizes", "tree", "moved")
    shapes = shapes.mapInArrow(aligned, "host string, page long, shape long, keys array<long>, sizes array<int>, nodes array<long>")
    placed_at = tables.write(shapes, "nodes", instead_of=(places, moved))
    shapes = tables.write(placed_at.withColumn("page", F.xxhash64("nodes")).dropDuplicates(["host", "page"]), "shapes")
    enough = shapes.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    texts = shapes.select("host", "shape", "page", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("nodes").alias("node"), F.col("sizes").alias("size"))))
    held = texts.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1").join(enough, "host")
    held = tables.write(held.select("host", "key", F.when(F.col("n") < NEARLY_ALL * F.col("pages"), F.col("n")).otherwise(0).alias("n")), "held")
    # 0 pages: nearly all of them, which says nothing of copies
    texts = texts.join(held, ["host", "key"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    copies = F.percentile(F.when(F.col("n") > 0, F.col("n")), F.lit(0.5), F.col("size"))
    weighed = texts.groupBy("host", "shape", "page").agg(F.coalesce(copies, F.lit(1.0)).alias("copies"), F.collect_list(F.when(F.col("n") != 1, F.col("node"))).alias("nodes"))
    weighed = tables.write(weighed.select("host", "shape", (1 / F.col("copies")).alias("w"), "nodes"), "weights", instead_of=(shapes, held))

    def constant(votes: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
        total = totals.groupBy(*by).agg(F.round(F.sum("w"), 6).alias("total")).where(F.col("total") >= least)
        voted = votes.groupBy(*by, "node").agg(F.round(F.sum("w"), 6).alias("n")).where(F.col("n") >= least).join(total, by)
        return voted.where(F.col("n") >= share * F.col("total")).select("host", "node")

    totals = weighed.groupBy("host", "shape").agg(F.sum("w").alias("w"))
    votes = tables.write(weighed.select("host", "shape", "w", F.explode("nodes").alias("node")).groupBy("host", "shape", "node").agg(F.sum("w").alias("w")), "votes")
    template = constant(votes, totals, ["host"]).union(constant(votes, totals, ["host", "shape"])).distinct()
    lost = placed_at.select("host", "page", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("nodes").alias("node")))).join(template, ["host", "node"])
    lost = lost.groupBy("host", "page").agg(F.collect_list("key").alias("lost"))
    lost = read.select("host", "digest", "page").distinct().join(lost, ["host", "page"]).drop("page")
    lost = tables.write(lost, "lost", instead_of=(read, placed_at, weighed, votes))

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, lost = (batch.column(len(carry) + i).to_pylist() for i in range(2))
            out = [main_text(p, frozenset(t or ())) for p, t in zip(page, lost, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(out, pa.string())], names=[*carry, "text"])

    # by position, as columns of any name may be carried
    joined = rows.join(lost, ["host", "digest"], "left").select(*(F.col("row").getField(c).alias(str(i)) for i, c in enumerate(carry)), "html", "lost")
    return map_batches(joined, text, StructType([*pages.select(*(F.col(quoted(c)) for c in carry)).schema.fields, StructField("text", StringType())]))
