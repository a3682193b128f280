"""Main text of web pages by minimum-cut labelling of their blocks and elements.

A page is cut into text blocks.  A classifier over a block's text and surroundings, learnt from pages that mark
their article, gives its cost of being called content or boilerplate, the terminal capacity of its node; it
sees no names of elements or classes.  Elements are nodes as well, and what their names say is a capacity of
theirs alone.  Smoothness edges tie each node to the element round it and blocks to their neighbours,
so that a name reaches a text through the cut, and weighs as much as the blocks let it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Element names by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("button canvas datalist dialog form head iframe input map noscript object option select svg template textarea".split())
RAW_TAGS = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
BOILER_TAGS = frozenset("aside footer header menu nav".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies discussion disqus dropdown footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond responses share sharing shoutbox side sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: Words of names that tell of layout only.
LAYOUT_WORDS = frozenset("area articles bar block bottom box col column container element group inner item items left links list main panel posts right row section top wrap wrapper".split())
#: A block's own capacity, and what its family adds to an element for it, end at SURE either way.  An element's capacities
#: for each block in it: an article's, a name like "content", an element or name that is boilerplate, a name that is
#: partly so, and what lies round an article.
SURE, ARTICLE, CONTENT_NAME, BOILER, PARTLY, AROUND = 2.2, 12.0, 2.5, -14.0, -1.5, -9.0
#: Edges to the element round a node: for each of its blocks, inside an article or a menu or amid paragraphs; elsewhere of a block, and of
#: an element for the root of its blocks' number.  Edges between neighbouring blocks, from a heading to what follows it, the
#: part of both left across an article's or a menu's border, and the steps in the DOM from which blocks aren't tied.
FIRM, KIN, LOOSE, NEXT_TO, HEADED, ACROSS, FAR = 6.5, 2.6, 1.6, 0.7, 2.0, 0.25, 7
#: Characters inside article or main elements from which a page counts as marking its content.
MARKED_CHARS = 80
#: Pages that the classifier is fitted on, at most about; features are multiples of 1 / GRID, so that their sums are exact.
FIT_PAGES, GRID = 4_000, 64
#: The part of the features' covariances that the classifier leaves out.
SHRINK = 0.5

# A quoted value ends at a quote before white space or the tag's end; a tag with a quote that never closes so ends at its first >.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:(?P<most>(?:\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[^>\"'])*)(?:>|\Z)|(?P<rest>[^>]*)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SENTENCE = re.compile(r"[.!?:;,…。](?:\s|$)")


class Element:
    """An open element: its name, parent and depth, its own capacity a block, and what its blocks inherit."""

    __slots__ = ("name", "parent", "depth", "hint", "content", "boiler", "barred", "dropped", "link")

    def __init__(self, name: str, parent: Element | None, hint: float, content: Element | None, boiler: Element | None, barred: bool, dropped: bool, link: bool):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        self.hint, self.barred, self.dropped, self.link = hint, barred, dropped, link
        #: The innermost article and the innermost boilerplate that hold the element, itself included.
        self.content, self.boiler = (self if hint == ARTICLE else content), (self if hint == BOILER else boiler)


def steps_between(a: Element, b: Element) -> int:
    """Steps from one element up and down to another, FAR if they are that many or more."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


class Block:
    """A block of text with its element, whether it is a heading, and the share of linked text."""

    __slots__ = ("text", "owner", "link_share", "heading")

    def __init__(self, text: str, owner: Element, link_share: float, heading: bool):
        self.text, self.owner, self.link_share, self.heading = text, owner, link_share, heading


def boiler_share(label: str) -> float:
    """The share of a class's or id's words, layout words aside, that name boilerplate; an entry's or article's header is its title."""
    if label.replace("-", "").replace("_", "").lower() in BOILER_WORDS:
        return 1.0
    words = [w.lower() for w in _WORDS.findall(label)]
    telling = [w for w in words if w not in LAYOUT_WORDS]
    hits = [w for w in telling if w in BOILER_WORDS]
    if set(hits) == {"header"} and CONTENT_WORDS.intersection(words):
        return 0.0
    return len(hits) / len(telling) if hits else 0.0


def opened(name: str, attributes: str, parent: Element) -> Element:
    """The element of a start tag below parent."""
    article, boiler, named, partly, dropped = name in CONTENT_TAGS, name in BOILER_TAGS, False, False, parent.dropped or name in DROPPED_TAGS
    if attributes.strip():
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        role = found.get("role", "").lower()
        labels = (found.get("class", "") + " " + found.get("id", "")).split()
        if name not in ("html", "body"):
            share = max(map(boiler_share, labels), default=0.0)
            boiler, partly = boiler or role in BOILER_ROLES or share == 1, share > 0
        named = bool({w.lower() for w in _WORDS.findall(" ".join(labels))} & CONTENT_WORDS) or found.get("itemprop", "").lower() == "articlebody"
        article = article or role in ("main", "article")
        style = found.get("style", "").replace(" ", "").lower()
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            dropped = True
    barred = parent.barred or boiler
    # An article in a menu or among comments is none of the page's own.
    hint = BOILER if boiler else ARTICLE if article and not barred else PARTLY if partly else CONTENT_NAME if named else 0.0
    return Element(name, parent, hint, parent.content, parent.boiler, barred, dropped, parent.link or name == "a")


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, outside of dropped elements."""
    root = Element("", None, 0.0, None, None, False, False, False)
    stack, blocks = [root], []
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                owner = next(e for e in reversed(stack) if e.name in BLOCK_TAGS or e is root)
                heading = any(e.name in ("h1", "h2", "h3", "h4", "h5", "h6") for e in stack[-4:])
                blocks.append(Block(text, owner, linked / len(text), heading))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        top = stack[-1]
        if text and not top.dropped:
            text = html.unescape(text)
            parts.append(text)
            if top.link:
                linked += len(text.strip())

    def close_from(k: int) -> None:
        open_names.subtract(e.name for e in stack[k:])
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        name, attributes = m["name"].lower(), m["most"] if m["most"] is not None else m["rest"]
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0) if open_names[name] else 0
            if name in BLOCK_TAGS:
                close_block()
                if k:
                    close_from(k)
            elif k and not any(e.name in BLOCK_TAGS for e in stack[k + 1 :]):
                close_from(k)
            continue
        if name in BLOCK_TAGS:
            close_block()
            if name != "head" and open_names["head"]:
                close_from(next(k for k, e in enumerate(stack) if e.name == "head"))
            # A paragraph ends where a block begins; items and cells end at the next of their kind.
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p" or stack[k].name in closes:
                    close_from(k)
                    break
                if stack[k].name in BLOCK_TAGS:
                    break
        elif name == "br":
            parts.append(" ")
        if name in RAW_TAGS:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID_TAGS or attributes.rstrip().endswith("/") and name not in BLOCK_TAGS:
            continue
        stack.append(opened(name, attributes, stack[-1]))
        open_names[name] += 1
    close_block()
    return blocks


#: What features() gives: of a block itself, then of its family.
FEATURES, OWN = ["size", "linked", "sentences", "family", "family_share", "family_linked"], 3
#: Weights of FEATURES, and constants of both parts, where no page marks its article: long texts without links in large families.
UNFITTED = (0.9, -3.5, 0.8, 0.8, 3.0, -3.5, -2.2, -1.6)


def families(blocks: list[Block]) -> tuple[list[Element], set[int]]:
    """(the element that holds each block's family, the elements amid another's blocks, by id).

    A block's family are the blocks of one parent.  An element between blocks that its own parent holds, as a list between
    paragraphs, has no family of its own: its blocks are of its parent's.
    """
    home = [b.owner.parent or b.owner for b in blocks]
    low, high = {}, {}
    for k, e in enumerate(home):
        low.setdefault(id(e), k)
        high[id(e)] = k
    amid = set()
    for e in {id(e): e for e in home}.values():
        outer, a, b = e.parent, low[id(e)] - 1, high[id(e)] + 1
        if outer and outer.name not in ("", "html", "body") and a >= 0 and b < len(blocks) and all(outer in (blocks[k].owner, blocks[k].owner.parent) for k in (a, b)):
            amid.add(id(e))
    for k, e in enumerate(home):
        while id(e) in amid:
            e = e.parent
        home[k] = e
    return home, amid


def features(blocks: list[Block]) -> np.ndarray:
    """Whole numbers, in 1 / GRID: of each block its size, links and sentences, and the number, share of the page and links of its family."""
    if not blocks:
        return np.zeros((0, len(FEATURES)), np.int64)
    chars = np.array([len(b.text) for b in blocks], np.float64)
    linked = np.minimum([b.link_share for b in blocks], 1.0)
    size = np.log1p(chars / 8)
    sentences = np.array([min(len(_SENTENCE.findall(b.text)), 4) for b in blocks]) / 2
    family = np.unique([id(e) for e in families(blocks)[0]], return_inverse=True)[1]
    members, share, links = np.bincount(family)[family], np.bincount(family, chars)[family] / chars.sum(), np.bincount(family, chars * linked)[family] / np.bincount(family, chars)[family]
    x = np.stack([size, linked, sentences, np.log1p(np.minimum(members, 1000)), share, links], 1)
    return np.rint(x * GRID).astype(np.int64)


def marks(blocks: list[Block]) -> bool:
    """Whether the page of the blocks marks its content by an article."""
    return sum(len(b.text) for b in blocks if b.owner.content and not bars(b)) >= MARKED_CHARS


def bars(block: Block) -> bool:
    """Whether a block lies in boilerplate that isn't round its article; a heading in an article's own header is the article's."""
    own = block.owner
    inner = own.boiler and not (own.content and own.content.depth > own.boiler.depth)
    return bool(inner) and not (block.heading and own.content and own.name in ("h1", "h2", "header", "hgroup"))


def leanings(blocks: list[Block], weights: tuple[float, ...]) -> tuple[list[float], list[float]]:
    """The classifier: log odds of being content that each block has of itself, and those its family gives it; SURE at most either way."""
    x, w = features(blocks) / GRID, np.array(weights)
    own, kin = x[:, :OWN] @ w[:OWN] + w[-2], x[:, OWN:] @ w[OWN:-2] + w[-1]
    return np.clip(own, -SURE, SURE).tolist(), np.clip(kin, -SURE, SURE).tolist()


def examples(page: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of a page that marks its article; of no block of another.

    The page counts four times: as it is, without what lies round the article, and both with but the
    article's longest block, so that pages with little text are known as well.
    """
    blocks = blocks_of(page) if page else []
    if not marks(blocks):
        return features([]), np.zeros(0, bool)
    content = {id(b) for b in blocks if b.owner.content and not bars(b)}
    longest = max((b for b in blocks if id(b) in content), key=lambda b: len(b.text))
    views = [blocks, [b for b in blocks if id(b) in content], [b for b in blocks if b is longest or id(b) not in content], [longest]]
    return np.concatenate([features(v) for v in views]), np.array([id(b) in content for v in views for b in v], bool)


def fitted(pages: DataFrame, most: int = FIT_PAGES) -> tuple[float, ...]:
    """The classifier's weights, a linear discriminant, from about most pages at most, those of the least hashes of (page_id, url, html).

    Tasks give sums of features and of their products by label, whole numbers, so weights don't depend on how pages are
    dealt.  Without a marked page, or with one label alone, UNFITTED.  The choice reads pages once more.
    """
    total = pages.count()
    limit = (1 << 63) - 1 if total <= most else int(-(1 << 63) + (1 << 64) * (most / total))
    width = len(FEATURES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width, width), np.int64)
        for batch in batches:
            for page in batch.column(0).to_pylist():
                x, y = examples(page)
                x = np.c_[x, np.ones(len(x), np.int64)]
                for k in (0, 1):
                    sums[k] += x[y == k].T @ x[y == k]
        yield pa.RecordBatch.from_arrays([pa.array(range(sums.size), pa.int32()), pa.array(sums.reshape(-1))], ["place", "n"])

    chosen = pages.where(F.xxhash64("page_id", "url", "html") <= limit).select("html")
    parts = small_batches(chosen).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(2 * width * width)
    for place, n in parts:
        sums[place] = n
    return discriminant(sums.reshape(2, width, width))


def discriminant(sums: np.ndarray) -> tuple[float, ...]:
    """Weights from sums of products by label, the last row of which are sums of features and the number of rows."""
    count = sums[:, -1, -1]
    if min(count) == 0:
        return UNFITTED
    mean = sums[:, -1, :-1] / count[:, None] / GRID
    spread = sum(sums[k, :-1, :-1] / GRID**2 - count[k] * np.outer(mean[k], mean[k]) for k in (0, 1)) / count.sum()
    w = np.linalg.solve((1 - SHRINK) * spread + SHRINK * np.diag(np.diag(spread)) + 0.03 * np.eye(len(spread)), mean[1] - mean[0])
    middle = -w * (mean[0] + mean[1]) / 2
    return (*w.round(6).tolist(), round(float(middle[:OWN].sum()), 6), round(float(middle[OWN:].sum()), 6))


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: leaving a node's leaning costs its size, parting an edge its weight.

    A node whose leaning outweighs all its edges keeps its side in some minimum cut, so it is
    folded into its neighbours' leanings first; what remains is solved by augmenting paths.
    """
    near: list[dict[int, float]] = [{} for _ in lean]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    lean = list(lean)
    label: list[bool | None] = [None] * len(lean)
    queue = deque(range(len(lean)))
    while queue:
        v = queue.popleft()
        if label[v] is None and abs(lean[v]) >= sum(near[v].values()):
            label[v] = lean[v] > 0
            for u, w in near[v].items():
                lean[u] += w if label[v] else -w
                del near[u][v]
                queue.append(u)
            near[v].clear()
    rest = [v for v, x in enumerate(label) if x is None]
    if rest:
        flow = {v: dict(near[v]) for v in rest}
        source = {v: max(lean[v], 0.0) for v in rest}
        sink = {v: max(-lean[v], 0.0) for v in rest}
        while True:
            came: dict[int, int] = {v: -1 for v in rest if source[v] > 1e-12}
            walk, goal = deque(came), -1
            while walk:
                v = walk.popleft()
                if sink[v] > 1e-12:
                    goal = v
                    break
                for u, w in flow[v].items():
                    if w > 1e-12 and u not in came:
                        came[u] = v
                        walk.append(u)
            if goal < 0:
                break
            path = [goal]
            while came[path[-1]] >= 0:
                path.append(came[path[-1]])
            path.reverse()
            least = min([source[path[0]], sink[goal], *(flow[a][b] for a, b in zip(path, path[1:]))])
            source[path[0]] -= least
            sink[goal] -= least
            for a, b in zip(path, path[1:]):
                flow[a][b] -= least
                flow[b][a] = flow[b].get(a, 0.0) + least
        for v in rest:
            label[v] = v in came
    return [bool(x) for x in label]


def labelled(page: str | None, weights: tuple[float, ...] = UNFITTED) -> tuple[list[Block], list[float], list[bool]]:
    """A page's blocks, how each leans by itself, and whether the cut calls it content.

    What a block's family says is a capacity of the family's element.
    """
    blocks = blocks_of(page) if page else []
    leans, kin = leanings(blocks, weights)
    if not blocks:
        return blocks, leans, []
    # The tree: each node's parent, blocks first, then elements; a heading in an article's header hangs on the article.
    parents, elements, node = [0] * len(blocks), [], {}
    for k, b in enumerate(blocks):
        at, child = b.owner.content if b.heading and b.owner.boiler and not bars(b) and b.owner.content else b.owner, k
        while at is not None:
            known = id(at) in node
            if not known:
                node[id(at)] = len(parents)
                parents.append(-1)
                elements.append(at)
            parents[child] = node[id(at)]
            if known:
                break
            child, at = node[id(at)], at.parent
    first = len(blocks)
    size, children = [1] * first + [0] * len(elements), Counter(p for p in parents if p >= 0)
    order = sorted(range(first, len(parents)), key=lambda v: -elements[v - first].depth)
    for v in [*range(first), *order]:
        if parents[v] >= 0:
            size[parents[v]] += size[v]
    marked = marks(blocks)
    place = lambda v: blocks[v].owner if v < first else elements[v - first]

    def alike(v: int, up: int) -> bool:
        """Whether one article or menu holds both nodes; where an article is marked, what lies round it holds together too."""
        a, b = place(v), place(up)
        return a.content is b.content and a.boiler is b.boiler and (marked or a.content is not None or a.boiler is not None)

    home, amid = families(blocks)
    embedded = [False] * len(parents)
    for v in reversed(order):
        embedded[v] = id(elements[v - first]) in amid or parents[v] >= 0 and embedded[parents[v]]
    for v in range(first):
        embedded[v] = embedded[parents[v]]
    top = node[id(next(e for e in elements if e.parent is None))]
    lean = leans + [e.hint * size[first + k] for k, e in enumerate(elements)]
    for k, (e, x) in enumerate(zip(home, kin, strict=True)):
        lean[node.get(id(e), parents[k])] += x
    if marked:
        lean[top] += AROUND * size[top]
    edges = []
    for v in range(len(parents)):
        # An element of one node that says nothing is passed through.
        if v >= first and v != top and children[v] == 1 and not lean[v] or parents[v] < 0:
            continue
        up, firm = parents[v], alike(v, parents[v]) or embedded[v]
        while up != top and children[up] == 1 and not lean[up]:
            firm = firm and (alike(up, parents[up]) or embedded[up])
            up = parents[up]
        edges.append((v, up, FIRM * size[v] if firm else KIN if v < first else LOOSE * math.sqrt(size[v])))
    for k in range(1, first):
        a, b = blocks[k - 1], blocks[k]
        steps = steps_between(a.owner, b.owner)
        if steps < FAR:
            across = a.owner.content is not b.owner.content or a.owner.boiler is not b.owner.boiler
            near = NEXT_TO / max(steps - 1, 1) ** 2
            edges.append((k - 1, k, (HEADED if a.heading else near) * (ACROSS if across else 1.0)))
    return blocks, leans, minimum_cut(lean, edges)[:first]


def main_text(page: str | None, weights: tuple[float, ...] = UNFITTED) -> str:
    """The page's content blocks joined by line ends; empty for null, empty or textless pages."""
    blocks, _, kept = labelled(page, weights)
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages, from its whole html.

    Null and empty html give an empty text.  Repeated rows are extracted each; other columns are
    ignored; no rows give no rows.  A page is worked on alone, in memory of a few times its size.
    The classifier is fitted first (see fitted), on pages of the table that mark their article.
    """
    weights = fitted(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    types = dict(pages.dtypes)
    schema = f"page_id {types['page_id']}, url {types['url']}, text string"
    return small_batches(pages).select("page_id", "url", "html").mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
