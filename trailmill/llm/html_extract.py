"""Main-text extraction: boosted trees over DOM nodes, decoded so that ancestors and descendants agree.

A page is parsed to elements and text runs (``parse``). Every element gets features of its tag, its class, id and
role tokens, the density of text, links and markup in its subtree, its depth, and its place among its siblings.
Gradient-boosted trees (``Trees``, histogram splits, logistic loss) score each element as content or not; they are
fitted here on ``TRAINING_PAGES`` generated, labelled pages (``synthetic``), a fixed bound and the only sample.

Decoding is a dynamic program over the tree: an element is kept whole, dropped whole, or mixed, and only a mixed
one lets its children choose; so nothing is kept inside what was dropped, and the other way round.

What lies in an element that shows no text of its own (``DROPPED``, hidden) is dropped with it. A page without any
mark of structure (no class, id or role that hints at a part, no list, link, form, table or sectioning element) has
nothing to tell apart: all that it shows is its text. Where the trees would keep nothing of a page that shows something,
which short texts in bare surroundings bring about, its text is what lies in an article or main element, or else outside
of the parts that their tag or name sets apart, or else outside of those set apart by their tag.

Defined results: null, empty and text-free pages give an empty text, an empty table no rows; markup that never closes
is closed at the end; rows are independent, so repeated rows give repeated results; equal worth is kept whole before
it is dropped whole before it is mixed; every page is read whole, however long; columns other than ``keep`` and the
source are not read, so none but those can clash.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.sources.tables import table

ORACLE_SQL = None
TRAINING_PAGES = 250
SEED = 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# HTML's own categories.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object textarea select option button".split())
DROPPED = RAW | {"head", "title"}
UNPARSED = frozenset("script style textarea iframe noscript template xmp".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li tbody td tfoot th thead title tr".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody body html div article section main".split())
# Words of class, id and role that tell parts of a page.
HINTS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs crumbs toc pagination pager tabs toolbar skip sitemap categories topics",
    "edge": "header footer masthead banner bottom top copyright legal colophon branding logo contentinfo site foot head",
    "side": "sidebar aside rail widget related recommended complementary more popular trending latest also promo teaser side secondary left right",
    "ad": "ad ads advert advertisement adslot sponsor sponsored promotion dfp outbrain taboola commercial adv partner",
    "notice": "cookie cookies consent notice alert modal popup overlay gdpr newsletter subscribe signup paywall dialog toast message privacy warning info",
    "form": "form search login register contact input field captcha poll survey",
    "talk": "comment comments reply replies discussion disqus respond responses review reviews reader readers thread feedback guestbook talk",
    "share": "share social sharing follow twitter facebook tags tag author byline meta date rating print tools",
    "body": "article content main post entry story text body prose copy page blog article-body maincontent entrycontent paragraph lead intro",
}
_HINT_OF: dict[str, int] = {}
for _k, _words in enumerate(HINTS.values()):
    for _w in _words.split():
        _HINT_OF[_w] = _HINT_OF.get(_w, 0) | 1 << _k
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TAGS = ("nav", "header", "footer", "aside", "article", "main", "section", "div", "p", "ul", "ol", "li", "a", "form", "table", "td", "tr", "figure", "figcaption", "blockquote", "pre", "span", "b", "em", "dl", "dialog", "h1", "h2")
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
#: Elements that give a page structure.
STRUCTURE = frozenset("a nav header footer aside article main section form ul ol dl table dialog menu details fieldset input figure".split())
#: Elements that are no main text by their tag, and hints that are no text's.
APART = frozenset("nav header footer aside form dialog menu".split())
_TEXT_HINT = 1 << list(HINTS).index("body")
_INSIDE = {"a": 1, "li": 4} | dict.fromkeys(("p", "blockquote", "pre", *_HEADINGS), 2)
_FIELDS = frozenset("input textarea select button label form".split())


@dataclass
class Page:
    """Elements in page order with what they inherit, and text runs (element, text) in page order."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    kids: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)
    #: Bits: hints of the element, hints above it, and whether it is in a link (1), a paragraph (2), a list item (4).
    hint: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    sizes: list[tuple[int, int, int, int]] = field(default_factory=list)
    letters: int = 0
    #: Numbers of runs before which a block begins or ends.
    breaks: set[int] = field(default_factory=set)

    def say(self, node: int, text: str) -> None:
        self.runs.append((node, text))
        if n := len(text.strip()):
            self.sizes.append((node, n, text.strip().count(" ") + 1, text.count(".") + text.count(",") + text.count("?") + text.count("!")))
            self.letters += n

    def open(self, parent: int, tag: str, hint: int, hidden: bool) -> int:
        top = parent < 0
        self.parent.append(parent)
        self.tag.append(tag)
        self.depth.append(0 if top else self.depth[parent] + 1)
        self.place.append(0 if top else self.kids[parent])
        self.kids.append(0)
        self.before.append(self.letters)
        self.hint.append(hint)
        self.above.append(0 if top else self.above[parent] | self.hint[parent])
        self.inside.append((0 if top else self.inside[parent]) | _INSIDE.get(tag, 0))
        self.hidden.append(hidden or tag in DROPPED or (not top and self.hidden[parent]))
        if not top:
            self.kids[parent] += 1
        return len(self.parent) - 1


def _hints(attrs: str) -> tuple[int, bool]:
    found = 0
    hidden = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role", "data-component"):
            for w in _SPLIT.split(_CAMEL.sub(" ", value).lower()):
                found |= _HINT_OF.get(w, 0)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return found, hidden


def parse(source: str) -> Page:
    """Elements and text of a page; what should have been closed is closed as browsers do."""
    page = Page()
    stack = [page.open(-1, "html", 0, False)]
    at, end = 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            page.say(stack[-1], source[at:lt])
        if lt == end:
            break
        m = _TOKEN.match(source, lt)
        if not m:
            page.say(stack[-1], "<")
            at = lt + 1
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] == tag:
                    if any(page.tag[x] in BLOCK for x in stack[k:]):
                        page.breaks.add(len(page.runs))
                    del stack[k:]
                    break
        elif m[2]:
            tag = m[2].lower()
            if tag in BLOCK:
                page.breaks.add(len(page.runs))
            if tag not in IN_HEAD and len(stack) > 1 and page.tag[stack[1]] == "head":
                del stack[1:]
            if tag in ("html", "body") and any(page.tag[x] == tag for x in stack):
                continue
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[k]] == "p":
                        del stack[k:]
                        break
                    if page.tag[stack[k]] in BLOCK:
                        break
            elif tag in CLOSED_BY:
                for k in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[k]] in CLOSED_BY[tag]:
                        del stack[k:]
                        break
                    if page.tag[stack[k]] in SCOPES:
                        break
            hint, hidden = _hints(m[3]) if m[3] and not m[3].isspace() else (0, False)
            node = page.open(stack[-1], tag, hint, hidden)
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in UNPARSED and tag != "a":
                if tag in ("br", "hr", "img", "wbr"):
                    page.say(node, " ")
            elif tag in UNPARSED:
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                at = close.end() if close else end
            else:
                stack.append(node)
        elif m[0].startswith("<![CDATA["):
            page.say(stack[-1], m[0][9:-3])
    return page


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """One row per element of the pages in turn, and the length of each element's own text."""
    edge = np.cumsum([0, *(len(p.parent) for p in pages)])
    n = int(edge[-1])
    every = lambda f: np.fromiter((v for p in pages for v in f(p)), np.int64, n)
    page_of = np.repeat(np.arange(len(pages)), np.diff(edge))
    parent = every(lambda p: p.parent)
    top = parent < 0
    up = np.where(top, np.arange(n), parent + edge[page_of])
    depth, place, kids, hint, above, inside = (every(f) for f in (lambda p: p.depth, lambda p: p.place, lambda p: p.kids, lambda p: p.hint, lambda p: p.above, lambda p: p.inside))
    before = every(lambda p: p.before).astype(float)
    codes: dict[str, int] = dict(_TAG_AT)
    code = np.fromiter((codes.setdefault(t, len(codes)) for p in pages for t in p.tag), np.int64, n)
    is_tag = lambda *names: np.isin(code, [codes[t] for t in names if t in codes])

    sizes = np.array([(k + e, *x) for p, e in zip(pages, edge.tolist(), strict=False) for k, *x in p.sizes], np.int64).reshape(-1, 4)
    own, words, stops = (np.bincount(sizes[:, 0], sizes[:, k], n) for k in (1, 2, 3))
    sums = np.column_stack([own, words, stops, *(own * (inside & bit > 0) for bit in (1, 2, 4)), np.ones(n), is_tag("a"), is_tag(*_FIELDS), is_tag("p")]).astype(float)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2 if n else 1))
    for d in range(len(levels) - 2, 0, -1):
        at = by_depth[levels[d] : levels[d + 1]]
        np.add.at(sums, up[at], sums[at])
    text, w, s, linked, par, listed, nodes, links, inputs, paras = sums.T
    total = np.maximum(text[edge[:-1]], 1.0)[page_of]
    safe = np.maximum(text, 1.0)
    siblings = np.maximum(kids[up], 1)
    _, group, count = np.unique(up * (len(codes) + 1) + code, return_inverse=True, return_counts=True)
    bits = np.arange(len(HINTS))
    x = np.column_stack(
        [
            hint[:, None] >> bits & 1,
            above[:, None] >> bits & 1,
            code[:, None] == np.arange(len(TAGS)),
            np.log1p(text),
            text / total,
            linked / safe,
            par / safe,
            listed / safe,
            text / nodes,
            s / np.maximum(w, 1),
            w / nodes,
            np.log1p(nodes),
            np.log1p(links),
            np.minimum(inputs, 5),
            np.log1p(paras),
            depth,
            place / siblings,
            np.minimum(siblings, 30),
            np.minimum(count[group], 30),
            text / safe[up],
            before / total,
            inside,
            is_tag(*_HEADINGS),
            is_tag(*BLOCK),
            np.log1p(text[up]),
            (linked / safe)[up],
            (par / safe)[up],
            np.log1p(paras[up]),
            (text / total)[up],
        ]
    )
    return x.astype(np.float64), own


class Trees:
    """Gradient-boosted regression trees for logistic loss: complete trees of one depth, splits on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]).astype(np.int64)
        prior = y.mean()
        self.start = float(np.log(prior / (1 - prior)))
        score = np.full(len(y), self.start)
        wide = self.bins
        self.at, self.cut, self.leaf = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            at, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                width = 2**level
                best = np.full(width, 1e-9)
                pick, where = np.zeros(width, np.int64), np.full(width, wide)
                for f in range(x.shape[1]):
                    slot = node * wide + binned[:, f]
                    gs = np.bincount(slot, g, width * wide).reshape(width, wide).cumsum(1)
                    hs = np.bincount(slot, h, width * wide).reshape(width, wide).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better], pick[better], where[better] = top[better], f, k[better]
                for j in range(width):
                    at[width - 1 + j] = pick[j]
                    cut[width - 1 + j] = cuts[pick[j]][where[j]] if where[j] < len(cuts[pick[j]]) else np.inf
                node = node * 2 + (binned[np.arange(len(y)), pick[node]] > where[node])
            leaf = self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.ridge)
            score += leaf[node]
            self.at.append(at)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for at, cut, leaf in zip(self.at, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = 2**level - 1 + node
                node = node * 2 + (x[rows, at[k]] > cut[k])
            out += leaf[node]
        return out


def states(page: Page, score: list[float], weight: list[float], switch: float = 3.0) -> list[int]:
    """Of each element: 0 dropped whole, 1 kept whole, 2 mixed with its own text kept, 3 mixed without it.

    score: log odds; weight: of an element's own text. keep and drop are the worth of a subtree of one kind, mixed lets
    each child take its best state at a cost; hidden elements are never worth keeping.
    """
    n, parent, never = len(page.parent), page.parent, page.hidden
    keep = [-1e6 if h else s * w for h, s, w in zip(never, score, weight, strict=True)]
    drop = [0.0 if h else -s * w for h, s, w in zip(never, score, weight, strict=True)]
    own = [abs(d) for d in drop]
    best, kids = [0.0] * n, [0.0] * n
    mixed = [-1e9] * n
    for k in range(n - 1, -1, -1):
        if page.kids[k]:
            mixed[k] = own[k] + kids[k] - switch
        best[k] = max(keep[k], drop[k], mixed[k])
        p = parent[k]
        if p >= 0:
            keep[p] += keep[k]
            drop[p] += drop[k]
            kids[p] += best[k]
    state = [0] * n
    for k in range(n):
        up = state[parent[k]] if k else 2
        if up < 2:
            state[k] = up
        elif best[k] == keep[k]:
            state[k] = 1
        elif best[k] == drop[k]:
            state[k] = 0
        else:
            state[k] = 2 if score[k] > 0 and not never[k] else 3
    return state


def decoded(page: Page, score: list[float], weight: list[float], switch: float = 3.0) -> list[bool]:
    """Which elements' own text is kept."""
    if not any(page.hint) and not STRUCTURE.intersection(page.tag):
        return [not h for h in page.hidden]
    kept = [x in (1, 2) and not h for x, h in zip(states(page, score, weight, switch), page.hidden, strict=True)]
    shown = {k for k, t in page.runs if t.strip() and not page.hidden[k]}
    if any(kept[k] for k in shown):
        return kept
    for within, named in ((True, True), (False, True), (False, False)):
        left = not_apart(page, within, named)
        if any(left[k] for k in shown):
            return left
    return kept


def not_apart(page: Page, within: bool, named: bool) -> list[bool]:
    """Which elements lie in no part that is set apart by its tag or (``named``) by its name; ``within``: and in an article or main
    element, where a header may stand."""
    n = len(page.parent)
    apart, kept = [False] * n, [False] * n
    for k in range(n):
        up = page.parent[k]
        other = named and page.hint[k] and not page.hint[k] & _TEXT_HINT
        top = page.tag[k] in ("article", "main")
        inside = within and up >= 0 and kept[up]
        own = page.hidden[k] or page.tag[k] in APART and not (inside and page.tag[k] == "header") or bool(other) and not top
        apart[k] = own or up >= 0 and apart[up]
        kept[k] = not own and (inside or top and not apart[k]) if within else not apart[k]
    return kept


def blocks(page: Page, kept: list[bool] | None = None) -> str:
    """Text of the kept elements: one line per block, white space inside it single."""
    lines: list[str] = []
    held: list[str] = []

    def end() -> None:
        if line := _SPACE.sub(" ", html.unescape("".join(held))).strip():
            lines.append(line)
        held.clear()

    for i, (k, t) in enumerate(page.runs):
        if i in page.breaks:
            end()
        if kept is None or kept[k] or page.tag[k] in VOID and kept[page.parent[k]]:
            held.append(t)
    end()
    return "\n".join(lines)


def _weights(own: np.ndarray) -> np.ndarray:
    return np.where(own > 0, 1.0 + np.log1p(own) / 4, 0.25)


class Extractor:
    def __init__(self, trees: Trees):
        self.trees = trees

    def texts(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        x, own = features(pages)
        score, weight = self.trees.score(x), _weights(own)
        out, at = [], 0
        for p in pages:
            to = at + len(p.parent)
            out.append(blocks(p, decoded(p, score[at:to].tolist(), weight[at:to].tolist())))
            at = to
        return out


def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Trees:
    """Trees fitted on generated pages; an element is an example if its text is nearly all of one kind."""
    from trailmill.llm.synthetic_pages import is_content, labelled_page

    rng = np.random.default_rng(seed)
    parsed = [parse(labelled_page(rng)) for _ in range(pages)]
    x, _ = features(parsed)
    good, bad = [], []
    for page in parsed:
        g, b = [0] * len(page.parent), [0] * len(page.parent)
        for k, t in page.runs:
            (g if is_content(t) else b)[k] += len(t.strip())
        for k in range(len(page.parent) - 1, 0, -1):
            g[page.parent[k]] += g[k]
            b[page.parent[k]] += b[k]
        good += g
        bad += b
    good, bad = np.array(good), np.array(bad)
    sure = (good + bad > 0) & (np.maximum(good, bad) > 0.9 * (good + bad))
    return Trees().fit(x[sure], (good > bad)[sure].astype(float))


_READY: dict[tuple[int, int], Trees] = {}


def fitted() -> Trees:
    key = (TRAINING_PAGES, SEED)
    if key not in _READY:
        _READY[key] = trained(*key)
    return _READY[key]


def extracted(pages: DataFrame, trees: Trees, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Extractor(trees)
        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                texts = ready.texts([s or "" for s in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select(*keep, F.col(source).alias("_html")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"), fitted())
    return out.withColumn("n_chars", F.length("text").cast("long"))
