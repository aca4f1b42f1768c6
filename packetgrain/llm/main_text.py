"""Main text of web pages by a tree-structured graphical model.

The blocks of a page form a tree as in its document, and every block is content or not. What a page says itself is
evidence: an ``article`` and all in it is content; navigation, footers, asides, adverts, comments, forms in an article
and parts so named are not, nor is anything in them. All other blocks are unknown. Their own texture (prose, heading,
list item, length, link share, punctuation) gives a log-odds, to which weak hints are added (``main``, a form or header
that may hold the whole page, names that only contain a telling word); a parent-child potential ties a block to its
parent. Sum-product messages go up from the leaves and down again and give each block's marginal; text of blocks over
one half is kept, in page order.

Training uses the evidence as labels and never as features: weights of texture are a maximum a posteriori fit to the
texture of blocks of known state, the columns of hints held out. Parent-child tables are then estimated by expectation
maximisation: expected pairs of states, given the evidence, by the same messages over all edges. Only counts of
distinct texture rows and sums of expected pairs leave the tasks.

Defined results: a null or empty page has an empty text; repeated rows have equal results; an empty table gives no
rows; without evidence the priors hold. A hidden element that no end tag and no block's end closes hides nothing from
there on, and neither do later ones of its kind. Other columns are passed on; one named ``main_text`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.session import cut

FIT_PAGES = 2_000
ROUNDS = 2

# Element groups.
HIDDEN = frozenset("script style noscript template svg math head title iframe object select textarea button canvas".split())
# Elements that '/>' closes, and the start tags that end an open one of them.
FOREIGN = frozenset("svg math".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre ruby "
    "s small span strong strike sub sup table tt u ul var".split()
)
# What may stand in a head; any other element, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AGAINST = frozenset("nav footer aside form menu dialog fieldset header".split())
FOR = frozenset("article main".split())
NEUTRAL = frozenset("html body div section center table tbody thead tfoot tr".split())
PROSE = frozenset("p pre blockquote dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = (
    AGAINST
    | FOR
    | NEUTRAL
    | PROSE
    | HEADINGS
    | frozenset("address caption details dl dt figure hgroup li ol summary td th ul".split())
)
# An opening tag of these ends an open one of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

# Parts of names. Those that say what a block is in any company,
PLAIN_BAD = re.compile(
    r"advert\w*|breadcrumbs?|comments?|consent|cookies?|disqus|login|masthead|modal|newsletters?|popup|sidebar|signup|sponsor\w*"
)
# those that say it alone or with words of layout,
BAD = re.compile(
    r"ads?|banner|footer|header|hidden|menu|nav\w*|notices?|pager|pagination|promo\w*|related|repl(?:y|ies)|respond|share|"
    r"sharing|social|subscri\w*|toolbar|widget"
)
# words of content, words of layout, and first parts of names that describe a page's layout, not the block.
GOOD = frozenset("article content entry main post story text".split())
LAYOUT = frozenset(
    "area articles bar block body bottom box button buttons col column container desktop global group icons inner item items "
    "left link links list mobile news outer page panel posts primary right row secondary section site stories top wrap wrapper".split()
)
SWITCH = frozenset("has hide is no not show with without".split())
PARTS = re.compile(r"[a-z]+")
BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())

# Prior log-odds: bias, main, form or header, weak name, good name, prose, heading, neutral, list item, length, links, stop.
PRIOR = np.array([-0.3, 3.0, -3.0, -1.5, 1.5, 1.2, 0.8, -0.3, -0.3, 0.25, -3.0, 0.8])
# Columns of hints: they are no features of training.
HINTS = slice(1, 5)
# Pseudo-counts of (parent, child) states below neutral wrappers, below other blocks, and below the page itself.
PAIRS = np.array([[[6.0, 4.0], [2.0, 8.0]], [[19.0, 1.0], [1.0, 19.0]], [[1.0, 1.0], [1.0, 1.0]]])
NEVER = -1e9


@dataclass
class Page:
    """Blocks of a page, parents before children, and its text pieces in page order."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    role: list[str] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[bool] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)


class _Builder(HTMLParser):
    def __init__(self, shown: dict[str, int] | None = None):
        super().__init__(convert_charrefs=True)
        self.shown = shown or {}  # hidden elements that hide nothing from this start tag on
        self.tags = 0
        self.hidden_at = 0
        self.page = Page()
        self.stack: list[int] = []
        self.skipped: list[str] = []
        self.links = 0
        self.run: list[str] = []
        self._open("html", {})

    def _open(self, tag: str, attrs: dict) -> None:
        p = self.page
        p.parent.append(self.stack[-1] if self.stack else -1)
        self.stack.append(len(p.tag))
        p.tag.append(tag)
        p.name.append(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".strip().lower())
        p.role.append((attrs.get("role") or "").lower())
        p.own.append(0)
        p.linked.append(0)
        p.stops.append(False)

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            p, at = self.page, self.stack[-1]
            p.pieces.append((at, text))
            p.own[at] += len(text)
            p.stops[at] |= text[-1] in ".!?:;…。"

    def _pop_to(self, tags: set, bounds: set) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.page.tag[self.stack[depth]]
            if tag in tags:
                del self.stack[depth:]
                return
            if tag in bounds:
                return

    def _hides(self, tag: str) -> bool:
        return tag in HIDDEN and self.tags < self.shown.get(tag, self.tags + 1)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.skipped and tag == "body":
            self.skipped.clear()
            return
        if self.skipped and self.skipped[-1] == "head" and tag not in IN_HEAD:
            self.skipped.clear()
        if tag in ("button", "select") and tag in self.skipped:
            self._unskip(tag)  # neither nests
        while self.skipped and self.skipped[-1] in FOREIGN and tag in BREAKOUT:
            self.skipped.pop()
        if self.skipped:
            # Blocks are noted too, so that an end tag can be told to belong to one outside.
            if self._hides(tag) or tag in BLOCKS or tag in ("foreignobject", "desc"):
                self.skipped.append(tag)
            return
        if self._hides(tag):
            self.skipped.append(tag)
            self.hidden_at = self.tags
        elif tag == "a":
            self.links = 1
        elif tag == "br":
            self.run.append(" ")
        elif tag in BLOCKS and tag not in ("html", "body"):
            self.flush()
            self._pop_to({"p"}, BLOCKS - PROSE - HEADINGS)
            if tag in CLOSES:
                self._pop_to(CLOSES[tag], BOUNDS[tag])
            self._open(tag, dict(attrs))
        elif tag == "hr":
            self.flush()
            self._pop_to({"p"}, BLOCKS - PROSE - HEADINGS)

    def handle_startendtag(self, tag, attrs):
        # Void elements and foreign ones close themselves; others with a slash are ordinary opening tags.
        if tag not in FOREIGN and not (self.skipped and self.skipped[-1] in FOREIGN and tag not in BREAKOUT):
            self.handle_starttag(tag, attrs)
        elif self.skipped and self.skipped[-1] == "head":
            self.skipped.clear()

    def _unskip(self, tag: str) -> None:
        while self.skipped.pop() != tag:
            pass

    def handle_endtag(self, tag):
        if tag in self.skipped:
            self._unskip(tag)
            return
        if self.skipped:
            # The end of a block around hidden elements ends them too.
            if tag not in BLOCKS or tag not in (self.page.tag[i] for i in self.stack[1:]):
                return
            self.skipped.clear()
        if tag == "a":
            self.links = 0
        elif tag in BLOCKS and tag not in ("html", "body"):
            self.flush()
            self.links = 0
            bounds = {"article", "main", "nav", "aside", "footer", "form", "table"} - {tag}
            self._pop_to(HEADINGS if tag in HEADINGS else {tag}, set() if tag in bounds | FOR | AGAINST else bounds)

    def handle_data(self, data):
        if self.skipped == ["head"] and data.strip():
            self.skipped.clear()
        if not self.skipped:
            self.run.append(data)
            if self.links:
                self.page.linked[self.stack[-1]] += len(data)


def _built(html: str, shown: dict[str, int]) -> _Builder:
    builder = _Builder(shown)
    try:
        builder.feed(html)
        builder.close()
    except AssertionError:  # marked sections the parser has no rule for
        builder = _Builder(shown)
        builder.feed(html.replace("<![", "&lt;!["))
        builder.close()
    builder.flush()
    return builder


def parse(html: str) -> Page:
    shown: dict[str, int] = {}
    builder = _built(html, shown)
    # Each turn settles one kind of element, so there are few.
    while builder.skipped and builder.skipped[0] not in shown and builder.skipped[0] != "head":
        shown[builder.skipped[0]] = builder.hidden_at
        builder = _built(html, shown)
    return builder.page


def named(name: str) -> int:
    """What the classes and ids of a block say: 2 surely no content, 1 perhaps none, 0 nothing against it."""
    found = 0
    for token in name.split():
        parts = PARTS.findall(token)
        if not parts or parts[0] in SWITCH:
            continue
        bad = [p for p in parts if BAD.fullmatch(p)]
        other = [p for p in parts if not BAD.fullmatch(p)]
        if any(PLAIN_BAD.fullmatch(p) for p in parts):
            return 2
        if bad and all(p in GOOD or p in LAYOUT for p in other):
            # A header of an article, post or text is a part of it.
            if bad != ["header"] or not GOOD.intersection(other) - {"main"}:
                return 2
        found = max(found, bool(bad))
    return found


def _against(page: Page, i: int) -> bool:
    tag, name = page.tag[i], page.name[i]
    if page.role[i] in BAD_ROLE or (tag in AGAINST and tag not in ("header", "form")):
        return True
    if tag in FOR:  # classes of these speak of the page, but comments may be articles
        return "comment" in name
    return tag not in HEADINGS and named(name) == 2


def features(page: Page) -> np.ndarray:
    """One row per block, in the order of PRIOR; length and link share in steps, so that rows repeat."""
    rows = np.zeros((len(page.tag), len(PRIOR)))
    for i, tag in enumerate(page.tag):
        name, own = page.name[i], page.own[i]
        rows[i, HINTS] = (
            tag in FOR or page.role[i] in FOR,
            tag in ("form", "header") or page.role[i] == "form",
            bool(name) and tag not in FOR and named(name) > 0,
            bool(GOOD.intersection(PARTS.findall(name))),
        )
        if own:
            rows[i, 0] = 1
            rows[i, 5:9] = (tag in PROSE, tag in HEADINGS, tag in NEUTRAL, tag in ("li", "td", "th", "dt"))
            rows[i, 9:] = (int(math.log2(1 + own)), round(4 * min(page.linked[i] / own, 1)) / 4, page.stops[i])
    return rows


def states(page: Page) -> list[int]:
    """What the page says itself: 1 content, 0 not, -1 unknown."""
    out: list[int] = []
    for i, parent in enumerate(page.parent):
        above, tag = (out[parent] if parent >= 0 else -1), page.tag[i]
        top = tag == "header" and parent == 0
        if above == 0 or _against(page, i) or top or (above == 1 and (tag == "form" or page.role[i] == "form")):
            out.append(0)
        else:
            out.append(1 if "article" in (tag, page.role[i]) else above)
    return out


def _firm(page: Page, i: int) -> int:
    """Table of the children of a block: 0 of neutral wrappers, 1 of other blocks, 2 of the page itself."""
    plain = page.tag[i] in NEUTRAL and not page.role[i] and not named(page.name[i])
    return 2 if i == 0 else 0 if plain else 1


@dataclass
class Model:
    weights: np.ndarray
    pairs: np.ndarray  # log P(child state | parent state) per kind of parent

    def _messages(self, page: Page) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Tables of parents, then log messages to parents, of subtrees and of whole pages."""
        n = len(page.tag)
        below = np.column_stack([np.zeros(n), features(page) @ self.weights])
        for i, state in enumerate(states(page)):
            if state >= 0:
                below[i, 1 - state] = NEVER
        firm = [_firm(page, i) for i in range(n)]
        up = np.zeros((n, 2))
        for i in range(n - 1, 0, -1):
            table = self.pairs[firm[page.parent[i]]] + below[i]
            up[i] = np.logaddexp(table[:, 0], table[:, 1])
            below[page.parent[i]] += up[i]
        full = below.copy()
        for i in range(1, n):
            parent = page.parent[i]
            table = self.pairs[firm[parent]] + (full[parent] - up[i])[:, None]
            full[i] = below[i] + np.logaddexp(table[0], table[1])
            full[i] -= full[i].max()
        return firm, up, below, full

    def marginals(self, page: Page) -> np.ndarray:
        """Probability of content of every block: messages upward, then downward."""
        full = self._messages(page)[3]
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700)))

    def expected_pairs(self, page: Page) -> np.ndarray:
        """Expected numbers of (parent, child) states per kind of parent, given what the page says itself."""
        firm, up, below, full = self._messages(page)
        out = np.zeros(PAIRS.shape)
        for i in range(1, len(page.tag)):
            parent = page.parent[i]
            table = (full[parent] - up[i])[:, None] + self.pairs[firm[parent]] + below[i]
            table = np.exp(np.maximum(table - table.max(), -700))
            out[firm[parent]] += table / table.sum()
        return out

    def text(self, html: str) -> str:
        page = parse(html)
        kept = self.marginals(page) > 0.5
        return "\n".join(text for at, text in page.pieces if kept[at])


def estimate(rows: np.ndarray, label: np.ndarray, count: np.ndarray, pairs: np.ndarray, steps: int = 40) -> Model:
    """Newton steps to the most probable weights, with a normal prior around PRIOR; pair tables from counts."""
    weights = PRIOR.copy()
    # Texture that no block of known state shows keeps its prior; all else is the data's to say.
    scale = min(1.0, 2_000 / max(count.sum(), 1))
    for _ in range(steps if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (scale * count * (p - label)) + 4 * (weights - PRIOR)
        curve = (rows * (scale * count * p * (1 - p))[:, None]).T @ rows + 4 * np.eye(len(weights))
        move = np.linalg.solve(curve, slope)
        weights = weights - move
        if np.abs(move).max() < 1e-8:
            break
    return Model(weights, _tables(pairs))


def _tables(pairs: np.ndarray) -> np.ndarray:
    """Logarithms of P(child state | parent state) from counts and pseudo-counts; kinds without counts keep those."""
    held = PAIRS.copy()
    held[: len(pairs)] += pairs
    return np.log(held / held.sum(axis=2, keepdims=True))


def sample(pages: DataFrame, most: int) -> DataFrame:
    """``html`` of at most ``most`` different pages, those of the smallest hashes of id and page."""
    keyed = pages.where("html is not null").select(
        "html", F.xxhash64(F.col("page_id").cast("string")).alias("a"), F.xxhash64("html").alias("b")
    )
    chosen = keyed.groupBy("a", "b").count().orderBy("a", "b").limit(most).select("a", "b")
    return cut(keyed.join(F.broadcast(chosen), ["a", "b"]).dropDuplicates(["a", "b"]).select("html"))


def fit(pages: DataFrame, most: int = FIT_PAGES, rounds: int = ROUNDS) -> Model:
    """Train on at most ``most`` pages, the tables of parents and children in ``rounds`` passes over them."""

    def textures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for html in batch.column(0).to_pylist():
                page = parse(html)
                rows = features(page)
                rows[:, HINTS] = 0
                for i, label in enumerate(states(page)):
                    if label >= 0 and page.own[i]:
                        seen[(*rows[i].tolist(), float(label))] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(k) for k in seen], pa.list_(pa.float64())), pa.array(list(seen.values()), pa.int64())],
                ["row", "n"],
            )

    def pairs_by(model: Model):
        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for html in batch.column(0).to_pylist():
                    # Whole millionths, so that sums do not depend on the order of pages.
                    held = np.rint(model.expected_pairs(parse(html)).ravel() * 1e6).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(PAIRS.size)), pa.array(held)], ["pair", "n"])

        return expected

    held = sample(pages, most)
    # Textures are steps of small range: the distinct rows are few, whatever the number of pages.
    found = held.mapInArrow(textures, "row array<double>, n long").groupBy("row").agg(F.sum("n").alias("n"))
    blocks = found.orderBy("row").collect()
    table = np.array([r["row"] for r in blocks]).reshape(-1, len(PRIOR) + 1)
    count = np.array([r["n"] for r in blocks], float)
    model = estimate(table[:, :-1], table[:, -1], count, np.zeros(PAIRS.shape))
    for _ in range(rounds):
        sums = held.mapInArrow(pairs_by(model), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
        pairs = np.zeros(PAIRS.size)
        for r in sums:
            pairs[r["pair"]] = r["n"] / 1e6
        model = Model(model.weights, _tables(pairs.reshape(PAIRS.shape)))
    return model


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``pages`` with ``main_text``, the kept blocks joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html"))
            found = [model.text(h.as_py() or "") for h in html]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "main_text"]
            )

    pages = pages.drop("main_text")
    return pages.mapInArrow(run, T.StructType([*pages.schema, T.StructField("main_text", T.StringType())]))
