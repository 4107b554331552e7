"""Main text of web pages by a tree-structured graphical model.

Every block of a page is a node that frames other blocks, is content, or is apart from it (a menu, an advert, ...).
Node potentials come from a block's tag, its class, id and
role words, its share of linked text and its length; parent-child potentials say how often a block is like the block
around it. Messages go up the tree and down again, and a node's text is kept if its content marginal is above one half. All potentials are counts over
labelled pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from esquina.llm.labelled_pages import PAGES

TRAIN_PAGES = 2_000  # labelled pages of the table that are counted, about
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var".split()
)
SILENT = set("script style noscript template head title select textarea button iframe object svg canvas".split())
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = {"ul", "ol", "dl", "table", "body", "html"}
# Text right inside of these is a paragraph.
BARE = {"#page", "html", "body"}
# Tags that tell nothing about what they hold.
PLAIN = {"ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tr", "td", "th", "div", "section"}
OUTER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
OUTER_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottom sidebar side aside "
    "rail widget notice notices cookie cookies consent gdpr banner alert popup modal overlay ad ads advert adverts "
    "advertisement sponsor sponsored promo promotion form login signup subscribe newsletter search comment comments reply "
    "replies disqus discussion respond share sharing social related recommended pagination pager tags copyright legal".split()
)
INNER_WORDS = set("article content main post entry story body text prose".split())
SENTENCE = re.compile(r"[.!?…。！？][\"'”»)]*\s*$")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


FRAME, CONTENT, APART = range(3)
LABELS = (FRAME, CONTENT, APART)
# The least log potential of a feature, by kind, and of a change of label on the way down. Features of a block tell
# much the same thing, so none but a telling name may outweigh the blocks around it.
LEAST = {"tag": -3.0, "words": -20.0, "links": -1.5, "stops": -1.5}
TURN = -9.0
UNSEEN = 1e-4


class Page(HTMLParser):
    """Blocks as nodes in page order, parents first, and the text pieces with their node and block number."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.words, self.parents, self.marks = ["#page"], [frozenset()], [-1], [None]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.open: Counter[str] = Counter()  # tags on the stack
        self.block, self.silent, self.links = 0, 0, 0
        self.loose = (-1, 0)  # block and node of text that no block of its own encloses
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self.block += 1
            return
        if tag in CLOSES_P:
            self._close_until({"p"}, HOLDERS | OUTER_TAGS | {"div", "article", "section", "main", "td", "li"})
        if tag in SIBLINGS:
            self._close_until(SIBLINGS[tag], HOLDERS)
        named = {k: v or "" for k, v in attrs}
        words = frozenset(w.lower() for k in ("class", "id", "role") for w in WORD.findall(named.get(k, "")))
        node = self.stack[-1][1]
        inline = tag in INLINE
        if not inline:
            self.block += 1
        if not inline or words & OUTER_WORDS:
            node = self._node(tag, words, node, named.get("data-content"))
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.stack.append((tag, node))
        self.open[tag] += 1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![…`` outside a foreign element is a comment up to the next ``>``."""
        return self.parse_bogus_comment(i)

    def _node(self, tag: str, words: frozenset[str], parent: int, mark: str | None) -> int:
        self.tags.append(tag)
        self.words.append(words)
        self.parents.append(parent)
        self.marks.append(mark)
        return len(self.tags) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.open["p"]:
            self.block += 1
        if self.open[tag]:
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        self.silent -= tag in SILENT
        self.links -= tag == "a"
        self.block += tag not in INLINE
        return tag

    def _close_until(self, wanted: set[str], fence: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in wanted:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k][0] in fence:
                return

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        node = self.stack[-1][1]
        if self.tags[node] in BARE:
            if self.loose[0] != self.block and data.strip():
                self.loose = (self.block, self._node("p", frozenset(), node, None))
            node = self.loose[1] if self.loose[0] == self.block else node
        self.pieces.append((node, self.block, data, self.links > 0))

    def features(self) -> list[tuple[str, ...]]:
        """Per node: a telling tag, words, share of links with length, ends of sentences; over the whole subtree."""
        size, linked, stops = ([0] * len(self.tags) for _ in range(3))
        for node, _, text, link in self.pieces:
            n = len(text.strip())
            size[node] += n
            linked[node] += n * link
            stops[node] += bool(SENTENCE.search(text)) and not link
        for i in range(len(self.tags) - 1, 0, -1):
            for sums in (size, linked, stops):
                sums[self.parents[i]] += sums[i]
        out = []
        for i, tag in enumerate(self.tags):
            share = 0 if not size[i] else 1 + (10 * linked[i] >= 2 * size[i]) + (10 * linked[i] >= 6 * size[i])
            length = sum(size[i] >= n for n in (1, 25, 100, 400))
            kind = "outer" if self.is_apart(i) else "inner" if self.words[i] & INNER_WORDS else "none"
            named = () if tag in PLAIN or tag in INLINE else (f"tag:{tag}",)
            out.append((*named, f"words:{kind}", f"links:{share}:{length}", f"stops:{min(stops[i], 2)}"))
        return out

    def own_labels(self) -> list[int] | None:
        """Labels of a page that names its article and its other parts by tags, else none."""
        if not {"article", "main"} & set(self.tags):
            return None
        labels = [FRAME] * len(self.tags)
        for i in range(1, len(self.tags)):
            labels[i] = labels[self.parents[i]]
            if labels[i] != APART and self.is_apart(i):
                labels[i] = APART
            elif labels[i] == FRAME and self.tags[i] in ("article", "main"):
                labels[i] = CONTENT
        return labels

    def is_apart(self, i: int) -> bool:
        return self.tags[i] in OUTER_TAGS or bool(self.words[i] & OUTER_WORDS)

    def marked_labels(self) -> list[int]:
        """Labels from ``data-content`` attributes, which hold for what they enclose, and from names outside of them."""
        labels = [FRAME] * len(self.tags)
        for i in range(1, len(self.tags)):
            around = labels[self.parents[i]]
            if self.marks[i] is not None:
                labels[i] = CONTENT if self.marks[i] == "1" else APART
            else:
                labels[i] = APART if around == FRAME and self.is_apart(i) else around
        return labels


def counts(page: Page, labels: list[int]) -> Counter:
    """What the potentials are made from: features and labels, and labels of parents and children."""
    seen: Counter = Counter()
    for i, found in enumerate(page.features()):
        for f in found:
            seen[f, labels[i]] += 1
        seen["node", labels[i]] += 1
        if i:
            seen[f"around:{labels[page.parents[i]]}", labels[i]] += 1
    return seen


class Model:
    """Log potentials from counts; what was never seen counts as ``UNSEEN``."""

    def __init__(self, seen: dict[tuple[str, int], int]):
        total = [seen.get(("node", y), 0) + 1 for y in LABELS]
        self.unary: dict[str, list[float]] = {}
        for f in {f for f, _ in seen if f != "node" and not f.startswith("around:")}:
            logs = [math.log((seen.get((f, y), 0) + UNSEEN) / total[y]) for y in LABELS]
            least = LEAST[f.partition(":")[0]]
            self.unary[f] = [max(x - max(logs), least) for x in logs]
        self.pair = []
        for around in LABELS:
            n = [seen.get((f"around:{around}", y), 0) + 1 for y in LABELS]
            self.pair.append([max(math.log(x / sum(n)), TURN) for x in n])

    def marginals(self, page: Page) -> list[float]:
        """The probability of each node to be content, by messages up and down the tree."""
        size, pair, zero = len(page.tags), self.pair, [0.0, 0.0, 0.0]
        up = [[sum(x) for x in zip(*(self.unary.get(f, zero) for f in found))] for found in page.features()]
        sent = [zero] * size
        for i in range(size - 1, 0, -1):
            own, p = up[i], up[page.parents[i]]
            sent[i] = [log_sum([pair[a][y] + own[y] for y in LABELS]) for a in LABELS]
            for a in LABELS:
                p[a] += sent[i][a]
        down, out = [zero] * size, [0.0] * size
        for i in range(size):
            if i:
                p = page.parents[i]
                rest = [up[p][a] - sent[i][a] + down[p][a] for a in LABELS]
                message = [log_sum([rest[a] + pair[a][y] for a in LABELS]) for y in LABELS]
                down[i] = [m - max(message) for m in message]
            both = [u + d for u, d in zip(up[i], down[i])]
            out[i] = math.exp(both[CONTENT] - log_sum(both))
        return out

    def text(self, html: str | None) -> str:
        """The kept blocks of a page, white space made single, one to a line."""
        if not html:
            return ""
        page = Page(html)
        content = self.marginals(page)
        blocks: dict[int, list[str]] = {}
        for node, block, text, _ in page.pieces:
            if content[node] > 0.5:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n".join(x for x in lines if x)


def log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum([math.exp(v - top) for v in x]))


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", limit: int = TRAIN_PAGES) -> Model:
    """Counts the labelled pages: those shipped with the package, and of the table about ``limit`` that label themselves.

    Only sums for each feature value reach the driver.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html"))
    total = rows.count()
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, total))) < limit).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for html in b.column("html").to_pylist():
                page = Page(html or "")
                labels = page.own_labels()
                if labels:
                    seen += counts(page, labels)
        if seen:
            parts = zip(*((f, y, n) for (f, y), n in seen.items()))
            columns = [pa.array(c, k) for c, k in zip(parts, (pa.string(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "label", "n"])

    summed = chosen.mapInArrow(run, "feature string, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n"))
    seen = Counter({(r["feature"], r["label"]): r["n"] for r in summed.collect()})
    weight = max(1, seen["node", CONTENT] // 500)
    for html in PAGES:
        page = Page(html)
        for k, n in counts(page, page.marked_labels()).items():
            seen[k] += n * weight
    return Model(seen)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``. A null or empty page gives an empty text."""

    @F.arrow_udf("string")
    def main_text(html: pa.Array) -> pa.Array:
        return pa.array([model.text(h) for h in html.to_pylist()], pa.string())

    found = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), main_text(F.col(f"`{html_col}`")).alias("text")
    )
    return found.withColumn("n_chars", F.length("text").cast("long"))
