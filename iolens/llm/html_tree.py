"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: elements with the same path (tags, classes and order among
their like) are one node of the site's tree. Two things are counted at each node: its presentation, which
is the sequence of its child tags, and its content, which is its own text. What is the same on most of a
node's pages carries little information: with ``c`` of ``m`` pages alike, a page's node scores
``log(m / c) / log(m)``, whose mean over the pages is the normalised entropy of the node. Nodes seen on few
pages score 1. A branch's importance is put together bottom-up from presentation and content scores;
what the page itself says weighs in as a prior: 0 for elements that name themselves as menus, adverts,
forms and the like, more inside an element marked as the article. Branches of low importance are
removed, and the text blocks of the rest are joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.llm.common import stored
from iolens.llm.site_lines import host_of

#: Nodes seen on fewer pages of a host are not judged by their entropy.
MIN_PAGES = 5
#: Share of an inner node's importance that comes from its own presentation.
OWN_SHARE = 0.1
#: Branches below are removed.
LEAST_IMPORTANCE = 0.2
#: What is inside an article weighs so much more: only what nearly all of the host's pages share goes.
MAIN_WEIGHT = 1.5
#: Most entries of the score table that are broadcast (16 bytes each); beyond, pages are joined with theirs.
MAX_BROADCAST = 4_000_000

# HTML's elements by kind.
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe noframes noembed xmp textarea title svg math select".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("body head html li dd dt td th tr tbody thead tfoot caption option optgroup legend button".split())
CLOSES_LIKE = {
    "li": {"li"},
    "dd": {"dd", "dt"},
    "dt": {"dd", "dt"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "thead": {"tr", "td", "th", "tbody", "thead", "tfoot"},
    "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"},
    "tfoot": {"tr", "td", "th", "tbody", "thead", "tfoot"},
    "option": {"option"},
    "optgroup": {"option", "optgroup"},
}
#: An open element of these keeps the ones outside it from being closed by what is inside.
SCOPES = set("html body table td th ul ol dl menu div section article aside nav header footer main form".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NOISE_TAGS = RAW | set(
    "head nav header footer aside form button input label fieldset legend menu dialog object embed applet canvas "
    "audio video map datalist output progress meter search frameset".split()
)
MAIN_TAGS = {"article", "main"}
NOISE_ROLES = set(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar "
    "status tablist tooltip note".split()
)
#: Words in a class or id by which elements name themselves as no part of the article.
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox adblock sponsor sponsored "
    "sponsors promo promos promotion promoted banner nav navbar navi navigation menu menus submenu breadcrumb "
    "breadcrumbs header masthead topbar footer colophon copyright sidebar sidebars aside widget widgets cookie cookies "
    "consent gdpr notice notices notification notifications alert popup modal overlay lightbox newsletter subscribe "
    "subscription signup signin login register paywall social share sharing shares follow related recommended "
    "recommendations recirculation outbrain taboola comment comments commentlist disqus reply replies respond "
    "discussion pagination pager toolbar searchbox searchform form skip hidden".split()
)
#: Of them, those that also unmake an element marked as an article.
NOT_ARTICLES = set(
    "ad ads advert advertisement sponsor sponsored promo promoted comment comments reply related recommended "
    "teaser widget".split()
)

_TAG = re.compile(
    r"<(?:/?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|!--.*?(?:-->|\Z)|[!?][^>]*>|/?[a-zA-Z][^>]*>)", re.S
)
_NAME = re.compile(r"</?([^\s/>]+)(.*)>\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile("class|id|role|itemprop|hidden|style", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

NONE, NOISE, MAIN = 0, 1, 2


@dataclass(slots=True)
class Tag:
    """What a tag says by itself."""

    name: str
    ends: bool
    kind: int
    shape: str
    block: bool
    raw: bool
    empty: bool
    soft: bool  # noise by the words of its class or id only


class Page:
    """The DOM of a page as parallel lists; node 0 stands above the root."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.kinds, self.children = ["#"], [-1], [NONE], [[]]
        self.hard = [False]  # noise by more than words, or inside such
        self.blocks: list[tuple[int, str]] = []  # (node, text) in page order
        self._run: list[str] = []
        self._held: dict[int, list[str]] = {}  # lines that go on after noise inside them
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack, at, find = [0], 0, _TAG.search
        while (m := find(html, at)) is not None:
            start, end = m.span()
            if start > at:
                self._run.append(html[at:start])
            at = end
            tag = _tag(m.group())
            if tag is None:
                continue
            if tag.ends:
                self._close(stack, tag)
                continue
            self._open(stack, tag)
            if tag.empty:
                self._end(stack)
            elif tag.raw:  # its content is no markup
                close = re.compile(rf"</{re.escape(tag.name)}\s*>", re.I).search(html, at)
                at = close.end() if close else len(html)
                self._end(stack)
        self._run.append(html[at:])
        self._flush(stack[-1])

    def _open(self, stack: list[int], tag: Tag) -> None:
        name, tags = tag.name, self.tags
        if tag.block:
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] == "p":
                        self._cut(stack, i)
                        break
                    if tags[stack[i]] in SCOPES:
                        break
            if name in CLOSES_LIKE:
                self._close_like(stack, name)
            self._flush(stack[-1])
        elif name == "br":
            self._run.append(" ")
        kind, parent = tag.kind, stack[-1]
        over = self.kinds[parent]
        if over:
            if over == NOISE:
                kind = MAIN if kind == MAIN and (not self.hard[parent] or self._in_form(parent)) else NOISE
            elif kind == NONE or name == "header":  # an article's own head has its title
                kind = MAIN
        node = len(tags)
        if kind == NOISE and over != NOISE and not tag.block:
            self._held[node], self._run = self._run, []
        tags.append(name)
        self.parents.append(parent)
        self.kinds.append(kind)
        self.hard.append(kind == NOISE and (self.hard[parent] or tag.kind == NOISE and not tag.soft))
        self.children.append([])
        self.children[parent].append((node, tag.shape))
        stack.append(node)

    def _close_like(self, stack: list[int], name: str) -> None:
        """End the open row, item or the like that cannot hold another one."""
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[i]]
            if tag in CLOSES_LIKE[name]:
                self._cut(stack, i)
                if name not in ("tr", "thead", "tbody", "tfoot", "optgroup"):
                    break
            elif tag in SCOPES:
                break

    def _in_form(self, node: int) -> bool:
        """Whether the outermost noise around a node is a form; some pages are one form."""
        while self.kinds[self.parents[node]] == NOISE:
            node = self.parents[node]
        return self.tags[node] == "form"

    def _close(self, stack: list[int], tag: Tag) -> None:
        for i in range(len(stack) - 1, 0, -1):
            name = self.tags[stack[i]]
            if name == tag.name:
                self._cut(stack, i)
                return
            if not tag.block and name in BLOCK:
                return  # an inline end tag closes nothing beyond its block

    def _cut(self, stack: list[int], i: int) -> None:
        while len(stack) > i:
            self._end(stack)

    def _end(self, stack: list[int]) -> None:
        node = stack.pop()
        if self.tags[node] in BLOCK:
            self._flush(node)
        elif node in self._held:
            self._flush(node)
            self._run = self._held.pop(node)

    def _flush(self, node: int) -> None:
        if not self._run:
            return
        text = "".join(self._run)
        self._run = []
        text = " ".join((unescape(text) if "&" in text else text).split())
        if text:
            self.blocks.append((node, text))


_tags: dict[str, Tag | None] = {}


def _tag(text: str) -> Tag | None:
    """A tag as written; None for comments and declarations."""
    if text in _tags:
        return _tags[text]
    tag = None
    if text[1] not in "!?":
        name, attrs = _NAME.match(text).groups()
        name, ends = name.lower(), text[1] == "/"
        kind, shape, soft = (NONE, "", False) if ends else _read_shape(name, attrs if _TELLING.search(attrs) else "")
        block, raw = name in BLOCK, name in RAW
        empty = name in VOID or attrs.endswith("/") and not block and not raw
        tag = Tag(name, ends, kind, shape, block, raw, empty, soft)
    if len(_tags) > 20_000:
        _tags.clear()
    _tags[text] = tag
    return tag


def _read_shape(name: str, attrs: str) -> tuple[int, str, bool]:
    given = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip() else {}
    css = given.get("class", "")
    words = {w.lower() for w in _PART.findall(f"{css} {given.get('id', '')}")}
    role = given.get("role", "").lower()
    main = name in MAIN_TAGS or role in MAIN_TAGS or given.get("itemprop", "").lower() == "articlebody"
    hides = "hidden" in given or re.search(r"display\s*:\s*none", given.get("style", ""), re.I) is not None
    told = name in NOISE_TAGS or role in NOISE_ROLES or hides
    if name in ("html", "body", "main"):
        kind = MAIN if name == "main" else NONE
    elif main:
        kind = NOISE if hides or words & NOT_ARTICLES else MAIN
    else:
        noise = told or bool(words & NOISE_WORDS)
        kind = NOISE if noise and name not in HEADINGS or hides else NONE
    return kind, f"{name}.{' '.join(sorted(css.split()))}", not told and not words & NOT_ARTICLES


def features(page: Page, host: str) -> list[tuple[int, int, int, int]]:
    """``(node, which, key, value)``: its place in the site's tree, and what it shows (0) or says (1) there."""
    keys = [0] * len(page.tags)
    keys[0] = xxhash.xxh64_intdigest(host)
    out = []
    for node, below in enumerate(page.children):
        seen: dict[str, int] = {}
        for child, shape in below:
            seen[shape] = seen.get(shape, 0) + 1
            keys[child] = xxhash.xxh64_intdigest(f"{shape}#{seen[shape]}", keys[node])
        if below and node:
            style = " ".join([shape for _, shape in below])
            out.append((node, 0, keys[node] ^ 1, xxhash.xxh64_intdigest(style, keys[node] ^ 1)))
    texts: dict[int, list[str]] = {}
    for node, text in page.blocks:
        texts.setdefault(node, []).append(text)
    for node, own in texts.items():
        out.append((node, 1, keys[node], xxhash.xxh64_intdigest("\n".join(own), keys[node])))
    return out


def main_text(page: Page, scores: dict[tuple[int, int], float]) -> str:
    """The blocks of the branches that are important enough; ``scores`` by node and 0 or 1 as above."""
    marked = any(page.kinds[n] == MAIN for n, _ in page.blocks)  # where an article is marked, nothing else is one
    importance = _importance(page, scores)
    removed = [False] * len(page.tags)
    for node in range(1, len(page.tags)):
        kind, low = page.kinds[node], importance[node] < LEAST_IMPORTANCE
        if kind == MAIN:  # an article by itself, or a part of one
            removed[node] = low or page.kinds[page.parents[node]] == MAIN and removed[page.parents[node]]
        else:
            removed[node] = kind == NOISE or removed[page.parents[node]] or low
    kept = [t for n, t in page.blocks if not removed[n] and (page.kinds[n] == MAIN or not marked)]
    if marked and not kept:  # nearly all pages are copies of this one
        kept = [t for n, t in page.blocks if page.kinds[n] == MAIN]
    return "\n".join(kept)


def _importance(page: Page, scores: dict[tuple[int, int], float]) -> list[float]:
    """Bottom-up: a share from the node's presentation, the rest the largest of its content and children.

    The page's own word is a prior: noise counts 0, what is inside an article counts ``MAIN_WEIGHT`` fold.
    """
    inside, out = [0.0] * len(page.tags), [0.0] * len(page.tags)
    for node, _ in page.blocks:
        inside[node] = scores.get((node, 1), 1.0)
    for node in range(len(page.tags) - 1, 0, -1):  # children come after their parents
        kind, parent = page.kinds[node], page.parents[node]
        if kind != NOISE and inside[node]:
            out[node] = (1 - OWN_SHARE) * inside[node] + OWN_SHARE * scores.get((node, 0), 1.0)
            out[node] = min(1.0, out[node] * (MAIN_WEIGHT if kind == MAIN else 1.0))
        inside[parent] = max(inside[parent], out[node])
    return out


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """``page_id, url, text`` for each row: the text of the page's important branches.

    Null and empty pages have an empty text. Pages without a host are judged by themselves. Repeated rows
    each count and keep a row. Other columns are not read. An empty table gives no rows.
    """
    chosen = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        host_of(F.col(url_col)).alias("host"),
    )
    counted = chosen.where("host is not null and html is not null").select("host", "html")
    counted = counted.mapInArrow(_count_features, "key long, value long").groupBy("key", "value").agg(
        F.count("*").alias("c")
    )
    counted = stored(counted, "styles")
    totals = counted.groupBy("key").agg(F.sum("c").alias("m")).where(F.col("m") >= min_pages)
    alike = counted.where("c > 1").join(totals, "key")
    scores = stored(alike.select("value", (F.log(F.col("m") / F.col("c")) / F.log("m")).alias("score")), "scores")
    schema = chosen.select("page_id", "url").withColumn("text", F.lit("")).schema
    if scores.count() <= max_broadcast:
        table = pages.sparkSession.sparkContext.broadcast(_sorted(scores.toArrow()))
        return chosen.mapInArrow(_extractor(lambda: table.value), schema)
    return _extract_joined(chosen, scores).mapInArrow(_extractor(None), schema)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (key, value)
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"))
            for _, _, key, value in features(Page(html.as_py()), host)
        ]
        table = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["key", "value"])


def _sorted(scores: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    values = scores.column("value").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], scores.column("score").to_numpy()[order].astype(np.float32)


def _extract_joined(chosen: DataFrame, scores: DataFrame) -> DataFrame:
    """Pages with the scores of their own nodes, by a join: equal pages of a host have equal scores."""
    name = F.xxhash64("host", F.md5("html"))
    listed = chosen.where("host is not null and html is not null").select(name.alias("name"), "host", "html")
    nodes = listed.mapInArrow(_name_features, "name long, value long").distinct().join(scores, "value")
    own = nodes.groupBy("name").agg(F.collect_list("value").alias("values"), F.collect_list("score").alias("scores"))
    return chosen.withColumn("name", name).join(own, "name", "left").drop("name")


def _name_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, values = [], []
        for name, host, html in zip(
            batch.column("name").to_pylist(), batch.column("host").to_pylist(), batch.column("html")
        ):
            found = [value for _, _, _, value in features(Page(html.as_py()), host)]
            names += [name] * len(found)
            values += found
        signed = pa.array(np.array(values, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), signed], ["name", "value"])


def _extractor(table_of: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of() if table_of else None
        for batch in batches:
            texts = []
            for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"))):
                html = html.as_py()
                if not html:
                    texts.append("")
                    continue
                own = table
                if own is None:
                    pair = (batch.column("values")[i].as_py() or [], batch.column("scores")[i].as_py() or [])
                    order = np.argsort(values := np.array(pair[0], np.int64).view(np.uint64))
                    own = (values[order], np.array(pair[1], np.float32)[order])
                page = Page(html)
                texts.append(main_text(page, _scores(page, host, own)))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])

    return run


def _scores(page: Page, host: str | None, table: tuple[np.ndarray, np.ndarray]) -> dict[tuple[int, int], float]:
    values, scores = table
    found = features(page, host) if host is not None and len(values) else []
    if not found:
        return {}
    wanted = np.array([value for _, _, _, value in found], np.uint64)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    hits = np.flatnonzero(values[at] == wanted)
    return {found[i][:2]: float(scores[at[i]]) for i in hits.tolist()}
