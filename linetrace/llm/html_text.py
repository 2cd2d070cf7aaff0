"""Main text of web pages by a site style tree.

The DOMs of one host are merged into a style tree: a node is a path of tags with their classes.  A
node's presentation importance is the entropy of its child sequences over the host's pages, its
content importance the entropy of its texts; both are shares of the largest entropy possible, and
drawn towards 1 where few pages were seen.  Pages that say the same outside marked boilerplate count
once, so copies of an article do not make it look like boilerplate.

On each page importance is combined bottom-up over its branches: the mean content importance of the
text below, by length, and the mean presentation importance of the nodes below.  Branches of low
importance are removed, the largest first.  Elements that HTML itself defines as something else than
content (nav, footer, form, script ...) never count; class words, and an article or main element
elsewhere on the page, lower the importance of what they speak against.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetrace.llm.common import stash

#: A branch of less importance is removed, unless it holds so much of the page's important text.
LOW, KEEP = 0.3, 0.2
#: Weight of content against presentation; pages that speak for importance before any was seen.
CONTENT, PRIOR_PAGES = 0.9, 2.0
#: What a telling class word leaves of the importance; where more of the page's text stands in the
#: branch than this share, the word is not believed.
NAMED, BELIEF = 0.25, 0.9
#: Importances above this count as 1 and are not stored.
WHOLE = 0.95
#: Bytes of a style tree's entries that are sent to all executors; larger trees are joined by host.
SMALL_BYTES = 8 << 20
ENTRY_BYTES = 24

# Elements and words of class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset(
    "head nav footer aside form script style noscript template iframe svg math button select option textarea input dialog menu object embed canvas audio video noembed noframes title datalist".split()
)
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices "
    "gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comments comment disqus respond replies reply pagination pager toolbar "
    "widget masthead skip search byline toc copyright".split()
)
#: The few of them that an article, a heading or a paragraph may bear against itself.
PLAIN_NOISE = frozenset(("comment", "comments", "ad", "ads", "related", "sponsored", "promo"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
    "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
#: Elements that bound the search for an element to close.
FENCE = frozenset("table ul ol dl div section article aside nav main body html td th".split())
#: Elements that are told apart from like siblings by their number.
NUMBERED = frozenset("div section td th table ul ol dl".split())
LEVELS = {"article": 2, "main": 1}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAMES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

SHAPE, SAID = 0, 1
#: An element's place in the lists below for text that ends a block.
BREAK = -1


def _hash(value: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), seed)


def _about(tag: str, attributes: str, article: bool) -> tuple[str, bool, bool]:
    """Its name in a path, whether HTML says that it is no content, and whether a class word does."""
    out = tag in DROP or tag == "header" and not article
    if not attributes.strip():
        return tag, out, False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attributes)}
    words = {w.lower() for k in ("class", "id") for w in _NAMES.findall(found.get(k, ""))}
    named = False
    if tag not in ("html", "body", "main") and not (tag in ("article", "h1", "p") and not words & PLAIN_NOISE):
        named = bool(words & NOISE) or "header" in words and not article
        out |= found.get("role", "").lower() in ROLES
    if tag not in ("html", "body"):
        style = found.get("style", "").replace(" ", "").lower()
        out |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style
    return ".".join([tag, *sorted(found.get("class", "").split())]), out, named


class Page:
    """Elements of one page, each after its parent, and the text runs in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.shape = [0], [""], [0], [0]
        #: No content by HTML itself, or within such; a class word speaks against it; 2 within an
        #: article, 1 within main; the block that the element belongs to.
        self.out, self.named, self.level, self.home = [False], [False], [0], [0]
        self.runs: list[tuple[int, str]] = []
        self._parse(source)

    def _add(self, top: int, tag: str, attributes: str, siblings: dict[tuple[int, str], int]) -> int:
        name, out, named = _about(tag, attributes, self.level[top] == 2)
        if tag in NUMBERED:
            number = siblings[top, name] = siblings.get((top, name), 0) + 1
            name = f"{name}#{number}"
        self.shape[top] = _hash(name, self.shape[top])
        if tag in VOID or tag in RAW:
            return -1
        self.parent.append(top)
        self.tag.append(tag)
        self.path.append(_hash(name, self.path[top]))
        self.shape.append(0)
        self.out.append(self.out[top] or out)
        self.named.append(named)
        self.level.append(max(self.level[top], LEVELS.get(tag, 0)))
        self.home.append(len(self.home) if tag in BLOCK else self.home[top])
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        stack, open_, siblings, at = [0], {}, {}, 0

        def close(k: int) -> None:
            for e in stack[k:]:
                open_[self.tag[e]] -= 1
            del stack[k:]

        def text(upto: int) -> None:
            if upto > at and not self.out[stack[-1]]:
                self.runs.append((stack[-1], html.unescape(source[at:upto])))

        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue
            text(m.start())
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if tag in BLOCK:
                self.runs.append((BREAK, "\n"))
            if m[1] or m[4]:
                if open_.get(tag):
                    close(next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag))
                continue
            closes = CLOSES.get(tag, set()) | ({"p", "head"} if tag in BLOCK and tag != "br" else {"head"} if tag == "br" else set())
            if any(open_.get(x) for x in closes):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in closes:
                        close(k)
                        break
                    if self.tag[stack[k]] in FENCE:
                        break
            attributes = m[3] or m[6] or ""
            element = self._add(stack[-1], tag, attributes, siblings)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif element >= 0 and not (attributes.endswith("/") and tag in ("svg", "path")):
                stack.append(element)
                open_[tag] = open_.get(tag, 0) + 1
        text(len(source))

    def own_text(self) -> str:
        """The page's text outside branches that a class word speaks against."""
        marked = [False] * len(self.parent)
        for e in range(1, len(marked)):
            marked[e] = marked[self.parent[e]] or self.named[e]
        return _clean([said for element, said in self.runs if element == BREAK or not marked[element]])

    def nodes(self) -> tuple[dict[int, int], dict[int, int]]:
        """Of each style node: a hash of the child sequences of its elements, and one of their text."""
        shapes: dict[int, int] = {}
        for e, shape in enumerate(self.shape):
            if shape and not self.out[e]:
                shapes[self.path[e]] = _hash(str(shape), shapes.get(self.path[e], 0))
        said: dict[int, list[str]] = {}
        for element, words in self.runs:
            if element != BREAK:
                said.setdefault(self.path[self.home[element]], []).append(words)
        texts = {path: _clean(words) for path, words in said.items()}
        return shapes, {path: _hash(t) for path, t in texts.items() if t}


Importance = dict[int, tuple[float, float]]


def _clean(runs: list[str]) -> str:
    return " ".join("".join(runs).split())


def _upwards(page: Page, own: list[float]) -> list[float]:
    """Sums over branches: an element's own number and those of all below it."""
    out = list(own)
    for e in range(len(out) - 1, 0, -1):
        out[page.parent[e]] += out[e]
    return out


def main_text(source: str, tree: Importance | None = None) -> str:
    """Kept text of one page; ``tree``: presentation and content importance of the host's style nodes
    by path, 1 for those that it lacks."""
    page, tree = Page(source), tree or {}
    whole = (1.0, 1.0)
    n = len(page.parent)
    size, seen, inner, shapes = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for element, said in page.runs:
        if element != BREAK:
            size[element] += len(said) - said.count(" ")
    content = [tree.get(page.path[page.home[e]], whole)[1] for e in range(n)]
    # What class words and an article elsewhere leave of it.
    raw = _upwards(page, [a * b for a, b in zip(size, content, strict=True)])
    factor = [1.0] * n
    for e in range(1, n):
        believed = page.named[e] and raw[e] <= BELIEF * raw[0]
        factor[e] = factor[page.parent[e]] * (NAMED if believed else 1.0)
    held = [0.0, 0.0, 0.0]
    for e in range(n):
        if factor[e] == 1.0:
            held[page.level[e]] += size[e] * content[e]
    total = sum(held) or 1.0
    beside = (1 - (held[1] + held[2]) / total, 1 - held[2] / total, 1.0)
    own = [content[e] * factor[e] * beside[page.level[e]] for e in range(n)]
    # Composite importance of every branch, and the important text in it.
    mass = _upwards(page, [a * b for a, b in zip(size, own, strict=True)])
    good = _upwards(page, [size[e] * own[e] if own[e] >= LOW else 0.0 for e in range(n)])
    size = _upwards(page, size)
    for e in range(n):
        if page.shape[e]:
            seen[e], shapes[e] = 1.0, tree.get(page.path[e], whole)[0] * factor[e] * beside[page.level[e]]
    seen, shapes = _upwards(page, seen), _upwards(page, shapes)
    gone = [False] * n
    for e in range(n):
        inner[e] = mass[e] / size[e] if size[e] else 0.0
        shown = shapes[e] / seen[e] if seen[e] else inner[e]
        low = CONTENT * inner[e] + (1 - CONTENT) * shown < LOW and good[e] < KEEP * good[0]
        gone[e] = gone[page.parent[e]] or (low and e > 0)
    return _clean([said if element == BREAK or not gone[element] and own[element] >= LOW else "" for element, said in page.runs])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page, style node and kind: the hash of what the page shows or says there.  ``main``
    names the page by its own text."""
    for batch in batches:
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            page = Page(source.as_py() or "")
            shapes, said = page.nodes()
            paths, values = [*shapes, *said], [*shapes.values(), *said.values()]
            kinds = np.repeat(np.array([SHAPE, SAID], dtype=np.int32), [len(shapes), len(said)])
            main = _hash(page.own_text()) - (1 << 63)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(paths), host)), _signed(paths), pa.array(np.full(len(paths), main)), pa.array(kinds), _signed(values)], ["host", "path", "main", "kind", "value"]
            )


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; '' for null and whatever has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, shape, content) of the merged style trees: hashes of host and path, and the
    importances, for all nodes that several pages have and that are not of full importance.

    The entropy of a node with shares p over its m different pages is -sum(p log p) / log m; the
    importance is 1 - (1 - entropy) * m / (m + 2)."""
    rows = pages.select(F.xxhash64(host_of(F.col("url"))).alias("host"), "html")
    nodes = rows.mapInArrow(_node_batches, "host long, path long, main long, kind int, value long").distinct()
    counts = nodes.groupBy("host", "path", "kind", "value").count()
    m = F.sum("count").cast("double")
    entropy = (F.log(m) - F.sum(F.col("count") * F.log("count")) / m) / F.log(m)
    imp = F.when(m > 1, 1 - (1 - entropy) * m / (m + PRIOR_PAGES)).otherwise(1.0)
    by = counts.groupBy("host", "path", "kind").agg(imp.alias("imp")).filter(F.col("imp") <= WHOLE)
    one = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("imp"))), F.lit(1.0)).cast("float")
    return by.groupBy("host", "path").agg(one(SHAPE).alias("shape"), one(SAID).alias("content"))


def _by_host(tree: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    rows = tree.toPandas().sort_values("host", kind="stable")
    if rows.empty:
        return {}
    hosts, at = np.unique(rows["host"].to_numpy(), return_index=True)
    columns = [rows[c].to_numpy() for c in ("path", "shape", "content")]
    return {int(h): tuple(c[a:b] for c in columns) for h, a, b in zip(hosts, at, [*at[1:], len(rows)], strict=True)}


def _importance(paths, shapes, contents) -> Importance:
    unsigned = np.asarray(paths, dtype=np.int64).view(np.uint64).tolist()
    return dict(zip(unsigned, zip(np.asarray(shapes).tolist(), np.asarray(contents).tolist(), strict=True), strict=True))


def _text_batches(batches: Iterator[pa.RecordBatch], tree_of: Callable[[pa.RecordBatch, int], Importance]) -> Iterator[pa.RecordBatch]:
    last: tuple[int | None, Importance] = (None, {})
    for batch in batches:
        kept = []
        for i, (host, source) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"), strict=True)):
            if host != last[0]:
                last = (host, tree_of(batch, i))
            kept.append(main_text(source.as_py() or "", last[1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(kept, pa.string()), pa.array([len(t) for t in kept], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html).

    Null or empty html gives empty text; null urls and urls without a host are one host; a host's few
    pages say little about importance, which stays near 1, so there tags and class words decide; an
    importance of just the bound stays; repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.  Character references are decoded, white space
    inside a block becomes one space, blocks are joined by one space; nothing is capped.  A page is
    held whole in a task, several times its size as elements.

    The style tree goes to all executors if its entries are at most ``small_bytes`` together; a
    larger one is joined by host."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(host_of(F.col("url"))).alias("host"))
    tree = stash(style_tree(pages))
    if tree.count() * ENTRY_BYTES <= small_bytes:
        shared = pages.sparkSession.sparkContext.broadcast(_by_host(tree))

        def sent(batch: pa.RecordBatch, i: int) -> Importance:
            found = shared.value.get(batch.column("host")[i].as_py())
            return _importance(*found) if found else {}

        return rows.mapInArrow(lambda b: _text_batches(b, sent), EXTRACTED)

    def joined(batch: pa.RecordBatch, i: int) -> Importance:
        found = batch.column("tree")[i].as_py() or ()
        return _importance([x["path"] for x in found], [x["shape"] for x in found], [x["content"] for x in found])

    lists = tree.groupBy("host").agg(F.collect_list(F.struct("path", "shape", "content")).alias("tree"))
    return rows.join(lists, "host", "left").mapInArrow(lambda b: _text_batches(b, joined), EXTRACTED)
