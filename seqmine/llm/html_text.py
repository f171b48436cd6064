"""Main text of web pages by paths that the pages of a host agree on.

First each page scores its own containers.  A container's path is generalised: the tags with their classes from the body
down, digits in class names made equal, without positions.  A container's score is its text outside links, less a
share for linked text; ``article``, ``main`` and boxes named as content count more, and other boxes count only if they hold a
block of their own, so plain wrappers lose against what they wrap and a title or lead beside an inner box is not lost.  Every page
votes for its best path, of equal ones for the smallest.  Votes are added up per host in Spark; a host's winners are the path with most
votes (of equal ones the greatest) and every path with two votes and a tenth of all, and its pages are read again with that winner that scores best on the page.
A page on which no winner holds text, and a page without a host, uses its own best path.

Names such as ``sidebar`` mark furniture, but never a box around the page's ``main`` or largest ``article``, nor, without
those, around most of its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import sha1
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmine.llm.storage import small_side, written

# Element names and roles of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
UNSEEN = frozenset("noscript template svg select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
BOXES = frozenset("article main div td body".split())
ASIDE = frozenset("nav header footer aside form button menu dialog".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
                   "nav ol p pre section table ul".split())
NOISE = re.compile(r"(?:^|[-_\s])(?:ad|ads|advert\w*|banner|promo\w*|sponsor\w*|sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|masthead|"
                   r"comments?|respond|replies|disqus|notice\w*|cookies?|consent|popup|modal|newsletter|subscribe|social|share\w*|"
                   r"related|widget|login|signup|search|skip\w*)(?:$|[-_\s])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
#: Words that mark a box even around other boxes, and those that mark an article.
FIRM = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|promo\w*|sponsor\w*|comments?|respond|replies|disqus|related|cookies?|consent|popup|modal|"
                  r"newsletter|subscribe|login|signup)(?:$|[-_\s])", re.I)
NO_ARTICLE = re.compile(r"(?:^|\s)(?:comment|reply|replies|respond|related|ads?)(?:$|[-_\s])", re.I)
#: Names that speak of furniture elsewhere.
ABOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|hide|show)[-_]\S+", re.I)
CONTENT = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story)(?:[-_](?:body|content|text))?|content|main)(?:$|\s)", re.I)

#: Weights of containers, the share of a host's votes that makes a path a winner, and of a page's text that lifts a mark.
SEMANTIC, NAMED, PLAIN = 3.0, 2.0, 1.0
WINNER_SHARE = 0.1
MOST = 0.6
PATH_CHARS = 400

_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I | re.A) for tag in RAW}


class Node:
    """An element that can hold text; ``parts`` has strings, ``None`` for a block border, and nodes in page order.

    ``aside`` marks page furniture; ``named`` says that only its names do, ``firm`` that they do so around anything.
    """

    __slots__ = ("tag", "path", "aside", "named", "firm", "link", "weight", "parts")

    def __init__(self, tag: str, path: str, link: bool):
        self.tag, self.path, self.link = tag, path, link
        self.aside = self.named = self.firm = False
        self.weight = SEMANTIC if tag in ("article", "main") else PLAIN
        self.parts: list = []

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def _node(tag: str, attributes: str, above: Node) -> Node:
    """The element below ``above`` with its step of a path and what its names or role say of it."""
    # Paths of very deep elements are shortened, so a page's paths stay in proportion to its elements.
    start = above.path if len(above.path) < PATH_CHARS else sha1(above.path.encode("utf-8", "surrogatepass")).hexdigest()
    node = Node(tag, f"{start}/{tag}", above.link or tag == "a")
    node.aside = tag in ASIDE or tag in UNSEEN
    if "=" not in attributes and "hidden" not in attributes:
        return node
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    node.path = ".".join([node.path, *sorted(re.sub(r"\d+", "0", c) for c in found.get("class", "").lower().split())])
    names = ABOUT.sub("", f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}")
    if node.aside or "hidden" in found or found.get("aria-hidden") == "true":
        node.aside = True
    elif tag not in ("html", "body", "main"):
        node.aside = node.named = bool((NO_ARTICLE if tag == "article" else NOISE).search(names))
        node.firm = node.named and bool(FIRM.search(names))
    if found.get("role") == "main":
        node.weight = SEMANTIC
    elif tag in BOXES and node.weight == PLAIN and CONTENT.search(names):
        node.weight = NAMED
    return node


def parse(html: str) -> Node:
    """A tree of elements that is as forgiving as browsers are about missing end tags.

    Text of an unseen element (``noscript``, ``template``, ``svg``, ``select``) without an end tag belongs to the page.
    """
    root = Node("", "", False)
    stack, at = [root], 0
    search = _TOKEN.search

    def close(k: int) -> None:
        for node in stack[k:]:
            if node.tag in UNSEEN:
                node.aside = False
        del stack[k:]

    while m := search(html, at):
        if m.start() > at:
            stack[-1].parts.append(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE and tag != "a":
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k + 1)
                    stack.pop()
                    break
                if tag in ("p", "li", "a") and (stack[k].tag in BOXES or stack[k].tag == "section" or stack[k].tag in UNSEEN):
                    break
            if tag not in INLINE:
                stack[-1].parts.append(None)
            continue
        if tag in RAW:  # nothing in it is text of the page
            if not m[3].endswith("/"):
                end = _END[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in VOID:
            stack[-1].parts.append(" " if tag == "br" else None if tag == "hr" else "")
            continue
        if tag in INLINE and tag != "a" or tag in UNSEEN and m[3].endswith("/"):
            continue
        if tag in ENDS_P and stack[-1].tag == "p" or tag == stack[-1].tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option", "a"):
            stack.pop()
        if tag not in INLINE:
            stack[-1].parts.append(None)
        node = _node(tag, m[3], stack[-1])
        stack[-1].parts.append(node)
        stack.append(node)
    if at < len(html):
        stack[-1].parts.append(html[at:])
    close(1)
    _lift(root)
    return root


def _own(node: Node) -> int:
    return sum(len(p) for p in node.parts if isinstance(p, str) and not p.isspace())


def _lift(root: Node) -> None:
    """Takes marks by name off boxes that hold the page's main element, its largest article or, without those, most of its text."""
    nodes, up, firm = [root], [-1], [False]
    for k, node in enumerate(nodes):
        for below in node.children():
            if not below.aside or below.named:
                nodes.append(below)
                up.append(k)
                firm.append(firm[k] or below.firm)
    if not any(node.named for node in nodes):
        return
    size = [_own(node) for node in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        size[up[k]] += size[k]
    usable = [k for k, node in enumerate(nodes) if size[k] and not firm[k] and not node.named and node.weight == SEMANTIC]
    best = [k for k in usable if nodes[k].tag == "main"] + sorted((k for k in usable if nodes[k].tag != "main"), key=lambda k: (-size[k], k))[:1]
    for k in best:
        while k > 0:
            nodes[k].aside = nodes[k].named = False
            k = up[k]
    if best:
        return
    page = size[0] - sum(size[k] for k in range(1, len(nodes)) if nodes[k].firm and not firm[up[k]])
    for k, node in enumerate(nodes):
        blocks = sum(below.tag in BOXES or below.tag in ENDS_P for below in node.children())
        if node.named and not firm[k] and blocks >= 2 and size[k] > MOST * page:
            node.aside = node.named = False


def text_of(node: Node) -> str:
    """Blocks below ``node``, without page furniture, each with single spaces, joined by one space."""
    blocks, block = [], []

    def close() -> None:
        text = " ".join(unescape("".join(block)).split())
        if text:
            blocks.append(text)
        block.clear()

    todo = [iter(node.parts)]
    while todo:
        for part in todo[-1]:
            if part is None:
                close()
            elif isinstance(part, str):
                block.append(part)
            elif not part.aside:
                todo.append(iter(part.parts))
                break
        else:
            todo.pop()
    close()
    return " ".join(blocks)


def scores(root: Node) -> dict[str, float]:
    """Score of each container path of a page; containers with one path add up."""
    found: dict[str, float] = {}
    order = [root]
    for node in order:
        order += [p for p in node.children() if not p.aside]
    total: dict[int, float] = {}
    adds: dict[int, bool] = {}
    for node in reversed(order):
        own = _own(node)
        below = [p for p in node.children() if not p.aside]
        total[id(node)] = (-0.5 * own if node.link else own) + sum(total[id(p)] for p in below)
        # Whether it holds text outside links that no inner box holds.
        adds[id(node)] = own > 0 and not node.link or any(adds[id(p)] for p in below if p.tag not in BOXES)
        if node.tag in BOXES and total[id(node)] > 0 and (node.weight > PLAIN or adds[id(node)]):
            found[node.path] = found.get(node.path, 0.0) + node.weight * total[id(node)]
    return found


def best_path(page: dict[str, float]) -> str | None:
    return min(page, key=lambda p: (-page[p], p)) if page else None


def at_path(root: Node, path: str) -> list[Node]:
    """Nodes with the path, in page order, none inside another or inside page furniture."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.path == path:
            found.append(node)
            continue
        todo += [p for p in reversed(node.children()) if not p.aside]
    return found


def extract_page(html: str | None, paths: Sequence[str] | None) -> str:
    """The page's text under that of the host's paths that scores best here, or under its own best one if they hold none."""
    if not html:
        return ""
    root = parse(html)
    page = scores(root)
    own = best_path(page)
    for path in [*sorted(paths or (), key=lambda p: (-page.get(p, 0.0), p)), *([own] if own else [])]:
        text = " ".join(t for t in map(text_of, at_path(root, path)) if t)
        if text:
            return text
    return text_of(root)


def host_of(url: str):
    """Host of a url in lower case; null without ``://``."""
    return F.expr(f"nullif(lower(regexp_extract({url}, '^[^:]*://([^/?#]*)', 1)), '')")


def host_paths(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """One row per host: ``host`` and the winning ``paths``, at most ``1 / WINNER_SHARE`` and one.  Pages without a host do not vote.

    Pages are reduced to (host, path, weight) in their tasks; sums combine before the shuffle, so a host with a third of
    all pages costs a few rows per task.
    """
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[str, str], int] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                path = best_path(scores(parse(html))) if html else None
                if path is not None:
                    out[host, path] = out.get((host, path), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()),
                 pa.array(list(out.values()), pa.int64())], ["host", "path", "votes"])

    rows = pages.select(host_of(url).alias("host"), F.col(body).cast("string").alias("html")).where("host is not null")
    votes = rows.mapInArrow(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    votes = written(votes, "host-votes")
    most = votes.groupBy("host").agg(F.sum("votes").alias("all"), F.max(F.struct("votes", "path"))["path"].alias("first"))
    winners = votes.join(most, "host").where((F.col("votes") >= F.greatest(F.lit(2), WINNER_SHARE * F.col("all"))) | (F.col("path") == F.col("first")))
    return winners.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One row per page: key, url, ``text``, ``n_chars`` (code points).

    A null or empty body gives an empty text; a null url takes the page's own best path; a null key is kept; repeated rows come out
    repeatedly; a very long or deeply nested page is read whole, in memory in proportion to it; an empty table gives no rows; other columns are not read.  The hosts' winners are written and counted; up to a
    fixed number of them they are broadcast, beyond it rows and winners meet by host in a shuffle that adaptive
    execution splits for frequent hosts.
    """
    winners = small_side(written(host_paths(pages, url, body), "host-paths"))
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(body).cast("string").alias("html"),
                        host_of(url).alias("host")).join(winners, "host", "left").select("k", "u", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_page(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("u"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [key, "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"{key} {kind}, url string, text string, n_chars long")
