"""Main text of web pages by wrapper induction.

The DOM trees of one host's pages are aligned with a reference page of that host (the one with the least
id) by simple tree matching. An aligned node with the same text on both pages is template; a node with
other text, or without a partner, is a varying slot. The wrapper of a host is the path of the deepest
container that holds nearly all varying text of the host's pages outside of menus, adverts and the like.
Extraction follows the wrapper on every page, leaves out the texts that nearly all pages of the host show at
the same place, and renders the rest as blocks. Pages without the wrapper's path, and hosts with nothing to
compare, take the article, the main element or the body.

The reference page is one page per host; the votes come from all pages, summed before they are shuffled.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stockloom.llm.dom import BLOCKS, Node, blocks, match, parse
from stockloom.session import staged

NEARLY_ALL = 0.9
LEAST_PAGES = 4
# Elements that can be a slot for a whole article.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTAINERS = ("html", "body", "main", "article", "section", "div", "td", "center")


def host_of(url: str):
    """Host of a URL column in lower case, without user, port and a leading ``www.`` or ``m.``; null: empty."""
    authority = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(authority, r"^(www|m)\.", "")


@dataclass
class Placed:
    """A text-bearing or container node: key of its path, the next container above (place in the list), depth among containers."""

    node: Node
    path: int
    above: int
    depth: int
    container: bool


def placed(page: Node) -> list[Placed]:
    """Containers and nodes with text of their own outside of menus and the like, parents first. A path is known by a checksum of its labels."""
    out: list[Placed] = []
    todo: list[tuple[Node, int, int]] = [(page, 0, -1)]
    while todo:
        node, above_path, above = todo.pop()
        if node.dropped:
            continue
        path = zlib.crc32(node.label.encode("utf-8", "surrogatepass"), above_path)
        container = node.tag in CONTAINERS
        if container or node.text.strip():
            out.append(Placed(node, path, above, out[above].depth + container if above >= 0 else int(container), container))
            if container:
                above = len(out) - 1
        todo.extend((child, path, above) for child in node.children)
    return out


def _text_key(p: Placed) -> str:
    return f"={p.path}:{zlib.crc32(' '.join(p.node.text.split()).encode('utf-8', 'surrogatepass'))}"


def _can_be_template(node: Node) -> bool:
    """Blocks of their own can be; headings and phrases inside a block belong to what stands around them."""
    return node.tag in BLOCKS and node.tag not in HEADINGS


def _votes(page: Node, reference: Node) -> dict[str, int]:
    """Characters of varying text below each container path of a page ("depth/path"), and 1 for each text that its partner shows too."""
    partner = {id(y): x for x, y in match(reference, page)}
    nodes = placed(page)
    varying = [0] * len(nodes)
    votes: dict[str, int] = defaultdict(int)
    for k, p in enumerate(nodes):
        text = p.node.text.strip()
        if text:
            other = partner.get(id(p.node))
            if other is None or other.text.strip() != text:
                varying[k if p.container else p.above] += len(text)
            elif _can_be_template(p.node):
                votes[_text_key(p)] = 1
    for k in range(len(nodes) - 1, -1, -1):  # children come after their parents
        p = nodes[k]
        if p.container and varying[k]:
            votes[f"{p.depth}/{p.path}"] += varying[k]
            if p.above >= 0:
                varying[p.above] += varying[k]
    return votes


def _induce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Votes of each batch, summed by host and key; a host's reference is parsed once in a row of its pages. Key "" counts its other pages."""
    reference, source = Node("", ""), None
    for batch in batches:
        total: dict[tuple[str, str], int] = defaultdict(int)
        for host, page, ref in zip(batch["host"], batch["html"], batch["ref_html"]):
            if ref != source:
                reference, source = parse(ref), ref
            if page == ref:
                continue
            total[host, ""] += 1
            for path, chars in _votes(parse(page), reference).items():
                total[host, path] += chars
        yield pd.DataFrame([(h, p, c) for (h, p), c in total.items()], columns=["host", "path", "chars"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, path) of the hosts whose pages differ, from rows (page_id, host, html)."""
    first = pages.groupBy("host").agg(F.min("page_id").alias("_first")).withColumnRenamed("host", "_host")
    refs = pages.join(first, (F.col("page_id") == F.col("_first")) & (F.col("host") == F.col("_host")))
    # Rows that repeat the least id: the greatest page is the reference.
    refs = staged(refs.groupBy("_host").agg(F.max("html").alias("ref_html")), "references")
    aligned = pages.join(refs, F.col("host") == F.col("_host")).select("host", "html", "ref_html")
    votes = aligned.mapInPandas(_induce, "host string, path string, chars long").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    votes = staged(votes, "wrapper-votes")
    plain = votes.filter("path <> '' and path not like '=%'")
    whole = plain.groupBy(F.col("host").alias("_host")).agg(F.max("chars").alias("_all"))
    depth = F.split("path", "/")[0].cast("int")
    near = plain.join(whole, F.col("host") == F.col("_host")).filter(F.col("chars") >= F.col("_all") * NEARLY_ALL)
    best = near.groupBy("host").agg(F.max(F.struct(depth.alias("depth"), "chars", "path")).alias("w")).select(F.col("host").alias("_host"), F.col("w.path").alias("wrapper"))
    # What nearly all other pages of a host show at the same place is template; a reference page bounds their number.
    others = votes.filter("path = ''").select(F.col("host").alias("_other"), F.col("chars").alias("_pages")).filter(F.col("_pages") >= LEAST_PAGES)
    constant = votes.filter("path like '=%'").join(others, F.col("host") == F.col("_other")).filter(F.col("chars") >= F.col("_pages") * NEARLY_ALL)
    constant = constant.groupBy(F.col("host").alias("_constant_host")).agg(F.sort_array(F.collect_set("path")).alias("template"))
    return best.join(constant, F.col("_host") == F.col("_constant_host"), "left").drop("_constant_host")


def find_slots(nodes: list[Placed], page: Node, wrapper: str | None) -> list[Node]:
    """The nodes at the wrapper's path, else the first kind of usual content elements that the page has."""
    at_path = [p.node for p in nodes if p.container and wrapper == f"{p.depth}/{p.path}"]
    if at_path:
        return _in_page_order(at_path, page)
    for tag in ("article", "main", "body"):
        found = [p.node for p in nodes if p.node.tag == tag]
        if found:
            inner = {id(x) for outer in found for x in _below(outer) if x.tag == tag}
            return _in_page_order([x for x in found if id(x) not in inner], page)
    return [page]


def _in_page_order(nodes: list[Node], page: Node) -> list[Node]:
    if len(nodes) < 2:
        return nodes
    wanted, out, todo = {id(n) for n in nodes}, [], [page]
    while todo:
        node = todo.pop()
        if id(node) in wanted:
            out.append(node)
        todo.extend(reversed(node.children))
    return out


def _below(node: Node) -> Iterator[Node]:
    todo = list(node.children)
    while todo:
        x = todo.pop()
        yield x
        todo.extend(x.children)


def main_text(source: str | None, wrapper: str | None = None, template: Iterable[str] = ()) -> str:
    """The text of one page: blocks joined by two line feeds; empty if there is none.

    Texts in ``template`` are left out, unless they are most of what the page holds: then it is a copy of other pages.
    """
    page = parse(source)
    nodes = placed(page)
    slots = find_slots(nodes, page, wrapper)
    known = set(template)
    if known:
        constant = {id(p.node) for p in nodes if _can_be_template(p.node) and p.node.text.strip() and _text_key(p) in known}
        varying = blocks(slots, constant)
        if 2 * sum(map(len, varying)) >= sum(map(len, blocks(slots))):
            return "\n\n".join(varying)
    return "\n\n".join(blocks(slots))


@F.pandas_udf(StringType())
def _extract(sources: pd.Series, paths: pd.Series, templates: pd.Series) -> pd.Series:
    return pd.Series([main_text(s, p, () if t is None else t) for s, p, t in zip(sources, paths, templates)], dtype=object)


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, host and wrapper.

    Null html is an empty page with empty text. Pages without a URL are the pages of the empty host.
    Repeated rows get a row each. Only the named columns are read; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = staged(wrappers(rows), "wrappers")
    joined = rows.join(found, F.col("host") == F.col("_host"), "left")
    out = joined.select("page_id", "url", _extract("html", "wrapper", "template").alias("text"), "host", "wrapper")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host", "wrapper")
