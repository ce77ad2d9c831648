"""Raw pages as a node table, and texts in their JSON data islands.

Parsing is the one step that needs Python: a page becomes rows in document order, and everything after is columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, and elements that end an open one of the set, as the HTML standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: How deep elements nest in a browser; deeper ones stand beside each other there. Fixed value.
MAX_DEPTH = 512
#: A node longer than this, trimmed, carries no text of its own copy, unless it is an outermost heading: no block is that long.
LONGEST_TEXT = 4096
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NODE_SCHEMA = (
    "page_key string, page_id long, url string, pos int, sub_end int, parent int, depth int, tag string, same_tag_index int, parent_tag string, "
    "child_tags array<string>, attrs map<string,string>, own array<struct<nth:int,text:string>>, direct_text boolean, child_text boolean, text string, "
    "length int, whole int, xpath string, links int, link_text int"
)
#: Nodes that a task hands on at a time.
BATCH_NODES = 4096


def _units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2


class _Tree(HTMLParser):
    """The elements of a page. Each piece of text stands once in ``pieces``; an element's are those from ``first`` to ``last``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.pieces: list[str] = []
        self.links = self.link_text = 0  # so far, so that a node's are a difference

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"button", "table"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if len(self.open) >= MAX_DEPTH:
            self._end(MAX_DEPTH - 1)
        up, at = self.open[-1] if self.open else None, len(self.pieces)
        node = {"pos": len(self.nodes), "sub_end": len(self.nodes), "up": up, "depth": len(self.open), "tag": tag, "attrs": {k: v or "" for k, v in reversed(attrs)}, "kids": [], "own": [], "first": at, "last": at, "of_tag": {}}
        same = up["of_tag"] if up else {}
        same[tag] = node["index"] = same.get(tag, 0) + 1
        node["xpath"] = f"{up['xpath'] if up else ''}/{tag}[{node['index']}]"
        self.links += tag == "a"
        node["links"], node["link_text"] = self.links, self.link_text
        self.nodes.append(node)
        if up:
            up["kids"].append(node)
        if tag in VOID:
            node["links"] = node["link_text"] = 0
        else:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1]["tag"] == tag:
            self.handle_endtag(tag)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """End the nearest open element of ``tags`` and what it holds, unless one of ``stop`` is nearer."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] in tags:
                self._end(k)
                return
            if self.open[k]["tag"] in stop:
                return

    def _end(self, k: int) -> None:
        for node in reversed(self.open[k:]):
            node["sub_end"], node["last"] = len(self.nodes) - 1, len(self.pieces)
            node["links"], node["link_text"] = self.links - node["links"], self.link_text - node["link_text"]
            if node["tag"] == "a":
                self.link_text += sum(_units(self.pieces[i]) for i in node["own"])
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                self._end(k)
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1]["own"].append(len(self.pieces))
            self.pieces.append(data)


#: Elements whose text is read as it stands, and ampersands outside of them that begin no reference with a semicolon.
_BARE = re.compile(rf"<({'|'.join(_Tree.CDATA_CONTENT_ELEMENTS)})\b.*?(?:</\1\s*>|\Z)|&(?!(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);)", re.I | re.S)


def _tree(html: str, bare: bool = True) -> _Tree:
    tree = _Tree()
    tree.feed(html if bare or "&" not in html else _BARE.sub(lambda m: m[0] if m[1] else "&amp;", html))
    tree.close()
    tree._end(0)
    return tree


def parse(html: str) -> list[dict]:
    """The elements of a page in document order, with the pieces of text of each (``own``) and of all below it (``parts``)."""
    tree = _tree(html)
    for n in tree.nodes:
        n["own"], n["parts"] = [tree.pieces[i] for i in n["own"]], tree.pieces[n["first"] : n["last"]]
    return tree.nodes


#: What a page's script takes off the ends of a text.
_ENDS = " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _lengths(pieces: list[str]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """UTF-16 units before each piece; for each piece the first and for each end the last piece that isn't blank; and the
    blanks at the start and end of each: what a node's length, trimmed or not, is found by without its text."""
    before, start, end = [0], [], []
    for x in pieces:
        before.append(before[-1] + _units(x))
        start.append(len(x) - len(x.lstrip(_ENDS)))
        end.append(len(x) - len(x.rstrip(_ENDS)))
    after, prior = [len(pieces)] * (len(pieces) + 1), [-1] * (len(pieces) + 1)
    for i in range(len(pieces) - 1, -1, -1):
        after[i] = i if start[i] < len(pieces[i]) else after[i + 1]
    for i, x in enumerate(pieces):
        prior[i + 1] = i if start[i] < len(x) else prior[i]
    return before, after, prior, start, end


def node_rows(html: str, bare: bool = True) -> Iterator[tuple]:
    """A page's nodes as NODE_SCHEMA has them, after page_key, page_id and url. ``bare``: as ``html_nodes`` has it."""
    tree = _tree(html, bare)
    pieces = tree.pieces
    before, after, prior, start, end = _lengths(pieces)
    in_heading = -1
    for n in tree.nodes:
        first, last, up = n["first"], n["last"], n["up"]
        whole, i, j = before[last] - before[first], after[first], prior[last]
        length = before[j + 1] - end[j] - before[i] - start[i] if i < last else 0
        outer = n["tag"] in HEADINGS and n["pos"] > in_heading
        if outer:
            in_heading = n["sub_end"]
        text = "".join(pieces[first:last]) if length <= LONGEST_TEXT or outer else None
        yield (
            n["pos"], n["sub_end"], up["pos"] if up else None, n["depth"], n["tag"], n["index"], up["tag"] if up else None, [k["tag"] for k in n["kids"]],
            list(n["attrs"].items()), [{"nth": i, "text": pieces[i]} for i in n["own"]], any(pieces[i].strip() for i in n["own"]),
            any(after[k["first"]] < k["last"] for k in n["kids"]), text, length, whole, n["xpath"], n["links"], n["link_text"],
        )


def keyed(pages: DataFrame) -> DataFrame:
    """page_key, page_id, url and html. Rows that differ in any of the three have keys of their own, whatever their ids;
    equal rows have equal keys."""
    page_id, url, html = F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    sign = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return pages.select(F.md5(F.concat(sign(page_id), F.lit("\0"), sign(url), F.lit("\0"), sign(html))).alias("page_key"), page_id.alias("page_id"), url.alias("url"), html.alias("html"))


def html_nodes(pages: DataFrame, bare: bool = True) -> DataFrame:
    """NODE_SCHEMA rows of every page, and ``own_text``: ``sub_end`` is the last position below a node, so ancestors are ranges.

    ``links`` counts the links below a node and ``link_text`` the length of their own texts; ``whole`` is the length of all
    text below it, ``length`` that without blanks at its ends. ``text`` is null where ``length`` is over LONGEST_TEXT, so that what
    a page makes stays in proportion to it. ``own`` holds a node's own pieces of text with their places among the page's.
    A null or empty page has no nodes. ``page_key`` tells pages apart, whatever their ids; equal rows are one page. Rows are
    dealt by page, as all that follows asks for.

    ``bare``: a character reference that lacks its semicolon, as of a text cut short, counts as one where a browser reads it so
    (``&amp`` is an ampersand); else it is text as it stands.
    """
    names = [re.match(r"\w+", x.strip())[0] for x in re.split(r", (?=\w+ )", NODE_SCHEMA)]
    piece = pa.list_(pa.struct([("nth", pa.int32()), ("text", pa.string())]))
    kinds = [
        pa.string(), pa.int64(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), piece,
        pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for key, page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(key, page_id, url, *r) for r in node_rows(html or "", bare)]
                if len(rows) >= BATCH_NODES:
                    yield made()
                    rows = []
        if rows:
            yield made()

    own = pages if "page_key" in pages.columns else keyed(pages)
    once = own.groupBy("page_key").agg(F.any_value(F.struct("page_id", "url", "html")).alias("p")).select("page_key", "p.page_id", "p.url", "p.html")
    nodes = once.mapInArrow(run, NODE_SCHEMA).repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_key")
    return nodes.withColumn("own_text", F.array_join(F.transform("own", lambda x: x["text"]), " "))


def text_nodes(nodes: DataFrame) -> DataFrame:
    """page_key, nth, pos and text of every piece of text of the pages in document order; ``pos`` is of the node around it."""
    return nodes.select("page_key", "pos", F.explode("own").alias("o")).select("page_key", "o.nth", "pos", "o.text")


#: Fields of data islands that hold prose, and fields that never do; fixed values.
PROSE_FIELDS = frozenset("articlebody text content description body html markdown summary excerpt plaintext".split())
OTHER_FIELDS = frozenset("url href src image icon logo type @type @context id key name slug tag category author date published modified created updated locale lang language version site domain host path query method status code token csrf nonce".split())
MIN_ISLAND_TEXT = 50
_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.I | re.S)


def island_texts(value: object, field: str | None = None) -> Iterator[str]:
    """Texts of a JSON value in order: prose fields whole, others from MIN_ISLAND_TEXT characters on."""
    if isinstance(value, str):
        text = value.strip()
        name = (field or "").lower()
        if text and name not in OTHER_FIELDS and (name in PROSE_FIELDS or len(text) >= MIN_ISLAND_TEXT):
            yield text
    elif isinstance(value, list):
        for x in value:
            yield from island_texts(x, field)
    elif isinstance(value, dict):
        for k, x in value.items():
            yield from island_texts(x, k)


def distinct_islands(html: str) -> list[str]:
    """The distinct texts of a page's JSON scripts in order; scripts that aren't JSON are skipped."""
    seen: dict[str, None] = {}
    for attrs, body in _SCRIPT.findall(html):
        if re.search(r"application/json|__NEXT_DATA__|__NUXT_DATA__", attrs):
            try:
                seen.update(dict.fromkeys(island_texts(json.loads(body))))
            except ValueError:
                continue
    return list(seen)


def data_islands(pages: DataFrame) -> DataFrame:
    """page_key, page_id, position and text of each distinct text in a page's JSON scripts; what isn't JSON is skipped,
    and equal rows are one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, page_id, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(key, page_id, i + 1, t) for i, t in enumerate(distinct_islands(html or ""))]
            cols, kinds = list(zip(*rows, strict=True)) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["page_key", "page_id", "position", "text"])

    own = pages if "page_key" in pages.columns else keyed(pages if "url" in pages.columns else pages.withColumn("url", F.lit(None)))
    with_scripts = own.where(F.col("html").rlike("(?i)<script")).select("page_key", "page_id", "html")
    return with_scripts.mapInArrow(run, "page_key string, page_id long, position int, text string").dropDuplicates(["page_key", "position"])
