"""The page sources as table functions, for queries in SQL.

    register(spark)
    spark.sql("SELECT * FROM html_nodes(TABLE(SELECT page_id, url, html FROM pages) PARTITION BY page_id)")

``html_nodes`` and ``data_islands`` take a table of pages (page_id, url, html), best partitioned by page; rows come out as those of
the functions of ``html`` of the same names. Equal rows within a partition are one page. Defined results beyond those of
``html``: the arguments are found by name, in any order, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from brookloom.sources.html import NODE_SCHEMA, distinct_islands, node_rows


def _key(page_id: int | None, url: str | None, html: str | None) -> str:
    """What ``html.keyed`` gives a page."""
    sign = lambda x: "-" if x is None else f"={x}"
    return hashlib.md5("\0".join(map(sign, (page_id, url, html))).encode()).hexdigest()


class _Pages:
    def __init__(self):
        self.seen: set[str] = set()

    def page(self, row: Row) -> tuple | None:
        """key, page_id, url and html of a row that no equal one came before."""
        held = row.asDict()
        page_id, url, html = (held.get(c) for c in ("page_id", "url", "html"))
        key = _key(page_id, url, html)
        if key in self.seen:
            return None
        self.seen.add(key)
        return key, page_id, url, html or ""


class _Nodes(_Pages):
    def eval(self, row: Row) -> Iterator[tuple]:
        if found := self.page(row):
            key, page_id, url, html = found
            for pos, sub_end, parent, depth, tag, nth, parent_tag, children, attrs, own, *rest in node_rows(html):
                yield key, page_id, url, pos, sub_end, parent, depth, tag, nth, parent_tag, children, dict(attrs), [(o["nth"], o["text"]) for o in own], *rest


class _Islands(_Pages):
    def eval(self, row: Row) -> Iterator[tuple]:
        if found := self.page(row):
            for i, text in enumerate(distinct_islands(found[3])):
                yield found[0], found[1], i + 1, text


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session."""
    spark.udtf.register("html_nodes", udtf(_Nodes, returnType=NODE_SCHEMA))
    spark.udtf.register("data_islands", udtf(_Islands, returnType="page_key string, page_id bigint, position int, text string"))
