"""Laid-out text: spans to lines, lines to paragraphs. Both are folds whose state is the line or paragraph so far.

A page is one group: neither lines nor paragraphs cross a page's border. Rows are dealt by page, sorted, and streamed
through a task a page at a time, so a task holds one page, and both folds of a page are one pass.

Defined results: null texts, blank ones and boxes without area don't count; repeated spans stand twice in their line;
null ids and pages are groups of their own; of equal places the order of the texts decides; no spans, no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.functions.text import pixels

#: Fixed values, in pixels and line heights.
LINE_TOLERANCE, PARAGRAPH_GAP, INDENT, MIN_LINE = 3.0, 1.5, 30.0, 2
_END = re.compile(r"[.!?。！？]\s*$")
BOX = ["left", "top", "right", "bottom"]
SCHEMA = "doc_id long, page int, no long, text string, left double, top double, right double, bottom double, n long"


def group_lines(spans: list[tuple]) -> list[tuple]:
    """(text, left, top, right, bottom, spans) of lines from (layer, left, top, right, bottom, text): a line is the spans
    of a layer within LINE_TOLERANCE of its first span's top, in order of left."""
    groups: list[list[tuple]] = []
    layer = top = None
    for s in sorted(spans, key=itemgetter(0, 2)):
        if not groups or s[0] != layer or abs(s[2] - top) > LINE_TOLERANCE:
            groups.append([])
            layer, top = s[0], s[2]
        groups[-1].append(s)
    out = []
    for g in groups:
        g.sort(key=itemgetter(1))
        _, left, tops, right, bottom, texts = zip(*g, strict=True)
        text = " ".join(" ".join(texts).split())
        if len(text) >= MIN_LINE:
            out.append((text, left[0], min(tops), max(right), max(bottom), len(g)))
    return sorted(out, key=itemgetter(2))


def group_paragraphs(lines: list[tuple]) -> list[tuple]:
    """(text, left, top, right, bottom, lines): a wide gap, a change of indent or a sentence's end begins a new one."""
    groups: list[list[tuple]] = []
    for line in lines:
        if groups:
            g = groups[-1]
            height = sum(x[4] - x[2] for x in g) / len(g)
            same = line[2] - g[-1][4] <= height * PARAGRAPH_GAP and abs(line[1] - min(x[1] for x in g)) <= INDENT and not _END.search(g[-1][0])
            if same:
                g.append(line)
                continue
        groups.append([line])
    return [(" ".join(x[0] for x in g), min(x[1] for x in g), g[0][2], max(x[3] for x in g), g[-1][4], len(g)) for g in groups]


def _values(column: pa.Array) -> list:
    """A column as Python values; whole columns by way of an array, which takes a fraction of the time."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _by_page(rows: DataFrame, order: list[str], columns: list[str], fold: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """SCHEMA rows of ``fold`` on each page's ``columns``, sorted by ``order``."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), *[pa.float64()] * 4, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, out = None, []

        def flush() -> None:
            out.extend((*key, i + 1, *x) for i, x in enumerate(fold(held)))

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*map(_values, batch.columns), strict=True):
                if held and row[:2] != key:
                    flush()
                    held.clear()
                    if len(out) >= 10_000:
                        yield ready()
                        out.clear()
                key = row[:2]
                held.append(row[2:])
        if held:
            flush()
        if out:
            yield ready()

    own = rows.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), *columns)
    return own.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", *order).mapInArrow(run, SCHEMA)


def relative_boxes(spans: DataFrame) -> DataFrame:
    """Spans whose boxes count from their page's corner (layer_left, layer_top), with a font size, 14 pixels by default."""
    size = F.coalesce(F.nullif(pixels(F.col("font_size")), F.lit(0.0)), F.lit(14.0))
    moved = {k: F.col(k) - F.col("layer_left" if k in ("left", "right") else "layer_top") for k in BOX}
    return spans.withColumns({**moved, "font_size": size}).drop("layer_left", "layer_top")


def _spans(spans: DataFrame) -> DataFrame:
    return spans.withColumn("text", F.trim("text")).where("text != '' and right > left and bottom > top")


def lines(spans: DataFrame) -> DataFrame:
    """Lines of (doc_id, page, layer, left, top, right, bottom, text); ``n`` counts spans."""
    return _by_page(_spans(spans), ["layer", "top", "left", "text"], ["layer", *BOX, "text"], group_lines)


def paragraphs(line_rows: DataFrame) -> DataFrame:
    """Paragraphs of lines, each page by itself; ``n`` counts lines."""
    return _by_page(line_rows, ["no"], ["text", *BOX, "n"], group_paragraphs)


def paragraphs_of(spans: DataFrame) -> DataFrame:
    """The paragraphs of spans, in one pass."""
    return _by_page(_spans(spans), ["layer", "top", "left", "text"], ["layer", *BOX, "text"], lambda rows: group_paragraphs(group_lines(rows)))


def overlay_boxes(paragraph_rows: DataFrame, page_width: float) -> DataFrame:
    """Where a paragraph's translation goes: below it, and at least 100 pixels wide."""
    return paragraph_rows.select("doc_id", "page", "no", (F.col("bottom") + 2).alias("box_top"), F.col("left").alias("box_left"), F.greatest(F.lit(100.0), F.lit(page_width) - F.col("left")).alias("max_width"))
