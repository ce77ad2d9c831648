"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are the test items' word n-grams with the least document frequency over all documents, and all that few documents
hold. Where a document holds
a seed, the words around it are aligned with the item by Smith-Waterman over words, so edited and partly copied
passages score too: 1.0 is the whole item, a changed word costs its match and a penalty. Items go out in blocks of at
most ``BLOCK_ITEMS`` and ``BLOCK_BYTES``, known before they are sent; every block meets all documents where they lie, so
no text is shuffled, and documents are read twice for each block.

Words are runs of letters, digits and bytes beyond ASCII, lower-cased. Defined results: a null or empty text or item
matches nothing; an item of fewer than ``n`` words is one seed of its own length; repeated ids, texts and items are
each reported; ties between places go to the earliest; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.llm.common import map_batches, windows, word_hashes

N = 4
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def fold_words(column: pa.Array) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")).cast(pa.binary()).to_pylist()
    return [word_hashes(b.translate(FOLD).split()) for b in lowered]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of b's words in a: (score, start in a, end in a)."""
    m = len(a)
    h = np.zeros(m + 1, np.int64)
    start = np.arange(m + 1)
    best = (0, 0, 0)
    slope = np.arange(m + 1) * -GAP
    for w in b:
        diagonal = h[:-1] + np.where(a == w, MATCH, MISMATCH)
        up = h[1:] + GAP
        now = np.maximum(diagonal, up)
        begun = np.where(diagonal >= up, start[:-1], start[1:])
        fresh = now <= 0
        now[fresh] = 0
        begun[fresh] = np.arange(1, m + 1)[fresh]
        # A gap along the row: the running maximum of what stands before, less its distance.
        shifted = np.r_[0, now] + slope
        top = np.maximum.accumulate(shifted)
        from_left = (top - slope)[1:] > now
        if from_left.any():
            at = np.maximum.accumulate(np.where(shifted == top, np.arange(m + 1), 0))[1:]
            begun = np.where(from_left, np.r_[0, begun][at], begun)
            now = np.where(from_left, (top - slope)[1:], now)
        h, start = np.r_[0, now], np.r_[0, begun]
        k = int(np.argmax(h))
        if h[k] > best[0]:
            best = (int(h[k]), int(start[k]), k)
    return best


@dataclass
class SeedBlock:
    """Items of one block and their seeds, sorted by hash; ``seed_of`` and ``place`` say whose and where each is."""

    item_ids: list
    words: list[np.ndarray]
    hashes: dict[int, np.ndarray]
    item: dict[int, np.ndarray]
    place: dict[int, np.ndarray]

    @staticmethod
    def of(rows: list[tuple], n: int) -> SeedBlock:
        words = fold_words(pa.array([t for _, t in rows], pa.string()))
        found: dict[int, list] = {}
        for i, w in enumerate(words):
            k = min(n, len(w))
            if k:
                h = windows(w, k)
                found.setdefault(k, []).append((h, np.full(len(h), i), np.arange(len(h))))
        hashes, item, place = {}, {}, {}
        for k, parts in found.items():
            h, i, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            hashes[k], item[k], place[k] = h[order], i[order], p[order]
        return SeedBlock([d for d, _ in rows], words, hashes, item, place)

    def keep(self, frequency: dict[int, np.ndarray], n_docs: int, share: float, rare: float, few: int) -> SeedBlock:
        """Seeds in at most ``rare`` of all documents or ``few`` of them, and of each item its rarest ``share`` in any case."""
        hashes, item, place = {}, {}, {}
        for k, h in self.hashes.items():
            f = frequency[k]
            order = np.lexsort((self.place[k], f, self.item[k]))
            first = np.r_[True, np.diff(self.item[k][order]) != 0]
            start = np.flatnonzero(first)
            size = np.diff(np.r_[start, len(order)])
            rank = np.arange(len(order)) - np.repeat(start, size)
            chosen = np.zeros(len(h), bool)
            chosen[order] = rank < np.ceil(share * np.repeat(size, size))
            chosen |= f <= max(few, rare * n_docs)
            hashes[k], item[k], place[k] = h[chosen], self.item[k][chosen], self.place[k][chosen]
        return SeedBlock(self.item_ids, self.words, hashes, item, place)

    def hits(self, k: int, doc: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the document, place among the seeds) of every window of k words that is a seed."""
        h = windows(doc, k)
        at = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at, at
        own = self.hashes[k]
        lo, hi = np.searchsorted(own, h[at], "left"), np.searchsorted(own, h[at], "right")
        n = hi - lo
        if not n.any():
            return at[:0], at[:0]
        first = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)
        return np.repeat(at, n), first + np.arange(n.sum())

    def bits(self) -> dict[int, np.ndarray]:
        """For each seed length, which 20-bit heads of hashes occur: most windows are settled by it."""
        out = {}
        for k, h in self.hashes.items():
            out[k] = np.zeros(1 << 20, bool)
            out[k][(h >> np.uint64(44)).astype(np.int64)] = True
        return out

    def leaks(self, doc: np.ndarray, bits: dict[int, np.ndarray], least: float) -> list[tuple]:
        """(item place, score, start, end, seeds) of the items that the document's words hold."""
        out = []
        for k in sorted(self.hashes):
            at, seed = self.hits(k, doc, bits[k])
            if not len(at):
                continue
            item = self.item[k][seed]
            for i in np.unique(item).tolist():
                own = item == i
                b = self.words[i]
                slack = len(b) // 2 + 2
                begin = np.unique(at[own] - self.place[k][seed[own]])
                best, last = (0, 0, 0), None
                for s in begin.tolist() + [None]:
                    if s is not None and last is not None and s <= last[1]:
                        last[1] = s + len(b) + slack
                        continue
                    if last is not None:
                        lo, hi = max(0, last[0]), min(len(doc), last[1])
                        score, x, y = align(doc[lo:hi], b)
                        if score > best[0]:
                            best = (score, lo + x, lo + y)
                    last = None if s is None else [s - slack, s + len(b) + slack]
                score = best[0] / (MATCH * len(b))
                if score >= least:
                    out.append((i, score, best[1], best[2], int(own.sum())))
        return out


def _blocks(benchmark: DataFrame, n: int, size: int) -> Iterator[SeedBlock]:
    """The items in blocks of at most ``size`` items and about BLOCK_BYTES of text. They are the stated query set: all of
    its seeds pass the driver, and a task holds those of one block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").orderBy("item_id", "text")
    rows, held = [], 0
    for r in items.toLocalIterator():
        rows.append((r.item_id, r.text))
        held += len(r.text)
        if len(rows) == size or held >= BLOCK_BYTES:
            yield SeedBlock.of(rows, n)
            rows, held = [], 0
    if rows:
        yield SeedBlock.of(rows, n)


def rare_seeds(docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = 0.5, rare: float = 1e-4, few: int = 100, block_items: int = BLOCK_ITEMS) -> list[SeedBlock]:
    """The blocks with their rare seeds. Document frequencies come from all documents."""
    out = []
    n_docs = docs.count()
    for block in _blocks(benchmark, n, block_items):
        bits = block.bits()

        def count(batch: pa.RecordBatch, block=block, bits=bits) -> pa.RecordBatch:
            found = {k: np.zeros(len(h), np.int64) for k, h in block.hashes.items()}
            for doc in fold_words(batch.column("text")):
                for k in found:
                    found[k][np.unique(block.hits(k, doc, bits[k])[1])] += 1
            cols = [(np.full(len(at), k), at, v[at]) for k, v in found.items() for at in [np.flatnonzero(v)]]
            size, seed, n_in = (np.concatenate(x).astype(np.int64) for x in zip(*cols, strict=True)) if cols else (np.empty(0, np.int64),) * 3
            return pa.RecordBatch.from_arrays([pa.array(size), pa.array(seed), pa.array(n_in)], ["size", "seed", "n"])

        frequency = {k: np.zeros(len(h), np.int64) for k, h in block.hashes.items()}
        rows = map_batches(docs.select(F.col("text").cast("string").alias("text")), count, "size long, seed long, n long").groupBy("size", "seed").agg(F.sum("n").alias("n")).toPandas()
        for k in frequency:
            own = rows[rows["size"] == k]
            frequency[k][own["seed"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
        out.append(block.keep(frequency, n_docs, share, rare, few))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """One row for each document and test item it holds: score, and the words [start, end) of the document."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, start long, end long, n_seeds long"
    out = spark.createDataFrame([], schema)
    for block in rare_seeds(docs, benchmark, **how):
        bits = block.bits()

        def work(batch: pa.RecordBatch, block=block, bits=bits) -> pa.RecordBatch:
            rows = []
            for d, doc in zip(batch.column("doc_id").to_pylist(), fold_words(batch.column("text")), strict=True):
                rows += [(d, block.item_ids[i], *x) for i, *x in block.leaks(doc, bits, least)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        out = out.unionByName(map_batches(texts, work, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """The documents that hold no test item, all columns as they were."""
    for block in rare_seeds(docs, benchmark, **how):
        bits = block.bits()

        def work(batch: pa.RecordBatch, block=block, bits=bits) -> pa.RecordBatch:
            clean = [not block.leaks(doc, bits, least) for doc in fold_words(batch.column("text"))]
            return batch.filter(pa.array(clean, pa.bool_()))

        docs = map_batches(docs, work, docs.schema)
    return docs
