"""Stupid-backoff scores of documents under the word n-gram counts of all other documents.

Every 1-, 2- and 3-gram of every document is counted, however rare. A document is scored as one that the model has not
seen: what it holds itself is taken off the counts, else each n-gram of a text that stands alone would be found in it.
The score of a word is its trigram's count over its context's, if any other document holds the trigram. Else it is ALPHA
times the bigram's count over its context's, else ALPHA squared times the word's count, one at least, over that of all
words. At a text's start fewer orders are tried. A document's score is the sum of the words' logarithms.

1. Each slice of documents counts its own 1-, 2- and 3-grams, which travel as 64-bit hashes with their counts, dealt by
   hash: an n-gram comes once from a slice, however often it stands there. No word is left out.
2. A partition sums the counts of each n-gram and sends the sums back to the slices that asked.
3. The slice joins them to its words by place, takes off each document's own, and sums per document.

N-grams travel as packed arrays, one row for each slice and partition. No row holds more than a slice's or a
partition's n-grams, and no word or n-gram binds more rows to one partition than there are slices. Rows are slices times
partitions; both sizes follow from the counted words (``sizes``), or are arguments.

Words are ``[^\\x20\\x09-\\x0D]+`` as they stand. Defined results: a null or wordless text has 0 words and scores 0;
repeated rows are documents of their own, each scored with the others counted; null ids are ordinary; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.llm.common import as_bytes, map_batches, slices, windows, word_hashes

ALPHA = 0.4
ORDERS = (1, 2, 3)
#: Bytes of a slice, and n-grams that a partition counts at a time on average: those of FEW_WORDS words or less, and those that
#: a task of 4 GB can hold, which large corpora come to.
SLICE_BYTES, MOST_SLICE_BYTES = 12 << 20, 64 << 20
PARTITION_GRAMS, MOST_PARTITION_GRAMS = 2_000_000, 16_000_000
FEW_WORDS = 200_000_000


def sizes(words: int) -> tuple[int, int]:
    """Bytes of a slice and n-grams of a partition for a corpus of so many words. Both grow with the root of it, so that rows,
    which are slices times partitions, grow as the words do, until a task is full: 80 GB of text; at 100 TB a row holds
    some 16 n-grams."""
    more = max(1.0, (words / FEW_WORDS) ** 0.5)
    return min(int(SLICE_BYTES * more), MOST_SLICE_BYTES), min(int(PARTITION_GRAMS * more), MOST_PARTITION_GRAMS)


def planes(x: np.ndarray) -> bytes:
    """An array of integers as bytes, all low bytes first: the high ones, mostly 0, compress in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def squeezed(ascending: np.ndarray, *others: np.ndarray) -> bytes:
    """Ascending hashes as steps, and arrays of 4-byte numbers."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    return zstandard.compress(np.uint64(len(ascending)).tobytes() + planes(steps) + b"".join(map(planes, others)), 1)


def unsqueezed(b: bytes) -> tuple[np.ndarray, bytes]:
    """(hashes, bytes of what follows)."""
    b = zstandard.decompress(b)
    end = 8 + 8 * int(np.frombuffer(b, np.uint64, 1)[0])
    return np.cumsum(unplanes(b[8:end], np.uint64), dtype=np.uint64), b[end:]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _total(docs: DataFrame) -> int:
    """How many words all documents have."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sum(len(b.split()) for b in as_bytes(batch.column("text")))], pa.int64())], ["n"])

    return map_batches(_texts(docs).select("text"), count, "n long").agg(F.sum("n")).first()[0] or 0


def _places(lengths: np.ndarray) -> np.ndarray:
    """Each word's place in its text, from 0."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _grams(hashes: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places where an n-gram of one text ends, its hash)."""
    ends = np.flatnonzero(place >= n - 1)
    return ends, windows(hashes, n)[ends - (n - 1)]


def _dealt(grams: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(partition, places in ``grams`` of what goes there, ascending by hash): each has a range of hashes."""
    if not len(grams):
        return []
    order = np.argsort(grams, kind="stable")
    part = ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return [(int(part[at[0]]), at) for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1)]


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of every n-gram that a slice sent to this partition: its count in all slices."""
    found = [unsqueezed(x) for x in pdf["data"]]
    sizes = [len(x) for x, _ in found]
    grams = np.concatenate([x for x, _ in found])
    mine = np.concatenate([unplanes(x, np.uint32) for _, x in found])
    del found
    order = np.argsort(grams)
    grams = grams[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    sums = np.empty(len(order), np.int64)
    sums[order] = np.repeat(np.add.reduceat(mine[order].astype(np.int64), first), np.diff(np.r_[first, len(order)]))
    data = [zstandard.compress(planes(x), 1) for x in np.split(sums, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"slice": pdf["slice"], "part": pdf["part"], "doc_ids": None, "lengths": None, "data": data})


def _own(back: np.ndarray, doc: np.ndarray, kinds: int) -> np.ndarray:
    """How often the document of each n-gram, one of ``kinds``, holds it."""
    _, at, n = np.unique(doc * kinds + back, return_inverse=True, return_counts=True)
    return n[at]


def _logs(place: np.ndarray, counts: list[np.ndarray], others: np.ndarray) -> np.ndarray:
    """The logarithm of each word's score. counts[n - 1][i]: of the n-gram that ends at i, in other documents; others[i]:
    how many words those have."""
    one, two, three = counts
    step = np.log(ALPHA)
    out = np.log(np.maximum(one, 1) / np.maximum(others, 1)) + np.minimum(place, 2) * step
    pair, full = (place >= 1) & (two > 0), (place >= 2) & (three > 0)
    before, context = np.r_[0, one[:-1]], np.r_[0, two[:-1]]
    out[pair] = np.log(two[pair] / before[pair]) + (place[pair] >= 2) * step
    out[full] = np.log(three[full] / context[full])
    return out


def lm_scores(docs: DataFrame, slice_bytes: int | None = None, partition_grams: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score, its share of one word, of every document. ``sizes`` of the corpus hold
    where none are given."""
    total = _total(docs)
    own = sizes(total)
    slice_bytes, partition_grams = slice_bytes or own[0], partition_grams or own[1]
    parts = max(1, -(-2 * total // partition_grams))  # a word ends three n-grams at most; a slice sends what it repeats once
    schema = "slice long, part long, doc_ids array<long>, lengths array<long>, data binary"
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def packed(of: Callable[[np.ndarray, np.ndarray, list], list[tuple]]) -> DataFrame:
        """Rows (part, doc_ids, lengths, data) of ``of``, which gets a slice's word hashes, lengths and ids, with its name."""

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, doc_ids = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            digest = xxhash.xxh3_64()  # names the slice by what it holds, so that a task that is run again names it alike
            for d, b in zip(doc_ids, texts, strict=True):
                digest.update(f"{d}:{len(b)}:".encode() + b)
            name = digest.intdigest() - (1 << 63)
            words = [b.split() for b in texts]
            lengths = np.array([len(x) for x in words], np.int64)
            rows = [(name, *x) for x in of(word_hashes([w for x in words for w in x]), lengths, doc_ids)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, slice_bytes):
                    if part.num_rows:
                        yield work(part)
            pa.default_memory_pool().release_unused()

        return _texts(docs).mapInArrow(run, schema)

    def asked(hashes: np.ndarray, lengths: np.ndarray, doc_ids: list) -> list[tuple]:
        place = _places(lengths)
        found = [np.unique(_grams(hashes, place, n)[1], return_counts=True) for n in ORDERS]
        grams, n = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]).astype(np.uint32)
        return [(p, None, None, squeezed(grams[at], n[at])) for p, at in _dealt(grams, parts)]

    def held(hashes: np.ndarray, lengths: np.ndarray, doc_ids: list) -> list[tuple]:
        words, ids, n = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # the most frequent words have the least ids, which zstandard shortens
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        return [(-1, doc_ids, lengths.tolist(), squeezed(words, n.astype(np.uint32), rank[ids]))]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["part"] == -1]
        sent = {int(p): x for p, x in zip(pdf["part"], pdf["data"], strict=True) if p >= 0}
        lengths, data = np.array(own["lengths"].iloc[0], np.int64), own["data"].iloc[0]
        sums = np.zeros(len(lengths))
        if lengths.any():
            words, rest_of = unsqueezed(data)
            n, ids = unplanes(rest_of[: 4 * len(words)], np.uint32), unplanes(rest_of[4 * len(words) :], np.uint32)
            hashes, place = words[np.argsort(-n.astype(np.int64), kind="stable")][ids], _places(lengths)
            found = []
            for n in ORDERS:
                ends, grams = _grams(hashes, place, n)
                found.append((ends, *np.unique(grams, return_inverse=True)))
            grams = np.concatenate([x for _, x, _ in found])
            n = np.empty(len(grams), np.int64)
            for p, at in _dealt(grams, parts):
                n[at] = unplanes(zstandard.decompress(sent[p]), np.int64)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            counts, at = [], 0
            for ends, x, back in found:
                counts.append(np.zeros(len(hashes), np.int64))
                counts[-1][ends] = n[at : at + len(x)][back] - _own(back, doc[ends], len(x))
                at += len(x)
            logs = _logs(place, counts, total - np.repeat(lengths, lengths))
            sums[lengths > 0] = np.add.reduceat(logs, (np.cumsum(lengths) - lengths)[lengths > 0])
        out = pd.DataFrame({"doc_id": pd.array([None if d is None or d != d else int(d) for d in own["doc_ids"].iloc[0]], "Int64"), "n_words": lengths, "log_score": sums, "mean_log_score": sums / np.maximum(lengths, 1)})
        return pd.concat([out] * len(own), ignore_index=True)  # a slice may come twice, rows and all

    counts = packed(asked).groupBy("part").applyInPandas(_counted, schema)
    return packed(held).unionByName(counts).groupBy("slice").applyInPandas(score, "doc_id long, n_words long, log_score double, mean_log_score double")


#: The same scores, rounded as the query rounds them.
ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tokens AS (SELECT r, len(ws) AS n_words, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
total AS (SELECT count(*) AS n FROM tokens),
grams AS (SELECT r, n_words, i, w, lag(w) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM tokens WINDOW o AS (PARTITION BY r ORDER BY i)),
counted AS (
  SELECT r, n_words, i,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY w, r) AS one,
    CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY w1, w) - count(*) OVER (PARTITION BY w1, w, r) ELSE 0 END AS two,
    CASE WHEN i >= 3 THEN count(*) OVER (PARTITION BY w2, w1, w) - count(*) OVER (PARTITION BY w2, w1, w, r) ELSE 0 END AS three
  FROM grams),
seen AS (SELECT *, lag(one) OVER o AS one_before, lag(two) OVER o AS two_before FROM counted WINDOW o AS (PARTITION BY r ORDER BY i)),
scored AS (
  SELECT r, CASE
    WHEN three > 0 THEN ln(three::DOUBLE / two_before)
    WHEN two > 0 THEN ln(two::DOUBLE / one_before) + (CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END)
    ELSE ln(greatest(one, 1)::DOUBLE / greatest(total.n - n_words, 1)) + least(i - 1, 2) * ln(0.4) END AS x
  FROM seen, total)
SELECT docs.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(x, 0), 6) AS log_score, round(coalesce(x, 0) / greatest(len(ws), 1), 6) AS mean_log_score
FROM docs LEFT JOIN (SELECT r, sum(x) AS x FROM scored GROUP BY r) AS sums ON docs.r = sums.r
"""
