"""MinHash near-duplicates, candidates checked by odd sketches, links confirmed on full shingle sets.

1. Each text gives its shingle count, a 128-bit digest of its words in order, MinHash band keys, and an odd sketch: the
   MinHash samples folded into a parity bitmap. The population count of two sketches' XOR estimates their similarity.
2. Texts of equal words are exact classes; the smallest doc_id stands for each, so copies are never paired. Texts whose
   sets are equal but not their words take the way of all others, and are confirmed on full sets.
3. Representatives that share a band key meet in cells. A key with many of them is dealt over a triangular grid of
   cells of bounded size, in which any two still meet once. A cell compares sketches and returns a row for each
   document that has a likely partner: its neighbourhood's smallest document, not the pairs.
4. Neighbourhoods are joined into coarse groups, whose texts meet once, again in bounded cells. There likely pairs are
   confirmed on full sets, most similar first, and only those that join two parts are returned: a forest keeps every
   component that the pairs make.
5. Components of the confirmed links, and of exact classes, give each document the smallest id it reaches.

The chance that one pair at the threshold shares no band is (1 - 0.85**5)**20, under 1e-5.

Defined results: a null or wordless text has an empty set, is linked with nothing and is kept; rows with an equal id
are one node, each row with its own n_shingles, and the node's links are those of all its texts; a row with a null id
is linked with nothing, has a null component and is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.llm.common import as_bytes, map_batches, map_groups, mix, stored, windows, word_hashes

SHINGLE = 5
BANDS, ROWS = 20, 5
SKETCH_BITS = 512
#: Sketches estimating at least this much go on to the full sets: the threshold less more than four deviations.
LIKELY_MARGIN = 0.17
CELL_DOCS, CELL_BYTES = 512, 16 << 20
UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(20240607)
MULTIPLIERS = _RNG.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
ADDENDS = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of all its words, where they are fewer than a shingle."""
    words = text.translate(UPPER_TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(windows(h, min(SHINGLE, len(h))) ^ np.uint64(0 if len(h) >= SHINGLE else len(h)))


def minhashes(h: np.ndarray) -> np.ndarray:
    """BANDS * ROWS samples of a non-empty set."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(MULTIPLIERS), np.uint32(2**32 - 1))
    for lo in range(0, len(low), 2048):
        x = low[lo : lo + 2048, None] * MULTIPLIERS + ADDENDS
        out = np.minimum(out, x.min(axis=0))
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Rows of samples to rows of SKETCH_BITS / 64 words: each sample flips the bit that its place and value name."""
    n, k = samples.shape
    bit = (mix(samples.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + bit).ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.uint64)


def sketch_similarity(apart: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Estimated Jaccard similarity from the number of bits in which two odd sketches differ."""
    left = np.maximum(1 - 2 * apart / SKETCH_BITS, 1e-9)
    return np.maximum(0.0, 1 + SKETCH_BITS / (4 * k) * np.log(left))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the words (two longs, null without any), band keys and sketch of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(batch.column("text"))
        sets = [shingles(b) for b in texts]
        size = np.array([len(h) for h in sets], np.int64)
        full = np.flatnonzero(size)
        m = np.array([minhashes(sets[i]) for i in full.tolist()], np.uint32).reshape(len(full), BANDS * ROWS)
        keys = np.zeros((len(full), BANDS), np.uint64)
        for j in range(ROWS):
            keys = mix(keys + m[:, j::ROWS].astype(np.uint64) + np.uint64(1))
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
        at = np.full(len(sets), -1)
        at[full] = np.arange(len(full))
        sketch = odd_sketches(m)
        digest = [np.frombuffer(xxhash.xxh3_128_digest(b" ".join(b.translate(UPPER_TO_LOWER).split())), np.int64).tolist() if len(h) else (None, None) for b, h in zip(texts, sets, strict=True)]
        d1, d2 = [x for x, _ in digest], [x for _, x in digest]
        bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(size > 0, BANDS, 0))].astype(np.int32)), pa.array(keys.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), bands, pa.array([sketch[i].tobytes() if i >= 0 else None for i in at.tolist()], pa.binary())],
            ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
        )

    return map_batches(_texts(docs), work, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def grid(rows: DataFrame, key: str, parts: str) -> DataFrame:
    """Each row once for every cell (key, lo, hi) of its key's triangular grid; any two rows of a key share a cell."""
    own = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col(parts))
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("own", "other", parts)
    )


class Parts:
    """Union-find over 0..n-1; the smallest member stands for a part."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _likely(sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sketches that estimate at least ``least``: (first, second, estimate)."""
    most = int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp((least - 1) * 4 * BANDS * ROWS / SKETCH_BITS))))
    out = [(np.empty(0, np.int64),) * 2 + (np.empty(0),)]
    for i in range(len(sketch) - 1):
        apart = np.bitwise_count(sketch[i + 1 :] ^ sketch[i]).sum(axis=1)
        j = np.flatnonzero(apart <= most)
        if len(j):
            out.append((np.full(len(j), i), j + i + 1, sketch_similarity(apart[j].astype(float))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def neighbourhoods(reps: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b): a document with a likely partner under some band key, and its neighbourhood's smallest one."""
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / CELL_DOCS).cast("long").alias("parts"))
    rows = grid(keyed.join(shared, "key").join(reps.select("doc_id", "sketch"), "doc_id"), "key", "parts")

    def cell(rows: pa.Table) -> pa.RecordBatch:
        ids = rows.column("doc_id").to_numpy()
        if len(ids) < 2:
            return _edges([], [])
        at = np.argsort(ids, kind="stable")
        ids, held = ids[at], rows.column("sketch").to_pylist()
        sketch = np.frombuffer(b"".join([held[i] for i in at.tolist()]), np.uint64).reshape(len(ids), -1)
        parts = Parts(len(ids))
        for i, j in zip(*(x.tolist() for x in _likely(sketch, threshold - LIKELY_MARGIN)[:2]), strict=True):
            parts.join(i, j)
        top = np.array([parts.find(i) for i in range(len(ids))])
        found = np.flatnonzero(top != np.arange(len(ids)))
        return _edges(ids[found], ids[top[found]])

    return map_groups(rows, ["key", "lo", "hi"], cell, "a long, b long").where("a != b").distinct()


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirmed(docs: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of a coarse group whose full sets are similar enough: a forest of each cell."""
    size = groups.groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    size = size.select("label", F.greatest(F.ceil(F.col("n") / CELL_DOCS), F.ceil(F.col("bytes") / CELL_BYTES)).cast("long").alias("parts"))
    members = groups.select("doc_id", "label").join(size, "label")
    # Sorted and merged at every size: members are a share of all documents, so neither side is ever small enough to send.
    rows = grid(_texts(docs).join(members.hint("merge"), "doc_id"), "label", "parts")
    num, den = round(threshold * 1000), 1000

    def cell(rows: pa.Table) -> pa.RecordBatch:
        ids = rows.column("doc_id").to_pylist()
        if len(ids) < 2:
            return _edges([], [])
        texts = rows.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ids, sets = [ids[k] for k in order], [shingles(texts[k] or b"") for k in order]
        held = [k for k, s in enumerate(sets) if len(s)]
        ids, sets = [ids[k] for k in held], [sets[k] for k in held]
        if len(ids) < 2:
            return _edges([], [])
        sketch = odd_sketches(np.array([minhashes(s) for s in sets]))
        i, j, estimate = _likely(sketch, threshold - LIKELY_MARGIN)
        order = np.argsort(-estimate, kind="stable")
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum([len(s) for s in sets])
        coded = np.split(code, ends[:-1])
        flag = np.zeros(int(code.max()) + 1, bool)
        parts, links, last = Parts(len(ids)), [], -1
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if parts.find(x) == parts.find(y):
                continue
            if last != x:
                if last >= 0:
                    flag[coded[last]] = False
                flag[coded[x]] = True
                last = x
            both = int(np.count_nonzero(flag[coded[y]]))
            if den * both >= num * (len(coded[x]) + len(coded[y]) - both):
                parts.join(x, y)
                links.append((ids[x], ids[y]))
        return _edges([a for a, _ in links], [b for _, b in links])

    return map_groups(rows, ["label", "lo", "hi"], cell, "a long, b long").where("a != b")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, label) of every node of the edges (a, b): the smallest node of its component.

    Rounds of hooking to the smallest neighbour's label and pointer jumping; each round's labels are written to the
    shared folder, so no lineage grows and a lost executor costs one round.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.col("doc_id"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "doc_id").select("doc_id", F.least("label", "near").alias("up"), F.col("label").alias("was"))
        top = labels.select(F.col("doc_id").alias("up"), F.col("label").alias("top"))
        moved = stored(hooked.join(top, "up", "left").select("doc_id", F.least("up", F.coalesce("top", "up")).alias("label"), "was"), "labels")
        if moved.where("label != was").limit(1).isEmpty():
            return moved.drop("was")
        labels = moved.drop("was")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = stored(signatures(docs), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    # One row of each class of equal sets; a class may hold any share of the rows.
    classes = stored(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stored(usable.join(classes, ["d1", "d2"]).where("doc_id = rep").select("doc_id", "bands", "sketch"), "representatives")
    coarse = components(neighbourhoods(reps, threshold))
    sized = coarse.join(signed.groupBy("doc_id").agg((F.max("n_shingles") * 8).alias("bytes")), "doc_id")
    links = confirmed(docs, stored(sized, "groups"), threshold)
    # Rows of one id are one node: classes that share an id are linked, each with the least of them.
    nodes = usable.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "rep").distinct()
    least = nodes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a != most").select("doc_id", "a")
    shared = nodes.join(least, "doc_id").select("a", F.col("rep").alias("b")).where("a != b")
    found = components(links.select("a", "b").union(shared))
    labels = classes.join(found, classes["rep"] == found["doc_id"], "left").select("d1", "d2", F.coalesce("label", "rep").alias("component"))
    # Rows without words have no class: they take no part in the join, where they would all meet in one task.
    rows = signed.select("doc_id", "n_shingles", "d1", "d2")
    joined = rows.where("d1 is not null").join(labels, ["d1", "d2"], "left").select("doc_id", "n_shingles", "component")
    alone = rows.where("d1 is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    return (
        joined.unionByName(alone)
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each component, all columns as they were; of repeated rows of its id, the one whose text has the
    least hash."""
    found = near_duplicates(docs, threshold).where("kept").select(F.col("doc_id").alias("kept_id")).where("kept_id is not null").distinct()
    rows = docs.select(F.struct("*").alias("row"))  # so that no column of the caller's meets those of this join
    kept = rows.join(found, F.col("row.doc_id").cast("long") == F.col("kept_id"))
    one = kept.groupBy("kept_id").agg(F.min_by("row", F.struct(F.xxhash64("row.text"), F.col("row.text").alias("text"))).alias("row")).select("row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


#: The query's rows at a threshold of 0.85: all pairs that share a shingle, and reachability by recursion.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 85 * (s.n + t.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x)
SELECT words.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(words.doc_id, coalesce(low, words.doc_id)) AS component_id, words.doc_id <= coalesce(low, words.doc_id) AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) r USING (doc_id)
"""
