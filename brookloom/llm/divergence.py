"""How far the sources of each language differ in their words: all pairs of sources, and each source's own terms.

Terms are runs of letters A-Z and of characters beyond ASCII; only A-Z are lower-cased. A language keeps the V terms that
at least ``min_docs`` of its documents hold. A group (language, source), or a whole language, gives a kept term of ``count``
occurrences p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), N being the sum of its counts of kept terms.

Part ``pair`` holds, for each other source of the language, the sum over all kept terms of abs(p - q). It isn't taken term
by term: for each pair of sources a joint histogram tallies how many terms have each combination of counts, those that
only one of the two holds with an implied 0, and abs(p - q) is evaluated once for a combination and multiplied. The cell
of terms that neither holds is what is left of V. Part ``term`` holds the terms that a source uses more than its language.

1. Tasks count terms by (language, source) over whole texts, and in how many documents each stands; a shuffle sums them.
2. Kept terms join their counts. Terms are dealt over blocks of about ``block_rows`` counts by hash, and sources over tiles
   of ``tile``; a block of a pair of tiles makes the histograms of its pairs of sources and sends one sum for each pair.
3. The sums of the blocks are added up.

No task holds more than a block, and what is sent of a block doesn't grow with its terms. Joins on a language or a group,
which may hold most rows, are dealt over ``SALTS`` parts. All numbers are whole.

Defined results: null text, lang and source are ''; a group without terms, and a language that keeps no term, has pairs but
no terms (value 0 where V is 0); repeated rows are documents of their own; other columns, doc_id too, are ignored; a
source alone in its language has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookloom.llm.common import as_bytes, slices, stored

MIN_DOCS = 30
TOP = 50
#: Added to every count, and what probabilities are multiplied by.
PRIOR, SCALE = 5, 1_000_000_000
BLOCK_ROWS = 100_000
#: Sources of a tile, parts of a salted join, and counts that a task gathers before it sends them on.
TILE, SALTS, HELD = 128, 32, 300_000
#: Longest stretch of a text that is split at once.
STRETCH = 4 << 20

#: All bytes that are no part of a term become blanks; A-Z become a-z.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: bytes) -> Counter:
    """How often each term stands in a text; long texts are split in stretches that end at blanks."""
    text, at, out = text.translate(LETTERS), 0, Counter()
    while at < len(text):
        end = text.find(b" ", at + STRETCH)
        end = len(text) if end < 0 else end
        out.update(text[at:end].split())
        at = end
    return out


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences, docs that hold it; and each group once with a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_of) in held.items():
                terms = [None, *n]
                k = len(terms)
                strings = [pa.array(x, pa.binary()).cast(pa.string()) for x in ([lang] * k, [source] * k, terms)]
                yield pa.RecordBatch.from_arrays(
                    [*strings, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs_of[t] for t in n)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        size = 0
        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(*map(as_bytes, part.columns), strict=True):
                    n, docs_of = held.setdefault((lang, source), (Counter(), Counter()))
                    before = len(n)
                    own = terms_of(text)
                    n.update(own)
                    docs_of.update(own.keys())
                    size += len(n) - before
                    if size > HELD:
                        yield from sent()
                        size = 0
        yield from sent()

    raw = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    counted = raw.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def salted(rows: DataFrame, small: DataFrame, on: list[str], by: str) -> DataFrame:
    """An inner join whose keys may each hold most of ``rows``: they are dealt by the hash of ``by``, and ``small`` repeated."""
    dealt = rows.withColumn("salt", F.pmod(F.hash(by), F.lit(SALTS)))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*on, "salt"]).drop("salt")


def probability(count: str, total: str, kept: str) -> F.Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exact at any size; null where nothing is kept."""
    return F.expr(
        f"1 + if({kept} = 0, null, (cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0))) div cast({total} + {PRIOR} * {kept} as decimal(20,0)))"
    )


def _probabilities(levels: np.ndarray, total: int, kept: int) -> np.ndarray:
    levels = levels if int(levels.max()) < 2**62 // SCALE else levels.astype(object)
    return (1 + SCALE * (levels + PRIOR) // (total + PRIOR * kept)).astype(np.int64)


def joint_histograms(block: pa.Table, tile: int) -> pa.Table:
    """Of each pair a < b of sources of a block, from the pair of tiles: how many terms either holds, and the sum of
    abs(p - q) over these."""
    lang, ta, tb = (block.column(c)[0].as_py() for c in ("lang", "tile_a", "tile_b"))
    block = block.combine_chunks()
    known = block.column("term").is_null().to_numpy()
    idx = block.column("idx").to_numpy()
    group = block.filter(pa.array(known))
    totals = dict(zip(group.column("idx").to_pylist(), group.column("total").to_pylist(), strict=True))
    kept = group.column("kept")[0].as_py()
    rows = block.filter(pa.array(~known))
    levels, code = np.unique(np.append(rows.column("n").to_numpy(), 0), return_inverse=True)
    code = code[:-1]  # the count 0, which no row has, comes first
    term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if len(rows) else np.empty(0, np.int32)
    idx = idx[~known]
    order = np.argsort(idx, kind="stable")
    idx, term, code = idx[order], term[order].astype(np.int64), code[order].astype(np.int64)
    sources = sorted(totals)
    lo, hi = np.searchsorted(idx, sources), np.searchsorted(idx, sources, "right")
    p = [_probabilities(levels, totals[s], kept) for s in sources]
    own = [np.bincount(code[i:j], minlength=len(levels)) for i, j in zip(lo, hi, strict=True)]
    at = np.zeros(int(term.max()) + 1 if len(term) else 0, np.int64)
    out: list[tuple[int, int, int, int]] = []
    for x, a in enumerate(sources):
        if a // tile != ta:
            continue
        at[term[lo[x] : hi[x]]] = code[lo[x] : hi[x]]
        for y in range(x + 1, len(sources)):
            if sources[y] // tile != tb:
                continue
            mine, theirs = at[term[lo[y] : hi[y]]], code[lo[y] : hi[y]]
            cells, times = np.unique(mine * len(levels) + theirs, return_counts=True)
            ca, cb = np.divmod(cells, len(levels))
            alone = own[x] - np.bincount(mine, minlength=len(levels))  # terms of a that b lacks, by their count
            alone[0] = 0
            value = (times * np.abs(p[x][ca] - p[y][cb])).sum() + (alone * np.abs(p[x] - p[y][0])).sum()
            out.append((a, sources[y], int(times.sum() + alone.sum()), int(value)))
        at[term[lo[x] : hi[x]]] = 0
    a, b, seen, value = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string())} | {k: pa.array(v, pa.int64()) for k, v in (("a", a), ("b", b), ("seen", seen), ("value", value))})


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_rows: int = BLOCK_ROWS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value and rank; see above."""
    tallies = stored(term_counts(docs), "tallies")
    kept = tallies.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(F.col("docs") >= min_docs)
    counts = stored(tallies.select("lang", "source", "term", "n").join(kept.drop("docs"), ["lang", "term"]), "counts")

    # Languages and groups: few rows beside the counts.
    per_term = counts.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang"), F.count("*").alias("rows"))
    langs = per_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"), F.sum("rows").alias("rows"))
    found = tallies.where("term is null").select("lang", "source")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = found.withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = stored(
        numbered.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", "idx", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total", "rows")],
            F.max("idx").over(Window.partitionBy("lang")).alias("last"),
        ),
        "groups",
    )

    blocks = F.ceil(F.col("rows") / block_rows).cast("int")
    own_tile, last_tile = (F.col("idx") / tile).cast("int").alias("tile"), (F.col("last") / tile).cast("int")
    other = F.explode(F.sequence(F.lit(0), last_tile))
    tiles = [F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b")]
    joined = salted(counts, groups, ["lang", "source"], "term")
    in_blocks = joined.select("lang", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "idx", "term", "n", "total", "kept", own_tile, other.alias("other"))
    heads = groups.where("rows > 0").select(
        "lang", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "idx", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"),
        "total", "kept", own_tile, "last",
    ).withColumn("other", other).drop("last")
    dealt = in_blocks.unionByName(heads).select("lang", "block", "idx", "term", "n", "total", "kept", *tiles)
    histograms = dealt.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(lambda block: joint_histograms(block, tile), "lang string, a long, b long, seen long, value long")
    sums = histograms.groupBy("lang", "a", "b").agg(F.sum("seen").alias("seen"), F.sum("value").alias("value"))

    one = groups.select("lang", "source", "idx", "kept", probability("0", "total", "kept").alias("p"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("other"), probability("0", "total", "kept").alias("q"))
    both = salted(one, two, ["lang"], "source").where("idx != other").withColumns({"a": F.least("idx", "other"), "b": F.greatest("idx", "other")})
    neither = (F.col("kept") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("p") - F.col("q"))
    pairs = both.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(F.coalesce("value", F.lit(0)) + neither, F.lit(0)).alias("value"))

    more = joined.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (probability("n", "total", "kept") - probability("in_lang", "lang_total", "kept")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    own = more.where("value > 0").withColumn("rank", ranked).where(F.col("rank") <= top)
    return pairs.withColumn("rank", ranked).unionByName(own)


#: The query's rows: term by term over all kept terms, in 128-bit numbers.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM docs) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grid AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, v FROM groups JOIN kept USING (lang) JOIN sized USING (lang) LEFT JOIN counts USING (lang, source, term)),
probs AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p FROM grid),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n, any_value(v) AS v FROM grid GROUP BY lang, term),
lang_probs AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q FROM whole),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
own AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM probs JOIN lang_probs USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM own) WHERE rank <= 50
"""
