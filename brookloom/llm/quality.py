"""Quality rules: counts over whole texts, a fixed base rule, and a learned decision list.

The list is learned by sequential covering from labelled statistics: grow a conjunction of thresholds on one
part of the labelled rows, prune it on the other, keep it while it stays precise, remove what it covers, go on.
It is applied as one ordered Spark conditional expression, so the verdict runs inside the JVM.

Defined results: a null or empty text has no words and so fails the base rule; repeated ids stay separate rows;
columns other than ``doc_id`` and ``text`` are ignored; an empty table gives an empty result; with no labels the
list is empty and only the base rule decides; equal thresholds tie towards the feature named first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.llm.common import as_bytes, map_batches, mix, windows

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
ENDS = b".!?"

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_distinct long, n_upper long, n_digits long, n_ends long, n_chars long"
)
#: Ratios that the rules may test, as SQL over the counts; all are 0 for a text without words.
FEATURES = {
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_ratio": "n_distinct / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
    "end_ratio": "n_ends / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def repeated_words(words: list[bytes], span: int = 5) -> int:
    """Words inside windows of ``span`` words that occur twice or more in the text, the first one included."""
    n = len(words)
    if n <= span:
        return 0
    h = windows(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), span)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + span, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def _count(b: bytes, those: bytes) -> int:
    return len(b) - len(b.translate(None, those))


def _stats(batch: pa.RecordBatch) -> pa.RecordBatch:
    chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
    out = []
    for b, n_chars in zip(as_bytes(batch.column("text")), chars, strict=True):
        words = b.split()
        lines = [x for x in b.split(b"\n") if x.strip()]
        out.append(
            (
                len(words),
                n_chars - _count(b, SPACE),
                _count(b, SYMBOLS),
                len(lines) - len(set(lines)),
                repeated_words(words),
                len(lines),
                len(set(words)),
                _count(b, UPPER),
                _count(b, DIGITS),
                _count(b, ENDS),
                n_chars,
            )
        )
    names = [x.split()[0] for x in STATS.split(", ")]
    columns = zip(*out, strict=True) if out else [[]] * len(names)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of STATS for every row."""
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _stats, f"doc_id long, {STATS}")


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, ">=" or "<=", threshold) holds."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, t in self.tests:
            out &= x[name] >= t if op == ">=" else x[name] <= t
        return out

    def column(self) -> F.Column:
        out = F.lit(True)
        for name, op, t in self.tests:
            c = F.expr(FEATURES[name])
            out = out & (c >= F.lit(float(t)) if op == ">=" else c <= F.lit(float(t)))
        return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> tuple[tuple[str, str, float], ...]:
    """Add the test with the best information gain until no ordinary row is covered."""
    held, tests = np.ones(len(y), bool), ()
    while len(tests) < most:
        p, n = int(y[held].sum()), int((~y[held]).sum())
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for name, v in x.items():
            values, labels = v[held], y[held]
            order = np.argsort(values, kind="stable")
            values, labels = values[order], labels[order]
            cp, cn = np.cumsum(labels), np.cumsum(~labels)
            last = np.r_[values[1:] != values[:-1], True]
            for op, tp, tn, cuts in (("<=", cp, cn, values), (">=", p - cp + labels, n - cn + ~labels, values)):
                ok = last if op == "<=" else np.r_[True, values[1:] != values[:-1]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok & (tp > 0), tp * (np.log2(tp / (tp + tn)) - base), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (gain[k], (name, op, float(cuts[k])))
        if best[1] is None:
            break
        tests += (best[1],)
        held &= Rule((best[1],), 0).mask(x)
    return tests


def _prune(tests: tuple, x: dict[str, np.ndarray], y: np.ndarray) -> Rule | None:
    """Drop final tests while (p - n) / (p + n) on the pruning rows doesn't fall."""
    best = None
    for k in range(len(tests), 0, -1):
        m = Rule(tests[:k], 0).mask(x)
        p, n = int((m & y).sum()), int((m & ~y).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if best is None or worth >= best[0]:
            best = (worth, Rule(tests[:k], p / (p + n) if p + n else 0.0))
    return best[1] if best else None


def learn(x: dict[str, np.ndarray], junk: np.ndarray, fold: np.ndarray, max_rules: int = 12, max_tests: int = 3, precision: float = 0.9) -> list[Rule]:
    """Sequential covering. ``fold``: True for pruning rows. Ends when a new rule is less precise than asked."""
    rules: list[Rule] = []
    left = np.ones(len(junk), bool)
    while len(rules) < max_rules:
        g, p = left & ~fold, left & fold
        if junk[g].sum() < 3:
            break
        rule = _prune(_grow({k: v[g] for k, v in x.items()}, junk[g], max_tests), {k: v[p] for k, v in x.items()}, junk[p])
        if rule is None or rule.precision < precision:
            break
        rules.append(rule)
        left &= ~rule.mask(x)
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, precision: float = 0.9) -> list[Rule]:
    """The decision list from labelled rows that pass the base rule.

    At most ``max_labelled`` labelled documents, those with the least hash of their id, come to the driver, each
    as a dozen numbers; the sample bound is the only limit and nothing is cut from their texts.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = (
        text_stats(picked)
        .where(~base_failed())
        .join(F.broadcast(known), "doc_id")
        .select("doc_id", "quality", *(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()))
        .toPandas()
        .sort_values("doc_id", kind="stable")
    )
    if rows.empty:
        return []
    x = {k: rows[k].to_numpy(float) for k in FEATURES}
    return learn(x, rows["quality"].to_numpy() == 0, mix(rows["doc_id"].to_numpy().astype(np.uint64)) >> np.uint64(32) < np.uint64(2**32 // 3), precision=precision)


def verdict(rules: list[Rule]) -> F.Column:
    """The number of the first rule that rejects a row, in the list's order, or null."""
    out = F.when(base_failed(), F.lit(0))
    for k, rule in enumerate(rules):
        out = out.when(rule.column(), F.lit(k + 1))
    return out


def quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the deciding ``rule`` (0: base, null: none) of every document."""
    rules = fit_rules(docs, labels, max_labelled)
    return (
        text_stats(docs)
        .withColumn("rule", verdict(rules).cast("int"))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", F.col("rule").isNull())
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    )


def kept_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """The rows that ``quality`` keeps, all columns as they were; counted where they lie, so nothing is shuffled."""
    rejected = verdict(fit_rules(docs, labels, max_labelled)).isNotNull()
    names = [x.split()[0] for x in STATS.split(", ")]

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = _stats(pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(own.index("text"))], ["doc_id", "text"]))
        return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, own), *(stats.column(x) for x in names)], ["row", *names])

    own = docs.columns
    whole = map_batches(docs, measured, f"row {docs.schema.simpleString()}, {STATS}")
    return whole.where(~rejected).select(*(F.col("row").getField(c).alias(c) for c in own))
