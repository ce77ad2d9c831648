"""Secret scans through a trigram inverted index.

Each rule's regular expression yields a Boolean query over the trigrams that any match must contain. Every batch of
documents is one index segment: postings of the rules' trigrams over the batch's bytes, lower-cased. The query's
AND and OR are intersections and unions of postings; the rule then verifies its candidates on whole texts. A rule
without mandatory trigrams scans every text. Index and texts stay together, so nothing is shuffled.

Defined results: null counts as an empty text, which has no spans; repeated ids stay separate rows; other columns
are ignored; overlapping spans of different kinds are all reported; offsets count code points, the end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.llm.common import as_bytes, map_batches

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # the names before Python 3.11
    import sre_constants as sre
    import sre_parse as parser


@dataclass(frozen=True)
class SecretRule:
    """A match of ``pattern`` (over bytes) counts if its ``group`` has at least ``least`` bytes."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    SecretRule("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    SecretRule("access", rb"AKIA[A-Z0-9]+", 0, 20, True),
    SecretRule("hex", rb"[0-9a-f]+", 0, 24, True),
    SecretRule("github", rb"gh[opsur]_[A-Za-z0-9]{36,}"),
    SecretRule("google", rb"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: The most spellings of a literal run that are followed before the run is closed.
SPELLINGS = 32

# A query is True (no condition), a trigram, ("and", [...]) or ("or", [...]).


def _all(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list):
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _spelled(words: set[bytes]):
    """What a run that is spelled in one of these ways requires."""
    return _any([_all([w[i : i + 3] for i in range(len(w) - 2)]) for w in sorted(words)])


def _walk(nodes) -> tuple[set[bytes] | None, object]:
    """(all spellings of the sequence, or None if they are too many or open; what else a match requires)."""
    runs, needs, closed = {b""}, [], False

    def close() -> None:
        nonlocal runs, closed
        needs.append(_spelled(runs))
        runs, closed = {b""}, True

    for op, arg in nodes:
        if op is sre.LITERAL:
            words = {bytes([arg]).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            words = {bytes([a]).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            words, more = _walk(arg[3])
            needs.append(more)
        elif op is sre.BRANCH:
            found = [_walk(x) for x in arg[1]]
            if all(w is not None and m is True for w, m in found):
                words = set().union(*(w for w, _ in found))
            else:
                words = None
                needs.append(_any([_all([m, True if w is None else _spelled(w)]) for w, m in found]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, what = arg
            words, more = _walk(what)
            if least:
                needs.append(more)
            if words is not None and (least, most) == (0, 1):
                words = words | {b""}
            elif words is not None and least == most == 1:
                pass
            else:
                words = None
        elif op is sre.AT:
            continue
        else:
            words = None
        if words is None or len(runs) * len(words) > SPELLINGS:
            close()
            if words is not None and len(words) <= SPELLINGS:
                runs = words
        else:
            runs = {a + b for a in runs for b in words}
    if closed:
        needs.append(_spelled(runs))
        return None, _all(needs)
    return runs, _all(needs)


def trigram_query(pattern: bytes):
    """The Boolean trigram query that every text with a match satisfies."""
    words, needs = _walk(parser.parse(pattern))
    return _all([needs, True if words is None else _spelled(words)])


def _grams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_grams, query[1]))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Segment:
    """Postings of the given trigrams over one batch of texts."""

    def __init__(self, texts: list[bytes], grams: list[bytes], lookup: np.ndarray, step: int = 1 << 22):
        ends = np.cumsum([len(x) + 2 for x in texts])
        raw = LOWER[np.frombuffer(b"\0\0".join([*texts, b""]), np.uint8)] if texts else np.empty(0, np.uint8)
        found = []
        for lo in range(0, max(0, len(raw) - 2), step):
            b = raw[lo : lo + step + 2].astype(np.int32)
            ids = lookup[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            at = np.flatnonzero(ids)
            found.append(np.unique((ids[at].astype(np.int64) << 32) | np.searchsorted(ends, at + lo, side="right")))
        keys = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        cut = np.searchsorted(keys, np.arange(1, len(grams) + 2, dtype=np.int64) << 32)
        self.postings = {g: keys[cut[i] : cut[i + 1]] & 0xFFFFFFFF for i, g in enumerate(grams)}
        self.everything = np.arange(len(texts))

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return self.everything
        if isinstance(query, bytes):
            return self.postings[query]
        out = None
        for part in sorted((self.candidates(q) for q in query[1]), key=len):
            if out is None:
                out = part
            else:
                out = np.intersect1d(out, part, assume_unique=True) if query[0] == "and" else np.union1d(out, part)
        return out


def gram_lookup(grams: list[bytes]) -> np.ndarray:
    """1 + the trigram's place in the list, by its 24 bits; 0 for others."""
    out = np.zeros(1 << 24, np.uint8 if len(grams) < 256 else np.uint32)
    for i, g in enumerate(grams):
        out[int.from_bytes(g, "big")] = i + 1
    return out


def find_spans(texts: list[bytes], rules: tuple[SecretRule, ...] = RULES, lookup: np.ndarray | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text, (start, rule's place, end) in code points, in order."""
    asked = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(_grams, asked)))
    segment = Segment(texts, grams, gram_lookup(grams) if lookup is None else lookup)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, asked, strict=True)):
        # Runs of one class end where the class ends, so asking for the length in the pattern finds the same ones.
        simple = rule.group == 0 and rule.pattern.endswith(b"]+") and rule.pattern.count(b"[") == 1
        fixed = rule.pattern.index(b"[") if simple else 0
        rx = re.compile(rule.pattern[:-1] + b"{%d,}" % max(1, rule.least - fixed) if simple else rule.pattern)
        for i in segment.candidates(query).tolist():
            for m in rx.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    for i, spans in enumerate(out):
        if spans:
            spans.sort()
            b = texts[i]
            if not b.isascii():
                lead = np.r_[0, np.cumsum((np.frombuffer(b, np.uint8) & 0xC0) != 0x80)]
                out[i] = [(int(lead[s]), k, int(lead[e])) for s, k, e in spans]
    return out


def secret_spans(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Per document: doc_id and ``found``, an array of kind, start and end, ordered by start and the rules' order."""
    grams = sorted(set().union(*(_grams(trigram_query(r.pattern)) for r in rules)))
    kept: dict[str, np.ndarray] = {}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "lookup" not in kept:
            kept["lookup"] = gram_lookup(grams)
        found = find_spans(as_bytes(batch.column("text")), rules, kept["lookup"])
        rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans] for spans in found]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "found"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, work, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def secret_digest(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text, of every document."""
    base = [r.kind for r in rules if r.base]

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(kind: str) -> F.Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secret_spans(docs, rules).select(
        "doc_id",
        *(of(k) for k in base),
        F.sha2(joined(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
