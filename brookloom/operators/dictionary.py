"""Dictionaries of any size against texts: an automaton finds all entries in one pass, longest first.

A dictionary is a table of names. Up to ``PART_BYTES`` of them make one automaton, which tasks build once from what they are
sent; a larger dictionary is cut into as many parts, which its size is asked for before. Each part then goes over the texts
by itself, and what the parts found in a text is settled together, so no task holds more than a part.

Of entries that stand at overlapping places the one that begins first counts, and of these the longest: what a regular
expression of all entries, the longest first, would find, in time that doesn't grow with the entries.

Defined results: entries are told apart by their folded form, and the least written one of equal ones is given back; null
and empty entries find nothing; null texts hold nothing; repeated rows and rows of equal ids are texts of their own, whose
hits stand side by side; other columns are ignored; an empty dictionary or table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of names that one automaton is made of; it takes some tens of times as many.
PART_BYTES = 8 << 20
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def folded(text: str) -> str:
    """In small letters, each character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def settled(found: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of (start, end, name) those that a scan from the left takes: at each place the longest, then on behind it."""
    out, free = [], 0
    for start, end, name in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if start >= free:
            out.append((start, end, name))
            free = end
    return out


class Matcher:
    """All places of the names in a text. ``fold``: in any case; ``whole``: with no ASCII letter, digit or underscore on
    either side."""

    def __init__(self, names: Iterable[str], fold: bool = True, whole: bool = True):
        self.fold, self.whole = fold, whole
        self.automaton = ahocorasick.Automaton()
        for name in sorted(x for x in names if x):
            key = folded(name) if fold else name
            if key not in self.automaton:
                self.automaton.add_word(key, (len(key), name))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, int, str]]:
        if self.empty:
            return
        for last, (size, name) in self.automaton.iter(folded(text) if self.fold else text):
            start, end = last - size + 1, last + 1
            if not self.whole or ((start == 0 or text[start - 1] not in _WORD) and (end == len(text) or text[end] not in _WORD)):
                yield start, end, name

    def found(self, text: str) -> list[tuple[int, int, str]]:
        return settled(self.places(text))

    def names(self, text: str) -> list[str]:
        """The distinct names in a text, in order."""
        return list(dict.fromkeys(name for _, _, name in self.found(text)))


def parts_of(entries: DataFrame, name: str = "name", part_bytes: int = PART_BYTES) -> Iterator[tuple[int, list[str]]]:
    """How many parts of about ``part_bytes`` the dictionary has, and the names of each, one part at a time."""
    own = entries.select(F.col(name).cast("string").alias("name")).where("name != ''").distinct()
    total = own.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    for k in range(n):
        part = own.where(F.pmod(F.xxhash64(F.lower("name")), F.lit(n)) == k) if n > 1 else own
        yield n, [r.name for r in part.collect()]


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string())]))
_HITS_SQL = "hits array<struct<start:int,end:int,name:string>>"


def _hits(rows: Iterable[Iterable[tuple[int, int, str]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b, "name": x} for a, b, x in r] for r in rows], _HITS)


def dictionary_hits(docs: DataFrame, entries: DataFrame, name: str = "name", fold: bool = True, whole: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, start, end (characters from 0, the end exclusive) and name, as the dictionary writes it, of every entry that
    stands in a text (doc_id, text). The driver and the tasks hold one part of the dictionary at a time; the places that
    each of several parts finds are written to the checkpoint folder before the next is read."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.md5("text").alias("digest"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest string, {_HITS_SQL}"
    found: DataFrame | None = None
    for n, names in parts_of(entries, name, part_bytes):
        part = own.mapInArrow(_searching(names, fold, whole, settle=n == 1), schema)
        if n == 1:
            found = part
        else:
            part = part.where("size(hits) > 0").checkpoint()
            found = part if found is None else found.unionByName(part)
    if n > 1:
        # Rows of equal id and text have equal hits; as many are settled as there are.
        copies = own.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
        places = found.groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
        same = places["doc_id"].eqNullSafe(copies["doc_id"]) & (places["digest"] == copies["digest"])
        each = places.join(copies, same).select(places["doc_id"], places["digest"], "hits", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
        found = each.mapInArrow(_settling, schema)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.start", "h.end", "h.name")


def _settling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [[(h["start"], h["end"], h["name"]) for h in hits] for hits in batch.column("hits").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), _hits(map(settled, places))], names=["doc_id", "digest", "hits"])


def _searching(names: list[str], fold: bool, whole: bool, settle: bool):
    """Looks for a part's names in each text; what overlaps is settled here where the part is the only one."""
    held: list[Matcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Matcher(names, fold, whole))
        look = held[0].found if settle else held[0].places
        for batch in batches:
            rows = (look(t or "") for t in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), _hits(rows)], names=["doc_id", "digest", "hits"])

    return run
