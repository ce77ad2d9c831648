"""Sampled SentencePiece segmentations by forward filtering and backward sampling over the piece lattice.

A text is read as SentencePiece reads it: a space before it, spaces as a piece's word mark, characters without a
piece of their own as byte pieces. Every path through the lattice of pieces is a segmentation; its probability is
proportional to the product of its pieces' weights. A piece's weight is 1 / (2 + its merge rank), to the power
``theta``; a byte piece's is that of a rank after all others. Forward filtering sums the weights of all paths to each
place; backward sampling then draws a piece at a time, from the end, with exactly those probabilities.

No piece spans the border before a word's spaces, or a line end, so the lattice falls into units there, and each
distinct unit is filtered once, for as long as a worker has room to keep it; within a unit, wherever no piece spans a place, the stretches on either side are
filtered side by side. Draws are hashes of seed, row key, unit and step, so a row is segmented alike
wherever and whenever it runs. Texts and lattices stay in bytes; places inside a character lie on byte paths alone.

Decoding joins the pieces' bytes and takes the first space off. It returns every text exactly, those included that
hold the word mark itself, which no piece but bytes may spell.

Defined results: a null text has null ids, an empty one none; rows of an equal id and text have equal pieces; a null
id counts as one key; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.llm.common import map_batches, mix, slices

MARK = "▁".encode()
#: A byte that no text holds: a unit that it begins has no space before it.
BARE = b"\xff"
RUNS = re.compile(rb" +[^ ]*")
BASE = np.uint64(0x9E3779B97F4A7C15)
UNIT_STEP, DRAW_STEP = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
#: Bytes of text that are segmented at a time.
SLICE_BYTES = 1 << 19
#: A unit longer than this many bytes is drawn in stretches of about as many, where no piece spans a place between them.
STRETCH = 32
#: Bytes of units whose lattices are filtered at a time, and bytes that a worker's lattices may take before it starts anew; the
#: units of SLICE_BYTES of text are added to that.
LEARN_BYTES, KEPT_BYTES = 1 << 18, 192 << 20


class Pieces:
    """The pieces of a model: their bytes with spaces as marks, their log weights, and tables of their prefixes."""

    def __init__(self, path: str, theta: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [b""] * n
        self.weight = np.zeros(n)
        self.byte_id = np.zeros(256, np.int32)
        prefixes: dict[bytes, int] = {}
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.text[i], self.byte_id[b] = bytes([b]), i
                self.weight[i] = -theta * np.log(2 + n)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = model.id_to_piece(i).encode().replace(MARK, b" ")
                self.text[i] = raw
                self.weight[i] = -theta * np.log(2 - min(0.0, model.get_score(i)))
                for k in range(1, len(raw)):
                    prefixes.setdefault(raw[:k], -1)
                prefixes[raw] = i
        self.size = np.array([len(x) for x in self.text], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)
        self.tables = []  # by length: sorted hashes of the prefixes of that length, and the piece each is, or -1
        for k in range(1, int(self.size.max(initial=1)) + 1):
            own = [(x, i) for x, i in prefixes.items() if len(x) == k]
            h = np.zeros(len(own), np.uint64)
            raw = np.frombuffer(b"".join(x for x, _ in own), np.uint8).reshape(len(own), k)
            for j in range(k):
                h = h * BASE + raw[:, j].astype(np.uint64) + np.uint64(1)
            order = np.argsort(h)
            self.tables.append((h[order], np.array([i for _, i in own], np.int64)[order]))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of an array of ids, one after another."""
        n = self.size[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.start[:-1][ids] - (ends - n), n)
        return self.blob[at + np.arange(len(at))]


class Sampler:
    """Lattices of the units seen so far, until they take about ``most`` bytes, then anew."""

    def __init__(self, pieces: Pieces, most: int = KEPT_BYTES):
        self.pieces, self.most = pieces, most
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first = np.empty(0, np.int64)  # of each stretch, its first and last state; states are numbered on
        self.last = np.empty(0, np.int64)
        self.stretch = np.empty(0, np.int64)  # of each unit, its first stretch, and how many it has
        self.stretches = np.empty(0, np.int64)
        self.low = np.empty(0, np.int64)  # of each state, the first and last edge that ends there
        self.high = np.empty(0, np.int64)
        self.share = np.empty(0)  # of each edge, the chance of it and its state's earlier edges
        self.back = np.empty(0, np.int32)  # of each edge, how many bytes it covers
        self.piece = np.empty(0, np.int32)
        self.states = self.names = 0

    def held(self) -> int:
        """About how many bytes the lattices take."""
        return sum(x.nbytes for x in (self.first, self.last, self.stretch, self.stretches, self.low, self.high, self.share, self.back, self.piece)) + self.names

    def learn(self, units: list[bytes]) -> None:
        p = self.pieces
        raw = [u[1:] if u[:1] == BARE else b" " + u for u in units]
        size = np.array([len(x) for x in raw], np.int64)
        a = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        end_of = np.repeat(ends, size)
        at = np.arange(len(a))
        h = np.zeros(len(a), np.uint64)
        begin, covers, which = [], [], []
        lead = (a & 0xC0) != 0x80
        width = np.where(a < 0x80, 1, np.where(a < 0xE0, 2, np.where(a < 0xF0, 3, 4)))  # of the character that a lead byte begins
        alone = np.zeros(len(a), bool)  # lead bytes of characters that are a piece
        at, h = at[lead], h[lead]
        for k, (hashes, ids) in enumerate(p.tables):
            ok = at + k < end_of[at]
            at, h = at[ok], h[ok]
            h = h * BASE + a[at + k].astype(np.uint64) + np.uint64(1)
            if not len(hashes) or not len(at):
                break
            j = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            ok = hashes[j] == h
            at, h, j = at[ok], h[ok], ids[j[ok]]
            hit = j >= 0
            begin.append(at[hit])
            which.append(j[hit])
            covers.append(np.full(int(hit.sum()), k + 1))
            alone[at[hit][width[at[hit]] == k + 1]] = True
        spelled = np.flatnonzero(~np.repeat(alone[lead], np.diff(np.r_[np.flatnonzero(lead), len(a)])))
        begin = np.concatenate([*begin, spelled])
        which = np.concatenate([*which, p.byte_id[a[spelled]]]).astype(np.int64)
        covers = np.concatenate([*covers, np.ones(len(spelled), np.int64)])
        unit = np.repeat(np.arange(len(units)), size)[begin]
        # Where no piece spans a place, every path goes through it: weights count from there, and what lies between two
        # such places is filtered by itself, so text without spaces falls into short stretches too.
        spans = np.cumsum(np.bincount(begin + 1, minlength=len(a) + 2)[: len(a) + 1] - np.bincount(begin + covers, minlength=len(a) + 2)[: len(a) + 1])
        free = spans == 0
        since = np.maximum.accumulate(np.where(free, np.arange(len(a) + 1), 0))
        place, fresh = begin + covers - since[begin], free[begin]
        end = begin + covers + unit  # a unit of n bytes has n + 1 states
        order = np.argsort(end, kind="stable")
        end, covers, which, place, fresh = end[order], covers[order], which[order], place[order], fresh[order]
        first = ends - size + np.arange(len(units))
        # Forward filtering: places in order, all stretches at once.
        total = np.zeros(len(a) + len(units))
        by_place = np.argsort(place, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(place[by_place])) + 1, len(by_place)] if len(place) else [0]
        chance = np.empty(len(end))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            e = by_place[lo:hi]
            x = np.where(fresh[e], 0.0, total[end[e] - covers[e]]) + p.weight[which[e]]
            head = np.flatnonzero(np.r_[True, end[e][1:] != end[e][:-1]])
            n = np.diff(np.r_[head, len(e)])
            most = np.maximum.reduceat(x, head)
            odds = np.exp(x - np.repeat(most, n))
            total[end[e][head]] = np.log(np.add.reduceat(odds, head)) + most
            chance[e] = np.exp(x - np.repeat(total[end[e][head]], n))
        # Running chances within a state, summed from its first edge on: what other units stand beside it changes no bit.
        n = np.bincount(end, minlength=len(total))
        low = np.cumsum(n) - n
        share, rank = chance.copy(), np.arange(len(end)) - low[end]
        by_rank = np.argsort(rank, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(rank))] if len(rank) else [0]
        for lo, hi in zip(cuts[1:-1], cuts[2:], strict=True):
            e = by_rank[lo:hi]
            share[e] += share[e - 1]
        share[(low + n - 1)[n > 0]] = 1.0
        # A unit is drawn in stretches, which end at the first free place of every STRETCH bytes after the first.
        begins = ends - size
        of = np.repeat(np.arange(len(units)), size)
        bucket = (np.arange(len(a)) - begins[of]) // STRETCH
        inner = np.flatnonzero(free[:-1] & (bucket > 0))
        inner = inner[np.r_[True, (np.diff(bucket[inner]) != 0) | (np.diff(of[inner]) != 0)][: len(inner)]]
        opens = np.concatenate([first, inner + of[inner]])  # as states
        owner = np.concatenate([np.arange(len(units)), of[inner]])
        order = np.lexsort((opens, owner))
        opens, owner = opens[order], owner[order]
        last_of = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.empty(0, bool)
        closes = np.where(last_of, (first + size)[owner], np.r_[opens[1:], 0][: len(opens)])
        n_of = np.bincount(owner, minlength=len(units))
        self.names += sum(map(len, units)) + 150 * len(units)
        self.known.update(zip(units, range(len(self.stretch), len(self.stretch) + len(units)), strict=True))
        self.stretch = np.r_[self.stretch, len(self.first) + np.cumsum(n_of) - n_of]
        self.stretches = np.r_[self.stretches, n_of]
        self.first = np.r_[self.first, opens + self.states]
        self.last = np.r_[self.last, closes + self.states]
        self.low = np.r_[self.low, low + len(self.share)]
        self.high = np.r_[self.high, low + n - 1 + len(self.share)]
        self.share = np.r_[self.share, share]
        self.back = np.r_[self.back, covers.astype(np.int32)]
        self.piece = np.r_[self.piece, which.astype(np.int32)]
        self.states += len(total)

    def encode(self, texts: list[bytes], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        """Sampled ids of each text; ``keys`` are row keys as 64-bit numbers."""
        split = []
        for t in texts:
            if not t:
                split.append([])
                continue
            t = t.replace(b"\n", b" \xff\n \xff")
            split.append([x[1:] for x in RUNS.findall(b" " + t)] if b"  " in t else t.split(b" "))
        distinct = set().union(*split) if split else set()
        new = distinct.difference(self.known)
        if new:
            if self.held() > self.most:
                self.forget()
                new = distinct
            new = sorted(new)
            group = np.cumsum([len(x) + 1 for x in new]) // LEARN_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(new)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                self.learn(new[lo:hi])
        counts = np.array([len(x) for x in split], np.int64)
        n = int(counts.sum())
        if not n:
            return [np.empty(0, np.int32) for _ in texts]
        get = self.known.__getitem__
        unit = np.fromiter(map(get, chain.from_iterable(split)), np.int64, n)
        reps = self.stretches[unit]
        upto = np.cumsum(reps)
        counts = np.diff(np.r_[0, np.r_[0, upto][np.cumsum(counts)]])  # of stretches
        n = int(upto[-1])
        unit = np.repeat(self.stretch[unit] - (upto - reps), reps) + np.arange(n)
        number = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        salt = mix(np.repeat(mix(keys.astype(np.uint64) + np.uint64(seed)), counts) + number.astype(np.uint64) * UNIT_STEP)
        live = np.argsort(unit, kind="stable")  # so that draws of one unit read the same edges
        unit = unit[live]
        live, unit = live[ok := self.last[unit] != self.first[unit]], unit[ok]
        state, stop, salt = self.last[unit], self.first[unit], salt[live]
        drawn = []
        used = np.zeros(n, np.int64)
        while len(live):
            u = (mix(salt) >> np.uint64(11)).astype(float) * 2.0**-53
            e, top = self.low[state], self.high[state]  # the first of the state's own edges whose share is above u
            while (e < top).any():
                mid = (e + top) >> 1
                later = self.share[mid] <= u
                e, top = np.where(later, mid + 1, e), np.where(later, top, mid)
            drawn.append((live, self.piece[e]))
            used[live] += 1
            state = state - self.back[e]
            ok = state != stop
            live, state, stop, salt = live[ok], state[ok], stop[ok], salt[ok] + DRAW_STEP
        ends = np.cumsum(used)
        ids = np.empty(int(ends[-1]), np.int32)
        for k, (at, piece) in enumerate(drawn):
            ids[ends[at] - 1 - k] = piece
        return np.split(ids, ends[np.cumsum(counts)[:-1] - 1] if (counts[:-1] > 0).all() else np.r_[0, ends][np.cumsum(counts)[:-1]])


_SAMPLERS: dict[tuple, Sampler] = {}


def sampler(path: str, theta: float) -> Sampler:
    """One sampler a process, so that tasks go on with the lattices of those before them."""
    if (path, theta) not in _SAMPLERS:
        _SAMPLERS[path, theta] = Sampler(Pieces(path, theta))
    return _SAMPLERS[path, theta]


def _default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sampled_pieces(docs: DataFrame, seed: int = 0, theta: float = 1.0, model: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, whether decoding returns the text, and the ids if asked, of every row.

    ``model``: a file that every executor has; by default that of the installed package.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model or _default_model(), theta)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                keys = np.array([0 if d is None else d for d in part.column("doc_id").to_pylist()], np.int64).view(np.uint64)
                found = own.encode([t or b"" for t in texts], keys, seed)
                whole = own.pieces.decode(np.concatenate(found)).tobytes() if found else b""
                n_bytes = [int(own.pieces.size[x].sum()) for x in found]
                ends = np.cumsum(n_bytes).tolist()
                same = [whole[e - n : e] == (b" " + t if t else b"") for t, e, n in zip([t or b"" for t in texts], ends, n_bytes, strict=True)]
                cols = [
                    part.column("doc_id"),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                    pa.array(same),
                ]
                if ids:
                    cols.append(pa.array([None if t is None else x for t, x in zip(texts, found, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decoded(pieces: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every row of doc_id and ids; null ids give a null text."""
    held: dict[str, Pieces] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = held.setdefault("pieces", held.get("pieces") or Pieces(model or _default_model()))
        out = [None if x is None else own.decode(np.array(x, np.int64)).tobytes()[1:].decode() for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return map_batches(pieces.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), work, "doc_id long, text string")
