"""Token-id output: patched frame-of-reference blocks in ascending document order.

A segment holds the ids of consecutive documents, about ``SEGMENT`` of them or one longer document. Its payload:

    u32 n_values, u32 n_blocks, u32 start[n_blocks]      byte place of each block after this header
    block: u32 minimum, u8 width, u8 0, u16 n_exceptions,
           u16 place[n_exceptions], u32 value[n_exceptions], u64 packed[width * BLOCK / 64]

All numbers are little-endian. A block has BLOCK values less their minimum. The width is that of the value at the
chosen percentile; larger ones go to the exception list as whole ids and are 0 in the packed part. Value j of a
group of 64 starts at bit j * width of that group's ``width`` words. The last block is padded with its minimum.

Segments are rows of a Parquet table that Spark commits, so a lost task leaves no part of a file behind and any
store that Spark reaches will do. Each row names its shard (a range of doc_id), its place there, and its documents.

Shards are ranges of (doc_id, hash of the text), so rows of one id, or without one, may lie in several.

Defined results: a null or empty text has the end id alone; repeated ids each keep their rows, ordered by a hash of the
text; null ids come first; columns other than ``doc_id`` and ``text`` are ignored; no documents, no segments.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookloom.llm.common import shared_dir, slices

BLOCK = 256
SEGMENT = 1 << 16
#: Bytes of text that are encoded at a time: more of them hold fewer distinct words each.
SLICE_BYTES = 8 << 20
END_ID = 2
SEGMENT_SCHEMA = "shard int, place long, shard_start long, n_values long, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width to rows of width * BLOCK / 64 words."""
    lanes = np.ascontiguousarray(v.reshape(-1, 64).T.astype(np.uint64))
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(v), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, lanes.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (lanes[word + 1] << np.uint64(64 - shift))
        out[j] = x & mask
    return np.ascontiguousarray(out.T).reshape(len(words), BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray, percentile: float = 0.97) -> bytes:
    """The payload of a segment for an array of ids below 2**32."""
    n = len(ids)
    if not n:
        return np.array([0, 0], "<u4").tobytes()
    nb = -(-n // BLOCK)
    v = np.full(nb * BLOCK, ids[-1], np.uint32)
    v[:n] = ids
    tail = v[(nb - 1) * BLOCK : n]
    v[n:] = tail.min()
    v = v.reshape(nb, BLOCK)
    low = v.min(axis=1)
    d = v - low[:, None]
    k = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.searchsorted(1 << np.arange(33, dtype=np.uint64), np.partition(d, k, axis=1)[:, k].astype(np.uint64), side="right")
    over = d.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    d[over] = 0
    packed: list[bytes] = [b""] * nb
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            for r, x in zip(rows.tolist(), _pack(d[rows], int(w)).astype("<u8"), strict=True):
                packed[r] = x.tobytes()
    n_over = over.sum(axis=1)
    row, place = np.nonzero(over)
    value, place = v[row, place].astype("<u4"), place.astype("<u2")
    first = np.r_[0, np.cumsum(n_over)].tolist()
    head = np.zeros(nb, np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("over", "<u2")]))
    head["low"], head["width"], head["over"] = low, width, n_over
    parts = [head[i].tobytes() + place[first[i] : first[i + 1]].tobytes() + value[first[i] : first[i + 1]].tobytes() + packed[i] for i in range(nb)]
    start = np.r_[0, np.cumsum([len(x) for x in parts])][:-1].astype("<u4")
    return np.array([n, nb], "<u4").tobytes() + start.tobytes() + b"".join(parts)


def decode_blocks(payload: bytes) -> np.ndarray:
    """All ids of a segment."""
    n, nb = np.frombuffer(payload, "<u4", 2).tolist()
    if not n:
        return np.empty(0, np.uint32)
    base = 8 + 4 * nb
    start = np.frombuffer(payload, "<u4", nb, 8).astype(np.int64) + base
    raw = np.frombuffer(payload, np.uint8)
    head = raw[start[:, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, over = head[:, 4].astype(int), np.ascontiguousarray(head[:, 6:8]).view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((nb, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            at = start[rows] + 8 + 6 * over[rows]
            words = np.ascontiguousarray(raw[at[:, None] + np.arange(w * BLOCK // 8)]).view("<u8")
            out[rows] = _unpack(words, int(w))
    out += low[:, None]
    for i in np.flatnonzero(over).tolist():
        k, at = int(over[i]), int(start[i]) + 8
        out[i, np.frombuffer(payload, "<u2", k, at)] = np.frombuffer(payload, "<u4", k, at + 2 * k)
    return out.reshape(-1)[:n]


def block_ids(payload: bytes, at: int) -> np.ndarray:
    """The BLOCK ids from place ``at`` * BLOCK on, read through the index of block starts alone."""
    n, nb = np.frombuffer(payload, "<u4", 2).tolist()
    start = int(np.frombuffer(payload, "<u4", 1, 8 + 4 * at)[0]) + 8 + 4 * nb
    end = int(np.frombuffer(payload, "<u4", 1, 12 + 4 * at)[0]) + 8 + 4 * nb if at + 1 < nb else len(payload)
    one = np.array([min(BLOCK, n - at * BLOCK), 1, 0], "<u4").tobytes() + payload[start:end]
    return decode_blocks(one)


#: The parts of a tokenizer file that the encoding by words relies on; fixed values.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def splits_into_words(form: dict) -> bool:
    """Whether a tokenizer file normalises and splits so that a text's ids are those of its words, one after another,
    a word's last id ends it, and a word of letters is one piece before merges."""
    model, rest = form["model"], [form.get(k) for k in ("truncation", "padding")]
    return (
        rest == [None, None]
        and (form.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and (form.get("pre_tokenizer") or {}).get("pretokenizers") == SPLITTERS
        and model["type"] == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and not any(set(t["content"]) & set(" \t\n\v\f\r") or not set(t["content"]) - set(WordEncoder.MARKS + LETTERS) for t in form["added_tokens"])
    )


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _byte_characters() -> dict[int, str]:
    """The character that byte-level splitting writes for each byte; line ends stay, as they part words here."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    out = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    del out[ord("\n")]
    return out


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + size[i]] of all i, one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordEncoder:
    """Whole-text encoding by way of the distinct words of a batch.

    The tokenizer's splitting never crosses white space, so a text's ids are its words' ids in order; nor does it
    join a letter and the marks after it, so a word's ids are those of its letters, then those of its last marks.
    Lower-case words of letters in a few blocks of Unicode are encoded together by the file's own merges, without the
    normalising that leaves them as they are; all others one by one by the file as it stands. Each word is a span of
    one array of ids, which starts anew beyond ``most`` words, so its size is bounded.

    A file of another form (``splits_into_words``) encodes each whole text as it stands.
    """

    MARKS = ".,!?;:*#%&$|"
    #: Letters that lower-casing has been applied to and that no normaliser changes.
    PLAIN = "^[a-zà-öø-ÿā-ľł-ňŋ-žа-џ]+$"

    def __init__(self, path: str, most: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.by_word = splits_into_words(form)
        if self.by_word:
            model = form["model"]
            merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
            self.merging = Tokenizer(BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"]))
            self.merging.pre_tokenizer = WhitespaceSplit()
            self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.last[[i for w, i in model["vocab"].items() if w.endswith(model["end_of_word_suffix"])]] = True
            self.characters = _byte_characters()
        self.forget()

    def forget(self) -> None:
        """Rows 0 and 1 are the end of a document and the empty word."""
        self.known: dict[bytes, int] = {b"": 1}
        self.ids, self.start, self.size = np.array([END_ID], np.uint32), np.array([0, 1]), np.array([1, 0])

    def _add(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of new spans."""
        first = len(self.start)
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.ids = np.r_[self.ids, ids.astype(np.uint32)]
        return np.arange(first, len(self.start))

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _cores(self, cores: pa.Array) -> np.ndarray:
        """Rows of distinct words of plain letters."""
        names = cores.cast(pa.binary()).to_pylist()
        rows = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(rows < 0)
        if len(new):
            lines = b"\n".join(names[i] for i in new.tolist()).decode("latin-1").translate(self.characters)
            ids = np.array(self.merging.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(new):
                raise ValueError("the tokenizer's words don't end where its suffix says")
            rows[new] = self._add(ids, np.diff(np.r_[0, ends]))
            self.known.update(zip((names[i] for i in new.tolist()), rows[new].tolist(), strict=True))
        return rows

    def learn(self, words: pa.Array) -> np.ndarray:
        """Rows of distinct words that aren't known."""
        low = pc.utf8_lower(words)
        core = pc.ascii_rtrim(low, characters=self.MARKS)
        plain = pc.and_not(pc.match_substring_regex(core, self.PLAIN), pc.match_substring(words, "İ")).to_numpy(zero_copy_only=False)
        rows = np.empty(len(words), np.int64)
        odd = np.flatnonzero(~plain)
        if len(odd):
            rows[odd] = self._add(*self._one_by_one(words.take(pa.array(odd)).to_pylist()))
        held = core.filter(pa.array(plain)).dictionary_encode()
        rows[plain] = self._cores(held.dictionary)[held.indices.to_numpy()] if len(held) else 0
        n_marks = (pc.binary_length(low).to_numpy() - pc.binary_length(core).to_numpy()) * plain
        marked = np.flatnonzero(n_marks)
        if len(marked):
            ends = [w[-k:] for w, k in zip(low.take(pa.array(marked)).to_pylist(), n_marks[marked].tolist(), strict=True)]
            kinds = sorted(set(ends))
            row_of = dict(zip(kinds, self._add(*self._one_by_one(kinds)).tolist(), strict=True))
            pairs = np.stack([rows[marked], np.array([row_of[x] for x in ends])], axis=1).ravel()
            size = self.size[pairs]
            rows[marked] = self._add(_gather(self.ids, self.start[pairs], size), size.reshape(-1, 2).sum(axis=1))
        self.known.update(zip(words.cast(pa.binary()).to_pylist(), rows.tolist(), strict=True))
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id last; how many each has)."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            ids, size = self._one_by_one(texts.to_pylist())
            return np.insert(ids, np.cumsum(size), np.uint32(END_ID)), size + 1
        split = pc.ascii_split_whitespace(texts)
        held = split.flatten().dictionary_encode()
        words = held.dictionary.cast(pa.binary()).to_pylist()
        rows = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        if len(self.known) + len(new) > self.most:
            self.forget()
            new = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)))
            rows[:] = 1
        if len(new):
            rows[new] = self.learn(held.dictionary.take(pa.array(new)))
        last = split.offsets.to_numpy()[1:]
        row = np.insert(rows[held.indices.to_numpy()], last, 0)
        size = self.size[row]
        ends = np.cumsum(size)[last + np.arange(len(last))] if len(last) else np.empty(0, np.int64)
        return _gather(self.ids, self.start[row], size), np.diff(np.r_[0, ends])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a process, so that tasks go on with the words of those before them."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, percentile: float = 0.97) -> None:
    """Encode and write all documents' ids to ``path`` in ascending doc_id order.

    ``tokenizer``: a file that every executor has, of any form; by default that of the installed package. Each shard is one
    range of ids, streamed through one task that holds a segment at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or _default_tokenizer()).encode
        shard, place, shard_start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def segment() -> pa.RecordBatch:
            nonlocal place, shard_start, size, held
            ids = np.concatenate([x for _, x in held])
            row = (shard, place, shard_start, len(ids), [d for d, _ in held], [len(x) for _, x in held], encode_blocks(ids, percentile))
            place, shard_start, size, held = place + 1, shard_start + len(ids), 0, []
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                ids, lengths = encode(part.column("text"))
                cuts = np.cumsum(lengths)[:-1]
                for d, own in zip(part.column("doc_id").to_pylist(), np.split(ids, cuts) if len(lengths) else [], strict=True):
                    held.append((d, own))
                    size += len(own)
                    if size >= SEGMENT:
                        yield segment()
        if held:
            yield segment()
        pa.default_memory_pool().release_unused()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("order", F.xxhash64("text"))
        .repartitionByRange("doc_id", "order", F.spark_partition_id())
        .sortWithinPartitions("doc_id", "order", "text")
        .select("doc_id", "text")
        .mapInArrow(run, SEGMENT_SCHEMA)
        .write.parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, and its ids if asked, decoded from the files."""
    schema = "shard int, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = decode_blocks(row["payload"]).astype("<u4", copy=False)
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(values.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array([row["shard"]] * len(lengths), pa.int32()), pa.array(starts + row["shard_start"]), pa.array(row["doc_ids"], pa.int64()), pa.array(lengths), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # One row a shard: as many as the write had tasks.
    shards = files.groupBy("shard").agg(F.sum("n_values").alias("n")).withColumn("base", F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)))
    return (
        files.select("shard", "shard_start", "doc_ids", "lengths", "payload")
        .mapInArrow(run, schema)
        .join(F.broadcast(shards.select("shard", F.coalesce("base", F.lit(0)).alias("base"))), "shard")
        .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
    )


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the files, to a fresh shared folder unless ``path`` is given, and return what they hold."""
    path = path or shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
