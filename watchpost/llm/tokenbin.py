"""Token-id files with constant-time access by document.

Documents are range-partitioned by doc_id, and every task writes its documents, in order, as shards. A shard is one
binary value:

    magic, ids width, number of documents, number of ids
    doc_ids in order (int64 each, with a bit for null) and the number of the copy among equal doc_ids
    a minimal perfect hash over (doc_id, copy)
    for each slot: a 32-bit fingerprint of the key, where its ids start, how many there are
    all ids, raw, little-endian, in document order

Shards are stored through Spark's Parquet writer beside their part, number, ids before and in them and doc_id range, so that they land whole or not at all in
whatever storage the shared folder is in, and a lost executor's shards are written again.

Defined cases: null text is empty, and its document holds only the end id; a null doc_id comes before all others; rows
that repeat a doc_id follow each other, by text. Input columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchpost.llm.common import as_bytes, kept, shared_dir, slices
from watchpost.llm.mphash import PerfectHash, mix

MAGIC = b"TOKSHRD1"
#: Ids in a shard; a longer document is a shard of its own.
SHARD_IDS = 2_000_000
#: Words in a generation: a worker remembers the one that fills up and the one before, which bounds its memory.
REMEMBERED = 600_000
#: The normaliser and splitter under which no token spans white space, and a full stop or comma after an ASCII letter stands alone.
_APART = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
_SHARDS = "part long, shard long, before long, n_ids long, low long, high long, data binary"


def _keys(doc_ids: np.ndarray, nulls: np.ndarray, copies: np.ndarray) -> np.ndarray:
    return mix(doc_ids.view(np.uint64) ^ mix(copies.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64), 1), 2)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 97) >> np.uint64(32)).astype("<u4")


def pack_shard(doc_ids: list[int | None], copies: list[int], ids: list[bytes], width: int) -> bytes:
    """A shard of documents in order; `ids` holds each one's ids as little-endian integers of `width` bytes."""
    nulls = np.array([x is None for x in doc_ids], bool)
    numbers = np.array([0 if x is None else x for x in doc_ids], "<i8")
    copied = np.array(copies, "<u4")
    keys = _keys(numbers, nulls, copied)
    index = PerfectHash.build(keys)
    slots = index.slots(keys)
    lengths = np.array([len(x) // width for x in ids], "<u4")
    starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)[:-1])).astype("<u8")
    marks, at, n = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u4")
    marks[slots], at[slots], n[slots] = _fingerprints(keys), starts, lengths
    head = MAGIC + np.array([width, len(keys), int(lengths.sum(dtype=np.int64))], "<u8").tobytes()
    return b"".join((head, numbers.tobytes(), np.packbits(nulls).tobytes(), copied.tobytes(), index.packed(), marks.tobytes(), at.tobytes(), n.tobytes(), *ids))


class Shard:
    """Reads a shard; `ids` of a document takes one hash, one fingerprint and one slice."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        width, n, self.n_ids = np.frombuffer(data, "<u8", 3, 8).tolist()
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        at += 8 * n
        self.nulls = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        at += (n + 7) // 8
        self.copies = np.frombuffer(data, "<u4", n, at)
        self.index, at = PerfectHash.unpacked(data, at + 4 * n)
        self.marks, at = np.frombuffer(data, "<u4", n, at), at + 4 * n
        self.starts, at = np.frombuffer(data, "<u8", n, at), at + 8 * n
        self.lengths, at = np.frombuffer(data, "<u4", n, at), at + 4 * n
        self.payload = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def spans(self, doc_ids: np.ndarray, nulls: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of ids of each key; -1 where a fingerprint says that the key isn't here."""
        keys = _keys(doc_ids, nulls, copies)
        slots = self.index.slots(keys)
        safe = np.maximum(slots, 0)
        found = (slots >= 0) & (self.marks[safe] == _fingerprints(keys)) if len(self.marks) else np.zeros(len(keys), bool)
        return np.where(found, self.starts[safe].astype(np.int64), -1), np.where(found, self.lengths[safe].astype(np.int64), -1)

    def ids(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        start, n = self.spans(np.array([doc_id or 0], np.int64), np.array([doc_id is None]), np.array([copy], np.uint32))
        return None if start[0] < 0 else self.payload[start[0] : start[0] + n[0]]


class _Encoder:
    """Ids of a text as raw integers. Where the tokenizer's rules let no token span white space, words are encoded apart and
    remembered, and a word and the full stop or comma at its end are looked up by halves; under other rules texts are encoded whole."""

    def __init__(self, spec: str, width: int):
        from tokenizers import Tokenizer

        # Machine integers of 2 or 4 bytes; shards are little-endian, as the machines that Spark runs on.
        self.tokenizer, self.kind = Tokenizer.from_str(spec), "H" if width == 2 else "I"
        rules = json.loads(spec)
        self.apart = (rules["normalizer"], rules["pre_tokenizer"]) == _APART and rules.get("post_processor") is None
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.ends = {x: self._encoded([x])[0] for x in (b".", b",")}

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        return [array(self.kind, x.ids).tobytes() for x in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Makes sure that all of these are in the newest generation."""
        if len(self.known) + len(words) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, before, plain, cut = self.known, self.before, set(), []
        for w in words:
            ids = before.get(w)
            if ids is not None:
                known[w] = ids
            elif w[-1:] in self.ends and w[-2:-1].isalpha():
                cut.append(w)
            else:
                plain.add(w)
        plain.update(w[:-1] for w in cut if w[:-1] not in known and w[:-1] not in before)
        new = list(plain)
        known.update(zip(new, self._encoded(new), strict=True))
        for w in cut:
            stem = known.get(w[:-1])
            known[w] = (before[w[:-1]] if stem is None else stem) + self.ends[w[-1:]]

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        if not self.apart:
            return [coded + end for coded in self._encoded(texts)]
        words = [x.split() for x in texts]
        missing = set(chain.from_iterable(words)).difference(self.known)
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:
                missing = set(chain.from_iterable(words))  # a new generation starts, which needs all of them
            self.learn(missing)
        return [b"".join([*map(self.known.__getitem__, some), end]) for some in words]


def _encoder(spec: str, width: int) -> _Encoder:
    """The encoder of this worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
    return kept(("tokens", xxhash.xxh128_hexdigest(spec), width), lambda: _Encoder(spec, width))


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 1) -> None:
    """Writes the ids of every document, with the end id after each, as shards in ascending doc_id order under `path`."""
    spec = Path(tokenizer_file).read_text()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    width = _width(spec, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(shared.value, width), np.array([end_id], f"<u{width}").tobytes()
        part, shard, size, before = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids, copies, ids = [], [], []
        last, copy = object(), 0

        def flush() -> pa.RecordBatch:
            low = next((x for x in doc_ids if x is not None), None)
            numbers = [part, shard, before, size, low, doc_ids[-1]]
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in numbers), pa.array([pack_shard(doc_ids, copies, ids, width)], pa.binary())], ["part", "shard", "before", "n_ids", "low", "high", "data"])

        for batch in slices(batches, 512):
            for doc_id, coded in zip(batch.column(0).to_pylist(), encoder.encode(as_bytes(batch.column(1)), end), strict=True):
                if ids and size + len(coded) // width > SHARD_IDS:
                    yield flush()
                    shard, before, size, doc_ids, copies, ids = shard + 1, before + size, 0, [], [], []
                copy = copy + 1 if doc_id == last else 0
                last = doc_id
                doc_ids.append(doc_id)
                copies.append(copy)
                ids.append(coded)
                size += len(coded) // width
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _SHARDS).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def _width(spec: str, end_id: int) -> int:
    """Bytes that hold every id."""
    from tokenizers import Tokenizer

    return 2 if max(end_id, Tokenizer.from_str(spec).get_vocab_size() - 1) < 1 << 16 else 4


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids as raw unsigned 32-bit integers) of every document, each looked up by its key in its shard."""
    shards = spark.read.schema(_SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # One row for each task that wrote: the window and the broadcast are as small as the number of partitions.
    bases = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            shard, base = Shard(batch.column(0)[0].as_py()), batch.column(1)[0].as_py()
            starts, lengths = shard.spans(shard.doc_ids, shard.nulls, shard.copies)
            if (starts < 0).any():
                raise ValueError("a document is missing from its shard's index")
            for k in range(0, len(starts), 256):
                a, n = starts[k : k + 256], lengths[k : k + 256]
                ids = [shard.payload[i : i + m].astype("<u4").tobytes() for i, m in zip(a.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[k : k + 256], pa.int64(), mask=shard.nulls[k : k + 256]), pa.array(a + base, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return shards.join(F.broadcast(bases), "part").select("data", (F.col("base") + F.col("before")).alias("base")).mapInArrow(run, "doc_id long, start long, ids binary")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the asked doc_ids by their shards' indexes; shards whose range holds none are skipped by Parquet's
    statistics where one id is asked for, and unknown ids give no row."""
    wanted = np.unique(np.array(doc_ids, np.int64))
    shards = spark.read.schema(_SHARDS).parquet(path).where((F.col("low") <= int(wanted[-1])) & (F.col("high") >= int(wanted[0]))) if len(wanted) else spark.createDataFrame([], _SHARDS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            low, high = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            asked = wanted[np.searchsorted(wanted, low) : np.searchsorted(wanted, high, "right")]
            if len(asked):
                shard = Shard(batch.column(2)[0].as_py())
                starts, lengths = shard.spans(asked, np.zeros(len(asked), bool), np.zeros(len(asked), np.uint32))
                there = np.flatnonzero(starts >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(asked[there], pa.int64()), pa.array([shard.payload[starts[i] : starts[i] + lengths[i]].astype("<u4").tobytes() for i in there], pa.binary())], ["doc_id", "ids"])

    return shards.select("low", "high", "data").mapInArrow(find, "doc_id long, ids binary")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, tokenizer_file, path, end_id)
    return read_tokens(docs.sparkSession, path)
