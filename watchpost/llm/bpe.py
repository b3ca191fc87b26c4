"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer file.

Each match of the split pattern is a pre-token. Pre-tokens that are whole vocabulary entries resolve through a minimal
perfect hash with the entry's bytes as fingerprint, all new ones of a slice at once; the others start as a linked list of
bytes, and a heap of ranked pairs gives the merges in order. Workers remember pre-tokens and words with their ids as raw
integers, so that a text's ids are joined, not listed; both memories are bounded and keep what is in use.

Defined cases: null counts as empty and gives no ids; decoding joins bytes, which need not be valid UTF-8 for part of a
text's ids; ids outside the vocabulary raise ValueError. Input columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.llm.common import kept, slices
from watchpost.llm.mphash import PerfectHash

#: Pre-tokens and words in a generation: a worker remembers the one that fills up and the one before, which bounds its memory.
PIECES, WORDS = 200_000, 100_000
#: Fixed value: the public pattern that lets a text be cut at white space before it is matched; texts under other patterns are matched whole.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that isn't alone between words: such a text is matched as a whole too.
_LOOSE = regex.compile(r"\s(?:\s|$)")


class _Memory:
    """Word -> ids as raw integers. What is in use moves on to each new generation."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def missing(self, words: set[str]) -> list[str]:
        """Those that aren't remembered; the others are in the newest generation afterwards."""
        new = words.difference(self.now)
        if len(self.now) + len(new) > self.most:  # a new generation starts, which needs all of them
            self.before, self.now, new = self.now, {}, words
        found = new.intersection(self.before)
        self.now |= {w: self.before[w] for w in found}
        return list(new.difference(found))


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find, self.cut = ranks, regex.compile(pattern).findall, pattern == SPACED
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.length = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        tokens = list(ranks)
        keys = np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens), np.uint64, len(tokens))
        self.hash = PerfectHash.build(keys)
        self.entries: list[bytes] = [b""] * len(tokens)
        for slot, token in zip(self.hash.slots(keys).tolist(), tokens, strict=True):
            self.entries[slot] = token
        self.ids = [ranks[t] for t in self.entries]
        # Ranks of pairs of bytes by 256 * first + second: every merge begins with these.
        self.pair = [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]
        self.pieces, self.words, self.firsts = _Memory(PIECES), _Memory(WORDS), _Memory(WORDS)

    @classmethod
    def from_file(cls, data: bytes, pattern: str) -> ByteBpe:
        """From the lines of a rank file: base64 of the bytes, a space, the rank."""
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}, pattern)

    def lookup(self, pieces: list[bytes]) -> list[int | None]:
        """The ids of pieces that are entries: one probe each, and a comparison with the entry in the slot."""
        slots = self.hash.slots(np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64, len(pieces))).tolist()
        return [self.ids[slot] if slot >= 0 and self.entries[slot] == piece else None for slot, piece in zip(slots, pieces, strict=True)]

    def merge(self, piece: bytes) -> list[int]:
        """Merges by rank, leftmost first among equals: parts are a linked list over byte positions, pairs wait in a heap."""
        n, rank, pair = len(piece), self.ranks.get, self.pair
        end = list(range(1, n + 2))  # where the part that starts here ends; n once it is merged away, and nothing ends at 0
        end[n] = 0
        before = list(range(-1, n))
        # A pair waits as one integer: rank, start and end, the latter of as many bits as positions need.
        bits = n.bit_length()
        mask, high = (1 << bits) - 1, 2 * bits
        heap = [r << high | i << bits | i + 2 for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := pair[a << 8 | b]) is not None]
        heapify(heap)
        while heap:
            least = heappop(heap)
            i, stop = least >> bits & mask, least & mask
            middle = end[i]
            if end[middle] != stop:
                continue  # a part of this pair has changed meanwhile
            end[i], end[middle], before[stop] = stop, n, i
            if stop < n and (r := rank(piece[i : (after := end[stop])])) is not None:
                heappush(heap, r << high | i << bits | after)
            if i and (r := rank(piece[(p := before[i]) : stop])) is not None:
                heappush(heap, r << high | p << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : (i := end[i])]))
        return out

    def _learn_pieces(self, pieces: set[str]) -> None:
        new = self.pieces.missing(pieces)
        known, coded = self.pieces.now, [p.encode() for p in new]
        for name, piece, whole in zip(new, coded, self.lookup(coded), strict=True):
            ids = self.merge(piece) if whole is None else (whole,)
            known[name] = pack(f"={len(ids)}i", *ids)

    def _cut_word(self, word: str, before: str) -> list[str]:
        """The pre-tokens of a word and what stands before it; the usual kinds need no pattern."""
        if word.isalpha():
            return [before + word]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [before + word[:-1], word[-1]]
        return self.find(before + word)

    def _learn_words(self, memory: _Memory, words: set[str], before: str) -> None:
        new = memory.missing(words)
        found = [self._cut_word(w, before) for w in new]
        self._learn_pieces(set(chain.from_iterable(found)))
        known = self.pieces.now
        memory.now |= {w: known[some[0]] if len(some) == 1 else b"".join([known[p] for p in some]) for w, some in zip(new, found, strict=True)}

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as raw 32-bit integers of the machine."""
        cuts: list[tuple[list[str], list[list[str]]] | list[str]] = []
        firsts, words, pieces = set(), set(), set()
        for text in texts:
            if not self.cut or _LOOSE.search(text):
                found = self.find(text)
                pieces.update(found)
                cuts.append(found)
            else:
                # Every space starts a pre-token here and every line break is one, so lines are cut before their spaces.
                lines = [line.split(" ") for line in text.split("\n")]
                for line in lines:
                    words.update(line[1:])
                firsts.update(line[0] for line in lines)
                cuts.append(lines)
        firsts.add("\n")
        self._learn_words(self.firsts, firsts, "")
        self._learn_words(self.words, words, " ")
        self._learn_pieces(pieces)
        first, word, piece, gap = self.firsts.now.__getitem__, self.words.now.__getitem__, self.pieces.now.__getitem__, self.firsts.now["\n"]
        out = []
        for own in cuts:
            if own and isinstance(own[0], list):
                out.append(gap.join([first(line[0]) + b"".join(map(word, line[1:])) for line in own]))
            else:
                out.append(b"".join(map(piece, own)))
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids; `ends` tells where runs end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.bytes_of)):
            raise ValueError("an id outside the vocabulary")
        length = self.length[ids]
        upto = np.cumsum(length)
        whole = self.blob[np.repeat(self.start[ids] - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        stops = np.concatenate(([0], upto))[ends].tolist()
        return [whole[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def _codec(data: bytes, pattern: str) -> ByteBpe:
    """The codec of this worker process."""
    return kept(("bpe", xxhash.xxh128_hexdigest(data + pattern.encode())), lambda: ByteBpe.from_file(data, pattern))


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, decode: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) for each row, and `decoded` (binary, from those ids) if asked for. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in slices(batches):
            coded = codec.encode([text or "" for text in batch.column(1).to_pylist()])
            flat = np.frombuffer(b"".join(coded), np.int32)
            ends = np.cumsum([len(x) // 4 for x in coded])
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))]
            if decode:
                columns.append(pa.array(codec.decode(flat, ends), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decode)


def decode_documents(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids); null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in slices(batches):
            own = [x or [] for x in batch.column(1).to_pylist()]
            found = codec.decode(np.fromiter(chain.from_iterable(own), np.int64), np.cumsum([len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what encode_documents(..., decode=True) returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
