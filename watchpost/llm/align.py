"""Alignment of two tokenizers' tokens over the same bytes: groups between shared cuts, links of overlapping tokens, counts of linked ids.

Tokenizer A is byte-level BPE, B sentence pieces with byte fallback; A reads a space and the text, B adds that space itself. Where neither lets a
token go on, texts are cut into chunks, whose ends both sides share: before a space or line break that follows a visible character, and
between letters and common punctuation. That depends on A's split pattern and B's vocabulary, which are looked at; under others
a text is one chunk. Chunks repeat, so a worker aligns each new one once, many at a time. Within chunks the groups come by divide and
conquer: the byte end common to both sides that is nearest to an interval's middle (found by bisecting the other side's ends) parts
it, both halves go on, an interval without such an end is a group. All intervals of a level go together.

A pair of ids counts as often as its tokens' byte ranges overlap in the corpus. Texts are read once: a row keeps the numbers of its chunks
in its generation, a bounded dictionary of chunks that the task filled meanwhile, which is written beside the rows with each chunk's pairs and
occurrences. Counts come from the generations; so do the sums of counts by chunk, for which the most frequent pairs, KNOWN at most, are broadcast
and all others are joined; rows then meet their generation's sums.

Defined cases: null and empty texts, and texts that one side's tokens don't spell (such as a text that holds U+2581) have no tokens:
zeros, empty arrays and the empty digest; they count nowhere. Names of special tokens inside a text are plain text. Repeated rows count each;
rows that repeat a doc_id keep their own result; a null doc_id stays null. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from watchpost.llm.common import kept, slices, written

#: Chunks that a worker remembers, and the characters of all of them.
CHUNKS, CHARACTERS = 250_000, 4_000_000
#: Chunks of texts, repeats included, of a generation, and pairs of ids that are broadcast.
OCCURRENCES, KNOWN = 4_000_000, 1 << 20
#: Strings that no text may hold to be cut at line breaks and punctuation too; others are cut before spaces only.
_LOOSE = ("  ", " \n", "\n ", "\n\n", "\u180e", "\u200b")
_SPACED = re.compile(r"(?<=[^\s\u180e\u200b])(?= )")
#: Punctuation before which a run of letters ends a chunk, and these letters, all of Latin script.
_POINTS = ".,*$#%&|<>;:!?"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
_WORDED = re.compile(rf"[ \n][{_LETTERS}]++(?![^ \n{_POINTS}])|[ \n]?[^ \n]+")
_JOINED = re.compile(rf"[{_LETTERS}][{_POINTS}]")


def shared_groups(a: np.ndarray, b: np.ndarray, a_parts: np.ndarray, b_parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups as numbers of A and of B tokens, rising. a, b: rising byte ends; the parts' ends, likewise as numbers of tokens, are shared."""
    a0, a1, b0, b1 = np.concatenate(([0], a_parts[:-1])), a_parts, np.concatenate(([0], b_parts[:-1])), b_parts
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a1):
        one = (a1 - a0 <= 1) | (b1 - b0 <= 1)
        leaves.append((a1[one], b1[one]))
        a0, a1, b0, b1 = (x[~one] for x in (a0, a1, b0, b1))
        middle, cut_a, cut_b = (a0 + a1 - 1) // 2, np.full(len(a1), -1), np.full(len(a1), -1)
        left, off = np.arange(len(a1)), 0
        while len(left):
            for at in (middle[left] - off, middle[left] + off)[: 1 + (off > 0)]:
                inside = (at >= a0[left]) & (at < a1[left] - 1)
                j = np.searchsorted(b, a[np.where(inside, at, 0)])
                met = inside & (j < b1[left] - 1) & (j >= b0[left])
                met &= b[np.where(met, j, 0)] == a[np.where(inside, at, 0)]
                cut_a[left[met]], cut_b[left[met]] = at[met] + 1, j[met] + 1
            off += 1
            left = left[(cut_a[left] < 0) & ((middle[left] - off >= a0[left]) | (middle[left] + off < a1[left] - 1))]
        whole = cut_a < 0
        leaves.append((a1[whole], b1[whole]))
        a0, a1, b0, b1, cut_a, cut_b = (x[~whole] for x in (a0, a1, b0, b1, cut_a, cut_b))
        a0, a1, b0, b1 = np.concatenate((a0, cut_a)), np.concatenate((cut_a, a1)), np.concatenate((b0, cut_b)), np.concatenate((cut_b, b1))
    ends = [np.concatenate([x[k] for x in leaves] or [np.zeros(0, np.int64)]) for k in (0, 1)]
    order = np.argsort(ends[0], kind="stable")
    return ends[0][order], ends[1][order]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in A and in B of all tokens whose byte ranges overlap. Arguments are rising byte ends."""
    starts = np.concatenate(([0], a[:-1])) if len(a) else a
    first, last = np.searchsorted(b, starts, "right"), np.searchsorted(b, a, "left")
    n = last - first + 1
    at = np.repeat(np.arange(len(a)), n)
    return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Rows:
    """Rows of numbers of different lengths in one array that grows."""

    def __init__(self, kind: type):
        self.flat, self.ends, self.n, self.used = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0, 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(sizes) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.ends[self.n + 1 : self.n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.n, self.used = self.n + len(sizes), self.used + len(flat)

    def sizes(self, rows: np.ndarray | slice) -> np.ndarray:
        return (self.ends[1 : self.n + 1] - self.ends[: self.n])[rows]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These rows one after the other, and their sizes."""
        sizes = self.sizes(rows)
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.ends[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class Aligner:
    """Both tokenizers of a worker, with the chunks that it remembers by number: ids of both sides, tokens of each group, pairs of linked
    ids, and the text of the groups. A chunk that one side's tokens don't spell is not sound and has none of these."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters, whole = byte_alphabet(), json.loads(a_file)
        spelled: dict[int, bytes] = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in whole["model"]["vocab"].items()}
        spelled |= {t["id"]: t["content"].encode() for t in whole["added_tokens"]}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spelled = [[spelled.get(i, b"") for i in range(max(spelled, default=-1) + 1)], [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]]
        self.length = [np.array([len(x) for x in side]) for side in self.spelled]
        self.told = [[[b"%d%s" % (i, mark) for i in range(len(side))] for mark in marks] for side, marks in zip(self.spelled, ((b",", b"|"), (b",", b";")), strict=True)]
        self.space = self.b.piece_to_id("▁")
        cut = {k: v for k, v in (whole["pre_tokenizer"] or {}).items() if k != "trim_offsets"} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and not whole["normalizer"]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.spaced = cut and not any(re.search("[^▁]▁", p) for p in plain)
        self.worded = self.spaced and self.space >= 0 and not any(_JOINED.search(p) or "\n" in p for p in plain)
        self.number: dict[str, int] = {}
        self.sound = np.zeros(0, bool)
        self.seen = np.zeros(0, np.int64)
        self.rows, self.in_a, self.in_b, self.pairs = [Rows(np.int32), Rows(np.int32)], Rows(np.int32), Rows(np.int32), Rows(np.int64)
        self.text: list[bytes] = []
        self.characters = 0

    def full(self) -> bool:
        return len(self.number) > CHUNKS or self.characters > CHARACTERS

    def forget(self) -> None:
        """Leaves the chunks met most often since the last time, a third of the bounds at most, under new numbers."""
        names = list(self.number)
        often = np.argsort(-self.seen, kind="stable")[: CHUNKS // 3]
        often = np.sort(often[(self.seen[often] > 1) & (np.cumsum([len(names[i]) for i in often.tolist()]) <= CHARACTERS // 3)])
        left = []
        for rows, kind in ((self.rows[0], np.int32), (self.rows[1], np.int32), (self.in_a, np.int32), (self.in_b, np.int32), (self.pairs, np.int64)):
            left.append(Rows(kind))
            if rows.n:
                left[-1].append(*rows.take(often))
        self.rows, (self.in_a, self.in_b, self.pairs) = left[:2], left[2:]
        self.number = {names[i]: k for k, i in enumerate(often.tolist())}
        self.sound, self.seen, self.text = self.sound[often], np.zeros(len(often), np.int64), [self.text[i] for i in often.tolist()]
        self.characters = sum(map(len, self.number))

    def cut(self, text: str) -> list[str]:
        """The chunks of a space and the text."""
        if not self.spaced:
            return [f" {text}"]
        # Single spaces and line breaks between words, and no other white space.
        if not self.worded or any(x in text for x in _LOOSE) or text[0] in " \n" or text[-1] in " \n" or len(text.split()) != text.count(" ") + text.count("\n") + 1:
            return _SPACED.split(f" {text}")
        return _WORDED.findall(f" {text}")

    def learn(self, chunks: set[str]) -> None:
        rest = list(chunks.difference(self.number))
        for k in range(0, len(rest), 8192):
            self._learn(rest[k : k + 8192])

    def _learn(self, new: list[str]) -> None:
        self.number |= {c: i for i, c in enumerate(new, len(self.number))}
        self.characters += sum(map(len, new))
        raw = [c.encode() for c in new]
        # What doesn't begin with a space is read behind a line break, from which no piece goes on, so that B's own space comes before that.
        late = [c[0] != " " for c in new]
        pieces = self.b.encode([f"\n{c}" if l else c[1:] for c, l in zip(new, late, strict=True)], num_threads=1)
        ids = [[e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)], [p[2:] if l else p or [self.space] for p, l in zip(pieces, late, strict=True)]]
        sizes = [np.fromiter(map(len, side), np.int64, len(new)) for side in ids]
        flat = [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(ids, sizes, strict=True)]
        whole, bytes_in = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        spelled = [b"".join([own[i] for i in f.tolist()]) for own, f in zip(self.spelled, flat, strict=True)]
        sound = np.ones(len(new), bool)
        if spelled != [whole, whole] or any((_sums(self.length[k][flat[k]], sizes[k]) != bytes_in).any() for k in (0, 1)):
            x, y = self.spelled
            sound = np.array([b"".join([x[i] for i in a]) == r == b"".join([y[i] for i in b]) for a, b, r in zip(*ids, raw, strict=True)], bool)
            flat = [f[np.repeat(sound, n)] for f, n in zip(flat, sizes, strict=True)]
            sizes = [np.where(sound, n, 0) for n in sizes]
        ends = [np.cumsum(self.length[k][flat[k]]) for k in (0, 1)]
        stops = [np.cumsum(n) for n in sizes]
        i, j = overlaps(*ends)
        n_pairs = np.bincount(np.searchsorted(stops[0], i, "right"), minlength=len(new))
        for k in (0, 1):
            self.rows[k].append(flat[k], sizes[k])
        self.pairs.append(flat[0][i] << 32 | flat[1][j], n_pairs)
        self.sound = np.concatenate((self.sound, sound))
        self._group(flat, sizes, ends, stops)

    def _group(self, flat: list[np.ndarray], sizes: list[np.ndarray], ends: list[np.ndarray], stops: list[np.ndarray]) -> None:
        full = sizes[0] > 0
        groups = shared_groups(*ends, stops[0][full], stops[1][full])
        owner = np.searchsorted(stops[0], groups[0] - 1, "right")  # the chunk of each group
        n_groups = np.bincount(owner, minlength=len(full))
        inside = [np.diff(g, prepend=0) for g in groups]
        self.in_a.append(inside[0], n_groups)
        self.in_b.append(inside[1], n_groups)
        # The text of each group: its A ids, then its B ids, each with the mark that follows.
        last = [np.isin(np.arange(len(f)), g - 1).tolist() for f, g in zip(flat, groups, strict=True)]
        parts = [[marks[end][t] for t, end in zip(f.tolist(), e, strict=True)] for f, e, marks in zip(flat, last, self.told, strict=True)]
        group_of = [np.repeat(np.arange(len(owner)), n) for n in inside]
        order = np.argsort(np.concatenate(group_of), kind="stable")
        both = parts[0] + parts[1]
        lengths = np.fromiter(map(len, both), np.int64, len(both))[order]
        blob = b"".join([both[k] for k in order.tolist()])
        counts = sizes[0] + sizes[1]
        upto = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        self.text += [blob[x:y] for x, y in zip(upto, upto[1:])]


def _cut(batch: pa.RecordBatch, at: int, aligner: Aligner) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the chunks of all texts, and how many each text has; a text that can't be aligned has none."""
    cuts = [aligner.cut(t) if t else [] for t in batch.column(at).to_pylist()]
    aligner.learn(set(chain.from_iterable(cuts)))
    sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
    numbers = np.fromiter(map(aligner.number.__getitem__, chain.from_iterable(cuts)), np.int64, int(sizes.sum()))
    aligner.seen = np.bincount(numbers, minlength=len(aligner.number)) + np.concatenate((aligner.seen, np.zeros(len(aligner.number) - len(aligner.seen), np.int64)))
    odd = ~aligner.sound[numbers]
    if odd.any():
        texts = np.repeat(np.arange(len(sizes)), sizes)
        stays = ~np.isin(texts, texts[odd])
        numbers, sizes = numbers[stays], np.bincount(texts[stays], minlength=len(sizes))
    return numbers, sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of these sizes."""
    upto = np.concatenate((np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, 0)))
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _aligner(files: tuple[bytes, bytes]) -> Aligner:
    """The aligner of this worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
    return kept(("align", *map(xxhash.xxh128_hexdigest, files)), lambda: Aligner(*files))


def _shared(docs: DataFrame, a_file: str, b_file: str):
    return docs.sparkSession.sparkContext.broadcast((Path(a_file).read_bytes(), Path(b_file).read_bytes()))


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, in_a, in_b) of each row: both sides' ids, and how many tokens of either side each group takes. No shuffle."""
    shared = _shared(docs, a_file, b_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        for batch in slices(batches):
            numbers, sizes = _cut(batch, 1, aligner)
            columns = []
            for rows in (*aligner.rows, aligner.in_a, aligner.in_b):
                flat, each = rows.take(numbers)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(_sums(each, sizes)))).astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "a_ids", "b_ids", "in_a", "in_b"])
            if aligner.full():
                aligner.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, in_a array<int>, in_b array<int>")


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))


_STATIC = ("n_a", "n_b", "n_groups", "n_links")
_TOLD = f"gen long, doc_id {{kind}}, {', '.join(f'{n} long' for n in _STATIC)}, groups_sha256 string, numbers array<int>, used array<int>, times array<long>, sizes array<int>, pairs array<long>"


def _told(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Two kinds of rows: those of docs with what their groups tell and the numbers of their chunks, and those of generations (doc_id and
    the rest null) with the chunks used, how often each was, and their pairs. Number `gen` is drawn, so the result is to be written once."""
    shared = _shared(docs, a_file, b_file)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        gen, times, met, form = _drawn(), np.zeros(0, np.int64), 0, None

        def generation() -> pa.RecordBatch:
            used = np.flatnonzero(times)
            pairs, sizes = aligner.pairs.take(used)
            columns = [_lists(x, np.array([len(x)])) for x in (used.astype(np.int32), times[used], sizes.astype(np.int32), pairs)]
            return pa.RecordBatch.from_arrays([pa.array([gen]), pa.nulls(1, form), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), *columns], names)

        names = [x.split()[0] for x in _TOLD.format(kind=kind).split(", ")]
        for batch in slices(batches):
            form = batch.column(0).type
            numbers, sizes = _cut(batch, 1, aligner)
            times = np.bincount(numbers, minlength=len(aligner.number)) + np.concatenate((times, np.zeros(len(aligner.number) - len(times), np.int64)))
            each = np.stack([r.sizes(numbers) for r in (*aligner.rows, aligner.in_a, aligner.pairs)], 1)
            sums, ends, own, text = _sums(each, sizes), np.cumsum(sizes).tolist(), numbers.tolist(), aligner.text
            digests = [hashlib.sha256(b"".join([text[k] for k in own[a:b]])[:-1]).hexdigest() if b > a else "" for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            n = batch.num_rows
            none = [pa.nulls(n, pa.list_(t)) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gen)), batch.column(0), *[pa.array(sums[:, k]) for k in range(4)], pa.array(digests, pa.string()), _lists(numbers.astype(np.int32), sizes), *none], names)
            met += len(numbers)
            if aligner.full() or met > OCCURRENCES:
                yield generation()
                if aligner.full():
                    aligner.forget()
                gen, times, met = _drawn(), np.zeros(0, np.int64), 0
        if met:
            yield generation()

    return docs.select("doc_id", "text").mapInArrow(run, _TOLD.format(kind=kind))


def _drawn() -> int:
    return int.from_bytes(os.urandom(8), "little") >> 1


def _counted(generations: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                times, sizes, pairs = (batch.column(c)[k].values.to_numpy() for c in range(3))
                found, at = np.unique(pairs, return_inverse=True)
                sums = np.zeros(len(found), np.int64)
                np.add.at(sums, at, np.repeat(times, sizes))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums)], ["pair", "n"])

    parts = generations.select("times", "sizes", "pairs").mapInArrow(run, "pair long, n long")
    sums = written(parts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")))
    most = sums.groupBy("b").agg(F.max("n").alias("_most"))
    return written(sums.join(most, "b").select("pair", "b", "n", (F.col("n") == F.col("_most")).alias("best")))


def pair_counts(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(pair, b, n, best): how often a pair of ids (A's in the upper 32 bits) is linked, and whether no pair of its B id is linked more often."""
    return _counted(written(_told(docs, a_file, b_file).where("used is not null")))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs, counts and best of the pairs that are linked most often, `most` pairs at most."""
    sizes = counts.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count("*").alias("c"), F.min("n").alias("n")).orderBy(F.desc("k")).collect()  # a few hundred rows
    total = least = 0
    for r in sizes:
        total += r.c
        if total > most:
            break
        least = r.n
    if not least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(F.col("n") >= least).select("pair", "n", F.col("best").cast("long")).toArrow()
    pairs, times, best = (x.to_numpy() for x in rows.columns)
    order = np.argsort(pairs)
    return pairs[order], times[order], best[order]


def _valued(generations: DataFrame, counts: DataFrame, known: int) -> DataFrame:
    """(gen, used, best, total, more): of each chunk used, its links whose count is the highest of their B id, and the sum of their counts. What pairs
    outside the broadcast add stands in `more`, (number, best, total) of the chunks that have some."""
    frequent = generations.sparkSession.sparkContext.broadcast(_frequent(counts, known))  # `known` pairs at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, best = frequent.value
        for batch in batches:
            for k in range(batch.num_rows):
                used, sizes, flat = (batch.column(c)[k].values.to_numpy() for c in range(1, 4))
                if len(pairs):
                    at = np.minimum(np.searchsorted(pairs, flat), len(pairs) - 1)
                    met = pairs[at] == flat
                    scores = np.where(met[:, None], np.stack((best[at], times[at]), 1), 0)
                else:
                    met, scores = np.zeros(len(flat), bool), np.zeros((len(flat), 2), np.int64)
                sums = _sums(scores, sizes.astype(np.int64))
                columns = [used, np.ascontiguousarray(sums[:, 0]), np.ascontiguousarray(sums[:, 1]), np.repeat(used, sizes)[~met], flat[~met]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *[_lists(c, np.array([len(c)])) for c in columns]], ["gen", "used", "best", "total", "number", "pair"])

    values = written(generations.select("gen", "used", "sizes", "pairs").mapInArrow(run, "gen long, used array<int>, best array<long>, total array<long>, number array<int>, pair array<long>"))
    left = values.where(F.size("pair") > 0).select("gen", F.explode(F.arrays_zip("number", "pair")).alias("x")).select("gen", "x.number", "x.pair")
    added = left.join(counts, "pair").groupBy("gen", "number").agg(F.sum(F.col("best").cast("long")).alias("best"), F.sum("n").alias("total"))
    more = added.groupBy("gen").agg(F.collect_list(F.struct("number", "best", "total")).alias("more"))  # CHUNKS at most
    return values.select("gen", "used", "best", "total").join(more, "gen", "left")


def alignment_statistics(docs: DataFrame, a_file: str, b_file: str, known: int = KNOWN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row; the digest is of `a1,a2|b1;a3|b2,b3` in order."""
    told = written(_told(docs, a_file, b_file))
    generations = told.where("used is not null")
    values = _valued(generations, _counted(generations), known)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def met(rows: pa.Table, own: pa.Table) -> pa.Table:
        """The rows of one generation, of OCCURRENCES chunks and one slice more at most, with its chunks' values."""
        rows = rows.combine_chunks()
        if not rows.num_rows:
            return rows.select(["doc_id", *_STATIC]).append_column("n_best", pa.array([], pa.int64())).append_column("count_sum", pa.array([], pa.int64())).append_column("groups_sha256", rows["groups_sha256"])
        lists = rows["numbers"].chunk(0) if rows["numbers"].num_chunks else pa.array([], pa.list_(pa.int32()))
        sizes, numbers = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        table = np.zeros((int(numbers.max(initial=-1)) + 1, 2), np.int64)
        if own.num_rows:
            used, best, total = (own[c][0].values.to_numpy() for c in ("used", "best", "total"))
            table[used] = np.stack((best, total), 1)
            for x in own["more"][0].as_py() or []:
                table[x["number"]] += (x["best"], x["total"])
        sums = _sums(table[numbers], sizes.astype(np.int64))
        return pa.table({"doc_id": rows["doc_id"], **{c: rows[c] for c in _STATIC}, "n_best": sums[:, 0], "count_sum": sums[:, 1], "groups_sha256": rows["groups_sha256"]})

    rows = told.where("used is null").select("gen", "doc_id", *_STATIC, "groups_sha256", "numbers")
    return rows.groupBy("gen").cogroup(values.groupBy("gen")).applyInArrow(met, f"doc_id {kind}, {', '.join(f'{n} long' for n in _STATIC)}, n_best long, count_sum long, groups_sha256 string")
