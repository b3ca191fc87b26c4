"""Benchmark decontamination by template windows.

Words lose punctuation at their ends and case; words of punctuation alone go. Beside this plain form, a template form has
typed placeholders for numbers, units and names (capitalised words). A capitalised word that begins a sentence may be a name or
not, and is read both ways. Windows of five words of both forms are hashed; template windows with fewer than LITERAL words that are no
placeholders say nothing (a row of numbers is like any other) and are left out on both sides. Documents keep only windows whose hash some benchmark window has, told from a broadcast table of hashes that is
filled in blocks of bounded size, so that a benchmark of any size takes more blocks, not more memory. The windows left are
hash-joined with the benchmark's. A document holds an item if windows near each other cover 0.8 of the item's words: in
plain form, or in template form when the slots agree, that is when equal values of the item are equal in the document (read along an
alignment of both texts, and from the windows nearest to it where words were put in or left out); or if a run
of 30 words stands in both, whatever part of the item that is. Items of two to four words are one window of their own width, and
an item of one word is held by documents of that word alone.

The join is bounded by an exact prefix filter: covering that much takes at least k of an item's window positions, so one of all but the
k - 1 most frequent positions is among them. Only those rarer windows find candidates; frequent ones are looked up for candidates alone.

Defined cases: null and empty documents and items match nothing; of rows that repeat both doc_id and text one decision holds
for all; items that repeat an item_id are found under it, each by its own words. Other columns are not looked at, and
`without_benchmark` passes them on.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.llm.common import as_bytes, kept, slices, written

WIDTH = 5
COVERED = 0.8
#: Words in a row, in plain form, that are proof by themselves.
RUN = 30
#: Words of a template window that are no placeholders, at least.
LITERAL = 2
#: Distinct hashes of benchmark windows that are looked for in one pass over the documents.
BLOCK = 4_000_000
REMEMBERED = 300_000
#: Kinds of windows; items of n < WIDTH words have the kind SHORT + n.
PLAIN, TEMPLATE, SHORT = 0, 1, 10
_NUMBER = re.compile(rb"[$]?[+-]?[0-9][0-9.,:/]*[%]?$")
_GLUED = re.compile(rb"[$]?[0-9][0-9.,]*[a-z]{1,3}$")
# Words for numbers and units.
_NUMBER_WORDS = frozenset(b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice double triple".split())
_UNITS = frozenset(b"mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces lb lbs oz ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres".split())
_ENDS = b".!?\"'):;,([{<>|*#$%&-_/\\`~^=+@"
_QUOTES = "\u2018\u2019\u201c\u201d\u00ab\u00bb\u2013\u2014\u2026\u00bf\u00a1"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WINDOWS = "kind int, h long, pos int, slots array<string>"


class _Words:
    """What is known of a raw word, by number: hashes of its plain form and of its template form at a sentence's start and
    inside, whether it ends a sentence, whether anything is left of it. A worker keeps up to a bound of words."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 14, 3), np.uint64)
        self.flags = np.zeros((1 << 14, 2), bool)

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.number)
        if len(self.number) + len(new) > REMEMBERED:
            self.forget()
            new = words
        new = list(new)
        start, digest, usual, name = len(self.number), xxhash.xxh64_intdigest, _NUMBER_WORDS | _UNITS, xxhash.xxh64_intdigest(b"\x01name")
        while start + len(new) > len(self.rows):
            self.rows, self.flags = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.flags, np.zeros_like(self.flags)])
        rows, flags = [], []
        for word in new:
            last = word[-1:]
            ends = last in b".!?"
            stem = word[:-1] if ends or last == b"," else word
            # ASCII letters, lower-cased or capitalised, need no patterns: all forms are the word, or a name inside a sentence.
            if stem.isalpha() and stem[1:].islower() and (plain := stem.lower()) not in usual:
                h = digest(plain)
                rows.append((h, h, h if plain == stem else name))
                flags.append((ends, True))
            else:
                plain, first, inside = forms(word)
                rows.append((digest(plain), digest(first), digest(inside)))
                flags.append((ends, bool(plain)))
        if rows:
            self.rows[start : start + len(rows)] = np.array(rows, np.uint64)
            self.flags[start : start + len(rows)] = flags
            self.number |= {w: i for i, w in enumerate(new, start)}


def bare(word: bytes) -> bytes:
    """Lower-cased, without punctuation at the ends."""
    return word.strip(_ENDS).decode("utf-8", "replace").lower().strip(_QUOTES).encode()


def forms(word: bytes) -> tuple[bytes, bytes, bytes]:
    """Plain form, template form at a sentence's start, template form inside a sentence."""
    plain = bare(word)
    if _NUMBER.match(plain) or _GLUED.match(plain) or plain in _NUMBER_WORDS:
        return plain, b"\x01number", b"\x01number"
    if plain in _UNITS:
        return plain, b"\x01unit", b"\x01unit"
    stem = word.strip(_ENDS).decode("utf-8", "replace").strip(_QUOTES)
    named = stem[:1].isupper() and not (len(stem) > 1 and stem.isupper())
    return plain, plain, b"\x01name" if named else plain


_SLOTS = frozenset((b"\x01number", b"\x01unit", b"\x01name"))
_SLOT_HASHES = np.array([xxhash.xxh64_intdigest(x) for x in sorted(_SLOTS)], np.uint64)


def _windows(texts: list[bytes], wanted: tuple[np.ndarray, np.ndarray] | None, widths: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[list[str]]]]:
    """For each text and kind: text number, kind, window hashes, positions, slots. `widths` are those of short items. With `wanted`, only
    windows whose hash is in its sorted array, pre-filtered by its table of high bits."""
    words = [t.split() for t in texts]
    remembered = kept(("decontam",), _Words)
    remembered.learn(set().union(*words))
    lengths = np.array([len(w) for w in words])
    n = int(lengths.sum())
    ids = np.fromiter(map(remembered.number.__getitem__, chain.from_iterable(words)), np.int64, n)
    owner = np.repeat(np.arange(len(texts)), lengths)
    ends, stays = remembered.flags[ids, 0], remembered.flags[ids, 1]
    starts_sentence = np.ones(n, bool)
    starts_sentence[1:] = ends[:-1] | (owner[1:] != owner[:-1])
    raw = np.flatnonzero(stays)  # where each word that is left stands in the text
    ids, owner, starts_sentence = ids[raw], owner[raw], starts_sentence[raw]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    before = np.cumsum(lengths) - lengths
    table = remembered.rows

    def asked(sums: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Where windows that lie in one text are wanted."""
        if wanted is None:
            return np.flatnonzero(near)
        known, bits = wanted
        at = np.flatnonzero(near & bits[(sums >> np.uint64(44)).astype(np.int64)])
        return at[known[np.minimum(np.searchsorted(known, sums[at]), len(known) - 1)] == sums[at]]

    def hashed(parts: list[np.ndarray], kind: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.full(len(parts[0]), np.uint64(kind + 1))
            for part in parts:
                sums = (sums ^ part) * _BASE
                sums ^= sums >> np.uint64(32)
        return sums

    def by_text(sums: np.ndarray, at: np.ndarray, kind: int, way: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[list[str]]]]:
        for doc in np.unique(owner[at]).tolist():
            here = owner[at] == doc
            slots = []
            for i in at[here].tolist():
                found = []
                if kind == TEMPLATE:
                    for j in range(i, i + WIDTH):
                        word = words[doc][raw[j] - before[doc]]
                        if forms(word)[1 if starts_sentence[j] and not way >> (j - i) & 1 else 2] in _SLOTS:
                            found.append(bare(word).decode("utf-8", "replace"))
                slots.append(found)
            yield doc, kind, sums[here].view(np.int64), (at[here] - first[doc]).astype(np.int32), slots

    for width in widths:
        if len(ids) >= width:
            m = len(ids) - width + 1
            near = owner[:m] == owner[width - 1 :]
            if width == 1:
                near = (first[1:] - first[:-1] == 1)[owner]
            sums = hashed([table[ids[j : j + m], 0] for j in range(width)], SHORT + width)
            at = asked(sums, near)
            yield from by_text(sums[at], at, SHORT + width, 0)
    if len(ids) < WIDTH:
        return
    m = len(ids) - WIDTH + 1
    whole = owner[:m] == owner[WIDTH - 1 :]
    plain = table[ids, 0]
    sums = hashed([plain[j : j + m] for j in range(WIDTH)], PLAIN)
    at = asked(sums, whole)
    yield from by_text(sums[at], at, PLAIN, 0)
    inside = table[ids, 2]
    h = np.where(starts_sentence, table[ids, 1], inside)

    def telling(at: np.ndarray, way: int) -> np.ndarray:
        """Whether windows that begin there, of those asked for, hold enough words that are no placeholders."""
        parts = [(inside if way >> j & 1 else h)[at + j] for j in range(WIDTH)]
        return sum(np.isin(x, _SLOT_HASHES).astype(np.int8) for x in parts) <= WIDTH - LITERAL

    sums = hashed([h[j : j + m] for j in range(WIDTH)], TEMPLATE)
    at = asked(sums, whole)
    at = at[telling(at, 0)]
    yield from by_text(sums[at], at, TEMPLATE, 0)
    # A capitalised sentence start has two readings; windows that hold some are read in every other way too.
    either = starts_sentence & (h != inside)
    ways = np.zeros(m, np.uint8)
    for j in range(WIDTH):
        ways |= either[j : j + m].astype(np.uint8) << np.uint8(j)
    some = np.flatnonzero(whole & (ways > 0))
    for way in range(1, 1 << WIDTH):
        own = some[(ways[some] & way) == way]
        if len(own):
            sums = hashed([inside[own + j] if way >> j & 1 else h[own + j] for j in range(WIDTH)], TEMPLATE)
            at = asked(sums, np.ones(len(own), bool))
            at = at[telling(own[at], way)]
            yield from by_text(sums[at], own[at], TEMPLATE, way)


def _sizes(texts: list[bytes]) -> list[int]:
    return [sum(bool(bare(w)) for w in t.split()) for t in texts]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, n_words, kind, h, pos, slots) of every window of every item; item is the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch.column(2))
            sizes = _sizes(texts)
            for doc, kind, h, pos, slots in _windows(texts, None, list(range(1, WIDTH))):
                n, k = sizes[doc], len(h)
                if kind > SHORT and kind != SHORT + n:
                    continue  # an item is a window of its own width only
                yield pa.RecordBatch.from_arrays([*(pa.array([batch.column(i)[doc].as_py()] * k, batch.column(i).type) for i in (0, 1)), pa.array([n] * k, pa.int32()), pa.array([kind] * k, pa.int32()), pa.array(h), pa.array(pos), pa.array(slots, pa.list_(pa.string()))], ["item_id", "item", "n_words", "kind", "h", "pos", "slots"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.where("text is not null").select("item_id", F.xxhash64("text").alias("item"), "text").mapInArrow(run, f"item_id {kind}, item long, n_words int, {_WINDOWS}")


def _hits(docs: DataFrame, hashes: np.ndarray, widths: list[int]) -> DataFrame:
    """Windows of the documents whose hash is among these."""
    bits = np.zeros(1 << 20, bool)
    bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast((hashes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [(pa.array([batch.column(0)[doc].as_py()] * len(h), pa.int64()), pa.array([batch.column(1)[doc].as_py()] * len(h), pa.int64()), pa.array([kind] * len(h), pa.int32()), pa.array(h), pa.array(pos), pa.array(slots, pa.list_(pa.string()))) for doc, kind, h, pos, slots in _windows(as_bytes(batch.column(2)), shared.value, widths)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], ["doc", "row", "kind", "h", "pos", "slots"])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row"), "text").mapInArrow(run, f"doc long, row long, {_WINDOWS}")


Windows = list[tuple[list[tuple[int, list[str]]], list[tuple[int, list[str]]]]]


def _reach(n_words: int) -> int:
    return n_words + n_words // 2 + WIDTH


def _covered(n_words: int, windows: Windows) -> float:
    """The largest part of an item's words that windows near each other cover, whatever their slots. Equal windows that follow
    each other within reach are one span, so that repetition costs no more than its positions."""
    reach, events = _reach(n_words), []
    for k, (own, theirs) in enumerate(windows):
        words = sorted({j for i, _ in theirs for j in range(i, i + WIDTH)})
        first = last = None
        for pos in sorted(p for p, _ in own):
            if last is None or pos - last > reach:
                if last is not None:
                    events += [(first, 0, k, words), (last + reach, 1, k, words)]
                first = pos
            last = pos
        if last is not None:
            events += [(first, 0, k, words), (last + reach, 1, k, words)]
    times, covered, best = [0] * n_words, 0, 0
    for _, ends, _, words in sorted(events, key=lambda e: e[:3]):
        for j in words:
            if ends:
                times[j] -= 1
                covered -= times[j] == 0
            else:
                covered += times[j] == 0
                times[j] += 1
        best = max(best, covered)
    return best / n_words


def _agreeing(n_words: int, windows: Windows) -> float:
    """The same, with slots that agree, as far as COVERED. For each alignment of the two texts its own windows come first, then those nearest
    to it; a window that contradicts the values read so far doesn't count."""
    if _covered(n_words, windows) < COVERED:
        return 0.0
    at: dict[int, dict[int, list[tuple[list[str], list[str]]]]] = {}  # by word of the item and alignment: slots of both sides
    for own, theirs in windows:
        for item_pos, wanted in theirs:
            by_shift = at.setdefault(item_pos, {})
            for pos, found in own:
                by_shift.setdefault(pos - item_pos, []).append((found, wanted))
    shifts = {i: sorted(x) for i, x in at.items()}
    best, reach = 0.0, n_words // 2 + WIDTH
    for base in sorted({d for x in shifts.values() for d in x}):
        order = []
        for i, own in shifts.items():
            k = bisect_left(own, base)
            order += [(abs(d - base), i, d) for d in own[max(0, k - 1) : k + 2] if abs(d - base) <= reach]
        if 5 * len({i for _, i, _ in order}) < COVERED * n_words:
            continue
        covered, values = set(), {}
        for _, i, d in sorted(order):
            for found, wanted in at[i][d]:
                read = dict(zip(wanted, found, strict=False))
                if all(read[w] == f for w, f in zip(wanted, found, strict=False)) and all(values.get(w, f) == f for w, f in read.items()):
                    values |= read
                    covered.update(range(i, i + WIDTH))
                    break
        best = max(best, len(covered) / n_words)
        if best >= COVERED:
            break
    return best


def _longest_run(n_words: int, windows: Windows) -> int:
    """Words of the longest run that stands in both texts: a row of the item's positions goes along the document's."""
    places = {pos: k for k, (own, _) in enumerate(windows) for pos, _ in own}
    theirs = [np.array(sorted(i for i, _ in t), np.int64) for _, t in windows]
    row, last, best = np.zeros(n_words + 2, np.int64), None, 0
    for pos in sorted(places):
        items = theirs[places[pos]]
        now = np.zeros(n_words + 2, np.int64)
        now[items + 1] = row[items] + 1 if last == pos - 1 else 1
        row, last, best = now, pos, max(best, int(now[items + 1].max(initial=0)))
    return best + WIDTH - 1 if best else 0


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        out = []
        for n_words, shared in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if n_words < WIDTH:
                out.append((1.0, 1.0, n_words))
                continue
            by_kind: dict[int, Windows] = {PLAIN: [], TEMPLATE: []}
            for m in shared:
                by_kind[m["kind"]].append(tuple([(x["pos"], x["slots"]) for x in m[side]] for side in ("own", "theirs")))
            plain, run = _covered(n_words, by_kind[PLAIN]), _longest_run(n_words, by_kind[PLAIN])
            out.append((plain, plain if plain >= COVERED else _agreeing(n_words, by_kind[TEMPLATE]), run))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.int32())], ["doc", "row", "item_id", "plain", "template", "run"])


def _finding(items: DataFrame, hits: DataFrame) -> DataFrame:
    """(item_id, item, kind, h) of the windows that find candidates: all but the most frequent positions that can't all be missing."""
    often = hits.groupBy("kind", "h").agg(F.count("*").alias("_often"))
    at = items.join(often, ["kind", "h"]).groupBy("item_id", "item", "n_words", "kind", "pos").agg(F.sum("_often").alias("_often"), F.collect_set("h").alias("h"))
    # Positions that no document has are the rarest of all: those present come after them.
    present = Window.partitionBy("item_id", "item", "kind")
    needed = F.when(F.col("n_words") < WIDTH, 1).otherwise(F.least(F.ceil(F.col("n_words") * COVERED / WIDTH - 1e-9), F.lit(RUN - WIDTH + 1)))
    ranked = at.withColumn("_left", F.row_number().over(present.orderBy(F.desc("_often"), "pos")))
    return ranked.where(F.col("_left") >= needed).select("item_id", "item", "kind", F.explode("h").alias("h"))


def matches(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc, row, item_id, plain, template, run) for documents and items that they hold; row is the hash of the document's text."""
    spark, items = docs.sparkSession, written(item_windows(benchmark))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc long, row long, item_id {kind}, plain double, template double, run int"
    blocks = -(-items.select("h").distinct().count() // block)
    if not blocks:
        return spark.createDataFrame([], schema)
    widths = sorted(r.n_words for r in items.where(F.col("n_words") < WIDTH).select("n_words").distinct().collect())
    hits = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b).select("h").distinct().toPandas()["h"].to_numpy(np.int64)
        found = _hits(docs, np.sort(own.view(np.uint64)), widths)
        hits = found if hits is None else hits.unionByName(found)
    hits = written(hits)
    pairs = written(hits.join(_finding(items, hits), ["kind", "h"]).select("doc", "row", "item_id", "item").distinct())
    # Positions of equal windows stay together on both sides, so that a repeated window never multiplies.
    theirs = items.groupBy("item_id", "item", "n_words", "kind", "h").agg(F.collect_list(F.struct("pos", "slots")).alias("theirs"))
    own = hits.groupBy("doc", "row", "kind", "h").agg(F.collect_list(F.struct("pos", "slots")).alias("own"))
    null_safe = lambda a, b, c: a[c].eqNullSafe(b[c])
    joined = pairs.join(theirs, null_safe(pairs, theirs, "item_id") & (pairs["item"] == theirs["item"])).select(pairs["doc"], pairs["row"], pairs["item_id"], pairs["item"], "n_words", "kind", "h", "theirs")
    both = joined.join(own, null_safe(joined, own, "doc") & (joined["row"] == own["row"]) & (joined["kind"] == own["kind"]) & (joined["h"] == own["h"])).select(joined["doc"], joined["row"], joined["item_id"], joined["item"], "n_words", joined["kind"], "own", "theirs")
    grouped = both.groupBy("doc", "row", "item_id", "item").agg(F.max("n_words").alias("n_words"), F.collect_list(F.struct("kind", "own", "theirs")).alias("m"))
    judged = grouped.select("doc", "row", "item_id", "n_words", "m").mapInArrow(_judge, schema)
    return judged.where((F.col("plain") >= COVERED) | (F.col("template") >= COVERED) | (F.col("run") >= RUN))


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids in order, reparameterised: items held in template form only) for each row."""
    found = matches(docs, benchmark).groupBy("doc", "row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sort_array(F.collect_set(F.when((F.col("plain") < COVERED) & (F.col("run") < RUN), F.col("item_id")))).alias("reparameterised"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("_row"))
    joined = keys.join(found, keys["doc_id"].cast("long").eqNullSafe(found["doc"]) & (keys["_row"] == found["row"]), "left")
    kind = found.schema["item_ids"].dataType.simpleString()
    none = F.array().cast(kind)
    return joined.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("reparameterised", none).alias("reparameterised"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    found = matches(docs, benchmark).select("doc", "row").distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["doc"]) & (F.xxhash64(docs["text"]) == found["row"]), "left_anti")
