"""Language-model scores: a log-bilinear model over word classes, trained with noise-contrastive estimation.

Counts of all words of all training texts are gathered first. The most frequent words are classes of their own; any other word,
seen or not, belongs to one of `BUCKETS` classes by its last letters and its final punctuation. The model predicts a class
from the two classes before it: context vectors add up, and their products with the class vectors, normalised over all
classes, are its probabilities. A word within a bucket has (c + 1) / (sum of (c + 1) over the bucket's seen words + 1), the
rest being left for unseen ones. Together that is a distribution over the seen words and one unseen word a bucket.

Workers score texts with the counts of the `HOT` most frequent words at hand (a broadcast of bounded size); each other word of a
text becomes one (word hash, text, times) row that is joined with the table of all counts. Those words are rare, so the join has no hot key.

The classes' vectors begin with a fit on about `SAMPLE_ROWS` training texts, which only gives all tasks one start. Then every task learns
from all training texts of its partition, and the tasks' vectors are averaged by their tokens, so that the vectors learn from the whole corpus. A task's part of the texts is
its input split and its draws follow from the split's number, so scores are the same again for the same splits, and differ in later digits under others.

Defined cases: null text has no words, and its end is scored; A-Z are lower-cased; rows that repeat a doc_id are learned and
scored each; without training texts every probability is that of one unseen token. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpost.llm.common import as_bytes, kept, slices, written

CLASSES, BUCKETS, DIM = 1024, 256, 16
HOT = 131_072
#: The common start: texts by hash, and the longest of them.
SAMPLE_ROWS, LONGEST = 1500, 200_000
EPOCHS, BATCH, NOISE, RATE = 4, 2048, 128, 0.01
#: Learning from all texts: tokens whose order is mixed at once, batches, draws of noise, and the rate with the steps at which it halves.
BLOCK, STEP, DRAWS, FINE, HALVES = 262_144, 4096, 64, 0.004, 200
#: Tasks that add up the vectors of all others.
ADDERS = 8
REMEMBERED = 300_000
#: Words that a task counts before it hands them on.
COUNTED = 400_000
#: The end of a text is counted as the empty word.
END = b""
_PUNCTUATION = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def bucket_of(word: bytes) -> int:
    stem = word.rstrip(_PUNCTUATION)
    mark = 0 if len(stem) == len(word) else 1 if word[-1:] == b"." else 2 if word[-1:] == b"," else 3
    return xxhash.xxh32_intdigest(stem[-4:]) % (BUCKETS // 4) * 4 + mark


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, bucket, c): times of each word of all texts, by the hash of the word; each text has one end."""

    def flush(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        buckets = np.fromiter(map(bucket_of, words), np.int32, len(words))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(buckets), pa.array(np.fromiter(counts.values(), np.int64, len(words)))], ["h", "bucket", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            texts = as_bytes(batch.column(0))
            for text in texts:
                counts.update(text.lower().split())
            counts[END] += len(texts)
            if len(counts) > COUNTED:
                yield flush(counts)
                counts = Counter()
        if counts:
            yield flush(counts)

    return docs.select("text").mapInArrow(run, "h long, bucket int, c long").groupBy("h", "bucket").agg(F.sum("c").alias("c"))


@dataclass
class Lbl:
    """`hot`: sorted hashes of frequent words, with log10(c + 1) and class (-1: its bucket); `within`: log10 of each bucket's
    mass; vectors A1, A2 of the classes as context, Q and bias as target."""

    hot: np.ndarray
    log_count: np.ndarray
    hot_class: np.ndarray
    within: np.ndarray
    total: int
    distinct: int
    a1: np.ndarray
    a2: np.ndarray
    q: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        self.forget()
        n = len(self.q)
        self.log_z = np.full(n * n, np.nan, np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "cls", "gain", "rare", "hash", "base", "log_z")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.cls, self.rare = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)
        self.gain, self.base, self.hash = np.zeros(1 << 14), np.zeros(1 << 14), np.zeros(1 << 14, np.uint64)

    def learn(self, words: set[bytes]) -> None:
        """Looks up words that are not remembered; beyond the bound all are forgotten first."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = words
        new, start = list(new), len(self.known)
        while start + len(new) > len(self.cls):
            for name in ("cls", "rare", "gain", "base", "hash"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        if not new:
            return
        own = slice(start, start + len(new))
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in new), np.uint64, len(new))
        at = np.minimum(np.searchsorted(self.hot, h), max(0, len(self.hot) - 1))
        found = self.hot[at] == h if len(self.hot) else np.zeros(len(new), bool)
        count = np.where(found, self.log_count[at], 0) if len(self.hot) else np.zeros(len(new))
        named = np.where(found, self.hot_class[at], -1) if len(self.hot) else np.full(len(new), -1)
        bucket = np.fromiter(map(bucket_of, new), np.int64, len(new))
        self.hash[own], self.rare[own], self.base[own] = h, ~found, count
        self.cls[own] = np.where(named >= 0, named, CLASSES + bucket)
        # Within its class: nothing for a word that is a class; for others its count, added later where it is rare, over the mass.
        self.gain[own] = np.where(named >= 0, 0, count - self.within[bucket])
        self.known |= {w: i for i, w in enumerate(new, start)}

    def classes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its number among the remembered words, class and the two classes before; and where texts start."""
        words = [[*t.lower().split(), END] for t in texts]
        self.learn(set().union(*words))
        lengths = np.array([len(w) for w in words])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
        cls, end = self.cls[ids], self.cls[self.known[END]]
        one, two = np.roll(cls, 1), np.roll(cls, 2)
        one[starts] = two[starts] = end
        two[(starts + 1)[lengths > 1]] = end
        return ids, cls, one, two, starts

    def log_probability(self, cls: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each class after its context; a context's normaliser is computed once."""
        n = len(self.q)
        context = one * n + two
        open_ = np.unique(context[np.isnan(self.log_z[context])])
        for k in range(0, len(open_), 2048):
            some = open_[k : k + 2048]
            z = (self.a1[some // n] + self.a2[some % n]) @ self.q.T + self.bias
            top = z.max(1)
            self.log_z[some] = top + np.log(np.exp(z - top[:, None]).sum(1))
        energy = np.einsum("ij,ij->i", self.a1[one] + self.a2[two], self.q[cls]) + self.bias[cls]
        return (energy - self.log_z[context]).astype(np.float64) / np.log(10)


def fit_vectors(sequences: list[np.ndarray], unigram: np.ndarray, end: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Noise-contrastive estimation: telling each class from `NOISE` draws of the unigram, which a batch shares."""
    rng, n = np.random.default_rng(seed), len(unigram)
    p = (unigram + 0.5) / (unigram + 0.5).sum()
    log_p, cumulative = np.log(p).astype(np.float32), np.cumsum(p)
    r = rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
    c1, c2 = (np.eye(DIM) * 0.5).astype(np.float32), (np.eye(DIM) * 0.3).astype(np.float32)
    q, bias = rng.normal(0, 0.1, (n, DIM)).astype(np.float32), log_p.copy()
    params = [r, c1, c2, q, bias]
    first, second, step = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
    if sequences:
        cls = np.concatenate(sequences)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sequences])[:-1])).astype(np.int64)
        one, two = np.roll(cls, 1), np.roll(cls, 2)
        one[starts] = two[starts] = end
        second_tokens = (starts + 1)[np.array([len(s) > 1 for s in sequences])]
        two[second_tokens] = end
        for _ in range(EPOCHS):
            order = rng.permutation(len(cls))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                w, a, b = cls[own], one[own], two[own]
                noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), n - 1)
                hat = r[a] @ c1 + r[b] @ c2
                true = np.einsum("ij,ij->i", hat, q[w]) + bias[w] - np.log(NOISE) - log_p[w]
                false = hat @ q[noise].T + bias[noise] - np.log(NOISE) - log_p[noise]
                d_true = (1 / (1 + np.exp(-np.clip(true, -30, 30))) - 1).astype(np.float32) / len(own)
                d_false = (1 / (1 + np.exp(-np.clip(false, -30, 30)))).astype(np.float32) / len(own)
                d_hat = d_true[:, None] * q[w] + d_false @ q[noise]
                grads = [np.zeros_like(x) for x in params]
                np.add.at(grads[3], w, d_true[:, None] * hat)
                np.add.at(grads[3], noise, d_false.T @ hat)
                np.add.at(grads[4], w, d_true)
                np.add.at(grads[4], noise, d_false.sum(0))
                np.add.at(grads[0], a, d_hat @ c1.T)
                np.add.at(grads[0], b, d_hat @ c2.T)
                grads[1], grads[2] = r[a].T @ d_hat, r[b].T @ d_hat
                step += 1
                for x, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return r @ c1, r @ c2, q, bias


class _Learner:
    """Vectors of a task as it reads texts: noise-contrastive estimation from the common start, by Adam on batches."""

    def __init__(self, params: list[np.ndarray], log_p: np.ndarray, seed: int):
        self.params, self.log_p = [p.copy() for p in params], log_p
        self.first, self.second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        self.rng, self.cumulative, self.step, self.tokens = np.random.default_rng(seed), np.cumsum(np.exp(log_p.astype(np.float64))), 0, 0
        self.held, self.size = [], 0

    def read(self, cls: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        self.held.append((cls, one, two))
        self.size += len(cls)
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        cls, one, two = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = self.rng.permutation(len(cls))
        for k in range(0, len(order), STEP):
            own = order[k : k + STEP]
            self._learn(cls[own], one[own], two[own])
        self.tokens += self.size
        self.held, self.size = [], 0

    def _learn(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        a1, a2, q, bias = self.params
        n, shift = len(q), np.float32(np.log(DRAWS))
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(DRAWS) * self.cumulative[-1]), n - 1)
        hat, target, drawn = a1[a] + a2[b], q[w], q[noise]
        true = np.einsum("ij,ij->i", hat, target) + bias[w] - shift - self.log_p[w]
        false = hat @ drawn.T + (bias[noise] - shift - self.log_p[noise])
        d_true = (1 / (1 + np.exp(-np.clip(true, -30, 30))) - 1) / np.float32(len(w))
        d_false = 1 / (1 + np.exp(-np.clip(false, -30, 30))) / np.float32(len(w))
        d_hat, d_target = d_true[:, None] * target + d_false @ drawn, d_true[:, None] * hat
        added = lambda at, rows: np.stack([np.bincount(at, rows[:, j], n) for j in range(rows.shape[1])], 1).astype(np.float32)
        g_q, g_bias = added(w, d_target), np.bincount(w, d_true, n).astype(np.float32)
        np.add.at(g_q, noise, d_false.T @ hat)
        np.add.at(g_bias, noise, d_false.sum(0))
        self.step += 1
        rate = FINE / (1 + self.step / HALVES)
        fade1, fade2 = 1 - 0.9**self.step, 1 - 0.999**self.step
        for x, g, m, v in zip(self.params, (added(a, d_hat), added(b, d_hat), g_q, g_bias), self.first, self.second, strict=True):
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            x -= np.float32(rate / fade1) * m / (np.sqrt(v / np.float32(fade2)) + np.float32(1e-8))


def fit_all(docs: DataFrame, model: Lbl, unigram: np.ndarray) -> None:
    """Vectors learned from every text: each task from the model's own, then their mean by tokens, added up by a few tasks."""
    p = (unigram + 0.5) / (unigram + 0.5).sum()
    shared, name = docs.sparkSession.sparkContext.broadcast((model, np.log(p).astype(np.float32))), uuid4().hex
    shapes = [model.a1.shape, model.a2.shape, model.q.shape, model.bias.shape]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, log_p = kept(("lbl", name), lambda: shared.value)
        part = TaskContext.get().partitionId()
        learner = _Learner([own.a1, own.a2, own.q, own.bias], log_p, part)
        for batch in slices(batches):
            _, cls, one, two, _ = own.classes(as_bytes(batch.column(0)))
            learner.read(cls, one, two)
        learner.flush()
        if learner.tokens:
            yield row(learner.tokens, np.concatenate([x.ravel() for x in learner.params]).astype(np.float64) * learner.tokens)

    def row(tokens: int, summed: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([summed.tobytes()], pa.binary())], ["tokens", "summed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, summed = 0, 0.0
        for batch in slices(batches, 1):
            tokens += batch.column(0)[0].as_py()
            summed = summed + np.frombuffer(batch.column(1)[0].as_py(), np.float64)
        if tokens:
            yield row(tokens, summed)

    kind = "tokens long, summed binary"
    sums = docs.select("text").mapInArrow(learn, kind).repartition(ADDERS, "tokens").mapInArrow(add, kind).collect()
    total = sum(r.tokens for r in sums)
    if total:
        mean, at = sum(np.frombuffer(r.summed, np.float64) for r in sums) / total, 0
        for field, shape in zip(("a1", "a2", "q", "bias"), shapes, strict=True):
            size = int(np.prod(shape))
            setattr(model, field, mean[at : at + size].reshape(shape).astype(np.float32))
            at += size


def train(docs: DataFrame) -> tuple[Lbl, DataFrame]:
    """The model, and the table (h, bucket, c) of all counts, which is written to the shared folder."""
    counts = written(word_counts(docs))
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums.n or 0, sums.v
    # The smallest count of a frequent word, such that no more than HOT words have it.
    floor, taken = 1, 0
    for row in counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).toLocalIterator():
        if taken + row.k > HOT:
            floor = row.c + 1
            break
        taken += row.k
    # The end is a class of its own however rare it is, so it always is among these.
    hot = counts.where((F.col("c") >= floor) & F.lit(taken > 0) | (F.col("h") == _signed(xxhash.xxh64_intdigest(END)))).toPandas()
    h, c = hot["h"].to_numpy(np.int64).view(np.uint64), hot["c"].to_numpy(np.int64)
    buckets = hot["bucket"].to_numpy(np.int64)
    order = np.lexsort((h, -c))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    end = np.uint64(xxhash.xxh64_intdigest(END))
    named = rank < CLASSES - 1
    hot_class = np.where(named, rank, -1)
    hot_class[h == end] = CLASSES - 1
    is_class = hot_class >= 0
    mass = np.zeros(BUCKETS)
    occurrences = np.zeros(BUCKETS)
    for row in counts.groupBy("bucket").agg(F.sum(F.col("c") + 1).alias("m"), F.sum("c").alias("t")).collect():
        mass[row.bucket], occurrences[row.bucket] = row.m, row.t
    np.subtract.at(mass, buckets[is_class], c[is_class] + 1)
    np.subtract.at(occurrences, buckets[is_class], c[is_class])
    unigram = np.zeros(CLASSES + BUCKETS)
    unigram[hot_class[is_class]] = c[is_class]
    unigram[CLASSES:] = occurrences
    place = np.argsort(h)
    blank = np.zeros((CLASSES + BUCKETS, DIM), np.float32)
    model = Lbl(h[place], np.log10(c[place] + 1), hot_class[place], np.log10(mass + 1), int(total), int(distinct), blank, blank, blank, np.zeros(len(blank), np.float32))
    rows = int(c[h == end][0]) if (h == end).any() else 0
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / max(1, rows)) * (1 << 30))
    start = docs.where(share & (F.length("text") <= LONGEST)).select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(2 * SAMPLE_ROWS).toPandas()
    sequences = [model.classes([t.encode()])[1] for t in start["text"]]
    model.forget()
    model.a1, model.a2, model.q, model.bias = fit_vectors(sequences, unigram, CLASSES - 1)
    fit_all(docs, model, unigram)
    return model, counts


def score(docs: DataFrame, model: Lbl, counts: DataFrame, *keep: Column) -> DataFrame:
    """(doc_id, keep.., n_tokens, n_known, train_tokens, base_score, score) for each row; scores are log10 of the text's probability."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid4().hex
    source = docs.select("text", "doc_id", *keep)
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    passed = source.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("lbl", name), lambda: shared.value)  # it remembers words and normalisers between tasks
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            ids, cls, one, two, starts = own.classes(as_bytes(batch.column(0)))
            lengths = np.diff(np.append(starts, len(ids)))
            model_sum = np.add.reduceat(own.log_probability(cls, one, two) + own.gain[ids], starts)
            base = np.add.reduceat(own.base[ids], starts)
            rare = own.rare[ids]
            hot = np.add.reduceat((~rare).astype(np.int64), starts)
            owner = np.repeat(np.arange(len(starts)), lengths)[rare]
            pairs, times = np.unique(owner * len(own.cls) + ids[rare], return_counts=True)
            whose = pairs // len(own.cls)
            offsets = np.searchsorted(whose, np.arange(len(starts) + 1)).astype(np.int32)
            words = own.hash[pairs % len(own.cls)].view(np.int64)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.arange(row, row + n)), pa.array(lengths), pa.array(hot), pa.array(base), pa.array(model_sum), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32)))],
                [*passed, "_row", "n_tokens", "_hot", "_base", "_model", "_words", "_times"],
            )
            row += n

    scored = written(source.mapInArrow(run, ", ".join([*names, "_row long, n_tokens long, _hot long, _base double, _model double, _words array<long>, _times array<int>"])))
    rare = scored.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("x")).select("_row", F.col("x._words").alias("h"), F.col("x._times").alias("times"))
    known = rare.join(counts.select("h", "c"), "h").groupBy("_row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_rare"))
    joined = scored.drop("_words", "_times").join(known, "_row", "left")
    more = F.coalesce("_rare", F.lit(0.0))
    denominator = float(np.log10(model.total + model.distinct + 1))
    return joined.select(
        *passed, "n_tokens", (F.col("_hot") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("_base") + more - F.col("n_tokens") * denominator).alias("base_score"), (F.col("_model") + more).alias("score"),
    )
