"""Toxicity scores by a convolutional text classifier in numpy.

A word's embedding is the sum of hashed vectors of the word, its first four and its first six letters. Filters over one,
two and three neighbouring words, rectified, keep their largest response in the whole text (max pooling), and a linear layer
gives the log-odds. A bounded sample of labelled rows, balanced by class and weighted back to the real counts, gives all tasks one
start. Where there are more labelled rows than that, every one of them counts: four fifths (by a hash of the text, so copies stay together) are learned
task by task from the start, and the tasks' weights are averaged; the other fifth calibrates. On rows kept apart the score is bent so that 0.3
is the threshold of best F1, and each language with enough
toxic rows gets its own threshold, which `score_documents` applies where it is given a language column. Scores never see it.

Defined cases: null and empty texts have no words and score 0.3 times the share of toxic rows, which is below the threshold; labels other than 0 and 1 and null
labels aren't learned; several labels of one doc_id are each a row; without both classes every score is 0. Other columns pass unseen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.llm.common import hash_sample, kept, slices, written

#: Bounds of the start's sample: rows and characters of each class, in hash order, and of a text.
SAMPLE_ROWS, SAMPLE_CHARS, LONGEST = 3000, 12_000_000, 60_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 12, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 32, 0.01
CUT = 0.3
#: Samples under this are scored by models of the other three quarters to be calibrated.
SMALL = 1500
REMEMBERED = 300_000
#: The pass over every labelled row: its step size, and the rows and words of a minibatch (a longer text is one of its own).
FINE_RATE, FINE_BATCH, BATCH_WORDS = 0.002, 64, 100_000
#: Parts in which the tasks' weights are added up, and steps of log-odds in which scores of rows kept apart are counted.
PARTS, STEPS = 64, 64
_PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def features(word: str) -> tuple[int, int, int]:
    """Buckets of a lower-cased word, its first four and its first six letters; bucket 0 is left for no word."""
    w = word.strip(_PUNCTUATION) or word
    return tuple(1 + crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for x in ("w" + w, "4" + w[:4], "6" + w[:6]))


@dataclass
class Cnn:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    intercept: float = 0.0
    cut: float = 0.5
    trained: bool = False
    share: float = 0.0
    by_language: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((0, DIM), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "vectors")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def learn(self, words: set[str]) -> None:
        """Embeds words that are not remembered; beyond the bound all are forgotten first. Row 0 is no word."""
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        if not len(self.vectors):
            self.vectors = np.zeros((1 << 14, DIM), np.float32)
        new = list(words.difference(self.known))
        start = 1 + len(self.known)
        if start + len(new) > len(self.vectors):
            grown = np.zeros((max(start + len(new), 2 * len(self.vectors)), DIM), np.float32)
            grown[: len(self.vectors)] = self.vectors
            self.vectors = grown
        if new:
            at = np.array([features(w) for w in new])
            self.vectors[start : start + len(new)] = self.embedding[at].sum(1)
            self.known |= {w: i for i, w in enumerate(new, start)}

    def log_odds(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        out = np.full(len(texts), self.intercept, np.float64)
        full = [i for i, w in enumerate(words) if w]
        if not full:
            return out
        self.learn(set().union(*words))
        pad = max(WIDTHS) - 1
        lengths = np.array([len(words[i]) + pad for i in full])
        starts = np.cumsum(lengths) - lengths
        at = np.zeros(int(lengths.sum()) + pad, np.int64)
        for i, start in zip(full, starts.tolist(), strict=True):
            at[start : start + len(words[i])] = np.fromiter(map(self.known.__getitem__, words[i]), np.int64, len(words[i]))
        x = self.vectors[at]
        # Filters begin at a text's words only: from the padding they would look into the next text.
        between = np.flatnonzero(at[: len(x) - pad] == 0)
        for k, width in enumerate(WIDTHS):
            seen = x[: len(x) - pad] @ self.filters[k][:DIM]
            for j in range(1, width):
                seen += x[j : len(x) - pad + j] @ self.filters[k][j * DIM : (j + 1) * DIM]
            seen[between] = -np.inf
            top = np.maximum(np.maximum.reduceat(seen, starts, axis=0) + self.bias[k], 0)
            out[full] += top @ self.out[k * FILTERS : (k + 1) * FILTERS]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """0 to 1; bent so that the calibrated cut lies at 0.3."""
        if not self.trained:
            return np.zeros(len(texts))
        spoken = np.array([bool(t.split()) for t in texts])
        return np.where(spoken, _bend(_sigmoid(self.log_odds(texts)), self.cut), CUT * self.share)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _bend(p: np.ndarray, cut: float) -> np.ndarray:
    return np.where(p < cut, CUT * p / cut, CUT + (1 - CUT) * (p - cut) / max(1e-12, 1 - cut))


def _best_cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle between the two scores around the threshold of best weighted F1."""
    order = np.argsort(-p, kind="stable")
    hit, flagged = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (flagged + (weight * y).sum())
    k = int(np.argmax(f1))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + below) / 2, 1e-4, 1 - 1e-4))


def fit(texts: list[str], toxic: np.ndarray, languages: list[str | None], counts: tuple[int, int], apart: np.ndarray | None = None, seed: int = 7) -> Cnn:
    """The model of `learned` rows, bent by scores of rows that it hasn't seen: a fifth of a large sample; of a small one, every row's
    score by the one of four models that was learned without it. Where rows are set apart already it learns from the others and isn't bent."""
    y = np.asarray(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return _learn(texts, y, np.arange(len(y)), counts, seed)
    if apart is not None:
        return _learn(texts, y, np.flatnonzero(~apart), counts, seed)
    order = np.random.default_rng(seed).permutation(len(y))
    small = len(y) < SMALL
    folds = [order[i::4] for i in range(4)] if small else [order[: len(y) // 5]]
    apart = np.concatenate(folds)
    seen = []
    for fold in folds:
        model = _learn(texts, y, np.setdiff1d(order, fold), counts, seed)
        seen.append(np.concatenate([model.log_odds([texts[i] for i in fold[k : k + 256]]) for k in range(0, len(fold), 256)]))
    if small:
        model = _learn(texts, y, np.sort(order), counts, seed)
    p = _sigmoid(np.concatenate(seen))
    share = counts[1] / max(1, sum(counts))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.cut = _best_cut(p, y[apart], weight[apart])
    spoken = np.array([languages[i] or "" for i in apart])
    for lang in sorted(set(spoken.tolist()) - {""}):
        own = spoken == lang
        if y[apart][own].sum() >= 20:
            model.by_language[lang] = float(_bend(np.array([_best_cut(p[own], y[apart][own], weight[apart][own])]), model.cut)[0])
    model.forget()
    return model


def _learn(texts: list[str], y: np.ndarray, learned: np.ndarray, counts: tuple[int, int], seed: int) -> Cnn:
    """A model of the rows `learned`, all in memory."""
    rng = np.random.default_rng(seed)
    model = Cnn(rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.3 / np.sqrt(w), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32))
    if not len(learned) or y[learned].min() == y[learned].max():
        return model
    learned = learned.copy()
    table: dict[str, tuple[int, int, int]] = {}
    pad = max(WIDTHS) - 1
    docs: dict[int, np.ndarray] = {}
    for i in learned.tolist():
        words = texts[i].lower().split()
        table |= {w: features(w) for w in set(words) - table.keys()}
        # Buckets of each word, and as many empty words as a filter may look ahead.
        docs[i] = np.array([*(table[w] for w in words), *[(0, 0, 0)] * (pad if words else pad + 1)], np.int64)
    share = counts[1] / max(1, sum(counts))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    model.share, model.intercept = float(share), float(np.log(share / (1 - share)))
    weight *= np.where(y == 1, _lift(share), 1)
    steps = _Steps(model, RATE)
    for _ in range(max(EPOCHS, min(40, EPOCHS * 1500 // len(learned)))):  # small samples are read more often
        rng.shuffle(learned)
        for k in range(0, len(learned), BATCH):
            own = learned[k : k + BATCH]
            steps.step([docs[i] for i in own.tolist()], y[own], weight[own])
    # Buckets that no gradient has touched are those of words that say nothing.
    model.embedding[steps.touched == 0] = 0
    model.embedding[0] = 0
    model.trained = True
    model.forget()
    return model


def _lift(share: float) -> float:
    """Weight of toxic rows while learning: halfway to equal classes."""
    return float(np.sqrt((1 - share) / share))


class _Steps:
    """Adam on minibatches, each one array of words; gradients flow through each filter's largest response only."""

    def __init__(self, model: Cnn, rate: float):
        self.model, self.rate = model, rate
        self.params = [model.embedding, *model.filters, *model.bias, model.out]
        self.first, self.second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        self.b_first, self.b_second, self.done = 0.0, 0.0, 0
        self.touched = np.zeros(len(model.embedding), np.float32)

    def step(self, parts: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> None:
        """parts: buckets of each text's words, and as many empty words as a filter may look ahead."""
        model, first, second, pad = self.model, self.first, self.second, max(WIDTHS) - 1
        lengths = np.array([len(p) for p in parts])
        starts, stops = np.cumsum(lengths) - lengths, np.cumsum(lengths) - pad  # filters begin before the padding
        words = np.concatenate(parts)
        model.embedding[0] = 0
        e = model.embedding[words[:, 0]] + model.embedding[words[:, 1]] + model.embedding[words[:, 2]]
        tops, ats = np.zeros((len(parts), len(model.out)), np.float32), np.zeros((len(parts), len(model.out)), np.int64)
        for f, width in enumerate(WIDTHS):
            cols = slice(f * FILTERS, (f + 1) * FILTERS)
            seen = e[: len(e) - pad] @ model.filters[f][:DIM]
            for j in range(1, width):
                seen += e[j : len(e) - pad + j] @ model.filters[f][j * DIM : (j + 1) * DIM]
            ats[:, cols] = [a + seen[a:b].argmax(0) for a, b in zip(starts, stops, strict=True)]
            tops[:, cols] = np.maximum(seen[ats[:, cols], np.arange(FILTERS)] + model.bias[f], 0)
        tops[words[starts, 0] == 0] = 0  # texts without a word
        z = tops @ model.out + model.intercept
        d = ((_sigmoid(z) - y) * w / w.sum()).astype(np.float32)
        grads = [np.zeros_like(p) for p in self.params[1:]]
        grads[-1] = tops.T @ d
        back = d[:, None] * model.out[None, :] * (tops > 0)
        rows, moved = [], []
        for f, width in enumerate(WIDTHS):
            cols = slice(f * FILTERS, (f + 1) * FILTERS)
            g = back[:, cols]
            grads[len(WIDTHS) + f] = g.sum(0)
            doc, live = np.nonzero(g)
            for j in range(width):
                place = slice(j * DIM, (j + 1) * DIM)
                at = ats[:, cols] + j
                grads[f][place] = np.einsum("rfd,rf->df", e[at], g)
                rows.append(words[at[doc, live]].ravel())
                moved.append(np.repeat(model.filters[f][place].T[live] * g[doc, live][:, None], 3, 0))
        self.done += 1
        fade1, fade2, rate = 1 - 0.9**self.done, 1 - 0.999**self.done, self.rate
        for p, g, m, v in zip(self.params[1:], grads, first[1:], second[1:], strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / fade1) / (np.sqrt(v / fade2) + 1e-8)
        at, place = np.unique(np.concatenate(rows), return_inverse=True)  # only the touched rows of the embedding move
        if len(at):
            g = np.stack([np.bincount(place, x, len(at)) for x in np.concatenate(moved).T], 1).astype(np.float32)
            first[0][at] += 0.1 * (g - first[0][at])
            second[0][at] += 0.001 * (g * g - second[0][at])
            model.embedding[at] -= rate * (first[0][at] / fade1) / (np.sqrt(second[0][at] / fade2) + 1e-8)
            self.touched[at] += 1
        g0 = float(d.sum())
        self.b_first += 0.1 * (g0 - self.b_first)
        self.b_second += 0.001 * (g0 * g0 - self.b_second)
        model.intercept -= rate * (self.b_first / fade1) / (np.sqrt(self.b_second / fade2) + 1e-8)


class _Buckets(dict):
    """Buckets of words; a worker keeps up to a bound of them."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = features(word)
        return found


def _learn_rows(rows: DataFrame, start: Cnn) -> Cnn:
    """The start after one pass over rows (text, y): each task goes on from it through its own rows, then weights are averaged: an
    embedding by the steps that moved it, all others by the tasks' rows. Tasks send sums by blocks of buckets, which Spark adds up."""
    shared, block = rows.sparkSession.sparkContext.broadcast(start), BUCKETS // PARTS
    dense = lambda m: np.concatenate([*[p.ravel() for p in (*m.filters, *m.bias, m.out)], [m.intercept]])
    kinds, share = "part int, packed binary", start.share

    def pack(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in found.values()], pa.binary())], ["part", "packed"])

    def unpack(packed: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(packed), np.float64)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, rng, n, pad = deepcopy(shared.value), _Buckets(), np.random.default_rng(7), 0, max(WIDTHS) - 1
        steps, lift = _Steps(model, FINE_RATE), _lift(share)
        for batch in slices(batches):
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float32)
            parts, own, size = [], [], 0
            for i in [*rng.permutation(len(texts)).tolist(), None]:
                if parts and (i is None or len(parts) >= FINE_BATCH or size >= BATCH_WORDS):
                    steps.step(parts, y[own], np.where(y[own] == 1, lift, 1).astype(np.float32))
                    parts, own, size = [], [], 0
                if i is not None:
                    words = (texts[i] or "").lower().split()
                    parts.append(np.array([*map(known.__getitem__, words), *[(0, 0, 0)] * (pad if words else pad + 1)], np.int64))
                    own.append(i)
                    size += len(words)
            n += len(texts)
        if not n:
            return
        moved = (model.embedding - shared.value.embedding).astype(np.float64) * steps.touched[:, None]
        sums = {p: np.concatenate([moved[p * block : (p + 1) * block], steps.touched[p * block : (p + 1) * block, None]], 1).ravel() for p in range(PARTS) if steps.touched[p * block : (p + 1) * block].any()}
        yield pack(sums | {PARTS: np.append(dense(model) * n, float(n))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[p] = sums.get(p, 0) + unpack(packed.as_py())
        yield pack(sums)

    model = deepcopy(start)
    for r in rows.select("text", "_y").mapInArrow(learn, kinds).repartition(PARTS, "part").mapInArrow(add, kinds).collect():
        found = unpack(bytes(r.packed))
        if r.part < PARTS:
            found = found.reshape(block, DIM + 1)
            model.embedding[r.part * block : (r.part + 1) * block] += (found[:, :DIM] / np.maximum(found[:, DIM:], 1)).astype(np.float32)
            continue
        means, at = found[:-1] / found[-1], 0
        for p in (*model.filters, *model.bias, model.out):
            p[...] = means[at : at + p.size].reshape(p.shape)
            at += p.size
        model.intercept = float(means[-1])
    model.embedding[0] = 0
    model.forget()
    return model


def _calibrate(rows: DataFrame, model: Cnn) -> None:
    """Bends the scores by every row (text, _y, _lang) kept apart: log-odds are counted in steps, by class and language."""
    shared, name = rows.sparkSession.sparkContext.broadcast(model), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("toxicity", name), lambda: shared.value)
        for batch in slices(batches):
            at = np.floor(np.clip(own.log_odds([t or "" for t in batch.column(0).to_pylist()]), -30, 30) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at)], ["y", "lang", "at"])

    counted = written(rows.select("text", "_y", "_lang").mapInArrow(run, "y int, lang string, at int").groupBy("lang", "y", "at").agg(F.count("*").alias("n")))

    def cut(found: list) -> float:
        by = {}
        for r in found:
            by.setdefault(r["at"], [0, 0])[r.y] += r.n
        both = np.array([by[k] for k in sorted(by, reverse=True)], float)
        # A step's rows fall on one side together.
        hit, flagged = np.cumsum(both[:, 1]), np.cumsum(both.sum(1))
        k = int(np.argmax(2 * hit / (flagged + both[:, 1].sum())))
        at = sorted(by, reverse=True)[k]
        below = max((x for x in by if x < at), default=None)
        low = _sigmoid(np.array((below + 1) / STEPS)) if below is not None else 0.0
        return float(np.clip((_sigmoid(np.array(at / STEPS)) + low) / 2, 1e-4, 1 - 1e-4))

    found = counted.groupBy("y", "at").agg(F.sum("n").alias("n")).collect()
    if len({r.y for r in found}) < 2:
        return
    model.cut = cut(found)
    enough = counted.where("y = 1 and lang <> ''").groupBy("lang").agg(F.sum("n").alias("n")).where("n >= 20").select("lang")
    by_language: dict[str, list] = {}
    for r in counted.join(enough, "lang", "left_semi").collect():
        by_language.setdefault(r.lang, []).append(r)
    model.by_language = {k: float(_bend(np.array([cut(v)]), model.cut)[0]) for k, v in sorted(by_language.items())}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Cnn:
    """Learns from every labelled row of docs. At most sample_rows distinct texts of each class and SAMPLE_CHARS characters of them, in hash
    order, are the start; if these are all there are they are the whole training."""
    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_y"))
    counts = {r._y: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    language = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", "text", language.alias("_lang"), F.xxhash64("text").alias("_h"), F.length("text").cast("long").alias("_n"))
    # The sample is drawn from keys of labelled texts that may be taken, each text once; the texts follow for those drawn.
    joined = written(marked.join(texts.select("doc_id", "_h", "_n"), "doc_id").distinct())
    drawn = hash_sample(joined.where(F.col("_n") <= LONGEST), "_y", F.xxhash64("doc_id", "_h"), sample_rows)
    chosen = written(drawn.withColumn("_sum", F.sum("_n").over(Window.partitionBy("_y").orderBy("_r"))).where(F.col("_sum") <= SAMPLE_CHARS).select("_y", "_r", "doc_id", "_h"))
    rows = texts.join(F.broadcast(chosen), ["doc_id", "_h"]).dropDuplicates(["_y", "_r"]).orderBy("_y", "_r").collect()
    some = [r.text for r in rows], np.array([r._y for r in rows]), [r._lang for r in rows], (counts.get(0, 0), counts.get(1, 0))
    if joined.where("_n is not null").count() <= len(rows):
        return fit(*some)
    start = fit(*some, np.array([r._h % 5 == 0 for r in rows], bool))
    if not (start and start.trained):
        return start
    # Joined in one way at every size: texts are moved once, and never wait for a whole table of labels.
    whole = texts.join(marked.hint("merge"), "doc_id").where("_n is not null").withColumn("_apart", F.pmod("_h", F.lit(5)) == 0)
    model = _learn_rows(whole.where(~F.col("_apart")), start)
    _calibrate(whole.where("_apart"), model)
    return model


def score_documents(docs: DataFrame, model: Cnn, language: str | None = None) -> DataFrame:
    """(doc_id, score, predicted at 0.3), and flagged_by_language at the threshold of the language in that column if one is
    named (0.3 for languages without their own). No shuffle."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, score double, predicted int" + ", flagged_by_language boolean" * (language is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("toxicity", name), lambda: shared.value)  # it remembers words between tasks
        for batch in slices(batches):
            scores = own.score([t or "" for t in batch.column(1).to_pylist()])
            columns = [batch.column(0), pa.array(scores), pa.array((scores >= CUT).astype(np.int32))]
            if language is not None:
                cuts = np.array([own.by_language.get(x, CUT) for x in batch.column(2).to_pylist()])
                columns.append(pa.array(scores >= cuts))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "flagged_by_language"][: len(columns)])

    return docs.select("doc_id", "text", *([language] if language else [])).mapInArrow(run, kinds)
