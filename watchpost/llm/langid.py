"""Language identification by interpolated Kneser-Ney character models.

Each language gets a model of characters within words: a word is lower-cased, gets a mark on both sides and is read with up to
`order` - 1 characters of context, the start mark among them. Counts are Kneser-Ney's: occurrences for the longest n-grams and for those that
begin with the start mark, distinct left neighbours for the others. Each order is interpolated with the next shorter one and the
shortest with a uniform share over all languages' characters and one unseen character, so that probabilities of the next
character sum to 1 in every context. Probabilities of all n-grams that any language has seen are put into one sorted array of
n-gram hashes per order, with a column per language, so that a look-up by binary search scores all languages at once. A text's score for a
language is its cross-entropy per character; the lowest one wins.

Rejection asks whether a text is in any of the languages, mixed ones included: its strangeness is the cross-entropy with each word
under the language that suits it best. It is calibrated on labelled texts that the models haven't learned: excerpts of 1, 2, 4, .. words of them
give the strangeness of true texts of each length, and a limit lies where an exponential tail would leave `FALSE_REJECTS` of them. A
text without a letter, or above its length's limit, is rejected.

Training takes a bounded sample of the labelled rows: texts in hash order until `sample_chars` characters are reached, in equal shares
for the languages; a text of over an eighth of a share is left to others.

Defined cases: null texts and texts without a letter (marks alone are none) are `und` with score 0; equal cross-entropies go to the
first language by name; rows without a language aren't learned; without any labelled row all is `und`. Rows that repeat are
learned once and judged each. With fewer than LEAST_APART labelled texts apart nothing is calibrated, and only texts without a letter are rejected.
Every distinct value of lang is a language and gets an equal share of the sample. Other columns pass unseen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.llm.common import hash_sample, kept, slices, written

ORDER = 5
DISCOUNT = 0.75
#: Bound of the training sample, in characters over all languages, and the rows of a language that it draws from.
SAMPLE_CHARS, SAMPLE_ROWS = 6_000_000, 3000
#: Share of true texts that rejection may cost, by its calibration; one text in APART is kept for that.
FALSE_REJECTS, APART = 1e-6, 5
#: Fewer texts apart than this calibrate nothing: then only texts without a letter are rejected.
LEAST_APART = 30
#: Lengths of excerpts: 1, 2, 4, .. words.
LENGTHS = 12
REMEMBERED = 200_000
UND = "und"
#: Runs of letters that touch no digit, such as those inside a hexadecimal number do; where a text has no others, any run.
_WORD, _ANY = regex.compile(r"(?<![\p{L}\p{M}\p{N}])\p{L}[\p{L}\p{M}]*+(?!\p{N})"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PAD = np.uint32(0x110000)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    low = text.lower()
    return _WORD.findall(low) or _ANY.findall(low)


def _grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each n-gram length, the hash of the n-gram that ends at each character of the marked words (0: the word hasn't that much
    before it); the place of each character in its word, 0 at the start mark, and its word."""
    lengths = np.array([len(w) for w in words], np.int64) + 2
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    chars = np.full(total, _PAD, np.uint32)
    inner = np.ones(total, bool)
    inner[starts] = inner[starts + lengths - 1] = False
    chars[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(total) - np.repeat(starts, lengths)
    out = []
    with np.errstate(over="ignore"):
        one = (chars.astype(np.uint64) + np.uint64(1)) * _BASE
        one ^= one >> np.uint64(29)
        running = one
        for n in range(1, order + 1):
            if n > 1:  # longer by one character on the left
                moved = np.zeros(total, np.uint64)
                moved[n - 1 :] = one[: max(0, total - n + 1)]
                running = (running * np.uint64(0xBF58476D1CE4E5B9)) ^ (moved + np.uint64(n))
                running ^= running >> np.uint64(31)
            out.append(np.where(place >= n - 1, np.maximum(running, np.uint64(1)), np.uint64(0)))
    return out, place, np.repeat(np.arange(len(words)), lengths)


def _counts(words: Counter[str], order: int) -> list[dict]:
    """For each length: the n-grams, their Kneser-Ney counts, their contexts and their shorter n-grams."""
    grams, place, word = _grams(list(words), order)
    times = np.fromiter(words.values(), np.float64, len(words))[word]
    out = []
    for n in range(order):
        here = np.flatnonzero((place > 0) & (place >= n))
        gram = grams[n][here]
        keys, first, which = np.unique(gram, return_index=True, return_inverse=True)
        count = np.bincount(which, times[here], len(keys))
        if n + 1 < order:
            longer = grams[n + 1][here]
            _, distinct = np.unique(longer, return_index=True)
            distinct = distinct[longer[distinct] != 0]
            begins = longer == 0  # with the start mark, which has no left neighbour
            count = np.bincount(which[distinct], minlength=len(keys)) + np.bincount(which[begins], times[here][begins], len(keys))
        context = grams[n - 1][here - 1] if n else np.zeros(len(here), np.uint64)
        short = grams[n - 1][here] if n else np.zeros(len(here), np.uint64)
        out.append({"gram": keys, "context": context[first], "short": short[first], "count": count.astype(float)})
    return out


class KneserNey:
    """`keys[n]` sorted hashes of n-grams of length n + 1, `values[n]` their log-probabilities (languages in columns),
    `backoff[n]` the log-weights that contexts in `contexts[n]` leave to the shorter n-gram, `limits` of strangeness by length."""

    def __init__(self, languages: list[str], keys, values, contexts, backoff, unseen: float, limits: np.ndarray):
        self.languages, self.keys, self.values, self.contexts, self.backoff = languages, keys, values, contexts, backoff
        self.unseen, self.limits = unseen, limits
        self.forget()

    @classmethod
    def train(cls, texts: dict[str, list[str]], order: int = ORDER) -> KneserNey:
        learned = {lang: [t for i, t in enumerate(own) if i % APART != APART - 1] for lang, own in texts.items()}
        counters = {lang: Counter(w for t in own for w in words_of(t)) for lang, own in learned.items()}
        languages = sorted(lang for lang, own in counters.items() if own)
        if not languages:
            return cls([], [], [], [], [], 0.0, np.zeros(LENGTHS))
        per = [_counts(counters[lang], order) for lang in languages]
        keys, values, contexts, backoff, shorter = [], [], [], [], None
        unseen = 1.0 / (len(np.unique(np.concatenate([p[0]["gram"] for p in per]))) + 1)
        for n in range(order):
            all_keys = np.unique(np.concatenate([p[n]["gram"] for p in per]))
            all_contexts = np.unique(np.concatenate([p[n]["context"] for p in per]))
            p_all, weights = np.zeros((len(all_keys), len(languages))), np.ones((len(all_contexts), len(languages)))
            # Which context, and which shorter n-gram, each n-gram has; the same for all languages.
            context_of, short_of = np.zeros(len(all_keys), np.uint64), np.zeros(len(all_keys), np.uint64)
            for p in per:
                at = np.searchsorted(all_keys, p[n]["gram"])
                context_of[at], short_of[at] = p[n]["context"], p[n]["short"]
            at_context = np.searchsorted(all_contexts, context_of)
            for j, p in enumerate(per):
                count = np.zeros(len(all_keys))
                count[np.searchsorted(all_keys, p[n]["gram"])] = p[n]["count"]
                total = np.bincount(at_context, count, len(all_contexts))
                seen = total > 0
                weights[seen, j] = DISCOUNT * np.bincount(at_context, count > 0, len(all_contexts))[seen] / total[seen]
                p_all[:, j] = np.maximum(count - DISCOUNT, 0) / np.where(seen, total, 1)[at_context]
            p_all += weights[at_context] * (unseen if n == 0 else shorter[np.searchsorted(keys[n - 1], short_of)])
            keys.append(all_keys)
            values.append(np.log(p_all).astype(np.float32))
            contexts.append(all_contexts)
            backoff.append(np.log(weights).astype(np.float32))
            shorter = p_all
        model = cls(languages, keys, values, contexts, backoff, float(np.log(unseen)), np.full(LENGTHS, np.inf))
        model.limits = model._calibrated([t for lang in languages for t in texts[lang][APART - 1 :: APART]])
        model.forget()
        return model

    def _calibrated(self, apart: list[str]) -> np.ndarray:
        """Limits of strangeness by length, from excerpts of texts."""
        found: list[list[float]] = [[] for _ in range(LENGTHS)]
        for text in apart:
            words = words_of(text)
            self.learn(set(words))
            for b in range(LENGTHS):
                if len(words) >= 1 << b:
                    for start in np.unique(np.linspace(0, len(words) - (1 << b), 8).astype(int)).tolist():
                        found[b].append(self._entropy(words[start : start + (1 << b)])[2])
        out, last = np.full(LENGTHS, np.inf), np.inf
        for b, own in enumerate(found):
            if len(apart) >= LEAST_APART and len(own) >= 10:
                high = np.quantile(own, 0.9)
                beyond = [x - high for x in own if x > high]
                last = min(last, high + max(0.05, float(np.mean(beyond)) if beyond else 0.0) * np.log(0.1 / FALSE_REJECTS))
            out[b] = last
        return out

    def forget(self) -> None:
        """Drops the remembered words."""
        self.known, self.sums = {}, np.zeros((0, len(self.languages)), np.float32)

    def log_probabilities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each character after the start mark, the end mark included: its log-probability under each language, and its word."""
        grams, place, word = _grams(words, len(self.keys))
        scored = np.flatnonzero(place > 0)
        out = np.zeros((len(place), len(self.languages)), np.float32)
        left, weight = scored, np.zeros((len(place), len(self.languages)), np.float32)
        for k in range(len(self.keys) - 1, -1, -1):
            if not len(left):
                break
            gram = grams[k][left]
            at = np.minimum(np.searchsorted(self.keys[k], gram), len(self.keys[k]) - 1)
            hit = (self.keys[k][at] == gram) & (gram != 0)
            done = left[hit]
            out[done] = weight[done] + self.values[k][at[hit]]
            left, gram = left[~hit], gram[~hit]
            if len(left):  # the context, where it is known, says how much goes to shorter ones
                context = grams[k - 1][left - 1] if k else np.zeros(len(left), np.uint64)
                at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
                known = (self.contexts[k][at] == context) & (gram != 0)
                weight[left[known]] += self.backoff[k][at[known]]
        out[left] = weight[left] + self.unseen
        return out[scored], word[scored]

    def _word_sums(self, words: list[str]) -> np.ndarray:
        """Summed log-probability of each word under each language."""
        p, word = self.log_probabilities(words)
        return np.add.reduceat(p, np.flatnonzero(np.diff(word, prepend=-1)), axis=0)

    def learn(self, words: set[str]) -> None:
        """Scores words that are not remembered; beyond the bound all are forgotten first."""
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        new = list(words.difference(self.known))
        if new:
            start = len(self.known)
            if start + len(new) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros((max(start + len(new), 2 * len(self.sums)) - len(self.sums), len(self.languages)), np.float32)])
            for i in range(0, len(new), 20_000):
                self.sums[start + i : start + i + len(new[i : i + 20_000])] = self._word_sums(new[i : i + 20_000])
            self.known |= {w: i for i, w in enumerate(new, start)}

    def _entropy(self, words: list[str]) -> tuple[np.ndarray, int, float]:
        """Nats per character for each language, the number of characters, and strangeness, of words that are remembered."""
        n = sum(map(len, words)) + len(words)
        sums = self.sums[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
        return -sums.sum(0, dtype=np.float64) / n, n, float(-sums.max(1).sum(dtype=np.float64) / n)

    def cross_entropy(self, text: str) -> tuple[np.ndarray, int]:
        words = words_of(text)
        self.learn(set(words))
        return self._entropy(words)[:2] if words else (np.zeros(len(self.languages)), 0)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Language, score and whether the text is rejected, of each text."""
        all_words = [words_of(t) for t in texts]
        if self.languages:
            self.learn(set().union(*all_words))
        out = []
        for words in all_words:
            if not words or not self.languages:
                out.append((UND, 0.0, True))
                continue
            ce, n, strange = self._entropy(words)
            best = int(np.argmin(ce))
            share = np.exp(-(ce - ce[best]) * min(n, 50))
            out.append((self.languages[best], float(1 / share.sum()), bool(strange > self.limits[min(len(words).bit_length(), LENGTHS) - 1])))
        return out


def training_sample(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Texts by language, in hash order, within the bound."""
    marked = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("_h"), F.length("text").alias("_n"))
    spoken = marked.select("lang").distinct().count()
    if not spoken:
        return {}
    bound = sample_chars // spoken
    short = marked.where(F.col("_n") <= bound // 8)
    # Ranks need only hashes and lengths; the texts of the chosen hashes follow by a join with that small table.
    first = hash_sample(short.select("lang", "_h", "_n").distinct(), "lang", F.col("_h"), SAMPLE_ROWS)
    chosen = first.withColumn("_sum", F.sum("_n").over(Window.partitionBy("lang").orderBy("_r"))).where(F.col("_sum") <= bound).select("lang", "_h")
    texts: dict[str, list[str]] = {}
    # Chosen keys are bounded by the characters of their texts, so they may be broadcast.
    for row in short.join(F.broadcast(written(chosen)), ["lang", "_h"]).dropDuplicates(["lang", "_h"]).select("lang", "_h", "text").orderBy("lang", "_h").toLocalIterator():
        texts.setdefault(row.lang, []).append(row.text)
    return texts


def train(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> KneserNey:
    return KneserNey.train(training_sample(docs, sample_chars))


def predict(docs: DataFrame, model: KneserNey, keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns of `keep` (doc_id if not given) with the predicted language, its score and whether it is rejected, under `names`, for each
    row. No shuffle."""
    keep = ["doc_id"] if keep is None else keep
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid4().hex
    columns, read = [*keep, *names], [*keep, *([] if "text" in keep else ["text"])]
    at = read.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("langid", name), lambda: shared.value)  # it remembers words between tasks
        for batch in slices(batches):
            found = own.predict([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], columns)

    kinds = "".join(f"`{f}` {docs.schema[f].dataType.simpleString()}, " for f in keep)
    # Plain names on the way in, whatever the columns are called.
    plain = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(read)]
    return docs.select(*plain).mapInArrow(run, f"{kinds}`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")
