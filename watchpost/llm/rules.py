"""Quality rules: a decision list learned from labelled statistics of whole texts.

Statistics are counted per text in one pass. Sequential covering then learns the list on a bounded sample of labelled
rows: a rule is a conjunction of thresholds, grown one condition at a time by FOIL gain on two thirds of the
rows left, pruned from its end on the other third, and taken while it stays precise; rows it covers leave, and the next
rule follows. The default is to keep. The list becomes one ordered CASE WHEN over the statistics, so that applying it is a Spark
expression.

Defined cases: null and empty texts have no words and all counts are 0; labels other than 0 and 1 aren't learned;
without rejected rows in the sample the list is empty and keeps all. Input columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpost.llm.common import as_bytes, hash_sample, slices, written

#: Bound of the training sample: labelled rows of each class, in hash order.
SAMPLE_ROWS = 4000
WINDOW = 5
#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks")
#: What rules may look at: name and the SQL that gives it from the counts.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "n_words": "n_words + 0.0",
}
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?"
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))


def _repeated(words: list[bytes]) -> int:
    """Words in windows of five words that occur twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    size, windows = len(index), ids[: n - WINDOW + 1].copy()
    top = size
    for j in range(1, WINDOW):
        if top * size >= 1 << 62:  # name what has been read so far anew, in few numbers
            _, windows = np.unique(windows, return_inverse=True)
            top = len(windows)
        windows = windows * size + ids[j : n - WINDOW + 1 + j]
        top *= size
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def _counted(text: bytes) -> tuple[int, ...]:
    words, lines = text.split(), text.split(b"\n")
    without = lambda some: len(text) - len(text.translate(None, some))
    seen: set[bytes] = set()
    dup = 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += bool(line.split())
            else:
                seen.add(line)
    chars = len(text.translate(None, _CONTINUED))
    return (len(words), len(text.translate(None, _CONTINUED + _SPACE)), without(SYMBOLS), dup, _repeated(words), chars, len(lines), without(_UPPER), without(_LOWER), without(_DIGITS), without(_MARKS))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts of COUNTS as long) for each row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([_counted(x) for x in as_bytes(batch.column(1))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, j]) for j in range(len(COUNTS)))], ["doc_id", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def sql(self) -> str:
        return " AND ".join(f"({c.sql()})" for c in self.conditions)


def _thresholds(values: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Middles between neighbouring distinct values whose rows differ in class; at most 64 by quantile."""
    order = np.argsort(values, kind="stable")
    v, b = values[order], bad[order]
    at = np.flatnonzero((v[1:] != v[:-1]))
    if len(at) > 64:
        turn = at[(b[at] != b[at + 1])]
        at = turn if 0 < len(turn) <= 64 else np.unique(np.concatenate([turn[np.linspace(0, len(turn) - 1, 32).astype(int)] if len(turn) else turn, at[np.linspace(0, len(at) - 1, 32).astype(int)]]))
    return (v[at] + v[at + 1]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Condition]:
    inside, grown = np.ones(len(bad), bool), []
    while len(grown) < longest and bad[inside].mean() < 1:
        p0, n0 = bad[inside].sum(), inside.sum()
        best = (0.0, None, None)
        for name, values in x.items():
            for t in _thresholds(values[inside], bad[inside]):
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    cover = inside & c.holds(x)
                    p, n = bad[cover].sum(), cover.sum()
                    if p:
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if gain > best[0] + 1e-9:
                            best = (gain, c, cover)
        if best[1] is None:
            break
        grown.append(best[1])
        inside = best[2]
    return grown


def learn(x: dict[str, np.ndarray], bad: np.ndarray, longest: int = 3, precision: float = 0.9, support: int = 5, most: int = 12, seed: int = 5) -> list[Rule]:
    """The decision list: rules that reject, in order; rows that none covers are kept."""
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(bad), bool)
    while len(rules) < most and bad[left].sum() >= support:
        at = rng.permutation(np.flatnonzero(left))
        grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
        if not bad[grow].any() or not len(prune):
            break
        conditions = _grow({k: v[grow] for k, v in x.items()}, bad[grow], longest)
        # Keep the prefix that does best on the rows it hasn't seen.
        held, yet = {k: v[prune] for k, v in x.items()}, bad[prune]

        def worth(k: int, conditions=conditions, held=held, yet=yet) -> float:
            cover = Rule(tuple(conditions[:k])).holds(held)
            p, n = yet[cover].sum(), cover.sum()
            return (2 * p - n) / n if n else -1.0

        if not conditions:
            break
        keep = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        rule = Rule(tuple(conditions[:keep]))
        cover = left & rule.holds(x)
        if cover.sum() < support or bad[cover].mean() < precision:
            break
        rules.append(rule)
        left &= ~cover
    return rules


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns from at most sample_rows distinct texts of each class, those of the first labelled rows in hash order; label 0 is what rules reject."""
    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_y"))
    first = hash_sample(marked, "_y", F.xxhash64("doc_id"), sample_rows)
    # The sample's bound holds for labels; a doc_id may have many rows, so the joined texts are bounded again, class by class.
    joined = written(docs.select("doc_id", "text").join(F.broadcast(first.select("doc_id", "_y").distinct()), "doc_id").withColumn("_h", F.xxhash64("text")))
    kept = written(hash_sample(joined.dropDuplicates(["_y", "doc_id", "_h"]), "_y", F.xxhash64("doc_id", "_h"), sample_rows))
    counted = [statistics(kept.where(F.col("_y") == y)).select(F.lit(y).alias("_y"), *[F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()]) for y in (0, 1)]
    rows = counted[0].unionByName(counted[1]).toPandas().sort_values(["_y", *FEATURES], kind="stable")
    if not len(rows):
        return []
    return learn({name: rows[name].to_numpy(float) for name in FEATURES}, rows["_y"].to_numpy() == 0)


def rejecting_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects, from 1; 0 where none does."""
    if not rules:
        return F.lit(0)
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules, 1)) + " ELSE 0 END")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics of each row with base_failed, rule (the rejecting one's number) and kept."""
    judged = statistics(docs).withColumns({"base_failed": base_failed(), "rule": rejecting_rule(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
