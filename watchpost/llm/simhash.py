"""SimHash near-duplicate groups by a generalised pigeonhole search.

Fingerprints of 64 bits are made from word shingles; those that differ in at most `distance` bits are linked, and a group
is a connected component. Equal fingerprints are one class with its smallest doc_id, so copies cost nothing afterwards.

The search splits the 64 bits into parts with thresholds t_i >= -1 where sum(t_i + 1) = distance + 1: two fingerprints
within the distance must be within t_i in some part i. Bits that go together are put into one part (they are told from a
sample of fingerprints, which steers only cost), and dynamic programming over estimated candidate counts picks the thresholds.
Each class probes its value in a part with up to t_i bits turned against the plain values.

A probe whose bucket holds few classes verifies them all. A bucket of more than `bucket` classes is never paired:
its members are dealt again by the values that lie within half the distance of them: any two within the distance share
such a middle value, which few others can be near, and each value links its members to their smallest one.
Links go through large-star / small-star rounds, written to the shared folder each time, until nothing changes.

`similar_groups` takes these links of five-word fingerprints as candidates, verifies them on the sets of shingles and lets the exact join find the
links that 64 bits can't tell.

Defined cases: null text has no words; no words give fingerprint zero, which is linked like any other; fewer words than
a shingle give one shingle of all words; rows that repeat a doc_id keep their own fingerprint and group; a null doc_id
gets its group's smallest doc_id. Input columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpost.llm import jaccard
from watchpost.llm.common import as_bytes, slices, written
from watchpost.llm.components import components

#: Fingerprints that steer the choice of parts and thresholds.
SAMPLE = 20_000
#: Classes in a bucket that are verified one with another; larger buckets take the other way.
BUCKET = 64
_SEED = 42


def _fingerprint(text: bytes, width: int) -> int:
    words = text.lower().split()  # of bytes: only A-Z, and white space is 9 to 13 and 32
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, _SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - width + 1].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    hashes = np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit pattern of each row's fingerprint. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([_fingerprint(x, width) for x in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def correlated_parts(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0..63 in groups of nearly equal size; each group grows by the bit that goes with it most."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    centred = bits - bits.mean(0)
    spread = np.sqrt((centred**2).sum(0))
    spread[spread == 0] = 1
    like = np.abs(centred.T @ centred) / spread[:, None] / spread[None, :]
    left, out = set(range(64)), []
    for p in range(parts):
        size = 64 // parts + (p < 64 % parts)
        group = [max(left, key=lambda b: (like[b, list(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            b = max(left, key=lambda b: (like[b, group].sum(), -b))
            group.append(b)
            left.discard(b)
        out.append(sorted(group))
    return out


def _value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def part_costs(sample: np.ndarray, bits: list[int], total: int, most: int) -> list[float]:
    """Estimated work of one class in a part for thresholds -1, 0, .., most: its probes, and the candidates that they meet."""
    values, counts = np.unique(_value(sample, bits), return_counts=True)
    grown = total / max(1, len(sample))
    costs, met, flips = [0.0], np.zeros(len(values)), 0
    for t in range(most + 1):
        for turned in combinations(range(len(bits)), t):
            other = values ^ np.uint64(sum(1 << i for i in turned))
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            met += np.where(values[at] == other, counts[at], 0)
            flips += 1
        costs.append(flips + float((met * counts).sum() / max(1, counts.sum())) * grown)
    return costs


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 of least total cost, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for k, c in enumerate(own):
                if spent + k <= distance + 1 and (spent + k not in after or cost + c < after[spent + k][0]):
                    after[spent + k] = (cost + c, [*chosen, k - 1])
        best = after
    return best[distance + 1][1]


def choose_parts(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """The parts and thresholds of least estimated cost among two to distance + 2 parts; unused parts are left out."""
    options = []
    for m in range(2, distance + 3):
        groups = correlated_parts(sample, m)
        costs = [part_costs(sample, g, total, min(2, distance)) for g in groups]
        if m * (min(2, distance) + 1) < distance + 1:
            continue
        chosen = allocate(costs, distance)
        options.append((sum(c[t + 1] for c, t in zip(costs, chosen, strict=True)), m, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[:2])[2]


def _bits_of(fp: Column, bits: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), i))
    return out


def _apart(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def _masks(n_bits: int, most: int) -> Column:
    """An array of every pattern of at most `most` among n bits."""
    masks = [sum(1 << i for i in c) for t in range(most + 1) for c in combinations(range(n_bits), t)]
    return F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in masks])


def links(classes: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect what is connected among distinct fingerprints `fp`; each joins two within the distance."""
    spark = classes.sparkSession
    total = classes.count()
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, total)) * (1 << 30))
    sample = np.array([x.fp for x in classes.where(share).limit(2 * SAMPLE).collect()] or [0], np.int64).view(np.uint64)
    if total < 2:
        return spark.createDataFrame([], "a long, b long")
    parts = choose_parts(sample, total, distance)
    plain = [F.struct(F.lit(i).alias("part"), _bits_of(F.col("fp"), bits).alias("v")) for i, (bits, _) in enumerate(parts)]
    held = classes.select("fp", F.explode(F.array(*plain)).alias("k")).select("fp", "k.part", "k.v")
    # How many classes lie in each bucket; only sizes over the bound travel on.
    large = written(held.groupBy("part", "v").count().where(F.col("count") > bucket).select("part", "v"))
    some_large = bool(large.take(1))
    small = held.join(large, ["part", "v"], "left_anti") if some_large else held
    probes = []
    for i, (bits, t) in enumerate(parts):
        turned = classes.select(F.col("fp").alias("a"), _bits_of(F.col("fp"), bits).alias("plain"), F.explode(_masks(len(bits), t)).alias("m"))
        probes.append(turned.select(F.lit(i).alias("part"), F.col("plain").bitwiseXOR(F.col("m")).alias("v"), "a"))
    probed = probes[0]
    for x in probes[1:]:
        probed = probed.unionByName(x)
    near = probed.join(small.withColumnRenamed("fp", "b"), ["part", "v"]).where((F.col("a") != F.col("b")) & _apart("a", "b", distance)).select("a", "b")
    if not some_large:
        return near
    # What probes a large bucket, its own members among it, is dealt by middle values instead of being paired.
    members = probed.join(large, ["part", "v"], "left_semi").select(F.col("a").alias("fp")).distinct()
    return near.unionByName(_by_middle(members, distance))


def _by_middle(members: DataFrame, distance: int) -> DataFrame:
    """Links of members by shared middle values, as stars. Two within distance d share a value within d // 2 of one and
    (d + 1) // 2 of the other; so the smallest member in the inner ring is linked to all in either ring, and every such link holds."""
    inner = distance // 2
    turned = members.select("fp", F.explode(_masks(64, distance - inner)).alias("m"))
    keyed = turned.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"), (F.bit_count("m") <= inner).alias("inside"))
    least = keyed.groupBy("key").agg(F.min(F.when(F.col("inside"), F.col("fp"))).alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").select("key", "least")
    return keyed.join(least, "key").where(F.col("fp") != F.col("least")).select(F.col("fp").alias("a"), F.col("least").alias("b"))


def near_duplicate_groups(docs: DataFrame, width: int = 3, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id, class_id, n_links): each row's fingerprint, the smallest doc_id of its group and of its exact
    class, and the number of links that the search returned for its class (in buckets of over `bucket` classes those are stars)."""
    prints = written(fingerprints(docs, width))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("class_id")))
    found = written(links(classes.select("fp"), distance, bucket).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    degree = found.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(found).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    roots = roots.groupBy("node").agg(F.min("root").alias("root"))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "class_id", F.coalesce("root", "fp").alias("root"))
    top = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    labels = written(named.join(top, "root").join(degree, "fp", "left").select("fp", "class_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id", "class_id", "n_links")


def similar_groups(docs: DataFrame, width: int = jaccard.WIDTH, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """The columns of `jaccard.similar_groups`: groups of documents by shingles of similarity 0.8 or more. Sets of one fingerprint, and those of
    fingerprints within the distance, are verified first; the exact join then looks only at lists that these links leave in several groups."""

    def near(classes: DataFrame) -> DataFrame:
        prints = fingerprints(docs.select(F.xxhash64("text").alias("doc_id"), "text"), width).select(F.col("doc_id").alias("row"), "fp")
        held = written(classes.join(prints.dropDuplicates(["row"]), "row").select("node", "fp"))
        first = written(held.groupBy("fp").agg(F.min("node").alias("first")))
        same = held.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
        own = lambda x: first.select(F.col("fp").alias(x), F.col("first").alias(f"_{x}"))
        found = links(first.select("fp"), distance, bucket).join(own("a"), "a").join(own("b"), "b")
        return same.unionByName(found.select(F.col("_a").alias("a"), F.col("_b").alias("b")))

    return jaccard.similar_groups(docs, width, near=near)
