"""Exact similarity join of documents as sets of word shingles: links at a Jaccard similarity of 0.8 or more, and their components.

Sets are of 64-bit hashes of shingles; equal sets are one class, and only classes are compared. All tokens have one order, rarest
first, by a table of COUNTERS counts over every document (hashes share counters: that moves the order, never a result). Two
similar sets share a token among the first n - ceil(0.8 n) + 1 of each, so these prefixes are the index lists.

What relates sets to each other saves most of the work in long lists:
* entries lie in blocks of near sizes. An entry's position bounds what can still be shared from there on, and so the sizes that it can
  meet: it visits the blocks in that reach and skips the others. Entries out of every other's reach leave their lists;
* the set of a list that has the fewest rarer tokens, its leader, is compared with the others: these are its answers. Links join sets to
  components; a few rounds take the next leaders;
* a list whose sets are one component by then is done: no further link can change anything. Sums by list find that out, not pairs;
* a pair that other lists are left with is first judged from its leader's answers: of the overlaps a and b with a leader of m tokens, the pair
  shares at least a + b - m and at most min(a, b) + min(rests). Where that is open and both are close to the leader, the pair's overlap
  follows from the few tokens in which each differs from it; only the rest is intersected as whole sets.

So no list is ever paired as a whole, none meets in one task, nothing is left out: components are those of all pairs at the similarity.
`n_links` counts the links that had to be verified, not all that hold within a component; with `every` it counts each link of the class.
Then lists stay open until their pairs are decided, not only their components. A set's home is the nearest leader that it was compared with, from
which it lacks g of m tokens and has c others. Two sets of one home share m - g - g' tokens at least, so they are linked for sure where
5 (g + g') + 4 (c + c') <= m: such links are counted by sums over homes, never as pairs. What is over m must be made up for by tokens that both
lack or both have besides, 9 for each, so others of one home meet in lists of these differences only; sets of different homes are judged pair by pair.

Defined cases: null or empty texts, and texts without words, have an empty set, link with nothing and are their own component;
fewer words than a shingle give one shingle of all words; rows that repeat a doc_id keep their own set, class and component; a null
doc_id gets the smallest doc_id of its component, or null where there is none. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpost.llm.common import as_bytes, kept, slices, written
from watchpost.llm.components import components
from watchpost.sources.shared import scratch

WIDTH = 5
#: Similarity of linked sets, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Counters of the token order, as a power of two, and the parts in which tasks' counters are added up.
COUNTERS, PARTS = 21, 128
#: Rounds of leaders before lists are read by blocks, which steers cost only: second leaders joined next to nothing where it was measured.
ROUNDS = 1
#: Blocks of a list hold sizes within a factor of exp(1 / BLOCKS).
BLOCKS = 18
#: Earlier tokens of a set that its entry in a list of differences knows, so that a pair is seldom met twice.
BEFORE = 6
#: Rows of keys and numbers that are broadcast at most; more of them are shuffled.
SMALL = 300_000
#: Words whose hashes a worker remembers, and sets that it knows to have sent already.
REMEMBERED, SENT = 100_000, 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 1 << 18

Keep = Callable[[DataFrame], DataFrame]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _BASE
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    """Hashes of words; a worker keeps up to a bound of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words, remembered = text.lower().split(), kept(("jaccard",), _Words)  # of bytes: only A-Z, and white space is 9 to 13 and 32
    h = np.fromiter(map(remembered.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    if not width:
        return h
    m = len(h) - width + 1
    sums = np.full(m, np.uint64(width))
    for j in range(width):
        sums = _mixed(sums ^ h[j : j + m])
    return np.unique(sums)


def class_of(found: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    h = xxhash.xxh64_intdigest(found.tobytes())
    return h - (1 << 64) if h >> 63 else h


def prefix_length(n: int, similar: tuple[int, int] = SIMILAR) -> int:
    """Tokens of a set among which every similar set has one of its own first ones."""
    most, of = similar
    return n - -(-most * n // of) + 1 if n else 0


def _count_table(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], keep: Keep) -> np.ndarray:
    """How often hashes fall on each of 2^COUNTERS counters, by their upper bits, over all rows of df."""
    size = (1 << COUNTERS) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Four bytes a counter; hashes are counted many at once, as sorted runs, so that nothing else of the table's size is needed.
        counts, waiting, n = np.zeros(1 << COUNTERS, np.uint32), [], 0

        def settle() -> None:
            if waiting:
                at, times = np.unique((np.concatenate(waiting) >> np.uint64(64 - COUNTERS)).astype(np.uint32), return_counts=True)
                counts[at] += times.astype(np.uint32)

        for batch in batches:
            for part in hashes(batch):
                waiting.append(part)
                n += len(part)
                if n > _AT_ONCE:
                    settle()
                    waiting, n = [], 0
        settle()
        parts = [(p, c) for p in range(PARTS) if (c := counts[p * size : (p + 1) * size]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([zlib.compress(c.astype("<u4").tobytes(), 1) for _, c in parts], pa.binary())], ["part", "packed"])

    def unpack(packed: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[p] = sums.get(p, 0) + unpack(packed.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(np.minimum(c, 2**32 - 1).astype("<u4").tobytes(), 1) for c in sums.values()], pa.binary())], ["part", "packed"])

    kinds = "part int, packed binary"
    total = np.zeros(1 << COUNTERS, np.uint32)
    for r in keep(df.mapInArrow(count, kinds)).repartition(PARTS, "part").mapInArrow(add, kinds).collect():
        total[r.part * size : (r.part + 1) * size] = unpack(bytes(r.packed))
    return total


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): row is the hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def _indexed(docs: DataFrame, counts: np.ndarray, width: int, similar: tuple[int, int]) -> DataFrame:
    """(doc_id, row, cls, n, prefix) of each row; prefix is null where the task has sent the same set before. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 2^COUNTERS integers at any size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sent = shared.value, set()
        for batch in slices(batches):
            classes, sizes, prefixes = [], [], []
            for text in as_bytes(batch.column(2)):
                found = shingles(text, width)
                classes.append(class_of(found))
                sizes.append(len(found))
                if not len(found) or classes[-1] in sent:
                    prefixes.append(None)
                    continue
                if len(sent) >= SENT:
                    sent.clear()
                sent.add(classes[-1])
                rarest = np.argsort(table[(found >> np.uint64(64 - COUNTERS)).astype(np.int64)], kind="stable")
                prefixes.append(found[rarest[: prefix_length(len(found), similar)]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "row", "cls", "n", "prefix"])

    return _rows(docs).mapInArrow(run, "doc_id long, row long, cls long, n int, prefix array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, keep: Keep) -> DataFrame:
    """(node, shingles, n) of the classes wanted: (node, doc_id, row). A table of hashes, of one size always, keeps most other texts from
    being read again; those that it lets through drop out by the join."""
    key = F.xxhash64("row", "doc_id")

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)

    shared = docs.sparkSession.sparkContext.broadcast(_count_table(wanted.select(key.alias("h")), hashes, keep) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sent = shared.value, set()
        for batch in slices(batches):
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - COUNTERS)
            chosen = np.flatnonzero(table[at.astype(np.int64)])
            sets = {class_of(s): s for s in (shingles(t, width) for t in as_bytes(batch.column(1).take(pa.array(chosen))))}
            new = {c: s for c, s in sets.items() if c not in sent}
            if len(sent) >= SENT:
                sent.clear()
            sent.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array([s.view(np.int64) for s in new.values()], pa.list_(pa.int64()))], ["node", "shingles"])

    found = keep(_rows(docs).select(key.alias("h"), "text").mapInArrow(run, "node long, shingles array<long>").withColumn("_place", F.monotonically_increasing_id()))
    # Of a set that several tasks have sent the first one stays: places are compared, sets aren't moved.
    first = keep(found.groupBy("node").agg(F.min("_place").alias("_place")).join(wanted.select("node"), "node", "left_semi"))
    return found.join(_bounded(first), ["node", "_place"], "left_semi").drop("_place")


def _bounded(df: DataFrame) -> DataFrame:
    """A written table of few columns, to be broadcast if it has SMALL rows at most."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _may_link(a: str, b: str, similar: tuple[int, int]) -> Column:
    """Whether two sizes can have the similarity."""
    most, of = similar
    return of * F.least(F.col(a), F.col(b)) >= most * F.greatest(F.col(a), F.col(b))


def _enough(shared: Column, total: Column, similar: tuple[int, int]) -> Column:
    """Whether a number of common tokens is enough for two sets of that many tokens together."""
    most, of = similar
    return (most + of) * shared.cast("long") >= most * total.cast("long")


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str, keep: Keep) -> DataFrame:
    """The pairs with both sets, `_sa` and `_sb`; of the two sides `a` should have the fewer different sets. pairs is a written table."""
    second = sets.select(F.col("node").alias(b), F.col("shingles").alias("_sb")).join(_bounded(pairs), b)
    ends = keep(pairs.select(F.col(a).alias("node")).distinct())
    return second.join(sets.join(_bounded(ends), "node", "left_semi").select(F.col("node").alias(a), F.col("shingles").alias("_sa")), a)


def _answers(pairs: DataFrame, sets: DataFrame, keep: Keep) -> DataFrame:
    """(lead, node, m, n, shared, gone, come) of (lead, node, m, n): how many tokens both have, and what the node lacks of its leader
    and has besides; the latter two are null where they are more than half of the node's tokens."""
    both = _with_sets(pairs, sets, "lead", "node", keep).withColumn("shared", F.size(F.array_intersect("_sa", "_sb")))
    near = 2 * (F.col("m") + F.col("n") - 2 * F.col("shared")) <= F.col("n")
    return keep(both.select("lead", "node", "m", "n", "shared", F.when(near, F.array_except("_sa", "_sb")).alias("gone"), F.when(near, F.array_except("_sb", "_sa")).alias("come")))


def _by_answers(pairs: DataFrame, answers: DataFrame, sets: DataFrame, similar: tuple[int, int], keep: Keep) -> DataFrame:
    """(a, b) of the pairs (lead, m, a, b, na, nb) that are similar, judged from their leader's answers as far as these go."""
    own = lambda x, *more: answers.select("lead", F.col("node").alias(x), *[F.col(c).alias(f"_{c}_{x}") for c in more])
    joined = lambda df, *more: df.join(own("a", *more), ["lead", "a"], "left").join(own("b", *more), ["lead", "b"], "left")
    total, a, b = F.col("na") + F.col("nb"), F.coalesce("_shared_a", F.when(F.col("lead") == F.col("a"), F.col("m"))), F.coalesce("_shared_b", F.when(F.col("lead") == F.col("b"), F.col("m")))
    most = F.least(a, b) + F.least(F.col("na") - a, F.col("nb") - b)
    bounded = F.when(_enough(a + b - F.col("m"), total, similar), True).when(~_enough(most, total, similar), False)
    first = keep(joined(pairs, "shared").select("lead", "m", "a", "b", "na", "nb", bounded.alias("linked")))
    exact = F.col("m") - F.size("_gone_a") - F.size("_gone_b") + F.size(F.array_intersect("_gone_a", "_gone_b")) + F.size(F.array_intersect("_come_a", "_come_b"))
    near = F.col("_gone_a").isNotNull() & F.col("_gone_b").isNotNull()
    second = keep(joined(first.where("linked is null").drop("linked"), "gone", "come").select("a", "b", "na", "nb", F.when(near, _enough(exact, total, similar)).alias("linked")))
    whole = _with_sets(keep(second.where("linked is null")), sets, "a", "b", keep).where(_enough(F.size(F.array_intersect("_sa", "_sb")), total, similar))
    return reduce(DataFrame.unionByName, [df.select("a", "b") for df in (first.where("linked"), second.where("linked"), whole)])


def _named(nodes: DataFrame, found: DataFrame, keep: Keep) -> DataFrame:
    """(node, comp) of nodes (node, comp) after the links (a, b) between them have joined components."""
    names = lambda x: nodes.select(F.col("node").alias(x), F.col("comp").alias(f"_{x}"))
    between = keep(found.join(names("a"), "a").join(names("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct())
    if not between.take(1):
        return nodes
    roots = components(between).select(F.col("node").alias("comp"), "root")
    return keep(nodes.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))


def _open_lists(lists: DataFrame, nodes: DataFrame, keep: Keep) -> DataFrame:
    """The entries of lists that hold more than one component, with `comp`. Sums by token, so that no task gets a long list whole."""
    named = keep(lists.join(_bounded(nodes), "node"))
    several = named.groupBy("token").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x <> _y").select("token")
    return keep(named.join(several, "token", "left_semi"))


def _reach(similar: tuple[int, int]) -> Column:
    """The largest size that an entry can meet as the smaller set: by the ratio, and by what follows its position. Under its own size it meets none."""
    most, of = similar
    return F.least(F.floor(of * F.col("n") / most), F.floor((most + of) * (F.col("n") - F.col("pos")) / most) - F.col("n"))


def _blocks(lists: DataFrame, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The entries of lists as smaller sets, in every block of sizes that they reach, and as larger ones, in their own block."""
    block = lambda n: F.floor(F.log(n.cast("double")) * BLOCKS)
    small = lists.withColumn("_reach", _reach(similar)).where(F.col("_reach") >= F.col("n"))
    return small.withColumn("_block", F.explode(F.sequence(block(F.col("n")), block(F.col("_reach"))))).drop("_reach"), lists.withColumn("_block", block(F.col("n")))


def _lists(entries: DataFrame, similar: tuple[int, int], keep: Keep) -> DataFrame:
    """The entries (token, node, n, pos) that can meet another of their list: between the least size and the farthest reach of its smaller sets."""
    reach = F.when(_reach(similar) >= F.col("n"), _reach(similar).cast("int"))
    ends = entries.groupBy("token").agg(F.min("node").alias("_x"), F.max("node").alias("_y"), F.min(F.when(reach.isNotNull(), F.col("n"))).alias("_from"), F.max(reach).alias("_to"))
    live = keep(ends.where("_x <> _y and _to is not null").select("token", "_from", "_to"))
    lists = keep(entries.join(live, "token").where(F.col("n").between(F.col("_from"), F.col("_to"))).drop("_from", "_to").dropDuplicates(["token", "node"]))
    several = lists.groupBy("token").agg(F.min("node").alias("_x"), F.max("node").alias("_y")).where("_x <> _y").select("token")
    return keep(lists.join(several, "token", "left_semi"))


def _met_in_blocks(lists: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(lead, m, a, b, na, nb) of entries of different components that can be similar by sizes and positions, through blocks. lists: (token, node, n, pos,
    comp, lead, m)."""
    small, large = _blocks(lists, similar)
    left = F.col("n") - F.col("pos")
    small = small.select("token", "_block", "lead", "m", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("_ca"), left.alias("_la"))
    large = large.select("token", "_block", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("_cb"), left.alias("_lb"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = small.join(large, ["token", "_block"]).where(ordered & (F.col("_ca") != F.col("_cb")) & _may_link("na", "nb", similar) & _enough(F.least("_la", "_lb"), F.col("na") + F.col("nb"), similar))
    return met.groupBy("a", "b", "na", "nb").agg(F.min(F.struct("lead", "m")).alias("_l")).select("_l.lead", "_l.m", "a", "b", "na", "nb")


def _homes(lists: DataFrame, answers: DataFrame, similar: tuple[int, int], keep: Keep) -> DataFrame:
    """(node, comp, x, most) of every set in a list: its home as comp, and how far it is from it; two sets of a home are linked for sure where their x
    add up to `most` at most. Of the leaders that a set is linked with, the home is one that many are linked with and that is near it: leaders live
    with others too. Sets that are near no leader are their own home."""
    most, of = similar
    far = of * F.size("gone") + most * F.size("come")
    own = answers.where("gone is not null and come is not null").select("node", "lead", "m", far.alias("x"))
    own = keep(own.unionByName(answers.select(F.col("lead").alias("node"), "lead", "m", F.lit(0).alias("x")).distinct()))
    limit = (of - most) * F.col("m")
    guests = keep(own.where(F.col("x") <= limit).groupBy("lead").agg(F.count(F.lit(1)).alias("_guests")))
    order = F.when(F.col("x") <= limit, -F.col("_guests") * (1 - F.col("x") / (limit + 1))).otherwise(F.col("x").cast("double"))
    nearest = own.join(guests, "lead").groupBy("node").agg(F.min(F.struct(order.alias("o"), "x", "lead", "m")).alias("_l"))
    found = lists.select("node").distinct().join(nearest, "node", "left")
    return keep(found.select("node", F.coalesce("_l.lead", "node").alias("comp"), F.coalesce("_l.x", F.lit(0)).alias("x"), F.coalesce((of - most) * F.col("_l.m"), F.lit(0)).alias("most")))


def _met_at_home(homes: DataFrame, answers: DataFrame, similar: tuple[int, int], keep: Keep) -> DataFrame:
    """(lead, m, a, b, na, nb) of sets of one home that aren't linked for sure and can be: their x exceed `most` by what their common differences from
    the home make up for, so only sets that differ from it in a common token meet. Differences of one set alone are common to none."""
    widest = keep(homes.groupBy("comp").agg(F.max("x").alias("_far")))
    open_ = homes.join(widest, "comp").where((F.col("x") > 0) & (F.col("x") + F.col("_far") > F.col("most"))).select("node", F.col("comp").alias("lead"), "x", "most")
    known = answers.where("gone is not null and come is not null").select("lead", "node", "m", "n", F.explode(F.concat("gone", "come")).alias("token"))
    each = keep(known.join(_bounded(keep(open_)), ["lead", "node"]))
    shared = keep(each.groupBy("lead", "token").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1"))
    by_node = Window.partitionBy("node").orderBy("_k", "token")
    met = each.join(shared, ["lead", "token"]).withColumn("_left", F.count(F.lit(1)).over(Window.partitionBy("node")) - F.row_number().over(by_node) + 1)
    met = keep(met.withColumn("_before", F.collect_list("token").over(by_node.rowsBetween(-BEFORE, -1))))
    side = lambda x: met.select("lead", "token", "m", "most", F.col("node").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "x", "_left", "_before")])
    total = F.col("xa") + F.col("xb")
    could = (total > F.col("most")) & (total <= F.col("most") + sum(similar) * F.least("_lefta", "_leftb"))
    # Of the tokens that two sets have in common the first is enough; it is the one that the bound above holds for.
    once = ~F.arrays_overlap("_beforea", "_beforeb")
    return side("a").join(side("b").drop("m", "most"), ["lead", "token"]).where((F.col("a") < F.col("b")) & could & once).select("lead", "m", "a", "b", "na", "nb").distinct()


def _sure_links(homes: DataFrame, keep: Keep) -> DataFrame:
    """(node, n_links): how many sets of its home each set is linked with for sure, by sums over the homes' values of x."""
    sums = keep(homes.groupBy("comp", "x", "most").agg(F.count(F.lit(1)).alias("_n")))
    other = sums.select("comp", F.col("x").alias("_x"), F.col("_n").alias("_k"))
    met = sums.join(other, "comp").where(F.col("x") + F.col("_x") <= F.col("most")).groupBy("comp", "x").agg(F.sum("_k").alias("_k"))
    return homes.join(met, ["comp", "x"]).select("node", (F.col("_k") - F.when(2 * F.col("x") <= F.col("most"), 1).otherwise(0)).alias("n_links"))


def similar_groups(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, rounds: int = ROUNDS, every: bool = False, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, row, n_shingles, class_id, component_id, n_links) of each row: row is the hash of its text, class_id the smallest doc_id with an
    equal set, component_id the smallest doc_id that links reach, n_links how many links of its class were verified, or, with `every`, how many it has.
    near gives pairs (a, b) of classes (node, row) that another search takes for similar, row being the hash of a text of the class: they are verified first, and
    lists that they join need no more work. It changes no component."""
    with scratch(docs.sparkSession) as keep:

        def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for part in slices(iter([batch])):
                for text in as_bytes(part.column(0)):
                    yield shingles(text, width)

        counts = _count_table(docs.select("text"), hashes, keep)
        rows = keep(_indexed(docs, counts, width, similar))
        classes = keep(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "row")).alias("rep")))
        nodes, found, sure = _joined(docs, rows, classes, width, similar, rounds, every, near, keep)
        ends = found.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n_links"))
        degree = (ends if sure is None else ends.unionByName(sure)).groupBy("node").agg(F.sum("n_links").alias("n_links"))
        named = keep(classes.select(F.col("cls").alias("node"), "class_id").join(nodes, "node", "left").select("node", "class_id", F.coalesce("comp", "node").alias("comp")))
        top = named.groupBy("comp").agg(F.min("class_id").alias("component_id"))
        labels = keep(named.join(top, "comp").join(degree, "node", "left").select(F.col("node").alias("cls"), "class_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
        whole = rows.where("n > 0").join(labels, "cls").select("doc_id", "row", F.col("n").cast("long").alias("n_shingles"), "class_id", "component_id", "n_links")
        empty = rows.where("n = 0").select("doc_id", "row", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
        return written(whole.unionByName(empty))


def _joined(docs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, similar: tuple[int, int], rounds: int, every: bool, near: Callable[[DataFrame], DataFrame] | None, keep: Keep) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(node, comp) of the classes that meet another in a list, and the links (a, b) that were verified. With `every`, these are all links but
    those that (node, n_links) counts."""
    entries = rows.where("prefix is not null").select(F.col("cls").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    lists = _lists(entries, similar, keep)
    nodes = keep(lists.select("node").distinct().withColumn("comp", F.col("node")))
    sets = _sets(docs, nodes.join(classes, nodes["node"] == classes["cls"]).select("node", "rep.doc_id", "rep.row"), width, keep)
    answers = found = before = first = None
    open_ = lists.withColumn("comp", F.col("node"))
    if near is not None:
        size = keep(lists.select("node", "n").distinct())
        taken = near(classes.select(F.col("cls").alias("node"), "rep.row")).select(F.least("a", "b").alias("lead"), F.greatest("a", "b").alias("node")).where("lead <> node").distinct()
        taken = taken.join(size, "node").join(size.select(F.col("node").alias("lead"), F.col("n").alias("m")), "lead").where(_may_link("m", "n", similar))
        answers = _answers(keep(taken.select("lead", "node", "m", "n")), sets, keep)
        found = answers.where(_enough(F.col("shared"), F.col("m") + F.col("n"), similar)).select(F.col("lead").alias("a"), F.col("node").alias("b"))
        nodes = _named(nodes, found, keep)
        open_ = open_ if every else _open_lists(lists, nodes, keep)
    for _ in range(rounds):
        # Leaders have the fewest rarer tokens before the list's own: near copies with few changes of their own.
        ranked = open_.withColumn("_o", F.struct(F.floor(4096 * F.col("pos") / F.col("n")).alias("o"), F.xxhash64("node").alias("h")))
        if before is not None:
            ranked = ranked.join(before, "token").where(F.col("_o") > F.col("_p"))
        leaders = keep(ranked.groupBy("token").agg(F.min(F.struct("_o", "node", "n", "pos", "comp")).alias("l")).select("token", F.col("l._o").alias("_p"), F.col("l.node").alias("lead"), F.col("l.n").alias("m"), F.col("l.pos").alias("_at"), F.col("l.comp").alias("_of")))
        before, first = leaders.select("token", "_p"), first if first is not None else leaders.select("token", "lead", "m")
        left = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("_at"))
        met = open_.join(leaders, "token").where((F.col("comp") != F.col("_of")) & _may_link("m", "n", similar) & _enough(left, F.col("m") + F.col("n"), similar)).select("lead", "node", "m", "n").distinct()
        met = keep(met if answers is None else met.join(answers.select("lead", "node"), ["lead", "node"], "left_anti"))
        own = _answers(met, sets, keep)
        answers = own if answers is None else answers.unionByName(own)
        links = own.where(_enough(F.col("shared"), F.col("m") + F.col("n"), similar)).select(F.col("lead").alias("a"), F.col("node").alias("b"))
        found = links if found is None else found.unionByName(links)
        nodes = _named(nodes, links, keep)
        open_ = _open_lists(open_.drop("comp"), nodes, keep)
        if not open_.take(1):
            break
    sure = inside = None
    if every:
        homes = _homes(lists, answers, similar, keep)
        sure = _sure_links(homes, keep)
        # What the sums count leaves the links found so far.
        home = lambda x: homes.select(F.col("node").alias(x), F.col("comp").alias(f"_c{x}"), F.col("x").alias(f"_x{x}"), F.col("most").alias(f"_m{x}"))
        ordered = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = keep(ordered.join(home("a"), "a").join(home("b"), "b").where("_ca <> _cb or _xa + _xb > _ma").select("a", "b"))
        named = keep(lists.join(_bounded(homes), "node"))
        several = named.groupBy("token").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x <> _y").select("token")
        open_ = keep(named.join(several, "token", "left_semi"))
        inside = keep(_met_at_home(homes, answers, similar, keep))
    if not open_.take(1) and (inside is None or not inside.take(1)):
        return nodes, keep(found), sure
    done = answers.select(F.col("lead").alias("a"), F.col("node").alias("b"))
    done = done.unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _met_in_blocks(open_.join(first, "token"), similar)
    pairs = keep((met if inside is None else met.unionByName(inside)).join(done, ["a", "b"], "left_anti"))
    # What the pairs' leaders haven't been asked yet: as many questions as sets and leaders, not as pairs.
    asked = pairs.select("lead", "m", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("na").alias("n")), F.struct(F.col("b").alias("node"), F.col("nb").alias("n")))).alias("x")).select("lead", "x.node", "m", "x.n").where("lead <> node").distinct()
    more = _answers(keep(asked.join(answers, ["lead", "node"], "left_anti")), sets, keep)
    links = keep(_by_answers(pairs, answers.unionByName(more), sets, similar, keep))
    whole = found.unionByName(links).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _named(nodes, links, keep), keep(whole), sure
