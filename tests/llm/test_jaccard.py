"""The similarity join against all pairs of exact word shingles."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from watchpost.llm import jaccard, simhash

SCHEMA = "doc_id long, text string"


def exact_set(text, width=5):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row, sorted."""
    sets = [exact_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) if s else (d, 0, d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(spark, rows, parts=6, **how):
    df = spark.createDataFrame([(d, t, "other", 1) for d, t in rows], "doc_id long, text string, shingles string, node int").repartition(parts)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, **how).collect()), key=str)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def draw(seed):
    """Near copies around the threshold, chains that drift, pages of one template, short texts and the odd cases."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = [(None, "no id but text enough here"), (None, "no id but text enough here"), (1, None), (2, ""), (3, " \n\t"), (4, "Ab"), (5, "aB"), (6, "a b c d e"), (7, "a b c d e f"), (7, "another text of the same id"), (8, "a b c d e f g h"), (9, "a b c d e f g h i")]
    n = 100
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.randrange(8, 260))
        for _ in range(rng.randrange(1, 14)):
            rows.append((n := n + 1, edited(rng, words, rng.randrange(1 + len(words) // 30))))
    words = rng.choices(vocabulary, k=150)
    for _ in range(25):  # a chain: neighbours link, its ends don't
        words = [*words[2:], *rng.choices(vocabulary, k=2)]
        rows.append((n := n + 1, " ".join(words)))
    template = rng.choices(vocabulary, k=220)
    for _ in range(30):  # pairs under one template
        own = rng.choices(vocabulary, k=30)
        rows += [((n := n + 1), " ".join([*template, *own])), ((n := n + 1), edited(rng, [*template, *own], 3))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_all_pairs(spark, seed):
    rows = draw(seed)
    want = brute(rows)
    assert got(spark, rows) == want


def test_few_counters_more_rounds_and_shuffled_joins_change_nothing(spark, monkeypatch):
    rows = draw(4)
    monkeypatch.setattr(jaccard, "COUNTERS", 7)
    monkeypatch.setattr(jaccard, "SMALL", 3)
    assert got(spark, rows, rounds=3) == brute(rows)


def degrees(rows):
    """n_links of each row: the different sets that its own is linked with."""
    sets = [exact_set(t) for _, t in rows]
    distinct = {s for s in sets if s}
    links = {s: sum(s != o and 5 * len(s & o) >= 4 * len(s | o) for o in distinct if 5 * min(len(s), len(o)) >= 4 * max(len(s), len(o))) for s in distinct}
    return sorted(((d, len(s), links.get(s, 0)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


@pytest.mark.parametrize("seed", [1, 6])
def test_every_link_is_counted(spark, seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(300)]
    rows = [*draw(seed), *[(10000 + i, edited(rng, words, rng.randrange(9))) for i in range(120)]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = jaccard.similar_groups(df, every=True).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in out), key=str) == degrees(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows)


def test_links_of_a_large_group_are_counted_from_few_pairs(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, words, 1 + rng.randrange(3))) for i in range(300)]
    seen, judge = [], jaccard._by_answers
    monkeypatch.setattr(jaccard, "_by_answers", lambda pairs, *more: seen.append(pairs.count()) or judge(pairs, *more))
    out = jaccard.similar_groups(spark.createDataFrame(rows, SCHEMA).repartition(6), every=True).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in out), key=str) == degrees(rows)
    assert sum(seen) < 300 * 299 / 2 / 2  # half of all pairs


@pytest.mark.parametrize("before", [1, 6])
def test_copies_of_changed_copies_are_counted(spark, monkeypatch, before):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    changed = [edited(rng, words, 2).split() for _ in range(8)]  # groups within the group: they share differences from any one leader
    rows = [(i, edited(rng, changed[i % 8], rng.randrange(4))) for i in range(160)]
    monkeypatch.setattr(jaccard, "BEFORE", before)
    out = jaccard.similar_groups(spark.createDataFrame(rows, SCHEMA).repartition(6), every=True).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in out), key=str) == degrees(rows)


@pytest.mark.parametrize("all_pairs", [False, True])
def test_near_copies_of_the_pipeline_are_fingerprinted_first_and_verified(spark, monkeypatch, all_pairs):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    rows = [(5, "\x20"), (6, None), (500, " ".join(words)), (501, " ".join([*words[:-1], "other"])), *draw(9)]
    asked, found, answers, links = [], [], jaccard._answers, simhash.links
    monkeypatch.setattr(jaccard, "_answers", lambda pairs, *more: asked.append(pairs.count()) or answers(pairs, *more))

    def spied(classes, *more):
        out = classes.select(F.col("fp").alias("a")).crossJoin(classes.select(F.col("fp").alias("b"))).where("a < b") if all_pairs else links(classes, *more)
        found.append(out.distinct().count())
        return out

    monkeypatch.setattr(simhash, "links", spied)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    left = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert len(found) == 1 and found[0] > 0 and asked[0] > 0  # candidates of fingerprints are the first to be verified
    want = brute(rows)
    stays = {d for d, _, c in want if d == c}
    assert {r.doc_id for r in left} == stays and 500 in stays and 501 not in stays


def test_large_group_of_near_copies_makes_few_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, words, rng.randrange(4))) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    out = jaccard.similar_groups(df).collect()
    assert {r.component_id for r in out} == {0} and len(out) == 400
    assert sum({r.class_id: r.n_links for r in out}.values()) / 2 < 20 * 400  # copies of a text share its links


def test_empty_table(spark):
    assert got(spark, [], 1) == [] and got(spark, [(1, None)], 1) == [(1, 0, 1)]


def test_prefixes_and_hashes():
    assert [jaccard.prefix_length(n) for n in (0, 1, 4, 5, 10, 100)] == [0, 1, 1, 2, 3, 21]
    assert len(jaccard.shingles(b"A a a a a a a")) == 1 and not len(jaccard.shingles(b" "))
    assert (jaccard.shingles(b"a B c d e f") == jaccard.shingles("A b C d\te F".encode())).all()
    assert len(np.intersect1d(jaccard.shingles(b"a b c"), jaccard.shingles(b"a b c d e"))) == 0
