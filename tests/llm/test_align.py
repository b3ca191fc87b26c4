"""Alignment against both libraries on whole texts and all pairs of byte ranges."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from watchpost.llm import align

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "word  two   three ", "line\nnext line\r\n\ttabbed \n end", "don't we'll 'tis it's", "x" * 5000, "日本語のテキスト です。全角　空白", "é é ﬁ ﬀ ｆｕｌｌ 🙂👩‍👩‍👧 ümläut", "<s> </s> <unk> <0x41> <|endoftext|>",
    "holds ▁ itself", "▁", "a​ b᠎ c\x1c d\x85 e  f\xa0 g", "\x00\x01 \x7f", "1234567 3.14159 12:30", "The quick brown fox jumps over the lazy dog. " * 40, "naïve façade coöperate Ångström", "tab\there", "\n", "https://example.org/a?b=c&d=%20e", "antidisestablishmentarianism " * 30,
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute(texts, libraries):
    """Rows of the query from whole texts: tokens of the libraries, groups from the sets of ends, links from all pairs of ranges."""
    a_lib, b_lib = libraries
    letters = align.byte_alphabet()
    parts = []
    for text in texts:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        own = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        theirs = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text is None or not b"".join(own) == (" " + text).encode() == b"".join(theirs):
            a, b, own, theirs = [], [], [], []
        ends = [np.cumsum([0] + [len(x) for x in side]).tolist() for side in (own, theirs)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups = [([i for i, e in zip(a, ends[0][1:]) if lo < e <= hi], [i for i, e in zip(b, ends[1][1:]) if lo < e <= hi]) for lo, hi in zip(shared, shared[1:])]
        links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if max(ends[0][i], ends[1][j]) < min(ends[0][i + 1], ends[1][j + 1])] if len(a) < 3000 else None
        parts.append((a, b, groups, links))
    counts = collections.Counter(x for p in parts for x in p[3])
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    told = [";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in p[2]) for p in parts]
    return [(len(a), len(b), len(g), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(t.encode()).hexdigest() if a else "") for (a, b, g, k), t in zip(parts, told, strict=True)]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, a_ids string, n_a int").repartition(5)


@pytest.mark.parametrize("known", [1 << 20, 40, 0])
def test_matches_whole_texts(spark, libraries, known):
    got = align.alignment_statistics(rows(spark, TEXTS + TEXTS[5:9]), *FILES, known=known).orderBy("doc_id").collect()
    want = brute(TEXTS + TEXTS[5:9], libraries)
    for text, r, w in zip(TEXTS + TEXTS[5:9], got, want, strict=True):
        assert tuple(r)[1:] == w, repr(text)[:60]


def test_random_texts(spark, libraries, monkeypatch):
    rng = random.Random(3)
    signs = "aabcdeETrst  \n\t.,'0129éß日▁　​\x1c🙂-"
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 120))).replace("▁", "▁" if k % 9 == 0 else "_") for k in range(300)]
    texts += [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(60)) for _ in range(40)]
    got = align.alignment_statistics(rows(spark, texts), *FILES).orderBy("doc_id").collect()
    for text, r, w in zip(texts, got, brute(texts, libraries), strict=True):
        assert tuple(r)[1:] == w, repr(text)


def test_forgetting_changes_nothing(spark, libraries, monkeypatch):
    files = tuple(open(f, "rb").read() for f in FILES)
    own = align.Aligner(*files)
    monkeypatch.setattr(align, "CHUNKS", 7)
    for text in TEXTS[4:] * 2:
        chunks = own.cut(text)
        assert "".join(chunks) == " " + text
        own.learn(set(chunks))
        numbers = np.array([own.number[c] for c in chunks])
        if own.sound[numbers].all():
            assert own.rows[0].take(numbers)[0].tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
            assert own.rows[1].take(numbers)[0].tolist() == libraries[1].encode(text)
        if own.full():
            own.forget()
    with open(FILES[0]) as f:  # under another split pattern a text is one chunk
        other = align.Aligner(f.read().replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false').encode(), files[1])
    assert own.worded and not other.worded and other.cut("two words") == [" two words"]


def test_align_returns_ids_and_groups(spark, libraries):
    got = align.align(rows(spark, TEXTS), *FILES).orderBy("doc_id").collect()
    for text, r in zip(TEXTS, got, strict=True):
        assert sum(r.in_a) == len(r.a_ids) and sum(r.in_b) == len(r.b_ids) and len(r.in_a) == len(r.in_b)
        if text and "▁" not in text:
            assert (r.a_ids, r.b_ids) == (libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text))


def test_groups_by_divide_and_conquer():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 60)
        a, b = (sorted({n, *rng.sample(range(1, n + 1), rng.randrange(n))}) for _ in range(2))
        want = [(a.index(e) + 1, b.index(e) + 1) for e in sorted(set(a) & set(b))]
        got = align.shared_groups(np.array(a), np.array(b), np.array([len(a)]), np.array([len(b)]))
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want
        some = rng.choice(want)
        parts = [np.array(sorted({some[k], (len(a), len(b))[k]})) for k in (0, 1)]
        got = align.shared_groups(np.array(a), np.array(b), *parts)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment_statistics(none, *FILES).count() == 0 and align.align(none, *FILES).count() == 0
    some = spark.createDataFrame([(None, "same text"), (1, "same text"), (1, "same text")], "doc_id long, text string")
    assert len({tuple(r)[1:] for r in align.alignment_statistics(some, *FILES).collect()}) == 1
