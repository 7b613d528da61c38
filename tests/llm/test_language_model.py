"""The language model against plain versions: a dictionary of byte contexts, and counts of deep contexts by content."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import language_model as lm
from varloom.llm.blocks import Texts

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def stream(text):
    return b"\0" * 5 + (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) + b"\xff"


def plain_trie(texts):
    trie = collections.defaultdict(collections.Counter)
    for text in texts:
        s = stream(text)
        for q in range(5, len(s)):
            for k in range(6):
                trie[s[q - k : q]][s[q]] += 1
    return trie


def symbol(trie, context, sym):
    """Probability of a symbol: escapes by method D, with the symbols of longer contexts excluded."""
    out, excluded = 1.0, set()
    for k in range(5, -1, -1):
        seen = trie.get(context[5 - k :])
        if not seen:
            continue
        left = {a: n for a, n in seen.items() if a not in excluded}
        n = sum(left.values())
        if sym in left:
            return out * (2 * left[sym] - 1) / (2 * n)
        if left:
            out *= len(left) / (2 * n)
        excluded |= set(seen)
    return out / (256 - len(trie[b""]))


def plain_paths(text):
    """(context, path, first, one after the last) at the anchors of a text, found by whether its own anchors agree with those of a block."""
    raw = stream(text)[5:-1]
    found = lm.Paths(Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    begins = found.begin.tolist()
    ends = [*begins[1:], len(raw)]
    return [(raw[b - lm.DEEP : b], raw[b:e] + (b"\xff" if e == len(raw) else b""), b, e + (e == len(raw))) for b, e in zip(begins, ends)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"w{rng.randrange(300)}" for _ in range(200)] + ["the", "of", "and"] * 20
    prose = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 12))).capitalize() + "." for _ in range(n))
    base = [prose(rng.randrange(1, 30)) for _ in range(40)]
    passage = prose(12)
    out = [None, "", " \n\t", "One", "the  the\r\nThe", "é 中 🙂", "x" * 3000, "again and again. " * 200]
    out += base + base[:6] + [b + "\n" + passage for b in base[:8]] + [passage + "\n" + passage]
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("deep", [False, True])
def test_model(spark, rows, deep):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"train": F.lit("x"), "score": F.lit(1)}).repartition(3)
    learned = {i for i, _ in rows if i % 5 != 1}
    trie = plain_trie(t for i, t in rows if i in learned)
    for context in (b"\0\0\0\0\0", b" the ", b"w1 of", b"qzqzq"):
        assert sum(symbol(trie, context, x) for x in range(256)) == pytest.approx(1, abs=1e-9)
    tokens = {i: [*WORDS.findall(stream(t)[5:-1]), b"\n"] for i, t in rows}
    counts = collections.Counter(x for i in learned for x in tokens[i])
    n, v = sum(counts.values()), len(counts)
    paths = {i: plain_paths(t) for i, t in rows}
    assert sum(map(len, paths.values())) > 100
    known = {i: (collections.Counter(p[0] for p in paths[i]), collections.Counter(p[:2] for p in paths[i])) for i in paths}
    contexts, follow = (sum((known[i][k] for i in learned), collections.Counter()) for k in (0, 1))
    copied = 0
    got = lm.score_texts(docs, F.col("doc_id") % 5 != 1, deep=deep).collect()
    assert len(got) == len(rows)
    for r in got:
        i, s = r["doc_id"], stream(rows[r["doc_id"]][1])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens[i]), sum(t in counts for t in tokens[i]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[i]))
        each = [math.log10(symbol(trie, s[q - 5 : q], s[q])) for q in range(5, len(s))]
        expected, had_context, had_path = sum(each), collections.Counter(), collections.Counter()
        for context, path, b, e in paths[i] if deep else []:
            own = known[i] if i in learned else (collections.Counter(), collections.Counter())
            total = contexts[context] - own[0][context] + had_context[context]
            times = follow[context, path] - own[1][context, path] + had_path[context, path]
            if times:
                copied += 1
                expected += math.log10(times / (total + 1)) - sum(each[b:e])
            else:
                expected -= math.log10(total + 1)
            had_context[context] += 1
            had_path[context, path] += 1
        assert r["score"] == pytest.approx(expected, rel=1e-5), rows[i]
    assert not deep or copied > 30


def test_anchors_follow_the_content():
    """A passage has the same anchors wherever it stands, and in a block as alone."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcde fgh") for _ in range(4000))
    texts = ["xy" + passage, "", passage, "q" * 100 + passage[:2000]]
    raw = [t.encode() for t in texts]
    block = lm.Paths(Texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    start = np.cumsum([0, *map(len, raw)])
    at = [(block.begin[block.owner == i] - start[i]).tolist() for i in range(4)]
    assert len(at[2]) > 30 and not at[1]
    assert [x - 2 for x in at[0] if x - 2 >= lm.DEEP] == at[2]
    assert [x - 100 for x in at[3] if x - 100 >= lm.DEEP] == [x for x in at[2] if x <= 2000]
    assert {block.distinct[c] for c in block.code[block.owner == 2][:-1]} <= {block.distinct[c] for c in block.code[block.owner == 0]}


def test_contexts_run_over_words(spark):
    # Each word is as frequent as the others, so that only the word before tells which comes next.
    rng = random.Random(3)
    pairs = [("red", "apple"), ("blue", "cheese"), ("old", "bridge"), ("new", "garden")]
    train = [(i, " ".join(" ".join(rng.choice(pairs)) for _ in range(12)) + f" {i}") for i in range(40)]
    both = spark.createDataFrame([*train, (100, "blue cheese old bridge"), (101, "blue bridge old cheese")], "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(both, F.col("doc_id") < 100, deep=False).collect()}
    assert got[100] > got[101] + 1


def test_sums_of_runs():
    rng = np.random.default_rng(3)
    runs = [np.unique(rng.integers(0, 50, 30)).astype(np.int64) for _ in range(4)] + [np.zeros(0, np.int64)]
    times = [rng.integers(1, 2**32, len(r)).astype("<u4") for r in runs]
    want = collections.Counter()
    for r, t in zip(runs, times):
        want.update(dict(zip(r.tolist(), t.tolist())))
    keys, sums = lm.summed(runs, times)
    assert dict(zip(keys.tolist(), sums.tolist())) == dict(want) and keys.tolist() == sorted(want) and sums.dtype == np.int64
    assert [len(x) for x in lm.summed([], [])] == [0, 0] == [len(x) for x in lm.summed([runs[-1]], [times[-1]])]
    # sums are of integers: as doubles they lost what is beyond 2^53
    assert lm.summed([np.array([7]), np.array([7])], [np.array([2**53]), np.array([1])])[1].tolist() == [2**53 + 1]


def test_blocks_and_steps_do_not_matter(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    read = lm.read_texts
    monkeypatch.setattr(lm, "read_texts", lambda d, deep: read(d, deep, limit=2000))  # texts longer than a block, many blocks
    small = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, F.col("doc_id") % 5 != 1).collect()}
    monkeypatch.setattr(lm, "read_texts", read)
    large = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, F.col("doc_id") % 5 != 1).collect()}
    assert small.keys() == large.keys() and all(small[i] == pytest.approx(large[i], rel=1e-6) for i in small)
