import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from varloom.llm.blocks import Texts, blocks, units, words
from varloom.llm.packing import CapacityTree, best_fit_decreasing, dot_product_packing
from varloom.llm.vocabulary import Vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["", None, " ", "\n\n", "a", "Hello  World", " lead", "trail \n", "x y  z　", "don't I'll we've", "a.b,c;d!e?f", "<|endoftext|> a <|endoftext|>b",
       "<|ENDOFTEXT|>", "İstanbul ΑΣ Σ ſ ﬁ", "éé ñ", "日本語 テキスト。", "🙂🙂 ok 👨‍👩‍👧", "12 3456 7", "tab\tand\x0bvt\x0c\r\n end", "\x1c\x85", "a" * 3000, "the the the The THE", "'s 't x's", "#### $$$%", "0\x00b"]


def random_texts(n):
    rng = random.Random(5)
    alphabet = ["a", "B", "é", " ", " ", "\n", ".", ",", "'", "s", "1", "\t", "|", "ß", "ñ", " ", "中", "<|endoftext|>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    path = public_tokenizers.path(name)
    tokenizer, vocab = Tokenizer.from_file(path), Vocabulary.load(path)
    texts = ODD + random_texts(400)
    t = Texts.of(pa.array(texts, pa.string()))
    ids, start = vocab.texts(t)
    counts = vocab.counts(t)
    for i, text in enumerate(texts):
        expected = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[start[i] : start[i + 1]].tolist() == expected, text
        assert counts[i] == len(expected)


#: White space as Unicode has it beyond the space and 9 to 13.
WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_where_spaces_alternate_with_wide_ones(name):
    path = public_tokenizers.path(name)
    tokenizer, vocab = Tokenizer.from_file(path), Vocabulary.load(path)
    rng = random.Random(6)
    texts = ["Menu \u00a0 \u00a0 \u00a0 Home", "\u00a0", " \u00a0", "\u00a0 \u00a0 "] + [f"a{w} {w} {w}{w}\n{w} b{w} " for w in WIDE]
    texts += ["".join(rng.choice([" ", " ", "\n", "\u00a0", "\u00a0", "a", "\u00e0", "\u2020", ".", "\u200b", "\u180e", *WIDE]) for _ in range(rng.randrange(40))) for _ in range(1000)]
    t = Texts.of(pa.array(texts, pa.string()))
    ids, start = vocab.texts(t)
    counts = vocab.counts(t)
    for i, text in enumerate(texts):
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[start[i] : start[i + 1]].tolist() == expected, text
        assert counts[i] == len(expected)


def test_words_and_units():
    texts = ODD + random_texts(200)
    t = Texts.of(pa.array(texts, pa.string()))
    w, u = words(t, lower=True), units(t)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        got = [w.distinct[c].as_py() for c in w.code[w.start[i] : w.start[i + 1]]]
        assert got == re.findall(rb"[^\x20\x09-\x0D]+", raw.lower())
        assert b"".join(u.distinct[c].as_py() for c in u.code[u.start[i] : u.start[i + 1]]) == raw


def test_blocks_keep_rows_and_bound_sizes():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 5)), pa.array(["x" * 10] * 4 + [None])], ["i", "t"]) for k in range(0, 50, 5)]
    batches.append(pa.RecordBatch.from_arrays([pa.array([50]), pa.array(["y" * 500])], ["i", "t"]))
    out = list(blocks(batches, "t", 64, row=0))
    assert sum((b.column("i").to_pylist() for b in out), []) == list(range(51))
    assert all(sum(len(x or "") for x in b.column("t").to_pylist()) <= 64 or b.num_rows == 1 for b in out)
    assert list(blocks([], "t")) == []


def test_capacity_tree():
    rng, tree, rooms = random.Random(1), CapacityTree(100), []
    for _ in range(2000):
        if rooms and rng.random() < 0.5:
            r = rooms.pop(rng.randrange(len(rooms)))
            tree.add(r, -1)
        else:
            rooms.append(r := rng.randrange(101))
            tree.add(r, 1)
        need = rng.randrange(101)
        assert tree.least(need) == min((r for r in rooms if r >= need), default=-1)


@pytest.mark.parametrize("packer,most_loss,most_segments", [(best_fit_decreasing(64), 64, 64), (dot_product_packing(64, 4, 40, 8), 40, 4), (dot_product_packing(64, 64, 64, 0), 64, 64)])
def test_packers_are_lossless_and_keep_limits(packer, most_loss, most_segments):
    rng = np.random.default_rng(3)
    tokens = np.concatenate([rng.integers(1, 30, 300), rng.integers(64, 400, 20), [64, 128, 1, 1]])
    loss = (tokens * rng.random(len(tokens))).astype(np.int64)
    example, start, length, place = packer(tokens, loss)
    for i, n in enumerate(tokens):
        parts = sorted((s, m) for e, s, m in zip(example, start, length) if e == i)
        assert sum(m for _, m in parts) == n and all(m > 0 for _, m in parts)
        assert [s for s, _ in parts] == list(np.cumsum([0] + [m for _, m in parts[:-1]]))
    assert (np.diff(place) >= 0).all() and set(place) == set(range(place.max() + 1))
    assert np.bincount(place, weights=length).max() <= 64
    if most_segments < 64:
        bearing = np.clip(start + length - (tokens - loss)[example], 0, None) - np.clip(start - (tokens - loss)[example], 0, None)
        assert np.bincount(place).max() <= most_segments
        assert np.bincount(place, weights=bearing).max() <= most_loss
