"""Prediction by partial matching: code lengths of texts under a byte-context trie of the corpus.

The lower-cased (A-Z) bytes of a text, white space included, and one end symbol are coded one by one in the
context of the bytes before them, five at the most, from the text's beginning on.  The trie has the counts of
all contexts of the training texts.  A symbol unseen in a context costs an escape to the next shorter one
(method D: a symbol seen c times of n, among d different ones, has (2c - 1) / 2n, the escape d / 2n), where all
symbols of the longer context are excluded; below the empty context all bytes left are alike.

Above these stands one deep context, whose path below it is taken as one symbol: the ``DEEP`` bytes before an
anchor, that is a place where a hash of those bytes says so (one byte in ``EVERY``), are followed by the bytes up
to the next anchor.  Its counts are pretrained and adaptive: those of the other training texts, and those that
the text itself has gathered so far.  A path seen c times of n has c / (n + 1) (method A), others escape, with
1 / (n + 1), to the trie.  So passages that come again are coded by the passage, and all else by the trie alone;
``deep=False`` leaves this context out.

The trie is a table of (context, symbol) that is never gathered: each block of texts counts its own and deals
them out by a hash of the last three bytes of the context; where they meet, counts are summed and code lengths
worked out, and each block gets back the lengths of what it asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.blocks import LOWER, Texts, blocks, encoded, words
from varloom.llm.common import crc_remainder, documents, written
from varloom.llm.near import whole_groups

ORDER = 5
#: Bytes of the deep context, and bytes from one of its anchors to the next on average.
DEEP, EVERY = 16, 64
#: The end symbol in the trie (UTF-8 has no such byte) and as a token.
END, END_TOKEN = 255, b"\n"
#: Parts that the last three bytes of contexts are hashed to.
SHARDS = 4096
#: Word rows that one bucket of distinct words should have.
BUCKET_ROWS = 200_000

SCHEMA = "batch bigint, doc_id {}, train boolean, n_tokens bigint, words binary, number bigint, word binary, times bigint, shard int, keys binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def parts(texts: Texts, step: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """Runs of texts of about ``step`` bytes, or one longer text: the first, the one after the last, and they."""
    a, last = 0, len(texts)
    while a < last:
        b = max(a + 1, int(np.searchsorted(texts.start, texts.start[a] + step, "right")) - 1)
        p, q = texts.start[a], texts.start[b]
        yield a, b, Texts(texts.data[p:q], texts.start[a : b + 1] - p)
        a = b


def grams(texts: Texts) -> np.ndarray:
    """(context, symbol) of every byte of each text and its end, as numbers of 6 bytes; contexts begin with the text."""
    number = np.arange(len(texts))
    begin = texts.start[:-1] + (ORDER + 1) * number + ORDER
    stream = np.zeros(len(texts.data) + (ORDER + 1) * len(texts), np.uint8)
    symbol = np.ones(len(stream), bool)
    for back in range(1, ORDER + 1):
        symbol[begin - back] = False
    at = np.flatnonzero(symbol)
    end = np.zeros(len(at), bool)
    end[texts.start[1:] + number] = True
    stream[at[~end]], stream[at[end]] = LOWER[texts.data], END
    key = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        key = (key << 8) | stream[at - back]
    return key


def sharded(key: np.ndarray) -> np.ndarray:
    """Keys with their shard and then the last three bytes of the context in front."""
    last = key >> 8 & 0xFFFFFF
    return (last * 0x9E3779B1 >> 20 & (SHARDS - 1)) << 48 | last << 24 | key >> 32 << 8 | key & 255


def restored(key: np.ndarray) -> np.ndarray:
    """Keys of a shard, which may be in front or not, as ``grams`` makes them."""
    return (key >> 8 & 0xFFFF) << 32 | (key >> 24 & 0xFFFFFF) << 8 | key & 255


def summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their times."""
    if not sum(map(len, keys)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, n = np.concatenate(keys), np.concatenate(times).astype(np.int64)
    order = np.argsort(found, kind="stable")  # merges the runs, each of which is in order
    found = found[order]
    first = np.flatnonzero(np.diff(found, prepend=found[0] - 1))
    return found[first], np.add.reduceat(n[order], first)


def asked_keys(texts: Texts, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of the texts, by shard, and how often training texts have them."""
    keys, times = [], []
    for a, b, part in parts(texts):
        of = np.repeat(train[a:b], np.diff(part.start) + 1)
        both, n = np.unique(sharded(grams(part)) << 1 | of, return_counts=True)
        keys.append(both >> 1)
        times.append(n * (both & 1))
        if len(keys) == 5:
            one, sums = summed(keys, times)
            keys, times = [one], [sums]
    return summed(keys, times)


class Paths:
    """What follows the deep contexts of texts: for each anchor, in order, its text, the bytes from it (begin) to the next
    or the text's end (end), the context's hash, and a code of (context, path); ``distinct`` has those as 13 bytes,
    which begin as no word does: a mark, six of the context's hash, six of the path's."""

    def __init__(self, texts: Texts):
        owner, begin, end, context = [], [], [], []
        rng = np.random.default_rng(17)
        value = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        factors = rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for a, _, part in parts(texts):
            h = value[LOWER[part.data]]
            width = 1
            while width < DEEP:  # hashes of runs of bytes, twice as long each time
                h[width:] = h[width:] + h[:-width] * factors[width.bit_length()] if len(h) > width else h[width:]
                width *= 2
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            at = np.flatnonzero(h >> np.uint64(64 - EVERY.bit_length() + 1) == 0) + 1
            of = np.searchsorted(part.start, at - 1, "right") - 1
            inside = at - part.start[of] >= DEEP
            at, of = at[inside], of[inside]
            follow = np.minimum(np.append(at[1:], len(part.data)), part.start[of + 1])
            owner.append(of + a)
            begin.append(at + texts.start[a])
            end.append(follow + texts.start[a])
            mixed = h[at - 1] * np.uint64(0x94D049BB133111EB)  # the bits that choose anchors are the same for all
            context.append(mixed ^ mixed >> np.uint64(31))
        self.owner, self.begin, self.end, self.context = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, begin, end, context))
        self.ends = self.end == texts.start[self.owner + 1]  # the end symbol belongs to the last path
        bounds = np.unique(np.concatenate([texts.start, self.begin]))
        code, distinct = encoded(LOWER[texts.data], bounds)
        # A path from the very end of a text has no bytes.
        own = np.where(self.end > self.begin, code[np.minimum(np.searchsorted(bounds, self.begin), max(len(code) - 1, 0))] if len(code) else 0, -1)
        kinds, which = np.unique(own * 2 + self.ends, return_inverse=True)
        path = [blake2b((b"" if k < 0 else distinct[int(k) >> 1].as_py()) + bytes([int(k) & 1]), digest_size=6).digest() for k in kinds.tolist()]
        raw = np.zeros((len(own), 13), np.uint8)
        raw[:, 0] = END_TOKEN[0]
        raw[:, 1:7] = self.context.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        raw[:, 7:] = np.frombuffer(b"".join(path), np.uint8).reshape(-1, 6)[which] if len(own) else raw[:, 7:]
        found = pa.Array.from_buffers(pa.binary(13), len(own), [None, pa.py_buffer(raw.tobytes())]).dictionary_encode()
        self.code, self.distinct = found.indices.to_numpy(), found.dictionary.to_pylist()


def earlier(values: np.ndarray) -> np.ndarray:
    """How many equal values come before each."""
    order = np.argsort(values, kind="stable")
    begin = np.flatnonzero(np.diff(values[order], prepend=values[order][:1] - 1)) if len(values) else np.zeros(0, np.int64)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(begin, np.diff(np.append(begin, len(values))))
    return out


def within(owner: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence of a kind in a text how often the text has it, and had it before."""
    _, which, often = np.unique(owner << 32 | np.unique(kind, return_inverse=True)[1], return_inverse=True, return_counts=True)
    return often[which], earlier(which)


def packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte: first the lowest byte of each, and so on, which compresses better."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def laid_out(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def keys_and(raw: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a shard, without the shard, and the values that go with them."""
    n = len(raw) // (8 + np.dtype(kind).itemsize)
    return np.cumsum(laid_out(raw[: 8 * n], "<i8")), laid_out(raw[8 * n :], kind)


def read_texts(docs: DataFrame, deep: bool = True, limit: int = 12 << 20) -> DataFrame:
    """For each block of texts a row per text (by number), a row per distinct word and deep path (number, word,
    times in training texts; the end token has number -1), a row per shard of keys (shard, the keys and
    their times), and a row per three bytes (shard -1, number, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        batch = TaskContext.get().partitionId() << 32
        for table in blocks(batches, "t", limit):
            texts = Texts.of(table.column("t"))
            train = table.column("train").to_numpy().astype(bool)

            def made(n: int, batch: int = batch, kind: pa.DataType = table.schema.field("i").type, **columns) -> pa.RecordBatch:
                kinds = [pa.int64(), kind, pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
                columns["batch"] = np.full(n, batch)
                return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(n, k)) for c, k in zip(COLUMNS, kinds, strict=True)], names=COLUMNS)

            n, tokens = table.num_rows, words(texts, lower=True)
            yield made(n, doc_id=table.column("i").combine_chunks(), train=train, n_tokens=tokens.counts + 1, words=[pack(texts.text(i)) for i in range(n)], number=np.arange(n))
            times = np.bincount(tokens.code[np.repeat(train, tokens.counts)], minlength=len(tokens.distinct))
            symbols = [END_TOKEN, *tokens.distinct.to_pylist()]
            del tokens
            if deep:
                paths = Paths(texts)
                times = np.concatenate([times, np.bincount(paths.code[train[paths.owner]], minlength=len(paths.distinct))])
                symbols += paths.distinct
                del paths
            yield made(len(symbols), number=np.arange(-1, len(symbols) - 1), word=symbols, times=np.concatenate([[int(train.sum())], times]))
            del symbols, times
            keys, count = asked_keys(texts, train)
            shard, begin = np.unique(keys >> 48, return_index=True)
            bounds = [*begin.tolist(), len(keys)]
            low, count4 = (keys & ((1 << 48) - 1)).astype("<i8"), count.astype("<u4")
            held = [pack(packed(np.diff(low[p:q], prepend=0)) + packed(count4[p:q])) for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
            yield made(len(shard), shard=shard, keys=held)
            three, which = np.unique(restored(keys) & 0xFFFFFF, return_inverse=True)
            yield made(len(three), shard=np.full(len(three), -1), number=three, times=np.bincount(which, weights=count, minlength=len(three)).astype(np.int64))
            batch += 1

    return docs.mapInArrow(run, SCHEMA.format(dict(docs.dtypes)["i"]))


def counted_words(table: pa.Table) -> pa.Table:
    """Of the rows of a bucket their word's training count, and of paths their context's (``of``); in four rows without a
    batch the bucket's sums: words in all and different ones."""
    found = table.column("word").combine_chunks().dictionary_encode()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    code, distinct = found.indices.to_numpy(), found.dictionary.to_pylist()
    times = np.bincount(code, weights=table.column("times").to_numpy(), minlength=len(distinct)).astype(np.int64)
    path = np.array([len(w) > 1 and w[:1] == END_TOKEN for w in distinct], bool)
    of = np.zeros(len(distinct), np.int64)
    at = np.flatnonzero(path)
    if len(at):
        _, which = np.unique(np.array([int.from_bytes(distinct[i][1:7], "little") for i in at.tolist()]), return_inverse=True)
        of[at] = np.bincount(which, weights=times[at])[which].astype(np.int64)
    extra = [int(times[~path].sum()), int(np.count_nonzero(times[~path]))]
    batch = pa.chunked_array([*table.column("batch").chunks, pa.nulls(2, pa.int64())])
    return pa.table({"batch": batch, "number": np.concatenate([table.column("number").to_numpy(), [-1, -2]]), "times": np.concatenate([times[code], extra]), "of": np.concatenate([of[code], [0, 0]])})


class Short:
    """Counts of all runs of three bytes of the corpus, for the contexts of two bytes and less: sorted runs, and counts."""

    def __init__(self, run: np.ndarray, count: np.ndarray):
        order = np.argsort(run)
        self.run, self.count = run[order], count[order].astype(float)
        self.pairs = np.zeros((256, 256))
        np.add.at(self.pairs, (self.run >> 8 & 255, self.run & 255), self.count)


def code_lengths(key: np.ndarray, times: np.ndarray, short: Short) -> np.ndarray:
    """log10 probability of each (context, symbol).

    The keys are distinct and hold all contexts that share their last three bytes; ``short`` has the counts
    of the runs of three bytes in the corpus.
    """
    seen, pairs = times > 0, short.pairs
    tables = {}
    for k in range(ORDER, 1, -1):
        if k > 2:
            keys, which = np.unique(key[seen] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(which, weights=times[seen], minlength=len(keys))
        else:
            keys, count = short.run[short.count > 0], short.count[short.count > 0]
        contexts, first = np.unique(keys >> 8, return_index=True)
        tables[k] = (keys, count, contexts, np.add.reduceat(count, first) if len(first) else count[:0], np.diff(np.append(first, len(keys))), first)

    def counted(k: int, at: np.ndarray) -> np.ndarray:
        if k == 1:
            return pairs[(at >> 8) & 255, at & 255]
        if k == 0:
            return pairs.sum(0)[at & 255]
        keys, count = tables[k][:2]
        if not len(keys):
            return np.zeros(len(at))
        i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        return np.where(keys[i] == at, count[i], 0.0)

    out, open_ = np.zeros(len(key)), np.ones(len(key), bool)
    shut_n, shut_d = np.zeros(len(key)), np.zeros(len(key))
    for k in range(ORDER, -1, -1):
        at = key & ((1 << 8 * (k + 1)) - 1)
        if k > 1:
            keys, count, contexts, total, different, first = tables[k]
            i = np.minimum(np.searchsorted(contexts, at >> 8), max(len(contexts) - 1, 0))
            known = contexts[i] == at >> 8 if len(contexts) else np.zeros(len(at), bool)
            n, d = (np.where(known, v[i], 0.0) if len(contexts) else np.zeros(len(at)) for v in (total, different))
        else:
            c = pairs if k else pairs.sum(0, keepdims=True)
            context = (at >> 8) & 255 if k else np.zeros(len(at), np.int64)
            n, d = c.sum(1)[context], (c > 0).sum(1).astype(float)[context]
        c = counted(k, at)
        left, kinds = n - shut_n, d - shut_d
        here = open_ & (c > 0)
        out[here] += np.log10((2 * c[here] - 1) / (2 * left[here]))
        open_ &= ~here
        escaped = open_ & (kinds > 0)
        out[escaped] += np.log10(kinds[escaped] / (2 * left[escaped]))
        if k > 1 and len(tables[k][0]):
            shorter = np.add.reduceat(counted(k - 1, keys & ((1 << 8 * k) - 1)), first)
            shut_n, shut_d = np.where(known, shorter[i], 0.0), d
        elif k == 1:
            shorter = (np.where(pairs > 0, pairs.sum(0)[None, :], 0)).sum(1)
            shut_n, shut_d = shorter[context], d
        else:
            shut_n, shut_d = np.zeros(len(key)), np.zeros(len(key))
    out[open_] += -math.log10(max(1, 256 - int((pairs.sum(0) > 0).sum())))
    return out


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", deep: bool = True) -> DataFrame:
    """One row per row of ``docs``: n_tokens, n_known, train_tokens, base_score, score.

    ``train`` tells which rows are learned from (null: not).  Tokens are the words of the text and one
    end; base_score is the log10 probability under smoothed frequencies of training tokens, score that of the
    lower-cased bytes of the text and its end under the model (see the module).  All counts are over all training rows.

    Null texts count as empty: one token.  Null ids and repeated rows are scored like any other.  Only
    the id, the text and the columns of ``train`` are read.  An empty table gives an empty result, and
    without training rows every symbol has probability 1/256.  A text longer than a block (12 MB) is a block
    of its own, and a task holds some 60 times its bytes while it is worked on.
    """
    read = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = dict(read.dtypes)["i"]
    both = written(read_texts(read, deep))
    rows = both.filter("word is not null")
    n_rows = rows.count()
    # All paths of a deep context share a bucket.
    place = F.when((F.length("word") > 1) & (F.substring("word", 1, 1) == F.lit(END_TOKEN)), F.substring("word", 1, 7)).otherwise(F.col("word"))
    held = rows.select(F.pmod(F.xxhash64(place), F.lit(max(1, -(-n_rows // BUCKET_ROWS)))).alias("bucket"), "batch", "number", "word", "times")
    word_times = written(held.groupBy("bucket").applyInArrow(counted_words, "batch bigint, number bigint, times bigint, of bigint"))
    totals = {r["number"]: r["n"] for r in word_times.filter("batch is null").groupBy("number").agg(F.sum("times").alias("n")).collect()}
    n_train, n_kinds = totals.get(-1, 0), totals.get(-2, 0)
    # 256^3 runs of three bytes at the most, some 100,000 in texts of a few languages.
    runs = both.filter("shard = -1").groupBy("number").agg(F.sum("times").alias("n")).toArrow()
    run_of, run_times = runs.column("number").to_numpy(), runs.column("n").to_numpy()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        short = Short(run_of, run_times)
        for table, begin in whole_groups(batches, ["shard"], 1):
            for p, q in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                group = table.slice(p, q - p)
                keys, times, size = [], [], 0
                for blob in group.column("keys"):
                    k, n = keys_and(unpack(blob.as_py()), "<u4")
                    keys.append(k)
                    times.append(n)
                    if (size := size + len(k)) > 1 << 20:  # no more is held than the distinct keys and a step
                        one, sums = summed(keys, times)
                        keys, times, size = [one], [sums], 0
                low, n = summed(keys, times)
                length = code_lengths(restored(low), n, short).astype("<f4")
                told = []
                for blob in group.column("keys"):
                    k, _ = keys_and(unpack(blob.as_py()), "<u4")
                    told.append(pack(packed(np.diff(k, prepend=0).astype("<i8")) + packed(length[np.searchsorted(low, k)])))
                yield pa.RecordBatch.from_arrays([group.column("batch").combine_chunks(), group.column("shard").combine_chunks(), pa.array(told, pa.binary())], names=["batch", "shard", "keys"])

    shards = both.filter("shard >= 0").select("batch", "shard", "keys").repartition("shard").sortWithinPartitions("shard")
    told = shards.mapInArrow(lengths, "batch bigint, shard int, keys binary")
    answers = word_times.filter("batch is not null").unionByName(told, allowMissingColumns=True)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        import pyarrow.compute as pc
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        left = left.sort_by("number")
        texts = Texts.of(pa.array([unpack(x) for x in left.column("words").to_pylist()], pa.binary()))
        told, right = (right.filter(f(right.column("keys"))) for f in (pc.is_valid, pc.is_null))
        number = right.column("number").to_numpy() + 1
        times, of = np.zeros(len(number)), np.zeros(len(number))
        times[number], of[number] = right.column("times").to_numpy(), right.column("of").to_numpy()
        told = told.sort_by("shard")
        found = [keys_and(unpack(x), "<f4") for x in told.column("keys").to_pylist()]
        shard = told.column("shard").to_numpy().astype(np.int64)
        known = np.concatenate([k | s << 48 for (k, _), s in zip(found, shard.tolist(), strict=True)] or [np.zeros(0, np.int64)])
        length = np.concatenate([n for _, n in found] or [np.zeros(0, "<f4")])
        del found, shard, told, right
        tokens = words(texts, lower=True)
        base = np.log10((times[: len(tokens.distinct) + 1] + 0.5) / (n_train + 0.5 * (n_kinds + 1)))
        sums, hits = (np.concatenate([[0.0], np.cumsum(x)]) for x in (base[tokens.code + np.int64(1)], times[tokens.code + np.int64(1)] > 0))
        total, n_known = (x[tokens.start[1:]] - x[tokens.start[:-1]] for x in (sums, hits))
        before = len(tokens.distinct) + 1
        del tokens, sums, hits
        train = left.column("train").to_numpy().astype(bool)
        score, paths = np.zeros(len(texts)), Paths(texts) if deep else None
        place = pd.Index(known)  # by a hash: a binary search of all keys for each byte takes three times as long
        by_trie = np.zeros(len(paths.begin)) if deep else None
        for a, b, part in parts(texts):
            run = np.concatenate([[0.0], np.cumsum(length[place.get_indexer(sharded(grams(part)))].astype(float))])
            ends = part.start + np.arange(len(part) + 1)
            score[a:b] = np.diff(run[ends])
            if deep:
                p, q = np.searchsorted(paths.owner, [a, b])
                shift = paths.owner[p:q] - a - texts.start[a]
                by_trie[p:q] = run[paths.end[p:q] + shift + paths.ends[p:q]] - run[paths.begin[p:q] + shift]
        if deep:
            own_path, path_before = within(paths.owner, paths.code)
            own_context, context_before = within(paths.owner, paths.context)
            learned = train[paths.owner]
            c = times[before + paths.code] - np.where(learned, own_path, 0) + path_before
            n = of[before + paths.code] - np.where(learned, own_context, 0) + context_before
            by_path = np.where(c > 0, np.log10(np.maximum(c, 1) / (n + 1)), by_trie - np.log10(n + 1))
            score += np.bincount(paths.owner, weights=by_path - by_trie, minlength=len(texts))
        return pa.table(
            {
                "doc_id": left.column("doc_id"), "train": left.column("train"), "n_tokens": left.column("n_tokens"), "n_known": pa.array(n_known + (times[0] > 0), pa.float64()).cast(pa.int64()),
                "train_tokens": np.full(len(score), n_train), "base_score": total + base[0], "score": score,
            }
        )

    texts = both.filter("train is not null").select("batch", "doc_id", "train", "n_tokens", "words", "number")
    out = f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(scored, out)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_texts(docs, crc_remainder("doc_id", 5) != 1).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
