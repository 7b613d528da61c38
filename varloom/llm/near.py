"""Near duplicates by SetSketch registers: band, estimate by likelihood, verify on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.blocks import Texts, blocks, ragged, words
from varloom.llm.common import checkpointed, documents, whole_text
from varloom.llm.components import components

M64 = (1 << 64) - 1


@dataclass(frozen=True)
class Sketch:
    """SetSketch with registers floor(1 - log_base(least exponential value at the rate)), cut to 0..65535."""

    registers: int = 125
    base: float = 1.001
    rate: float = 20.0

    def rows(self, similarity: float, miss: float = 1e-4) -> int:
        """Registers in a band, at most 5, so that pairs at the similarity are missed with ``miss`` at most."""
        return max([1, *(r for r in range(1, 6) if (1 - similarity**r) ** (self.registers // r) <= miss)])

    def of(self, elements: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Registers of sets of 64-bit elements; set i is elements[start[i]:start[i + 1]], none is empty."""
        rng = np.random.default_rng(42)
        factor = rng.integers(0, 2**63, self.registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 2**63, self.registers, dtype=np.uint64) * np.uint64(2)
        out = np.empty((len(start) - 1, self.registers), np.uint16)
        at = 0
        while at < len(start) - 1:
            to = max(at + 1, int(np.searchsorted(start, start[at] + 65536, "right")) - 1)
            part, begin = elements[start[at] : start[to]], start[at:to] - start[at]
            value = np.empty_like(part)
            for i in range(self.registers):
                np.multiply(part, factor[i], out=value)
                value += shift[i]
                least = (np.minimum.reduceat(value, begin).astype(np.float64) + 0.5) / 2.0**64
                height = 1 - np.log(-np.log1p(-np.minimum(least, 1 - 1e-16)) / self.rate) / math.log(self.base)
                out[at:to, i] = np.clip(np.floor(height), 0, 65535)
            at = to
        return out

    def at_least(self, similarity: float, n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Whether the joint maximum-likelihood estimate of the similarity reaches the one given.

        ``above`` and ``below`` count the registers in which the first set's is larger and smaller.
        The likelihood is concave, so its slope there tells on which side the maximum lies.
        """
        u = n_a / (n_a + n_b)
        v, c, j = 1 - u, (self.base - 1) / self.base, similarity
        x, y = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
        p, q = -np.log1p(-x * c) / math.log(self.base), -np.log1p(-y * c) / math.log(self.base)
        dp, dq = c / (math.log(self.base) * (1 - x * c)), c / (math.log(self.base) * (1 - y * c))
        equal = self.registers - above - below
        return equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-9) - above * v * dp / p - below * u * dq / q >= 0


def shingles(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """64-bit hashes of the word shingles of each text, where each text's begin, and a key of its words.

    Words are lower-cased in A-Z. Fewer words than ``width`` make one shingle; no words make none, and
    no key.
    """
    tokens = words(texts, lower=True)
    distinct = tokens.distinct.to_pylist()
    hashed = np.array([int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in distinct] or [0], np.uint64)
    n = tokens.counts
    sizes = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first, owner = ragged(tokens.start[:-1], sizes), np.repeat(np.arange(len(n)), sizes)
    word = np.append(hashed[tokens.code], np.uint64(0)) if len(tokens.code) else np.zeros(1, np.uint64)
    factors = np.random.default_rng(3).integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    end = tokens.start[1:][owner]
    z = np.zeros(len(first), np.uint64)
    for j in range(width):
        z += (word[np.where(first + j < end, first + j, len(word) - 1)] + np.uint64(1)) * factors[j]
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(by)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    wide = hashed[tokens.code] if len(tokens.code) else np.zeros(0, np.uint64)
    keys = [blake2b(wide[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(tokens.start[:-1].tolist(), tokens.start[1:].tolist(), strict=True)]
    return z, np.concatenate([[0], np.cumsum(sizes)]), keys


def sketched(docs: DataFrame, width: int, sketch: Sketch) -> DataFrame:
    """doc_id, mark, key (equal for equal words; null without words), n_shingles, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "t", 8 << 20):
            z, start, keys = shingles(Texts.of(table.column("t")), width)
            n = [len(np.unique(z[a:b])) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            full = np.flatnonzero(np.diff(start))
            registers = sketch.of(z, np.append(start[:-1][full], start[-1])) if len(full) else np.zeros((0, sketch.registers), np.uint16)
            each = [None] * len(n)
            for at, row in zip(full.tolist(), registers, strict=True):
                each[at] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [table.column("i").combine_chunks(), table.column("mark").combine_chunks(), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(each, pa.binary())],
                names=["doc_id", "mark", "key", "n_shingles", "registers"],
            )

    kind = dict(docs.dtypes)["i"]
    return docs.mapInArrow(run, f"doc_id {kind}, mark bigint, key binary, n_shingles bigint, registers binary")


def cells(members: DataFrame, block: int) -> DataFrame:
    """Members of each bucket dealt into cells: a bucket of more than ``block`` is cut into blocks, and
    each pair of blocks is a cell, so that every pair of members meets in a cell of bounded size."""
    many = F.ceil(F.col("size") / block)
    own = members.withColumn("blocks", many).withColumn("own", F.pmod(F.xxhash64("doc_id", "mark"), many))
    place = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("x"), F.greatest(j, F.col("own")).alias("y")))
    )
    return own.select("bucket", "band", "doc_id", "mark", "own", F.explode(place).alias("c")).select("bucket", "band", "doc_id", "mark", "own", "c.x", "c.y")


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The task's rows, which are sorted by whole numbers, as tables of whole groups of about ``rows`` rows, and where the groups begin."""
    held: list[pa.RecordBatch] = []

    def cut(final: bool) -> tuple[pa.Table, np.ndarray] | None:
        table = pa.Table.from_batches(held).combine_chunks()
        a = np.stack([table.column(c).to_numpy() for c in by])
        begin = np.append(0, np.flatnonzero((a[:, 1:] != a[:, :-1]).any(0)) + 1)
        if not final:
            begin, end = begin[:-1], begin[-1]
            held[:] = table.slice(end).to_batches()
            if not len(begin):
                return None
            table = table.slice(0, end)
        return table, np.append(begin, table.num_rows)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows and (got := cut(False)):
            yield got
    if held:
        yield cut(True)


@dataclass(frozen=True)
class Rule:
    """When two sets are linked, and which pairs of a cell are worth comparing."""

    sketch: Sketch
    percent: int
    rows: int
    slack: float = 4.5

    def candidates(self, table: pa.Table, begin: np.ndarray, step: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (i, j) of a cell's rows and their equal registers: pairs that meet in this band first,
        whose sizes allow a link and whose estimated similarity is near enough."""
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, self.sketch.registers)
        n, band, own = (table.column(c).to_numpy() for c in ("n_shingles", "band", "own"))
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        similarity = self.percent / 100
        near = similarity - self.slack * math.sqrt(similarity * (1 - similarity) / self.sketch.registers)
        bands = self.sketch.registers // self.rows
        triangle: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def judged() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            left, right = (np.concatenate(c) for c in zip(*held, strict=True))
            for at in range(0, len(left), step):
                i, j = left[at : at + step], right[at : at + step]
                small, big = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                fits = 100 * small >= self.percent * big
                i, j = i[fits], j[fits]
                a, b = registers[i], registers[j]
                same = a == b
                met = same[:, : bands * self.rows].reshape(-1, bands, self.rows).all(2)
                close = (met.argmax(1) == band[i]) & self.sketch.at_least(near, n[i], n[j], (a > b).sum(1), (a < b).sum(1))
                yield i[close], j[close], same.sum(1)[close]

        for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if x[s] == y[s]:
                if e - s < 2:
                    continue
                if e - s not in triangle:
                    triangle[e - s] = np.triu_indices(e - s, 1)
                i, j = triangle[e - s]
                held.append((i + s, j + s))
            else:
                one, two = np.flatnonzero(own[s:e] == x[s]) + s, np.flatnonzero(own[s:e] == y[s]) + s
                held.append((np.repeat(one, len(two)), np.tile(two, len(one))))
            size += len(held[-1][0])
            if size >= 4 * step:
                yield from judged()
                held, size = [], 0
        if held:
            yield from judged()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, sketch: Sketch | None = None, block: int = 512
) -> DataFrame:
    """One row per row of ``docs``: n_shingles, component_id, kept, text_hash, stands.

    A text's set holds its distinct shingles of ``width`` words (runs other than space and the
    characters 9 to 13, lower-cased in A-Z); fewer words make one shingle, none make an empty set,
    which is linked with nothing.  Two sets are linked if 100 * common >= percent * all;
    component_id is the smallest id reachable by links, and kept marks the rows that have it.

    Rows of equal words form one class, which is compared as one.  Classes with equal registers in a
    band share a bucket; a bucket's pairs are compared inside tasks, in cells of 2 * ``block`` classes at
    most, first by registers (the joint likelihood estimate, with a slack of 4.5 standard deviations),
    and the classes that are then near enough by their whole texts.  Only links are sent on, as many
    as a cell's forest has; no pair that shares a bucket and may be linked is left out.

    Null texts count as empty.  Null ids never stand for a class with other ids, and a class of null
    ids alone is linked with nothing (component_id null, kept).  Different texts of one id are told apart by
    ``text_hash`` (xxhash64 of the text) and linked each for itself; ``stands`` marks the one (id, text) of a
    component that stands for it, where ``kept`` marks all rows with its id.  Only the id and the text are read.
    An empty table gives an empty result.  A text longer than a block (8 MB) is a block of its own, and a task
    holds some 60 times its bytes; where it is compared, all texts of its cell are held.
    """
    sketch = sketch or Sketch()
    rule = Rule(sketch, percent, sketch.rows(percent / 100))
    read = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"), F.xxhash64(whole_text(text_col)).alias("mark"))
    kind = dict(read.dtypes)["i"]
    rows = checkpointed(sketched(read, width, sketch))
    # The second key makes the joins below deal their sides anew, so that Spark can split a hot class.
    classes = rows.filter("key is not null").groupBy("key").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("class_id")).withColumn("tag", F.crc32("key"))
    tagged = rows.withColumn("tag", F.crc32("key"))
    heads = checkpointed(
        tagged.join(classes, ["key", "tag"]).filter("doc_id = class_id.doc_id and mark = class_id.mark").select("doc_id", "mark", "n_shingles", "registers").dropDuplicates(["doc_id", "mark"])
    )
    size = 2 * rule.rows
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("registers", b * size + 1, size)) for b in range(sketch.registers // rule.rows)])
    buckets = heads.select("doc_id", "mark", F.posexplode(bands).alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    dealt = cells(buckets.join(shared, "bucket"), block).join(heads, ["doc_id", "mark"])
    order = ["bucket", "x", "y"]
    held = "bucket bigint, x bigint, y bigint, band int, own bigint, doc_id {}, mark bigint, n_shingles bigint, registers binary"

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in whole_groups(batches, order, 4096):
            used = np.zeros(table.num_rows, bool)
            for i, j, _ in rule.candidates(table, begin):
                used[i] = used[j] = True
            yield from table.filter(pa.array(used)).to_batches()

    columns = [c.split()[0] for c in held.split(", ")]
    near = checkpointed(dealt.select(*columns).repartition(*order).sortWithinPartitions(*order).mapInArrow(worth, held.format(kind)))
    texts = near.join(read.withColumnRenamed("i", "doc_id"), ["doc_id", "mark"]).dropDuplicates([*order, "doc_id", "mark"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in whole_groups(batches, order, 1024):
            z, start, _ = shingles(Texts.of(table.column("t")), width)
            sets: dict[int, np.ndarray] = {}
            full = lambda k: sets[k] if k in sets else sets.setdefault(k, np.unique(z[start[k] : start[k + 1]]))
            root = list(range(table.num_rows))

            def top(k: int) -> int:
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k

            links: list[tuple[int, int]] = []
            for i, j, same in rule.candidates(table, begin):
                best = np.argsort(-same, kind="stable")
                for a, b in zip(i[best].tolist(), j[best].tolist(), strict=True):
                    if (p := top(a)) == (q := top(b)):
                        continue
                    s, t = full(a), full(b)
                    common = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        root[q] = p
                        links.append((a, b))
            a, b = (np.array(c, np.int64) for c in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
            ids, marks = table.column("doc_id").combine_chunks(), table.column("mark").combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([ids.take(at), marks.take(at)], ["doc_id", "mark"]) for at in map(pa.array, (a, b))], names=["a", "b"])

    links = texts.select(*columns, "t").repartition(*order).sortWithinPartitions(*order).mapInArrow(verified, "a {0}, b {0}".format(f"struct<doc_id:{kind},mark:bigint>"))
    found = components(links)
    node = F.coalesce("component", "class_id")
    known = tagged.join(classes, ["key", "tag"]).join(found, F.col("class_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", node["doc_id"].alias("component_id"), "mark", (node == F.struct("doc_id", "mark")).alias("stands")
    )
    every = known.unionByName(rows.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "mark", F.lit(True).alias("stands")))
    return every.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("mark").alias("text_hash"), F.coalesce("stands", F.lit(True)).alias("stands")
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85, width=3)
