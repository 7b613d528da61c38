"""Packing token ids into sequences of bounded length."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.blocks import Texts, blocks, ragged
from varloom.llm.common import documents
from varloom.llm.vocabulary import Vocabulary

PIECE = "struct<doc_id:{id},start:bigint,length:bigint,offset:bigint,doc_tokens:bigint,loss_tokens:bigint>"
SCHEMA = f"sequence_id bigint, n_tokens bigint, ids binary, segments array<int>, positions binary, pieces array<{PIECE}>"

#: From lengths and loss-bearing lengths of examples to pieces (example, start, length) in sequences:
#: arrays of the example, the start, the length and the sequence, ordered by sequence.
Packer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


class CapacityTree:
    """Segment tree over room 0..most: each node has the number of open sequences below it."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.node = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.node[i] += by
            i >>= 1

    def least(self, room: int) -> int:
        """The smallest room of an open sequence that is at least ``room``; -1 if there is none."""
        i, node = room + self.size, self.node
        if node[i]:
            return room
        while i > 1:
            if not i & 1 and node[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if node[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(most: int) -> Packer:
    """Overlong examples are cut every ``most`` tokens; pieces, longest first, go where least room stays."""

    def pack(tokens: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = -(-tokens // most)
        example = np.repeat(np.arange(len(tokens)), parts)
        start = ragged(np.zeros(len(parts), np.int64), parts) * most
        length = np.minimum(most, tokens[example] - start)
        place, used = np.empty(len(length), np.int64), 0
        tree, open_ = CapacityTree(most), defaultdict(list)
        for k in np.argsort(-length, kind="stable").tolist():
            need = int(length[k])
            room = tree.least(need) if need < most else -1
            if room < 0:
                place[k], used, room = used, used + 1, most
            else:
                place[k] = open_[room].pop()
                tree.add(room, -1)
            if room > need:
                open_[room - need].append(place[k])
                tree.add(room - need, 1)
        order = np.lexsort((start, example, place))
        return example[order], start[order], length[order], place[order]

    return pack


def dot_product_packing(most_tokens: int, most_segments: int, most_loss: int, max_gap: int) -> Packer:
    """Vector bin packing by the dot-product heuristic.

    One sequence is filled at a time.  Of the examples that fit in all dimensions it takes the one
    with the largest dot product of its demand and the room that is left, both as shares of the
    limits.  Where none fits and more than ``max_gap`` tokens are left, the head of the largest
    remaining example is cut off to fill them; longer examples than a sequence are cut this way too.
    """

    def pack(tokens: np.ndarray, loss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        kinds, kind = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
        waiting = defaultdict(list)
        for k, at in zip(kind.ravel().tolist()[::-1], range(len(tokens) - 1, -1, -1), strict=True):
            waiting[k].append((at, 0))
        t, l, left = kinds[:, 0].astype(float), kinds[:, 1].astype(float), np.bincount(kind.ravel(), minlength=len(kinds))
        key = {(int(a), int(b)): i for i, (a, b) in enumerate(kinds)}
        total, out, sequence = int(left.sum()), [], 0
        while total:
            room, segments, bearing = most_tokens, most_segments, most_loss
            while total and segments and room:
                fits = (left > 0) & (t <= room) & (l <= bearing)
                score = np.where(fits, t * (room / most_tokens**2) + l * (bearing / most_loss**2) + segments / most_segments**2, -1.0)
                k = int(score.argmax())
                if score[k] >= 0:
                    at, start = waiting[k].pop()
                    need, cost = int(t[k]), int(l[k])
                    total -= 1
                    left[k] -= 1
                elif room > max_gap and bearing > 0:
                    k = int(np.where(left > 0, t, -1).argmax())
                    at, start = waiting[k].pop()
                    left[k] -= 1
                    plain = int(t[k] - l[k])  # tokens at the front that bear no loss
                    need = min(room, int(t[k]) - 1, plain + bearing)
                    cost = max(0, need - plain)
                    rest = (int(t[k]) - need, int(l[k]) - cost)
                    if rest not in key:
                        key[rest] = len(t)
                        t, l, left = np.append(t, rest[0]), np.append(l, rest[1]), np.append(left, 0)
                    waiting[key[rest]].append((at, start + need))
                    left[key[rest]] += 1
                else:
                    break
                out.append((at, start, need, sequence))
                room, segments, bearing = room - need, segments - 1, bearing - cost
            sequence += 1
        a = np.array(out, np.int64).reshape(-1, 4)
        return a[:, 0], a[:, 1], a[:, 2], a[:, 3]

    return pack


def packed(
    docs: DataFrame, vocabulary: str, end: int, packer: Packer,
    id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, first_line: bool = False, positions: bool = False,
    limit: int = 16 << 20,
) -> DataFrame:
    """Sequences of token ids made of the rows of ``docs`` by a packer.

    An example is the ids of its prompt (if any), of its text, and ``end``; the prompt's ids bear no
    loss, nor does an example's first id.  Prompts come in ``prompt_col``, or with ``first_line`` a text of several
    lines has its first line as its prompt.  Returns for each sequence: sequence_id, n_tokens, ids
    (little-endian unsigned 32-bit, without padding), segments (cumulative lengths from 0), positions
    (ids' places in their segments, as ids are written; null unless asked for) and pieces (doc_id,
    start in the example, length, offset in the sequence, doc_tokens, loss_tokens).

    Null texts count as empty, and are packed as the end id alone.  Rows that repeat an id are packed
    as often as they come; null ids stay null.  Only the named columns are read.  An empty table gives
    an empty result.  Examples of equal sizes are taken in the order of their rows.

    Examples are packed with those of their block (``limit`` bytes of text, or one longer text), so nothing is
    shuffled and a task holds one block; each block leaves one sequence partly filled at most.  Which examples
    share a block follows how Spark splits the files, so other splits give other sequences, each as well filled.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.load(vocabulary)
        number = TaskContext.get().partitionId() << 40
        for table in blocks(batches, "t", limit):
            n, texts = table.num_rows, Texts.of(table.column("t"))
            ids, start = vocab.texts(texts)
            before = vocab.prefixes(texts, first_lines(texts)) if first_line else np.zeros(n, np.int64)
            if prompt_col:
                more, at = vocab.texts(Texts.of(table.column("p")))
                before = np.diff(at)
                ids = np.concatenate([more, ids])[_interleaved(before, np.diff(start), len(more))]
                start = start + at
            size = np.diff(start) + 1
            begin = np.cumsum(size) - size
            every = np.full(int(size.sum()), end, "<u4")
            every[ragged(begin, size - 1)] = ids
            example, first, length, place = packer(size, size - np.maximum(before, 1))
            used = np.bincount(place)
            edge = np.concatenate([[0], np.cumsum(used)])
            laid = every[ragged(begin[example] + first, length)]
            ends = np.cumsum(length)
            row = np.concatenate([[0], ends])[edge]
            offset = ends - length - row[place]
            free = np.clip(np.maximum(before, 1)[example] - first, 0, length)
            pieces = pa.StructArray.from_arrays(
                [table.column("i").combine_chunks().take(pa.array(example)), *map(pa.array, (first, length, offset, size[example], length - free))],
                ["doc_id", "start", "length", "offset", "doc_tokens", "loss_tokens"],
            )
            bounds = np.insert(offset + length, edge[:-1], 0).astype(np.int32)
            where = ragged(np.zeros(len(length), np.int64), length).astype("<u4") if positions else None
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number + np.arange(len(used))), pa.array(np.diff(row)), _rows(laid, row),
                    pa.ListArray.from_arrays(pa.array((edge + np.arange(len(edge))).astype(np.int32)), pa.array(bounds)),
                    _rows(where, row) if positions else pa.nulls(len(used), pa.binary()), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pieces),
                ],
                names=["sequence_id", "n_tokens", "ids", "segments", "positions", "pieces"],
            )
            number += len(used)

    cols = [docs[id_col].alias("i"), docs[text_col].cast("string").alias("t")]
    read = docs.select(*cols, *([docs[prompt_col].cast("string").alias("p")] if prompt_col else []))
    return read.mapInArrow(build, SCHEMA.format(id=dict(read.dtypes)["i"]))


def first_lines(texts: Texts) -> np.ndarray:
    """Length of the first line of each text; 0 where no other follows."""
    breaks = np.flatnonzero(texts.data == 10)
    at = np.append(breaks, len(texts.data))[np.searchsorted(breaks, texts.start[:-1])]
    return np.where(at + 1 < texts.start[1:], at - texts.start[:-1], 0)


def _interleaved(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
    """Order that puts each row's first ids before its second ids; those begin at ``shift``."""
    at = np.stack([np.cumsum(first) - first, shift + np.cumsum(second) - second], 1).ravel()
    return ragged(at, np.stack([first, second], 1).ravel())


def _rows(values: np.ndarray, row: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(row) - 1, [None, pa.py_buffer((row * 4).astype(np.int32)), pa.py_buffer(raw)])


def pieces(sequences: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per piece, with the crc32 of its ids as they are laid in the sequence, and if asked for the ids."""
    one = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    part = F.substring("ids", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return one.select("p.doc_id", "p.start", "p.length", F.crc32(part).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset", "p.loss_tokens", *([part.alias("ids")] if with_ids else []))


def write_matrices(sequences: DataFrame, path: str, width: int, pad: int) -> None:
    """Writes sequences as rows of a matrix: ids padded to ``width``, segments and positions."""
    fill = F.unhex(F.lit(int(pad).to_bytes(4, "little").hex()))
    wide = F.concat(F.col("ids"), F.unhex(F.repeat(F.hex(fill), (F.lit(width) - F.col("n_tokens")).cast("int"))))
    sequences.withColumn("ids", wide).write.parquet(path)


def op1_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-fit-decreasing packing of ``documents``, one row per sequence: its ids and their places in their segments
    (rows of the matrices, little-endian unsigned 32-bit; ``write_matrices`` pads them), the cumulative lengths of its
    segments, and of what those are pieces."""
    import public_tokenizers

    out = packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 50256, best_fit_decreasing(2048), positions=True)
    return out.select("sequence_id", "n_tokens", "ids", "segments", "positions", *(F.col(f"pieces.{c}").alias(f"{c}s") for c in ("doc_id", "start", "length")))


#: Limits of a sequence of ``documents``: tokens, segments, and tokens that bear loss.  A first line is the prompt of the
#: rest, so cut pieces of long texts bear loss all through: they are placed beside prompts, or leave 48 places empty.
LIMITS = (2048, 12, 2000)


def vector_packed(docs: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """Sequences of the vector packing of ``docs``, each document with its end id 1 and its first line as its prompt; ``limit`` is that of ``packed``."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), 1, dot_product_packing(*LIMITS, 32), first_line=True, limit=limit)


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(vector_packed(documents(spark, sf_dir)))
