"""Fill-in-the-middle: whole texts cut in three at unit ends, which ranks in a wavelet matrix locate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.blocks import SPACE, Texts, blocks
from varloom.llm.common import documents, whole_text

#: Classes of a byte by what ends with it: bit 0 a character, bit 1 a line, bit 2 a token.  A unit's end is any of these classes.
UNITS = {"char": (1, 3, 5, 7), "line": (3, 7), "token": (5, 7)}
SENTINELS = ("<P>", "<S>", "<M>")
HASHES = ("h1", "h2", "h3", "h4")


class WaveletMatrix:
    """Ranks of small symbols in a sequence of any length.

    One packed row of bits for each bit of a symbol, the highest first; each row has the symbols of the row before
    with the zeros of its bit moved to the front.  A quarter of a byte for each symbol and row.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.rows: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in reversed(range(bits)):
            one = (symbols >> bit & 1).astype(bool)
            packed = np.zeros((len(one) // 64 + 1) * 8, np.uint8)
            packed[: -(-len(one) // 8)] = np.packbits(one, bitorder="little")
            words = packed.view("<u8")
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.rows.append((bit, words, before, len(one) - int(before[-1])))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are set."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & mask)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are ``symbol``."""
        low, high = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for bit, words, before, zeros in self.rows:
            left, right = self._ones(words, before, low), self._ones(words, before, high)
            low, high = (zeros + left, zeros + right) if symbol >> bit & 1 else (low - left, high - right)
        return high - low

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are among ``symbols``."""
        return sum(self.rank(s, at) for s in symbols)

    def find(self, symbols: tuple[int, ...], times: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest places from ``low`` to ``high`` before which there are ``times`` of ``symbols``, by bisection on ranks."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.count(symbols, middle) >= times
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low


def classes(texts: Texts) -> np.ndarray:
    """The class of each byte (see ``UNITS``).  A token is white space with the word after it, or white space that ends the text."""
    data = texts.data
    if not len(data):
        return np.zeros(0, np.uint8)
    last = np.zeros(len(data), bool)
    last[texts.start[1:][np.diff(texts.start) > 0] - 1] = True
    space = SPACE[data]
    char, token = last.copy(), last.copy()
    char[:-1] |= (data[1:] & 0xC0) != 0x80
    token[:-1] |= ~space[:-1] & space[1:]
    return char.astype(np.uint8) | (last | (data == 10)).astype(np.uint8) << 1 | token.astype(np.uint8) << 2


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hex sha256 of ``seed``, a colon and the id; null ids count as the text 'null'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(h) for k, h in enumerate(HASHES)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80,
    unit: str = "token", sentinels: tuple[str, str, str] = SENTINELS, limit: int = 8 << 20,
) -> DataFrame:
    """One row per row of ``docs``: n (units of the whole text), form, prefix_chars, middle_chars (code points) and output.

    Both cuts are ends of units ('token', 'line' or 'char'), drawn by hashes of the id.  A block's bytes are classed by
    what ends with them; a wavelet matrix over the classes gives the units and characters before any place as sums of
    ranks, and bisection on those finds the cuts of all texts of the block at once.

    ``percent`` of the texts are rearranged, ``spm_percent`` of those with the suffix first (form 'spm'), the others with the
    prefix first ('psm').  Texts that are empty or hold one of the ``sentinels`` stay as they are ('plain'; prefix_chars and
    middle_chars are null), so each output has one reading, which ``restored`` gives.  Null counts as the empty text.  The
    sentinels must differ, and none may hold another or end as one begins; else a ValueError.

    Rows that repeat an id are cut by the same hashes; null ids count as the text 'null'.  Only the id and the text are
    read, so other columns' names do no harm.  An empty table gives an empty result.  Needs no shuffle; a task holds one block of texts
    (``limit`` bytes, or one longer text), some six times its size.
    """
    alike = [(a, b) for a in sentinels for b in sentinels if (a != b and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b)))]
    if len(set(sentinels)) < 3 or alike:
        raise ValueError(f"sentinels can be mistaken for each other: {sentinels}")
    ends, chars = UNITS[unit], UNITS["char"]
    p, s, m = (x.encode() for x in sentinels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "t", limit):
            texts = Texts.of(table.column("t"))
            begin, end = texts.start[:-1], texts.start[1:]
            matrix = WaveletMatrix(classes(texts), 3)
            before = matrix.count(ends, begin)
            n = matrix.count(ends, end) - before
            h = [table.column(x).to_numpy() for x in HASHES]
            drawn = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
            one, two = (matrix.find(ends, before + k, begin, end) for k in drawn)
            sizes = [matrix.count(chars, b) - matrix.count(chars, a) for a, b in ((begin, one), (one, two))]
            held = np.zeros(len(texts), bool)
            for mark in sentinels:
                held |= pc.match_substring(table.column("t"), mark).to_numpy(zero_copy_only=False).astype(bool)
            plain = (begin == end) | held | (h[2] % 100 >= percent)
            spm = h[3] % 100 < spm_percent
            out, data = [], texts.data
            for i, (a, b, c, d) in enumerate(zip(begin, one, two, end, strict=True)):
                if plain[i]:
                    out.append(data[a:d].tobytes())
                else:
                    prefix, middle, suffix = data[a:b].tobytes(), data[b:c].tobytes(), data[c:d].tobytes()
                    out.append(b"".join((s, suffix, p, prefix, m, middle) if spm[i] else (p, prefix, s, suffix, m, middle)))
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("i").combine_chunks(), pa.array(n), pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
                    pa.array(sizes[0], mask=plain), pa.array(sizes[1], mask=plain), pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    read = docs.select(docs[id_col].alias("i"), whole_text(text_col).alias("t"), *draws(id_col, seed))
    return read.mapInArrow(cut, f"doc_id {dict(read.dtypes)['i']}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of, from that and its form alone."""
    p, s, m = sentinels

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(output, a, -1), b, 1)

    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(documents(spark, sf_dir))
    text = restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


OP13_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), 'null')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units
  from documents
), drawn as (
  select *, len(units) as n, cast('0x' || h[1:8] as bigint) % (len(units) + 1) as a, cast('0x' || h[9:16] as bigint) % (len(units) + 1) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || h[17:24] as bigint) % 100 >= 50 then 'plain'
      when cast('0x' || h[25:32] as bigint) % 100 < 80 then 'spm' else 'psm' end as form
  from cut
), parts as (
  select *, array_to_string(units[1:least(a, b)], '') as p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') as m,
    array_to_string(units[greatest(a, b) + 1:n], '') as s
  from drawn
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""
