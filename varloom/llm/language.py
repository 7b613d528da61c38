"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import crc_remainder, documents

#: Languages whose dictionaries a task holds ready at a time; more are taken in turns.
AT_ONCE = 64
UNKNOWN = "und"


def learn_dictionaries(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = 65536, piece: int = 1000, seed: int = 9
) -> dict[str, bytes]:
    """For each language a dictionary of ``dict_bytes`` bytes at most, of passages of labelled rows.

    The bounded sample: about 2 * dict_bytes / piece rows of each language, however many there are, chosen by a hash of
    id and text, of which each gives one passage of ``piece`` characters from a place chosen by the hash.
    Rows without text or language are left out, rows that come twice give one
    passage.  Only the id, text and language are read, so other columns' names do no harm.  The driver holds one dictionary for each language, of any number.  Languages come
    in order of their rows, and of their names where those are equal.
    """
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).alias("n"), F.col(text_col).cast("string").alias("text"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), 1).alias("h"),
    ).filter("lang is not null and n > 0")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()
    if not counts:
        return {}
    known = {r["lang"]: r["rows"] for r in counts}
    shares = labelled.sparkSession.createDataFrame([(k, min(1.0, 2 * dict_bytes / piece / n)) for k, n in known.items()], "lang string, share double")
    chosen = rows.join(F.broadcast(shares) if len(known) <= 10_000 else shares, "lang").filter(F.col("h") < F.col("share") * 2.0**63)
    at = (F.col("h") % F.greatest(F.lit(1), F.col("n") - piece + 1) + 1).cast("int")
    passages = chosen.select("lang", F.hash("h").alias("o"), F.lower(F.substring("text", at, F.lit(piece))).alias("t"))
    got = passages.groupBy("lang").agg(F.sort_array(F.collect_set(F.struct("o", "t"))).alias("all")).collect()
    return {r["lang"]: " ".join(x["t"] for x in r["all"]).encode()[:dict_bytes] for r in sorted(got, key=lambda r: (-known[r["lang"]], r["lang"]))}


def identify_language(
    docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", level: int = 6, min_margin: float = 0.02
) -> DataFrame:
    """One row per row of ``docs``: lang_pred, score, margin, rejected.

    The whole text, in lower case, is compressed with each language's dictionary as raw content; the
    language with the smallest result is predicted, ties going to the one that comes first in
    ``dictionaries``.  margin is how much smaller that is than the second smallest, as a share of it,
    score is 1 - (1 - margin)^8, and ``rejected`` marks margins below ``min_margin``, which are too narrow
    to be relied on.

    Texts that are null or have no letter are 'und' with score 0, rejected; so is every text if no
    language was learned.  One learned language alone has margin and score 1.  Null and repeated ids
    are treated like others.  Only the id and the text are read, so other columns' names do no harm.  An
    empty table gives an empty result.  Needs no shuffle; a task holds a batch of rows (64 MB, or one longer
    text and what it is compressed to) and ``AT_ONCE`` dictionaries made ready; of more languages, each batch is
    compressed with some after the others.
    """
    names = list(dictionaries)

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            return zstandard.ZstdCompressor(dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)

        turns = [range(a, min(a + AT_ONCE, len(names))) for a in range(0, len(names), AT_ONCE)]
        ready: dict[int, list[zstandard.ZstdCompressor]] = {}
        for frame in frames:
            texts = [None if t is None or not any(map(str.isalpha, t)) else f" {t.lower()} ".encode() for t in frame["t"]]
            best: list[list[tuple[int, int]]] = [[] for _ in texts]
            for k, turn in enumerate(turns):
                if k not in ready:
                    ready.clear()
                    ready[k] = [compressor(dictionaries[names[i]]) for i in turn]
                for at, data in enumerate(texts):
                    if data is not None:
                        best[at] = sorted([*best[at], *((len(c.compress(data)), i) for i, c in zip(turn, ready[k], strict=True))])[:2]
            margins = [0.0 if not two else 1 - two[0][0] / two[1][0] if len(two) > 1 else 1.0 for two in best]
            yield pd.DataFrame(
                {
                    "doc_id": frame["i"], "lang_pred": [names[two[0][1]] if two else UNKNOWN for two in best], "score": [1 - (1 - m) ** 8 for m in margins],
                    "margin": margins, "rejected": [not two or m < min_margin for two, m in zip(best, margins, strict=True)],
                }
            )

    read = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"))
    return read.mapInPandas(predict, f"doc_id {dict(read.dtypes)['i']}, lang_pred string, score double, margin double, rejected boolean")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_remainder("doc_id", 4) == 2
    dictionaries = learn_dictionaries(docs.filter(~held_out))
    return identify_language(docs, dictionaries).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")
