"""Token counts of whole texts from the counts of their distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from varloom.llm.blocks import Texts, blocks
from varloom.llm.common import documents
from varloom.llm.vocabulary import Vocabulary


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, block: int = 48 << 20) -> DataFrame:
    """One row per row of ``docs``: n_bytes (UTF-8), n_tokens, and over_limit (more than ``limit``).

    ``vocabulary`` is a tokenizers file that every executor can read.  In each block of texts the
    distinct pre-tokens are counted once by the tokenizer; their counts are joined, by code, to the
    pre-tokens of each text and summed.  A text's ids are never made.

    Null and empty texts have no bytes and no tokens.  Rows with null or repeated ids are counted
    like any other.  Only the id and the text are read.  An empty table gives an empty result.
    Needs no shuffle; a task holds one block of texts (``block`` bytes, or one longer text).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.load(vocabulary)
        for table in blocks(batches, "t", block):
            texts = Texts.of(table.column("t"))
            n = vocab.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [table.column("i").combine_chunks(), pa.array(np.diff(texts.start)), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    read = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"))
    return read.mapInArrow(count, f"doc_id {dict(read.dtypes)['i']}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
