"""Exact duplicates by recipes of content-defined chunks; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import documents, whole_text

#: A chunk ends after two characters of these classes, so that its ends depend on the content near
#: them alone; it has at least LEAST characters and at most MOST.
CUT = r"(?<=[a-dA-Dà-ÿ一-濿\s][e-nE-N.,а-я瀀-鿿])"
LEAST, MOST = 256, 4096
#: Identifiers of a chunk, tried in turn until one tells all chunks of the corpus apart; the last is the chunk itself.
SCHEMES: tuple[Callable[[Column], Column], ...] = (lambda c: F.unhex(F.md5(c)), lambda c: F.unhex(F.sha2(c, 256)), lambda c: c.cast("binary"))


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text as an array of chunks whose concatenation is the text; none for the empty text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?{CUT}|.{{1,{most}}}"), F.lit(0))


def told_apart(parts: DataFrame, scheme: Callable[[Column], Column]) -> bool:
    """Whether no two different chunks of the corpus share an identifier: all chunks are compared by content."""
    pieces = parts.select(F.explode("chunks").alias("chunk")).select(scheme(F.col("chunk")).alias("id"), "chunk")
    different = pieces.groupBy("id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return different.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its group of equal texts: keep_id, group_size, kept, text_sha256.

    Texts are cut at content-defined places; a chunk is named by an identifier that is verified, by
    comparing the content of all chunks once, to differ between different chunks.  A text's recipe is
    the ordered list of its identifiers, and equal recipes are equal texts: only recipes move after
    that.  Groups are counted before they are joined back, and the join may split hot groups.

    Null counts as the empty text, whose recipe is empty.  keep_id is the largest id of a group
    (nulls count as smallest); rows that repeat an id share its verdict, as nothing tells them apart.
    Only the id and the text are read.  An empty table gives an empty result.
    """
    read = docs.select(docs[id_col].alias("doc_id"), whole_text(text_col).alias("text"))
    parts = read.select(chunks(F.col("text")).alias("chunks"))
    scheme = next((s for s in SCHEMES[:-1] if told_apart(parts, s)), SCHEMES[-1])
    recipes = read.select(
        "doc_id",
        F.transform(chunks(F.col("text")), scheme).alias("recipe"),
        F.sha2("text", 256).alias("text_sha256"),
    ).withColumn("n_chunks", F.size("recipe"))
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # With the number of chunks as a second key the join deals both sides anew, so that Spark can split a hot group.
    return recipes.join(groups.withColumn("n_chunks", F.size("recipe")), ["recipe", "n_chunks"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op8_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP8_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
