"""A corpus from documents: quality rules, exact and near duplicates out, sources mixed, tokens packed.

Every stage takes documents (doc_id, text, lang, source, n_chars; other columns do no harm and are left behind) and
reads all of them.  Null texts count as empty; null ids and sources are values like others; an empty table gives an
empty result; texts may be of any length (see the operators for what a long one costs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import exact, mixing, near, packing, quality
from varloom.llm.common import documents, whole_text, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of text that mixing deals to one partition, as long as those are no more than Spark's shuffle partitions.
PART_BYTES = 32 << 20
#: Bytes of text that are packed together.
PACK_BYTES = 8 << 20
#: SQL has no functions for sketches, random rounding and tokens; tests hold the stages against plain versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without the lines that failed; n_chars follows the text.

    Null and empty texts go, as they have too few words; repeated rows are judged alike, and stay repeated.
    """
    judged = quality.line_quality(docs, carry=("lang", "source")).filter("kept")
    return judged.select("doc_id", F.col("cleaned").alias("text"), "carried.lang", "carried.source", F.length("cleaned").cast("long").alias("n_chars"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id (nulls are the smallest); rows repeated whole once."""
    verdict = written(exact.exact_groups(docs).select("doc_id", "text_sha256", "kept"))
    named = docs.select(*COLUMNS).withColumn("text_sha256", F.sha2(whole_text("text"), 256))
    gone = verdict.filter(~F.col("kept")).distinct().select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s"))
    kept = named.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_sha256") == F.col("s")), "left_anti")
    again = verdict.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text_sha256"])).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, a similarity of 0.8): the one with the smallest id.

    Different texts that share an id are judged each for itself; texts without words are all kept.
    """
    gone = near.near_duplicates(docs, percent=80, width=5).filter(~F.col("stands")).select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).distinct()
    named = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64(whole_text("text")))
    return named.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("_hash") == F.col("h")), "left_anti").select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; ids that come several times take their largest number of copies.

    Copies are dealt by id and number, so that those of a document are rarely packed together.
    """
    copies = mixing.mix_sources(docs).filter("copies > 0").groupBy(F.col("doc_id").alias("i")).agg(F.max("copies").alias("copies"))
    taken = docs.select(*COLUMNS).join(copies, F.col("doc_id").eqNullSafe(F.col("i")))
    size = docs.agg(F.sum(F.octet_length(whole_text("text")))).first()[0] or 0
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).repartition(parts, "doc_id", "copy").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, in sequences of 2048 tokens at most; repeated rows come as often as they are."""
    return packing.pieces(packing.vector_packed(docs, PACK_BYTES), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what each returns is written, and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
