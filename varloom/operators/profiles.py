"""Mutation types and sequence contexts of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.scalars import CODE_COLUMNS, CODE_ROWS, folded_context, mutation_code, mutation_type, reverse_complement

TYPES = [f"{a}>{b}" for a in "CT" for b in "ACGT" if a != b]


def type_counts(calls: DataFrame, key: list[str]) -> DataFrame:
    """Calls by folded type, long."""
    return calls.groupBy(*key, mutation_type().alias("mut_type")).agg(F.count(F.lit(1)).alias("n"))


def type_matrix(calls: DataFrame, key: list[str]) -> DataFrame:
    """Calls by folded type, one column per type, 0 where there are none."""
    return type_counts(calls, key).groupBy(*key).pivot("mut_type", TYPES).agg(F.sum("n")).fillna(0)


def context_counts(calls: DataFrame, key: list[str], k: int = 5, strand_mode: str = "middle_only", dense: bool = True) -> DataFrame:
    """Calls by type code and context of k bases, with 0 for all that a key lacks if ``dense``.

    The grid has the contexts of five letters (N too) around the folded reference, for both rows and
    all columns of the count matrix, as a fixed table of 6 * 5^(k-1) rows.
    """
    counts = calls.groupBy(*key, mutation_code().alias("mut_code"), folded_context(strand_mode=strand_mode).alias("context")).agg(F.count(F.lit(1)).alias("n"))
    if not dense:
        return counts
    grid = calls.select(*key).distinct().withColumn("mut_code", F.explode(F.array(*[F.lit(f"{i}{j}") for i, r in enumerate(CODE_ROWS) for j, c in enumerate(CODE_COLUMNS) if r != c])))
    middle = F.substring(F.lit(CODE_ROWS), F.substring("mut_code", 1, 1).cast("int") + 1, F.lit(1))
    context: Column = F.lit("")
    for i in range(k):
        if i == k // 2:
            grid = grid.withColumn(f"_b{i}", middle)
        else:
            grid = grid.withColumn(f"_b{i}", F.explode(F.array(*map(F.lit, "ACGTN"))))
        context = F.concat(context, F.col(f"_b{i}"))
    full = grid.select(*key, "mut_code", context.alias("context"))
    return full.join(counts, [*key, "mut_code", "context"], "left").fillna(0, ["n"])


def shrink_contexts(counts: DataFrame, key: list[str], k: int) -> DataFrame:
    """Context counts for shorter contexts with the same middle, without unknown bases."""
    start = ((F.length("context") - k) / 2 + 1).cast("int")
    short = counts.withColumn("context", F.substring(F.col("context"), start, F.lit(k))).filter(~F.col("context").contains("N"))
    return short.groupBy(*key, "mut_code", "context").agg(F.sum("n").alias("n"))


def type_summary(calls: DataFrame) -> DataFrame:
    """Mean and sd over samples of the count of each type, and the type's share of all."""
    counts = type_counts(calls, ["sample_id"])
    out = counts.groupBy("mut_type").agg(F.avg("n").alias("mean_n"), F.stddev_samp("n").alias("sd_n"), F.sum("n").alias("total"))
    return out.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))


def type_rates(calls: DataFrame, base_counts: DataFrame) -> DataFrame:
    """Calls of each type per base of its (folded) reference; ``base_counts`` has (base, n_bases), folded."""
    counts = type_counts(calls, []).withColumn("base", F.substring("mut_type", 1, 1))
    return counts.join(base_counts, "base").withColumn("rate", F.col("n") / F.col("n_bases"))


def cpg_ratio(calls: DataFrame, key: list[str], anchored: bool = True) -> DataFrame:
    """C>T in CpG against C>T elsewhere, as a log2 ratio; ``anchored`` looks right after the middle base,
    the other form for a G anywhere from the third base on."""
    c = folded_context(strand_mode="revcomp")
    middle = ((F.length(c) + 1) / 2).cast("int")
    cpg = F.substring(c, middle + 1, F.lit(1)) == "G" if anchored else c.rlike("..G")
    ct = calls.filter(mutation_type() == "C>T")
    out = ct.groupBy(*key).agg(F.count_if(cpg).alias("n_cpg"), F.count_if(~cpg).alias("n_other"))
    return out.withColumn("log2_ratio", F.log2(F.try_divide("n_cpg", "n_other")))


def diversity(expression: DataFrame, pseudo: float = 0.0) -> DataFrame:
    """Shannon entropy (bits) of each sample's expression over log2 of its expressed genes."""
    e = expression.withColumn("v", F.col("tpm") + pseudo).filter("v > 0")
    total = e.groupBy("sample_id").agg(F.sum("v").alias("s"))
    p = F.col("v") / F.col("s")
    return e.join(total, "sample_id").groupBy("sample_id").agg((-F.sum(p * F.log2(p))).alias("entropy"), F.count(F.lit(1)).alias("n_genes")).withColumn("diversity", F.try_divide(F.col("entropy"), F.log2("n_genes")))


def kmer_counts(sequences: DataFrame, key: str, k: int) -> DataFrame:
    """Counts of each k-mer in each sequence (key, seq)."""
    at = F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1)).alias("at")
    return sequences.filter(F.length("seq") >= k).select(key, "seq", at).groupBy(key, F.substring(F.col("seq"), F.col("at"), F.lit(k)).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def kmer_opportunity(kmers: DataFrame, expression: DataFrame) -> DataFrame:
    """Expression-weighted k-mers of each sample, with the middle base folded."""
    half = F.length("kmer") / 2
    middle = F.substring(F.col("kmer"), (half + 1).cast("int"), F.lit(1))
    folded = F.when(middle.isin("A", "G"), reverse_complement("kmer")).otherwise(F.col("kmer"))
    return kmers.join(expression, "gene_id").groupBy("sample_id", folded.alias("kmer")).agg(F.sum(F.col("n") * F.col("tpm")).alias("weight"))


def merge_strands(counts: DataFrame, key: list[str]) -> DataFrame:
    """Counts by context with each context and its reverse complement taken together, as the smaller of the two."""
    both = F.least(F.col("context"), reverse_complement("context"))
    return counts.groupBy(*key, both.alias("context")).agg(F.sum("n").alias("n"))


def coding_share(counts: DataFrame, background: DataFrame) -> DataFrame:
    """Share of each context's calls in coding sequence, and its rate relative to the background's count."""
    c = counts.groupBy("context").agg(F.sum(F.when(F.col("coding"), F.col("n")).otherwise(0)).alias("n_coding"), F.sum("n").alias("n"))
    return c.join(background, "context").select("context", "n_coding", "n", (F.col("n_coding") / F.col("n")).alias("coding_share"), (F.col("n") / F.col("n_background")).alias("rate"))


def share_within(df: DataFrame, value: str, key: list[str], out: str = "share") -> DataFrame:
    return df.withColumn(out, F.col(value) / F.sum(value).over(Window.partitionBy(*key)))


def profile_similarity(profiles: DataFrame, key: str = "tissue") -> DataFrame:
    """Cosine of the type profiles of each pair of keys; profiles are summed first, so pairs are of keys."""
    p = profiles.select(F.col(key), "mut_type", "n")
    a, b = p.select(F.col(key).alias("a"), "mut_type", F.col("n").alias("x")), p.select(F.col(key).alias("b"), "mut_type", F.col("n").alias("y"))
    norm = p.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("s"))
    dots = a.join(b, "mut_type").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    na, nb = norm.select(F.col(key).alias("a"), F.col("s").alias("sa")), norm.select(F.col(key).alias("b"), F.col("s").alias("sb"))
    return dots.join(na, "a").join(nb, "b").select("a", "b", F.try_divide(F.col("dot"), F.col("sa") * F.col("sb")).alias("cosine"))
