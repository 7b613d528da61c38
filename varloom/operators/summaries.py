"""Summaries over genes, tissues and samples that build on tests and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.scalars import normal_quantile
from varloom.operators.calling import reference_context
from varloom.operators.intervals import overlap_join
from varloom.operators.stats import bootstrap_ci, correlate, fisher_combine, permutation_fdr


def sorted_union(*frames: DataFrame, distinct: bool = True) -> DataFrame:
    """The rows of several tables with the same columns in order of all columns, equal rows once."""
    every = reduce(DataFrame.unionByName, frames)
    return (every.distinct() if distinct else every).orderBy(*every.columns)


def stranded_flanks(calls: DataFrame, exons: DataFrame, reference: DataFrame, flank: int = 1) -> DataFrame:
    """The reference around each call that lies in an exon, ``flank`` bases to both sides, with the exon's strand.

    A call in exons of both strands gives a row for each; the sequence is that of the forward strand.
    """
    inside = overlap_join(calls, exons.select("chrom", "start_pos", "end_pos", "strand")).drop("start_pos", "end_pos").distinct()
    return reference_context(inside.drop("ref", "context"), reference, 2 * flank + 1).withColumnRenamed("context", "seq")


def by_gene_table(assigned: DataFrame) -> DataFrame:
    """Calls in genes with the columns that mutation mappers take, to be written by gene."""
    return assigned.select(
        "gene_id", F.col("sample_id").alias("Sample_ID"), F.col("tissue").alias("Cancer_Type"), F.col("chrom").alias("Chromosome"), F.col("pos").alias("Start_Position"),
        F.col("pos").alias("End_Position"), F.col("ref").alias("Reference_Allele"), F.col("alt").alias("Variant_Allele"),
    )


def certain_variants(posteriors: DataFrame, least: float = 0.9) -> DataFrame:
    """Variants whose most likely genotype reaches ``least`` in every sample (variant_id, sample_id, posteriors), with that genotype."""
    best = F.array_max("posteriors")
    sure = posteriors.groupBy("variant_id").agg(F.bool_and(F.coalesce(best >= least, F.lit(False))).alias("_all")).filter("_all").select("variant_id")
    named = posteriors.withColumn("genotype", (F.array_position("posteriors", best) - 1).cast("int"))  # before the join, so that who asks for genotypes alone moves no posteriors
    return named.join(sure, "variant_id", "left_semi")


def signature_correlation(expression: DataFrame, signature: DataFrame, values: DataFrame, method: str = "spearman", with_p: bool = True) -> DataFrame:
    """How each sample's expression goes with a signature over its genes (gene_id, level), and over the samples how that goes
    with their values (sample_id, value): one row."""
    each = correlate(expression.join(signature, "gene_id"), "tpm", "level", ["sample_id"], method, with_p=False).select("sample_id", F.col("r").alias("similarity"))
    return correlate(each.join(values.select("sample_id", "value"), "sample_id"), "similarity", "value", [], method, with_p)


def association_fdr(real: DataFrame, permuted: DataFrame, key: list[str], over: list[str] | None = None) -> DataFrame:
    """Fisher's statistic of the p-values of each key, and its false discovery rate against stored permutations.

    ``real`` has the key and p, ``permuted`` perm_id too.  The rate is that of keys with the same ``over`` columns:
    genes over all tissues have key gene and no ``over``; pathways of a tissue key (pathway, tissue) and over tissue.
    Statistics that agree in nine digits count as equal.
    """
    over = over or []
    score = lambda df, by: fisher_combine(df, "p", by, with_p=False).withColumn("_low", -F.round("statistic", 9))
    found = score(real, key)
    rates = permutation_fdr(found, score(permuted, [*key, "perm_id"]), "_low", over).select(*over, "_low", F.least(F.lit(1.0), "fdr").alias("fdr"))
    return found.join(rates, [*over, "_low"]).select(*key, "statistic", F.col("n").alias("n_tests"), "fdr")


def normal_draw(mean: Column, sd: Column, *parts: Column | str) -> Column:
    """A normal draw that depends on the parts alone."""
    u = (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 0.5) / F.lit(float(1 << 53))
    return mean + sd * normal_quantile(u)


def simulated_medians(fits: DataFrame, key: list[str], unit: str, draws: int = 1000, rounds: int = 1000, interval: float = 0.9, seed: int = 1) -> DataFrame:
    """Median over units of what a fitted model lets expect, with a bootstrap interval, for each key.

    ``fits`` has the key, a unit, fitted and sigma.  Each unit's value is the mean of ``draws`` normal draws around its
    fitted value, which is worked out row by row.
    """
    spread = F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.lit(0.0), lambda acc, i: acc + normal_draw(F.lit(0.0), F.lit(1.0), F.lit(seed), *(F.col(c) for c in (*key, unit)), i)) / draws
    values = fits.withColumn("value", F.col("fitted") + F.col("sigma") * spread)
    return bootstrap_ci(values, "value", key, "median", rounds, interval, seed).withColumnRenamed("estimate", "median")


def profile_ratio(expression: DataFrame, shares: DataFrame, quantile: float = 0.2, n: int = 100, seed: int = 1) -> DataFrame:
    """For each gene and type the mean share in the samples that express the gene most over that in those that express it least.

    ``shares`` has (sample_id, mut_type, share).  Against that stand n drawings of two groups of the same sizes: their
    mean log2 ratio, and the share of those that are as far from 0.  A drawing orders the samples by a hash and takes
    the first ones and the next, so that sums along that order serve groups of all sizes.
    """
    cuts = expression.groupBy("gene_id").agg(F.percentile("tpm", F.array(F.lit(quantile), F.lit(1 - quantile))).alias("_q"))
    side = F.when(F.col("tpm") <= F.col("_q")[0], "low").when(F.col("tpm") >= F.col("_q")[1], "high")
    sides = expression.join(cuts, "gene_id").select("gene_id", "sample_id", side.alias("side")).filter("side is not null")
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("share")))
    means = sides.join(shares, "sample_id").groupBy("gene_id", "mut_type").agg(F.log2(F.try_divide(mean("high"), mean("low"))).alias("log2_ratio"))
    sizes = sides.groupBy("gene_id").agg(F.count_if(F.col("side") == "low").alias("n_low"), F.count_if(F.col("side") == "high").alias("n_high"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm_id").cast("string"), F.col("sample_id").cast("string")))
    drawn = shares.withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    along = Window.partitionBy("perm_id", "mut_type").orderBy(order, "sample_id")
    sums = drawn.select("perm_id", "mut_type", F.row_number().over(along).cast("long").alias("k"), F.sum("share").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    kinds = sizes.select("n_low", "n_high", (F.col("n_low") + F.col("n_high")).alias("n_both")).distinct()
    first = kinds.join(sums.select(F.col("k").alias("n_low"), "perm_id", "mut_type", F.col("s").alias("_a")), "n_low")
    both = first.join(sums.select(F.col("k").alias("n_both"), "perm_id", "mut_type", F.col("s").alias("_b")), ["n_both", "perm_id", "mut_type"])
    ratio = F.log2(F.try_divide((F.col("_b") - F.col("_a")) / F.col("n_high"), F.col("_a") / F.col("n_low")))
    nulls = both.select("n_low", "n_high", "mut_type", ratio.alias("_r")).groupBy("n_low", "n_high", "mut_type").agg(F.collect_list("_r").alias("_rs"), F.avg("_r").alias("perm_mean"))  # n values
    out = means.join(sizes, "gene_id").join(nulls, ["n_low", "n_high", "mut_type"], "left")
    reached = F.try_divide(F.size(F.filter("_rs", lambda r: F.abs(r) >= F.abs("log2_ratio") - 1e-12)), F.size("_rs"))
    return out.select("gene_id", "mut_type", "n_low", "n_high", "log2_ratio", "perm_mean", reached.alias("p_permuted"))
