"""Lookups, assembled tables, and scans that combine other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.genes import agreement_fdr
from varloom.operators.intervals import genes_near, overlap_join
from varloom.operators.regression import alike, association_scan, strongest_of, tested_pairs
from varloom.operators.stats import adjust, correlate, permute, rank_sum


def merge_histograms(a: DataFrame, b: DataFrame, key: list[str], value: str = "n") -> DataFrame:
    """Two histograms side by side, 0 where one has no such key; keys must be unique and not null."""
    left, right = a.select(*key, F.col(value).alias(f"{value}_a")), b.select(*key, F.col(value).alias(f"{value}_b"))
    return left.join(right, key, "full").fillna(0, [f"{value}_a", f"{value}_b"])


def assemble_metadata(base: DataFrame, others: list[DataFrame], key: str, complete: bool = False) -> DataFrame:
    """``base`` with the columns of the other tables, which have one row per key.

    Columns without any value are dropped; with ``complete``, rows that miss a value are too.
    """
    joined = reduce(lambda x, y: x.join(y, key, "left"), others, base)
    known = joined.agg(*[F.count(c).alias(c) for c in joined.columns]).first()
    kept = joined.select(*[c for c in joined.columns if c == key or known[c]])
    return kept.dropna() if complete else kept


def first_symbol(df: DataFrame, symbols: DataFrame, id_col: str = "gene_id", symbol: str = "symbol") -> DataFrame:
    """Adds the first symbol, in order of text, of each id; null for ids that have none."""
    return df.join(symbols.groupBy(id_col).agg(F.min(symbol).alias(symbol)), id_col, "left")


def listed_hits(hits: DataFrame, listed: DataFrame, on: list[str], p: str = "p") -> DataFrame:
    """The hits that are listed, smallest p first."""
    return hits.join(listed.select(*on), on, "left_semi").orderBy(p, *on)


def covered_contexts(covered: DataFrame, exons: DataFrame) -> DataFrame:
    """Number of covered positions (chrom, pos, context) inside exons of each strand, by context.

    A position counts once for each strand, however many exons or samples cover it.
    """
    inside = overlap_join(covered.select("chrom", "pos", "context"), exons.select("chrom", "start_pos", "end_pos", "strand"))
    return inside.select("chrom", "pos", "context", "strand").distinct().groupBy("strand", "context").agg(F.count(F.lit(1)).alias("n"))


def context_fdr(pairs: DataFrame, key: list[str], subject: str = "subject_id") -> DataFrame:
    """False discovery of paired calls by key: the mean of the subjects' percentages, and their number."""
    each = agreement_fdr(pairs, [subject, *key])
    return each.groupBy(*key).agg(F.avg("fdr_percent").alias("mean_fdr"), F.count("fdr_percent").alias("n_subjects"))


def correlation_grid(features: DataFrame, weights: DataFrame, on: str, method: str = "spearman", with_p: bool = True) -> DataFrame:
    """Correlation of each feature (feature, ``on``, x) with each weight (weight, ``on``, y) over the units that both have."""
    return correlate(features.join(weights, on), "x", "y", ["feature", "weight"], method, with_p)


def log_ratio(counts: DataFrame, key: str, unit: str, value: str = "n") -> DataFrame:
    """log2 of each unit's value over what its total and the key's share over all units let expect."""
    by_unit, by_key = (counts.groupBy(c).agg(F.sum(value).alias(f"_{c}")) for c in (unit, key))
    total = counts.agg(F.sum(value).alias("_all"))  # one row
    joined = counts.join(by_unit, unit).join(by_key, key).join(F.broadcast(total), how="cross")
    expected = F.try_divide(F.col(f"_{unit}") * F.col(f"_{key}"), F.col("_all"))
    return joined.withColumn("expected", expected).withColumn("log_ratio", F.log2(F.try_divide(F.col(value), F.col("expected")))).drop(f"_{unit}", f"_{key}", "_all")


def region_scan(
    features: DataFrame, variants: DataFrame, genes: DataFrame, phenotypes: DataFrame, window: int = 100_000, n: int = 100, top_k: int = 100, seed: int = 1
) -> DataFrame:
    """For each gene the permutation scan of the variants (feature, chrom, pos) that lie within ``window`` of it.

    Pairs and permutations are worked out once for all genes; Bonferroni's number of tests, the largest |r| of a
    permutation and ``top_k`` are those of the gene.  Of the pairs only the ``top_k`` of each variant leave their block.
    """
    near = genes_near(variants, genes, window).select("feature", "gene_id").distinct()
    inside = features.join(near, "feature", "left_semi")
    classes = alike(inside)
    of_gene = near.join(classes[1], "feature").select("gene_id", F.col("first").alias("feature")).distinct()
    real = association_scan(inside, phenotypes, top_each=top_k, classes=classes).join(near, "feature")
    perm = permute(phenotypes, ["phenotype"], "y", "sample_id", n, seed)
    best = strongest_of(classes[0], perm).join(of_gene, "feature").groupBy("gene_id", "perm_id").agg(F.max("m").alias("m"))
    maxima = best.groupBy("gene_id").agg(F.collect_list("m").alias("ms"))  # n values a gene
    order = Window.partitionBy("gene_id").orderBy(F.desc(F.abs("r")), "feature", "phenotype")
    tests = tested_pairs(inside, phenotypes, classes).join(near, "feature").groupBy("gene_id").agg(F.sum("tests").alias("tests"))
    top = real.filter("r is not null").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= top_k).drop("_k").join(tests, "gene_id").join(maxima, "gene_id")
    reached = F.size(F.filter("ms", lambda m: m >= F.abs("r") - 1e-12)) / F.size("ms")
    return top.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * F.col("tests"))).withColumn("p_empirical", reached).drop("ms", "tests")


def pathway_enrichment(real: DataFrame, permuted: DataFrame, terms: DataFrame, on: str = "gene_id") -> DataFrame:
    """For each term the Fisher statistic of its genes' p, and the share of permutations that reach it.

    ``real`` has (gene, p), ``permuted`` (perm_id, gene, p), ``terms`` (term, gene).
    """
    statistic = F.sum(-2 * F.log("p")).alias("statistic")
    found = real.join(terms, on).groupBy("term").agg(statistic, F.count(F.lit(1)).alias("n_genes"))
    drawn = permuted.join(terms, on).groupBy("perm_id", "term").agg(statistic).select("term", F.col("statistic").alias("drawn"))
    reached = F.avg(F.when(F.col("drawn") >= F.col("statistic") - 1e-12, 1.0).otherwise(0.0))
    return found.join(drawn, "term").groupBy("term", "statistic", "n_genes").agg(reached.alias("p_permuted"))


def driver_summary(counts: DataFrame, targets: DataFrame, by: str = "tissue", value: str = "n") -> DataFrame:
    """For each tissue the means of target and other genes, their log2 ratio, the rank test and its p adjusted over tissues.

    ``counts`` has (``by``, gene_id, ``value``); a tissue without genes of either kind has null statistics.
    """
    known = targets.select("gene_id").distinct().withColumn("_t", F.lit(True))
    flagged = counts.join(known, "gene_id", "left").withColumn("kind", F.when(F.col("_t"), 0).otherwise(1))
    means = flagged.groupBy(by).agg(F.avg(F.when(F.col("_t"), F.col(value))).alias("target_mean"), F.avg(F.when(F.col("_t").isNull(), F.col(value))).alias("other_mean"))
    tests = adjust(rank_sum(flagged, value, "kind", [by]), "p", [])
    return means.withColumn("log2_ratio", F.log2(F.try_divide(F.col("target_mean"), F.col("other_mean")))).join(tests, by)
