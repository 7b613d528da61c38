"""Genes: assignment, impact, selection, strands, and agreement of assays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.scalars import complement, mutation_id, mutation_type, position_bin, with_amino_acid
from varloom.functions.tails import chi2_p
from varloom.operators.intervals import distances, overlap_join
from varloom.operators.stats import adjust, rank_sum

IMPACTS = ("Synonymous", "Missense", "Nonsense", "Essential_Splice")

#: Marks that exon_signal makes columns of.
MOST_MARKS = 1000


def assign_genes(calls: DataFrame, genes: DataFrame) -> DataFrame:
    """A row for each gene that holds the call, with the alleles on the gene's strand."""
    inside = overlap_join(calls, genes)
    minus = F.col("strand") == "-"
    return inside.withColumns({f"{c}_cod": F.when(minus, complement(c)).otherwise(F.col(c)) for c in ("ref", "alt")})


def codon_sites(cds_sites: DataFrame) -> DataFrame:
    """Adds to each coding position (gene_id, cds_pos, base on the coding strand) its codon, its place in it and its neighbours.

    ``up`` and ``down`` that are given (neighbours in the genome, on the coding strand) stay; else they are those in the coding sequence."""
    w = Window.partitionBy("gene_id").orderBy("cds_pos")
    near = cds_sites.withColumn("codon_index", F.floor((F.col("cds_pos") - 1) / 3))
    if not {"up", "down"} <= set(cds_sites.columns):
        near = near.withColumn("up", F.lag("base").over(w)).withColumn("down", F.lead("base").over(w))
    # a codon lies within two positions of each of its own, so the order of the gene that is there already shows it
    beside = F.collect_list(F.struct("cds_pos", "base", "codon_index")).over(w.rangeBetween(-2, 2))
    own = F.sort_array(F.filter("_near", lambda x: x["codon_index"] == F.col("codon_index")))
    known = near.filter("gene_id is not null").withColumn("_near", beside).filter("cds_pos is not null")
    sites = known.withColumn("codon", F.array_join(F.transform(own, lambda x: x["base"]), "")).drop("_near")
    return sites.withColumn("in_codon", ((F.col("cds_pos") - 1) % 3 + 1).cast("int"))


def annotate_impact(calls: DataFrame, sites: DataFrame, splice: DataFrame | None = None) -> DataFrame:
    """Impact of each call in coding sequence: Essential_Splice at listed sites, else by the amino acids
    of the codon with the call's own reference and alternate written in.

    ``sites`` come from ``codon_sites`` with the gene's strand; incomplete codons give no impact.
    """
    minus = F.col("strand") == "-"
    c = calls.join(sites, ["chrom", "pos"]).withColumns({f"{x}_cod": F.when(minus, complement(x)).otherwise(F.col(x)) for x in ("ref", "alt")})
    put = lambda base: F.concat(F.substring(F.col("codon"), F.lit(1), F.col("in_codon") - 1), base, F.substring(F.col("codon"), F.col("in_codon") + 1, F.lit(3)))
    c = with_amino_acid(with_amino_acid(c, put(F.col("ref_cod")), "old_aa"), put(F.col("alt_cod")), "new_aa")
    impact = F.when(F.col("new_aa") == F.col("old_aa"), "Synonymous").when(F.col("new_aa") == "*", "Nonsense").when(F.col("old_aa") != "*", "Missense").when(F.col("old_aa") == "*", "Stop_loss")
    codon_number = (F.col("codon_index") + 1).cast("string")
    out = c.withColumn("impact", impact).withColumn("aachange", F.concat("old_aa", codon_number, "new_aa")).withColumn("ntchange", F.concat("ref_cod", F.col("cds_pos").cast("string"), "alt_cod"))
    if splice is not None:
        marked = out.join(splice.select("chrom", "pos").distinct().withColumn("_s", F.lit(True)), ["chrom", "pos"], "left")
        out = marked.withColumns({"impact": F.when(F.col("_s"), "Essential_Splice").otherwise(F.col("impact")), "aachange": F.when(F.col("_s"), "-").otherwise(F.col("aachange")), "ntchange": F.when(F.col("_s"), "-").otherwise(F.col("ntchange"))}).drop("_s")
    return out


def possible_changes(sites: DataFrame) -> DataFrame:
    """A row for each base that a coding position may change to, with the impact it would have."""
    alts = sites.filter(F.length("codon") == 3).withColumn("alt_cod", F.explode(F.array(*map(F.lit, "ACGT")))).filter("alt_cod <> base")
    new = F.concat(F.substring(F.col("codon"), F.lit(1), F.col("in_codon") - 1), F.col("alt_cod"), F.substring(F.col("codon"), F.col("in_codon") + 1, F.lit(3)))
    a = with_amino_acid(with_amino_acid(alts, F.col("codon"), "old_aa"), new, "new_aa")
    impact = F.when(F.col("new_aa") == F.col("old_aa"), "Synonymous").when(F.col("new_aa") == "*", "Nonsense").when(F.col("old_aa") != "*", "Missense")
    return a.withColumn("impact", impact).filter("impact is not null")


def opportunities(sites: DataFrame) -> DataFrame:
    """For each gene, change (ref>alt on the coding strand) and impact the number of possible changes."""
    return possible_changes(sites).groupBy("gene_id", F.concat("base", F.lit(">"), "alt_cod").alias("change"), "impact").agg(F.count(F.lit(1)).alias("sites"))


def _cells(annotated: DataFrame, opportunity: DataFrame) -> DataFrame:
    n = annotated.filter(F.col("impact").isin(*IMPACTS)).groupBy("gene_id", F.concat("ref_cod", F.lit(">"), "alt_cod").alias("change"), "impact").agg(F.count(F.lit(1)).alias("n"))
    return opportunity.join(n, ["gene_id", "change", "impact"], "left").fillna(0, ["n"])


def dnds_global(annotated: DataFrame, opportunity: DataFrame) -> DataFrame:
    """Selection ratios over all genes by a Poisson model with a rate for each change and a log offset of
    the possible sites: wmis and wnon, and wall with one ratio for both; with 95% intervals."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GeneralizedLinearRegression

    cells = _cells(annotated, opportunity).groupBy("change", "impact").agg(F.sum("sites").alias("sites"), F.sum("n").alias("n")).filter("sites > 0")
    # 36 rows at the most: twelve changes and three impacts.
    cells = annotated.sparkSession.createDataFrame(cells.collect(), cells.schema)
    changes = [f"{a}>{b}" for a in "ACGT" for b in "ACGT" if a != b]
    rates = [F.when(F.col("change") == c, 1.0).otherwise(0.0) for c in changes]
    found = []
    for models in ((("wmis", ["Missense"]), ("wnon", ["Nonsense"])), (("wall", ["Missense", "Nonsense"]),)):
        ratios = [F.when(F.col("impact").isin(*kinds), 1.0).otherwise(0.0) for _, kinds in models]
        # Wald intervals come from the fit's standard errors; no intercept, as each change has a rate.
        table = cells.select(F.col("n").cast("double").alias("label"), F.log("sites").alias("offset"), array_to_vector(F.array(*rates, *ratios)).alias("features"))
        model = GeneralizedLinearRegression(family="poisson", link="log", offsetCol="offset", fitIntercept=False, maxIter=100).fit(table)
        errors = model.summary.coefficientStandardErrors
        for i, (name, _) in enumerate(models):
            b, s = float(model.coefficients[len(changes) + i]), float(errors[len(changes) + i])
            found.append((name, b, s))
    out = annotated.sparkSession.createDataFrame(found, "name string, beta double, se double")
    return out.select("name", F.exp("beta").alias("mle"), F.exp(F.col("beta") - 1.959963984540054 * F.col("se")).alias("cilow"), F.exp(F.col("beta") + 1.959963984540054 * F.col("se")).alias("cihigh"))


def dnds_per_gene(annotated: DataFrame, opportunity: DataFrame, with_p: bool = True) -> DataFrame:
    """Selection ratios of each gene relative to its own synonymous calls, with likelihood-ratio p and BH.

    Expected counts of a gene are its possible sites times the rate of each change, which is the rate
    of synonymous calls over all genes.  Of the Poisson likelihoods only the terms that differ between
    the models are needed, and those depend on four observed and expected sums.
    """
    cells = _cells(annotated, opportunity).persist()  # a few rows a gene, which rates and sums read
    rates = cells.filter("impact = 'Synonymous'").groupBy("change").agg(F.try_divide(F.sum("n"), F.sum("sites")).alias("rate"))
    sums = cells.join(rates, "change").groupBy("gene_id").agg(*[x for k in IMPACTS[:3] for x in (
        F.sum(F.when(F.col("impact") == k, F.col("n")).otherwise(0)).alias(f"n_{k[:3].lower()}"), F.sum(F.when(F.col("impact") == k, F.col("sites") * F.col("rate")).otherwise(0.0)).alias(f"e_{k[:3].lower()}")
    )])
    n, e = [F.col(f"n_{k}") for k in ("syn", "mis", "non")], [F.col(f"e_{k}") for k in ("syn", "mis", "non")]
    term = lambda k, m: F.when(m > 0, k * F.log(m)).otherwise(0.0) - m
    total = lambda fold, w: reduce(lambda a, b: a + b, [term(n[i], e[i] * fold * w[i]) for i in range(3)])
    one = F.lit(1.0)
    free = lambda i, fold: F.when((n[i] == 0) | (e[i] == 0), 0.0).otherwise(F.try_divide(F.try_divide(n[i], e[i]), fold))
    r0 = F.try_divide(sum(n, F.lit(0)), sum(e, F.lit(0.0)))
    r1 = F.greatest(F.lit(1e-10), (n[0] + n[1]) / (e[0] + e[1]))
    r2 = F.greatest(F.lit(1e-10), n[0] / e[0])
    out = sums.filter((e[0] > 0) & (e[1] > 0)).withColumn("ll0", total(r0, [one, one, one])).withColumn("llmis", total(r1, [one, one, free(2, r1)])).withColumn("llall", total(r2, [one, free(1, r2), free(2, r2)]))
    out = out.withColumn("wmis", F.least(F.lit(1e4), free(1, r2))).withColumn("wnon", F.least(F.lit(1e4), free(2, r2)))
    out = out.withColumn("lr_mis", 2 * (F.col("llall") - F.col("llmis"))).withColumn("lr_all", 2 * (F.col("llall") - F.col("ll0"))).drop("ll0", "llmis", "llall")
    if not with_p:
        return out
    tested = out.withColumn("p_mis", chi2_p("lr_mis", F.lit(1.0))).withColumn("p_all", chi2_p("lr_all", F.lit(2.0))).persist()  # one row a gene, which both adjustments read
    return adjust(adjust(tested, "p_mis", [], out="q_mis"), "p_all", [], out="q_all")


def vaf_classes(annotated: DataFrame, groups: int = 4) -> DataFrame:
    """Adds the quantile group of the allele frequency, for selection ratios by class."""
    from varloom.operators.windows import quantile_groups

    return quantile_groups(annotated.withColumn("vaf", F.col("n_support") / F.col("coverage")), "vaf", groups)


def ratio_by_class(annotated: DataFrame, opportunity: DataFrame, key: str) -> DataFrame:
    """Missense over synonymous calls per possible site, for each value of a column."""
    l = opportunity.groupBy("impact").agg(F.sum("sites").alias("sites"))  # noqa: E741
    n = annotated.filter(F.col("impact").isin(*IMPACTS[:3])).groupBy(key, "impact").agg(F.count(F.lit(1)).alias("n")).join(l, "impact")
    rate = lambda k: F.sum(F.when(F.col("impact") == k, F.col("n") / F.col("sites")))
    return n.groupBy(key).agg(F.try_divide(rate("Missense"), rate("Synonymous")).alias("mis_ratio"), F.sum("n").alias("n"))


def gene_counts(assigned: DataFrame) -> DataFrame:
    """Calls of each gene in each sample."""
    return assigned.groupBy("gene_id", "sample_id").agg(F.count(F.lit(1)).alias("n"))


def dense_gene_counts(counts: DataFrame, genes: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts for every listed gene and sample, 0 where there are no calls."""
    grid = genes.select("gene_id").distinct().join(samples.select("sample_id").distinct(), how="cross")  # the result has this size
    return grid.join(counts, ["gene_id", "sample_id"], "left").fillna(0, ["n"])


def expression_with_counts(expression: DataFrame, counts: DataFrame) -> DataFrame:
    return expression.join(counts, ["gene_id", "sample_id"], "left").fillna(0, ["n"])


def flag_known_changes(annotated: DataFrame, known: DataFrame) -> DataFrame:
    """Flags calls whose amino-acid change is listed for the gene."""
    listed = known.select("gene_id", "aachange").distinct().withColumn("known", F.lit(True))
    return annotated.join(listed, ["gene_id", "aachange"], "left").fillna({"known": False})


def flag_last_interval(calls: DataFrame, last: DataFrame) -> DataFrame:
    """Flags calls in the last coding interval of their gene (gene_id, last_start, last_end)."""
    joined = calls.join(last, "gene_id", "left")
    inside = (F.col("pos") >= F.col("last_start")) & (F.col("pos") < F.col("last_end"))
    return joined.withColumn("in_last", F.coalesce(inside, F.lit(False))).drop("last_start", "last_end")


def strand_asymmetry(stranded: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts of each key and type on both strands with their ratio, and mean, sd and sd / n of the counts
    (key columns, mut_type, transcribed boolean)."""
    counts = stranded.groupBy(*key, "mut_type", "transcribed").agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.groupBy(*key, "mut_type").agg(F.max(F.when(F.col("transcribed"), F.col("n"))).alias("n_transcribed"), F.max(F.when(~F.col("transcribed"), F.col("n"))).alias("n_other"))
    stats = counts.groupBy("mut_type", "transcribed").agg(F.avg("n").alias("mean_n"), F.stddev_samp("n").alias("sd_n"), (F.stddev_samp("n") / F.count(F.lit(1))).alias("stderr_n"))
    return pairs.withColumn("fc", F.col("n_transcribed") / F.col("n_other")), stats


def transcribed_strand(calls: DataFrame) -> DataFrame:
    """Whether the folded (pyrimidine) base lies on the gene's transcribed strand, and the folded type."""
    folded = F.col("ref").isin("A", "G")
    return calls.withColumn("mut_type", mutation_type()).withColumn("transcribed", F.when(F.col("strand") == "+", folded).otherwise(~folded))


def strand_asymmetry_by_gene(stranded: DataFrame, with_p: bool = True) -> DataFrame:
    """Both strands of each gene and type: totals plus 0.9, their ratio, a rank test over samples, BH."""
    counts = stranded.groupBy("gene_id", "mut_type", "sample_id").agg(F.count_if("transcribed").alias("a"), F.count_if(~F.col("transcribed")).alias("b"))
    if with_p:
        counts = counts.persist()  # totals, ranks and adjustment read them
    totals = counts.groupBy("gene_id", "mut_type").agg((F.sum("a") + 0.9).alias("n_transcribed"), (F.sum("b") + 0.9).alias("n_other"), F.count(F.lit(1)).alias("n_samples"))
    totals = totals.withColumn("fc", F.col("n_transcribed") / F.col("n_other"))
    if not with_p:
        return totals
    long = counts.select("gene_id", "mut_type", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("v")), F.struct(F.lit("b").alias("side"), F.col("b").alias("v")))).alias("s")).select("gene_id", "mut_type", "s.*")
    tests = rank_sum(long, "v", "side", ["gene_id", "mut_type"]).select("gene_id", "mut_type", "w", "p")
    return adjust(totals.join(tests, ["gene_id", "mut_type"]), "p", [])


def two_tissue_ratio(counts: DataFrame, a: str, b: str, least: int = 6) -> DataFrame:
    """Genes with enough calls in both tissues and the ratio of those (tissue, gene_id, n)."""
    wide = counts.filter(F.col("tissue").isin(a, b)).groupBy("gene_id").pivot("tissue", [a, b]).agg(F.sum("n"))
    return wide.filter((F.col(a) >= least) & (F.col(b) >= least)).select("gene_id", F.col(a).alias("n_a"), F.col(b).alias("n_b"), (F.col(a) / F.col(b)).alias("ratio"))


def agreement(pairs: DataFrame, key: list[str], min_expected: float = 8.0, min_support: int = 6) -> DataFrame:
    """How calls of a first assay fare in a second one, over all calls and over those it supports.

    ``pairs`` has ref1, alt1, alt_n1, cov1 and ref2, alt2, alt_n2, cov2, with X for no second base.
    """
    from varloom.operators.filters import drop_low_coverage_pairs

    p = drop_low_coverage_pairs(pairs, min_expected)
    one, two, turned = F.concat("ref1", "alt1"), F.concat("ref2", "alt2"), F.concat("alt2", "ref2")
    same, either, none = one == two, (one == two) | (one == turned), two.contains("X")
    sure = F.col("alt_n2") >= min_support
    return p.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(either).alias("agreed_bases"), F.count_if(same).alias("agreed_direction"), F.count_if(~either & ~none).alias("disagreed"), F.count_if(none).alias("no_call"),
        F.count_if(sure).alias("sure"), F.count_if(sure & either).alias("sure_agreed_bases"), F.count_if(sure & same).alias("sure_agreed_direction"), F.count_if(sure & ~either & ~none).alias("sure_disagreed"),
    )


def agreement_fdr(pairs: DataFrame, key: list[str], min_expected: float = 8.0) -> DataFrame:
    """Percent of calls that the second assay does not show, by key."""
    from varloom.operators.filters import drop_low_coverage_pairs

    shown = (F.col("ref1") == F.col("ref2")) & (F.col("alt1") == F.col("alt2")) & (F.col("alt_n2") > 0)
    out = drop_low_coverage_pairs(pairs, min_expected).groupBy(*key).agg(F.count_if(~shown).alias("false_positives"), F.count_if(shown).alias("true_positives"))
    return out.withColumn("fdr_percent", F.col("false_positives") / (F.col("false_positives") + F.col("true_positives")) * 100)


def expression_stats(expression: DataFrame) -> DataFrame:
    return expression.groupBy("gene_id").agg(F.sum("tpm").alias("sum_tpm"), F.percentile("tpm", F.lit(0.5)).alias("median_tpm"), F.avg("tpm").alias("mean_tpm"), F.var_samp("tpm").alias("var_tpm"))


def impact_share(annotated: DataFrame) -> DataFrame:
    counts = annotated.filter("impact is not null").groupBy("gene_id", "impact").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gene_id")))


def gene_by_tissue(calls: DataFrame, tissues: list[str]) -> DataFrame:
    return calls.groupBy("gene_id").pivot("tissue", tissues).count().fillna(0)


def collapsed_vaf(annotated: DataFrame) -> DataFrame:
    """Median allele frequency of each mutation, gene and impact."""
    return annotated.filter("impact is not null").groupBy(mutation_id().alias("mutation"), "gene_id", "impact").agg(F.percentile(F.col("n_support") / F.col("coverage"), F.lit(0.5)).alias("vaf"))


def cds_position_profile(annotated: DataFrame, bins: int = 10) -> DataFrame:
    """Calls by relative position in the coding sequence (cds_pos, cds_length)."""
    return annotated.groupBy(position_bin("cds_pos", "cds_length", bins).alias("bin"), "impact").agg(F.count(F.lit(1)).alias("n"))


def distance_histogram(calls: DataFrame, covered: DataFrame, exons: DataFrame, most: int = 100) -> DataFrame:
    """Calls and covered positions by distance to the nearest exon, and calls per covered position."""
    counted = lambda df: df.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("_n"))
    hist = lambda df, c: distances(counted(df), exons).filter((F.col("distance") >= 0) & (F.col("distance") <= most)).groupBy("distance").agg(F.sum("_n").alias(c))
    both = hist(calls, "n_calls").join(hist(covered, "n_covered"), "distance", "full").fillna(0, ["n_calls", "n_covered"])
    return both.withColumn("rate", F.try_divide("n_calls", "n_covered"))


def exon_signal(exons: DataFrame, calls: DataFrame, depth: DataFrame, marks: DataFrame) -> DataFrame:
    """Calls, covered positions and each mark's mean signal of exons where all marks are above 0, as log2.

    ``marks`` has (mark, chrom, pos, signal); each mark is a column, more than ``MOST_MARKS`` are an error: ``exon_signal_long`` takes any number.
    """
    names = [r[0] for r in marks.select("mark").distinct().orderBy("mark").limit(MOST_MARKS + 1).collect()]  # column names
    if len(names) > MOST_MARKS:
        raise ValueError(f"more than {MOST_MARKS} marks: use exon_signal_long")
    n = overlap_join(calls.select("chrom", "pos"), exons.select("exon_id", "chrom", "start_pos", "end_pos")).groupBy("exon_id").agg(F.count(F.lit(1)).alias("n_calls"))
    d = overlap_join(depth.select("chrom", "pos"), exons.select("exon_id", "chrom", "start_pos", "end_pos")).groupBy("exon_id").agg(F.count(F.lit(1)).alias("n_covered"))
    m = overlap_join(marks, exons.select("exon_id", "chrom", "start_pos", "end_pos")).groupBy("exon_id").pivot("mark", names).agg(F.avg("signal"))
    every = reduce(lambda a, b: a & b, [F.col(x) > 0 for x in names])
    return n.join(d, "exon_id").join(m, "exon_id").filter(every).select("exon_id", "n_calls", "n_covered", F.log2(F.col("n_calls") / F.col("n_covered")).alias("log_rate"), *[F.log2(x).alias(x) for x in names])


def exon_signal_long(exons: DataFrame, calls: DataFrame, depth: DataFrame, marks: DataFrame) -> DataFrame:
    """What ``exon_signal`` has, with a row for each exon and mark, for any number of marks: (exon_id, n_calls, n_covered, log_rate, mark, log_signal)."""
    spans = exons.select("exon_id", "chrom", "start_pos", "end_pos")
    count = lambda df, c: overlap_join(df.select("chrom", "pos"), spans).groupBy("exon_id").agg(F.count(F.lit(1)).alias(c))
    means = overlap_join(marks.select("mark", "chrom", "pos", "signal"), spans).groupBy("exon_id", "mark").agg(F.avg("signal").alias("s"))
    number = marks.agg(F.countDistinct("mark").alias("_m"))  # one row
    whole = means.groupBy("exon_id").agg(F.count_if(F.col("s") > 0).alias("_k")).join(F.broadcast(number), F.col("_k") == F.col("_m")).select("exon_id")
    rates = count(calls, "n_calls").join(count(depth, "n_covered"), "exon_id").join(whole, "exon_id")
    return rates.join(means, "exon_id").select("exon_id", "n_calls", "n_covered", F.log2(F.col("n_calls") / F.col("n_covered")).alias("log_rate"), "mark", F.log2("s").alias("log_signal"))


def match_assays(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of runs of two assays of the same subject; ids come as comma lists (subject_id, runs)."""
    side = lambda df, c: df.select("subject_id", F.explode(F.split("runs", ",")).alias(c)).withColumn(c, F.trim(c)).filter(F.col(c) != "").dropDuplicates()
    return side(a, "run_a").join(side(b, "run_b"), "subject_id")


def translate_ids(df: DataFrame, id_map: DataFrame, source: str, target: str) -> DataFrame:
    """Adds the target id of each row's source id (null if unknown); the map is first made unique on the source."""
    unique = id_map.groupBy(source).agg(F.min(target).alias(target))
    return df.join(unique, source, "left")


def meta_summary(results: DataFrame, key: str = "gene_id") -> DataFrame:
    """Signs of a gene over tissues (gene_id, beta, p), and Fisher's combination of its p-values: statistic, p_combined and BH over the genes.

    A missing beta has no sign and a missing p does not count; a gene without any p has nulls.
    """
    c: Column = F.col("beta")
    out = results.groupBy(key).agg(
        F.count_if(c > 0).alias("n_up"), F.count_if(c < 0).alias("n_down"), F.count("p").alias("n_tests"), (-2 * F.sum(F.log(F.greatest("p", F.lit(1e-300))))).alias("statistic"), F.log2((F.count_if(c > 0) + 1) / (F.count_if(c < 0) + 1)).alias("sign_ratio")
    )
    return adjust(out.withColumn("p_combined", chi2_p("statistic", 2.0 * F.col("n_tests"))), "p_combined", [], out="p_adjusted")
