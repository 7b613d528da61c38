"""Selection ratios of genes taken together: which genes count, means with intervals, sets against random sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators.genes import IMPACTS, annotate_impact, possible_changes
from varloom.operators.stats import bootstrap

#: Models of selection, and the impacts that each ratio of a model stands for.
RATIO_MODELS = (
    (("wmis", ("Missense",)), ("wnon", ("Nonsense",)), ("wspl", ("Essential_Splice",))),
    (("wmis", ("Missense",)), ("wtru", ("Nonsense", "Essential_Splice"))),
    (("wall", ("Missense", "Nonsense", "Essential_Splice")),),
)
#: Of each model, the ratios that are reported (wmis is that of the first).
REPORTED = (("wmis", "wnon", "wspl"), ("wtru",), ("wall",))


def context_change(ref: str, alt: str) -> Column:
    """A change with the bases beside it on the coding strand, as ACA>ATA; null where one of them is not known."""
    return F.concat("up", ref, "down", F.lit(">"), "up", alt, "down")


def annotate_contexts(calls: DataFrame, sites: DataFrame, splice: DataFrame) -> DataFrame:
    """Calls with their impact and their change in context, one row for each gene that they are in.

    ``sites`` come from ``codon_sites``; ``splice`` has the essential splice sites outside coding sequence (gene_id,
    chrom, pos, strand, base, up, down; bases on the coding strand).  Calls elsewhere, in incomplete codons, or
    beside an unknown base have no row.
    """
    beside = splice.select("gene_id", "chrom", "pos", "strand", "up", "down").withColumn("_splice", F.lit(True))
    places = sites.withColumn("_splice", F.lit(False)).unionByName(beside, allowMissingColumns=True)  # so that calls are worked out and moved once
    known = annotate_impact(calls, places).withColumn("impact", F.when(F.col("_splice"), "Essential_Splice").otherwise(F.col("impact")))
    return known.filter(F.col("impact").isin(*IMPACTS)).select(*calls.columns, "gene_id", "ref_cod", "alt_cod", "impact", context_change("ref_cod", "alt_cod").alias("change")).filter("change is not null")


def context_opportunities(sites: DataFrame, splice: DataFrame) -> DataFrame:
    """How many sites allow each change in context, by impact: at most 192 times 4 rows."""
    spliced = splice.groupBy("up", "base", "down").agg(F.count(F.lit(1)).alias("_k")).withColumn("alt_cod", F.explode(F.array(*map(F.lit, "ACGT")))).filter("alt_cod <> base").withColumn("impact", F.lit("Essential_Splice"))
    alike = sites.groupBy("up", "base", "down", "codon", "in_codon").agg(F.count(F.lit(1)).alias("_k"))  # some thousand rows, so that changes are worked out once for sites that are alike
    parts = [x.select("up", "base", "alt_cod", "down", "impact", "_k") for x in (possible_changes(alike), spliced)]
    return parts[0].unionByName(parts[1]).withColumn("change", context_change("base", "alt_cod")).filter("change is not null").groupBy("change", "impact").agg(F.sum("_k").alias("sites"))


def fit_ratios(n: np.ndarray, sites: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios and their standard errors from counts and sites of (change, class); the first class is synonymous.

    Each change has a rate of its own.  Given how many calls a change has, their classes are multinomial, so the
    rates drop out of the Poisson likelihood: Newton's steps are over the ratios alone, and their Hessian is the
    information on them that is left once the rates are fitted.  A ratio without calls is 0 (its logarithm is minus
    infinity) and has no error; where classes share no change, or none is synonymous, the ratio is not known (NaN).
    """
    k = n.shape[1] - 1
    beta, error = np.full(k, np.nan), np.full(k, np.nan)
    n = np.where(sites > 0, n, 0.0)  # calls where no site allows them do not count
    totals = n.sum(0)
    if totals[0] == 0:
        return beta, error
    beta[(totals[1:] == 0) & (sites.sum(0)[1:] > 0)] = -np.inf
    on = np.flatnonzero(totals[1:] > 0)
    if not len(on):
        return beta, error
    keep, used = n.sum(1) > 0, [0, *(on + 1)]
    c, m = n[keep][:, used], sites[keep][:, used]
    total, seen = c.sum(1), c.sum(0)

    def shares(b):
        mean = m * np.exp(np.concatenate([[0.0], b]))
        return mean[:, 1:] / mean.sum(1)[:, None], float(seen[1:] @ b - total @ np.log(mean.sum(1)))

    b = np.log(seen[1:] / seen[0])
    for _ in range(200):
        share, now = shares(b)
        hessian = np.diag(total @ share) - (share * total[:, None]).T @ share
        if np.linalg.eigvalsh(hessian)[0] <= 1e-9 * np.trace(hessian):
            return beta, error
        step = np.linalg.solve(hessian, seen[1:] - total @ share)
        while np.abs(step).max() > 1e-10 and shares(b + step)[1] < now - 1e-12 * abs(now):
            step = step / 2
        b = b + step
        if np.abs(step).max() <= 1e-10:
            break
    beta[on], error[on] = b, np.sqrt(np.diag(np.linalg.inv(hessian)))
    return beta, error


def context_ratios(annotated: DataFrame, opportunity: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Selection ratios over all genes by a Poisson model with a rate for each change in context: wmis, wnon and wspl
    together, wtru (nonsense and splice as one, beside wmis), and wall (all as one), with 95% Wald intervals.

    ``annotated`` comes from ``annotate_contexts``, ``opportunity`` from ``context_opportunities``; with a ``key`` there
    are ratios for each of its values (tissues, expression classes).  Spark sums the calls to a count for each change and
    impact, 768 a group whatever the data, and each group is fitted where its counts are.  A ratio without calls is 0,
    one that cannot be told is null; neither has an interval.  Without calls there is a row of nulls for each ratio, or
    none if there is a key.
    """
    key = list(key)
    cell = F.concat_ws("|", "change", "impact")
    possible = opportunity.agg(F.array_sort(F.collect_list(F.struct("change", "impact", "sites"))).alias("_l"))  # one row
    counted = annotated.filter(F.col("impact").isin(*IMPACTS)).groupBy(*key, "change", "impact").agg(F.count(F.lit(1)).alias("_k"))
    counts = counted.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(cell, "_k"))).alias("_n"))
    both = counts.join(F.broadcast(possible), how="cross")
    part = lambda f: F.transform("_l", f)
    often = part(lambda x: F.coalesce(F.try_element_at("_n", F.concat_ws("|", x["change"], x["impact"])), F.lit(0)).cast("double"))
    arrays = part(lambda x: x["change"]), part(lambda x: x["impact"]), part(lambda x: x["sites"].cast("double")), often
    models, reported, impacts, fit = RATIO_MODELS, REPORTED, IMPACTS, fit_ratios

    @F.pandas_udf("array<struct<name string, n long, beta double, error double>>")
    def fitted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for changes, kinds, sites, n in batches:
            yield pd.Series([[r for model, wanted in zip(models, reported) for r in ratios(model, wanted, *x)] for x in zip(changes, kinds, sites, n)])

    def ratios(model, wanted, change, kind, sites, n):
        names, row = np.unique(np.asarray(change, dtype=str), return_inverse=True)
        column = np.array([impacts.index(x) for x in kind], dtype=int)
        cells = np.zeros((2, len(names), len(impacts)))
        cells[0, row, column], cells[1, row, column] = n, sites
        classes = [[0], *([impacts.index(x) for x in of] for _, of in model)]
        n, sites = (np.stack([x[:, of].sum(1) for of in classes], 1) for x in cells)
        known = lambda x: None if np.isnan(x) else float(x)
        return [{"name": name, "n": int(k), "beta": known(b), "error": known(e)} for (name, _), k, b, e in zip(model, n.sum(0)[1:], *fit(n, sites)) if name in wanted]

    rows = both.select(*key, F.explode(fitted(*arrays)).alias("_r")).select(*key, "_r.*")
    bound = lambda sign: F.exp(F.col("beta") + sign * 1.959963984540054 * F.col("error"))
    return rows.select(*key, "name", "n", F.exp("beta").alias("mle"), bound(-1).alias("cilow"), bound(1).alias("cihigh"))


def good_ratios(per_gene: DataFrame, kind: str = "mis", least: int = 5) -> DataFrame:
    """Ratios of genes (those of ``dnds_per_gene``) that have synonymous and ``kind`` calls, ``least`` of them together.

    A ratio of 0 is set to the smallest that the largest one allows, 1 / (largest + 1).
    """
    n, w = F.col(f"n_{kind}"), F.col(f"w{kind}")
    known = per_gene.filter((F.col("n_syn") > 0) & (n > 0) & (F.col("n_syn") + n >= least)).select("gene_id", F.col("n_syn"), n.alias("n"), w.alias("ratio")).persist()  # one row a gene, read here and by each step of what follows
    most = known.agg(F.max("ratio").alias("_most"))  # one row
    return known.join(F.broadcast(most), how="cross").withColumn("ratio", F.when(F.col("ratio") == 0, 1 / (F.col("_most") + 1)).otherwise(F.col("ratio"))).drop("_most")


def ratio_means(ratios: DataFrame, key: list[str] | None = None, log: bool = True, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """Mean, median and trimmed mean of ratios (of their log2) with bootstrap intervals, one row each."""
    value = F.log2("ratio") if log else F.col("ratio")
    df, by = (ratios.withColumn("_v", value), key) if key else (ratios.withColumn("_v", value).withColumn("every", F.lit("all")), ["every"])
    return bootstrap(df, "_v", by, ("mean", "median", "trimmed_mean"), rounds, 0.95, seed)


def set_ratio(ratios: DataFrame, targets: DataFrame, random_sets: DataFrame) -> DataFrame:
    """Mean log2 ratio of the target genes against those of random sets (perm_id, gene_id): their mean and sd, and the share
    of sets that reach the targets'."""
    v = ratios.select("gene_id", F.log2("ratio").alias("v"))
    real = v.join(targets.select("gene_id").distinct(), "gene_id").agg(F.avg("v").alias("target_mean"), F.count(F.lit(1)).alias("n_targets"))  # one row
    sets = random_sets.join(v, "gene_id").groupBy("perm_id").agg(F.avg("v").alias("m"))
    both = sets.join(F.broadcast(real), how="cross")
    return both.groupBy("target_mean", "n_targets").agg(F.avg("m").alias("random_mean"), F.stddev_samp("m").alias("random_sd"), F.count(F.lit(1)).alias("n_sets"), F.avg((F.col("m") >= F.col("target_mean")).cast("double")).alias("p"))


def recurrence_bands(annotated: DataFrame, bands: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """Adds the band of how many samples have the mutation: the largest number of ``bands`` that it reaches."""
    key = ["chrom", "pos", "ref", "alt"]
    often = annotated.groupBy(*key).agg(F.countDistinct("sample_id").alias("_n"))
    band = F.lit(None).cast("int")
    for b in sorted(bands):
        band = F.when(F.col("_n") >= b, b).otherwise(band)
    return annotated.join(often, key).withColumn("band", band).drop("_n")
