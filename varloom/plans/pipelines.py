"""The pipelines that the operators compose."""

from __future__ import annotations

from pyspark.sql import DataFrame

from varloom.operators import calling, cohort, filters, profiles


def call_mutations(pileup: DataFrame, stats: DataFrame, junctions: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Pileup to clean calls: called, labelled (regions, junctions, errors, clusters, bias), kept."""
    calls = calling.call_variants(pileup)
    calls = filters.label_near(calls, blacklist, 1, "blacklisted_region")
    calls = filters.label_near(calls, junctions, 7, "splice_junction_error")
    calls = filters.label_seq_error(calls)
    calls = filters.label_clustered(calls)
    return filters.keep_clean(filters.label_bias(calls, stats))


def cohort_map(calls: DataFrame, min_freq: float = 0.4, recurrent: float = 0.04) -> DataFrame:
    """Clean calls to the final map: panel of normals, then recurrence over all samples."""
    return cohort.drop_panel_and_recurrent(calls, min_freq, recurrent)


def threshold(calls: DataFrame, min_support: int = 6, min_coverage: int = 40, vaf_hi: float = 0.7) -> DataFrame:
    """The cutoffs of calling, for tables that hold calls already."""
    vaf = calls["n_support"] / calls["coverage"]
    return calls.filter((calls["coverage"] >= min_coverage) & (calls["n_support"] >= min_support) & (vaf > 0) & (vaf <= vaf_hi))


def flagship(calls: DataFrame) -> DataFrame:
    """Calls to counts of each tissue and type: cutoffs, cluster label, panel of normals, types."""
    clean = filters.keep_clean(filters.label_clustered(threshold(calls)))
    return profiles.type_counts(cohort.drop_panel(clean, cohort.panel_of_normals(clean)), ["tissue"])
