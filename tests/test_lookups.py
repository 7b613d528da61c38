import pytest

from varloom.operators import calling, genes, lookups, regression
from varloom.plans import stats_queries
from varloom.plans.calls_queries import gene_seqs
from varloom.plans.projections import Tables


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_histograms_are_filled_with_zeros(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1)], "k string, n long")
    b = spark.createDataFrame([("y", 5), ("z", 7)], "k string, n long")
    assert rows(lookups.merge_histograms(a, b, ["k"]), "k", "n_a", "n_b") == [("x", 2, 0), ("y", 1, 5), ("z", 0, 7)]
    assert rows(lookups.merge_histograms(a.limit(0), b, ["k"]), "k", "n_a", "n_b") == [("y", 0, 5), ("z", 0, 7)]


def test_metadata_drops_empty_columns_and_incomplete_rows(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, t string")
    other = spark.createDataFrame([(1, 0.5, None), (3, 0.1, None)], "id int, v double, none int")
    out = lookups.assemble_metadata(base, [other], "id")
    assert out.columns == ["id", "t", "v"] and out.count() == 3
    assert rows(lookups.assemble_metadata(base, [other], "id", complete=True), "id") == [(1,)]


def test_first_symbol_and_listed_hits(spark):
    genes = spark.createDataFrame([("g1",), ("g2",)], "gene_id string")
    symbols = spark.createDataFrame([("g1", "B"), ("g1", "A")], "gene_id string, symbol string")
    assert rows(lookups.first_symbol(genes, symbols), "gene_id", "symbol") == [("g1", "A"), ("g2", None)]
    hits = spark.createDataFrame([("v1", 0.5), ("v2", 0.1), ("v3", 0.2)], "id string, p double")
    listed = spark.createDataFrame([("v1",), ("v2",), ("v2",)], "id string")
    assert [r["id"] for r in lookups.listed_hits(hits, listed, ["id"]).collect()] == ["v2", "v1"]


def test_covered_contexts_count_a_position_once_a_strand(spark):
    covered = spark.createDataFrame([("chr1", 5, "AACAA"), ("chr1", 5, "AACAA"), ("chr1", 20, "GGTGG")], "chrom string, pos long, context string")
    exons = spark.createDataFrame([("chr1", 1, 10, "+"), ("chr1", 4, 8, "+"), ("chr1", 5, 6, "-")], "chrom string, start_pos long, end_pos long, strand string")
    assert rows(lookups.covered_contexts(covered, exons), "strand", "context", "n") == [("+", "AACAA", 1), ("-", "AACAA", 1)]


def test_log_ratio_of_even_table_is_zero(spark):
    counts = spark.createDataFrame([("C>T", "T0", 2), ("C>T", "T1", 4), ("C>A", "T0", 1), ("C>A", "T1", 2)], "mut_type string, tissue string, n long")
    assert all(abs(r["log_ratio"]) < 1e-12 for r in lookups.log_ratio(counts, "mut_type", "tissue").collect())


def test_correlation_grid_by_ranks(spark):
    x = spark.createDataFrame([("f", i, float(i) ** 3) for i in range(5)], "feature string, s int, x double")
    w = spark.createDataFrame([("up", i, float(i)) for i in range(5)] + [("down", i, -float(i)) for i in range(5)], "weight string, s int, y double")
    found = {r["weight"]: round(r["r"], 9) for r in lookups.correlation_grid(x, w, "s", with_p=False).collect()}
    assert found == {"up": 1.0, "down": -1.0}


def test_pathway_share_of_permutations(spark):
    real = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.9)], "gene_id string, p double")
    terms = spark.createDataFrame([("low", "a"), ("low", "b"), ("high", "c")], "term string, gene_id string")
    drawn = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.02), (1, "c", 0.01), (2, "a", 0.01), (2, "b", 0.02), (2, "c", 0.9)], "perm_id int, gene_id string, p double")
    assert rows(lookups.pathway_enrichment(real, drawn, terms), "term", "n_genes", "p_permuted") == [("high", 1, 1.0), ("low", 2, 0.5)]


def test_region_scan_reads_only_near_variants(spark):
    features = spark.createDataFrame([(v, s, float((s * (v + 1)) % 3)) for v in range(3) for s in range(9)], "feature int, sample_id int, x double")
    phenotypes = spark.createDataFrame([("y", s, float(s % 3)) for s in range(9)], "phenotype string, sample_id int, y double")
    variants = spark.createDataFrame([(0, "chr1", 100), (1, "chr1", 5000), (2, "chr2", 100)], "feature int, chrom string, pos long")
    genes = spark.createDataFrame([("g", "chr1", 150, 200, "+")], "gene_id string, chrom string, start_pos long, end_pos long, strand string")
    out = lookups.region_scan(features, variants, genes, phenotypes, window=100, n=10)
    assert {r["feature"] for r in out.collect()} == {0}


def test_driver_summary_compares_targets_with_others(spark):
    counts = spark.createDataFrame([("T", f"g{i}", 10 + i if i < 3 else i) for i in range(8)] + [("U", "g0", 1)], "tissue string, gene_id string, n long")
    targets = spark.createDataFrame([("g0",), ("g1",), ("g2",)], "gene_id string")
    out = {r["tissue"]: r for r in lookups.driver_summary(counts, targets).collect()}
    assert (out["T"]["target_mean"], out["T"]["other_mean"], out["T"]["w"]) == (11.0, 5.0, 15.0)
    assert out["T"]["p_adjusted"] == out["T"]["p"] and out["U"]["other_mean"] is None


def test_region_scan_is_the_scan_of_each_gene(spark):
    features = spark.createDataFrame([(v, s, float((s * (v + 1) + s * s * v) % 3)) for v in range(4) for s in range(9)], "feature int, sample_id int, x double")
    phenotypes = spark.createDataFrame([(y, s, float((s * k) % 4)) for k, y in ((1, "y"), (3, "z")) for s in range(9)], "phenotype string, sample_id int, y double")
    variants = spark.createDataFrame([(0, "chr1", 100), (1, "chr1", 5000), (2, "chr2", 100), (3, "chr1", 120)], "feature int, chrom string, pos long")
    places = {"g": ("chr1", 150, 200), "h": ("chr1", 4950, 4960), "i": ("chr1", 110, 115), "k": ("chr2", 90, 5000)}
    genes = spark.createDataFrame([(g, *at, "+") for g, at in places.items()], "gene_id string, chrom string, start_pos long, end_pos long, strand string")
    out = lookups.region_scan(features, variants, genes, phenotypes, window=100, n=10, top_k=3)
    for gene, inside in {"g": [0, 3], "h": [1], "i": [0, 3], "k": [2]}.items():
        alone = regression.permutation_scan(features.filter(features.feature.isin(inside)), phenotypes, 10, 3)
        cols = ["feature", "phenotype", "n", "r", "p_bonferroni", "p_empirical"]
        assert rows(out.filter(out.gene_id == gene), *cols) == rows(alone, *cols)


def test_every_two_samples_of_a_subject_are_compared(spark):
    pile = spark.createDataFrame([(s, "chr1", 9, "A", "CCACC", 50, 50 if s == 2 else 0, 0, 0) for s in (1, 2, 3, 12, 22)], "sample_id int, chrom string, pos long, ref string, context string, a_n int, t_n int, g_n int, c_n int")
    subjects = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (12, 2), (22, 1)], "sample_id int, subject_id int")
    assert rows(calling.compare_samples(pile, subjects), "sample_id_a", "sample_id_b", "called_a", "called_b") == [(2, 12, True, False), (2, 3, True, False)]


def test_queries_read_every_sample(spark, tmp_path):
    # Calls of samples 1, 20, 21 and 28 in an exon of each of two genes: none of 1 in the second.
    line = "l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_extendedprice double"
    calls = [(k, 0, 5, 1, 20.0, 0.05, 0.04, 900.0) for k in (1, 20, 21, 28)] + [(k, 0, 60, 1, 20.0, 0.05, 0.04, 900.0) for k in (20, 21, 28)]
    spark.createDataFrame(calls, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, 24), (60, 24)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    t = Tables(spark, str(tmp_path))
    assert {r["gene_id"] for r in gene_seqs(t).collect()} == {"G0", "G1"}
    assert {r["exon_id"] for r in stats_queries.QUERIES["a48_a49_a50_exon_signal"][0](t).collect()} == {5, 60}


def test_too_many_marks_are_an_error(spark):
    at = spark.createDataFrame([("chr1", 5)], "chrom string, pos long")
    exons = spark.createDataFrame([(1, "chr1", 1, 10)], "exon_id int, chrom string, start_pos long, end_pos long")
    marks = spark.range(1001).selectExpr("concat('m', id) as mark", "'chr1' as chrom", "5L as pos", "1 as signal")
    with pytest.raises(ValueError, match="marks"):
        genes.exon_signal(exons, at, at, marks)
