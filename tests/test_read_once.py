"""Steps that read calls, sites and gene tables once, with the rows of those that read them again."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from varloom.operators import cohort, genes, selection
from varloom.plans import pipelines, reads_queries

SITES = "gene_id string, chrom string, strand string, pos long, base string, cds_pos long"


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dnds_keeps_its_cells(spark):
    seen = spark.createDataFrame([("g", "A", "C", k) for k in ("Synonymous", "Missense", "Missense")], "gene_id string, ref_cod string, alt_cod string, impact string").withColumn("_m", F.md5(F.col("gene_id")))
    possible = spark.createDataFrame([("g", "A>C", "Synonymous", 4), ("g", "A>C", "Missense", 8)], "gene_id string, change string, impact string, sites long")
    found = genes.dnds_per_gene(seen, possible)
    row = found.first()
    assert (row["n_syn"], row["n_mis"], row["e_syn"], row["e_mis"], row["wmis"]) == (1, 2, 1.0, 2.0, 1.0)
    assert found._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation") > 0


def test_codons_come_from_the_order_of_the_gene(spark):
    rows = [("g", "c1", "+", 10 + i, "ACGT"[i % 4], i + 1) for i in range(8)] + [("h", "c1", "-", 50 - i, b, p) for i, (b, p) in enumerate((("C", 4), ("G", 6), ("A", 6), ("T", 7), ("C", None)))] + [(None, "c1", "+", 1, "A", 1)]
    sites = genes.codon_sites(spark.createDataFrame(rows, SITES))
    got = sorted((r["gene_id"], r["cds_pos"], r["base"], r["codon"], r["in_codon"]) for r in sites.collect())
    g = [("g", i + 1, "ACGT"[i % 4], ("ACG", "TAC", "GT")[i // 3], i % 3 + 1) for i in range(8)]
    assert got == [*g, ("h", 4, "C", "CAG", 1), ("h", 6, "A", "CAG", 3), ("h", 6, "G", "CAG", 3), ("h", 7, "T", "T", 1)]
    assert "Join" not in plan(sites)


def test_calls_meet_sites_and_splice_sites_in_one_join(spark):
    sites = genes.codon_sites(spark.createDataFrame([("g", "c1", "-", 100 - i, b, i + 1) for i, b in enumerate("ATGCCC")], SITES))
    splice = spark.createDataFrame([("g", "c1", "-", 94, "G", "T", "A"), ("g", "c1", "-", 93, "T", None, "A")], "gene_id string, chrom string, strand string, pos long, base string, up string, down string")
    calls = spark.createDataFrame([(1, "c1", 98, "C", "G"), (1, "c1", 94, "C", "T"), (2, "c1", 94, "C", "T"), (1, "c1", 93, "A", "T"), (1, "c1", 5, "A", "T")], "sample_id int, chrom string, pos long, ref string, alt string").withColumn("_m", F.md5(F.col("ref")))
    known = selection.annotate_contexts(calls, sites, splice)
    assert sorted((r["sample_id"], r["pos"], r["change"], r["impact"]) for r in known.collect()) == [(1, 94, "TGA>TAA", "Essential_Splice"), (1, 98, "TGC>TCC", "Missense"), (2, 94, "TGA>TAA", "Essential_Splice")]
    assert plan(known).count("md5") == 1


def test_context_opportunities_are_those_of_each_site(spark):
    draw = random.Random(2)
    sites = genes.codon_sites(spark.createDataFrame([(f"g{k}", "c1", "+", 1000 * k + i, draw.choice("ACGT"), i + 1) for k in range(4) for i in range(31)], SITES))
    splice = spark.createDataFrame([("A", "C", "G"), ("A", "C", "G"), (None, "C", "G")], "up string, base string, down string")
    got = {(r["change"], r["impact"]): r["sites"] for r in selection.context_opportunities(sites, splice).collect()}
    each = genes.possible_changes(sites).filter("up is not null and down is not null").select(F.concat("up", "base", "down", F.lit(">"), "up", "alt_cod", "down").alias("c"), "impact").collect()
    want = {k: sum((r["c"], r["impact"]) == k for r in each) for k in {(r["c"], r["impact"]) for r in each}}
    assert got == want | {(f"ACG>A{b}G", "Essential_Splice"): 2 for b in "AGT"}


def test_cohort_map_moves_calls_once(spark):
    draw = random.Random(3)
    pick = lambda *x: draw.choice([*x, None] if draw.random() < 0.1 else x)
    rows = [(pick(*range(12)), pick("a", "b"), pick("c1", "c2"), pick(*range(25)), pick(*"AC"), pick(*"GT"), i) for i in range(600)]
    calls = spark.createDataFrame(rows, "sample_id int, tissue string, chrom string, pos long, ref string, alt string, k int").repartition(3)
    for panel, shared in ((0.4, 0.1), (0.3, 0.2), (0.25, 0.5), (2.0, 0.15)):
        want = cohort.drop_recurrent(cohort.drop_panel(calls, cohort.panel_of_normals(calls, panel)), shared)
        got = pipelines.cohort_map(calls, panel, shared)
        assert got.columns == calls.columns and same(want, got)
        assert 0 < want.count() < 600
    assert plan(got.select("k")).count("LogicalRDD") <= 5 < plan(want.select("k")).count("LogicalRDD")


def test_genome_is_dealt_before_its_bases(spark):
    ends = spark.createDataFrame([("chr1", 5000), ("chr2", 900)], "chrom string, last long")
    chunks = reads_queries.genome(SimpleNamespace(spark=spark), ends)
    assert "RepartitionByExpression" in plan(chunks) and chunks.count() == 7 and all(len(r["seq"]) >= 1000 for r in chunks.collect())
