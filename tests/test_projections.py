"""The projections and queries read whole tables."""

import duckdb
import pytest

from varloom.operators.regression import association_scan
from varloom.plans.catalog import ALL
from varloom.plans.projections import PROJECTIONS, Tables, with_projections
from varloom.plans.stats_queries import QUERIES, features, phenotypes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    line = "l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_extendedprice double"
    rows = [(k, 0, p, k % 7 + 1, 20.0 + k % 30, 0.05, 0.04, 900.0 + k * p) for k in (1, 2, 12, 22, 33, 38) for p in (5, 6, 7, 60, 505)]
    spark.createDataFrame(rows, line).write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(1, 3), (499, 4), (500, 5), (70000, 6)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(p, 24) for p in (5, 6, 7, 60, 505)], "p_partkey bigint, p_size int").write.parquet(f"{at}/part.parquet")
    return str(at)


def test_genotypes_have_every_order(spark, folder):
    t = Tables(spark, folder)
    assert {r[0] for r in features(t).select("feature").distinct().collect()} == {1, 499, 500, 70000}
    assert t.genotypes.count() == 4 * t.calls.select("sample_id").distinct().count()


def test_bases_far_along_a_chromosome_are_those_of_duckdb(spark, tmp_path):
    """Products beyond 2^53 are rounded when they become doubles, which DuckDB's division does."""
    places = list(range(1_000_000, 1_040_000, 5))
    line = "l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_extendedprice double"
    spark.createDataFrame([(k % 8, 0, p, 1, 20.0, 0.05, 0.04, 900.0) for k, p in enumerate(places)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
        want = c.execute(with_projections("select chrom, pos, ref, alt, context from calls order by 1, 2")).fetchall()
    assert [tuple(r) for r in Tables(spark, str(tmp_path)).calls.select("chrom", "pos", "ref", "alt", "context").orderBy("chrom", "pos").collect()] == want


def test_calls_meet_exons_by_bins(spark, folder, capsys):
    t = Tables(spark, folder)
    got, want = t.gene_calls, t.sql(PROJECTIONS["gene_calls"])
    assert got.columns == want.columns and want.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got.explain()
    assert "_bin" in capsys.readouterr().out


def test_the_scan_returns_weak_pairs_too(spark, folder):
    t = Tables(spark, folder)
    whole = association_scan(features(t), phenotypes(t)).filter("r is not null")
    assert whole.filter("p > 0.05").count() > 0
    got = QUERIES["r4_association_scan"][0](t)
    assert {(r.feature, r.phenotype) for r in got.collect()} == {(r.feature, r.phenotype) for r in whole.collect()}


def test_queries_that_read_calls_once_do_not_keep_them(spark, folder):
    t = Tables(spark, folder)
    assert sorted(map(tuple, t.calls_once.collect()), key=str) == sorted(map(tuple, t.sql(PROJECTIONS["calls"]).collect()), key=str)
    for name in ("x15_share_within", "i2_outside_exons", "t26_error_grid", "f8_keep_clean"):
        t = Tables(spark, folder)
        ALL[name][0](t)
        assert "calls" not in vars(t)


def test_calls_are_not_kept(spark, folder):
    """To keep all columns of all calls took longer than to work out the few that a query reads."""
    t = Tables(spark, folder)
    assert t.gene_calls.count() >= 0 and not t.calls.storageLevel.useMemory and not t.calls.storageLevel.useDisk


def test_counts_and_permutations_of_genes_are_worked_out_once(spark, folder):
    from varloom.operators import genes
    from varloom.plans.stats_queries import gene_p, stranded

    t = Tables(spark, folder)
    for made in (gene_p(t), genes.strand_asymmetry_by_gene(stranded(t))):
        assert "InMemoryRelation" in made._jdf.queryExecution().withCachedData().toString()
    spark.catalog.clearCache()
