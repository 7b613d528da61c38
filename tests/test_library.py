"""Edge rules on hand-made tables, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import scalars, tails
from varloom.operators import calling, cohort, filters, genes, intervals, profiles, regression, stats, windows
from varloom.sources import tables
from varloom.streaming.live_calls import live_type_counts

PILE = "sample_id int, chrom string, pos bigint, ref string, context string, a_n int, t_n int, g_n int, c_n int"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_calling_edges(spark):
    p = spark.createDataFrame([
        (1, "chr1", 1, "A", "CCACC", 30, 70, 0, 0),  # vaf 0.7 exactly: kept
        (1, "chr1", 2, "A", "CCACC", 29, 71, 0, 0),  # above 0.7
        (1, "chr1", 3, "A", "CCACC", 90, 5, 5, 0),  # three bases
        (1, "chr1", 4, "A", "CCACC", 0, 50, 50, 0),  # reference unseen
        (1, "chr1", 5, "A", "CCACC", 95, 5, 0, 0),  # support 5
        (1, "chr1", 6, "A", "CCACC", 33, 6, 0, 0),  # coverage 39
        (1, "chr1", 7, "A", "CCACC", 50, 50, 0, 0),
        (1, "chr1", 8, "A", "CCACC", 80, 10, 10, 0),
    ], PILE)
    assert rows(calling.call_variants(p), "pos", "alt") == [(1, "T"), (7, "T")]
    assert rows(calling.call_variants(p, require_unique_top=True), "pos") == [(1,)]
    assert rows(calling.call_variants(p, biallelic_only=False), "pos", "alt") == [(1, "T"), (7, "T"), (8, "G"), (8, "T")]
    two = {r["pos"]: r for r in calling.call_top_two(p).collect()}
    assert (two[7]["ref"], two[7]["alt"], two[1]["ref"], two[1]["alt"]) == ("A", "T", "T", "A")


def test_pileup_of_reads(spark):
    genome = spark.createDataFrame([("chr1", "ACGTACGTAC" * 300)], "chrom string, seq string")
    chunks = calling.reference_chunks(genome, 1000, 5)
    sites = spark.createDataFrame([("chr1", p) for p in (1, 2, 3, 999, 1000, 1001, 1002, 2000, 2998, 3000)], "chrom string, pos bigint")
    seq = "ACGTACGTAC" * 300
    assert rows(calling.reference_context(sites, chunks), "pos", "context", "ref") == sorted([(p, seq[p - 3 : p + 2], seq[p - 1]) for p in (3, 999, 1000, 1001, 1002, 2000, 2998)], key=lambda r: (False, str(r[0])))
    reads = spark.createDataFrame([(1, i, "chr1", 10, i % 2 == 0, "CACG" if i < 3 else "CTCG", [40, 40, 10, 40]) for i in range(5)], "sample_id int, read_id int, chrom string, start bigint, is_reverse boolean, seq string, quals array<int>")
    assert rows(calling.pileup(reads, chunks, 30), "pos", "a_n", "t_n", "ref", "ref_n") == [(11, 3, 2, "A", 3)]
    assert rows(calling.depth(reads, 29, 5), "pos", "depth") == [(10, 5), (11, 5), (13, 5)]
    assert calling.drop_duplicate_reads(reads).count() == 2


def test_germline_and_context(spark):
    p = spark.createDataFrame([(1, "chr1", q, "A", "CCACC", 50, 50, 0, 0) for q in (10, 11, 12, 20)], PILE)
    g = spark.createDataFrame([("chr1", 11, "AC", "A", "0/1"), ("chr1", 21, "C", "G", "1/1"), ("chr1", 19, "T", "C", "0/0")], "chrom string, pos bigint, ref string, alt string, gt string")
    assert rows(calling.drop_germline(p, g), "pos") == [(10,), (20,)]
    assert ("CTAGC", "A") in rows(calling.repair_context(p, g).filter("pos = 20"), "context", "ref")


def test_nearest_and_overlap_against_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [("c1", int(p)) for p in rng.integers(1, 3000, 200)] + [("c2", 5), ("c3", 50)]
    ivs = [(i, "c1", int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(1, 2500, 25), rng.integers(1, 150, 25)))] + [(99, "c3", 10, 12), (98, "c3", 51, 60), (97, "c1", 5, 5)]
    p = spark.createDataFrame(pts, "chrom string, pos bigint").distinct()
    i = spark.createDataFrame(ivs, "iid int, chrom string, start_pos bigint, end_pos bigint")

    def distance(c, x):
        d = [0 if s <= x < e else (s - x if x < s else x - e + 1) for _, k, s, e in ivs if k == c and e > s]
        return min(d) if d else -1

    for stretch in (1 << 20, 256):
        got = intervals.nearest(p, i, stretch).collect()
        assert all(r["distance"] == distance(r["chrom"], r["pos"]) for r in got) and len(got) == len(set(pts))
    pairs = sorted((c, x, k) for c, x in set(pts) for k, c2, s, e in ivs if c == c2 and s <= x < e)
    assert rows(intervals.overlap_join(p, i, bin_width=16), "chrom", "pos", "iid") == sorted(pairs, key=lambda r: tuple((x is None, str(x)) for x in r))
    anti, semi = (intervals.overlap_join(p, i, h).count() for h in ("left_anti", "left_semi"))
    assert anti + semi == len(set(pts)) and semi == len({x[:2] for x in pairs})
    cover = intervals.interval_coverage(i.filter("end_pos > start_pos"), p, ["iid"])
    assert cover.agg(F.sum("hits")).first()[0] == len(pairs)


def test_labels(spark):
    base = [(1, "c1", 100), (1, "c1", 200), (1, "c1", 300), (1, "c1", 601), (1, "c1", 701), (1, "c1", 802), (2, "c1", 150)]
    calls = spark.createDataFrame(base, "sample_id int, chrom string, pos bigint")
    got = dict(rows(filters.label_clustered(calls).withColumn("s", F.concat_ws("|", "sample_id", "pos")).withColumn("n", F.size("filters")), "s", "n"))
    assert {k for k, n in got.items() if n} == {"1|200"}  # 100 to 200 is within, 701 to 802 is not
    near = spark.createDataFrame([("c1", 210, 220)], "chrom string, start_pos bigint, end_pos bigint")
    out = filters.label_near(calls, near, 10, "near")
    assert {r[0] for r in rows(out.filter("size(filters) > 0"), "pos")} == set()
    assert {r[0] for r in rows(filters.label_near(calls, near, 11, "near").filter("size(filters) > 0"), "pos")} == {200}
    bias = spark.createDataFrame([(1, "c1", 1, None, 0.05, 0.04, 1.0, 1.0)], "sample_id int, chrom string, pos bigint, vdb double, rpb double, mqb double, bqb double, mqsb double")
    assert filters.label_bias(bias).first()["filters"] == ["mqb_bias"]
    two = filters.label(filters.label(calls, "clustered_mutation", F.lit(True)), "x", F.col("pos") > 500)
    assert {r[0] for r in rows(filters.keep_clean(two), "pos")} == {100, 150, 200, 300}
    assert {r[0] for r in rows(two.withColumn("f", filters.filter_string()), "f")} == {"clustered_mutation", "clustered_mutation;x"}
    tail = spark.createDataFrame([(100, 0), (100, 1), (50, 6)], "n int, k int").select("n", "k", filters.binomial_tail(F.col("n"), F.col("k"), F.lit(0.01)).alias("p"))
    for n, k, p in tail.collect():
        assert p == pytest.approx(1 - sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)), abs=1e-12)


def test_fix_reference_and_folding(spark):
    c = spark.createDataFrame([("A", "T", "CCACC"), ("A", "T", "CCTCC"), ("A", "T", "CCGCC"), ("AC", "T", "CCACC")], "ref string, alt string, context string")
    assert rows(filters.fix_reference(c), "ref", "alt") == [("A", "T"), ("T", "A")]
    f = c.limit(1).select(scalars.mutation_type().alias("t"), scalars.mutation_code().alias("c"), scalars.folded_context().alias("m"), scalars.folded_context(strand_mode="revcomp").alias("r"), scalars.type_of_code(scalars.mutation_code()).alias("back"))
    assert tuple(f.first()) == ("T>A", "00", "CCTCC", "GGTGG", "T>A")
    names = spark.createDataFrame([("Whole_Blood", "GTEX-1117F-0003-SM", "Brain - Cortex (x)")], "a string, b string, c string")
    assert tuple(names.select(scalars.display_tissue("a"), scalars.subject_of("b"), scalars.code_tissue("c")).first()) == ("Blood", "GTEX-1117F", "Brain_Cortex_x")
    counts = profiles.context_counts(c.limit(1).withColumn("tissue", F.lit("t")), ["tissue"])
    assert counts.count() == 3750 and counts.agg(F.sum("n")).first()[0] == 1


def test_panel_keeps_alleles_apart_if_asked(spark):
    c = spark.createDataFrame([("t", s, "c1", 5, "A", "T") for s in (1, 2)] + [("t", 3, "c1", 5, "A", "G")] + [("t", s, "c1", 9 + s, "A", "T") for s in range(5)], "tissue string, sample_id int, chrom string, pos bigint, ref string, alt string")
    by_position, by_allele = cohort.panel_of_normals(c), cohort.panel_of_normals(c, match="allele")
    assert rows(by_position, "pos") == [(5,)] and rows(by_allele, "alt") == [("T",)]
    assert cohort.drop_panel(c, by_position).count() == 5 and cohort.drop_panel(c, by_allele).count() == 6
    assert rows(cohort.shuffle_alts(c.select("sample_id", "chrom", "pos", "ref", "alt")), "sample_id", "alt") == rows(c, "sample_id", "alt")


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.02, 0.02, 0.9, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in stats.adjust(df, "p", []).collect()}
    known = sorted(x for x in p if x is not None)
    for i, x in enumerate(p):
        if x is None:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(min(1, min(v * len(known) / (k + 1) for k, v in enumerate(known) if v >= x)))
    assert [r[1] for r in sorted((r["p"], r["p_adjusted"]) for r in stats.adjust(df.dropna(), "p", []).collect())] == sorted(v for v in got.values() if v is not None)


def test_tails():
    assert tails.regular_beta(5.0, 0.5, 10 / (10 + 2.228138852**2)) == pytest.approx(0.05, abs=1e-9)
    assert tails.regular_beta(0.5, 0.5, 0.3) == pytest.approx(2 / math.pi * math.asin(math.sqrt(0.3)), abs=1e-10)
    for df, x, p in ((1, 3.841458821, 0.05), (2, 5.991464547, 0.05), (3, 7.814727903, 0.05), (10, 18.30703805, 0.05), (1, 0.5, 0.4795001222)):
        assert tails.upper_gamma(df / 2, x / 2) == pytest.approx(p, abs=1e-8)


def test_ranks_and_tests(spark):
    v = [3.0, 1.0, 3.0, 7.0, 9.0, 1.0, None]
    df = spark.createDataFrame([("g", i, x, "a" if i % 2 else "b") for i, x in enumerate(v)], "g string, i int, v double, l string")
    z = {r["i"]: r["rankit"] for r in windows.rankit(df, "v", ["g"]).collect()}
    assert z[6] is None and z[0] == z[2] and z[1] == z[5] and z[4] == pytest.approx(1.3829941, abs=1e-6)
    r = stats.rank_sum(df, "v", "l", ["g"]).first()
    a, b = [1.0, 7.0, 1.0], [3.0, 3.0, 9.0]
    assert r["w"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert stats.ks_two_sample(df.dropna(), "v", "l", ["g"]).first()["d"] == pytest.approx(2 / 3)
    c = stats.correlate(spark.createDataFrame([("g", float(i), float(i * i % 7)) for i in range(12)] + [("k", 1.0, 2.0), ("k", 1.0, 3.0)], "g string, x double, y double"), "x", "y", ["g"])
    got = {r["g"]: r for r in c.collect()}
    assert got["g"]["r"] == pytest.approx(np.corrcoef(range(12), [i * i % 7 for i in range(12)])[0, 1]) and 0 < got["g"]["p"] < 1 and got["k"]["r"] is None


def test_permutations_do_not_depend_on_partitions(spark):
    df = spark.range(40).select(F.lit("g").alias("g"), "id", (F.col("id") * 7 % 11).cast("double").alias("v"), F.col("id").cast("double").alias("x"))
    a, b = (rows(stats.permute(d, ["g"], "v", "id", 3), "perm_id", "id", "v") for d in (df.repartition(1), df.repartition(9)))
    assert a == b and len({tuple(x for p, _, x in a if p == k) for k in (1, 2, 3)}) == 3
    ci = stats.bootstrap_ci(df, "v", ["g"], rounds=200).first()
    assert ci["low"] < ci["estimate"] < ci["high"]
    e = stats.permuted_correlation(df.withColumn("y", F.col("x") * 2), "x", "y", "id", ["g"], 30).first()
    assert e["observed"] == pytest.approx(1) and e["p"] == 0


def test_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = 3 + x @ [2, -1] + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([("g", float(a), float(b), float(a * 2), float(c)) for (a, b), c in zip(x, y)] + [("g", None, 1.0, 1.0, 2.0)], "g string, a double, b double, a2 double, y double")
    full = np.column_stack([np.ones(60), x])
    beta, rest, *_ = np.linalg.lstsq(full, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * rest[0] / 57)
    got = {r["term"]: r for r in regression.linear_fit(df, "y", ["a", "b"], ["g"]).collect()}
    for t, b, s in zip(["(intercept)", "a", "b"], beta, se):
        assert got[t]["coefficient"] == pytest.approx(b) and got[t]["std_error"] == pytest.approx(s) and got[t]["n"] == 60
    twin = {r["term"]: r["coefficient"] for r in regression.linear_fit(df, "y", ["a", "a2"], ["g"]).collect()}
    assert twin["a2"] is None and twin["a"] is not None
    assert regression.linear_residuals(df, "y", ["a", "b"], ["g"]).filter("residual is null").count() == 1
    assert filters.prune_collinear(df, ["a", "a2", "b"]) == ["a", "b"]


def test_impact(spark):
    cds = "ATGAAATGTTAA"  # M K C stop
    sites = genes.codon_sites(spark.createDataFrame([("g", "+", "c1", 100 + i, i + 1, b) for i, b in enumerate(cds)], "gene_id string, strand string, chrom string, pos bigint, cds_pos bigint, base string"))
    calls = spark.createDataFrame([("c1", 105, "A", "G"), ("c1", 104, "A", "T"), ("c1", 108, "T", "A"), ("c1", 109, "T", "C"), ("c1", 103, "A", "T")], "chrom string, pos bigint, ref string, alt string")
    splice = spark.createDataFrame([("c1", 103)], "chrom string, pos bigint")
    got = {r["pos"]: (r["impact"], r["aachange"]) for r in genes.annotate_impact(calls, sites, splice).collect()}
    assert got == {105: ("Synonymous", "K2K"), 104: ("Missense", "K2I"), 108: ("Nonsense", "C3*"), 109: ("Stop_loss", "*4Q"), 103: ("Essential_Splice", "-")}
    assert genes.opportunities(sites).agg(F.sum("sites")).first()[0] <= 36


def test_quantile_groups_keep_ties_together(spark):
    df = spark.createDataFrame([(1.0,)] * 5 + [(2.0,), (3.0,), (4.0,), (5.0,)], "v double")
    got = {r["v"]: r["quantile_group"] for r in windows.quantile_groups(df, "v", 5).collect()}
    q = np.quantile([1.0] * 5 + [2, 3, 4, 5], np.linspace(0, 1, 5))
    assert got == {v: int(max(1, min(4, (q <= v).sum()))) for v in (1.0, 2.0, 3.0, 4.0, 5.0)}


def test_files_round_trip(spark, tmp_path):
    calls = spark.createDataFrame([("T1", "s1", "chr1", 5, "A", "T", "CCACC", 50, 9), ("T2", "s2", "chr2", 6, "C", "T", "CCCCC", 60, 8)], "tissue string, sample_id string, chrom string, pos bigint, ref string, alt string, context string, coverage int, n_support int")
    labelled = filters.label(calls, "near", F.col("pos") == 5)
    tables.write_map(labelled, str(tmp_path / "map"))
    back = tables.read_tsv(spark, str(tmp_path / "map"), tables.LABELLED, layout=None)
    assert rows(back, "chrom", "pos", "filter") == [("chr1", 5, "near"), ("chr2", 6, "PASS")]
    (tmp_path / "in/T1/n6_0_0.7").mkdir(parents=True)
    (tmp_path / "in/T1/n6_0_0.7/s9.txt").write_text("chr1\t7\tA\tT\tCCACC\t40\t6\ta;b\n")
    got = tables.read_map(spark, str(tmp_path / "in"), labelled=True).first()
    assert (got["tissue"], got["param_set"], got["sample_id"], got["filters"]) == ("T1", "n6_0_0.7", "s9", ["a", "b"])
    tables.write_table(calls, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and (tmp_path / "t/tissue=T1").exists()
    (tmp_path / "x.gct").write_text("#1.2\n2\t2\nName\tDescription\ts1\ts2\ng1\td\t1.5\t2\ng2\td\t0\t4\n")
    assert rows(tables.read_expression(spark, str(tmp_path / "x.gct"), ["s2"]), "gene_id", "sample_id", "tpm") == [("g1", "s2", 2.0), ("g2", "s2", 4.0)]
    (tmp_path / "m.tsv").write_text("id\tage\na\t5\n")
    with pytest.raises(ValueError, match="bmi"):
        tables.read_metadata(spark, str(tmp_path / "m.tsv"), ["age", "bmi"])
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/s1.Log.final.out").write_text("  Number of input reads |\t100\n Uniquely mapped reads number |\t90\n")
    assert rows(tables.read_mapping_logs(spark, str(tmp_path / "logs"), {"n": "Number of input reads", "u": "Uniquely mapped reads number"}), "n", "u") == [(100.0, 90.0)]


def test_streamed_calls(spark, tmp_path):
    p = spark.createDataFrame([("T1", 1, "chr1", 1, "C", "CCCCC", 0, 30, 0, 70), ("T1", 2, "chr1", 1, "C", "CCCCC", 0, 9, 0, 70)], "tissue string, " + PILE).withColumn("seen_at", F.to_timestamp(F.lit("2024-01-01 00:01:00")))
    p.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    query = live_type_counts(stream).writeStream.format("memory").queryName("live_types").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("live_types"), "tissue", "mut_type", "n") == [("T1", "C>T", 2)]


def test_entry_point(spark):
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 130
    assert entry.entry(spark).count() > 0
