"""Row numbers by stretches, parsers of lines, genotypes of regions, components and marks of any number."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from varloom.operators import cohort, filters, genes, regression, stats, windows
from varloom.sources import tables


def test_row_numbers_are_those_of_a_window(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), draw.choice(["c1", "c2", None]), draw.choice([None, *range(0, 400)]), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, chrom string, pos long, id long")
    w = Window.partitionBy("g").orderBy("chrom", "pos", "id")
    expected = {r["id"]: r["n"] for r in df.withColumn("n", F.row_number().over(w)).collect()}
    got = windows.number_rows(df, ["g"], [F.col("chrom"), F.floor(F.col("pos") / 16)], ["pos", "id"], "n")
    assert {r["id"]: r["n"] for r in got.collect()} == expected and got.columns == [*df.columns, "n"]
    assert windows.number_rows(df.limit(0), ["g"], [F.col("chrom")], ["pos"]).count() == 0
    assert {r["id"]: r["k"] for r in windows.number_rows(df, [], [F.col("chrom")], ["pos", "id"]).collect()} == {r["id"]: r["n"] for r in df.withColumn("n", F.row_number().over(Window.orderBy("chrom", "pos", "id"))).collect()}


def test_controls_do_not_depend_on_stretches(spark, monkeypatch):
    draw = random.Random(6)
    calls = spark.createDataFrame([(i % 2, "c1", draw.randrange(5000), draw.choice("AC"), draw.choice("GT")) for i in range(300)], "sample_id int, chrom string, pos long, ref string, alt string").distinct()
    covered = spark.createDataFrame([(s, "c1", p, "AC"[p % 2]) for s in (0, 1) for p in range(0, 5000, 9)], "sample_id int, chrom string, pos long, ref string")
    found = []
    for stretch, digits in ((1 << 20, 3), (16, 1)):
        monkeypatch.setattr(cohort, "STRETCH", stretch)
        monkeypatch.setattr(cohort, "DIGITS", digits)
        found.append((sorted(map(tuple, cohort.random_positions(calls, covered).collect())), sorted(map(tuple, cohort.shuffle_alts(calls).collect()))))
    assert found[0] == found[1] and len(found[0][0]) == calls.count() == len(found[0][1])


def test_lines_are_read_as_files_are(spark, tmp_path):
    lines = ["chr1\t5\tA\tT\tCCACC\t50\t3", "chr2\t6\tG\tA\t.\tNA\t4", "chr3\tx\tC\tT\tAACTT\t60", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, None])], "i int, value string")
    got = {r["i"]: tuple(r)[1:] for r in tables.parse_tsv(df, tables.MAP).collect()}
    assert got[0] == ("chr1", 5, "A", "T", "CCACC", 50, 3) and got[1] == ("chr2", 6, "G", "A", None, None, 4)
    assert got[2] == ("chr3", None, "C", "T", "AACTT", 60, None) and set(got[3]) == set(got[4]) == {None}
    (tmp_path / "T1" / "q30").mkdir(parents=True)
    (tmp_path / "T1" / "q30" / "s1.map").write_text("\n".join(lines[:3]) + "\n")
    read = {tuple(r) for r in tables.read_map(spark, str(tmp_path)).select("chrom", "pos", "ref", "alt", "context", "coverage", "n_support").collect()}
    assert read == {got[0], got[1], got[2]}


def test_map_lines_come_back(spark):
    calls = spark.createDataFrame([("T", 1, "chr1", 5, "A", "T", "CCACC", 50, 3), ("T", 1, "chr1", 6, "A", "T", None, None, 2)], "tissue string, sample_id int, " + tables.MAP)
    labelled = filters.label(filters.label(calls, "low", F.col("n_support") < 3), "first", F.col("pos") < 7)
    lines = tables.map_lines(labelled)
    assert {r["value"] for r in lines.collect()} == {"chr1\t5\tA\tT\tCCACC\t50\t3\tfirst", "chr1\t6\tA\tT\tNA\tNA\t2\tlow;first"}
    back = tables.parse_tsv(lines, tables.LABELLED).withColumn("filters", tables.filters_of("filter")).drop("filter")
    assert sorted(map(str, back.select(labelled.columns).collect())) == sorted(map(str, labelled.collect()))


def test_genotypes_of_regions_and_their_dosage(spark):
    g = spark.createDataFrame(
        [(1, "c1", p, gt, ds, gl) for p, gt, ds, gl in [(10, "0/1", None, None), (11, None, 1.7, [0.0, 0.0, 0.0]), (12, "./.", None, [-5.0, -1.0, -1.0]), (13, None, None, None), (14, "1|1", 0.2, None), (15, None, None, [-1.0])]] + [(2, "c1", 10, "1/1", None, None), (None, None, None, None, None, None)],
        "sample_id int, chrom string, pos long, gt string, ds double, gl array<double>",
    )
    regions = spark.createDataFrame([("c1", 10, 13), ("c1", 12, 15), ("c1", 11, 12), ("c1", 15, 16), ("c2", 1, 99)], "chrom string, start_pos long, end_pos long")
    got = tables.genotypes_in(g, regions).withColumn("d", tables.any_dosage())
    found = {(r["sample_id"], r["pos"]): r["d"] for r in got.collect()}
    assert got.count() == 7 and found[1, 10] == 1 and found[1, 11] == 1.7 and found[1, 13] is None and found[1, 14] == 0.2 and found[1, 15] is None and found[2, 10] == 2
    assert found[1, 12] == pytest.approx((1e-1 + 2e-1) / (1e-5 + 2e-1))
    some = tables.genotypes_in(g, regions.filter("start_pos = 11"), spark.createDataFrame([(1,), (1,), (3,)], "sample_id int"))
    assert [(r["sample_id"], r["pos"]) for r in some.collect()] == [(1, 11)]
    assert tables.genotypes_in(g, regions.limit(0)).count() == 0


def test_components_beyond_fifty(spark):
    x = np.random.default_rng(1).normal(size=(300, 64))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, v array<double>")
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.97) + 1)
    assert k > 50 and len(stats.principal_components(df, "v", 0.97).first()["scores"]) == k
    assert len(stats.principal_components(df, "v", 0.97, 7).first()["scores"]) == 7


def test_marks_as_rows(spark):
    exons = spark.createDataFrame([(i, "c1", 10 * i, 10 * i + 8) for i in range(4)], "exon_id int, chrom string, start_pos long, end_pos long")
    calls = spark.createDataFrame([("c1", p) for p in (1, 2, 12, 31, 33, 9)], "chrom string, pos long")
    depth = spark.createDataFrame([("c1", p) for p in range(0, 38)], "chrom string, pos long")
    marks = spark.createDataFrame([("x", "c1", p, float(p % 5 + 1)) for p in range(0, 38)] + [("y", "c1", p, 2.0 if p < 30 else 0.0) for p in range(0, 38, 2)], "mark string, chrom string, pos long, signal double")
    wide = {r["exon_id"]: r for r in genes.exon_signal(exons, calls, depth, marks).collect()}
    long = genes.exon_signal_long(exons, calls, depth, marks).collect()
    assert set(wide) == {0, 1} and len(long) == 4
    for r in long:
        w = wide[r["exon_id"]]
        assert (r["n_calls"], r["n_covered"], r["log_rate"], r["log_signal"]) == (w["n_calls"], w["n_covered"], w["log_rate"], w[r["mark"]])


def test_p_by_permutation(spark):
    draw = np.random.default_rng(8)
    x = np.arange(12.0)
    rows = [(g, i, float(a), float(b)) for g, y in (("linked", 2 * x + draw.normal(0, 0.1, 12)), ("none", draw.normal(0, 1, 12)), ("constant", np.ones(12))) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "g string, unit int, x double, y double")
    got = stats.permuted_p(df, "x", "y", "unit", ["g"], 19).collect()
    by = {g: {r["perm_id"]: r for r in got if r["g"] == g} for g in ("linked", "none", "constant")}
    assert all(set(v) == set(range(20)) for v in by.values())
    assert by["linked"][0]["p"] == 1 / 20 and all(r["p"] == 1 for r in by["constant"].values()) and by["constant"][0]["r"] is None
    for k, r in by["none"].items():
        assert r["p"] == sum(round(abs(o["r"]), 9) >= round(abs(r["r"]), 9) for o in by["none"].values()) / 20
    assert by["none"][0]["r"] == pytest.approx(np.corrcoef(x, [r[3] for r in rows if r[0] == "none"])[0, 1])


def test_sigma_of_fitted_models(spark):
    draw = np.random.default_rng(9)
    a, b = draw.normal(size=30), draw.normal(size=30)
    y = 1 + 2 * a - b + draw.normal(size=30)
    df = spark.createDataFrame([("g", *map(float, r)) for r in zip(y, a, b)] + [("two", 1.0, 1.0, 2.0), ("two", 2.0, 2.0, 5.0)], "g string, y double, a double, b double")
    got = regression.fitted_models(df, "y", ["a", "b"], ["g"]).collect()
    X = np.stack([np.ones(30), a, b], 1)
    rest = y - X @ np.linalg.lstsq(X, y, rcond=None)[0]
    assert len(got) == 32 and all(r["sigma"] == pytest.approx(np.sqrt(rest @ rest / 27)) for r in got if r["g"] == "g") and all(r["sigma"] is None for r in got if r["g"] == "two")


def test_exact_quantiles_are_those_of_percentile(spark):
    draw = random.Random(7)
    kinds = {"a": lambda: draw.gauss(0, 1e-3), "b": lambda: float(draw.randrange(-3, 4)), "c": lambda: draw.choice([None, 1.5, -1e300, 1e-310, float("inf")]), None: lambda: draw.random(), "none": lambda: None, "one": lambda: 0.25}
    rows = [(g, f()) for g, f in kinds.items() for _ in range(1 if g == "one" else 150)]
    df = spark.createDataFrame(rows, "g string, v double")
    probabilities = [0.0, 0.15, 0.25, 0.5, 1 / 3, 0.99, 1.0]
    wanted = F.percentile("v", F.array(*map(F.lit, probabilities))).alias("q")
    got = {r["g"]: r["q"] for r in windows.exact_quantiles(df, "v", ["g"], probabilities, "q").collect()}
    expected = {r["g"]: r["q"] for r in df.groupBy("g").agg(wanted).collect()}
    assert set(got) == set(expected)
    for g in got:
        assert got[g] is None and expected[g] is None if g == "none" else got[g] == pytest.approx(expected[g], rel=1e-12, nan_ok=True), g
    some = df.filter("g in ('a', 'b')")
    assert windows.exact_quantiles(some, "v", [], probabilities, "q").first()["q"] == pytest.approx(some.agg(wanted).first()["q"], rel=1e-12)
    assert windows.exact_quantiles(df.limit(0), "v", [], [0.5], "q").collect() == [(None,)] and windows.exact_quantiles(df.limit(0), "v", ["g"], [0.5]).count() == 0
    assert windows.exact_quantiles(spark.range(101), F.col("id") * 2, [], [0.5], "q").first()["q"] == [100.0]
