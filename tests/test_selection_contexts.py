"""Selection ratios with a rate for each change in context, against a fit of the whole Poisson model in NumPy."""

import itertools

import numpy as np
import pytest

from varloom.operators import genes, selection

SITES = "gene_id string, chrom string, strand string, pos long, base string, cds_pos long, up string, down string"
SPLICE = "gene_id string, chrom string, strand string, pos long, base string, up string, down string"
CALLS = "sample_id int, tissue string, chrom string, pos long, ref string, alt string, strand_note string"
MODELS = {"wmis": (0, 1, 2, 3), "wnon": (0, 1, 2, 3), "wspl": (0, 1, 2, 3), "wtru": (0, 1, 2, 2), "wall": (0, 1, 1, 1)}
PLACE = {"wmis": 1, "wnon": 2, "wspl": 3, "wtru": 2, "wall": 1}


def whole_model(cells, name):
    """Ratio and Wald interval by scoring steps over all rates and ratios at once."""
    changes = sorted({c for (c, _), (l, _) in cells.items()})
    changes = [c for c in changes if sum(n for (d, _), (_, n) in cells.items() if d == c)]
    rows = [(changes.index(c), MODELS[name][genes.IMPACTS.index(i)], l, n) for (c, i), (l, n) in cells.items() if c in changes]
    k = max(MODELS[name])
    X = np.zeros((len(rows), len(changes) + k))
    for r, (c, j, _, _) in enumerate(rows):
        X[r, c] = 1
        if j:
            X[r, len(changes) + j - 1] = 1
    l, n = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    eta = np.log((n + 0.5) / l)
    for _ in range(200):
        mu = l * np.exp(eta)
        A = X.T @ (mu[:, None] * X)
        beta = np.linalg.solve(A, X.T @ (mu * (eta + (n - mu) / mu)))
        eta = X @ beta
    at = len(changes) + PLACE[name] - 1
    b, s = beta[at], np.sqrt(np.linalg.inv(A)[at, at])
    return np.exp(b), np.exp(b - 1.959963984540054 * s), np.exp(b + 1.959963984540054 * s)


def drawn(n_calls=6000, seed=4):
    rng = np.random.default_rng(seed)
    turn = dict(zip("ACGT", "TGCA"))
    genome = "".join(rng.choice(list("ACGT"), 900))
    cds, splice = [], []
    for gene, (start, strand) in enumerate([(10, "+"), (300, "-"), (600, "+")]):
        order = range(start, start + 200) if strand == "+" else range(start + 199, start - 1, -1)  # 200: the last codon has two bases
        site = lambda p: (genome[p], genome[p - 1], genome[p + 1]) if strand == "+" else (turn[genome[p]], turn[genome[p + 1]], turn[genome[p - 1]])  # noqa: B023, E731
        cds += [(f"g{gene}", "chr1", strand, p, site(p)[0], i + 1, site(p)[1], site(p)[2]) for i, p in enumerate(order)]
        splice += [(f"g{gene}", "chr1", strand, p, *site(p)) for p in (start - 2, start - 1, start + 200, start + 201, start + 204)]
    places = rng.integers(0, 900, n_calls)
    calls = [(i % 7, "ab"[i % 2], "chr1", int(p), genome[p], str(rng.choice([b for b in "ACGT" if b != genome[p]])), "x") for i, p in enumerate(places)]
    return cds, splice, calls


@pytest.fixture(scope="module")
def fitted(spark):
    cds, splice, calls = drawn()
    sites, splice = genes.codon_sites(spark.createDataFrame(cds, SITES)), spark.createDataFrame(splice, SPLICE)
    calls = spark.createDataFrame([*calls, (None, None, None, None, None, None, None), (1, "a", "chr9", 5, "A", "C", None)], CALLS)
    return selection.annotate_contexts(calls, sites, splice), selection.context_opportunities(sites, splice)


def test_ratios_are_those_of_the_whole_model(fitted):
    annotated, possible = fitted
    seen = annotated.collect()
    for key in ([], ["tissue"]):
        got = selection.context_ratios(annotated, possible, key).collect()
        assert len(got) == (10 if key else 5)
        for row in got:
            cells = {(r["change"], r["impact"]): [r["sites"], 0] for r in possible.collect()}
            for r in seen:
                if not key or r["tissue"] == row["tissue"]:
                    cells[r["change"], r["impact"]][1] += 1
            assert (row["mle"], row["cilow"], row["cihigh"]) == pytest.approx(whole_model(cells, row["name"]), rel=1e-6), row


def test_sites_and_calls_are_counted_in_context(fitted):
    cds, splice, calls = drawn()
    annotated, possible = fitted
    counted = {(r["change"], r["impact"]): r["sites"] for r in possible.collect()}
    ends = [(u, b, a, d) for *_, b, u, d in splice for a in "ACGT" if a != b]
    for change in {f"{u}{b}{d}>{u}{a}{d}" for u, b, a, d in ends}:
        assert counted[change, "Essential_Splice"] == sum(change == f"{u}{b}{d}>{u}{a}{d}" for u, b, a, d in ends)
    assert sum(n for (_, i), n in counted.items() if i == "Essential_Splice") == 45 and len(counted) <= 768
    inside = {r[3] for r in cds if r[5] <= 198} | {r[3] for r in splice}
    assert annotated.filter("impact <> 'Stop_loss'").count() <= sum(c[3] in inside for c in calls)
    assert annotated.filter("impact = 'Essential_Splice'").count() == sum(c[3] in {r[3] for r in splice} for c in calls)


def test_flanks_that_are_given_stay(spark):
    cds, _, _ = drawn()
    got = {(r["gene_id"], r["cds_pos"]): (r["up"], r["down"]) for r in genes.codon_sites(spark.createDataFrame(cds, SITES)).collect()}
    assert got == {(r[0], r[5]): (r[6], r[7]) for r in cds}
    bare = {(r["gene_id"], r["cds_pos"]): (r["up"], r["down"]) for r in genes.codon_sites(spark.createDataFrame(cds, SITES).drop("up", "down")).collect()}
    assert bare["g0", 1][0] is None and bare["g0", 2] == (cds[0][4], cds[2][4])


def test_ratios_that_cannot_be_told(fitted):
    annotated, possible = fitted
    empty = selection.context_ratios(annotated.limit(0), possible).collect()
    assert len(empty) == 5 and all(r["n"] == 0 and r["mle"] is None and r["cilow"] is None for r in empty)
    assert selection.context_ratios(annotated.limit(0), possible, ["tissue"]).count() == 0
    none = {r["name"]: r for r in selection.context_ratios(annotated.filter("impact <> 'Essential_Splice'"), possible).collect()}
    assert none["wspl"]["mle"] == 0 and none["wspl"]["cihigh"] is None and none["wmis"]["mle"] > 0
    silent = selection.context_ratios(annotated.filter("impact <> 'Synonymous'"), possible).collect()
    assert all(r["mle"] is None for r in silent)


def test_changes_that_classes_do_not_share():
    n, sites = np.array([[5.0, 0.0], [0.0, 7.0]]), np.array([[10.0, 0.0], [0.0, 10.0]])
    beta, error = selection.fit_ratios(n, sites)
    assert np.isnan(beta).all() and np.isnan(error).all()
    for a, b, c in itertools.product((1, 40), (3, 500), (2, 9)):  # one change: the ratio of two Poisson rates
        beta, error = selection.fit_ratios(np.array([[a, b]], float), np.array([[10.0, 10.0 * c]]))
        assert beta[0] == pytest.approx(np.log(b / a / c)) and error[0] == pytest.approx(np.sqrt(1 / a + 1 / b))


def test_base_totals_are_sums_of_histograms(spark):
    from varloom.operators import calling

    rows = [(i, i % 2, "chr1", 10 + i % 3, i % 2 == 0, seq, [30 - i, 22, 22, 9]) for i, seq in enumerate(("ACGT", "AAAA", "CGN", "T", "ACGT"))] + [(9, None, "chr1", 10, True, "AC", [1, 2])]
    reads = spark.createDataFrame(rows, "read_id int, sample_id int, chrom string, start int, is_reverse boolean, seq string, quals array<int>")
    for key, of in ((["sample_id"], "read_pos"), ([], "qual")):
        whole, got = calling.sum_histograms(calling.base_histogram(reads, of), "histogram", [*key, "base"]), calling.base_totals(reads, key, of)
        assert got.columns == whole.columns and got.exceptAll(whole).count() == 0 == whole.exceptAll(got).count()
        assert got.count() > 4 and got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
