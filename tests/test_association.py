import math
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarevar_spark.functions import pvalues as P
from rarevar_spark.operators import association as A
from rarevar_spark.operators import variants
from rarevar_spark.plans import jobs


def dense(g, x, y):
    """Independent route: explicit flip, SVD basis, residuals."""
    n = len(g)
    f = g.mean(axis=0) / 2
    g = np.where(f > 0.5, 2 - g, g)
    w = 25 * (1 - np.minimum(f, 1 - f)) ** 24
    z = np.column_stack([np.ones(n), x])
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    u = u[:, s > s[0] * 1e-10]
    r = y - u @ (u.T @ y)
    sigma2 = (r**2).sum(axis=0) / (n - u.shape[1])
    gw = g * w
    score = r.T @ gw
    k = gw.T @ (gw - u @ (u.T @ gw)) / 2
    return (score**2).sum(axis=1) / (2 * sigma2), score.sum(axis=1) ** 2 / (2 * sigma2), 2 * k.sum(), k


def tables(spark, g, x, y, genes):
    n = len(g)
    people = spark.createDataFrame([("ALL", f"s{i}", [float(v) for v in np.atleast_1d(x[i])], [float(v) for v in y[i]]) for i in range(n)], "ancestry string, sample_id string, x array<double>, y array<double>")
    rows = [("ALL", "1", gene, f"s{i}", f"v{j}", int(g[i, j]), True) for gene, cols in genes.items() for j in cols for i in range(n) if g[i, j]]
    calls = spark.createDataFrame(rows, "ancestry string, chrom string, gene_id string, sample_id string, variant_key string, dosage int, called boolean")
    return people, calls


@pytest.fixture(scope="module")
def random_case(spark):
    rng = np.random.default_rng(5)
    n = 400
    g = np.column_stack([rng.binomial(2, f, n) for f in (0.01, 0.02, 0.05, 0.9, 0.99, 0.03, 0.5)])
    x = np.column_stack([rng.normal(50, 10, n), rng.normal(0, 1, n)])
    x = np.column_stack([x, x[:, 0] ** 2])
    y = rng.normal(0, 1, (n, 2)) + g[:, [0]] * 0.5
    return g, x, y, tables(spark, g, x, y, {"g": range(7), "h": [0, 3]})


def fitted(spark, case, covariates=3):
    g, x, y, (people, calls) = case
    null = A.fit_null_model(A.null_model_moments(people, covariates, y.shape[1]))
    weighted = A.variant_weights(A.gene_moments(calls, people, covariates, y.shape[1]), null)
    kept = spark.createDataFrame([(f"v{j}", 0.5) for j in range(g.shape[1])], "variant_key string, maf_threshold double")
    return null, weighted, A.minor_pairs(calls, weighted, null), kept


def test_moments_equal_dense(spark, random_case):
    g, x, y, _ = random_case
    null, weighted, pairs, kept = fitted(spark, random_case)
    q, qb, v, k = dense(g, x, y)
    s = {r.phenotype_index: r for r in A.score_statistics(weighted, null, kept).where("gene_id = 'g'").collect()}
    for i in (0, 1):
        assert s[i].q_skat == pytest.approx(q[i], rel=1e-8) and s[i].q_burden == pytest.approx(qb[i], rel=1e-8)
    r = A.gene_kernels(weighted, pairs, null, kept).where("gene_id = 'g'").first()
    assert r.v_burden == pytest.approx(v, rel=1e-8)
    assert (r.s1, r.s2, r.s3, r.s4) == pytest.approx((np.trace(k), (k @ k).trace(), (k @ k @ k).trace(), (k @ k @ k @ k).trace()), rel=1e-8)
    assert np.allclose(sorted(r.eigenvalues), sorted(A.kernel_eigenvalues(k)), rtol=1e-8)
    assert A.burden_variance(weighted, pairs, null, kept).where("gene_id = 'g'").first().v == pytest.approx(v, rel=1e-8)
    # probes in place of the dense matrix: exact while the padded width is no more than the probes
    w = A.gene_kernels(weighted, pairs, null, kept, widest=2, probes=8).where("gene_id = 'g'").first()
    assert (w.s1, w.s2, w.s3, w.s4, w.v_burden) == pytest.approx((r.s1, r.s2, r.s3, r.s4, v), rel=1e-8) and w.eigenvalues is None


def test_traces_without_the_matrix(spark, random_case):
    """Sparse products and small matrices give the traces of the dense kernels, with covariates and ALT-major variants, by threshold."""
    null, weighted, pairs, kept = fitted(spark, random_case)
    kept = kept.unionByName(kept.where("variant_key != 'v6'").withColumn("maf_threshold", F.lit(0.2)))
    dense_ = {(r.gene_id, r.maf_threshold): r for r in A.gene_kernels(weighted, pairs, null, kept).collect()}
    sparse = {(r.gene_id, r.maf_threshold): r for r in A.sparse_traces(weighted, pairs, null, kept).collect()}
    assert sparse.keys() == dense_.keys() and sparse["g", 0.5].variants == 7
    for k, r in sparse.items():
        d = dense_[k]
        assert (r.v_burden, r.s1, r.s2, r.s3, r.s4) == pytest.approx((d.v_burden, d.s1, d.s2, d.s3, d.s4), rel=1e-8)
    mixed = {(r.gene_id, r.maf_threshold): r for r in A.gene_kernels(weighted, pairs, null, kept, widest=2).collect()}
    assert mixed.keys() == dense_.keys() and mixed["g", 0.5].eigenvalues is None and len(mixed["h", 0.5].eigenvalues) == 2
    assert mixed["g", 0.2].s4 == pytest.approx(dense_["g", 0.2].s4, rel=1e-8)


def test_genes_of_few_pairs_get_traces_in_their_task(spark, random_case, monkeypatch):
    """Joined tables of entries are made for genes of more pairs alone; both ways give the same, and thresholds that keep the same variants too."""
    null, weighted, pairs, kept = fitted(spark, random_case)
    kept = kept.unionByName(kept.withColumn("maf_threshold", F.lit(0.2)))
    seen = []
    monkeypatch.setattr(A, "keep", lambda df, n, f=A.keep: seen.append(n) or f(df, n))
    got, tables_ = {}, {}
    for most in (0, 3, 500_000):  # h has three pairs at most, g more
        got[most] = {(r.gene_id, r.maf_threshold): r for r in A.sparse_traces(weighted, pairs, null, kept, in_task=most).collect()}
        tables_[most], seen[:] = "kernel-entries" in seen, []
    assert tables_ == {0: True, 3: True, 500_000: False}
    assert got[0].keys() == got[3].keys() == got[500_000].keys() and {k[0] for k in got[0]} == {"g", "h"}
    for k, r in got[0].items():
        for most in (3, 500_000):
            x = got[most][k]
            assert x.variants == r.variants and (x.v_burden, x.s1, x.s2, x.s3, x.s4) == pytest.approx((r.v_burden, r.s1, r.s2, r.s3, r.s4), rel=1e-8)


def test_pairs_of_minor_alleles(spark, random_case):
    """Variants 3 and 4 are ALT-major: their pairs are those of 2 - g, and no carrier of the major allele enters one."""
    g, x, y, (people, calls) = random_case
    null, weighted, pairs, _ = fitted(spark, random_case)
    h = np.where(g.mean(axis=0) > 1, 2 - g, g)
    assert (g.mean(axis=0) > 1).tolist() == [False, False, False, True, True, False, False] or (g.mean(axis=0) > 1).sum() == 3
    got = {(r.a, r.b): r.hth for r in pairs.where("gene_id = 'g'").collect()}
    want = {(f"v{i}", f"v{j}"): int(v) for i in range(7) for j in range(i, 7) if (v := (h.T @ h)[i, j])}
    assert got == want
    dosages = {(r.a, r.b): r.gtg for r in A.carrier_pairs(calls, weighted, null).where("gene_id = 'g'").collect()}
    assert dosages == {(f"v{i}", f"v{j}"): int(v) for i in range(7) for j in range(i, 7) if (v := (g.T @ g)[i, j])}


@pytest.mark.parametrize("share", [1, 3, 256])
def test_pairs_with_a_major_variant_are_not_dealt(spark, random_case, share):
    """However a gene's variants are shared out: the same pairs, and no exchange, sort or group over the rows of major variants with all others."""
    g, x, y, (people, calls) = random_case
    null, weighted, _, _ = fitted(spark, random_case)
    df = A.carrier_pairs(calls, weighted, null, share=share)
    assert {(r.a, r.b): r.gtg for r in df.where("gene_id = 'g'").collect()} == {(f"v{i}", f"v{j}"): int(v) for i in range(7) for j in range(i, 7) if (v := (g.T @ g)[i, j])}
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter", "Union"):  # the last branch of the union has them
        plan = plan.children().last()
    assert plan.nodeName() == "Join"


def test_all_is_summed_from_the_ancestries(spark, random_case):
    g, x, y, _ = random_case
    people, calls = tables(spark, g, x, y, {"g": range(7), "h": [0, 1, 2, 5]})  # h has no variant whose ALT is major
    own = F.concat(F.lit("P"), F.substring("sample_id", -1, 1).cast("int") % 2)
    label = lambda t: t.withColumn("ancestry", own)
    both = lambda t: label(t).unionByName(t)
    null = A.fit_null_model(A.null_model_moments(both(people), 3, 2))
    weighted = A.variant_weights(A.gene_moments(both(calls), both(people), 3, 2), null)
    rows = lambda t: sorted(map(tuple, t.collect()))
    assert rows(A.minor_pairs(label(calls), weighted, null, pooled=True)) == rows(A.minor_pairs(both(calls), weighted, null))
    assert rows(A.minor_pairs(label(calls), weighted.drop("ss"), null, pooled=True)) == rows(A.minor_pairs(both(calls), weighted, null))
    assert rows(A.carrier_pairs(label(calls), weighted, null, pooled=True)) == rows(A.carrier_pairs(both(calls), weighted, null))
    once = calls.where("gene_id = 'g'").drop("ancestry")
    got = A.pooled_moments(once, label(people), 3, 2).join(spark.createDataFrame([(f"v{j}",) for j in range(7)], "variant_key string"), "variant_key")
    want = {(r.ancestry, r.variant_key): r for r in weighted.where("gene_id = 'g'").collect()}
    got = {(r.ancestry, r.variant_key): r for r in got.collect()}
    assert got.keys() == want.keys() and len(got) == 21
    for k, r in got.items():
        assert (r.ac, r.ss) == (want[k].ac, want[k].ss) and np.allclose(r.gtx + r.gty, want[k].gtx + want[k].gty, rtol=1e-10)


def test_collinear_covariates(spark, random_case):
    g, x, y, _ = random_case
    x = np.column_stack([x[:, 0], 2 * x[:, 0] + 1])
    case = (g, x, y, tables(spark, g, x, y, {"g": range(7)}))
    null, weighted, pairs, kept = fitted(spark, case, 2)
    assert null.first().rank == 2
    q, _, v, _ = dense(g, x, y)
    assert A.score_statistics(weighted, null, kept).where("phenotype_index = 0").first().q_skat == pytest.approx(q[0], rel=1e-7)


def test_tail_probabilities():
    assert P.gamma_q(0.5, 2.0) == pytest.approx(math.erfc(math.sqrt(2.0)), rel=1e-12)
    assert P.gamma_q(3.0, 0.5) == pytest.approx(math.exp(-0.5) * (1 + 0.5 + 0.125), rel=1e-12)
    assert P.gamma_q(1.0, 200.0) == pytest.approx(math.exp(-200), rel=1e-10)
    rng = np.random.default_rng(1)
    for df, ncp, x in ((3.0, 2.0, 8.0), (2.0, 30.0, 50.0)):
        draws = ((rng.normal(0, 1, (400_000, int(df))) + np.array([math.sqrt(ncp)] + [0] * (int(df) - 1))) ** 2).sum(axis=1)
        assert P.noncentral_chi2_sf(x, df, ncp) == pytest.approx((draws > x).mean(), abs=3e-3)
    assert P.noncentral_chi2_sf(-1, 2, 1) == 1
    # one eigenvalue: a scaled chi-square of one degree
    one = np.array([2.0])
    assert P.liu_p(6.0, one, True) == pytest.approx(math.erfc(math.sqrt(1.5)), rel=1e-9)
    assert P.davies_p(6.0, one) == (P.liu_p(6.0, one, True), 1)
    lam = np.array([3.0, 1.0, 0.5, 0.25, 0.01])
    draws = (rng.normal(0, 1, (1_000_000, 5)) ** 2 * lam).sum(axis=1)
    for q in (1.0, 5.0, 15.0):
        p, ok = P.davies_p(q, lam)
        assert ok == 1 and p == pytest.approx((draws > q).mean(), abs=2e-3)
        if q > lam.sum():  # the match is one of the upper tail
            assert P.liu_p(q, lam, True) == pytest.approx(p, abs=0.02)


def paired(q, pairs):
    """The exact tail for eigenvalues that come in distinct pairs: a sum of exponentials, in many digits since its terms cancel."""
    with localcontext() as c:
        c.prec = 250
        lam = [Decimal(float(x)) for x in pairs]
        return float(sum((math.prod((a / (a - b) for b in lam if b != a), start=Decimal(1)) * (-Decimal(float(q)) / (2 * a)).exp() for a in lam), Decimal(0)))


@pytest.mark.parametrize("pairs", [[1.0], [1, 0.3], [1, 0.999], [3, 1, 0.5, 0.2], [1e-3, 2e-3, 5e-3], list(np.linspace(0.1, 5, 30)), [1, 1e-5], [1, *np.linspace(1e-4, 1e-3, 40)]])
def test_small_tails_are_as_accurate_as_large_ones(pairs):
    lam = np.repeat(np.array(pairs, dtype=float), 2)
    for f in (1e-6, 0.01, 0.1, 0.5, 0.9, 0.99, 1, 1.01, 1.1, 1.5, 2, 5, 10, 20, 50, 100, 140, 280):
        want = paired(f * lam.sum(), pairs)
        if want > 1e-290:
            p, ok = P.davies_p(f * lam.sum(), lam)
            assert ok == 1 and p == pytest.approx(want, rel=1e-8)


def test_tails_of_equal_eigenvalues_and_of_shifted_squares():
    for k in (2, 3, 5, 50, 501, 5000):
        for f in (0.5, 0.9, 1, 1.1, 2, 5, 20):
            if (want := P.gamma_q(k / 2, f * k / 2)) > 1e-290:
                p, ok = P.davies_p(3 * f * k, np.full(k, 3.0))
                assert ok == 1 and p == pytest.approx(want, rel=1e-7)
    for ncp in (0.1, 1, 4, 30, 200):
        for x in (0.1, 1, 5, 50, 200, 700):
            root, shift = math.sqrt(x), math.sqrt(ncp)
            want = 0.5 * math.erfc((root - shift) / math.sqrt(2)) + 0.5 * math.erfc((root + shift) / math.sqrt(2))
            assert P.noncentral_chi2_sf(x, 1, ncp) == pytest.approx(want, rel=1e-9)


def test_a_failing_inversion_is_marked(monkeypatch):
    lam = np.array([2.0, 1.0, 0.5])
    monkeypatch.setattr(P, "inverted_p", lambda q, e: None)
    assert P.davies_p(9.0, lam) == (P.liu_p(9.0, lam, True), 0)


def test_degenerate_and_deep(spark):
    deep = P.davies_p(1300.0, np.array([1.0, 0.9, 0.8]))
    assert deep[1] == 1 and 0 < deep[0] < 1e-270 and P.davies_p(0.0, np.array([1.0, 2.0])) == (1.0, 1)
    assert P.davies_p(2000.0, np.array([1.0, 0.9, 0.8]))[1] == 0  # below the least positive number
    f = spark.createDataFrame([(5.0, 2.0), (0.0, 0.0)], "q double, v double").select(P.burden_p("q", "v")).collect()
    assert f[0][0] == pytest.approx(math.erfc(math.sqrt(2.5))) and f[1][0] == 1
    z = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0)], "q double, a double, b double, c double").select(P.normal_sf(P.wilson_hilferty_z(*(F.col(c) for c in "qabc")))).first()[0]
    assert z == pytest.approx(1.0)


def site(spark, name, people, calls, genes, roles):
    n = people.count()
    present = genes.where("variant_key is not null").select("variant_key").distinct().withColumn("site", F.lit(name))
    cohort = people.select("sample_id").withColumn("site", F.lit(name))
    counts = variants.allele_counts(calls.withColumn("site", F.lit(name)).dropDuplicates(["sample_id", "variant_key"]), present, cohort)
    return jobs.Prepared(name, people.withColumn("site", F.lit(name)), genes.withColumn("role", F.lit(roles)), calls, counts, n)


def test_two_sites_equal_their_union(spark, random_case):
    g, x, y, (people, calls) = random_case
    genes = spark.createDataFrame([("1", "g", 0, f"v{j}", j, j) for j in range(7)] + [("1", "h", 1, "v0", 0, 0), ("1", "h", 1, "v3", 3, 1), ("1", "empty", 2, None, None, None)], "chrom string, gene_id string, order_index int, variant_key string, pos int, col_index int")
    half = F.substring("sample_id", 2, 9).cast("int") < 150
    a, b = (site(spark, s, people.where(c), calls.where(c), genes, r) for s, c, r in (("A", half, "public_only"), ("B", ~half, "shared")))
    one = site(spark, "A", people, calls, genes, "public_only")
    args = ([0.05, 0.5], ["p", "q"], 3)
    key = lambda r: (r.maf_threshold, r.gene_id, r.phenotype_index)
    joint = {key(r): r for r in jobs.run_association(a, b, *args).collect()}
    whole = {key(r): r for r in jobs.run_association(one, None, *args).collect()}
    assert joint.keys() == whole.keys() and len(joint) == 12
    for k, r in joint.items():
        for c in ("p_burden", "p_skat_wh", "p_skat_liu", "p_skat_davies"):
            assert r[c] == pytest.approx(whole[k][c], rel=1e-6, abs=1e-12)
            assert 0 <= r[c] <= 1
        if k[1] == "empty":
            assert (r.p_burden, r.p_skat_davies, r.davies_converged, r.variants) == (1, 1, None, 0)


def test_wide_gene_has_eigenvalues_and_p_values(spark):
    rng = np.random.default_rng(8)
    n, m = 60, 2100
    x, y = rng.normal(0, 1, (n, 1)), rng.normal(0, 1, (n, 1))
    g = np.zeros((n, m), dtype=int)
    for j in range(m):
        g[rng.choice(n, 2, replace=False), j] = 1
    y[:, 0] += 0.05 * g[:, ::3].sum(axis=1)
    null, weighted, pairs, kept = fitted(spark, (g, x, y, tables(spark, g, x, y, {"g": range(m)})), 1)
    q, _, v, k = dense(g, x, y)
    kernels = A.gene_kernels(weighted, pairs, null, kept)
    r = A.skat_pvalues(A.score_statistics(weighted, null, kept).join(kernels.withColumn("e", F.col("eigenvalues")), ["ancestry", "maf_threshold", "chrom", "gene_id"])).first()
    e = A.kernel_eigenvalues(k)
    assert r.variants == m and np.allclose(sorted(r.e), sorted(e), rtol=1e-6)
    assert (r.s1, r.s2, r.s3, r.v_burden) == pytest.approx((np.trace(k), (k @ k).trace(), (k @ k @ k).trace(), v), rel=1e-8)
    assert r.p_skat_liu == pytest.approx(P.liu_p(q[0], e, False), rel=1e-6) and r.p_skat_davies == pytest.approx(P.davies_p(q[0], e)[0], rel=1e-4) and r.p_skat_davies < 1


def test_p_values_that_were_not_computed_are_null(spark):
    rows = [(3.0, None, 1.5, 1.25, None, None), (3.0, None, 1.5, 1.25, 1.125, 1.0625), (0.0, [], 0.0, 0.0, 0.0, 0.0), (3.0, [1.0], 1.0, 1.0, 1.0, 1.0)]
    stats = spark.createDataFrame(rows, "q_skat double, eigenvalues array<double>, s1 double, s2 double, s3 double, s4 double")
    missing, traces, zero, one = A.skat_pvalues(stats).collect()
    assert (missing.p_skat_liu, missing.p_skat_davies, missing.davies_converged) == (None, None, None)
    assert traces.p_skat_liu == pytest.approx(P.liu_p(3.0, np.array([1.0, 0.5]), False), rel=1e-12) and (traces.p_skat_davies, traces.davies_converged) == (None, None)
    assert (zero.p_skat_liu, zero.p_skat_davies, zero.davies_converged) == (1, 1, None) and 0 < one.p_skat_davies < 1


@pytest.mark.parametrize("products", [7, 2_000_000])
def test_sparse_kernel_traces_equal_dense(products):
    rng = np.random.default_rng(3)
    m = 60
    h = (rng.random((300, m)) < 0.02) * 1.0
    w, x = rng.uniform(1, 25, m), h.T @ np.column_stack([np.ones(300), rng.normal(0, 1, 300)])
    omega = np.diag([1 / 300, 1 / 290])
    k = A.kernel(w, h.T @ h, x, omega)
    a = w[:, None] * (h.T @ h) * w / 2
    i, j = np.nonzero(a)
    got = A.sparse_kernel_traces(m, i, j, a[i, j], w[:, None] * (x @ A.half_of(omega)) / math.sqrt(2), products)
    assert np.allclose(got, (2 * k.sum(), *A.kernel_traces(k)), rtol=1e-10)


def test_kernels_without_spectrum_keep_their_traces(spark, random_case):
    null, weighted, pairs, kept = fitted(spark, random_case)
    both = kept.unionByName(kept.withColumn("maf_threshold", F.lit(0.4)))  # two thresholds that keep the same variants
    key = lambda r: (r.gene_id, r.maf_threshold)
    full = {key(r): r for r in A.gene_kernels(weighted, pairs, null, both).collect()}
    bare = {key(r): r for r in A.gene_kernels(weighted, pairs, null, both, spectrum=False, dense_below=1).collect()}
    assert set(full) == set(bare) and {t for _, t in full} == {0.4, 0.5}
    for k, r in full.items():
        assert bare[k].eigenvalues is None and r.eigenvalues == full[(k[0], 0.5)].eigenvalues
        assert all(math.isclose(bare[k][c], r[c], rel_tol=1e-6) for c in ("v_burden", "s1", "s2", "s3", "s4"))


def test_equal_rows_are_worked_out_once(monkeypatch):
    seen = []
    monkeypatch.setattr(P, "davies_p", lambda q, e, f=P.davies_p: seen.append(q) or f(q, e))
    P._liu_davies.cache_clear()
    q, e = [3.0, 9.0] * 50, [[2.0, 2.0, 0.5]] * 100
    import pandas as pd

    got = P.skat_p.func(pd.Series(q), pd.Series(e), pd.Series([None] * 100))
    assert len(seen) == 2 and got["davies"][0] == got["davies"][98] != got["davies"][1]


@pytest.mark.parametrize("block, together", [(7, 1), (64, 512)])
def test_tails_of_moments_equal_those_of_eigenvalues(block, together):
    rng = np.random.default_rng(4)
    n, m = 3000, 400
    h = np.zeros((n, m))
    for v in range(m):
        h[rng.choice(n, rng.integers(1, 9), replace=False), v] = rng.integers(1, 3)
    w, x = rng.uniform(15, 25, m), h.T @ np.column_stack([np.ones(n), rng.normal(0, 1, n)])
    omega = np.diag([1 / n, 1 / n])
    hth = h.T @ h
    i, j = np.nonzero(hth)
    moments = A.spectral_moments(m, i, j, w[i] * w[j] * hth[i, j] / 2, w[:, None] * (x @ A.half_of(omega)) / math.sqrt(2), block, together)
    e = np.linalg.eigvalsh(A.kernel(w, hth.copy(), x, omega))
    e = e[e > 1e-12 * e.max()]
    for sd in (-4, -1, 0, 1, 3, 5):
        q = e.sum() + sd * math.sqrt(2 * (e * e).sum())
        assert P.inverted_p(q, P.TracedSpectrum(np.array(moments))) == pytest.approx(P.inverted_p(q, e), rel=1e-9)
    assert P.inverted_p(e.sum() + 60 * math.sqrt(2 * (e * e).sum()), P.TracedSpectrum(np.array(moments))) is None


def test_wide_sparse_gene_has_p_values_without_its_matrix(spark):
    rng = np.random.default_rng(8)
    n, m = 900, 300
    x, y = rng.normal(0, 1, (n, 1)), rng.normal(0, 1, (n, 2))
    g = np.zeros((n, m), dtype=int)
    for v in range(m):
        g[rng.choice(n, 2, replace=False), v] = 1
    y[:, 1] += 100 * g[:, ::3].sum(axis=1)  # far out
    null, weighted, pairs, kept = fitted(spark, (g, x, y, tables(spark, g, x, y, {"g": range(m)})), 1)
    stats, key = A.score_statistics(weighted, null, kept), ["ancestry", "maf_threshold", "chrom", "gene_id"]
    rows = lambda below: {r.phenotype_index: r for r in A.skat_pvalues(stats.join(A.gene_kernels(weighted, pairs, null, kept, solved_below=below), key)).collect()}
    got, want = rows(200), rows(None)
    assert got[0].traced and not want[0].traced
    for k in range(2):
        for c in ("s1", "s2", "s3", "s4", "v_burden"):
            assert got[k][c] == pytest.approx(want[k][c], rel=1e-9)
    assert got[0].p_skat_davies == pytest.approx(want[0].p_skat_davies, rel=1e-8) and got[0].davies_converged == 1
    assert got[0].p_skat_liu == pytest.approx(want[0].p_skat_liu, rel=1e-8)


def test_sparse_gene_of_middling_width_is_not_solved(spark):
    """Between ``traced_from`` and ``solved_below`` variants: moments where a short order reaches the tails, with the p-values of the eigenvalues; else eigenvalues."""
    rng = np.random.default_rng(9)
    n, m = 6000, 600
    x, y = rng.normal(0, 1, (n, 1)), rng.normal(0, 1, (n, 2))
    g = np.zeros((n, m), dtype=int)
    for v in range(m):
        g[rng.choice(n, 2, replace=False), v] = 1
    null, weighted, pairs, kept = fitted(spark, (g, x, y, tables(spark, g, x, y, {"g": range(m)})), 1)
    stats, key = A.score_statistics(weighted, null, kept), ["ancestry", "maf_threshold", "chrom", "gene_id"]
    rows = lambda **how: {r.phenotype_index: r for r in A.skat_pvalues(stats.join(A.gene_kernels(weighted, pairs, null, kept, **how), key)).collect()}
    got, want, short = rows(traced_from=512), rows(solved_below=None), rows(traced_from=512, longest=4)
    assert got[0].traced and not want[0].traced and not short[0].traced
    for k in range(2):
        for c in ("p_skat_davies", "p_skat_liu", "s1", "s2", "s3", "s4", "v_burden"):
            assert got[k][c] == pytest.approx(want[k][c], rel=1e-8) and short[k][c] == pytest.approx(want[k][c], rel=1e-8)
