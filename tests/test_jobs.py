from dataclasses import replace
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarevar_spark.functions.columns import split_role
from rarevar_spark.operators import checks, compare
from rarevar_spark.plans import jobs
from rarevar_spark.sources import readers, writers


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(9)
    n, m = 80, 12
    people = spark.createDataFrame([(f"s{i:02d}", i) for i in range(n)], "sample_id string, ord long")
    v = spark.createDataFrame([(f"chr21:{10 * j}:A:G", "21", 10 * j, "A", "G", "q10" if j == 5 else "PASS", j) for j in range(m)], "variant_key string, chrom string, pos long, ref string, alt string, filter string, ord long")
    g = rng.binomial(2, 0.05, (n, m))
    calls = spark.createDataFrame([("A", f"s{i:02d}", f"chr21:{10 * j}:A:G", int(g[i, j]), True) for i in range(n) for j in range(m) if g[i, j]], "site string, sample_id string, variant_key string, dosage int, called boolean")
    genes = spark.createDataFrame([("G0", "S0", "21", 0), ("G1", "", "21", 1), ("G2", "S2", "21", 2)], "gene_id string, gene_symbol string, chrom string, order_index int")
    ann = spark.createDataFrame([(f"chr21:{10 * j}:A:G", f"G{j % 2}", "S") for j in range(m)], "variant_key string, gene_id string, gene_symbol string")
    y = spark.createDataFrame([(f"s{i:02d}", [float(rng.normal()) if i else float("nan")]) for i in range(n)], "sample_id string, y array<double>")
    x = spark.createDataFrame([(f"s{i:02d}", [float(rng.normal())]) for i in range(n)], "sample_id string, x array<double>")
    anc = spark.createDataFrame([(f"s{i:02d}", "EUR" if i % 4 else "AFR") for i in range(n)], "sample_id string, ancestry string")
    return jobs.SiteInputs(people, v, calls, genes, ann, y, x, anc)


def test_split_prepare_and_run(spark, inputs, tmp_path):
    split = jobs.split_cohort(inputs, ["EUR", "AFR"], 0.5)
    sizes = {s: split[s].samples.count() for s in "AB"}
    assert sizes == {"A": 40, "B": 40} and split["A"].samples.join(split["B"].samples, "sample_id").count() == 0
    hidden = {s: {r[0] for r in inputs.variants.select("variant_key").exceptAll(split[s].variants.select("variant_key")).collect()} for s in "AB"}
    roles = dict(inputs.variants.select("variant_key", split_role("variant_key", 0.5)).collect())
    assert hidden == {"A": {k for k, r in roles.items() if r == "private"}, "B": {k for k, r in roles.items() if r == "public_only"}}
    a = jobs.prepare_site(split["A"], "A", ["ALL", "EUR"], local_max_maf=0.2)
    with pytest.raises(ValueError):
        jobs.prepare_site(split["B"], "B", ["ALL", "EUR"])
    b = jobs.prepare_site(split["B"], "B", ["ALL", "EUR"], public=a.public, cut=a.cut, local_max_maf=0.2)
    assert {r.role for r in b.gene_variants.select("role").distinct().collect()} <= {"shared", "public_only", "private"}
    assert a.gene_variants.where("variant_key = 'chr21:50:A:G'").count() == 0, "not PASS"
    res = jobs.run_association(a, b, [0.5], ["y"], 1)
    rows = {(r.ancestry, r.gene_id): r for r in res.collect()}
    assert set(rows) == {(p, g) for p in ("ALL", "EUR") for g in ("G0", "G1", "G2")}
    assert rows["ALL", "G2"].p_burden == 1 and rows["ALL", "G2"].davies_converged is None and 0 < rows["ALL", "G0"].p_burden <= 1
    writers.write_prepared(a.calls, str(tmp_path / "prepared"))
    assert spark.read.parquet(str(tmp_path / "prepared")).count() == a.calls.count()
    writers.write_results(res, str(tmp_path / "results"))
    writers.export_results(res.select("chrom", "gene_index", "gene_id", "phenotype_index", "p_burden"), str(tmp_path / "text"))
    assert readers.read_results(spark, str(tmp_path / "text")).count() == 6
    local = jobs.prepare_site(split["A"], "A", ["ALL"], mode="local", genes_per_chromosome=1, local_max_maf=0.05)
    assert local.gene_variants.select("gene_id").distinct().count() == 1
    with pytest.raises(ValueError):
        jobs.run_association(local, None, [0.4], ["y"], 1)


@pytest.fixture(scope="module")
def pair(spark, inputs):
    split = jobs.split_cohort(inputs, ["EUR", "AFR"], 0.5)
    a = jobs.prepare_site(split["A"], "A", ["ALL", "EUR"], local_max_maf=0.2)
    return a, jobs.prepare_site(split["B"], "B", ["ALL", "EUR"], public=a.public, cut=a.cut, local_max_maf=0.2)


def changed(df, **columns):
    return df.withColumns({c: F.expr(e) for c, e in columns.items()})


FAULTS = {
    "gene_order": (lambda a, b: (a, replace(b, gene_variants=changed(b.gene_variants, order_index="1 - order_index"))), "gene that site A"),
    "column_count": (lambda a, b: (a, replace(b, gene_variants=b.gene_variants.join(b.gene_variants.where("role != 'private'").limit(1).select("variant_key"), "variant_key", "left_anti"))), "public variants differ"),
    "private_rows": (lambda a, b: (a, replace(b, gene_variants=changed(b.gene_variants, gene_id="if(role = 'private', 'G2', gene_id)"))), "the gene doesn't have"),
    "missing_private_keys": (lambda a, b: (a, replace(b, gene_variants=changed(b.gene_variants, variant_key="if(role = 'private', null, variant_key)"))), "private role without a variant"),
    "public_and_private": (lambda a, b: (a, replace(b, gene_variants=b.gene_variants.unionByName(changed(b.gene_variants.where("role = 'shared'"), role="'private'", gene_id="'G2'", order_index="2")))), "public and private"),
    "ac_above_cohort_ac": (lambda a, b: (replace(a, counts=changed(a.counts, ac="ac - 1")), b), "A: analysis AC above"),
    "cohort_ac_above_cohort": (lambda a, b: (a, replace(b, counts=changed(b.counts, ac="1000L"))), "B: cohort AC above"),
    "inconsistent_duplicate": (lambda a, b: (replace(a, calls=a.calls.unionByName(changed(a.calls.where("sample_id < 's10'"), gene_id="'G2'"))), b), "counts differ between genes"),
    "dosage": (lambda a, b: (replace(a, calls=changed(a.calls, dosage="3")), b), "dosage not in"),
    "repeated_calls": (lambda a, b: (replace(a, calls=reduce(DataFrame.unionAll, [a.calls] * 60)), b), "more calls than samples"),
    "ancestries": (lambda a, b: (a, replace(b, samples=b.samples.where("ancestry = 'ALL'"))), "one site lacks"),
    "covariates": (lambda a, b: (a, replace(b, samples=changed(b.samples, x="slice(x, 1, 0)"))), "x has not 1"),
    "phenotypes": (lambda a, b: (a, replace(b, samples=changed(b.samples, y="concat(y, y)"))), "y has not 1"),
    "repeated_sample": (lambda a, b: (replace(a, samples=a.samples.unionByName(a.samples.limit(1))), b), "sample twice"),
}


@pytest.mark.parametrize("fault", sorted(FAULTS))
def test_malformed_inputs_are_refused(pair, fault):
    change, message = FAULTS[fault]
    with pytest.raises(ValueError, match=message):
        jobs.run_association(*change(*pair), [0.5], ["y"], 1)


@pytest.mark.parametrize("fault", ["gene_order", "column_count", "ac_above_cohort_ac", "public_and_private", "inconsistent_duplicate"])
def test_resource_statistics_refuse_them_too(pair, fault):
    change, message = FAULTS[fault]
    with pytest.raises(ValueError, match=message):
        jobs.resource_stats(*change(*pair), [0.5], [5], [5])


def test_sound_inputs_break_no_rule(pair):
    assert checks.findings(jobs.input_rules(*pair, 1, 1)).collect() == []
    assert checks.findings(jobs.input_rules(pair[0], None, 1, 1)).collect() == []


def test_ancestries_are_joined_once(spark, inputs):
    """As many scans of the inputs for three ancestries as for one, and covariates of an ancestry's own."""
    plan = lambda a: jobs.analysis_samples(inputs, "A", a)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(["ALL"]).count("Join") == plan(["ALL", "EUR", "AFR"]).count("Join")
    got = {(r.ancestry, r.sample_id) for r in jobs.analysis_samples(inputs, "A", ["ALL", "EUR"]).collect()}
    assert got == {("ALL", f"s{i:02d}") for i in range(1, 80)} | {("EUR", f"s{i:02d}") for i in range(80) if i % 4}
    x = inputs.covariates.withColumn("ancestry", F.lit("EUR")).unionByName(inputs.covariates.select("sample_id", F.array(F.lit(0.0)).alias("x"), F.lit("ALL").alias("ancestry")))
    own = jobs.analysis_samples(replace(inputs, covariates=x), "A", ["ALL", "EUR"]).collect()
    assert {(r.ancestry, r.sample_id) for r in own} == got and len(own) == len(got) and all(r.x == [0.0] for r in own if r.ancestry == "ALL")


def test_calls_are_joined_with_samples_and_kept_once(spark, inputs, monkeypatch):
    """Counting and extracting read the same joined calls, and what is kept doesn't grow with the ancestries."""
    seen = []
    monkeypatch.setattr(jobs, "keep", lambda df, n, f=jobs.keep: seen.append((n, df)) or f(df, n))
    a = jobs.prepare_site(inputs, "A", ["ALL", "EUR", "AFR"])
    joins = {n: df._jdf.queryExecution().optimizedPlan().toString().count("Join") for n, df in seen}
    assert joins["gene-calls"] == 1 and joins["counts"] <= 4
    kept = dict(seen)["gene-calls"].count()
    by = {r.ancestry: r["count"] for r in a.calls.groupBy("ancestry").count().collect()}
    assert by["ALL"] == by["EUR"] + by["AFR"] == kept and a.calls.count() == 2 * kept


def results(spark, shift):
    rows = [("EUR", "21", i, f"G{i}", k, f"p{k}", min(1.0, (i + 1) / 40 + shift), str(int(i % 5 > 0))) for i in range(20) for k in (0, 1)]
    return spark.createDataFrame(rows, f"ancestry string, chromosome string, gene_index int, gene_id string, phenotype_index int, phenotype_name string, p_{'b' if shift else 'a'} double, converged_{'b' if shift else 'a'} string")


def test_compare(spark):
    a, b = results(spark, 0.0), results(spark, 0.001)
    out = jobs.compare_results(a, b, "p_a", "p_b", "converged_a")
    assert out["joined"].count() == 40 and out["rollup"].count() == 1 + 2 + 2
    x, y = (-np.log10([(i + 1) / 40 + s for i in range(20)] * 2) for s in (0, 0.001))
    r2 = 1 - ((x - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert out["rollup"].where("phenotype_index is null").first().r2 == pytest.approx(r2)
    assert out["labels"].count() == 20 and out["convergence"].first()["failed"] == 8
    assert out["worst"].first()["phenotype_index"] == 0
    with pytest.raises(ValueError):
        jobs.compare_results(a, b.where("gene_index > 0"), "p_a", "p_b")
    with pytest.raises(ValueError):
        jobs.compare_results(a.unionByName(a), b, "p_a", "p_b")
    names = compare.gene_symbols(a, spark.createDataFrame([("G1", " "), ("G2", "S2")], "gene_id string, gene_symbol string"))
    assert {(r.gene_id, r.gene_symbol) for r in names.where("gene_index < 3").collect()} == {("G0", "G0"), ("G1", "G1"), ("G2", "S2")}


def test_public_cohort(spark):
    rng = np.random.default_rng(4)
    n, m = 30, 150
    f = rng.uniform(0.1, 0.5, m)
    g = rng.binomial(2, f, (n, m))
    calls = spark.createDataFrame([(f"chr21:{j}:A:G", f"s{i:02d}", int(g[i, j]), True) for i in range(n) for j in range(m) if g[i, j]], "variant_key string, sample_id string, dosage int, called boolean")
    v = spark.createDataFrame([(f"chr21:{j}:A:G", "21", j, "A", "G", "PASS", j) for j in range(m)], "variant_key string, chrom string, pos long, ref string, alt string, filter string, ord long")
    people = spark.createDataFrame([(f"s{i:02d}", i) for i in range(n)], "sample_id string, ord long")
    genes = spark.createDataFrame([("21", 0, 100, "G0", "S0", 0), ("21", 50, 149, "G1", "S1", 1)], "chrom string, start long, `end` long, gene_id string, gene_symbol string, order_index int")
    panel = people.select("sample_id", F.lit("EUR").alias("super_pop"))
    out = jobs.public_cohort_inputs(calls, v, people, genes, panel, ["a", "b"], k=3)
    assert out["annotations"].count() == 2, "one of each full hundred of 201 pairs"
    assert out["ancestries"].count() == n and out["ancestries"].first().pca_features.count(",") == 2
    assert out["phenotypes"].columns == ["sample_id", "a", "b"]
