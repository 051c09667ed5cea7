"""Every query of the library against DuckDB on the smallest test tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from rarevar_spark import input_queries, job_queries  # noqa: F401  register their queries beside the others
from rarevar_spark import queries as Q
from rarevar_spark import testtables
from rarevar_spark.operators import checks
from rarevar_spark.tables import dealt

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return ("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = Q.queries()[name](spark, DIR)
    r = con.sql(Q.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    assert Q.queries()[name](spark, DIR).count() >= 0


@pytest.mark.parametrize("name", ["association_results", "resource_statistics"])
def test_every_ancestry_has_its_strata(spark, name):
    want = {r[0] for r in spark.read.parquet(f"{DIR}/region.parquet").select("r_name").collect()} | {"ALL"}
    assert {r[0] for r in Q.queries()[name](spark, DIR).select("ancestry").distinct().collect()} == want


def test_complete_results_names_what_every_stratum_lacks(spark):
    cells = [(a, c, g, f"g{c}{g}", 0, "p", 0.5) for a in "XY" for c in ("21", "22") for g in (0, 1)]
    have = [r for r in cells if r[:3] != ("Y", "22", 1)] + [cells[0], ("Z", *cells[0][1:])]
    columns = "ancestry string, chromosome string, gene_index int, gene_id string, phenotype_index int, phenotype_name string, p double"
    genes = spark.createDataFrame(cells, columns).select("chromosome", "gene_index", "gene_id").distinct()
    phenotypes = spark.createDataFrame([("X", 0, "p"), ("Y", 0, "p")], "ancestry string, phenotype_index int, phenotype_name string")
    got = checks.complete_results(spark.createDataFrame(have, columns), genes, phenotypes, ["p"], by=["ancestry", "chromosome"])
    assert {(r.ancestry, r.chromosome, r.gene_index, r.reason) for r in got.collect()} == {("Y", "22", 1, "missing"), ("X", "21", 0, "repeated"), ("Z", "21", 0, "unexpected")}


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().mkString(" ")


def test_people_are_made_once_for_all_ancestries(spark):
    assert "o_totalprice" not in leaves(Q.queries()["eligible_samples_all_ancestries"](spark, DIR))


def test_more_rows_are_dealt_to_more_tasks(spark):
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda rows: dealt(spark.range(10), rows, "id", most=100).rdd.getNumPartitions()
    assert parts(100 * partitions * 3) == 3 * partitions and parts(1000) == max(partitions, 10)


def test_order_lines_are_dealt_by_part_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(testtables, "dealt", lambda df, rows, *keys: seen.append((rows, keys)) or df.repartition(7, *keys))
    plan = testtables.Tables(spark, DIR).calls._jdf.queryExecution().executedPlan().toString()
    n = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert seen == [(n, ("l_orderkey",)), (n, ("l_partkey",))]
    assert plan.count("hashpartitioning(l_partkey") == 1 and "hashpartitioning(o_custkey" not in plan


@pytest.mark.parametrize("name", ["sparse_traces", "panel_a", "planted_violations"])
def test_last_plan_reads_kept_tables_alone(spark, name):
    assert "l_partkey" not in leaves(Q.queries()[name](spark, DIR))


@pytest.mark.parametrize("name", ["major_pairs", "major_kernels"])
def test_no_row_for_each_person_and_turned_variant(spark, monkeypatch, name):
    seen = []
    monkeypatch.setattr(job_queries, "keep", lambda df, n, f=job_queries.keep: seen.append((n, f(df, n))) or seen[-1][1])
    Q.queries()[name](spark, DIR)
    calls = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert dict(seen)["gene-calls"].count() <= 3 * calls  # under two ancestries, in one gene or two


def test_small_negative_balances_keep_their_sign_in_texts(spark):
    rows = [("a", 1.0, -0.004, "X"), ("b", 2.0, -0.0, "Y"), ("c", 3.0, 0.285, "X"), ("d", 4.0, -12.34, "Y"), ("e", 5.0, 0.0, "Y")]
    p = spark.createDataFrame(rows, "sample_id string, x0 double, y0 double, ancestry string")
    t = Q.Tables(spark, DIR).replaced(eligible=p, people=p)
    c = duckdb.connect()
    c.execute("CREATE TABLE eligible (sample_id VARCHAR, x0 DOUBLE, y0 DOUBLE, ancestry VARCHAR)")
    c.executemany("INSERT INTO eligible VALUES (?, ?, ?, ?)", rows)
    want = c.execute("SELECT sample_id, concat('[', x0, ',null,', round(y0, 2), ']') FROM eligible").fetchall()
    assert sorted((r.sample_id, r.packed) for r in Q.packed_covariates(t).collect()) == sorted(want)
    want = c.execute("SELECT sample_id, concat('[', x0, ',', round(y0, 2), ']') FROM eligible").fetchall()
    assert sorted((r.sample_id, r.pca_features) for r in input_queries.ancestry_components(t).collect()) == sorted(want)


@pytest.mark.parametrize("name", ["panel_a", "resource_stats_sum"])
def test_carriers_are_kept_and_cumulative_counts_left_out(spark, monkeypatch, name):
    seen = []
    monkeypatch.setattr(Q, "keep", lambda df, n, f=Q.keep: seen.append(n) or f(df, n))
    df = Q.queries()[name](spark, DIR)
    assert {"carriers", "site-calls", "site-counts"} <= set(seen) and "cmac" not in seen and "calls" not in seen
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3
