import gzip
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rarevar_spark import input_queries
from rarevar_spark.operators import checks, samples, variants
from rarevar_spark.plans import jobs
from rarevar_spark.sources import readers, writers
from rarevar_spark.testtables import Tables

DIR = "/root/testdata/sf0.001"


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_variants_samples_genes(spark, tmp_path):
    p = put(tmp_path, "a.pvar", "##x\n#CHROM\tPOS\tID\tREF\tALT\tFILTER\n21\t5\t21:5:A:<INS:ME>\tA\t<INS:ME>\tPASS\nchr21\t9\tchr21:9:A:G\tA\tG\tq10\n")
    assert [(r.variant_key, r.chrom, r.pos, r.filter) for r in readers.read_variants(spark, p).orderBy("ord").collect()] == [("chr21:5:A:<INS:ME>", "21", 5, "PASS"), ("chr21:9:A:G", "21", 9, "q10")]
    p = put(tmp_path, "b.pvar", "#CHROM\tPOS\tID\tREF\tALT\n21\t5\t21:5:A:G\tA\tG\n")
    assert readers.read_variants(spark, p).first()["filter"] == "PASS"
    with pytest.raises(ValueError):
        readers.read_variants(spark, put(tmp_path, "c.pvar", "21\t5\tx\tA\tG\n"))
    p = put(tmp_path, "a.psam", "#FID\tIID\tSID\n0\ts2\tx\n0\ts1\ty\n")
    assert [r.sample_id for r in readers.read_samples(spark, p).orderBy("ord").collect()] == ["s2", "s1"]
    p = put(tmp_path, "genes", "gene_id\tgene_symbol\tchromosome\torder_index\n\tX\t21\t0\n")
    with pytest.raises(ValueError):
        readers.read_gene_panel(spark, p)
    p = put(tmp_path, "ann", "extra\tgene_symbol\tvariant_key\tgene_id\n1\tS\t21:5:A:G\tG1\n")
    assert readers.read_annotations(spark, p).select("variant_key", "gene_id", "gene_symbol").first() == ("chr21:5:A:G", "G1", "S")


def test_phenotypes_and_covariates(spark, tmp_path):
    p = put(tmp_path, "ph", "id,a,b\ns1,1,NA\ns2,2,3\ns1,5,.\n")
    got = {r.sample_id: r for r in readers.read_phenotypes(spark, p, "id", ["a", "b"]).collect()}
    assert got["s1"].a == 5 and got["s1"].b != got["s1"].b and got["s2"].b == 3
    assert readers.phenotypes_long(readers.read_phenotypes(spark, p, "id", ["a", "b"]), ["a", "b"]).count() == 4
    put(tmp_path, "cov_EUR", "id\tpcs\ns1\t[0.5,-1,2]\n")
    path = str(tmp_path / "cov_{anc}")
    r = readers.read_covariates(spark, path, "id", ["PC1", "PC3"], "pcs", ["EUR"]).first()
    assert (r.ancestry, r.sample_id, r.x) == ("EUR", "s1", [0.5, 2.0])
    with pytest.raises(ValueError):
        readers.read_covariates(spark, path, "id", ["PC4"], "pcs", ["EUR"])
    p = put(tmp_path, "anc", "id\tlabel\ns1\t eur \n")
    assert readers.read_ancestries(spark, p, "id", "label").first() == ("s1", "EUR")
    p = put(tmp_path, "joint", "#IID,PC1,AGE,GENDER BIOBANK\ns1,0.5,,1 2\ns2\t1\t40\t0 1\n")
    rows = {r.sample_id: r for r in readers.import_joint_covariates(spark, p, ["PC1", "age_at_profile", "affiliation"]).collect()}
    assert rows["s2"].age_at_profile == 40 and rows["s1"].affiliation == 2 and rows["s1"].age_at_profile != rows["s1"].age_at_profile
    for bad in ("#IID,A\ns1,x\n", "#IID,A\ns1,1\ns1,2\n", "#IID,A\ns1\n", "#IID,A\n", "#IID,A,A\ns1,1,1\n"):
        with pytest.raises(ValueError):
            readers.import_joint_covariates(spark, put(tmp_path, f"bad{abs(hash(bad))}", bad), ["A"])


def test_vcf_and_gtf(spark, tmp_path):
    p = put(tmp_path, "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\n21\t5\t.\tA\tG\t.\tPASS\t.\tGT\t0|1\t./.\t0/0\n21\t6\t.\tA\tG,T\t.\tPASS\t.\tGT\t1|1\t0/0\t0/0\n21\t7\t.\tA\tC\t.\tlow\t.\tGT\t1|1\t0/0\t0/0\n21\t8\t.\tA\tC\t.\t.\t.\tGT:DP\t1|1:3\t0/0:1\t0/1:2\n")
    v, s, c = readers.read_vcf(spark, p, ["s1", "s2"])
    assert [r.variant_key for r in v.orderBy("pos").collect()] == ["chr21:5:A:G", "chr21:8:A:C"] and s.count() == 2
    assert {(r.variant_key[-5:], r.sample_id, r.dosage, r.called) for r in c.collect()} == {("5:A:G", "s1", 1, True), ("5:A:G", "s2", 0, False), ("8:A:C", "s1", 2, True)}
    line = lambda kind, a, b, gid, gt: f'chr21\tx\t{kind}\t{a}\t{b}\t.\t+\t.\tgene_id "{gid}"; gene_type "{gt}"; gene_name "N{gid}";\n'
    p = put(tmp_path, "g.gtf", "#c\n" + line("gene", 1, 10, "G1", "protein_coding") + line("exon", 1, 5, "G1", "protein_coding") + line("gene", 2, 9, "G2", "lncRNA") + line("gene", 5, 20, "G3", "protein_coding"))
    g = readers.read_gene_intervals(spark, p)
    assert [(r.gene_id, r.order_index) for r in g.orderBy("order_index").collect()] == [("G1", 0), ("G3", 1)]
    hits = variants.variant_gene_overlap(v, g, 4)
    assert {(r.pos, r.gene_id) for r in hits.collect()} == {(5, "G1"), (5, "G3"), (8, "G1"), (8, "G3")}


def test_vcf_batches_have_samples_of_their_own(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "v").mkdir()
    put(tmp_path / "v", "a.vcf", "##x\n" + head + "s1\ts2\n21\t5\t.\tA\tG\t.\tPASS\t.\tGT\t0|1\t./.\n21\t6\t.\tA\tG,T\t.\tPASS\t.\tGT\t1|1\t0/0\n")
    put(tmp_path / "v", "b.vcf", head + "s4\ts3\ts0\n21\t5\t.\tA\tG\t.\tPASS\t.\tGT:DP\t0/0:1\t1|1:1\t0|0:3\n21\t7\t.\tA\tC\t.\tlow\t.\tGT\t1|1\t0/0\t0/1\n")
    v, s, c = readers.read_vcf_batches(spark, str(tmp_path / "v"))
    assert [r.variant_key for r in v.collect()] == ["chr21:5:A:G"] and {r[0] for r in s.collect()} == {"s0", "s1", "s2", "s3", "s4"}
    assert {tuple(r) for r in c.collect()} == {("chr21:5:A:G", "s1", 1, True), ("chr21:5:A:G", "s2", 0, False), ("chr21:5:A:G", "s3", 2, True)}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_records_of_read_vcf_have_no_cell_for_each_person(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(input_queries, "_place", lambda t, name, f=input_queries._place: seen.append(f(t, name)) or seen[-1])
    input_queries.read_vcf(Tables(spark, DIR))
    cells = spark.read.text(seen[-1]).where("value not like '##%'").agg(F.max(F.size(F.split("value", "\t")) - 9), F.min(F.size(F.split("value", "\t")) - 9)).first()
    assert 0 < cells[1] and cells[0] < spark.read.parquet(f"{DIR}/customer.parquet").count() // 2


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_files_of_read_vcf_are_small_and_whole(spark, monkeypatch):
    """Each file is compressed and begins with the header of its batch, records follow by position; calls are dealt by batch before they are text."""
    seen, dealt_ = [], []
    monkeypatch.setattr(input_queries, "_place", lambda t, name, f=input_queries._place: seen.append(f(t, name)) or seen[-1])
    monkeypatch.setattr(input_queries, "dealt", lambda df, *a, f=input_queries.dealt: dealt_.append(df.columns) or f(df, *a))
    input_queries.read_vcf(Tables(spark, DIR))
    assert len(dealt_) == 2 and all("value" not in c for c in dealt_)
    files = list(Path(seen[-1].removeprefix("file://")).glob("batch=*/[!.]*"))
    assert files and all(f.name.endswith(".txt.gz") for f in files) and len({f.parent for f in files}) == len(files)
    names = []
    for f in files:
        lines = [x.split("\t") for x in gzip.decompress(f.read_bytes()).decode().splitlines()]
        assert lines[0][0] == "#CHROM" and all(x[0].startswith("chr") and len(x) == len(lines[0]) for x in lines[1:])
        assert [int(x[1]) for x in lines[1:]] == sorted(int(x[1]) for x in lines[1:])
        names += lines[0][9:]
    assert sorted(names) == sorted(str(r[0]) for r in spark.read.parquet(f"{DIR}/customer.parquet").select("c_custkey").collect())


def test_lists_round_trip(spark, tmp_path):
    genes = spark.createDataFrame([("21", "G1", "S1", 0), ("21", "G2", "S2", 1)], "chrom string, gene_id string, gene_symbol string, order_index int")
    gv = spark.createDataFrame([("21", "G1", "chr21:7:A:G", 7, 1), ("21", "G1", "chr21:5:A:G", 5, 0)], "chrom string, gene_id string, variant_key string, pos int, col_index int")
    out = str(tmp_path / "public")
    writers.write_public_variant_list(genes, gv, out)
    got = readers.read_public_variant_list(spark, out)
    assert [(r.gene_id, r.variant_key) for r in got.orderBy("ord").collect()] == [("G1", "chr21:5:A:G"), ("G1", "chr21:7:A:G"), ("G2", None)]
    writers.write_cut_list(gv.unionByName(gv), str(tmp_path / "cut"))
    assert readers.read_cut_list(spark, str(tmp_path / "cut")).count() == 2
    bad = put(tmp_path, "list", "chromosome\tgene_id\tgene_symbol\torder_index\tvariant_key\tposition\n21\tG1\tS\t0\ta\t1\n21\tG2\tS\t1\tb\t2\n21\tG1\tS\t0\tc\t3\n")
    with pytest.raises(ValueError):
        readers.read_public_variant_list(spark, bad)
    with pytest.raises(Exception):  # noqa: B017
        writers.write_cut_list(gv, str(tmp_path / "cut"))


def test_splits_and_draws(spark):
    people = spark.createDataFrame([(f"s{i:03d}", None if i % 7 == 0 else "EUR" if i % 3 else "AFR") for i in range(101)], "sample_id string, ancestry string")
    got = {r.sample_id: r.party for r in samples.split_samples(people).collect()}
    order = sorted(people.collect(), key=lambda r: (r.ancestry or "", r.sample_id))
    assert [got[r.sample_id] for r in order] == [i % 2 for i in range(101)]
    known = people.where("ancestry is not null")
    two = samples.split_two_cohorts(known, "all", 3)
    n = {(r.ancestry, r.site): r["count"] for r in two.groupBy("ancestry", "site").count().collect()}
    for a in ("EUR", "AFR"):
        assert n[a, "A"] - n[a, "B"] in (0, 1)
    with pytest.raises(ValueError):
        samples.sample_cohort(known.withColumn("site", F.lit("A")), 1000, 1)
    with pytest.raises(ValueError):
        samples.sample_cohort(known, 0, 1)
    assert samples.simulate_phenotypes(people.repartition(7), ["a"], 1).orderBy("sample_id").collect() == samples.simulate_phenotypes(people, ["a"], 1).orderBy("sample_id").collect()


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int")
    assert checks.repeated_keys(df, ["k"]).first() == ("a", 2)
    with pytest.raises(ValueError):
        checks.repeated_keys(df, ["k"], strict=True)
    assert checks.aligned_sites(df, df.where("n = 1"), ["k", "n"]).first() == ("a", 2, "a")
    s = spark.createDataFrame([("21", 0, "x"), ("22", 0, "x"), ("22", 1, "y")], "chrom string, ord int, sample_id string")
    assert checks.same_samples_across_chromosomes(s).collect() == [("22", 1, "y")]
    counts = spark.createDataFrame([(1, 2, 10, 5), (3, 2, 10, 5)], "analysis_ac int, cohort_ac int, cohort_n int, samples int")
    assert checks.impossible_counts(counts).count() == 1
    roles = spark.createDataFrame([("v", "shared"), ("v", "private"), ("w", "private")], "variant_key string, role string")
    assert checks.public_and_private(roles).collect() == [("v",)]
    with pytest.raises(ValueError):
        checks.threshold_within(0.1, 0.05)
    assert variants.invalid_dosages(spark.createDataFrame([(0,), (-9,), (3,)], "dosage int")).count() == 1


def test_ld_prune_and_pca(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    g = rng.binomial(2, 0.3, (60, 6))
    g[:, 1] = g[:, 0]
    rows = [("21", f"v{j}", j, f"s{i:02d}", int(g[i, j])) for i in range(60) for j in range(6) if g[i, j]]
    d = spark.createDataFrame(rows, "chrom string, variant_key string, pos int, sample_id string, dosage int")
    pairs = variants.window_ld_pairs(d, 60)
    got = {(r.a, r.b): r.r2 for r in pairs.collect()}
    want = {(f"v{i}", f"v{j}"): np.corrcoef(g[:, i], g[:, j])[0, 1] ** 2 for i in range(6) for j in range(i + 1, 6)}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v > 0.2}
    v = spark.createDataFrame([("21", f"v{j}", j, float(min(g[:, j].mean(), 2 - g[:, j].mean()) / 2)) for j in range(6)], "chrom string, variant_key string, pos int, maf double")
    left = {r.variant_key for r in variants.ld_prune(v, pairs).collect()}
    assert "v1" not in left and "v0" in left
    pcs = jobs.genotype_pca(d, spark.createDataFrame([(f"s{i:02d}",) for i in range(60)], "sample_id string"), 2).orderBy("sample_id").toPandas()
    f = g.mean(axis=0) / 2
    z = (g - 2 * f) / np.sqrt(2 * f * (1 - f))
    top = np.linalg.eigh(z @ z.T)[1][:, ::-1][:, :2]
    ids = [int(s[1:]) for s in pcs.sample_id]
    for k in (0, 1):
        assert abs(abs(pcs[f"PC{k + 1}"].to_numpy() @ top[ids, k]) - (top[ids, k] ** 2).sum()) < 1e-6


def test_build_annotations(spark):
    v = spark.createDataFrame([("k1", "21", 5, "A", "G", "PASS", 0), ("k2", "21", 9, "A", "G", "PASS", 1)], "variant_key string, chrom string, pos long, ref string, alt string, filter string, ord long")
    c = spark.createDataFrame(
        [("21", 5, "A", "G", "G1", "S1", "", "HC", 0), ("21", 5, "A", "G", "G1", "S1", "NM", "LC", 1), ("21", 5, "A", "G", "G1", "S1", "NM", "HC", 2), ("21", 9, "A", "G", "G1", "S2", "NM", "HC", 3), ("21", 9, "A", "G", "", "S2", "NM", "HC", 4)],
        "chrom string, pos long, ref string, alt string, gene_id string, gene_symbol string, mane string, lof string, ord long",
    )
    out = jobs.build_annotations(c, v)
    assert out["annotations"].collect() == [("k2", "G1", "S2")] and out["genes"].first()["order_index"] == 0
    assert tuple(out["summary"].first()) == (2, 0, 2, 1, 1, 1)


def test_consequences(spark, tmp_path):
    """Eight columns by place; a blank and a full stop are missing; short rows are an error."""
    wide = lambda **own: "\t".join(str(own.get({i: c for c, i in readers.CONSEQUENCE_COLUMNS.items()}.get(i, ""), "")) for i in range(readers.CONSEQUENCE_WIDTH))
    header = "\t".join(f"c{i}" for i in range(readers.CONSEQUENCE_WIDTH))
    rows = [dict(gene_id="g1", mane=".", lof="HC"), dict(gene_id="g1", mane="NM_1", lof="LC"), dict(gene_id="g1", mane="NM_2", lof="HC"), dict(gene_id="g2", mane=" ", lof="HC"), dict(gene_id="g3", mane="NM_3", lof="HC"), dict(gene_id=".", mane="NM_4", lof="HC")]
    path = tmp_path / "consequences.tsv"
    path.write_text("\n".join([header, *(wide(chrom="21", pos=5, ref="A", alt="G", gene_symbol="s", **r) for r in rows)]) + "\n")
    t = readers.read_consequences(spark, str(path))
    assert [(r.pos, r.gene_id, r.mane, r.lof) for r in t.orderBy("ord").collect()] == [(5, r["gene_id"], r["mane"], r["lof"]) for r in rows]
    site = spark.createDataFrame([("chr21:5:A:G", "21", 5, "A", "G", "PASS", 0)], "variant_key string, chrom string, pos long, ref string, alt string, filter string, ord long")
    out = jobs.build_annotations(t, site)
    assert [r.gene_id for r in out["annotations"].collect()] == ["g3"], "g1's first named transcript is LC, g2 has none, and a full stop is no gene"
    assert out["summary"].first().asDict() == {"pairs": 3, "without_mane": 1, "mane": 2, "mane_hc": 1, "mane_not_hc": 1, "retained": 1}
    path.write_text("\n".join([header, wide(pos=5), "21\t5"]) + "\n")
    with pytest.raises(ValueError, match="fewer than 110"):
        readers.read_consequences(spark, str(path))
