import math

import pytest
from pyspark.sql import functions as F

from rarevar_spark.functions import columns as C


def test_variant_keys(spark):
    cases = {"21:5:A:<INS:ME:ALU>": "chr21:5:A:<INS:ME:ALU>", "rs123": "rs123", "chr21:5:A:G": "chr21:5:A:G", "21:5:A:G": "chr21:5:A:G"}
    got = dict(spark.createDataFrame([(k,) for k in cases], "k string").select("k", C.canonical_variant_key("k")).collect())
    assert got == cases
    df = spark.createDataFrame([("chr1:5:A:G", "1", 5), ("1:5:A:G,T", "1", 5), ("1:6:A:G", "1", 5), ("1:5::G", "1", 5), ("x", "1", 5)], "k string, c string, p long")
    assert [r[0] for r in df.select(C.valid_variant_key("k", "c", "p")).collect()] == [True, False, False, False, False]
    alleles = spark.createDataFrame([("chr1:5:A:G",), ("5:A:<INS:ME>",), ("rs1",)], "k string").select(C.variant_alleles("k").alias("a")).collect()
    assert [tuple(r.a) if r.a else None for r in alleles] == [(5, "A", "G"), (5, "A", "<INS:ME>"), None]


def test_missing_and_finite(spark):
    df = spark.createDataFrame([(t,) for t in ["", "NA", "NaN", "nan", ".", "1.5", "x", None]], "t string")
    got = [r[0] for r in df.select(C.parse_missing("t")).collect()]
    assert all(math.isnan(v) for v in got[:5]) and got[5] == 1.5 and got[6] is None and math.isnan(got[7])
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0, float("nan")],), ([float("inf")],), ([None],), (None,), ([],)], "x array<double>")
    assert [r[0] for r in rows.select(C.finite_rows("x")).collect()] == [True, False, False, False, False, True]


def test_frequencies(spark):
    df = spark.createDataFrame([(0, 100), (2, 100), (3, 100), (197, 100), (198, 100), (100, 100), (101, 100)], "ac long, n long")
    assert [r[0] for r in df.select(C.maf_keep("ac", "n", 0.01)).collect()] == [True, True, False, False, True, False, False]
    assert all(r[0] for r in df.select(C.maf_keep("ac", "n", 0.5)).collect())
    assert [r[0] for r in df.select(C.alt_is_major("ac", "n")).collect()] == [False, False, False, True, True, False, True]
    w = [r[0] for r in df.select(C.signed_weight("ac", "n")).collect()]
    assert w[0] == 25 and w[3] < 0 < w[5] and w[1] == pytest.approx(25 * 0.99**24)
    flips = spark.createDataFrame([(0,), (1,), (2,), (-9,)], "d int").select(C.flip_to_minor("d", F.lit(150), F.lit(100))).collect()
    assert [r[0] for r in flips] == [2, 1, 0, None]
    assert [r[0] for r in spark.createDataFrame([(0.3,), (0.0,), (-1.0,), (float("nan"),)], "p double").select(C.neg_log10_p("p")).collect()] == [pytest.approx(-math.log10(0.3)), pytest.approx(300), None, None]


def test_roles_by_hash(spark):
    import hashlib

    keys = [f"chr1:{i}:A:G" for i in range(200)]

    def role(k):
        u = int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") / 2**64
        return "shared" if u < 0.6 else "public_only" if u < 0.8 else "private"

    got = dict(spark.createDataFrame([(k,) for k in keys], "k string").select("k", C.split_role("k", 0.6)).collect())
    assert got == {k: role(k) for k in keys}


def test_packed_and_lists(spark):
    df = spark.createDataFrame([([1.5, -0.25],)], "x array<double>").select(C.encode_packed_covariates("x", [0, 2], 4).alias("p"))
    assert df.first()[0] == "[1.5,null,-0.25,null]"
    assert df.select(C.packed_covariate("p", "PC3"), C.packed_covariate("p", "PC5")).first() == (-0.25, None)
    with pytest.raises(ValueError):
        C.packed_covariate("p", "PC0")
    assert C.normalize_chromosomes(["all"])[-1] == "22" and C.normalize_chromosomes([21, "22"]) == ["21", "22"]
    for bad in ([], [0], [23], [1, 1]):
        with pytest.raises(ValueError):
            C.normalize_chromosomes(bad)
    with pytest.raises(ValueError):
        C.check_thresholds([0.6])
    text = spark.createDataFrame([('gene_id "G1"; gene_type "protein_coding"; gene_name "ABC";',)], "t string")
    assert text.select(C.parse_attribute("t", "gene_name"), C.parse_attribute("t", "other")).first() == ("ABC", None)
