"""Two random sites against a count by hand, sample by sample."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rarevar_spark.operators import resource
from rarevar_spark.plans import jobs

SIZES = {("N", "A"): 13, ("N", "B"): 19, ("S", "A"): 11, ("S", "B"): 7}
TOTAL = sum(SIZES.values())
VARIANTS = ["rare", "common", "tie", "major", "majority_at_a", "unseen", "own_rare", "own_major"]
PRIVATE = {"own_rare", "own_major"}
GENES = {"alpha": ["rare", "common"], "beta": ["common", "major", "own_rare"], "gamma": ["own_rare", "own_major"], "delta": [], "epsilon": ["tie", "unseen", "majority_at_a"], "zeta": ["major"]}
THRESHOLDS, CARRIERS, EDGES = [0.02, 0.2, 0.5], [1, 6, 12], [2, 9, 25]


def dosages(seed):
    """(ancestry, site, sample, variant): dosage, or None where missing; site A has no private variants."""
    rng = random.Random(seed)
    odds = {"rare": (96, 4, 0), "common": (60, 30, 10), "major": (3, 15, 82), "majority_at_a": (20, 30, 50), "unseen": (1, 0, 0), "own_rare": (90, 10, 0), "own_major": (5, 10, 85)}
    out = {}
    for (anc, site), n in SIZES.items():
        for v in VARIANTS:
            if site == "A" and v in PRIVATE:
                continue
            for i in range(n):
                if v == "tie":  # as many ALT alleles as samples
                    d = 1
                elif v == "majority_at_a" and site == "B":
                    d = rng.choices((0, 1), (90, 10))[0]
                else:
                    d = rng.choices((0, 1, 2), odds[v])[0]
                out[anc, site, f"{anc}{site}{i}", v] = None if v != "tie" and rng.random() < 0.08 else d
    return out


def prepared(spark, site, data, chroms):
    shared = [v for v in VARIANTS if v not in PRIVATE]
    seen = [v for v in VARIANTS if site == "B" or v in shared]
    people = [(anc, site, f"{anc}{site}{i}") for (anc, s), n in SIZES.items() if s == site for i in range(n)]
    calls = [(anc, c, g, sample, f"{c}-{v}", d or 0, d is not None) for (anc, s, sample, v), d in data.items() if s == site and d != 0 for c in chroms for g, vs in GENES.items() if v in vs]
    role = lambda v: "public_only" if site == "A" else "private" if v in PRIVATE else "shared"
    genes = []
    for c in chroms:
        for k, (g, vs) in enumerate(GENES.items()):
            own = [v for v in vs if v in seen]
            genes += [(c, g, k, f"{c}-{v}", role(v)) for v in own] or [(c, g, k, None, None)]
    counts = [(site, f"{c}-{v}", sum(d or 0 for (_, s, _, x), d in data.items() if s == site and x == v)) for c in chroms for v in seen]
    return jobs.Prepared(
        site, spark.createDataFrame(people, "ancestry string, site string, sample_id string"),
        spark.createDataFrame(genes, "chrom string, gene_id string, order_index int, variant_key string, role string"),
        spark.createDataFrame(calls, "ancestry string, chrom string, gene_id string, sample_id string, variant_key string, dosage int, called boolean"),
        spark.createDataFrame(counts, "site string, variant_key string, ac long"), sum(n for (_, s), n in SIZES.items() if s == site),
    )


def by_hand(data):
    """(ancestry, threshold, panel, series, lower): count."""
    out = {}
    pooled = {v: sum(d or 0 for (_, s, _, x), d in data.items() if x == v) for v in VARIANTS}
    for anc in ("N", "S"):
        mine = {k[1:]: d for k, d in data.items() if k[0] == anc}
        n = sum(m for (a, _), m in SIZES.items() if a == anc)
        flip = {v: sum(d or 0 for (_, _, x), d in mine.items() if x == v) > n for v in VARIANTS}
        minor = {k: None if d is None else 2 - d if flip[k[2]] else d for k, d in mine.items()}
        for t in THRESHOLDS:
            kept = {v for v, ac in pooled.items() if t == 0.5 or ac <= math.floor(2 * TOTAL * t) or ac >= math.ceil(2 * TOTAL * (1 - t))}
            count = {(v, s): sum(m or 0 for (x, _, w), m in minor.items() if x == s and w == v) for v in kept for s in "AB"}
            carriers = {(g, s): len({i for (x, i, v), m in minor.items() if x == s and v in kept and v in vs and m}) for g, vs in GENES.items() for s in "AB"}
            cmac = {(g, s): sum(count[v, s] for v in vs if v in kept) for g, vs in GENES.items() for s in "AB"}
            both = [g for g in GENES if min(carriers[g, "A"], carriers[g, "B"]) >= EDGES[0]]
            for least in CARRIERS:
                for series, value in {"A": lambda a, b: a, "B": lambda a, b: b, "local_any": max, "joint": lambda a, b: a + b}.items():
                    out[anc, t, "A", series, str(least)] = sum(value(carriers[g, "A"], carriers[g, "B"]) >= least for g in GENES)
            for lo, hi in zip(EDGES, [*EDGES[1:], math.inf]):
                for series, value in {"A": lambda a, b: a, "B": lambda a, b: b, "joint": lambda a, b: a + b}.items():
                    out[anc, t, "B", series, str(lo)] = sum(lo <= value(cmac[g, "A"], cmac[g, "B"]) < hi for g in both)
            seen = [(count[v, "A"] > 0, count[v, "B"] > 0) for v in kept if any(v in vs for vs in GENES.values())]
            for series, where in {"shared": (True, True), "A_only": (True, False), "B_only": (False, True)}.items():
                out[anc, t, "C", series, "NA"] = seen.count(where)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_resource_stats_against_a_count_by_hand(spark, seed):
    data, chroms = dosages(seed), ("7", "9")
    want = by_hand(data)
    assert any(v for (_, t, p, _, _), v in want.items() if p == "B") and want["N", 0.5, "C", "B_only", "NA"] > 0
    stats = jobs.resource_stats(prepared(spark, "A", data, chroms), prepared(spark, "B", data, chroms), THRESHOLDS, CARRIERS, EDGES)
    got = {(r.ancestry, r.chromosome, r.maf_threshold, r.panel, r.series, r.lower): r["count"] for r in stats.collect()}
    assert got == {(anc, c, *rest): n for (anc, *rest), n in want.items() for c in chroms}
    summed = resource.sum_chromosomes(stats)
    assert {(r.ancestry, r.maf_threshold, r.panel, r.series, r.lower): r["count"] for r in summed.collect()} == {k: 2 * n for k, n in want.items()}
    with pytest.raises(ValueError):
        resource.sum_chromosomes(stats.where("not (chromosome = '9' and panel = 'C')"))
    with pytest.raises(ValueError):
        resource.cmac_histogram(stats, [25, 9])


def test_strata_of_a_call_are_counted_at_once(spark):
    """Calls with all strata of their samples give what calls by ancestry do, in genes with flipped variants and without; what is there twice counts once."""
    data, counted = dosages(3), {}
    for form in ("by ancestry", "with strata"):
        sites = []
        for site in "AB":
            p = prepared(spark, site, data, ("7",))
            own = p.calls.withColumn("strata", F.array(F.lit("ALL"), F.col("ancestry")))
            if form == "with strata":
                own = own.unionByName(own.where("not called and variant_key = '7-common'"))
            spread = own.withColumn("ancestry", F.explode("strata"))
            people = p.samples.unionByName(p.samples.withColumn("ancestry", F.lit("ALL")))
            sites.append(replace(p, samples=people, calls=spread if form == "with strata" else spread.drop("strata")))
        counted[form] = sorted(map(tuple, jobs.resource_stats(*sites, THRESHOLDS, CARRIERS, EDGES).collect()))
    assert {r[0] for r in counted["with strata"]} == {"ALL", "N", "S"} and any(r[-2] for r in counted["with strata"] if r[0] == "ALL")
    assert counted["with strata"] == counted["by ancestry"]
