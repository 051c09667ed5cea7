"""Data-quality checks. Each gives the rows that break a rule; ``strict`` raises on any. ``findings`` and ``refuse`` take many rules in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, what: str, strict: bool = False) -> DataFrame:
    if strict and (rows := df.limit(3).collect()):
        raise ValueError(f"{what}: {rows}")
    return df


def findings(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, n (rows that break it), example (one of them as JSON) of every rule that any row breaks: one job, in which rules share what they read."""
    rows = [df.select(F.lit(rule).alias("rule"), F.to_json(F.struct("*")).alias("example")) for rule, df in rules.items()]
    return reduce(DataFrame.unionAll, rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("example").alias("example"))


def refuse(rules: dict[str, DataFrame]) -> None:
    """Raises if any row breaks any of the rules, and names each of these with its number of rows and an example."""
    if found := sorted(map(tuple, findings(rules).collect())):  # a row for each rule at most
        raise ValueError("; ".join(f"{rule}: {n}, as {example}" for rule, n, example in found))


def call_summary(calls: DataFrame) -> DataFrame:
    """ancestry, chrom, gene_id, variant_key, analysis_ac, missing, carriers, odd_dosages: what rules need of the calls, summed once before any shuffle."""
    d = F.col("dosage")
    odd = F.coalesce(~d.isin(-9, 0, 1, 2), F.lit(True))
    called = F.coalesce(F.col("called"), F.lit(False)) if "called" in calls.columns else F.lit(True)
    return calls.groupBy("ancestry", "chrom", "gene_id", "variant_key").agg(
        F.coalesce(F.sum(F.when(called & d.between(1, 2), d.cast("long"))), F.lit(0)).alias("analysis_ac"), F.count_if(~called | (d == -9)).alias("missing"),
        F.count_if(called & (d > 0)).alias("carriers"), F.count_if(odd).alias("odd_dosages"),
    )


def site_rules(site: str, summary: DataFrame, sizes: DataFrame, counts: DataFrame, cohort_n: int, gene_variants: DataFrame) -> dict[str, DataFrame]:
    """The rules for one site's calls (:func:`call_summary`), cohort counts (variant_key, ac) and gene variants; ``sizes``: ancestry, n of the site."""
    wanted = gene_variants.where("variant_key is not null")
    bounds = summary.join(sizes, "ancestry").join(counts.select("variant_key", F.col("ac").alias("cohort_ac")), "variant_key", "left")
    bounds = bounds.select("ancestry", "gene_id", "variant_key", "analysis_ac", "cohort_ac", F.lit(cohort_n).alias("cohort_n"), F.col("n").alias("samples"), (F.col("carriers") + F.col("missing")).alias("calls"))
    odd_counts = counts.where((F.col("ac") < 0) | (F.col("ac") > 2 * cohort_n)).select("variant_key", "ac")
    per_ancestry = summary.select("analysis_ac", "missing", "carriers", F.concat_ws("/", "ancestry", "variant_key").alias("variant_key"))
    return {
        f"{site}: dosage not in -9, 0, 1, 2": summary.where("odd_dosages > 0").select("gene_id", "variant_key", "odd_dosages"),
        f"{site}: call of a variant that the gene doesn't have": summary.join(wanted.select("chrom", "gene_id", "variant_key"), ["chrom", "gene_id", "variant_key"], "left_anti").select("gene_id", "variant_key"),
        f"{site}: analysis AC above cohort AC": bounds.where("analysis_ac > cohort_ac or cohort_ac is null"),
        f"{site}: more calls than samples": bounds.where("calls > samples or samples > cohort_n"),
        f"{site}: cohort AC above twice the cohort": odd_counts,
        f"{site}: a variant's counts differ between genes": inconsistent_variants(per_ancestry, ["analysis_ac", "missing", "carriers"]),
        f"{site}: a variant twice in a gene": repeated_keys(wanted, ["chrom", "gene_id", "variant_key"]),
        f"{site}: private role without a variant": gene_variants.where("variant_key is null and role = 'private'").select("chrom", "gene_id", "role"),
        f"{site}: public and private": public_and_private(wanted),
    }


def pair_rules(a_variants: DataFrame, b_variants: DataFrame) -> dict[str, DataFrame]:
    """The rules for the gene variants of two sites: the genes of B stand as in A, and both have the same public variants in each gene."""
    gene = ["chrom", "gene_id", "order_index"]
    public = lambda t: t.where("variant_key is not null and role != 'private'")
    return {
        "gene that site A doesn't have in that place": b_variants.select(gene).distinct().join(a_variants.select(gene).distinct(), gene, "left_anti"),
        "the sites' public variants differ": both_ways(public(a_variants), public(b_variants), ["chrom", "gene_id", "variant_key"]),
    }


def sample_rules(samples: DataFrame, covariates: int | None = None, phenotypes: int | None = None) -> dict[str, DataFrame]:
    """The rules for both sites' samples (ancestry, site, sample_id, maybe x and y): each once, numbers of the right length, the same ancestries at each site."""
    rules = {"sample twice in an ancestry": repeated_keys(samples, ["ancestry", "site", "sample_id"])}
    for column, length in (("x", covariates), ("y", phenotypes)):
        if column in samples.columns and length is not None:
            fewer = F.size(column) < length if column == "x" else F.size(column) != length
            rules[f"{column} has not {length} values"] = samples.where(F.coalesce(fewer, F.lit(True))).select("site", "sample_id", F.size(column).alias("size"))
    sites = samples.select("site").distinct().agg(F.count(F.lit(1)).alias("sites"))
    per = samples.groupBy("ancestry").agg(F.count_distinct("site").alias("n"))
    rules["ancestry that one site lacks"] = per.join(F.broadcast(sites), F.col("n") != F.col("sites")).select("ancestry")
    return rules


def repeated_keys(df: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """keys and n of keys that more than one row has."""
    return violations(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"repeated {', '.join(keys)}", strict)


def require_columns(df: DataFrame, columns: list[str], nonempty: bool = True) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)}")
    if nonempty and df.limit(1).count() == 0:
        raise ValueError("no rows")
    return df


def impossible_counts(counts: DataFrame, strict: bool = False) -> DataFrame:
    """Rows without 0 <= analysis_ac <= cohort_ac <= 2 cohort_n and samples <= cohort_n."""
    bad = "analysis_ac < 0 or analysis_ac > cohort_ac or cohort_ac > 2 * cohort_n or samples > cohort_n"
    return violations(counts.where(bad), "impossible counts", strict)


def public_and_private(gene_variants: DataFrame, strict: bool = False) -> DataFrame:
    """Variants that are public in one gene and private in another."""
    per = gene_variants.groupBy("variant_key").agg(F.count_if(F.col("role") == "private").alias("n_private"), F.count(F.lit(1)).alias("n"))
    return violations(per.where("n_private > 0 and n_private < n").select("variant_key"), "public and private", strict)


def threshold_within(threshold: float, prepared: float | None) -> float:
    if prepared is not None and threshold > prepared:
        raise ValueError(f"threshold {threshold} is above the prepared maximum {prepared}")
    return threshold


def same_values(a: list, b: list, what: str) -> None:
    if list(a) != list(b):
        raise ValueError(f"the sites' {what} differ: {a} and {b}")


def both_ways(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that one table has more often than the other, with side a or b."""
    x, y = a.select(columns), b.select(columns)
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def aligned_sites(a: DataFrame, b: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """Differences between two sites' gene lists, block sizes or public lists."""
    return violations(both_ways(a, b, columns), "the sites differ", strict)


def same_samples_across_chromosomes(samples: DataFrame, strict: bool = False) -> DataFrame:
    """(chrom, ord, sample_id) that not every chromosome has."""
    chroms = samples.select("chrom").distinct()
    n = chroms.count()
    odd = samples.groupBy("ord", "sample_id").agg(F.count_distinct("chrom").alias("n")).where(F.col("n") != n)
    return violations(samples.join(odd, ["ord", "sample_id"]).select("chrom", "ord", "sample_id"), "samples differ between chromosomes", strict)


def inconsistent_variants(counts: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """Variants that have different counts in different genes."""
    bad = counts.groupBy("variant_key").agg(F.count_distinct(F.struct(*columns)).alias("n")).where("n > 1")
    return violations(bad, "a variant's counts differ", strict)


def complete_results(results: DataFrame, genes: DataFrame, phenotypes: DataFrame, p_columns: list[str], strict: bool = False, by: list[str] = []) -> DataFrame:  # noqa: B006
    """What keeps ``results`` from being one row with p-values in [0, 1] for each stratum, gene and phenotype, with a reason.

    ``genes`` has gene_index and gene_id, ``phenotypes`` phenotype_index and phenotype_name; phenotypes are few.
    ``by`` names the further columns of the key, such as ancestry and chromosome; each is a column of ``genes`` or of ``phenotypes``.
    """
    of = lambda df, own: df.select(*(c for c in by if c in df.columns), *own)
    key = [*by, "gene_index", "gene_id", "phenotype_index", "phenotype_name"]
    expected = of(genes, ["gene_index", "gene_id"]).crossJoin(F.broadcast(of(phenotypes, ["phenotype_index", "phenotype_name"]))).withColumn("wanted", F.lit(True))
    bad_p = reduce(lambda a, b: a | b, (~F.coalesce(F.col(c).try_cast("double").between(0, 1), F.lit(False)) for c in p_columns))
    found = results.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(bad_p).alias("bad_p"))
    diff = expected.join(found, key, "full")
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(F.col("bad_p"), "p outside [0, 1]")
    return violations(diff.select(*key, reason.alias("reason")).where("reason is not null"), "incomplete results", strict)
