"""Sample selection: eligibility, ancestries, cohort draws and the alternating split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ALL, finite_rows
from .checks import violations
from .ranks import ranked


def draw_key(seed: int, *keys: str) -> Column:
    """A seeded order that doesn't depend on partitions: SHA-256 of the seed and the keys."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)), 256)


def expand_ancestries(labelled: DataFrame, with_all: bool = True) -> DataFrame:
    """Each sample under its own ancestry and under ALL."""
    return labelled.withColumn("ancestry", F.explode(F.array("ancestry", F.lit(ALL)))) if with_all else labelled


def eligible_samples(samples: DataFrame, phenotypes: DataFrame, covariates: DataFrame, ancestries: DataFrame | None, ancestry: str = ALL) -> DataFrame:
    """sample_id, ord, x, y of samples of the ancestry whose phenotypes and covariates are all finite.

    ``phenotypes`` has sample_id and y (array), ``covariates`` sample_id, x (array) and maybe ancestry (null: any).
    """
    cov = covariates
    if "ancestry" in cov.columns:
        cov = cov.where(F.col("ancestry").isNull() | (F.col("ancestry") == ancestry)).drop("ancestry")
    out = samples.join(phenotypes.select("sample_id", "y"), "sample_id").join(cov.select("sample_id", "x"), "sample_id").where(finite_rows("x") & finite_rows("y"))
    if ancestry != ALL:
        out = out.join(ancestries.where(F.col("ancestry") == ancestry).select("sample_id"), "sample_id", "left_semi")
    return out


def sample_cohort(eligible: DataFrame, n: int | str, seed: int, by: list[str] = ["ancestry", "site"]) -> DataFrame:  # noqa: B006
    """``n`` random samples, without replacement, of each group of ``by``; 'all' takes all; too few are an error."""
    if n == "all":
        return eligible
    if int(n) <= 0:
        raise ValueError("the number of samples must be positive")
    violations(eligible.groupBy(*by).count().where(F.col("count") < int(n)), f"fewer than {n} eligible samples", strict=True)
    return ranked(eligible, by, [draw_key(seed, "sample_id"), "sample_id"], "rank_").where(F.col("rank_") < int(n)).drop("rank_")


def split_two_cohorts(eligible: DataFrame, n: int | str, seed: int, by: str = "ancestry") -> DataFrame:
    """``eligible`` with site A or B drawn at random: n for each, or with 'all' one half each, A having the odd one."""
    if n != "all" and int(n) <= 0:
        raise ValueError("the number of samples must be positive")
    t = ranked(eligible, [by], [draw_key(seed, "sample_id"), "sample_id"], "rank_", total="total_")
    if n != "all":
        violations(t.where(F.col("total_") < 2 * int(n)).select(by).distinct(), f"fewer than {2 * int(n)} eligible samples", strict=True)
    size = F.ceil(F.col("total_") / 2) if n == "all" else F.lit(int(n))
    last = F.col("total_") if n == "all" else F.lit(2 * int(n))
    return t.where(F.col("rank_") < last).withColumn("site", F.when(F.col("rank_") < size, "A").otherwise("B")).drop("rank_", "total_")


def split_samples(labelled: DataFrame, parties: int = 2) -> DataFrame:
    """``labelled`` (sample_id, ancestry or null) with party: alternating over the order of ancestry, then sample_id."""
    order = [F.coalesce("ancestry", F.lit("")), F.col("sample_id").cast("string")]
    return ranked(labelled, [], order, "rank_").withColumn("party", (F.col("rank_") % parties).cast("int")).drop("rank_")


def cohort_sizes(eligible_all: DataFrame) -> DataFrame:
    """site, n."""
    return eligible_all.groupBy("site").agg(F.count(F.lit(1)).alias("n"))


def dataset_table(analysis_samples: DataFrame, chromosomes: int) -> DataFrame:
    """ancestry, samples, covariates, phenotypes, chromosomes."""
    return analysis_samples.groupBy("ancestry").agg(
        F.count(F.lit(1)).alias("samples"), F.max(F.size("x")).alias("covariates"), F.max(F.size("y")).alias("phenotypes"), F.lit(chromosomes).alias("chromosomes")
    )


def keep_samples(df: DataFrame, keep: DataFrame) -> DataFrame:
    return df.join(keep.select("sample_id").distinct(), "sample_id", "left_semi")


def ancestry_pc_table(panel: DataFrame, eigenvectors: DataFrame, k: int) -> DataFrame:
    """sample_id, ancestry (super population) and pca_features: the first k components as a JSON array."""
    j = panel.join(eigenvectors, "sample_id")
    return j.select("sample_id", F.col("super_pop").alias("ancestry"), F.to_json(F.array(*(f"PC{i}" for i in range(1, k + 1)))).alias("pca_features"))


def simulate_phenotypes(samples: DataFrame, names: list[str], seed: int) -> DataFrame:
    """sample_id and a standard normal number for each name, from a hash of seed, name and sample: the same on any partitioning."""
    def normal(name: str) -> Column:
        u = [F.conv(F.substring(draw_key(seed, "sample_id", "n_"), 1 + 13 * i, 13), 16, 10).cast("double") / F.lit(16.0**13) for i in (0, 1)]
        return F.sqrt(-2 * F.log(1 - u[0])) * F.cos(2 * F.pi() * u[1])

    out = samples.select("sample_id")
    for name in names:
        out = out.withColumn("n_", F.lit(name)).withColumn(name, normal(name)).drop("n_")
    return out
