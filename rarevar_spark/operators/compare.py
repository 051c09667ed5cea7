"""Comparing two result tables, summaries of p-values and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_finite, neg_log10_p
from .checks import repeated_keys, violations

RESULT_KEY = ["chromosome", "gene_index", "gene_id", "phenotype_index", "phenotype_name"]


def match_results(left: DataFrame, right: DataFrame, keys: list[str] = RESULT_KEY, strict: bool = True) -> DataFrame:
    """Rows of both sides by key; a key repeated on a side, or on one side alone, is an error. Other columns must differ in name."""
    repeated_keys(left, keys, strict)
    repeated_keys(right, keys, strict)
    full = left.withColumn("left_", F.lit(True)).join(right.withColumn("right_", F.lit(True)), keys, "full")
    violations(full.where("left_ is null or right_ is null").select(keys), "keys of one side alone", strict)
    return full.where("left_ and right_").drop("left_", "right_")


def gene_symbols(results: DataFrame, genes: DataFrame) -> DataFrame:
    """``results`` with gene_symbol; a blank or missing symbol is the gene_id. The gene table is a panel, of some ten thousand rows."""
    names = genes.select("gene_id", F.nullif(F.trim("gene_symbol"), F.lit("")).alias("symbol_"))
    return results.join(names, "gene_id", "left").withColumn("gene_symbol", F.coalesce("symbol_", "gene_id")).drop("symbol_")


def _r2(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """n, r2 = 1 - sum (a - b)^2 / sum (b - mean b)^2 of pairs valid on both sides; null below two pairs or without variance."""
    x, y = neg_log10_p(a), neg_log10_p(b)
    both = x.isNotNull() & y.isNotNull()
    e = F.when(both, (x - y) * (x - y))
    ss = F.var_pop(F.when(both, y)) * F.count(F.when(both, 1))
    return df.groupBy(*by).agg(F.count(F.when(both, 1)).alias("n"), F.sum(e).alias("sse"), ss.alias("ss")).select(*by, "n", F.when((F.col("n") >= 2) & (F.col("ss") > 0), 1 - F.col("sse") / F.col("ss")).alias("r2"))


def r_squared(df: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    return _r2(df, by, a, b)


def accuracy_rollup(compared: DataFrame, a: str, b: str) -> DataFrame:
    """r_squared by ancestry, by ancestry and phenotype, and by these and chromosome, in one table (null: all)."""
    x, y = neg_log10_p(a), neg_log10_p(b)
    both = x.isNotNull() & y.isNotNull()
    t = compared.select("ancestry", "phenotype_index", "phenotype_name", "chromosome", F.when(both, x).alias("x"), F.when(both, y).alias("y"))
    sets = [["ancestry"], ["ancestry", "phenotype_index", "phenotype_name"], ["ancestry", "phenotype_index", "phenotype_name", "chromosome"]]
    keys = sets[-1]
    g = t.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.count("y").alias("n"), F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("sse"), (F.var_pop("y") * F.count("y")).alias("ss"))
    return g.select(*keys, "n", F.when((F.col("n") >= 2) & (F.col("ss") > 0), 1 - F.col("sse") / F.col("ss")).alias("r2"))


def convergence_split(compared: DataFrame, a: str, b: str, flag: str, by: list[str]) -> DataFrame:
    """by, total, failed (flag 0), r2 of all, r2_converged of the others."""
    failed = F.coalesce(F.col(flag).cast("string") == "0", F.lit(False))
    totals = compared.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"))
    every = _r2(compared, by, a, b).select(*by, "r2")
    fine = _r2(compared.where(~failed), by, a, b).select(*by, F.col("r2").alias("r2_converged"))
    return totals.join(every, by, "left").join(fine, by, "left")


def worst_stratum(rollup: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """The row of least r2 of each group, ties by the given columns."""
    rest = [c for c in rollup.columns if c not in by]
    first = F.min_by(F.struct(*rest), F.struct("r2", *ties))
    return rollup.where("r2 is not null").groupBy(*by).agg(first.alias("w")).select(*by, "w.*")


def pvalue_summary(results: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, column, count, nonfinite, outside (finite but not in [0, 1]), zeros, ones, min, q1, median, q3, max of the valid values."""
    long = results.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).try_cast("double").alias("p")) for c in columns))).alias("s")).select(*by, "s.*")
    ok = is_finite("p")
    valid = F.when(ok & F.col("p").between(0, 1), F.col("p"))
    q = F.percentile(valid, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(~ok).alias("nonfinite"), F.count_if(ok & ~F.col("p").between(0, 1)).alias("outside"),
        F.count_if(F.col("p") == 0).alias("zeros"), F.count_if(F.col("p") == 1).alias("ones"), F.min(valid).alias("min"), q.alias("q"), F.max(valid).alias("max"),
    ).select(*by, "column", "count", "nonfinite", "outside", "zeros", "ones", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def bonferroni_hits(results: DataFrame, column: str, alpha: float = 0.05, by: list[str] = ["ancestry", "phenotype_index"]) -> DataFrame:  # noqa: B006
    """Rows with p at most alpha over the rows of their (ancestry, phenotype), counted before any is judged invalid."""
    n = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"))
    return results.join(n, by).where(neg_log10_p(column).isNotNull() & (F.col(column) <= alpha / F.col("n_"))).drop("n_")


def label_genes(compared: DataFrame, a: str, b: str, top: int = 10, alpha: float = 0.05, by: list[str] = ["ancestry", "phenotype_index"]) -> DataFrame:  # noqa: B006
    """Rows to label: a hit on either side, or among the ``top`` of side b by (p, chromosome, gene_index, gene_id)."""
    n = compared.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"))
    p = F.when(neg_log10_p(b).isNotNull(), F.col(b))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(p.asc_nulls_last(), F.col("chromosome").cast("int"), "gene_index", "gene_id"))
    hit = lambda c: F.coalesce(neg_log10_p(c).isNotNull() & (F.col(c) <= alpha / F.col("n_")), F.lit(False))
    return compared.join(n, by).withColumn("rank_", rank).where(hit(a) | hit(b) | ((F.col("rank_") <= top) & p.isNotNull())).drop("n_", "rank_")


def manhattan_positions(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gene positions, chromosome marks): x counts genes by (chromosome, gene_index); marks are each chromosome's last x and mean x."""
    genes = results.select("chromosome", "gene_index").distinct()
    per = genes.groupBy("chromosome").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("chromosome", (F.sum("n").over(Window.orderBy(F.col("chromosome").cast("int"))) - F.col("n")).alias("before_"))  # a row per chromosome
    rank = F.row_number().over(Window.partitionBy("chromosome").orderBy("gene_index"))
    x = genes.withColumn("rank_", rank).join(F.broadcast(before), "chromosome").select("chromosome", "gene_index", (F.col("rank_") + F.col("before_") - 1).alias("x"))
    return x, x.groupBy("chromosome").agg(F.max("x").alias("boundary"), F.avg("x").alias("center"))


def metrics_time_table(metrics: DataFrame, stages: list[str], setup: list[str], process: Column | None = None) -> DataFrame:
    """Seconds by ancestry and chromosome with a column for each stage, and total.

    Chromosomes count when their 'chromosome_total' is there. The TOTAL row of an ancestry adds its chromosomes and the set-up stages,
    which are kept under chromosome 0; GRAND_TOTAL adds ancestries if there are several.
    """
    t = metrics if process is None else metrics.where(process)
    done = t.where((F.col("stage") == "chromosome_total") & (F.col("chromosome") != "0")).select("ancestry", "chromosome").distinct()
    per = t.join(done, ["ancestry", "chromosome"], "left_semi").where(F.col("stage").isin(stages))
    first = t.where((F.col("chromosome") == "0") & F.col("stage").isin(setup))
    sums = lambda df, keys: df.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("duration_seconds"))), F.lit(0.0)).alias(s) for s in [*setup, *stages]))
    rows = sums(per, ["ancestry", "chromosome"])
    total = sums(per.unionByName(first.join(done.select("ancestry").distinct(), "ancestry", "left_semi")), ["ancestry"]).withColumn("chromosome", F.lit("TOTAL"))
    out = rows.unionByName(total)
    grand = total.groupBy().agg(*(F.sum(s).alias(s) for s in [*setup, *stages]), F.count(F.lit(1)).alias("n_")).where("n_ > 1").drop("n_")
    out = out.unionByName(grand.select(F.lit("GRAND_TOTAL").alias("ancestry"), F.lit("TOTAL").alias("chromosome"), *setup, *stages))
    return out.withColumn("total", sum((F.col(s) for s in [*setup, *stages]), F.lit(0.0))).select("ancestry", "chromosome", *setup, *stages, "total")


def metrics_comm_table(metrics: DataFrame, setup: list[str]) -> DataFrame:
    """ancestry, chromosome, sent_bytes, received_bytes: set-up stages under 0, 'chromosome_total' elsewhere, with subtotals."""
    at0 = (F.col("chromosome") == "0") & F.col("stage").isin(setup)
    t = metrics.where(at0 | ((F.col("chromosome") != "0") & (F.col("stage") == "chromosome_total")))
    g = t.rollup("ancestry", "chromosome").agg(F.sum("sent_bytes").cast("long").alias("sent_bytes"), F.sum("received_bytes").cast("long").alias("received_bytes"))
    return g.select(F.coalesce("ancestry", F.lit("GRAND_TOTAL")).alias("ancestry"), F.coalesce("chromosome", F.lit("TOTAL")).alias("chromosome"), "sent_bytes", "received_bytes")
