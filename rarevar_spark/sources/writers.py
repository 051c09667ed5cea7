"""Sinks: Parquet for what other jobs read, text for what people read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip_missing

# Columns of the text outputs.
PUBLIC_LIST_COLUMNS = ["chromosome", "gene_id", "gene_symbol", "order_index", "variant_key", "position"]
STAT_COLUMNS = ["ancestry", "maf_threshold", "annotation", "chromosome", "gene_set", "panel", "series", "lower", "upper", "count", "status"]


def write_prepared(gene_calls: DataFrame, path: str) -> None:
    """Prepared calls by ancestry and chromosome; missing dosages become 0 and callability is kept; refuses a path in use."""
    gene_calls.drop("strata").withColumn("dosage", clip_missing("dosage").cast("tinyint")).repartition("ancestry", "chrom", F.pmod(F.xxhash64("sample_id"), F.lit(16))).write.partitionBy("ancestry", "chrom").mode("error").parquet(path)


def _text(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("error").csv(path, header=True, sep=sep, emptyValue="", nullValue="")


def write_public_variant_list(genes: DataFrame, gene_variants: DataFrame, path: str) -> None:
    """Genes in panel order with their variants in order, in one file, since its order counts; a gene without variants has one row with a blank key."""
    v = gene_variants.select("chrom", "gene_id", "variant_key", "pos", "col_index")
    t = genes.join(v, ["chrom", "gene_id"], "left").orderBy(F.col("chrom").cast("int"), "order_index", "gene_id", "col_index")
    _text(t.select(F.col("chrom").alias("chromosome"), "gene_id", "gene_symbol", "order_index", "variant_key", F.col("pos").alias("position")).coalesce(1), path)


def write_cut_list(keys: DataFrame, path: str) -> None:
    _text(keys.select("variant_key").distinct().orderBy("variant_key"), path)


def write_selected_genes(genes: DataFrame, path: str) -> None:
    _text(genes.select("gene_id", "gene_symbol", F.col("chrom").alias("chromosome"), "order_index").orderBy(F.col("chromosome").cast("int"), "order_index", "gene_id"), path)


def write_results(results: DataFrame, path: str) -> None:
    """Results as Parquet by ancestry, threshold and chromosome."""
    results.repartition("ancestry", "maf_threshold", "chrom").write.partitionBy("ancestry", "maf_threshold", "chrom").mode("error").parquet(path)


def export_results(results: DataFrame, path: str, sep: str = ",") -> None:
    """Results as text in gene-major order."""
    _text(results.orderBy(F.col("chrom").cast("int"), "gene_index", "phenotype_index"), path, sep)


def write_resource_stats(stats: DataFrame, path: str) -> None:
    _text(stats.select(STAT_COLUMNS).orderBy(STAT_COLUMNS[:-2]), path)
