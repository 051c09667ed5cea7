"""The composite jobs: preparing a site, association, resource statistics, comparison, annotation, splits and public cohorts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ALL, check_thresholds, clip_missing, finite_rows, local_maf_keep, maf_keep
from ..functions.pvalues import burden_p, normal_sf, wilson_hilferty_z
from ..operators import association as assoc
from ..operators import checks, compare, resource, samples, variants
from ..operators.ranks import ranked
from ..tables import dealt, keep


@dataclass
class SiteInputs:
    """A site's canonical tables. ``phenotypes``: sample_id, y (array); ``covariates``: sample_id, x (array), maybe ancestry."""

    samples: DataFrame
    variants: DataFrame
    calls: DataFrame
    genes: DataFrame
    annotations: DataFrame
    phenotypes: DataFrame
    covariates: DataFrame
    ancestries: DataFrame


@dataclass
class Prepared:
    """A site ready for analysis. ``calls`` are by ancestry, chromosome and gene, maybe with strata, all ancestries that the sample comes under; ``counts`` over the
    ALL cohort of ``cohort_size``."""

    site: str
    samples: DataFrame
    gene_variants: DataFrame
    calls: DataFrame
    counts: DataFrame
    cohort_size: int
    public: DataFrame | None = None
    cut: DataFrame | None = None
    max_maf: float | None = None


def analysis_samples(inputs: SiteInputs, site: str, ancestries: list[str], n: int | str = "all", seed: int = 1) -> DataFrame:
    """ancestry, site, sample_id, ord, x, y of the eligible samples of each ancestry (ALL among them if asked for).

    The inputs are joined once, whatever the number of ancestries: a sample comes under its own and under ALL.
    """
    wanted = inputs.samples.sparkSession.createDataFrame([(a,) for a in dict.fromkeys(ancestries)], "ancestry string")
    own = inputs.ancestries.where("ancestry is not null").select("sample_id", "ancestry").distinct()
    labels = inputs.samples.select("sample_id").distinct().withColumn("ancestry", F.lit(ALL)).unionByName(own.where(F.col("ancestry") != ALL))
    labels = labels.join(F.broadcast(wanted), "ancestry", "left_semi")
    cov = inputs.covariates
    t = inputs.samples.join(inputs.phenotypes.select("sample_id", "y"), "sample_id").join(labels, "sample_id")
    if "ancestry" in cov.columns:  # covariates of an ancestry of their own
        c = cov.select("sample_id", "x", F.col("ancestry").alias("of_"))
        t = t.join(c, "sample_id").where(F.col("of_").isNull() | (F.col("of_") == F.col("ancestry"))).drop("of_")
    else:
        t = t.join(cov.select("sample_id", "x"), "sample_id")
    t = t.where(finite_rows("x") & finite_rows("y")).withColumn("site", F.lit(site))
    return samples.sample_cohort(t, n, seed)


def prepare_site(
    inputs: SiteInputs, site: str, ancestries: list[str], mode: str = "joint", public: DataFrame | None = None, cut: DataFrame | None = None,
    local_max_maf: float | None = None, genes_per_chromosome: int | None = None, requested: list[str] | None = None, samples_per_cohort: int | str = "all", seed: int = 1,
) -> Prepared:
    """Prepare a site: eligible samples, PASS variants, cohort counts, the local MAF cut, genes, roles and calls.

    ``mode`` 'local' is a site alone, laid out as site A. In 'joint' mode site A publishes its gene variants and cut list, and site B gets these as
    ``public`` and ``cut``. Counts are over the site's ALL cohort whatever the ancestry. Tables that later steps read more than once are kept, so
    that no plan holds the steps before it. Calls are joined with the samples once, for counting and extracting, and kept once whatever the number of
    ancestries: those of :attr:`Prepared.calls` are spread as they are read.
    """
    passing = variants.pass_variants(inputs.variants)
    cohort = samples.eligible_samples(inputs.samples, inputs.phenotypes, inputs.covariates, inputs.ancestries, ALL).withColumn("site", F.lit(site))
    n = cohort.count()
    if not n:
        raise ValueError("no eligible samples")
    chosen = keep(analysis_samples(inputs, site, ancestries, samples_per_cohort, seed), "samples")
    panel = variants.select_genes(inputs.genes, requested) if requested else inputs.genes
    candidates = variants.gene_variants(panel, passing, inputs.annotations)
    if site == "B" and mode == "joint":
        if public is None or cut is None:
            raise ValueError("site B needs the public list and the cut list of site A")
        allowed = variants.minus_cut_list(passing, cut)
        candidates = variants.gene_variants(panel, passing, inputs.annotations, allowed)
        candidates = keep(candidates.join(public.select("gene_id").distinct(), "gene_id", "left_semi"), "candidates")
        keys = variants.countable_keys(passing, candidates, public)
    else:
        candidates = keep(candidates, "candidates")
        keys = variants.countable_keys(passing, candidates)
    present = keys.withColumn("site", F.lit(site))
    people = chosen.select("sample_id", "ancestry", F.lit(False).alias("counted")).unionByName(cohort.select("sample_id", F.lit(None).cast("string").alias("ancestry"), F.lit(True).alias("counted")))
    people = people.groupBy("sample_id").agg(F.sort_array(F.collect_list("ancestry")).alias("strata"), F.max("counted").alias("counted"))
    own = keep(inputs.calls.drop("ancestry").join(people, "sample_id"), "site-calls")
    counts = keep(variants.cohort_counts(own.where(F.col("counted") & (F.col("site") == site)), present), "counts")
    kept = counts.where(local_maf_keep("ac", F.lit(n), local_max_maf)).select("variant_key")
    local_cut = None
    if site == "B" and mode == "joint":
        roles = variants.site_roles_b(public, passing, candidates.join(kept, "variant_key", "left_semi"))
        ordered = roles.join(passing.select("variant_key", "ord"), "variant_key", "left").join(panel.select("chrom", "gene_id", "order_index"), ["chrom", "gene_id"])
        gene_table = keep(variants.column_index(ordered), "gene-variants")
    else:
        gene_table = variants.gene_variants(panel, passing, inputs.annotations, kept)
        if genes_per_chromosome:
            gene_table = gene_table.join(variants.sample_genes(gene_table, genes_per_chromosome, seed).select("chrom", "gene_id"), ["chrom", "gene_id"], "left_semi")
        gene_table = keep(variants.site_roles_a(gene_table), "gene-variants")
        local_cut = variants.local_cut_variants(candidates.where("variant_key is not null").join(gene_table.select("gene_id").distinct(), "gene_id", "left_semi"), counts, n, local_max_maf)
        local_cut, public = keep(local_cut, "cut"), gene_table
    calls = keep(variants.in_genes(own.where("size(strata) > 0").drop("counted"), gene_table), "gene-calls")
    return Prepared(site, chosen, gene_table, calls.withColumn("ancestry", F.explode("strata")), counts, n, public, local_cut, local_max_maf)


def kept_variants(a: Prepared, b: Prepared | None, thresholds: list[float]) -> DataFrame:
    """variant_key, maf_threshold of variants that pass the global rule on the pooled ALL cohort; private ones on site B's counts over the pooled size."""
    n = a.cohort_size + (b.cohort_size if b else 0)
    if b is None:
        pooled = a.counts.select("variant_key", "ac")
    else:
        pooled = variants.pooled_counts(a.counts.unionByName(b.counts), b.gene_variants)
    spark = a.counts.sparkSession
    t = spark.createDataFrame([(t,) for t in thresholds], "maf_threshold double")
    return pooled.crossJoin(F.broadcast(t)).where(maf_keep("ac", F.lit(n), F.col("maf_threshold"))).select("variant_key", "maf_threshold")


def input_rules(a: Prepared, b: Prepared | None, covariates: int | None = None, phenotypes: int | None = None) -> dict[str, DataFrame]:
    """All rules for the prepared inputs of an analysis, for :func:`checks.refuse`."""
    rules = {}
    for p in (a, b) if b else (a,):
        sizes = p.samples.groupBy("ancestry").agg(F.count(F.lit(1)).alias("n"))
        summary = keep(checks.call_summary(p.calls), "call-summary")  # several rules read it
        rules |= checks.site_rules(p.site, summary, sizes, p.counts, p.cohort_size, p.gene_variants)
    people = a.samples if b is None else a.samples.unionByName(b.samples)
    rules |= checks.sample_rules(people, covariates, phenotypes)
    return rules | (checks.pair_rules(a.gene_variants, b.gene_variants) if b else {})


def run_association(a: Prepared, b: Prepared | None, thresholds: list[float], phenotypes: list[str], covariates: int, widest: int | None = None, probes: int | None = None, spectrum: bool = True) -> DataFrame:
    """One row for each ancestry, threshold, gene and phenotype: statistics and Burden, SKAT-WH, SKAT-Liu and SKAT-Davies p-values.

    ``b`` null analyses site A alone. Malformed inputs are refused (:func:`input_rules`, one job). Genes without kept variants are there with p = 1 and convergence null; a p-value that could not be computed is null.
    Genes of more than ``widest`` variants get all but the Davies p-value, by traces that no task needs the whole kernel for (``probes``: by random probes).
    Without ``spectrum`` no gene's eigenvalues are worked out: all Davies p-values are null, and Liu's are those of the traces.
    """
    thresholds = check_thresholds(thresholds)
    for t in thresholds:
        checks.threshold_within(t, a.max_maf if b is None else None)
    checks.refuse(input_rules(a, b, covariates, len(phenotypes)))
    people = a.samples if b is None else a.samples.unionByName(b.samples)
    calls = a.calls if b is None else assoc.pool_sites(a.calls.drop("site"), b.calls.drop("site"))
    calls = calls.select("ancestry", "chrom", "gene_id", "sample_id", "variant_key", clip_missing("dosage").alias("dosage"))
    kept = keep(kept_variants(a, b, thresholds), "kept")
    calls = keep(calls.join(kept.select("variant_key").distinct(), "variant_key", "left_semi"), "kept-calls")
    moments = assoc.null_model_moments(people, covariates, len(phenotypes))
    null = assoc.fit_null_model(moments)
    weighted = keep(assoc.variant_weights(assoc.gene_moments(calls, people, covariates, len(phenotypes)), null), "gene-moments")
    pairs = assoc.minor_pairs(calls, weighted, null)
    stats = assoc.score_statistics(weighted, null, kept)
    key = ["ancestry", "maf_threshold", "chrom", "gene_id"]
    if spectrum:
        pairs, stats = keep(pairs, "minor-pairs"), keep(stats, "score-statistics")
        t = keep(assoc.skat_pvalues(stats.join(assoc.gene_kernels(weighted, pairs, null, kept, widest, probes), key)), "p-values")
        # statistics so far out that the moments don't give their tails: more moments, and where these don't either, eigenvalues
        for way in ({"reach": 40}, {"solved_below": None}):
            unsolved = t.where("traced and p_skat_davies is null and q_skat is not null").select(*assoc.GENE).distinct()
            if not unsolved.limit(1).count():
                break
            solved = assoc.gene_kernels(weighted.join(unsolved, assoc.GENE, "left_semi"), pairs.join(unsolved, assoc.GENE, "left_semi"), null, kept, **way)
            t = keep(t.join(unsolved, assoc.GENE, "left_anti").unionByName(assoc.skat_pvalues(stats.join(solved, key))), "p-values")
        t = t.drop("traced")
    else:
        t = assoc.skat_pvalues(stats.join(assoc.gene_kernels(weighted, pairs, null, kept, widest, probes, spectrum=False), key)).drop("traced")
    z = wilson_hilferty_z(F.col("q_skat"), F.col("s1"), F.col("s2"), F.col("s3"))
    t = t.withColumn("p_burden", burden_p("q_burden", "v_burden")).withColumn("p_skat_wh", normal_sf(z))
    spark = a.counts.sparkSession
    names = spark.createDataFrame([(i, p) for i, p in enumerate(phenotypes)], "phenotype_index int, phenotype_name string")
    cells = null.select("ancestry").crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in thresholds], "maf_threshold double"))).crossJoin(F.broadcast(names))
    genes = variants.gene_index(a.gene_variants.select("chrom", "gene_id", "order_index").distinct())
    full = genes.crossJoin(F.broadcast(cells)).join(t, [*key, "phenotype_index"], "left")
    one = lambda c: F.when(F.col("variants").isNull(), 1.0).otherwise(F.col(c)).alias(c)
    return full.select(
        "ancestry", "maf_threshold", "chrom", "gene_index", "gene_id", "phenotype_index", "phenotype_name", F.coalesce("variants", F.lit(0)).alias("variants"),
        "q_burden", "v_burden", "q_skat", "s1", "s2", "s3", one("p_burden"), one("p_skat_wh"), one("p_skat_liu"), one("p_skat_davies"), "davies_converged",
    )


def resource_stats(a: Prepared, b: Prepared, thresholds: list[float], carriers: list[int], bins: list[int], annotation: str = "all", gene_set: str = "all") -> DataFrame:
    """The eleven-column table of panels A (carrier coverage), B (cumulative counts) and C (variant overlap) by ancestry, threshold and chromosome.

    Malformed inputs are refused (:func:`input_rules`, one job). A call is dealt once, with the strata of its sample, whatever their number; a call that is there twice counts once.
    """
    thresholds = check_thresholds(thresholds)
    checks.refuse(input_rules(a, b))

    def once(p: Prepared, site: str) -> DataFrame:
        calls = p.calls.where(F.col("ancestry") == F.col("strata")[0]) if "strata" in p.calls.columns else p.calls.withColumn("strata", F.array("ancestry"))
        return calls.select("strata", F.lit(site).alias("site"), "sample_id", "variant_key", clip_missing("dosage").alias("dosage"), "called")

    people = a.samples.unionByName(b.samples)
    sizes = keep(people.groupBy("ancestry", "site").agg(F.count(F.lit(1)).alias("n")), "sizes")
    calls = once(a, "A").unionByName(once(b, "B"))
    at = lambda p: p.gene_variants.where("variant_key is not null").select("chrom", "variant_key").distinct()
    has_b = b.gene_variants.where("variant_key is not null and role != 'public_only'").select("chrom", "variant_key").distinct()
    has = at(a).withColumn("site", F.lit("A")).unionByName(has_b.withColumn("site", F.lit("B")))
    strata = a.samples.select("ancestry").unionByName(b.samples.select("ancestry")).distinct()
    single = dealt(calls, calls.count(), "variant_key").distinct()  # dealt by variant for that and both sums
    sums = single.groupBy("strata", "site", "variant_key").agg(F.sum(F.when(F.col("called"), F.col("dosage").cast("long"))).alias("ac"), F.count_if(~F.col("called")).alias("missing"))
    sums = sums.select(F.explode("strata").alias("ancestry"), "site", "variant_key", "ac", "missing").groupBy("ancestry", "site", "variant_key").agg(F.sum("ac").alias("ac"), F.sum("missing").alias("missing"))
    site_counts = has.join(sizes, "site").join(sums, ["ancestry", "site", "variant_key"], "left")
    site_counts = site_counts.select("ancestry", "chrom", "site", "variant_key", F.coalesce("ac", F.lit(0)).alias("ac"), (F.col("n") - F.coalesce("missing", F.lit(0))).alias("called"))
    kept = kept_variants(a, b, thresholds)
    minor = keep(resource.variant_minor(site_counts, sizes, kept), "minor")
    both = a.gene_variants.select("chrom", "gene_id", "variant_key").unionByName(b.gene_variants.select("chrom", "gene_id", "variant_key")).where("variant_key is not null").distinct()
    cells = strata.crossJoin(a.counts.sparkSession.createDataFrame([(t,) for t in thresholds], "maf_threshold double"))
    genes = a.gene_variants.select("chrom", "gene_id").distinct()
    by_gene = keep(resource.by_gene(genes, cells, resource.carrier_counts(calls, minor, both, sizes, thresholds), resource.cumulative_mac(minor, both)), "by-gene")
    out = resource.carrier_coverage(by_gene, carriers).unionByName(resource.cmac_histogram(by_gene, bins)).unionByName(resource.variant_overlap(minor, both, cells, genes))
    return out.select(
        "ancestry", "maf_threshold", F.lit(annotation).alias("annotation"), F.col("chrom").alias("chromosome"), F.lit(gene_set).alias("gene_set"),
        "panel", "series", "lower", "upper", F.col("count").cast("long").alias("count"), F.lit("released").alias("status"),
    )


def compare_results(left: DataFrame, right: DataFrame, a: str, b: str, flag: str | None = None) -> dict[str, DataFrame]:
    """joined (with error), rollup, worst, summary, hits, labels and, with a convergence flag, convergence of two result tables (ancestry among the keys)."""
    keys = ["ancestry", *compare.RESULT_KEY]
    joined = compare.match_results(left, right, keys).withColumn("error", F.abs(F.col(a).try_cast("double") - F.col(b).try_cast("double")))
    rollup = compare.accuracy_rollup(joined, a, b)
    out = {
        "joined": joined, "rollup": rollup, "worst": compare.worst_stratum(rollup.where("chromosome is not null"), ["ancestry"], ["phenotype_index", "phenotype_name", "chromosome", "n"]),
        "summary": compare.pvalue_summary(joined, [a, b], ["ancestry"]), "hits": compare.bonferroni_hits(joined, b), "labels": compare.label_genes(joined, a, b),
    }
    if flag:
        out["convergence"] = compare.convergence_split(joined, a, b, flag, ["ancestry"])
    return out


def build_annotations(consequences: DataFrame, site_variants: DataFrame, keep_keys: DataFrame | None = None) -> dict[str, DataFrame]:
    """annotations, genes and summary from transcript consequences (chrom, pos, ref, alt, gene_id, gene_symbol, mane, lof, ord)."""
    wanted = variants.biallelic_variants(variants.pass_variants(site_variants))
    if keep_keys is not None:
        wanted = wanted.join(keep_keys, "variant_key", "left_semi")
    rows = consequences.drop("variant_key").join(wanted.select("variant_key", "chrom", "pos", "ref", "alt"), ["chrom", "pos", "ref", "alt"]).where(variants.named("gene_id"))
    ranked = keep(variants.ranked_consequences(rows), "consequences")
    good = ranked.where("mane and lof = 'HC'").join(wanted.select("variant_key", "chrom", "pos", "ord"), "variant_key")
    return {"annotations": good.select("variant_key", "gene_id", "gene_symbol"), "genes": variants.gene_panel_from_annotations(good), "summary": variants.annotation_summary(ranked)}


def split_cohort(inputs: SiteInputs, ancestries: list[str], shared_rate: float, n: int | str = "all", seed: int = 1) -> dict[str, SiteInputs]:
    """An artificial pair of sites: samples alternate, and each site hides the variants of the other's role."""
    labelled = inputs.samples.join(inputs.ancestries, "sample_id", "left")
    party = keep(samples.split_samples(labelled), "split")
    out = {}
    for k, site in enumerate("AB"):
        own = party.where(F.col("party") == k)
        if ALL not in ancestries:  # a site's ALL is then the union of the chosen groups
            own = own.where(F.col("ancestry").isin(ancestries))
        if n != "all":
            own = ranked(own, ["ancestry"], [samples.draw_key(seed, "sample_id"), "sample_id"], "rank_").where(F.col("rank_") < int(n)).drop("rank_")
        seen = variants.hide_role(inputs.variants, site, shared_rate)
        chosen = inputs.samples.join(own.select("sample_id"), "sample_id", "left_semi")
        calls = inputs.calls.join(chosen.select("sample_id"), "sample_id", "left_semi").join(seen.select("variant_key"), "variant_key", "left_semi").withColumn("site", F.lit(site))
        out[site] = SiteInputs(chosen, seen, calls, inputs.genes, inputs.annotations, inputs.phenotypes, inputs.covariates, inputs.ancestries)
    return out


def _gram(t: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X of the array columns side by side, a row of X for each row: summed within each batch, then by cell."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in columns], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["cell", "x"])

    cells = t.select(*columns).mapInArrow(part, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow().sort_by("cell")
    x = cells.column("x").to_numpy()
    return x.reshape(math.isqrt(len(x)), -1)


def _combined(v: str, m: np.ndarray) -> Column:
    """The array column ``v`` times a small matrix."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in m[:, j])) for j in range(m.shape[1])))
    return F.transform(rows, lambda c: F.aggregate(F.zip_with(v, c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def _independent(gram: np.ndarray) -> np.ndarray:
    """M such that X M is orthonormal, for X with this Gram matrix; dependent directions are left out."""
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    ok = value > max(1e-10 * value.max(), 1e-14)
    return vector[:, ok] / np.sqrt(value[ok])


def genotype_pca(dosages: DataFrame, sample_table: DataFrame, k: int = 16, spare: int = 8, passes: int = 40, tolerance: float = 1e-4, blocks: int = 6, report: dict | None = None) -> DataFrame:
    """sample_id, PC1.. of standardised dosages (sparse rows sample_id, variant_key, dosage); components are unit vectors, signs are arbitrary.

    Block Krylov iteration (Golub and Underwood): a pass joins the newest ``k + spare`` basis vectors with the dosages, sums by variant, joins back and
    sums by sample; the product is made orthogonal to the whole basis, which stands as one array for each sample. Only matrices of the
    basis' width come to the driver, whatever the number of samples. Ritz vectors have the residual ||A u - value u|| in the part of the product that the basis doesn't
    hold, and the iteration ends when the ``k`` largest have one under the share ``tolerance`` of the largest value. After ``blocks``
    blocks it starts anew from the best vectors. ``report`` gets passes, values, residuals and trace (of A).
    """
    people = sample_table.select("sample_id").distinct()
    n = people.count()
    width = min(n, k + spare)
    d = dosages.where("dosage > 0").select("sample_id", "variant_key", F.col("dosage").cast("double").alias("g"))
    stats = d.groupBy("variant_key").agg((F.sum("g") / F.lit(2.0 * n)).alias("f")).where("f > 0 and f < 1")
    d = keep(d.join(stats, "variant_key").select("sample_id", "variant_key", "f", (F.col("g") / F.sqrt(2 * F.col("f") * (1 - F.col("f")))).alias("g")), "standardised")
    mean = 2 * F.col("f") / F.sqrt(2 * F.col("f") * (1 - F.col("f")))
    trace = d.groupBy("variant_key").agg(F.sum(F.col("g") * F.col("g")).alias("gg"), F.sum("g").alias("g"), F.first("f").alias("f")).agg(F.sum(F.col("gg") - 2 * mean * F.col("g") + n * mean * mean)).first()[0]
    start = F.array(*((F.xxhash64("sample_id", F.lit(i)) / F.lit(float(1 << 63))) for i in range(width)))
    t = keep(people.select("sample_id", start.alias("v")), "pca-basis")
    t = keep(t.select("sample_id", _combined("v", _independent(_gram(t, ["v"]))).alias("v")), "pca-basis")
    newest, size, done = width, width, 0

    def product(t: DataFrame, size: int, newest: int) -> DataFrame:
        """sample_id, v, w: A times the newest basis vectors."""
        q = [f"q{i}" for i in range(newest)]
        own = t.select("sample_id", *(F.col("v")[size - newest + i].alias(c) for i, c in enumerate(q)))
        total = own.agg(*(F.sum(c).alias(c) for c in q)).first()
        by_variant = d.join(own, "sample_id").groupBy("variant_key").agg(F.first("f").alias("f"), *(F.sum(F.col("g") * F.col(c)).alias(c) for c in q))
        by_variant = keep(by_variant.select("variant_key", mean.alias("m"), *((F.col(c) - mean * F.lit(float(total[c]))).alias(c) for c in q)), "pca-variants")
        shift = by_variant.agg(*(F.coalesce(F.sum(F.col("m") * F.col(c)), F.lit(0.0)).alias(c) for c in q)).first()
        sums = d.select("sample_id", "variant_key", "g").join(by_variant, "variant_key").groupBy("sample_id").agg(*(F.sum(F.col("g") * F.col(c)).alias(c) for c in q))
        w = F.array(*(F.coalesce(c, F.lit(0.0)) - F.lit(float(shift[c])) for c in q))
        return t.join(sums, "sample_id", "left").select("sample_id", "v", w.alias("w"))

    small = np.zeros((0, 0))  # V'AV of the blocks whose product is known
    while True:
        t = keep(product(t, size, newest), "pca-product")
        done += 1
        gram = _gram(t, ["v", "w"])
        inside = gram[:size, size:]
        grown = np.zeros((size, size))
        grown[: len(small), : len(small)] = small
        grown[:, size - newest :] = inside
        grown[size - newest :, :] = inside.T
        small = (grown + grown.T) / 2
        # what the basis doesn't hold of the product, made orthogonal twice since the first time leaves rounding errors
        t = keep(t.select("sample_id", "v", F.zip_with("w", _combined("v", inside), lambda a, b: a - b).alias("w")), "pca-product")
        again = _gram(t, ["v", "w"])
        rest = again[size:, size:] - again[:size, size:].T @ again[:size, size:]
        value, vector = np.linalg.eigh(small)
        order = np.argsort(-value)[: min(k, size)]
        values, ritz = value[order], vector[:, order]
        tail = ritz[size - newest :]
        residuals = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", tail, rest, tail), 0))
        grown_scale = float(np.trace(rest)) > 1e-20 * max(float(np.abs(values).max(initial=0.0)), 1e-300) ** 2
        if residuals.max(initial=0.0) <= tolerance * max(float(values.max(initial=0.0)), 1e-300) or not grown_scale or done >= passes or size >= n:
            break
        if size + newest > blocks * width:  # start anew from the best vectors, of which all products are then unknown
            best = vector[:, np.argsort(-value)[:width]]
            t, size, newest, small = keep(t.select("sample_id", _combined("v", best).alias("v")), "pca-basis"), width, width, np.zeros((0, 0))
            continue
        more = _independent(rest)
        t = t.select("sample_id", "v", F.zip_with("w", _combined("v", again[:size, size:]), lambda a, b: a - b).alias("w"))
        t = keep(t.select("sample_id", F.concat("v", _combined("w", more)).alias("v")), "pca-basis")
        newest, size = more.shape[1], size + more.shape[1]
    if report is not None:
        report |= {"passes": done, "values": values.tolist(), "residuals": residuals.tolist(), "trace": float(trace)}
    u = t.select("sample_id", _combined("v", ritz).alias("u"))
    return u.select("sample_id", *(F.col("u")[i].alias(f"PC{i + 1}") for i in range(ritz.shape[1])))


def public_cohort_inputs(vcf_calls: DataFrame, vcf_variants: DataFrame, sample_table: DataFrame, intervals: DataFrame, panel: DataFrame, phenotype_names: list[str], k: int = 10, seed: int = 1) -> dict[str, DataFrame]:
    """Inputs for a public cohort: thinned annotations, a gene panel, components with ancestries, and simulated phenotypes."""
    n = sample_table.count()
    hits = variants.variant_gene_overlap(vcf_variants, intervals)
    annotations = variants.thin_blocks(hits.select("chrom", "variant_key", "gene_id", "gene_symbol", "ord"), ["ord", "gene_id"], seed=seed).select("variant_key", "gene_id", "gene_symbol")
    counts = vcf_calls.groupBy("variant_key").agg(F.sum("dosage").alias("ac"), F.count_if(~F.col("called")).alias("missing"))
    common = vcf_variants.join(counts, "variant_key").select("chrom", "variant_key", "pos", "ord", "ac", F.lit(n).alias("n"), (F.lit(n) - F.col("missing")).alias("called"))
    common = keep(variants.genotype_filter(common), "common")
    dosages = vcf_calls.join(common.select("chrom", "variant_key", "pos"), "variant_key").select("chrom", "variant_key", "pos", "sample_id", "dosage")
    pairs = keep(variants.window_ld_pairs(dosages, n), "ld-pairs")
    maf = common.select("chrom", "variant_key", "pos", (F.least(F.col("ac"), 2 * F.col("n") - F.col("ac")) / (2 * F.col("n"))).alias("maf"))
    pruned = variants.ld_prune(maf, pairs)
    pcs = genotype_pca(dosages.join(pruned.select("variant_key"), "variant_key", "left_semi"), sample_table, k)
    return {
        "annotations": annotations, "genes": intervals.select("gene_id", "gene_symbol", "chrom", "order_index"),
        "ancestries": samples.ancestry_pc_table(panel, pcs, min(k, len(pcs.columns) - 1)), "phenotypes": samples.simulate_phenotypes(sample_table, phenotype_names, seed),
    }
