"""Variants and genes: filters, gene groups, site roles, allele counts, positions in genes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PRIVATE, PUBLIC_ONLY, SHARED, canonical_variant_key, clip_missing, local_maf_keep, minor_allele_frequency, split_role, variant_id, variant_key_parts
from ..tables import keep
from .checks import repeated_keys, violations
from .ranks import ranked
from .samples import draw_key


def pass_variants(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("filter").isin("PASS", "."))


def biallelic_variants(variants: DataFrame) -> DataFrame:
    return variants.where(~F.col("alt").contains(","))


def keep_variants(df: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of ``df`` whose variant_key ``keep`` has."""
    return df.join(keep.select("variant_key").distinct(), "variant_key", "left_semi")


def set_variant_ids(variants: DataFrame) -> DataFrame:
    return variants.withColumn("variant_key", variant_id("chrom", "pos", "ref", "alt"))


def invalid_dosages(calls: DataFrame, strict: bool = False) -> DataFrame:
    """Calls whose dosage is none of -9, 0, 1, 2."""
    return violations(calls.where(F.coalesce(~F.col("dosage").isin(-9, 0, 1, 2), F.lit(True))), "dosage not in -9, 0, 1, 2", strict)


def key_problems(variants: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``variants`` (chrom, pos, ref, alt: one or more with commas, variant_key) that ``wanted`` (variant_key) asks for, by canonical key, with
    allele_index, the place from 1 of the ALT that the key names, and reason, null where the key fits its row.

    A key fits if it has four parts, the row's chromosome, position and REF, names exactly one of its ALTs, and no other row has it.
    """
    keys = wanted.select(canonical_variant_key("variant_key").alias("variant_key")).distinct()
    t = variants.withColumn("variant_key", canonical_variant_key("variant_key")).join(keys, "variant_key", "left_semi")
    repeated = t.groupBy("variant_key").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    p, alts = variant_key_parts("variant_key"), F.split("alt", ",")
    plain = lambda c: F.regexp_replace(c, "^chr", "")
    named_alts = F.size(F.filter(alts, lambda a: a == p[3]))
    at = F.coalesce((F.size(p) == 4) & (plain(p[0]) == plain(F.col("chrom"))) & (p[1] == F.col("pos").cast("string")), F.lit(False))
    reason = F.when(~at, "coordinates").when(F.coalesce(p[2] != F.col("ref"), F.lit(True)), "ref").when(F.coalesce(named_alts != 1, F.lit(True)), "alt").when(F.col("n_").isNotNull(), "repeated")
    t = t.join(repeated, "variant_key", "left")
    return t.withColumns({"reason": reason, "allele_index": F.when(reason.isNull(), F.array_position(alts, p[3]).cast("int"))}).drop("n_")


def requested_variants(variants: DataFrame, wanted: DataFrame) -> DataFrame:
    """:func:`key_problems` without reason, refused if any key has one."""
    t = key_problems(variants, wanted)
    violations(t.where("reason is not null").select("variant_key", "reason"), "keys that don't fit their rows", strict=True)
    return t.drop("reason")


def hide_role(variants: DataFrame, site: str, shared_rate: float) -> DataFrame:
    """What a site of the artificial split sees: A no private variants, B no public-only ones."""
    return variants.where(split_role("variant_key", shared_rate) != (PRIVATE if site == "A" else PUBLIC_ONLY))


def dedup_first(variants: DataFrame, key: str = "variant_key", order: str | Column = "ord") -> DataFrame:
    """The first row of each key."""
    return variants.withColumn("rank_", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("rank_ = 1").drop("rank_")


def gene_index(genes: DataFrame) -> DataFrame:
    """``genes`` with gene_index, the zero-based place in the chromosome by panel order."""
    return genes.withColumn("gene_index", F.row_number().over(Window.partitionBy("chrom").orderBy("order_index", "gene_id")) - 1)


def column_index(gene_variants: DataFrame) -> DataFrame:
    """``gene_variants`` with col_index, the zero-based column in the gene by variant order."""
    return gene_variants.withColumn("col_index", F.row_number().over(Window.partitionBy("chrom", "gene_id").orderBy("ord", "variant_key")) - 1)


def gene_variants(genes: DataFrame, variants: DataFrame, annotations: DataFrame, allowed: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """chrom, gene_id, order_index, variant_key, pos, ord, col_index of PASS variants by gene; genes without any have one row with nulls.

    A variant may be in many genes; an annotation repeated for a gene and variant is an error.
    """
    repeated_keys(annotations, ["gene_id", "variant_key"], strict)
    v = pass_variants(variants)
    if allowed is not None:
        v = v.join(allowed.select("variant_key").distinct(), "variant_key", "left_semi")
    hits = annotations.select("gene_id", "variant_key").join(v.select("variant_key", "chrom", "pos", "ord"), "variant_key")
    hits = column_index(hits)
    return genes.select("chrom", "gene_id", "order_index").join(hits, ["chrom", "gene_id"], "left")


def extract_calls(calls: DataFrame, samples: DataFrame, gene_variants: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """Calls of exactly the wanted samples and variants, one for each gene of the variant.

    With ``available`` every wanted variant must be among these keys.
    """
    if available is not None:
        wanted = gene_variants.where("variant_key is not null").select("variant_key").distinct()
        violations(wanted.join(available, "variant_key", "left_anti"), "variants that the site doesn't have", strict=True)
    return in_genes(calls.join(samples.select("sample_id", *(c for c in ("ancestry",) if c in samples.columns)), "sample_id"), gene_variants)


def in_genes(calls: DataFrame, gene_variants: DataFrame) -> DataFrame:
    """``calls`` of the genes' variants, one for each gene of the variant."""
    wanted = gene_variants.where("variant_key is not null").select("chrom", "gene_id", "variant_key", "col_index", *(c for c in ("role",) if c in gene_variants.columns))
    return calls.join(wanted, "variant_key")


def site_roles_a(public: DataFrame) -> DataFrame:
    """Site A publishes its list: there every variant is public only."""
    return public.withColumn("role", F.when(F.col("variant_key").isNotNull(), PUBLIC_ONLY))


def site_roles_b(public: DataFrame, available: DataFrame, local: DataFrame) -> DataFrame:
    """chrom, gene_id, variant_key, role at site B.

    Public variants are shared where B has them, else public_only; B's own gene variants that are public in no gene are private.
    """
    have = available.select("variant_key").distinct().withColumn("have_", F.lit(True))
    pub = public.where("variant_key is not null").select("chrom", "gene_id", "variant_key")
    roles = pub.join(have, "variant_key", "left").withColumn("role", F.when(F.col("have_"), SHARED).otherwise(PUBLIC_ONLY)).drop("have_")
    own = local.where("variant_key is not null").select("chrom", "gene_id", "variant_key").join(pub.select("variant_key").distinct(), "variant_key", "left_anti")
    return roles.select("chrom", "gene_id", "variant_key", "role").unionByName(own.select("chrom", "gene_id", "variant_key", F.lit(PRIVATE).alias("role")))


def random_roles(gene_variants: DataFrame, rate: float, seed: int) -> DataFrame:
    """``gene_variants`` with a role drawn within each gene: round(rn) shared, round((1-r)/2 n) public only, the rest private; halves round to even."""
    rank = F.row_number().over(Window.partitionBy("chrom", "gene_id").orderBy(draw_key(seed, "variant_key"), "variant_key"))
    n = F.count("variant_key").over(Window.partitionBy("chrom", "gene_id"))
    shared, public = F.bround(rate * n), F.bround((1 - rate) / 2 * n)
    t = gene_variants.where("variant_key is not null").withColumn("rank_", rank).withColumn("role", F.when(F.col("rank_") <= shared, SHARED).when(F.col("rank_") <= shared + public, PUBLIC_ONLY).otherwise(PRIVATE))
    return t.drop("rank_")


def one_role_each(roles: DataFrame) -> DataFrame:
    """variant_key and the role it has in the first of its genes (by order_index, gene_id)."""
    return roles.groupBy("variant_key").agg(F.min_by("role", F.struct("order_index", "gene_id")).alias("role"))


def allele_counts(calls: DataFrame, present: DataFrame, cohort: DataFrame) -> DataFrame:
    """site, variant_key, ac over the cohort; missing calls count 0, and variants without carriers are there with 0.

    ``present`` has the (site, variant_key) that count, ``cohort`` the (site, sample_id).
    """
    return cohort_counts(calls.join(cohort.select("site", "sample_id"), ["site", "sample_id"], "left_semi"), present)


def cohort_counts(calls: DataFrame, present: DataFrame) -> DataFrame:
    """:func:`allele_counts` of calls that are all of the cohort."""
    sums = calls.groupBy("site", "variant_key").agg(F.sum(clip_missing("dosage").cast("long")).alias("ac"))
    return present.select("site", "variant_key").join(sums, ["site", "variant_key"], "left").select("site", "variant_key", F.coalesce("ac", F.lit(0)).cast("long").alias("ac"))


def called_counts(calls: DataFrame, sizes: DataFrame, present: DataFrame) -> DataFrame:
    """site, variant_key, called: samples less the missing calls; 0 where the site doesn't have the variant is for the caller's join."""
    missing = calls.groupBy("site", "variant_key").agg(F.count_if(~F.col("called")).alias("missing"))
    t = present.select("site", "variant_key").join(sizes, "site").join(missing, ["site", "variant_key"], "left")
    return t.select("site", "variant_key", (F.col("n") - F.coalesce("missing", F.lit(0))).cast("long").alias("called"))


def pooled_counts(counts: DataFrame, roles: DataFrame) -> DataFrame:
    """variant_key, ac of both sites; for private variants of site B alone."""
    private = roles.where(F.col("role") == PRIVATE).select("variant_key").distinct().withColumn("private_", F.lit(True))
    t = counts.join(private, "variant_key", "left").where(F.col("private_").isNull() | (F.col("site") == "B"))
    return t.groupBy("variant_key").agg(F.sum("ac").alias("ac"))


def variant_qc(calls: DataFrame, sizes: DataFrame, present: DataFrame, most_missing: float = 0.15) -> DataFrame:
    """site, variant_key, n, missing_rate, mean (of the called), sd (ddof 1, after putting the mean for missing), keep."""
    s = calls.groupBy("site", "variant_key").agg(
        F.sum(F.when(F.col("called"), F.col("dosage").cast("long"))).alias("s1"), F.sum(F.when(F.col("called"), F.col("dosage").cast("long") * F.col("dosage"))).alias("s2"), F.count_if(~F.col("called")).alias("missing")
    )
    t = present.join(sizes, "site").join(s, ["site", "variant_key"], "left").select("site", "variant_key", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("s1", "s2", "missing")))
    called = F.col("n") - F.col("missing")
    mean = F.when(called > 0, F.col("s1") / called).otherwise(0.0)
    sd = F.sqrt(F.greatest(F.col("s2") - F.col("s1") * mean, F.lit(0.0)) / (F.col("n") - 1))
    t = t.select("site", "variant_key", "n", (F.col("missing") / F.col("n")).alias("missing_rate"), mean.alias("mean"), sd.alias("sd"))
    return t.withColumn("keep", (F.col("missing_rate") < most_missing) & (F.col("sd") > 0))


def genotype_filter(counts: DataFrame, least_maf: float = 0.05, most_missing: float = 0.02) -> DataFrame:
    """Common, well-called variants (ac, n, called given), the first row of each key."""
    ok = (minor_allele_frequency("ac", "n") >= least_maf) & ((F.col("n") - F.col("called")) / F.col("n") <= most_missing)
    return dedup_first(counts.where(ok))


def local_cut_variants(candidates: DataFrame, counts: DataFrame, n: int, threshold: float | None) -> DataFrame:
    """Candidate keys that have counts but don't pass the local MAF rule."""
    counted = counts.join(candidates.select("variant_key").distinct(), "variant_key", "left_semi")
    passing = counted.where(local_maf_keep("ac", F.lit(n), threshold)).select("variant_key")
    return counted.select("variant_key").distinct().join(passing, "variant_key", "left_anti")


def minus_cut_list(variants: DataFrame, cut: DataFrame) -> DataFrame:
    return variants.join(cut.select("variant_key").distinct(), "variant_key", "left_anti")


def countable_keys(present: DataFrame, *candidates: DataFrame) -> DataFrame:
    """The keys of any candidate table that are present."""
    keys = candidates[0].select("variant_key")
    for c in candidates[1:]:
        keys = keys.unionByName(c.select("variant_key"))
    return keys.where("variant_key is not null").distinct().join(present.select("variant_key").distinct(), "variant_key", "left_semi")


def block_sizes(roles: DataFrame) -> DataFrame:
    """chrom, gene_id, public, private columns of each gene."""
    return roles.groupBy("chrom", "gene_id").agg(F.count_if(F.col("role") != PRIVATE).alias("public"), F.count_if(F.col("role") == PRIVATE).alias("private"))


def overlap_summary(roles: DataFrame) -> DataFrame:
    """chrom, public_cols, shared, public_only, private: gene-variant pairs, a variant once in each of its genes."""
    return roles.groupBy("chrom").agg(
        F.count_if(F.col("role") != PRIVATE).alias("public_cols"), *(F.count_if(F.col("role") == r).alias(r) for r in (SHARED, PUBLIC_ONLY, PRIVATE))
    )


def sample_genes(groups: DataFrame, k: int, seed: int) -> DataFrame:
    """k random genes per chromosome among those with variants (all, if fewer); a chromosome without any is an error."""
    full = groups.where("variant_key is not null").select("chrom", "gene_id", "order_index").distinct()
    violations(groups.select("chrom").distinct().join(full.select("chrom").distinct(), "chrom", "left_anti"), "no gene with variants", strict=True)
    rank = F.row_number().over(Window.partitionBy("chrom").orderBy(draw_key(seed, "gene_id"), "gene_id"))
    return full.withColumn("rank_", rank).where(F.col("rank_") <= k).drop("rank_")


def select_genes(panel: DataFrame, requested: list[str]) -> DataFrame:
    """The requested genes of the panel; repeated or unknown ones are an error."""
    if len(set(requested)) != len(requested):
        raise ValueError("a gene is requested twice")
    want = panel.sparkSession.createDataFrame([(g,) for g in requested], "gene_id string")
    violations(want.join(panel, "gene_id", "left_anti"), "genes that are not in the panel", strict=True)
    return panel.join(want, "gene_id", "left_semi")


def variant_gene_overlap(variants: DataFrame, intervals: DataFrame, bin_width: int = 100_000) -> DataFrame:
    """variant_key, pos, chrom, gene_id, gene_symbol where start <= pos <= end; genes may overlap.

    An equi-join on position bins: a gene is in every bin it touches, a variant in one.
    """
    g = intervals.withColumn("bin", F.explode(F.expr(f"sequence(start div {bin_width}, end div {bin_width})")))
    v = variants.withColumn("bin", F.expr(f"pos div {bin_width}"))
    return v.join(g.select("chrom", "bin", "start", "end", "gene_id", "gene_symbol"), ["chrom", "bin"]).where("pos between start and end").drop("bin", "start", "end")


def thin_blocks(pairs: DataFrame, order: list[str], block: int = 100, seed: int = 0) -> DataFrame:
    """One random pair of each complete run of ``block`` pairs in order, by chromosome; the last, incomplete run gives none."""
    t = ranked(pairs, ["chrom"], order, "rank_").withColumn("block", F.floor(F.col("rank_") / block))
    cols = [c for c in pairs.columns if c != "chrom"]
    key = draw_key(seed, "variant_key", "gene_id")
    return t.groupBy("chrom", "block").agg(F.min_by(F.struct(*cols), key).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") == block).select("chrom", "block", "r.*")


def annotate_variants(source: DataFrame, variants: DataFrame, strict: bool = True) -> DataFrame:
    """variant_key, gene_id, gene_symbol: source rows (pos, ref, alt, gene_id, gene_symbol) under the variants' own keys; blank genes and "." go."""
    out = source.where(named("gene_id")).join(variants.select("variant_key", "pos", "ref", "alt"), ["pos", "ref", "alt"])
    if strict and out.limit(1).count() == 0:
        raise ValueError("no annotation matched a variant")
    return out.select("variant_key", "gene_id", "gene_symbol").distinct()


def gene_panel_from_annotations(annotations: DataFrame) -> DataFrame:
    """gene_id, gene_symbol (of the smallest position, first in order), chrom, order_index by (least position, gene_id).

    ``annotations``: chrom, gene_id, gene_symbol, pos, ord.
    """
    g = annotations.groupBy("chrom", "gene_id").agg(F.min_by("gene_symbol", F.struct("pos", "ord")).alias("gene_symbol"), F.min("pos").alias("pos"))
    return g.select("gene_id", "gene_symbol", "chrom", (F.row_number().over(Window.partitionBy("chrom").orderBy("pos", "gene_id")) - 1).alias("order_index"))


def named(column: str) -> Column:
    """True where a text is there; consequence tables write missing ones as blanks or as one full stop."""
    return F.coalesce(~F.trim(column).isin("", "."), F.lit(False))


def ranked_consequences(rows: DataFrame) -> DataFrame:
    """variant_key, gene_id, n_rows, mane, lof: per variant and gene its first row with a MANE transcript (null without; "." is none)."""
    first = F.min_by(F.struct("lof", "gene_symbol"), F.when(F.col("has_mane"), F.col("ord")))
    return rows.withColumn("has_mane", named("mane")).groupBy("variant_key", "gene_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("has_mane").alias("mane"), first.alias("f")
    ).select("variant_key", "gene_id", "n_rows", "mane", F.col("f.lof").alias("lof"), F.col("f.gene_symbol").alias("gene_symbol"))


def first_consequence(rows: DataFrame) -> DataFrame:
    """variant_key, gene_id, gene_symbol of pairs whose first MANE row is a high-confidence loss of function; later rows don't count."""
    return ranked_consequences(rows).where("mane and lof = 'HC'").select("variant_key", "gene_id", "gene_symbol")


def annotation_summary(ranked: DataFrame) -> DataFrame:
    """One row: pairs, without_mane, mane, mane_hc, mane_not_hc, retained."""
    hc = F.coalesce(F.col("mane") & (F.col("lof") == "HC"), F.lit(False))
    return ranked.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(~F.col("mane")).alias("without_mane"), F.count_if("mane").alias("mane"),
        F.count_if(hc).alias("mane_hc"), F.count_if(F.col("mane") & ~hc).alias("mane_not_hc"), F.count_if(hc).alias("retained"),
    )


def window_ld_pairs(dosages: DataFrame, samples: int, window: int = 200, least_r2: float = 0.2) -> DataFrame:
    """chrom, a, b, r2 of variants at most ``window - 1`` ranks apart with r2 above ``least_r2``.

    ``dosages``: chrom, variant_key, pos, sample_id, dosage of carriers (absent rows are 0), over ``samples`` samples.
    """
    stats = dosages.groupBy("chrom", "variant_key", "pos").agg(F.sum("dosage").alias("s"), F.sum(F.col("dosage") * F.col("dosage")).alias("ss"))
    placed = ranked(stats, ["chrom"], ["pos", "variant_key"], "rank")
    d = dosages.join(placed.select("chrom", "variant_key", "rank", "s", "ss"), ["chrom", "variant_key"]).select("chrom", "sample_id", "rank", "variant_key", "dosage", "s", "ss").withColumn("bin", F.floor(F.col("rank") / window))
    right = d.withColumn("bin", F.explode(F.array(F.col("bin"), F.col("bin") - 1)))
    x, y = d.alias("x"), right.alias("y")
    j = x.join(y, (F.col("x.chrom") == F.col("y.chrom")) & (F.col("x.sample_id") == F.col("y.sample_id")) & (F.col("x.bin") == F.col("y.bin")) & (F.col("x.rank") < F.col("y.rank")) & (F.col("y.rank") - F.col("x.rank") < window))
    sums = j.groupBy(F.col("x.chrom").alias("chrom"), F.col("x.variant_key").alias("a"), F.col("y.variant_key").alias("b")).agg(
        F.sum(F.col("x.dosage").cast("double") * F.col("y.dosage")).alias("xy"), F.first("x.s").alias("sx"), F.first("y.s").alias("sy"), F.first("x.ss").alias("sxx"), F.first("y.ss").alias("syy")
    )
    cov = F.col("xy") - F.col("sx") * F.col("sy") / samples
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / samples, F.col("syy") - F.col("sy") * F.col("sy") / samples
    return sums.select("chrom", "a", "b", (cov * cov / (vx * vy)).alias("r2")).where(F.col("r2") > least_r2)


def ld_prune(variants: DataFrame, pairs: DataFrame) -> DataFrame:
    """``variants`` (chrom, variant_key, pos, maf) without one member of each correlated pair.

    Greedy by rounds: of every remaining pair the member of lower MAF (then later position, then later key) goes, unless it is kept by
    beating all its remaining partners; rounds end when no pair is left. Rounds are joins on the pairs alone, and each is written out.
    """
    key = F.struct((-F.col("maf")).alias("m"), "pos", "variant_key")
    order = variants.select("chrom", "variant_key", key.alias("k"))
    live = pairs.select("chrom", "a", "b").join(order.select("chrom", F.col("variant_key").alias("a"), F.col("k").alias("ka")), ["chrom", "a"]).join(order.select("chrom", F.col("variant_key").alias("b"), F.col("k").alias("kb")), ["chrom", "b"])
    live = live.select("chrom", F.when(F.col("ka") < F.col("kb"), F.col("a")).otherwise(F.col("b")).alias("w"), F.when(F.col("ka") < F.col("kb"), F.col("b")).otherwise(F.col("a")).alias("l")).distinct()
    live, gone = keep(live, "ld-live"), []
    while live.limit(1).count():
        winners = live.select("chrom", "w").distinct().join(live.select("chrom", F.col("l").alias("w")), ["chrom", "w"], "left_anti")
        losers = keep(live.join(winners, ["chrom", "w"], "left_semi").select("chrom", F.col("l").alias("variant_key")).distinct(), "ld-losers")
        gone.append(losers)
        rest = live.join(losers.withColumnRenamed("variant_key", "w"), ["chrom", "w"], "left_anti").join(losers.withColumnRenamed("variant_key", "l"), ["chrom", "l"], "left_anti")
        live = keep(rest.join(winners, ["chrom", "w"], "left_anti"), "ld-live")
    if not gone:
        return variants
    gone = reduce(DataFrame.unionByName, gone)  # a variant goes once
    return variants.join(gone, ["chrom", "variant_key"], "left_anti")
