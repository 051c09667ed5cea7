"""Column functions: variant keys, dosages, allele frequencies, missing values, p-values. Columns in, a column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing number.
MISSING_TOKENS = ["", "NA", "NaN", "nan", "."]
MISSING_DOSAGE = -9
SHARED, PUBLIC_ONLY, PRIVATE = "shared", "public_only", "private"
ALL = "ALL"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def variant_key_parts(key: Column | str) -> Column:
    """[chromosome, position, ref, alt]: split at the first three colons, since a symbolic ALT may hold more."""
    return F.split(_col(key), ":", 4)


def canonical_variant_key(key: Column | str) -> Column:
    """chr<c>:<pos>:<REF>:<ALT> with exactly one ``chr``; keys without four fields stay as they are."""
    parts = variant_key_parts(key)
    plain = F.regexp_replace(parts[0], "^chr", "")
    return F.when(F.size(parts) == 4, F.concat_ws(":", F.concat(F.lit("chr"), plain), parts[1], parts[2], parts[3])).otherwise(_col(key))


def bare_variant_key(key: Column | str) -> Column:
    """The key without its ``chr`` prefix."""
    return F.regexp_replace(_col(key), "^chr", "")


def valid_variant_key(key: Column | str, chrom: Column | str, pos: Column | str) -> Column:
    """Four nonblank parts that agree with the row's chromosome and position, and one ALT."""
    p = variant_key_parts(key)
    return (
        (F.size(p) == 4)
        & F.forall(p, lambda x: F.trim(x) != "")
        & (F.regexp_replace(p[0], "^chr", "") == F.regexp_replace(_col(chrom), "^chr", ""))
        & F.coalesce(p[1].try_cast("long") == _col(pos), F.lit(False))
        & ~p[3].contains(",")
    )


def variant_alleles(key: Column | str) -> Column:
    """struct(pos, ref, alt) of ``chr:pos:ref:alt`` or ``pos:ref:alt``; null for anything else."""
    parts = F.split(_col(key), ":", 4)
    four = parts[1].rlike("^[0-9]+$")
    make = lambda p, r, a: F.struct(p.cast("long").alias("pos"), r.alias("ref"), a.alias("alt"))
    three = F.split(_col(key), ":", 3)
    return F.when((F.size(parts) == 4) & four, make(parts[1], parts[2], parts[3])).when((F.size(three) == 3) & three[0].rlike("^[0-9]+$"), make(three[0], three[1], three[2]))


def variant_id(chrom: Column | str, pos: Column | str, ref: Column | str, alt: Column | str) -> Column:
    return F.concat_ws(":", _col(chrom), _col(pos).cast("string"), _col(ref), _col(alt))


def parse_missing(text: Column | str) -> Column:
    """A number; missing tokens become NaN, and what is no number null."""
    return F.when(_col(text).isNull() | _col(text).isin(MISSING_TOKENS), F.lit(float("nan"))).otherwise(_col(text).try_cast("double"))


def is_finite(x: Column | str) -> Column:
    return F.coalesce(~F.isnan(_col(x)) & (F.abs(_col(x)) < float("inf")), F.lit(False))


def finite_rows(values: Column | str) -> Column:
    """True where every element of an array is finite; a null array or element is not."""
    return F.coalesce(F.forall(_col(values), is_finite), F.lit(False))


def clip_missing(dosage: Column | str) -> Column:
    """Missing dosages (-9) count as 0."""
    return F.greatest(_col(dosage), F.lit(0))


def hash_fraction(key: Column | str) -> Column:
    """A key's place in [0, 1): the first 8 bytes of its SHA-256, over 2^64."""
    return F.conv(F.substring(F.sha2(_col(key), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def split_role(key: Column | str, shared_rate: float) -> Column:
    """shared, public_only or private, drawn by the key's hash; what isn't shared is halved."""
    u = hash_fraction(key)
    return F.when(u < shared_rate, SHARED).when(u < shared_rate + (1 - shared_rate) / 2, PUBLIC_ONLY).otherwise(PRIVATE)


def minor_allele_frequency(ac: Column | str, n: Column | str) -> Column:
    """Of ``ac`` ALT alleles in ``n`` samples, over 2n whatever is missing."""
    return F.least(_col(ac), 2 * _col(n) - _col(ac)) / (2 * _col(n))


def maf_keep(ac: Column | str, n: Column | str, threshold: Column | float) -> Column:
    """The global rule, in counts: ac <= floor(2nt) or ac >= ceil(2n(1-t)); 0.5 keeps all."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    two_n = 2 * _col(n)
    return (t == 0.5) | (_col(ac) <= F.floor(t * two_n)) | (_col(ac) >= F.ceil((1 - t) * two_n))


def local_maf_keep(ac: Column | str, n: Column | str, threshold: float | None) -> Column:
    """The local rule, by division; no threshold keeps all."""
    return F.lit(True) if threshold is None else minor_allele_frequency(ac, n) <= threshold


def beta_weight(maf: Column | str) -> Column:
    """Density of Beta(1, 25)."""
    return 25 * F.pow(1 - _col(maf), F.lit(24))


def alt_is_major(ac: Column | str, n: Column | str) -> Column:
    """More ALT alleles than samples; a tie keeps ALT as the minor one."""
    return _col(ac) > _col(n)


def flip_to_minor(dosage: Column | str, ac: Column | str, n: Column | str) -> Column:
    """Minor-allele dosage; null where missing."""
    return F.when(_col(dosage) < 0, None).when(alt_is_major(ac, n), 2 - _col(dosage)).otherwise(_col(dosage))


def signed_weight(ac: Column | str, n: Column | str) -> Column:
    """Beta weight of the minor allele, negative where ALT is major: stands for recoding, with an intercept in the model."""
    w = beta_weight(minor_allele_frequency(ac, n))
    return F.when(alt_is_major(ac, n), -w).otherwise(w)


def neg_log10_p(p: Column | str) -> Column:
    """-log10 of p, at least 1e-300; null for a p that is no finite number of at least 0."""
    return F.when(is_finite(p) & (_col(p) >= 0), -F.log10(F.greatest(_col(p), F.lit(1e-300))))


def abs_error(a: Column | str, b: Column | str) -> Column:
    """|a - b| of two texts or numbers; null unless both are finite numbers."""
    x, y = _col(a).try_cast("double"), _col(b).try_cast("double")
    return F.when(is_finite(x) & is_finite(y), F.abs(x - y))


def parse_attribute(text: Column | str, name: str) -> Column:
    """The value of ``name "value";`` in an attribute text; null if it isn't there."""
    return F.nullif(F.regexp_extract(_col(text), f'(?:^|;)\\s*{name} "([^"]*)"', 1), F.lit(""))


def encode_packed_covariates(values: Column | str, slots: list[int], width: int) -> Column:
    """JSON array of ``width`` slots with the values at ``slots`` (zero-based) and nulls elsewhere."""
    at = {s: i for i, s in enumerate(slots)}
    return F.to_json(F.array(*(F.get(_col(values), at[i]) if i in at else F.lit(None).cast("double") for i in range(width))))


def packed_covariate(text: Column | str, name: str) -> Column:
    """Element k-1 of a packed ``[v1,v2,...]`` text for the name PCk; null if the vector is shorter."""
    if not (name.startswith("PC") and name[2:].isdigit() and name[2] != "0"):
        raise ValueError(f"not a packed covariate: {name}")
    return F.get(F.from_json(_col(text), "array<double>"), int(name[2:]) - 1)


def normalize_chromosomes(chromosomes: list) -> list[str]:
    """["all"] or distinct whole numbers from 1 to 22, as texts."""
    if list(chromosomes) == ["all"]:
        return [str(c) for c in range(1, 23)]
    out = [str(int(c)) for c in chromosomes]
    if not out or len(set(out)) != len(out) or not all(1 <= int(c) <= 22 for c in out):
        raise ValueError(f"chromosomes must be distinct numbers from 1 to 22, or all: {chromosomes}")
    return out


def check_thresholds(thresholds: list[float]) -> list[float]:
    """Distinct MAF thresholds in (0, 0.5]."""
    out = [float(t) for t in thresholds]
    if not out or len(set(out)) != len(out) or not all(0 < t <= 0.5 for t in out):
        raise ValueError(f"thresholds must be distinct and in (0, 0.5]: {thresholds}")
    return out
