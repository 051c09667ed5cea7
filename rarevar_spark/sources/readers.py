"""Readers of the text inputs. Columns are found by name, their order is free and further columns are ignored.

Readers that keep file order add ``ord``, which rises with the position in a file. It is of use for one file only: the files of
a folder have no order among each other, so what hangs on order (the last row of an id, a panel's place) asks for one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_variant_key, is_finite, packed_covariate, parse_attribute, parse_missing
from ..operators.checks import violations
from .blocks import text_lines


def _header(spark: SparkSession, path: str, starts: str = "") -> str:
    lines = spark.read.text(path).where(~F.col("value").startswith("##"))
    row = (lines.where(F.col("value").startswith(starts)) if starts else lines).first()
    if row is None:
        raise ValueError(f"{path}: no header line")
    return row[0]


def read_columns(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", comment: str = "##", optional: dict[str, str] | None = None) -> DataFrame:
    """``ord`` and the named columns, as text, of a file whose first line that isn't a comment is its header (a leading # is dropped).

    Columns of ``optional`` that the file lacks get the value given there.
    """
    header = _header(spark, path)
    names = header.lstrip("#").rstrip("\r").split(sep)
    lacking = [c for c in columns if c not in names and c not in (optional or {})]
    if lacking:
        raise ValueError(f"{path}: no column {', '.join(lacking)}")
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    lines = lines.where((F.col("value") != header) & ~F.col("value").startswith(comment) & (F.trim("value") != ""))
    cells = F.split(F.regexp_replace("value", "\r$", ""), sep, -1)
    return lines.select("ord", *((F.get(cells, names.index(c)) if c in names else F.lit(optional[c])).alias(c) for c in columns))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """variant_key, chrom, pos, ref, alt, filter (PASS if the file has none), ord of a PVAR file."""
    t = read_columns(spark, path, ["CHROM", "POS", "ID", "REF", "ALT", "FILTER"], optional={"FILTER": "PASS"})
    return t.select(
        canonical_variant_key("ID").alias("variant_key"), F.regexp_replace("CHROM", "^chr", "").alias("chrom"), F.col("POS").cast("long").alias("pos"),
        F.col("REF").alias("ref"), F.col("ALT").alias("alt"), F.col("FILTER").alias("filter"), "ord",
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample_id and ord of a PSAM file."""
    return read_columns(spark, path, ["IID"]).select(F.col("IID").alias("sample_id"), "ord")


def read_gene_panel(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, gene_symbol, chrom, order_index; a blank gene_id is an error."""
    t = read_columns(spark, path, ["gene_id", "gene_symbol", "chromosome", "order_index"])
    violations(t.where(F.trim("gene_id") == ""), "blank gene_id", strict=True)
    return t.select("gene_id", "gene_symbol", F.regexp_replace("chromosome", "^chr", "").alias("chrom"), F.col("order_index").cast("int").alias("order_index"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """variant_key (canonical), gene_id, gene_symbol, ord."""
    t = read_columns(spark, path, ["variant_key", "gene_id", "gene_symbol"])
    return t.select(canonical_variant_key("variant_key").alias("variant_key"), "gene_id", "gene_symbol", "ord")


def _tab_or_comma(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    names = _header(spark, path).lstrip("#").split("\t")
    return read_columns(spark, path, columns, "\t" if all(c in names for c in columns) else ",")


def read_phenotypes(spark: SparkSession, path: str, id_col: str, columns: list[str]) -> DataFrame:
    """sample_id and the phenotype columns as doubles; missing texts are NaN, and of a repeated id the last row counts."""
    t = _tab_or_comma(spark, path, [id_col, *columns])
    last = t.groupBy(F.col(id_col).alias("sample_id")).agg(F.max_by(F.struct(*columns), "ord").alias("r"))
    return last.select("sample_id", *(parse_missing(F.col("r")[c]).alias(c) for c in columns))


def phenotypes_long(phenotypes: DataFrame, columns: list[str]) -> DataFrame:
    """sample_id, phenotype_index, phenotype_name, y."""
    pairs = F.array(*(F.struct(F.lit(i).alias("phenotype_index"), F.lit(c).alias("phenotype_name"), F.col(c).alias("y")) for i, c in enumerate(columns)))
    return phenotypes.select("sample_id", F.explode(pairs).alias("p")).select("sample_id", "p.*")


def read_covariates(spark: SparkSession, path: str, id_col: str, columns: list[str], packed: str | None = None, ancestries: list[str] | None = None) -> DataFrame:
    """ancestry (null when the path has no ``{anc}``), sample_id, x: the covariates as an array.

    With ``packed`` the columns are PCk of the JSON vector in that column; names must be distinct, and a vector
    that is short or holds what isn't finite is an error.
    """
    if not columns or len(set(columns)) != len(columns):
        raise ValueError("covariate names must be distinct, and there must be one")
    parts = []
    for anc in ancestries if "{anc}" in path else [None]:
        file = path.replace("{anc}", anc) if anc else path
        if packed:
            t = _tab_or_comma(spark, file, [id_col, packed])
            x = [packed_covariate(packed, c) for c in columns]
            violations(t.where(~F.forall(F.array(*x), is_finite)), f"{packed} too short or not finite", strict=True)
        else:
            t = _tab_or_comma(spark, file, [id_col, *columns])
            x = [parse_missing(c) for c in columns]
        last = t.select("ord", F.col(id_col).alias("sample_id"), F.array(*x).alias("x")).groupBy("sample_id").agg(F.max_by("x", "ord").alias("x"))
        parts.append(last.select(F.lit(anc).cast("string").alias("ancestry"), "sample_id", "x"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_ancestries(spark: SparkSession, path: str, id_col: str, label_col: str) -> DataFrame:
    """sample_id and ancestry (trimmed, upper case); of a repeated id the last row counts."""
    t = _tab_or_comma(spark, path, [id_col, label_col])
    last = t.groupBy(F.col(id_col).alias("sample_id")).agg(F.max_by(label_col, "ord").alias("label"))
    return last.select("sample_id", F.upper(F.trim("label")).alias("ancestry"))


def read_vcf(spark: SparkSession, path: str, keep_samples: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variants, samples, calls) of a VCF text: PASS records of one ALT, and calls that are not homozygous for the reference.

    A block-compressed file is read split by split as a plain one is (``blocks``); any other compressed file is one task.
    """
    text = text_lines(spark, path)
    header = text.where(F.col("value").startswith("#CHROM")).first()
    if header is None:
        raise ValueError(f"{path}: no header line")
    names = header["value"].split("\t")[9:]
    wanted = [i for i, s in enumerate(names) if keep_samples is None or s in set(keep_samples)]
    samples = spark.createDataFrame([(names[i], k) for k, i in enumerate(wanted)], "sample_id string, ord long")
    rows = _vcf_rows(text.where(~F.col("value").startswith("#")), "ord")
    # a row for each cell, whatever the number of samples; the plan stays as it is
    cells = _vcf_cells(rows.select("variant_key", F.slice("c", 10, max(len(names), 1)).alias("cells")), "variant_key")
    place = spark.createDataFrame([(i, names[i]) for i in wanted], "place int, sample_id string")
    return rows.select("variant_key", "chrom", "pos", "ref", "alt", "filter", "ord"), samples, _vcf_calls(cells.join(place, "place"))


def _vcf_rows(lines: DataFrame, *others: str) -> DataFrame:
    """The PASS records of one ALT with their fields, c."""
    c = F.split("value", "\t")
    rows = lines.select(*others, F.regexp_replace(c[0], "^chr", "").alias("chrom"), c[1].cast("long").alias("pos"), c[3].alias("ref"), c[4].alias("alt"), c[6].alias("filter"), c.alias("c"))
    rows = rows.where(F.col("filter").isin("PASS", ".") & ~F.col("alt").contains(","))
    return rows.withColumn("variant_key", canonical_variant_key(F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt")))


def _vcf_cells(rows: DataFrame, *key: str) -> DataFrame:
    """key, place, cell of the array ``cells`` where these are not homozygous for the reference."""
    return rows.select(*key, F.posexplode("cells").alias("place", "cell")).where(~F.col("cell").startswith("0/0") & ~F.col("cell").startswith("0|0"))


def _vcf_calls(cells: DataFrame) -> DataFrame:
    calls = cells.withColumn("gt", F.split("cell", ":")[0])
    missing = F.col("gt").contains(".")
    dosage = F.aggregate(F.split("gt", "[/|]"), F.lit(0), lambda s, a: s + a.try_cast("int"))
    calls = calls.select("variant_key", "sample_id", F.when(missing, 0).otherwise(dosage).cast("tinyint").alias("dosage"), (~missing).alias("called"))
    return calls.where("dosage != 0 or not called")


def read_vcf_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variants, samples, calls) as :func:`read_vcf`, without ord, of a folder of VCF texts, plain or compressed: each names samples of its own in its header, and has the
    records that any of these carries. No header comes to the driver; samples are joined by file and place.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    fields = F.split("value", "\t")
    heads = text.where(F.col("value").startswith("#CHROM")).select("file", F.posexplode(F.slice(fields, 10, F.size(fields))).alias("place", "sample_id"))
    rows = _vcf_rows(text.where(~F.col("value").startswith("#")), "file")
    cells = _vcf_cells(rows.select("file", "variant_key", F.slice("c", 10, F.size("c")).alias("cells")), "file", "variant_key")
    return rows.select("variant_key", "chrom", "pos", "ref", "alt", "filter").distinct(), heads.select("sample_id").distinct(), _vcf_calls(cells.join(heads, ["file", "place"]))


def read_gene_intervals(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, gene_id, gene_symbol, order_index of a GTF's protein-coding genes, in file order by chromosome."""
    t = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(~F.col("value").startswith("#"))
    c = F.split("value", "\t")
    g = t.select("ord", F.regexp_replace(c[0], "^chr", "").alias("chrom"), c[2].alias("type"), c[3].cast("long").alias("start"), c[4].cast("long").alias("end"), c[8].alias("attributes"))
    g = g.where((F.col("type") == "gene") & (parse_attribute("attributes", "gene_type") == "protein_coding"))
    return g.select(
        "chrom", "start", "end", parse_attribute("attributes", "gene_id").alias("gene_id"), parse_attribute("attributes", "gene_name").alias("gene_symbol"),
        (F.row_number().over(Window.partitionBy("chrom").orderBy("ord")) - 1).alias("order_index"),
    )


# Zero-based places of the wanted columns in a consequence file, and how many columns it has at least.
CONSEQUENCE_COLUMNS = {"chrom": 2, "pos": 3, "ref": 4, "alt": 5, "gene_symbol": 43, "gene_id": 53, "mane": 105, "lof": 109}
CONSEQUENCE_WIDTH = 110


def read_consequences(spark: SparkSession, path: str) -> DataFrame:
    """ord and the eight wanted columns, by place, with n_columns; a row with fewer than 110 is an error."""
    t = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    header = t.orderBy("ord").first()[0]
    c = F.split("value", "\t", -1)
    t = t.where(F.col("value") != header).select("ord", c.alias("c"), F.size(c).alias("n_columns"))
    violations(t.where(F.col("n_columns") < CONSEQUENCE_WIDTH).select("ord", "n_columns"), f"fewer than {CONSEQUENCE_WIDTH} columns", strict=True)
    return t.select("ord", "n_columns", *(F.get("c", i).alias(name) for name, i in CONSEQUENCE_COLUMNS.items())).withColumn("pos", F.col("pos").try_cast("long"))


# Columns of the joint covariate file that get another name.
JOINT_RENAMES = {"GENDER_REGULAR": "GENDER", "OTHER_GENDER": "GENDER_OTHER", "age_at_profile": "AGE", "age_sq": "AGESQ", "affiliation": "BIOBANK"}


def import_joint_covariates(spark: SparkSession, path: str, columns: list[str], rename: dict[str, str] = JOINT_RENAMES) -> DataFrame:
    """sample_id and the named covariates as doubles from a file whose lines mix commas, tabs and blanks inside the last cell.

    Empty cells are missing (NaN). A wrong number of fields, a missing or repeated id, a text that is no number, a repeated or
    missing header name and a file without rows are errors.
    """
    fields = lambda line: [f for cell in line.strip().replace("\t", ",").split(",") for f in (cell.split(" ") if " " in cell.strip() else [cell])]
    header = _header(spark, path)
    names = [n.lstrip("#").strip() for n in fields(header)]
    source = {c: rename.get(c, c) for c in columns}
    if len(set(names)) != len(names) or any(s not in names for s in [*source.values(), "IID"]):
        raise ValueError(f"{path}: header names are repeated or missing")
    t = spark.read.text(path).where((F.col("value") != header) & (F.trim("value") != ""))
    cells = F.flatten(F.transform(F.split(F.regexp_replace("value", "\t", ","), ",", -1), lambda x: F.when(F.trim(x).contains(" "), F.split(F.trim(x), " ")).otherwise(F.array(F.trim(x)))))
    t = t.select(cells.alias("c"))
    violations(t.where(F.size("c") != len(names)), "wrong number of fields", strict=True)
    rows = t.select(F.get("c", names.index("IID")).alias("sample_id"), *(F.get("c", names.index(s)).alias(c) for c, s in source.items()))
    bad = [F.col(c).isNotNull() & (F.col(c) != "") & F.col(c).try_cast("double").isNull() for c in columns]
    wrong = bad[0]
    for b in bad[1:]:
        wrong = wrong | b
    violations(rows.where(wrong), "not a number", strict=True)
    violations(rows.where(F.col("sample_id") == ""), "missing id", strict=True)
    violations(rows.groupBy("sample_id").count().where("count > 1"), "repeated id", strict=True)
    if rows.limit(1).count() == 0:
        raise ValueError(f"{path}: no rows")
    return rows.select("sample_id", *(parse_missing(c).alias(c) for c in columns))


def read_public_variant_list(spark: SparkSession, path: str) -> DataFrame:
    """ord, chrom, gene_id, gene_symbol, order_index, variant_key, pos; a gene without variants has one row with a null key.

    Chromosomes outside 1..22, a gene in more than one place and a variant twice in a gene are errors.
    """
    t = read_columns(spark, path, ["chromosome", "gene_id", "gene_symbol", "order_index", "variant_key", "position"])
    out = t.select(
        "ord", F.regexp_replace("chromosome", "^chr", "").alias("chrom"), "gene_id", "gene_symbol", F.col("order_index").cast("int").alias("order_index"),
        F.nullif("variant_key", F.lit("")).alias("variant_key"), F.col("position").try_cast("long").alias("pos"),
    )
    violations(out.where(~F.coalesce(F.col("chrom").try_cast("int").between(1, 22), F.lit(False))), "not an autosome", strict=True)
    starts = out.withColumn("before", F.lag("gene_id").over(Window.partitionBy("chrom").orderBy("ord"))).where("before is null or before != gene_id")
    violations(starts.groupBy("gene_id").count().where("count > 1"), "a gene in more than one place", strict=True)
    violations(out.where("variant_key is not null").groupBy("gene_id", "variant_key").count().where("count > 1"), "a variant twice in a gene", strict=True)
    return out


def read_cut_list(spark: SparkSession, path: str) -> DataFrame:
    """variant_key, canonical, without repeats."""
    return read_columns(spark, path, ["variant_key"]).select(canonical_variant_key("variant_key").alias("variant_key")).distinct()


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """site, sample_id, variant_key, dosage, called: sparse calls as Parquet."""
    return spark.read.parquet(path).select("site", "sample_id", "variant_key", F.col("dosage").cast("tinyint").alias("dosage"), "called")


def read_results(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A result table with its header; all columns as text but the keys that are numbers."""
    t = spark.read.csv(path, header=True, sep=sep)
    return t.select(*(F.col(c).cast("int").alias(c) if c in ("gene_index", "phenotype_index") else F.col(c) for c in t.columns))
