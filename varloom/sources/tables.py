"""Tab-separated and columnar sources and sinks; none reads data on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.scalars import dosage

MAP = "chrom string, pos bigint, ref string, alt string, context string, coverage int, n_support int"
LABELLED = MAP + ", filter string"
PILEUP = "chrom string, pos bigint, ref string, a_n int, t_n int, g_n int, c_n int, n_n int, ref_n int, context string"
STATS = PILEUP + ", vdb double, rpb double, mqb double, bqb double, mqsb double"
BED = "chrom string, start_pos bigint, end_pos bigint, name string, score string, strand string"
#: <tissue>/<parameter set>/<sample>.<ending>
LAYOUT = r"/([^/]+)/([^/]+)/([^/]+?)(?:\.[a-z]+)*$"


def path_columns(df: DataFrame, layout: str = LAYOUT, names: tuple[str, ...] = ("tissue", "param_set", "sample_id"), path: Column | None = None) -> DataFrame:
    """Adds what the path of a row's file (or another path) tells."""
    path = F.col("_metadata.file_path") if path is None else path
    return df.select("*", *[F.regexp_extract(path, layout, i + 1).alias(n) for i, n in enumerate(names)])


def read_tsv(spark: SparkSession, path: str, schema: str, layout: str | None = LAYOUT) -> DataFrame:
    """Files without header, searched through folders; '.' and NA are missing; .gz is read too."""
    df = spark.read.schema(schema).option("sep", "\t").option("nullValue", "NA").option("recursiveFileLookup", True).csv(path)
    out = path_columns(df) if layout else df
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return out.withColumns({c: F.when(F.col(c) != ".", F.col(c)) for c in texts if c not in ("strand", "name", "score")})


def parse_tsv(lines: DataFrame, schema: str) -> DataFrame:
    """Lines of text (value) as columns, beside the lines' other columns, as ``read_tsv`` reads them; a stream's lines too.

    NA and '.' are missing, an empty line has a row of nulls, a field that is no number is null."""
    rest = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*rest, F.from_csv("value", schema, {"sep": "\t", "nullValue": "NA", "mode": "PERMISSIVE"}).alias("_row")).select(*rest, "_row.*")
    texts = [f.name for f in parsed.schema if f.dataType.simpleString() == "string" and f.name not in (*rest, "strand", "name", "score")]
    return parsed.withColumns({c: F.when(F.col(c) != ".", F.col(c)) for c in texts})


def filters_of(text: str) -> Column:
    """Labels of a filter string as an array, empty for PASS."""
    return F.when(F.col(text) == "PASS", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, ";"))


def read_map(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    """Mutation maps; the filter string of labelled ones becomes an array, empty for PASS."""
    df = read_tsv(spark, path, LABELLED if labelled else MAP)
    if not labelled:
        return df
    return df.withColumn("filters", filters_of("filter")).drop("filter")


def read_bed(spark: SparkSession, path: str, one_based: bool = False) -> DataFrame:
    """Intervals; with ``one_based`` the starts are shifted to the number line of positions."""
    df = spark.read.schema(BED).option("sep", "\t").option("comment", "#").csv(path)
    return df.withColumns({"start_pos": F.col("start_pos") + 1, "end_pos": F.col("end_pos") + 1}) if one_based else df


def read_expression(spark: SparkSession, path: str, samples: list[str] | None = None, gene: str = "Name") -> DataFrame:
    """A gene by sample matrix (two lines of comment, then a header) as (gene_id, sample_id, tpm); only the
    samples asked for are parsed."""
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").startswith(gene + "\t")).first()[0].split("\t")
    return parse_expression(lines, header, samples)


def parse_expression(lines: DataFrame, header: list[str], samples: list[str] | None = None) -> DataFrame:
    """Lines of a gene by sample matrix as (gene_id, sample_id, tpm), given its header; lines of another width are left out."""
    gene = header[0]
    wanted = [(i, c) for i, c in enumerate(header) if i > 1 and (samples is None or c in set(samples))]
    cells = lines.select(F.split("value", "\t").alias("c")).filter((F.size("c") == len(header)) & (F.col("c")[0] != gene))
    values = F.array(*[F.struct(F.lit(c).alias("sample_id"), F.col("c")[i].try_cast("double").alias("tpm")) for i, c in wanted])
    if not wanted:
        values = F.expr("cast(array() as array<struct<sample_id:string,tpm:double>>)")
    return cells.select(F.col("c")[0].alias("gene_id"), F.explode(values).alias("v")).select("gene_id", "v.*")


def read_metadata(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of a table with header; an unknown name is an error."""
    df = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").option("inferSchema", True).csv(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.select(*columns)


def transpose(df: DataFrame, id_col: str, out: str = "sample_id") -> DataFrame:
    """Rows of a table with one column per sample as columns, one row per sample."""
    samples = [c for c in df.columns if c != id_col]
    return df.unpivot([id_col], samples, out, "value").groupBy(out).pivot(id_col).agg(F.first("value"))


def read_genotypes(spark: SparkSession, path: str, chrom: str, start: int, end: int, samples: list[str] | None = None) -> DataFrame:
    """Genotypes of a region, and samples; both restrictions reach the scan."""
    df = spark.read.parquet(path).filter((F.col("chrom") == chrom) & (F.col("pos") >= start) & (F.col("pos") <= end))
    return df.filter(F.col("sample_id").isin(*samples)) if samples is not None else df


def genotypes_in(genotypes: DataFrame, regions: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Genotypes inside any of the regions (chrom, start_pos, end_pos; any number), of samples that are listed, each row once.

    Regions that touch are merged first; the join is on (chromosome, bin), so neither side need be small.
    """
    from varloom.operators.intervals import merge_intervals, overlap_join

    inside = overlap_join(genotypes, merge_intervals(regions.select("chrom", "start_pos", "end_pos")), "left_semi")
    return inside.join(samples.select("sample_id").distinct(), "sample_id", "left_semi") if samples is not None else inside


def any_dosage(gt: str = "gt", ds: str = "ds", gl: str = "gl") -> Column:
    """Alternate alleles from what a row has: DS, else GT, else what is expected of GL (log10 likelihoods of 0, 1 and 2)."""
    weights = F.transform(gl, lambda x: F.pow(F.lit(10.0), x - F.array_max(gl)))
    expected = F.when(F.size(gl) == 3, (weights[1] + 2 * weights[2]) / (weights[0] + weights[1] + weights[2]))
    return F.coalesce(F.col(ds).cast("double"), dosage(gt).cast("double"), expected)


def read_mapping_logs(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Numbers from logs of the form 'name | number', one row per sample (the file's name)."""
    return parse_mapping_logs(path_columns(spark.read.option("recursiveFileLookup", True).text(path), r"/([^/]+?)(?:\.[A-Za-z.]+)*$", ("sample_id",)), fields)


def parse_mapping_logs(lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Numbers from lines (sample_id, value) of the form 'name | number', one row per sample."""
    name, value = F.trim(F.regexp_extract("value", r"^\s*(.*?)\s*\|", 1)), F.regexp_extract("value", r"\|\s*([0-9.]+)%?\s*$", 1)
    return lines.groupBy("sample_id").agg(*[F.max(F.when(name == v, value.try_cast("double"))).alias(k) for k, v in fields.items()])


def newest_wins(versions: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of each key with the largest version; the rest of the row decides between equal ones."""
    rest = [c for c in versions.columns if c not in (*key, version)]
    best = versions.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("_v"))
    return best.select(*key, "_v.*")


def edit_sites(sites: DataFrame, chrom: str, pos: str, strand: str | None = None) -> DataFrame:
    """Listed positions as intervals of one position."""
    return sites.select(F.col(chrom).alias("chrom"), F.col(pos).cast("long").alias("start_pos"), (F.col(pos).cast("long") + 1).alias("end_pos"), (F.col(strand) if strand else F.lit(".")).alias("strand")).distinct()


def write_table(df: DataFrame, path: str, by: str = "tissue") -> None:
    """Columnar files, one folder per value; rows of a value are brought together first, hot values into several files."""
    df.repartition(by, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy(by).mode("overwrite").parquet(path)


def map_lines(labelled: DataFrame) -> DataFrame:
    """Labelled calls as the lines (tissue, sample_id, value) that a file of them has; missing values are NA."""
    from varloom.operators.filters import filter_string

    fields = [*(F.coalesce(F.col(c.split()[0]).cast("string"), F.lit("NA")) for c in MAP.split(", ")), filter_string()]
    return labelled.select("tissue", "sample_id", F.concat_ws("\t", *fields).alias("value"))


def write_map(labelled: DataFrame, path: str) -> None:
    """Labelled calls as tab-separated files by tissue, with the filter string."""
    from varloom.operators.filters import filter_string

    labelled.select("tissue", "sample_id", *(c.split()[0] for c in MAP.split(", ")), filter_string().alias("filter")).write.partitionBy("tissue", "sample_id").option("sep", "\t").mode("overwrite").csv(path)


def combined(calls: DataFrame, strip_chr: bool = True) -> DataFrame:
    """Five columns of all samples: sample, chromosome (without 'chr'), position, alleles."""
    chrom: Column = F.regexp_replace("chrom", "^chr", "") if strip_chr else F.col("chrom")
    return calls.select("sample_id", chrom.alias("chrom"), "pos", "ref", "alt")


def by_parent(calls: DataFrame, phase: str = "phase") -> DataFrame:
    """Calls of known parent with the parent's name, to be written by it."""
    return calls.filter(F.col(phase).isin("father", "mother")).withColumn("parent", F.when(F.col(phase) == "father", "paternal").otherwise("maternal"))


#: Columns of the mutation annotation format, in the format's order.
MAF_COLUMNS = (
    "Hugo_Symbol", "Entrez_Gene_Id", "Center", "NCBI_Build", "Chromosome", "Start_Position", "End_Position", "Strand", "Variant_Classification", "Variant_Type",
    "Reference_Allele", "Tumor_Seq_Allele1", "Tumor_Seq_Allele2", "dbSNP_RS", "dbSNP_Val_Status", "Tumor_Sample_Barcode", "Matched_Norm_Sample_Barcode",
    "Match_Norm_Seq_Allele1", "Match_Norm_Seq_Allele2", "Tumor_Validation_Allele1", "Tumor_Validation_Allele2", "Match_Norm_Validation_Allele1",
    "Match_Norm_Validation_Allele2", "Verification_Status", "Validation_Status", "Mutation_Status", "Sequencing_Phase", "Sequence_Source", "Validation_Method",
    "Score", "BAM_File", "Sequencer", "Tumor_Sample_UUID", "Matched_Norm_Sample_UUID", "HGVSc", "HGVSp", "HGVSp_Short", "Transcript_ID", "Exon_Number",
    "t_depth", "t_ref_count", "t_alt_count", "n_depth", "n_ref_count", "n_alt_count", "Consequence", "Protein_position",
)
#: Names of impacts in that format.
MAF_CLASSES = {"Missense": "Missense_Mutation", "Nonsense": "Nonsense_Mutation", "Synonymous": "Silent", "Stop_loss": "Nonstop_Mutation", "Essential_Splice": "Splice_Site"}


def as_maf(annotated: DataFrame, source: str = ".", missing: str = ".") -> DataFrame:
    """Annotated calls in the 47 columns of the mutation annotation format; columns that calls do not tell have ``missing``."""
    kind = F.lit(None).cast("string")
    for k, v in MAF_CLASSES.items():
        kind = F.when(F.col("impact") == k, v).otherwise(kind)
    pos, ref, alt, sample, rest = F.col("pos"), F.col("ref"), F.col("alt"), F.col("sample_id").cast("string"), F.col("coverage") - F.col("n_support")
    values = {
        "Hugo_Symbol": F.col("gene_id"), "Entrez_Gene_Id": F.col("gene_id"), "Chromosome": F.regexp_replace("chrom", "^chr", ""), "Start_Position": pos, "End_Position": pos, "Strand": F.lit("+"),
        "Variant_Classification": kind, "Variant_Type": F.lit("SNP"), "Tumor_Sample_Barcode": sample, "Matched_Norm_Sample_Barcode": sample,
        "Verification_Status": F.lit("validated"), "Mutation_Status": F.lit("somatic"), "Sequence_Source": F.lit(source),
        "HGVSc": F.concat(F.lit("c."), F.regexp_replace("ntchange", "[ACGTN]", ""), "ref_cod", F.lit(">"), "alt_cod"), "HGVSp_Short": F.concat(F.lit("p."), F.col("aachange")),
        "Consequence": F.col("impact"), "Protein_position": F.regexp_replace("aachange", r"[A-Z*]", ""),
    }
    values |= {c: ref for c in ("Reference_Allele", "Tumor_Seq_Allele1", "Match_Norm_Seq_Allele1", "Match_Norm_Seq_Allele2", "Tumor_Validation_Allele1")}
    values |= {c: alt for c in ("Tumor_Seq_Allele2", "Tumor_Validation_Allele2", "Match_Norm_Validation_Allele1", "Match_Norm_Validation_Allele2")}
    values |= {f"{side}_{what}": v for side in "tn" for what, v in (("depth", F.col("coverage")), ("ref_count", rest), ("alt_count", F.col("n_support")))}
    return annotated.select(*[values.get(c, F.lit(missing)).alias(c) for c in MAF_COLUMNS])


def write_by_gene(table: DataFrame, path: str) -> None:
    """Tab-separated files with header, one folder per gene; a gene with many rows gets several files."""
    from varloom.operators.summaries import by_gene_table

    by_gene_table(table).repartition("gene_id", F.pmod(F.xxhash64("Sample_ID", "Start_Position"), F.lit(4))).write.partitionBy("gene_id").option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def pair_integrity(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of each key on both sides, and whether they agree."""
    a, b = first.groupBy(key).agg(F.count(F.lit(1)).alias("n_first")), second.groupBy(key).agg(F.count(F.lit(1)).alias("n_second"))
    both = a.join(b, key, "full").fillna(0, ["n_first", "n_second"])
    return both.withColumn("state", F.when(F.col("n_first") == F.col("n_second"), "correct").otherwise("corrupted"))


