"""Scalar functions on alleles, identifiers and statistics; all are Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tissue names that have a shorter display form.
DISPLAY_TISSUES = {
    "Breast_Mammary_Tissue": "Breast",
    "Muscle_Skeletal": "Muscle",
    "Skin_Not_Sun_Exposed_Suprapubic": "Skin sun protected",
    "Skin_Sun_Exposed_Lower_leg": "Skin sun exposed",
    "Small_Intestine_Terminal_Ileum": "Small Intestine",
    "Whole_Blood": "Blood",
}
#: Rows (T, C) and columns (A, T, G, C) of the count matrix give the two digits of a type's code.
CODE_ROWS, CODE_COLUMNS = "TC", "ATGC"
#: Amino acids in the order of codons over T, C, A, G.
BASES, AMINO_ACIDS = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_tissue(name: Column | str) -> Column:
    """A tissue's name without hyphens and brackets, white space as underscores."""
    return F.regexp_replace(F.regexp_replace(col(name), r"[-()]", ""), r"\s+", "_")


def display_tissue(name: Column | str) -> Column:
    """A tissue's name for display."""
    short = reduce(lambda acc, kv: F.when(col(name) == kv[0], kv[1]).otherwise(acc), DISPLAY_TISSUES.items(), col(name))
    return F.replace(short, F.lit("_"), F.lit(" "))


def subject_of(sample: Column | str) -> Column:
    """The subject part of a long sample id (two fields joined by a hyphen), or the id itself."""
    found = F.regexp_extract(col(sample), r"^([A-Za-z]+-\w+?)-.+", 1)
    return F.when(found == "", col(sample)).otherwise(found)


def complement(bases: Column | str) -> Column:
    return F.translate(col(bases), "ACGTacgt", "TGCAtgca")


def reverse_complement(bases: Column | str) -> Column:
    return F.reverse(complement(bases))


def is_folded(ref: Column | str) -> Column:
    """Whether a mutation is written from its complement: reference A or G."""
    return col(ref).isin("A", "G")


def fold(base: Column | str, ref: Column | str = "ref") -> Column:
    """The base as seen from the strand on which the reference is a pyrimidine."""
    return F.when(is_folded(ref), complement(base)).otherwise(col(base))


def mutation_type(ref: Column | str = "ref", alt: Column | str = "alt") -> Column:
    """Folded type, such as C>T."""
    return F.concat(fold(ref, ref), F.lit(">"), fold(alt, ref))


def mutation_code(ref: Column | str = "ref", alt: Column | str = "alt") -> Column:
    """Two digits of the folded type: row and column of the count matrix."""
    at = lambda base, order: (F.instr(F.lit(order), base) - 1).cast("string")
    return F.concat(at(fold(ref, ref), CODE_ROWS), at(fold(alt, ref), CODE_COLUMNS))


def type_of_code(code: Column | str) -> Column:
    c = col(code)
    pick = lambda order, at: F.substring(F.lit(order), F.substring(c, at, 1).cast("int") + 1, F.lit(1))
    return F.concat(pick(CODE_ROWS, 1), F.lit(">"), pick(CODE_COLUMNS, 2))


def folded_context(context: Column | str = "context", ref: Column | str = "ref", strand_mode: str = "middle_only") -> Column:
    """The context of a folded mutation.

    ``middle_only`` complements the middle base alone, as the established tables do; ``revcomp`` the
    whole context.
    """
    c = col(context)
    if strand_mode == "revcomp":
        turned = reverse_complement(c)
    elif strand_mode == "middle_only":
        half = ((F.length(c) - 1) / 2).cast("int")
        turned = F.concat(F.substring(c, F.lit(1), half), complement(F.substring(c, half + 1, F.lit(1))), F.substring(c, half + 2, half))
    else:
        raise ValueError(f"unknown strand_mode {strand_mode}")
    return F.when(is_folded(ref), turned).otherwise(c)


def mutation_id(*parts: Column | str) -> Column:
    """Composite id: chromosome, position, reference and alternate joined by dots."""
    return F.concat_ws(".", *(col(p) for p in (parts or ("chrom", "pos", "ref", "alt"))))


def variant_parts(variant: Column | str, sep: str = "_") -> Column:
    """chrom, pos, ref and alt of an id joined by ``sep``."""
    p = F.split(col(variant), sep)
    return F.struct(p[0].alias("chrom"), p[1].cast("long").alias("pos"), p[2].alias("ref"), p[3].alias("alt"))


def dosage(gt: Column | str) -> Column:
    """Alternate alleles of a genotype such as 0/1; null if any is missing."""
    g = F.replace(col(gt), F.lit("|"), F.lit("/"))
    return F.when(g == "0/0", 0).when(g.isin("0/1", "1/0"), 1).when(g == "1/1", 2)


def best_genotype(posteriors: Column | str, least: float = 0.9) -> Column:
    """Index of the posterior that reaches ``least``; null if none does."""
    p = col(posteriors)
    return F.when(F.array_max(p) >= least, F.array_position(p, F.array_max(p)) - 1)


def error_probability(phred: Column | float) -> Column:
    q = phred if isinstance(phred, Column) else F.lit(float(phred))
    return F.pow(F.lit(10.0), -q / 10.0)


def amino_acid(codon: Column | str) -> Column:
    """Amino acid of a codon over T, C, A, G; * is a stop, null an unknown base."""
    c = F.upper(col(codon))
    at = [F.instr(F.lit(BASES), F.substring(c, i, 1)) - 1 for i in (1, 2, 3)]
    return F.when((F.length(c) == 3) & reduce(lambda a, b: a & b, (x >= 0 for x in at)), F.substring(F.lit(AMINO_ACIDS), (at[0] * 16 + at[1] * 4 + at[2] + 1).cast("int"), F.lit(1)))


def with_amino_acid(df: DataFrame, codon: Column, out: str) -> DataFrame:
    """Adds a codon's amino acid from the table of the 64 codons, null for others."""
    i = F.col("_i")
    letter = lambda order, at: F.substring(F.lit(order), (at + 1).cast("int"), F.lit(1))
    name = F.concat(letter(BASES, F.floor(i / 16)), letter(BASES, F.floor(i / 4) % 4), letter(BASES, i % 4))
    table = df.sparkSession.range(64).select(F.col("id").alias("_i")).select(name.alias(f"_{out}"), letter(AMINO_ACIDS, i).alias(out))
    return df.join(F.broadcast(table), F.upper(codon) == F.col(f"_{out}"), "left").drop(f"_{out}")  # 64 rows


def position_bin(position: Column | str, length: Column | str, bins: int = 10) -> Column:
    """Bin 1..bins of a 1-based position in a sequence."""
    return F.least(F.lit(bins), F.floor((col(position) - 1) * bins / col(length)) + 1)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Aggregate: cosine of two columns."""
    x, y = col(a), col(b)
    return F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))


def line_through(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Slope and intercept of the line through two points."""
    slope = (y2 - y1) / (x2 - x1)
    return F.struct(slope.alias("slope"), (y1 - slope * x1).alias("intercept"))


def p_label(p: Column | str) -> Column:
    """Stars of a p-value; missing values count as 1."""
    v = F.coalesce(col(p), F.lit(1.0))
    return F.when(v < 0.001, "***").when(v < 0.01, "**").when(v < 0.05, "*").otherwise("n.s.")


#: Coefficients of the rational approximation of the normal quantile (relative error 1.2e-9).
QUANTILE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
QUANTILE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
QUANTILE_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732537343734, 4.374664141464968, 2.938163982698783)
QUANTILE_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column | str) -> Column:
    """Quantile of the normal distribution: one rational function in the middle, one in the tails."""
    v = col(p)
    q = v - 0.5
    r = q * q
    middle = _polynomial(QUANTILE_A, r) * q / _polynomial(QUANTILE_B, r)
    t = F.sqrt(-2 * F.log(F.least(v, 1 - v)))
    tail = _polynomial(QUANTILE_C, t) / _polynomial(QUANTILE_D, t)
    return F.when((v >= 0.02425) & (v <= 0.97575), middle).when(v < 0.5, tail).otherwise(-tail)


def normal_cdf(z: Column | str) -> Column:
    """Distribution function of the normal by the classical five-term tail series (|error| < 7.5e-8)."""
    x = F.abs(col(z))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(col(z) >= 0, 1 - upper).otherwise(upper)
