"""Projections of the driver's tables on the library's schemas, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.intervals import overlap_join

BASE = ("lineitem", "part", "orders", "events", "embeddings")
#: Each may read the base tables and those before it.
PROJECTIONS: dict[str, str] = {
    "calls": """
select sample_id,
  concat('T', cast(cast(floor(sample_id / 10.0) as int) as varchar(9))) as tissue,
  concat('chr', cast(ci as varchar(9))) as chrom, pos,
  substr('ATGC', cast(cast(floor((pos * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) as ref,
  substr('ATGC', cast((cast(floor((pos * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4
    + 1 + (pos + bump) % 3) % 4 as int) + 1, 1) as alt,
  concat(
    substr('ATGC', cast(cast(floor(((pos - 2) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1),
    substr('ATGC', cast(cast(floor(((pos - 1) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1),
    substr('ATGC', cast(cast(floor((pos * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1),
    substr('ATGC', cast(cast(floor(((pos + 1) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1),
    substr('ATGC', cast(cast(floor(((pos + 2) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1)
  ) as context,
  coverage, n_support, vdb, rpb, mqb, bqb, mqsb
from (
  select (l_orderkey + l_suppkey) % 40 as sample_id, l_partkey % 5 + 1 as ci,
    cast(floor(l_partkey / 5.0) as bigint) * 200 + (l_orderkey % 8) * 5 + 10 as pos,
    cast(max(l_quantity) as int) * 4 as coverage,
    min(l_linenumber + cast(round(l_discount * 100) as int)) as n_support,
    min(case when l_linenumber = 7 then 1 else 0 end) as bump,
    min(l_tax + 0.02) as vdb, max(l_tax + 0.02) as rpb,
    min(case when l_linenumber = 3 then null else l_tax + 0.03 end) as mqb,
    max(l_discount + 0.01) as bqb, min(l_discount + 0.045) as mqsb
  from lineitem group by 1, 2, 3) k
""",
    "exons": """
select p_partkey as exon_id,
  concat('G', cast(cast(floor(p_partkey / 50.0) as int) as varchar(9))) as gene_id,
  concat('chr', cast(p_partkey % 5 + 1 as varchar(9))) as chrom,
  cast(floor(p_partkey / 5.0) as bigint) * 200 + 15 as start_pos,
  cast(floor(p_partkey / 5.0) as bigint) * 200 + 15 + p_size % 25 + 1 as end_pos,
  case when p_partkey % 2 = 0 then '+' else '-' end as strand
from part
""",
    "pileup": """
select sample_id, tissue, chrom, pos, ref, context,
  case when ref = 'A' then coverage - n_support when alt = 'A' then n_support else 0 end as a_n,
  case when ref = 'T' then coverage - n_support when alt = 'T' then n_support else 0 end as t_n,
  case when ref = 'G' then coverage - n_support when alt = 'G' then n_support else 0 end as g_n,
  case when ref = 'C' then coverage - n_support when alt = 'C' then n_support else 0 end as c_n
from calls where coverage > n_support
""",
    "depth": """
select sample_id, tissue, chrom, pos, coverage as depth from calls where coverage >= 40
""",
    "sample_meta": """
select sample_id, tissue, sample_id % 10 as subject_id,
  20 + (sample_id * 7) % 50 as age, cast(18.5 + (sample_id * 11) % 20 as double) as bmi, sample_id % 2 + 1 as gender,
  1000000 + count(*) * 1000 + (sample_id * 37) % 100 as n_unique_mapped
from calls group by sample_id, tissue
""",
    "expression": """
select concat('G', cast(cast(floor(l_partkey / 50.0) as int) as varchar(9))) as gene_id,
  (l_orderkey + l_suppkey) % 40 as sample_id, round(avg(l_extendedprice) / 1000.0, 6) as tpm
from lineitem group by 1, 2
""",
    "genotypes": """
select o_orderkey as variant_id, sample_id,
  (o_orderkey * (sample_id + 3) + o_custkey) % 3 as dosage
from orders cross join (select distinct sample_id from calls) s
""",
    "catalogue": """
select distinct chrom, pos, ref, alt from calls where (pos + 1) % 4 = 0
""",
    "cds": """
select gene_id, chrom, strand, pos, base, row_number() over (partition by gene_id order by case when strand = '-' then -pos else pos end) as cds_pos
from (select concat(gene_id, '_', chrom, strand) as gene_id, chrom, strand, pos, case when strand = '-' then translate(b, 'ACGT', 'TGCA') else b end as base
  from (select gene_id, chrom, strand, start_pos + p_partkey - 1 as pos,
      substr('ATGC', cast(cast(floor(((start_pos + p_partkey - 1) * 2654435761 + cast(substr(chrom, 4, 1) as bigint) * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) as b
    from exons join part on p_partkey between 1 and 26 and start_pos + p_partkey - 1 < end_pos) x) y
""",
    "gene_calls": """
select c.sample_id, c.tissue, c.chrom, c.pos, c.ref, c.alt, c.context, c.coverage, c.n_support, e.gene_id, e.strand
from calls c join exons e on c.chrom = e.chrom and c.pos >= e.start_pos and c.pos < e.end_pos
""",
    "sample_counts": """
select m.sample_id, m.tissue, m.subject_id, m.age, m.bmi, m.gender, m.n_unique_mapped, k.n
from sample_meta m join (select sample_id, count(*) as n from calls group by sample_id) k on m.sample_id = k.sample_id
""",
    "pairs": """
select a.sample_id % 10 as subject_id, a.chrom, a.pos, a.ref as ref1, a.alt as alt1, a.n_support as alt_n1, a.coverage as cov1,
  b.ref as ref2, case when b.n_support < 3 then 'X' else b.alt end as alt2, case when b.n_support < 3 then 0 else b.n_support end as alt_n2, b.coverage as cov2
from calls a join calls b on a.chrom = b.chrom and a.pos = b.pos and a.sample_id + 10 = b.sample_id
""",
    "reads": """
select read_id, sample_id, concat('chr', cast(ci as varchar(9))) as chrom, start_pos as start, is_reverse, qual,
  concat(case when mutated and l_linenumber = 1 then substr('GCAT', cast(cast(floor(((start_pos + 0) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) else substr('ATGC', cast(cast(floor(((start_pos + 0) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) end,
    case when mutated and l_linenumber = 2 then substr('GCAT', cast(cast(floor(((start_pos + 1) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) else substr('ATGC', cast(cast(floor(((start_pos + 1) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) end,
    case when mutated and l_linenumber = 3 then substr('GCAT', cast(cast(floor(((start_pos + 2) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) else substr('ATGC', cast(cast(floor(((start_pos + 2) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) end,
    case when mutated and l_linenumber = 4 then substr('GCAT', cast(cast(floor(((start_pos + 3) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) else substr('ATGC', cast(cast(floor(((start_pos + 3) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) end,
    case when mutated and l_linenumber = 5 then substr('GCAT', cast(cast(floor(((start_pos + 4) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) else substr('ATGC', cast(cast(floor(((start_pos + 4) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) end,
    case when mutated and l_linenumber = 6 then substr('GCAT', cast(cast(floor(((start_pos + 5) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) else substr('ATGC', cast(cast(floor(((start_pos + 5) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) end,
    case when mutated and l_linenumber = 7 then substr('GCAT', cast(cast(floor(((start_pos + 6) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) else substr('ATGC', cast(cast(floor(((start_pos + 6) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) end,
    case when mutated and l_linenumber = 8 then substr('GCAT', cast(cast(floor(((start_pos + 7) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) else substr('ATGC', cast(cast(floor(((start_pos + 7) * 2654435761 + ci * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1) end) as seq
from (select l_orderkey * 10 + l_linenumber as read_id, (l_orderkey + l_suppkey) % 40 as sample_id, l_partkey % 5 + 1 as ci, l_linenumber,
    cast(floor(l_partkey / 250.0) as bigint) * 200 + l_linenumber % 3 + 10 as start_pos, l_suppkey % 2 = 0 as is_reverse, l_quantity % 3 = 0 as mutated, cast(l_quantity as int) % 20 + 20 as qual
  from lineitem) r
""",
}

def _base_at(pos: str) -> str:
    """SQL of the reference's base at a position of the row's chromosome."""
    return f"substr('ATGC', cast(cast(floor((({pos}) * 2654435761 + cast(substr(chrom, 4, 1) as bigint) * 40503) / 65536.0) as bigint) % 4 as int) + 1, 1)"


def _flanked(source: str) -> str:
    """SQL that adds the neighbours on the coding strand to rows with chrom, pos and strand."""
    return f"""select x.*, case when strand = '-' then translate(hi, 'ACGT', 'TGCA') else lo end as up, case when strand = '-' then translate(lo, 'ACGT', 'TGCA') else hi end as down
from (select y.*, {_base_at("pos - 1")} as lo, {_base_at("pos + 1")} as hi from {source} y) x"""


PROJECTIONS["cds_flanks"] = f"select gene_id, chrom, strand, pos, base, cds_pos, up, down from ({_flanked('cds')}) z"
#: Two bases before an exon and the first, second and fifth after it, in the direction of its gene.
_AT_EXON_ENDS = """(select concat(gene_id, '_', chrom, strand) as gene_id, chrom, strand,
    case when o < 0 and strand = '+' then start_pos + o when o < 0 then end_pos - 1 - o when strand = '+' then end_pos - 1 + o else start_pos - o end as pos
  from exons cross join (values (-2), (-1), (1), (2), (5)) v(o))"""
PROJECTIONS["splice_sites"] = f"""
select gene_id, chrom, strand, pos, case when strand = '-' then translate(b, 'ACGT', 'TGCA') else b end as base, up, down
from (select w.*, {_base_at("pos")} as b from ({_flanked(_AT_EXON_ENDS)}) w) z
"""


def with_projections(body: str) -> str:
    """The query, which may begin with "with", with the projections it reads as common table expressions."""
    body, needed = body.strip(), set()
    texts = [body]
    while texts:
        text = texts.pop()
        for name, sql in PROJECTIONS.items():
            if name not in needed and re.search(rf"(from|join)\s+{name}\b", text):
                needed.add(name)
                texts.append(sql)
    ctes = ", ".join(f"{n} as ({PROJECTIONS[n].strip()})" for n in PROJECTIONS if n in needed)
    if not ctes:
        return body
    return f"with {ctes}, {body[5:]}" if body.lower().startswith("with ") else f"with {ctes} {body}"


def _with_doubles(text: str) -> str:
    """The SQL with its numbers with a point as doubles, as DuckDB divides by them; for Spark they are decimals, which keep digits that doubles round off."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", text)


class Tables:
    """The projections over the tables in a folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **tables: DataFrame) -> DataFrame:
        """SQL over base tables, projections and the tables given."""
        known = {}
        for name in (*BASE, *PROJECTIONS, *tables):
            found = re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 {{{name}}}", text)
            if found != text:
                text, known[name] = found, tables.get(name) or (self.base(name) if name in BASE else getattr(self, name))
        return self.spark.sql(text, **known)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in PROJECTIONS:
            raise AttributeError(name)
        # the join of gene_calls on the chromosome alone would compare each call with every exon of it: Spark joins by bins
        # nothing is kept, calls neither: to keep all columns of all rows takes longer than to work out those that a query reads, each time it does
        made = self._in_genes() if name == "gene_calls" else self._genotypes() if name == "genotypes" else self.sql(_with_doubles(PROJECTIONS[name]))
        self.__dict__[name] = made
        return made

    @property
    def calls_once(self) -> DataFrame:
        """``calls`` for a query that reads them once."""
        return self.sql(_with_doubles(PROJECTIONS["calls"]))

    def _genotypes(self) -> DataFrame:
        """What the projection ``genotypes`` has.  Each row of lineitem is in a call, so the samples of calls are those of lineitem, 40 or so."""
        samples = self.sql("select distinct (l_orderkey + l_suppkey) % 40 as sample_id from lineitem")
        made = self.base("orders").join(F.broadcast(samples), how="cross")
        return made.selectExpr("o_orderkey as variant_id", "sample_id", "(o_orderkey * (sample_id + 3) + o_custkey) % 3 as dosage")

    def _in_genes(self) -> DataFrame:
        """What the projection ``gene_calls`` has."""
        calls = self.calls.select("sample_id", "tissue", "chrom", "pos", "ref", "alt", "context", "coverage", "n_support")
        return overlap_join(calls, self.exons.select("chrom", "start_pos", "end_pos", "gene_id", "strand"), bounds=False)
