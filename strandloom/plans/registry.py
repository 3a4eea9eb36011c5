"""Queries over the test tables: adapters that read genomic shapes out of them, and the registry of queries with their SQL.

An adapter is one SQL text that Spark and DuckDB both run, as a common table expression over the plain tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_MAP = "translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTACN')"

ADAPTERS = {
    "breaks": """select event_id as sv_id, concat('S', user_id) as sample,
        concat('chr', case event_type when 'click' then 1 when 'purchase' then 2 when 'error' then 3 when 'signup' then 4 else 5 end) as chrom,
        cast(day(ts) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) as bigint) as pos from {events}""",
    "chrom_lengths": "select distinct chrom, cast(2678400 as bigint) as length from {breaks}",
    "sv": """select b.sv_id, b.sample, b.chrom, b.pos, b.pos + cast(floor(e.value * 400) as bigint) - 900 as stop,
        case e.event_type when 'click' then 'DEL' when 'purchase' then 'INS' when 'error' then 'INV' when 'signup' then 'DUP' else 'TRA' end as svtype,
        case when e.event_type = 'view' then concat('chr', e.event_id % 5 + 1) end as chr2,
        case when e.event_type = 'view' then b.pos + cast(floor(e.value * 1000) as bigint) end as chr2_pos,
        case when e.event_id % 7 = 0 then null else cast(floor(e.value * 800) as bigint) end as svlen,
        (e.event_id % 100) / 100.0e0 as prob, cast(e.event_id % 12 as int) as su
        from {breaks} b join {events} e on b.sv_id = e.event_id""",
    "aln": """select l_returnflag as sample, concat('r', l_orderkey) as qname, concat('c', l_partkey) as contig,
        cast((l_orderkey * 37 + l_linenumber * 101) % 5000 + 1 as bigint) as pos, cast(l_quantity as bigint) as span,
        cast((l_suppkey * 7 + l_linenumber) % 61 as int) as mapq,
        cast(1 + 2 * (l_suppkey % 2) + case when l_partkey % 17 = 0 then 4 else 0 end + case when l_partkey % 23 = 0 then 8 else 0 end
          + 16 * (l_linenumber % 2) + 32 * (l_suppkey % 3 % 2) + case when l_linenumber = 1 then 64 when l_linenumber = 2 then 128 else 0 end
          + case when l_suppkey % 11 = 0 then 256 else 0 end + case when l_partkey % 13 = 0 then 512 else 0 end
          + case when l_partkey % 19 = 0 then 1024 else 0 end + case when l_linenumber > 5 then 2048 else 0 end as int) as flag,
        concat(case when l_suppkey % 3 = 0 then concat(l_suppkey % 40 + 1, 'S') else '' end, cast(l_quantity as bigint), 'M',
          case l_linenumber % 4 when 0 then '2D5M' when 1 then '1I4M' when 2 then '3N6M' else '' end,
          case when l_suppkey % 5 = 0 then concat(l_suppkey % 30 + 1, 'H') else '' end) as cigar,
        case when l_suppkey % 4 = 0 then concat('c', (l_partkey + 1)) else '=' end as rnext,
        cast((l_orderkey * 37 + l_linenumber * 101) % 5000 + 1 + l_suppkey * 3 as bigint) as pnext,
        cast(l_suppkey % 7 * 50 - 100 as bigint) as tlen, cast(floor(l_extendedprice) as bigint) as base_quality,
        cast(floor(l_tax * 1000) as bigint) as score from {lineitem}""",
    "regions": """select 'A' as sample, concat('c', p_partkey) as contig, cast(p_size * 40 as bigint) as r_start, cast(p_size * 40 + 600 as bigint) as r_end,
        cast(p_partkey as bigint) as region from {part}""",
    "reference": """select concat('c', doc_id) as contig, regexp_replace(%s, '[^ACGTN]', ''/*g*/) as seq from {documents}""" % _MAP,
    "coverage": """select sample, concat('k', cast(substring(contig, 2) as bigint) % 12) as chrom, 'p' as arm, cast(floor(pos / 20) as bigint) as bin,
        cast(sum(span * (1 + mapq % 3)) as double) as coverage, cast(min(mapq) as int) as map, cast(max(mapq) + min(span) as int) % 101 as gc from {aln} group by 1, 2, 3, 4""",
    "segments": """select l_returnflag as sample, concat('k', l_suppkey % 22) as chrom, 'p' as arm, cast(l_orderkey * 10 + l_linenumber as bigint) as start,
        cast(l_orderkey * 10 + l_linenumber + l_quantity as bigint) as end, cast(l_quantity as bigint) as n_probes, l_discount - 0.05 as mean from {lineitem}""",
    "contig_map": """select l_returnflag as sample, concat('S', l_suppkey % 30, '_q', l_orderkey, '_cov_', l_suppkey % 50) as qname, concat('chr', l_suppkey % 5 + 1) as chrom,
        cast((l_orderkey * 37 + l_linenumber * 101) % 50000 as bigint) as rstart, cast((l_orderkey * 37 + l_linenumber * 101) % 50000 + l_quantity * 3 as bigint) as rend,
        cast(l_linenumber * 60 + l_suppkey % 20 as bigint) as qstart, cast(l_linenumber * 60 + l_suppkey % 20 + l_quantity * 3 as bigint) as qend, 600 as qlen,
        case when l_partkey % 2 = 0 then '+' else '-' end as strand, cast((l_suppkey * 7 + l_linenumber) % 61 as int) as mapq, cast(floor(l_extendedprice) as bigint) as score from {lineitem}""",
    "raw": """select doc_id, source as sample, regexp_replace(%s, '[^ACGTN]', ''/*g*/) as seq from {documents}""" % _MAP,
    "contigs": """select doc_id, sample, replace(seq, 'N', '') as seq from {raw}""",
    "edges": "select distinct l_orderkey as src, l_partkey as dst from {lineitem}",
    "graph_edges": """select cast(l_orderkey * 10 + l_linenumber as bigint) as edge, cast(l_partkey as bigint) as src, cast(l_suppkey * 20 + l_linenumber as bigint) as dst,
        cast(l_quantity * 20 as bigint) as len, cast(l_extendedprice as double) as raw_cov from {lineitem}""",
    "profiles": "select concat('c', l_partkey) as contig, l_returnflag as sample, cast(sum(l_quantity) as double) as abundance from {lineitem} group by 1, 2",
    "bins": "select distinct concat('c', l_partkey) as contig, concat('BIN', l_partkey % 7) as bin from {lineitem}",
    "contig_lengths": "select concat('c', p_partkey) as contig, concat('g', p_size % 4) as grp, cast(p_size * 100 as bigint) as length from {part}",
    "mates": """select l_orderkey as pair, cast(l_linenumber % 2 as int) as mate, cast(l_suppkey as bigint) as edge, cast(l_partkey % 900 as bigint) as e_start,
        cast(l_quantity as bigint) as mapped from {lineitem}""",
    "edge_maps": """select l_orderkey as read, l_returnflag as sample, cast(l_suppkey as bigint) as edge, cast(l_linenumber * 50 as bigint) as q_start,
        cast(l_linenumber * 50 + l_quantity as bigint) as q_end, cast(l_partkey % 900 as bigint) as e_start, cast(l_partkey % 900 + l_quantity as bigint) as e_end from {lineitem}""",
}


def with_adapters(sql: str, base: str = "") -> str:
    """sql with {name} for tables and adapters; adapters become common table expressions, tables base + name."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in ADAPTERS and name not in needed:
                need(ADAPTERS[name])
                needed.append(name)

    need(sql)
    fill = lambda text: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in ADAPTERS else base + m[1], text)
    if not needed:
        return fill(sql)
    ctes = ", ".join(f"{n} as ({fill(ADAPTERS[n])})" for n in needed)
    body = fill(sql).lstrip()
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return f"{start}{ctes}, {body[len(start) :]}"
    return f"with {ctes} {body}"


class Tables:
    """The tables and adapters of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in ADAPTERS:
            return self.sql(f"select * from {{{name}}}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        full = with_adapters(text, "strand_")
        for name in BASE:
            if f"strand_{name}" in full:
                getattr(self, name).createOrReplaceTempView(f"strand_{name}")
        return self.spark.sql(full)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query, with the SQL that DuckDB runs over the same tables."""

    def add(f):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_adapters(sql).replace("/*g*/", ", 'g'")  # Spark replaces all matches by itself
        return f

    return add
