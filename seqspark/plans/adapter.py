"""The model's tables derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 8
LETTERS = string.ascii_letters
AS_BASES = ("ACGT" * 13)[:52]

READS_SQL = f"""reads AS (SELECT doc_id AS read_id, lang, source, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS seqtype,
  text, translate(text, '{LETTERS}', '{AS_BASES}') AS seq FROM documents)"""


def km_sql(k: int) -> str:
    """Positioned k-mers of reads."""
    return f"""{READS_SQL},
km AS (SELECT * FROM (SELECT read_id, lang, seqtype, pos, length(seq) AS n, substr(seq, pos + 1, {k}) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - {k} + 1)) AS pos FROM reads)) WHERE regexp_full_match(kmer, '[ACGT]{{{k}}}'))"""


KM_SQL = km_sql(K)
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def stats_sql(name: str = "ks", where: str = "") -> str:
    """Counts on both strands: kmer, f, r, seqtype."""
    return f"""{name}2 AS (SELECT kmer, 1 AS f, 0 AS r, seqtype FROM km {where} UNION ALL SELECT {RC.format("kmer")}, 0, 1, seqtype FROM km {where}),
{name} AS (SELECT kmer, CAST(sum(f) AS BIGINT) AS fcount, CAST(sum(r) AS BIGINT) AS rcount, CASE WHEN min(seqtype) = max(seqtype) THEN min(seqtype) ELSE 15 END AS seqtype FROM {name}2 GROUP BY kmer)"""


def bases(text):
    """Letters as bases; other characters stay and break k-mers. Never folds case, which differs between engines."""
    return F.translate(text, LETTERS, AS_BASES)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seqtype = F.when(d.lang == "en", 1).when(d.lang == "de", 2).when(d.lang == "fr", 3).otherwise(4)
    return d.select(d.doc_id.alias("read_id"), "lang", "source", seqtype.alias("seqtype"), "text", bases(d.text).alias("seq"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(c.conv_id.alias("template"), c.turn.alias("segment"), bases(c.text).alias("seq"))


TURNS_SQL = f"turns AS (SELECT conv_id AS template, turn AS segment, translate(text, '{LETTERS}', '{AS_BASES}') AS seq FROM conversations)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals on contigs: lineitem by supplier, starting at the part number, as long as the quantity."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return d.select(d.l_suppkey.alias("contig"), d.l_partkey.alias("start"), F.floor(d.l_quantity).alias("len"))


PLACED_SQL = "placed AS (SELECT l_suppkey AS contig, l_partkey AS start, CAST(floor(l_quantity) AS BIGINT) AS len FROM lineitem)"
STEPS_SQL = f"""{PLACED_SQL},
ev AS (SELECT contig, x, sum(d) AS d FROM (SELECT contig, start AS x, 1 AS d FROM placed UNION ALL SELECT contig, start + len, -1 FROM placed) GROUP BY contig, x HAVING sum(d) <> 0),
steps AS (SELECT contig, start, stop, CAST(cov AS BIGINT) AS cov FROM (SELECT contig, x AS start, lead(x) OVER (PARTITION BY contig ORDER BY x) AS stop, sum(d) OVER (PARTITION BY contig ORDER BY x) AS cov FROM ev) WHERE cov > 0)"""
