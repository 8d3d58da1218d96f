"""Queries that write reads, tags and alignments as lines of text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import names, scalar
from seqspark.plans.registry import query
from seqspark.plans.scalar_queries import SHORT_SQL, _short
from seqspark.sources import records

REC_SQL = SHORT_SQL + ", r AS (SELECT read_id, 'r' || read_id AS name, CAST(read_id % 5 AS INTEGER) AS rg, seq, qual, CAST(read_id % 6 AS INTEGER) AS ql, CAST(length(seq) - read_id % 4 AS INTEGER) AS qr FROM q)"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("read_id")
    return _short(spark, sf_dir).select("read_id", F.concat(F.lit("r"), i.cast("string")).alias("name"), (i % 5).cast("int").alias("rg"), "seq", "qual", (i % 6).cast("int").alias("ql"), (F.length("seq") - i % 4).cast("int").alias("qr"))


_QUALS = "array_to_string(list_transform(qual, lambda v: chr(v + 33)), '')"


@query(f"WITH {REC_SQL} SELECT 'RD' || chr(9) || name || chr(10) || 'RG' || chr(9) || rg || chr(10) || 'RS' || chr(9) || seq || chr(10) || 'RQ' || chr(9) || {_QUALS} || chr(10) || 'QL' || chr(9) || (ql + 1) || chr(10) || 'QR' || chr(9) || qr || chr(10) || 'ER' AS value FROM r")
def maf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.maf_read(_reads(spark, sf_dir))


@query(
    f"""WITH {REC_SQL} SELECT 'Sequence : ' || name || chr(10) || 'Is_read' || chr(10) || 'Padded' || chr(10) || 'Clipping QUAL ' || (ql + 1) || ' ' || qr || chr(10) || chr(10) || 'DNA : ' || name || chr(10) || seq || chr(10) || chr(10)
 || 'BaseQuality : ' || name || chr(10) || array_to_string(qual, ' ') || chr(10) AS value FROM r"""
)
def caf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.caf_read(_reads(spark, sf_dir))


@query(f"WITH {REC_SQL} SELECT '>' || name || chr(10) || array_to_string(qual[ql + 1:greatest(qr, ql)], ' ') AS value FROM r")
def fasta_qual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities of clipped reads."""
    return records.fasta_qual(records.clipped(_reads(spark, sf_dir)))


@query(f"WITH {REC_SQL} SELECT read_id, repeat('X', ql) || substr(seq, ql + 1, qr - ql) || repeat('X', length(seq) - qr) AS seq FROM r")
def masked_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.masked(_reads(spark, sf_dir)).select("read_id", "seq")


@query(
    f"""WITH {REC_SQL}, p AS (SELECT *, translate(seq, 'ACGTN*', 'A*GTNC') AS ref FROM r), o AS (SELECT *, array_to_string(list_transform(range(length(seq)), lambda i: CASE WHEN substr(seq, i + 1, 1) = '*' AND substr(ref, i + 1, 1) = '*' THEN ''
 WHEN substr(seq, i + 1, 1) = '*' THEN 'D' WHEN substr(ref, i + 1, 1) = '*' THEN 'I' ELSE 'M' END), '') AS ops FROM p)
SELECT read_id, CASE WHEN ql > 0 THEN ql || 'S' ELSE '' END || array_to_string(list_transform(regexp_extract_all(ops, 'M+|I+|D+'), lambda x: length(x) || left(x, 1)), '') || CASE WHEN read_id % 4 > 0 THEN read_id % 4 || 'S' ELSE '' END AS cigar FROM o"""
)
def sam_cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reads(spark, sf_dir).withColumn("ref", F.translate("seq", "ACGTN*", "A*GTNC"))
    return r.select("read_id", records.cigar(F.col("seq"), F.col("ref"), F.col("ql"), (F.col("read_id") % 4).cast("int")).alias("cigar"))


@query(
    f"""WITH {REC_SQL} SELECT name || chr(9) || CAST(16 * (read_id % 2) AS BIGINT) || chr(9) || 'c' || rg || chr(9) || (read_id % 1000 + 1) || chr(9) || '255' || chr(9) || length(replace(seq, '*', '')) || 'M' || chr(9)
 || CASE read_id % 3 WHEN 0 THEN '*' WHEN 1 THEN '=' ELSE 'c9' END || chr(9) || CASE WHEN read_id % 3 = 0 THEN '0' ELSE CAST(read_id % 500 AS VARCHAR) END || chr(9) || '0' || chr(9) || replace(seq, '*', '') || chr(9) || '*' AS line FROM r"""
)
def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("read_id")
    rows = _reads(spark, sf_dir).withColumns(
        {"flag": 16 * (i % 2), "contig": F.concat(F.lit("c"), F.col("rg").cast("string")), "pos": i % 1000 + 1, "mapq": F.lit(255), "cigar": F.concat(F.length(F.replace("seq", F.lit("*"), F.lit(""))).cast("string"), F.lit("M")), "mate_pos": F.when(i % 3 != 0, i % 500), "tlen": F.lit(0), "qual": F.lit("*")}
    )
    rows = rows.withColumn("mate_contig", F.when(i % 3 == 1, F.col("contig")).when(i % 3 == 2, "c9"))
    return rows.select(records.sam_line().alias("line"))


@query(
    """SELECT 'c' || l_suppkey || chr(9) || 'seqspark' || chr(9) || CASE l_linenumber % 2 WHEN 0 THEN 'SRMc' ELSE 'SROc' END || chr(9) || (l_partkey + 1) || chr(9) || (l_partkey + l_linenumber + 1) || chr(9) || '.' || chr(9) || CASE l_linenumber % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END
 || chr(9) || '.' || chr(9) || 'Note=' || l_returnflag || '%3B' || l_linestatus AS value FROM lineitem"""
)
def tag_gff3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_linenumber")
    tags = d.select(
        F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_partkey").alias("from"), (F.col("l_partkey") + n).alias("to"), F.when(n % 2 == 0, "SRMc").otherwise("SROc").alias("id"), F.when(n % 3 == 0, "+").when(n % 3 == 1, "-").alias("strand"), F.concat("l_returnflag", F.lit(";"), "l_linestatus").alias("comment")
    )
    return records.tag_gff3(tags)


@query(f"WITH {REC_SQL} SELECT read_id, reverse(translate(seq, '{scalar.BASES}', '{scalar.COMPLEMENTS}')) AS seq, array_to_string(list_reverse(qual), ',') AS qual, CAST(length(seq) - qr AS INTEGER) AS ql, CAST(length(seq) - ql AS INTEGER) AS qr FROM r")
def complemented_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.complement_record(_reads(spark, sf_dir)).select("read_id", "seq", F.array_join(F.col("qual").cast("array<string>"), ",").alias("qual"), "ql", "qr")


@query(f"WITH {REC_SQL} SELECT read_id, CASE WHEN name LIKE 'r1%' THEN 'lib1_' || substr(name, 3) WHEN name LIKE 'r2%' THEN 'lib2_' || substr(name, 3) ELSE name END AS name FROM r")
def renamed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).select("read_id", names.renamed(F.col("name"), {"r1": "lib1_", "r2": "lib2_"}).alias("name"))
