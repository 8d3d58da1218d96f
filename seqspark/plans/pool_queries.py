"""Queries on pools of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators import kmers, pool
from seqspark.plans import kmer_queries as kq
from seqspark.plans.adapter import AS_BASES, K, LETTERS, PLACED_SQL, STEPS_SQL, placed, reads, stats_sql
from seqspark.plans.contig_queries import _steps
from seqspark.plans.read_queries import PAIRS_SQL, pair_resolve
from seqspark.plans.registry import query


@query(f"WITH {PAIRS_SQL}, g AS (SELECT template, count(*) AS n FROM p GROUP BY template) SELECT read_id, CASE WHEN length(text) < 100 THEN 'debris' WHEN n = 2 THEN 'paired' ELSE 'unpaired' END AS bucket FROM p JOIN g USING (template) JOIN documents ON doc_id = read_id")
def pool_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = reads(spark, sf_dir).select("read_id", F.length("text").alias("n"))
    return pair_resolve(spark, sf_dir).join(n, "read_id").select("read_id", pool.bucket(F.col("pair_size"), F.col("n") >= 100).alias("bucket"))


@query(kq.HITS_SQL + " SELECT read_id, CAST(hits AS BIGINT) AS hits FROM h WHERE hits >= 11")
def phage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.library_matches(reads(spark, sf_dir), kq._baits(spark, sf_dir), K, 11, "read_id")


@query(
    f"""WITH {kq.KM_SQL}, ak AS (SELECT DISTINCT item_id AS adaptor_id, substr(s, pos + 1, {K}) AS kmer FROM (SELECT item_id, s, unnest(range(0, length(s) - {K} + 1)) AS pos FROM (SELECT item_id, translate(text, '{LETTERS}', '{AS_BASES}') AS s FROM benchmark))
 WHERE regexp_full_match(substr(s, pos + 1, {K}), '[ACGT]{{{K}}}')), e AS (SELECT read_id, adaptor_id, count(*) AS n, min(pos) AS r FROM km JOIN ak USING (kmer) GROUP BY ALL HAVING count(*) >= 4),
k AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY n DESC, r, adaptor_id) AS k FROM e) SELECT read_id, CAST(r AS INTEGER) AS "right", adaptor_id FROM k WHERE k = 1"""
)
def adaptor_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    adaptors = b.select(F.col("item_id").alias("adaptor_id"), kq.bases(b.text).alias("seq"))
    return pool.adaptor_clips(reads(spark, sf_dir), adaptors, K, 4)


@query(
    f"""WITH {kq.KM_SQL}, {stats_sql()}, ok AS (SELECT * FROM ks WHERE fcount >= 2 AND rcount >= 2), ff AS (SELECT kmer FROM (SELECT kmer, count(*) OVER (PARTITION BY left(kmer, {K - 1})) AS n FROM ok) WHERE n > 1),
fr AS (SELECT kmer FROM (SELECT kmer, count(*) OVER (PARTITION BY substr(kmer, 2)) AS n FROM ok) WHERE n > 1), a AS (SELECT read_id, pos + {K - 1} AS pos FROM km WHERE kmer IN (SELECT kmer FROM ff)), b AS (SELECT read_id, pos - {K - 1} AS pos FROM km WHERE kmer IN (SELECT kmer FROM fr))
SELECT read_id, CAST(pos AS INTEGER) AS pos FROM a SEMI JOIN b USING (read_id, pos)"""
)
def repeat_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of reads between a forward and a reverse fork."""
    ok = kmers.filter_and(kq._stats(spark, sf_dir), 2, 2, 0)
    several = lambda end, name: ok.withColumn("e", F.expr(end)).join(ok.groupBy(F.expr(end).alias("e")).count().where("count > 1").select("e"), "e", "left_semi").select("kmer", F.lit(True).alias(name))
    rows = kmers.positioned(reads(spark, sf_dir), K, "read_id")
    rows = rows.join(several(f"left(kmer, {K - 1})", "f"), "kmer", "left").join(several("substring(kmer, 2)", "r"), "kmer", "left")
    return pool.repeat_positions(rows.select("read_id", "pos", F.coalesce("f", F.lit(False)).alias("fork_f"), F.coalesce("r", F.lit(False)).alias("fork_r")), K)


@query(
    f"""WITH {STEPS_SQL}, n AS (SELECT contig, start, stop, CASE WHEN start - lag(stop) OVER (PARTITION BY contig ORDER BY start) < 6 THEN 0 ELSE 1 END AS new FROM steps), z AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY start) AS part FROM n),
p AS (SELECT contig, part, min(start) AS l, max(stop) AS r FROM z GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY r - l DESC, l) AS k, count(*) OVER (PARTITION BY contig) AS parts FROM p)
SELECT contig AS read_id, l AS "left", r AS "right", CAST(parts AS BIGINT) AS parts FROM k WHERE k = 1"""
)
def chimera_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.chimera_cuts(_steps(spark, sf_dir).withColumnRenamed("contig", "read_id").select("read_id", "start", "stop"), 4)


@query(
    """WITH p AS (SELECT l_orderkey AS template, l_linenumber AS segment, l_suppkey AS contig, l_partkey AS pos FROM lineitem), r AS (SELECT *, count(*) OVER (PARTITION BY template) AS n, lead(contig) OVER w AS c1, lag(contig) OVER w AS c0, lead(pos) OVER w AS p1, lag(pos) OVER w AS p0 FROM p WINDOW w AS (PARTITION BY template ORDER BY segment, contig, pos))
SELECT template, segment, contig, pos, CASE WHEN n = 2 THEN coalesce(c1, c0) END AS mate_contig, CASE WHEN n = 2 THEN coalesce(p1, p0) END AS mate_pos FROM r"""
)
def sam_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return pool.mates(d.select(d.l_orderkey.alias("template"), d.l_linenumber.alias("segment"), d.l_suppkey.alias("contig"), d.l_partkey.alias("pos")))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation, s_suppkey AS group_id FROM customer LEFT JOIN (SELECT min(s_suppkey) AS s_suppkey, s_nationkey, 'BUILDING' AS seg FROM supplier GROUP BY s_nationkey) ON c_nationkey = s_nationkey AND c_mktsegment = seg")
def group_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min("s_suppkey").alias("id")).withColumn("segment", F.lit("BUILDING"))
    return pool.match_group(c, s, "segment", "nation")


@query("SELECT l_suppkey AS contig, l_orderkey % 20 AS locus, string_agg(DISTINCT l_shipmode, ',' ORDER BY l_shipmode) AS names, min(l_partkey) AS first, max(l_partkey + l_linenumber) AS last FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY ALL")
def locus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    f = d.select(d.l_suppkey.alias("contig"), (d.l_orderkey % 20).alias("locus"), F.concat("l_returnflag", "l_linestatus").alias("name"), d.l_partkey.alias("lo"), (d.l_partkey + d.l_linenumber).alias("hi"))
    return pool.gene_summary(f)


@query(f"WITH {PLACED_SQL}, c AS (SELECT contig, sum(len) / (max(start + len) - min(start)) AS cov FROM placed GROUP BY contig) SELECT contig, cov, CASE WHEN floor(cov) <= 8 THEN 0 WHEN floor(cov) >= 300 THEN 4 WHEN floor(cov) >= 150 THEN 3 WHEN floor(cov) >= 80 THEN 2 ELSE 1 END AS warning FROM c")
def coverage_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = placed(spark, sf_dir).groupBy("contig").agg((F.sum("len") / (F.max(F.col("start") + F.col("len")) - F.min("start"))).alias("cov"))
    return pool.high_coverage(c, 8.0)
