"""Queries on placed intervals, columns and assemblies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.operators import consensus, intervals, pileup, stats
from seqspark.plans.adapter import PLACED_SQL, READS_SQL, STEPS_SQL, placed, reads
from seqspark.plans.registry import query


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coverage(placed(spark, sf_dir)).withColumn("cov", F.col("cov").cast("long"))


def _by_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_steps(), those of a contig together: what is joined or put in order by contig stays in partitions of bounded rows."""
    return intervals.dealt(_steps(spark, sf_dir), 2 * placed(spark, sf_dir).count(), "contig")


@query(f"WITH {STEPS_SQL} SELECT * FROM steps")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir)


@query(
    f"""WITH {STEPS_SQL}, a AS (SELECT contig, min(cov) AS min_cov, max(cov) AS max_cov, sum((stop - start) * cov) AS s, sum(stop - start) AS n, sum((stop - start) * cov * cov) AS sq FROM steps GROUP BY contig)
SELECT contig, min_cov, max_cov, CAST(s AS BIGINT) AS sum_cov, CAST(n AS BIGINT) AS positions, s / n AS mean_cov, sqrt(greatest(0.0, sq / n - (s / n) * (s / n))) AS stddev_cov FROM a"""
)
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coverage_stats(_steps(spark, sf_dir))


@query(
    f"""WITH {STEPS_SQL}, m AS (SELECT contig, sum((stop - start) * cov) / sum(stop - start) AS m, sum(stop - start) AS every FROM steps GROUP BY contig),
a AS (SELECT contig, max(every) AS every, sum(stop - start) AS n, sum((stop - start) * cov) AS s, sum((stop - start) * cov * cov) AS sq FROM steps JOIN m USING (contig) WHERE cov >= m / 3 AND cov <= m * 3 GROUP BY contig)
SELECT contig, CAST(n AS BIGINT) AS positions, s / n AS mean_cov, sqrt(greatest(0.0, sq - s * (s / n)) / every) AS stddev_cov FROM a"""
)
def coverage_stats_2nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.second_order(_by_contig(spark, sf_dir))


POS_SQL = STEPS_SQL + ", ps AS (SELECT contig, unnest(range(start, stop)) AS pos, cov FROM steps)"


@query(
    "WITH "
    + POS_SQL
    + """, av AS (SELECT contig, sum(cov) / count(*) AS a FROM ps GROUP BY contig), m0 AS (SELECT contig, pos, CAST(cov >= 1.5 * a AS INTEGER) AS m FROM ps JOIN av USING (contig)),
m1 AS (SELECT contig, pos, max(m) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m FROM m0),
m2 AS (SELECT contig, pos, min(m) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m FROM m1),
g AS (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM m2 WHERE m = 1)
SELECT contig, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) AS BIGINT) AS stop, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY contig, g HAVING count(*) >= 20"""
)
def coverage_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _by_contig(spark, sf_dir)
    n = F.col("stop") - F.col("start")
    avg = steps.groupBy("contig").agg((F.sum(n * F.col("cov")) / F.sum(n)).alias("a"))
    mask = steps.join(avg, "contig").select("contig", "start", "stop", (F.col("cov") >= 1.5 * F.col("a")).alias("m"))
    return stats.closed_islands(mask, 10, 20)


@query("WITH " + POS_SQL + " SELECT contig, pos // 4 AS span, CASE WHEN count(*) < 4 THEN 0 ELSE CAST(sum(cov) AS BIGINT) // 4 END AS mean_cov FROM ps GROUP BY contig, pos // 4")
def wiggle_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean coverage (whole numbers) of spans of 4 positions; 0 where one is uncovered."""
    return stats.span_means(_by_contig(spark, sf_dir), 4)


@query(
    f"""WITH {READS_SQL}, b AS (SELECT read_id, pos, CAST(substr(seq, pos + 1, 1) IN ('G', 'C') AS INTEGER) AS gc FROM (SELECT read_id, seq, unnest(range(0, length(seq))) AS pos FROM reads)),
w AS (SELECT read_id, pos, sum(gc) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) AS gc, count(*) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) AS n FROM b)
SELECT read_id, CAST(count(*) AS BIGINT) AS windows, CAST(max(gc) AS BIGINT) AS most, CAST(min(gc) AS BIGINT) AS least FROM w WHERE pos % 4 = 0 AND n = 50 GROUP BY read_id"""
)
def gc_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G and C in windows of 50 bases, 4 apart: how many windows a read has, and their extremes."""
    letters = F.split("seq", "")
    rows = reads(spark, sf_dir).where(F.length("seq") > 0).select("read_id", F.posexplode(F.slice(letters, F.lit(1), F.length("seq"))).alias("pos", "base"))
    w = W.partitionBy("read_id").orderBy("pos").rowsBetween(-25, 24)
    found = rows.select("read_id", "pos", F.sum(F.col("base").isin("G", "C").cast("int")).over(w).alias("gc"), F.count("*").over(w).alias("n"))
    return found.where("pos % 4 = 0 and n = 50").groupBy("read_id").agg(F.count("*").alias("windows"), F.max("gc").alias("most"), F.min("gc").alias("least"))


LEN_SQL = "ln AS (SELECT o_orderkey, count(*) * 100 + o_orderkey % 97 AS len FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select("o_orderkey", (F.col("n") * 100 + F.col("o_orderkey") % 97).alias("len"))


@query(
    f"""WITH {LEN_SQL}, r AS (SELECT len, sum(len) OVER (ORDER BY len DESC RANGE UNBOUNDED PRECEDING) AS run, sum(len) OVER () AS total FROM ln)
SELECT CAST(count(*) AS BIGINT) AS contigs, CAST(max(total) AS BIGINT) AS total, CAST(max(len) AS BIGINT) AS longest, CAST(max(len) FILTER (WHERE run >= total * 0.5) AS BIGINT) AS n50,
 CAST(max(len) FILTER (WHERE run >= total * 0.9) AS BIGINT) AS n90, CAST(max(len) FILTER (WHERE run >= total * 0.95) AS BIGINT) AS n95 FROM r"""
)
def n50_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.n_stats(_lengths(spark, sf_dir), 0.5, 0.9, 0.95)


@query(f"WITH {LEN_SQL} SELECT o_orderkey, CAST(len AS BIGINT) AS len FROM ln WHERE len >= 600 OR (len >= 400 AND len % 5 = 0) OR (len >= 200 AND len % 50 = 0)")
def significant_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs that reach a rung of a ladder of lengths and coverages."""
    n = F.col("len")
    return _lengths(spark, sf_dir).where((n >= 600) | ((n >= 400) & (n % 5 == 0)) | ((n >= 200) & (n % 50 == 0)))


@query(
    "WITH "
    + STEPS_SQL
    + """, m AS (SELECT contig, sum((stop - start) * cov) / sum(stop - start) AS a FROM steps GROUP BY contig), h AS (SELECT contig, start, stop FROM steps JOIN m USING (contig) WHERE cov >= 1.5 * a),
f AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY contig ORDER BY start) <= 10 THEN 0 ELSE 1 END AS new FROM h), z AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY start) AS zone FROM f)
SELECT contig, min(start) AS start, max(stop) AS stop, CAST(max(stop) - min(start) AS BIGINT) AS len FROM z GROUP BY contig, zone HAVING max(stop) - min(start) >= 40"""
)
def multicopy_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of high coverage, over gaps of up to 10 positions, of 40 positions at least."""
    steps = _by_contig(spark, sf_dir)
    n, w = F.col("stop") - F.col("start"), W.partitionBy("contig").orderBy("start")
    avg = steps.groupBy("contig").agg((F.sum(n * F.col("cov")) / F.sum(n)).alias("a"))
    high = steps.join(avg, "contig").where("cov >= 1.5 * a")
    zone = high.withColumn("new", F.when(F.col("start") - F.lag("stop").over(w) <= 10, 0).otherwise(1)).withColumn("zone", F.sum("new").over(w))
    out = zone.groupBy("contig", "zone").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return out.select("contig", "start", "stop", (F.col("stop") - F.col("start")).alias("len")).where("len >= 40")


PILE_SQL = """pile AS (SELECT l_suppkey AS contig, l_partkey % 50 AS pos, substr('ACGT*', CAST(l_orderkey % 5 + 1 AS BIGINT), 1) AS base, CAST(floor(l_quantity) AS BIGINT) AS qual, l_returnflag = 'R' AS rev FROM lineitem),
rk AS (SELECT *, row_number() OVER (PARTITION BY contig, pos, base, rev ORDER BY qual DESC) AS r FROM pile),
gr AS (SELECT contig, pos, base, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE NOT rev) AS BIGINT) AS fwd, CAST(count(*) FILTER (WHERE rev) AS BIGINT) AS bwd,
 CAST(least(90, coalesce(sum(qual) FILTER (WHERE r = 1), 0) + floor(coalesce(sum(qual) FILTER (WHERE r = 2), 0) / 10)) AS BIGINT) AS quality FROM rk GROUP BY ALL)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _groups_of(d: DataFrame) -> DataFrame:
    base = F.substr(F.lit("ACGT*"), (F.col("l_orderkey") % 5 + 1).cast("int"), F.lit(1))
    return pileup.groups(d.select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") % 50).alias("pos"), base.alias("base"), F.floor("l_quantity").alias("qual"), (F.col("l_returnflag") == "R").alias("rev")))


@query(f"WITH {PILE_SQL} SELECT * FROM gr")
def group_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


MAJORITY_SQL = PILE_SQL + ", mj AS (SELECT contig, pos, base, n, quality FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY n DESC, CASE base WHEN '*' THEN 9 ELSE instr('ACGT', base) END) AS k FROM gr) WHERE k = 1)"


@query(f"WITH {MAJORITY_SQL} SELECT * FROM mj")
def consensus_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.majority(_groups(spark, sf_dir))


@query(
    f"""WITH {PILE_SQL}, wt AS (SELECT *, CASE WHEN fwd >= 2 AND bwd >= 2 THEN n * 2 WHEN fwd >= 1 AND bwd >= 1 THEN n * 3 // 2 ELSE n END AS w FROM gr), mx AS (SELECT *, max(w) OVER (PARTITION BY contig, pos) AS most FROM wt),
kp AS (SELECT contig, pos, bit_or(CASE base WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 0 END) AS bits, count(*) AS groups FROM mx WHERE w >= most // 2 OR (fwd >= 2 AND bwd >= 2) GROUP BY contig, pos)
SELECT contig, pos, substr('-ACMGRSVTWYHKDBN', CAST(bits + 1 AS BIGINT), 1) AS letter, CAST(groups AS BIGINT) AS groups FROM kp"""
)
def consensus_shortread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.short_read_consensus(_groups(spark, sf_dir))


STRAIN_SQL = MAJORITY_SQL.replace("SELECT l_suppkey AS contig, l_partkey % 50", "SELECT s_nationkey AS contig, l_partkey % 50").replace("FROM lineitem)", "FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)", 1)


@query(f"WITH {STRAIN_SQL}, st AS (SELECT contig AS strain, pos, base FROM mj) SELECT a.pos, a.strain AS strain1, b.strain AS strain2, a.base AS base1, b.base AS base2 FROM st a JOIN st b ON a.pos = b.pos WHERE a.strain < b.strain AND a.base <> b.base")
def snp_between_strains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in which strains differ; all reads of a nation's suppliers are a strain."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    st = pileup.majority(_groups_of(d.withColumn("l_suppkey", F.col("s_nationkey")))).select(F.col("contig").alias("strain"), "pos", "base")
    return pileup.strain_differences(st).select("pos", "strain1", "strain2", "base1", "base2")


@query(
    """WITH t AS (SELECT l_suppkey AS contig, l_partkey AS start, CASE l_linenumber % 3 WHEN 0 THEN 'SRMc' WHEN 1 THEN 'SROc' ELSE 'UNSc' END AS id, l_orderkey, l_linenumber FROM lineitem)
SELECT contig, start, id, CAST(count(*) AS BIGINT) AS n FROM t WHERE id <> 'UNSc' OR (contig, start) NOT IN (SELECT contig, start FROM t WHERE id = 'SRMc') GROUP BY ALL"""
)
def tag_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_linenumber") % 3
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("start"), F.when(i == 0, "SRMc").when(i == 1, "SROc").otherwise("UNSc").alias("id"))
    return pileup.tag_precedence(t, ["SRMc"], ["UNSc"]).groupBy("contig", "start", "id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {READS_SQL} SELECT lang, source, CAST(count(*) AS BIGINT) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(min(length(seq)) AS BIGINT) AS shortest, CAST(max(length(seq)) AS BIGINT) AS longest FROM reads GROUP BY ROLLUP (lang, source)"""
)
def read_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("seq")
    return reads(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("reads"), F.sum(n).cast("long").alias("bases"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"))


@query(
    f"""WITH {PLACED_SQL}, f AS (SELECT s_suppkey AS contig, s_suppkey * 3 AS lo, s_suppkey * 3 + 40 AS hi FROM supplier)
SELECT contig, lo, hi, CAST(count(*) AS BIGINT) AS reads FROM f JOIN placed USING (contig) WHERE start <= hi AND start + len > lo GROUP BY ALL"""
)
def feature_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed reads that touch a feature's interval."""
    f = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("contig"), (F.col("s_suppkey") * 3).alias("lo"), (F.col("s_suppkey") * 3 + 40).alias("hi"))
    own = placed(spark, sf_dir).select("contig", "start", (F.col("start") + F.col("len")).alias("stop"))
    hits = intervals.touching(f.withColumn("hi", F.col("hi") + 1), own)
    return hits.groupBy("contig", "lo", (F.col("hi") - 1).alias("hi")).agg(F.count("*").alias("reads"))


@query(
    "WITH "
    + STEPS_SQL
    + """, m AS (SELECT contig, sum((stop - start) * cov) / sum(stop - start) AS a, sum(stop - start) AS n FROM steps GROUP BY contig)
SELECT contig, CAST(coalesce(sum(stop - start) FILTER (WHERE cov < 0.75 * a), 0) AS BIGINT) AS low, CAST(coalesce(sum(stop - start) FILTER (WHERE cov > 1.25 * a), 0) AS BIGINT) AS high, CAST(max(n) AS BIGINT) AS positions,
 CASE WHEN coalesce(sum(stop - start) FILTER (WHERE cov < 0.75 * a), 0) >= 0.15 * max(n) AND coalesce(sum(stop - start) FILTER (WHERE cov > 1.25 * a), 0) >= 0.15 * max(n) THEN 1 ELSE 0 END AS smile
FROM steps JOIN m USING (contig) GROUP BY contig"""
)
def smile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions far below and above a contig's mean coverage, and whether both are 15% or more."""
    steps = _by_contig(spark, sf_dir)
    n = F.col("stop") - F.col("start")
    avg = steps.groupBy("contig").agg((F.sum(n * F.col("cov")) / F.sum(n)).alias("a"), F.sum(n).alias("n"))
    part = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0).cast("long"))
    out = steps.join(avg, "contig").groupBy("contig").agg(part(F.col("cov") < 0.75 * F.col("a")).alias("low"), part(F.col("cov") > 1.25 * F.col("a")).alias("high"), F.max("n").alias("positions"))
    return out.withColumn("smile", ((F.col("low") >= 0.15 * F.col("positions")) & (F.col("high") >= 0.15 * F.col("positions"))).cast("int"))


LARGEST_SQL = """, o AS (SELECT *, CASE base WHEN '*' THEN 5 ELSE instr('ACGT', base) END AS o FROM gr), k AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY n DESC, o DESC) AS k FROM o),
t AS (SELECT contig, pos, max(n) FILTER (WHERE k = 1) AS n1, max(base) FILTER (WHERE k = 1) AS b1, max(quality) FILTER (WHERE k = 1) AS q1, coalesce(max(n) FILTER (WHERE k = 2), 0) AS n2, coalesce(max(quality) FILTER (WHERE k = 2), 0) AS q2 FROM k GROUP BY contig, pos),
s AS (SELECT *, {swap} AS swap FROM t), m AS (SELECT contig, pos, CASE WHEN swap THEN n2 ELSE n1 END AS most, CASE WHEN swap THEN n1 ELSE n2 END AS nxt, CASE WHEN swap THEN q1 ELSE q2 END AS nq FROM s),
z AS (SELECT contig, pos, most, nxt, nq, count(*) AS c, max(base) AS base, sum(quality) AS total, bit_or(CASE base WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 0 END) AS bits FROM m JOIN gr USING (contig, pos) WHERE n = most GROUP BY ALL),
d AS (SELECT *, CASE WHEN nxt > 0 AND most - nxt < 10 THEN total - nq ELSE total END AS dq FROM z)
SELECT contig, pos, CASE WHEN c = 1 THEN base ELSE substr('-ACMGRSVTWYHKDBN', CAST(bits + 1 AS BIGINT), 1) END AS letter, CAST(CASE WHEN c > 1 THEN total // c WHEN dq < 0 THEN greatest(abs(dq), 10) ELSE dq END AS BIGINT) AS quality FROM d"""


@query(f"WITH {PILE_SQL}" + LARGEST_SQL.replace("{swap}", "b1 = '*' AND n2 > 0 AND 100 * n2 // (n1 + n2) >= 40"))
def consensus_gap_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule for pyrosequenced and ion reads."""
    return pileup.largest_group_consensus(_groups(spark, sf_dir), gap_yields=True)


@query(f"WITH {PILE_SQL}" + LARGEST_SQL.replace("{swap}", "false"))
def consensus_long_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule for corrected long reads."""
    return pileup.largest_group_consensus(_groups(spark, sf_dir), gap_yields=False)


@query(
    f"""WITH {PILE_SQL}, o AS (SELECT *, CASE base WHEN '*' THEN 5 ELSE instr('ACGT', base) END AS o, max(n) OVER (PARTITION BY contig, pos) AS most FROM gr)
SELECT contig, pos, arg_min(base, o) FILTER (WHERE n = most) AS base, arg_min(quality, o) FILTER (WHERE n = most) AS quality, string_agg(base, '' ORDER BY o) FILTER (WHERE n >= most // 2) AS chosen FROM o GROUP BY contig, pos"""
)
def consensus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.text_consensus(_groups(spark, sf_dir))


@query(f"WITH {STEPS_SQL}, ps AS (SELECT contig, unnest(range(start, stop)) AS pos, cov FROM steps) SELECT contig, median(cov) AS median_cov FROM ps GROUP BY contig")
def coverage_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.median_coverage(_steps(spark, sf_dir))


@query(
    "WITH "
    + POS_SQL
    + """, b AS (SELECT contig, sum(cov) / count(*) AS m, count(*) AS every FROM ps GROUP BY contig),
i AS (SELECT contig, median(cov) AS cm, sum(cov) AS s, sum(cov * cov) AS q, count(*) AS n, max(every) AS every FROM ps JOIN b USING (contig) WHERE cov >= m / 3 AND cov <= m * 3 GROUP BY contig),
w AS (SELECT contig, cm, sqrt(greatest(0.0, q - s * (s / n)) / every) AS cs FROM i), f AS (SELECT s_suppkey AS contig, s_suppkey * 3 AS lo, s_suppkey * 3 + 40 AS hi FROM supplier),
fp AS (SELECT contig, lo, hi, unnest(range(lo, hi + 1)) AS pos FROM f), g AS (SELECT contig, lo, hi, median(coalesce(cov, 0)) AS fm, sum(coalesce(cov, 0)) / count(*) AS a, sum(coalesce(cov * cov, 0)) / count(*) AS q2 FROM fp LEFT JOIN ps USING (contig, pos) GROUP BY ALL),
d AS (SELECT contig, lo, hi, fm, sqrt(greatest(0.0, q2 - a * a)) AS fs, cs, CAST(trunc(cm) AS BIGINT) AS c, CAST(trunc(cs) AS BIGINT) AS e FROM g JOIN w USING (contig))
SELECT contig, lo, hi, fm AS median_cov, fs AS stddev_cov, CASE WHEN trunc(fm + fs) < c - e THEN CASE WHEN trunc(fm + 2 * fs) < c - 2 * e THEN 'probable' ELSE 'possible' END || CASE WHEN fm < cs THEN '_deletion' ELSE '_CNV_down' END
 WHEN trunc(fm - fs) > c + e THEN CASE WHEN trunc(fm - 2 * fs) > c + e THEN 'probable' ELSE 'possible' END || '_CNV_up' ELSE 'normal' END AS verdict FROM d"""
)
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("contig"), (F.col("s_suppkey") * 3).alias("lo"), (F.col("s_suppkey") * 3 + 40).alias("hi"))
    return stats.feature_coverage(_by_contig(spark, sf_dir), f)


@query(f"WITH {LEN_SQL} SELECT o_orderkey, CAST(len AS BIGINT) AS len, (len >= 300 AND o_orderkey % 30 >= 15) OR (o_orderkey % 7 <> 0 AND len >= 600 AND o_orderkey % 30 >= 10) AS large FROM ln")
def large_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _lengths(spark, sf_dir).withColumns({"cov": F.col("o_orderkey") % 30, "repeats": F.col("o_orderkey") % 7 == 0})
    return stats.large_contigs(c, 300, 15.0).select("o_orderkey", "len", "large")


_VERDICTS = " ".join(f"WHEN s_acctbal / 1000 < {rung} THEN '{name}'" for rung, name in zip(stats.CHIMERA_RUNGS, stats.CHIMERA_VERDICTS))


@query(f"SELECT s_suppkey AS id, CASE WHEN s_acctbal <= 0 THEN NULL {_VERDICTS} ELSE '{stats.CHIMERA_VERDICTS[-1]}' END AS verdict FROM supplier")
def chimera_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), stats.chimera_verdict(F.col("s_acctbal") / 1000).alias("verdict"))


@query("SELECT l_suppkey AS contig, CAST(l_orderkey AS BIGINT) AS read_id, l_partkey AS start, l_partkey + CAST(floor(l_quantity) AS BIGINT) - 1 AS stop, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_quantity) AS INTEGER) AS place FROM lineitem")
def contig_read_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each contig in order of place."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = W.partitionBy("l_suppkey").orderBy("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return d.select(F.col("l_suppkey").alias("contig"), F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.floor("l_quantity") - 1).alias("stop"), F.row_number().over(w).alias("place"))


QUALITY_SQL = """qc AS (SELECT *, instr('ACGT*', base) AS o, fwd > 0 AND bwd > 0 AS paired, max(quality) OVER w AS most, sum(quality) OVER w AS every FROM {source} WINDOW w AS (PARTITION BY contig, pos)),
qk AS (SELECT *, quality >= 30 OR quality + 5 >= most OR n >= 3 AND quality >= 20 AND paired AS c, CASE base WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 0 END AS bit FROM qc),
qs AS (SELECT contig, pos, any_value(most) AS most, any_value(every) AS every, count(*) FILTER (c) AS nc, count(*) FILTER (c AND quality >= 30 AND paired) AS ng, any_value(base) FILTER (c) AS b1, any_value(quality) FILTER (c) AS q1,
 any_value(base) FILTER (c AND quality >= 30 AND paired) AS bg, any_value(quality) FILTER (c AND quality >= 30 AND paired) AS qg, list(base ORDER BY o) FILTER (c) AS chosen, bit_or(bit) FILTER (c) AS bits, sum(quality) FILTER (c) AS qsum,
 count(*) FILTER (quality = most) AS nm, bool_or(quality = most AND base = '*') AS gm, max({{'s': CASE WHEN paired THEN n * 2 ELSE n END, 'o': o, 'b': base, 'q': quality}}) FILTER (c) AS top FROM qk GROUP BY contig, pos),
ql AS (SELECT contig, pos, chosen, CASE WHEN nc = 1 THEN b1 WHEN ng = 1 THEN bg WHEN gm AND nm = 1 THEN '*' ELSE substr('-ACMGRSVTWYHKDBN', CAST(bits + 1 AS BIGINT), 1) END AS letter, CASE WHEN nc = 1 THEN b1 WHEN ng = 1 THEN bg ELSE top.b END AS single,
 CAST(CASE WHEN nc = 1 THEN greatest(0, most - every + q1) WHEN ng = 1 THEN greatest(0, most - every + qg) WHEN gm AND nm = 1 THEN most ELSE qsum // nc END AS BIGINT) AS quality,
 CAST(CASE WHEN nc = 1 THEN greatest(0, most - every + q1) WHEN ng = 1 THEN greatest(0, most - every + qg) ELSE top.q END AS BIGINT) AS single_quality FROM qs)"""


@query(f"WITH {PILE_SQL}, {QUALITY_SQL.format(source='gr')} SELECT contig, pos, letter, quality, array_to_string(chosen, '') AS chosen FROM ql")
def consensus_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.quality_calls(_groups(spark, sf_dir)).withColumn("chosen", F.array_join("chosen", ""))


@query(f"WITH {PILE_SQL}, {QUALITY_SQL.format(source='gr')} SELECT contig, pos, single AS letter, single_quality AS quality FROM ql")
def consensus_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.quality_calls(_groups(spark, sf_dir), single=True).drop("chosen")


TECH = "CASE WHEN l_linenumber % 2 = 0 THEN 'sanger' ELSE 'short' END"
TECH_PILE_SQL = PILE_SQL.replace("l_suppkey AS contig, l_partkey % 50 AS pos", f"l_suppkey AS contig, {TECH} AS tech, l_partkey % 50 AS pos").replace("PARTITION BY contig, pos, base", "PARTITION BY contig, tech, pos, base").replace("SELECT contig, pos, base, CAST(count(*)", "SELECT contig, tech, pos, base, CAST(count(*)")


def _hybrid_sql(several: bool) -> str:
    near = "(tech <> 'short' OR quality >= CASE WHEN top > 30 THEN top - 30 ELSE 0 END)"
    letter = "substr('-ACMGRSVTWYHKDBN', CAST(bits + 1 AS BIGINT), 1)"
    base = "CASE WHEN len(lf) = 1 THEN lf[1] END" if several else "CASE WHEN len(lf) = 1 THEN lf[1] WHEN len(picks) = 1 THEN CASE WHEN list_contains(lf, picks[1]) THEN picks[1] ELSE '*' END ELSE mostly END"
    return f"""WITH {TECH_PILE_SQL}, sq AS (SELECT * FROM gr WHERE tech = 'sanger'), {QUALITY_SQL.format(source='sq')},
sw AS (SELECT *, instr('ACGT*', base) AS o, CASE WHEN fwd >= 2 AND bwd >= 2 THEN n * 2 WHEN fwd >= 1 AND bwd >= 1 THEN n * 3 // 2 ELSE n END AS w FROM gr WHERE tech = 'short'), sm AS (SELECT *, max(w) OVER (PARTITION BY contig, pos) AS mw FROM sw),
sl AS (SELECT contig, pos, list(base ORDER BY o) AS chosen, max({{'w': w, 'o': -o, 'b': base}}).b AS letter FROM sm WHERE w >= mw // 2 OR fwd >= 2 AND bwd >= 2 GROUP BY contig, pos),
ca AS (SELECT contig, pos, 'sanger' AS tech, letter, chosen FROM ql UNION ALL SELECT contig, pos, 'short', letter, chosen FROM sl),
lv AS (SELECT g.*, instr('ACGT*', g.base) AS o, CASE base WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 0 END AS bit, CASE g.tech WHEN 'sanger' THEN CASE WHEN fwd > 0 AND bwd > 0 THEN CASE WHEN quality >= 35 THEN 0 WHEN quality >= 25 THEN 1 ELSE 2 END WHEN n >= 3 AND len(chosen) = 1 THEN 3 ELSE 4 END
  ELSE CASE WHEN fwd > 0 AND bwd > 0 AND n >= 12 AND quality >= 35 THEN 0 WHEN fwd > 0 AND bwd > 0 AND n >= 8 AND quality >= 30 THEN 1 WHEN fwd > 0 AND bwd > 0 AND n >= 6 AND quality >= 25 THEN 2 WHEN quality >= 20 AND n >= 4 AND len(chosen) = 1 THEN 3 WHEN quality >= 10 THEN 4 ELSE 5 END END AS level
  FROM gr g JOIN ca USING (contig, pos, tech)),
be AS (SELECT *, min(level) OVER (PARTITION BY contig, pos) AS best, max(quality) FILTER (tech = 'short') OVER (PARTITION BY contig, pos) AS top FROM lv),
k1 AS (SELECT * FROM be WHERE level <= best + 2), n1 AS (SELECT contig, pos, count(DISTINCT base) AS d FROM k1 GROUP BY ALL),
k2 AS (SELECT k1.* FROM k1 JOIN n1 USING (contig, pos) WHERE d = 1 OR {near}), n2 AS (SELECT contig, pos, count(DISTINCT base) AS d FROM k2 GROUP BY ALL),
k3 AS (SELECT k2.* FROM k2 JOIN n2 USING (contig, pos) WHERE d = 1 OR {near} AND level <= best + {1 if several else 0}),
po AS (SELECT contig, pos, list(DISTINCT x) AS possible, list(DISTINCT pick) FILTER (pick IS NOT NULL) AS picks FROM (SELECT contig, pos, unnest(chosen) AS x, CASE WHEN letter IN ('A', 'C', 'G', 'T', '*') THEN letter END AS pick FROM ca) GROUP BY ALL),
mo AS (SELECT contig, pos, list(base) AS kept, max({{'n': n, 'o': o, 'b': base}}).b AS mostly FROM (SELECT contig, pos, base, any_value(o) AS o, sum(n) AS n FROM k3 GROUP BY ALL) GROUP BY contig, pos),
lf AS (SELECT contig, pos, picks, mostly, CASE WHEN len(possible) > 1 THEN coalesce(kept, []) ELSE possible END AS lf FROM po LEFT JOIN mo USING (contig, pos)),
ba AS (SELECT *, {base} AS base, list_sum(list_transform(lf, lambda x: CASE x WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 0 END)) AS bits FROM lf),
qq AS (SELECT ba.contig, ba.pos, max(lv.quality) FILTER (lv.base = ba.base) AS qm, sum(lv.quality) FILTER (lv.base = ba.base) AS qs, sum(lv.quality) FILTER (lv.base = '*' OR lv.bit & CAST(ba.bits AS BIGINT) > 0) AS cs, count(*) FILTER (lv.base = '*' OR lv.bit & CAST(ba.bits AS BIGINT) > 0) AS cn FROM ba JOIN lv USING (contig, pos) GROUP BY ALL)
SELECT contig, pos, CASE WHEN len(lf) = 0 THEN 'X' ELSE coalesce(base, {letter}) END AS letter, CAST(CASE WHEN len(lf) = 0 THEN 0 WHEN base IS NOT NULL THEN coalesce(greatest(qm, qs * 75 // 100), 0) ELSE cs // cn END AS BIGINT) AS quality FROM ba JOIN qq USING (contig, pos)"""


def _hybrid(spark: SparkSession, sf_dir: str, several: bool) -> DataFrame:
    """Even lines of an order stand for bases of long reads, odd ones for those of short reads."""
    tech = F.when(F.col("l_linenumber") % 2 == 0, consensus.SANGER).otherwise(consensus.SHORT)
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_suppkey", F.struct(F.col("l_suppkey").alias("c"), tech.alias("tech")))
    g = _groups_of(d).select(F.col("contig.c").alias("contig"), "contig.tech", "pos", "base", "n", "fwd", "bwd", "quality")
    of = lambda t: g.where(F.col("tech") == t).drop("tech")
    long = consensus.quality_calls(of(consensus.SANGER)).select("contig", "pos", F.lit(consensus.SANGER).alias("tech"), "letter", "chosen")
    short = consensus.short_chosen(of(consensus.SHORT)).select("contig", "pos", F.lit(consensus.SHORT).alias("tech"), "letter", "chosen")
    return consensus.hybrid_calls(g, long.union(short), several)


@query(_hybrid_sql(False))
def consensus_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, False)


@query(_hybrid_sql(True))
def consensus_hybrid_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, True)


@query(
    f"""WITH {PILE_SQL.replace("l_suppkey AS contig, l_partkey % 50 AS pos", "l_suppkey * 10 + l_linenumber % 3 AS contig, l_partkey % 50 AS pos")}, {QUALITY_SQL.format(source='gr')}
SELECT contig // 10 AS contig, contig % 10 AS strain, string_agg(single, '' ORDER BY pos) AS seq, coalesce(string_agg(single, '' ORDER BY pos) FILTER (single <> '*'), '') AS unpadded, CAST(coalesce(sum(single_quality) FILTER (single <> '*'), 0) AS BIGINT) AS quality FROM ql GROUP BY contig"""
)
def strain_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of each strain of a contig; the number of a line modulo three stands for the strain."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_suppkey", F.struct(F.col("l_suppkey").alias("c"), (F.col("l_linenumber") % 3).alias("strain")))
    g = _groups_of(d).select(F.col("contig.c").alias("contig"), "contig.strain", "pos", "base", "n", "fwd", "bwd", "quality")
    out = consensus.sequences(consensus.by_strain(g), "contig", "strain")
    return out.select("contig", "strain", "seq", "unpadded", F.aggregate("quals", F.lit(0).cast("long"), lambda a, x: a + x).alias("quality"))
