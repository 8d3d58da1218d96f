"""Queries on k-mers and baits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators import bait, kmers
from seqspark.plans.adapter import K, KM_SQL, RC, READS_SQL, TURNS_SQL, bases, reads, stats_sql, turns
from seqspark.plans.registry import query

BAIT_SQL = f"""bk AS (SELECT DISTINCT substr(s, pos + 1, {K}) AS kmer FROM (SELECT s, unnest(range(0, length(s) - {K} + 1)) AS pos FROM (SELECT translate(text, '{{0}}', '{{1}}') AS s FROM benchmark)) WHERE regexp_full_match(substr(s, pos + 1, {K}), '[ACGT]{{{{{K}}}}}')),
baits AS (SELECT kmer FROM bk UNION SELECT {RC.format("kmer")} FROM bk)"""


def _bait_sql() -> str:
    from seqspark.plans.adapter import AS_BASES, LETTERS

    return BAIT_SQL.format(LETTERS, AS_BASES)


def _baits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(bases(b.text).alias("seq"))


def _stats(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    r = reads(spark, sf_dir)
    return kmers.count(kmers.kmers(r.where(where) if where else r, K, "seqtype"), K)


HITS_SQL = f"WITH {KM_SQL}, {_bait_sql()}, h AS (SELECT read_id, count(*) AS hits FROM km WHERE kmer IN (SELECT kmer FROM baits) GROUP BY read_id)"


@query(HITS_SQL + " SELECT read_id, CAST(hits AS BIGINT) AS hits FROM h WHERE hits >= 3")
def bait_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bait.hits(reads(spark, sf_dir), _baits(spark, sf_dir), K, "read_id").where("hits >= 3")


@query(HITS_SQL + f" SELECT reads.read_id, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM reads LEFT JOIN h USING (read_id) WHERE coalesce(hits, 0) < greatest(0, length(seq) - {K - 1} - 800)")
def bait_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bait.take(reads(spark, sf_dir), _baits(spark, sf_dir), K, -800, "read_id").where("not taken").select("read_id", "hits")


@query(
    f"""WITH {TURNS_SQL}, {_bait_sql()}, tk AS (SELECT template, segment, substr(seq, pos + 1, {K}) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - {K} + 1)) AS pos FROM turns)),
h AS (SELECT template, segment, count(*) AS hits FROM tk WHERE kmer IN (SELECT kmer FROM baits) GROUP BY ALL),
t AS (SELECT template, segment, coalesce(hits, 0) AS hits FROM turns LEFT JOIN h USING (template, segment))
SELECT template, segment, CAST(hits AS BIGINT) AS hits, hits >= 2 AS taken, max(hits >= 2) OVER (PARTITION BY template) AS kept FROM t"""
)
def bait_pair_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bait.take(turns(spark, sf_dir), _baits(spark, sf_dir), K, 2, "template", "segment")
    return bait.rescue(t, "template").select("template", "segment", "hits", "taken", "kept")


@query(f"WITH {KM_SQL} SELECT kmer, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT read_id) AS BIGINT) AS reads, CAST(min(pos) AS BIGINT) AS low_pos FROM km GROUP BY kmer")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kmers.positioned(reads(spark, sf_dir), K, "read_id")
    each = rows.groupBy("kmer", "read_id").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    return each.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("reads"), F.min("p").cast("long").alias("low_pos"))


@query(f"WITH {KM_SQL}, {stats_sql()} SELECT * FROM ks")
def kmer_count_fr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query(f"WITH {KM_SQL}, {stats_sql()} SELECT fcount + rcount AS n, CAST(count(*) AS BIGINT) AS kmers FROM ks GROUP BY 1")
def kmer_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).groupBy(kmers.total().alias("n")).agg(F.count("*").alias("kmers"))


@query(f"WITH {KM_SQL}, {stats_sql()} SELECT * FROM ks WHERE fcount >= 2 AND rcount >= 2 AND fcount + rcount >= 6")
def kmer_filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.filter_and(_stats(spark, sf_dir), 2, 2, 6)


@query(f"WITH {KM_SQL}, {stats_sql()} SELECT * FROM ks WHERE (fcount >= 4 AND rcount >= 4) OR fcount + rcount >= 20")
def kmer_filter_andor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.filter_andor(_stats(spark, sf_dir), 4, 4, 20)


TWO = f"WITH {KM_SQL}, {stats_sql('ka', chr(87) + 'HERE lang = ' + chr(39) + 'en' + chr(39))}, {stats_sql('kb', chr(87) + 'HERE lang = ' + chr(39) + 'de' + chr(39))}"


@query(TWO + " SELECT * FROM ka WHERE kmer NOT IN (SELECT kmer FROM kb)")
def kmer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.difference(_stats(spark, sf_dir, "lang = 'en'"), _stats(spark, sf_dir, "lang = 'de'"))


@query(TWO + " SELECT * FROM ka WHERE kmer IN (SELECT kmer FROM kb)")
def kmer_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.intersection(_stats(spark, sf_dir, "lang = 'en'"), _stats(spark, sf_dir, "lang = 'de'"))


AVG_SQL = f"""WITH {KM_SQL}, {stats_sql()},
bc AS (SELECT fcount + rcount AS c, count(*) AS n, count(*) FILTER (WHERE fcount >= 1 AND rcount >= 1) AS good FROM ks GROUP BY 1),
rk AS (SELECT *, sum(n) OVER (ORDER BY c) AS upto, sum(n) OVER () AS size FROM bc),
ins AS (SELECT part, c, n, good, upto, size, greatest(0, least(upto, size - size // part) - greatest(upto - n, size // part)) AS inside FROM rk, (VALUES (20), (10)) p(part)),
wt AS (SELECT part, c, upto - n >= size - size // 10 AS late, inside * c AS every, CASE WHEN inside = n THEN good * c ELSE floor(good * inside / n) * c END AS sure FROM ins),
pk AS (SELECT part, c, late, CASE WHEN sum(sure) OVER (PARTITION BY part) > 0 THEN sure ELSE every END AS w FROM wt),
rn AS (SELECT part, c, late, sum(w) OVER (PARTITION BY part ORDER BY c) AS run, sum(w) OVER (PARTITION BY part) AS total FROM pk),
fd AS (SELECT part, min(c) AS c, arg_min(late, c) AS late FROM rn WHERE run > floor(total / 2) GROUP BY part),
av AS (SELECT CAST(greatest(CASE WHEN (SELECT late FROM fd WHERE part = 20) THEN (SELECT c FROM fd WHERE part = 10) ELSE (SELECT c FROM fd WHERE part = 20) END, 1) AS BIGINT) AS avg_freq)"""


@query(AVG_SQL + " SELECT avg_freq FROM av")
def kmer_avg_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.average_frequency(_stats(spark, sf_dir))


CLASS_SQL = """CASE WHEN n = 1 THEN 0 WHEN n <= 2 THEN 1 WHEN n > floor(a * 20.0) THEN 7 WHEN n > floor(a * 8.0) THEN 6 WHEN n >= floor(a * 2.0) THEN 5
 WHEN n > floor(a * 1.6) THEN 4 WHEN n >= floor(a * 0.4) THEN 3 ELSE 2 END"""
CLASSED_SQL = AVG_SQL + f", cl AS (SELECT kmer, {CLASS_SQL} AS class FROM (SELECT kmer, fcount + rcount AS n, (SELECT avg_freq FROM av) AS a FROM ks))"


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _stats(spark, sf_dir)
    avg = kmers.average_frequency(stats)
    return stats.crossJoin(F.broadcast(avg)).select("kmer", kmers.frequency_class(kmers.total(), F.col("avg_freq")).alias("class"))


@query(CLASSED_SQL + " SELECT kmer, class FROM cl")
def kmer_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir)


@query(CLASSED_SQL + " SELECT read_id, class, CAST(count(*) AS BIGINT) AS n FROM km JOIN cl USING (kmer) GROUP BY ALL")
def read_freq_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = kmers.kmers(reads(spark, sf_dir), K, "read_id").groupBy("read_id", "kmer").agg(F.count("*").alias("n"))
    return own.join(_classed(spark, sf_dir), "kmer").groupBy("read_id", "class").agg(F.sum("n").alias("n"))


@query(CLASSED_SQL + " SELECT read_id FROM km JOIN cl USING (kmer) GROUP BY read_id HAVING bool_or(class < 2)")
def chimera_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = kmers.kmers(reads(spark, sf_dir), K, "read_id").distinct()
    return own.join(_classed(spark, sf_dir).where("class < 2"), "kmer").select("read_id").distinct()


@query(
    CLASSED_SQL
    + """, g AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM km JOIN cl USING (kmer) WHERE class < 2)
SELECT read_id, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) AS BIGINT) AS stop, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY read_id, g HAVING count(*) >= 2"""
)
def rare_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.operators import stats

    rare = kmers.positioned(reads(spark, sf_dir), K, "read_id").join(_classed(spark, sf_dir).where("class < 2"), "kmer")
    return stats.islands(rare, "read_id", "pos", 2).select("read_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "n")


@query(
    f"""WITH {KM_SQL}, {stats_sql()}, ok AS (SELECT *, substr(kmer, 2) AS t, left(kmer, {K - 1}) AS h FROM ks WHERE fcount >= 2 AND rcount >= 2)
SELECT DISTINCT kmer FROM (SELECT kmer, count(*) OVER (PARTITION BY t) AS a, count(*) OVER (PARTITION BY h) AS b FROM ok) WHERE a > 1 OR b > 1"""
)
def kmer_fork_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.forks_strict(_stats(spark, sf_dir), 2)


@query(
    f"""WITH {KM_SQL}, {stats_sql()}, g AS (SELECT *, fcount > 2 AND rcount > 2 AS strong, count(*) OVER w AS size, max(fcount + rcount) OVER w AS most, count(*) FILTER (WHERE fcount > 2 AND rcount > 2) OVER w AS strongs
 FROM ks WINDOW w AS (PARTITION BY left(kmer, {K - 1})))
SELECT kmer, fcount, rcount FROM g WHERE size > 1 AND NOT CASE WHEN strongs > 0 THEN strong ELSE fcount + rcount = most END"""
)
def kmer_fork_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.forks_relaxed(_stats(spark, sf_dir))


_DUST = ", ".join(f"'{x}'" for x in kmers.dust_ends(6))


@query(f"WITH {KM_SQL}, {stats_sql()} SELECT * FROM ks WHERE left(kmer, 6) NOT IN ({_DUST}) AND right(kmer, 6) NOT IN ({_DUST})")
def kmer_dust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.without_dust(_stats(spark, sf_dir), 6)


@query(f"WITH {READS_SQL} SELECT CAST(count(*) AS BIGINT) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(sum(greatest(0, length(seq) - {K - 1})) AS BIGINT) AS windows, seqtype FROM reads GROUP BY seqtype")
def kmer_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("seq")
    return reads(spark, sf_dir).groupBy("seqtype").agg(F.count("*").alias("reads"), F.sum(n).cast("long").alias("bases"), F.sum(F.greatest(F.lit(0), n - (K - 1))).cast("long").alias("windows"))


@query(CLASSED_SQL + f" SELECT read_id, CAST(min(pos) AS BIGINT) AS l, CAST(max(pos) + {K} AS BIGINT) AS r FROM km JOIN cl USING (kmer) WHERE class >= 2 GROUP BY read_id")
def proposed_end_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.operators import treat

    classed = kmers.positioned(reads(spark, sf_dir), K, "read_id").join(_classed(spark, sf_dir), "kmer")
    return treat.end_clips(classed, K).select("read_id", F.col("left").cast("long").alias("l"), F.col("right").cast("long").alias("r"))


@query(AVG_SQL + " SELECT CAST(floor((fcount + rcount) / (SELECT avg_freq FROM av) + 0.5) AS BIGINT) AS ratio, CAST(count(*) AS BIGINT) AS kmers FROM ks GROUP BY 1")
def kmer_ratio_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _stats(spark, sf_dir)
    rows = stats.crossJoin(F.broadcast(kmers.average_frequency(stats)))
    return rows.groupBy(F.floor(kmers.total() / F.col("avg_freq") + 0.5).alias("ratio")).agg(F.count("*").alias("kmers"))


@query(f"WITH {KM_SQL}, {stats_sql()} SELECT kmer || chr(9) || fcount || chr(9) || rcount AS line, '>' || fcount || '_' || rcount || chr(10) || kmer AS record FROM ks")
def kmer_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, record = (f(_stats(spark, sf_dir)) for f in (kmers.dump_text, kmers.dump_fasta))
    key = lambda d, c, at: d.select(F.split("value", "[\t\n]")[at].alias("k"), F.col("value").alias(c))
    return key(line, "line", 0).join(key(record, "record", 1), "k").select("line", "record")


_PACK = " + ".join(f"CAST(instr('ACGT', substr(kmer, {j + 1}, 1)) - 1 AS BIGINT) * {4 ** (K - 1 - j)}" for j in range(K))


@query(f"WITH {KM_SQL}, {stats_sql()} SELECT {_PACK} AS code, kmer AS back, ({_PACK}) & 4095 AS bucket FROM ks")
def kmer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stats(spark, sf_dir).select(kmers.packed(F.col("kmer")).alias("code"))
    return rows.select("code", kmers.unpacked(F.col("code"), K).alias("back"), kmers.bucket(F.col("code"), K, 12).alias("bucket"))


@query(f"WITH {KM_SQL}, {stats_sql()}, {_bait_sql()} SELECT kmer, CAST(coalesce(fcount, 0) AS BIGINT) AS fcount, CAST(coalesce(rcount, 0) AS BIGINT) AS rcount FROM baits LEFT JOIN ks USING (kmer)")
def kmer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.lookup(_stats(spark, sf_dir), bait.bait_kmers(_baits(spark, sf_dir), K))


#: 67% of 8 bases are 5.36, rounded up.
_DUST_BASES = 6
_DUST_HALF = ", ".join(f"'{x}'" for x in kmers.dust_ends(_DUST_BASES))


@query(f"WITH {KM_SQL}, {stats_sql()} SELECT * FROM ks WHERE left(kmer, {_DUST_BASES}) NOT IN ({_DUST_HALF}) AND right(kmer, {_DUST_BASES}) NOT IN ({_DUST_HALF})")
def kmer_dust_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.dust_by_percent(_stats(spark, sf_dir), K, 67)


@query(
    f"""WITH {KM_SQL}, {stats_sql()}, g AS (SELECT *, fcount > 2 AND rcount > 2 AS strong, count(*) OVER w AS size, max(fcount + rcount) OVER w AS most, count(*) FILTER (WHERE fcount > 2 AND rcount > 2) OVER w AS strongs
 FROM ks WINDOW w AS (PARTITION BY substr(kmer, 2)))
SELECT kmer, fcount, rcount FROM g WHERE size > 1 AND NOT CASE WHEN strongs > 0 THEN strong ELSE fcount + rcount = most END"""
)
def kmer_fork_relaxed_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.forks_relaxed(_stats(spark, sf_dir), forward=False)


@query(
    CLASSED_SQL
    + f""", f AS (SELECT kmer FROM (SELECT kmer, fcount, rcount, count(*) OVER (PARTITION BY substr(kmer, 2)) AS a, count(*) OVER (PARTITION BY left(kmer, {K - 1})) AS b FROM ks WHERE fcount >= 2 AND rcount >= 2) WHERE a > 1 OR b > 1),
g AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM km WHERE kmer IN (SELECT kmer FROM f))
SELECT read_id, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + {K - 1} AS BIGINT) AS stop FROM g GROUP BY read_id, g"""
)
def fork_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of reads whose k-mers are forks."""
    from seqspark.operators import stats

    forks = kmers.forks_strict(_stats(spark, sf_dir), 2)
    found = kmers.positioned(reads(spark, sf_dir), K, "read_id").join(forks, "kmer")
    return stats.islands(found, "read_id", "pos").select("read_id", F.col("start").cast("long").alias("start"), (F.col("stop") + K - 1).cast("long").alias("stop"))


@query(
    CLASSED_SQL
    + f""", g AS (SELECT read_id, class, pos, pos - row_number() OVER (PARTITION BY read_id, class ORDER BY pos) AS g FROM km JOIN cl USING (kmer))
SELECT read_id, 'HAF' || class AS tag, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + {K - 1} AS BIGINT) AS stop FROM g GROUP BY read_id, class, g"""
)
def frequency_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of reads whose k-mers have one frequency class."""
    out = kmers.class_runs(reads(spark, sf_dir), _classed(spark, sf_dir), K, "read_id")
    return out.select("read_id", F.concat(F.lit("HAF"), F.col("class").cast("string")).alias("tag"), F.col("first").cast("long").alias("start"), (F.col("last") + K - 1).cast("long").alias("stop"))
