"""Queries on tables that are larger or odder than the given ones, against their SQL or against a bound on their plans."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

from seqspark.operators import intervals, kmers, overlap, stats
from seqspark.plans import registry
from seqspark.plans.read_queries import saver


@pytest.fixture()
def folder(tmp_path):
    """put(name, sql) writes a table of DuckDB; its folder is put.path."""
    con = duckdb.connect()

    def put(name, sql):
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")

    put.path, put.con = str(tmp_path), con
    return put


def same(spark, folder, name):
    """Whether a query equals its SQL; its rows."""
    df = registry.queries()[name](spark, folder.path)
    found = folder.con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = Counter(found.fetchall())
    return Counter(tuple(r[c] for c in names) for r in df.collect()) == want and want


LINES = """SELECT i // 4 AS l_orderkey, {part} AS l_partkey, {supplier} AS l_suppkey, CAST(i % 4 + 1 AS INTEGER) AS l_linenumber, CAST(1 + hash(i * 3) % 50 AS DOUBLE) AS l_quantity,
 CAST(900 + hash(i * 5) % 9000 AS DOUBLE) AS l_extendedprice, (hash(i * 7) % 11) / 100 AS l_discount, substr('ANR', CAST(1 + hash(i * 11) % 3 AS BIGINT), 1) AS l_returnflag, substr('OF', CAST(1 + hash(i * 13) % 2 AS BIGINT), 1) AS l_linestatus FROM range({n}) t(i)"""


def test_edges_with_repeated_ids(spark, folder):
    """From 100,000 parts on, lines of different orders have one edge_id."""
    folder("lineitem", LINES.format(part="CAST(hash(i * 17) % 40 + (3 - i % 4) * 100000 AS BIGINT)", supplier="CAST(i % 37 AS BIGINT)", n=4000))
    for name in ("edges_untaken_sides", "edges_untaken_reads", "edges_identical", "edges_by_level"):
        assert same(spark, folder, name), name


COVERAGE = "coverage coverage_stats coverage_stats_2nd coverage_peaks coverage_median wiggle_span multicopy_zones smile_coverage chimera_cuts feature_coverage".split()


def test_coverage_in_partitions_of_bounded_rows(spark, folder, monkeypatch):
    """The more rows, the more partitions are sorted and grouped; with gaps, contig ends and deep places results equal the SQL."""
    folder("lineitem", LINES.format(part="CAST(hash(i * 17) % (300 + i % 5 * 4000) AS BIGINT)", supplier="CAST(i % 5 AS BIGINT)", n=3000))
    folder("supplier", "SELECT i AS s_suppkey, 0.0 AS s_acctbal FROM range(5) t(i)")
    monkeypatch.setattr(intervals, "ROWS", 500)
    for name in COVERAGE:
        assert same(spark, folder, name), name
    assert intervals.dealt(spark.range(10), 6000, "id").rdd.getNumPartitions() == 12


@pytest.mark.parametrize("name", ["coverage_stats_2nd", "smile_coverage", "multicopy_zones", "coverage_peaks", "feature_coverage", "wiggle_span"])
def test_steps_of_a_contig_in_partitions_of_bounded_rows(spark, folder, monkeypatch, name):
    """What is joined, ordered or grouped by contig is dealt by the number of rows too."""
    folder("lineitem", LINES.format(part="CAST(hash(i * 17) % 4000 AS BIGINT)", supplier="CAST(i % 5 AS BIGINT)", n=3000))
    folder("supplier", "SELECT i AS s_suppkey, 0.0 AS s_acctbal FROM range(5) t(i)")
    monkeypatch.setattr(intervals, "ROWS", 500)
    plan = registry.queries()[name](spark, folder.path)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(contig#\d+L?, 12\)", plan), plan


def test_peaks_make_no_row_for_each_position(spark):
    rows = [(1, 0, 5, True), (1, 5, 10**9, False), (1, 10**9, 2 * 10**9, True), (1, 2 * 10**9 + 7, 2 * 10**9 + 12, False)]
    got = stats.closed_islands(spark.createDataFrame(rows, "contig long, start long, stop long, m boolean"), 10, 1)
    assert {tuple(r) for r in got.where("n < 100").collect()} == {(1, 0, 4, 5), (1, 2 * 10**9 + 7, 2 * 10**9 + 11, 5)}


def test_pairs_are_grouped_where_they_are_made(spark, monkeypatch):
    """Pairs grow with the square of a k-mer's rows, so they are not shuffled; slices give the same as one join."""
    words = ["internationally", "responsibilities", "characteristics", "internationality"]
    r = spark.createDataFrame([(i, " ".join(words[(i * k) % 4] for k in range(1, 6)).translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]))) for i in range(40)], "read_id long, seq string")
    rows = kmers.positioned(r, 12, "read_id").select("read_id", "pos", "kmer")
    want = {tuple(x) for x in overlap.candidates(overlap.shared(rows)).collect()}
    for size in (10**6, 300):
        monkeypatch.setattr(overlap, "SLICE", size)
        monkeypatch.setattr(overlap, "PAIRS", size)
        df = overlap.paired_candidates(rows, saver(spark))
        assert {tuple(x) for x in df.collect()} == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(read_id" in plan and "read_id2" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_best_overlaps_are_ranked_where_pairs_are_made(spark, monkeypatch):
    """Of all pairs only the best of each read and side in a slice are shuffled; they are those of the whole."""
    words = ["internationally", "responsibilities", "characteristics", "internationality", "internationallyinternationally"]
    r = spark.createDataFrame([(i, " ".join(words[(i * k) % 5] for k in range(1, 4 + i % 5)).translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]))) for i in range(40)], "read_id long, seq string")
    rows = kmers.positioned(r, 12, "read_id").select("read_id", "pos", "kmer")
    edges = overlap.candidates(overlap.shared(rows)).where("numhashes >= 2").selectExpr("rid1", "rid2", "lo AS eoffset", "numhashes AS weight")
    key = ("rid1", "rid2", "eoffset", "weight", "side", "rank")
    want = {tuple(x) for x in overlap.top_per_side(overlap.symmetric(edges), 3).select(*key).collect()}
    assert want
    for size in (10**6, 300):
        monkeypatch.setattr(overlap, "SLICE", size)
        monkeypatch.setattr(overlap, "PAIRS", size)
        df = overlap.paired_top(rows, saver(spark), 3, 2)
        assert {tuple(x) for x in df.select(*key).collect()} == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "hashpartitioning(rid" in line]
        assert len(dealt) <= 1 and "read_id2" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x), plan


def test_kmers_of_odd_texts(spark):
    odd = [None, "", "ACG", "ACGTN", "\U0001f600ACGT", "é ACGTA\nCGTACG", "acgt", "A" * 70000]
    r = spark.createDataFrame(list(enumerate(odd)), "read_id long, seq string")
    want = Counter((i, p, t[p : p + 4]) for i, t in enumerate(odd) if t for p in range(len(t) - 3) if set(t[p : p + 4]) <= set("ACGT"))
    assert Counter(map(tuple, kmers.positioned(r, 4, "read_id").collect())) == want
    assert sum(want.values()) == kmers.kmers(r, 4).count()


def test_codes_share_one_pass_over_codons(spark):
    from pyspark.sql import functions as F

    from seqspark.functions import scalar, translation

    d = spark.createDataFrame([("".join(scalar.codons()) + "NAC" + "AC",), ("",), (None,)], "dna string")
    for t in translation.CHANGES:
        got = d.select(translation.told(translation.coded(F.col("dna")), t), translation.translate(F.col("dna"), t)).collect()
        assert all(r[0] == r[1] for r in got)


def test_run_means_look_at_each_base_once(spark):
    """A long read took the square of its length; odd reads and qualities are as they were."""
    from pyspark.sql import functions as F

    from seqspark.operators import edits

    rows = [("AAcc**NNG\U0001f600\U0001f600", list(range(11))), ("", []), (None, [1]), ("AC", None), ("GGT", [5, None, 7]), ("TTT", [9]), ("A\nA", [-3, 2, -1]), ("AAAA", [-1, -1, -1, 0])]
    rows.append(("".join("ACGT"[i // 3 % 4] for i in range(60_000)), [i % 41 for i in range(60_000)]))
    d = spark.createDataFrame(rows, "seq string, qual array<int>")
    got = [r[0] for r in d.select(edits.rle_qual(F.col("seq"), F.col("qual"))).collect()]
    assert got[:-1] == [[0, 2, 4, 5, 6, 7, 8, 9, 10], [], None, None, [None, 7], [3], [-3, 2, -1], [-1]]
    assert got[-1] == [sum(i % 41 for i in range(a, a + 3)) // 3 for a in range(0, 60_000, 3)]


def test_class_runs_are_found_where_reads_are(spark):
    """Without an exchange of k-mers; both ways give the runs of a plain walk, and a class may be missing."""
    import random

    rnd, k = random.Random(5), 4
    seqs = [None, "", "ACG", "ACGNACGTACGT", "A" * 70_000] + ["".join(rnd.choices("ACGTN", [9, 9, 9, 9, 1], k=rnd.choice([3, 50, 400]))) for _ in range(40)]
    r = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(3)
    words = sorted({t[p : p + k] for t in seqs if t for p in range(len(t) - k + 1) if set(t[p : p + k]) <= set("ACGT")} - {"AAAC"})
    cls = {w: i % 3 for i, w in enumerate(words)}
    want = Counter()
    for i, t in enumerate(seqs):
        c = [cls.get(t[p : p + k]) for p in range(len(t) - k + 1)] if t else []
        p = 0
        while p < len(c):
            q = p
            while q + 1 < len(c) and c[q + 1] == c[p]:
                q += 1
            if c[p] is not None:
                want[(i, c[p], p, q)] += 1
            p = q + 1
    classed = spark.createDataFrame(list(cls.items()), "kmer string, class int")
    df = kmers.class_runs(r, classed, k, "read_id")
    assert Counter(map(tuple, df.collect())) == want
    assert "Exchange" not in kmers.class_runs(spark.range(3).selectExpr("id AS read_id", "'ACGT' AS seq"), classed, k, "read_id")._jdf.queryExecution().executedPlan().toString()


def test_class_runs_of_long_kmers(spark):
    r = spark.createDataFrame([(1, "ACGTACGTACGTACGN"), (2, "ACGTACGTACGT")], "read_id long, seq string")
    classed = kmers.kmers(r, 11).distinct().selectExpr("kmer", "CAST(left(kmer, 1) = 'A' AS int) AS class")
    assert {tuple(x) for x in kmers.class_runs(r, classed, 11, "read_id").collect()} == {(1, 1, 0, 0), (1, 0, 1, 3), (1, 1, 4, 4), (2, 1, 0, 0), (2, 0, 1, 1)}


def test_kmers_of_the_graph_travel_packed(spark, tmp_path):
    """Counting, chains and gaps move k-mers as differences of numbers, not as rows of text; long k-mers and odd reads are counted right."""
    import random

    from seqspark.operators import coded

    rnd = random.Random(2)
    seqs = [None, "", "ACG", "\U0001f600" + "ACGTT" * 9, "A" * 90_000] + ["".join(rnd.choices("ACGTN", [9, 9, 9, 9, 1], k=rnd.choice([3, 60, 400]))) for _ in range(30)] * 2
    r = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(3)
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for k in (3, 17, 31):
        n = Counter(min(w, turned(w)) for t in seqs if t for p in range(len(t) - k + 1) if set(w := t[p : p + k]) <= set("ACGT"))
        nodes = coded.counted(r, k, 2, 4)
        assert {tuple(x) for x in nodes.select(kmers.unpacked(nodes.code, k), "n").collect()} == {x for x in n.items() if x[1] >= 2}
        want = set()
        for i, t in enumerate(seqs):
            rows = [(p, t[p : p + k]) for p in range(len(t) - k + 1) if set(t[p : p + k]) <= set("ACGT")] if t else []
            there = [j for j, (_, w) in enumerate(rows) if n[min(w, turned(w))] >= 2]
            want |= {(i, rows[a][0], rows[b][0], rows[a][1], rows[b][1]) for a, b in zip(there, there[1:]) if b - a > 1}
        got = coded.gaps(r, nodes, k, 4)
        assert {tuple(x) for x in got.select("read_id", "pos", "upto", kmers.unpacked(got.code, k), kmers.unpacked(got.code2, k)).collect()} == want
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(seqs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    for name in ("unitig_graph", "graph_edits", "graph_chimeras"):
        plan = registry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\((kmer|e)#", plan), plan


def test_a_task_leaves_a_forest_of_its_pairs(spark, monkeypatch):
    """300 reads with one word make 44,850 pairs, of which edges for components are few; components are those of all pairs."""
    r = spark.createDataFrame([(i, ["ACGTACCATGATTACAG", "TTGACCAGTAGGACCTT", "GGGACCCATTTAGACCA", "ACGTACCATGATNACAG"][i % 4] + "N" + ("ACGTACCATGATTACAG" if i == 2 else "")) for i in range(300)], "read_id long, seq string")
    rows = kmers.positioned(r, 12, "read_id").select("read_id", "pos", "kmer")
    pairs = overlap.candidates(overlap.shared(rows)).where("numhashes >= 3").selectExpr("rid1 AS a", "rid2 AS b")
    ids, save = r.selectExpr("read_id AS id"), saver(spark)
    want = {tuple(x) for x in overlap.components(pairs, ids, save).collect()}
    assert pairs.count() > 8000
    for size in (10**6, 50):
        monkeypatch.setattr(overlap, "FOREST", size)
        edges = overlap.paired_forest(rows, save, 3)
        assert edges.count() <= 300 * edges.rdd.getNumPartitions() < pairs.count()
        assert {tuple(x) for x in overlap.components(edges, ids, save).collect()} == want


def test_bans_by_a_rule_join_nothing(spark, folder):
    folder("documents", "SELECT i AS doc_id, 'internationally responsibilities' AS text, 'en' AS lang, 's' AS source, 1 AS n_chars FROM range(40) t(i)")
    assert same(spark, folder, "overlap_not_banned")
    plan = registry.queries()["overlap_not_banned"](spark, folder.path)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(read_id" in plan and not re.search(r"hashpartitioning\([^)]*(rid|lo#|hi#|read_id2)", plan), plan


def test_tasks_of_pairs_are_small(spark):
    """Tables of a task's pairs fit its share of the memory: 2,500 reads of one word are dealt by at most 500,000 pairs."""
    rows = spark.range(2500).selectExpr("id AS read_id", "0 AS pos", "'ACGTACGTACGT' AS kmer")
    for df in (overlap.paired_candidates(rows, saver(spark)), overlap.longest_runs(rows, 12, saver(spark)), overlap.paired_hits(rows, saver(spark), overlap.by_diagonal)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = [int(x) for x in re.findall(r"hashpartitioning\(read_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
        assert dealt and min(dealt) * 500_000 >= 2500 * 2499 / 2, plan


def test_no_rows_are_sent_by_the_driver(spark, monkeypatch):
    """Blocks of reads meet in tasks, a read with more pairs than a task holds with some reads at a time; nothing is broadcast."""
    words = ["internationally", "responsibilities", "characteristics", "internationality", "internationallyinternationally"]
    r = spark.createDataFrame([(i, "N".join(words[(i * k) % 5] for k in range(1, 4 + i % 5)).translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]))) for i in range(40)], "read_id long, seq string")
    rows = kmers.positioned(r, 12, "read_id").select("read_id", "pos", "kmer").cache()
    lengths = r.selectExpr("read_id", "length(seq) AS n")
    hits, save = overlap.shared(rows).cache(), saver(spark)
    few = overlap.candidates(hits).where("numhashes >= 9").selectExpr("rid1", "rid2", "lo AS eoffset", "numhashes AS weight")
    pos = rows.toDF("read_id", "pos1", "kmer").join(rows.toDF("read_id2", "pos2", "kmer"), "kmer").where("read_id > read_id2")
    runs = pos.selectExpr("read_id", "read_id2", "pos1 - pos2 AS far", "pos1 - row_number() OVER (PARTITION BY read_id, read_id2, pos1 - pos2 ORDER BY pos1) AS g")
    longest = runs.groupBy("read_id", "read_id2", "far", "g").count().groupBy("read_id", "read_id2").agg({"count": "max"}).selectExpr("read_id", "read_id2", "`max(count)` + 11")
    wanted = [overlap.by_diagonal(hits), overlap.offsets(hits), overlap.percent(hits, lengths, 12), longest, overlap.symmetric(few).groupBy("rid1").count()]
    wanted = [{tuple(x) for x in df.collect()} for df in wanted]
    assert all(wanted)
    for size in (10**6, 2_000):
        monkeypatch.setattr(overlap, "PAIRS", size)
        monkeypatch.setattr(overlap, "SLICE", 10_000)
        monkeypatch.setattr(overlap, "FOREST", size)
        got = [
            overlap.paired_hits(rows, save, overlap.by_diagonal),
            overlap.paired_hits(rows, save, overlap.offsets),
            overlap.paired_shares(rows.join(lengths, "read_id").select("read_id", "n", "pos", "kmer"), save, 12),
            overlap.longest_runs(rows, 12, save).select("rid1", "rid2", "longest"),
            overlap.paired_degrees(rows, save, 9),
        ]
        for df, want in zip(got, wanted):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan and "Join" not in plan, plan
            found = [tuple(x) for x in df.collect()]
            assert len(found) == len(want) and set(found) == want
