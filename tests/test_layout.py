"""Layouts of reads drawn from known sequences, on both strands, with contained reads, rings and single reads."""

from __future__ import annotations

import random

from seqspark.operators import layout
from seqspark.plans.read_queries import saver

OVERLAPS, READS = "a long, b long, d int, e long, w long", "read_id long, n long"


def overlaps(reads, size, circular=False, least=20):
    """True overlaps of reads {id: (start, length, strand)} on a sequence, seen from the read of the smaller id."""
    out = []
    for a, (sa, na, da) in reads.items():
        for b, (sb, nb, db) in reads.items():
            if a >= b:
                continue
            for turn in (-size, 0, size) if circular else (0,):
                e = sb + turn - sa
                w = min(na, e + nb) - max(0, e)
                if w >= least:
                    out.append((a, b, da * db, e if da == 1 else na - e - nb, w))
    return out


def placed(spark, reads, edges):
    df = spark.createDataFrame(edges, OVERLAPS).repartition(3)
    lengths = spark.createDataFrame([(i, n) for i, (_, n, _) in reads.items()], READS)
    return {r.read_id: r for r in layout.layout(df, lengths, saver(spark)).collect()}


def consistent(reads, got, size=None):
    """All reads of a contig lie as on the sequence, or all as on its reverse."""
    for contig in {r.contig for r in got.values()}:
        own = [r for r in got.values() if r.contig == contig]
        turns = {r.dir * reads[r.read_id][2] for r in own}
        assert len(turns) == 1
        turn = turns.pop()
        where = {r.offset - reads[r.read_id][0] if turn == 1 else r.offset + reads[r.read_id][0] + reads[r.read_id][1] for r in own}
        assert len({x % size if size else x for x in where}) == 1


def test_a_tiled_sequence_with_contained_reads(spark):
    rnd = random.Random(2)
    starts = list(range(0, 3000, 60))
    reads = {100 + k: (s, 100, rnd.choice([1, -1])) for k, s in enumerate(rnd.sample(starts, len(starts)))}
    for k in range(40):  # within longer reads, and within one another
        s = rnd.choice(starts) + rnd.randrange(0, 40)
        reads[k] = (s, rnd.choice([30, 45, 60]), rnd.choice([1, -1]))
    got = placed(spark, reads, overlaps(reads, 3060))
    assert len(got) == len(reads) and len({r.contig for r in got.values()}) == 1
    consistent(reads, got)
    assert sorted(r.rank for r in got.values() if not r.contained) == list(range(50))
    # a short read that no long one holds is part of the chain
    assert all(r.contained == (r.read_id < 100) or not r.contained for r in got.values())
    ends = [i for i, (s, n, _) in reads.items() if i >= 100 and s in (0, starts[-1])]
    assert next(iter(got.values())).contig == min(ends)


def test_two_sequences_a_single_read_and_a_copy(spark):
    rnd = random.Random(5)
    one = {k: (60 * k, 100, rnd.choice([1, -1])) for k in range(20)}
    two = {50 + k: (60 * k, 100, rnd.choice([1, -1])) for k in range(9)}
    reads = one | two | {99: (0, 80, 1)}
    edges = overlaps(one, 0) + overlaps(two, 0)
    twin = (0, 55, 1, 0, 100)  # an equal read of a larger id lies within the smaller one
    got = placed(spark, reads | {55: one[0][:2] + (one[0][2],)}, [x for x in edges if 55 not in x[:2]] + [twin, twin, (7, 7, 1, 3, 500)])
    assert got[99].contig == 99 and (got[99].offset, got[99].dir, got[99].rank, got[99].contained) == (0, 1, 0, False)
    assert got[55].contained and got[55].contig == got[0].contig == 0
    assert {r.contig for i, r in got.items() if 50 <= i < 55} == {50} and {r.contig for i, r in got.items() if 55 < i < 99} == {56}


def test_a_ring(spark):
    rnd = random.Random(9)
    reads = {k: (s, 100, rnd.choice([1, -1])) for k, s in enumerate(rnd.sample(range(0, 1200, 60), 20))}
    got = placed(spark, reads, overlaps(reads, 1200, circular=True))
    assert all(r.ring and r.contig == 0 for r in got.values()) and (got[0].offset, got[0].dir) == (0, 1)
    consistent(reads, got, 1200)


def test_heavier_overlaps_win_and_only_mutual_ones_count(spark):
    reads = {k: (0, 100, 1) for k in range(5)}
    # 1 and 2 both follow 0, 2 more heavily; 1 is left without a neighbour on its left, so 3 starts from it
    got = placed(spark, reads, [(0, 1, 1, 50, 40), (0, 2, 1, 60, 45), (1, 3, 1, 30, 10)])
    assert {i: (r.contig, r.offset) for i, r in got.items()} == {0: (0, 0), 2: (0, 60), 1: (1, 0), 3: (1, 30), 4: (4, 0)}


def test_no_reads_and_nulls(spark):
    empty = spark.createDataFrame([], OVERLAPS)
    assert layout.layout(empty, spark.createDataFrame([], READS), saver(spark)).count() == 0
    got = layout.layout(spark.createDataFrame([(1, None, 1, 5, 5), (1, 2, 1, 5, None)], OVERLAPS), spark.createDataFrame([(1, 10), (2, 10), (None, 3), (4, None)], READS), saver(spark)).collect()
    assert {r.read_id for r in got} == {1, 2}
