"""Consensus of columns by a plain walk over their groups, in the order of the rules."""

from __future__ import annotations

import random

import pytest

from seqspark.operators import consensus as C

GROUPS = "contig long, pos long, base string, n long, fwd long, bwd long, quality long"
LETTERS = "-ACMGRSVTWYHKDBN"


def iupac(bases):
    return LETTERS[sum({"A": 1, "C": 2, "G": 4, "T": 8}.get(b, 0) for b in bases)]


def columns(rnd, n):
    out = []
    for pos in range(n):
        for base in rnd.sample("ACGT*", rnd.choice([1, 1, 2, 3, 5])):
            fwd, bwd = rnd.randrange(4), rnd.randrange(4)
            if fwd + bwd:
                out.append((1, pos, base, fwd + bwd, fwd, bwd, rnd.choice([5, 18, 20, 24, 29, 30, 31, 35, 60, 60, 90])))
    return out


def walked(groups, single):
    groups = sorted(groups, key=lambda g: "ACGT*".index(g[2]))
    most = max(g[6] for g in groups)
    taken = [g for g in groups if g[6] >= 30 or g[6] + 5 >= most or g[3] >= 3 and g[6] >= 20 and g[4] and g[5]]
    good = [g for g in taken if g[6] >= 30 and g[4] and g[5]]
    one = taken[0] if len(taken) == 1 else good[0] if len(good) == 1 else None
    if one:
        return one[2], max(0, most - sum(g[6] for g in groups if g[2] != one[2]))
    if single:
        size, call = 0, None
        for g in taken:
            count = g[3] * (2 if g[4] and g[5] else 1)
            if count >= size:
                size, call = count, (g[2], g[6])
        return call
    best = [g for g in groups if g[6] == most]
    if len(best) == 1 and best[0][2] == "*":
        return "*", most
    return iupac(g[2] for g in taken), sum(g[6] for g in taken) // len(taken)


@pytest.mark.parametrize("single", [False, True])
def test_quality_calls(spark, single):
    rows = columns(random.Random(1), 300)
    by = {}
    for g in rows:
        by.setdefault(g[1], []).append(g)
    got = {r.pos: (r.letter, r.quality) for r in C.quality_calls(spark.createDataFrame(rows, GROUPS).repartition(3), single).collect()}
    assert got == {p: walked(g, single) for p, g in by.items()}


def test_hybrids(spark):
    def call(groups, calls, several):
        g = spark.createDataFrame([(1, 1, *x) for x in groups], "contig long, pos long, tech string, base string, n long, fwd long, bwd long, quality long")
        c = spark.createDataFrame([(1, 1, *x) for x in calls], "contig long, pos long, tech string, letter string, chosen array<string>")
        r = C.hybrid_calls(g, c, several).first()
        return r.letter, r.quality

    long, short = [("sanger", "A", 4, 2, 2, 40)], [("short", "A", 9, 5, 4, 32)]
    both = [("sanger", "A", ["A"]), ("short", "A", ["A"])]
    # all agree: three quarters of 72 are more than 40
    assert call(long + short, both, False) == ("A", 54)
    # a group of level 4 falls to one of level 0
    weak = [("short", "C", 2, 2, 0, 15)]
    assert call(long + weak, [("sanger", "A", ["A"]), ("short", "C", ["C"])], False) == ("A", 40)
    # levels 0 and 1: several make a letter, one alone is of the best level
    near = [("short", "C", 9, 5, 4, 32)]
    told = [("sanger", "A", ["A"]), ("short", "C", ["C"])]
    assert call(long + near, told, True) == ("M", 36)
    assert call(long + near, told, False) == ("A", 40)
    # both of the best level: the more frequent base, and a gap before a base of equal number
    strong = [("short", "*", 12, 6, 6, 40)]
    assert call(long + strong, [("sanger", "A", ["A"]), ("short", "*", ["*"])], False) == ("*", 40)
    assert call([("sanger", "A", 12, 6, 6, 40), *strong], [("sanger", "A", ["A"]), ("short", "*", ["*"])], False) == ("*", 40)
    # what the technologies called alone wins over number
    assert call([("sanger", "A", 2, 1, 1, 40), ("sanger", "C", 9, 5, 4, 40)], [("sanger", "A", ["A", "C"])], False) == ("A", 40)


def test_strains_and_sequences(spark):
    rows = [(1, s, p, b, 3, 2, 1, 40) for s, seq in (("x", "AC*T"), ("y", "AG")) for p, b in enumerate(seq)]
    calls = C.by_strain(spark.createDataFrame(rows, "contig long, strain string, pos long, base string, n long, fwd long, bwd long, quality long"))
    got = {r.strain: (r.seq, r.unpadded, r.quals) for r in C.sequences(calls, "contig", "strain").collect()}
    assert got == {"x": ("AC*T", "ACT", [40, 40, 40]), "y": ("AG", "AG", [40, 40])}
    assert C.quality_calls(spark.createDataFrame([], GROUPS)).count() == 0
