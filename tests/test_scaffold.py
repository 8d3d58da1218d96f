"""Scaffolds of contigs cut from a known sequence, with mates on both strands and contradicting links."""

from __future__ import annotations

import random

from seqspark.operators import scaffold
from seqspark.plans.read_queries import saver

MATES = "c1 long, pos1 long, len1 long, dir1 int, c2 long, pos2 long, len2 long, dir2 int"


def test_order_direction_and_gaps(spark):
    rnd = random.Random(3)
    size, read, gap, n = 500, 40, 60, 400
    ids = rnd.sample(range(1, 100), 8)
    contigs = {c: (k * (n + gap), rnd.choice([1, -1])) for k, c in enumerate(ids)}
    mates = []
    for _ in range(4000):
        at = rnd.randrange(0, 8 * (n + gap) - size)
        ends = []
        for start, strand in ((at, 1), (at + size - read, -1)):
            for c, (s, d) in contigs.items():
                if s <= start and start + read <= s + n:
                    ends.append((c, start - s if d == 1 else n - (start - s) - read, read, strand * d))
        if len(ends) == 2:
            mates.append((*ends[0], *ends[1]) if rnd.random() < 0.5 else (*ends[1], *ends[0]))
    wrong = (ids[0], 10, read, -1, ids[5], 10, read, -1)
    df = spark.createDataFrame([*mates, *[wrong] * 3, (ids[1], 5, read, 1, ids[6], 5, read, 1)], MATES)
    lengths = spark.createDataFrame([(c, n) for c in [*ids, 500]], "read_id long, n long")
    save = saver(spark)
    links = save(scaffold.links(df, lengths, size))
    got = {r.contig: r for r in scaffold.scaffolds(links, lengths, save).collect()}
    assert got[500].scaffold == 500 and {got[c].scaffold for c in ids} == {min(ids[0], ids[-1])}
    order = sorted(ids, key=lambda c: got[c].rank)
    forward = order == ids
    assert forward or order == ids[::-1]
    assert all(got[c].dir == contigs[c][1] * (1 if forward else -1) for c in ids)
    assert all(abs(got[b].offset - got[a].offset - n - gap) <= 1 for a, b in zip(order, order[1:]))
    bad = [(r.a, r.b, r.w) for r in scaffold.unused(links, scaffold.scaffolds(links, lengths, save)).collect()]
    assert bad == [(min(ids[0], ids[5]), max(ids[0], ids[5]), 3)]
    assert scaffold.links(df.limit(0), lengths, size).count() == 0
