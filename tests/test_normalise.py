"""Normalisation in rounds against the walk in order, with frequent k-mers, pairs and unmasked reads."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from seqspark.operators import normalise
from seqspark.plans.read_queries import saver

KIND = "rg string, read_id long, seq string, masked boolean, good boolean, partner long"


def walked(rows, k, most):
    good = {r[1]: r[4] for r in rows}
    order = []
    for rg, i, seq, masked, g, p in rows:
        pair = g and bool(good.get(p))
        order.append(((0 if pair else 1 if g else 2), min(i, p) if pair else i, i, rg, seq, masked))
    seen, kept = Counter(), set()
    for _, _, i, rg, seq, masked in sorted(order, key=lambda x: x[:3]):
        own = {w for p in range(len(seq or "") - k + 1) if set(w := seq[p : p + k]) <= set("ACGT")}
        if not masked:
            kept.add((rg, i))
        elif any(seen[rg, w] < most for w in own):
            kept.add((rg, i))
            seen.update((rg, w) for w in own)
    return kept


@pytest.mark.parametrize("most", [1, 3])
def test_equals_the_walk(spark, most):
    rnd = random.Random(most)
    genome = "".join(rnd.choices("ACGT", k=150))
    rows = []
    for i in range(220):
        a = rnd.choice([0, 0, 0, rnd.randrange(110)])  # many reads share their place
        seq = genome[a : a + rnd.choice([8, 20, 40])]
        if rnd.random() < 0.2:
            seq = seq[:5] + "N" + seq[6:]
        rows.append((rnd.choice("ab"), i, seq, rnd.random() < 0.9, rnd.random() < 0.6, i ^ 1 if i < 160 else None))
    rows += [("a", 900, "NNNN", True, True, None), ("a", 901, None, True, False, None), ("b", 902, "", False, False, 900)]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    got = normalise.normalise(normalise.steps(df), 6, saver(spark), most)
    found = [tuple(r) for r in got.collect()]
    assert set(found) == walked(rows, 6, most) and len(found) == len(set(found))


def test_copies_and_empty(spark):
    rows = [("g", k, "ACGTACG", True, False, None) for k in range(15)] + [("g", 20, "ACGTACG", False, False, None), ("h", 99, "NNN", True, False, None)]
    d = normalise.steps(spark.createDataFrame(rows, KIND))
    assert sorted(tuple(r) for r in normalise.normalise(d, 4, saver(spark)).collect()) == [("g", k) for k in range(10)] + [("g", 20)]
    assert normalise.normalise(d.limit(0), 4, saver(spark)).count() == 0
