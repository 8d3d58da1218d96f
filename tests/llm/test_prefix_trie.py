"""The prefix trie against a plain rebuild in Python, with deep conversations and awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqspark.llm import prefix_trie as P

KIND = "conv_id long, turn long, role string, text string, digest string, depth int, family long"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(base, [])[:h] + x[h:]
    members, end = defaultdict(list), defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
        end[tuple(x)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(end[p]))).encode()).hexdigest())
        for p, m in members.items()
    ]


def same(spark, rows, **sizes):
    got = [tuple(r) for r in P.trie(spark.createDataFrame(rows, KIND).repartition(5), **sizes).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    return got


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    out = []
    for c in [*range(-12, 60), 1000, 1003, 5_000_000_004]:
        if c == 30:
            continue  # a base that is absent
        for t in range(rnd.choice([1, 1, 2, 5, 9, 12])):
            out.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "é中", "", None, "x" * 400]), None, None, None))
    out += [(None, 0, "user", "lost", None, None, None), (7, None, "system", "first", "d", 1, 2), (61, None, None, None, None, None, None)]
    return out


def test_equals_a_plain_rebuild(spark, rows):
    got = same(spark, rows)
    assert [r for r in got if r[1] == 0] and len(got) > 100


def test_deep_conversations_and_chunks(spark):
    """With blocks of 2 levels and chunks of two ids, sums go through many levels and ends through many chunks."""
    rnd = random.Random(1)
    rows = [(c, t, "user", rnd.choice("ab") if t > 9 else "s", None, None, None) for c in range(25) for t in range(rnd.choice([1, 3, 17, 33]))]
    rows += [(c, 0, "user", "same", None, None, None) for c in range(100, 180, 5)]
    same(spark, rows, block=2, chunk=20)
    same(spark, [(0, t, "user", "x", None, None, None) for t in range(70)], block=3)


def test_blocks_of_the_usual_size(spark):
    rows = [(c, t, "user", f"{t % 7} {c * (t > 200)}", None, None, None) for c in (0, 5, 10) for t in range(300)]
    same(spark, rows)


def test_repeated_rows_are_turns(spark):
    same(spark, [(1, 0, "user", "x", None, None, None)] * 4 + [(2, 0, "user", "x", None, None, None)] * 3)


def test_empty(spark):
    assert P.trie(spark.createDataFrame([], KIND)).count() == 0


def test_work_of_a_long_chain_is_bounded(spark):
    """Ancestors carried by a row are at most BLOCK a level."""
    rows = spark.range(600).select(F.lit(0).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text"))
    most = P.prefixes(rows).select(F.size("ups").alias("n"), F.expr("aggregate(ups, 0, (s, x) -> s + octet_length(x))").alias("bytes")).agg(F.max("n"), F.max("bytes")).first()
    assert most[0] <= 3 and most[1] <= 3 * P.BLOCK * 32
