"""Contigs as SAM and CAF: places, CIGARs and pairs against a plain walk, and round trips."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from seqspark.sources import contigs as C

PLACED = "name string, contig string, start long, dir int, seq string, qual array<int>, rg int, template string, segment int"
CONTIGS = "contig string, seq string, qual array<int>"


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(4)
    seqs = {f"c{k}": "".join(rnd.choices("ACGT*", weights=[5, 5, 5, 5, 2], k=n)) for k, n in enumerate((90, 400, 1))}
    placed = []
    for k in range(80):
        c = rnd.choice(["c0", "c1", "c1"])
        n = rnd.randrange(1, 40)
        s = rnd.randrange(0, len(seqs[c]) - n + 1)
        own = "".join(x if rnd.random() < 0.85 else rnd.choice("ACGT*") for x in seqs[c][s : s + n])
        placed.append((f"r{k}", c, s, rnd.choice([1, -1]), own, [rnd.randrange(0, 60) for _ in own], rnd.choice([1, 2, None]), f"t{k // 2}" if k < 50 else None, k % 2 + 1))
    return placed, [(c, s, [rnd.randrange(90) for _ in s]) for c, s in seqs.items()]


@pytest.mark.parametrize("width", [7, 64, 4096])
def test_sam_equals_a_walk(spark, data, width):
    placed, contigs = data
    got = {r.qname: r for r in C.on_contig(spark.createDataFrame(placed, PLACED), spark.createDataFrame(contigs, CONTIGS), width).withColumn("qname", F.col("name")).collect()}
    seqs = {c: s for c, s, _ in contigs}
    for name, c, start, _, seq, *_ in placed:
        assert got[name].ref == seqs[c][start : start + len(seq)] and got[name].pos == len(seqs[c][:start].replace("*", ""))
    at = spark.createDataFrame([(c, k) for c, s in seqs.items() for k in range(len(s))], "contig string, at long")
    assert all(r.base == len(seqs[r.contig][: r["at"]].replace("*", "")) for r in C.unpadded(at, spark.createDataFrame(contigs, CONTIGS), width).collect())


def test_sam_lines(spark, data, tmp_path):
    placed, contigs = data
    rows = C.sam(spark.createDataFrame(placed, PLACED), spark.createDataFrame(contigs, CONTIGS), 10, 200, 50)
    seqs, by = {c: s for c, s, _ in contigs}, {}
    for p in placed:
        by.setdefault(p[7] or p[0], []).append(p)
    for r in rows.collect():
        own = sorted(by[r.name], key=lambda p: p[8])
        p = own[1] if r.flag & 128 else own[0]
        seq, ref = p[4], seqs[p[1]][p[2] : p[2] + len(p[4])]
        ops = "".join("" if a == b == "*" else "D" if a == "*" else "I" if b == "*" else "M" for a, b in zip(seq, ref))
        assert r.cigar == "".join(f"{len(m.group())}{m.group()[0]}" for m in re.finditer(r"M+|D+|I+", ops))
        assert r.seq == seq.replace("*", "") and r.qual == "".join(chr(q + 33) for q, x in zip(p[5], seq) if x != "*")
        assert bool(r.flag & 1) == (len(own) == 2) and bool(r.flag & 16) == (p[3] == -1)
        if len(own) == 2:
            mate = own[0] if r.flag & 128 else own[1]
            assert bool(r.flag & 32) == (mate[3] == -1) and r.mate_contig == mate[1] and r.mate_pos == len(seqs[mate[1]][: mate[2]].replace("*", "")) + 1
    pairs = {}
    for r in rows.where("flag & 1 = 1").collect():
        pairs.setdefault(r.name, []).append(r)
    assert all(a.tlen is None and b.tlen is None or a.tlen == -b.tlen for a, b in pairs.values()) and any(r.flag & 2 for x in pairs.values() for r in x)
    C.sam_text(rows).write.text(f"{tmp_path}/sam")
    back = C.read_sam(spark, f"{tmp_path}/sam").select(rows.columns)
    key = lambda d: sorted(repr(tuple(None if v in ("", 0) else str(v) for v in r)) for r in d.collect())
    assert key(back) == key(rows)


def test_caf_round_trip(spark, data, tmp_path):
    placed, contigs = data
    C.write_caf(spark.createDataFrame(placed, PLACED), spark.createDataFrame(contigs, CONTIGS), f"{tmp_path}/caf")
    reads, back = C.read_caf(spark, f"{tmp_path}/caf")
    assert sorted(map(repr, ((r.contig, r.seq, r.qual) for r in back.collect()))) == sorted(map(repr, contigs))
    got = sorted((r.name, r.contig, r.start, r.dir, r.seq, r.qual, r.template) for r in reads.collect())
    # a read of one letter tells no direction
    assert got == sorted((p[0], p[1], p[2], p[3] if len(p[4]) > 1 else 1, p[4] if len(p[4]) > 1 or p[3] == 1 else p[4].translate(str.maketrans("ACGT", "TGCA")), p[5], p[7]) for p in placed)
