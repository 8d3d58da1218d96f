"""Records of several lines: each once, whole and in its contig, at any split size."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from seqspark.sources import blocks, text_formats


@pytest.fixture()
def split(spark):
    """Sets the bytes of a split."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def put(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fastq(rnd, n):
    """Records whose qualities often begin with @ or +, and some without bases."""
    out = []
    for k in range(n):
        size = rnd.choice([0, 1, 3, 20, 70])
        seq = "".join(rnd.choices("ACGTN", k=size))
        qual = (rnd.choice("@+I") + "".join(rnd.choices("@+!I~", k=size)))[:size]
        out.append((f"r{k}", rnd.choice(["", "1:N:0", "plain text"]), seq, qual))
    return out


@pytest.mark.parametrize("size", [7, 23, 64, 200, 10_000])
def test_fastq_at_any_split_size(spark, tmp_path, split, size):
    rnd = random.Random(size)
    want = []
    for f in range(3):
        some = fastq(rnd, 40)
        text = "".join(f"@{n}{' ' + c if c else ''}\n{s}\n+{rnd.choice(['', n])}\n{q}\n" for n, c, s, q in some)
        (tmp_path / f"{f}.fastq").write_text(text if f else text + "\n")
        want += some
    split(size)
    got = text_formats.read_fastq(spark, str(tmp_path))
    rows = sorted((r.name, r.comment, r.seq, r.qual) for r in got.collect())
    assert rows == sorted((n + ("/1" if c.startswith("1:") else ""), c, s, [ord(x) - 33 for x in q]) for n, c, s, q in want)
    if size < 100:
        assert got.rdd.getNumPartitions() > 3


def test_fastq_in_gzip_and_bad_records(spark, tmp_path, split):
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write("@a\r\nAC\r\n+\r\nII\r\n@b x\nG\n+\n@\n")
    split(10)
    assert sorted((r.name, r.seq, r.qual) for r in text_formats.read_fastq(spark, f"{tmp_path}/a.fastq.gz").collect()) == [("a", "AC", [40, 40]), ("b", "G", [31])]
    for k, text in enumerate(["@a\nAC\n+\nI\n", "@a\nAC\n+\n", "@a\nAC\nII\n+\n", "a\nAC\n+\nII\n"]):
        (tmp_path / f"bad{k}.fastq").write_text(text)
        with pytest.raises(Exception, match="four lines"):
            text_formats.read_fastq(spark, f"{tmp_path}/bad{k}.fastq").collect()
    (tmp_path / "empty.fastq").write_text("")
    assert text_formats.read_fastq(spark, f"{tmp_path}/empty.fastq").count() == 0


KEYED = """@Version\t2\t0
@Program\tX
@ReadGroup
@RG\tname\tlong ones
@RG\tID\t3
@RG\ttechnology\tSolexa
@EndReadGroup
RD\tfree
RG\t3
RS\tACGT
RQ\tIIII
ER
CO\tcon one
NR\t2
LC\t8
CT\tSROc\t2\t4\t=\tX\tsome note
CS\tACGTACGT
CQ\t!!!!IIII
\\\\
RD\tr1
RG\t3
RS\tCOEC
RQ\t@@@@
TN\tt
TS\t1
QL\t2
QR\t3
RT\tHAF3\t1\t2\t+\tX
RT\tSRMr\t4\t3
ER
AT 1 4 1 4
RD\tr2
RS\tGG
RQ\tII
ER
AT 8 7 1 2
//
EC
CO\tempty
NR\t0
CS\t
CQ\t
\\\\
//
EC
RD\tlast
RS\tA
RQ\tI
ER
"""


def collected(units):
    groups = {r.id: dict(r["values"]) for r in blocks.keyed_groups(units).collect()}
    contigs = {r.contig: r.asDict(True) for r in blocks.keyed_contigs(units).collect()}
    reads = {r.name: r.asDict(True) for r in blocks.keyed_reads(units).collect()}
    return groups, contigs, reads


@pytest.mark.parametrize("size", [5, 16, 40, 90, 10_000])
def test_keyed_files_at_any_split_size(spark, tmp_path, split, size):
    (tmp_path / "a.maf").write_text(KEYED)
    split(size)
    units = blocks.keyed_units(spark, f"{tmp_path}/a.maf")
    groups, contigs, reads = collected(units)
    assert groups == {3: {"name": "long ones", "id": "3", "technology": "Solexa"}}
    assert contigs["con one"]["seq"] == "ACGTACGT" and contigs["con one"]["qual"] == [0] * 4 + [40] * 4 and contigs["con one"]["length"] == 8
    assert contigs["con one"]["tags"] == [{"id": "SROc", "from": 1, "to": 4, "strand": "=", "source": "X", "comment": "some note"}]
    assert contigs["empty"]["seq"] == "" and contigs["empty"]["qual"] == [] and len(contigs) == 2
    assert {k: r["contig"] for k, r in reads.items()} == {"free": None, "r1": "con one", "r2": "con one", "last": None}
    assert reads["r1"]["clips"] == {"sl": 0, "sr": 4, "ql": 1, "qr": 3, "cl": 0, "cr": 4} and (reads["r1"]["template"], reads["r1"]["segment"]) == ("t", 1)
    assert [(t["id"], t["from"], t["to"], t["strand"]) for t in reads["r1"]["tags"]] == [("HAF3", 0, 2, "+"), ("SRMr", 2, 4, "")]
    assert reads["r2"]["place"] == {"from": 8, "to": 7, "read_from": 1, "read_to": 2} and reads["free"]["place"] is None
    assert units.count() == 11


def test_keyed_round_trip(spark, tmp_path, split):
    (tmp_path / "a.maf").write_text(KEYED)
    units = blocks.keyed_units(spark, f"{tmp_path}/a.maf")
    before = collected(units)
    many = blocks.keyed_reads(units)
    copies = spark.range(30).select(F.concat(F.lit("c"), "id").alias("contig"), F.lit(0).alias("reads"), F.lit(3).alias("length"), F.lit("ACG").alias("seq"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("qual"))
    copies = copies.withColumn("tags", F.array().cast(blocks.keyed_contigs(units).schema["tags"].dataType))
    blocks.write_keyed(f"{tmp_path}/out", blocks.keyed_groups(units), blocks.keyed_contigs(units).union(copies), many)
    split(60)
    groups, contigs, reads = collected(blocks.keyed_units(spark, f"{tmp_path}/out"))
    assert (groups, reads) == (before[0], before[2])
    assert {k: contigs[k] for k in before[1]} == before[1] and len(contigs) == 32
