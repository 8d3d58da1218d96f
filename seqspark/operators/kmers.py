"""K-mers: extraction, counts on both strands, frequency classes, filters, forks, set operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.functions import scalar

MULTI = 15


#: Characters of one batch of k-mers.
BATCH = 1 << 19


def _places(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each k-mer of ACGT: its text, where it begins in it, and its letters as a row of bytes."""
    raw = [(x or "").encode("latin-1", "replace") for x in texts]  # one byte a character
    whole = np.frombuffer(b" ".join([*raw, b" " * k]), np.uint8)
    begin = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1, out=begin[1:])
    breaks = np.flatnonzero(~np.isin(whole, np.frombuffer(b"ACGT", np.uint8)))
    first = np.concatenate([[0], breaks[:-1] + 1])
    size = np.maximum(0, breaks - first - (k - 1))  # k-mers of each stretch between two breaks
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    who = np.searchsorted(begin, at, "right") - 1
    return who, at - begin[who], np.lib.stride_tricks.sliding_window_view(whole, k)[at] if len(at) else np.zeros((0, k), np.uint8)


def _strings(letters: np.ndarray) -> pa.StringArray:
    n, k = letters.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and batch.column(column).nbytes > BATCH:
        half = batch.num_rows // 2
        yield from _pieces(batch.slice(0, half), column)
        yield from _pieces(batch.slice(half), column)
    else:
        yield batch


def _found(reads: DataFrame, k: int, keep: tuple[str, ...], with_pos: bool) -> DataFrame:
    kept = reads.select(*keep, F.col("seq").alias("_seq"))
    schema = T.StructType([*kept.schema.fields[:-1], *[T.StructField("pos", T.IntegerType())] * with_pos, T.StructField("kmer", T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, "_seq"):
                who, pos, letters = _places(batch.column(len(keep)).to_pylist(), k)
                for a in range(0, len(who), BATCH):
                    part = slice(a, a + BATCH)
                    rows = pa.array(who[part])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(len(keep))), *[pa.array(pos[part].astype(np.int32))] * with_pos, _strings(letters[part])], names)

    return kept.mapInArrow(run, schema)


def kmers(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """Rows (keep..., kmer): every k-mer of reads.seq; other characters than ACGT break them."""
    return _found(reads, k, keep, False)


def positioned(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """Rows (keep..., pos, kmer), pos counting from 0."""
    return _found(reads, k, keep, True)


#: The longest k-mers of which a table with every one is sent to all tasks: 4^10 bytes.
TABLE_K = 10


def class_runs(reads: DataFrame, classed: DataFrame, k: int, key: str) -> DataFrame:
    """(key, class, first, last): runs of neighbouring k-mers of reads(key, seq) that have one class in classed(kmer, class).

    Up to TABLE_K the classes are sent to all tasks as one byte for each possible k-mer, however many reads there are,
    and runs are found where a read is; longer k-mers are joined, and their runs put in order by read.
    """
    if k > TABLE_K:
        rows = positioned(reads, k, key).join(classed, "kmer")
        runs = rows.withColumn("g", F.col("pos") - F.row_number().over(W.partitionBy(key, "class").orderBy("pos")))
        return runs.groupBy(key, "class", "g").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("g")
    digit = np.zeros(256, np.int64)
    digit[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    power, none = 4 ** np.arange(k - 1, -1, -1), 255
    table = np.full(4**k, none, np.uint8)
    for r in classed.select("kmer", "class").collect():
        table[int(digit[list(r[0].encode())] @ power)] = r[1]
    kept = reads.select(key, F.col("seq").alias("_seq"))
    schema = T.StructType([kept.schema[0], T.StructField("class", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, "_seq"):
                who, pos, letters = _places(batch.column(1).to_pylist(), k)
                code = np.zeros(len(who), np.int64)
                for i in range(k):
                    code = code * 4 + digit[letters[:, i]]
                found = table[code]
                there = found != none
                who, pos, found = who[there], pos[there], found[there]
                new = np.ones(len(who), bool)
                new[1:] = (who[1:] != who[:-1]) | (pos[1:] != pos[:-1] + 1) | (found[1:] != found[:-1])
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(who)) - 1 if len(a) else a
                columns = [batch.column(0).take(pa.array(who[a])), *(pa.array(x.astype(np.int32)) for x in (found[a], pos[a], pos[b]))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(run, schema)


def count(rows: DataFrame, k: int) -> DataFrame:
    """(kmer, fcount, rcount, seqtype) of rows (kmer, seqtype), each strand a key of its own.

    Rows are summed before the other strand is added, so both strands cost one shuffle of distinct k-mers.
    seqtype is MULTI where read groups of several types have the k-mer.
    """
    one = rows.groupBy("kmer").agg(F.count("*").alias("n"), F.min("seqtype").alias("lo"), F.max("seqtype").alias("hi"))
    both = one.select("kmer", F.col("n").alias("f"), F.lit(0).cast("long").alias("r"), "lo", "hi").union(
        one.select(scalar.reverse_complement(F.col("kmer")), F.lit(0).cast("long"), "n", "lo", "hi")
    )
    seqtype = F.when(F.min("lo") == F.max("hi"), F.min("lo")).otherwise(MULTI)
    return both.groupBy("kmer").agg(F.sum("f").alias("fcount"), F.sum("r").alias("rcount"), seqtype.cast("int").alias("seqtype"))


def total() -> F.Column:
    return F.col("fcount") + F.col("rcount")


def filter_and(stats: DataFrame, fwd: int, rev: int, both: int) -> DataFrame:
    return stats.where((F.col("fcount") >= fwd) & (F.col("rcount") >= rev) & (total() >= both))


def filter_andor(stats: DataFrame, fwd: int, rev: int, both: int) -> DataFrame:
    return stats.where(((F.col("fcount") >= fwd) & (F.col("rcount") >= rev)) | (total() >= both))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """K-mers of a that b lacks, with a's counts."""
    return a.join(b.select("kmer"), "kmer", "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """K-mers that both have, with a's counts."""
    return a.join(b.select("kmer"), "kmer", "left_semi")


def average_frequency(stats: DataFrame, least: int = 1, confirm: int = 1) -> DataFrame:
    """One row (avg_freq): the count at which half of all confirmed occurrences are reached.

    K-mers are ordered by count and 5% at either end are left out; if none inside is confirmed on both strands, all
    count. Where the count found begins in the last tenth of the k-mers, 10% are left out instead. Of the k-mers
    of a count that is cut, the confirmed ones are taken to be spread evenly. Only counts and how many k-mers have
    them are ordered, which is a small table.
    """
    ok = (F.col("fcount") >= confirm) & (F.col("rcount") >= confirm)
    by_count = stats.groupBy(total().alias("c")).agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("good"))
    ranked = by_count.select("c", "n", "good", F.expr("sum(n) over (order by c)").alias("upto"), F.expr("sum(n) over ()").alias("size"))
    rows = ranked.select("*", F.explode(F.array(F.lit(20), F.lit(10))).alias("part"))
    inside = F.greatest(F.lit(0), F.least("upto", F.expr("size - size div part")) - F.greatest(F.col("upto") - F.col("n"), F.expr("size div part")))
    weighed = rows.select("part", "c", "n", "upto", "size", (inside * F.col("c")).alias("every"), F.when(inside == F.col("n"), F.col("good") * F.col("c")).otherwise(F.floor(F.col("good") * inside / F.col("n")) * F.col("c")).alias("sure"))
    picked = weighed.withColumn("all_sure", F.expr("sum(sure) over (partition by part)")).withColumn("w", F.when(F.col("all_sure") > 0, F.col("sure")).otherwise(F.col("every")))
    run = picked.select("part", "c", (F.col("upto") - F.col("n") >= F.expr("size - size div 10")).alias("late"), F.expr("sum(w) over (partition by part order by c)").alias("run"), F.expr("sum(w) over (partition by part)").alias("total"))
    found = run.where("run > total div 2").groupBy("part").agg(F.min(F.struct("c", "late")).alias("x"))
    first, again = F.max(F.when(F.col("part") == 20, F.col("x"))), F.max(F.when(F.col("part") == 10, F.col("x")))
    return found.agg(F.greatest(F.when(first.late, F.coalesce(again.c, first.c)).otherwise(first.c), F.lit(least)).cast("long").alias("avg_freq"))


def frequency_class(n: F.Column, avg: F.Column, repeat: float = 2.0) -> F.Column:
    """Classes 0 to 7; thresholds are truncated to whole numbers first."""
    cut = lambda f: F.floor(avg * f)
    return (
        F.when(n == 1, 0).when(n <= 2, 1).when(n > cut(20.0), 7).when(n > cut(8.0), 6).when(n >= cut(repeat), 5).when(n > cut(1.6), 4).when(n >= cut(0.4), 3).otherwise(2)
    )


def forks_strict(stats: DataFrame, mincount: int, confirm: int = 1) -> DataFrame:
    """K-mers that share their last or first k - 1 bases with another, all with mincount on both strands."""
    ok = stats.where((F.col("fcount") >= max(mincount, confirm)) & (F.col("rcount") >= max(mincount, confirm)))
    tail, head = F.expr("substring(kmer, 2)"), F.expr("left(kmer, length(kmer) - 1)")
    a = ok.groupBy(tail.alias("e")).agg(F.count("*").alias("n")).where("n > 1").select("e")
    b = ok.groupBy(head.alias("e")).agg(F.count("*").alias("n")).where("n > 1").select("e")
    left = ok.join(a, tail == F.col("e"), "left_semi").select("kmer")
    right = ok.join(b, head == F.col("e"), "left_semi").select("kmer")
    return left.union(right).distinct()


def forks_relaxed(stats: DataFrame, forward: bool = True) -> DataFrame:
    """K-mers of a fork that are weaker than its strong ones (more than 2 on both strands, else the most frequent)."""
    key = F.expr("left(kmer, length(kmer) - 1)") if forward else F.expr("substring(kmer, 2)")
    strong = (F.col("fcount") > 2) & (F.col("rcount") > 2)
    groups = stats.groupBy(key.alias("e")).agg(F.count("*").alias("size"), F.sum(strong.cast("int")).alias("strongs"), F.max(total()).alias("most")).where("size > 1")
    rows = stats.withColumn("e", key).join(groups, "e")
    return rows.where(~F.when(F.col("strongs") > 0, strong).otherwise(total() == F.col("most"))).select("kmer", "fcount", "rcount")


def dust_ends(n: int) -> list[str]:
    """Repeats of 1 to 4 bases cut to n bases; those of 2 begin with A, as the convention is."""
    out = {b * n for b in "ACGT"} | {("A" + b) * n for b in "CGT"}
    for size in (3, 4):
        units = [""]
        for _ in range(size):
            units = [u + b for u in units for b in "ACGT"]
        out |= {u * n for u in units}
    return sorted({x[:n] for x in out})


def without_dust(stats: DataFrame, n: int) -> DataFrame:
    """K-mers neither of whose ends of n bases is a microrepeat."""
    ends = dust_ends(n)
    return stats.where(~F.expr(f"left(kmer, {n})").isin(ends) & ~F.expr(f"right(kmer, {n})").isin(ends))


def dust_bases(k: int, percent: int) -> int:
    """Bases of an end that is a percentage of k: one more than the whole bases in it, k at most."""
    return min(k, k * percent // 100 + 1)


def dust_by_percent(stats: DataFrame, k: int, percent: int) -> DataFrame:
    """As without_dust(), with ends of a percentage of the k-mer's length, rounded up; a whole share counts one base more."""
    return without_dust(stats, dust_bases(k, percent))


def byte_width(k: int) -> int:
    """Bytes of a k-mer of two bits a base, as a power of two."""
    if not 1 <= k <= 256:
        raise ValueError("k is 1 to 256")
    return next(n for n in (1, 2, 4, 8, 16, 32, 64) if 4 * n >= k)


def packed(kmer):
    """A k-mer of up to 31 bases as a whole number, two bits a base, the first in the highest."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpacked(code, k: int):
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def bucket(code, k: int, bits: int):
    """The lowest `bits` bits of a packed k-mer, by which an index finds it."""
    return code.bitwiseAND(F.lit((1 << min(bits, 2 * k)) - 1))


def lookup(stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counts of wanted(kmer), 0 for those that stats lacks."""
    rows = wanted.join(stats, "kmer", "left")
    return rows.select("kmer", F.coalesce("fcount", F.lit(0)).alias("fcount"), F.coalesce("rcount", F.lit(0)).alias("rcount"))


def ordered(stats: DataFrame, by: str) -> DataFrame:
    """stats in one of the orders lex, count_up, count_down, lex_count."""
    keys = {"lex": ["kmer"], "count_up": [total(), "kmer"], "count_down": [total().desc(), "kmer"], "lex_count": ["kmer", total()]}
    return stats.orderBy(*keys[by])


def thresholds(avg: int) -> dict[str, int]:
    """Least counts of the frequency classes, truncated to whole numbers."""
    return {"rare": 1, "below": int(avg * 0.4), "normal": int(avg * 1.6), "repeat": int(avg * 2.0), "heavy": int(avg * 8.0), "mega": int(avg * 20.0)}


def replacement_coverage(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(read_id, coverage): half the mean over a read's k-mers of count / count among kept reads, rounded.

    counts(kmer, n, reads array or read_id rows) is given as rows (read_id, kmer, n) and kept as (kmer, m).
    """
    rows = counts.join(kept, "kmer")
    return rows.groupBy("read_id").agg(F.floor(F.avg(F.col("n") / F.col("m")) / 2 + 0.5).cast("long").alias("coverage"))


def dump_text(stats: DataFrame) -> DataFrame:
    """(value): lines of k-mer, forward count and reverse count."""
    return stats.select(F.concat_ws("\t", "kmer", F.col("fcount").cast("string"), F.col("rcount").cast("string")).alias("value"))


def dump_fasta(stats: DataFrame) -> DataFrame:
    """(value): FASTA records named by the k-mer's counts."""
    return stats.select(F.concat(F.lit(">"), F.col("fcount").cast("string"), F.lit("_"), F.col("rcount").cast("string"), F.lit("\n"), F.col("kmer")).alias("value"))
