"""Digital normalisation: reads of repeats are kept only while one of their k-mers is rare among those kept before.

The rule depends on the order of reads. It is settled in rounds instead of by a walk: a read is surely kept if one of
its k-mers stays below the limit even if all open reads before it are kept, and surely dropped if all reach it with
those already kept. The first open read is always settled, so the result is that of the walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.operators import kmers
from seqspark.operators.chains import Save

OPEN, KEPT, DROPPED = 0, 1, 2
#: Pieces that the order of a step is cut into, so that the reads of a frequent k-mer are counted in many tasks.
PIECES = 64


def steps(reads: DataFrame) -> DataFrame:
    """reads(read_id, good, partner) with step and first, which order them: pairs of two good reads, other good reads, the rest.

    Mates of a good pair stand together, at the smaller of their ids.
    """
    mates = reads.select(F.col("read_id").alias("partner"), F.col("good").alias("_g"))
    pair = F.col("good") & F.coalesce("_g", F.lit(False))
    out = reads.join(mates, "partner", "left").withColumn("step", F.when(pair, 0).when(F.col("good"), 1).otherwise(2))
    return out.withColumn("first", F.when(pair, F.least("read_id", "partner")).otherwise(F.col("read_id"))).drop("_g")


def normalise(reads: DataFrame, k: int, save: Save, most: int = 10) -> DataFrame:
    """(rg, read_id) of the reads that are kept, of reads(rg, read_id, seq, masked, step, first) in each group rg.

    Only masked reads, whose k-mers are repeats, are tested, each once in the order of step, first and read_id; the others are
    kept and not counted. A tested read is kept if one of its k-mers is in fewer than `most` kept ones before it; one
    without k-mers is not. Ids are distinct.
    """
    tested = reads.where("masked").select("rg", "read_id", "seq", "step", "first")
    cuts = tested.agg(F.percentile_approx("first", [x / PIECES for x in range(1, PIECES)], 1000).alias("c")).first()["c"] or []
    piece = F.col("step") * PIECES + sum(((F.col("first") >= c).cast("int") for c in cuts), F.lit(0))
    rows = kmers.kmers(tested, k, "rg", "read_id", "step", "first").distinct().withColumn("piece", piece)
    rows = save(rows.select("rg", "kmer", "read_id", "step", "first", "piece"))
    state = save(tested.select("rg", "read_id", F.lit(OPEN).alias("state")))
    # a read without k-mers is dropped
    state = save(state.join(rows.select("rg", "read_id").distinct(), ["rg", "read_id"], "left_semi"))
    left = state.limit(1).count()
    kept, open_ = (F.col("state") == KEPT).cast("int"), (F.col("state") == OPEN).cast("int")
    pieces = W.partitionBy("rg", "kmer").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy("rg", "kmer", "piece").orderBy("step", "first", "read_id").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    while left:
        now = rows.join(state, ["rg", "read_id"]).where(F.col("state") != DROPPED)
        sums = now.groupBy("rg", "kmer", "piece").agg(F.sum(kept).alias("k"), F.sum(open_).alias("o"))
        carried = sums.select("rg", "kmer", "piece", before("k", pieces).alias("k0"), before("o", pieces).alias("o0"))
        each = now.select("rg", "kmer", "piece", "read_id", "state", before(kept, within).alias("k1"), before(open_, within).alias("o1")).where(F.col("state") == OPEN)
        low = F.col("k0") + F.col("k1")
        told = each.join(carried, ["rg", "kmer", "piece"]).groupBy("rg", "read_id").agg(F.min(low + F.col("o0") + F.col("o1")).alias("high"), F.min(low).alias("low"))
        new = F.when(F.col("high") < most, KEPT).when(F.col("low") >= most, DROPPED).otherwise(F.col("state"))
        seen = Observation()
        out = state.join(told, ["rg", "read_id"], "left").select("rg", "read_id", new.alias("state")).observe(seen, F.count_if(F.col("state") == OPEN).alias("open"))
        state = save(out)
        left = seen.get["open"]
    return reads.where("not masked").select("rg", "read_id").union(state.where(F.col("state") == KEPT).select("rg", "read_id"))
