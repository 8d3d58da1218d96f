"""Row-level treatment of reads: editing, run lengths, tiles, end clips, windowed quality clips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blind(seq: Column, base: str = "c") -> Column:
    """Every letter but gaps and N replaced."""
    return F.regexp_replace(seq, "[^*nN]", base)


def collapse_runs(seq: Column) -> Column:
    """Runs of A, C, G or T as one base."""
    for b in "ACGT":
        seq = F.regexp_replace(seq, f"{b}+", b)
    return seq


def hard_trim(seq: Column, left: Column, right: Column) -> Column:
    """What lies between the clips; empty where they cross."""
    return F.substr(seq, left + F.lit(1), F.greatest(F.lit(0), right - left))


def tiles(seqs: DataFrame, length: int, step: int) -> DataFrame:
    """Overlapping windows of seqs(name, seq) as reads (name, start, seq); the last may be shorter."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("seq") - 1), F.lit(step))
    return seqs.where(F.length("seq") > 0).select("name", "seq", F.explode(at).alias("start")).select("name", "start", F.substr("seq", F.col("start") + 1, F.lit(length)).alias("seq"))


def end_clips(classed: DataFrame, k: int, least: int = 2) -> DataFrame:
    """classed(read_id, pos, class) -> (read_id, left, right): from the first to past the last k-mer of a class of `least` or more."""
    return classed.where(F.col("class") >= least).groupBy("read_id").agg(F.min("pos").alias("left"), (F.max("pos") + k).alias("right"))


def window_clip(qual: np.ndarray, least: float, window: int) -> tuple[int, int]:
    """The stretch from the first to past the last window whose mean quality is `least` or more; (0, 0) if none is."""
    if len(qual) < window:
        return (0, len(qual)) if len(qual) and qual.mean() >= least else (0, 0)
    total = np.concatenate([[0], np.cumsum(qual)])
    good = np.flatnonzero(total[window:] - total[:-window] >= least * window)
    return (int(good[0]), int(good[-1]) + window) if len(good) else (0, 0)


def quality_clips(reads: DataFrame, least: float = 20, window: int = 30) -> DataFrame:
    """reads(read_id, qual) -> (read_id, ql, qr)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            clips = [window_clip(np.asarray(q if q is not None else [], np.int64), least, window) for q in b.qual]
            yield pd.DataFrame({"read_id": b.read_id, "ql": [c[0] for c in clips], "qr": [c[1] for c in clips]})

    return reads.select("read_id", "qual").mapInPandas(run, "read_id long, ql int, qr int")
