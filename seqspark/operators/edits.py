"""Edits of single reads: run lengths, gaps, cases, bases and tags, as column expressions.

Reads have seq (string) and qual (array of int, as long as seq). Positions count from 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of one base (any case), or one other character.
RUNS = r"(?s)A+|C+|G+|T+|a+|c+|g+|t+|."


def letters(seq: Column) -> Column:
    return F.regexp_extract_all(seq, F.lit("(?s)."), F.lit(0))


def joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def runs(seq: Column) -> Column:
    return F.regexp_extract_all(seq, F.lit(RUNS), F.lit(0))


def rle_seq(seq: Column) -> Column:
    """One base of each run of A, C, G or T."""
    return joined(F.transform(runs(seq), lambda r: F.substr(r, F.lit(1), F.lit(1))))


def rle_lengths(seq: Column) -> Column:
    return F.transform(runs(seq), lambda r: F.length(r))


def rle_qual(seq: Column, qual: Column) -> Column:
    """Whole-number mean of the qualities of each run."""
    return _run_means(seq, qual)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _run_means(seq: pa.Array, qual: pa.Array) -> pa.Array:
    """Each base is looked at once: runs of a batch are cut by comparing neighbours, and summed. Missing qualities count 0, null ones make null."""
    null = pc.or_(seq.is_null(), qual.is_null()).to_numpy(zero_copy_only=False)
    texts = ["" if bad else x for x, bad in zip(seq.to_pylist(), null)]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)), size)
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (row[1:] != row[:-1]) | ~np.isin(letters[1:], [ord(c) for c in "ACGTacgt"])
    # the quality of each letter by its place in the flat values of the batch
    values, held = qual.flatten(), pc.fill_null(pc.list_value_length(qual), 0).to_numpy(zero_copy_only=False)
    at = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    there = at < held[row]
    place = ((np.cumsum(held) - held)[row] + at)[there]
    of, missing = np.zeros(len(letters), np.int64), np.zeros(len(letters), np.int64)
    of[there] = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)[place]
    missing[there] = values.is_null().to_numpy(zero_copy_only=False)[place]
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(letters)))
    means = np.add.reduceat(of, starts) // n if len(starts) else of
    unknown = np.add.reduceat(missing, starts) > 0 if len(starts) else missing > 0
    ends = np.searchsorted(row[starts], np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(means.astype(np.int32), mask=unknown), mask=pa.array(null))


def unrle(seq: Column, lengths: Column) -> Column:
    return joined(F.zip_with(letters(seq), lengths, lambda c, n: F.call_function("repeat", c, n)))


def unrle_qual(qual: Column, lengths: Column) -> Column:
    return F.flatten(F.zip_with(qual, lengths, lambda q, n: F.call_function("array_repeat", q, n)))


def case_by_quality(seq: Column, qual: Column, threshold: int) -> Column:
    """Bases below the threshold in lower case, the others as they are."""
    return joined(F.zip_with(letters(seq), qual, lambda c, q: F.when(q < threshold, F.lower(c)).otherwise(c)))


def case_by_clips(seq: Column, left: Column, right: Column) -> Column:
    """Lower case outside [left, right), upper case inside."""
    left, right = F.least(left, right), right
    return F.concat(F.lower(F.substr(seq, F.lit(1), left)), F.upper(F.substr(seq, left + 1, right - left)), F.lower(F.substr(seq, right + 1)))


def gaps_to_ns(seq: Column) -> Column:
    return F.translate(seq, "*", "N")


def ns_to_gaps(seq: Column) -> Column:
    return F.translate(seq, "Nn", "**")


def without_gaps(seq: Column) -> Column:
    return F.replace(seq, F.lit("*"), F.lit(""))


def qual_without_gaps(seq: Column, qual: Column) -> Column:
    pairs = F.zip_with(letters(seq), qual, lambda c, q: F.struct(c.alias("c"), q.alias("q")))
    return F.transform(F.filter(pairs, lambda p: p.c != "*"), lambda p: p.q)


def unpadded_position(seq: Column, pos: Column) -> Column:
    """How many bases that are no gaps lie before a padded position."""
    return F.length(F.replace(F.substr(seq, F.lit(1), pos), F.lit("*"), F.lit("")))


def lower_base_position(seq: Column, pos: Column) -> Column:
    """The position itself or the nearest one to its left that is no gap; -1 where there is none."""
    return F.length(F.regexp_replace(F.substr(seq, F.lit(1), pos + 1), r"\*+$", "")) - 1


def complement_position(length: Column, pos: Column) -> Column:
    return length - 1 - pos


def insert_base(seq: Column, base: str, pos: Column) -> Column:
    return F.concat(F.substr(seq, F.lit(1), pos), F.lit(base), F.substr(seq, pos + 1))


def insert_quality(qual: Column, quality: int, pos: Column) -> Column:
    return F.concat(F.slice(qual, F.lit(1), pos), F.array(F.lit(quality)), F.slice(qual, pos + 1, F.greatest(F.size(qual) - pos, F.lit(0))))


def delete_base(seq: Column, pos: Column) -> Column:
    return F.concat(F.substr(seq, F.lit(1), pos), F.substr(seq, pos + 2))


def delete_quality(qual: Column, pos: Column) -> Column:
    return F.filter(qual, lambda q, i: i != pos)


def change_base(seq: Column, base: str, pos: Column) -> Column:
    return F.overlay(seq, F.lit(base), pos + 1, F.lit(1))


def run_bounds(seq: Column, pos: Column) -> tuple[Column, Column]:
    """First and last position of the run of equal bases around a position."""
    base = F.substr(seq, pos + 1, F.lit(1))
    back = F.reverse(F.substr(seq, F.lit(1), pos))
    ahead = F.substr(seq, pos + 2)
    same = lambda text: F.length(text) - F.length(F.call_function("ltrim", base, text))
    return pos - same(back), pos + same(ahead)


def weakest_in_run(seq: Column, qual: Column, pos: Column) -> Column:
    """Position of the lowest quality in the run around a position, the first among equals."""
    low, high = run_bounds(seq, pos)
    part = F.slice(qual, low + 1, high - low + 1)
    return low + F.array_position(part, F.array_min(part)).cast("int") - 1


# tags: arrays of structs (from, to, id)


def has_tag(tags: Column, kind: str, pos: Column | None = None) -> Column:
    return F.exists(tags, lambda t: (t.id == kind) & (F.lit(True) if pos is None else pos.between(t["from"], t["to"])))


def count_tags(tags: Column, kind: str, pos: Column | None = None) -> Column:
    return F.size(F.filter(tags, lambda t: (t.id == kind) & (F.lit(True) if pos is None else pos.between(t["from"], t["to"]))))


def delete_tags(tags: Column, kind: str) -> Column:
    return F.filter(tags, lambda t: t.id != kind)


def average_quality(seq: Column, qual: Column, left: Column, right: Column) -> Column:
    """Whole-number mean of the qualities in [left, right], N and gaps left out; 0 if nothing is left."""
    pairs = F.zip_with(F.slice(letters(seq), left + 1, right - left + 1), F.slice(qual, left + 1, right - left + 1), lambda c, q: F.when(F.lower(c).isin("n", "*"), None).otherwise(q))
    good = F.array_compact(pairs)
    return F.when(F.size(good) == 0, 0).otherwise(F.floor(F.aggregate(good, F.lit(0), lambda a, b: a + b) / F.size(good))).cast("int")
