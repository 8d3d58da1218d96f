"""Clips of reads as column expressions: masked ends, poly stretches, bad stretches, least clips.

A clip pair is (left, right): bases of [left, right) stay. Lengths count bases.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_left(seq: Column, gap: int, front: int) -> Column:
    """Length of the masked front: runs of X with at most `front` bases before and `gap` between them.

    N and gaps count as no bases, and belong to the run of X that they follow. 0 where nothing is masked.
    """
    base = "[^XxNn*][Nn*]*+"  # possessive: nothing is tried again, however long the masked front is
    return F.length(F.regexp_extract(seq, rf"^[Nn*]*+(?:{base}){{0,{front}}}+[Xx][XxNn*]*+(?:(?:{base}){{0,{gap}}}+[Xx][XxNn*]*+)*+", 0))


def mask_right(seq: Column, gap: int, end: int) -> Column:
    """Where the masked end begins."""
    return F.length(seq) - mask_left(F.reverse(seq), gap, end)


def narrowed(old_left: Column, old_right: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """New clips that never widen what the old ones leave."""
    new_left = F.greatest(old_left, left)
    return new_left, F.greatest(new_left, F.least(old_right, right))


def least_left(left: Column, required: int, set_to: int) -> Column:
    return F.when(left < required, set_to).otherwise(left)


def least_right(right: Column, length: Column, required: int) -> Column:
    return F.when(length - right < required, length - required).otherwise(right)


def enough_quality(qual: Column, least: int, number: int) -> Column:
    """Whether at least `number` bases have the least quality."""
    return F.size(F.filter(qual, lambda q: q >= least)) >= number


def bad_stretch(qual: Column, left: Column, right: Column, least: int, window: int) -> Column:
    """The right clip at the first `window` bases in a row below the least quality, within the clips."""
    marks = F.array_join(F.transform(F.slice(qual, left + 1, F.greatest(right - left, F.lit(0))), lambda q: F.when(q < least, "b").otherwise("g")), "")
    at = F.instr(marks, "b" * window)
    return F.when(at > 0, left + at - 1).otherwise(right)


def poly_front(seq: Column, base: str, length: int, errors: int, grace: int) -> tuple[Column, Column]:
    """(start, end) of the first poly stretch near the front: `length` of the base, up to `errors` others.

    It begins at one of the first grace + 1 bases and ends with its last such base; N counts as neither.
    Both are -1 where there is none.
    """
    low, up = base.lower(), base.upper()
    stretch = rf"^(?:[{low}{up}Nn]*[^{low}{up}Nn]){{0,{errors}}}[{low}{up}Nn]*"

    def at(i: Column) -> Column:
        run = F.regexp_replace(F.regexp_extract(F.substr(seq, i + 1), stretch, 0), rf"[^{low}{up}]+$", "")
        hits = F.length(F.regexp_replace(run, rf"[^{low}{up}]", ""))
        return F.struct(i.alias("start"), (i + F.length(run) - 1).alias("end"), ((hits >= length) & F.lower(F.substr(seq, i + 1, F.lit(1))).isin(low)).alias("ok"))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.lit(grace)), at), lambda x: x.ok)
    first = F.get(found, F.lit(0))
    return F.coalesce(first.start, F.lit(-1)), F.coalesce(first.end, F.lit(-1))


def poly_end(seq: Column, base: str, length: int, errors: int, grace: int) -> tuple[Column, Column]:
    """(start, end) of the first poly stretch from the back, as poly_front() on the reversed read."""
    start, end = poly_front(F.reverse(seq), base, length, errors, grace)
    n = F.length(seq)
    return F.when(start >= 0, n - 1 - end).otherwise(-1), F.when(start >= 0, n - 1 - start).otherwise(-1)


def end_base(seq: Column, length: int, share: int = 30) -> Column:
    """The base that may make a poly stretch at the back: the most frequent of the last `length`, with its share in percent."""
    tail = F.lower(F.substr(F.reverse(seq), F.lit(1), F.lit(length)))
    count = {b: F.length(tail) - F.length(F.replace(tail, F.lit(b), F.lit(""))) for b in "acgt"}
    most, real = F.greatest(*count.values()), sum(count.values(), F.lit(0))
    out = F.lit(None).cast("string")
    for b in reversed("acgt"):
        out = F.when(count[b] == most, b).otherwise(out)
    return F.when((real > 0) & (F.floor(100 * most / real) >= share), out)
