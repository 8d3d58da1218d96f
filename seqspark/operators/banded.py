"""Banded semi-global alignment of pairs of reads, with traceback and the facts that edges are chosen by.

Pairs of like size are padded to one matrix. It is filled for all pairs by lines across the diagonal, whose cells do not
depend on each other; traces are followed for all pairs at once, and the last few one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ten times the score of a match, a mismatch and a gap; half scores of ambiguity codes; what N is expected to score.
TIMES, MATCH, MISMATCH, GAP, HALF, HALF_MISS, N_EXPECTED = 10, 10, -10, -20, 5, -5, -1
#: The bases each code stands for.
CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT"}
#: Percent of the score that a gap of 1, 2, 3... columns takes, the last for longer ones.
GAP_PERCENTS = (0, 5, 10, 20, 40, 80, 100)
#: A gap's k-th column counts FADE^k of a gap, from the FADED-th on nothing.
FADE, FADED = 0.9, 50
LOW = -(1 << 29)
#: Bytes of scores that a batch of pairs may take, and traces that are followed one by one rather than in step.
ROOM, FEW = 96 << 20, 128
#: Cells whose steps are looked up at a time, about.
BLOCK = 1 << 17
#: Pairs that are worth a batch, however their sizes differ: the steps of a batch cost about as much as these pairs' cells.
ENOUGH = 48
#: Characters that are bases or score nothing.
COMMON = np.isin(np.arange(256), np.frombuffer(b"ACGTacgtNnXx", np.uint8))
#: Lines of a band between which scores are lowered; what they are lowered by leaves their last 8 bits.
AGAIN = 512


@dataclass(frozen=True)
class Rules:
    """What a solution needs, how wide the band is, and which penalties apply."""

    min_score: int = 15 * TIMES
    min_relscore: int = 65
    min_overlap: int = 17
    #: Half the band: a percentage of the expected overlap between a least and a most value; doubled up to widest where a trace meets the edge.
    band_percent: int = 15
    band_min: int = 25
    band_max: int = 100
    widest: int = 400
    #: Bases from an end of the overlap with at most so many mismatches; 0 for no such rule.
    clean_distance: int = 0
    clean_allowed: int = 0
    gap_percents: tuple[int, ...] = ()
    max_gap_percent: int = 100
    affine: bool = False


@cache
def matrices() -> tuple[np.ndarray, np.ndarray]:
    """Scores of two characters, and what they are expected to score. Case does not matter; unknown characters are like X."""
    real, wanted = np.zeros((256, 256), np.int32), np.zeros((256, 256), np.int32)

    def put(m: np.ndarray, a: str, b: str, value: int) -> None:
        for x in {a, a.lower()}:
            for y in {b, b.lower()}:
                m[ord(x), ord(y)] = m[ord(y), ord(x)] = value

    for a, own in CODES.items():
        for b, other in CODES.items():
            both, sizes = len(set(own) & set(other)), sorted((len(own), len(other)))
            if a == b:
                value = MATCH
            elif not both:
                value = MISMATCH
            elif sizes[0] == 1:
                value = 0 if sizes[1] == 2 else HALF_MISS
            elif sizes == [2, 2]:
                value = 0
            else:
                value = HALF if both == sizes[0] or sizes == [3, 3] else HALF_MISS
            put(real, a, b, value)
            put(wanted, a, b, MATCH)
        put(wanted, "N", a, N_EXPECTED)
        put(wanted, "*", a, MATCH)
    real[ord("*"), :] = real[:, ord("*")] = GAP
    put(wanted, "*", "*", MATCH)
    put(wanted, "*", "N", N_EXPECTED)
    put(wanted, "*", "X", N_EXPECTED)
    for m in (real, wanted):
        m[ord(" "), :] = m[:, ord(" ")] = 0
    return real, wanted


@cache
def letters() -> np.ndarray:
    """Characters of sequences as they are; all others as X."""
    known = "".join(CODES) + "NX"
    return np.array([x if chr(x) in known + known.lower() + "*" else ord("X") for x in range(256)], np.uint8)


def padded(seqs: list[np.ndarray], left: int, right: int) -> np.ndarray:
    out = np.full((len(seqs), left + max(map(len, seqs), default=0) + right), ord(" "), np.uint8)
    for row, s in zip(out, seqs):
        row[left : left + len(s)] = s
    return out


def shifted(two: list[np.ndarray], shift: np.ndarray, size: int) -> np.ndarray:
    """Characters of each sequence so that column x holds its place x + shift, counted from 1; 0 outside."""
    out = np.zeros((len(two), size), np.uint8)
    for row, s, by in zip(out, two, shift.tolist()):
        begin, end = max(0, 1 - by), min(size, len(s) + 1 - by)
        if begin < end:
            row[begin:end] = s[begin + by - 1 : end + by - 1]
    return out


@cache
def steps_of_five() -> np.ndarray:
    """Scores of two characters as traces() adds them: in fives, and what two gaps cost more, so that a gap costs nothing."""
    return ((matrices()[0] - 2 * GAP) // 5).astype(np.int8)


def coded(one: list[np.ndarray], two: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], tuple]:
    """What gives two texts of characters as codes, and those what gives steps_of_five() of two blocks of them."""
    step = steps_of_five()
    used = np.unique(np.concatenate([*one, *two, np.zeros(1, np.uint8)]))
    base = np.isin(used, np.frombuffer(b"ACGTacgt", np.uint8))
    match, miss, none = (int(x) for x in (step[65, 65], step[65, 67], step[65, 88]))
    if (step[used[~base][:, None], used] == none).all():  # bases, and characters that score nothing
        own, other = np.full(256, 16, np.uint8), np.full(256, 32, np.uint8)
        for n, c in enumerate(b"ACGT"):
            own[[c, c | 32]] = other[[c, c | 32]] = n
        least = np.where(own == 16, none, miss).astype(np.int8)

        def plain(a: tuple, b: tuple, block: tuple) -> np.ndarray:
            out = np.equal(_up(a[0], *block), _along(b[0], *block)).view(np.int8)
            out *= match - miss
            out += np.maximum(_up(a[1], *block), _along(b[1], *block))
            return out

        return lambda a, b: ((own[a], least[a]), (other[b], least[b]), plain)
    code = np.zeros(256, np.intp)
    code[used] = np.arange(len(used))
    table = step[used[:, None], used].reshape(-1)
    return lambda a, b: (code[a] * len(used), code[b], lambda a, b, block: table[_up(a, *block) + _along(b, *block)])


def _along(x: np.ndarray, back: int, place: int, size: int, lines: int) -> np.ndarray:
    """Of each of some lines, `size` rows of x from `place` on, which is one more for each line."""
    return np.lib.stride_tricks.as_strided(x[place:], (lines, size, x.shape[1]), (x.strides[0], *x.strides))


def _up(x: np.ndarray, back: int, place: int, size: int, lines: int) -> np.ndarray:
    """Of each of some lines, `size` rows of x from `back` on, which is one less for each line."""
    return np.lib.stride_tricks.as_strided(x[back:], (lines, size, x.shape[1]), (-x.strides[0], *x.strides))


@cache
def _kept() -> np.ndarray:
    return np.empty(ROOM, np.uint8)


def scratch(size: int) -> np.ndarray:
    """Bytes of any content, the same ones for each batch that fits."""
    return _kept()[:size] if size <= len(_kept()) else np.empty(size, np.uint8)


def within(begin: np.ndarray, size: np.ndarray, lines: int) -> list[bool]:
    """Whether a line is one of begin, ..., begin + size of any pair."""
    step = np.zeros(lines + 1, np.int64)
    np.add.at(step, np.clip(begin, 0, lines), 1)
    np.add.at(step, np.clip(begin + size + 1, 0, lines), -1)
    return (np.cumsum(step)[:lines] > 0).tolist()


def traces(one: list[np.ndarray], two: list[np.ndarray], offset: np.ndarray, half: np.ndarray, rules: Rules) -> list[tuple[int, int, int, int, np.ndarray, int] | None]:
    """Of each pair: where the trace begins and ends in both, its steps (1 diagonal, 2 one alone, 3 two alone), and how near it came to the band's edge.

    offset: where two is expected to begin in one. None without a cell in the last row or column that is good enough.
    Of equal ends the farthest counts. Where steps tie, the last gap goes on, after an N gaps come first, then diagonals, then gaps in two.

    The band's cells are filled by lines on which row r plus place is the same, whose cells do not depend on each other. Column k
    of row r is on line 2r + k, in cell k // 2. Scores are held in fives, with a gap's cost added for each line since the last
    multiple of AGAIN; those that traces are followed by are held by their last 8 bits, as neighbours within the band differ by far less.
    """
    p = np.arange(len(one))
    n1, n2 = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    edge, wide = 2 * half, int(half.max())
    k = np.arange(2 * wide + 1)
    first = np.maximum(0, offset - half)
    shift = first - offset - half  # column k of row r is place shift + r + k of two
    rows = np.minimum(n1, offset + half + n2) - first + 1
    most = int(max(1, rows.max()))
    lines = int(max(1, np.minimum(2 * (rows - 1) + edge, n1 + n2 - first - shift).max() + 1))
    top = (lines - 1) // 2
    # the pairs of a cell lie side by side
    back = shifted([x[::-1] for x in one], n1 + 1 - first - top, top + wide + 2).T.copy()  # place top - r is row r
    back, ahead, steps_of = coded(one, two)(back, shifted(two, shift, top + wide + 3).T.copy())
    kind = np.int16 if 2 * most + 4 * AGAIN < 30_000 else np.int32
    low = -16_000
    even, odd = np.full((wide + 1, len(p)), low, kind), np.full((wide + 2, len(p)), low, kind)  # an odd line has a cell before and behind
    gaps = np.empty((wide + 1, len(p)), kind)
    held = scratch(lines * (wide + 1) * len(p)).reshape(lines, wide + 1, len(p))
    ends = np.full((most, len(p)), LOW, np.int32)  # scores in the last column
    bottom = np.full((len(p), 2 * wide + 1), LOW, np.int32)  # scores in the last row
    narrow = np.flatnonzero(half < wide)
    bottom_at = np.where(n1 - first < rows, n1 - first, 1 << 40)
    in_bottom = within(2 * bottom_at, edge, lines)
    last = n2 - shift  # row and column of the last place of two
    in_ends = within(2 * last - edge, edge, lines)
    ahead_by = max(1, min(256, BLOCK // (wide * len(p) + 1)))  # lines whose steps are looked up at a time
    zero_from, zero_to = int((-shift).min()), 2 * int((-shift).max())
    for d in range(lines):
        q, is_odd = d >> 1, d & 1
        now, before, size = (odd[1:-1], even, wide) if is_odd else (even, odd, wide + 1)
        raised = -GAP // 5 * (d % AGAIN)
        if not raised:
            even -= -GAP // 5 * AGAIN
            odd[1:-1] -= -GAP // 5 * AGAIN
        if d % (2 * ahead_by) == 0:
            some = min(ahead_by, top - q + 1)
            steps_even = steps_of(back, ahead, (top - q, q, wide + 1, some)).astype(kind)
            steps_odd = steps_of(back, ahead, (top - q, q + 1, wide, some)).astype(kind)
        now += (steps_odd if is_odd else steps_even)[q % ahead_by]
        np.maximum(now, np.maximum(before[:-1], before[1:], out=gaps[:size]), out=now)
        if d <= 2 * wide:  # row 0
            now[q] = np.where((d <= edge) & ((shift + d == 0) | (first == 0) & (shift + d >= 0)), raised, low)
        if zero_from <= d <= zero_to:  # place 0
            m = -shift - q - is_odd
            x = np.flatnonzero((m >= 0) & (m < size) & (d + shift >= 0))
            now[m[x], x] = raised
        if is_odd and len(narrow):
            odd[half[narrow] + 1, narrow] = low
        np.copyto(held[d, :size], now, casting="unsafe")
        if in_bottom[d]:
            at = d - 2 * bottom_at
            x = np.flatnonzero((at >= 0) & (at <= edge))
            bottom[x, at[x]] = (now[at[x] >> 1, x].astype(np.int32) - raised) * 5
        if in_ends[d]:
            r = d - last
            m = last - q - is_odd
            x = np.flatnonzero((r >= 0) & (r < rows) & (first + r > 0) & (m >= 0) & (2 * m + is_odd <= edge))
            ends[r[x], x] = (now[m[x], x].astype(np.int32) - raised) * 5
    # the best cells of the last row and column
    j = (n1 - offset - half)[:, None] + k
    good = (j >= 1) & (j <= n2[:, None]) & (bottom >= rules.min_score)
    good &= bottom.astype(np.int64) * 10000 // np.maximum(1, np.minimum(j, n1[:, None])) >= rules.min_relscore
    row = np.where(good, bottom, -1)
    row_k = len(k) - 1 - np.argmax(row[:, ::-1], axis=1)
    i = first[None, :] + np.arange(most)[:, None]
    good = (i >= 1) & (ends >= rules.min_score) & (ends.astype(np.int64) * 10000 // np.maximum(1, np.minimum(i, n2[None, :])) >= rules.min_relscore)
    col = np.where(good, ends, -1)
    col_r = most - 1 - np.argmax(col[::-1], axis=0)
    in_row = row[p, row_k] > col[col_r, p]
    found = np.maximum(row[p, row_k], col[col_r, p]) > -1
    i = np.where(in_row, n1, first + col_r)
    j = np.where(in_row, n1 - offset - half + row_k, n2)
    end_i, end_j = i.copy(), j.copy()
    # follow all traces in step, and the last few one by one
    step_of = steps_of_five().view(np.uint8)
    text1, text2 = (np.concatenate([*x, np.zeros(1, np.uint8)]) for x in (one, two))
    begin1, begin2 = np.cumsum(n1) - n1 - 1, np.cumsum(n2) - n2 - 1
    steps, near = [], np.full(len(p), 1 << 30)
    came, after_n = np.ones(len(p), np.uint8), np.zeros(len(p), bool)
    live = np.flatnonzero(found & (i > 0) & (j > 0))
    flat, line = held.reshape(-1), len(p) * (wide + 1)
    while len(live) >= max(1, FEW):
        li, lj = i[live], j[live]
        lr = li - first[live]
        lk = lj - lr - shift[live]
        room = edge[live] - lk
        near[live] = np.minimum(near[live], np.minimum(lk, room))
        line_at = (2 * lr + lk) * line + live
        at = line_at + (lk >> 1) * len(p)
        score = flat[at]
        x, y = text1[begin1[live] + li], text2[begin2[live] + lj]
        diagonal = flat[at - 2 * line] + step_of[x, y] == score
        up = (flat[line_at - line + (lk + 1 >> 1) * len(p)] == score) & (room > 0)
        left = (flat[line_at - line + (lk - 1 >> 1) * len(p)] == score) & (lk > 0)
        by = came[live]
        diagonal &= ~(after_n[live] & (up | left)) & ~(up & (by == 2)) & ~(left & (by == 3))
        up &= ~(left & (by == 3))
        step = np.where(diagonal, 1, np.where(up, 2, 3)).astype(np.uint8)
        after_n[live] = (x == ord("N")) | (y == ord("N"))
        i[live] = li = li - (step != 3)
        j[live] = lj = lj - (step != 2)
        came[live] = step
        whole = np.zeros(len(p), np.uint8)
        whole[live] = step
        steps.append(whole)
        live = live[(li > 0) & (lj > 0)]
    told = np.array(steps, np.uint8).reshape(len(steps), len(p)).T
    tails = {x: followed(held[:, :, x], one[x], two[x], int(i[x]), int(j[x]), int(first[x]), int(shift[x]), int(edge[x]), int(came[x]), bool(after_n[x])) for x in live.tolist()}
    out = []
    for x in p.tolist():
        done = told[x][told[x] > 0]
        at_i, at_j, tail, closest = tails.get(x, (int(i[x]), int(j[x]), b"", 1 << 30))
        way = np.concatenate([done, np.frombuffer(tail, np.uint8)])[::-1]
        out.append((at_i, at_j, int(end_i[x]), int(end_j[x]), way, min(int(near[x]), closest)) if found[x] else None)
    return out


def followed(held: np.ndarray, one: np.ndarray, two: np.ndarray, i: int, j: int, first: int, shift: int, edge: int, came: int, after_n: bool) -> tuple[int, int, bytes, int]:
    """One trace to its begin: where that is, the steps from its end on, and how near it came to the band's edge."""
    table = steps_of_five()
    step_of = {x << 8 | y: int(table[x, y]) for x in np.unique(one).tolist() for y in np.unique(two).tolist()}
    score, x, y = memoryview(held), one.tobytes(), two.tobytes()
    steps, closest, n = bytearray(), 1 << 30, ord("N")
    some_n = n in x or n in y
    k = j - (i - first) - shift
    d = 2 * (i - first) + k
    v = score[d, k >> 1] if i and j else 0
    while i > 0 and j > 0:
        closest = min(closest, k, edge - k)
        m = k >> 1
        if came == 1 and not some_n:  # as far as the diagonal goes
            begin, upto = i, max(0, i - j)
            while i > upto:
                w = score[d - 2, m]
                if w + step_of[x[i - 1] << 8 | y[j - 1]] - v & 255:
                    break
                i, j, d, v = i - 1, j - 1, d - 2, w
            steps += b"\1" * (begin - i)
            if i == upto:
                break
        p, q = x[i - 1], y[j - 1]
        step = 0 if score[d - 2, m] + step_of[p << 8 | q] - v & 255 else 1
        if not step or after_n or came != 1:
            up = k < edge and score[d - 1, k + 1 >> 1] == v
            left = k > 0 and score[d - 1, k - 1 >> 1] == v
            if after_n and (up or left) or up and came == 2 or left and came == 3:
                step = 0
            if not step:
                step = 2 if up and not (left and came == 3) else 3
        after_n = p == n or q == n
        if step == 1:
            i, j, d = i - 1, j - 1, d - 2
        elif step == 2:
            i, d, k = i - 1, d - 1, k + 1
        else:
            j, d, k = j - 1, d - 1, k - 1
        v = score[d, k >> 1]
        came = step
        steps.append(step)
    return i, j, bytes(steps), closest


def laid_out(one: np.ndarray, two: np.ndarray, trace: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences in columns: gaps are *, blanks stand before and after a sequence."""
    i, j, end_i, end_j, steps, _ = trace
    at1, at2 = i + np.cumsum(steps != 3) - 1, j + np.cumsum(steps != 2) - 1
    mid1 = np.where(steps != 3, one[np.clip(at1, 0, len(one) - 1)], ord("*"))
    mid2 = np.where(steps != 2, two[np.clip(at2, 0, len(two) - 1)], ord("*"))
    blank = lambda n: np.full(n, ord(" "), np.uint8)
    own = np.concatenate([one[:i], blank(j), mid1, one[end_i:], blank(len(two) - end_j)]).astype(np.uint8)
    other = np.concatenate([blank(i), two[:j], mid2, blank(len(one) - end_i), two[end_j:]]).astype(np.uint8)
    return own, other


def first_run(same: np.ndarray) -> int:
    return int(np.argmin(same)) if not same.all() else len(same)


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(value, length) of runs."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return list(zip(x[at].tolist(), np.diff(np.append(at, len(x))).tolist()))


@cache
def _among(some: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(some, np.uint8))


def facts(x: np.ndarray, y: np.ndarray, rules: Rules) -> dict:
    """Scores, errors and clean ends of two laid out sequences."""
    real, wanted = matrices()
    here = np.flatnonzero((x != 32) & (y != 32))
    begin, end = (int(here[0]), int(here[-1]) + 1) if len(here) else (0, 0)
    a, b = x[begin:end], y[begin:end]
    n = end - begin
    gap = (a == ord("*")) | (b == ord("*"))
    each, place = real[a, b].astype(np.float64), np.arange(n)
    since = place - np.maximum.accumulate(np.where(gap, -1, place)) - 1 if n else place  # columns of the gap before this one
    score = np.where(gap, (np.where(since == 0, GAP, 0) if rules.affine else np.where(since < FADED, each * FADE ** np.minimum(since, FADED), 0.0)), each).sum()
    gaps = [size for is_gap, size in runs(gap) if is_gap]
    expected = float(wanted[a, b].sum())
    if rules.gap_percents:
        share = sum(rules.gap_percents[min(g, len(rules.gap_percents)) - 1] for g in gaps)
        score -= score * min(share, rules.max_gap_percent) / 100
    upper = lambda v: np.where((v >= 97) & (v <= 122), v - 32, v)
    ua, ub = upper(a), upper(b)
    differs = ua != ub
    if rules.clean_distance:
        bad = differs & _among(b"ACGT*")[ua] & _among(b"ACGT*")[ub]
        # the ends are counted as the score is: the last column is the first from the right
        if max(bad[max(0, n - rules.clean_distance + 1) :].sum(), bad[: rules.clean_distance].sum()) > rules.clean_allowed:
            score = 0.0
    score = max(0.0, score)
    ratio = int(100.0 / expected * score + 0.5) if expected > 0 and score > 0 else 0
    codes = ~_among(b"ACGTNX*")[ua] & ~_among(b"ACGTNX*")[ub]
    mismatch = differs & ~gap & (codes | (real[a, b] == MISMATCH))
    front, back = (first_run(~differs), first_run(~differs[::-1])) if n else (0, 0)
    starts = [not (s[:begin] != 32).any() for s in (x, y)]
    stops = [not (s[end:] != 32).any() for s in (x, y)]
    # a clean end counts for the read that begins (or ends) there, in steps of four up to seven
    clean = [min(7, run // 4) if is_end else 0 for run, is_end in ((front, starts[0]), (back, stops[0]), (front, starts[1]), (back, stops[1]))]
    return {
        "score": int(score / TIMES), "expected": int(expected / TIMES), "ratio": ratio, "overlap": n, "mismatches": int(mismatch.sum()), "gaps": int((gap & differs).sum()), "longest_gap": max(gaps, default=0),
        "left1": int((y[:begin] == 32).sum()), "left2": int((x[:begin] == 32).sum()), "clean5_1": clean[0], "clean3_1": clean[1], "clean5_2": clean[2], "clean3_2": clean[3],
    }


def good_length(x: np.ndarray, y: np.ndarray, window: int, allowed: int) -> tuple[int, int] | None:
    """How far both reach from the overlap's begin with at most `allowed` errors in each window, up to the last window without any.

    Returns (length in one, length in two), counted in columns from where each may begin; None if that is under five columns.
    """
    real, _ = matrices()
    here = np.flatnonzero((x != 32) & (y != 32))
    if len(here) <= window:
        return None
    begin, n = int(here[0]), len(here)
    a, b = x[begin : begin + n], y[begin : begin + n]
    cost = real[a, b]
    error = (cost == MISMATCH) | (cost == GAP)
    unknown = _among(b"nx")[a | 32] | _among(b"nx")[b | 32]
    upto = np.concatenate([[0], np.cumsum(error)])
    errors = (upto[window:] - upto[:-window])[: n - window]  # of the window from each place
    place = np.arange(n)
    run = place - np.maximum.accumulate(np.where(unknown, -1, place))
    tail = run[window - 1 :][: n - window]
    stop = np.flatnonzero((errors > allowed) | (tail == 2 * window))
    upto = int(stop[0]) if len(stop) else n - window
    clean = np.flatnonzero((errors[:upto] == 0) & (tail[:upto] == 0))
    last = int(clean[-1]) if len(clean) else 0
    return (begin + last + window, last + window) if last >= 5 else None


def cigar(x: np.ndarray, y: np.ndarray) -> str:
    """Runs of columns: = and X where both have a base, D and I where one or two alone has, S where two overhangs one, N where one overhangs two."""
    kind = np.where(x == 32, ord("S"), np.where(y == 32, ord("N"), np.where(x == 42, ord("I"), np.where(y == 42, ord("D"), np.where((x | 32) == (y | 32), ord("="), ord("X"))))))
    return "".join(f"{n}{chr(c)}" for c, n in runs(kind))


def aligned(one: list[str], two: list[str], offset: list[int], rules: Rules) -> list[tuple[np.ndarray, np.ndarray, bool] | None]:
    """The columns of each pair, and whether its trace met the edge of the widest band."""
    s1, s2 = ([letters()[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)] for s in x] for x in (one, two))
    n1, n2, off = np.array([len(s) for s in s1]), np.array([len(s) for s in s2]), np.array(offset, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, bool] | None] = [None] * len(one)
    overlap = np.minimum(n1, off + n2) - np.maximum(off, 0)
    half = np.clip(overlap * rules.band_percent // 100, rules.band_min, rules.band_max)
    safety = np.clip(overlap // 100, 1, 15)
    rare = np.array([not (COMMON[a].all() and COMMON[b].all()) for a, b in zip(s1, s2)], bool)  # these are slower, so they go by themselves
    todo = np.flatnonzero((n1 > 0) & (n2 > 0) & (off - half <= n1) & (off + half + n2 >= 0))
    while len(todo):
        again = []
        rows = np.minimum(n1, off + half + n2) - np.maximum(0, off - half) + 1
        todo = todo[np.lexsort((-rows[todo], -half[todo], rare[todo]))]
        at = 0
        while at < len(todo):
            size, most = 1, rows[todo[at]]
            while at + size < len(todo):
                x = todo[at + size]
                longest = max(most, rows[x])
                if rare[x] != rare[todo[at]] or (size + 1) * 2 * (longest + half[todo[at]]) * (half[todo[at]] + 1) > ROOM:
                    break
                if size >= ENOUGH and (half[todo[at]] > half[x] * 1.2 + 8 or longest > min(most, rows[x]) * 1.2 + 64):
                    break
                size, most = size + 1, longest
            part = todo[at : at + size]
            at += size
            for x, trace in zip(part, traces([s1[x] for x in part], [s2[x] for x in part], off[part], half[part], rules)):
                covers = half[x] >= n1[x] + n2[x] + abs(off[x])
                if trace is None or trace[5] > safety[x] or covers:
                    out[x] = None if trace is None else (*laid_out(s1[x], s2[x], trace), False)
                elif 2 * half[x] <= rules.widest:
                    half[x] *= 2
                    again.append(x)
                else:
                    out[x] = (*laid_out(s1[x], s2[x], trace), True)
        todo = np.array(again, np.int64)
    return out


FACTS = ["score", "expected", "ratio", "overlap", "mismatches", "gaps", "longest_gap", "left1", "left2", "clean5_1", "clean3_1", "clean5_2", "clean3_2"]
SCHEMA = "rid1 long, rid2 long, eoffset long, " + ", ".join(f"{x} int" for x in FACTS) + ", good1 int, good2 int, band_hit boolean, accepted boolean, cigar string, aligned1 string, aligned2 string"


def alignments(pairs: DataFrame, rules: Rules = Rules(), window: int = 30, allowed: int = 3, with_text: bool = True) -> DataFrame:
    """pairs(rid1, rid2, seq1, seq2, eoffset) with the alignment of each and its facts; eoffset: where seq2 begins in seq1.

    accepted: the score is high enough and either overlap and ratio are, or the overlap is perfect; never where the
    trace met the edge of the widest band (band_hit). good1, good2: how far the first `window` columns' quality holds.
    A pair without any solution, or with a null or empty sequence, has nulls and is not accepted.
    """
    kinds = [pa.int64()] * 3 + [pa.int32()] * (len(FACTS) + 2) + [pa.bool_()] * 2 + [pa.string()] * 3
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            out = []
            for r1, r2, o, found in zip(d["rid1"], d["rid2"], d["eoffset"], aligned([x or "" for x in d["seq1"]], [x or "" for x in d["seq2"]], [x or 0 for x in d["eoffset"]], rules)):
                if found is None:
                    out.append((r1, r2, o, *[None] * (len(FACTS) + 2), False, False, None, None, None))
                    continue
                x, y, hit = found
                f = facts(x, y, rules)
                good = good_length(x, y, window, allowed) or (None, None)
                enough = f["score"] >= rules.min_score // TIMES and (f["overlap"] >= rules.min_overlap and f["ratio"] >= rules.min_relscore or f["overlap"] >= 17 and f["ratio"] == 100)
                texts = (x.tobytes().decode("latin-1"), y.tobytes().decode("latin-1")) if with_text else (None, None)
                out.append((r1, r2, o, *(f[c] for c in FACTS), *good, hit, bool(enough and not hit), cigar(x, y), *texts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return pairs.select("rid1", "rid2", "seq1", "seq2", "eoffset").mapInArrow(run, SCHEMA)


def edges(found: DataFrame) -> DataFrame:
    """Edges from both ends of accepted alignments, (rid1, rid2, weight, ratio, rank): weight is score times ratio squared.

    Of several alignments of a pair the one of most weight counts; rank orders a read's edges, equal weights by the other read.
    """
    weight = F.col("score").cast("long") * F.col("ratio") * F.col("ratio")
    best = found.where("accepted").groupBy("rid1", "rid2").agg(F.max(F.struct(weight.alias("weight"), F.col("ratio"))).alias("x")).select("rid1", "rid2", "x.*")
    both = best.union(best.select("rid2", "rid1", "weight", "ratio"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("rid1").orderBy(F.desc("weight"), "rid2")))


def bans(found: DataFrame) -> DataFrame:
    """(lo, hi): pairs without an accepted alignment."""
    by = found.groupBy(F.least("rid1", "rid2").alias("lo"), F.greatest("rid1", "rid2").alias("hi")).agg(F.bool_or("accepted").alias("any"))
    return by.where(~F.col("any")).select("lo", "hi")
