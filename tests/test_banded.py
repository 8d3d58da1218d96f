"""Banded alignment against cell-by-cell brute force, planted errors, and known shapes."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest

from seqspark.operators import banded as B

KIND = "rid1 long, rid2 long, seq1 string, seq2 string, eoffset long"


def brute(one, two, offset, half, rules):
    """Fills the band a cell at a time and follows one trace."""
    real, _ = B.matrices()
    n1, n2 = len(one), len(two)
    score = {}
    for i in range(n1 + 1):
        for j in range(max(0, i - offset - half), min(n2, i - offset + half) + 1):
            if i == 0 or j == 0:
                score[i, j] = 0
                continue
            options = [score[a, b] + w for a, b, w in ((i - 1, j - 1, real[ord(one[i - 1]), ord(two[j - 1])]), (i - 1, j, B.GAP), (i, j - 1, B.GAP)) if (a, b) in score]
            score[i, j] = max(options)
    row = col = (-1, 0)
    for j in range(1, n2 + 1):
        v = score.get((n1, j), -1)
        if v >= rules.min_score and v * 10000 // min(j, n1) >= rules.min_relscore and v >= row[0]:
            row = (v, j)
    for i in range(1, n1 + 1):
        v = score.get((i, n2), -1)
        if v >= rules.min_score and v * 10000 // min(i, n2) >= rules.min_relscore and v >= col[0]:
            col = (v, i)
    if max(row, col)[0] < 0:
        return None
    i, j = (n1, row[1]) if row[0] > col[0] else (col[1], n2)
    x, y = (list(one[i:]), [" "] * (n1 - i)) if j == n2 else ([], [])
    if j < n2:
        x, y = [" "] * (n2 - j), list(two[j:])
    x, y, last, had = x[::-1], y[::-1], "d", False
    while i > 0 and j > 0:
        s = score[i, j]
        d = score.get((i - 1, j - 1), -1e9) + real[ord(one[i - 1]), ord(two[j - 1])] == s
        u = score.get((i - 1, j), -1e9) + B.GAP == s
        w = score.get((i, j - 1), -1e9) + B.GAP == s
        if had and d and (u or w):
            d = False
        if u and last == "u":
            d = False
        if w and last == "l":
            d = u = False
        had = one[i - 1] == "N" or two[j - 1] == "N"
        if d:
            x, y, i, j, last = [*x, one[i - 1]], [*y, two[j - 1]], i - 1, j - 1, "d"
        elif u:
            x, y, i, last = [*x, one[i - 1]], [*y, "*"], i - 1, "u"
        else:
            x, y, j, last = [*x, "*"], [*y, two[j - 1]], j - 1, "l"
    x, y = [*x, *one[:i][::-1], *[" "] * j], [*y, *[" "] * i, *two[:j][::-1]]
    return "".join(x[::-1]), "".join(y[::-1])


def mutated(rnd, s, errors, letters="ACGT"):
    s = list(s)
    for _ in range(errors):
        k = rnd.randrange(len(s))
        what = rnd.choice("sid")
        if what == "s":
            s[k] = rnd.choice(letters)
        elif what == "i":
            s.insert(k, rnd.choice(letters))
        elif len(s) > 2:
            del s[k]
    return "".join(s)


def cases():
    rnd = random.Random(12)
    out = []
    for _ in range(250):
        letters = rnd.choice(["ACGT", "ACGT", "AC", "ACGTN", "ACGTMRWSYKVHDBNX*"])
        one = "".join(rnd.choices(letters, k=rnd.choice([5, 17, 30, 60, 90])))
        cut = rnd.randrange(len(one))
        two = mutated(rnd, one[cut:] + "".join(rnd.choices(letters, k=rnd.choice([0, 8, 30]))), rnd.choice([0, 1, 3, 6]), letters)
        if rnd.random() < 0.3:
            one, two, cut = two, one, -cut
        out.append((one, two, cut + rnd.choice([0, 0, 1, -2, 5])))
    return out


def test_traces_equal_brute_force():
    rules = B.Rules(min_score=30)
    some = cases()
    half = np.array([[3, 8, 25][k % 3] for k in range(len(some))])
    arrays = [[np.frombuffer(c[x].encode(), np.uint8) for c in some] for x in (0, 1)]
    got = B.traces(*arrays, np.array([c[2] for c in some]), half, rules)
    solved = 0
    for (one, two, offset), h, trace, a, b in zip(some, half, got, *arrays):
        want = brute(one, two, offset, int(h), rules)
        if want is None:
            assert trace is None
            continue
        solved += 1
        assert tuple(v.tobytes().decode() for v in B.laid_out(a, b, trace)) == want
    assert solved > 150


def test_batching_changes_nothing(monkeypatch):
    some = cases()
    columns = [list(x) for x in zip(*some)]
    whole = B.aligned(*columns, B.Rules())
    monkeypatch.setattr(B, "ROOM", 20_000)
    for a, b in zip(whole, B.aligned(*columns, B.Rules())):
        assert (a is None) == (b is None) and (a is None or a[0].tobytes() == b[0].tobytes() and a[1].tobytes() == b[1].tobytes())


def plain_facts(x, y, rules):
    real, wanted = B.matrices()
    cols = [k for k in range(len(x)) if x[k] != " " and y[k] != " "]
    score = expected = percent = stars = 0
    for k in [*cols, None]:
        a, b = (x[k], y[k]) if k is not None else (" ", " ")
        if "*" in (a, b):
            score += (B.GAP if stars == 0 else 0) if rules.affine else real[ord(a), ord(b)] * 0.9**stars if stars < 50 else 0
            stars += 1
        else:
            if stars and rules.gap_percents:
                percent += rules.gap_percents[min(stars, len(rules.gap_percents)) - 1]
            stars = 0
            score += real[ord(a), ord(b)]
        expected += wanted[ord(a), ord(b)]
    score -= score * min(percent, rules.max_gap_percent) / 100
    bad = [k for k, c in enumerate(cols) if x[c].upper() != y[c].upper() and {x[c].upper(), y[c].upper()} <= set("ACGT*")]
    n = len(cols)
    if max(sum(n - k < rules.clean_distance for k in bad), sum(k < rules.clean_distance for k in bad)) > rules.clean_allowed:
        score = 0
    score = max(0, score)
    return int(score / 10), int(expected / 10), int(100 / expected * score + 0.5) if expected > 0 and score > 0 else 0


@pytest.mark.parametrize("rules", [B.Rules(), B.Rules(gap_percents=B.GAP_PERCENTS), B.Rules(affine=True), B.Rules(clean_distance=6, clean_allowed=1, gap_percents=(0, 50), max_gap_percent=70)])
def test_facts_equal_a_plain_count(rules):
    some = cases()
    for found in B.aligned(*[list(c) for c in zip(*some)], replace(rules, min_score=30)):
        if found is not None:
            x, y = (v.tobytes().decode() for v in found[:2])
            f = B.facts(*found[:2], rules)
            assert (f["score"], f["expected"], f["ratio"]) == plain_facts(x, y, rules)
            n = 0
            for length in B.cigar(*found[:2]).replace("=", "X").replace("D", "X").replace("I", "X").replace("S", "X").replace("N", "X").split("X")[:-1]:
                n += int(length)
            assert n == len(x)


def test_clean_ends_and_offsets():
    rnd = random.Random(3)
    s = "".join(rnd.choices("ACGT", k=120))
    two = s[40:] + "ACGT" * 5
    two = two[:10] + ("A" if two[10] != "A" else "C") + two[11:]
    x, y, hit = B.aligned([s], [two], [40], B.Rules())[0]
    f = B.facts(x, y, B.Rules())
    assert (f["overlap"], f["mismatches"], f["gaps"], f["left1"], f["left2"], hit) == (80, 1, 0, 40, 0, False)
    # one ends and two begins inside the overlap: 69 and 10 equal bases, in steps of four up to seven
    assert (f["clean5_1"], f["clean3_1"], f["clean5_2"], f["clean3_2"]) == (0, 7, 2, 0)
    assert f["score"] == 78 and f["expected"] == 80


def test_good_length_equals_a_sliding_window():
    rnd = random.Random(9)
    for _ in range(200):
        n = rnd.choice([10, 40, 90])
        x = "".join(rnd.choices("ACGT", k=n))
        y = "".join(c if rnd.random() > 0.08 else rnd.choice("ACGTN*") for c in x)
        y = y[:60] + "N" * (len(y) - 60)
        window, allowed = 6, 2
        a, b = (np.frombuffer((" " * p + v).encode(), np.uint8) for p, v in ((0, "GG" + x), (2, y)))
        real, _ = B.matrices()
        wrong = [real[ord(p), ord(q)] in (B.MISMATCH, B.GAP) for p, q in zip(x, y)]
        last = unknown = 0
        for k in range(window - 1):
            unknown = unknown + 1 if x[k] in "NX" or y[k] in "NX" else 0
        for t in range(n - window):
            errors = sum(wrong[t : t + window])
            k = t + window - 1
            unknown = unknown + 1 if x[k] in "NX" or y[k] in "NX" else 0
            if not unknown and not errors:
                last = t
            if unknown == 2 * window or errors > allowed:
                break
        want = (2 + last + window, last + window) if last >= 5 else None
        assert B.good_length(a, b, window, allowed) == want


def test_gap_runs_and_widening(spark):
    """Gap shapes: several short gaps against a long sequence with stars, and a gap that the first band misses."""
    rnd = random.Random(6)
    s = "".join(rnd.choices("ACGT", k=600))
    dropped = s[100:150] + s[153:200] + s[201:260] + s[262:300]
    moved = s[:250] + s[310:]  # sixty bases are missing
    rows = [(1, 2, s, dropped, 100), (3, 4, s, moved, 0), (5, 6, s, None, 0), (7, 8, "", s, 0), (9, 10, s, "ACGT", 0), (11, 12, "a b" * 20, s, None), (13, 14, s, s, 10_000)]
    got = {r.rid1: r for r in B.alignments(spark.createDataFrame(rows, KIND).repartition(3)).collect()}
    assert got[1].accepted and got[1].gaps == 6 and got[1].longest_gap == 3 and got[1].aligned2.count("*") == 6
    assert got[3].gaps == 60 and got[3].longest_gap == 60 and not got[3].band_hit
    assert {got[k].accepted for k in (5, 7, 9, 11, 13)} == {False} and got[5].cigar is None
    assert got[1].cigar.startswith("100N") and got[1].aligned1.replace("*", "").strip() == s


def test_edges_and_bans(spark):
    kind = "rid1 long, rid2 long, score int, ratio int, accepted boolean"
    found = spark.createDataFrame([(1, 2, 50, 90, True), (1, 2, 60, 100, True), (3, 1, 40, 100, True), (4, 1, None, None, False), (2, 4, 9, 3, False), (4, 2, 70, 80, True)], kind)
    rows = sorted(tuple(r) for r in B.edges(found).collect())
    assert rows == [(1, 2, 600_000, 100, 1), (1, 3, 400_000, 100, 2), (2, 1, 600_000, 100, 1), (2, 4, 448_000, 80, 2), (3, 1, 400_000, 100, 1), (4, 2, 448_000, 80, 1)]
    assert [tuple(r) for r in B.bans(found).collect()] == [(1, 4)]


def test_pairs_of_unlike_size_share_a_batch(monkeypatch):
    """A batch costs its longest pair's lines, so a few long pairs must not make a batch each."""
    rnd = random.Random(8)
    seqs = ["".join(rnd.choices("ACGT", k=n)) for n in range(700, 4700, 100)]
    batches, fill = [], B.traces
    monkeypatch.setattr(B, "traces", lambda one, *rest: batches.append(len(one)) or fill(one, *rest))
    found = B.aligned(seqs, [s[50:] for s in seqs], [50] * len(seqs), B.Rules())
    assert batches == [40]
    assert all(B.cigar(x, y) == f"50N{len(s) - 50}=" for (x, y, _), s in zip(found, seqs))


def test_traces_in_step_and_one_by_one_agree(monkeypatch):
    some = cases()
    columns = [list(x) for x in zip(*some)]
    monkeypatch.setattr(B, "FEW", 1)
    monkeypatch.setattr(B, "AGAIN", 64)
    monkeypatch.setattr(B, "BLOCK", 1_000)
    whole = B.aligned(*columns, B.Rules())
    monkeypatch.undo()
    monkeypatch.setattr(B, "FEW", 1 << 30)
    for a, b in zip(whole, B.aligned(*columns, B.Rules())):
        assert (a is None) == (b is None) and (a is None or a[0].tobytes() == b[0].tobytes() and a[1].tobytes() == b[1].tobytes())
