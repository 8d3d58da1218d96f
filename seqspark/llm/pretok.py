"""Splitting of code points into the pieces that byte-pair tokenizers merge separately, on numpy arrays."""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
APOSTROPHE = 0x27


@cache
def class_table() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    text = "".join(map(chr, [x if not 0xD800 <= x < 0xE000 else 0 for x in range(0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = OTHER
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text begins (one more entry: the end)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def widths(cp: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return (1 + (cp > 0x7F).view(np.uint8) + (cp > 0x7FF).view(np.uint8) + (cp > 0xFFFF).view(np.uint8)).astype(np.uint8)


def piece_starts(cp: np.ndarray, at: np.ndarray, *, joins_space: bool, single_numbers: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin (boolean per code point), and the class of each code point.

    joins_space: one blank before a run belongs to it and other white space makes pieces; else white space
    only separates. single_numbers: each number is a piece of its own. The contractions 's 't 're 've 'm
    'll 'd are pieces where an apostrophe begins one.
    """
    n = len(cp)
    cls = class_table()[cp]
    if not n:
        return np.zeros(0, bool), cls
    first = np.zeros(n, bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    space = cls == SPACE
    start = first.copy()
    start[1:] |= cls[1:] != cls[:-1]
    if single_numbers:
        start |= cls == NUMBER
    if joins_space:
        more = space[:-1] & ~space[1:] & ~first[1:]  # the last blank of a run that text follows
        start[:-1] |= more
        start[1:] &= ~(more & (cp[:-1] == 0x20))
    quote = np.flatnonzero((cp == APOSTROPHE) & start)
    if len(quote):
        pad = np.append(cp, np.zeros(3, np.uint32))
        edge = np.append(first, np.ones(3, bool))
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"]) & ~edge[quote + 1]
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~edge[quote + 1] & ~edge[quote + 2]
        for hit, size in ((quote[one], 2), (quote[two], 3)):
            start[hit + 1] = False
            after = hit + size
            start[after[after < n]] = True
    return start, cls
