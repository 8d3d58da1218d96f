"""Binary base-call traces (SCF 2 and 3): header, samples with second differences, bases."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC, HEADER = b".scf", ">4s8I4s4I18I"


def delta(samples: np.ndarray) -> np.ndarray:
    """Second differences modulo the width of the type."""
    first = np.diff(samples, prepend=samples.dtype.type(0))
    return np.diff(first, prepend=samples.dtype.type(0))


def undelta(differences: np.ndarray) -> np.ndarray:
    """Undo delta()."""
    kind = differences.dtype
    return np.cumsum(np.cumsum(differences, dtype=kind), dtype=kind)


def read_scf(data: bytes) -> dict:
    """Samples of A, C, G and T, base calls, their peaks and the probabilities of each base."""
    h = struct.unpack_from(HEADER, data)
    magic, n, at, bases, _, _, bases_at, _, _, version, width = h[:11]
    if magic != MAGIC:
        raise ValueError("not a trace file")
    kind = np.dtype(">u1" if width == 1 else ">u2")
    if float(version.decode("ascii", "replace").strip("\0 ") or 0) >= 3:
        traces = [undelta(np.frombuffer(data, kind, n, at + k * n * kind.itemsize).astype(kind.newbyteorder("="))) for k in range(4)]
        peaks = np.frombuffer(data, ">u4", bases, bases_at)
        rest = np.frombuffer(data, np.uint8, 5 * bases, bases_at + 4 * bases).reshape(5, bases)
        probabilities, calls = rest[:4], rest[4]
    else:
        traces = list(np.frombuffer(data, kind, 4 * n, at).reshape(n, 4).T.astype(kind.newbyteorder("=")))
        rows = np.frombuffer(data, np.dtype([("peak", ">u4"), ("p", "u1", 4), ("call", "u1"), ("spare", "u1", 3)]), bases, bases_at)
        peaks, probabilities, calls = rows["peak"], rows["p"].T, rows["call"]
    return {"samples": [t.tolist() for t in traces], "seq": calls.tobytes().decode("latin-1"), "peaks": peaks.tolist(), "probabilities": [p.tolist() for p in probabilities]}


def write_scf(samples: list[list[int]], seq: str, peaks: list[int], probabilities: list[list[int]]) -> bytes:
    """A trace file of version 3 with samples of two bytes."""
    n, bases, start = len(samples[0]), len(seq), 128
    body = b"".join(delta(np.array(t, np.uint16)).astype(">u2").tobytes() for t in samples)
    calls = np.array(peaks, ">u4").tobytes() + b"".join(bytes(p) for p in probabilities) + seq.encode("latin-1") + bytes(3 * bases)
    comments = b"\0"
    head = struct.pack(HEADER, MAGIC, n, start, bases, 0, 0, start + len(body), len(comments), start + len(body) + len(calls), b"3.00", 2, 0, 0, 0, *[0] * 18)
    return head + body + calls + comments


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, qual, peaks, samples) of trace files; a quality is the probability of the base that was called."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, content in zip(b.path, b.content):
                t = read_scf(bytes(content))
                qual = [t["probabilities"]["ACGT".index(c)][i] if (c := x.upper()) in "ACGT" else 0 for i, x in enumerate(t["seq"])]
                out.append((name, t["seq"], qual, t["peaks"], t["samples"]))
            yield pd.DataFrame(out, columns=["path", "seq", "qual", "peaks", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, seq string, qual array<int>, peaks array<long>, samples array<array<int>>")
