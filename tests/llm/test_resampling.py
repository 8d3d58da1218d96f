"""Importance resampling against a plain Python version, and its parts against libraries."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqspark.llm import resampling as R

DOCS = "doc_id long, text string, lang string, score double, id long, weight string, rank int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def features(text):
    w = WORD.findall(lower(text or ""))
    return [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)], len(w)


def brute(rows, target, num=5, den=100):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[0])
    for x in target:
        t.update(features(x)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for r in rows:
        f, n = features(r[1])
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: R.key(x[3], x[0]))
    for k, x in enumerate(able[: num * len(able) // den], 1):
        x[4] = k
    return [tuple(x[:5]) for x in out]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    pool = ["Alpha", "beta", "Éclair", "naïve", "中文", "x2", "İ", "ß", "w" * 70, "don't", "a-b", "\x00q\x7fr", "😀"]
    out = [(k, " ".join(rnd.choices(pool, k=rnd.choice([0, 1, 2, 3, 19, 20, 21, 60]))), None, None, None, None, None) for k in range(900)]
    out += [(9001, None, "en", 1.0, 2, "x", 3), (9002, "", None, None, None, None, None), (9003, "beta " * 30_000, None, None, None, None, None), (None, "alpha " * 25, None, None, None, None, None)]
    return [*out, out[5]]


def collect(df):
    return [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]


def test_equals_a_plain_version(spark, rows):
    target = ["Alpha beta x2", "中文 beta", None, ""]
    docs, bench = spark.createDataFrame(rows, DOCS).repartition(6), spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = collect(R.resample(docs, bench))
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, target)))
    half = collect(R.resample(docs, bench, num=50))
    assert sorted(map(repr, half)) == sorted(map(repr, brute(rows, target, num=50)))
    everything = collect(R.resample(docs, bench, num=100, least_words=0))
    assert sorted(r[4] for r in everything) == list(range(1, len(rows) + 1))


def test_many_runs_and_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 3)
    docs, bench = spark.createDataFrame(rows, DOCS).repartition(16), spark.createDataFrame([(0, "naïve x2")], "item_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    assert sorted(map(repr, collect(R.resample(docs, bench, num=37)))) == sorted(map(repr, brute(rows, ["naïve x2"], num=37)))


def test_equal_scores_and_small_tables(spark):
    docs = spark.createDataFrame([(k % 7, "one two three " * 7, None, None, None, None, None) for k in range(70)], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    got = collect(R.resample(docs, bench, num=20))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 15)) and len(got) == 70
    assert {r[4] for r in collect(R.resample(docs.limit(3), bench))} == {None}
    assert R.resample(spark.createDataFrame([], DOCS), bench).count() == 0


def test_tournament():
    rnd = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rnd.choices(range(20), k=rnd.choice([0, 1, 4, 30]))) for _ in range(k)]
        assert list(R.Tournament([((( x,), x) for x in r) for r in runs])) == list(heapq.merge(*runs))


def test_crc_of_runs_of_words():
    texts = ["a bb ccc dddd", "x" * 33 + " " + "y" * 1000 + " z", None, "", "Ünïcode ZZ"]
    raw, begin, end, first = R.words(pa.array(texts))
    found = R.buckets(raw, begin, end, first)
    for n in (1, 2, 3):
        bucket, inside = found[2 * n - 2], found[2 * n - 1]
        want = [zlib.crc32(" ".join(w[k : k + n]).encode()) % R.BUCKETS for t in texts for w in [WORD.findall(lower(t or ""))] for k in range(len(w) - n + 1)]
        assert bucket[inside].tolist() == want
    assert R.gains(np.zeros(R.BUCKETS, np.int64), np.zeros(R.BUCKETS, np.int64)).tolist() == [0] * R.BUCKETS
