"""Importance resampling of documents towards a target distribution of hashed n-grams.

A text's features are its runs of one to three words; crc32 hashes them to buckets. The buckets' counts in
the corpus and in the target give each bucket a gain, and a document weighs the sum of its features' gains,
read from one array. A seeded Gumbel draw is added, so that the highest scores are a sample without
replacement in proportion to exp(weight).

Each partition writes its eligible rows as a sorted run. The runs are cut at common places of the order into
blocks, the blocks of a range are merged by a tournament tree, and ranges before it tell where its ranks
begin. Ranges beyond the draw are not merged, and the last one stops at the exact count.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.llm import common
from seqspark.llm.common import Scratch

BUCKETS = 10_000
LONGEST = 3
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
#: Rows of a range that is merged in one task, ranges at most, and sampled keys for each range.
RANGE_ROWS, RANGES, KEYS = 100_000, 5_000, 16
#: Words up to so many bytes are hashed in step.
IN_STEP = 32
ONES = np.uint32(0xFFFFFFFF)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 of a byte; registers moved on by 0 to IN_STEP bytes of zero, by byte of the register; and by 2^k of them."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    moved = np.zeros((IN_STEP + 1, 4, 256), np.uint32)
    for k in range(4):
        moved[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(IN_STEP):
        moved[n + 1] = one[moved[n] & 255] ^ (moved[n] >> 8)
    twice = np.zeros((31, 4, 256), np.uint32)
    twice[0] = moved[1]
    for k in range(30):
        twice[k + 1] = _move(twice[k], twice[k])
    return one, moved, twice


def _move(table: np.ndarray, s: np.ndarray) -> np.ndarray:
    return table[0][s & 255] ^ table[1][(s >> 8) & 255] ^ table[2][(s >> 16) & 255] ^ table[3][s >> 24]


def append(s: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Registers s after words of these sizes, which give `own` from a register of zero."""
    _, moved, twice = tables()
    n = np.minimum(size, IN_STEP)
    out = moved[n, 0, s & 255] ^ moved[n, 1, (s >> 8) & 255] ^ moved[n, 2, (s >> 16) & 255] ^ moved[n, 3, s >> 24]
    for at in np.flatnonzero(size > IN_STEP):
        x, left = s[at : at + 1], int(size[at])
        for k in range(left.bit_length()):
            if left >> k & 1:
                x = _move(twice[k], x)
        out[at] = x[0]
    return out ^ own


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z in lower case, where words begin and end, and each text's first word (one more: the end)."""
    column = pc.fill_null(column, "")
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    kind = np.arange(256)
    lower = np.where((kind >= 65) & (kind <= 90), kind + 32, kind).astype(np.uint8)
    inside = (kind >= 0x30) & (kind <= 0x39) | (kind >= 0x61) & (kind <= 0x7A) | (kind >= 0x80)
    raw = lower[raw]
    w = inside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begin = np.flatnonzero(w & (np.append(True, ~w[:-1]) | edge[:-1])[: len(w)])
    end = np.flatnonzero(w & (np.append(~w[1:], True) | edge[1:])[: len(w)]) + 1
    return raw, begin, end, np.searchsorted(begin, at)


def buckets(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket of the run of n words from each word, whether it stays in the text) for n = 1, 2, 3, in a row."""
    one, _, _ = tables()
    size = end - begin
    order = np.argsort(np.minimum(size, IN_STEP + 1).astype(np.uint8), kind="stable")
    n, b, s = size[order], begin[order], np.zeros(len(size), np.uint32)
    stop = np.searchsorted(n, IN_STEP + 1)
    for k in range(int(n[stop - 1]) if stop else 0):
        from_ = np.searchsorted(n[:stop], k + 1)
        s[from_:stop] = one[(s[from_:stop] ^ raw[b[from_:stop] + k]) & 255] ^ (s[from_:stop] >> 8)
    for k in range(stop, len(n)):
        s[k] = zlib.crc32(raw[b[k] : b[k] + n[k]].tobytes(), 0xFFFFFFFF) ^ 0xFFFFFFFF
    own = np.empty_like(s)
    own[order] = s
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out, now = [], append(np.full(len(own), ONES), size, own)
    for k in range(LONGEST):
        inside = np.ones(len(own), bool)
        if k:
            inside[max(0, len(own) - k) :] = False
            inside[:-k] = text[k:] == text[:-k]
            now[:-k] = append((one[(now ^ np.uint32(0x20)) & 255] ^ (now >> 8))[:-k], size[k:], own[k:])
        out += [((now ^ ONES) % np.uint32(BUCKETS)).astype(np.int64), inside]
    return tuple(out)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts(t) fall in each bucket; every task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in common.slices(whole, "t", 1 << 20):
                found = buckets(*words(batch.column("t")))
                for bucket, inside in zip(found[::2], found[1::2]):
                    sums += np.bincount(bucket[inside], minlength=BUCKETS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(common.tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of a bucket's smoothed share in the target over that in the corpus, rounded down."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_column: str, text_column: str) -> DataFrame:
    """(id, n_features, weight, words) of every row."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "t", 1 << 20):
                raw, begin, end, first = words(batch.column("t"))
                found = buckets(raw, begin, end, first)
                n, w = np.zeros(len(begin) + 1, np.int64), np.zeros(len(begin) + 1, np.int64)
                for bucket, inside in zip(found[::2], found[1::2]):
                    n[1:] += inside
                    w[1:] += np.where(inside, gain[bucket], 0)
                n, w = np.cumsum(n)[first], np.cumsum(w)[first]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (np.diff(n), np.diff(w), np.diff(first)))], ["id", "n_features", "weight", "words"])

    kind = T.StructType([rows.schema["id"], *(T.StructField(x, T.LongType()) for x in ("n_features", "weight", "words"))])
    return rows.mapInArrow(common.tidy(run), kind)


def noise(id_column, seed: int):
    """Floor of 1000 times a Gumbel variate that the id and the seed give."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def key(score: int, doc) -> tuple:
    """Places in the order: the highest score first, of equals the smallest id, null last."""
    return (-score, doc is None, 0 if doc is None else doc)


class Tournament:
    """Merges sorted runs: a tree of losers, replayed from the winner's leaf to the root for each row.

    Runs are lists of (key, row). Of equal keys the run of the lower number wins.
    """

    END = (math.inf,)

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = [iter(r) for r in runs], max(1, len(runs))
        self.heads = [next(r, (self.END, None)) for r in self.runs] or [(self.END, None)]
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def __iter__(self) -> Iterator:
        while self.heads[self.winner][0] is not self.END:
            yield self.heads[self.winner][1]
            now = self.winner
            self.heads[now] = next(self.runs[now], (self.END, None))
            node = (now + self.k) // 2
            while node:
                if self.before(self.losers[node], now):
                    self.losers[node], now = now, self.losers[node]
                node //= 2
            self.winner = now


def splitters(able: DataFrame, wanted: int, n: int, ranges: int) -> list[tuple]:
    """Keys at which runs are cut: about `ranges` ranges of the rows wanted and as many after them; the last range is the rest.

    They come from a sample of KEYS keys a range, and only set which rows are merged together, not the result.
    """
    least = able.agg(F.percentile_approx("score", max(0.0, 1 - 2 * wanted / n), 10_000).alias("q")).first()["q"]
    near = able.where(F.col("score") >= least).select("score", "id")
    some = near.sample(min(1.0, KEYS * ranges / (wanted + 1)), 42).toArrow()
    sample = sorted(key(s, d) for s, d in zip(some["score"].to_pylist(), some["id"].to_pylist()))
    step = max(1, len(sample) // (2 * ranges))
    return [*sample[step - 1 :: step], (-least, True, 0)]


def blocks_of(scored: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Sorted rows as blocks (range, n, rows): each is a piece of a sorted run within one range."""
    kind = T.StructType([T.StructField("range", T.LongType()), T.StructField("n", T.LongType()), T.StructField("rows", T.ArrayType(T.StructType([scored.schema[x] for x in ("id", "n_features", "weight", "score")])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out, now, last = [], None, None
            for r in rows:
                k = key(r["score"], r["id"])
                at = now if now is not None and k >= last and (now == len(cuts) or k <= cuts[now]) else bisect.bisect_left(cuts, k)
                if at != now or k < last:  # another range, or another run begins
                    out.append((at, []))
                out[-1][1].append(r)
                now, last = at, k
            arrays = [pa.array([x for x, _ in out], pa.int64()), pa.array([len(x) for _, x in out], pa.int64())]
            values = pa.array(rows, pa.struct([batch.schema.field(x) for x in batch.schema.names]))
            offsets = np.cumsum([0, *(len(x) for _, x in out)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), values)], ["range", "n", "rows"])

    return scored.select("id", "n_features", "weight", "score").mapInArrow(common.tidy(run), kind)


def draw(scored: DataFrame, scratch: Scratch, *, num: int, den: int) -> DataFrame:
    """scored(id, n_features, weight, score, eligible) with ranks 1, 2, 3... of the floor(num * n / den) best of n eligible rows.

    Few values reach the driver: about 2 * KEYS keys for each range, and its number of rows.
    """
    spark = scored.sparkSession
    runs = scratch.save(scored.sortWithinPartitions(F.desc("eligible"), F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight"), "runs")
    able = runs.where("eligible")
    n = able.count()
    wanted = num * n // den
    ranges = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted // RANGE_ROWS + 1))
    cuts = splitters(able, wanted, n, ranges) if wanted else []
    blocks = scratch.save(blocks_of(able, cuts), "blocks")
    held = {r.range: r.n for r in blocks.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    before, sums = {}, 0
    for r in sorted(held):
        if sums >= wanted:
            break
        before[r], sums = sums, sums + held[r]
    last = max(before, default=-1)
    kind = T.StructType([*(scored.schema[x] for x in ("id", "n_features", "weight", "score")), T.StructField("rank", T.LongType())])

    def keyed(run: int, rows: list[dict]) -> Iterator:
        return ((key(r["score"], r["id"]), (run, r)) for r in rows)

    def merge(place: tuple, group: pa.Table) -> pa.Table:
        lists = group.column("rows").to_pylist()
        from_ = before[place[0].as_py()]
        tree = Tournament([keyed(j, rows) for j, rows in enumerate(lists)])
        out, taken = [], [0] * len(lists)
        if wanted > from_:
            for rank, (j, r) in enumerate(tree, from_ + 1):
                out.append(r | {"rank": rank})
                taken[j] += 1
                if rank == wanted:
                    break
        out += [r | {"rank": None} for rows, k in zip(lists, taken) for r in rows[k:]]
        return pa.Table.from_pylist(out, to_arrow)

    to_arrow = pa.schema([(x.name, pa.string() if isinstance(x.dataType, T.StringType) else pa.int32() if isinstance(x.dataType, T.IntegerType) else pa.int64()) for x in kind])
    drawn = blocks.where(F.col("range") <= last).groupBy("range").applyInArrow(merge, kind)
    none = F.lit(None).cast("long").alias("rank")
    rest = blocks.where(F.col("range") > last).select(F.inline("rows")).select("id", "n_features", "weight", "score", none)
    return drawn.union(rest).union(runs.where(~F.col("eligible")).select("id", "n_features", "weight", "score", none))


def resample(docs: DataFrame, target: DataFrame, *, num: int = 5, den: int = 100, seed: int = 42, least_words: int = LEAST_WORDS, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """Weight, score and rank of every document: id_column, n_features, weight, score, rank.

    Of the n documents with least_words words or more, the floor(num * n / den) highest scores are drawn and
    ranked from 1, of equal scores the smaller id first (a null id last, hashed as an empty one); others have
    a null rank. Null and empty texts have no features and weigh 0. Repeated rows are rows of their own; which
    of rows equal in id and score gets which rank is left open. An empty table gives an empty one, an empty
    target counts as no features; other columns are ignored. Ids are strings, ints or longs.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch = Scratch(spark)
    gain = gains(bucket_counts(docs.select(docs[text_column].alias("t"))), bucket_counts(target.select(target[target_column].alias("t"))))
    rows = weighed(docs, gain, id_column, text_column)
    scored = rows.select("id", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), (F.col("words") >= least_words).alias("eligible"))
    return draw(scored, scratch, num=num, den=den).withColumnRenamed("id", id_column)
