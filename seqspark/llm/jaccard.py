"""Exact Jaccard join of word n-gram sets, size-aware and split into light and heavy parts.

Sets are compared by 64-bit hashes of their shingles. Equal sets form a class, and classes are compared.

Small sets emit a hash of each subset they may share with a partner; all that share a subset large enough
for their sizes are linked. Large sets put the first few of their shingles, in a common order, into inverted
lists: partners must meet in one. The order puts frequent shingles last, so lists stay short; any order finds
the same links. The boundary between small and large is where enumeration costs more than lists, from the
histogram of set sizes.

Every link is found and counted once. Below a subset, sizes are counted instead of pairs. Members of a short list
are paired if they can still be similar by what their lists tell. Classes that hang together by such pairs and by
long lists form a family, whose whole sets are compared block by block; a block gives how many links each class has
and a forest that spans them, so large groups of near copies emit no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm import common
from seqspark.llm.common import Scratch

#: Frequent shingles that every worker is told (12 bytes each), the most frequent ones: they only set the order.
HEAVY = 300_000
#: Texts that must share a shingle before it counts as frequent, and the multiple of a lead that is counted.
SEEN, COUNTED = 3, 2
#: Rows of three longs that are sent to all workers; larger tables are dealt out by key.
BROADCAST_ROWS = 300_000
#: Members from which on a list is not paired but makes a family.
LONG = 64
#: Classes and shingles of a family's piece at most, about; a block is two of them.
BLOCK_ROWS, BLOCK_ITEMS = 500, 1 << 18
#: Owners up to which a shingle of a block is counted by its pairs.
RARE = 48
MOST_SMALL = 29
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


@cache
def byte_codes() -> np.ndarray:
    """A 64-bit code of each byte; A-Z as a-z."""
    x = np.arange(256, dtype=np.uint64)
    x[65:91] += np.uint64(32)
    return mix(mix(x + np.uint64(BASE)))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    base, inverse = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    out_at = np.zeros(len(texts) + 1, np.int64)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
    first, last = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), out_at
    power, inverse = powers(1 << max(16, int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_codes()[raw] * power[: len(raw)], out=total[1:])
    h = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    owner = np.searchsorted(begin, first, "right") - 1
    words = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(h)) - np.repeat(np.cumsum(words) - words, words)
    count = np.repeat(words, words)
    keep = (place + width <= count) | ((count < width) & (place == 0))
    at = np.flatnonzero(keep)
    acc = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = place[at] + k < count[at]
        acc = mix(acc + np.where(inside, h[np.minimum(at + k, len(h) - 1)], np.uint64(k)))
    who = owner[at]
    order = np.argsort(acc, kind="stable")
    order = order[np.argsort(who[order].astype(np.uint16) if len(texts) < 65536 else who[order], kind="stable")]
    acc, who = acc[order], who[order]
    new = np.append(True, (acc[1:] != acc[:-1]) | (who[1:] != who[:-1]))
    acc, who = acc[new], who[new]
    np.cumsum(np.bincount(who, minlength=len(texts)), out=out_at[1:])
    return acc, out_at


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for whole in batches:
        for batch in common.slices(whole, "t", 1 << 19):
            yield batch, [x.encode("utf-8", "surrogatepass") if x else b"" for x in batch.column("t").to_pylist()]


class Rule:
    """Jaccard >= num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        """The fewest shingles that a set of n shares with a partner."""
        return -(-n * self.num // self.den)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def subsets(self, n: int) -> int:
        return sum(comb(n, d) for d in range(n - self.least(n) + 1))

    def boundary(self, histogram: dict[int, int]) -> int:
        """The largest size up to which subsets cost no more rows than lists and the sets to compare them on.

        Partners of small sets lack one shingle at most, which small_links() relies on.
        """
        best = 0
        for n in range(1, MOST_SMALL + 1):
            if n - self.least(n) > 1:
                break
            if self.subsets(n) <= self.prefix(n) + 2 * n:
                best = n
            elif histogram.get(n, 0):
                break
        return best

    def holds(self, shared, a, b):
        return self.den * shared >= self.num * (a + b - shared)


def survey(texts: DataFrame, width: int, rule: Rule, scratch: Scratch) -> tuple[dict[int, int], np.ndarray]:
    """Histogram of small set sizes, and the most frequent shingles (the least frequent first), over texts(t).

    Leads begin with the lowest hashes, so shingles of the lowest hashes are counted, all of them and in all rows.
    """
    share = min(1.0, COUNTED * (1 - rule.num / rule.den))
    below = np.uint64(int(share * float(1 << 63)) * 2 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in encoded(batches):
            acc, at = shingles(texts, width)
            sizes, m = np.unique(np.diff(at), return_counts=True)
            m, sizes = m[sizes <= MOST_SMALL], sizes[sizes <= MOST_SMALL]
            x, n = np.unique(acc[acc <= below], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.ones(len(sizes), bool), np.zeros(len(x), bool))), pa.array(np.append(sizes, x.view(np.int64))), pa.array(np.append(m, n))], ["is_size", "k", "n"])

    found = texts.mapInArrow(common.tidy(run), "is_size boolean, k long, n long").groupBy("is_size", "k").agg(F.sum("n").alias("n"))
    found = scratch.save(found.where(F.col("is_size") | (F.col("n") >= SEEN)), "survey", few=True)
    histogram = {r.k: r.n for r in found.where("is_size").collect()}
    heavy = found.where("not is_size").orderBy(F.desc("n"), "k").limit(HEAVY).select("k").toArrow()["k"].to_numpy()
    return histogram, np.ascontiguousarray(heavy[::-1]).view(np.uint64)


def sets(docs: DataFrame, width: int, rule: Rule, small: int, heavy: np.ndarray) -> DataFrame:
    """docs(i, h, t) -> (i, h, n, s, lead, subs): set size, set hash, leading shingles, subset hashes.

    Shingles are ordered by hash, those in heavy last and in its order.

    subs holds (hash, size) of the subsets of small sets; lead those of sets that may have a large partner.
    The hash of a set is the sum of its mixed shingles, so a subset's is that less what it lacks.
    """
    kind = docs.schema["i"].dataType.simpleString()
    by_hash = np.argsort(heavy, kind="stable")
    told = docs.sparkSession.sparkContext.broadcast((heavy[by_hash], by_hash.astype(np.int32)))
    lists_from = rule.least(small + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = told.value
        for batch, texts in encoded(batches):
            acc, at = shingles(texts, width)
            often, place = np.zeros(len(acc), bool), np.zeros(len(acc), np.int32)
            if len(heavy) and len(acc):
                slot = np.minimum(np.searchsorted(heavy, acc), len(heavy) - 1)
                often, place = heavy[slot] == acc, rank[slot]
            code = mix(acc + np.uint64(0x632BE59BD9B4E019))
            lead, subs, total = [], [], []
            for a, b in zip(at.tolist(), at[1:].tolist()):
                n, own = b - a, acc[a:b]
                with np.errstate(over="ignore"):
                    s = int(code[a:b].sum(dtype=np.uint64)) + n & 0xFFFFFFFFFFFFFFFF
                total.append(s)
                if n >= lists_from and n:
                    p = rule.prefix(n)
                    rare = own[~often[a:b]][:p]
                    if len(rare) < p:
                        known = often[a:b]
                        rare = np.append(rare, own[known][np.argsort(place[a:b][known])][: p - len(rare)])
                    lead.append(rare.view(np.int64))
                else:
                    lead.append(None)
                keys = []
                if 0 < n <= small:
                    codes = code[a:b].tolist()
                    for d in range(n - rule.least(n) + 1):
                        for lost in combinations(codes, d):
                            keys.append({"key": _signed(s - n - sum(lost)), "size": n - d})
                subs.append(keys or None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), batch.column("h"), pa.array(np.diff(at)), pa.array([_signed(x) for x in total], pa.int64()), pa.array(lead, pa.list_(pa.int64())), pa.array(subs, pa.list_(pa.struct([("key", pa.int64()), ("size", pa.int32())])))],
                ["i", "h", "n", "s", "lead", "subs"],
            )

    return docs.mapInArrow(common.tidy(run), f"i {kind}, h long, n long, s long, lead array<long>, subs array<struct<key:long,size:int>>")


def _signed(x: int) -> int:
    x &= 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


def whole_sets(rows: DataFrame, width: int) -> DataFrame:
    """rows(s, t) -> (s, items): all shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in encoded(batches):
            acc, at = shingles(texts, width)
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(acc.view(np.int64)))], ["s", "items"])

    return rows.mapInArrow(common.tidy(run), "s long, items array<long>")


def join(docs: DataFrame, *, width: int = 3, num: int = 90, den: int = 100, id_column: str = "doc_id", text_column: str = "text", with_hash: bool = False) -> DataFrame:
    """Link texts whose sets of `width`-word shingles have a Jaccard similarity of num / den or more.

    Words are runs of other bytes than white space (9 to 13 and 32), A-Z lowered. A text with fewer words
    has its whole sequence as one shingle; null, empty and blank texts have none and link with nothing.
    Returns id_column, n_shingles (set size), set_id (hash of the set; equal sets link), n_links (all other
    classes directly linked), component_id (smallest id reachable). Null ids have a row each, and a null component
    only if no row of it has an id; with_hash: (i, h, n, component) instead, h hashing the text; repeated ids count as one document's rows; an empty table gives an
    empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch, rule = Scratch(spark), Rule(num, den)
    base = docs.select(docs[id_column].alias("i"), F.xxhash64(docs[text_column]).alias("h"), docs[text_column].alias("t"))
    histogram, heavy = survey(base.select("t"), width, rule, scratch)
    small = rule.boundary(histogram)
    whole = scratch.save(sets(base, width, rule, small, heavy), "sets")
    rows = whole.select("i", "h", "n", "s")
    classes = scratch.save(whole.where("n > 0 and (lead is not null or subs is not null)").dropDuplicates(["s"]), "classes")

    def sent(d: DataFrame) -> DataFrame:
        """A table with a broadcast hint if it is small."""
        return F.broadcast(d) if d.count() <= BROADCAST_ROWS else d

    near = scratch.save(small_links(classes, rule), "near")

    # large sets: lists of leading shingles that two classes share
    lists = classes.where("lead is not null").select("s", "n", F.posexplode("lead").alias("pos", "tok"))
    shared = scratch.save(lists.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1"), "shared", few=True)
    lists = scratch.save(lists.join(sent(shared), "tok"), "lists")

    # pairs that meet in a short list, as often as they share a leading shingle
    one = lists.where(F.col("c") <= LONG).select("tok", "s", "n", "pos")
    two = one.toDF("tok", "b", "nb", "posb")
    met = one.join(two, "tok").where((F.col("s") < F.col("b")) & (F.greatest("n", "nb") > small) & rule.holds(F.least("n", "nb"), F.col("n"), F.col("nb")))
    # from their first common shingle on, two sets share no more than is left of either
    met = met.groupBy(F.col("s").alias("a"), "b", F.col("n").alias("na"), "nb").agg(F.count("*").alias("both"), F.max(F.least(F.col("n") - F.col("pos"), F.col("nb") - F.col("posb"))).alias("left"))
    # and those in a short list of at most one of them lie behind a lead or in a long list
    behind = lambda n: F.floor((F.col(n) * num + den - 1) / den) - 1
    in_long = lists.where(F.col("c") > LONG).groupBy("s").agg(F.count("*").alias("more"))
    met = met.join(in_long.toDF("a", "ma"), "a", "left").join(in_long.toDF("b", "mb"), "b", "left")
    more = F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0)))
    at_most = F.least(F.col("both") + more + F.greatest(behind("na"), behind("nb")), F.when(more == 0, F.col("left")).otherwise(F.col("na")), "na", "nb")
    pairs = scratch.save(met.where(rule.holds(at_most, F.col("na"), F.col("nb"))).select("a", "b", "na", "nb"), "pairs")

    # what hangs together by pairs and long lists is a family, compared in blocks
    long = lists.where(F.col("c") > LONG)
    star = long.join(long.groupBy("tok").agg(F.min("s").alias("m")), "tok").select(F.col("s").alias("a"), F.col("m").alias("b"))
    family = common.components(star.union(pairs.select("a", "b")), scratch).select(F.col("id").alias("s"), F.col("component").alias("family"))
    members = scratch.save(family.join(lists.select("s", "n").distinct(), "s").join(long.select("s", F.lit(True).alias("long")).distinct(), "s", "left"), "members")
    scratch.drop(lists)

    ends = members.select("s")
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    wanted = scratch.save(classes.select("i", "h", "s").join(ends, "s", "left_semi").select(key(F.col("i")).alias("k"), "h", "s"), "wanted", few=True)
    source = base.select(key(F.col("i")).alias("k"), "h", "t")
    items = scratch.save(whole_sets(source.join(sent(wanted), ["k", "h"]).select("s", "t"), width), "items")
    scratch.drop(classes)

    # a large family of few pairs costs less pair by pair
    cost = members.groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.max("long").alias("long"))
    many = pairs.select(F.col("a").alias("s")).join(members.select("s", "family"), "s").groupBy("family").agg(F.count("*").alias("p"))
    thin = scratch.save(cost.join(many, "family").where(F.col("long").isNull() & (2 * F.col("p") < F.col("c") * pieces())).select("family"), "thin")
    u, v = items.select(F.col("s").alias("a"), F.col("items").alias("ia")), items.select(F.col("s").alias("b"), F.col("items").alias("ib"))
    apart = pairs.join(members.join(thin, "family", "left_semi").select(F.col("s").alias("a")), "a", "left_semi")
    found = apart.join(u, "a").join(v, "b").where(rule.holds(F.size(F.array_intersect("ia", "ib")), F.col("na"), F.col("nb")))
    found = scratch.save(found.select("a", "b").distinct(), "found")
    inner = scratch.save(family_links(members.join(thin, "family", "left_anti"), items, rule, small), "inner", few=True)
    scratch.drop(items)

    edges = scratch.save(near.where("b is not null").select(F.col("s").alias("a"), "b").union(found).union(inner.where("b is not null").select("a", "b")).distinct(), "edges")
    degrees = near.select("s", "links").union(found.select(F.col("a").alias("s"), F.lit(1))).union(found.select("b", F.lit(1))).union(inner.where("b is null").select("a", "links"))
    degrees = degrees.groupBy("s").agg(F.sum("links").alias("links"))
    comp = common.components(edges, scratch).withColumnRenamed("id", "s")
    own = rows.where("n > 0").groupBy("s").agg(F.min("i").alias("least"))
    with_comp = own.join(comp, "s", "left").withColumn("component", F.coalesce("component", "s"))
    least = with_comp.groupBy("component").agg(F.min("least").alias("component_id"))
    told = scratch.save(with_comp.join(least, "component").join(degrees, "s", "left").select("s", "component", "component_id", F.coalesce("links", F.lit(0)).alias("n_links")), "told")
    out = rows.select("i", "h", "n", F.when(F.col("n") > 0, F.col("s")).alias("s")).join(told, "s", "left")
    if with_hash:
        return out.select("i", "h", "n", F.coalesce("component", "s").alias("component"))
    return out.select(F.col("i").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "i").alias("component_id"), F.col("s").alias("set_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def small_links(classes: DataFrame, rule: Rule) -> DataFrame:
    """Links between small sets: (s, links, b), how many s has below one subset, and b to span them (or null).

    As a small set lacks at most one shingle of a subset, two of them share one subset large enough if they
    link, and only one: their intersection. So counting the set sizes below each subset counts each link once.
    """
    subset = classes.where("subs is not null").select("s", "n", F.explode("subs").alias("x")).select("s", "n", "x.key", "x.size")
    groups = subset.groupBy("key", "size").agg(F.min(F.struct("n", "s")).alias("m"), F.count("*").alias("c"), F.count(F.when(F.col("n") == F.col("size"), 1)).alias("same")).where("c > 1")
    near = subset.join(groups, ["key", "size"])
    plain, larger = F.col("n") == F.col("size"), F.col("size") + 1
    with_plain = F.when(rule.holds(F.col("size"), F.col("size"), larger), F.when(plain, F.col("c") - F.col("same")).otherwise(F.col("same"))).otherwise(0)
    with_larger = F.when(~plain & rule.holds(F.col("size"), larger, larger), F.col("c") - F.col("same") - 1).otherwise(0)
    to = F.when((F.col("s") != F.col("m.s")) & rule.holds(F.col("size"), F.col("n"), F.col("m.n")), F.col("m.s"))
    return near.select("s", (with_plain + with_larger).cast("long").alias("links"), to.alias("b")).where("links > 0 or b is not null")


def pieces():
    """Pieces of a group of c classes with w shingles."""
    return F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("w") / BLOCK_ITEMS)).cast("int")


def shared_counts(items: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share: rare shingles by their few pairs, the others by matrix products."""
    g = len(items)
    owner = np.repeat(np.arange(g), [len(x) for x in items])
    flat = np.concatenate([*items, np.zeros(0, np.int64)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    often = np.diff(np.append(first, len(flat)))
    out, keys, held = np.zeros(g * g, np.int64), [], 0
    begin, size = np.repeat(first, often), np.repeat(often, often)
    at = np.flatnonzero((size > 1) & (size <= RARE))
    for step in range(1, RARE):  # owners that lie `step` apart in the list of a shingle
        at = at[at + step < begin[at] + size[at]]
        keys.append(owner[at] * g + owner[at + step])
        held += len(at)
        if held > 1 << 21 or not len(at) or step == RARE - 1:
            out += np.bincount(np.concatenate(keys), minlength=g * g)
            keys, held = [], 0
        if not len(at):
            break
    out = out.reshape(g, g).astype(np.float32)
    column = np.cumsum(often > RARE) - 1
    at = np.flatnonzero(size > RARE)
    column, owner = np.repeat(column, often)[at], owner[at]
    for k in range(0, int(column[-1]) + 1 if len(at) else 0, 1024):
        a, b = np.searchsorted(column, [k, k + 1024])
        x = np.zeros((g, 1024), np.float32)
        x[owner[a:b], column[a:b] - k] = 1
        out += np.triu(x @ x.T, 1)
    return out + out.T


def family_links(members: DataFrame, items: DataFrame, rule: Rule, small: int) -> DataFrame:
    """All links within families: rows (a, links) with how many each class has in a block, and (a, b) of a forest.

    members(s, family, n), items(s, items). Only sets of like size can link, so a family is cut into bands of
    sizes, each band into pieces of bounded rows and shingles, and each two pieces of one band or of neighbours
    meet in one block. Blocks return counts and a forest, no pairs. Links of two small sets are left out.
    """
    cost = (F.count("*").alias("c"), F.sum("n").alias("w"))
    whole = members.groupBy("family").agg(*cost).select("family", (pieces() == 1).alias("one"))
    width = float(np.log(rule.den / rule.num)) * 1.001
    banded = members.join(whole, "family").select("s", "n", "family", F.when(F.col("one"), 0).otherwise(F.floor(F.log("n") / width)).cast("int").alias("band"))
    sizes = banded.groupBy("family", "band").agg(*cost).select("family", "band", pieces().alias("own"))
    above = sizes.select("family", (F.col("band") - 1).alias("band"), F.col("own").alias("over"))
    below = sizes.select("family", (F.col("band") + 1).alias("band"), F.col("own").alias("under"))
    placed = banded.join(sizes, ["family", "band"]).join(above, ["family", "band"], "left").join(below, ["family", "band"], "left")
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("s"), F.col("own")).cast("int"))

    def blocks(n: str, band, x, y, kind: int, side):
        each = F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(0)) - 1)
        return F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.transform(each, lambda j: F.struct(band.alias("at"), F.lit(kind).alias("kind"), x(j).alias("x"), y(j).alias("y"), side(j).alias("side")))).otherwise(F.array())

    piece, band, no = F.col("piece"), F.col("band"), F.lit(0)
    where = F.concat(
        blocks("own", band, lambda j: F.least(piece, j), lambda j: F.greatest(piece, j), 0, lambda j: (piece > j).cast("int")),
        blocks("over", band, lambda j: piece, lambda j: j, 1, lambda j: no),
        blocks("under", band - 1, lambda j: j, lambda j: piece, 1, lambda j: no + 1),
    )
    dealt = placed.select("s", "n", "family", F.explode(where).alias("b")).select("s", "n", "family", "b.*").join(items, "s")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("s")
        s, n, side = group.s.to_numpy(), group.n.to_numpy(), group.side.to_numpy()
        alone = group.kind.iloc[0] == 0 and group.x.iloc[0] == group.y.iloc[0]
        shared = shared_counts([np.asarray(x, np.int64) for x in group["items"]])
        ok = rule.holds(shared, n[:, None], n[None, :]) & (np.maximum(n[:, None], n[None, :]) > small)
        ok &= ~np.eye(len(s), dtype=bool) if alone else side[:, None] != side[None, :]
        links, root = ok.sum(1), np.arange(len(s))
        a, b = np.nonzero(ok)
        while len(a):  # smallest label of each neighbourhood until nothing changes
            new = root.copy()
            np.minimum.at(new, a, root[b])
            new = new[new]
            if (new == root).all():
                break
            root = new
        some, tree = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(s)))
        out = pd.DataFrame({"a": np.concatenate([s[some], s[tree]]), "b": pd.array([*[None] * len(some), *s[root[tree]].tolist()], dtype="Int64"), "links": np.concatenate([links[some], np.zeros(len(tree), np.int64)])})
        if len(s) > BLOCK_ROWS // 2 or int(n.sum()) > BLOCK_ITEMS // 2:
            common.release()
        return out

    return dealt.groupBy("family", "at", "kind", "x", "y").applyInPandas(compare, "a long, b long, links long")


def one_of_each(docs: DataFrame, *, width: int = 3, num: int = 90, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs without near duplicates, with all their columns: of each component the row of smallest id stays.

    Rows that link with nothing stay, also those without words. Of rows with equal id and text in a component
    one stays.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(join(docs, width=width, num=num, den=den, id_column=id_column, text_column=text_column, with_hash=True), "found")
    words = found.where("n > 0")
    stays = words.groupBy("component").agg(F.min(F.struct("i", "h")).alias("x")).select("x.i", "x.h")
    stays = stays.union(found.where("n = 0").select("i", "h").distinct())
    again = words.groupBy("i", "h").count().where("count > 1").join(stays, ["i", "h"], "left_semi").limit(1).count() > 0
    ik = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    keys = stays.select(ik(F.col("i")).alias("k"), "h").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), ik(docs[id_column]).alias("k"), F.xxhash64(docs[text_column]).alias("h"), F.xxhash64(F.struct(*docs.columns)).alias("o"))
    kept = rows.join(keys, ["k", "h"], "left_semi")
    if again:
        blank = kept.join(found.where("n = 0").select(ik(F.col("i")).alias("k"), "h").distinct(), ["k", "h"], "left_semi")
        kept = kept.join(blank.select("k", "h").distinct(), ["k", "h"], "left_anti").dropDuplicates(["k", "h"]).union(blank)
    return kept.select("doc.*")
