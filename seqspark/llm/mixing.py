"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS_BITS = 12


def cyclic_weights(names: Sequence[str | None], cycle: Sequence[float] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights by code point order, null last, repeating the cycle."""
    ordered = sorted(x for x in names if x is not None) + [None] * (None in names)
    return {x: cycle[k % len(cycle)] for k, x in enumerate(ordered)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], cap: int) -> dict[str | None, float]:
    """Shares of all sizes by weight, none above cap times its source's size; excess is shared anew."""
    out: dict[str | None, float] = {}
    open_, left = {x for x in sizes if weights.get(x, 0) > 0}, float(sum(sizes.values()))
    out |= {x: 0.0 for x in sizes if x not in open_}
    while open_:
        total = sum(weights[x] for x in open_)
        over = {x for x in open_ if left * weights[x] / total > cap * sizes[x]}
        if not over:
            return out | {x: left * weights[x] / total for x in open_}
        out |= {x: float(cap * sizes[x]) for x in over}
        left -= sum(cap * sizes[x] for x in over)
        open_ -= over
    return out


def route(capacity: dict[tuple, int], quota: dict[str | None, int], cap: int) -> dict[tuple[tuple, str | None], int]:
    """Words each pattern gives each of its sources: a flow of most quota at least cost.

    A source that overlaps with no other gives its quota as far as its passes go. The others are routed by
    groups of sources that patterns connect.
    """
    parent = {s: s for p in capacity for s in p}

    def root(s: str | None) -> str | None:
        while parent[s] != s:
            parent[s] = s = parent[parent[s]]
        return s

    for p in capacity:
        for s in p[1:]:
            parent[root(s)] = root(p[0])
    groups: dict[str | None, list[tuple]] = {}
    for p in capacity:
        if p:
            groups.setdefault(root(p[0]), []).append(p)
    flow = {}
    for group in groups.values():
        if len(group) == 1 and len(group[0]) == 1:
            p = group[0]
            if quota.get(p[0], 0) > 0:
                flow[p, p[0]] = min(quota[p[0]], cap * capacity[p])
        else:
            flow |= route_group({p: capacity[p] for p in group}, {s: quota[s] for s in {s for p in group for s in p} if s in quota}, cap)
    return flow


def route_group(capacity: dict[tuple, int], quota: dict[str | None, int], cap: int) -> dict[tuple[tuple, str | None], int]:
    """The flow of one group of sources that overlap.

    A pattern's first pass over its documents costs 0 a word, the second 1, the third 2 and so on (convex),
    so repeats are spread evenly. Successive shortest paths by Bellman-Ford; the graph has a node for each
    pattern and each source.
    """
    patterns, names = sorted(capacity, key=repr), sorted(quota, key=repr)
    node = {("p", p): 1 + k for k, p in enumerate(patterns)} | {("s", s): 1 + len(patterns) + k for k, s in enumerate(names)}
    sink = 1 + len(node)
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, most: int, price: int) -> int:
        for x, y, m, c in ((a, b, most, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(m)
            cost.append(c)
        return len(to) - 2

    given = {}
    for p in patterns:
        for k in range(cap):
            arc(0, node["p", p], capacity[p], k)
        for s in p:
            if quota.get(s, 0) > 0:
                given[p, s] = arc(node["p", p], node["s", s], cap * capacity[p], 0)
    for s in names:
        arc(node["s", s], sink, quota[s], 0)
    while True:
        far, by, queue = [float("inf")] * (sink + 1), [-1] * (sink + 1), deque([0])
        far[0] = 0
        waiting = {0}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in out[a]:
                if room[e] > 0 and far[a] + cost[e] < far[to[e]]:
                    far[to[e]], by[to[e]] = far[a] + cost[e], e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if by[sink] < 0:
            return {k: room[e ^ 1] for k, e in given.items()}
        path, b = [], sink
        while b:
            path.append(by[b])
            b = to[by[b] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most


@dataclass
class Mix:
    """rows: the sized rows (id, members, size, key); plan: one row per pattern, with how it is taken."""

    rows: DataFrame
    plan: DataFrame
    sizes: dict[str | None, int]
    targets: dict[str | None, float]


def sort_key(seed: int, *columns: Column) -> Column:
    """The seeded order of documents."""
    return F.xxhash64(F.lit(seed), *columns)


def times(plan: Callable[[str], Column], key: Column, size: Column) -> Column:
    """How often a row is taken: whole passes, and once more if the plan of its pattern says so."""
    more = (key <= plan("last")) | ((size > 0) & (size <= plan("limit")) & (key <= plan("small_last"))) | (key == plan("filler"))
    return plan("passes") + F.coalesce(more, F.lit(False)).cast("long")


def sized(docs: DataFrame, kept: Column, seed: int = 7) -> DataFrame:
    """(kept, members in order, size, key) of each row of docs(id, members, text)."""
    members = F.array_sort(F.array_distinct(F.coalesce("members", F.array(F.lit(None).cast("string")))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(kept, members.alias("members"), size.alias("size"), sort_key(seed, F.col("id"), F.col("text")).alias("key"))


def from_rows(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    """A table of the driver's rows, by way of Arrow: a list of rows would start Python workers on every executor."""
    return spark.createDataFrame(pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds.values())], list(kinds)))


def plan_mix(docs: DataFrame, scratch: Scratch, *, weights: Callable[[Sequence[str | None]], dict] | None = None, cap: int = 3, seed: int = 7) -> Mix:
    """Plan the mix of docs (id, members array<string>, text): see mixed().

    Selection is by a seeded key per row, so it needs no memory of rows: of each pattern, all rows are taken
    `passes` times and rows up to the key `last` once more. What is missing up to the row that does not fit
    any more is filled by further rows of at most `limit` words up to the key small_last, and by one row whose
    size comes closest to the gap. Keys are found in the one of 4,096 key ranges where the running size
    crosses the rest.
    Rows with equal id and text share a key and are taken alike.
    """
    spark = docs.sparkSession
    rows = scratch.save(sized(docs, F.col("id"), seed), "mix", few=True)
    grouped = rows.groupBy("members").agg(F.sum("size").alias("size")).collect()
    capacity = {tuple(r.members): r["size"] for r in grouped}
    sizes: dict[str | None, int] = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    total = sum(capacity.values())
    wanted = targets(sizes, (weights or cyclic_weights)(list(sizes)), cap)
    # overlapping sources count a document in each of them; the mix itself has as many words as the documents
    scale = total / max(1, sum(sizes.values()))
    flow = route(capacity, {s: round(t * scale) for s, t in wanted.items()}, cap)
    take = {p: sum(flow.get((p, s), 0) for s in p) for p in capacity}
    parts = [(list(p), *(divmod(take[p], n) if n else (0, 0))) for p, n in capacity.items()]
    goal = from_rows(spark, parts or [([None], 0, 0)], {"members": pa.list_(pa.string()), "passes": pa.int64(), "rest": pa.int64()})

    def cut(eligible: DataFrame) -> DataFrame:
        """Of rows (members, key, size, rest): the last key whose running size is within the rest, and the gap that is left."""
        bucket = F.shiftright(F.col("key"), 64 - BUCKETS_BITS)
        by_bucket = eligible.groupBy("members", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        by_bucket = by_bucket.withColumn("upto", F.expr("sum(size) over (partition by members order by bucket rows unbounded preceding)"))
        by_bucket = scratch.save(by_bucket.withColumn("before", F.col("upto") - F.col("size")).drop("size"), "buckets")
        crossing = by_bucket.where("upto > rest and before <= rest").select("members", "bucket", "before")
        inside = eligible.withColumn("bucket", bucket).join(F.broadcast(crossing), ["members", "bucket"]).groupBy("members", "rest", "before", "key").agg(F.sum("size").alias("size"))
        inside = inside.withColumn("upto", F.col("before") + F.expr("sum(size) over (partition by members order by key rows unbounded preceding)"))
        edge = inside.groupBy("members", "rest").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("key", "upto"))).alias("in"), F.min(F.struct("key", "before")).alias("first"))
        # no row of the range fits: the last key is just below the range's first
        found = edge.select("members", F.coalesce("in.key", F.col("first.key") - 1).alias("last"), (F.col("rest") - F.coalesce("in.upto", "first.before")).alias("gap"))
        short = by_bucket.groupBy("members", "rest").agg(F.max("upto").alias("upto")).where("upto <= rest")
        return scratch.save(found.union(short.select("members", F.lit((1 << 63) - 1), F.col("rest") - F.col("upto"))), "cut")

    aimed = rows.join(F.broadcast(goal), members_equal(rows, goal)).drop(goal.members).where("rest > 0")
    one = cut(aimed.select("members", "key", "size", "rest"))
    size, gap = F.col("size"), F.col("gap")
    small = rows.join(F.broadcast(one), "members").where((F.col("key") > F.col("last")) & (size > 0) & (size * 16 <= gap))
    two = cut(small.select("members", "key", "size", gap.alias("rest")))
    both = one.join(two.select("members", F.col("last").alias("small_last"), F.col("gap").alias("gap2")), "members", "left")
    both = scratch.save(both.select("members", "last", F.when(F.col("small_last").isNotNull(), gap / 16).alias("limit"), "small_last", F.coalesce("gap2", "gap").alias("gap")), "both")
    free = (F.col("key") > F.col("last")) & ~F.coalesce((size <= F.col("limit")) & (F.col("key") <= F.col("small_last")), F.lit(False))
    filler = (
        rows.join(F.broadcast(both), "members")
        .where(free & (size > 0) & (F.abs(size - gap) < gap))
        .groupBy("members")
        .agg(F.min(F.struct(F.abs(size - gap).alias("off"), F.col("key"))).alias("f"))
        .select("members", F.col("f.key").alias("filler"))
    )
    # where the rest is 0 nothing more is taken
    plan = goal.join(both.drop("gap"), "members", "left").join(filler, "members", "left")
    return Mix(rows, scratch.save(plan.select("members", "passes", "last", "limit", "small_last", "filler"), "plan"), sizes, wanted)


def members_equal(a: DataFrame, b: DataFrame) -> Column:
    return a.members.eqNullSafe(b.members)


def mixed(docs: DataFrame, scratch: Scratch, *, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", weights: Callable[[Sequence[str | None]], dict] | None = None, cap: int = 3, seed: int = 7) -> DataFrame:
    """How much of each document a mix to target weights takes.

    source_column holds one source (string) or several (array<string>); a null source is a source of its
    own. A document's size is its number of words (0 for a null or blank text); sources share the sum of all
    sizes by weight, none above cap times its own size. Returns id, size, source_size and target (of the
    first source), times and taken (times x size, whole documents, repeats counted; times <= cap). Each row
    of docs gives a row, null and repeated ids included; equal rows are taken alike; an empty table gives an
    empty one; other columns are ignored. Reruns with the same seed agree.
    """
    kind = docs.schema[source_column].dataType.typeName()
    members = docs[source_column] if kind == "array" else F.array(docs[source_column].cast("string"))
    named = docs.select(docs[id_column].alias("id"), members.alias("members"), docs[text_column].alias("text"))
    mix = plan_mix(named, scratch, weights=weights, cap=cap, seed=seed)
    spark = docs.sparkSession
    told = from_rows(spark, [(s, mix.sizes[s], mix.targets[s]) for s in mix.sizes] or [(None, 0, 0.0)], {"source": pa.string(), "source_size": pa.int64(), "target": pa.float64()})
    rows, plan = mix.rows.alias("r"), mix.plan.alias("p")
    out = rows.join(F.broadcast(plan), F.col("r.members").eqNullSafe(F.col("p.members")), "left")
    out = out.join(F.broadcast(told), F.element_at("r.members", 1).eqNullSafe(F.col("source")), "left")
    n = times(F.col, F.col("key"), F.col("size"))
    return out.select(F.col("id").alias(id_column), "size", "source_size", "target", n.alias("times"), (n * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, scratch: Scratch, *, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", weights: Callable[[Sequence[str | None]], dict] | None = None, cap: int = 3, seed: int = 7) -> DataFrame:
    """The rows of docs as often as mixed() takes them, with all their columns."""
    members = F.array(docs[source_column].cast("string")) if docs.schema[source_column].dataType.typeName() != "array" else docs[source_column]
    named = docs.select(F.struct(*docs.columns).alias("doc"), docs[id_column].alias("id"), members.alias("members"), docs[text_column].alias("text"))
    plan = plan_mix(named.select("id", "members", "text"), scratch, weights=weights, cap=cap, seed=seed).plan.withColumnRenamed("members", "pattern")
    out = sized(named, F.col("doc"), seed).join(F.broadcast(plan), F.col("members").eqNullSafe(F.col("pattern")), "left")
    n = F.coalesce(times(F.col, F.col("key"), F.col("size")), F.lit(0))
    return out.where(n > 0).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("copy")).select("doc.*")
