"""Near-duplicate vectors by robust-pruned flat graphs on overlapping cluster shards.

Distinct vectors are dealt to their two nearest centroids. Each shard builds a navigable graph by greedy
search and robust pruning, in growing batches; the shards' adjacency lists are united. Every vector is then
searched for in the shard of its nearest centroid, greedily from the medoid, and the search widens along
the graph as long as it stays within the range. What it finds is checked in double precision.

A shard above PIECE vectors is split into pieces at random; each two pieces are searched against each other,
so that a dense group costs no link. Pairs within a shard are only counted, and passed on as a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm import common
from seqspark.llm.common import Scratch

#: Vectors that centroids are fitted on at most (lowest hashes), and centroids at most.
SAMPLE, MOST_CENTROIDS = 20_000, 2_000
#: Vectors per centroid aimed at, and the most in a piece of a shard.
HOME, PIECE = 500, 1_500
DEGREE, BEAM, ALPHA, SLACK = 24, 40, 1.2, 0.02
# kinds of rows that a search gives: links of a vector, an edge of the forest, a pair across shards
COUNT, TREE, PAIR = 0, 1, 2


def unit(v: np.ndarray) -> np.ndarray:
    """Rows over their norm, scaled first so that large and small numbers keep their direction."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Robust pruning: of each row's candidates (-1: none) up to DEGREE that no kept, nearer one covers."""
    rows, width = candidates.shape
    far = np.where(candidates < 0, np.inf, 2 - 2 * np.einsum("bcd,bd->bc", x[candidates], x[own]))
    far[candidates == own[:, None]] = np.inf
    order = np.argsort(far, 1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    again = np.zeros(candidates.shape, bool)  # repeated candidates lie side by side or at equal distance
    again[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    alive = np.isfinite(far) & ~again
    vectors = x[candidates]
    out = np.full((rows, DEGREE), -1, np.int64)
    r = np.arange(rows)
    for k in range(DEGREE):
        j = alive.argmax(1)
        some = alive[r, j]
        if not some.any():
            break
        out[some, k] = candidates[r[some], j[some]]
        covered = ALPHA * (2 - 2 * np.einsum("bcd,bd->bc", vectors, vectors[r, j])) <= far
        alive &= ~(covered & some[:, None])
        alive[r, j] = False
    return out


def greedy(x: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once: (nodes, similarities) of each, the nearest first, -1 for none."""
    q, r = len(queries), np.arange(len(queries))
    seen = np.zeros((q, len(x)), bool)
    nodes, sims, open_ = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf, np.float32), np.zeros((q, beam), bool)
    nodes[:, 0], sims[:, 0], open_[:, 0] = start, queries @ x[start], True
    seen[:, start] = True
    live = r
    while len(live):
        best = np.where(open_[live], sims[live], -np.inf).argmax(1)
        live, best = live[ok := open_[live, best]], best[ok]
        if not len(live):
            break
        open_[live, best] = False
        near = links[nodes[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        a, b = np.nonzero(fresh)
        seen[live[a], near[a, b]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[a, b] = np.einsum("ij,ij->i", x[near[a, b]], queries[live[a]])
        every, scores = np.concatenate([nodes[live], np.where(fresh, near, -1)], 1), np.concatenate([sims[live], s], 1)
        undone = np.concatenate([open_[live], fresh], 1)
        top = np.argsort(-scores, 1, kind="stable")[:, :beam]
        nodes[live], sims[live], open_[live] = np.take_along_axis(every, top, 1), np.take_along_axis(scores, top, 1), np.take_along_axis(undone, top, 1)
    return nodes, sims


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build(x: np.ndarray) -> np.ndarray:
    """Links [n, DEGREE] of a graph over unit rows, from batches that double."""
    n = len(x)
    links = np.full((n, DEGREE), -1, np.int64)
    start = medoid(x)
    order = np.append(start, np.delete(np.arange(n), start))
    done = 1
    while done < n:
        new = order[done : done + max(1, min(done, 1024))]
        found, _ = greedy(x, links, start, x[new])
        # members of one batch may be each other's neighbours
        inside = x[new] @ x[new].T
        np.fill_diagonal(inside, -2)
        peers = new[np.argsort(-inside, 1)[:, : min(len(new), 16)]] if len(new) > 1 else np.full((1, 1), -1)
        links[new] = prune(x, new, np.concatenate([found, peers], 1))
        a, b = np.nonzero(links[new] >= 0)
        to, source = links[new][a, b], new[a]
        by = np.lexsort((-np.einsum("ij,ij->i", x[to], x[source]), to))
        to, source = to[by], source[by]
        head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        size = np.diff(np.append(head, len(to)))
        back = np.full((len(head), min(int(size.max()), 4 * DEGREE)), -1, np.int64)
        place = np.arange(len(to)) - np.repeat(head, size)
        fits = place < back.shape[1]
        back[np.repeat(np.arange(len(head)), size)[fits], place[fits]] = source[fits]
        nodes = to[head]
        links[nodes] = prune(x, nodes, np.concatenate([links[nodes], back], 1))
        done += len(new)
    return links


def in_range(x: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of similarity `least` or more: greedy search, widened along the graph while in range."""
    wide = np.float32(least - SLACK)
    nodes, sims = greedy(x, links, start, queries)
    seen = np.zeros((len(queries), len(x)), bool)
    a, b = np.nonzero((nodes >= 0) & (sims >= wide))
    who, node = a, nodes[a, b]
    seen[who, node] = True
    found = [(who, node)]
    while len(who):
        near = links[node]
        w, v = np.repeat(who, near.shape[1]), near.reshape(-1)
        ok = v >= 0
        w, v = w[ok], v[ok]
        ok = ~seen[w, v]
        w, v = w[ok], v[ok]
        if not len(w):
            break
        key = np.unique(w * len(x) + v)
        w, v = key // len(x), key % len(x)
        seen[w, v] = True
        ok = np.concatenate([np.einsum("ij,ij->i", x[v[k : k + 65536]], queries[w[k : k + 65536]]) >= wide for k in range(0, len(w), 65536)])
        who, node = w[ok], v[ok]
        found.append((who, node))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), np.float64)


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(i, v, c): v null where the vector can't be compared; c the class of equal vectors."""
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[id_column].alias("i"), vectors[vector_column].cast("array<double>").alias("v"))
    return rows.withColumn("v", F.when(F.coalesce(good, F.lit(False)), v)).withColumn("c", F.when(v.isNotNull(), F.xxhash64("v")))


def near_dups(vectors: DataFrame, *, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Link vectors of cosine `threshold` or more: id_column, n_links, component_id, kept.

    n_links counts other rows linked directly, equal vectors included; component_id is the smallest id
    reachable, itself included; kept says whether it is the row's own. Null, empty and zero vectors, and those
    with null or non-finite components, link with nothing; vectors of different lengths don't link. A null id
    counts as a row that others may link to, and its component is null if no row of it has an id.
    Repeated rows each give a row; an empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(clean(vectors, id_column, vector_column), "rows")
    classes = scratch.save(rows.where("v is not null").groupBy("c").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("i").alias("least")), "classes")
    n = classes.count()

    sample = classes.orderBy("c").limit(SAMPLE).select("v").toPandas().v
    middle: dict[int, np.ndarray] = {}
    for size in sorted({len(x) for x in sample}):
        x = unit(matrix(pd.Series([v for v in sample if len(v) == size])))
        share = len(x) / max(1, len(sample))
        middle[size] = centroids(x, int(max(1, min(len(x), MOST_CENTROIDS, np.ceil(n * share / HOME)))))
    told = spark.sparkContext.broadcast(middle)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector in the shards of its two nearest centroids; home marks the nearer."""
        for b in batches:
            out = []
            for size, group in b.groupby(b.v.map(len)):
                x = unit(matrix(group.v))
                c = told.value.get(size)
                s = x @ c.T if c is not None else np.zeros((len(x), 1))
                two = np.argsort(-s, 1, kind="stable")[:, :2]
                for k in range(two.shape[1]):
                    out.append(pd.DataFrame({"c": group.c, "copies": group.copies, "u": list(x), "shard": size * (MOST_CENTROIDS + 1) + two[:, k], "home": k == 0}))
            yield pd.concat(out) if out else pd.DataFrame({"c": [], "copies": [], "u": [], "shard": [], "home": []})

    dealt = scratch.save(classes.select("c", "copies", "v").mapInPandas(assign, "c long, copies long, u array<double>, shard long, home boolean"), "dealt")
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    placed = scratch.save(dealt.join(F.broadcast(sizes.where("pieces > 1")), "shard", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", F.pmod(F.hash("c"), F.col("pieces"))), "placed")

    def graph(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c")
        ids = group.c.to_numpy()
        links = build(matrix(group.u).astype(np.float32))
        return pd.DataFrame({"c": ids, "near": [ids[x[x >= 0]] for x in links]})

    lists = placed.select("shard", "piece", "c", "u").groupBy("shard", "piece").applyInPandas(graph, "c long, near array<long>")
    united = scratch.save(lists.groupBy("c").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c")
        x64 = matrix(group.u)
        x, ids, home, copies = x64.astype(np.float32), group.c.to_numpy(), group.home.to_numpy(), group.copies.to_numpy()
        piece = group.piece.to_numpy()
        at = {c: k for k, c in enumerate(ids.tolist())}
        first, last = piece.min(), piece.max()
        if group.first_piece.iloc[0] != group.last_piece.iloc[0] and first == last:
            return pd.DataFrame({"kind": [], "a": [], "b": [], "n": []})
        found = []
        for part, asks in {(first, last), (last, first)}:
            members, queries = np.flatnonzero(piece == part), np.flatnonzero((piece == asks) & home)
            if not len(queries):
                continue
            place = np.full(len(ids), -1)
            place[members] = np.arange(len(members))
            near = [[place[k] for v in row if (k := at.get(v)) is not None and place[k] >= 0] for row in group.near.iloc[members]]
            links = np.full((len(members), max(1, max(map(len, near)))), -1, np.int64)
            for k, row in enumerate(near):
                links[k, : len(row)] = row
            own = x[members]
            for k in range(0, len(queries), 512):
                part_q = queries[k : k + 512]
                w, v = in_range(own, links, medoid(own), x[part_q], threshold)
                found.append(np.stack([part_q[w], members[v]], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        pairs = np.unique(np.sort(pairs, 1), axis=0)
        ok = [np.einsum("ij,ij->i", x64[pairs[k : k + 65536, 0]], x64[pairs[k : k + 65536, 1]]) >= threshold for k in range(0, len(pairs), 65536)]
        pairs = pairs[np.concatenate(ok)] if ok else pairs
        local = home[pairs].all(1)
        inner, cross = pairs[local], pairs[~local]
        n = np.bincount(inner[:, 0], copies[inner[:, 1]], len(ids)) + np.bincount(inner[:, 1], copies[inner[:, 0]], len(ids))
        root = np.arange(len(ids))
        while len(inner):  # smallest label of each neighbourhood until nothing changes
            low = np.minimum(root[inner[:, 0]], root[inner[:, 1]])
            new = root.copy()
            np.minimum.at(new, inner[:, 0], low)
            np.minimum.at(new, inner[:, 1], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(n)
        tree = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame(
            {
                "kind": np.repeat([COUNT, TREE, PAIR], [len(some), len(tree), len(cross)]),
                "a": np.concatenate([ids[some], ids[tree], ids[cross[:, 0]]]),
                "b": np.concatenate([ids[some], ids[root[tree]], ids[cross[:, 1]]]),
                "n": np.concatenate([n[some].astype(np.int64), np.zeros(len(tree) + len(cross), np.int64)]),
            }
        )

    # each two pieces of a shard meet once
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    met = placed.select("*", other).join(united, "c").withColumns({"first_piece": F.least("piece", "other"), "last_piece": F.greatest("piece", "other")})
    found = scratch.save(met.select("shard", "first_piece", "last_piece", "c", "copies", "u", "home", "piece", "near").groupBy("shard", "first_piece", "last_piece").applyInPandas(search, "kind long, a long, b long, n long"), "found")

    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    cross = scratch.save(found.where(f"kind = {PAIR}").select(low, high).distinct(), "cross")
    both = cross.union(cross.select("b", "a")).toDF("c", "o").join(classes.select(F.col("c").alias("o"), "copies"), "o")
    counts = found.where(f"kind = {COUNT}").select(F.col("a").alias("c"), "n").union(both.select("c", "copies")).groupBy("c").agg(F.sum("n").alias("n"))
    comp = common.components(found.where(f"kind = {TREE}").select("a", "b").union(cross), scratch).withColumnRenamed("id", "c")
    known = classes.select("c", "copies", "least").join(comp, "c", "left").join(counts, "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = scratch.save(known.join(least, "component").select("c", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "known")
    out = rows.select("i", "c").join(known, "c", "left")
    component = F.coalesce("component_id", "i")
    return out.select(F.col("i").alias(id_column), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("i") == component, F.lit(False)).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, *, threshold: float = 0.95, every: int = 100, block: int = 2_000, id_column: str = "vec_id", vector_column: str = "embedding") -> float:
    """Share of the true links of the rows whose id is divisible by `every` that result counts.

    The queries are compared with all rows in blocks of `block`, one block at a time on the driver's side.
    """
    rows = clean(vectors, id_column, vector_column).where("v is not null")
    asked = rows.where(F.col("i") % every == 0).select("i").orderBy("i")
    spark, true, got = vectors.sparkSession, 0, 0
    total = asked.count()
    ids = asked.withColumn("k", F.expr("row_number() over (order by i) - 1"))
    for k in range(0, total, block):
        part = rows.join(F.broadcast(ids.where(F.col("k").between(k, k + block - 1)).select("i")), "i").select("i", "v").toPandas()
        told = spark.sparkContext.broadcast([(n, g.i.to_numpy(), unit(matrix(g.v))) for n, g in part.groupby(part.v.map(len))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for n, mine, q in told.value:
                    same = b[b.v.map(len) == n]
                    if len(same):
                        hit = (q @ unit(matrix(same.v)).T >= threshold) & (mine[:, None] != same.i.to_numpy()[None, :])
                        yield pd.DataFrame({"i": mine, "n": hit.sum(1)})

        exact = rows.mapInPandas(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
        r = exact.join(result.select(F.col(id_column).alias("i"), "n_links"), "i").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
        true, got = true + (r[0] or 0), got + (r[1] or 0)
    return got / true if true else 1.0
