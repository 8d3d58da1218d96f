"""Trie of conversation prefixes.

A turn becomes a digest, and a conversation the chain of its turns' digests, so that equal prefixes have
equal chained digests. Every prefix is a row; grouped by depth and digest they are the nodes. Sums over
subtrees come from nodes exploded to their ancestors. As a chain of n nodes has n * n / 2 ancestors, this is
done in blocks of BLOCK levels: a node goes to the ancestors in its block, the roots of blocks go to
each other in the same way one level up, and a whole root's sum goes to the block above it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm import common
from seqspark.llm.common import Scratch

BLOCK = 16
ROOT = hashlib.sha256(b"").digest()
#: Bytes of ids that are joined before they are hashed.
CHUNK = 32 << 10
#: A head of another conversation has fewer turns than this.
HEADS = 9


def turn_rows(turns: DataFrame) -> DataFrame:
    """(family, other, conv, turn, role, digest, bytes) of turns; a family is conversations with one base, which comes first."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    family = F.col("conv_id") - F.col("conv_id") % 5
    return turns.where("conv_id is not null").select(family.alias("family"), (F.col("conv_id") != family).alias("other"), F.col("conv_id").alias("conv"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def head_length(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % HEADS


class Chain:
    """Chained digests of one conversation, with those of its ancestors by level of blocks."""

    def __init__(self, conv: int, block: int):
        self.block, self.conv, self.depth, self.digest, self.size, self.above = block, conv, 0, ROOT, 0, [[]]
        self.ups: list[bytes] = []

    def row(self, last: bool) -> tuple:
        return self.conv, self.depth, self.digest, self.size, self.ups, last

    def add(self, digest: bytes, size: int) -> None:
        for j, level in enumerate(self.above):  # the last node joins the levels that it is on
            at, off = divmod(self.depth, self.block**j)
            if off:
                break
            if at % self.block == 0:
                level.clear()
            level.append(self.digest)
        self.depth, self.size = self.depth + 1, size
        self.digest = hashlib.sha256(self.digest + digest).digest()
        while self.block ** len(self.above) <= self.depth:
            self.above.append([ROOT])
        self.ups = [b"".join(level) for j, level in enumerate(self.above) if self.depth % self.block**j == 0]


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, depth, digest, bytes, ups, last) of every prefix of the rebuilt conversations, the empty one included.

    ups[j] holds the digests of ancestors on level j (depths that block^j divides) back to and including the last
    root of a block above. Rows stream by; a task holds the first turns of one base and one chain's open blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "depth", "digest", "bytes", "ups", "last"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.bool_()]
        out: list[tuple] = []
        heads: list[tuple] = []
        family, chain, own, skip = None, None, 0, 0

        for batch in batches:
            for f, other, conv, digest, size in zip(*(batch.column(k).to_pylist() for k in ("family", "other", "conv", "digest", "bytes"))):
                if chain is None or conv != chain.conv:
                    if chain is not None:
                        out.append(chain.row(True))
                    if f != family:
                        family, heads = f, []
                    chain, own, skip = Chain(conv, block), 0, head_length(conv)
                    # the base is rebuilt from itself, so its own first turns stand there as they come
                    for x in heads[:skip] if other else []:
                        out.append(chain.row(False))
                        chain.add(*x)
                own += 1
                if not other and own < HEADS:
                    heads.append((digest, size))
                if not other or own > skip:
                    out.append(chain.row(False))
                    chain.add(digest, size)
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                    out = []
        if chain is not None:
            out.append(chain.row(True))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    rows = turn_rows(turns).repartition("family").sortWithinPartitions("family", "other", "conv", F.asc_nulls_first("turn"), "role", "digest")
    return rows.select("family", "other", "conv", "digest", "bytes").mapInArrow(common.tidy(run), "conv long, depth long, digest binary, bytes long, ups array<binary>, last boolean")


def ends(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(digest, ends_sha256) of conversations' ends(digest, conv): the digest of their ids, ascending, joined by commas.

    Ids are joined in chunks over a range partitioning, which splits a node where many end; a second pass
    streams a node's chunks in order through one hash.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size, out = None, [], 0, []
        for batch in batches:
            for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv").to_pylist()):
                if digest != now or size > chunk:
                    if ids:
                        out.append((now, ids[0], ",".join(map(str, ids))))
                    now, ids, size = digest, [], 0
                ids.append(conv)
                size += 12
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], ["digest", "first", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["digest", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        for batch in batches:
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if digest != now:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = digest, hashlib.sha256(ids.encode())
                else:
                    h.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.binary(), pa.string()))], ["digest", "ends_sha256"])
                out = []
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["digest", "ends_sha256"])

    chunks = rows.repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv").mapInArrow(common.tidy(joined), "digest binary, first long, ids string")
    return chunks.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(common.tidy(hashed), "digest binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, scratch: Scratch, deepest: int, block: int = BLOCK) -> DataFrame:
    """(digest, leaves, saved): sums of nodes(depth, digest, ups, leaves, saved) over each node's subtree."""
    add = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    size = len(ROOT)

    def level(now: DataFrame, j: int) -> DataFrame:
        """now: the nodes whose depth block^j divides, with what they are worth by themselves."""
        # ancestors on this level: those of the block, or, of the root of a block, those of the block above
        ups = F.get("ups", F.lit(j))
        up = F.transform(F.sequence(F.lit(0), F.expr(f"octet_length(get(ups, {j})) div {size} - 1").cast("int")), lambda k: F.substring(ups, k * size + 1, F.lit(size)))
        to = lambda d, own: d.select(F.explode(F.concat(up, F.array("digest")) if own else up).alias("digest"), "leaves", "saved")
        root = F.col("depth") % block ** (j + 1) == 0
        if deepest < block ** (j + 1):
            return to(now.where("depth > 0"), True).union(now.where("depth = 0").select("digest", "leaves", "saved")).groupBy("digest").agg(*add)
        # over the blocks; a root adds to itself only
        part = scratch.save(to(now.where(~root), True).union(now.where(root).select("digest", "leaves", "saved")).groupBy("digest").agg(*add), f"part{j}")
        roots = scratch.save(now.where(root).select("depth", "digest", "ups").join(part, "digest"), f"roots{j}")
        whole = scratch.save(level(roots, j + 1), f"whole{j}")
        told = to(roots.where("depth > 0").select("digest", "ups").join(whole, "digest"), False)
        others = part.join(roots.select("digest"), "digest", "left_anti")
        # a root's whole sum already holds the blocks below; other nodes get the whole roots that hang below them
        return others.union(told.join(roots.select("digest"), "digest", "left_anti")).union(whole).groupBy("digest").agg(*add)

    return level(nodes, 0)


def trie(turns: DataFrame, *, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Nodes of the trie over rebuilt conversations, from turns(conv_id, turn, role, text).

    Turns are ordered by turn (null first), then role and the digest of role and text; null role or text is
    empty. Conversation c is rebuilt as the first h turns of conversation c - c % 5 and its own after its first
    h, h being crc32 of the decimal c modulo 9; % has the sign of c. Rows without conv_id are left out; repeated rows are
    turns of their own; an empty table gives an empty one; other columns are ignored.
    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    scratch = Scratch(turns.sparkSession)
    rows = scratch.save(prefixes(turns, block), "prefixes")
    nodes = scratch.save(rows.groupBy("depth", "digest", "bytes", "ups").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    parent = F.when(F.col("depth") > 0, F.expr(f"substring(get(ups, 0), -{len(ROOT)}, {len(ROOT)})"))
    children = nodes.where("depth > 0").groupBy(parent.alias("digest")).agg(F.count("*").alias("n_children"))
    ended = ends(rows.where("last").select("digest", "conv"), chunk)
    full = nodes.join(children, "digest", "left").join(ended, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = scratch.save(full.withColumn("parent", parent).withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "full")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(full.select("depth", "digest", "ups", "leaves", "saved"), scratch, deepest, block)
    above = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = full.drop("leaves", "saved", "ups").join(sums, "digest").join(above, "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
