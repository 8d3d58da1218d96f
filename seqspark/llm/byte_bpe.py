"""Byte-level byte-pair encoding and decoding of whole texts on length-bucketed numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqspark.llm import common, pretok

NONE = np.int32(0x7FFFFFFF)
#: Pieces of more bytes leave the matrices for a heap with the same merge order.
LONGEST_ROW = 256
#: Distinct pieces that a worker remembers, and their bytes; then it starts anew.
REMEMBERED, REMEMBERED_BYTES = 60_000, 4 << 20


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of base64 token and rank lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing over numpy arrays."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens)}
        keys, values = [], []
        for t, i in ids.items():
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.keys[slot[won]], self.values[slot[won]] = key[won], value[won]
            left = np.ones(len(key), bool)
            left[won] = False
            key, value, slot = key[left], value[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is none (also for padding, below 0)."""
        key = (a.astype(np.int64) << 32 | b.astype(np.int64)).ravel()
        key[(a.ravel() < 0) | (b.ravel() < 0)] = -2
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.values[slot], NONE)
        todo = np.flatnonzero((got != key) & (got >= 0) & (key >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out.reshape(a.shape)


class ByteBPE:
    """Encoder and decoder by ranks. The lowest-ranked pair merges first, the leftmost among equals."""

    def __init__(self, path: str):
        self.tokens = read_ranks(path)
        self.pairs = PairTable(self.tokens)
        ids = {t: i for i, t in enumerate(self.tokens)}
        self.whole = ids
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        self.memory: dict[bytes, bytes] = {}
        self.held = 0

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Ids of each row of a padded matrix (padding is -1): all rows merge one pair a round."""
        done = np.full(rows.shape, -1, np.int32)
        index = np.arange(len(rows))
        ids, rank = rows, self.pairs.find(rows[:, :-1], rows[:, 1:])
        while len(index):
            j = rank.argmin(1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            best = rank[np.arange(len(ids)), j] if rank.shape[1] else np.full(len(ids), NONE)
            over = best == NONE
            if over.any():
                done[index[over], : ids.shape[1]] = ids[over]
                keep = ~over
                index, ids, rank, j, best = index[keep], ids[keep], rank[keep], j[keep], best[keep]
                if not len(index):
                    break
            r = np.arange(len(ids))
            ids[r, j] = best
            keep = np.ones(ids.shape, bool)
            keep[r, j + 1] = False
            ids = ids[keep].reshape(len(ids), -1)
            keep = np.ones(rank.shape, bool)
            keep[r, j] = False
            rank = rank[keep].reshape(len(ids), -1)
            if rank.shape[1]:
                # the pair that begins at the merged token, and the one that ends there
                right = np.minimum(j, rank.shape[1] - 1)
                rank[r, right] = self.pairs.find(ids[r, right], ids[r, right + 1])
                left = np.maximum(j - 1, 0)
                rank[r, left] = self.pairs.find(ids[r, left], ids[r, left + 1])
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece by a heap of (rank, place): the same order as merge_rows, n log n."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        a = np.array(ids, np.int32)
        start = self.pairs.find(a[:-1], a[1:])
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(start.tolist()) if r != NONE]
        heapq.heapify(heap)
        whole, tokens = self.whole, self.tokens
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            if not alive[i] or ids[i] != left or after[i] >= n or ids[after[i]] != right:
                continue
            k = after[i]
            ids[i], alive[k], after[i] = rank, False, after[k]
            if after[k] < n:
                before[after[k]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    r = whole.get(tokens[ids[x]] + tokens[ids[y]])
                    if r is not None:
                        heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x, ok in zip(ids, alive) if ok], np.int32)

    def learn(self, pieces: list[bytes]) -> None:
        """Encode distinct pieces and remember their ids as little-endian bytes."""
        buckets: dict[int, list[bytes]] = {}
        for p in pieces:
            i = self.whole.get(p)
            if i is not None and len(p) == 1:
                self.memory[p] = i.to_bytes(4, "little")
            elif len(p) > LONGEST_ROW:
                self.memory[p] = self.merge_long(p).astype("<u4").tobytes()
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(p)
        for size, group in buckets.items():
            for k in range(0, len(group), 1 << 14):
                part = group[k : k + (1 << 14)]
                rows = np.full((len(part), size * 4), -1, np.int32)
                lengths = np.fromiter(map(len, part), np.int64, len(part))
                rows[np.arange(size * 4) < lengths[:, None]] = self.bytes[np.frombuffer(b"".join(part), np.uint8)]
                done = self.merge_rows(rows)
                real = done >= 0
                flat, ends = done[real].astype("<u4").tobytes(), (real.sum(1).cumsum() * 4).tolist()
                self.memory.update(zip(part, [flat[a:b] for a, b in zip([0, *ends], ends)]))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cp, at = pretok.code_points(texts)
        start, _ = pretok.piece_starts(cp, at, joins_space=True, single_numbers=False)
        width = pretok.widths(cp)
        place = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(width, out=place[1:])
        begins = np.flatnonzero(start)
        first = np.searchsorted(begins, at)
        cuts = place[np.append(begins, len(cp))].tolist()
        raw = "".join(texts).encode("utf-8", "surrogatepass")
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(self.memory) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.memory.clear()
            self.held = 0
        new = set(pieces).difference(self.memory)
        if new:
            self.learn(list(new))
            self.held += sum(map(len, new))
        found = list(map(self.memory.__getitem__, pieces))
        return [b"".join(found[a:b]) for a, b in zip(first.tolist(), first[1:].tolist())]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def digests(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again and digest both.

    Returns id_column, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256,
    and with_ids the column ids (those bytes). Null texts count as empty, which have no tokens; a null id
    stays null; repeated rows each give a row; an empty table gives an empty one; other columns are ignored.
    """
    common.small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for batch in common.slices(whole, "t", 1 << 20):
                texts = [x or "" for x in batch.column("t").to_pylist()]
                ids = bpe.encode_batch(texts)
                out = [
                    batch.column("i"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out, names = [*out, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(docs[id_column].alias("i"), docs[text_column].alias("t")).mapInArrow(common.tidy(run), schema)
