"""Token counts by a compiled finite-state transducer.

A byte-pair tokenizer with word ends is compiled, as far as the texts need it, into a deterministic
transducer over bytes. Its state holds, for every place of the current word from which a longer token may
still begin, the node of the token trie reached from there, the last token before that place, and how many
tokens the word has gained since. A transition emits the change of the token count. This works because a
token sequence is what the merges give if and only if each two neighbours are, so that every prefix has
exactly one possible last token.

The symbols of a batch are cut into chunks of equal length that run in step. All but a chunk's first, partial
word is independent of the state it is entered with; the chunks' state maps are composed by a scan, and
then the partial words run.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqspark.llm import common, pretok

CHUNK = 1024
#: States that a worker holds at most; then it compiles anew.
STATES = 300_000
NEVER = -128  # in emitted: not compiled yet
UNKNOWN, START = 1, 0  # states: entered with an unknown state; at the beginning of a word
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Merges:
    """Byte-pair merges of a vocabulary whose last symbols of words carry a suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        end, letters = model["end_of_word_suffix"], byte_letters()
        self.vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in enumerate(merges)}
        self.single = np.full((2, 256), -1, np.int64)
        #: Bytes of each token and whether it ends a word; other tokens can't come from merges.
        self.parts: dict[int, tuple[bytes, bool]] = {}
        made = {out for _, out in self.rank.values()}
        for text, i in self.vocab.items():
            last = text.endswith(end) and text != end
            core = text[: -len(end)] if last else text
            if all(c in letters for c in core):
                raw = bytes(letters[c] for c in core)
                if len(raw) == 1:
                    self.single[int(last), raw[0]] = i
                if len(raw) == 1 or i in made:
                    self.parts[i] = raw, last
        self.fits: dict[tuple[int, int], bool] = {}

    def symbols(self, raw: bytes, last: bool) -> list[int]:
        ids = self.single[0, np.frombuffer(raw, np.uint8)].tolist()
        if last:
            ids[-1] = int(self.single[1, raw[-1]])
        return ids

    def encode(self, ids: list[int]) -> list[int]:
        """Apply merges, the lowest rank first and the leftmost among equals."""
        while len(ids) > 1:
            best = min(((r[0], i, r[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (r := self.rank.get(pair))), default=None)
            if not best:
                break
            _, i, out = best
            ids = [*ids[:i], out, *ids[i + 2 :]]
        return ids

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when written one after the other (left -1: nothing)."""
        found = self.fits.get((left, right))
        if found is None:
            own = self.symbols(*self.parts[right])
            found = self.encode(([] if left < 0 else self.symbols(*self.parts[left])) + own) == ([right] if left < 0 else [left, right])
            self.fits[left, right] = found
        return found


class Transducer:
    """next[state, class of the byte] and emitted[state, column]; column: 2 x class + whether it ends a word."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: list[dict[int, int]] = [{}]
        self.token: list[list[int]] = [[-1, -1]]
        for i, (raw, last) in merges.parts.items():
            node = 0
            for b in raw:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append([-1, -1])
                node = self.child[node][b]
            self.token[node][last] = i
        self.classes = np.full(256, -1, np.int64)
        self.bytes: list[int] = []
        self.reset()

    def reset(self) -> None:
        #: (trie node, last token before the place, tokens gained since) of each open place, packed.
        self.states: list[bytes] = [array("i", [0, -1, 0]).tobytes(), b""]
        self.number = {self.states[START]: START}
        width = max(16, len(self.bytes))
        self.next = np.full((4096, width), -1, np.int32)
        self.emitted = np.full((4096, 2 * width), NEVER, np.int8)
        self._unknown()

    def _unknown(self) -> None:
        self.next[UNKNOWN], self.emitted[UNKNOWN] = UNKNOWN, 0

    def columns(self, raw: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Column of each symbol; unseen bytes get a class."""
        if (self.classes[raw] < 0).any():
            for b in np.unique(raw):
                if self.classes[b] < 0:
                    self.classes[b] = len(self.bytes)
                    self.bytes.append(int(b))
            if (short := len(self.bytes) - self.next.shape[1]) > 0:
                self.next = np.pad(self.next, ((0, 0), (0, max(short, 16))), constant_values=-1)
                self.emitted = np.pad(self.emitted, ((0, 0), (0, 2 * max(short, 16))), constant_values=NEVER)
                self._unknown()
        return (2 * self.classes[raw] + last).astype(np.int32)

    def build(self, state: int, column: int) -> None:
        """Compile one transition."""
        b, last = self.bytes[column // 2], column % 2
        emitted, found, places = None, -1, []
        packed = array("i", self.states[state]).tolist()
        for node, token, gained in zip(packed[0::3], packed[1::3], packed[2::3]):
            to = self.child[node].get(b)
            if to is None:
                continue
            if (t := self.token[to][last]) >= 0 and emitted is None and self.merges.fit(token, t):
                emitted, found = 1 - gained, t
            if self.child[to]:
                places.append((to, token, gained))
        if emitted is None:
            raise ValueError(f"no token ends with byte {b}")
        self.emitted[state, column] = emitted
        if not last:
            key = array("i", [x for to, token, gained in places for x in (to, token, gained + emitted)] + [0, found, 0]).tobytes()
            new = self.number.get(key)
            if new is None:
                new = self.number[key] = len(self.states)
                self.states.append(key)
                if new >= len(self.next):
                    more = min(len(self.next), 1 << 15)
                    self.next = np.pad(self.next, ((0, more), (0, 0)), constant_values=-1)
                    self.emitted = np.pad(self.emitted, ((0, more), (0, 0)), constant_values=NEVER)
            self.next[state, column // 2] = new

    def step(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self.emitted[state, column]
        if (miss := got == NEVER).any():
            for s, c in set(zip(state[miss].tolist(), column[miss].tolist())):
                self.build(s, c)
            got = self.emitted[state, column]
        to = self.next[state, column >> 1]
        to[(column & 1) == 1] = START
        return to, got

    def run(self, columns: np.ndarray) -> np.ndarray:
        """Emitted counts at each symbol. The last symbol must end a word."""
        n = len(columns)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        if len(self.states) > STATES:
            self.reset()
        size = min(CHUNK, max(16, n // 64))
        lanes = -(-n // size)
        # padding begins a word that never ends
        grid = np.zeros(lanes * size, np.int32)
        grid[:n] = columns
        grid = np.ascontiguousarray(grid.reshape(lanes, size).T)
        got = np.zeros((size, lanes), np.int8)
        state = np.full(lanes, UNKNOWN, np.int32)
        full = lanes - (n % size > 0)
        for k in range(size):
            w = lanes if k < n - full * size or full == lanes else full
            state[:w], got[k, :w] = self.step(state[:w], grid[k, :w])
        # compose: the state a chunk is entered with is its predecessor's exit, run on where that is unknown
        enter = np.full(lanes, UNKNOWN, np.int32)
        enter[0] = START
        enter[1:] = state[:-1]
        waiting = np.flatnonzero(enter != UNKNOWN)
        while len(waiting):
            lane, s = waiting, enter[waiting]
            passed = []
            for k in range(size):
                inside = lane * size + k < n
                lane, s = lane[inside], s[inside]
                if not len(lane):
                    break
                column = grid[k, lane]
                s, got[k, lane] = self.step(s, column)
                going = column % 2 == 0
                lane, s = lane[going], s[going]
            else:
                passed = [lane, s]
            waiting = np.zeros(0, np.int64)
            if len(passed):
                after = passed[0] + 1
                ok = after < lanes
                enter[after[ok]] = passed[1][ok]
                waiting = after[ok]
        return np.ascontiguousarray(got.T).reshape(-1)[:n]


class Counter:
    """Counts the tokens of texts as a tokenizer file of this family gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = [x for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in split] != ["Split", "ByteLevel"] or split[0]["pattern"] != {"Regex": PATTERN} or not spec["model"]["end_of_word_suffix"]:
            raise ValueError("this file needs another normalizer, splitter or merges without word ends")
        self.transducer = Transducer(Merges(spec))
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.special and "<|" in text:
                pieces = self.special.split(text)
                extra[i] = len(pieces) - 1
                for p in pieces:
                    parts.append(self.normal(p))
                    owner.append(i)
            else:
                parts.append(self.normal(text))
                owner.append(i)
        cp, at = pretok.code_points(parts)
        start, cls = pretok.piece_starts(cp, at, joins_space=False, single_numbers=True)
        keep = cls != pretok.SPACE
        ends = np.zeros(len(cp), bool)
        ends[:-1] = start[1:]
        ends[-1:] = True
        ends[at[1:][at[1:] > at[:-1]] - 1] = True
        width = pretok.widths(cp)
        byte_at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        raw = np.frombuffer("".join(parts).encode("utf-8", "surrogatepass"), np.uint8)
        last = np.zeros(len(raw), bool)
        last[byte_at[1:][ends] - 1] = True
        kept = np.repeat(keep, width)
        total = np.zeros(len(raw) + 1, np.int64)
        emitted = np.zeros(len(raw), np.int8)
        emitted[kept] = self.transducer.run(self.transducer.columns(raw[kept], last[kept]))
        np.cumsum(emitted, out=total[1:])
        np.add.at(extra, np.array(owner, np.int64), total[byte_at[at[1:]]] - total[byte_at[at[:-1]]])
        return extra


@cache
def load(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, *, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokens of every whole text, special strings inside texts counting as one token each.

    Returns id_column, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). Null texts count as empty:
    0 bytes, 0 tokens. A null id stays null, repeated rows each give a row, an empty table an empty one, and
    other columns are ignored.
    """
    common.small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for whole in batches:
            for batch in common.slices(whole, "t", 2 << 20):
                texts = [x or "" for x in batch.column("t").to_pylist()]
                n = counter.count(texts)
                size = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [id_column, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_column].alias("i"), docs[text_column].alias("t")).mapInArrow(common.tidy(run), f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
