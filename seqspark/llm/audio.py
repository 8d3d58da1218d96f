"""Audio features of byte payloads: 8-bit WAV, polyphase resampling, log-mel frames, energy segments."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqspark.llm import common


@dataclass(frozen=True)
class Settings:
    """Sampling rates in Hz, the resampling filter, frames and thresholds."""

    rate: int = 12_000
    up: int = 2
    down: int = 3
    taps_per_phase: int = 12
    frame: int = 256
    hop: int = 128
    mels: int = 24
    tensor_frames: int = 32
    #: A segment begins at a frame louder than the upper share of the loudest frame's energy and lasts to the
    #: first frame below the lower share.
    on: float = 0.6
    off: float = 0.3
    block: int = 192

    @cached_property
    def phases(self) -> np.ndarray:
        """Integer filter taps by phase, [up, taps_per_phase]; whole numbers make the result exact."""
        n = self.up * self.taps_per_phase
        t = np.arange(n) - (n - 1) / 2
        cut = 1 / max(self.up, self.down)
        h = np.sinc(t * cut) * np.hamming(n)
        h = h / h.sum() * self.up
        return np.round(h * 4096).astype(np.int64).reshape(self.taps_per_phase, self.up).T[:, ::-1].copy()

    @cached_property
    def bank(self) -> np.ndarray:
        """Triangular mel filters, [bins, mels]."""
        out_rate, bins = self.rate * self.up / self.down, self.frame // 2 + 1
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        edge = 700 * (10 ** (np.linspace(mel(0.0), mel(out_rate / 2), self.mels + 2) / 2595) - 1)
        f = np.linspace(0, out_rate / 2, bins)[:, None]
        rise, fall = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
        return np.maximum(0, np.minimum(rise, fall))

    @cached_property
    def window(self) -> np.ndarray:
        return np.hanning(self.frame)


def write_wav(samples: bytes, rate: int) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    n, pad = len(samples), len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + b"\0" * pad


def read_wav(raw: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono WAV file of unsigned 8-bit samples, by its chunks."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from("<4sI", raw, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit samples")
        elif kind == b"data":
            return raw[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def resample(x: np.ndarray, s: Settings) -> np.ndarray:
    """Polyphase resampling of whole-number samples by up/down, exact in 64-bit integers."""
    taps, n_out = s.taps_per_phase, -(-len(x) * s.up // s.down)
    padded = np.zeros(len(x) + 2 * taps, np.int64)
    padded[taps : taps + len(x)] = x
    rows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n_out, np.int64)
    for first in range(s.up):
        # outputs first, first + up, ... have one phase: their inputs lie `down` samples apart
        place = first * s.down
        count = len(range(first, n_out, s.up))
        begin = place // s.up + taps // 2 + 1
        picked = rows[begin : begin + (count - 1) * s.down + 1 : s.down]
        acc = np.zeros(count, np.int64)
        for k, weight in enumerate(s.phases[place % s.up].tolist()):
            acc += picked[:, k] * weight
        out[first :: s.up] = acc
    return (out + 2048) >> 12


def log_mel(y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames [frames, mels] (float32) and the energy of each frame (whole numbers)."""
    n = max(1, -(-max(0, len(y) - s.frame) // s.hop) + 1)
    padded = np.zeros((n - 1) * s.hop + s.frame, np.int64)
    padded[: len(y)] = y
    frames = np.lib.stride_tricks.sliding_window_view(padded, s.frame)[:: s.hop]
    sums = np.zeros(len(padded) + 1, np.int64)
    np.cumsum(padded * padded, out=sums[1:])
    begin = np.arange(n) * s.hop
    energy = sums[begin + s.frame] - sums[begin]
    out = np.empty((n, s.mels), np.float32)
    for k in range(0, n, 512):  # rows of equal shape, but for the last: bounded memory
        power = np.abs(np.fft.rfft(frames[k : k + 512] * s.window, axis=1)) ** 2
        out[k : k + 512] = np.log(np.einsum("ij,jk->ik", power, s.bank) + 1e-3)
    return out, energy


def segments(energy: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Loud spans of frames [begin, end) by hysteresis."""
    top = int(energy.max()) if len(energy) else 0
    if top <= 0:
        return []
    over, under = energy >= s.on * top, energy < s.off * top
    # the last event so far decides: 1 from a loud frame on, 0 from a quiet one on
    event = np.where(over, 1, np.where(under, 0, -1))
    last = np.maximum.accumulate(np.where(event >= 0, np.arange(len(event)), -1))
    on = np.where(last >= 0, event[np.maximum(last, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def tensors(mel: np.ndarray, s: Settings) -> tuple[np.ndarray, list[dict[str, float]]]:
    """Fixed-shape blocks [blocks, tensor_frames, mels] with their time spans in seconds; the last is padded."""
    rate = s.rate * s.up / s.down
    blocks = -(-len(mel) // s.tensor_frames)
    out = np.zeros((blocks * s.tensor_frames, s.mels), np.float32)
    out[: len(mel)] = mel
    step = s.tensor_frames * s.hop
    return out.reshape(blocks, s.tensor_frames, s.mels), [{"start": k * step / rate, "end": min((k + 1) * step, (len(mel) - 1) * s.hop + s.frame) / rate} for k in range(blocks)]


def tensor_array(blocks: pa.Array, settings: Settings | None = None) -> pa.FixedShapeTensorArray:
    """The inner lists of a `tensors` column as Arrow tensors of one fixed shape (frames, mels)."""
    s = settings or Settings()
    kind = pa.fixed_shape_tensor(pa.float32(), [s.tensor_frames, s.mels])
    flat = blocks.flatten() if isinstance(blocks, pa.ListArray) and pa.types.is_list(blocks.type.value_type) else blocks
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat.flatten(), s.tensor_frames * s.mels))


def write_tensors(blocks: np.ndarray, s: Settings) -> bytes:
    """Blocks as an Arrow stream of one column of tensors of fixed shape."""
    flat = pa.array(blocks.reshape(-1), pa.float32())
    kind = pa.fixed_shape_tensor(pa.float32(), [s.tensor_frames, s.mels])
    column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, s.tensor_frames * s.mels))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("tensor", kind)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([column], ["tensor"]))
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> np.ndarray:
    """The blocks of write_tensors() as one array [blocks, frames, mels]."""
    return pa.ipc.open_stream(stored).read_all().column("tensor").combine_chunks().to_numpy_ndarray()


def feature(blocks: np.ndarray, frames: int, loud: list[tuple[int, int]]) -> str:
    """Digest of the quantised log-mel frames of tensors, and of the loud segments."""
    mel = blocks.reshape(-1, blocks.shape[-1])[:frames]
    return hashlib.sha256(np.round(mel * 64).astype("<i2").tobytes() + np.array(loud, "<i8").tobytes()).hexdigest()


def payload(text: str, block: int) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(1, -(-len(raw) // block)) * block - len(raw))


def media(docs: DataFrame, settings: Settings | None = None, *, id_column: str = "doc_id", text_column: str = "text", full: bool = True) -> DataFrame:
    """Store each whole text as audio, read it back and compute features.

    Returns id_column, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the samples read back),
    media_bytes, media_sha256, feature (digest of the quantised log-mel frames and segments), n_frames,
    segments (array of start and end seconds); full: also media (the WAV file), tensors (log-mel blocks of
    one fixed shape, see tensor_array()) and spans (the start and end seconds of each block). Null texts count as empty: one block of blanks.
    Equal texts have equal values: every text is computed by itself. A null id stays null, repeated rows
    each give a row, an empty table an empty one; other columns are ignored.
    """
    s = settings or Settings()
    common.small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def one(text: str) -> tuple:
        n_bytes, samples = payload(text, s.block)
        wav = write_wav(samples, s.rate)
        back, _ = read_wav(wav)
        y = resample(np.frombuffer(back, np.uint8).astype(np.int64) - 128, s)
        mel, energy = log_mel(y, s)
        loud = segments(energy, s)
        rate = s.rate * s.up / s.down
        spans = [{"start": a * s.hop / rate, "end": ((b - 1) * s.hop + s.frame) / rate} for a, b in loud]
        stored, times = tensors(mel, s)
        told = feature(read_tensors(write_tensors(stored, s)), len(mel), loud)
        row = (n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), told, len(mel), spans)
        return (*row, wav, stored, times) if full else row

    def blocks(values: tuple[np.ndarray, ...]) -> pa.Array:
        inner = s.tensor_frames * s.mels
        flat = np.concatenate([x.reshape(-1) for x in values])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, inner), pa.int32()), pa.array(flat))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), lists)

    spans_type = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), spans_type, pa.binary(), None, spans_type]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "segments", "media", "tensors", "spans"]
    names = names if full else names[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "t", 4 << 20):
                rows = [one(x or "") for x in batch.column("t").to_pylist()]
                columns = [pa.array(x, kind) if kind else blocks(x) for x, kind in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column("i"), *columns], [id_column, *names])

    schema = f"`{id_column}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, segments array<struct<start:double,end:double>>" + ", media binary, tensors array<array<float>>, spans array<struct<start:double,end:double>>" * full
    return docs.select(docs[id_column].alias("i"), docs[text_column].alias("t")).mapInArrow(common.tidy(run), schema)
