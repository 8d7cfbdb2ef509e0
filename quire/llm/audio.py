"""Audio columns: 8-bit PCM, polyphase resampling, log-mel frames and hysteresis segments.

A clip is stored as a WAV file (one channel, unsigned 8-bit, 16 kHz). Its features are an Arrow stream
with one row for each run of 32 frames: a fixed-shape tensor (32 x 20 log-mel values, the last run
padded with the floor value) and the run's time span. Clips and features are columns of a Parquet
table in the shared folder; what is reported of them is read back from there.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Stages, blocks, frugal

RATE, UP, DOWN = 16_000, 5, 8
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, MELS, RUN = 320, 160, 20, 32
FLOOR = np.float32(-12.0)
#: Decibels above the median frame at which a segment opens and below which it closes.
OPEN_DB, CLOSE_DB = 1.5, 0.5
#: Output samples that are computed at once.
PIECE = 1 << 18
_WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")


def write_wav(payload: bytes) -> bytes:
    return _WAV.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def read_wav(data: bytes) -> bytes:
    riff, _, wave, fmt, _, kind, channels, _, _, _, bits, tag, n = _WAV.unpack_from(data)
    if (riff, wave, fmt, tag, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(data) != _WAV.size + n:
        raise ValueError("not one channel of 8-bit PCM")
    return data[_WAV.size :]


@cache
def phases() -> np.ndarray:
    """The low-pass filter's taps by output phase: UP rows."""
    half = 8 * max(UP, DOWN)
    t = np.arange(-half, half + 1)
    cut = 1.0 / max(UP, DOWN)
    taps = np.sinc(cut * t) * cut * np.blackman(len(t)) * UP
    taps = np.append(taps, np.zeros(-len(taps) % UP))
    return np.ascontiguousarray(taps.reshape(-1, UP).T.astype(np.float32))


def resample(x: np.ndarray) -> np.ndarray:
    """x at RATE as samples at OUT_RATE; each output touches only its own phase's taps."""
    h = phases()
    n_taps = h.shape[1]
    n = -(-len(x) * UP // DOWN)
    lead = (8 * max(UP, DOWN)) // UP
    padded = np.concatenate([np.zeros(n_taps - 1 - lead, np.float32), x, np.zeros(n_taps + DOWN + lead, np.float32)])
    out = np.empty(n, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(padded, n_taps)
    for p in range(UP):
        phase, base = (p * DOWN) % UP, (p * DOWN) // UP
        rows = view[base::DOWN]
        count = len(out[p::UP])
        taps = h[phase][::-1].copy()
        for at in range(0, count, PIECE):
            to = min(count, at + PIECE)
            out[p::UP][at:to] = rows[at:to] @ taps
    return out


@cache
def mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * OUT_RATE / FRAME
    rise, fall = (f[:, None] - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f[:, None]) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@cache
def hann() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and each frame's energy in decibels; a short clip is one padded frame."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, 4096):
        frames = view[at : at + 4096]
        energy[at : at + 4096] = 10 * np.log10((frames * frames).mean(axis=1) + 1e-8)
        power = np.abs(np.fft.rfft(frames * hann(), axis=1)).astype(np.float32) ** 2
        mels[at : at + 4096] = np.log(np.maximum(power @ mel_bank(), np.exp(FLOOR)))
    return mels, energy


def segments(energy: np.ndarray) -> np.ndarray:
    """Frame ranges that rise above the upper threshold, stretched while they stay above the lower one."""
    middle = np.median(energy)
    on = np.concatenate([[False], energy > middle + CLOSE_DB, [False]])
    edge = np.flatnonzero(np.diff(on))
    start, stop = edge[::2], edge[1::2]
    strong = np.concatenate([[0], np.cumsum(energy > middle + OPEN_DB)])
    return np.stack([start, stop], axis=1)[strong[stop] > strong[start]]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (RUN, MELS))
SCHEMA = pa.schema([("mel", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def features(payload: bytes) -> tuple[bytes, list[list[float]]]:
    """The Arrow stream of a clip's tensors, and its segments in seconds."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(x))
    runs = -(-len(mels) // RUN)
    full = np.full((runs * RUN, MELS), FLOOR, np.float32)
    full[: len(mels)] = mels
    first = np.arange(runs) * RUN
    last = np.minimum(first + RUN, len(mels)) - 1
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), RUN * MELS)
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR, storage), pa.array(first * HOP / OUT_RATE), pa.array((last * HOP + FRAME) / OUT_RATE)], schema=SCHEMA)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SCHEMA) as writer:
        writer.write_batch(batch)
    spans = segments(energy) * (HOP / OUT_RATE)
    return sink.getvalue().to_pybytes(), spans.round(4).tolist()


def _clips(pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in blocks(batch.column(1), 1 << 20):
                raw, media, mel, spans = data.tobytes(), [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    payload = raw[a:b] + bytes(max(pad, -(-(b - a) // pad) * pad) - (b - a))
                    media.append(write_wav(payload))
                    m, s = features(payload)
                    mel.append(m)
                    spans.append(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(media, pa.binary()), pa.array(mel, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.float64())))],
                    names=["doc_id", "n_bytes", "media", "mel", "segments"],
                )

    return run


def audio_columns(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", pad: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media, mel, segments): every text's UTF-8 bytes as a clip with its features.

    The bytes get zeros up to a positive multiple of ``pad``. Null text counts as empty and is ``pad``
    zeros; ids, null ones too, pass through; repeated rows each give a clip; other columns are ignored.
    Each row is made on its own, so equal texts give equal values and nothing is shuffled. Texts of any
    length are one clip each (a WAV file holds up to 4 GB), computed in pieces. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return docs.mapInArrow(frugal(_clips(pad)), "doc_id long, n_bytes long, media binary, mel binary, segments array<array<double>>")


def store(clips: DataFrame, stages: Stages | None = None) -> DataFrame:
    """Writes clips and their features to the shared folder and gives the table that is read back."""
    return (stages or Stages(clips.sparkSession, "audio")).put(clips, "clips")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha, crc, sizes, media_sha, said = [], [], [], [], [], []
        for media, mel, spans in zip(*(batch.column(i) for i in (2, 3, 4))):
            media = media.as_py()
            payload = read_wav(media)
            got = pa.ipc.open_stream(mel.as_py()).read_all()
            tensor = np.concatenate([x.to_numpy_ndarray() for x in got.column("mel").chunks]).reshape(-1, MELS)
            used = tensor[(tensor > FLOOR).any(axis=1)]
            spans = spans.as_py()
            text = {"rate": OUT_RATE, "runs": got.num_rows, "seconds": round(got.column("end_s")[-1].as_py(), 4), "mel_mean": [round(float(v), 2) for v in (used.mean(axis=0, dtype=np.float64) if len(used) else np.full(MELS, FLOOR))], "segments": len(spans), "voiced": round(sum(b - a for a, b in spans), 3)}
            n.append(len(payload))
            sha.append(hashlib.sha256(payload).hexdigest())
            crc.append(zlib.crc32(payload[-64:]))
            sizes.append(len(media))
            media_sha.append(hashlib.sha256(media).hexdigest())
            said.append(json.dumps(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media_sha), pa.array(said)],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def digest(clips: DataFrame) -> DataFrame:
    """What is read back from the stored clips and tensors."""
    return clips.mapInArrow(frugal(_digest), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
