"""Audio features of media columns.

Samples are kept as 8-bit WAV bytes, stored, and read back from those bytes.  Features: polyphase resampling to a common
rate, overlapped frames under a mel filterbank in log scale, and segments of activity by energy with hysteresis (a
segment opens at the higher threshold and closes at the lower one).  The log-mel frames of a recording are one Arrow stream of
fixed-shape tensors of ``STEP`` frames, each with its time span; ``describe`` gives a short text of all features.

Resampling and filterbanks work in blocks, so beyond a recording's own bytes and its frames (0.7 bytes a sample) memory does not depend on its length.

Cases:  null is an empty recording; it is padded to 64 zero samples like any other to a positive multiple of 64; rows that repeat get
equal results, whatever their id; an empty table gives no row; a very long text is one value of one task; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, scratch

RATE, TARGET, UP, DOWN = 8000, 6000, 3, 4
TAPS = 16
FRAME, HOP, FFT, MELS = 192, 96, 256, 20
BLOCK = 4096
OPEN_DB, CLOSE_DB = 3.0, 0.0
STEP = 16
"""Frames in a tensor."""


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM; a sample is a byte, so nothing is lost."""
    pad = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def from_wav(wav: bytes) -> tuple[bytes, int]:
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(wav):
        kind, n = struct.unpack_from("<4sI", wav, at)
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", wav, at + 12)[0]
        if kind == b"data":
            return wav[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@cache
def _phases() -> np.ndarray:
    """The low-pass filter of the resampler, one row of TAPS a phase."""
    n = UP * TAPS
    t = (np.arange(n) - (n - 1) / 2) / DOWN
    h = np.sinc(t) * np.hamming(n)
    phases = h.reshape(TAPS, UP).T[:, ::-1]
    return np.ascontiguousarray(phases / phases.sum(axis=1, keepdims=True), dtype=np.float32)


def resampled(x: np.ndarray) -> Iterator[np.ndarray]:
    """Rate times UP / DOWN, in blocks: output m is phase (m * DOWN) mod UP of the filter over the inputs that end at m * DOWN // UP.

    Unsigned 8-bit samples are scaled to -1 .. 1.
    """
    count, stride = (len(x) * UP) // DOWN, UP * 8 * BLOCK
    for first in range(0, count, stride):
        stop = min(first + stride, count)
        low, high = first * DOWN // UP - (TAPS - 1), (stop - 1) * DOWN // UP + 1
        part = x[max(low, 0) : high].astype(np.float32)
        if x.dtype == np.uint8:
            part = (part - 128) / 128
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(part, (max(-low, 0), TAPS)), TAPS)
        out = np.empty(stop - first, np.float32)
        for r in range(min(UP, len(out))):
            n = len(out[r::UP])
            out[r::UP] = windows[r * DOWN // UP :: DOWN][:n] @ _phases()[r * DOWN % UP]
        yield out


def resample(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.float32), *resampled(x)])


@cache
def _filters() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(TARGET / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / TARGET)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(blocks: Iterator[np.ndarray], n: int) -> Iterator[np.ndarray]:
    """Blocks of (frames, MELS) of a signal of n samples; the last frame is padded with silence."""
    window = np.hanning(FRAME).astype(np.float32)
    count, done, rest = max(1, -(-max(0, n - FRAME) // HOP) + 1), 0, np.empty(0, np.float32)
    for block in itertools.chain(blocks, [None]):
        if block is not None:
            rest = np.concatenate([rest, block])
        while done < count:
            frames = min(BLOCK, count - done)
            need = (frames - 1) * HOP + FRAME
            if len(rest) < need and block is not None:
                break
            part = rest[:need]
            view = np.lib.stride_tricks.sliding_window_view(np.pad(part, (0, need - len(part))), FRAME)[::HOP] * window
            power = np.abs(np.fft.rfft(view, FFT)) ** 2
            yield (10 * np.log10(power.astype(np.float32) @ _filters() + 1e-6)).astype(np.float32)
            rest, done = rest[frames * HOP :], done + frames


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Spans of frames (end exclusive) that open OPEN_DB above the mean energy and close CLOSE_DB above it."""
    level = energy.mean()
    state = np.where(energy >= level + OPEN_DB, 1, np.where(energy < level + CLOSE_DB, -1, 0))
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.concatenate([[0], np.where(last >= 0, state[last] > 0, False).astype(np.int8), [0]])
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    x = np.frombuffer(samples, np.uint8)
    mel = np.concatenate(list(log_mel(resampled(x), (len(x) * UP) // DOWN)))
    return mel, segments(mel.mean(axis=1))


def describe(mel: np.ndarray, spans: list[tuple[int, int]]) -> str:
    ms = 1000 * HOP / TARGET
    active = sum(b - a for a, b in spans)
    first = ";".join(f"{round(a * ms)}-{round(b * ms)}" for a, b in spans)
    where = first if len(first) <= 200 else hashlib.sha256(first.encode()).hexdigest()
    means, spread = mel.mean(axis=0), mel.std(axis=0)
    return f"frames={len(mel)} segments={len(spans)} active_ms={round(active * ms)} spans={where} mean={','.join(f'{v:.1f}' for v in means)} std={','.join(f'{v:.1f}' for v in spread)}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def tensor_type() -> pa.FixedShapeTensorType:
    return pa.fixed_shape_tensor(pa.float32(), [STEP, MELS], dim_names=["frame", "mel"])


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of (start_ms, end_ms, log_mel), ``log_mel`` being a fixed-shape tensor of (STEP, MELS); the last one is filled up
    with the least value."""
    mel = np.pad(mel, ((0, -len(mel) % STEP), (0, 0)), constant_values=mel.min())
    storage = pa.FixedSizeListArray.from_arrays(pa.array(mel.ravel(), pa.float32()), STEP * MELS)
    start = 1000 * HOP / TARGET * np.arange(0, len(mel), STEP)
    columns = [pa.array(start), pa.array(start + 1000 * ((STEP - 1) * HOP + FRAME) / TARGET), pa.ExtensionArray.from_storage(tensor_type(), storage)]
    batch = pa.record_batch(columns, names=["start_ms", "end_ms", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tensors", pa.binary()),
])
ROW = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensors binary"
BATCH_BYTES = 16 << 20


def digest(doc_id: int | None, n_bytes: int, wav: bytes) -> tuple:
    back, _ = from_wav(wav)
    mel, spans = features(back)
    return (
        doc_id, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), describe(mel, spans), tensors(mel),
    )


def described(stored: DataFrame) -> DataFrame:
    """Per recording (doc_id, n_bytes, wav): the payload's and the media's digests, all features as text, and the log-mel tensors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda rows: pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], SCHEMA)
        for batch in batches:
            rows, size = [], 0
            for doc_id, n, wav in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                rows.append(digest(doc_id.as_py(), n.as_py(), wav.as_py()))
                size += len(rows[-1][-1])
                if size >= BATCH_BYTES:
                    yield make(rows)
                    rows, size = [], 0
            yield make(rows)

    return stored.select("doc_id", "n_bytes", "wav").mapInArrow(run, ROW)


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, wav): the stored form of every text's payload, and the bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, types, strict=True)], names=["doc_id", "n_bytes", "wav"])
        types = (pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                n, payload = payload_of(text.as_py())
                rows.append((doc_id.as_py(), n, to_wav(payload)))
                size += n
                if size >= BATCH_BYTES:
                    yield make(rows)
                    rows, size = [], 0
            yield make(rows)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, wav binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store the media of (doc_id, text) and describe what is read back."""
    path = scratch(docs.sparkSession, "media")
    made = media(docs)
    made.write.option("compression", "zstd").parquet(path)
    return described(docs.sparkSession.read.schema(made.schema).parquet(path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read(spark, sf_dir, "documents"))
