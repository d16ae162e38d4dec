"""Operator 5: audio features of a media column.

Bytes are stored losslessly as 8-bit samples of a WAV file, read back, resampled by a polyphase filter, turned into
overlapped log-mel frames and cut into segments by energy with hysteresis. Frames are stored as fixed-shape Arrow
tensors, each with its time span.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches

UNIT = 64
RATE = 16_000
UP, DOWN = 1, 2
TAPS = 32
FRAME, HOP, FFT, MELS = 200, 80, 256, 32
#: Frames in a tensor, and frames computed at a time.
PATCH, BLOCK = 64, 2048
#: A segment begins at frames this far over the mean level, in dB, and ends below the second figure.
ON_DB, OFF_DB = 1.0, -1.0
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, segments array<struct<start_s: double, end_s: double>>, tensors binary"


def payload_of(text: bytes) -> bytes:
    """text with bytes 0 up to a positive multiple of UNIT."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of 8-bit samples; a large file's sizes, of 32 bits, are held at their maximum as streams do."""
    n = min(len(samples), 0xFFFFFFFF - 36)
    return HEADER.pack(b"RIFF", n + 36, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + samples


def from_wav(media: bytes) -> tuple[int, memoryview]:
    """The rate and the samples of a mono WAV file of 8-bit samples."""
    riff, _, wave, fmt, size, code, channels, rate, _, _, bits, data, n = HEADER.unpack_from(media)
    if (riff, wave, fmt, size, code, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data"):
        raise ValueError("not a mono WAV file of 8-bit samples")
    view = memoryview(media)[HEADER.size :]
    return rate, view if n == 0xFFFFFFFF - 36 else view[:n]


def low_pass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """One row of filter taps for each of the up phases: a windowed sinc that cuts at the lower of the two Nyquist rates."""
    n = np.arange(taps * up) - (taps * up - 1) / 2
    h = np.sinc(n / max(up, down)) / max(up, down) * np.hamming(taps * up) * up
    return np.ascontiguousarray(h.reshape(taps, up).T.astype(np.float32))


def resample(x: np.ndarray, phases: np.ndarray, down: int = DOWN) -> np.ndarray:
    """x at up / down times its rate: every output takes the one phase of the filter that meets samples."""
    up, taps = phases.shape
    n_out = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(down + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    y = np.empty(n_out, np.float32)
    for r in range(up):
        at = r * down
        own, taken, tap = y[r::up], windows[at // up :: down], np.ascontiguousarray(phases[at % up][::-1])
        for i in range(0, len(own), 1 << 16):  # windows overlap in memory; a product copies them
            own[i : i + (1 << 16)] = taken[i : min(i + (1 << 16), len(own))] @ tap
    return y


def mel_bank(rate: float, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters at equal steps of the mel scale: one column for each."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, fft // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_PHASES, _BANK, _WINDOW = low_pass(), mel_bank(RATE * UP / DOWN), np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (frames, MELS) and each frame's level in dB; a last part frame is filled up with zeros."""
    n = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mels, level = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, BLOCK):
        part = frames[i : i + BLOCK]
        level[i : i + BLOCK] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-10)
        spectrum = np.fft.rfft(part * _WINDOW, FFT, axis=1)
        mels[i : i + BLOCK] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _BANK + 1e-6)
    return mels, level


def active(level: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Frame ranges from a level over on to the next under off."""
    mark = np.where(level > on, 1, np.where(level < off, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    state = np.where(at >= 0, mark[np.maximum(at, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], state, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensor_file(mels: np.ndarray, hop_s: float) -> bytes:
    """An Arrow stream of one batch: patch, a fixed-shape tensor of PATCH frames, and its start_s and end_s."""
    n = -(-len(mels) // PATCH)
    whole = np.concatenate([mels, np.full((n * PATCH - len(mels), MELS), np.log(1e-6), np.float32)]).reshape(n, PATCH, MELS)
    start = np.arange(n) * PATCH
    batch = pa.record_batch({"patch": pa.FixedShapeTensorArray.from_numpy_ndarray(whole), "start_s": pa.array(start * hop_s), "end_s": pa.array(np.minimum(start + PATCH, len(mels)) * hop_s)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def features_of(text: str | None) -> tuple:
    """The columns of SCHEMA but doc_id, of one text."""
    raw = (text or "").encode("utf-8", "replace")
    media = to_wav(payload_of(raw))
    rate, samples = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mels, level = log_mel(resample(x, _PHASES))
    hop_s = HOP * DOWN / UP / rate
    mean = float(level.mean())
    spans = [{"start_s": a * hop_s, "end_s": b * hop_s} for a, b in active(level, mean + ON_DB, mean + OFF_DB)]
    return len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(mels), spans, tensor_file(mels, hop_s)


def audio_features(docs: DataFrame) -> DataFrame:
    """The columns of SCHEMA for every row of docs (doc_id, text).

    segments are the spans of raised energy; tensors is an Arrow stream of fixed-shape tensors (PATCH frames by MELS)
    with time spans. A null text counts as an empty one, whose payload is 64 zero bytes; equal texts have equal
    values. A null doc_id stays null, repeated rows give repeated rows, other columns are ignored, an empty table
    gives an empty one. Texts are whole; the spectrum is taken BLOCK frames at a time.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.int64()), ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("tensors", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(0, len(ids), 256):  # tensors of few rows at a time
                rows = [features_of(x) for x in texts.slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(i, 256), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(of, SCHEMA)


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' media and features: frames, segments and the hash of the tensors as stored."""
    rows = audio_features(read_table(spark, sf_dir, "documents"))
    spans = F.concat_ws(",", F.transform("segments", lambda s: F.concat(F.round(s["start_s"] * 1000).cast("long").cast("string"), F.lit("-"), F.round(s["end_s"] * 1000).cast("long").cast("string"))))
    feature = F.concat(F.lit("frames="), F.col("frames").cast("string"), F.lit(";segments="), F.size("segments").cast("string"), F.lit(":"), F.md5(spans), F.lit(";tensors="), F.sha2("tensors", 256))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
