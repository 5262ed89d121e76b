"""Media columns: payloads stored as WAV, read back, and fingerprinted by spectral peaks.

A payload's bytes are the samples of a mono 8-bit WAV file. The samples read back from it go through a short-time Fourier
transform; the strongest bin of each frame and band is a peak; peaks are paired with the ones that follow, and each pair is
stored as a time-coded number: frame << 32 | first bin << 20 | second bin << 8 | frames between.

Defined cases: null and empty texts are a payload of 64 zero bytes (silence has no peaks); equal texts give equal values;
repeated rows give repeated results; of equally strong bins the lowest is the peak; extra columns are ignored; very long texts are transformed
block by block; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomcast.llm import _text

RATE, FRAME, HOP, BANDS, FAN, BLOCK = 8000, 128, 64, ((2, 8), (8, 20), (20, 40), (40, 65)), 3, 4096
_HANN = np.hanning(FRAME).astype(np.float32)


def to_payload(text: str | None) -> bytes:
    """UTF-8, then zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The strongest bin of each frame (rows) and band (columns), -1 where a band is silent."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = []
    for at in range(0, len(frames), BLOCK):
        part = frames[at : at + BLOCK]
        power = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _HANN, axis=1))
        best = np.stack([power[:, a:b].argmax(axis=1) + a for a, b in BANDS], axis=1)
        level = np.stack([power[:, a:b].max(axis=1) for a, b in BANDS], axis=1)
        out.append(np.where(level > 1e-3, best, -1))
    return np.concatenate(out)


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded pairs of each peak with the same band's peaks of the next ``FAN`` frames, in order of time."""
    p = peaks(samples)
    out = []
    for gap in range(1, min(FAN, len(p) - 1) + 1):
        a, b = p[:-gap], p[gap:]
        time = np.broadcast_to(np.arange(len(a))[:, None], a.shape)
        good = (a >= 0) & (b >= 0)
        out.append(((time << 32) | (a << 20) | (b << 8) | gap)[good])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def row(text: str | None) -> dict:
    payload = to_payload(text)
    media = write_wav(payload)
    back = read_wav(media)
    marks = fingerprint(back)
    return {"n_bytes": len((text or "").encode()), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
            "feature": f"{len(marks)}:{hashlib.sha256(marks.astype('<i8').tobytes()).hexdigest()}", "media": media, "fingerprint": marks}


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(documents: DataFrame, keep_media: bool = True, keep_fingerprint: bool = True) -> DataFrame:
    """The digest columns of every row, its ``fingerprint`` (array of long) and the WAV file in ``media`` unless told otherwise."""
    def run(batches):
        for b in _text.small(batches, 1):
            rows = [row(t) for t in b.column(1).to_pylist()]
            cols = [b.column(0)]
            for name, kind in (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())):
                cols.append(pa.array([r[name] for r in rows], kind))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if keep_fingerprint:
                marks = [r["fingerprint"] for r in rows]
                ends = np.concatenate(([0], np.cumsum([len(m) for m in marks]))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64), pa.int64())))
                names.append("fingerprint")
            if keep_media:
                cols.append(pa.array([r["media"] for r in rows], pa.binary()))
                names.append("media")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return documents.select("doc_id", "text").mapInArrow(_text.released(run), _DIGEST + (", fingerprint array<long>" if keep_fingerprint else "") + (", media binary" if keep_media else ""))
