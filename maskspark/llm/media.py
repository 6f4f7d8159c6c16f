"""Media columns: bytes as WAV samples, short-time Fourier transforms, spectral-peak pairs.

A text's UTF-8 bytes are padded with bytes 255 to a positive multiple of one frame and stored as
unsigned 8-bit mono samples by the wave module; all features come from the bytes read back.
Frames overlap by half. In each frame the strongest bin of each band is a peak if it also stands
out in time; each peak and the next few peaks form pairs, kept as two arrays of equal length:
the frame of the first peak, and a code of both bins and their distance in frames.

Edge cases. Null counts as empty text; an empty text is one frame of bytes 255. Equal texts give
equal values. Whole texts are stored, of any length; transforms run over bounded blocks of
frames. Repeated rows each give a row; null doc_id is kept; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.llm.common import map_pieces

FRAME = 576
HOP = FRAME // 2
RATE = 8000
#: Borders of the bands, in bins.
BANDS = (1, 18, 72, 144, HOP + 1)
#: Pairs made with each peak, and their largest distance in frames.
FAN, REACH = 3, 63
#: Frames transformed at once.
FRAMES_AT_ONCE = 4096


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % FRAME if text else FRAME)


def store(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and strength of the strongest bin in each frame and band, for overlapping frames."""
    n = len(samples) // HOP - 1
    frames = np.lib.stride_tricks.as_strided(samples, (n, FRAME), (HOP * samples.strides[0], samples.strides[0]))
    window = np.hanning(FRAME).astype(np.float32)
    bins, power = np.empty((n, len(BANDS) - 1), np.int32), np.empty((n, len(BANDS) - 1), np.float32)
    for at in range(0, n, FRAMES_AT_ONCE):
        x = np.fft.rfft((frames[at : at + FRAMES_AT_ONCE].astype(np.float32) - 128) * window, axis=1)
        p = (x.real**2 + x.imag**2).astype(np.float32)
        for k, (a, b) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            i = p[:, a:b].argmax(1)
            bins[at : at + len(p), k] = a + i
            power[at : at + len(p), k] = p[np.arange(len(p)), a + i]
    return bins, power


def fingerprints(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(times, codes) of each payload; payloads are transformed together."""
    if not payloads:
        return []
    bins, power = _band_peaks(np.frombuffer(b"".join(payloads), np.uint8))
    ends = np.cumsum([len(p) // HOP for p in payloads])
    out = []
    start = 0
    for end in ends:
        b, p = bins[start : end - 1], power[start : end - 1]  # the frame at end - 1 would cross into the next payload
        edge = np.zeros((1, p.shape[1]), np.float32)
        peak = (p > np.vstack([edge, p[:-1]])) & (p >= np.vstack([p[1:], edge]))
        t, band = np.nonzero(peak)
        f = b[t, band].astype(np.int64)
        times, codes = [], []
        for k in range(1, FAN + 1):
            gap = t[k:] - t[:-k]
            near = gap <= REACH
            times.append(t[:-k][near] if k < len(t) else np.empty(0, np.int64))
            codes.append(((f[:-k] << 16) | (f[k:] << 6) | gap)[near] if k < len(t) else np.empty(0, np.int64))
        times, codes = np.concatenate(times), np.concatenate(codes)
        order = np.lexsort((codes, times))
        out.append((times[order].astype(np.int32), codes[order].astype(np.int32)))
        start = end
    return out


def media_columns(docs: DataFrame) -> DataFrame:
    """Of every row doc_id, n_bytes (of its text), the stored form (media), and, from the bytes read
    back, the digests of the payload and the fingerprint (times, codes: arrays of equal length)."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, times array<int>, codes array<int>"

    def make():
        def step(piece: pa.RecordBatch) -> dict:
            out: dict = {name.split()[0]: [] for name in schema.split(", ")}
            out["doc_id"] = piece["doc_id"]
            read = []
            for text in piece["text"].cast(pa.binary()).to_pylist():
                media = store(payload_of(text or b""))
                payload = load(media)
                read.append(payload)
                out["n_bytes"].append(len(text or b""))
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-32:]))
                out["media"].append(media)
            for times, codes in fingerprints(read):
                out["times"].append(times.tolist())
                out["codes"].append(codes.tolist())
            return out

        return step

    return map_pieces(docs.select("doc_id", "text"), "text", schema, make)


def digests(media: DataFrame) -> DataFrame:
    """The rows of media_columns() with digests in place of the stored form and the fingerprint."""
    listed = F.concat_ws(";", F.array_join("times", ","), F.array_join("codes", ","))
    feature = F.concat(F.lit("pairs="), F.size("times"), F.lit(";frames="), F.size(F.array_distinct("times")), F.lit(";sha256="), F.sha2(listed, 256))
    stored = (F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", *stored, feature.alias("feature"))
