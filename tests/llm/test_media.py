import hashlib
import io
import wave
import zlib

import numpy as np

from maskspark.llm.media import BANDS, FAN, FRAME, HOP, REACH, digests, fingerprints, load, media_columns, payload_of, store


def test_payload_and_store():
    assert payload_of(b"") == b"\xff" * FRAME
    assert [len(payload_of(b"x" * n)) for n in (1, 575, 576, 577)] == [576, 576, 576, 1152]
    media = store(payload_of(b"abc"))
    with wave.open(io.BytesIO(media)) as w:
        assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
    assert load(media) == payload_of(b"abc")


def test_fingerprints_do_not_depend_on_neighbours():
    r = np.random.default_rng(1)
    payloads = [payload_of(r.integers(0, 256, n).astype(np.uint8).tobytes()) for n in (1, 5000, 576, 20000)]
    together = fingerprints(payloads)
    for p, (times, codes) in zip(payloads, together, strict=True):
        alone = fingerprints([p])[0]
        assert np.array_equal(times, alone[0]) and np.array_equal(codes, alone[1])


def test_a_tone_peaks_at_its_bin():
    t = np.arange(FRAME * 20)
    tone = (128 + 60 * np.sin(2 * np.pi * 100 * t / FRAME) * (1 + (t // HOP) % 2)).astype(np.uint8)
    _, codes = fingerprints([tone.tobytes()])[0]
    bins = np.bincount(np.concatenate([codes >> 16, (codes >> 6) & 1023]))
    assert 100 in np.flatnonzero(bins)


def naive_fingerprint(payload):
    """Peaks and pairs by loops, from a transform written as its sum."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(FRAME // 2 + 1), np.arange(FRAME)) / FRAME)
    power = [abs(turn @ (x[at : at + FRAME] * hann)) ** 2 for at in range(0, len(x) - FRAME + 1, HOP)]
    best = [[max(range(a, b), key=lambda i: p[i]) for a, b in zip(BANDS, BANDS[1:], strict=False)] for p in power]
    strength = [[p[i] for i in row] for p, row in zip(power, best, strict=True)]
    peaks = []
    for t, row in enumerate(best):
        for k, f in enumerate(row):
            before = strength[t - 1][k] if t else 0
            after = strength[t + 1][k] if t + 1 < len(best) else 0
            if strength[t][k] > before and strength[t][k] >= after:
                peaks.append((t, f))
    pairs = [(t, f << 16 | g << 6 | u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 1 + FAN] if u - t <= REACH]
    return sorted(pairs)


def test_fingerprints_equal_a_naive_transform():
    r = np.random.default_rng(4)
    for frames in (1, 2, 5, 35):
        payload = r.integers(0, 256, frames * FRAME).astype(np.uint8).tobytes()  # no padding, whose flat spectrum ties
        times, codes = fingerprints([payload])[0]
        assert list(zip(times.tolist(), codes.tolist(), strict=True)) == naive_fingerprint(payload)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 400), (4, "é" * 400), (None, "x" * 300000)]
    made = media_columns(spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, media string, times int")).collect()
    told = {r.doc_id: r for r in digests(media_columns(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    got = {r.doc_id: r for r in made}
    for doc, text in rows:
        raw = (text or "").encode()
        p, r, d = payload_of(raw), got[doc], told[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert load(bytes(r.media)) == p and list(zip(r.times, r.codes, strict=True)) == list(zip(*(x.tolist() for x in fingerprints([p])[0]), strict=True))
        assert (d.media_bytes, d.media_sha256, d[1:5]) == (len(r.media), hashlib.sha256(r.media).hexdigest(), r[1:5])
        assert d.feature.startswith(f"pairs={len(r.times)};frames={len(set(r.times))};sha256=")
    assert got[1][1:] == got[2][1:] and told[3][1:] == told[4][1:] and told[1][1:] == told[2][1:]
    assert media_columns(spark.createDataFrame([], "doc_id long, text string")).collect() == []
