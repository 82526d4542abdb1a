"""Audio vectors: hashed triples of spectral peaks, computed a window at a time in NumPy."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import FNV_OFFSET, FNV_PRIME, TextFailure, unit
from lodestone.types import DIMENSIONS

#: Fixed values of the landmark profile.
RATE, FFT, HOP = 16_000, 1024, 256
FIRST_BIN, LAST_BIN, NEIGHBOURHOOD, PEAKS = 6, 256, 4, 5
FLOOR, SILENCE = 0.03, 1e-8
TRIPLES = ((7, 3), (15, 7), (31, 15), (63, 31))
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
WINDOW_SECONDS, MAX_WINDOWS, MIN_LANDMARKS = 8.0, 32, 32
FRAMES_AT_ONCE = 4096
#: Rates that are taken for sound.
MIN_RATE, MAX_RATE = 1000, 768_000


def windows(duration: float) -> list[tuple[float, float]]:
    """(start, length) in seconds: centred in equal intervals, at most MAX_WINDOWS."""
    if not np.isfinite(duration) or duration <= 0:
        return []
    n = int(min(max(np.ceil(duration / WINDOW_SECONDS), 1), MAX_WINDOWS))
    interval = duration / n
    length = min(WINDOW_SECONDS, interval)
    return [(max(0.0, (i + 0.5) * interval - length / 2), length) for i in range(n)]


def peaks(samples: np.ndarray) -> np.ndarray:
    """Up to PEAKS half bins of each frame, strongest first; -1 where there are fewer."""
    if len(samples) < FFT:
        return np.empty((0, PEAKS), np.int64)
    hann = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FFT) / FFT)).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FFT)[::HOP]
    found = []
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(frames[at : at + FRAMES_AT_ONCE] * hann, axis=1).astype(np.complex64)
        power = (spectrum.real**2 + spectrum.imag**2)[:, : FFT // 2]
        band = power[:, FIRST_BIN : LAST_BIN + 1]
        top = band.max(1, keepdims=True)
        keep = (top >= SILENCE) & (band >= top * np.float32(FLOOR))
        for d in range(1, NEIGHBOURHOOD + 1):
            lower = power[:, FIRST_BIN - d : LAST_BIN + 1 - d]
            upper = power[:, FIRST_BIN + d : LAST_BIN + 1 + d]
            # Of equal neighbours the lower bin is the peak.
            keep &= (band > lower) & (band >= upper)
        order = np.argsort(np.where(keep, -band, np.inf), axis=1, kind="stable")[:, :PEAKS]
        found.append(np.where(np.take_along_axis(keep, order, 1), (order + FIRST_BIN) // 2, -1))
    return np.concatenate(found)


def triple_hash(pattern: int, *peaks: np.ndarray) -> np.ndarray:
    """64-bit hash of a pattern and the half bins of its three peaks: FNV-1a, finalised."""
    with np.errstate(over="ignore"):
        state = np.full(len(peaks[0]), (FNV_OFFSET ^ pattern) * FNV_PRIME % (1 << 64), np.uint64)
        for p in peaks:
            state = (state ^ p.astype(np.uint64)) * np.uint64(FNV_PRIME)
        state = (state ^ (state >> np.uint64(30))) * np.uint64(MIX_1)
        state = (state ^ (state >> np.uint64(27))) * np.uint64(MIX_2)
        return state ^ (state >> np.uint64(31))


def landmarks(samples: np.ndarray, counts: np.ndarray) -> int:
    """Add the signed triples of one window to `counts`; how many there were."""
    found = peaks(samples)
    total = 0
    with np.errstate(over="ignore"):
        for pattern, (far, near) in enumerate(TRIPLES):
            if len(found) <= far:
                break
            old, middle, now = found[:-far], found[far - near : len(found) - near], found[far:]
            shape = np.broadcast_shapes(old[:, :, None, None].shape, middle[:, None, :, None].shape, now[:, None, None, :].shape)
            parts = [np.broadcast_to(x, shape) for x in (old[:, :, None, None], middle[:, None, :, None], now[:, None, None, :])]
            real = np.logical_and.reduce([p >= 0 for p in parts])
            state = triple_hash(pattern, *[p[real] for p in parts])
            sign = 1.0 - 2.0 * (state >> np.uint64(63)).astype(np.float64)
            counts += np.bincount((state & np.uint64(DIMENSIONS - 1)).astype(np.int64), weights=sign, minlength=DIMENSIONS)
            total += len(state)
    return total


def resample(samples: np.ndarray, rate: int) -> np.ndarray:
    """Samples of `rate` at RATE, band-limited: the spectrum cut or padded."""
    if rate == RATE or not len(samples):
        return samples
    size = round(len(samples) * RATE / rate)
    spectrum = np.fft.rfft(samples.astype(np.float64))
    kept = np.zeros(size // 2 + 1, np.complex128)
    n = min(len(kept), len(spectrum))
    kept[:n] = spectrum[:n]
    return (np.fft.irfft(kept, size) * (size / len(samples))).astype(np.float32)


def encode_samples(samples: np.ndarray, rate: int = RATE) -> tuple[np.ndarray, dict]:
    """(unit vector, extraction) of mono samples; windows of another rate than RATE are
    resampled one by one. Raises TextFailure."""
    if not MIN_RATE <= rate <= MAX_RATE:
        raise TextFailure("decode_failed", f"{rate} samples a second")
    if not np.isfinite(samples).all():
        raise TextFailure("decode_failed", "samples that are no numbers")
    duration = len(samples) / rate
    counts, total, spans = np.zeros(DIMENSIONS), 0, []
    for start, length in windows(duration):
        part = resample(samples[round(start * rate) : round((start + length) * rate)], rate)
        if len(part) < FFT:
            raise TextFailure("insufficient_content", "a window is shorter than one frame")
        total += landmarks(part, counts)
        spans.append({"start_seconds": start, "decoded_samples": len(part)})
    if total < MIN_LANDMARKS:
        raise TextFailure("insufficient_content", f"{total} landmarks")
    vector = unit(np.sign(counts) * np.sqrt(np.abs(counts)))
    return vector, {"coverage": "sampled_audio_timeline", "duration_seconds": duration, "landmarks": total, "windows": spans}


def _chunks(content: bytes, order: str) -> dict[bytes, bytes]:
    """The first chunk of each name of a chunked file; a last one that is cut off counts."""
    out, at = {}, 12
    while at + 8 <= len(content):
        name, size = struct.unpack(f"{order}4sI", content[at : at + 8])
        out.setdefault(name, content[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def _wave(content: bytes) -> tuple[bytes, str, int, int]:
    parts = _chunks(content, "<")
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", parts[b"fmt "][:16])
    if kind == 0xFFFE:
        kind = struct.unpack("<H", parts[b"fmt "][24:26])[0]
    return parts[b"data"], {(1, 8): "u1", (1, 16): "<i2", (1, 24): "<i3", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}[kind, bits], channels, rate


def _aiff(content: bytes) -> tuple[bytes, str, int, int]:
    parts = _chunks(content, ">")
    channels, _, bits, exponent, mantissa = struct.unpack(">HIHHQ", parts[b"COMM"][:18])
    kind = parts[b"COMM"][18:22] if content[8:12] == b"AIFC" else b"NONE"
    order = {b"NONE": ">i", b"twos": ">i", b"sowt": "<i", b"fl32": ">f", b"FL32": ">f"}[kind]
    offset = struct.unpack(">I", parts[b"SSND"][:4])[0]
    return parts[b"SSND"][8 + offset :], "i1" if bits == 8 else f"{order}{bits // 8}", channels, round(mantissa * 2.0 ** (exponent - 16383 - 63))


def _au(content: bytes) -> tuple[bytes, str, int, int]:
    offset, _, kind, rate, channels = struct.unpack(">5I", content[4:24])
    return content[offset:], {2: "i1", 3: ">i2", 4: ">i3", 5: ">i4", 6: ">f4", 7: ">f8"}[kind], channels, rate


def _caf(content: bytes) -> tuple[bytes, str, int, int]:
    at, parts = 8, {}
    while at + 12 <= len(content):
        name, size = struct.unpack(">4sq", content[at : at + 12])
        parts.setdefault(name, content[at + 12 :] if size < 0 else content[at + 12 : at + 12 + size])
        at = len(content) if size < 0 else at + 12 + size
    rate, form, flags, _, _, channels, bits = struct.unpack(">d4s5I", parts[b"desc"][:32])
    if form != b"lpcm":
        raise KeyError(form)
    return parts[b"data"][4:], "i1" if bits == 8 else f"{'<' if flags & 2 else '>'}{'f' if flags & 1 else 'i'}{bits // 8}", channels, round(rate)


def read_pcm(content: bytes) -> tuple[np.ndarray, int]:
    """Mono float samples and rate of a WAV, AIFF, AU or CAF file with PCM or float samples."""
    magic = content[:4]
    if magic not in (b"RIFF", b"FORM", b".snd", b"caff"):
        raise TextFailure("runtime_unavailable", "no decoder but for PCM sound is installed")
    try:
        raw, kind, channels, rate = {b"RIFF": _wave, b"FORM": _aiff, b".snd": _au, b"caff": _caf}[magic](content)
        width = int(kind[-1])
        if not 1 <= channels <= 256 or kind[-2] == "i" and width not in (1, 2, 3, 4):
            raise KeyError(channels)
    except KeyError as e:
        raise TextFailure("decode_failed", f"no PCM sound in it: {e}") from None
    except (struct.error, OverflowError, ValueError) as e:
        raise TextFailure("decode_failed", f"cut off: {e}") from None
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)[:, :: 1 if kind[0] == "<" else -1]
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / float(1 << 23)
    else:
        x = np.frombuffer(raw, kind).astype(np.float32)
        x = x if kind[-2] == "f" else (x - 128) / 128 if kind == "u1" else x / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1), rate


def encode_sound(content: bytes) -> tuple[np.ndarray, dict]:
    return encode_samples(*read_pcm(content))


_OUTCOME = T.StructType(
    [T.StructField("state", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("dimensions", "windows", "landmarks")], T.StructField("error", T.StringType())]
)


@F.pandas_udf(_OUTCOME)
def sound_outcomes(contents: pd.Series) -> pd.DataFrame:
    """What becomes of sound files: their state, windows and landmarks, or the error's code."""
    out = []
    for content in contents:
        try:
            vector, seen = encode_sound(content)
            out.append(("ready", len(vector), len(seen["windows"]), seen["landmarks"], None))
        except TextFailure as e:
            out.append(("failed", None, None, None, e.code))
    return pd.DataFrame(out, columns=["state", "dimensions", "windows", "landmarks", "error"])
